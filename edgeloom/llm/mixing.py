"""Mixing sources to target weights."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edgeloom.llm._common import BROADCAST_ROWS, free_name, stored

#: A word: what stands between ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"


def words(text: str) -> Column:
    """Number of words of a text; null has none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def targets(totals: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """Adds target to (source, source_size): the size that the mix takes of each source.

    All sources together get share times their sizes, dealt by weight. A target stops at most times its source's size
    and the excess is dealt again by weight until no target is above. That process has one fixed point, level x
    weight below the caps: sources are met in order of cap / weight, and a source is capped if the level that the
    rest would have is not below its ratio. Weights repeat over the sources in code point order, null last. The one
    unpartitioned window runs over a row for each source, not over documents.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*(F.lit(float(w)) for w in weights))
    ranked = totals.withColumn("weight", F.element_at(cycle, ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("cap", F.col("source_size") * F.lit(float(most)))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, rest = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy()
    ranked = ranked.withColumn("level", (F.sum("source_size").over(whole) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest))
    capped = F.col("cap") / F.col("weight") <= F.col("level")
    level = F.max(F.when(~capped, F.col("level"))).over(whole)  # that of the first one below its cap
    return ranked.select("source", "source_size", F.when(capped, F.col("cap")).otherwise(F.least("cap", level * F.col("weight"))).alias("target"))


def draw(doc_id: str, seed: int) -> Column:
    """A number in [0, 1) that depends on the document's id and the seed alone."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def mix(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 7, plan_only: bool = False, text: str = "text", source: str = "source", doc_id: str = "doc_id") -> DataFrame:
    """Every document floor(rate) times, and once more with a probability equal to the rate's fraction.

    rate = target / size of the document's source (see targets). The draw is a hash of seed and doc_id, so reruns and
    retried tasks agree; rows that share a doc_id share the draw. With plan_only the result has one row for each
    document instead, without its other columns: doc_id, size, source_size, target, copies, taken. Sizes are words.

    Nulls: a null text or one without words has size 0 and follows its source's rate; a null source is a source like
    any other, the last in order; null doc_ids share one draw. A source without words has target 0 and rate 0. An
    empty table gives an empty result. Other columns are kept as they are, whatever their names.

    Only (doc_id, source, size) is written and read back, once; a source that holds most rows is pre-aggregated
    map-side, and rates are joined by broadcast when there are at most BROADCAST_ROWS sources, else by shuffle.
    """
    id_, source_, size_ = F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), words(text).alias("size")
    sized = stored(docs.select(id_, source_, size_), "sizes") if plan_only else docs.select(source_, size_)
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    rates = stored(targets(totals, weights, share, most), "rates")
    sized_for_all = F.broadcast if rates.count() <= BROADCAST_ROWS else lambda df: df
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    if plan_only:
        joined = sized.alias("d").join(sized_for_all(rates.alias("r")), F.col("d.source").eqNullSafe(F.col("r.source")))
        copies = F.floor(rate) + F.when(draw("doc_id", seed) < rate - F.floor(rate), 1).otherwise(0)
        out = joined.select("doc_id", "size", "source_size", "target", copies.cast("long").alias("copies"))
        return out.withColumn("taken", F.col("size") * F.col("copies"))
    # the rate travels under names that no column of docs has
    free, of = (free_name(docs.columns, n) for n in ("__rate", "__rate_of"))
    slim = rates.select(F.col("source").alias(of), rate.alias(free))
    joined = docs.join(sized_for_all(slim), F.col(source).eqNullSafe(F.col(of)))
    copies = F.floor(F.col(free)) + F.when(draw(doc_id, seed) < F.col(free) - F.floor(F.col(free)), 1).otherwise(0)
    emitted = joined.withColumn(free, F.explode(F.array_repeat(F.lit(1), copies.cast("int"))))
    return emitted.select(*docs.columns)
