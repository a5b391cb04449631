"""Exact histogram of encoded lengths, and what follows from its suffix sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from edgeloom.llm._common import stored
from edgeloom.llm.bpe import counted

#: Lengths whose rows are summed in one window; blocks are summed by a second one.
BLOCK = 1 << 8


def histogram(docs: DataFrame, path: str | None = None, pattern: str | None = None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(n_tokens, n_docs): how many documents have each encoded length; counted map-side before the shuffle.

    A null or empty text has length 0; null and repeated doc_ids count like others; an empty table has no rows.
    """
    return counted(docs, path, pattern, text, doc_id).groupBy("n_tokens").agg(F.count("*").alias("n_docs"))


def context_limits(lengths: DataFrame) -> DataFrame:
    """For every length that occurs, as a context limit: n_tokens, n_docs, and

    docs_at_least, tokens_at_least: documents this long or longer, and their tokens;
    truncated_total: tokens kept if every document is cut to n_tokens;
    share_at_most: share of the documents that are no longer than this, from which quantiles are read.

    Suffix sums in two steps: over the lengths of a block of BLOCK lengths, and over the blocks' totals. The one
    unpartitioned window has a row for each block, that is the longest length / BLOCK rows at most.
    """
    table = stored(lengths.withColumn("block", F.floor(F.col("n_tokens") / BLOCK)).withColumn("tokens", F.col("n_tokens") * F.col("n_docs")), "lengths")
    sums = table.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    later = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    blocks = sums.select("block", F.coalesce(F.sum("d").over(later), F.lit(0)).alias("d"), F.coalesce(F.sum("t").over(later), F.lit(0)).alias("t"), F.sum("d").over(whole).alias("all_docs"), F.sum("t").over(whole).alias("all_tokens"))
    down = Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, 0)
    summed = table.withColumn("dd", F.sum("n_docs").over(down)).withColumn("tt", F.sum("tokens").over(down)).join(blocks, "block")
    out = summed.select("n_tokens", "n_docs", (F.col("dd") + F.col("d")).alias("docs_at_least"), (F.col("tt") + F.col("t")).alias("tokens_at_least"), "all_docs", "all_tokens")
    longer = F.col("docs_at_least") * F.col("n_tokens")
    kept = F.col("all_tokens") - F.col("tokens_at_least") + longer
    share = (F.col("all_docs") - F.col("docs_at_least") + F.col("n_docs")) / F.col("all_docs")
    return out.select("n_tokens", "n_docs", "docs_at_least", "tokens_at_least", kept.alias("truncated_total"), share.alias("share_at_most"))


def quantile(limits: DataFrame, q: float) -> DataFrame:
    """(n_tokens): the smallest length that at least a share q of the documents do not exceed."""
    return limits.where(F.col("share_at_most") >= q).agg(F.min("n_tokens").alias("n_tokens"))


def truncated_total(limits: DataFrame, limit: int) -> DataFrame:
    """(tokens): tokens kept if every document is cut to any limit, one that occurs as a length or not."""
    longer = F.col("n_tokens") >= limit
    whole = F.sum(F.when(~longer, F.col("n_tokens") * F.col("n_docs")).otherwise(limit * F.col("n_docs")))
    return limits.agg(F.coalesce(whole, F.lit(0)).alias("tokens"))
