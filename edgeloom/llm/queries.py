"""The registered queries of the operators, over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeloom.llm import bpe, embed_dedup, langid, mixing, mpeg_audio, simhash, substring_dedup, token_counts, token_store, url_filter
from edgeloom.llm._common import new_path, stored

RULES = [("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block")]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mix(_table(spark, sf_dir, "documents"), weights=(3, 1, 2), share=1.5, most=2.0, plan_only=True)
    return plan.select("doc_id", "size", "source_size", "target", "taken")


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.embedding_groups(_table(spark, sf_dir, "embeddings"), cosine=0.95)


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(_table(spark, sf_dir, "documents"), bpe.default_path("byte_bpe_50k.tiktoken"))


def op4_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.simhash_groups(_table(spark, sf_dir, "documents"))
    return groups.select("doc_id", simhash.hex_of("fp").alias("fingerprint"), "component_id")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filter.judge(_table(spark, sf_dir, "pages"), RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict", "template")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    filters = langid.learn(docs.where(~langid.held_out()))
    return langid.predict(docs.withColumn("held_out", langid.held_out()), filters, ["doc_id", "held_out"])


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substring_dedup.remove_repeats(_table(spark, sf_dir, "documents"))
    words = F.aggregate("removed", F.lit(0), lambda n, x: n + x["end"] - x["begin"])
    return cut.select("doc_id", F.size("removed").cast("long").alias("n_removed"), words.cast("long").alias("chars_removed"), "removed", "text")


def op8_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = new_path(spark, "token-store")
    token_store.write_store(_table(spark, sf_dir, "documents"), target, bpe.default_path("byte_bpe_50k.json"), end_id=0)
    return token_store.read_store(spark, target)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.context_limits(token_counts.histogram(_table(spark, sf_dir, "documents"), bpe.default_path("byte_bpe_50k.json")))


def op10_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = stored(mpeg_audio.to_audio(_table(spark, sf_dir, "documents")), "media", compression="zstd")
    read = mpeg_audio.feature(mpeg_audio.read_audio(media, ["doc_id", "n_bytes"]))
    return read.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "samples", "rate", "seconds", "seek_offsets", "table_kind", "table_agrees")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_mix_sources, op2_embedding_dedup, op3_byte_bpe, op4_simhash_dedup, op5_url_filter, op6_language_id, op7_substring_dedup, op8_token_store, op9_token_counts, op10_mpeg_audio, pipeline)
}

MIX_SQL = r"""
with sized as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size from documents),
totals as (select source, sum(size)::bigint as source_size from sized group by source),
weighed as (select *, source_size * 2.0::double as cap, [3.0::double, 1.0::double, 2.0::double][((row_number() over (order by source nulls last) - 1) % 3 + 1)::int] as weight from totals),
levels as (
  select *, ((sum(source_size) over ())::double * 1.5::double - coalesce(sum(cap) over (order by cap / weight, source nulls last rows between unbounded preceding and 1 preceding), 0.0::double))
    / sum(weight) over (order by cap / weight, source nulls last rows between current row and unbounded following) as level
  from weighed),
flagged as (select *, cap / weight <= level as capped from levels),
rates as (select source, source_size, case when capped then cap else least(cap, max(case when not capped then level end) over () * weight) end as target from flagged),
drawn as (
  select doc_id, size, r.source_size, r.target, case when r.source_size > 0 then r.target / r.source_size else 0.0::double end as rate,
    ('0x' || substr(md5('7:' || coalesce(doc_id::varchar, '')), 1, 13))::bigint / 4503599627370496.0::double as u
  from sized join rates r on sized.source is not distinct from r.source)
select doc_id, size, source_size, target, (size * (floor(rate) + case when u < rate - floor(rate) then 1 else 0 end))::bigint as taken from drawn
"""

ORACLE_SQL = {"op1_mix_sources": MIX_SQL, "op5_url_filter": f"select page_id, host, path, rule, verdict, template from ({url_filter.judge_sql(RULES)})"}
