"""A scan: code files to the stored graph."""

from __future__ import annotations

import datetime as dt
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeloom.operators.extract import extract
from edgeloom.plans import rollup
from edgeloom.plans.store import Store
from edgeloom.sources.code_files import code_files
from edgeloom.sources.config import Config, Source

FILE = ["source", "path", "rel_path", "language", "digest", "size_bytes", "root", "branch", "commit_sha", "remote"]


def findings_of(store: Store, files: DataFrame, source: Source, cache: bool) -> DataFrame:
    """What each file says; files whose bytes, language and settings were met before aren't parsed again.

    The cache is an anti-join on the digest, which leaves out the texts of what is known before they are parsed."""
    keyed = files.withColumn("settings", F.lit(source.digest))
    fresh = keyed
    known = None
    if cache and store.knows("findings"):
        keys = ["source", "settings", "language", "digest"]
        old = store.read("findings").where((F.col("source") == source.name) & (F.col("settings") == source.digest))
        old = old.select(*keys, "joins", "tables", "columns", "errors").dropDuplicates(keys)
        known = keyed.drop("text").join(old, keys)
        fresh = keyed.join(old.select(*keys), keys, "left_anti")
    out = extract(fresh, source.settings).withColumn("cached", F.lit(False))
    return out if known is None else out.unionByName(known.withColumn("cached", F.lit(True)))


def scan(spark: SparkSession, config: Config, names: list[str] | None = None, cache: bool = True) -> dict:
    """Scans the named sources (all, if none is named), replaces their rows in all tables of the store in one step, and says what was met."""
    began, clock = dt.datetime.now(dt.UTC), time.time()
    store = Store(spark, config.store)
    sources = config.select(names)
    chosen = [s.name for s in sources]
    found = None
    for s in sources:
        one = findings_of(store, code_files(spark, s), s, cache)
        found = one if found is None else found.unionByName(one)
    staged = found.persist()
    try:
        stats = staged.agg(F.count("*").alias("files_scanned"), F.coalesce(F.sum(F.col("cached").cast("long")), F.lit(0)).alias("files_cached"), F.coalesce(F.sum(F.size("joins")), F.lit(0)).alias("joins_found"), F.coalesce(F.sum(F.size("errors")), F.lit(0)).alias("errors")).first().asDict()
        new = store.replacing(chosen)
        found = new.write("findings", staged)
    finally:
        staged.unpersist()
    new.write("files", found.select(*FILE))
    new.write("parse_errors", found.select("source", "rel_path", F.explode("errors").alias("message")))
    occurrences = new.write("occurrences", found.select("source", "rel_path", "branch", "commit_sha", "remote", F.inline("joins")))
    edges = new.write("edges", rollup.edges(occurrences))
    conditions = new.write("edge_conditions", rollup.edge_conditions(occurrences))
    mentions = found.select("source", F.explode("tables").alias("table_key"), F.col("path").alias("file"))
    new.write("nodes", rollup.nodes(mentions, edges))
    observed = found.select("source", F.inline("columns"), F.col("path").alias("file"))
    new.write("columns", rollup.columns(observed, conditions))
    new.publish()
    stats |= {"sources": len(sources), "duration_ms": int(1000 * (time.time() - clock))}
    row = {"started_at": began.isoformat(timespec="seconds"), **{k: int(v) for k, v in stats.items()}}
    store.append("scans", spark.createDataFrame([row]).coalesce(1))
    return stats
