"""Scans as a stream: new code files are parsed as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from edgeloom.operators.extract import extract
from edgeloom.sources.code_files import decoded, language_of

BINARY = "path string, modificationTime timestamp, length long, content binary"


def arriving(spark: SparkSession, folder: str, source: str = "stream") -> DataFrame:
    """(source, rel_path, language, text) of the code files that come into a folder."""
    files = spark.readStream.format("binaryFile").schema(BINARY).option("recursiveFileLookup", True).load(folder)
    language = language_of(F.col("path"))
    return files.select(F.lit(source).alias("source"), F.regexp_extract("path", r"([^/]+)$", 1).alias("rel_path"), language.alias("language"), decoded(F.col("content")).alias("text")).where("language is not null")


def follow(spark: SparkSession, folder: str, target: str, checkpoint: str, settings: dict | None = None, once: bool = True) -> StreamingQuery:
    """Appends the joins of arriving files to a Parquet table, each file exactly once."""
    joins = extract(arriving(spark, folder), settings).select("source", "rel_path", F.inline("joins"))
    writer = joins.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()
