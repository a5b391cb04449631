"""Occurrences of joins to edges, nodes and columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EDGE = ["source", "left_table", "right_table", "join_type", "condition"]


def edges(occurrences: DataFrame, file: str = "rel_path") -> DataFrame:
    """One row for each distinct join of a source. An edge is ambiguous or implicit only if every occurrence is."""
    counts = [F.count("*").alias("occurrence_count"), F.countDistinct(file).alias("file_count"), F.bool_and("implicit").alias("implicit"), F.bool_and("ambiguous").alias("ambiguous")]
    if "conditions" in occurrences.columns:
        counts.append(F.max(F.size("conditions")).cast("long").alias("condition_count"))
    return occurrences.groupBy(*EDGE).agg(*counts)


def edge_conditions(occurrences: DataFrame) -> DataFrame:
    """(edge, ordinal, predicate, operator, left_column, right_column) of each distinct edge."""
    slim = occurrences.select(*EDGE, F.posexplode("conditions").alias("ordinal", "c"))
    return slim.select(*EDGE, F.col("ordinal").cast("long").alias("ordinal"), "c.*").distinct()


def incident(edges: DataFrame) -> DataFrame:
    """Each edge once for each of its ends, as table_key; a loop has one end."""
    ends = F.array_distinct(F.array("left_table", "right_table"))
    return edges.select("*", F.explode(ends).alias("table_key"))


def nodes(mentions: DataFrame, edges: DataFrame) -> DataFrame:
    """(source, table_key, file_count, degree, join_count) from (source, table_key, file) and the edges."""
    files = mentions.groupBy("source", "table_key").agg(F.countDistinct("file").alias("file_count"))
    joined = incident(edges).groupBy("source", "table_key").agg(F.count("*").alias("degree"), F.sum("occurrence_count").alias("join_count"))
    out = files.join(joined, ["source", "table_key"], "left")
    return out.select("source", "table_key", "file_count", F.coalesce("degree", F.lit(0)).alias("degree"), F.coalesce("join_count", F.lit(0)).alias("join_count"))


def columns(observed: DataFrame, conditions: DataFrame) -> DataFrame:
    """(source, table_key, name, ref_count, is_join_key) from (source, table_key, name, file) and edge conditions."""
    refs = observed.groupBy("source", "table_key", "name").agg(F.countDistinct("file").alias("ref_count"))
    ends = conditions.select("source", F.explode(F.array("left_column", "right_column")).alias("c")).where("c is not null")
    dot = F.length("c") - F.length(F.substring_index("c", ".", -1))
    keys = ends.select("source", F.substring(F.col("c"), F.lit(1), dot - 1).alias("table_key"), F.substring_index("c", ".", -1).alias("name"), F.lit(0).cast("long").alias("ref_count"), F.lit(True).alias("is_join_key")).distinct()
    both = refs.withColumn("is_join_key", F.lit(False)).unionByName(keys)
    return both.groupBy("source", "table_key", "name").agg(F.max("ref_count").alias("ref_count"), F.bool_or("is_join_key").alias("is_join_key"))
