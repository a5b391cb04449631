"""Questions to the graph: catalogue, neighbourhoods, shortest paths and the relationship model.

Edges need left_table, right_table, occurrence_count and, for filters, source and ambiguous. Path searches keep their
levels as small tables: a level is checkpointed, so plans don't grow with the number of hops.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeloom.plans.rollup import EDGE, incident
from edgeloom.plans.store import shared_dir

#: Edges and nodes up to so many are broadcast to the other side of a search's joins.
SMALL = 200_000


def select_edges(edges: DataFrame, source: str | None = None, min_occurrences: int = 1, ambiguous: bool = True, tables: Sequence[str] | None = None) -> DataFrame:
    """Edges under the usual filters; with tables, those that have both ends among them."""
    out = edges.where(F.col("occurrence_count") >= min_occurrences)
    if source is not None:
        out = out.where(F.col("source") == source)
    if not ambiguous:
        out = out.where(~F.col("ambiguous"))
    if tables is not None:
        keys = [t.lower() for t in tables]
        out = out.where(F.col("left_table").isin(keys) & F.col("right_table").isin(keys))
    return out


def with_ids(edges: DataFrame) -> DataFrame:
    """edges with edge_id, a hash of what identifies an edge, as text; it needs no counter and survives a new scan."""
    return edges.withColumn("edge_id", F.lower(F.hex(F.xxhash64(*EDGE))))


def sources(nodes: DataFrame) -> DataFrame:
    return nodes.select("source").distinct().orderBy("source")


def occurrences_of(occurrences: DataFrame, edge_id: str, limit: int = 100) -> DataFrame:
    """Where an edge occurs, by file and line, with the file's branch, commit and remote."""
    return with_ids(occurrences).where(F.col("edge_id") == edge_id).orderBy("rel_path", "line").limit(limit)


def edge_detail(edges: DataFrame, conditions: DataFrame, occurrences: DataFrame, edge_id: str, limit: int = 100) -> dict | None:
    """An edge with its conditions in order and its first occurrences; None if there is no such edge."""
    row = with_ids(edges).where(F.col("edge_id") == edge_id).first()
    if row is None:
        return None
    parts = with_ids(conditions).where(F.col("edge_id") == edge_id).orderBy("ordinal").select("ordinal", "predicate", "operator", "left_column", "right_column")
    seen = occurrences_of(occurrences, edge_id, limit).select("rel_path", "line", "language", "branch", "commit_sha", "remote")
    return row.asDict() | {"conditions": [r.asDict() for r in parts.collect()], "occurrences": [r.asDict() for r in seen.collect()]}


def top_edges(edges: DataFrame, limit: int = 5000) -> DataFrame:
    return edges.orderBy(F.desc("occurrence_count"), *[c for c in EDGE if c in edges.columns]).limit(limit)


def top_nodes(nodes: DataFrame, search: str | None = None, source: str | None = None, limit: int = 500) -> DataFrame:
    """Nodes by joins, files and name; search is found anywhere in the key, with % and _ as wildcards."""
    out = nodes if search is None else nodes.where(F.col("table_key").like(f"%{search.lower()}%"))
    out = out if source is None else out.where(F.col("source") == source)
    return out.orderBy(F.desc("join_count"), F.desc("file_count"), "table_key", *(["source"] if "source" in nodes.columns else [])).limit(limit)


def adjacency(edges: DataFrame) -> DataFrame:
    """(a, b, weight): every edge both ways; edges between the same tables are parallel."""
    ends = F.array(F.struct(F.col("left_table").alias("a"), F.col("right_table").alias("b")), F.struct(F.col("right_table").alias("a"), F.col("left_table").alias("b")))
    return edges.select(F.inline(ends), F.col("occurrence_count").alias("weight"))


def checked(df: DataFrame) -> DataFrame:
    """df, its lineage cut by a checkpoint in the cluster's folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(SMALL + 1).count() <= SMALL else df


def distances(edges: DataFrame, start: str, depth: int) -> DataFrame:
    """(table_key, distance) of all tables within depth joins of start; start itself is at 0 whether it exists or not."""
    near = checked(adjacency(edges).select("a", "b").distinct())
    seen = edges.sparkSession.createDataFrame([(start.lower(), 0)], "table_key string, distance int")
    frontier = seen
    for level in range(1, depth + 1):
        reached = near.join(_small(frontier), F.col("a") == F.col("table_key"), "left_semi").select(F.col("b").alias("table_key")).distinct()
        frontier = checked(reached.join(seen, "table_key", "left_anti").withColumn("distance", F.lit(level)))
        seen = seen.unionByName(frontier)
    return seen


def neighbourhood(edges: DataFrame, start: str, depth: int = 1) -> DataFrame:
    """Edges met on the way: those of a table nearer than depth, with both ends reached."""
    seen = checked(distances(edges, start, depth))
    inner = _small(seen.where(F.col("distance") < depth).select("table_key"))
    ends = lambda side: edges.join(inner, F.col(side) == F.col("table_key"), "left_semi")
    return ends("left_table").union(ends("right_table")).distinct()


def nodes_by_key(nodes: DataFrame, keys: Sequence[str], source: str | None = None) -> DataFrame:
    """The nodes of the named tables, in one source or in all."""
    out = nodes.where(F.col("table_key").isin([k.lower() for k in keys]))
    return out if source is None else out.where(F.col("source") == source)


def surroundings(edges: DataFrame, nodes: DataFrame, start: str, depth: int = 1, limit: int = 300) -> tuple[DataFrame, DataFrame]:
    """(nodes with their distance, edges) around a table: the `limit` nearest tables, by distance and name, and the edges
    met on the way that have both ends among them. Both are empty if no edge has the table."""
    near = distances(edges, start, depth).orderBy("distance", "table_key").limit(limit)
    near = checked(near.join(incident(edges).select("table_key").distinct(), "table_key", "left_semi"))
    met = neighbourhood(edges, start, depth)
    keys = _small(near.select("table_key"))
    inside = met.join(keys, F.col("left_table") == F.col("table_key"), "left_semi").join(keys, F.col("right_table") == F.col("table_key"), "left_semi")
    return nodes.join(_small(near), "table_key"), inside


def subgraph(edges: DataFrame, nodes: DataFrame, limit: int = 400) -> tuple[DataFrame, DataFrame]:
    """The busiest tables: (nodes, edges) of the limit top tables, edges inside them, and tables that have one."""
    ranked = top_nodes(nodes, limit=limit)
    keys = _small(ranked.select("table_key").distinct())
    inside = edges.join(keys, F.col("left_table") == F.col("table_key"), "left_semi").join(keys, F.col("right_table") == F.col("table_key"), "left_semi")
    linked = incident(inside).select("table_key").distinct()
    return ranked.join(linked, "table_key", "left_semi"), inside


def shortest_path(edges: DataFrame, start: str, end: str, max_hops: int = 8) -> DataFrame:
    """(tables, occurrences, hops, total) of the path with fewest joins, and of those the best attested one.

    Level by level the best path to each newly reached table is kept: more occurrences in total, then the path's text.
    occurrences holds those of each edge on the path. No row if there is none; a table is a path to itself."""
    start, end = start.lower(), end.lower()
    schema = "at string, tables array<string>, occurrences array<bigint>, total bigint"
    level = edges.sparkSession.createDataFrame([(start, [start], [], 0)], schema)
    if start == end:
        return level.select("tables", "occurrences", F.lit(0).alias("hops"), "total")
    near = checked(adjacency(edges).groupBy("a", "b").agg(F.max("weight").alias("weight")))
    seen = level.select("at")
    for hop in range(1, max_hops + 1):
        step = near.join(_small(level), F.col("a") == F.col("at")).select(F.col("b").alias("at"), F.concat("tables", F.array("b")).alias("tables"), F.concat("occurrences", F.array("weight")).alias("occurrences"), (F.col("total") + F.col("weight")).alias("total"))
        step = step.join(seen, "at", "left_anti")
        best = F.min_by(F.struct("tables", "occurrences", "total"), F.struct(-F.col("total"), F.array_join("tables", ">"))).alias("p")
        level = checked(step.groupBy("at").agg(best).select("at", "p.*"))
        found = level.where(F.col("at") == end)
        if found.take(1):
            return found.select("tables", "occurrences", F.lit(hop).alias("hops"), "total")
        if not level.take(1):
            break
        seen = checked(seen.union(level.select("at")))
    return level.where("false").select("tables", "occurrences", F.lit(0).alias("hops"), "total")


def shortest_paths(edges: DataFrame, start: str, end: str, k: int = 3, max_hops: int = 8) -> DataFrame:
    """Up to k paths, each found after the least attested edge of the one before was taken out.

    Adds rank from 1. Parallel edges may give a route over the same tables again."""
    keyed = edges.withColumn("__key", F.xxhash64(*[c for c in EDGE if c in edges.columns]))
    banned: list[int] = []
    out: list[DataFrame] = []
    for rank in range(1, k + 1):
        usable = keyed.where(~F.col("__key").isin(banned)) if banned else keyed
        path = shortest_path(usable, start, end, max_hops)
        row = path.first()
        if row is None:
            break
        out.append(path.withColumn("rank", F.lit(rank)))
        if len(row["tables"]) < 2:
            break
        hops = list(zip(row["tables"], row["tables"][1:], row["occurrences"], strict=False))
        a, b, weight = min(hops, key=lambda h: h[2])
        same = F.least("left_table", "right_table") == min(a, b)
        hit = usable.where(same & (F.greatest("left_table", "right_table") == max(a, b)) & (F.col("occurrence_count") == weight)).orderBy("__key").first()
        banned.append(hit["__key"])
    if not out:
        return shortest_path(keyed.where("false"), start, end, 1).withColumn("rank", F.lit(0)).where("false")
    return reduce(DataFrame.unionByName, out)


def weakest_link(paths: DataFrame) -> DataFrame:
    """paths with the occurrences of the least attested edge; 0 for a path without edges."""
    return paths.withColumn("weakest_link", F.coalesce(F.array_min("occurrences"), F.lit(0)))


def column_pairs(conditions: DataFrame) -> DataFrame:
    """(left_table, right_table, left_name, right_name, operator) of plain comparisons, turned to the edge's order."""
    of = lambda side, table: F.when(F.col(side).startswith(F.concat(F.col(table), F.lit("."))), F.substring(F.col(side), F.length(table) + 2, F.length(side)))
    straight = of("left_column", "left_table"), of("right_column", "right_table")
    turned = of("right_column", "left_table"), of("left_column", "right_table")
    ok = straight[0].isNotNull() & straight[1].isNotNull()
    left, right = (F.when(ok, straight[i]).otherwise(turned[i]) for i in (0, 1))
    # fixed values: comparisons whose sides change places
    flip = F.create_map(*(F.lit(x) for x in ("<", ">", ">", "<", "<=", ">=", ">=", "<=")))
    operator = F.when(ok, F.col("operator")).otherwise(F.coalesce(F.element_at(flip, F.col("operator")), F.col("operator")))
    out = conditions.where("left_column is not null and right_column is not null").select("left_table", "right_table", left.alias("left_name"), right.alias("right_name"), operator.alias("operator"))
    return out.where("left_name is not null and right_name is not null").distinct()


def model(nodes: DataFrame, edges: DataFrame, columns: DataFrame, conditions: DataFrame, limit: int = 200) -> tuple[DataFrame, DataFrame]:
    """(tables, relationships): tables with their columns, join keys of the shown relationships first."""
    shown, inside = subgraph(edges, nodes, limit)
    pairs = column_pairs(conditions.join(inside.select(*EDGE), EDGE, "left_semi"))
    keys = pairs.select(F.inline(F.array(F.struct(F.col("left_table").alias("table_key"), F.col("left_name").alias("name")), F.struct(F.col("right_table").alias("table_key"), F.col("right_name").alias("name"))))).distinct().withColumn("is_join_key", F.lit(True))
    named = columns.groupBy("table_key", "name").agg(F.max("ref_count").alias("ref_count")).join(keys, ["table_key", "name"], "full")
    ordered = F.array_sort(F.collect_list(F.struct((~F.coalesce("is_join_key", F.lit(False))).alias("plain"), "name")))
    listed = named.groupBy("table_key").agg(F.transform(ordered, lambda c: F.struct(c["name"].alias("name"), (~c["plain"]).alias("is_join_key"))).alias("columns"))
    return shown.join(listed, "table_key", "left"), pairs


def summary(nodes: DataFrame, edges: DataFrame, occurrences: DataFrame, files: DataFrame) -> DataFrame:
    count = lambda df, name: df.agg(F.count("*").alias(name))
    return count(nodes, "tables").crossJoin(count(edges, "joins")).crossJoin(count(occurrences, "occurrences")).crossJoin(count(files, "files"))
