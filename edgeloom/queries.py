"""Registered queries of the join graph, each with its SQL.

The tables hold no code, so an occurrence of a join is a line item whose customer and supplier are of different
nations, its file is the order and its source the market segment; and code is written from rows, by templates whose
expected edges SQL can say.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeloom.functions import canonical, naming
from edgeloom.operators.extract import extract
from edgeloom.plans import graph, rollup, store

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- the graph of nations

OCC = """occ as (
  select lower(c_mktsegment) as source, least(lower(cn.n_name), lower(sn.n_name)) as left_table, greatest(lower(cn.n_name), lower(sn.n_name)) as right_table,
    'INNER' as join_type, l_orderkey::varchar as rel_path, l_linenumber as line, l_returnflag = 'R' as implicit, l_linestatus = 'O' as ambiguous
  from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join supplier on l_suppkey = s_suppkey
  join nation cn on c_nationkey = cn.n_nationkey join nation sn on s_nationkey = sn.n_nationkey where cn.n_name <> sn.n_name)"""
EDGES = f"""{OCC}, edges as (
  select source, left_table, right_table, join_type, left_table || '.k = ' || right_table || '.k' as condition, count(*) as occurrence_count, count(distinct rel_path) as file_count,
    bool_and(implicit) as implicit, bool_and(ambiguous) as ambiguous from occ group by source, left_table, right_table, join_type)"""
WHOLE = f"{OCC}, whole as (select left_table, right_table, count(*) as occurrence_count from occ group by all)"
ENDS = "ends as (select min(left_table) as a, max(right_table) as b from whole)"
ADJ = "adj as (select left_table as a, right_table as b, occurrence_count as weight from whole union all select right_table, left_table, occurrence_count from whole)"
NODES = """mentions as (select source, left_table as table_key, rel_path from occ union all select source, right_table, rel_path from occ),
  ends2 as (select source, left_table as table_key, occurrence_count from edges union all select source, right_table, occurrence_count from edges),
  f as (select source, table_key, count(distinct rel_path) as file_count from mentions group by all),
  g as (select source, table_key, count(*) as degree, sum(occurrence_count)::bigint as join_count from ends2 group by all),
  nodes as (select source, table_key, file_count, coalesce(degree, 0) as degree, coalesce(join_count, 0)::bigint as join_count from f left join g using (source, table_key))"""


def occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as occurrences of joins between nations; dimensions are joined first where they are smallest."""
    t = lambda name: table(spark, sf_dir, name)
    nation = t("nation").select("n_nationkey", F.lower("n_name").alias("n_name"))
    customer = t("customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.lower("c_mktsegment").alias("source"), F.col("n_name").alias("a"))
    supplier = t("supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_name").alias("b"))
    orders = t("orders").select("o_orderkey", "o_custkey").join(customer, F.col("o_custkey") == F.col("c_custkey"))
    lines = t("lineitem").select("l_orderkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_linestatus")
    joined = lines.join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(orders, F.col("l_orderkey") == F.col("o_orderkey")).where("a <> b")
    left, right = F.least("a", "b"), F.greatest("a", "b")
    return joined.select("source", left.alias("left_table"), right.alias("right_table"), F.lit("INNER").alias("join_type"), F.concat(left, F.lit(".k = "), right, F.lit(".k")).alias("condition"), F.col("l_orderkey").cast("string").alias("rel_path"), F.col("l_linenumber").alias("line"), (F.col("l_returnflag") == "R").alias("implicit"), (F.col("l_linestatus") == "O").alias("ambiguous"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.edges(occurrences(spark, sf_dir))


def whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges over all sources, kept for the path queries' many steps."""
    return graph.checked(occurrences(spark, sf_dir).groupBy("left_table", "right_table").agg(F.count("*").alias("occurrence_count")))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = occurrences(spark, sf_dir)
    mentions = seen.select("source", F.explode(F.array("left_table", "right_table")).alias("table_key"), F.col("rel_path").alias("file"))
    return rollup.nodes(mentions, rollup.edges(seen))


EDGE_COLUMNS = "source, left_table, right_table, join_type, condition, occurrence_count, file_count, implicit, ambiguous"


@query(f"with {EDGES} select {EDGE_COLUMNS} from edges")
def edges_rollup(spark, sf_dir):
    return edges(spark, sf_dir)


@query(f"with {EDGES} select {EDGE_COLUMNS} from edges where occurrence_count >= 20")
def edges_min_occ(spark, sf_dir):
    return graph.select_edges(edges(spark, sf_dir), min_occurrences=20)


@query(f"with {EDGES} select {EDGE_COLUMNS} from edges where not ambiguous and source = 'building'")
def edges_confident(spark, sf_dir):
    return graph.select_edges(edges(spark, sf_dir), source="building", ambiguous=False)


@query(f"with {EDGES} select source, ambiguous, implicit, count(*) as n from edges group by all")
def edge_flags(spark, sf_dir):
    return edges(spark, sf_dir).groupBy("source", "ambiguous", "implicit").agg(F.count("*").alias("n"))


@query(f"with {EDGES} select {EDGE_COLUMNS} from edges order by occurrence_count desc, source, left_table, right_table limit 50")
def edges_topk(spark, sf_dir):
    return graph.top_edges(edges(spark, sf_dir), 50)


@query(f"with {EDGES} select {EDGE_COLUMNS} from edges where left_table in ('nation_1', 'nation_2', 'nation_3', 'nation_4') and right_table in ('nation_1', 'nation_2', 'nation_3', 'nation_4')")
def edges_within_set(spark, sf_dir):
    return graph.select_edges(edges(spark, sf_dir), tables=["Nation_1", "Nation_2", "Nation_3", "Nation_4"])


@query(f"with {EDGES}, {NODES} select * from nodes")
def nodes_rollup(spark, sf_dir):
    return nodes(spark, sf_dir)


@query(f"with {EDGES}, {NODES} select * from nodes order by join_count desc, file_count desc, table_key, source limit 20")
def nodes_topk(spark, sf_dir):
    return graph.top_nodes(nodes(spark, sf_dir), limit=20)


@query(f"with {EDGES}, {NODES} select * from nodes where table_key like '%n_1%' order by join_count desc, file_count desc, table_key, source limit 500")
def nodes_search(spark, sf_dir):
    return graph.top_nodes(nodes(spark, sf_dir), search="N_1")


@query(f"with {EDGES}, {NODES} select (select count(*) from nodes) as tables, (select count(*) from edges) as joins, (select count(*) from occ) as occurrences, (select count(distinct rel_path) from occ) as files")
def summary_counts(spark, sf_dir):
    seen = occurrences(spark, sf_dir)
    return graph.summary(nodes(spark, sf_dir), rollup.edges(seen), seen, seen.select("rel_path").distinct())


@query(f"with {OCC} select source, rel_path, line, left_table, right_table from occ where left_table = 'nation_1' order by rel_path, line, source, right_table limit 100")
def edge_occurrences(spark, sf_dir):
    seen = occurrences(spark, sf_dir).where("left_table = 'nation_1'")
    return seen.orderBy("rel_path", "line", "source", "right_table").limit(100).select("source", "rel_path", "line", "left_table", "right_table")


@query(f"with {WHOLE}, {ADJ} select * from adj")
def adjacency(spark, sf_dir):
    return graph.adjacency(whole(spark, sf_dir))


def _ends(e: DataFrame) -> tuple[str, str]:
    row = e.agg(F.min("left_table").alias("a"), F.max("right_table").alias("b")).first()
    return row["a"] or "", row["b"] or ""


NEAR = """seen(t, d) as (select a, 0 from ends union select adj.b, d + 1 from seen join adj on adj.a = t where d < {depth}), best as (select t, min(d) as d from seen group by t)"""
AROUND = "select distinct left_table, right_table, occurrence_count from whole where exists (select 1 from best where d < {depth} and t in (left_table, right_table))"


def _near(depth: int) -> str:
    return f"with recursive {WHOLE}, {ENDS}, {ADJ}, {NEAR.format(depth=depth)} {AROUND.format(depth=depth)}"


@query(_near(1))
def neighbourhood_d1(spark, sf_dir):
    e = whole(spark, sf_dir)
    return graph.neighbourhood(e, _ends(e)[0], 1)


@query(_near(2))
def neighbourhood_d2(spark, sf_dir):
    e = whole(spark, sf_dir)
    return graph.neighbourhood(e, _ends(e)[0], 2)


def _routes(k: int) -> str:
    """k routes, each found after the least attested edge of the one before was taken out: of those with fewest joins the
    best attested one. Only tables that a step brings nearer to the end are walked through."""
    parts = [WHOLE, ENDS, "e1 as (select * from whole)"]
    for i in range(1, k + 1):
        parts += [
            f"adj{i} as (select left_table as a, right_table as b, occurrence_count as weight from e{i} union all select right_table, left_table, occurrence_count from e{i})",
            f"seen{i}(t, d) as (select a, 0 from ends union select adj{i}.b, d + 1 from seen{i} join adj{i} on adj{i}.a = t where d < 8)",
            f"near{i} as (select t, min(d) as d from seen{i} group by t)",
            f"""p{i}(cur, tables, occurrences, total) as (select a, [a], []::bigint[], 0::bigint from ends
              union all select adj{i}.b, list_append(tables, adj{i}.b), list_append(occurrences, weight), (total + weight)::bigint from p{i} join adj{i} on adj{i}.a = cur join near{i} on t = adj{i}.b and d = len(tables))""",
            f"best{i} as (select tables, occurrences, total, list_position(occurrences, list_min(occurrences)) as pos from p{i} where cur = (select b from ends) order by total desc, array_to_string(tables, '>') limit 1)",
            f"e{i + 1} as (select e{i}.* from e{i} left join best{i} on left_table = least(tables[pos], tables[pos + 1]) and right_table = greatest(tables[pos], tables[pos + 1]) where pos is null)",
        ]
    return f"with recursive {', '.join(parts)}"


@query(f"{_routes(1)} select array_to_string(tables, '>') as route, len(tables) - 1 as hops, total from best1")
def shortest_path(spark, sf_dir):
    e = whole(spark, sf_dir)
    return graph.shortest_path(e, *_ends(e)).select(F.array_join("tables", ">").alias("route"), F.col("hops").cast("long").alias("hops"), "total")


@query(f"{_routes(1)} select array_to_string(tables, '>') as route, coalesce(list_min(occurrences), 0) as weakest_link from best1")
def weakest_link(spark, sf_dir):
    e = whole(spark, sf_dir)
    return graph.weakest_link(graph.shortest_path(e, *_ends(e))).select(F.array_join("tables", ">").alias("route"), "weakest_link")


@query(f"{_routes(3)} {' union all '.join(f"select {i} as rank, array_to_string(tables, '>') as route, len(tables) - 1 as hops, total from best{i}" for i in (1, 2, 3))}")
def k_paths(spark, sf_dir):
    e = whole(spark, sf_dir)
    return graph.shortest_paths(e, *_ends(e), k=3).select("rank", F.array_join("tables", ">").alias("route"), F.col("hops").cast("long").alias("hops"), "total")


TOP_NODES = "top as (select table_key from (select table_key, sum(join_count) as j, sum(file_count) as f from nodes group by table_key) order by j desc, f desc, table_key limit 10)"


def _all_nodes(spark, sf_dir):
    return nodes(spark, sf_dir).groupBy("table_key").agg(F.sum("join_count").alias("join_count"), F.sum("file_count").alias("file_count"))


@query(f"with {EDGES}, {NODES}, {TOP_NODES} select {EDGE_COLUMNS} from edges where left_table in (select table_key from top) and right_table in (select table_key from top)")
def subgraph_core(spark, sf_dir):
    return graph.subgraph(edges(spark, sf_dir), _all_nodes(spark, sf_dir), 10)[1]


COND = "cond as (select source, left_table, right_table, join_type, condition, case when length(left_table) % 2 = 0 then '<' else '=' end as operator, case when length(right_table) % 2 = 0 then right_table || '.rk' else left_table || '.lk' end as left_column, case when length(right_table) % 2 = 0 then left_table || '.lk' else right_table || '.rk' end as right_column from edges)"


def conditions(e: DataFrame) -> DataFrame:
    """A plain comparison for every edge, its sides in the edge's order or not."""
    left, right = F.concat("left_table", F.lit(".lk")), F.concat("right_table", F.lit(".rk"))
    turned = F.length("right_table") % 2 == 0
    return e.select(*rollup.EDGE, F.when(F.length("left_table") % 2 == 0, "<").otherwise("=").alias("operator"), F.when(turned, right).otherwise(left).alias("left_column"), F.when(turned, left).otherwise(right).alias("right_column"))


@query(f"with {EDGES}, {COND} select distinct left_table, right_table, 'lk' as left_name, 'rk' as right_name, case when operator = '<' and length(right_table) % 2 = 0 then '>' else operator end as operator from cond")
def model_relationships(spark, sf_dir):
    return graph.column_pairs(conditions(edges(spark, sf_dir)))


@query(
    f"with {EDGES}, {COND}, refs as (select source, left_table as table_key, 'lk' as name, count(distinct rel_path) as ref_count from occ group by all), keys as (select source, left_table as table_key, 'lk' as name from cond union select source, right_table, 'rk' from cond) "
    "select coalesce(refs.source, keys.source) as source, coalesce(refs.table_key, keys.table_key) as table_key, coalesce(refs.name, keys.name) as name, coalesce(ref_count, 0) as ref_count, keys.name is not null as is_join_key from refs full join keys on refs.source = keys.source and refs.table_key = keys.table_key and refs.name = keys.name"
)
def model_columns(spark, sf_dir):
    seen = occurrences(spark, sf_dir)
    observed = seen.select("source", F.col("left_table").alias("table_key"), F.lit("lk").alias("name"), F.col("rel_path").alias("file"))
    return rollup.columns(observed, conditions(rollup.edges(seen)))


@query(f"with {EDGES} select source, left_table, right_table, case when source = 'building' then occurrence_count + 1000 else occurrence_count end as occurrence_count from edges")
def replace_partition(spark, sf_dir):
    slim = edges(spark, sf_dir).select("source", "left_table", "right_table", "occurrence_count")
    kept = store.Store(spark, store.scratch(spark, "store"))
    all_of = kept.replacing([r["source"] for r in slim.select("source").distinct().collect()])  # market segments
    all_of.write("edges", slim)
    all_of.publish()
    one = kept.replacing(["building"])
    one.write("edges", kept.read("edges").where("source = 'building'").withColumn("occurrence_count", F.col("occurrence_count") + 1000))
    one.publish()
    kept.replacing(["building"]).write("edges", slim)  # never published, so never seen
    return kept.read("edges")


# ---- names, filters and files

RENAMES = [("^www\\.", ""), ("example", "sample")]
URL_PATH = "list_filter(string_split(regexp_replace(trim(url), '^[A-Za-z][A-Za-z0-9+.\\-]*:/+', ''), '/'), lambda s: s <> '' and not contains(s, '=') and not contains(s, '*'))"


@query(f"with p as (select page_id, list_transform({URL_PATH}, lambda s: lower(regexp_replace(s, '\\.[A-Za-z0-9]+$', ''))) as parts from pages) select page_id, nullif(array_to_string(list_filter(parts[-2:], lambda s: s <> ''), '.'), '') as table_key from p")
def path_to_table(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", naming.path_table_column(F.col("url")).alias("table_key"))


HOST = "regexp_extract(url, '://([^/?#]*)', 1)"


def _host() -> Column:
    return F.regexp_extract("url", "://([^/?#]*)", 1)


@query(f"select page_id, lower(regexp_replace(regexp_replace({HOST}, '(?i)^www\\.', '', 'g'), '(?i)example', 'sample', 'g')) as table_key from pages")
def table_rewrite(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", naming.rewritten(_host(), RENAMES).alias("table_key"))


@query(f"select page_id, {HOST} as table_key from pages where regexp_matches({HOST}, '(?i:com$)|(?i:ORG$)') and not regexp_matches({HOST}, '(?i)^Blog')")
def table_filter(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", _host().alias("table_key")).where(naming.accepted(F.col("table_key"), ["com$", "ORG$"], ["^Blog"]))


@query(f"with p as (select page_id, string_split(lower({HOST}), '.') as parts from pages) select page_id, case when len(parts) > 2 then array_to_string(parts[:len(parts) - 2], '.') end as catalog, case when len(parts) > 1 then parts[len(parts) - 1] end as schema_name, parts[len(parts)] as table_name from p")
def name_parse(spark, sf_dir):
    catalog, schema, name = naming.name_parts(F.concat(F.lit(" "), F.upper(_host()), F.lit(" ; ")))
    return table(spark, sf_dir, "pages").select("page_id", catalog.alias("catalog"), schema.alias("schema_name"), name.alias("table_name"))


KINDS = ["left", "LEFT JOIN", "left_outer", "fullouter", "semi", "leftanti", "cross", "join", "right outer join", "odd"]
KIND_SQL = f"({KINDS!r})[(l_linenumber - 1 + l_orderkey)::bigint % {len(KINDS)} + 1]"
NORMAL_SQL = f"case {' '.join(f'when k = {k!r} then {canonical.join_type(k)!r}' for k in KINDS)} end"


def _kinds(spark, sf_dir) -> DataFrame:
    at = ((F.col("l_linenumber") - 1 + F.col("l_orderkey")) % len(KINDS)).cast("int")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.get(F.array(*map(F.lit, KINDS)), at).alias("k"))


@query(f"with t as (select {KIND_SQL} as k from lineitem) select k, {NORMAL_SQL} as join_type, count(*) as n from t group by all")
def join_type_norm(spark, sf_dir):
    return _kinds(spark, sf_dir).groupBy("k", canonical.join_type_column(F.col("k")).alias("join_type")).agg(F.count("*").alias("n"))


@query(f"with t as (select {KIND_SQL} as k from lineitem), u as (select {NORMAL_SQL} as j from t) select j as join_type, case when starts_with(j, 'LEFT') then replace(j, 'LEFT', 'RIGHT') when starts_with(j, 'RIGHT') then replace(j, 'RIGHT', 'LEFT') else j end as mirrored, count(*) as n from u group by all")
def join_type_mirror(spark, sf_dir):
    kind = canonical.join_type_column(F.col("k"))
    return _kinds(spark, sf_dir).select(kind.alias("join_type")).groupBy("join_type", canonical.mirrored_column(F.col("join_type")).alias("mirrored")).agg(F.count("*").alias("n"))


@query(r"select doc_id, length(text) >= 12 and (regexp_matches(text, '(?i)\bjoin\b') or regexp_matches(text, '(?is)\b(create|delete|insert|merge|select|update|with)\b.*\bfrom\b')) as is_sql from documents")
def looks_like_sql(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", naming.looks_like_sql(F.col("text")).alias("is_sql"))


@query(r"select doc_id from documents where regexp_matches(lower(text), '\b(from|join)\b')")
def sql_hint(spark, sf_dir):
    return table(spark, sf_dir, "documents").where(F.col("text").rlike(naming.SQL_HINT)).select("doc_id")


@query("select doc_id, md5(regexp_replace(regexp_replace(text, '(?m)^(\\S)', '#\\1', 'g'), '(?m)^([ \\t]*)#[^\\n]*$', '\\1', 'g')) as digest from documents")
def hash_comment_strip(spark, sf_dir):
    marked = F.regexp_replace("text", r"(?m)^(\S)", "#$1")
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(naming.without_hash_comments(marked).cast("binary")).alias("digest"))


GLOBS = ["**/en/*", "*.html", "*/de/[0-4]*"]


@query("select page_id from (select page_id, regexp_replace(url, '^[a-z]+://', '') as rel from pages) where rel = 'en' or regexp_matches(rel, '(^|/)en/') or ends_with(rel, '.html') or regexp_matches(rel, '/de/[0-4]')")
def glob_filter(spark, sf_dir):
    rel = F.regexp_replace("url", "^[a-z]+://", "")
    return table(spark, sf_dir, "pages").where(rel.rlike("|".join(naming.glob_regex(g) for g in GLOBS))).select("page_id")


@query("select page_id, url as remote from pages")
def remote_scrub(spark, sf_dir):
    secret = F.regexp_replace("url", "://", "://user:s3cret@")
    return table(spark, sf_dir, "pages").select("page_id", naming.scrubbed(secret).alias("remote"))


@query("select d.doc_id, e.n > 1 as cached from (select doc_id, sha256(text) as digest from documents) d join (select sha256(text) as digest, count(*) as n from documents group by 1) e using (digest)")
def cache_probe(spark, sf_dir):
    keyed = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))
    known = keyed.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select("digest", F.lit(True).alias("hit"))
    return keyed.join(known, "digest", "left").select("doc_id", F.coalesce("hit", F.lit(False)).alias("cached"))


# ---- extraction: code written from rows

O, C, P = "s{k}.orders", "s{k}.customers", "s{k}.items"
EQ = f"{C}.id = {O}.cid"
READS = f'orders = spark.table("{O}")\ncustomers = spark.table("{C}")\nitems = spark.read.table("{P}")\n'
#: name: (language, code, [(left, type, right, condition, implicit, ambiguous)])
CASES: dict[str, tuple[str, str, list[tuple]]] = {
    "extract_inner": ("sql", f"SELECT * FROM {O} o JOIN {C} c ON o.cid = c.id AND c.active = TRUE", [(C, "INNER", O, EQ, False, False)]),
    "extract_outer": ("sql", f"SELECT 1 FROM {C} c LEFT JOIN {O} o ON o.cid = c.id;\nSELECT 1 FROM {O} o LEFT OUTER JOIN {C} c ON c.id = o.cid; SELECT 1 FROM {O} o FULL OUTER JOIN {P} p ON p.oid = o.id", [(C, "LEFT OUTER", O, EQ, False, False), (C, "RIGHT OUTER", O, EQ, False, False), (P, "FULL OUTER", O, f"{P}.oid = {O}.id", False, False)]),
    "extract_semi": ("sql", f"SELECT 1 FROM {C} c LEFT SEMI JOIN {O} o ON o.cid = c.id; SELECT 1 FROM {C} c LEFT ANTI JOIN {O} o ON o.cid = c.id", [(C, "LEFT SEMI", O, EQ, False, False), (C, "LEFT ANTI", O, EQ, False, False)]),
    "extract_using": ("sql", f"SELECT 1 FROM {O} JOIN {C} USING (cid, region)", [(C, "INNER", O, f"{C}.cid = {O}.cid AND {C}.region = {O}.region", False, False)]),
    "extract_comma": ("sql", f"SELECT 1 FROM {O} o, {C} c WHERE o.cid = c.id AND o.total > 3", [(C, "INNER", O, EQ, True, False)]),
    "extract_cross": ("sql", f"SELECT 1 FROM {O} o CROSS JOIN {C} c", [(C, "CROSS", O, "", False, False)]),
    "extract_cte": ("sql", f"WITH a AS (SELECT o.id AS oid, o.cid AS ref FROM {O} o), b AS (SELECT x.ref AS r2 FROM a x) SELECT 1 FROM b JOIN {C} c ON b.r2 = c.id", [(C, "INNER", O, EQ, False, False)]),
    "extract_derived": ("sql", f"SELECT 1 FROM {C} c JOIN (SELECT cid AS j, count(*) AS n FROM {O} GROUP BY cid) s ON c.id = s.j", [(C, "INNER", O, EQ, False, False)]),
    "extract_union": ("sql", f"SELECT 1 FROM {C} c JOIN (SELECT cid FROM {O} UNION ALL SELECT cid FROM {P}) u ON u.cid = c.id", [(C, "INNER", O, EQ, False, True), (C, "INNER", P, f"{C}.id = {P}.cid", False, True)]),
    "extract_exists": ("sql", f"SELECT 1 FROM {C} c WHERE EXISTS (SELECT 1 FROM {O} o WHERE o.cid = c.id)", [(C, "INNER", O, EQ, True, False)]),
    "extract_merge": ("sql", f"MERGE INTO {O} t USING {C} s ON t.cid = s.id WHEN MATCHED THEN UPDATE SET t.v = s.v", [(C, "INNER", O, EQ, False, False)]),
    "extract_between": ("sql", f"SELECT 1 FROM {O} o JOIN {C} c ON o.ts BETWEEN c.valid_from AND c.valid_to AND c.score < o.score", [(C, "INNER", O, f"{C}.score < {O}.score AND {O}.ts BETWEEN {C}.valid_from AND {C}.valid_to", False, False)]),
    "extract_functions": ("sql", f"SELECT 1 FROM {O} o JOIN {C} c ON lower(o.name) = lower(c.name) AND (o.cid = c.id OR o.email = c.email) AND CAST(o.x AS STRING) = c.x", [(C, "INNER", O, f"({C}.email = {O}.email OR {EQ}) AND CAST({O}.x AS STRING) = {C}.x AND LOWER({C}.name) = LOWER({O}.name)", False, False)]),
    "extract_threeway": ("sql", f"SELECT 1 FROM {O} o JOIN {C} c ON o.cid = c.id JOIN {P} p ON p.oid = o.id AND p.cid = c.id", [(C, "INNER", O, EQ, False, False), (P, "INNER", O, f"{P}.oid = {O}.id", False, False), (C, "INNER", P, f"{C}.id = {P}.cid", False, False)]),
    "extract_insert": ("sql", f"-- load; nightly\nINSERT INTO w.target SELECT 1 FROM `{O.replace('.', '`.`')}` o JOIN {C} c ON o.`cid` = c.ID", [(C, "INNER", O, EQ, False, False)]),
    "extract_pyspark": ("python", READS + 'orders.join(customers, orders.cid == customers.id, "left")\norders.alias("o").join(F.broadcast(customers.alias("c")), (F.col("o.cid") == F.col("c.id")) & (customers.active == True))\norders.crossJoin(items)\norders.join(items, ["oid"], how="leftanti")', [(C, "RIGHT OUTER", O, EQ, False, False), (C, "INNER", O, EQ, False, False), (P, "CROSS", O, "", False, False), (P, "RIGHT ANTI", O, f"{P}.oid = {O}.oid", False, False)]),
    "extract_lineage": ("python", READS + f'both = orders.join(items, "oid")\nboth.createOrReplaceTempView("both")\nspark.sql("SELECT 1 FROM both b JOIN {C} c ON b.cid = c.id")', [(P, "INNER", O, f"{P}.oid = {O}.oid", False, False), (C, "INNER", O, EQ, False, True), (C, "INNER", P, f"{C}.id = {P}.cid", False, True)]),
    "extract_notebook": ("notebook", json.dumps({"cells": [{"cell_type": "markdown", "source": "# x JOIN y"}, {"cell_type": "code", "source": [f'o = spark.table("{O}")\n', "%time 1"]}, {"cell_type": "code", "source": f'c = spark.table("{C}")\no.join(c, o.cid == c.id)'}, {"cell_type": "code", "source": f"%%sql\nSELECT 1 FROM {P} p JOIN {O} o ON p.oid = o.id"}]}), [(C, "INNER", O, EQ, False, False), (P, "INNER", O, f"{P}.oid = {O}.id", False, False)]),
    "extract_interval": ("sql", f"SELECT 1 FROM {O} o JOIN {C} c ON o.cid = c.id AND o.ts > c.ts - INTERVAL 3 DAYS;\nSELECT 1 FROM {O} o JOIN {C} c ON o.cid = c.id AND o.ts > c.ts - INTERVAL '7' DAY", [(C, "INNER", O, f"{EQ} AND {C}.ts - INTERVAL {n} DAY < {O}.ts", False, False) for n in (3, 7)]),
    "extract_grouped": ("sql", f"SELECT 1 FROM ({O} o JOIN {C} c ON o.cid = c.id) LEFT JOIN {P} p ON p.oid = o.id;\nSELECT 1 FROM {P} p LEFT JOIN ({O} o JOIN {C} c ON o.cid = c.id) ON p.oid = o.id;\nSELECT 1 FROM (({O} o JOIN {C} c USING (cid)))", [(C, "INNER", O, EQ, False, False), (P, "RIGHT OUTER", O, f"{P}.oid = {O}.id", False, False), (P, "LEFT OUTER", O, f"{P}.oid = {O}.id", False, False), (C, "INNER", O, EQ, False, False), (C, "INNER", O, f"{C}.cid = {O}.cid", False, False)]),
    "extract_lateral": ("sql", f"SELECT 1 FROM {C} c, LATERAL (SELECT * FROM {O} o WHERE o.cid = c.id) l;\nSELECT 1 FROM {O} o LATERAL VIEW explode(o.xs) t AS x JOIN {C} c ON c.id = o.cid", [(C, "INNER", O, EQ, True, False), (C, "INNER", O, EQ, False, False)]),
    "extract_star_except": ("sql", f"SELECT * EXCEPT (a, b), c.* FROM {O} o JOIN {C} c ON o.cid = c.id", [(C, "INNER", O, EQ, False, False)]),
    "extract_pipes": ("sql", f"FROM {O} o |> JOIN {C} c ON o.cid = c.id |> WHERE o.total > 3 |> AGGREGATE sum(o.v) AS v GROUP BY o.pid |> AS g |> LEFT JOIN {P} p ON p.id = g.pid |> ORDER BY v |> LIMIT 3", [(C, "INNER", O, EQ, False, False), (P, "RIGHT OUTER", O, f"{P}.id = {O}.pid", False, False)]),
    "extract_match": ("python", READS + 'match 1:\n    case 1:\n        x = orders.join(customers, orders.cid == customers.id)\n    case _:\n        x = orders', [(C, "INNER", O, EQ, False, False)]),
    "extract_magics": ("notebook", json.dumps({"cells": [{"cell_type": "code", "source": f"%%athena\nSELECT 1 FROM {P} p JOIN {O} o ON p.oid = o.id"}, {"cell_type": "code", "source": "def ("}, {"cell_type": "code", "source": "%%bash\nls -la ("}, {"cell_type": "code", "source": f"%spark_sql SELECT 1 FROM {O} o JOIN {C} c ON o.cid = c.id"}]}), [(P, "INNER", O, f"{P}.oid = {O}.id", False, False), (C, "INNER", O, EQ, False, False)]),
}
#: Errors that the files of a case have.
WRONG = {"extract_magics": 1}


def code(spark: SparkSession, sf_dir: str, names: list[str]) -> DataFrame:
    """Code files from customers, one for each case."""
    made = F.array(*(F.struct(F.lit(n).alias("case"), F.lit(CASES[n][0]).alias("language"), F.replace(F.lit(CASES[n][1]), F.lit("{k}"), F.col("k")).alias("text")) for n in names))
    keys = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("k"))
    return keys.repartition(spark.sparkContext.defaultParallelism, "k").select("k", F.inline(made))  # parsing is CPU work


def _expected(names: list[str]) -> str:
    lit = lambda s: f"replace('{s}', '{{k}}', c_custkey::varchar)"
    rows = [(n, CASES[n][0], *e) for n in names for e in CASES[n][2]]
    return " union all ".join(f"select '{n}' as \"case\", '{lang}' as language, c_custkey::varchar as k, {lit(a)} as left_table, '{kind}' as join_type, {lit(b)} as right_table, {lit(cond)} as condition, {imp} as implicit, {amb} as ambiguous from customer" for n, lang, a, kind, b, cond, imp, amb in rows)


def found_joins(spark: SparkSession, sf_dir: str, names: list[str]) -> DataFrame:
    fields = ["left_table", "join_type", "right_table", "condition", "implicit", "ambiguous"]
    return extract(code(spark, sf_dir, names), parts=["joins"], fields=fields).select("case", "language", "k", F.inline("joins"))


#: Statements over several lines, and the line of each join.
LINES = f"""-- one; two
SELECT 1
FROM {O} o
JOIN {C} c
  ON o.cid = c.id;

/* three
   four */ SELECT 1 FROM {O} o
  LEFT JOIN {P} p ON p.oid = o.id
  WHERE EXISTS (
    SELECT 1 FROM {C} c WHERE c.id = o.cid);
SELECT FROM WHERE ((;
SELECT 1 FROM {P} p, {C} c
WHERE p.cid = c.id
"""
AT = [(4, C, "INNER", O, False), (9, P, "RIGHT OUTER", O, False), (11, C, "INNER", O, True), (13, C, "INNER", P, True)]


@query(" union all ".join(f"select c_custkey::varchar as k, {n} as line, replace('{a}', '{{k}}', c_custkey::varchar) as left_table, '{kind}' as join_type, replace('{b}', '{{k}}', c_custkey::varchar) as right_table, {imp} as implicit, 1 as errors from customer" for n, a, kind, b, imp in AT))
def extract_lines(spark, sf_dir):
    keys = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("k")).repartition(spark.sparkContext.defaultParallelism, "k")
    files = keys.select("k", F.lit("sql").alias("language"), F.replace(F.lit(LINES), F.lit("{k}"), F.col("k")).alias("text"))
    found = extract(files).select("k", F.size("errors").alias("errors"), F.explode("joins").alias("j"))
    return found.select("k", "j.line", "j.left_table", "j.join_type", "j.right_table", "j.implicit", "errors")


#: Comparisons as SQL and Python write them.
COMPARED = (("=", "=="), ("<", "<"), (">=", ">="), ("<>", "!="))


@query("""with c as (select c_custkey as n, c_custkey // 5 % 4 as op, c_custkey // 20 % 2 = 1 as swapped, c_custkey // 40 % 2 = 1 as py, c_custkey // 80 % 2 = 1 as more, c_custkey // 160 % 3 as blank,
    'w.t' || c_nationkey as t, 'w.u' || c_custkey % 7 as u, 'k' || c_custkey % 11 as a, 'j' || c_nationkey % 3 as b, ['INNER', 'LEFT', 'RIGHT', 'FULL', 'CROSS'][c_custkey % 5 + 1] as kind from customer)
  select n as k, case when py then 'python' else 'sql' end as language, blank + case when py then 3 else 2 end as line, t as left_table, u as right_table,
    case kind when 'LEFT' then case when swapped then 'RIGHT OUTER' else 'LEFT OUTER' end when 'RIGHT' then case when swapped then 'LEFT OUTER' else 'RIGHT OUTER' end when 'FULL' then 'FULL OUTER' else kind end as join_type,
    case when kind = 'CROSS' then '' else t || '.' || a || ' ' || case when swapped then ['=', '>', '<=', '<>'][op + 1] else ['=', '<', '>=', '<>'][op + 1] end || ' ' || u || '.' || b
      || case when more then ' AND ' || t || '.z = ' || u || '.z' else '' end end as condition from c""")
def extract_varied(spark, sf_dir):
    """One join of each file; its tables, columns, type, comparison, sides, language and line are the row's."""
    k = F.col("c_custkey")
    part = lambda by, n: F.floor(k / by) % n
    at = lambda values, i: F.get(F.array(*map(F.lit, values)), i.cast("int"))
    swapped, python = part(20, 2) == 1, part(40, 2) == 1
    t, u, a, b = F.concat(F.lit("w.t"), "c_nationkey"), F.concat(F.lit("w.u"), k % 7), F.concat(F.lit("k"), k % 11), F.concat(F.lit("j"), F.col("c_nationkey") % 3)
    either = lambda x, y: F.when(swapped, y).otherwise(x)
    sql_on = F.concat(F.lit(" ON x."), either(a, b), F.lit(" "), at([c for c, _ in COMPARED], part(5, 4)), F.lit(" y."), either(b, a), F.when(part(80, 2) == 1, " AND y.z = x.z AND x.v > 3").otherwise(""))
    sql = F.concat(F.lit("SELECT 1 FROM "), either(t, u), F.lit(" x\n"), at(["INNER", "LEFT", "RIGHT", "FULL", "CROSS"], k % 5), F.lit(" JOIN "), either(u, t), F.lit(" y"), F.when(k % 5 == 4, "").otherwise(sql_on))
    py_on = F.concat(F.lit("x.join(y, (x."), either(a, b), F.lit(" "), at([c for _, c in COMPARED], part(5, 4)), F.lit(" y."), either(b, a), F.lit(")"), F.when(part(80, 2) == 1, ' & (y["z"] == x["z"]) & (x.v > 3)').otherwise(""), F.lit(', "'), at(["inner", "left", "right", "outer", ""], k % 5), F.lit('")'))
    code = F.concat(F.lit('x = spark.table("'), either(t, u), F.lit('")\ny = spark.table("'), either(u, t), F.lit('")\n'), F.when(k % 5 == 4, "x.crossJoin(y)").otherwise(py_on))
    files = table(spark, sf_dir, "customer").repartition(spark.sparkContext.defaultParallelism, "c_custkey")
    files = files.select(k.alias("k"), F.when(python, "python").otherwise("sql").alias("language"), F.concat(F.repeat(F.lit("\n"), part(160, 3).cast("int")), F.when(python, code).otherwise(sql)).alias("text"))
    found = extract(files).select("k", "language", F.explode("joins").alias("j"))
    return found.select("k", "language", "j.line", "j.left_table", "j.right_table", "j.join_type", "j.condition")


def _register_cases() -> None:
    for n in CASES:

        def run(spark, sf_dir, n=n):
            return found_joins(spark, sf_dir, [n])

        QUERIES[n] = run
        ORACLE_SQL[n] = _expected([n])


_register_cases()


@query(f"select left_table, right_table, condition, count(distinct language) as languages, count(*) as occurrence_count from ({_expected(list(CASES))}) where not ambiguous and join_type = 'INNER' group by all having count(distinct language) > 1")
def parity(spark, sf_dir):
    found = found_joins(spark, sf_dir, list(CASES)).where("not ambiguous and join_type = 'INNER'")
    return found.groupBy("left_table", "right_table", "condition").agg(F.countDistinct("language").alias("languages"), F.count("*").alias("occurrence_count")).where("languages > 1")


@query(f"with e as ({_expected(list(CASES))}) select (select count(*) from customer) * {len(CASES)} as files_scanned, count(*) as joins_found, count(distinct (left_table, join_type, right_table, condition)) as edges, (select count(*) from customer) * {sum(WRONG.values())} as errors from e")
def scan_stats(spark, sf_dir):
    key = F.transform("joins", lambda j: F.struct(j["left_table"], j["join_type"], j["right_table"], j["condition"]))
    said = extract(code(spark, sf_dir, list(CASES)), parts=["joins", "errors"], fields=["left_table", "join_type", "right_table", "condition"]).select(F.size("errors").alias("wrong"), F.posexplode_outer(key).alias("at", "e"))
    file = F.coalesce("at", F.lit(0)) == 0  # the first row of each file
    return said.agg(F.count(F.when(file, 1)).alias("files_scanned"), F.count("e").alias("joins_found"), F.countDistinct("e").alias("edges"), F.sum(F.when(file, F.col("wrong")).otherwise(0)).alias("errors"))
