"""URL filtering by a path-template tree with labelled purity; DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edgeloom.llm._common import stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Levels of the tree in judge_sql; judge() itself goes as deep as the paths do.
DEPTH = 4
#: A node's child is generalised into the wildcard if the node has more children than this and the child has less than
#: one part in so many of the node's pages.
CHILDREN = 16
#: Squared standard deviations within which the labels of two branches are alike.
APART = 9.0
#: Labelled pages that the purity of the node above counts for.
PRIOR = 8.0
#: Purity (share of blocked pages) from which a template is rejected.
REJECT = 0.5
WILD = "*"

Rule = tuple[str, str]


def parsed(url: Column) -> tuple[Column, Column]:
    """(host, path) of a url; both empty if it is null or has no ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(F.coalesce(rest, F.lit("")), "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(F.coalesce(rest, F.lit("")), F.length(host) + 1, F.length(url)), "^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, of equally long ones the first by text; null if none does. A rule is
    host/path and fits the host and its subdomains if the path starts with the rule's."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, said in sorted(rules, key=lambda r: (-len(r[0]), r[0]))[::-1]:
        at, _, start = text.partition("/")
        fits = ((host == at) | host.endswith(f".{at}")) & path.startswith(f"/{start}")
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, said).otherwise(verdict)
    return rule, verdict


def _merged(branches: DataFrame, above: list[str]) -> DataFrame:
    """(above, branches, labelled, bad) from (above, branch, labelled, bad): branches beside each other whose labels are
    alike, listed in order. A path's end, the empty branch, joins none."""
    told = (F.col("labelled") > 0) & (F.col("branch") != "")
    ordered = Window.partitionBy(*above, "told").orderBy("rate", "branch")
    bad, labelled = F.lag("bad").over(ordered), F.lag("labelled").over(ordered)
    common = (F.col("bad") + bad + 1) / (F.col("labelled") + labelled + 2)
    off = F.col("bad") * labelled - bad * F.col("labelled")
    near = off * off <= F.lit(APART) * common * (1 - common) * (F.col("labelled") + labelled) * F.col("labelled") * labelled
    named = branches.withColumn("told", told).withColumn("rate", F.when(told, F.col("bad") / F.col("labelled")))
    runs = named.withColumn("first", F.when(F.col("told") & F.coalesce(near, F.lit(False)), 0).otherwise(1))
    runs = runs.withColumn("run", F.sum("first").over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(*above, "told", "run").agg(F.array_sort(F.collect_list("branch")).alias("branches"), F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"), F.max("above").alias("above"))


def judge(pages: DataFrame, rules: Sequence[Rule], url: str = "url", page_id: str = "page_id", depth: int | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict, template, purity) of every page.

    Pages that a rule fits have its verdict and label the tree. Below a host, level by level, a node's rare children
    become one wildcard (CHILDREN), and branches whose labels are alike are merged into one node, {a|b}, under which
    their own children meet: in the order of their labelled purity, a branch joins the one before it if the two differ
    by APART squared standard deviations of their common purity or less. So ends of a long run may differ by more.
    Branches without labels stay as they are, for nothing says what they are like. The tree is as deep as the deepest
    path; with depth, what a path has below that level is one segment there.

    From the host down, purity is smoothed by that of the node above: (blocked + PRIOR x purity above) / (labelled +
    PRIOR); at the top it is that of all labels, (blocked + 1) / (labelled + 2). Pages without a rule are blocked if the
    purity of their template reaches REJECT.

    Null urls and urls without :// have an empty host and path and are judged like others; rows that repeat a page_id
    are judged each; other columns are ignored; an empty table gives an empty result.

    Everything is counted over different (host, segments), summed map-side. Children's sums are written before they
    are joined to their nodes, so that AQE can split the rows of a host that has a third of all pages. A node has at
    most CHILDREN + 2 branches once its rare children are one, so windows and lists over branches are small.
    """
    host, path = parsed(F.col(url))
    seen = pages.select(F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path"))
    rule, said = rule_of(F.col("host"), F.col("path"), rules)
    seen = seen.select("page_id", "host", "path", rule.alias("rule"), said.alias("said"), F.filter(F.split("path", "/"), lambda x: x != "").alias("parts"))
    deep = seen.agg(F.max(F.size("parts"))).first()[0] or 0
    deep = deep if depth is None else min(deep, depth)
    raw = [f"s{i}" for i in range(deep)]
    segment = [F.coalesce(F.get("parts", F.lit(i)), F.lit("")) for i in range(deep)]  # '' where a path has ended
    if deep and deep == depth:
        segment[-1] = F.array_join(F.slice("parts", deep, 1 << 20), "/")
    seen = seen.select("page_id", "host", "path", "rule", "said", *(s.alias(name) for s, name in zip(segment, raw, strict=True)))
    sums = [F.sum("n").alias("n"), F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad")]
    leaves = seen.groupBy("host", *raw).agg(F.count("*").alias("n"), F.count("said").alias("labelled"), F.count(F.when(F.col("said") == "block", 1)).alias("bad"))
    leaves = stored(leaves, "paths")

    # from the host down: m0.. are the segments of the template, purity that of the node so far
    whole = leaves.agg(F.coalesce(F.sum("labelled"), F.lit(0)).alias("labelled"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")).first()
    top = (whole["bad"] + 1) / (whole["labelled"] + 2)
    smooth = lambda above: (F.col("bad") + F.lit(PRIOR) * above) / (F.col("labelled") + F.lit(PRIOR))
    hosts = stored(leaves.groupBy("host").agg(*sums).select("host", smooth(F.lit(top)).alias("purity")), "hosts")
    named = leaves.join(hosts, "host")
    for i in range(deep):
        above = ["host", *(f"m{k}" for k in range(i))]
        children = stored(named.groupBy(*above, f"s{i}").agg(*sums, F.max("purity").alias("above")), "children")
        nodes = stored(children.groupBy(*above).agg(F.sum("n").alias("all"), F.count("*").alias("different")), "nodes")
        rare = (F.col("different") > CHILDREN) & (F.col("n") * CHILDREN < F.col("all")) & (F.col(f"s{i}") != "")
        children = children.join(nodes, above).withColumn("branch", F.when(rare, WILD).otherwise(F.col(f"s{i}")))
        branches = children.groupBy(*above, "branch").agg(F.sum("labelled").cast("double").alias("labelled"), F.sum("bad").cast("double").alias("bad"), F.max("above").alias("above"))
        merged = _merged(branches, above).select(*above, F.explode("branches").alias("branch"), F.when(F.size("branches") > 1, F.concat(F.lit("{"), F.array_join("branches", "|"), F.lit("}"))).otherwise(F.get("branches", F.lit(0))).alias(f"m{i}"), F.when(F.get("branches", F.lit(0)) == "", F.col("above")).otherwise(smooth(F.col("above"))).alias("purity"))
        renamed = stored(children.select(*above, f"s{i}", "branch").join(merged, [*above, "branch"]).drop("branch"), "renamed")
        named = stored(named.drop("purity").join(renamed, [*above, f"s{i}"]), "templates")

    text = F.concat_ws("/", F.col("host"), *(F.when(F.col(f"m{k}") != "", F.col(f"m{k}")) for k in range(deep)))
    judged = named.select("host", *raw, text.alias("template"), "purity")
    out = seen.join(judged, ["host", *raw])
    method = F.when(F.col("purity") >= REJECT, "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce("said", method).alias("verdict"), "template", F.round("purity", 6).alias("purity"))


def judge_sql(rules: Sequence[Rule], pages: str = "pages") -> str:
    """judge() as one DuckDB statement."""
    raw = ", ".join(f"s{i}" for i in range(DEPTH))
    fits = [(t, s, f"((host = '{t.partition('/')[0]}' or ends_with(host, '.{t.partition('/')[0]}')) and starts_with(path, '/{t.partition('/')[2]}'))") for t, s in sorted(rules, key=lambda r: (-len(r[0]), r[0]))]
    case = lambda k: f"case {' '.join(f"when {x[2]} then '{x[k]}'" for x in fits)} end"
    seg = ", ".join([*(f"coalesce(parts[{i + 1}], '') as s{i}" for i in range(DEPTH - 1)), f"array_to_string(parts[{DEPTH}:], '/') as s{DEPTH - 1}"])
    ctes = [
        f"cut as (select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from {pages})",
        "split as (select page_id, rest, regexp_extract(rest, '^[^/?#]*') as spelled from cut)",
        f"found as (select page_id, translate(spelled, '{UPPER}', '{LOWER}') as host, regexp_extract(substr(rest, length(spelled) + 1), '^[^?#]*') as path from split)",
        f"ruled as (select *, {case(0)} as rule, {case(1)} as said, list_filter(string_split(path, '/'), lambda x: x <> '') as parts from found)",
        f"seen as (select page_id, host, path, rule, said, {seg} from ruled)",
        f"leaves as materialized (select host, {raw}, count(*) as n, count(said) as labelled, count(*) filter (said = 'block') as bad from seen group by all)",
    ]
    ctes += [
        "top as (select (coalesce(sum(bad), 0)::double + 1) / (coalesce(sum(labelled), 0)::double + 2) as top from leaves)",
        f"h as (select host, (sum(bad)::double + {PRIOR} * any_value(top)) / (sum(labelled)::double + {PRIOR}) as purity from leaves, top group by host)",
        "n0 as materialized (select * from leaves join h using (host))",
    ]
    for i in range(DEPTH):
        up = ", ".join(["host", *(f"m{k}" for k in range(i))])
        far = f"(bad * pl - pb * labelled) * (bad * pl - pb * labelled) > {APART} * ((bad + pb + 1) / (labelled + pl + 2)) * (1 - (bad + pb + 1) / (labelled + pl + 2)) * (labelled + pl) * labelled * pl"
        ctes += [
            f"c{i} as (select {up}, s{i}, sum(n) as own, sum(labelled) as labelled, sum(bad) as bad, max(purity) as above from n{i} group by all)",
            f"p{i} as (select {up}, sum(own) as everything, count(*) as different from c{i} group by all)",
            f"r{i} as materialized (select *, case when different > {CHILDREN} and own * {CHILDREN} < everything and s{i} <> '' then '{WILD}' else s{i} end as branch from c{i} join p{i} using ({up}))",
            f"b{i} as (select {up}, branch, sum(labelled)::double as labelled, sum(bad)::double as bad, max(above) as above, sum(labelled) > 0 and branch <> '' as told from r{i} group by {up}, branch)",
            f"o{i} as (select *, lag(bad) over w as pb, lag(labelled) over w as pl from b{i} window w as (partition by {up}, told order by bad / labelled, branch))",
            f"f{i} as (select *, case when not told or pl is null or {far} then 1 else 0 end as first from o{i})",
            f"g{i} as (select *, sum(first) over (partition by {up}, told order by bad / labelled, branch rows unbounded preceding) as run from f{i})",
            f"k{i} as (select {up}, told, run, list(branch order by branch) as branches, sum(labelled) as labelled, sum(bad) as bad, max(above) as above from g{i} group by all)",
            f"u{i} as (select {up}, unnest(branches) as branch, case when len(branches) > 1 then '{{' || array_to_string(branches, '|') || '}}' else branches[1] end as m{i}, case when branches[1] = '' then above else (bad + {PRIOR} * above) / (labelled + {PRIOR}) end as purity from k{i})",
            f"q{i} as (select {up}, s{i}, m{i}, purity from r{i} join u{i} using ({up}, branch))",
            f"n{i + 1} as materialized (select n{i}.* exclude (purity), m{i}, q{i}.purity from n{i} join q{i} using ({up}, s{i}))",
        ]
    text = "concat_ws('/', host, " + ", ".join(f"nullif(m{k}, '')" for k in range(DEPTH)) + ")"
    return f"with {', '.join(ctes)} select page_id, seen.host, path, rule, coalesce(said, case when purity >= {REJECT} then 'block' else 'allow' end) as verdict, {text} as template, round(purity, 6) as purity from seen join n{DEPTH} using (host, {raw})"
