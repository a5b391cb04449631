import random

import brute
import duckdb
import pytest

from edgeloom.llm import url_filter

SQL = "select page_id, host, path, rule, verdict, template, purity from ({})"


@pytest.mark.parametrize("seed", range(3))
def test_tree_is_that_of_lists(spark, seed):
    """Templates, purities and verdicts against a tree over lists, and the SQL against both."""
    rng = random.Random(seed)
    rules = [(f"h{h}.com/{a}/{b}", rng.choice(["block", "block", "allow"])) for h in range(2) for a in "abcde" for b in range(12) if rng.random() < 0.5]
    rules += [(f"h2.com/{a}/", "block" if a in "ab" else "allow") for a in "abcd"] + [("h2.com/b/1", "allow")]
    path = lambda: "/".join([rng.choice("abcdefg"), *(str(min(int(rng.expovariate(0.15)), 40)) for _ in range(rng.randrange(4)))])
    pages = [(i, f"http://h{rng.randrange(4)}.com/{path()}{rng.choice(['', '/'])}") for i in range(3000)] + [(7, None), (8, "http://h0.com")]
    df = spark.createDataFrame(pages, "page_id long, url string").repartition(5)
    got = url_filter.judge(df, rules).collect()
    rows = sorted(tuple(map(str, r)) for r in got)
    con = duckdb.connect()
    con.register("pages", df.toPandas())
    assert rows == sorted(tuple(map(str, r)) for r in con.execute(SQL.format(url_filter.judge_sql(rules))).fetchall())
    want = brute.url_templates([(r["host"], [p for p in r["path"].split("/") if p], dict(rules).get(r["rule"])) for r in got])
    assert any("{" in t for t, _ in want) and any("*" in t for t, _ in want)
    for r, (template, purity) in zip(got, want, strict=True):
        assert r["template"] == template and abs(r["purity"] - purity) < 1e-5
        assert r["verdict"] == (dict(rules)[r["rule"]] if r["rule"] else "block" if purity >= url_filter.REJECT else "allow")


def test_like_branches_meet(spark):
    """Branches with like labels are one node, also below; unlike ones and those without labels are not."""
    rules = [("x.com/a/", "block"), ("x.com/b/", "block"), ("x.com/c/", "allow"), ("x.com/a/new/", "allow")]
    urls = [f"http://x.com/{s}/{t}/{i}" for s in "abc" for t in ("old", "new") for i in range(15)] + ["http://x.com/d/old/1"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r["template"].rpartition("/")[0] for r in url_filter.judge(df, [r for r in rules if "new" not in r[0]], depth=3).collect()}
    assert got == {"x.com/{a|b}/{new|old}", "x.com/c/{new|old}", "x.com/d/old"}
    got = {r["template"].rpartition("/")[0] for r in url_filter.judge(df, [*rules, ("x.com/b/new/", "allow")], depth=3).collect()}
    assert got == {"x.com/{a|b}/new", "x.com/{a|b}/old", "x.com/c/{new|old}", "x.com/d/old"}
