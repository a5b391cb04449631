import pytest
from pyspark.sql import functions as F

from edgeloom.functions import canonical, naming


@pytest.mark.parametrize(("text", "key"), [("orders", "orders"), ("s.o", "s.o"), ("`c`.`s`.`o`", "c.s.o"), ('"S"."O"', "s.o"), ("[s].[o]", "s.o"), ("  s.o ;", "s.o"), ("a.b.c.d", "a.b.c.d"), ("`a.b`.c", "a.b.c")])
def test_table_key(text, key):
    assert naming.table_key(text) == key


def test_defaults_fill_what_is_missing():
    assert naming.table_key("o", "s", "c") == "c.s.o"
    assert naming.table_key("x.o", "s", "c") == "c.x.o"
    assert naming.table_key("o", None, "c") == "c.o"
    with pytest.raises(ValueError):
        naming.table_key("  ")


@pytest.mark.parametrize(("raw", "kind"), [(None, "INNER"), ("join", "INNER"), ("left", "LEFT OUTER"), ("LEFT JOIN", "LEFT OUTER"), ("left_outer", "LEFT OUTER"), ("fullouter", "FULL OUTER"), ("leftanti", "LEFT ANTI"), ("semi", "LEFT SEMI"), ("cross", "CROSS"), ("odd", "ODD")])
def test_join_types(spark, raw, kind):
    assert canonical.join_type(raw) == kind
    assert spark.range(1).select(canonical.join_type_column(F.lit(raw).cast("string"))).first()[0] == kind


def test_predicates_have_one_spelling():
    a, b = ("col", "x", "k"), ("col", "y", "k")
    named = {a: ("a.t1", "k"), b: ("b.t2", "k")}
    assert canonical.render(("bin", "=", b, a), named) == "a.t1.k = b.t2.k"
    assert canonical.render(("bin", ">", b, a), named) == canonical.render(("bin", "<", a, b), named) == "a.t1.k < b.t2.k"
    assert canonical.render(("bin", "=", a, b), {a: None, b: ("b.t2", "k")}) == "<unknown>.k = b.t2.k"
    plus = ("bin", "*", ("bin", "+", a, ("lit", "1")), ("lit", "2"))
    assert canonical.render(plus, named) == "(a.t1.k + 1) * 2"


def test_joins_are_mirrored_and_conditions_sorted():
    one, two = ({"predicate": p, "operator": None, "left_column": None, "right_column": None} for p in ("b.x = a.x", "a.k = b.k"))
    j = canonical.make_join("z.t", "a.t", "LEFT OUTER", [one, two, one], 1, "sql")
    assert (j["left_table"], j["join_type"], j["condition"]) == ("a.t", "RIGHT OUTER", "a.k = b.k AND b.x = a.x")


def test_paths(spark):
    paths = ["s3://b/staging/raw_events/dt=1/*.parquet", "/data/x/orders.csv", "orders", "s3://b/a/b/c", "/", ""]
    plain = [naming.path_table(p) for p in paths]
    rows = spark.createDataFrame([(p,) for p in paths], "p string").select(naming.path_table_column(F.col("p"))).collect()
    assert plain == [r[0] for r in rows] == ["staging.raw_events", "x.orders", "orders", "b.c", None, None]


@pytest.mark.parametrize(("glob", "path", "fits"), [("**/*.py", "a.py", True), ("**/*.py", "x/y/a.py", True), ("*.sql", "x/a.sql", True), ("**/old/**", "x/old/a.py", True), ("**/old/**", "older/a.py", False), ("a?.[ch]", "ab.c", True)])
def test_globs(glob, path, fits):
    import re

    assert bool(re.search(naming.glob_regex(glob), path)) is fits
