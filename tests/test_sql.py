import pytest

from edgeloom.operators.extract import analyse


def joins(text, language="sql", **settings):
    return analyse(text, language, settings).joins


def edges(text, language="sql"):
    return {(j["left_table"], j["join_type"], j["right_table"], j["condition"]) for j in joins(text, language)}


@pytest.mark.parametrize(("clause", "kind"), [("JOIN", "INNER"), ("LEFT JOIN", "LEFT OUTER"), ("RIGHT JOIN", "RIGHT OUTER"), ("FULL OUTER JOIN", "FULL OUTER"), ("LEFT SEMI JOIN", "LEFT SEMI"), ("LEFT ANTI JOIN", "LEFT ANTI")])
def test_types(clause, kind):
    assert edges(f"SELECT 1 FROM a.t1 x {clause} b.t2 y ON x.k = y.k") == {("a.t1", kind, "b.t2", "a.t1.k = b.t2.k")}
    assert edges(f"SELECT 1 FROM a.t1 x {clause} b.t2 y ON y.k = x.k") == {("a.t1", kind, "b.t2", "a.t1.k = b.t2.k")}


def test_one_statement_does_not_spoil_another():
    found = analyse("THIS IS NOT SQL FROM (((;\nSELECT 1 FROM a.t1 x JOIN b.t2 y ON x.k = y.k; -- a; b\n SELECT 2 FROM c.t JOIN d.t USING (i)", "sql")
    assert len(found.joins) == 2 and found.joins[0]["line"] == 2


def test_ctes_are_no_tables_and_recursion_ends():
    found = analyse("WITH RECURSIVE r AS (SELECT id FROM s.o UNION ALL SELECT r.id FROM r JOIN s.o p ON r.id = p.up) SELECT 1 FROM r JOIN c.k k ON r.id = k.id", "sql")
    assert found.tables == {"s.o", "c.k"}
    assert ("c.k", "INNER", "s.o") in {(j["left_table"], j["join_type"], j["right_table"]) for j in found.joins}


def test_ambiguous_unless_some_conjunct_is_certain():
    found = joins("WITH u AS (SELECT k FROM b.t2 UNION SELECT k FROM b.t3) SELECT 1 FROM a.t1 x JOIN u ON x.k = u.k")
    assert len(found) == 2 and all(j["ambiguous"] for j in found)


def test_filters_and_rewrites():
    text = "SELECT 1 FROM prod.a.t1 x JOIN tmp.t2 y ON x.k = y.k JOIN t3 z ON z.k = x.k"
    found = analyse(text, "sql", {"rewrites": [("^prod\\.", "")], "exclude": ["^tmp"], "default_schema": "d"})
    assert found.tables == {"a.t1", "d.t3"}
    assert [(j["left_table"], j["right_table"]) for j in found.joins] == [("a.t1", "d.t3")]


def test_empty_and_odd_input():
    for text in ("", ";;;", "-- only a comment", "\0", "select", "select * from", "merge into", "with a as", "select ((((("):
        assert analyse(text, "sql").joins == []


def test_windows_lambdas_and_placeholders_parse():
    text = "SELECT row_number() OVER (PARTITION BY o.a ORDER BY o.b DESC) rn, transform(o.xs, x -> x + 1), o.j:k, CASE WHEN o.a > 1 THEN 'x' ELSE c.n END, date '2020-01-01' + interval 1 day FROM ${db}.orders o JOIN {{ ref }}.c c ON o.id = c.id AND o.d >= '2020-01-01' GROUP BY ALL HAVING count(*) > 1 ORDER BY 1 LIMIT 3"
    found = analyse(text, "sql")
    assert not found.errors and len(found.joins) == 1 and found.joins[0]["condition"].count("=") == 1


FRAMES = 'orders = spark.table("sales.orders")\ncustomers = spark.table("crm.customers")\n'


@pytest.mark.parametrize(
    ("sql", "frame"),
    [
        ("o.cid = c.id", "orders.cid == customers.id"), ("c.id = o.cid AND o.r = c.r", "(orders.cid == customers.id) & (orders.r == customers.r)"),
        ("lower(o.n) = lower(c.n)", "F.lower(orders.n) == F.lower(customers.n)"), ("c.s < o.s", "orders.s > customers.s"), ("o.t BETWEEN c.a AND c.b", "orders.t.between(customers.a, customers.b)"),
        ("(o.a = c.a OR o.b = c.b)", "(orders.a == customers.a) | (orders.b == customers.b)"), ("o.a = c.a AND c.x = TRUE", "(orders.a == customers.a) & (customers.x == True)"),
        ("CAST(o.a AS STRING) = c.a", 'orders.a.cast("string") == customers.a'), ("o.a <=> c.a", "orders.a.eqNullSafe(customers.a)"), ("o.a + 1 = c.a", 'orders["a"] + 1 == customers["a"]'),
    ],
)
def test_sql_and_frames_agree(sql, frame):
    one = edges(f"SELECT 1 FROM sales.orders o JOIN crm.customers c ON {sql}")
    assert len(one) == 1 and one == edges(f"{FRAMES}orders.join(customers, {frame})", "python")


def test_frames_ignore_comments_and_find_embedded_sql():
    text = FRAMES + '# orders.join(customers, "k")\n"""SELECT 1 FROM a.b JOIN c.d USING (k)"""\nq = "SELECT 1 FROM a.x JOIN c.y USING (k)"\nspark.sql(f"SELECT 1 FROM {db}.p JOIN c.q USING (k)")'
    assert {(a, b) for a, _, b, _ in edges(text, "python")} == {("a.x", "c.y"), ("c.q", "x_.p")}


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("x JOIN b.t2 y ON x.q = y.q - INTERVAL '1-2' YEAR TO MONTH", {("a.t1", "INNER", "b.t2", "a.t1.q = b.t2.q - INTERVAL 1-2 YEAR TO MONTH")}),
        ("x JOIN (b.t2 y JOIN c.t3 z ON y.j = z.j) ON x.k = z.k", {("a.t1", "INNER", "c.t3", "a.t1.k = c.t3.k"), ("b.t2", "INNER", "c.t3", "b.t2.j = c.t3.j")}),
        ("x LEFT JOIN LATERAL (SELECT * FROM b.t2 y WHERE y.k = x.k) l", {("a.t1", "INNER", "b.t2", "a.t1.k = b.t2.k")}),
        ("x CROSS APPLY (SELECT * FROM b.t2 y WHERE y.k = x.k) l", {("a.t1", "INNER", "b.t2", "a.t1.k = b.t2.k")}),
        ("x JOIN LATERAL (SELECT * FROM b.t2) l ON l.k = x.k", {("a.t1", "INNER", "b.t2", "a.t1.k = b.t2.k")}),
        ("x ASOF JOIN b.t2 y ON x.k = y.k AND x.ts >= y.ts", {("a.t1", "ASOF", "b.t2", "a.t1.k = b.t2.k AND a.t1.ts >= b.t2.ts")}),
        ("x JOIN ((SELECT k FROM b.t2) UNION (SELECT k FROM b.t2)) y ON x.k = y.k", {("a.t1", "INNER", "b.t2", "a.t1.k = b.t2.k")}),
        ("x JOIN ((SELECT k FROM b.t2) y JOIN c.t3 z ON y.k = z.k) ON x.k = y.k", {("a.t1", "INNER", "b.t2", "a.t1.k = b.t2.k"), ("b.t2", "INNER", "c.t3", "b.t2.k = c.t3.k")}),
    ],
)
def test_odd_relations(text, want):
    found = analyse(f"SELECT 1 FROM a.t1 {text}", "sql")
    assert not found.errors and edges(f"SELECT 1 FROM a.t1 {text}") == want


def test_pipes_enclose_what_is_before():
    assert edges("FROM a.t1 x |> JOIN b.t2 y ON x.k = y.k |> SELECT x.j AS r |> AS q |> JOIN c.t3 z ON q.r = z.j") == {("a.t1", "INNER", "b.t2", "a.t1.k = b.t2.k"), ("a.t1", "INNER", "c.t3", "a.t1.j = c.t3.j")}
    found = analyse("FROM a.t1 x |> EXTEND k + 1 AS n |> WHERE EXISTS (SELECT 1 FROM b.t2 y WHERE y.k = x.k) |> DROP n |> UNION ALL (SELECT * FROM c.t3) |> LIMIT 3", "sql")
    assert not found.errors and found.tables == {"a.t1", "b.t2", "c.t3"}


def test_broken_files_are_errors():
    assert analyse("def (", "python").errors and analyse("{", "notebook").errors and analyse("[]", "notebook").errors
    assert not analyse("From the join of two rivers", "text").joins
