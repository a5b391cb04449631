import pytest

from edgeloom.plans import graph, rollup

ROWS = [("s", "a", "b", 5), ("s", "b", "c", 4), ("s", "a", "d", 9), ("s", "c", "d", 1), ("s", "x", "y", 2)]


@pytest.fixture(scope="module")
def edges(spark):
    rows = [(s, a, b, "INNER", f"{a}.k = {b}.k", n, n, False, n == 1) for s, a, b, n in ROWS]
    return spark.createDataFrame(rows, "source string, left_table string, right_table string, join_type string, condition string, occurrence_count long, file_count long, implicit boolean, ambiguous boolean").cache()


def test_shortest_path_prefers_hops_then_evidence(edges):
    row = graph.shortest_path(edges, "A", "c").first()
    assert row["tables"] == ["a", "d", "c"] and row["hops"] == 2 and row["total"] == 10
    assert graph.shortest_path(edges, "a", "y").count() == 0
    assert graph.shortest_path(edges, "a", "c", max_hops=1).count() == 0
    assert graph.shortest_path(edges, "q", "q").first()["hops"] == 0


def test_paths_leave_out_the_weakest_edge(edges):
    rows = graph.weakest_link(graph.shortest_paths(edges, "a", "c", 3)).orderBy("rank").collect()
    assert [r["tables"] for r in rows] == [["a", "d", "c"], ["a", "b", "c"]]
    assert [r["weakest_link"] for r in rows] == [1, 4]
    assert graph.shortest_paths(edges, "a", "y", 3).count() == 0


def test_neighbourhood_stops_at_its_depth(edges):
    pairs = lambda d: {(r["left_table"], r["right_table"]) for r in graph.neighbourhood(edges, "a", d).collect()}
    assert pairs(1) == {("a", "b"), ("a", "d")}
    assert pairs(2) == {("a", "b"), ("a", "d"), ("b", "c"), ("c", "d")}
    assert graph.neighbourhood(edges, "nowhere", 2).count() == 0


def test_surroundings_have_distances_and_a_limit(edges):
    nodes = edges.sparkSession.createDataFrame([("s", t) for t in "abcdxy"], "source string, table_key string")
    found, inside = graph.surroundings(edges, nodes, "A", 2)
    assert {r["table_key"]: r["distance"] for r in found.collect()} == {"a": 0, "b": 1, "d": 1, "c": 2} and inside.count() == 4
    found, inside = graph.surroundings(edges, nodes, "a", 2, limit=2)
    assert {r["table_key"] for r in found.collect()} == {"a", "b"} and inside.count() == 1
    found, inside = graph.surroundings(edges, nodes, "nowhere", 2)
    assert found.count() == inside.count() == 0
    assert {r["table_key"] for r in graph.nodes_by_key(nodes, ["A", "q"]).collect()} == {"a"}


def test_filters(edges):
    assert graph.select_edges(edges, min_occurrences=4).count() == 3
    assert graph.select_edges(edges, ambiguous=False).count() == 4
    assert graph.select_edges(edges, source="other").count() == 0
    assert graph.select_edges(edges, tables=["A", "B", "x"]).count() == 1


def test_certain_occurrences_beat_candidates(spark):
    rows = [("s", "a", "b", "INNER", "c", "f1", True, True), ("s", "a", "b", "INNER", "c", "f1", True, False)]
    occ = spark.createDataFrame(rows, "source string, left_table string, right_table string, join_type string, condition string, rel_path string, implicit boolean, ambiguous boolean")
    row = rollup.edges(occ).first()
    assert (row["occurrence_count"], row["file_count"], row["implicit"], row["ambiguous"]) == (2, 1, True, False)
    nodes = {r["table_key"]: r for r in rollup.nodes(spark.createDataFrame([("s", t, "f1") for t in "abz"], "source string, table_key string, file string"), rollup.edges(occ)).collect()}
    assert (nodes["a"]["degree"], nodes["a"]["join_count"], nodes["z"]["degree"], nodes["z"]["join_count"]) == (1, 2, 0, 0)


def test_column_pairs_turn_to_the_edge(spark):
    rows = [("a.t", "b.u", "<", "b.u.y", "a.t.x"), ("a.t", "b.u", "=", "a.t.x", "b.u.y"), ("a.t", "b.u", "=", "c.v.x", "b.u.y"), ("a.t", "b.u", None, None, None)]
    df = spark.createDataFrame(rows, "left_table string, right_table string, operator string, left_column string, right_column string")
    assert {tuple(r) for r in graph.column_pairs(df).collect()} == {("a.t", "b.u", "x", "y", ">"), ("a.t", "b.u", "x", "y", "=")}
