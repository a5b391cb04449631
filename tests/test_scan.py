import json

import pytest

from edgeloom import cli
from edgeloom.functions import udtf
from edgeloom.operators.scan import scan
from edgeloom.plans import graph
from edgeloom.plans.store import Store
from edgeloom.sources.config import Config, ConfigError
from edgeloom.sources.git import repository, scrub
from edgeloom.streaming.incremental import follow


@pytest.fixture
def code(tmp_path):
    root = tmp_path / "code"
    (root / "old").mkdir(parents=True)
    (root / "a.sql").write_text("SELECT 1 FROM s.orders o JOIN s.customers c ON o.cid = c.id")
    (root / "b.py").write_text('o = spark.table("s.orders")\nc = spark.table("s.customers")\no.join(c, o.cid == c.id)')
    (root / "old" / "c.sql").write_text("SELECT 1 FROM s.x JOIN s.y USING (k)")
    (root / "d.ipynb").write_text(json.dumps({"cells": [{"cell_type": "code", "source": "%%sql\nSELECT 1 FROM s.orders JOIN s.items USING (oid)"}]}))
    (root / "binary.sql").write_bytes(b"SELECT\0 1 FROM a JOIN b")
    (root / "latin.sql").write_bytes("SELECT 1 -- café\nFROM s.p JOIN s.q USING (k)".encode("latin-1"))
    (root / ".git").mkdir()
    (root / ".git" / "HEAD").write_text("ref: refs/heads/feature/joins\n")
    (root / ".git" / "packed-refs").write_text("# pack-refs\n" + "a" * 40 + " refs/heads/feature/joins\n")
    (root / ".git" / "config").write_text('[remote "origin"]\n\turl = https://user:secret@host/x.git\n')
    return root


def config(tmp_path, code, **more):
    return Config.from_dict({"store": "store", "sources": [{"name": "one", "roots": [str(code)], "exclude": ["old/**"], **more}]}, tmp_path)


def test_scan_stores_the_graph_and_caches(spark, tmp_path, code):
    conf = config(tmp_path, code)
    stats = scan(spark, conf)
    assert (stats["files_scanned"], stats["files_cached"], stats["joins_found"], stats["errors"]) == (4, 0, 4, 0)
    store = Store(spark, conf.store)
    top = graph.top_edges(store.read("edges")).first()
    assert (top["left_table"], top["right_table"], top["occurrence_count"], top["file_count"]) == ("s.customers", "s.orders", 2, 2)
    files = {r["rel_path"]: r for r in store.read("files").collect()}
    assert set(files) == {"a.sql", "b.py", "d.ipynb", "latin.sql"}
    assert (files["a.sql"]["branch"], files["a.sql"]["commit_sha"], files["a.sql"]["remote"]) == ("feature/joins", "a" * 40, "https://host/x.git")
    assert {r["name"] for r in store.read("columns").where("table_key = 's.orders' and is_join_key").collect()} == {"cid", "oid"}
    (code / "a.sql").write_text("SELECT 1 FROM s.orders o LEFT JOIN s.customers c ON o.cid = c.id")
    again = scan(spark, conf)
    assert (again["files_cached"], again["joins_found"]) == (3, 4)
    assert Store(spark, conf.store).read("edges").where("left_table = 's.customers'").count() == 2
    assert scan(spark, conf, cache=False)["files_cached"] == 0
    with pytest.raises(KeyError):
        scan(spark, conf, ["nowhere"])


def test_sources_are_replaced_apart(spark, tmp_path, code):
    both = Config.from_dict({"store": "st", "sources": [{"name": "one", "roots": [str(code)]}, {"name": "two", "roots": [str(code / "old"), str(tmp_path / "none")]}]}, tmp_path)
    scan(spark, both)
    before = Store(spark, both.store).read("edges").where("source = 'one'").count()
    (code / "old" / "c.sql").unlink()
    scan(spark, both, ["two"])
    edges = Store(spark, both.store).read("edges")
    assert edges.where("source = 'one'").count() == before
    assert edges.where("source = 'two'").count() == 0


def test_a_replacement_shows_only_when_published(spark, tmp_path):
    store = Store(spark, str(tmp_path / "st"))
    rows = lambda *r: spark.createDataFrame(list(r), "source string, n long")
    see = lambda: sorted((r["source"], r["n"]) for r in store.read("t").collect())
    with pytest.raises(FileNotFoundError):
        store.read("t")
    first = store.replacing(["a", "b/c=1", "none"])
    first.write("t", rows(("a", 1), ("b/c=1", 2), ("unnamed", 9)))
    with pytest.raises(FileNotFoundError):
        store.read("t")
    first.publish()
    assert see() == [("a", 1), ("b/c=1", 2)]
    reader = store.read("t")
    for n in (3, 4):
        new = store.replacing(["a"])
        assert [r["n"] for r in new.write("t", rows(("a", n))).collect()] == [n]
        assert see()[0] == ("a", 1 if n == 3 else 3)
        new.publish()
        assert see() == [("a", n), ("b/c=1", 2)]
        if n == 3:
            assert reader.count() == 2  # a version outlives its replacement
    assert not (tmp_path / "st" / "t" / f"version={first.version}" / "source=a").exists()
    gone = store.replacing(["b/c=1"])
    gone.write("t", rows())
    gone.publish()
    assert see() == [("a", 4)]


@pytest.mark.parametrize("raw", [[], {}, {"sources": []}, {"sources": [{"name": "a"}]}, {"sources": [{"name": "a", "roots": ["."], "odd": 1}]}, {"sources": [{"name": "a", "roots": ["."], "max_file_bytes": 0}]}, {"sources": [{"name": "a", "roots": ["."], "exclude_tables": ["("]}]}, {"sources": [{"name": "a", "roots": ["."]}] * 2}])
def test_bad_configs(raw):
    with pytest.raises(ConfigError):
        Config.from_dict(raw)


def test_defaults_are_inherited(tmp_path):
    conf = Config.from_dict({"defaults": {"default_schema": "d"}, "sources": [{"name": "a", "roots": "."}, {"name": "b", "roots": ["."], "default_schema": "e"}]}, tmp_path)
    assert [s.default_schema for s in conf.sources] == ["d", "e"]
    assert conf.sources[0].digest != conf.sources[1].digest


def test_git(tmp_path):
    assert repository(str(tmp_path))["branch"] is None
    assert scrub("https://u:p@h/x") == "https://h/x" and scrub("git@h:x") == "git@h:x" and scrub(None) is None


def test_cli(spark, tmp_path, code, capsys):
    assert cli.main(["init", str(tmp_path / "c.yaml")]) == 0
    assert cli.main(["init", str(tmp_path / "c.yaml")]) == 1
    (tmp_path / "c.yaml").write_text(f"store: st\nsources:\n  - name: one\n    roots: [{code}]\n")
    at = ["-c", str(tmp_path / "c.yaml")]
    assert cli.main([*at, "scan", "--quiet"]) == 0
    capsys.readouterr()
    assert cli.main([*at, "joins", "--json"]) == 0
    assert json.loads(capsys.readouterr().out)[0]["left_table"] == "s.customers"
    assert cli.main([*at, "path", "s.customers", "s.items"]) == 0
    assert cli.main([*at, "path", "s.customers", "s.nowhere"]) == 1
    assert cli.main([*at, "tables", "--search", "ORD", "--json"]) == 0
    assert cli.main([*at, "scan", "--source", "none"]) == 2
    assert cli.main(["-c", str(tmp_path / "missing.yaml"), "scan"]) == 2


def test_udtf(spark):
    udtf.register(spark)
    row = spark.sql("select * from extract_joins('sql', 'SELECT 1 FROM a.x JOIN a.y USING (k)')").first()
    assert (row["left_table"], row["condition"]) == ("a.x", "a.x.k = a.y.k")


def test_stream(spark, tmp_path, code):
    for _ in range(2):
        follow(spark, str(code), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5


def test_repositories_below_links_and_excluded_folders(spark, tmp_path, code):
    from edgeloom.sources.code_files import code_files

    inner = code / "libs" / "inner"
    (inner / ".git").mkdir(parents=True)
    (inner / ".git" / "HEAD").write_text("b" * 40 + "\n")
    (inner / "sub").mkdir()
    (inner / "sub" / "e.sql").write_text("SELECT 1 FROM s.orders JOIN s.items USING (oid)")
    (code / "libs" / "f.sql").write_text("SELECT 1")
    (code / "linked.sql").symlink_to(code / "a.sql")
    (code / "linked").symlink_to(inner / "sub")
    (code / "x" / "node_modules" / "y").mkdir(parents=True)
    (code / "x" / "node_modules" / "y" / "g.sql").write_text("SELECT 1")
    read = lambda **more: {r["path"].removeprefix(f"{code}/"): (r["rel_path"], r["commit_sha"], r["branch"]) for r in code_files(spark, config(tmp_path, code, exclude=["old", "**/node_modules"], include=["**/*.sql"], **more).sources[0]).collect()}
    outer = ("a" * 40, "feature/joins")
    want = {"a.sql": ("a.sql", *outer), "latin.sql": ("latin.sql", *outer), "libs/f.sql": ("libs/f.sql", *outer), "libs/inner/sub/e.sql": ("sub/e.sql", "b" * 40, None)}
    assert read() == want
    assert set(read(follow_symlinks=True)) == {*want, "linked.sql", "linked/e.sql"}


def test_paths_are_shown_from_the_repository(spark, tmp_path, code):
    from edgeloom.sources.code_files import code_files

    below = config(tmp_path, code / "old", exclude=[]).sources[0]
    assert [r["rel_path"] for r in code_files(spark, below).collect()] == ["old/c.sql"]
    picked = config(tmp_path, code, include_files=["^A", "d\\."], exclude_files=["ipynb$"]).sources[0]
    assert [r["rel_path"] for r in code_files(spark, picked).collect()] == ["a.sql"]


def test_web(spark, tmp_path, code):
    import threading
    import urllib.request

    from edgeloom.web import Api, server

    conf = config(tmp_path, code)
    assert Api(spark, str(tmp_path / "none")).answer("/api/summary")[0] == 503
    scan(spark, conf)
    api = Api(spark, conf.store)
    assert api.answer("/api/summary")[1]["joins"] == 3
    assert api.answer("/api/summary")[1]["last_scan"]["files_scanned"] == 4
    drawn = api.answer("/api/graph?limit=10")[1]
    assert len(drawn["edges"]) == 3 and not drawn["truncated"]
    one = api.answer(f"/api/edges/{drawn['edges'][0]['edge_id']}")[1]
    assert one["conditions"][0]["operator"] == "=" and len(one["occurrences"]) == 2
    assert api.answer("/api/edges/0")[0] == 404 and api.answer("/api/other")[0] == 404
    assert [api.answer(f"/api/{q}")[0] for q in ("graph?limit=0", "graph?limit=2001", "neighbourhood?table=a&depth=5", "path?start=a", "path?start=a&end=b&k=11", "tables?limit=x")] == [422] * 6
    near = api.answer("/api/neighbourhood?table=S.Orders")[1]
    assert len(near["edges"]) == 2
    assert api.answer("/api/path?start=s.customers&end=s.items")[1]["paths"][0]["hops"] == 2
    tables = {t["table_key"]: t for t in api.answer("/api/model")[1]["tables"]}
    assert tables["s.orders"]["columns"][0]["is_join_key"]
    http = server(spark, conf.store, port=0)
    threading.Thread(target=http.serve_forever, daemon=True).start()
    with urllib.request.urlopen(f"http://127.0.0.1:{http.server_port}/api/sources", timeout=60) as r:
        assert json.load(r) == ["one"]
    http.shutdown()
