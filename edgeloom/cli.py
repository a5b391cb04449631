"""python -m edgeloom.cli: init, scan, tables, joins, path, summary, serve."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from edgeloom.operators.scan import scan
from edgeloom.plans import graph
from edgeloom.plans.store import Store
from edgeloom.sources.config import Config, ConfigError

EXAMPLE = """store: joins
sources:
  - name: main
    roots: [.]
    exclude: ["**/.git/**"]
"""


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="edgeloom")
    p.add_argument("-c", "--config", default="edgeloom.yaml")
    p.add_argument("--db", help="the store, instead of the config's")
    sub = p.add_subparsers(dest="command", required=True)
    init = sub.add_parser("init")
    init.add_argument("path", nargs="?", default="edgeloom.yaml")
    init.add_argument("--force", action="store_true")
    s = sub.add_parser("scan")
    s.add_argument("--source", action="append")
    s.add_argument("--workers", type=int)
    s.add_argument("--no-cache", action="store_true")
    s.add_argument("--quiet", action="store_true")
    for name in ("tables", "joins", "path", "summary"):
        q = sub.add_parser(name)
        q.add_argument("--source")
        if name == "tables":
            q.add_argument("--search")
        if name in ("joins", "path"):
            q.add_argument("--min-count", type=int, default=1)
            q.add_argument("--no-ambiguous", action="store_true")
        if name == "path":
            q.add_argument("start")
            q.add_argument("end")
            q.add_argument("-k", type=int, default=3)
        else:
            q.add_argument("--limit", type=int, default=50)
        q.add_argument("--json", action="store_true")
    s.add_argument("--json", action="store_true")
    web = sub.add_parser("serve")
    web.add_argument("--host", default="127.0.0.1")
    web.add_argument("--port", type=int, default=8000)
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    if args.command == "init":
        if Path(args.path).exists() and not args.force:
            print(f"{args.path} exists; --force overwrites it", file=sys.stderr)
            return 1
        Path(args.path).write_text(EXAMPLE, encoding="utf-8")
        return 0
    try:
        config = Config.load(args.config) if not args.db or args.command == "scan" else Config(args.db, [])
        if args.db:
            config.store = args.db
        return run(args, config)
    except (ConfigError, KeyError, FileNotFoundError) as error:
        print(f"edgeloom: {error}", file=sys.stderr)
        return 2


def rows(df: DataFrame, as_json: bool) -> list[dict]:
    found = [r.asDict(recursive=True) for r in df.collect()]
    if as_json:
        print(json.dumps(found, default=str))
    else:
        for r in found:
            print("  ".join(str(v) for v in r.values()))
    return found


def run(args: argparse.Namespace, config: Config) -> int:
    spark = SparkSession.builder.appName("edgeloom").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if args.command == "scan":
        if args.workers:
            spark.conf.set("spark.sql.shuffle.partitions", args.workers)
        stats = scan(spark, config, args.source, cache=not args.no_cache)
        if args.json:
            print(json.dumps(stats))
        elif not args.quiet:
            print(", ".join(f"{k} {v}" for k, v in stats.items()))
        return 0
    if args.command == "serve":
        from edgeloom.web import server

        server(spark, config.store, args.host, args.port).serve_forever()
        return 0
    store = Store(spark, config.store)
    if args.command == "tables":
        rows(graph.top_nodes(store.read("nodes"), args.search, args.source, args.limit), args.json)
        return 0
    if args.command == "summary":
        rows(graph.summary(store.read("nodes"), store.read("edges"), store.read("occurrences"), store.read("files")), args.json)
        return 0
    edges = graph.select_edges(store.read("edges"), args.source, args.min_count, not args.no_ambiguous)
    if args.command == "joins":
        rows(graph.top_edges(edges, args.limit), args.json)
        return 0
    found = rows(graph.weakest_link(graph.shortest_paths(edges, args.start, args.end, args.k)), args.json)
    return 0 if found else 1


if __name__ == "__main__":
    sys.exit(main())
