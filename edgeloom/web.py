"""The graph over HTTP, as JSON, with the standard library's server."""

from __future__ import annotations

import json
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, unquote, urlsplit

from pyspark.sql import DataFrame, SparkSession

from edgeloom.plans import graph
from edgeloom.plans.store import Store

Answer = tuple[int, object]
#: Caps of what may be asked for.
MOST_NODES, MOST_PATHS, MOST_DEPTH, MOST_EDGES = 2000, 10, 4, 200_000


class BadRequest(ValueError):
    pass


def _rows(df: DataFrame) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]


class Api:
    """Answers paths with (status, body); it holds no state but the store."""

    def __init__(self, spark: SparkSession, path: str):
        self.store = Store(spark, path)
        self.routes: dict[str, Callable[[dict], object]] = {"summary": self.summary, "sources": self.sources, "graph": self.graph, "model": self.model, "tables": self.tables, "neighbourhood": self.neighbourhood, "path": self.path}

    def answer(self, url: str) -> Answer:
        at = urlsplit(url)
        asked = {k: v[-1] for k, v in parse_qs(at.query).items()}
        parts = [unquote(p) for p in at.path.strip("/").split("/")]
        try:
            if parts[:2] == ["api", "edges"] and len(parts) == 3:
                found = graph.edge_detail(self.store.read("edges"), self.store.read("edge_conditions"), self.store.read("occurrences"), parts[2])
                return (200, found) if found else (404, {"detail": "no such edge"})
            if len(parts) == 2 and parts[0] == "api" and parts[1] in self.routes:
                return 200, self.routes[parts[1]](asked)
            return 404, {"detail": "not found"}
        except BadRequest as error:
            return 422, {"detail": str(error)}
        except FileNotFoundError as error:
            return 503, {"detail": str(error)}

    def number(self, asked: dict, name: str, default: int, least: int, most: int) -> int:
        try:
            n = int(asked.get(name, default))
        except ValueError as error:
            raise BadRequest(f"{name}: a number is needed") from error
        if not least <= n <= most:
            raise BadRequest(f"{name}: {least} to {most}")
        return n

    def edges(self, asked: dict) -> DataFrame:
        least = self.number(asked, "min_occurrences", 1, 1, 1 << 31)
        return graph.select_edges(self.store.read("edges"), asked.get("source"), least, asked.get("include_ambiguous", "true").lower() not in ("0", "false"))

    def nodes(self, asked: dict) -> DataFrame:
        nodes = self.store.read("nodes")
        return nodes.where(nodes["source"] == asked["source"]) if "source" in asked else nodes

    def summary(self, asked: dict) -> object:
        counts = graph.summary(self.store.read("nodes"), self.store.read("edges"), self.store.read("occurrences"), self.store.read("files"))
        return _rows(counts)[0] | {"sources": self.sources(asked), "last_scan": self.store.last_scan()}

    def sources(self, asked: dict) -> object:
        return [r["source"] for r in graph.sources(self.store.read("nodes")).collect()]

    def graph(self, asked: dict) -> object:
        limit = self.number(asked, "limit", 400, 1, MOST_NODES)
        nodes, edges = graph.subgraph(self.edges(asked), self.nodes(asked), limit)
        shown, ranked = _rows(nodes), graph.top_nodes(self.nodes(asked), limit=limit).count()
        found = _rows(graph.top_edges(graph.with_ids(edges), MOST_EDGES + 1))
        return {"nodes": shown, "edges": found[:MOST_EDGES], "isolated": ranked - len(shown), "truncated": ranked >= limit or len(found) > MOST_EDGES}

    def model(self, asked: dict) -> object:
        limit = self.number(asked, "limit", 200, 1, MOST_NODES)
        tables, pairs = graph.model(self.nodes(asked), self.edges(asked), self.store.read("columns"), self.store.read("edge_conditions"), limit)
        return {"tables": _rows(tables), "relationships": _rows(pairs.orderBy(*pairs.columns).limit(MOST_EDGES))}

    def tables(self, asked: dict) -> object:
        return _rows(graph.top_nodes(self.nodes(asked), asked.get("search"), limit=self.number(asked, "limit", 500, 1, MOST_NODES)))

    def neighbourhood(self, asked: dict) -> object:
        if not asked.get("table"):
            raise BadRequest("table: a name is needed")
        limit = self.number(asked, "limit", 300, 1, MOST_NODES)
        nodes, edges = graph.surroundings(self.edges(asked), self.nodes(asked), asked["table"], self.number(asked, "depth", 1, 1, MOST_DEPTH), limit)
        found = _rows(graph.top_edges(graph.with_ids(edges), MOST_EDGES + 1))
        return {"nodes": _rows(nodes), "edges": found[:MOST_EDGES], "truncated": len(found) > MOST_EDGES}

    def path(self, asked: dict) -> object:
        if not asked.get("start") or not asked.get("end"):
            raise BadRequest("start, end: names are needed")
        found = graph.shortest_paths(self.edges(asked), asked["start"], asked["end"], self.number(asked, "k", 3, 1, MOST_PATHS))
        return {"paths": _rows(graph.weakest_link(found).orderBy("rank"))}


def server(spark: SparkSession, path: str, host: str = "127.0.0.1", port: int = 8000) -> ThreadingHTTPServer:
    api = Api(spark, path)

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self) -> None:  # noqa: N802
            status, body = api.answer(self.path)
            raw = json.dumps(body, default=str).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(raw)))
            self.end_headers()
            self.wfile.write(raw)

        def log_message(self, *args: object) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)
