"""The index catalogue over HTTP: JSON in and out, one Spark session behind it.

    GET  /indexes                       -> [{"index_id", "engine", "state"}]
    GET  /indexes/{id}                  -> {"index_id", "state", ..}
    POST /indexes                       {"documents": [{"doc_id", "title", "text"}], "engine", "config"} or {"path": Parquet folder, ..}
    GET  /indexes/{id}/documents?ids=1,2
    POST /retrieve                      {"index_id", "queries": [str], "parameters": {..}} -> a list of hits per query
    GET  /retrievers                    -> components and their parameters
"""

from __future__ import annotations

import json
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

from pyspark.sql import SparkSession

from answerforge import components
from answerforge.service import IndexStore

RETRIEVERS = ("SparseRetriever", "VectorRetriever")


class Api:
    """What the server does, without HTTP: (status, value) of a method, path and body."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.store = spark, IndexStore(spark, root)

    def call(self, method: str, url: str, body: dict | None = None) -> tuple[int, object]:
        parts, asked = urlsplit(url), body or {}
        names = [n for n in parts.path.split("/") if n]
        try:
            match (method, *names):
                case ("GET", "indexes"):
                    return 200, [r.asDict() for r in self.store.indexes().collect()]
                case ("POST", "indexes"):
                    return 201, {"index_id": self._generate(asked)}
                case ("GET", "indexes", index_id):
                    state = self.store.status(index_id)
                    return (404 if state == "DOES_NOT_EXIST" else 200), {"index_id": index_id, "state": state}
                case ("GET", "indexes", index_id, "documents"):
                    ids = [int(i) for i in parse_qs(parts.query).get("ids", [""])[0].split(",") if i]
                    return 200, [r.asDict() for r in self.store.documents(index_id, ids).collect()]
                case ("POST", "retrieve"):
                    return 200, self._retrieve(asked)
                case ("GET", "retrievers"):
                    return 200, [components.describe(components.get(name)) for name in RETRIEVERS]
        except (KeyError, TypeError, ValueError) as e:
            return 400, {"error": str(e)}
        return 404, {"error": f"{method} {parts.path}"}

    def _generate(self, asked: dict) -> str:
        if "path" in asked:
            docs = self.spark.read.parquet(asked["path"])
        else:
            docs = self.spark.createDataFrame([(d["doc_id"], d.get("title"), d["text"]) for d in asked["documents"]], "doc_id bigint, title string, text string")
        return self.store.generate(docs, asked.get("engine", "SparseRetriever"), asked.get("index_id"), **asked.get("config", {}))

    def _retrieve(self, asked: dict) -> list[list[dict]]:
        queries = self.spark.createDataFrame([(i, q) for i, q in enumerate(asked["queries"])], "qid bigint, query string")
        out: list[list[dict]] = [[] for _ in asked["queries"]]
        for r in sorted(self.store.retrieve(asked["index_id"], queries, asked.get("retriever"), **asked.get("parameters", {})).collect(), key=lambda r: r["rank"]):
            out[r["qid"]].append({"score": r["score"], "document": {k: r[k] for k in ("doc_id", "title", "text")}})
        return out


def serve(spark: SparkSession, root: str, host: str = "127.0.0.1", port: int = 8080) -> ThreadingHTTPServer:
    """A server that is ready to `serve_forever`."""
    api = Api(spark, root)

    class Handler(BaseHTTPRequestHandler):
        def _answer(self) -> None:
            size = int(self.headers.get("Content-Length") or 0)
            try:
                body = json.loads(self.rfile.read(size)) if size else None
                status, value = api.call(self.command, self.path, body)
            except json.JSONDecodeError as e:
                status, value = 400, {"error": str(e)}
            raw = json.dumps(value).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(raw)))
            self.end_headers()
            self.wfile.write(raw)

        do_GET = do_POST = _answer

        def log_message(self, *args) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)
