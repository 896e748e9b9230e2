"""The control plane as a library: an index catalogue with states, and retrieval against a ready index."""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from answerforge import components
from answerforge.operators.sparse import BM25Index
from answerforge.sources.files import Folder

STATES = ("INDEXING", "READY", "CORRUPT", "DOES_NOT_EXIST")


class IndexStore:
    """Indexes as folders under any root that Spark can write to: the documents as Parquet, for the sparse engine an
    inverted index that every search uses, and a small JSON file with state and configuration."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.folder = spark, Folder(spark, root)

    def _info(self, index_id: str) -> dict:
        if not self.folder.exists(index_id, "information.json"):
            return {"index_id": index_id, "state": "DOES_NOT_EXIST"}
        return json.loads(self.folder.read(index_id, "information.json"))

    def _write(self, info: dict) -> None:
        self.folder.write(json.dumps(info), info["index_id"], "information.json")

    def generate(self, docs: DataFrame, engine: str = "SparseRetriever", index_id: str | None = None, **config) -> str:
        """Stores (doc_id, title, text); READY when all is written, CORRUPT if that fails."""
        index_id = index_id or uuid.uuid4().hex
        info = {"index_id": index_id, "engine": engine, "config": config, "state": "INDEXING", "modified": time.time()}
        self._write(info)
        try:
            rows = docs.select(F.col("doc_id").cast("bigint"), F.coalesce("title", F.lit("")).alias("title"), "text")
            rows.write.mode("overwrite").parquet(self.folder.path(index_id, "documents"))
            if engine == "SparseRetriever":
                made = components.get(engine, **config)
                BM25Index.build(self.spark.read.parquet(self.folder.path(index_id, "documents")), self.folder.path(index_id, "bm25"), k1=made.k1, b=made.b)
            self._write(info | {"state": "READY", "modified": time.time()})
        except Exception:
            self._write(info | {"state": "CORRUPT", "modified": time.time()})
            raise
        return index_id

    def status(self, index_id: str) -> str:
        return self._info(index_id)["state"]

    def indexes(self) -> DataFrame:
        found = [self._info(n) for n in self.folder.names() if self.folder.exists(n, "information.json")]
        return self.spark.createDataFrame([(i["index_id"], i.get("engine"), i["state"]) for i in found], "index_id string, engine string, state string")

    def documents(self, index_id: str, ids: list[int] | None = None) -> DataFrame:
        if self.status(index_id) != "READY":
            raise ValueError(f"index {index_id} is {self.status(index_id)}")
        docs = self.spark.read.parquet(self.folder.path(index_id, "documents"))
        return docs.where(F.col("doc_id").isin(ids)) if ids is not None else docs

    def retrieve(self, index_id: str, queries: DataFrame, retriever: str | None = None, **overrides) -> DataFrame:
        """Hits with their documents; the retriever must be of the index's engine."""
        info = self._info(index_id)
        docs = self.documents(index_id)
        if retriever and retriever != info["engine"]:
            raise ValueError(f"index {index_id} is of {info['engine']}, not {retriever}")
        made = components.get(info["engine"], **(info["config"] | overrides))
        if info["engine"] == "SparseRetriever":
            found = BM25Index(self.spark, self.folder.path(index_id, "bm25"), made.k1, made.b).search(queries, made.k)
        else:
            found = made.retrieve(queries, docs)
        return found.join(docs, "doc_id")
