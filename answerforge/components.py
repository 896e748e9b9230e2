"""Pluggable components: protocols, deterministic defaults, a registry, and their parameters as rows.

A component is a dataclass whose fields are its parameters. Neural models plug in by implementing the
protocol; the defaults here need no model and make whole pipelines runnable and testable.
"""

from __future__ import annotations

import hashlib
import importlib
import json
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field, fields
from functools import lru_cache
from typing import Protocol, runtime_checkable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from answerforge.functions.text import words
from answerforge.operators import sparse, vectors


def parameter(default, description: str = "", hashed: bool = True, **options):
    """A dataclass field with its description; `hashed=False` leaves it out of the component's identity."""
    return field(default=default, metadata={"description": description, "hashed": hashed, **options})


class Component:
    def identity(self) -> str:
        """Hash of the class and the parameters that make results differ."""
        own = {f.name: getattr(self, f.name) for f in fields(self) if f.metadata.get("hashed", True)}
        return hashlib.sha256(json.dumps([type(self).__name__, own], sort_keys=True, default=str).encode()).hexdigest()[:16]

    @classmethod
    def parameters(cls, spark: SparkSession) -> DataFrame:
        """(component, name, type, default, description) of every parameter."""
        rows = [(cls.__name__, f.name, str(f.type), None if f.default is None else str(f.default), f.metadata.get("description", "")) for f in fields(cls)]
        return spark.createDataFrame(rows, "component string, name string, type string, default string, description string")


@runtime_checkable
class Retriever(Protocol):
    def retrieve(self, queries: DataFrame, docs: DataFrame) -> DataFrame:
        """queries (qid, query), docs (doc_id, text) -> (qid, doc_id, score, rank)."""


@runtime_checkable
class Reranker(Protocol):
    def rerank(self, pairs: DataFrame) -> DataFrame:
        """pairs (qid, query, doc_id, text) -> (qid, doc_id, score, rank)."""


@runtime_checkable
class Reader(Protocol):
    def read(self, contexts: DataFrame) -> DataFrame:
        """contexts (qid, query, doc_id, text) -> (qid, answer, confidence, doc_id)."""


@runtime_checkable
class Embedder(Protocol):
    def embed(self, text: Column) -> Column:
        """text -> ARRAY<FLOAT>."""


@dataclass
class SparseRetriever(Component):
    k: int = parameter(10, "documents per query")
    k1: float = parameter(0.9, "saturation of term frequency")
    b: float = parameter(0.4, "normalisation by length")

    def retrieve(self, queries: DataFrame, docs: DataFrame) -> DataFrame:
        return sparse.bm25_topk(docs, queries, self.k, self.k1, self.b)


@dataclass
class HashingEmbedder(Component):
    """Signed word hashing to unit vectors: the offline stand-in for an encoder."""

    size: int = parameter(64, "dimensions")

    def embed(self, text: Column) -> Column:
        """Words are hashed in the JVM; a batch of them is counted into vectors at once."""
        size = self.size

        @F.pandas_udf("array<float>")
        def vector(hashes: pd.Series) -> pd.Series:
            lists = [np.asarray(h, np.int64) if h is not None else np.zeros(0, np.int64) for h in hashes]
            row = np.repeat(np.arange(len(lists)), [len(h) for h in lists])
            h = np.concatenate(lists) if lists else np.zeros(0, np.int64)
            v = np.bincount(row * size + np.abs(h >> 1) % size, weights=1.0 - 2.0 * (h & 1), minlength=len(lists) * size).reshape(-1, size)
            n = np.linalg.norm(v, axis=1, keepdims=True)
            return pd.Series(list((v / np.where(n == 0, 1, n)).astype(np.float32)), dtype=object)

        return vector(F.transform(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: w != ""), lambda w: F.xxhash64(w)))


@dataclass
class VectorRetriever(Component):
    k: int = parameter(10, "documents per query")
    metric: str = parameter("cosine", "dot, cosine or l2", options=["dot", "cosine", "l2"])
    embedder: Embedder = field(default_factory=HashingEmbedder)

    def retrieve(self, queries: DataFrame, docs: DataFrame) -> DataFrame:
        d = docs.select(F.col("doc_id").alias("vec_id"), self.embedder.embed(F.col("text")).alias("embedding"))
        numbered = queries.select(F.xxhash64("qid").alias("vec_id"), "qid", self.embedder.embed(F.col("query")).alias("embedding"))
        found = vectors.vector_topk(d, numbered, self.k, self.metric)
        return found.withColumnRenamed("qid", "_q").join(numbered.select(F.col("vec_id").alias("_q"), "qid"), "_q").select("qid", F.col("vec_id").alias("doc_id"), "score", "rank")


@runtime_checkable
class PairScorer(Protocol):
    def score(self, query: Column, passage: Column) -> Column:
        """Score of a query with a passage: an expression, or a pandas UDF around a model."""


@dataclass
class OverlapScorer(Component):
    """Share of the query's words that the passage holds: the offline stand-in for a cross-encoder."""

    def score(self, query: Column, passage: Column) -> Column:
        q, t = F.array_distinct(words(query)), F.array_distinct(words(passage))
        return F.round(F.coalesce(F.try_divide(F.size(F.array_intersect(q, t)).cast("double"), F.size(q)), F.lit(0.0)), 6)


def passage_text(pairs: DataFrame) -> Column:
    """Title, blank line, text: what a scorer sees of a document. Without a title, the text."""
    return F.concat_ws("\n\n", F.when(F.col("title") != "", F.col("title")), F.col("text")) if "title" in pairs.columns else F.col("text")


@dataclass
class OverlapReranker(Component):
    """Documents of each query by the scores of a pluggable scorer; equal scores go by id."""

    keep: int = parameter(0, "documents per query; 0 keeps all")
    scorer: PairScorer = field(default_factory=OverlapScorer)

    def rerank(self, pairs: DataFrame) -> DataFrame:
        scored = pairs.select("qid", "doc_id", self.scorer.score(F.col("query"), passage_text(pairs)).alias("score"))
        return sparse.rank_by_score(scored, self.keep if self.keep > 0 else None)


def distillation_scores(pairs: DataFrame, scorer: PairScorer) -> DataFrame:
    """(qid, scores): all (score, doc_id) of a query, best first: what a student model is trained on."""
    scored = pairs.select("qid", "doc_id", scorer.score(F.col("query"), passage_text(pairs)).alias("score"))
    best_first = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("down"), "doc_id")))
    return scored.groupBy("qid").agg(F.transform(best_first, lambda x: F.struct((-x["down"]).alias("score"), x["doc_id"].alias("doc_id"))).alias("scores"))


@dataclass
class SentenceReader(Component):
    """The sentence that shares most words with the question."""

    min_score: float = parameter(0.0, "answers below are dropped; 0 keeps all")

    def read(self, contexts: DataFrame) -> DataFrame:
        each = contexts.select("qid", "doc_id", F.array_distinct(words(F.col("query"))).alias("q"), F.posexplode(F.split("text", r"(?<=[.!?])\s+")).alias("pos", "answer"))
        score = F.round(F.coalesce(F.try_divide(F.size(F.array_intersect("q", F.array_distinct(words(F.col("answer"))))).cast("double"), F.size("q")), F.lit(0.0)), 6)
        scored = each.withColumn("confidence", score).where(F.col("confidence") >= self.min_score)
        best = scored.groupBy("qid").agg(F.min(F.struct((-F.col("confidence")).alias("k"), "doc_id", "pos", "answer")).alias("x"))
        return best.select("qid", "x.answer", (-F.col("x.k")).alias("confidence"), "x.doc_id")


def prompt(question: Column, contexts: Column, prefix: str = "", suffix: str = "Answer:") -> Column:
    """Text for a generative reader."""
    lead = F.lit(prefix + " " if prefix else "")
    body = F.when(F.size(contexts) > 0, F.concat(F.lit(" Context: "), F.array_join(contexts, ", "))).otherwise("")
    return F.concat(lead, F.lit("Question: "), question, body, F.lit(f" {suffix}"))


@dataclass
class Pipeline:
    """retrieve -> rerank (if given) -> read, as one plan."""

    retriever: Retriever
    reader: Reader
    reranker: Reranker | None = None

    def run(self, queries: DataFrame, docs: DataFrame) -> DataFrame:
        """(qid, answer, confidence, doc_id); a query without a hit keeps a row without answer."""
        hits = self.retriever.retrieve(queries, docs).select("qid", "doc_id", "rank")
        pairs = hits.join(docs.select("doc_id", "text"), "doc_id").join(queries.select("qid", "query"), "qid")
        if self.reranker:
            pairs = pairs.drop("rank").join(self.reranker.rerank(pairs).select("qid", "doc_id", "rank"), ["qid", "doc_id"])
        return queries.select("qid").join(self.reader.read(pairs), "qid", "left")

    def preview(self, queries: DataFrame, docs: DataFrame, n: int = 3, chars: int = 200) -> DataFrame:
        """(qid, previews): beginnings of the first hits, in rank order."""
        hits = self.retriever.retrieve(queries, docs).where(F.col("rank") <= n).join(docs.select("doc_id", F.substring("text", 1, chars).alias("t")), "doc_id")
        return hits.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "t"))), lambda x: x["t"]).alias("previews"))


@runtime_checkable
class TextGenerator(Protocol):
    def answer(self, prompt: Column) -> Column:
        """prompt -> answer: an expression, or a pandas UDF around a model or a service."""


@dataclass
class EchoGenerator(Component):
    """The first sentence of the context that the prompt holds: the offline stand-in for a generative model."""

    def answer(self, prompt: Column) -> Column:
        return F.regexp_extract(prompt, r"Context: (.*?[.!?])(?=\s|$)", 1)


@dataclass
class PromptReader(Component):
    """Prompts from the contexts in rank order, answered by a pluggable generator; of a query, one row."""

    contexts: int = parameter(3, "contexts in a prompt")
    prefix: str = parameter("", "text before the question")
    suffix: str = parameter("Answer:", "text after the contexts")
    generator: TextGenerator = field(default_factory=EchoGenerator)

    def read(self, contexts: DataFrame) -> DataFrame:
        rank = F.col("rank") if "rank" in contexts.columns else F.lit(0)
        lists = contexts.groupBy("qid", "query").agg(F.array_sort(F.collect_list(F.struct(rank.alias("rank"), "doc_id", "text"))).alias("cs"))
        texts = F.transform(F.slice("cs", 1, self.contexts), lambda c: c["text"])
        asked = lists.select("qid", prompt(F.col("query"), texts, self.prefix, self.suffix).alias("prompt"), F.col("cs")[0]["doc_id"].alias("doc_id"))
        return asked.select("qid", self.generator.answer(F.col("prompt")).alias("answer"), F.lit(1.0).alias("confidence"), "doc_id")


class SearchableCorpus:
    """Add and search: passages go to an index in `folder` that every search uses; further ones may be added, at the cost of these only."""

    def __init__(self, spark: SparkSession, folder: str, retriever=None):
        self.spark, self.folder, self.retriever = spark, folder.rstrip("/"), retriever or SparseRetriever()

    def add(self, docs: DataFrame) -> None:
        """(doc_id, title, text); the index gets these passages, and those added before are left as they are."""
        part = uuid.uuid4().hex
        rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "title", "text", F.lit(part).alias("part"))
        rows.write.mode("append").option("compression", "zstd").parquet(f"{self.folder}/documents")
        if isinstance(self.retriever, SparseRetriever):
            sparse.BM25Index(self.spark, f"{self.folder}/index", self.retriever.k1, self.retriever.b).add(self._stored().where(F.col("part") == part), text="searched")

    def _stored(self) -> DataFrame:
        text = F.concat_ws(" ", F.when(F.col("title") != "", F.col("title")), F.col("text"))
        return self.spark.read.schema("doc_id bigint, title string, text string, part string").parquet(f"{self.folder}/documents").withColumn("searched", text)

    def documents(self) -> DataFrame:
        return self._stored().drop("part")

    def search(self, queries: DataFrame) -> DataFrame:
        """(qid, doc_ids, scores) in rank order for queries (qid, query); a query without a hit has empty arrays."""
        if isinstance(self.retriever, SparseRetriever):
            found = sparse.BM25Index(self.spark, f"{self.folder}/index", self.retriever.k1, self.retriever.b).search(queries, self.retriever.k)
        else:
            found = self.retriever.retrieve(queries, self.documents().select("doc_id", F.col("searched").alias("text")))
        lists = found.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "doc_id", "score"))).alias("hits"))
        out = queries.select("qid").distinct().join(lists, "qid", "left").withColumn("hits", F.coalesce("hits", F.array().cast("array<struct<rank:bigint,doc_id:bigint,score:double>>")))
        return out.select("qid", F.transform("hits", lambda h: h["doc_id"]).alias("doc_ids"), F.transform("hits", lambda h: h["score"]).alias("scores"))


_REGISTRY: dict[str, type] = {c.__name__: c for c in (SparseRetriever, VectorRetriever, HashingEmbedder, OverlapScorer, OverlapReranker, SentenceReader, EchoGenerator, PromptReader)}


def register(cls: type) -> type:
    _REGISTRY[cls.__name__] = cls
    return cls


def resolve(name: str) -> Callable:
    """A registered class, or one by dotted path `package.module.Class`."""
    if name in _REGISTRY:
        return _REGISTRY[name]
    module, _, attribute = name.rpartition(".")
    if not module:
        raise KeyError(name)
    return getattr(importlib.import_module(module), attribute)


@lru_cache(maxsize=64)
def _cached(name: str, config: str):
    return resolve(name)(**json.loads(config))


def get(name: str, **config):
    """One instance per class and parameters."""
    return _cached(name, json.dumps(config, sort_keys=True))


def describe(component) -> dict:
    return {"component": type(component).__name__, **asdict(component)}
