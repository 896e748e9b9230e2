"""Writers of the toolkit's file formats. A compressed target is a matter of the `compression` option."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from answerforge.operators.ranking import hash_order
from answerforge.sources.files import Folder


#: Tab-separated fields as they are: without quotes, spaces at their ends kept.
TAB_LINES = {"sep": "\t", "quote": "\u0000", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def _describe(df: DataFrame, path: str) -> None:
    """A sidecar with the columns, beside the target."""
    parent, _, name = path.rstrip("/").rpartition("/")
    Folder(df.sparkSession, parent or ".").write(json.dumps({"columns": df.columns, "types": [t for _, t in df.dtypes]}), f"{name}.meta.json")


def write_ranking(ranking: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """qid, doc_id, rank (from 1), score, tab-separated."""
    out = ranking.select("qid", "doc_id", "rank", "score")
    out.write.mode(mode).option("sep", "\t").csv(path)
    _describe(out, path)


def write_corpus(docs: DataFrame, path: str, compression: str = "none") -> None:
    """id, text, title with a header; tabs and line ends in fields become spaces."""
    clean = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"[\t\r\n]", " ")
    out = docs.select(F.col("pid").alias("id"), clean("text").alias("text"), clean("title").alias("title"))
    out.write.options(**TAB_LINES).option("header", True).option("emptyValue", "").option("compression", compression).csv(path)


def write_xor(hits: DataFrame, languages: DataFrame, path: str, most: int = 100) -> None:
    """Per query {id, lang, ctxs}: texts of its first hits in rank order; a query without language keeps its row."""
    top = hits.where((F.col("rank") <= most) & F.col("text").isNotNull())
    lists = top.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]).alias("ctxs"))
    lists.join(languages, "qid", "left").select(F.col("qid").alias("id"), "lang", "ctxs").write.json(path)


def write_index_lines(docs: DataFrame, path: str) -> None:
    contents = F.concat(F.coalesce("title", F.lit("")), F.lit("\t"), F.replace("text", F.lit("\t"), F.lit(" ")))
    docs.select(F.col("pid").alias("id"), contents.alias("contents")).write.json(path)


def write_shards(df: DataFrame, path: str, shards: int, seed: int = 0) -> None:
    """Rows in random shards, shuffled within them, the same ones for the same seed."""
    key = F.xxhash64(*[F.col(c) for c in df.columns], F.lit(seed))
    df.withColumn("_k", key).repartition(shards, "_k").sortWithinPartitions("_k").drop("_k").write.parquet(path)


def write_routed(df: DataFrame, path: str, route: str) -> None:
    """One folder per value of the routing column."""
    df.write.partitionBy(route).parquet(path)


def write_vectors(df: DataFrame, path: str) -> None:
    """Passages with their vectors as a Parquet table: (pid, title, text, vector)."""
    df.select("pid", "title", "text", F.col("vector").cast("array<float>").alias("vector")).write.parquet(path)


def sample_query_file(df: DataFrame, path: str, per_file: int) -> None:
    """Non-empty questions in files of at most so many lines."""
    rows = df.where(F.length(F.trim("question")) > 0).orderBy(hash_order("qid"))
    rows.select("qid", "question").write.options(**TAB_LINES).option("maxRecordsPerFile", per_file).csv(path)
