"""Preparation of training features: window targets, contexts, graphs of row and passage nodes, batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from answerforge.operators.ranking import hash_order
from answerforge.session import materialize


def spans_intersect(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Whether the closed spans [a, b] and [c, d] share a place."""
    return F.greatest(a, c) <= F.least(b, d)


def window_targets(windows: DataFrame, start: Column, stop: Column) -> DataFrame:
    """Target of each window for an answer at tokens [start, stop): inside it both ends relative to the window
    and SPAN; an overlap or nothing gives (0, 0) and NONE; has_answer tells negatives of answered questions."""
    inside = (start >= F.col("start")) & (stop <= F.col("stop")) & (start >= 0)
    return windows.select(
        "*",
        F.when(inside, start - F.col("start")).otherwise(0).cast("bigint").alias("target_start"),
        F.when(inside, stop - 1 - F.col("start")).otherwise(0).cast("bigint").alias("target_end"),
        F.when(inside, "SPAN").otherwise("NONE").alias("target_type"),
        F.when(inside, "POSITIVE").when(start >= 0, "NEGATIVE_HAS_ANSWER").otherwise("NEGATIVE_NO_ANSWER").alias("subsample"),
    )


def keep_by_rate(df: DataFrame, key: str, rates: dict[str, float], kind: str, seed: int = 0) -> DataFrame:
    """Bernoulli keep per class, by the hash of the key, so that a rerun keeps the same rows."""
    u = F.conv(F.substring(hash_order(key, seed=seed), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))
    rate = F.lit(1.0)
    for name, r in rates.items():
        rate = F.when(F.col(kind) == name, r).otherwise(rate)
    return df.where(u < rate)


def best_context(windows: DataFrame, key: str, position: str) -> DataFrame:
    """For every token position the window with the most context: min(left, right) + 0.01 * length, the first of equal ones."""
    left, right = F.col(position) - F.col("start"), F.col("stop") - 1 - F.col(position)
    score = F.least(left, right) + 0.01 * (F.col("stop") - F.col("start"))
    inside = windows.where((F.col(position) >= F.col("start")) & (F.col(position) < F.col("stop")))
    w = Window.partitionBy(key, position).orderBy(F.round(score, 6).desc(), "window_idx")
    return inside.withColumn("_n", F.row_number().over(w)).where("_n = 1").select(key, position, "window_idx")


def beam_paths(edges: DataFrame, start: DataFrame, hops: int, beam: int) -> DataFrame:
    """Paths without loops of up to `hops` edges (src, dst, weight) from each start node, the `beam` best by
    summed weight kept per start at every hop. The frontier is at most beam rows a start."""
    paths = start.select("start", F.array("start").alias("path"), F.lit(0.0).cast("double").alias("score"))
    out = paths
    for _ in range(hops):
        tail = paths.withColumn("src", F.element_at("path", -1))
        grown = tail.join(edges, "src").where(~F.array_contains("path", F.col("dst")))
        grown = grown.select("start", F.concat("path", F.array("dst")).alias("path"), F.round(F.col("score") + F.col("weight"), 6).alias("score"))
        w = Window.partitionBy("start").orderBy(F.col("score").desc(), F.array_join(F.transform("path", lambda x: x.cast("string")), ","))
        paths = materialize(grown.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= beam).drop("_n"), "beam")
        out = out.unionByName(paths)
    return out


def conflict_free_batches(triples: DataFrame, size: int, seed: int = 0, rounds: int = 8) -> DataFrame:
    """(qid, pos, neg, batch): a positive of one instance is no negative of another in its batch.

    Instances are dealt to batches by hash; those that clash within their batch are dealt again in the next
    round, until none is left or the rounds end; what still clashes then gets a batch of its own.
    """
    left, out, base = triples.select("qid", "pos", "neg"), None, 0
    for r in range(rounds):
        n = left.count()
        if not n:
            break
        batches = max(1, n // size)
        dealt = materialize(left.withColumn("batch", (F.pmod(F.xxhash64("qid", "pos", "neg", F.lit(seed + r)), F.lit(batches)) + base).cast("bigint")), "dealt")
        held = dealt.select("batch", F.col("pos").alias("neg"), F.col("qid").alias("other"))
        clash = dealt.join(held, ["batch", "neg"]).where("qid <> other").select("qid", "pos", "neg").distinct()
        good = dealt.join(clash, ["qid", "pos", "neg"], "left_anti")
        out = good if out is None else out.unionByName(good)
        left = materialize(dealt.join(clash, ["qid", "pos", "neg"], "left_semi").drop("batch"), "left")
        base += batches
    alone = left.withColumn("batch", F.lit(-1) - F.pmod(F.xxhash64("qid", "pos", "neg"), F.lit(1 << 40)))
    return alone if out is None else out.unionByName(alone)


def clean_text(c: Column) -> Column:
    """Separators of the passage format and runs of white space become single spaces."""
    return F.trim(F.regexp_replace(F.replace(c, F.lit("::::"), F.lit(" ")), r"\s+", " "))


def validate_schema(df: DataFrame, expected: str) -> list[str]:
    """Differences between a frame's columns and a DDL schema; empty if all expected columns are there."""
    from pyspark.sql.types import _parse_datatype_string

    have = {f.name: f.dataType.simpleString() for f in df.schema}
    return [f"{f.name}: {have.get(f.name, 'missing')} instead of {f.dataType.simpleString()}" for f in _parse_datatype_string(expected) if have.get(f.name) != f.dataType.simpleString()]


def search_defaults(k: int) -> dict[str, float]:
    """Cells, threshold and documents of the centroid search by depth: fixed values."""
    if k <= 10:
        return {"ncells": 1, "threshold": 0.5, "ndocs": 256}
    if k <= 100:
        return {"ncells": 2, "threshold": 0.45, "ndocs": 1024}
    return {"ncells": 4, "threshold": 0.4, "ndocs": max(4 * k, 4096)}


def partition_count(vectors: int) -> int:
    """Number of centroids of an index: the power of two not above 8 * sqrt(vectors)."""
    target = int(8 * max(1, vectors) ** 0.5)
    return 1 << (target.bit_length() - 1)


def index_sample_size(vectors: int) -> int:
    """Number of vectors on which the centroids of an index are fitted: all of a small collection."""
    return min(vectors, 1 + int(16 * (120 * vectors) ** 0.5))
