"""Algebra of rankings (qid, doc_id, rank, score) and training triples mined from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_order(*cols: str, seed: int = 0) -> Column:
    """A reproducible random order that SQL engines share: md5 of the values and a seed."""
    return F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in cols], F.lit(str(seed))))


def merge_rankings(rankings: list[DataFrame], depth: int = 0) -> DataFrame:
    """Bag union, ranked anew per query by (score, rank, id), all descending; 0 keeps all."""
    union = rankings[0]
    for more in rankings[1:]:
        union = union.unionByName(more)
    w = Window.partitionBy("qid").orderBy(F.col("score").desc(), F.col("rank").desc(), F.col("doc_id").desc())
    merged = union.withColumn("new_rank", F.row_number().over(w).cast("bigint"))
    merged = merged.where(F.col("new_rank") <= depth) if depth else merged
    return merged.select("qid", "doc_id", "score", F.col("new_rank").alias("rank"))


def split_by_offset(ranking: DataFrame, gap: int) -> DataFrame:
    """Queries numbered split * gap + id back to (split, id); ids below the gap belong to the last split (-1)."""
    return ranking.withColumn("split", F.floor(F.col("qid") / gap) - 1).withColumn("qid", F.pmod("qid", F.lit(gap)))


def split_by_queries(ranking: DataFrame, owners: DataFrame) -> DataFrame:
    """Each row to the split that owns its query; a query owned twice is an error of the input."""
    return ranking.join(owners, "qid")


def first_hits(ranking: DataFrame, most: int) -> DataFrame:
    return ranking.where(F.col("rank") <= most)


def contiguous_ranks(ranking: DataFrame) -> DataFrame:
    """(qid, rows, gaps): ranks that do not follow the one before."""
    w = Window.partitionBy("qid").orderBy("rank", "doc_id")
    step = F.col("rank") - F.lag("rank", 1, 0).over(w)
    return ranking.withColumn("gap", (step != 1).cast("bigint")).groupBy("qid").agg(F.count("*").alias("rows"), F.sum("gap").alias("gaps"))


def with_document(ranking: DataFrame, docs: DataFrame, columns: list[str], how: str = "inner") -> DataFrame:
    """Hits with fields of their documents; inner drops unknown ids, left keeps them."""
    return ranking.join(docs.select("doc_id", *columns), "doc_id", how)


def hit_lists(ranking: DataFrame, most: int) -> DataFrame:
    """Per query its first hits as one array in rank order."""
    top = ranking.where(F.col("rank") <= most)
    return top.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "doc_id"))), lambda x: x["doc_id"]).alias("docs"))


def mine_triples(ranking: DataFrame, qrels: DataFrame, negatives: int, seed: int = 13) -> DataFrame:
    """(qid, pos, neg): every judged hit with `negatives` other hits of its query in hash order.

    A query's hits are at most the ranking's depth, so the join within a query is bounded.
    """
    marked = ranking.select("qid", "doc_id").join(qrels.select("qid", "doc_id", F.lit(1).alias("rel")), ["qid", "doc_id"], "left")
    pos = marked.where("rel = 1").select("qid", F.col("doc_id").alias("pos"))
    order = Window.partitionBy("qid").orderBy(hash_order("qid", "doc_id", seed=seed), "doc_id")
    neg = marked.where("rel is null").withColumn("n", F.row_number().over(order)).where(F.col("n") <= negatives).select("qid", F.col("doc_id").alias("neg"))
    return pos.join(neg, "qid")


def self_training_triples(ranking: DataFrame, positives: int, cutoff: int, depth: int) -> DataFrame:
    """Hits up to `positives` against hits ranked in (cutoff, depth]."""
    pos = ranking.where(F.col("rank") <= positives).select("qid", F.col("doc_id").alias("pos"))
    neg = ranking.where((F.col("rank") > cutoff) & (F.col("rank") <= depth)).select("qid", F.col("doc_id").alias("neg"))
    return pos.join(neg, "qid")


def take_by_hash(df: DataFrame, key: str, n: int, by: list[str] | None = None, seed: int = 0) -> DataFrame:
    """Exactly n rows, of each group if `by` is given, in hash order of the key: a reproducible sample."""
    order = [hash_order(key, seed=seed), F.col(key)]
    if not by:
        return df.orderBy(*order).limit(n)
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def take_by_hash_large(df: DataFrame, key: str, n: int, by: str, seed: int = 0) -> DataFrame:
    """As take_by_hash for few groups of any size: counts per group and hash cell (at most 65,536 a group)
    tell the cell in which the n-th row lies; only that cell's rows are ranked, so no task holds a group."""
    marked = df.withColumn("_h", hash_order(key, seed=seed)).withColumn("_cell", F.substring("_h", 1, 4))
    cells = marked.groupBy(by, "_cell").agg(F.count("*").alias("_c"))
    run = cells.withColumn("_before", F.sum("_c").over(Window.partitionBy(by).orderBy("_cell")) - F.col("_c")).where(F.col("_before") < n)
    edge = run.groupBy(by).agg(F.max("_cell").alias("_last"), F.max("_before").alias("_before"))
    near = marked.join(F.broadcast(edge), by).where(F.col("_cell") <= F.col("_last"))
    sure = near.where(F.col("_cell") < F.col("_last"))
    rank = F.row_number().over(Window.partitionBy(by).orderBy("_h", key))
    rest = near.where(F.col("_cell") == F.col("_last")).withColumn("_n", rank).where(F.col("_n") + F.col("_before") <= n).drop("_n")
    return sure.unionByName(rest).select(*df.columns)


def balance_classes(df: DataFrame, label: str, key: str, seed: int = 0) -> DataFrame:
    """As many rows of each class as the smallest has, in hash order. Class sizes are one row a class."""
    least = df.groupBy(label).count().agg(F.min("count")).first()[0] or 0
    return take_by_hash_large(df, key, least, label, seed)


def split_by_fraction(df: DataFrame, key: str, fractions: dict[str, float], seed: int = 0) -> DataFrame:
    """The same key always in the same split: its hash, as a number in [0, 1), against cumulated fractions."""
    u = F.conv(F.substring(hash_order(key, seed=seed), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))
    out, upto = F.lit(None).cast("string"), sum(fractions.values())
    for name, share in reversed(list(fractions.items())):
        out = F.when(u < upto, name).otherwise(out)
        upto -= share
    return df.withColumn("split_name", out)
