"""Ordered-state operators: run-length ids, recency-weighted means, threshold histograms, batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from answerforge.operators.passages import number_rows, number_runs

#: Rows folded at a time by the recency-weighted mean.
CHUNK = 1000


def run_length_ids(df: DataFrame, by: str, order: list[str], value: str) -> DataFrame:
    """Consecutive equal values get `value_0`, `value_1`, ...; the count starts anew with every run. No task gets a whole group."""
    runs = number_runs(df, by, order, value)
    return runs.withColumn("run_id", F.concat(F.col(value), F.lit("_"), (F.col("_n") - F.col("_run")).cast("string"))).drop("_n", "_group", "_run")


def moving_average(df: DataFrame, by: str, order: list[str], value: str, weight: float, chunk: int = CHUNK) -> DataFrame:
    """(by, average, rows): each new value enters with weight max(weight, 1/count).

    The recurrence avg = (1 - w) avg + w x is linear, so chunks of rows fold to pairs (a, b) that compose; those are
    folded `chunk` at a time as well, and what is put in sequence per group is one pair for chunk * chunk rows.
    """
    numbered = number_runs(df.where(F.col(value).isNotNull()), by, order).withColumn("n", F.col("_n") - F.col("_group") + 1)
    w = F.greatest(F.lit(weight), 1.0 / F.col("n"))
    pairs = numbered.select(by, (F.col("n") - 1).alias("at"), F.struct((1 - w).alias("a"), (w * F.col(value).cast("double")).alias("b")).alias("f"), F.lit(1).cast("bigint").alias("rows"))
    start = F.struct(F.lit(1.0).cast("double").alias("a"), F.lit(0.0).cast("double").alias("b"))
    step = lambda acc, f: F.struct((acc["a"] * f["a"]).alias("a"), (acc["b"] * f["a"] + f["b"]).alias("b"))
    for level in range(3):
        at = F.lit(0).cast("bigint") if level == 2 else F.floor(F.col("at") / chunk)
        lists = pairs.groupBy(by, at.alias("at")).agg(F.array_sort(F.collect_list(F.struct("at", "f"))).alias("fs"), F.sum("rows").alias("rows"))
        pairs = lists.select(by, "at", F.aggregate(F.transform("fs", lambda x: x["f"]), start, step).alias("f"), "rows")
    return pairs.select(by, F.col("f.b").alias("average"), "rows")


def threshold_bucket(value: Column, thresholds: list[float]) -> Column:
    """Index of the first threshold that is not below the value; one more where all are."""
    return sum((F.when(value > t, 1).otherwise(0) for t in thresholds), F.lit(0))


def threshold_distribution(df: DataFrame, value: str, thresholds: list[float]) -> DataFrame:
    """(bucket, count, total, fraction) over sorted thresholds."""
    counts = df.where(F.col(value).isNotNull()).groupBy(threshold_bucket(F.col(value), sorted(thresholds)).cast("bigint").alias("bucket")).agg(F.count("*").alias("count"), F.round(F.sum(value), 4).alias("total"))
    every = Window.partitionBy(F.lit(1))  # one row per threshold
    return counts.withColumn("fraction", F.round(F.col("count") / F.sum("count").over(every), 6))


def batches(df: DataFrame, order: list[str], size: int, ranks: int) -> DataFrame:
    """Fixed-size batches in the given order, and the worker that owns each."""
    numbered = number_rows(df, order, "n")
    batch = F.floor((F.col("n") - 1) / size)
    return numbered.withColumn("batch", batch).withColumn("owner", F.pmod(batch, F.lit(ranks))).drop("n")
