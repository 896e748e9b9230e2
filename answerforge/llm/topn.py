"""Problem 2: the N best items of every group, exactly, with hot groups pruned before ranking.

1. Rows that agree in the candidate key are one candidate; the row with the smallest item id stands.
   The key spreads a hot group over all partitions.
2. Rows with NULL or NaN score go.
3. Per (group, score bin) counts, combined map-side, give for every large group the highest bin such
   that at least N candidates lie in it or above: a safe lower threshold. Bins are logarithmic in the
   score, so groups on any scale get useful ones.
4. Rows below their group's threshold are dropped. Up to FEW_FLOORS thresholds, counted, are broadcast;
   more are joined on (group, salt) by a shuffle in which a hot group is spread over SALTS partitions.
5. Survivors are ranked exactly: score descending, tie columns ascending with NULL last, id ascending.

Defined results: an empty table gives none; NULL group is a group of its own; a NULL part of the
candidate key equals another NULL; equal scores are settled by the tie columns and the unique id, so
the result is the same on every run; other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from answerforge.session import materialize

SALTS = 8
#: Groups up to this many candidates are ranked as they are.
SMALL_GROUP = 64
#: Thresholds that may be broadcast: rows of a group name and a number, a few MB in all.
FEW_FLOORS = 50_000


def score_bin(score: Column) -> Column:
    """Order-preserving, scale-free bin: 16 per doubling of the absolute value."""
    size = F.least(F.abs(score), F.lit(1e290)) * F.lit(1e12)
    level = F.floor(F.log2(F.lit(1.0) + size) * 16)
    return F.when(score < 0, -level).otherwise(level)


def distinct_candidates(df: DataFrame, key: list[str], item: str, keep: list[str]) -> DataFrame:
    """Per key the row with the smallest item id; hash aggregation over primitive buffers."""
    kept = [F.min_by(c, item).alias(c) for c in keep]
    return df.groupBy(*key).agg(F.min(item).alias("_item"), *kept).withColumnRenamed("_item", item)


def safe_thresholds(rows: DataFrame, n: int, small: int = SMALL_GROUP) -> DataFrame:
    """(g, floor_bin) of groups with more than `small` rows: at least n rows have bin >= floor_bin."""
    cells = rows.groupBy("g", "bin").agg(F.count("*").alias("c"))
    down = Window.partitionBy("g").orderBy(F.col("bin").desc())
    run = cells.withColumn("above", F.sum("c").over(down) - F.col("c"))
    return run.groupBy("g").agg(F.min(F.when(F.col("above") < n, F.col("bin"))).alias("floor_bin"), F.sum("c").alias("rows")).where(F.col("rows") > small).select("g", "floor_bin")


def top_n_per_group(df: DataFrame, group: str, score: str, item: str, ties: list[str], n: int = 5, key: list[str] | None = None, small: int = SMALL_GROUP) -> DataFrame:
    """(group, item, score, ties..., pos) of the n best rows of each group; see the module docstring."""
    key = key or [group, item]
    cols = list(dict.fromkeys([*key, group, score, item, *ties]))
    kept = [c for c in [score, *ties, group] if c not in key]
    base = df.select(*cols)
    one = base if key == [group, item] else distinct_candidates(base, key, item, kept)
    one = one.where(F.col(score).isNotNull() & ~F.isnan(score)).select(F.col(group).alias("g"), F.col(item).alias("i"), F.col(score).alias("s"), *[F.col(t).alias(f"t{k}") for k, t in enumerate(ties)])
    rows = materialize(one, "candidates")
    binned = rows.withColumn("bin", score_bin(F.col("s").cast("double")))
    floors = materialize(safe_thresholds(binned, n, small), "floors")
    same_group = F.col("g").eqNullSafe(F.col("fg"))
    floors = floors.withColumnRenamed("g", "fg")
    if floors.count() <= FEW_FLOORS:
        met = binned.join(F.broadcast(floors), same_group, "left")
    else:
        salted = floors.withColumn("fsalt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).hint("merge")
        left = binned.withColumn("salt", F.pmod(F.xxhash64("i"), F.lit(SALTS)).cast("int"))
        met = left.join(salted, same_group & (F.col("salt") == F.col("fsalt")), "left")
    kept_rows = met.where(F.col("floor_bin").isNull() | (F.col("bin") >= F.col("floor_bin")))
    order = [F.col("s").desc(), *[F.col(f"t{k}").asc_nulls_last() for k in range(len(ties))], F.col("i").asc()]
    ranked = kept_rows.withColumn("pos", F.row_number().over(Window.partitionBy("g").orderBy(*order))).where(F.col("pos") <= n)
    return ranked.select(F.col("g").alias(group), F.col("i").alias(item), F.col("s").alias(score), *[F.col(f"t{k}").alias(t) for k, t in enumerate(ties)], "pos")
