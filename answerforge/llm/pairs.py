"""Shared by the operators on pairs: bounded rarity tables, and joins whose hot keys are dealt into cells."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from answerforge.session import materialize

#: Rows of one key that a task gets at most, about, from either side of a split join.
BLOCK = 4096
#: Size of a rarity table, fixed whatever the corpus: 2^18 counters, 2 MB.
RARITY_BITS = 18


def bucket_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - RARITY_BITS)).astype(np.int64)


def rarity_table(df: DataFrame, hashes_of: Callable[[pa.RecordBatch], Iterator[np.ndarray]]) -> np.ndarray:
    """Occurrences of hashed items over all rows of df, in 2^RARITY_BITS shared counters.

    Counted per Arrow batch, summed map-side, at most 2^RARITY_BITS rows reach the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(1 << RARITY_BITS, np.int64)
        for batch in batches:
            for hashes in hashes_of(batch):
                np.add.at(sums, *_counted(hashes))
        at = np.flatnonzero(sums)
        for lo in range(0, len(at), 1 << 16):
            part = at[lo : lo + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(sums[part])], names=["bucket", "n"])

    got = df.mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(1 << RARITY_BITS, np.int64)
    out[got["bucket"].to_numpy(np.int64)] = got["n"].to_numpy(np.int64)
    return out


def _counted(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(bucket_of(hashes), return_counts=True)


def _blocks(df: DataFrame, on: list[str], out: str, block: int) -> DataFrame:
    return df.groupBy(*on).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > block).select(*on, F.ceil(F.col("_n") / F.lit(block)).cast("int").alias(out))


def split_join(left: DataFrame, right: DataFrame, on: list[str], block: int = BLOCK, unique_right: bool = False, big: DataFrame | None = None) -> DataFrame:
    """Inner join on NULL-free keys in which no task gets a hot key whole: the rows of a key with more than `block`
    rows on a side are dealt by hash into blocks of about that many, the other side's blocks are repeated for each,
    and every cell is joined for itself. Rows repeated are in proportion to the rows of the result over `block`.
    Both sides are read twice, so they should be written tables or scans, unless `big` is given: (on, _bl, _br), the
    numbers of blocks of keys that need more than one. No row is lost or capped."""
    if big is not None:
        pass
    elif unique_right:
        big = _blocks(left, on, "_bl", block)
        big = big.withColumn("_br", F.lit(1))
    else:
        big = _blocks(left, on, "_bl", block).join(_blocks(right, on, "_br", block), on, "full").fillna(1, ["_bl", "_br"])
    big = materialize(big, "big")
    if big.isEmpty():
        return left.join(right, on)
    own = lambda df, n: F.pmod(F.xxhash64(*df.columns), F.coalesce(F.col(n), F.lit(1))).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.coalesce(F.col(n), F.lit(1)) - 1))
    dealt_left = left.join(big, on, "left").withColumn("_i", own(left, "_bl")).withColumn("_j", every("_br")).drop("_bl", "_br")
    dealt_right = right.join(big, on, "left").withColumn("_j", own(right, "_br")).withColumn("_i", every("_bl")).drop("_bl", "_br")
    return dealt_left.join(dealt_right, [*on, "_i", "_j"]).drop("_i", "_j")


def attach_both(pairs: DataFrame, payload: DataFrame, block: int = BLOCK) -> DataFrame:
    """(a, b, left, right, other columns of pairs) from pairs (a, b, ..) and payload (key, items). A key with very many
    pairs, on either side, is dealt into blocks, for each of which its payload is repeated."""
    rest = [c for c in pairs.columns if c not in ("a", "b")]
    as_b = payload.select(F.col("key").alias("b"), F.col("items").alias("right"))
    as_a = payload.select(F.col("key").alias("a"), F.col("items").alias("left"))
    big_a = materialize(_blocks(pairs, ["a"], "_bl", block), "pivots")
    if big_a.isEmpty():
        met = split_join(pairs, as_b, ["b"], block, True).join(as_a, "a")
    else:
        salt = F.pmod(F.xxhash64("a", "b"), F.coalesce(F.col("_bl"), F.lit(1))).cast("int")
        dealt = as_a.join(big_a, "a", "left").withColumn("_cell", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_bl"), F.lit(1)) - 1))).drop("_bl")
        marked = pairs.join(big_a, "a", "left").withColumn("_cell", salt).drop("_bl")
        met = split_join(marked, as_b, ["b"], block, True).join(dealt, ["a", "_cell"])
    return met.select("a", "b", "left", "right", *rest)
