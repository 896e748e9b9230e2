"""Connected components of an undirected edge list: up to LOCAL edges in one task, more by alternating large-star and
small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from answerforge.session import join_counted, materialize

#: Edges of which one task finds the components (about 200 MB, measured); it spares the driver the plans of all rounds.
LOCAL = 1 << 20


def _roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every root with a lesser one beside it joins the least of these; paths are shortened; until no edge joins two roots."""
    parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
    if not parts:
        return
    u, v = (np.concatenate(x) for x in zip(*parts))
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    left, right = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while True:
        x, y = root[left], root[right]
        open_ = x != y
        if not open_.any():
            break
        left, right, x, y = left[open_], right[open_], x[open_], y[open_]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(up := root[root], root):
            root = up
    below = np.flatnonzero(root != np.arange(len(nodes)))
    for lo in range(0, len(below), 1 << 16):
        part = below[lo : lo + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(nodes[part]), pa.array(nodes[root[part]])], names=["node", "root"])


def _with_least(rows: DataFrame, total: int) -> DataFrame:
    """(u, v, m, n): each row with the least neighbour and the number of neighbours of u. These are written, so that the
    plan of a step holds no other step and doesn't repeat its own input for every join."""
    least = materialize(rows.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "least")
    return join_counted(rows, least, ["u"], "n", total)


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    met = _with_least(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), total)
    return met.select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e")).select(F.col("e.v").alias("u"), F.col("e.m").alias("v")).where("u <> v").distinct()


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    met = _with_least(edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))), 2 * total)
    return met.where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()


def connected_components(edges: DataFrame, a: str, b: str, max_rounds: int = 40, local: int = LOCAL) -> DataFrame:
    """(node, root) for every node but the roots; root is the least node of the component.

    Each step of more than `local` edges is written to the shared folder, so the plan stays short and lost executors cost
    one step. Self loops and repeated edges are ignored; an edge with a NULL end is dropped.
    """
    now = materialize(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").distinct(), "edges")
    seen = None
    for _ in range(max_rounds):
        total, mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if (total, mark) == seen or total == 0:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        if total <= local and dict(now.dtypes) == {"u": "bigint", "v": "bigint"}:
            return now.coalesce(1).mapInArrow(_roots, "node bigint, root bigint")
        seen = (total, mark)
        now = materialize(_small_star(materialize(_large_star(now, total), "edges"), total), "edges")
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
