"""Documents to passages and token windows; numbering of rows without a global sort in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from answerforge.functions.text import space_tokens
from answerforge.session import materialize


def docs2passages(docs: DataFrame, doc_id: str, text: str, size: int, overlap: int) -> DataFrame:
    """(doc_id, off, passage): windows of `size` words, stride size - overlap, the last filled from the start
    of the document. Documents of at most `size` words stay whole; those of at most `overlap` words and NULL
    texts give none."""
    ws = docs.where(F.col(text).isNotNull()).select(F.col(doc_id).alias("doc_id"), space_tokens(F.col(text)).alias("ws")).where(F.size("ws") > overlap)
    starts = F.when(F.size("ws") <= size, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.size("ws") - overlap - 1, F.lit(size - overlap)))
    each = ws.select("doc_id", "ws", F.explode(starts).alias("off"))
    window = F.when(F.size("ws") <= size, F.col("ws")).otherwise(F.slice(F.concat("ws", "ws"), F.col("off") + 1, size))
    return each.select("doc_id", F.col("off").cast("bigint").alias("off"), F.array_join(window, " ").alias("passage"))


def token_windows(docs: DataFrame, doc_id: str, tokens: Column, size: int, stride: int) -> DataFrame:
    """(doc_id, start, stop, window_idx) of overlapping windows that cover all tokens."""
    n = docs.select(F.col(doc_id).alias("doc_id"), F.size(tokens).alias("n")).where("n > 0")
    starts = F.sequence(F.lit(0), F.greatest(F.col("n") - size, F.lit(0)) + stride - 1, F.lit(stride))
    each = n.select("doc_id", "n", F.explode(starts).alias("start"))
    return each.select("doc_id", F.col("start").cast("bigint").alias("start"), F.least(F.col("start") + size, F.col("n")).cast("bigint").alias("stop"), F.floor(F.col("start") / stride).alias("window_idx"))


def _ranged(df: DataFrame, order: list[str]) -> DataFrame:
    return materialize(df.repartitionByRange(*[F.col(c) for c in order]).withColumn("_p", F.spark_partition_id()), "ranges")


def number_rows(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """1-based row numbers in the given order: counts per range partition, then numbers within it."""
    parts = _ranged(df, order)
    before = Window.partitionBy(F.lit(1)).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    base = parts.groupBy("_p").agg(F.count("*").alias("c")).select("_p", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("_p").orderBy(*order)
    return parts.join(base, "_p").withColumn(name, (F.row_number().over(inside) + F.col("_base")).cast("bigint")).drop("_p", "_base")


def prefix_offsets(df: DataFrame, order: str, value: str, name: str) -> DataFrame:
    """Sum of `value` over the rows before, in the given order."""
    parts = _ranged(df, [order])
    before = Window.partitionBy(F.lit(1)).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    base = parts.groupBy("_p").agg(F.sum(value).alias("c")).select("_p", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("_p").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return parts.join(base, "_p").withColumn(name, (F.coalesce(F.sum(value).over(inside), F.lit(0)) + F.col("_base")).cast("bigint")).drop("_p", "_base")


def number_runs(df: DataFrame, by: str, order: list[str], value: str | None = None) -> DataFrame:
    """df with `_n`, the row's number in the order of (by, order), `_group`, the number of the first row of its group, and, with a
    value, `_run`, that of the first row of its run of equal values (a NULL is a run of its own).

    A group may hold any share of the rows: windows run over range partitions, and what a partition takes over from those
    before it (rows, last row, last starts) comes from one row per partition."""
    keys = [by, *order]
    parts = _ranged(df, keys)
    inside, flow = Window.partitionBy("_p").orderBy(*keys), Window.partitionBy(F.lit(1)).orderBy("_p")
    before = flow.rowsBetween(Window.unboundedPreceding, -1)
    seen = F.struct(F.col(by).alias("g"), F.col(value or by).alias("v"))
    edge = parts.groupBy("_p").agg(F.count(F.lit(1)).alias("c"), F.max_by(seen, F.struct(*keys)).alias("end"))
    edge = edge.select("_p", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("_base"), F.lag("end").over(flow).alias("_end"))
    rows = parts.join(edge, "_p").withColumn("_n", F.row_number().over(inside) + F.col("_base")).withColumn("_last", F.coalesce(F.lag(seen).over(inside), F.col("_end")))
    new_group = F.col("_last").isNull() | ~F.col("_last.g").eqNullSafe(F.col(by))
    new_run = new_group | F.coalesce(F.col("_last.v") != F.col(value or by), F.lit(True))
    marked = materialize(rows.withColumns({"_g": F.when(new_group, F.col("_n")), "_r": F.when(new_run, F.col("_n"))}).drop("_base", "_end", "_last"), "marked")
    carried = marked.groupBy("_p").agg(F.max("_g").alias("g"), F.max("_r").alias("r")).select("_p", F.max("g").over(before).alias("_g0"), F.max("r").over(before).alias("_r0"))
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    out = marked.join(carried, "_p").withColumn("_group", F.coalesce(F.max("_g").over(upto), F.col("_g0")))
    if value is not None:
        out = out.withColumn("_run", F.coalesce(F.max("_r").over(upto), F.col("_r0")))
    return out.drop("_p", "_g", "_r", "_g0", "_r0")
