"""Functions no built-in expresses: longest common subsequence and greedy packing, in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def lcs_length(a: list[str], b: list[str]) -> int:
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def _rouge(p: str | None, g: str | None) -> float:
    a, b = (p or "").lower().split(), (g or "").lower().split()
    both = lcs_length(a, b)
    return 2 * both / (len(a) + len(b)) if both else 0.0


def rouge_l_f(pred: Column, gold: Column) -> Column:
    """F-measure of the longest common subsequence of words; 0 where either side has none."""

    @F.pandas_udf("double")
    def score(p: pd.Series, g: pd.Series) -> pd.Series:
        return pd.Series([_rouge(x, y) for x, y in zip(p, g)], dtype="float64")

    return score(pred, gold)


def greedy_ranges(sizes: list[int], least: int, most: int) -> list[tuple[int, int]]:
    """Consecutive paragraphs put together until `least` words are reached or `most` would be passed."""
    out, start, total = [], 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most:
            out.append((start, i))
            start, total = i, 0
        total += n
        if total >= least:
            out.append((start, i + 1))
            start, total = i + 1, 0
    if start < len(sizes):
        out.append((start, len(sizes)))
    return out


def pack_paragraphs(docs: DataFrame, key: str, text: str, least: int, most: int) -> DataFrame:
    """(doc_id, first, stop, words, passage); paragraphs are lines. Narrow: a document is one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[], [], [], [], []]
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                parts = [p.strip() for p in t.split("\n") if p.strip()]
                sizes = [len(p.split()) for p in parts]
                for a, b in greedy_ranges(sizes, least, most):
                    for c, x in zip(cols, (k, a, b, sum(sizes[a:b]), " ".join(parts[a:b]))):
                        c.append(x)
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["doc_id", "first", "stop", "words", "passage"])

    base = docs.where(F.col(text).isNotNull()).select(F.col(key).cast("bigint"), F.col(text))
    return base.mapInArrow(run, "doc_id bigint, first int, stop int, words bigint, passage string")
