"""Cell and key normalisation, and compact encodings of vectors and texts, in Arrow batches."""

from __future__ import annotations

import base64
import re
import unicodedata
import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Signs that are written as one, and what is stripped from the end of a cell until nothing changes.
SIGNS = {"'": "‘’´`", '"': "“”", "-": "‐‑‒–—−"}
TRAILING = (
    (r"((?<!^)\[[^\]]*\]|\[\d+\]|[•♦†‡*#+])*$", ""),
    (r"(?<!^)( \([^)]*\))*$", ""),
    (r'^"([^"]*)"$', r"\1"),
)
_TABLE = {ord(c): to for to, signs in SIGNS.items() for c in signs}
_TRAILING = [(re.compile(p), to) for p, to in TRAILING]


@lru_cache(maxsize=100_000)
def _cell(text: str) -> str:
    marks = unicodedata.normalize("NFKD", text)
    now = "".join(c for c in marks if unicodedata.category(c) != "Mn").translate(_TABLE)
    before = None
    while now != before:
        before = now
        for pattern, to in _TRAILING:
            now = pattern.sub(to, now.strip())
    return re.sub("<[^<]+?>", "", " ".join(now.removesuffix(".").lower().split()))


def normalize_cell(c: Column) -> Column:
    """A table cell for comparison: no diacritics, plain quotes and dashes, no notes, brackets or quotes around it."""

    @F.pandas_udf("string")
    def normal(s: pd.Series) -> pd.Series:
        return s.map(_cell, na_action="ignore")

    return normal(c)


def document_key(url: Column) -> Column:
    """Percent codes decoded; plus signs stay, and what is no valid code stays whole."""
    return F.coalesce(F.try_url_decode(F.replace(url, F.lit("+"), F.lit("%2B"))), url)


def vector_to_text(v: Column) -> Column:
    """An array of numbers as base64 of half-precision floats."""

    @F.pandas_udf("string")
    def text(s: pd.Series) -> pd.Series:
        return s.map(lambda x: base64.b64encode(np.asarray(x, np.float16).tobytes()).decode(), na_action="ignore")

    return text(v)


def text_to_vector(c: Column) -> Column:
    @F.pandas_udf("array<float>")
    def vector(s: pd.Series) -> pd.Series:
        return s.map(lambda x: np.frombuffer(base64.b64decode(x), np.float16).astype(np.float32), na_action="ignore")

    return vector(c)


def compress_text(c: Column) -> Column:
    """zlib of the UTF-8 bytes."""

    @F.pandas_udf("binary")
    def packed(s: pd.Series) -> pd.Series:
        return s.map(lambda x: zlib.compress(x.encode()), na_action="ignore")

    return packed(c)


def decompress_text(c: Column) -> Column:
    @F.pandas_udf("string")
    def text(s: pd.Series) -> pd.Series:
        return s.map(lambda x: zlib.decompress(x).decode(), na_action="ignore")

    return text(c)
