"""Words and word-sequence hashes, vectorised over Arrow batches.

A word is a maximal run of Unicode letters and digits, lower-cased; everything else separates.
Texts are folded to UTF-8 bytes in which every separator is a space; word hashes come from prefix
sums of byte * BASE^position, so no word becomes a Python object.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np

WORD = re.compile(r"[^\W_]+")
CHUNK_CHARS = 500_000
#: Bytes hashed at once; longer texts are cut at spaces, which changes no hash.
SEGMENT = 4_000_000
_WIDE_SEPARATOR = re.compile(r"[^\w\x00-\x7f]+")
_ASCII = bytes(c if c >= 128 else ord(chr(c).lower()) if chr(c).isalnum() else 32 for c in range(256))
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0x100000001B3
_INVERSE = pow(_BASE, -1, 2**64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def words(text: str | None) -> list[str]:
    return [w.lower() for w in WORD.findall(text)] if text else []


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fold(text: str | None) -> bytes:
    """The text's words in UTF-8, lower-cased, with spaces for everything between them."""
    if not text:
        return b""
    if not text.isascii():
        text = _WIDE_SEPARATOR.sub(" ", text).lower()
    return text.encode("utf-8", "replace").translate(_ASCII)


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            row = np.full(n, base, np.uint64)
            row[0] = 1
            with np.errstate(over="ignore"):
                _powers[k] = np.cumprod(row)
    return _powers[0][:n], _powers[1][:n]


def _hash_bytes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first byte, hash) of every word; data must end with a space."""
    space = data == 32
    edge = np.empty(len(data), bool)
    edge[0], edge[1:] = not space[0], space[1:] != space[:-1]
    at = np.flatnonzero(edge)
    starts, ends = at[0::2], at[1::2]
    up, down = _power(len(data) + 1)
    with np.errstate(over="ignore"):
        run = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=run[1:])
        return starts, mix((run[ends] - run[starts]) * down[starts])


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if len(data) <= SEGMENT:
        return _hash_bytes(data)
    firsts, hashes, lo = [], [], 0
    while lo < len(data):
        hi = min(len(data), lo + SEGMENT)
        if hi < len(data):
            gap = np.flatnonzero(data[lo:hi] == 32)
            hi = lo + int(gap[-1]) + 1 if len(gap) else hi + int(np.argmax(data[hi:] == 32)) + 1
        f, h = _hash_bytes(data[lo:hi])
        firsts.append(f + lo)
        hashes.append(h)
        lo = hi
    return np.concatenate(firsts), np.concatenate(hashes)


def batch_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """All words' hashes of the texts one after another, and each text's number of words."""
    parts = [fold(t) for t in texts]
    bounds = np.cumsum([0] + [len(p) + 1 for p in parts])
    starts, hashes = word_hashes(np.frombuffer(b" ".join(parts) + b" ", np.uint8)) if parts else (np.zeros(0, np.int64), np.zeros(0, np.uint64))
    return hashes, np.diff(np.searchsorted(starts, bounds))


def chunks(keys: list, texts: list) -> Iterator[tuple[list, list]]:
    """Pieces of a batch of about CHUNK_CHARS characters, so that arrays stay small; texts stay whole."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= CHUNK_CHARS:
            yield keys[start : i + 1], texts[start : i + 1]
            start, size = i + 1, 0
    if start < len(texts):
        yield keys[start:], texts[start:]


def rolling(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive words."""
    n = max(0, len(hashes) - k + 1)
    h = hashes[:n].copy()
    with np.errstate(over="ignore"):
        for j in range(1, k):
            h = mix(h * _GOLD + hashes[j : n + j])
        return mix(h)


def shingle_sets(hashes: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct k-word sequences of each text as hashes: (values, text number), sorted by text, then value.

    A text of fewer than k words has none.
    """
    if len(hashes) < k:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(counts)), counts)
    h = rolling(hashes, k)
    inside = owner[: len(h)] == owner[k - 1 :]
    h, owner = h[inside], owner[: len(inside)][inside]
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    return h[new], owner[new]
