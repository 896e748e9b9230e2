"""Problem 6: passages of held-out items inside a large corpus, by q-gram lemma filtering.

Both sides are reduced to their words joined by single spaces. A leaked passage is a stretch of an item that aligns with a
stretch of a document so that its equal words, less PENALTY for each word changed, left out or put in, make at least
`min_words`: min_words equal words in a row, or a longer stretch of m words with up to (m - min_words) / (PENALTY + 1) edits,
so the budget grows with the length.

1. Lemma. Such a stretch of n characters with e edited words shares at least n + 1 - q - sum(length + q) character
   q-grams with its source, the sum over the e longest words. The least of these bounds over stretches with up to MOST_EDITS edits
   is the item's threshold. The shared q-grams lie on diagonals (text position minus item position) that drift by no more than
   the edits shift the text.
2. Per document the shared q-grams are counted in bands of BAND diagonals that overlap by half; a stretch
   that drifts by up to BAND / 2 characters lies in one band whole. Bands that meet the item's threshold, and whose runs of q-grams
   can make a passage, are regions.
3. Every region is verified by alignment of words in its band; the longest run of equal words there is exact.

Items that share text share q-grams: the distinct q-grams of a block of items have one place each, stretches of
places that the same items hold at the same distances are one segment, and a document's hits are counted by runs over segments:
an instruction that stands in thousands of items makes one run per document, not one hit per q-gram and item.

The items are a stated query set. They go to the tasks in blocks of at most BLOCK_ITEMS items and BLOCK_CHARS characters (or
one item, if longer), one pass over the corpus per block. A block's index is built once, sent by broadcast, and freed when the
block's results are written, before the next block is read; the corpus is never shuffled.

Defined results: NULL and empty texts hold nothing; an item of fewer than min_words words can't be
found; equal items are all reported; a document is reported once per item, with its best passage. Columns other than the
named ones are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from answerforge.llm.words import chunks, fold, mix, word_hashes
from answerforge.session import materialize_all

BLOCK_ITEMS, BLOCK_CHARS = 20_000, 4_000_000
Q, BAND, PENALTY, MOST_EDITS, CELL_BITS = 10, 64, 3, 8, 20
#: Rows of runs times items that are held at once.
EXPANDED = 2_000_000
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_UNIT = 1 << 16
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("matched_words", pa.int32()), ("edits", pa.int32()), ("item_share", pa.float64()), ("run_words", pa.int32())])
OUT = "doc_id bigint, item_id bigint, matched_words int, edits int, item_share double, run_words int"


def normalise(text: str | None) -> bytes:
    """The words joined by single spaces."""
    return b" ".join(fold(text).split())


def qgram_hashes(data: np.ndarray, q: int) -> np.ndarray:
    """Hash of each q consecutive bytes, built by doubling."""
    n = len(data) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        power, width, done = data.astype(np.uint64), 1, None
        filled, rest = 0, q
        while rest:
            if rest & 1:
                part = power[filled : filled + n]
                done = mix(part + _GOLD) if done is None else mix(done * _GOLD + part)
                filled += width
            rest >>= 1
            if rest:
                power = power[:-width] * np.uint64(0x100000001B3) ** np.uint64(width) + power[width:] if width < 8 else mix(power[:-width] * _GOLD + power[width:])
                width *= 2
    return done


def _spread(counts: np.ndarray, first: np.ndarray) -> np.ndarray:
    """first[i], first[i] + 1, .. for counts[i] values, one after another."""
    return np.repeat(first - np.append(0, np.cumsum(counts)[:-1]), counts) + np.arange(int(counts.sum()))


class Words:
    """First and last characters and hashes of the words of a normalised text."""

    def __init__(self, raw: bytes):
        self.starts, self.hashes = word_hashes(np.frombuffer(raw + b" ", np.uint8))
        self.ends = np.append(self.starts[1:] - 1, len(raw))

    def inside(self, first: int, last: int) -> int:
        """Number of words that lie whole in the characters first .. last - 1."""
        return max(0, int(np.searchsorted(self.ends, last, "right")) - int(np.searchsorted(self.starts, first, "left")))


def least_shared(words: Words, size: int, min_words: int, q: int) -> int:
    """The q-gram lemma for one item: least number of q-grams that any stretch within the edit budget shares."""
    edges = np.append(words.starts, size + 1)
    longest = np.sort(np.diff(edges) - 1)[::-1]
    lost = np.append(0, np.cumsum(longest + q))
    bound = size
    for edits in range(MOST_EDITS + 1):
        for put_in in (0, 1):
            m = min_words + (PENALTY + 1) * edits + PENALTY * put_in
            if m <= len(words.starts) and edits < len(lost):
                least = int((edges[m:] - edges[:-m]).min()) - 1
                bound = min(bound, least + 1 - q - int(lost[edits]) - put_in * (q - 1))
    return max(1, bound)


class Index:
    """q-grams of a block of items: a bit table to pass over most of the corpus, distinct q-grams with their place, and
    segments of places with the items that hold them."""

    def __init__(self, items: list[tuple[int, str]], min_words: int, q: int = Q):
        self.min_words = min_words
        keys: dict[bytes, list[int]] = {}
        for key, text in items:
            raw = normalise(text)
            if raw.count(b" ") + 1 >= min_words:
                keys.setdefault(raw, []).append(key)
        self.texts, self.keys = list(keys), list(keys.values())
        self.words = [Words(t) for t in self.texts]
        shortest = [int((np.append(w.starts, len(t) + 1)[min_words:] - w.starts[: len(w.starts) - min_words + 1]).min()) - 1 for w, t in zip(self.words, self.texts)]
        self.q = max(2, min([q, *shortest]))
        self.least = np.array([least_shared(w, len(t), min_words, self.q) for w, t in zip(self.words, self.texts)], np.int64)
        base = np.cumsum([0] + [len(t) + 1 for t in self.texts])
        data = np.frombuffer(b"\n".join(self.texts), np.uint8)
        grams = qgram_hashes(data, self.q)
        at = _spread(*(np.array(x, np.int64) for x in ([len(t) - self.q + 1 for t in self.texts], base[:-1]))) if self.texts else np.zeros(0, np.int64)
        owner = np.searchsorted(base, at, "right") - 1
        self.hash, first, which = np.unique(grams[at], return_index=True, return_inverse=True)
        self.place = at[first]
        place = self.place[which]
        starts = np.flatnonzero(np.append(True, (np.diff(place) != 1) | (np.diff(owner) != 0))) if len(at) else np.zeros(0, np.int64)
        size = np.diff(np.append(starts, len(at)))
        self.cuts = np.unique(np.concatenate([place[starts], place[starts] + size]))
        lo, hi = np.searchsorted(self.cuts, place[starts]), np.searchsorted(self.cuts, place[starts] + size)
        segment = _spread(hi - lo, lo)
        item = np.repeat(owner[starts], hi - lo)
        shift = np.repeat(at[starts] - base[owner[starts]] - place[starts], hi - lo)
        order = np.lexsort((shift, item, segment))
        self.slot, self.shift = segment[order] * max(1, len(self.texts)) + item[order], shift[order]
        starts_of = [w.starts for w in self.words]
        self.word_base = np.cumsum([0] + [len(x) for x in starts_of])
        self.text_base = base
        lengths = [np.diff(np.append(x, len(t) + 1)) - 1 for x, t in zip(starts_of, self.texts)]
        self.word_first = np.concatenate([x + base[i] for i, x in enumerate(starts_of)]) if starts_of else np.zeros(0, np.int64)
        self.word_last = np.concatenate([x + n + base[i] for i, (x, n) in enumerate(zip(starts_of, lengths))]) if starts_of else np.zeros(0, np.int64)
        pays = lambda x, n: len(x) > PENALTY and bool(((x + n)[PENALTY:] - x[:-PENALTY] < self.q).any())
        self.dense = np.array([pays(x, n) for x, n in zip(starts_of, lengths)], bool)
        self.bits_log = int(min(26, max(16, np.ceil(np.log2(16 * len(self.hash) + 1)))))
        self.bits = np.zeros(1 << self.bits_log, bool)
        self.bits[(self.hash >> np.uint64(64 - self.bits_log)).astype(np.int64)] = True

    def words_inside(self, item: np.ndarray, place: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Number of the item's words that lie whole in the characters place .. place + length - 1."""
        first = np.searchsorted(self.word_first, self.text_base[item] + place, "left")
        last = np.searchsorted(self.word_last, self.text_base[item] + place + length, "right")
        return np.maximum(last - first, 0)

    def runs(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(first position, first place, length, segment) of the runs of shared q-grams in a text."""
        h = qgram_hashes(data, self.q)
        at = np.flatnonzero(self.bits[(h >> np.uint64(64 - self.bits_log)).astype(np.int64)])
        row = np.minimum(np.searchsorted(self.hash, h[at]), len(self.hash) - 1)
        good = self.hash[row] == h[at]
        at, place = at[good], self.place[row[good]]
        segment = np.searchsorted(self.cuts, place, "right") - 1
        new = np.flatnonzero(np.append(True, (np.diff(at) != 1) | (np.diff(place) != 1) | (np.diff(segment) != 0))) if len(at) else np.zeros(0, np.int64)
        return at[new], place[new], np.diff(np.append(new, len(at))), segment[new]

    def expanded(self, runs: tuple[np.ndarray, ...], doc: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """(document, item, position, item position, length) of all runs, whole documents and items together, at
        most EXPANDED rows at a time unless one document and item have more."""
        todo = [(0, len(doc), 0, len(self.texts))]
        at, place, size, segment = runs
        while todo:
            a, b, i, j = todo.pop()
            lo = np.searchsorted(self.slot, segment[a:b] * len(self.texts) + i)
            count = np.searchsorted(self.slot, segment[a:b] * len(self.texts) + j) - lo
            if count.sum() > EXPANDED and (doc[a] != doc[b - 1] or j - i > 1):
                if doc[a] != doc[b - 1]:
                    middle = int(np.searchsorted(doc, doc[(a + b) // 2]))
                    middle = middle if middle > a else int(np.searchsorted(doc, doc[a], "right"))
                    todo += [(a, middle, i, j), (middle, b, i, j)]
                else:
                    todo += [(a, b, i, (i + j) // 2), (a, b, (i + j) // 2, j)]
                continue
            rows = _spread(count, lo)
            if len(rows):
                again = np.repeat(np.arange(a, b), count)
                yield doc[again], self.slot[rows] % len(self.texts), at[again], place[again] + self.shift[rows], size[again]


def regions(index: Index, doc: np.ndarray, item: np.ndarray, at: np.ndarray, place: np.ndarray, size: np.ndarray) -> list[tuple[int, ...]]:
    """(bound on the score, bound on the run, document, item, first diagonal of the band, first position, last
    position, and position, item position and length of the longest run) of bands with enough shared q-grams in which a passage is possible, greatest bounds first.

    In an alignment at least one edit lies between two runs of shared q-grams, and equal words outside of runs come in pieces shorter
    than q characters. Where no such piece of the item holds more than PENALTY words it doesn't pay for its edit, so no score
    exceeds that of the best chain of runs: their whole words, less PENALTY for each gap."""
    diagonal = at - place
    out = []
    for half in (0, BAND // 2):
        band = (diagonal + half) // BAND
        # Cells too poor even when hashed together can't reach the bound: dropped before sorting.
        with np.errstate(over="ignore"):
            cell = (mix((doc * len(index.texts) + item).astype(np.uint64) * _GOLD + band.astype(np.uint64)) >> np.uint64(64 - CELL_BITS)).astype(np.int64)
        rows = np.flatnonzero(np.bincount(cell, size, minlength=1 << CELL_BITS)[cell] >= index.least[item])
        order = rows[np.lexsort((at[rows], diagonal[rows], band[rows], item[rows], doc[rows]))]
        if not len(order):
            continue
        d, o, b, p, first, n = doc[order], item[order], band[order], place[order], at[order], size[order]
        new = np.append(True, (np.diff(d) != 0) | (np.diff(o) != 0) | (np.diff(b) != 0))
        starts = np.flatnonzero(new)
        rich = np.add.reduceat(n, starts) >= index.least[o[starts]]
        # Runs that only a segment's end cuts are one.
        cut = np.append(True, (np.diff(p - first) != 0) | (first[1:] != first[:-1] + n[:-1])) | new
        head = np.flatnonzero(cut)
        length = np.add.reduceat(n, head) + index.q - 1
        whole = index.words_inside(o[head], p[head], length)
        group = np.cumsum(new)[head] - 1
        by_place = np.lexsort((first[head], group))
        group, whole, head, length = group[by_place], whole[by_place], head[by_place], length[by_place]
        paid = np.cumsum(whole - PENALTY)
        before = paid - (whole - PENALTY)
        low = np.minimum.accumulate(before - group * (1 << 40)) + group * (1 << 40)
        inner = np.flatnonzero(np.append(True, np.diff(group) != 0))
        bound = np.maximum.reduceat(paid - low + PENALTY, inner)
        bound[index.dense[o[starts]]] = 1 << 30
        run = np.maximum.reduceat(whole, inner)
        after = np.append(inner[1:], len(group))
        begin, last = np.minimum.reduceat(first, starts), np.maximum.reduceat(first + n, starts)
        for i in np.flatnonzero(rich & (bound >= index.min_words)):
            s = starts[i]
            top = inner[i] + int(whole[inner[i] : after[i]].argmax())
            out.append((int(bound[i]), int(run[i]), int(d[s]), int(o[s]), int(b[s]) * BAND - half, int(begin[i]), int(last[i]), int(first[head[top]]), int(p[head[top]]), int(length[top])))
    return sorted(out, reverse=True)


def align(text: Words, first: int, last: int, item: Words, low: int, high: int) -> tuple[int, int, int]:
    """(equal words less penalties, edits, longest run of equal words) of the best local alignment of the text's words
    first..last - 1 and the item's words on the diagonals low..high."""
    n = len(item.starts)
    score, run = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)
    best = longest = 0
    cost = PENALTY * _UNIT + 1
    rows = np.arange(first, last)
    begin = np.searchsorted(item.starts, text.starts[rows] - high, "left")
    end = np.searchsorted(item.starts, text.starts[rows] - low, "right")
    a = b = 0
    for r, lo, hi in zip(rows, begin, end):
        same = item.hashes[lo:hi] == text.hashes[r]
        now = np.maximum(np.maximum(score[lo:hi] + np.where(same, _UNIT, -cost), score[lo + 1 : hi + 1] - cost), 0)
        gaps = np.arange(len(now)) * cost
        now = np.maximum.accumulate(now + gaps) - gaps
        equal = np.where(same, run[lo:hi] + 1, 0)
        score[a:b] = run[a:b] = 0
        a, b = lo + 1, hi + 1
        score[a:b], run[a:b] = now, equal
        if len(now):
            best, longest = max(best, int(now.max())), max(longest, int(equal.max()))
    points = -(-best // _UNIT)
    return points, points * _UNIT - best, longest


def scan(index: Index, keys: list[int], texts: list[str | None]) -> list[tuple]:
    """Rows of OUT for a few documents."""
    raw = [normalise(t) for t in texts]
    starts = np.cumsum([0] + [len(r) + 1 for r in raw])
    runs = index.runs(np.frombuffer(b"\n".join(raw), np.uint8))
    if not len(runs[0]):
        return []
    doc = np.searchsorted(starts, runs[0], "right") - 1
    words: dict[int, Words] = {}
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    for part in index.expanded((runs[0] - starts[doc], *runs[1:]), doc):
        for bound, possible, d, o, low, at, end, text_at, item_at, length in regions(index, *part):
            points, _, run = best.get((d, o), (0, 0, 0))
            if bound <= points and possible <= run:
                continue
            if d not in words:
                words[d] = Words(raw[d])
            text = words[d]
            item = index.words[o]
            if bound == possible == min(text.inside(text_at, text_at + length), item.inside(item_at, item_at + length)):
                points, edits, run = bound, 0, bound  # nothing beats this run, and all its words are equal
            else:
                first, last = np.searchsorted(text.starts, (at - BAND, end + BAND))
                points, edits, run = align(text, int(first), int(last), item, low, low + BAND - 1)
            if points >= index.min_words:
                old = best.get((d, o), (0, 0, 0))
                best[d, o] = (*max(old[:2], (points, -edits)), max(old[2], run))
    out = []
    for (d, o), (points, spent, run) in sorted(best.items()):
        equal = points - PENALTY * spent
        out += [(keys[d], key, equal, -spent, round(equal / len(index.words[o].starts), 6), run) for key in index.keys[o]]
    return out


def _scanner(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            rows = []
            for keys, texts in chunks(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows += scan(index, keys, texts)
            cols = list(zip(*rows)) if rows else [[]] * len(_SCHEMA)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _SCHEMA)], schema=_SCHEMA)

    return run


def _blocks(items: DataFrame, item_key: str, item_text: str, most: int, chars: int) -> Iterator[list[tuple[int, str]]]:
    """Items in blocks of bounded size, streamed to the driver one partition at a time."""
    block, size = [], 0
    for key, text in items.select(F.col(item_key).cast("bigint"), item_text).where(f"{item_text} is not null").toLocalIterator():
        if block and (len(block) >= most or size + len(text) > chars):
            yield block
            block, size = [], 0
        block.append((key, text))
        size += len(text)
    if block:
        yield block


def leaked_passages(docs: DataFrame, doc_key: str, doc_text: str, items: DataFrame, item_key: str, item_text: str, min_words: int = 12, block_items: int = BLOCK_ITEMS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Rows of OUT: every document with every item of which it holds a passage, see the module's docstring. run_words is
    the longest run of equal words among the passages: at least min_words where that many consecutive words are equal."""
    base = docs.select(F.col(doc_key).cast("bigint").alias("doc_id"), F.col(doc_text).alias("text")).where("text is not null")
    context = docs.sparkSession.sparkContext

    def parts() -> Iterator[DataFrame]:
        for block in _blocks(items, item_key, item_text, block_items, block_chars):
            index = Index(block, min_words)
            if index.texts:
                shared = context.broadcast(index)
                yield base.mapInArrow(_scanner(shared), OUT)
                shared.destroy()

    found = materialize_all(parts(), "leaks")
    return docs.sparkSession.createDataFrame([], OUT) if found is None else found
