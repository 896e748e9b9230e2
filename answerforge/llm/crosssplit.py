"""Problem 4: records of evaluation splits that stand, exactly or almost, in the training split.

A record is the sequence of its words; its items are the k-word rolling hashes, tied to the record's scope. Records
of one scope with equal item sets form one class: classes are compared, and copies follow as members.

1. Fingerprints by winnowing: of every WINDOW consecutive rolling hashes the least is selected, the rarest first
   (by a fixed-size table of counts over all classes), then by value.
2. The fingerprints of train classes are joined with those of evaluation classes; two classes that share enough of
   them (half of what an overlap at the threshold lets expect) are candidates.
3. Supplement. The overlap of sets says nothing of order, so a pair of reordered or evenly edited records may share
   no window. Therefore a class also joins by the p = n - ceil(t n) + m rarest of all its items: two sets of
   overlap >= t share at least m of those, whatever the edits, so no pair is missed. Fingerprints more common than
   COMMON times the mean are left to this selection.
4. The exact overlap decides which candidates are links.
5. Links are chained: shared fingerprints in collinear order, extended by alignment (equal words to both sides of
   each), give the coverage of both records.

Result: classes, their members, and links between classes; `cross_split_overlaps` expands them to pairs of rows.
Hot fingerprints, hot classes and classes with very many links are dealt into blocks (`split_join`).

Defined results: a NULL or unknown split belongs to neither side; NULL or blank text, or fewer than k
words, gives no item and no pair; a NULL scope equals no other; every pair of rows that qualifies is
given once.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from answerforge.llm.pairs import BLOCK, attach_both, bucket_of, rarity_table, split_join
from answerforge.llm.words import batch_hashes, chunks, mix, rolling
from answerforge.session import join_hot_cold, materialize

WINDOW = 8
SHARED = 4
COMMON = 16
#: Split names, lower-cased and without other signs.
TRAIN, EVALUATION = ("train", "training"), ("dev", "test", "validation", "valid", "val", "eval", "evaluation")
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_SIGNS = re.compile(r"[\W_]+")


def split_side(split: Column) -> Column:
    """0 for train, 1 for an evaluation split, NULL otherwise; spelling aside."""
    plain = F.regexp_replace(F.lower(split), "[^a-z]+", "")
    return F.when(plain.isin(*TRAIN), 0).when(plain.isin(*EVALUATION), 1)


def canonical_id(name: str | None) -> str | None:
    """One spelling of an id written with other case, spaces, signs or percent codes."""
    return None if name is None else _SIGNS.sub("_", unicodedata.normalize("NFKC", unquote(name)).casefold()).strip("_")


def _items(words: np.ndarray, k: int, scope: int) -> np.ndarray:
    """Rolling hashes of a record's words (32 bits each) in text order, tied to its scope."""
    with np.errstate(over="ignore"):
        return mix(rolling(words.astype(np.uint64), k) ^ np.uint64(scope))


def _sequences(words: list[np.ndarray], k: np.ndarray, scope: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(item, record number) of many records, each record's items in text order, one record after another."""
    out, owners = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for one in np.unique(k):
        rows = np.flatnonzero(k == one)
        owner = np.repeat(rows, [len(words[i]) for i in rows])
        n = len(owner) - int(one) + 1
        if n > 0:
            inside = owner[:n] == owner[int(one) - 1 :]
            owner = owner[:n][inside]
            with np.errstate(over="ignore"):
                out.append(mix(rolling(np.concatenate([words[i] for i in rows]).astype(np.uint64), int(one))[inside] ^ scope[owner]))
            owners.append(owner)
    return np.concatenate(out), np.concatenate(owners)


def _distinct(seq: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(item, record number) once each, in order of record, then item; and the place of each of seq among them."""
    order = np.lexsort((seq, owner))
    v, o = seq[order], owner[order]
    new = np.append(True, (v[1:] != v[:-1]) | (o[1:] != o[:-1]))[: len(v)]
    at = np.empty(len(v), np.int64)
    at[order] = np.cumsum(new) - 1
    return v[new], o[new], at


def _classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, scope, text, side, k, t -> key, side, k, t, scope hash, set hashes, number of items, word hashes."""
    for batch in batches:
        rows = [r for r in zip(*(batch.column(i).to_pylist() for i in range(6))) if r[1] is not None]
        for part, some in chunks(rows, [r[2] for r in rows]):
            hashes, counts = batch_hashes(some)
            hashes = (hashes >> np.uint64(32)).astype("<u4")
            bounds = np.cumsum(np.append(0, counts))
            words = [hashes[bounds[i] : bounds[i + 1]] for i in range(len(part))]
            scope = np.array([_scope_hash(r[1]) for r in part], np.uint64)
            items, owner, _ = _distinct(*_sequences(words, np.array([r[4] for r in part]), scope))
            if not len(items):
                continue
            starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            at = owner[starts]
            with np.errstate(over="ignore"):
                h1, h2 = np.add.reduceat(mix(items), starts), np.add.reduceat(mix(items ^ _GOLD), starts)
            kept = [part[i] for i in at]
            cols = [[r[0] for r in kept], [r[3] for r in kept], [r[4] for r in kept], [r[5] for r in kept], scope[at].view(np.int64), h1.view(np.int64), h2.view(np.int64), np.diff(np.append(starts, len(items))), [words[i].tobytes() for i in at]]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _RECORD)], schema=_RECORD)


@lru_cache(maxsize=100_000)
def _scope_hash(scope: str) -> int:
    return xxhash.xxh3_64_intdigest(canonical_id(scope))


_RECORD = pa.schema([("key", pa.int64()), ("side", pa.int32()), ("k", pa.int32()), ("t", pa.float64()), ("scope", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("n", pa.int32()), ("words", pa.binary())])
RECORD = "key bigint, side int, k int, t double, scope bigint, h1 bigint, h2 bigint, n int, words binary"


def _numbers(batch: pa.RecordBatch, *names: str) -> Iterator[np.ndarray]:
    return (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in names)


def _unpacked(batch: pa.RecordBatch, name: str) -> list[np.ndarray]:
    return [np.frombuffer(raw, "<u4") for raw in batch.column(batch.schema.get_field_index(name)).to_pylist()]


def _all_items(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    k, scope = _numbers(batch, "k", "scope")
    yield _distinct(*_sequences(_unpacked(batch, "words"), k, scope.view(np.uint64)))[0]


def _selected(rarity: np.ndarray):
    """The seeds of each class: fingerprints of its windows (kind 1) and of the supplement (2), or both (3)."""
    common = COMMON * (1 + int(rarity.mean()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, k, t, scope, train, held = _numbers(batch, "key", "k", "t", "scope", "train_rows", "eval_rows")
            seq, place = _sequences(_unpacked(batch, "words"), k, scope.view(np.uint64))
            items, owner, at = _distinct(seq, place)
            if not len(items):
                continue
            often = rarity[bucket_of(items)]
            order = np.lexsort((items, often, owner))
            rank = np.empty(len(items), np.int64)
            rank[order] = np.arange(len(items))
            n = np.bincount(owner, minlength=batch.num_rows)
            share = np.ceil(t * n - 1e-9).astype(np.int64)
            least = n - share + np.minimum(SHARED, share)
            kind = np.where(rank - (np.cumsum(n) - n)[owner] < least[owner], 2, 0).astype(np.int8)
            prints = order[window_minima(rank[at], place)]
            prints = prints[often[prints] <= common]
            kind[prints] |= 1
            count = np.bincount(owner[prints], minlength=batch.num_rows)
            good = np.flatnonzero((kind > 0) & (often > 1))  # what occurs once joins nothing
            if len(good):
                o = owner[good]
                cols = (key[o], n[o].astype(np.int32), t[o], count[o].astype(np.int32), train[o] > 0, held[o] > 0, items[good].view(np.int64), kind[good])
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["key", "n", "t", "prints", "has_train", "has_eval", "seed", "kind"])

    return run


def window_minima(ranks: np.ndarray, owner: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """The distinct minima of all windows of consecutive ranks of one owner; an owner with fewer ranks is one window."""
    if not len(ranks):
        return ranks
    starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
    size = np.diff(np.append(starts, len(ranks)))
    room = np.maximum(size, window)  # a short owner is filled up with ranks above all others
    first = np.cumsum(room) - room
    padded = np.full(int(room.sum()), np.iinfo(np.int64).max)
    padded[np.arange(len(ranks)) + np.repeat(first - starts, size)] = ranks
    low, width = padded, 1
    while width < window:
        step = min(width, window - width)
        low, width = np.minimum(low[:-step], low[step:]), width + step
    inside = np.repeat(first + room - window, room)[: len(low)] >= np.arange(len(low))
    return np.unique(low[inside])


def winnow(hashes: np.ndarray, window: int = WINDOW, rarity: np.ndarray | None = None) -> np.ndarray:
    """Positions of the minima of every window of consecutive hashes (rightmost of equal ones), rare ones first if
    counts are given."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    if rarity is not None:
        distinct, at = np.unique(hashes, return_inverse=True)
        rank = np.empty(len(distinct), np.int64)
        rank[np.lexsort((distinct, rarity[bucket_of(distinct)]))] = np.arange(len(distinct))
        hashes = rank[at]
    if len(hashes) <= window:
        return np.array([len(hashes) - 1 - int(hashes[::-1].argmin())])
    views = np.lib.stride_tricks.sliding_window_view(hashes[::-1], window)
    at = np.arange(len(views)) + views.argmin(1)
    return np.unique(len(hashes) - 1 - at)


def chain(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest collinear chain of (position, position) anchors, by patience sorting."""
    import bisect

    tails, where, before = [], [], []
    ordered = sorted(set(pairs), key=lambda x: (x[0], -x[1]))
    for i, (_, y) in enumerate(ordered):
        at = bisect.bisect_left(tails, y)
        before.append(where[at - 1] if at else -1)
        if at == len(tails):
            tails.append(y)
            where.append(i)
        else:
            tails[at], where[at] = y, i
    out, i = [], where[-1] if where else -1
    while i >= 0:
        out.append(ordered[i])
        i = before[i]
    return out[::-1]


def coverage(a: np.ndarray, b: np.ndarray, k: int, scope: int = 0, rarity: np.ndarray | None = None) -> tuple[float, float]:
    """Shares of the words of both covered by the chained fingerprints and their extension over equal words."""
    ha, hb = _items(a, k, scope), _items(b, k, scope)
    at_b: dict[int, list[int]] = {}
    for j in winnow(hb, WINDOW, rarity):
        at_b.setdefault(int(hb[j]), []).append(int(j))
    anchors = [(int(i), j) for i in winnow(ha, WINDOW, rarity) for j in at_b.get(int(ha[i]), ())]
    in_a, in_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
    for i, j in chain(anchors):
        if in_a[i] and in_b[j]:
            continue
        lo = 0
        while lo < min(i, j) and a[i - lo - 1] == b[j - lo - 1]:
            lo += 1
        n = min(len(a) - i, len(b) - j)
        differs = a[i : i + n] != b[j : j + n]
        hi = int(differs.argmax()) if differs.any() else n
        in_a[i - lo : i + hi] = True
        in_b[j - lo : j + hi] = True
    return float(in_a.mean()), float(in_b.mean())


def _overlaps(batch: pa.RecordBatch) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """Words of both sides of each pair of the batch, and the exact overlap of their item sets."""
    k, scope = _numbers(batch, "k", "scope")
    sides, sets, sizes = [], [], np.zeros(batch.num_rows, np.int64)
    for name in ("left", "right"):
        words = _unpacked(batch, name)
        items, owner, _ = _distinct(*_sequences(words, k, scope.view(np.uint64)))
        sizes += np.bincount(owner, minlength=batch.num_rows)
        sides.append(words)
        sets.append((items, owner))
    v, o = (np.concatenate(x) for x in zip(*sets))
    order = np.lexsort((v, o))
    v, o = v[order], o[order]
    both = np.bincount(o[1:][(v[1:] == v[:-1]) & (o[1:] == o[:-1])], minlength=batch.num_rows)
    return *sides, both / np.maximum(sizes - both, 1)


def _linked(rarity: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            left, right, overlap = _overlaps(batch)
            a, b, k, t, scope, prints = _numbers(batch, "a", "b", "k", "t", "scope", "shared_prints")
            good = np.flatnonzero(overlap >= t - 1e-9)
            rows = [(int(a[i]), int(b[i]), float(overlap[i]), *coverage(left[i], right[i], int(k[i]), int(scope[i]) % 2**64, rarity), int(prints[i])) for i in good]
            cols = list(zip(*rows)) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _LINK)], schema=_LINK)

    return run


_LINK = pa.schema([("c1", pa.int64()), ("c2", pa.int64()), ("overlap", pa.float64()), ("train_cover", pa.float64()), ("eval_cover", pa.float64()), ("shared_prints", pa.int64())])
LINK = "c1 bigint, c2 bigint, overlap double, train_cover double, eval_cover double, shared_prints bigint"


def split_records(df: DataFrame, key: str, scope: Column, text: str, split: str, k: int, threshold: float) -> DataFrame:
    """Records of one table in the common form; several such tables may be joined by union before `overlap_classes`
    if their keys differ and no scope of one is a scope of another."""
    base = df.select(F.col(key).cast("bigint").alias("key"), scope.cast("string").alias("scope"), F.col(text).alias("text"), split_side(F.col(split)).alias("side"))
    return base.where("key is not null and side is not null and text is not null").withColumns({"k": F.lit(k), "t": F.lit(float(threshold))})


def overlap_classes(records: DataFrame, block: int = BLOCK) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(classes, members, links) of the records of `split_records`. classes: cls, train_rows, eval_rows. members: key,
    side, cls. links: c1 (has training rows), c2 (has evaluation rows), overlap, train_cover, eval_cover, shared_prints
    (fingerprints in common); a class with rows of both sides is linked with itself."""
    rows = materialize(records.select("key", "scope", "text", "side", "k", "t").mapInArrow(_classify, RECORD), "records")
    same = ["h1", "h2"]
    held = F.sum("side").alias("eval_rows")
    groups = materialize(rows.groupBy(*same).agg(F.min("key").alias("cls"), F.count(F.lit(1)).alias("rows"), held).where("rows > 1"), "groups")
    total = rows.count()
    copies = materialize(join_hot_cold(rows.select("key", "side", *same), groups.select(*same, "cls", "rows"), same, "rows", total).select("key", "side", "cls"), "copies")
    alone = rows.select("key", "side").join(copies.select("key"), "key", "left_anti").withColumn("cls", F.col("key"))
    members = copies.unionByName(alone)
    led = groups.select(F.col("cls").alias("key"), (F.col("rows") - F.col("eval_rows")).alias("train_rows"), "eval_rows")
    followers = copies.where("key <> cls").select("key")
    first = rows.join(followers, "key", "left_anti").join(led, "key", "left")
    counted = {"train_rows": F.coalesce("train_rows", (1 - F.col("side")).cast("bigint")), "eval_rows": F.coalesce("eval_rows", F.col("side").cast("bigint"))}
    reps = materialize(first.withColumns(counted).drop("h1", "h2", "side"), "reps")
    rarity = rarity_table(reps.select("k", "scope", "words"), _all_items)
    seeds = materialize(reps.mapInArrow(_selected(rarity), "key bigint, n int, t double, prints int, has_train boolean, has_eval boolean, seed bigint, kind tinyint"), "seeds")
    train = seeds.where("has_train").select("seed", F.col("key").alias("c1"), F.col("n").alias("n1"), F.col("prints").alias("w1"), F.col("kind").alias("k1"), "t")
    held = seeds.where("has_eval").select("seed", F.col("key").alias("c2"), F.col("n").alias("n2"), F.col("prints").alias("w2"), F.col("kind").alias("k2"))
    least = F.least("n1", "n2")
    near = least >= F.col("t") * F.greatest("n1", "n2") - F.lit(1e-9)
    both = F.col("k1").bitwiseAND(F.col("k2"))
    must = F.least(F.lit(SHARED), F.ceil(F.col("t") * least - F.lit(1e-9)))
    enough = F.greatest(F.lit(1), F.ceil(F.col("t") / 2 * F.least("w1", "w2")))
    sizes = [F.ceil(F.sum(F.col(c).cast("int")) / F.lit(block)).cast("int").alias(b) for c, b in (("has_train", "_bl"), ("has_eval", "_br"))]
    big = seeds.groupBy("seed").agg(*sizes).where("greatest(_bl, _br) > 1 and least(_bl, _br) > 0")
    met = split_join(train, held, ["seed"], block, big=big).where((F.col("c1") != F.col("c2")) & near).groupBy("c1", "c2").agg(
        F.sum(F.shiftright(both, 1).cast("bigint")).alias("shared"), F.sum(both.bitwiseAND(F.lit(1)).cast("bigint")).alias("shared_prints"), F.first(must).alias("must"), F.first(enough).alias("enough")
    )
    pairs = materialize(met.where("shared >= must or shared_prints >= enough").select(F.col("c1").alias("a"), F.col("c2").alias("b"), "shared_prints"), "pairs")
    payload = reps.select("key", F.struct("words", "k", "t", "scope").alias("items"))
    attached = attach_both(pairs, payload, block).select("a", "b", "shared_prints", F.col("left.words").alias("left"), F.col("right.words").alias("right"), "left.k", "left.t", "left.scope")
    links = materialize(attached.mapInArrow(_linked(rarity), LINK), "links")
    one = F.lit(1.0)
    within = reps.where("train_rows > 0 and eval_rows > 0").select(F.col("key").alias("c1"), F.col("key").alias("c2"), one.alias("overlap"), one.alias("train_cover"), one.alias("eval_cover"), F.lit(1).cast("bigint").alias("shared_prints"))
    return reps.select(F.col("key").alias("cls"), "train_rows", "eval_rows"), materialize(members, "members"), links.unionByName(within)


def overlapping_rows(members: DataFrame, links: DataFrame, block: int = BLOCK) -> DataFrame:
    """(train_key, eval_key, overlap, train_cover, eval_cover) of every pair of rows of linked classes."""
    trains = members.where("side = 0").select(F.col("cls").alias("c1"), F.col("key").alias("train_key"))
    helds = members.where("side = 1").select(F.col("cls").alias("c2"), F.col("key").alias("eval_key"))
    left = materialize(split_join(links.drop("shared_prints"), trains, ["c1"], block).drop("c1"), "left")
    return split_join(left, helds, ["c2"], block).select("train_key", "eval_key", "overlap", "train_cover", "eval_cover")


def cross_split_overlaps(df: DataFrame, key: str, scope: Column, text: str, split: str, k: int, threshold: float, block: int = BLOCK) -> DataFrame:
    """(train_key, eval_key, overlap, train_cover, eval_cover) of every pair of a training and an evaluation
    row of one scope whose sets of k-word sequences overlap by at least the threshold."""
    _, members, links = overlap_classes(split_records(df, key, scope, text, split, k, threshold), block)
    return overlapping_rows(members, links, block)
