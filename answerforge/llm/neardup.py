"""Problem 5: groups of texts that are small edits of one another, by a chosen-path join.

Every text becomes its set of k-word sequences. Equal sets collapse to one representative (their
copies follow it at the end). A set is embedded as POSITIONS min-hash values; in each of several
runs it walks down a tree: at a node, whose identity fixes two sampled positions, it goes to the
children named by its values there, so two sets meet in a child with a chance equal to their overlap
(branching 1/0.5 = 2 keeps similar pairs together at every depth). All sets start at depth DEPTH;
then per bucket:

* up to SMALL sets: all pairs in it (brute force);
* more: every member is paired with the bucket's least member, and all its members go one level
  deeper, until MAX_DEPTH. Sets still together there agree in many sampled values: most are linked with
  their pivots. Once those links are verified, all pairs of such a bucket whose two sets are not in one
  group yet are compared too, in blocks of about SMALL by SMALL sets; the others can't change a group.

A bucket that is large among one batch's sets is large among all: its sets are paired with the batch's
least before the shuffle and only that one goes to the bucket, marked crowded, so a hot bucket is
combined map-side. The others pass the shuffle spread over the partitions and go down one level
together with the bucket's sets of all other batches. After the shuffle a partition's buckets are
walked as a sorted stream of (path, key) rows, none held whole.

Runs are repeated until the expected recall of a pair at the threshold reaches the target at DEPTH; the
sets of crowded buckets walk further runs, as many as the deepest level needs, half of the allowed
misses for either part. Candidates are verified on the exact sets; links give connected components.

Defined results: NULL, empty and short texts (under min_words) are in no group; a repeated key with
equal text is one member; no row is dropped or capped, whatever the skew.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from answerforge.llm.pairs import attach_both
from answerforge.llm.words import batch_hashes, chunks, mix, shingle_sets
from answerforge.operators.components import connected_components
from answerforge.session import join_counted, materialize

POSITIONS, DEPTH, MAX_DEPTH, SMALL, BRANCH = 64, 2, 6, 128, 2
#: Of CHECKS sampled values, kept in a byte each, a pair must agree in AGREE to become a candidate.
CHECKS, AGREE = 8, 2
FILTER_BITS, FILTER_PART = 23, 1024
PATHS = "path bigint, a bigint, x bigint, kind tinyint"
MEMBER, CROWDED, PAIR, GOING = 0, 1, 2, 3
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def runs_for(recall: float, threshold: float, depth: int = DEPTH) -> int:
    """Runs after which a pair of overlap `threshold` has met at `depth` with probability `recall`."""
    p = 1.0
    for _ in range(depth):
        p = 1 - (1 - threshold * p) ** BRANCH
    p *= sum(math.comb(CHECKS, i) * threshold**i * (1 - threshold) ** (CHECKS - i) for i in range(AGREE, CHECKS + 1))
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - p)))


def _sketcher(k: int, min_words: int):
    rng = np.random.default_rng(20240501)
    mul = rng.integers(1, 2**63, POSITIONS, dtype=np.uint64) | np.uint64(1)
    add = rng.integers(0, 2**63, POSITIONS, dtype=np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, texts in chunks(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                hashes, counts = batch_hashes(texts)
                values, owner = shingle_sets(hashes, counts, k)
                good = np.flatnonzero(counts >= max(min_words, k))
                if not len(good):
                    continue
                inside = (counts >= max(min_words, k))[owner]
                values, owner = values[inside], owner[inside]
                starts = np.searchsorted(owner, good)
                sig = np.empty((len(good), POSITIONS), np.uint16)  # 16 bits tell values apart but for one in 65536
                with np.errstate(over="ignore"):
                    for j in range(POSITIONS):
                        sig[:, j] = np.minimum.reduceat(((values * mul[j] + add[j]) >> np.uint64(32)).astype(np.uint32), starts).astype(np.uint16)
                    h1 = np.add.reduceat(mix(values), starts).view(np.int64)
                    h2 = np.add.reduceat(mix(values ^ _GOLD), starts).view(np.int64)
                raw = sig.tobytes()
                width = POSITIONS * 2
                yield pa.RecordBatch.from_arrays(
                    [pa.array([keys[g] for g in good], pa.int64()), pa.array(h1), pa.array(h2), pa.array([raw[i * width : (i + 1) * width] for i in range(len(good))], pa.binary())],
                    names=["key", "h1", "h2", "sig"],
                )

    return run


def _descend(paths: np.ndarray, sig: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Children of (path, row) pairs: BRANCH positions sampled by the node's identity."""
    out_p, out_r = [], []
    with np.errstate(over="ignore"):
        for b in range(BRANCH):
            seed = mix(paths * _GOLD + np.uint64(b + 1))
            pos = (seed % np.uint64(POSITIONS)).astype(np.int64)
            out_p.append(mix(seed ^ (sig[rows, pos].astype(np.uint64) * _GOLD)))
            out_r.append(rows)
    return np.concatenate(out_p), np.concatenate(out_r)


def _signatures(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, POSITIONS)


def _rows(path: np.ndarray, a: np.ndarray, x: np.ndarray, kind: np.ndarray | int) -> pa.RecordBatch:
    """Rows of PATHS: a set `a` in the bucket `path` with its check bytes x, or a candidate pair (a, x)."""
    kind = np.full(len(path), kind, np.int8) if isinstance(kind, int) else kind.astype(np.int8)
    return pa.RecordBatch.from_arrays([pa.array(path.view(np.int64)), pa.array(a), pa.array(x.view(np.int64)), pa.array(kind)], names=["path", "a", "x", "kind"])


def _check_bytes(paths: np.ndarray, sig: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """CHECKS values of each row's signature, at positions the bucket fixes, a byte each."""
    block = (paths >> np.uint64(58)).astype(np.int64) % (POSITIONS // CHECKS) * CHECKS
    out = np.zeros(len(paths), np.uint64)
    for i in range(CHECKS):
        out = (out << np.uint64(8)) | (sig[rows, block + i] & np.uint16(255)).astype(np.uint64)
    return out


def _pair_rows(a: np.ndarray, b: np.ndarray, left: np.ndarray, right: np.ndarray) -> pa.RecordBatch:
    """Pairs whose check bytes agree enough, least first, under a path of their own, so that equal pairs meet."""
    same = ((left ^ right).view(np.uint8).reshape(-1, 8) == 0).sum(1) >= AGREE
    lo, hi = np.minimum(a, b), np.maximum(a, b)
    good = same & (lo < hi)
    lo, hi = lo[good], hi[good]
    with np.errstate(over="ignore"):
        return _rows(mix(mix(lo.view(np.uint64)) * _GOLD + hi.view(np.uint64)), lo, hi, PAIR)


def _spread(paths: np.ndarray, keys: np.ndarray, sig: np.ndarray, rows: np.ndarray, small: int) -> Iterator[pa.RecordBatch]:
    """Path rows of one batch's sets. Of a bucket with more than `small` of them the least set alone goes to the
    bucket, marked crowded; the others are paired with it and are GOING down whatever the bucket holds."""
    order = np.lexsort((keys[rows], paths))
    paths, rows = paths[order], rows[order]
    check = _check_bytes(paths, sig, rows)
    first = np.flatnonzero(np.append(True, paths[1:] != paths[:-1]))
    size = np.diff(np.append(first, len(paths)))
    full = np.repeat(size > small, size)
    head = np.zeros(len(paths), bool)
    head[first] = True
    rest = full & ~head
    yield _rows(paths[~rest], keys[rows[~rest]], check[~rest], full[~rest])
    if rest.any():
        lead = np.repeat(first, size)
        yield _pair_rows(keys[rows[lead[rest]]], keys[rows[rest]], check[lead[rest]], check[rest])
        yield _rows(paths[rest], keys[rows[rest]], check[rest], GOING)


def _start_paths(runs: range, depth: int, small: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, sig = batch.column(0).to_numpy(), _signatures(batch.column(1))
            for r in runs:
                rows = np.arange(len(keys))
                paths = np.full(len(keys), mix(np.array([r + 1], np.uint64))[0], np.uint64)
                for _ in range(depth):
                    paths, rows = _descend(paths, sig, rows)
                yield from _spread(paths, keys, sig, rows, small)

    return run


def _next_paths(small: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keys, paths, sig = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64), _signatures(batch.column(2))
                paths, rows = _descend(paths, sig, np.arange(len(keys)))
                yield from _spread(paths, keys, sig, rows, small)

    return run


def _then_end(batches: Iterator) -> Iterator:
    yield from batches
    yield None


def _walker(small: int):
    return lambda batches: _walk(batches, small)


def _walk(batches: Iterator[pa.RecordBatch], small: int) -> Iterator[pa.RecordBatch]:
    """Buckets of one partition, in path order, as a stream; no bucket is held whole. GOING rows come last.

    Output rows: pairs, and members of buckets that must descend (CROWDED).
    """
    last = (None, None)  # (path, key) of the GOING row before
    cols = [np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int8)]
    lead: tuple | None = None  # (path, least key, its check bytes) of a large bucket of which more may follow
    for batch in _then_end(batches):
        if batch is not None:
            new = [batch.column(i).to_numpy() for i in range(4)]
            going = new[3] == GOING
            if going.any():
                path, a, x = (c[going] for c in new[:3])
                once = np.append((path[0], a[0]) != last, (path[1:] != path[:-1]) | (a[1:] != a[:-1]))
                last = (path[-1], a[-1])
                yield _rows(path[once], a[once], x[once], CROWDED)
                new = [c[~going] for c in new]
            cols = [np.append(c, n.view(c.dtype)) for c, n in zip(cols, new)]
        path = cols[0]
        if not len(path):
            continue
        # The last bucket may go on in the next batch.
        cut = len(path) if batch is None else int(np.flatnonzero(np.append(True, path[1:] != path[:-1]))[-1])
        if cut:
            yield from _settle(*(c[:cut] for c in cols), lead, small)
            if lead is not None and (cut == len(path) or path[cut] != lead[0]):
                lead = None
            cols = [c[cut:] for c in cols]
        if batch is not None and len(cols[0]) > small and cols[3][0] != PAIR:
            lead = lead or (cols[0][0], cols[1][0], cols[2][0])
            yield from _settle(*cols, lead, small)
            cols = [c[:0] for c in cols]


def _settle(path: np.ndarray, a: np.ndarray, x: np.ndarray, kind: np.ndarray, lead: tuple | None, small: int) -> Iterator[pa.RecordBatch]:
    """Whole buckets, but for one that lead names: it began before or goes on."""
    first = np.flatnonzero(np.append(True, path[1:] != path[:-1]))
    crowded = np.repeat(np.logical_or.reduceat(kind == CROWDED, first), np.diff(np.append(first, len(path))))
    once = np.append(True, (path[1:] != path[:-1]) | (a[1:] != a[:-1]))
    path, a, x, kind, crowded = path[once], a[once], x[once], kind[once], crowded[once]
    first = np.flatnonzero(np.append(True, path[1:] != path[:-1]))
    size = np.diff(np.append(first, len(path)))
    going = np.zeros(len(first), bool) if lead is None else path[first] == lead[0]
    is_pair = kind[first] == PAIR
    if is_pair.any():
        at = first[is_pair]
        yield _rows(path[at], a[at], x[at], PAIR)
    many = ~is_pair & ((size > 1) | going)
    large = many & ((size > small) | crowded[first] | going)
    if large.any():
        inside, key, check = np.repeat(large, size), np.repeat(a[first], size), np.repeat(x[first], size)
        for i in np.flatnonzero(going):
            key[first[i] : first[i] + size[i]], check[first[i] : first[i] + size[i]] = lead[1], lead[2]
        yield _pair_rows(key[inside], a[inside], check[inside], x[inside])
        yield _rows(path[inside], a[inside], x[inside], CROWDED)
    few = np.repeat(many & ~large, size)
    path, a, x = path[few], a[few], x[few]
    for step in range(1, small):
        left = np.flatnonzero(path[:-step] == path[step:])
        if not len(left):
            break
        yield _pair_rows(a[left], a[left + step], x[left], x[left + step])


def _key_cells(keys: np.ndarray) -> np.ndarray:
    return (mix(keys.view(np.uint64)) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def _set_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bits = np.zeros(1 << FILTER_BITS, bool)
    for batch in batches:
        bits[_key_cells(batch.column(0).to_numpy())] = True
    packed = np.packbits(bits).reshape(-1, FILTER_PART)
    yield _parts({int(i): packed[i] for i in np.flatnonzero(packed.any(1))})


def _merge_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        for i, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            part = np.frombuffer(part, np.uint8)
            held[i] = held[i] | part if i in held else part
    yield _parts(held)


def _parts(held: dict[int, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([x.tobytes() for x in held.values()], pa.binary())], names=["part", "bits"])


def key_filter(keys: DataFrame) -> np.ndarray:
    """A bit table of 2^FILTER_BITS cells (1 MB packed) telling which keys may be among `keys`. Its size is
    fixed: with very many keys it lets more pass, never fewer. The tasks set and merge the bits; the driver
    gets each part of FILTER_PART bytes once, so 1 MB at most."""
    kind = "part int, bits binary"
    merged = keys.mapInArrow(_set_cells, kind).repartition("part").mapInArrow(_merge_parts, kind)
    packed = np.zeros((1 << FILTER_BITS) // 8, np.uint8)
    for part, bits in merged.collect():
        packed[part * FILTER_PART : (part + 1) * FILTER_PART] = np.frombuffer(bits, np.uint8)
    return packed


def _passing(packed: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(packed).astype(bool)
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array(bits[_key_cells(batch.column(0).to_numpy())]))

    return run


def may_match(df: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows of df (key first) whose key may be among `keys`: no shuffle of df."""
    return df.mapInArrow(_passing(key_filter(keys)), df.schema)


def _levels(sig: DataFrame, runs: range, small: int = SMALL) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """(pairs, crowded, rest) of some runs: pairs (a, b) that met, signatures of the sets that were in a crowded
    bucket, and rows (key, path, x) of the buckets still crowded at MAX_DEPTH. One shuffle of small rows a level."""
    paths = sig.mapInArrow(_start_paths(runs, DEPTH, small), PATHS)
    found, depth, crowded, rest = [], DEPTH, None, None
    while True:
        going = F.col("kind") == GOING
        placed = paths.repartition(F.when(going, F.xxhash64("path", "a")).otherwise(F.col("path")))
        met = materialize(placed.sortWithinPartitions(going, "path", "a").mapInArrow(_walker(small), PATHS), "met")
        found.append(met.where(F.col("kind") == PAIR).select("a", F.col("x").alias("b")))
        deeper = met.where(F.col("kind") == CROWDED).select(F.col("a").alias("key"), "path", "x")
        if deeper.isEmpty():
            break
        if depth >= MAX_DEPTH:
            rest = deeper
            break
        if crowded is None:  # every later level is among these sets
            sig = crowded = materialize(may_match(sig, deeper.select("key")), "signatures")
        depth += 1
        paths = deeper.join(sig, "key").select("key", "path", "sig").mapInArrow(_next_paths(small), PATHS)
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.unionByName(more)
    return pairs, crowded, rest


def candidate_pairs(sketches: DataFrame, runs: int, deep_runs: int = 0, small: int = SMALL) -> tuple[DataFrame, DataFrame | None]:
    """Distinct (a, b), a < b, of representatives that meet in some bucket, and the rows (key, path, x) of buckets
    that did not split. Sets that were in a crowded bucket walk deep_runs in all."""
    pairs, crowded, rest = _levels(sketches.select("key", "sig"), range(runs), small)
    if crowded is not None and deep_runs > runs:
        more, _, last = _levels(crowded, range(runs, deep_runs), small)
        pairs = pairs.unionByName(more)
        rest = last if rest is None else rest if last is None else rest.unionByName(last)
    return pairs.distinct(), rest


def unsplit_pairs(rest: DataFrame, roots: DataFrame, small: int = SMALL) -> DataFrame:
    """Distinct (a, b), a < b, of the buckets that did not split: all pairs with enough equal check bytes that are
    in different groups so far. At least one set of such a pair is outside the bucket's main group; those sets are
    the left side. Either side is dealt into blocks of about `small` sets, and each cell (i, j) is joined for itself."""
    named = rest.join(roots.select(F.col("node").alias("key"), "root"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    sizes = named.groupBy("path", "root").agg(F.count("*").alias("n"))
    main = sizes.groupBy("path").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.max("n").alias("most"), F.sum("n").alias("m")).where("most < m")
    blocks = lambda n: F.ceil(n / F.lit(small)).cast("int")
    mixed = materialize(named.join(main.select("path", "main", blocks(F.col("m")).alias("mi"), blocks(F.col("m") - F.col("most")).alias("mj")), "path"), "mixed")
    own = lambda n: F.pmod(F.xxhash64("key"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    right = mixed.select("path", own("mi").alias("i"), every("mj").alias("j"), F.col("key").alias("rk"), F.col("root").alias("rr"), F.col("x").alias("rx"))
    left = mixed.where("root <> main").select("path", every("mi").alias("i"), own("mj").alias("j"), F.col("key").alias("lk"), F.col("root").alias("lr"), F.col("x").alias("lx"))
    differ = F.col("lx").bitwiseXOR(F.col("rx"))
    same = sum((F.when(F.shiftright(differ, 8 * i).bitwiseAND(F.lit(255)) == 0, 1).otherwise(0) for i in range(CHECKS)), F.lit(0))
    met = left.join(right, ["path", "i", "j"]).where((F.col("lr") != F.col("rr")) & (same >= AGREE))
    return met.select(F.least("lk", "rk").alias("a"), F.greatest("lk", "rk").alias("b")).distinct()


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, texts in chunks(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                values, owner = shingle_sets(*batch_hashes(texts), k)
                bounds = np.searchsorted(owner, np.arange(len(texts) + 1))
                short = (values >> np.uint64(32)).astype("<u4")  # order kept; two sequences in 4e9 share a value
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, pa.int64()), pa.array([short[bounds[i] : bounds[i + 1]].tobytes() for i in range(len(texts))], pa.binary())],
                    names=["key", "items"],
                )

    return run


def unpack(items: bytes) -> np.ndarray:
    return np.unique(np.frombuffer(items, "<u4"))


def _verify(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, left, right = (batch.column(i).to_pylist() for i in range(4))
            keep, overlap = [], []
            last, x = None, None
            for i in range(len(a)):
                if a[i] != last:
                    last, x = a[i], unpack(left[i])
                y = unpack(right[i])
                both = len(np.intersect1d(x, y, assume_unique=True))
                union = len(x) + len(y) - both
                if union and both >= threshold * union:
                    keep.append(i)
                    overlap.append(both / union)
            yield pa.RecordBatch.from_arrays([pa.array([a[i] for i in keep], pa.int64()), pa.array([b[i] for i in keep], pa.int64()), pa.array(overlap, pa.float64())], names=["a", "b", "overlap"])

    return run


def verified_links(texts: DataFrame, pairs: DataFrame, k: int, threshold: float) -> DataFrame:
    """(a, b, overlap) of the pairs whose exact sets overlap enough. A pivot with very many pairs is salted."""
    need = pairs.select(F.col("a").alias("key")).unionByName(pairs.select(F.col("b").alias("key")))
    sets = may_match(texts.select("key", "text"), need).mapInArrow(_sets(k), "key bigint, items binary")
    return attach_both(pairs, sets).mapInArrow(_verify(threshold), "a bigint, b bigint, overlap double")


def near_duplicate_groups(texts: DataFrame, key: str, text: str, k: int = 5, threshold: float = 0.8, min_words: int = 20, recall: float = 0.995, small: int = SMALL) -> DataFrame:
    """(key_a, key_b): key_b every member of a group but the least, key_a the least key of its group."""
    base = texts.select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text")).where("key is not null and text is not null")
    sketches = materialize(base.mapInArrow(_sketcher(k, min_words), "key bigint, h1 bigint, h2 bigint, sig binary"), "sketches")
    total = sketches.count()
    # Equal sets: the least key stands for all.
    copies = materialize(sketches.groupBy("h1", "h2").agg(F.min("key").alias("rep"), F.count("*").alias("n")).where("n > 1"), "copies")
    followers = materialize(join_counted(sketches.select("key", "h1", "h2"), copies, ["h1", "h2"], "n", total).where("key <> rep").select("key", "rep", "n"), "followers")
    reps = sketches.join(followers, "key", "left_anti")
    part = 1 - (1 - recall) / 2
    pairs, rest = candidate_pairs(reps, runs_for(part, threshold), runs_for(part, threshold, MAX_DEPTH), small)
    links = materialize(verified_links(base, materialize(pairs, "pairs"), k, threshold), "links")
    roots = materialize(connected_components(links, "a", "b"), "roots")
    if rest is not None:
        more = materialize(unsplit_pairs(rest, roots, small), "unsplit")
        if not more.isEmpty():
            links = links.unionByName(verified_links(base, more, k, threshold))
            roots = materialize(connected_components(links, "a", "b"), "roots")
    # Copies take the root of their representative; counts of followers tell hot representatives.
    led = followers.groupBy("rep").agg(F.count("*").alias("n")).join(roots.select(F.col("node").alias("rep"), "root"), "rep", "left")
    led = materialize(led.withColumn("root", F.coalesce("root", "rep")), "led")
    tail = join_counted(followers.select("key", "rep"), led, ["rep"], "n", total)
    return roots.select(F.col("root").alias("key_a"), F.col("node").alias("key_b")).unionByName(tail.select(F.col("root").alias("key_a"), F.col("key").alias("key_b"))).distinct()
