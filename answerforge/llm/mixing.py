"""Problem 7: sources mixed to target shares of the total size, small ones repeated a capped number of times.

1. Sizes: tokens of a public tokenizer per document, summed per source.
2. Budgets: the largest total at which every source that has documents can give its share (shares are
   taken over those sources) within max_repeats uses of each document; or a given total, where sources
   at their cap give what they can and the rest is shared among the others in proportion.
3. Every document has a place in its source's permutation, a seeded hash of PLACE_BITS bits, and equal ranges of places
   are its source's blocks, so neither needs a sort. A budget is r whole passes over a source and a part of one more.
   The place where the part ends is found by a radix search: sums over 2^LEVEL_BITS ranges of places, then over as many
   parts of the range that it lies in, then over the few documents left. The document that crosses the end belongs to
   the part only if that leaves the sum nearer to the budget; rows that are equal in id and size go together.
4. Splitting tree: the block uses of each source are split between the two halves of the output shards by a
   multivariate hypergeometric draw, and so on down to single shards, so every shard gets an exact quota of block uses
   per source without any global shuffle. The driver draws the upper nodes (at most NODES), the tasks those below; the
   quotas are a table (source, shard, from, to).
5. A source's block uses are permuted (use -> a * use + c modulo their number, a prime to it); a shard takes the next
   ones of the permutation: disjoint by construction. Documents meet their shard by an equi-join on (source, bin of the
   permuted place), a bin as wide as a mean quota, so the bins of a large source are as many as the shards.
6. Documents are shuffled within the shard by hash.

The number of blocks grows with the data and has no bound: a block has at most `block_tokens`, and less where that would leave
a source fewer than BLOCKS_A_SHARD block uses a shard.

Defined results: NULL and empty texts have no tokens and are left out; sources are matched by their
canonical name; documents whose source is NULL or has no target are left out and reported with share 0;
a source without documents gets nothing and is reported; nothing else is dropped.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from answerforge.session import materialize

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
BLOCK_TOKENS, BLOCKS_A_SHARD = 4096, 32
PLACE_BITS, LEVEL_BITS, NODES = 40, 12, 256
#: A shard holds about so many tokens unless the number of shards is given.
SHARD_TOKENS = 50_000_000


def canonical_source(source: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(source)), r"[^\p{L}\p{N}]+", "_")


def _pattern(pattern: str | None) -> str:
    """The regular expression that cuts text before the tokenizer merges; by default the one of the public tokenizers' package."""
    if pattern is not None:
        return pattern
    try:
        from public_tokenizers import PATTERN
    except ImportError as e:
        raise ValueError("pass `pattern`, the tokenizer's splitting pattern: no package gives a default") from e
    return PATTERN


def _counter(path: str, pattern: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        try:
            with open(path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        except OSError as e:
            raise ValueError(f"the tokenizer's vocabulary {path} must be readable on every executor") from e
        own = tiktoken.Encoding("own", pat_str=_pattern(pattern), mergeable_ranks=ranks, special_tokens={})
        for batch in batches:
            sizes = [len(own.encode_ordinary(t)) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64())], names=["doc_id", "source", "tokens"])

    return run


def budgets(sizes: dict[str, int], shares: dict[str, float], caps: dict[str, int], total: float | None = None) -> dict[str, float]:
    """Tokens that each source is to give."""
    live = {s: shares[s] for s in shares if sizes.get(s, 0) > 0 and shares[s] > 0 and caps.get(s, 0) > 0}
    if not live:
        return {}
    whole = sum(live.values())
    room = {s: float(caps[s] * sizes[s]) for s in live}
    if total is None:
        total = min(room[s] * whole / live[s] for s in live)
        return {s: total * live[s] / whole for s in live}
    out, open_, left = {}, dict(live), float(total)
    while open_:
        scale = left / sum(open_.values())
        full = [s for s in open_ if open_[s] * scale >= room[s]]
        if not full:
            return out | {s: open_[s] * scale for s in open_}
        for s in full:
            out[s] = room[s]
            left -= room[s]
            del open_[s]
    return out


def _draw(rng: np.random.Generator, counts: np.ndarray, take: int) -> np.ndarray:
    """`take` of `counts` without replacement. Counts beyond what the generator can hold are drawn in units of several."""
    unit = max(1, -(-int(counts.sum()) // 500_000_000))
    whole = counts // unit
    left = unit * rng.multivariate_hypergeometric(whole, min(take // unit, int(whole.sum())), method="marginals")
    rest = take - int(left.sum())
    if rest:
        left = left + rng.multivariate_hypergeometric(np.minimum(counts - left, 10_000_000), rest, method="marginals")
    return left


def _halves(counts: np.ndarray, first: int, shards: int, seed: int) -> tuple[tuple, tuple]:
    """The two children (counts, first shard, shards) of a node. A node's draw depends on the seed and its shards only."""
    n = shards // 2
    left = _draw(np.random.default_rng([seed, first, shards]), counts, int(counts.sum()) * n // shards)
    return (left, first, n), (counts - left, first + n, shards - n)


def upper_nodes(uses: dict[str, int], shards: int, seed: int, most: int = NODES) -> list[tuple]:
    """Nodes of the splitting tree, at most `most`, that hold all shards in order."""
    nodes = [(np.array([uses[s] for s in sorted(uses)], np.int64), 0, shards)]
    while 2 * len(nodes) <= most and any(n > 1 for *_, n in nodes):
        nodes = [child for node in nodes for child in (_halves(*node, seed) if node[2] > 1 else (node,))]
    return nodes


def leaf_quotas(counts: np.ndarray, first: int, shards: int, seed: int) -> np.ndarray:
    """(shards x sources) quotas below a node."""
    out, open_ = np.zeros((shards, len(counts)), np.int64), [(counts, first, shards)]
    while open_:
        node = open_.pop()
        if node[2] == 1:
            out[node[1] - first] = node[0]
        else:
            open_ += _halves(*node, seed)
    return out


def split_quotas(uses: dict[str, int], shards: int, seed: int) -> list[dict[str, int]]:
    """Per shard, the number of block uses of each source: halves drawn without replacement, recursively."""
    names = sorted(uses)
    return [dict(zip(names, map(int, row))) for node in upper_nodes(uses, shards, seed) for row in leaf_quotas(*node, seed)]


def quota_table(spark: SparkSession, uses: dict[str, int], shards: int, seed: int) -> DataFrame:
    """(source, shard, lo, hi): the shard takes the permuted block uses lo <= use < hi of the source."""
    names = sorted(uses)
    rows, before = [], np.zeros(len(names), np.int64)
    for counts, first, n in upper_nodes(uses, shards, seed):
        rows.append((first, n, counts.tolist(), before.tolist()))
        before = before + counts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, n, counts, start in zip(*(batch.column(i).to_pylist() for i in range(4))):
                quota = leaf_quotas(np.array(counts, np.int64), first, n, seed)
                hi = np.array(start, np.int64) + np.cumsum(quota, 0)
                for i, name in enumerate(names):
                    yield pa.RecordBatch.from_arrays([pa.array([name] * n), pa.array(np.arange(first, first + n, dtype=np.int32)), pa.array(hi[:, i] - quota[:, i]), pa.array(hi[:, i])], names=["source", "shard", "lo", "hi"])

    nodes = spark.createDataFrame(rows, "first int, n int, counts array<bigint>, before array<bigint>").repartition(max(1, len(rows) // 4))
    return nodes.mapInArrow(run, "source string, shard int, lo bigint, hi bigint").where("hi > lo")


def block_count(available: int, docs: int, budget: float, shards: int, block_tokens: int = BLOCK_TOKENS) -> int:
    """Blocks of a source: none larger than block_tokens, and enough for BLOCKS_A_SHARD uses a shard, but no more than documents."""
    size = max(1.0, min(float(block_tokens), budget / (BLOCKS_A_SHARD * shards)))
    return int(max(1, min(docs, round(available / size))))


def step_of(n: int) -> int:
    """A stride prime to n, near the golden section of it, and small enough for products below 2^62."""
    a = max(1, min(int(n * 0.6180339887), (1 << 62) // max(1, n)))
    while math.gcd(a, n) > 1:
        a -= 1
    return a


def part_ends(sized: DataFrame, parts: dict[str, float]) -> dict[str, tuple[int, int, int]]:
    """Per source the last (place, doc_id, tokens) of the documents, in that order, that fill `parts` tokens; a source
    whose part is too small for any document has none. Three sums over the table, each of bounded size."""
    spark = sized.sparkSession
    spent = {s: (0, 0) for s, p in parts.items() if p > 0}  # source -> (range so far, tokens before it)
    for level in (1, 2):
        if not spent:
            return {}
        shift = PLACE_BITS - level * LEVEL_BITS
        frame = F.broadcast(spark.createDataFrame([(s, r) for s, (r, _) in sorted(spent.items())], "source string, outer bigint"))
        inside = sized.join(frame, "source").where(F.shiftright("place", shift + LEVEL_BITS) == F.col("outer"))
        sums: dict[str, list] = {}
        for r in inside.groupBy("source", F.shiftright("place", shift).alias("cell")).agg(F.sum("tokens").alias("t")).collect():
            sums.setdefault(r["source"], []).append((r["cell"], r["t"]))
        for s, cells in sums.items():
            before = spent[s][1]
            for cell, t in sorted(cells):
                spent[s] = (cell, before)
                if before + t > parts[s]:
                    break
                before += t
    frame = F.broadcast(spark.createDataFrame([(s, r) for s, (r, _) in sorted(spent.items())], "source string, outer bigint"))
    last = sized.join(frame, "source").where(F.shiftright("place", PLACE_BITS - 2 * LEVEL_BITS) == F.col("outer"))
    rows = last.groupBy("source", "place", "doc_id", "tokens").agg(F.sum("tokens").alias("t")).collect()
    at, ends = {s: b for s, (_, b) in spent.items()}, {}
    for r in sorted(rows, key=lambda r: (r["source"], r["place"], r["doc_id"], r["tokens"])):
        s = r["source"]
        if at[s] + r["t"] / 2 <= parts[s]:
            ends[s] = (r["place"], r["doc_id"], r["tokens"])
        at[s] += r["t"]
    for s, (outer, _) in spent.items():  # the part may end with the range before
        ends.setdefault(s, ((outer << (PLACE_BITS - 2 * LEVEL_BITS)) - 1, 2**63 - 1, 2**63 - 1))
    return ends


def token_sizes(docs: DataFrame, key: str, text: str, source: str, tokenizer: str = TOKENIZER, pattern: str | None = None) -> DataFrame:
    base = docs.select(F.col(key).cast("bigint").alias("doc_id"), canonical_source(F.col(source)).alias("source"), F.col(text).alias("text")).where("text is not null")
    return base.mapInArrow(_counter(tokenizer, pattern), "doc_id bigint, source string, tokens bigint").where("tokens > 0")


def source_budgets(sized: DataFrame, weights: DataFrame, total: float | None = None) -> DataFrame:
    """(source, target_share, max_repeats, available, docs, budget, whole_passes): as many rows as weights has sources,
    and one, `(no target)`, for all documents of other sources. sized: doc_id, source, tokens."""
    per_source = {r["source"]: (r["t"], r["n"]) for r in _by_target(sized, weights).collect()}
    plan = {r["source"]: (float(r["target_share"] or 0), int(r["max_repeats"] or 0)) for r in _targets(weights).collect()}
    budget = budgets({s: t for s, (t, _) in per_source.items()}, {s: p[0] for s, p in plan.items()}, {s: p[1] for s, p in plan.items()}, total)
    plan |= {s: (0.0, 0) for s in per_source if s not in plan}
    rows = [(s, *plan[s], *per_source.get(s, (0, 0)), float(budget.get(s, 0.0)), int(budget.get(s, 0.0) // max(1, per_source.get(s, (0, 0))[0]))) for s in sorted(plan)]
    return sized.sparkSession.createDataFrame(rows, "source string, target_share double, max_repeats int, available bigint, docs bigint, budget double, whole_passes int")


def mix_sources(
    docs: DataFrame, key: str, text: str, source: str, weights: DataFrame, shards: int | None = None, total: float | None = None, seed: int = 7, block_tokens: int = BLOCK_TOKENS, tokenizer: str = TOKENIZER, pattern: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """(mix, report). mix: doc_id, source, use (1 = first pass), shard, position in the shard, tokens.
    report: source, target_share, max_repeats, available, used, uses_per_token, actual_share."""
    spark = docs.sparkSession
    place = F.pmod(F.xxhash64("doc_id", "tokens", F.lit(seed)), F.lit(1 << PLACE_BITS))
    sized = materialize(token_sizes(docs, key, text, source, tokenizer, pattern).withColumn("place", place), "sized")
    table = source_budgets(sized, weights, total)
    planned = [r for r in table.collect() if r["budget"] > 0]
    shards = shards or max(8, round(sum(r["budget"] for r in planned) / SHARD_TOKENS))
    ends = part_ends(sized, {r["source"]: r["budget"] - r["whole_passes"] * r["available"] for r in planned})
    rng, rows, uses = np.random.default_rng(seed + 1), [], {}
    for r in planned:
        s = r["source"]
        blocks = block_count(r["available"], r["docs"], r["budget"], shards, block_tokens)
        end = ends.get(s)
        part = 0 if end is None or end[0] < 0 else int(end[0] * float(blocks) / float(1 << PLACE_BITS)) + 1
        n = r["whole_passes"] * blocks + part
        if n:
            uses[s] = n
            rows.append((s, r["whole_passes"], blocks, n, step_of(n), int(rng.integers(n)), max(1, n // shards), *(end if part else (-1, 0, 0))))
    frame = F.broadcast(spark.createDataFrame(rows, "source string, passes int, blocks bigint, n bigint, step bigint, shift bigint, width bigint, end_place bigint, end_id bigint, end_tokens bigint"))
    in_part = F.struct("place", "doc_id", "tokens") <= F.struct(F.col("end_place").alias("place"), F.col("end_id").alias("doc_id"), F.col("end_tokens").alias("tokens"))
    used = sized.join(frame, "source").withColumn("uses", F.col("passes") + in_part.cast("int")).where("uses > 0")
    each = used.withColumn("use", F.explode(F.sequence(F.lit(1), F.col("uses"))))
    block = F.floor(F.col("place").cast("double") * F.col("blocks").cast("double") / F.lit(float(1 << PLACE_BITS)))
    at = F.pmod(F.col("step") * ((F.col("use") - 1) * F.col("blocks") + block) + F.col("shift"), F.col("n"))
    placed = each.withColumn("at", at).withColumn("bin", F.floor(F.col("at") / F.col("width"))).select("doc_id", "source", "use", "tokens", "at", "bin")
    width = F.broadcast(spark.createDataFrame([(r[0], r[6]) for r in rows], "source string, width bigint"))
    quotas = materialize(quota_table(spark, uses, shards, seed).join(width, "source"), "quotas")
    binned = quotas.withColumn("bin", F.explode(F.sequence(F.floor(F.col("lo") / F.col("width")), F.floor((F.col("hi") - 1) / F.col("width"))))).drop("width")
    shuffled = Window.partitionBy("shard").orderBy(F.xxhash64("doc_id", "use", F.lit(seed)), "doc_id", "use", "tokens")
    mix = placed.join(binned, ["source", "bin"]).where("at >= lo and at < hi").withColumn("position", F.row_number().over(shuffled)).select("doc_id", "source", "use", "shard", "position", "tokens")
    got = used.groupBy("source").agg(F.sum(F.col("tokens") * F.col("uses")).alias("used"), F.max("uses").alias("most_uses"))
    report = table.drop("docs", "budget", "whole_passes").join(got, "source", "left").fillna(0, ["used", "most_uses"])
    report = report.withColumn("all_used", F.sum("used").over(Window.partitionBy(F.lit(1))))
    return mix, report.withColumn("actual_share", F.round(F.try_divide(F.col("used").cast("double"), F.col("all_used")), 6)).drop("all_used")


def _targets(weights: DataFrame) -> DataFrame:
    return weights.select(canonical_source(F.col("source")).alias("source"), "target_share", "max_repeats").where("source is not null")


def _by_target(sized: DataFrame, weights: DataFrame) -> DataFrame:
    """Sizes of the sources with a target, all others together under one name: as many rows as weights has."""
    named = F.broadcast(_targets(weights).select("source").distinct().withColumn("known", F.lit(True)))
    label = F.when(F.col("known"), F.col("source")).otherwise(F.lit("(no target)"))
    return sized.join(named, "source", "left").groupBy(label.alias("source")).agg(F.sum("tokens").alias("t"), F.count("*").alias("n"))
