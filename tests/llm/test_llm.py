"""Operators that prepare training text against brute force on small tables."""

import json
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from answerforge.llm import crosssplit, leaks, level, markup, mixing, neardup, pairs, topn, tree, words
from answerforge.operators.components import connected_components

RNG = random.Random(11)
VOCABULARY = [f"w{i}" for i in range(400)] + ["Ünïté", "straße", "x_y", "the"]


def text(n, rng=RNG):
    return " ".join(rng.choice(VOCABULARY) + rng.choice(["", "", ",", "."]) for _ in range(n))


def edited(t, changes, rng=RNG):
    ws = t.split()
    for _ in range(changes):
        at = rng.randrange(len(ws))
        rng.choice([lambda: ws.pop(at), lambda: ws.insert(at, rng.choice(VOCABULARY)), lambda: ws.__setitem__(at, rng.choice(VOCABULARY))])()
    return " ".join(ws)


def shingles(t, k):
    w = words.words(t)
    return frozenset(zip(*[w[i:] for i in range(k)]))


# --- words ---------------------------------------------------------------------------------------------


def test_word_hashes_agree_with_words(monkeypatch):
    texts = [None, "", "  ", "One, two_three ONE", "straße ÉTÉ—été “x” 12²", "a" * 50, "İstanbul x", "日本 語", text(300)]
    hashes, counts = words.batch_hashes(texts)
    flat = [w for t in texts for w in words.words(t)]
    assert list(counts) == [len(words.words(t)) for t in texts]
    by_word = defaultdict(set)
    for w, h in zip(flat, hashes):
        by_word[w].add(int(h))
    assert all(len(v) == 1 for v in by_word.values()) and len({min(v) for v in by_word.values()}) == len(by_word)
    monkeypatch.setattr(words, "SEGMENT", 64)
    again, _ = words.batch_hashes(texts)
    assert (again == hashes).all()


# --- 2: top N ------------------------------------------------------------------------------------------


@pytest.mark.parametrize(("small", "few"), [(1, 50_000), (64, 50_000), (1, 0)])
def test_top_n_against_loops(spark, monkeypatch, small, few):
    monkeypatch.setattr(topn, "FEW_FLOORS", few)  # read on the driver only
    rng = random.Random(2)
    rows = []
    for i in range(3000):
        g = "hot" if rng.random() < 0.4 else rng.choice([None, *"abcdefgh"])
        s = rng.choice([None, float("nan"), 0.0, -1.5, 1e6, 1e6 + 1, rng.random(), rng.random() * 1e-6, -0.25])
        rows.append((g, i if rng.random() < 0.7 else i - 1, rng.choice([None, 1, 2]), s, i * 7 % 3001))
    df = spark.createDataFrame(rows, "g string, a int, r int, s double, id bigint").withColumn("bin", F.lit("clash")).withColumn("i", F.lit(1))
    got = sorted((str(r["g"]), r["id"], r["pos"]) for r in topn.top_n_per_group(df, "g", "s", "id", ["r"], 5, ["g", "a"], small).collect())
    first = {}
    for g, a, r, s, i in rows:
        if (g, a) not in first or i < first[g, a][2]:
            first[g, a] = (s, r, i)
    groups = defaultdict(list)
    for (g, _), (s, r, i) in first.items():
        if s is not None and s == s:
            groups[g].append((-s, r is None, r or 0, i))
    expected = sorted((str(g), x[3], n) for g, xs in groups.items() for n, x in enumerate(sorted(xs)[:5], 1))
    assert got == expected
    assert topn.top_n_per_group(df.where("false"), "g", "s", "id", ["r"], 5).count() == 0


def test_score_bins_keep_order(spark):
    values = [float("-inf"), -1e300, -5.0, -1e-9, -0.0, 0.0, 1e-12, 0.1, 0.1000001, 7.0, 1e30, 1e300, float("inf")]
    df = spark.createDataFrame([(v,) for v in values], "s double").withColumn("b", topn.score_bin(F.col("s")))
    bins = [r["b"] for r in df.orderBy("s").collect()]
    assert bins == sorted(bins)


# --- 5: near-duplicates --------------------------------------------------------------------------------


def groups_by_force(texts, k, threshold, least):
    sets = {key: shingles(t, k) for key, t in texts if t and len(words.words(t)) >= least}
    parent = {key: key for key in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            both = len(sets[a] & sets[b])
            if both and both >= threshold * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {(find(x), x) for x in keys if find(x) != x}


@pytest.mark.parametrize("small", [4, 128])  # with 4, large buckets and all levels occur
def test_near_duplicates_against_all_pairs(spark, small):
    rng = random.Random(5)
    base = [text(60, rng) for _ in range(60)]
    texts = [(i, t) for i, t in enumerate(base)]
    for i, t in enumerate(base[:30]):
        texts += [(1000 + 10 * i + j, edited(t, j, rng)) for j in range(6)]
    texts += [(5000 + j, edited(base[40], j % 4, rng)) for j in range(150)]  # a hot family
    texts += [(7000 + j, base[41].upper()) for j in range(150)]  # a hot group of copies
    texts += [(9000, None), (9001, ""), (9002, "too short"), (9003, " ".join(["same"] * 50)), (9004, " ".join(["same"] * 70)), (9005, text(20_000, rng))]
    df = spark.createDataFrame(texts, "key bigint, text string").withColumn("a", F.lit(0)).withColumn("path", F.lit("x")).repartition(3)
    got = {tuple(r) for r in neardup.near_duplicate_groups(df, "key", "text", 3, 0.5, 20, small=small).collect()}
    assert got == groups_by_force(texts, 3, 0.5, 20)
    assert neardup.near_duplicate_groups(df.where("false"), "key", "text").count() == 0


def family(base, share, count, first, rng, like=None):
    """(keys, signatures) of sets that have `share` of the base's values, at the places of `like` if given."""
    held = rng.random((count, neardup.POSITIONS)) < share if like is None else like
    own = rng.integers(0, 2**16, (count, neardup.POSITIONS), dtype=np.uint16)
    return list(range(first, first + count)), np.where(held, base, own), held


def test_family_split_unevenly_over_batches_meets(spark):
    rng = np.random.default_rng(11)
    base = rng.integers(0, 2**16, neardup.POSITIONS, dtype=np.uint16)
    many, sig, held = family(base, 0.7, 600, 1000, rng)
    few, twin, _ = family(base, 0.7, 40, 5000, rng, held[:40])
    rows = [(k, bytearray(v.tobytes())) for k, v in zip(many + few, np.concatenate([sig, twin]))]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "600")  # all of the many in one batch, the few in another
    try:
        met = {tuple(r) for r in neardup.candidate_pairs(spark.createDataFrame(rows, "key bigint, sig binary").coalesce(1), 6)[0].collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sum((1000 + i, 5000 + i) in met for i in range(40)) >= 38


def test_pairs_of_a_bucket_that_does_not_split(spark):
    rng = np.random.default_rng(12)
    base = rng.integers(0, 2**16, neardup.POSITIONS, dtype=np.uint16)
    many, sig, held = family(base, 0.8, 1000, 1000, rng)
    few, twin, _ = family(base, 0.8, 40, 5000, rng, held[:40])
    rows = [(k, bytearray(v.tobytes())) for k, v in zip(many + few, np.concatenate([sig, twin]))]
    pairs, rest = neardup.candidate_pairs(spark.createDataFrame(rows, "key bigint, sig binary"), 2)
    late = neardup.unsplit_pairs(rest, spark.createDataFrame([(1001, 1000)], "node bigint, root bigint"))
    twins = F.col("b") == F.col("a") + 4000
    early = {tuple(r) for r in pairs.where(twins).collect()}
    assert len(early) < 30 and len(early | {tuple(r) for r in late.where(twins).collect()}) >= 38
    assert late.where("a = 1000 and b = 1001").isEmpty()  # in one group already


@pytest.mark.parametrize("small", [16, 128])
def test_recall_at_the_threshold_in_a_crowded_family(spark, small):
    """600 sets that share a base (boilerplate), each with a twin of its own: of the pairs of twins, overlap near one half,
    0.99 are met, directly at some level or in the blocks of a bucket that didn't split."""
    rng = np.random.default_rng(13)
    base = rng.integers(0, 2**16, neardup.POSITIONS, dtype=np.uint16)
    held = rng.random((600, neardup.POSITIONS)) < 0.4
    left = np.where(held, base, rng.integers(0, 2**16, held.shape, dtype=np.uint16))
    right = np.where(held, base, np.where(rng.random(held.shape) < 0.17, left, rng.integers(0, 2**16, held.shape, dtype=np.uint16)))
    near = (left == right).mean(1) >= 0.5
    rows = [(i + 5000 * side, bytearray(v[i].tobytes())) for side, v in enumerate((left, right)) for i in np.flatnonzero(near).tolist()]
    part = 1 - (1 - 0.995) / 2
    pairs_met, rest = neardup.candidate_pairs(spark.createDataFrame(rows, "key bigint, sig binary"), neardup.runs_for(part, 0.5), neardup.runs_for(part, 0.5, neardup.MAX_DEPTH), small)
    if rest is not None:
        pairs_met = pairs_met.unionByName(neardup.unsplit_pairs(rest, spark.createDataFrame([(-1, -1)], "node bigint, root bigint"), small))
    met = {r["a"] for r in pairs_met.where("b = a + 5000").select("a").distinct().collect()}
    assert near.sum() > 200 and len(met) >= 0.99 * near.sum()


def test_runs_reach_the_recall():
    assert neardup.runs_for(0.9, 0.5) < neardup.runs_for(0.999, 0.5)
    assert neardup.runs_for(0.99, 0.95) <= 2


def broadcasts_of_plans(spark, act):
    """What act returns, and the broadcasts in each plan that it ran."""
    bus, store = spark.sparkContext._jsc.sc().listenerBus(), spark._jsparkSession.sharedState().statusStore()

    def plans():
        bus.waitUntilEmpty(30_000)
        found = store.executionsList()
        return {e.executionId(): e.physicalPlanDescription() for e in (found.apply(i) for i in range(found.size()))}

    before = plans()
    got = act()
    return got, [len(re.findall(r"^[^(\n]*BroadcastExchange", p.split("\n\n")[0], re.M)) for i, p in plans().items() if i not in before]


def test_near_duplicates_make_small_plans(spark):
    """The driver holds each plan as it runs; a round of the components used to be one plan of 56 broadcasts, as first planned."""
    rng = random.Random(6)
    base = [text(60, rng) for _ in range(40)]
    texts = [(100 * i + j, edited(t, j % 4, rng)) for i, t in enumerate(base) for j in range(6)]
    df = spark.createDataFrame(texts, "key bigint, text string")
    got, plans = broadcasts_of_plans(spark, lambda: {tuple(r) for r in neardup.near_duplicate_groups(df, "key", "text", 3, 0.5, 20).collect()})
    assert got == groups_by_force(texts, 3, 0.5, 20)
    assert len(plans) > 10 and max(plans) <= 6
    edges = spark.createDataFrame(sorted((a, b) for a, b in got), "a bigint, b bigint")
    by_stars, plans = broadcasts_of_plans(spark, lambda: {(a, b) for b, a in connected_components(edges, "a", "b", local=0).collect()})
    assert by_stars == got
    assert len(plans) > 5 and max(plans) <= 6


def test_key_filter_comes_to_the_driver_in_parts(spark, monkeypatch):
    keys = np.arange(0, 3_000_000, 7, dtype=np.int64)
    bits = np.zeros(1 << neardup.FILTER_BITS, bool)
    bits[neardup._key_cells(keys)] = True
    monkeypatch.setattr(type(spark.range(1)), "toPandas", None)  # a row for each of 400,000 cells went to the driver
    packed = neardup.key_filter(spark.range(0, 3_000_000, 7))
    assert (packed == np.packbits(bits)).all()
    assert not neardup.key_filter(spark.range(0)).any()


# --- 4: overlaps across splits -------------------------------------------------------------------------


def test_split_join_keeps_all_rows(spark):
    rng = random.Random(1)
    left = spark.createDataFrame([(rng.choice([0, 0, 0, 1, 2, 3]), i) for i in range(200)] + [(9, 1000)], "k int, x int")
    right = spark.createDataFrame([(rng.choice([0, 0, 1, 4, 5]), i) for i in range(100)] + [(9, 1), (9, 1)], "k int, y int")
    plain = sorted(map(tuple, left.join(right, ["k"]).collect()))
    for block in (1, 7, 64, 10_000):
        assert sorted(map(tuple, pairs.split_join(left, right, ["k"], block).collect())) == plain
    assert pairs.split_join(left.where("false"), right, ["k"], 7).count() == 0


def test_attach_both_deals_hot_keys(spark):
    links = [(a, b, a * b) for a in (1, 2) for b in range(10, 60)] + [(a, 99, 0) for a in range(100, 150)] + [(1, 99, 5)]
    payload = spark.createDataFrame([(i, f"p{i}") for i in range(200)], "key bigint, items string")
    df = spark.createDataFrame(links, "a bigint, b bigint, w bigint")
    for block in (4, 10_000):
        got = sorted(tuple(r) for r in pairs.attach_both(df, payload, block).collect())
        assert got == sorted((a, b, f"p{a}", f"p{b}", w) for a, b, w in links)


@pytest.mark.parametrize(("k", "threshold", "block"), [(1, 0.7, 4096), (3, 0.6, 4096), (3, 0.6, 3)])
def test_cross_split_against_all_pairs(spark, k, threshold, block):
    rng = random.Random(k)
    rows = []
    for i in range(120):
        t = text(30, rng)
        for j in range(rng.choice([1, 2, 3])):
            scope = rng.choice(["Old_Town_(x)_0", "old town (X) 0", "Old%20Town_%28x%29_0"]) if i % 3 else "other_1"
            rows.append((len(rows), scope, edited(t, rng.choice([0, 0, 1, 2, 5, 9]), rng), rng.choice(["train", "TRAIN ", "dev", " Test", "validation", None, "unknown"])))
    rows += [(len(rows) + j, "other_1", "a b c d", "train" if j % 2 else "test") for j in range(10)]
    rows += [(9000, "other_1", None, "train"), (9001, None, "a b c d", "test"), (9002, "other_1", "", "test"), (9003, "other_1", "a", "train")]
    df = spark.createDataFrame(rows, "key bigint, scope string, text string, split string").withColumn("side", F.lit("x"))
    got = [(r["train_key"], r["eval_key"]) for r in crosssplit.cross_split_overlaps(df, "key", F.col("scope"), "text", "split", k, threshold, block).collect()]
    side = lambda s: {"train": 0, "dev": 1, "test": 1, "validation": 1}.get((s or "").strip().lower())
    items = [(i, crosssplit.canonical_id(c), shingles(t or "", k), side(s)) for i, c, t, s in rows]
    expected = {(a[0], b[0]) for a in items if a[3] == 0 for b in items if b[3] == 1 and a[1] and a[1] == b[1] and a[2] & b[2] and len(a[2] & b[2]) >= threshold * len(a[2] | b[2]) - 1e-9}
    assert len(got) == len(set(got)) and set(got) == expected
    assert crosssplit.cross_split_overlaps(df.where("false"), "key", F.col("scope"), "text", "split", k, threshold).count() == 0


def test_classes_hold_copies_once(spark):
    """A thousand copies on both sides are one class with its counts and members, and no link but its own."""
    body = text(30, random.Random(3))
    rows = [(i, "s", body, "train" if i % 4 else "dev") for i in range(1000)] + [(5000, "s", edited(body, 1, random.Random(4)), "dev"), (6000, "s", text(30), "train")]
    df = spark.createDataFrame(rows, "key bigint, scope string, text string, split string")
    classes, members, links = crosssplit.overlap_classes(crosssplit.split_records(df, "key", F.col("scope"), "text", "split", 3, 0.6), 16)
    assert {(r["cls"], r["train_rows"], r["eval_rows"]) for r in classes.collect()} == {(0, 750, 250), (5000, 0, 1), (6000, 1, 0)}
    assert members.count() == 1002 and {(r["c1"], r["c2"]) for r in links.collect()} == {(0, 0), (0, 5000)}
    assert crosssplit.overlapping_rows(members, links, 16).count() == 750 * 250 + 750


def test_window_minima_find_most_pairs_alone(spark):
    """Recall of the fingerprints without the supplement, over texts with a few edits."""
    rng = random.Random(21)
    rows = []
    for i in range(150):
        t = text(60, rng)
        rows += [(2 * i, "s", t, "train"), (2 * i + 1, "s", edited(t, rng.choice([1, 2, 3]), rng), "test")]
    df = spark.createDataFrame(rows, "key bigint, scope string, text string, split string")
    _, _, links = crosssplit.overlap_classes(crosssplit.split_records(df, "key", F.col("scope"), "text", "split", 3, 0.6))
    found = [r["shared_prints"] for r in links.collect()]
    assert len(found) == 150 and sum(n > 0 for n in found) >= 0.95 * len(found)


def test_chain_and_coverage():
    assert crosssplit.chain([(0, 5), (1, 1), (2, 2), (3, 9), (4, 3)]) == [(1, 1), (2, 2), (4, 3)]
    a, _ = words.batch_hashes(["one two three four five six seven eight nine ten eleven twelve"])
    b, _ = words.batch_hashes(["zero one two three four five six seven eight nine ten eleven twelve"])
    cover = crosssplit.coverage(a, b, 3)
    assert cover[0] == 1.0 and cover[1] == pytest.approx(12 / 13)
    assert len(crosssplit.winnow(np.arange(100, dtype=np.uint64))) == 93


def test_window_minima_against_loops():
    rng = np.random.default_rng(4)
    sizes = [1, 3, 7, 8, 9, 40, 1, 100]
    ranks, owner = rng.permutation(sum(sizes)), np.repeat(np.arange(len(sizes)), sizes)
    expected = set()
    for o in range(len(sizes)):
        mine = ranks[owner == o]
        expected |= {int(mine[i : i + 8].min()) for i in range(max(1, len(mine) - 7))}
    assert set(crosssplit.window_minima(ranks, owner).tolist()) == expected


# --- 6: leaked passages --------------------------------------------------------------------------------


def test_leaks_against_word_runs(spark):
    rng = random.Random(6)
    items = [(i, text(40, rng)) for i in range(20)] + [(50, "too short"), (51, None), (52, ""), (53, "a b c d e f g h i j k l m"), (54, "a b c d e f g h i j k l m")]
    items += [(60 + i, items[3][1] + " " + text(20, rng)) for i in range(4)]  # they share a text
    docs = []
    for i in range(150):
        t = text(80, rng).split()
        if i % 3 == 0:
            src = items[rng.randrange(20)][1].split()
            n, at = rng.choice([11, 12, 13, 30]), rng.randrange(0, 10)
            t[20:20] = [w.upper() + ";" for w in src[at : at + n]]
        docs.append((i, " ".join(t)))
    docs += [(900, None), (901, ""), (902, items[0][1] + " " + items[1][1]), (903, text(30_000, rng) + " " + items[2][1]), (904, "x a b c d e f g h i j k l y")]
    grams = lambda t: set(zip(*[words.words(t)[i:] for i in range(12)]))
    expected = {(d, i) for d, t in docs for i, u in items if grams(t) & grams(u)}
    d = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("item_id", F.lit("clash"))
    q = spark.createDataFrame(items, "item_id bigint, text string")
    for block in (7, 1000):
        found = leaks.leaked_passages(d, "doc_id", "text", q, "item_id", "text", 12, block)
        got = [(r["doc_id"], r["item_id"]) for r in found.where("run_words >= 12").collect()]
        assert len(got) == len(set(got)) and set(got) == expected
    assert leaks.leaked_passages(d, "doc_id", "text", q.where("false"), "item_id", "text").count() == 0
    assert leaks.leaked_passages(d.where("false"), "doc_id", "text", q, "item_id", "text").count() == 0


@pytest.mark.parametrize("every", [6, 8, 12])
def test_recall_of_leaks_with_spread_edits(every):
    """Items of 48 words inside documents of 248, a word in every `every` changed, left out or put in; no document
    without an item is found."""
    rng = random.Random(every)
    items = [(i, text(48, rng)) for i in range(100)]
    index, found, false = leaks.Index(items, 12), 0, 0
    for i, t in items:
        ws = t.split()
        for at in range(len(ws) - 1 - rng.randrange(every), -1, -every):
            rng.choice([lambda: ws.pop(at), lambda: ws.insert(at, rng.choice(VOCABULARY)), lambda: ws.__setitem__(at, rng.choice(VOCABULARY))])()
        rows = leaks.scan(index, [i, 1000 + i], [text(100, rng) + " " + " ".join(ws) + " " + text(100, rng), text(248, rng)])
        found += any(r[:2] == (i, i) for r in rows)
        false += any(r[0] != r[1] for r in rows)
    assert found >= 95 and false == 0


def test_an_instruction_shared_by_all_items_costs_one_run_a_document():
    rng = random.Random(9)
    instruction = "Read the following passage with care, then answer every question below in one short sentence of your own words"
    items = [(i, instruction + " " + text(30, rng)) for i in range(400)]
    index = leaks.Index(items, 12)
    data = np.frombuffer(leaks.normalise(text(50, rng) + " " + instruction + " " + text(50, rng)), np.uint8)
    at, _, size, _ = index.runs(data)
    assert size.max() > 90 and len(at) < 60
    assert {r[1] for r in leaks.scan(index, [1], [instruction])} == set(range(400))


def test_expansion_in_parts_changes_nothing(monkeypatch):
    rng = random.Random(10)
    instruction = text(20, rng)
    items = [(i, instruction + " " + text(20, rng)) for i in range(50)]
    docs = [text(20, rng) + " " + instruction + " " + items[i][1] for i in range(12)]
    index = leaks.Index(items, 12)
    whole = sorted(leaks.scan(index, list(range(12)), docs))
    for most in (1, 40, 300):
        monkeypatch.setattr(leaks, "EXPANDED", most)
        assert sorted(leaks.scan(index, list(range(12)), docs)) == whole


def test_a_passage_with_one_edit_is_found():
    item = "the quick brown fox jumps over the lazy dog while seventeen green parrots watch from trees"
    index = leaks.Index([(1, item)], 12)
    rows = leaks.scan(index, [7], ["Before it. " + item.replace("lazy", "lxzy") + " and after"])
    assert rows == [(7, 1, 15, 1, round(15 / 16, 6), 8)]
    assert leaks.scan(index, [7], [item[:50]]) == []


def test_alignment_counts_words():
    a, b = leaks.Words(b"one two three four five six seven"), leaks.Words(b"two three x five six")
    assert leaks.align(a, 0, 7, b, -40, 40) == (2, 0, 2)  # the edit costs more than two words give
    assert leaks.align(a, 0, 7, a, -40, 40) == (7, 0, 7)
    assert leaks.align(a, 0, 7, leaks.Words(b"one two three four six seven"), -40, 40)[2] == 4


# --- 1: markup -----------------------------------------------------------------------------------------

MIXED = """<!-- <h1>gone</h1> --><h2 class="x">Old <b>Town</b></h2>
<script>var s = "<li>no</li>";</script>
<ul><li>one thing<li>it cost $5 or $6 then</ul>
== Notes ==
* first *slanted* item
# numbered wiki item here.
# another numbered one here.

## Markdown heading ##

```
# no heading
- no item $x = 1$
```
Text with `$code = 1$` and $x_1 = 2$ and \\(y\\).

$$z = 1$$

% \\section{gone}
\\section*{Early years}
\\begin{itemize}
\\item first \\emph{one}
\\end{itemize}
See also
--------
<pre><code>&lt;li&gt;a&lt;/li&gt;</code></pre>
| a | b |
|---|---|
"""


def test_elements_of_mixed_markup():
    counts = Counter(kind for kind, _ in markup.elements(MIXED))
    assert counts == {"heading": 5, "list_item": 6, "code": 2, "formula": 3}
    numbers = defaultdict(list)
    for kind, n in markup.elements(MIXED):
        numbers[kind].append(n)
    assert all(v == list(range(1, len(v) + 1)) for v in numbers.values())


def test_clean_text_keeps_structure():
    clean = markup.clean_text(MIXED).split("\n")
    assert "## Old Town" in clean and "- one thing" in clean and "- it cost $5 or $6 then" in clean
    assert "$$z = 1$$" in clean and "<li>a</li>" in clean and "- first one" in clean
    assert "Text with $code = 1$ and $x_1 = 2$ and $y$." in clean
    assert not any("gone" in c or "var s" in c or "<b>" in c for c in clean)


@pytest.mark.parametrize("doc", [None, "", " ", "<", "<!-- x", "$", "$$", "```", "\\item", "#", "=" * 50, "<h1>", "7", "* " * 50, "`" * 99, "<li>" * 99])
def test_odd_documents_do_not_fail(doc):
    markup.elements(doc)
    markup.clean_text(doc)


def test_every_labelled_block_is_learnt():
    learnt = markup.block_tree()
    for doc, letters in markup.LABELLED:
        got = [c for _, c in markup.label_blocks(markup.filled(doc))]
        assert got == [markup._LETTER[x] for x in letters], doc
    assert isinstance(learnt, tuple)


#: Pages that the tree has not seen: their words, sizes and marks are others than in its table.
UNSEEN = (
    ("A short history\n\n" + "word " * 37 + "end.\n\nThe second war\n\n" + "word " * 64 + "end.", "HTHT"),
    ("<p>" + "go " * 31 + "on.</p><p>Money and trade</p><p>" + "go " * 58 + "on.</p>", "THT"),
    ("<div><a href='1'>Start</a> <a href='2'>Search</a> <a href='3'>Maps</a></div><p>" + "go " * 44 + "on.</p>", "BT"),
    ("<p>" + "go " * 44 + "on.</p><div><a href='1'>Imprint</a></div><div>No part may be copied</div>", "TBB"),
    ("<ul><li><a href='1'>Start</a></li><li><a href='2'>All maps</a></li><li><a href='3'>Search</a></li></ul><p>" + "go " * 44 + "on.</p>", "MMMT"),
    ("<ul><li>One <a href='1'>map</a> of the whole land</li><li>Another " + "go " * 8 + "on.</li></ul>", "LL"),
    ("go " * 30 + "on.\n\n[Up](1) [Down](2)\n\n" + "go " * 41 + "on.", "TBT"),
    ("go " * 30 + "on.\n\n# The wars\n\n" + "go " * 41 + "on.\n\n# " + "go " * 7 + "on.\n# " + "go " * 5 + "on.", "THTLL"),
    ("Some lines\nof a poem\nwithout any end", "TTT"),
    ("go " * 30 + "on.\n\nThey left it.\n\n" + "go " * 41 + "on.", "TTT"),
)


def _splits(node):
    return set() if isinstance(node, int) else {markup.FEATURES[node[0]]} | _splits(node[2]) | _splits(node[3])


def test_size_links_and_neighbours_decide():
    """The tree splits on them, gets unseen pages right, and loses accuracy without them."""
    used = _splits(markup.block_tree())
    assert {"words", "links"} <= used and used & {"words_after", "words_before"} and used & {"links_before", "links_after"}
    x, y = markup.labelled_rows(UNSEEN)
    right = np.mean([tree.classify(markup.block_tree(), r) == c for r, c in zip(x, y)])
    assert right == 1
    table, labels = markup.labelled_rows(markup.LABELLED)
    for gone in (markup.SIZES, markup.NEIGHBOURS):
        at = [markup.FEATURES.index(f) for f in gone]
        less, seen = table.copy(), x.copy()
        less[:, at], seen[:, at] = 0, 0
        poorer = tree.grow(less, labels, len(markup.CLASSES))
        assert np.mean([tree.classify(poorer, r) == c for r, c in zip(seen, y)]) < 0.95


@pytest.mark.parametrize(
    ("doc", "clean"),
    [
        ("A {{a|{{b}}}} c", "A c"),
        ("A\\footnote{a \\emph{b} c} text", "A text"),
        ("See [http://x.org the label] now [https://y.org].", "See the label now ."),
        ("{| class='wikitable'\n|+ The scores\n! Name !! Score\n|-\n| style=\"x\" | Old Town || [[a|12]]\n|}", "The scores\nName | Score\nOld Town | 12"),
        ("| Name | Score |\n|--|:--|\n| Old Town | 12 |", "Name | Score\nOld Town | 12"),
        ("\\begin{tabular}{ll}\n\\hline\na & b \\\\\nc \\& d & $x=1$ \\\\ \\hline\n\\end{tabular}", "a | b\nc & d | $x=1$"),
        ("<ol><li><p>One two.</p></li><li><div><p>Three</p></div></li></ol>", "- One two.\n- Three"),
        ("\\textbf{a \\emph{b {c} d} e} [[Category:Towns]] ![alt](x.png) {kept} }} {{open", "a b {c} d e alt {kept} }} open"),
        ("{{" * 5000 + "x" + "}}" * 5000, ""),
        ("<ul><li><a href='/'>Home</a></li><li><a href='/n'>News</a></li><li><a href='/s'>Sport</a></li></ul><h1>Old Town</h1><p>" + "go " * 40 + "on.</p>", "# Old Town\n" + "go " * 40 + "on."),
    ],
)
def test_no_residue(doc, clean):
    assert markup.clean_text(doc) == clean


def test_menu_items_are_list_items_of_the_document():
    menu = "* [Home](/)\n* [News](/n)\n* [Sport](/s)"
    assert markup.elements(menu) == [("list_item", 1), ("list_item", 2), ("list_item", 3)] and markup.clean_text(menu) == ""


def test_tree_splits_midway():
    grown = tree.grow(np.array([[0.0], [1.0], [4.0], [6.0]]), np.array([0, 0, 1, 1]), 2)
    assert grown == (0, 2.5, 0, 1)


def test_wrong_tokens(spark):
    tokens = [(True, "<p>"), (False, "</P>"), (None, "word"), (True, "word"), (False, "<"), (True, "< p>"), (True, '<a href="x">'), (True, "<b>x</b>"), None]
    df = spark.createDataFrame([(1, tokens), (2, None), (3, [])], "record_id bigint, tokens array<struct<is_html:boolean,token:string>>")
    got = sorted(r["item_no"] for r in markup.wrong_tokens(df, "record_id", "tokens").collect())
    assert got == [1, 2, 3, 5, 7]


def test_structure_of_tables(spark):
    df = spark.createDataFrame([(1, "== A ==\n* b"), (2, None), (3, "")], "record_id bigint, doc string").withColumn("element", F.lit(1))
    assert sorted(map(tuple, markup.structure_elements(df, "record_id", "doc").collect())) == [(1, "heading", 1), (1, "list_item", 1)]
    assert markup.cleaned_documents(df, "record_id", "doc").count() == 3
    assert markup.structure_elements(df.where("false"), "record_id", "doc").count() == 0


# --- 8: reading level ----------------------------------------------------------------------------------

EASY = ["The dog saw the cat.", "The cat ran.", "A boy had a ball.", "It was red.", "The sun was up."]
HARD = ["Notwithstanding the constitutional interpretation, the parliamentary commission administered infrastructure, whereas jurisdictional representation deteriorated considerably;", "inasmuch as unprecedented methodological reconsiderations characterised the interdisciplinary investigation, legislation necessitated reorganisation."]


def test_levels_are_learnt_and_held_out(spark):
    rng = random.Random(8)
    docs, truth = [], {}
    for i in range(400):
        lv = rng.randrange(1, 5)
        share = (lv - 1) / 3
        docs.append((i, " ".join(rng.choice(HARD if rng.random() < share else EASY) for _ in range(12))))
        truth[i] = lv
    docs += [(900, None), (901, ""), (902, "short")]
    labels = [(i, f"r{j}", truth[i]) for i in range(0, 400, 2) for j in range(2)] + [(0, "r0", truth[0]), (2, "r9", None), (12345, "r0", 2)]
    d = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("level", F.lit(9)).withColumn("spoken", F.lit("x"))
    lab = spark.createDataFrame(labels, "doc_id bigint, rater string, level int")
    got = {r["doc_id"]: r["level"] for r in level.reading_levels(d, "doc_id", "text", lab, "true", 30).collect()}
    assert set(got) == set(range(400))
    held = [i for i in range(1, 400, 2)]
    assert sum(got[i] == truth[i] for i in held) / len(held) > 0.6
    assert sum(abs(got[i] - truth[i]) <= 1 for i in held) / len(held) > 0.97
    assert level.reading_levels(d, "doc_id", "text", lab.where("false")).count() == 0
    assert level.reading_levels(d.where("false"), "doc_id", "text", lab).count() == 0


def test_ordinal_regression_orders_levels():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 3))
    y = np.digitize(x @ [2.0, -1.0, 0.0] + 0.1 * rng.normal(size=600), [-1.5, 0.0, 1.5])
    model = level.OrdinalRegression(penalty=0.1).fit(x[:400], y[:400])
    assert (np.diff(model.edge) > 0).all()
    assert (model.predict(x[400:]) == y[400:]).mean() > 0.85
    assert np.allclose(model.probabilities(x).sum(1), 1)


# --- 7: mixing -----------------------------------------------------------------------------------------


def test_budgets():
    shares, caps, sizes = {"a": 0.5, "b": 0.3, "c": 0.2}, {"a": 1, "b": 2, "c": 1}, {"a": 100, "b": 30, "c": 0}
    out = mixing.budgets(sizes, shares, caps)
    assert out == pytest.approx({"a": 100.0, "b": 60.0})
    capped = mixing.budgets(sizes, shares, caps, 150)
    assert capped == pytest.approx({"a": 93.75, "b": 56.25}) and mixing.budgets({}, shares, caps) == {}
    assert mixing.budgets(sizes, shares, caps, 500) == pytest.approx({"a": 100.0, "b": 60.0})


def test_splitting_tree_keeps_quotas():
    uses = {"a": 101, "b": 7, "c": 0}
    parts = mixing.split_quotas(uses, 5, 3)
    assert len(parts) == 5 and {s: sum(p[s] for p in parts) for s in uses} == uses
    sizes = [sum(p.values()) for p in parts]
    assert max(sizes) - min(sizes) <= 3 and parts == mixing.split_quotas(uses, 5, 3)


def test_plan_at_a_hundred_terabytes():
    """25e12 tokens of 14 sources: blocks far below a shard, no empty shard, every source in every shard."""
    raw = np.array([30, 20, 12, 9, 7, 5, 4, 3, 3, 2, 2, 1.5, 1, 0.5])
    budget = {f"s{i:02}": 25e12 * x / raw.sum() for i, x in enumerate(raw)}
    shards = round(25e12 / mixing.SHARD_TOKENS)
    assert shards == 500_000
    blocks = {s: mixing.block_count(int(b), int(b) // 800, b, shards) for s, b in budget.items()}
    assert all(budget[s] / blocks[s] < mixing.SHARD_TOKENS / 10_000 for s in budget)
    nodes = mixing.upper_nodes(blocks, shards, 7)
    assert len(nodes) <= mixing.NODES and sum(n for *_, n in nodes) == shards
    assert (sum(c for c, *_ in nodes) == [blocks[s] for s in sorted(blocks)]).all()
    for node in nodes[:: len(nodes) // 5]:
        quota = mixing.leaf_quotas(*node, 7)
        assert (quota.sum(0) == node[0]).all() and quota.min() > 0
        assert quota.sum(1).max() - quota.sum(1).min() <= 20


def test_strides_permute():
    for n in (1, 2, 3, 10, 97, 1000, 4096):
        a = mixing.step_of(n)
        assert len({(a * i + 5) % n for i in range(n)}) == n
    assert mixing.step_of(6 * 10**9) * 6 * 10**9 <= 1 << 62


def test_ends_of_parts_against_sorting(spark):
    rng = random.Random(17)
    rows = [(i // 3 if i % 50 == 0 else i, rng.choice("abc"), rng.randrange(1, 90), rng.choice([rng.getrandbits(40), 5 << 28, (5 << 28) + 1])) for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, tokens bigint, place bigint")
    for share in (0.0, 1e-4, 0.2, 0.5, 0.93, 0.9999):
        parts = {s: share * sum(r[2] for r in rows if r[1] == s) for s in "ab"}
        ends = mixing.part_ends(df, parts)
        for s in "ab":
            groups = Counter()
            for i, src, tokens, place in rows:
                if src == s:
                    groups[place, i, tokens] += tokens
            inside, at = set(), 0
            for g in sorted(groups):
                if parts[s] > 0 and at + groups[g] / 2 <= parts[s]:
                    inside.add(g)
                at += groups[g]
            assert {g for g in groups if g <= ends.get(s, (-1, 0, 0))} == inside


def test_quota_table_covers_every_use_once(spark):
    uses = {"a": 1001, "b": 70, "c": 5}
    rows = mixing.quota_table(spark, uses, 13, 3).collect()
    for s, n in uses.items():
        spans = sorted((r["lo"], r["hi"]) for r in rows if r["source"] == s)
        assert spans[0][0] == 0 and spans[-1][1] == n and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
    quotas = mixing.split_quotas(uses, 13, 3)
    assert {(r["source"], r["shard"]): r["hi"] - r["lo"] for r in rows} == {(s, i): q[s] for i, q in enumerate(quotas) for s in q if q[s]}


def test_a_tokenizer_that_is_not_there_is_named(spark):
    df = spark.createDataFrame([(1, "x y", "a")], "doc_id bigint, text string, source string")
    with pytest.raises(Exception, match="must be readable on every executor"):
        mixing.token_sizes(df, "doc_id", "text", "source", "/nowhere/vocabulary").collect()


def test_mix_reaches_shares_within_caps(spark):
    rng = random.Random(7)
    docs = [(i, text(rng.randrange(20, 60), rng), rng.choice(["Big Source", "big_source", " BIG_SOURCE "])) for i in range(300)]
    docs += [(1000 + i, text(40, rng), "small") for i in range(20)] + [(2000, text(30, rng), None), (2001, None, "small"), (2002, "", "small"), (2003, text(30, rng), "unlisted")]
    weights = spark.createDataFrame([("big_source", 0.7, 2), ("small", 0.2, 3), ("absent", 0.1, 4)], "source string, target_share double, max_repeats int")
    d = spark.createDataFrame(docs, "doc_id bigint, text string, source string").withColumn("use", F.lit("x")).withColumn("block", F.lit("x"))
    mix, report = mixing.mix_sources(d, "doc_id", "text", "source", weights, shards=4, block_tokens=300)
    rows = mix.collect()
    uses = Counter((r["doc_id"]) for r in rows)
    assert all(n <= (3 if i >= 1000 else 2) for i, n in uses.items()) and not {2000, 2001, 2002, 2003} & set(uses)
    assert len({(r["doc_id"], r["use"]) for r in rows}) == len(rows)
    assert {r["shard"] for r in rows} == {0, 1, 2, 3}
    for s in range(4):
        places = sorted(r["position"] for r in rows if r["shard"] == s)
        assert places == list(range(1, len(places) + 1))
    shares = {r["source"]: r["actual_share"] for r in report.collect()}
    assert shares["big_source"] == pytest.approx(0.7 / 0.9, abs=0.02) and shares["small"] == pytest.approx(0.2 / 0.9, abs=0.02)
    assert shares["absent"] == 0 and sum(shares.values()) == pytest.approx(1, abs=1e-4)
    used = sum(r["tokens"] for r in rows)
    assert used == sum(r["used"] for r in report.collect())


# --- queries -------------------------------------------------------------------------------------------


def test_queries_run_and_agree_with_sql(spark, sf):
    from oracle import connect, differences

    from answerforge.llm.queries import ORACLES, QUERIES

    con = connect(sf)
    for name, query in QUERIES.items():
        if name in ORACLES:
            assert differences(spark, con, sf, query, ORACLES[name]) is None
        else:
            assert query(spark, sf).columns


def test_columns_of_the_found_queries(spark, sf):
    from answerforge.llm.queries import QUERIES

    expected = {
        "p1_found": [("record_id", "bigint"), ("element", "string"), ("item_no", "int")],
        "p2_found": [("example_id", "string"), ("prediction_id", "bigint")],
        "p4_found": [("qa_key_a", "bigint"), ("qa_key_b", "bigint")],
        "p5_found": [("key_a", "bigint"), ("key_b", "bigint")],
        "p6_found": [("doc_id", "bigint"), ("item_id", "bigint")],
        "p8_found": [("doc_id", "bigint"), ("level", "int")],
    }
    for name, columns in expected.items():
        assert QUERIES[name](spark, sf).dtypes == columns
    json.dumps(list(expected))
