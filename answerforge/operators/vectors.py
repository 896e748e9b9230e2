"""Vector search: exact top-k by blocked matrix products, centroid index, late interaction."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from answerforge.operators.sparse import rank_by_score
from answerforge.operators.topk import RunningTopK
from answerforge.session import materialize, materialize_all

#: Query vectors that go to the tasks at once; more are searched in further passes.
QUERY_BLOCK, ROW_BLOCK = 4096, 512
MOST_CENTROIDS = 1 << 18


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0).cast("double"), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def l2_augmented(v: Column, largest: Column | float) -> Column:
    """The vector with one more dimension, so that inner product order becomes distance order."""
    rest = F.lit(largest) if isinstance(largest, float) else largest
    return F.concat(F.transform(v, lambda x: x.cast("double")), F.array(F.sqrt(F.greatest(rest - dot(v, v), F.lit(0.0)))))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _unit(m: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(n == 0, 1, n)


def _searcher(qids: np.ndarray, queries: np.ndarray, k: int, metric: str, not_self: bool):
    q = _unit(queries) if metric == "cosine" else queries

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = RunningTopK(len(q), k)
        for batch in batches:
            batch = batch.filter(batch.column(1).is_valid())
            if not batch.num_rows:
                continue
            all_ids, all_rows = batch.column(0).to_numpy(), _matrix(batch.column(1))
            for lo in range(0, len(all_ids), ROW_BLOCK):
                ids, m = all_ids[lo : lo + ROW_BLOCK], all_rows[lo : lo + ROW_BLOCK]
                m = _unit(m) if metric == "cosine" else m
                if metric == "l2":
                    scores = -np.sqrt(np.maximum((q * q).sum(1)[:, None] + (m * m).sum(1)[None, :] - 2 * q @ m.T, 0))
                else:
                    scores = q @ m.T
                scores = np.round(scores, 6)
                if not_self:
                    scores[qids[:, None] == ids[None, :]] = -np.inf
                best.add(ids, scores)
        yield pa.RecordBatch.from_arrays([pa.array(qids[best.q]), pa.array(best.ids), pa.array(best.scores)], names=["qid", "vec_id", "score"])

    return run


def _query_blocks(queries: DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    ids, rows = [], []
    for qid, v in queries.where("v is not null").toLocalIterator():
        ids.append(qid)
        rows.append(v)
        if len(ids) == QUERY_BLOCK:
            yield np.array(ids, np.int64), np.array(rows, np.float64)
            ids, rows = [], []
    if ids:
        yield np.array(ids, np.int64), np.array(rows, np.float64)


def vector_topk(vectors: DataFrame, queries: DataFrame, k: int, metric: str = "dot", vec_id: str = "vec_id", vector: str = "embedding", not_self: bool = False) -> DataFrame:
    """(qid, vec_id, score, rank), exact. metric: dot, cosine or l2 (score = -distance).

    Each task keeps k per query of its own rows, so the shuffle carries k rows per query and task.
    NULL vectors match nothing; equal scores (6 places) go by id.
    """
    base = vectors.select(F.col(vec_id).cast("bigint").alias("id"), F.col(vector).alias("v"))
    blocks = _query_blocks(queries.select(F.col(vec_id).cast("bigint"), F.col(vector).alias("v")))
    found = materialize_all((base.mapInArrow(_searcher(qids, block, k, metric, not_self), "qid bigint, vec_id bigint, score double") for qids, block in blocks), "hits")
    if found is None:
        return vectors.sparkSession.createDataFrame([], "qid bigint, vec_id bigint, score double, rank bigint")
    return rank_by_score(found, k, "qid", "vec_id")


def merge_shards(shards: list[DataFrame], k: int) -> DataFrame:
    """Global top-k of the top-k of each shard."""
    union = shards[0].select("qid", "vec_id", "score")
    for s in shards[1:]:
        union = union.unionByName(s.select("qid", "vec_id", "score"))
    return rank_by_score(union, k, "qid", "vec_id")


def centroids_by_label(vectors: DataFrame, label: str = "label", vector: str = "embedding") -> DataFrame:
    """(cid, centroid): mean vector of each label; sums are combined map-side."""
    each = vectors.where(F.col(vector).isNotNull()).select(F.col(label).alias("cid"), F.posexplode(vector).alias("pos", "x"))
    means = each.groupBy("cid", "pos").agg(F.round(F.avg(F.col("x").cast("double")), 9).alias("m"))
    return means.groupBy("cid").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("centroid"))


def centroid_scores(vectors: DataFrame, centroids: DataFrame, ids: list[str] | None = None, vector: str = "embedding", n: int | None = None) -> DataFrame:
    """(ids.., cid, score): the n best centroids of each vector (score, then smallest cid), all without n.

    The centroids of an index are at most MOST_CENTROIDS; they go to the tasks once, and a row's best are
    chosen where the row is: nothing is shuffled.
    """
    ids = ids or ["vec_id"]
    table = centroids.select("cid", "centroid").limit(MOST_CENTROIDS + 1).collect()
    if len(table) > MOST_CENTROIDS:
        raise ValueError(f"an index has at most {MOST_CENTROIDS} centroids")
    table.sort(key=lambda r: r["cid"])
    cids = np.array([r["cid"] for r in table], np.int64)
    m = np.array([r["centroid"] for r in table], np.float64).reshape(len(table), -1)
    keep = len(cids) if n is None else min(n, len(cids))
    base = vectors.where(F.col(vector).isNotNull()).select(*ids, F.col(vector).alias("_v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows or not keep:
                continue
            scores = np.round(_matrix(batch.column(len(ids))) @ m.T, 6)
            best = np.argsort(-scores, axis=1, kind="stable")[:, :keep]
            at = np.repeat(np.arange(len(scores)), keep)
            own = [batch.column(i).take(pa.array(at)) for i in range(len(ids))]
            yield pa.RecordBatch.from_arrays([*own, pa.array(cids[best.ravel()]), pa.array(scores[at, best.ravel()])], names=[*ids, "cid", "score"])

    kinds = dict(base.dtypes)
    return base.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in ids) + ", cid bigint, score double")


def nearest_centroid(vectors: DataFrame, centroids: DataFrame, ids: list[str] | None = None, vector: str = "embedding") -> DataFrame:
    """(ids.., code, score): highest score, then smallest centroid."""
    return centroid_scores(vectors, centroids, ids, vector, 1).withColumnRenamed("cid", "code")


def inverted_lists(codes: DataFrame) -> DataFrame:
    """(code, pid) distinct: the lists of the index as a table, one row per entry."""
    return codes.select("code", "pid").distinct()


def token_maxima(scored: DataFrame) -> DataFrame:
    """(q, d, score): best document token per query token, summed over query tokens."""
    return scored.groupBy("q", "d", "qtok").agg(F.max("score").alias("m")).groupBy("q", "d").agg(F.round(F.sum("m"), 6).alias("score"))


def _token_blocks(query_tokens: DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query, query token, vectors) in blocks of about QUERY_BLOCK tokens; a query's tokens stay together."""
    rows: list[tuple] = []
    for r in query_tokens.select("q", "qtok", "v").where("v is not null").orderBy("q", "qtok").toLocalIterator():
        if len(rows) >= QUERY_BLOCK and rows[-1][0] != r[0]:
            yield _token_arrays(rows)
            rows = []
        rows.append(tuple(r))
    if rows:
        yield _token_arrays(rows)


def _token_arrays(rows: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64), np.array([r[2] for r in rows], np.float64)


def pair_scores(doc_tokens: DataFrame, query_tokens: DataFrame) -> DataFrame:
    """(q, qtok, d, score): best score of each query token in each document. Columns: (d, v) and (q, qtok, v).
    For all documents with all query tokens; maxima per document are taken before anything is written."""

    def scan(qs: np.ndarray, qt: np.ndarray, m: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                docs, scores = batch.column(0).to_numpy(), m @ _matrix(batch.column(1)).T
                order = np.argsort(docs, kind="stable")
                starts = np.flatnonzero(np.append(True, np.diff(docs[order]) != 0))
                best = np.round(np.maximum.reduceat(scores[:, order], starts, axis=1), 6)
                ids = docs[order][starts]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(qs, len(ids))), pa.array(np.repeat(qt, len(ids))), pa.array(np.tile(ids, len(qs))), pa.array(best.ravel())], names=["q", "qtok", "d", "score"])

        return run

    base = doc_tokens.select("d", "v").where("v is not null")
    found = materialize_all((base.mapInArrow(scan(*block), PAIRS) for block in _token_blocks(query_tokens)), "pairs")
    return doc_tokens.sparkSession.createDataFrame([], PAIRS) if found is None else found


PAIRS = "q bigint, qtok bigint, d bigint, score double"


def candidate_scores(doc_tokens: DataFrame, query_tokens: DataFrame, candidates: DataFrame) -> DataFrame:
    """`pair_scores` of given (q, d) only: a document's tokens meet the queries that want it, no others."""
    met = materialize(candidates.select("q", "d").join(doc_tokens.select("d", "v").where("v is not null"), "d"), "met")

    def scan(qs: np.ndarray, qt: np.ndarray, m: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                q, d, v = batch.column(0).to_numpy(), batch.column(1).to_numpy(), None
                for one in np.unique(q[np.isin(q, qs)]):
                    v = _matrix(batch.column(2)) if v is None else v
                    rows, own = np.flatnonzero(q == one), np.flatnonzero(qs == one)
                    rows = rows[np.argsort(d[rows], kind="stable")]
                    starts = np.flatnonzero(np.append(True, np.diff(d[rows]) != 0))
                    best = np.round(np.maximum.reduceat(m[own] @ v[rows].T, starts, axis=1), 6)
                    ids = d[rows][starts]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(best.size, one)), pa.array(np.repeat(qt[own], len(ids))), pa.array(np.tile(ids, len(own))), pa.array(best.ravel())], names=["q", "qtok", "d", "score"])

        return run

    found = materialize_all((met.select("q", "d", "v").mapInArrow(scan(*block), PAIRS) for block in _token_blocks(query_tokens)), "pairs")
    return doc_tokens.sparkSession.createDataFrame([], PAIRS) if found is None else found


def maxsim_topk(doc_tokens: DataFrame, query_tokens: DataFrame, k: int) -> DataFrame:
    """(q, d, score, rank): the k documents of each query with the greatest sum, over its tokens, of the best score in the document.

    Documents' tokens are brought together once; then every block of queries is one pass in which a task sums whole
    documents and keeps k per query, so no score of a pair leaves it."""
    base = materialize(doc_tokens.select("d", "v").where("v is not null").repartition("d").sortWithinPartitions("d"), "tokens")

    def scan(qs: np.ndarray, qt: np.ndarray, m: np.ndarray):
        names, first = np.unique(qs, return_index=True)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = RunningTopK(len(names), k)
            ids, rows = np.zeros(0, np.int64), np.zeros((0, m.shape[1]))
            for batch in [*_then_none(batches)]:
                if batch is not None and batch.num_rows:
                    ids, rows = np.append(ids, batch.column(0).to_numpy()), np.concatenate([rows, _matrix(batch.column(1))])
                if not len(ids):
                    continue
                # The last document may go on in the next batch.
                whole = len(ids) if batch is None else int(np.searchsorted(ids, ids[-1]))
                for lo in _document_cuts(ids[:whole]):
                    part = slice(*lo)
                    starts = np.flatnonzero(np.append(True, np.diff(ids[part]) != 0))
                    tokens = np.round(np.maximum.reduceat(m @ rows[part].T, starts, axis=1), 6)
                    best.add(ids[part][starts], np.round(np.add.reduceat(tokens, first, axis=0), 6))
                ids, rows = ids[whole:], rows[whole:]
            yield pa.RecordBatch.from_arrays([pa.array(names[best.q]), pa.array(best.ids), pa.array(best.scores)], names=["q", "d", "score"])

        return run

    found = materialize_all((base.mapInArrow(scan(*block), "q bigint, d bigint, score double") for block in _token_blocks(query_tokens)), "maxsim")
    if found is None:
        return doc_tokens.sparkSession.createDataFrame([], "q bigint, d bigint, score double, rank bigint")
    return rank_by_score(found, k, "q", "d")


def _then_none(batches: Iterator) -> Iterator:
    yield from batches
    yield None


def _document_cuts(ids: np.ndarray) -> Iterator[tuple[int, int]]:
    """Pieces of about ROW_BLOCK rows of sorted ids, whole documents each."""
    lo = 0
    while lo < len(ids):
        hi = min(len(ids), lo + ROW_BLOCK)
        hi = int(np.searchsorted(ids, ids[hi - 1], "right"))
        yield lo, hi
        lo = hi


class ResidualCodec:
    """Vectors as the number of their nearest centroid and a few bits for each dimension of what is left: the bits tell
    between which cutoffs the rest lies. Decoding puts a weight in their place and scales to unit length."""

    def __init__(self, centroids: DataFrame, cutoffs: list[float], weights: list[float]):
        self.bits = max(1, (len(weights) - 1).bit_length())
        if len(weights) != 1 << self.bits or len(cutoffs) != len(weights) - 1:
            raise ValueError("a codec of b bits has 2^b weights and one cutoff less")
        table = sorted(centroids.select("cid", "centroid").limit(MOST_CENTROIDS + 1).collect())
        if len(table) > MOST_CENTROIDS:
            raise ValueError(f"an index has at most {MOST_CENTROIDS} centroids")
        self.cids = np.array([r["cid"] for r in table], np.int64)
        self.centroids = np.array([r["centroid"] for r in table], np.float64).reshape(len(table), -1)
        self.cutoffs, self.weights = np.array(cutoffs, np.float64), np.array(weights, np.float64)

    def pack(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places of the centroids, packed bits) of the rows of a matrix; equal scores go to the smaller centroid."""
        at = np.round(v @ self.centroids.T, 6).argmax(1)
        bucket = np.searchsorted(self.cutoffs, v - self.centroids[at], "left").astype(np.uint8)
        bits = (bucket[:, :, None] >> np.arange(self.bits - 1, -1, -1, dtype=np.uint8)) & 1
        return at, np.packbits(bits.reshape(len(v), -1), axis=1)

    def unpack(self, at: np.ndarray, packed: np.ndarray) -> np.ndarray:
        size = self.centroids.shape[1]
        bits = np.unpackbits(packed, axis=1, count=size * self.bits).reshape(len(packed), size, self.bits)
        bucket = (bits * (1 << np.arange(self.bits - 1, -1, -1))).sum(2)
        return _unit(self.centroids[at] + self.weights[bucket])

    def encode(self, vectors: DataFrame, ids: list[str], vector: str = "embedding") -> DataFrame:
        """(ids.., code, packed) of every vector; NULL vectors have none."""
        base = vectors.where(F.col(vector).isNotNull()).select(*ids, F.col(vector).alias("_v"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    at, packed = self.pack(_matrix(batch.column(len(ids))))
                    raw, width = packed.tobytes(), packed.shape[1]
                    rows = pa.array([raw[i * width : (i + 1) * width] for i in range(len(at))], pa.binary())
                    yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(self.cids[at]), rows], names=[*ids, "code", "packed"])

        return base.mapInArrow(run, self._kinds(base, ids) + "code bigint, packed binary")

    def decode(self, coded: DataFrame, ids: list[str]) -> DataFrame:
        """(ids.., code, v) of the rows of `encode`."""
        base = coded.select(*ids, "code", "packed")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    packed = np.frombuffer(b"".join(batch.column(len(ids) + 1).to_pylist()), np.uint8).reshape(batch.num_rows, -1)
                    v = self.unpack(np.searchsorted(self.cids, batch.column(len(ids)).to_numpy()), packed)
                    yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.FixedSizeListArray.from_arrays(pa.array(v.ravel()), v.shape[1]).cast(pa.list_(pa.float64()))], names=[*ids, "code", "v"])

        return base.mapInArrow(run, self._kinds(base, ids) + "code bigint, v array<double>")

    @staticmethod
    def _kinds(df: DataFrame, ids: list[str]) -> str:
        kinds = dict(df.dtypes)
        return "".join(f"`{c}` {kinds[c]}, " for c in ids)


def search_all(coded: DataFrame, codec: ResidualCodec, query_tokens: DataFrame, k: int, ncells: int) -> DataFrame:
    """(q, d, score, rank) of all queries in one plan. coded: (d, tok, code, packed). A document is a candidate if a token of it has
    one of the ncells best centroids of a token of the query; candidates are scored on their decoded vectors."""
    spark = coded.sparkSession
    centroids = spark.createDataFrame([(int(c), v.tolist()) for c, v in zip(codec.cids, codec.centroids)], "cid bigint, centroid array<double>")
    cells = centroid_scores(query_tokens, centroids, ["q", "qtok"], "v", ncells).select("q", F.col("cid").alias("code")).distinct()
    candidates = materialize(cells.join(coded.select("code", "d").distinct(), "code").select("q", "d").distinct(), "candidates")
    wanted = coded.join(candidates.select("d").distinct(), "d", "left_semi")
    return rank_by_score(token_maxima(candidate_scores(codec.decode(wanted, ["d", "tok"]), query_tokens, candidates)), k, "q", "d")


def plaid_cascade(doc_tokens: DataFrame, query_tokens: DataFrame, centroids: DataFrame, threshold: float, ndocs: int, k: int) -> DataFrame:
    """Three stages on tables (d, tok, code, v) and (q, qtok, v): centroid scores above the threshold, all
    centroid scores, then exact token maxima; each keeps fewer documents per query."""
    qc = centroid_scores(query_tokens, centroids, ["q", "qtok"], "v").withColumnRenamed("cid", "code")
    codes = doc_tokens.select("d", "code").distinct()
    seen = codes.join(qc.where(F.col("score") >= threshold), "code")
    first = rank_by_score(token_maxima(seen), ndocs, "q", "d").select("q", "d")
    second = rank_by_score(token_maxima(codes.join(first, "d").join(qc, ["q", "code"])), max(1, ndocs // 4), "q", "d").select("q", "d")
    return rank_by_score(token_maxima(candidate_scores(doc_tokens, query_tokens, materialize(second, "second"))), k, "q", "d")
