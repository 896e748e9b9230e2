"""Vector search over the embeddings. Queries are the vectors whose id is divisible by 50."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from answerforge.models.calibration import train_centroids
from answerforge.operators import vectors
from answerforge.operators.prepare import index_sample_size, partition_count
from answerforge.operators.ranking import take_by_hash
from answerforge.plans.registry import query
from answerforge.session import materialize, table

E = "e as (select vec_id, embedding::double[] as v, label from embeddings)"
Q = "q as (select vec_id as qid, v as qv from e where vec_id % 50 = 0)"


def _top(score: str, k: int, extra: str = "", where: str = "true") -> str:
    return f"with {E}, {Q}{extra}, s as (select qid, vec_id, round({score}, 6) as score from q, e where {where}) select qid, vec_id, score, rank from (select *, row_number() over (partition by qid order by score desc, vec_id) as rank from s) where rank <= {k}"


def _load(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, d, "embeddings").where("embedding is not null")
    return e, e.where("vec_id % 50 = 0")


@query(_top("list_cosine_similarity(qv, v)", 5))
def cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    e, q = _load(spark, d)
    return vectors.vector_topk(e, q, 5, "cosine")


@query(_top("list_inner_product(qv, v)", 5))
def dot_topk(spark: SparkSession, d: str) -> DataFrame:
    e, q = _load(spark, d)
    return vectors.vector_topk(e, q, 5, "dot")


@query(_top("-list_distance(list_append(qv, 0.0::double), list_append(v, sqrt(greatest(m - list_inner_product(v, v), 0))))", 5, ", mm as (select max(list_inner_product(v, v)) as m from e)").replace("from q, e where", "from q, e, mm where"))
def l2_converted_topk(spark: SparkSession, d: str) -> DataFrame:
    """Inner-product search as a search by distance: one more dimension makes all norms equal."""
    e, q = _load(spark, d)
    largest = float(e.agg(F.max(vectors.dot(F.col("embedding"), F.col("embedding")))).first()[0] or 0.0)
    longer = e.withColumn("embedding", vectors.l2_augmented(F.col("embedding"), largest))
    asked = q.withColumn("embedding", F.concat(F.transform("embedding", lambda x: x.cast("double")), F.array(F.lit(0.0))))
    return vectors.vector_topk(longer, asked, 5, "l2")


@query(_top("list_inner_product(qv, v)", 7))
def sharded_topk_merge(spark: SparkSession, d: str) -> DataFrame:
    e, q = _load(spark, d)
    return vectors.merge_shards([vectors.vector_topk(e.where(f"pmod(vec_id, 4) = {s}"), q, 7) for s in range(4)], 7)


@query(_top("list_cosine_similarity(qv, v)", 3, where="qid <> vec_id"))
def neighbours_of_stored(spark: SparkSession, d: str) -> DataFrame:
    """Neighbours of stored vectors, themselves left out."""
    e, q = _load(spark, d)
    return vectors.vector_topk(e, q, 3, "cosine", not_self=True)


@query(f"with {E}, {Q} select qid, vec_id, round(list_inner_product(qv, v), 6) as score from q join e on e.vec_id in (qid + 1, qid + 2)")
def rescore_documents(spark: SparkSession, d: str) -> DataFrame:
    """Score of each query with the documents given for it."""
    e, q = _load(spark, d)
    given = q.select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qv"), F.explode(F.array(F.col("vec_id") + 1, F.col("vec_id") + 2)).alias("vec_id"))
    return given.join(e.select("vec_id", "embedding"), "vec_id").select("qid", "vec_id", F.round(vectors.dot(F.col("qv"), F.col("embedding")), 6).alias("score"))


CENT = E + """, px as (select label::bigint as cid, unnest(range(1, len(v) + 1)) as pos, v from e), cm as (select cid, pos, round(avg(v[pos]), 9) as m from px group by 1, 2),
cent as (select cid, list(m order by pos) as centroid from cm group by 1), cs as (select vec_id, cid, round(list_inner_product(v, centroid), 6) as score from e, cent),
code as (select vec_id, cid as code, score from (select *, row_number() over (partition by vec_id order by score desc, cid) as n from cs) where n = 1)"""


def _centroids(e: DataFrame) -> DataFrame:
    return materialize(vectors.centroids_by_label(e), "centroids")


def _codes(e: DataFrame, c: DataFrame) -> DataFrame:
    return vectors.nearest_centroid(e, c)


@query(f"with {CENT} select * from code")
def nearest_centroid(spark: SparkSession, d: str) -> DataFrame:
    e, _ = _load(spark, d)
    return _codes(e, _centroids(e))


@query(f"with {CENT} select vec_id as qtok, cid, score from (select *, row_number() over (partition by vec_id order by score desc, cid) as n from cs where vec_id % 50 = 0) where n <= 2")
def candidate_cells(spark: SparkSession, d: str) -> DataFrame:
    e, q = _load(spark, d)
    return vectors.centroid_scores(q, _centroids(e), n=2).withColumnRenamed("vec_id", "qtok")


@query(f"with {CENT} select code, count(distinct vec_id // 4) as pids, min(vec_id // 4) as first_pid, max(vec_id // 4) as last_pid from code group by 1")
def ivf_lists(spark: SparkSession, d: str) -> DataFrame:
    e, _ = _load(spark, d)
    lists = vectors.inverted_lists(_codes(e, _centroids(e)).withColumn("pid", F.floor(F.col("vec_id") / 4)))
    return lists.groupBy("code").agg(F.count("*").alias("pids"), F.min("pid").alias("first_pid"), F.max("pid").alias("last_pid"))


@query(f"with {CENT}, cells as (select vec_id, cid from (select *, row_number() over (partition by vec_id order by score desc, cid) as n from cs where vec_id % 50 = 0) where n <= 2) select distinct cells.vec_id // 200 as q, code.vec_id // 4 as pid from cells join code on code.code = cells.cid")
def candidate_pids(spark: SparkSession, d: str) -> DataFrame:
    e, q = _load(spark, d)
    c = _centroids(e)
    lists = vectors.inverted_lists(_codes(e, c).withColumn("pid", F.floor(F.col("vec_id") / 4)))
    cells = vectors.centroid_scores(q, c, n=2).select(F.floor(F.col("vec_id") / 200).alias("q"), F.col("cid").alias("code")).distinct()
    return cells.join(lists, "code").select("q", "pid").distinct()


MAX = f"with {E}, p as (select a.vec_id // 200 as q, a.vec_id as qtok, b.vec_id // 4 as d, max(round(list_inner_product(a.v, b.v), 6)) as m from e a, e b where a.vec_id % 50 = 0 group by 1, 2, 3)"


def _tokens(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e, q = _load(spark, d)
    docs = e.select(F.floor(F.col("vec_id") / 4).alias("d"), F.col("vec_id").alias("tok"), F.col("embedding").alias("v"))
    return docs, q.select(F.floor(F.col("vec_id") / 200).alias("q"), F.col("vec_id").alias("qtok"), F.col("embedding").alias("v"))


@query(MAX + ", s as (select q, d, round(sum(m), 6) as score from p group by 1, 2) select q, d, score, rank from (select *, row_number() over (partition by q order by score desc, d) as rank from s) where rank <= 10")
def maxsim(spark: SparkSession, d: str) -> DataFrame:
    return vectors.maxsim_topk(*_tokens(spark, d), 10)


@query(MAX + ", r as (select *, row_number() over (partition by q, d order by m desc, qtok) as n from p) select q, d, round(sum(case when n <= 3 then m else 0 end) + sum(case when n <= 1 then m else 0 end), 6) as score from r group by 1, 2")
def maxsim_flipr(spark: SparkSession, d: str) -> DataFrame:
    """The best query tokens count: the sum of the three best maxima plus the best one again."""
    docs, asked = _tokens(spark, d)
    best = vectors.pair_scores(docs, asked).groupBy("q", "d", "qtok").agg(F.max("score").alias("m"))
    lists = best.groupBy("q", "d").agg(F.sort_array(F.collect_list("m"), asc=False).alias("ms"))
    total = lambda n: F.aggregate(F.slice("ms", 1, n), F.lit(0.0).cast("double"), lambda a, x: a + x)
    return lists.select("q", "d", F.round(total(3) + total(1), 6).alias("score"))


# All residuals, and those of the held-out vectors, which fit cutoffs and weights.
RES = (
    f"with {CENT}, h as (select vec_id from e order by md5(concat_ws('|', vec_id::varchar, '11')), vec_id limit 50000), "
    "rr as (select e.vec_id, code, pos, v[pos] - centroid[pos] as x, centroid[pos] as m from e join code using (vec_id) join cent on cent.cid = code.code, range(1, 65) t(pos)), r as (select * from rr semi join h using (vec_id)), "
    "cut as (select round(quantile_cont(x, 0.25), 5) as a, round(quantile_cont(x, 0.5), 5) as b, round(quantile_cont(x, 0.75), 5) as c, [round(quantile_cont(x, 0.125), 5), round(quantile_cont(x, 0.375), 5), round(quantile_cont(x, 0.625), 5), round(quantile_cont(x, 0.875), 5)] as w from r), "
    "bits as (select rr.*, (x > a)::int + (x > b)::int + (x > c)::int as bucket, w from rr, cut), "
    "ld as (select vec_id, any_value(code) as code, list(m + w[bucket + 1] order by pos) as u from bits group by 1), dec as (select vec_id, code, list_transform(u, lambda x: x / sqrt(list_inner_product(u, u))) as dv from ld)"
)


HELD_OUT = 50_000


def _residuals(e: DataFrame, c: DataFrame) -> DataFrame:
    """(vec_id, pos, x): vector minus its centroid."""
    coded = e.join(_codes(e, c).select("vec_id", "code"), "vec_id").join(F.broadcast(c.select(F.col("cid").alias("code"), "centroid")), "code")
    diff = F.zip_with("embedding", "centroid", lambda a, b: a.cast("double") - b)
    return coded.select("vec_id", F.posexplode(diff).alias("pos", "x"))


def _held_out(e: DataFrame) -> DataFrame:
    """The vectors that fit the cutoffs: at most HELD_OUT, in hash order."""
    return take_by_hash(e, "vec_id", HELD_OUT, seed=11)


@query(RES + " select q, round(quantile_cont(x, q), 5) as cutoff from r, (values (0.25::double), (0.5), (0.75)) v(q) group by 1".replace("quantile_cont(x, q)", "case q when 0.25 then quantile_cont(x, 0.25) when 0.5 then quantile_cont(x, 0.5) else quantile_cont(x, 0.75) end"))
def residual_quantiles(spark: SparkSession, d: str) -> DataFrame:
    """Bucket cutoffs of a 2-bit residual code."""
    e, _ = _load(spark, d)
    cuts = _residuals(_held_out(e), _centroids(e)).agg(F.percentile("x", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("c"))
    return cuts.select(F.explode(F.arrays_zip(F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)).alias("q"), F.col("c").alias("c"))).alias("z")).select(F.col("z.q").alias("q"), F.round("z.c", 5).alias("cutoff"))


@query(RES + " select vec_id, sum(bucket)::bigint as code_sum, count(*) as dims from bits group by 1")
def residual_codes(spark: SparkSession, d: str) -> DataFrame:
    """Each residual as the number of cutoffs below it; here their sum per vector. The cutoffs come from the
    held-out vectors, every vector is coded."""
    e, _ = _load(spark, d)
    c = _centroids(e)
    cuts = [round(x, 5) for x in _residuals(_held_out(e), c).agg(F.percentile("x", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))).first()[0] or []]
    code = sum((F.when(F.col("x") > c, 1).otherwise(0) for c in cuts), F.lit(0))
    return _residuals(e, c).groupBy("vec_id").agg(F.sum(code).cast("bigint").alias("code_sum"), F.count("*").alias("dims"))


def _codec(e: DataFrame, c: DataFrame) -> vectors.ResidualCodec:
    """A codec of 2 bits: cutoffs at the quarters of the held-out residuals, weights amid them."""
    at = [0.25, 0.5, 0.75, 0.125, 0.375, 0.625, 0.875]
    values = [round(x, 5) for x in _residuals(_held_out(e), c).agg(F.percentile("x", F.array(*[F.lit(q) for q in at]))).first()[0] or [0.0] * len(at)]
    return vectors.ResidualCodec(c, values[:3], values[3:])


@query(RES + """, b as (select vec_id, code, (pos - 1) // 4 as octet, sum(bucket << (6 - 2 * ((pos - 1) % 4))) as byte from bits group by 1, 2, 3)
select vec_id, code, string_agg(printf('%02X', byte::int), '' order by octet) as packed from b group by 1, 2""")
def residual_packed(spark: SparkSession, d: str) -> DataFrame:
    """The stored form of every vector: its centroid and four dimensions a byte."""
    e, _ = _load(spark, d)
    return _codec(e, _centroids(e)).encode(e, ["vec_id"]).select("vec_id", "code", F.hex("packed").alias("packed"))


@query(RES + " select vec_id, code, round(list_inner_product(dv, v) / sqrt(list_inner_product(v, v)), 5) as cosine, round(dv[1], 5) as first_value from dec join e using (vec_id)")
def residual_decompressed(spark: SparkSession, d: str) -> DataFrame:
    """Every vector decoded, and how near it is to what was coded."""
    e, _ = _load(spark, d)
    codec = _codec(e, _centroids(e))
    decoded = codec.decode(codec.encode(e, ["vec_id"]), ["vec_id"]).join(e.select("vec_id", "embedding"), "vec_id")
    cosine = vectors.dot(F.col("v"), F.col("embedding")) / vectors.norm(F.col("embedding"))
    return decoded.select("vec_id", "code", F.round(cosine, 5).alias("cosine"), F.round(F.col("v")[0], 5).alias("first_value"))


_DECODED = RES + ", dd as (select vec_id, vec_id // 4 as d, code, dv from dec), qq as (select vec_id // 200 as q, vec_id as qtok, v from e where vec_id % 50 = 0)"


@query(_DECODED + """, cells as (select distinct vec_id // 200 as q, cid from (select *, row_number() over (partition by vec_id order by score desc, cid) as n from cs where vec_id % 50 = 0) where n <= 2),
cand as (select distinct q, d from cells join dd on dd.code = cells.cid), s as (select q, d, qtok, max(round(list_inner_product(qq.v, dd.dv), 6)) as m from cand join qq using (q) join dd using (d) group by 1, 2, 3)
select q, d, score, rank from (select *, row_number() over (partition by q order by score desc, d) as rank from (select q, d, round(sum(m), 6) as score from s group by 1, 2)) where rank <= 10""")
def search_all(spark: SparkSession, d: str) -> DataFrame:
    """All queries in one plan over the compressed vectors: candidates from the lists of two cells a token, then decoded scores."""
    e, _ = _load(spark, d)
    docs, asked = _tokens(spark, d)
    codec = _codec(e, _centroids(e))
    return vectors.search_all(materialize(codec.encode(docs, ["d", "tok"], "v"), "coded"), codec, asked, 10, 2)


@query(_DECODED + """, dt as (select distinct d, code from dd), qc as (select vec_id // 200 as q, vec_id as qtok, cid as code, score from cs where vec_id % 50 = 0), th as (select round(quantile_cont(score, 0.5), 6) as least from qc),
s1 as (select q, d, round(sum(m), 6) as score from (select q, d, qtok, max(score) as m from dt join qc using (code) where score >= (select least from th) group by 1, 2, 3) group by 1, 2),
t1 as (select q, d from (select *, row_number() over (partition by q order by score desc, d) as n from s1) where n <= 40),
s2 as (select q, d, round(sum(m), 6) as score from (select q, d, qtok, max(score) as m from t1 join dt using (d) join qc using (q, code) group by 1, 2, 3) group by 1, 2),
t2 as (select q, d from (select *, row_number() over (partition by q order by score desc, d) as n from s2) where n <= 10),
s3 as (select q, d, round(sum(m), 6) as score from (select q, d, qtok, max(round(list_inner_product(qq.v, dd.dv), 6)) as m from t2 join qq using (q) join dd using (d) group by 1, 2, 3) group by 1, 2)
select q, d, score, rank from (select *, row_number() over (partition by q order by score desc, d) as rank from s3) where rank <= 5""")
def plaid_cascade(spark: SparkSession, d: str) -> DataFrame:
    """Stage 1 counts centroid scores from their median on, which is a quantile as embeddings differ in scale; stage 3 scores decoded vectors."""
    e, _ = _load(spark, d)
    docs, asked = _tokens(spark, d)
    c = _centroids(e)
    codec = _codec(e, c)
    coded = materialize(codec.decode(codec.encode(docs, ["d", "tok"], "v"), ["d", "tok"]), "coded")
    least = vectors.centroid_scores(asked, c, ["q", "qtok"], "v").agg(F.round(F.percentile("score", F.lit(0.5)), 6)).first()[0]
    return vectors.plaid_cascade(coded, asked, c, least or 0.0, 40, 5)


#: Of plaid_search: a code counts in stage 1 from this score on; documents after stage 1 (a quarter after stage 2).
PLAID_THRESHOLD, PLAID_NDOCS = 0.1, 1024


def _index(e: DataFrame) -> DataFrame:
    """Centroids of an index over e: partition_count(n) of them by k-means, on a sample by hash of about
    index_sample_size(n) rows, which grows with the root of n. Only this fit is on a sample."""
    n = e.count()
    share = index_sample_size(n) / max(1, n)
    sample = e if share >= 1 else e.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    return materialize(train_centroids(sample, partition_count(n)), "centroids")


@query()
def plaid_search(spark: SparkSession, d: str) -> DataFrame:
    """The cascade over a k-means index in which every row is coded; k-means has no SQL."""
    e, _ = _load(spark, d)
    docs, asked = _tokens(spark, d)
    c = _index(e)
    coded = docs.join(_codes(e, c).select(F.col("vec_id").alias("tok"), "code"), "tok")
    return vectors.plaid_cascade(materialize(coded, "coded"), asked, c, PLAID_THRESHOLD, PLAID_NDOCS, 5)
