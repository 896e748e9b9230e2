"""Sparse retrieval, ranking algebra and retrieval metrics: mined queries against the documents."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from answerforge import components
from answerforge.functions.text import space_tokens
from answerforge.operators import evaluate, ranking, sparse
from answerforge.plans.registry import query
from answerforge.session import materialize, own_folder, table

WORDS = "list_filter(string_split_regex(lower({c}), '[^a-z0-9]+'), lambda t: t <> '')"


def bm25_sql(k1: float, k: int) -> str:
    return f"""
q as (select id as qid, unnest({WORDS.format(c="query")}) as term from retrieval_triples where query is not null),
qt as (select qid, term, count(*) as qtf from q group by 1, 2),
d as (select doc_id, {WORDS.format(c="text")} as ws from documents where text is not null),
n as (select count(*)::double as n, avg(len(ws)) as a from d),
p as (select doc_id, len(ws) as dl, unnest(ws) as term from d),
tf as (select doc_id, term, dl, count(*) as tf from p where term in (select term from qt) group by 1, 2, 3),
idf as (select term, ln(1 + ((select n from n) - count(*) + 0.5) / (count(*) + 0.5)) as idf from tf group by 1),
s as (select qid, doc_id, round(sum(qtf * idf * tf / (tf + {k1} * (1 - 0.4 + 0.4 * dl / (select a from n)))), 6) as score from qt join idf using (term) join tf using (term) group by 1, 2),
bm as (select qid, doc_id, score, rank from (select *, row_number() over (partition by qid order by score desc, doc_id) as rank from s) where rank <= {k})"""


CLOSE = """jud as (select qid, doc_id from (select qid, doc_id, row_number() over (partition by qid order by md5(concat_ws('|', qid, doc_id::varchar, '5'))) as n from bm) where n <= 2)"""
BM10 = "with " + bm25_sql(0.9, 10)


def _bm25_rankings(spark: SparkSession, d: str, parameters: list[tuple[float, float]], k: int = 10) -> list[DataFrame]:
    docs = table(spark, d, "documents").select("doc_id", "text")
    queries = table(spark, d, "retrieval_triples").select(F.col("id").alias("qid"), "query").where("query is not null")
    return sparse.bm25_rankings(docs, queries, parameters, k)


def _bm25(spark: SparkSession, d: str, k1: float = 0.9, k: int = 10) -> DataFrame:
    return _bm25_rankings(spark, d, [(k1, 0.4)], k)[0]


def _judged(run: DataFrame) -> DataFrame:
    """Stand-in judgements: two documents of each query's ranking, by hash."""
    return ranking.take_by_hash(run.withColumn("key", F.concat_ws("|", "qid", "doc_id")), "key", 2, ["qid"], 5).select("qid", "doc_id")


def _run(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    run = materialize(_bm25(spark, d), "run")
    return run, _judged(run)


@query(BM10 + " select qid, doc_id, score, rank from bm")
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return _bm25(spark, d)


@query(BM10 + " select qid, doc_id, score, rank from bm")
def bm25_index_topk(spark: SparkSession, d: str) -> DataFrame:
    """The same ranking from an index that is built first, then opened by its folder."""
    path = f"{own_folder(spark)}/index-{uuid.uuid4().hex}"
    sparse.BM25Index.build(table(spark, d, "documents").select("doc_id", "text"), path)
    queries = table(spark, d, "retrieval_triples").select(F.col("id").alias("qid"), "query")
    return sparse.BM25Index(spark, path).search(queries, 10)


PAIRS = f"""p as (select id as qid, query, positive as x from retrieval_triples where positive is not null union all select id, query, unnest(negatives) from retrieval_triples),
w as (select distinct qid, x.pid as doc_id, query, case when coalesce(x.title, '') <> '' then concat_ws(chr(10) || chr(10), x.title, x.text) else coalesce(x.text, '') end as passage from p where x is not null and x.pid is not null),
best as (select qid, doc_id, max(passage) as passage, any_value(query) as query from w group by 1, 2),
sc as (select qid, doc_id, list_distinct({WORDS.format(c="query")}) as q, list_distinct({WORDS.format(c="passage")}) as t from best),
scored as (select qid, doc_id, round(coalesce(len(list_intersect(q, t))::double / nullif(len(q), 0), 0), 6) as score from sc)"""


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    """(qid, doc_id, query, text): every query with its positive and negative passages, one text for a passage id."""
    t = table(spark, d, "retrieval_triples")
    each = t.select(F.col("id").alias("qid"), "query", F.col("positive").alias("x")).unionByName(
        t.select(F.col("id").alias("qid"), "query", F.explode("negatives").alias("n")).select("qid", "query", F.struct("n.pid", "n.title", "n.text").alias("x"))
    )
    given = each.where("x is not null and x.pid is not null").select("qid", F.col("x.pid").alias("doc_id"), "query", F.col("x.title").alias("title"), F.col("x.text").alias("text"))
    passages = given.select("qid", "doc_id", "query", F.coalesce(components.passage_text(given), F.lit("")).alias("text"))
    return passages.groupBy("qid", "doc_id").agg(F.max("text").alias("text"), F.first("query").alias("query"))


@query(f"with {PAIRS} select qid, doc_id, score, rank from (select *, row_number() over (partition by qid order by score desc, doc_id) as rank from scored) where rank <= 5")
def rerank_pairs(spark: SparkSession, d: str) -> DataFrame:
    """The mined passages of each query, ranked anew by a pluggable scorer and cut."""
    return components.OverlapReranker(keep=5).rerank(_pairs(spark, d))


@query(f"with {PAIRS} select qid, count(*) as passages, string_agg(doc_id || ':' || printf('%.6f', score), ',' order by score desc, doc_id) as scores from scored group by 1")
def distillation_scores(spark: SparkSession, d: str) -> DataFrame:
    """All scored passages of each query, best first."""
    lists = components.distillation_scores(_pairs(spark, d), components.OverlapScorer())
    text = F.array_join(F.transform("scores", lambda x: F.concat(x["doc_id"], F.lit(":"), F.format_string("%.6f", x["score"]))), ",")
    return lists.select("qid", F.size("scores").cast("bigint").alias("passages"), text.alias("scores"))


@query("with " + bm25_sql(0.8, 10) + " select qid, doc_id, score, rank from bm")
def bm25_topk_k08(spark: SparkSession, d: str) -> DataFrame:
    return _bm25(spark, d, 0.8)


@query(f"with p as (select doc_id, unnest({WORDS.format(c='text')}) as term from documents where text is not null), tf as (select doc_id, term, count(*) as tf from p group by 1, 2) select term, count(*) as df, sum(tf)::bigint as cf from tf group by 1")
def term_statistics(spark: SparkSession, d: str) -> DataFrame:
    return sparse.term_statistics(table(spark, d, "documents"), "doc_id", "text")


@query(f"select doc_id, len({WORDS.format(c='text')}) as dl from documents where text is not null")
def doc_lengths(spark: SparkSession, d: str) -> DataFrame:
    return sparse.doc_lengths(table(spark, d, "documents").where("text is not null"), "doc_id", "text")


@query(f"""with a as (with {bm25_sql(0.9, 10)} select * from bm), b as (with {bm25_sql(0.8, 10)} select * from bm), u as (select * from a union all select * from b)
select qid, doc_id, score, new_rank as rank from (select qid, doc_id, score, row_number() over (partition by qid order by score desc, rank desc, doc_id desc) as new_rank from u) where new_rank <= 10""")
def merge_rankings(spark: SparkSession, d: str) -> DataFrame:
    """Two rankings of different parameters merged."""
    return ranking.merge_rankings(_bm25_rankings(spark, d, [(0.9, 0.4), (0.8, 0.4)]), 10)


@query(BM10 + ", u as (select * from bm union all select qid, doc_id, score, rank + 1 as rank from bm where rank <= 5) select qid, doc_id, score, rank from (select qid, doc_id, score, row_number() over (partition by qid order by score desc, u.rank desc, doc_id desc) as rank from u) where rank <= 12")
def union_rankings(spark: SparkSession, d: str) -> DataFrame:
    run, _ = _run(spark, d)
    return ranking.merge_rankings([run, run.where("rank <= 5").withColumn("rank", F.col("rank") + 1)], 12)


@query(BM10 + " select hash_q % 7 as qid, hash_q // 7 - 1 as split, doc_id, rank from (select *, (('0x' || substr(md5(qid), 1, 6))::bigint) as hash_q from bm)")
def ranking_split_offset(spark: SparkSession, d: str) -> DataFrame:
    number = F.conv(F.substring(F.md5("qid"), 1, 6), 16, 10).cast("bigint")
    return ranking.split_by_offset(_bm25(spark, d).withColumn("qid", number), 7).select("qid", "split", "doc_id", "rank")


@query(BM10 + ", o as (select id as qid, case when substr(md5(id), 1, 1) < '8' then 'a' else 'b' end as owner from retrieval_triples) select bm.*, owner from bm join o using (qid)")
def ranking_split_queries(spark: SparkSession, d: str) -> DataFrame:
    owners = table(spark, d, "retrieval_triples").select(F.col("id").alias("qid"), F.when(F.substring(F.md5("id"), 1, 1) < "8", "a").otherwise("b").alias("owner"))
    return ranking.split_by_queries(_bm25(spark, d), owners)


@query(BM10 + " select qid, doc_id, score, rank from bm where rank <= 3")
def ranking_first_hits(spark: SparkSession, d: str) -> DataFrame:
    return ranking.first_hits(_bm25(spark, d), 3)


@query(BM10 + " select qid, count(*) as rows, 0::bigint as gaps from bm group by 1")
def rank_contiguity(spark: SparkSession, d: str) -> DataFrame:
    return ranking.contiguous_ranks(_bm25(spark, d))


@query(BM10 + " select bm.qid, bm.rank, doc_id, title, coalesce(title, '') || ' | ' || text as passage from bm join documents using (doc_id)")
def attach_documents(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").withColumn("passage", F.concat(F.coalesce("title", F.lit("")), F.lit(" | "), "text"))
    return ranking.with_document(_bm25(spark, d), docs, ["title", "passage"]).select("qid", "rank", "doc_id", "title", "passage")


@query(BM10 + " select qid, string_agg(doc_id::varchar, ',' order by rank) as docs from bm where rank <= 5 group by 1")
def hit_lists(spark: SparkSession, d: str) -> DataFrame:
    return ranking.hit_lists(_bm25(spark, d), 5).select("qid", F.array_join(F.transform("docs", lambda x: x.cast("string")), ",").alias("docs"))


@query(BM10 + " select qid, lang, to_json(list(doc_id order by rank))::varchar as ctxs from (select bm.qid, bm.rank, bm.doc_id, 'en' as lang from bm join documents using (doc_id) where rank <= 4 and text is not null) group by 1, 2")
def xor_format(spark: SparkSession, d: str) -> DataFrame:
    hits = ranking.with_document(_bm25(spark, d), table(spark, d, "documents"), ["text"]).where("text is not null")
    return ranking.hit_lists(hits, 4).select("qid", F.lit("en").alias("lang"), F.to_json("docs").alias("ctxs"))


@query(BM10 + """ select t.id as qid, coalesce(h.n, 0) as passages from retrieval_triples t left join (select qid, count(*) as n from bm group by 1) h on h.qid = t.id""")
def questions_with_hits(spark: SparkSession, d: str) -> DataFrame:
    counts = _bm25(spark, d).groupBy("qid").agg(F.count("*").alias("n"))
    return table(spark, d, "retrieval_triples").select(F.col("id").alias("qid")).join(counts, "qid", "left").select("qid", F.coalesce("n", F.lit(0)).alias("passages"))


@query(BM10 + " select qid, 'Question: ' || any_value(t.query) || ' Context: ' || string_agg(d.title, ', ' order by rank) as prompt from bm join documents d using (doc_id) join retrieval_triples t on t.id = qid where rank <= 3 and d.title is not null group by 1")
def ctx_prompt(spark: SparkSession, d: str) -> DataFrame:
    """Prompt of a question and its contexts, in rank order."""
    hits = ranking.with_document(_bm25(spark, d, k=3), table(spark, d, "documents"), ["title"]).where("title is not null")
    lists = hits.groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "title"))), lambda x: x["title"]), ", ").alias("ctx"))
    asked = table(spark, d, "retrieval_triples").select(F.col("id").alias("qid"), "query")
    return lists.join(asked, "qid").select("qid", F.concat(F.lit("Question: "), "query", F.lit(" Context: "), "ctx").alias("prompt"))


JUDGED = BM10 + ", " + CLOSE


@query(JUDGED + """, per as (select j.qid, n_rel, f, h1, h5, h10 from (select qid, count(*) as n_rel from jud group by 1) j left join (select qid, min(rank) as f, sum((rank <= 1)::int) as h1, sum((rank <= 5)::int) as h5, sum((rank <= 10)::int) as h10 from bm semi join jud using (qid, doc_id) group by 1) h using (qid)),
e as (select d as depth, case when f <= d then 1.0::double / f else 0 end as rr, case when f <= d then 1.0::double else 0 end as hit, (case d when 1 then h1 when 5 then h5 else h10 end)::double / n_rel as rec from per, (values (1::bigint), (5), (10)) v(d))
select depth, round(avg(rr), 6) as mrr, round(avg(hit), 6) as success, round(avg(rec), 6) as recall, count(*) as queries from e group by 1""")
def mrr_recall_success(spark: SparkSession, d: str) -> DataFrame:
    run, judged = _run(spark, d)
    return evaluate.mrr_success_recall(run, judged, [1, 5, 10])


@query(JUDGED + """, g as (select qid, sum(1.0::double / log2(rank + 1)) as dcg from bm semi join jud using (qid, doc_id) group by 1), n as (select qid, count(*) as n from jud group by 1),
i as (select 1 as n, 1.0::double as ideal union all select 2, 1.0::double + 1.0::double / log2(3))
select round(avg(coalesce(dcg, 0) / ideal), 6) as ndcg, count(*) as queries from n join i using (n) left join g using (qid)""".replace("n as (select qid, count(*) as n from jud", "nj as (select qid, count(*) as n from jud").replace("from n join i", "from nj join i"))
def ndcg_at_10(spark: SparkSession, d: str) -> DataFrame:
    run, judged = _run(spark, d)
    return evaluate.ndcg(run, judged, 10)


@query(JUDGED + """, f as (select qid, min(rank) as f from bm semi join jud using (qid, doc_id) group by 1)
select round(sum(case when f <= 10 then 1.0::double / f else 0 end) / (select count(distinct qid) from jud), 6) as mrr_judged, round(sum(case when f <= 10 then 1.0::double / f else 0 end) / (select count(distinct id) from retrieval_triples), 6) as mrr_all, (select count(distinct qid) from jud) as judged, (select count(distinct qid) from bm) as ranked from f""")
def msmarco_eval(spark: SparkSession, d: str) -> DataFrame:
    """Mean reciprocal rank over the judged queries and over all."""
    run, judged = _run(spark, d)
    # One row per query from each side, then one aggregate: no join of totals.
    judged_rows = evaluate.first_relevant(run, judged).select(F.when(F.col("first_rank") <= 10, 1.0 / F.col("first_rank")).otherwise(0.0).alias("rr"), F.lit(1).alias("j"))
    ranked_rows = run.select("qid").distinct().select(F.lit(0.0).alias("rr"), F.lit(1).alias("r"))
    asked_rows = table(spark, d, "retrieval_triples").select("id").distinct().select(F.lit(0.0).alias("rr"), F.lit(1).alias("a"))
    all_rows = judged_rows.unionByName(ranked_rows, allowMissingColumns=True).unionByName(asked_rows, allowMissingColumns=True)
    return all_rows.agg(F.sum("rr").alias("s"), F.count("j").alias("judged"), F.count("r").alias("ranked"), F.count("a").alias("asked")).select(F.round(F.col("s") / F.col("judged"), 6).alias("mrr_judged"), F.round(F.col("s") / F.col("asked"), 6).alias("mrr_all"), "judged", "ranked")


@query(JUDGED + """, f as (select qid, min(rank) as f from bm semi join jud using (qid, doc_id) group by 1) select floor(1000 * avg((f <= 1)::int)) / 1000 as success_1, floor(1000 * avg((f <= 5)::int)) / 1000 as success_5, floor(1000 * avg((f <= 10)::int)) / 1000 as success_10 from (select distinct qid from jud) left join f using (qid)""")
def success_at_k(spark: SparkSession, d: str) -> DataFrame:
    """Success at ranks, truncated to three decimals."""
    run, judged = _run(spark, d)
    per = evaluate.first_relevant(run, judged)
    return per.agg(*[(F.floor(1000 * F.avg(F.coalesce((F.col("first_rank") <= k).cast("int"), F.lit(0)))) / 1000).alias(f"success_{k}") for k in (1, 5, 10)])


@query(f"""with t as (select id, {WORDS.format(c="coalesce(positive.title, '')")} as a, positive.text as body from retrieval_triples where positive is not null)
select id, case when len(a) = 0 then true else contains(' ' || array_to_string({WORDS.format(c="body")}, ' ') || ' ', ' ' || array_to_string(a, ' ') || ' ') end as found from t where body is not null""")
def has_answer(spark: SparkSession, d: str) -> DataFrame:
    from answerforge.functions.text import has_answer as holds

    rows = table(spark, d, "retrieval_triples").where("positive is not null and positive.text is not null")
    return rows.select("id", holds(F.col("positive.text"), F.coalesce("positive.title", F.lit(""))).alias("found"))


@query(JUDGED + """, l as (select bm.qid, rank, (j.doc_id is not null)::int as label from bm left join jud j on j.qid = bm.qid and j.doc_id = bm.doc_id)
select cut, sum(s) as success, sum(c) as counts from (select qid, cut, max(case when rank <= cut then label else 0 end)::bigint as s, sum(case when rank <= cut then label else 0 end)::bigint as c from l, (values (1::bigint), (5), (10)) v(cut) group by 1, 2) group by 1""".replace("sum(s) as success, sum(c) as counts", "sum(s)::bigint as success, sum(c)::bigint as counts"))
def annotate_answers(spark: SparkSession, d: str) -> DataFrame:
    """Queries with a labelled hit, and labelled hits, up to each cutoff."""
    run, judged = _run(spark, d)
    marked = run.join(judged.withColumn("label", F.lit(1)), ["qid", "doc_id"], "left")
    per = marked.withColumn("cut", F.explode(F.array(F.lit(1), F.lit(5), F.lit(10)))).withColumn("hit", F.when(F.col("rank") <= F.col("cut"), F.coalesce("label", F.lit(0))).otherwise(0))
    each = per.groupBy("qid", "cut").agg(F.max("hit").alias("s"), F.sum("hit").alias("c"))
    return each.groupBy(F.col("cut").cast("bigint").alias("cut")).agg(F.sum("s").alias("success"), F.sum("c").alias("counts"))


@query(JUDGED + """, m as (select bm.qid, bm.doc_id, j.doc_id is not null as rel from bm left join jud j on j.qid = bm.qid and j.doc_id = bm.doc_id),
n as (select qid, doc_id from (select *, row_number() over (partition by qid order by md5(concat_ws('|', qid, doc_id::varchar, '13')), doc_id) as n from m where not rel) where n <= 3)
select p.qid, p.doc_id as pos, n.doc_id as neg from m p join n using (qid) where p.rel""".replace("n as (select qid, doc_id from (", "ng as (select qid, doc_id from (").replace("n.doc_id as neg from m p join n using", "ng.doc_id as neg from m p join ng using"))
def mine_triples(spark: SparkSession, d: str) -> DataFrame:
    run, judged = _run(spark, d)
    return ranking.mine_triples(run, judged, 3)


@query(BM10 + " select p.qid, p.doc_id as pos, n.doc_id as neg from bm p join bm n using (qid) where p.rank <= 2 and n.rank > 5 and n.rank <= 10")
def self_training_triples(spark: SparkSession, d: str) -> DataFrame:
    return ranking.self_training_triples(materialize(_bm25(spark, d), "run"), 2, 5, 10)


@query("select id as qid, pos_text as pos, neg_text as neg, query from (select id, query, positive.title || ' | ' || positive.text as pos_text, unnest(negatives) as n from retrieval_triples where positive is not null), lateral (select n.title || ' | ' || n.text as neg_text) where n is not null")
def triples_to_text(spark: SparkSession, d: str) -> DataFrame:
    """Query, positive and each negative as texts with their titles."""
    rows = table(spark, d, "retrieval_triples").where("positive is not null").withColumn("n", F.explode("negatives")).where("n is not null")
    join = lambda c: F.concat(F.col(f"{c}.title"), F.lit(" | "), F.col(f"{c}.text"))
    return rows.select(F.col("id").alias("qid"), join("positive").alias("pos"), join("n").alias("neg"), "query")


@query("select pid, count(*) as uses, count(distinct id) as queries from (select id, unnest(negatives) as n from retrieval_triples), lateral (select n.pid as pid) where n is not null group by 1")
def negative_usage(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "retrieval_triples").select("id", F.explode("negatives").alias("n")).where("n is not null")
    return rows.groupBy(F.col("n.pid").alias("pid")).agg(F.count("*").alias("uses"), F.countDistinct("id").alias("queries"))


@query("select count(*) as queries, round(avg(n), 2) as average from (select id, (select count(*) from unnest(negatives) t(x) where x is not null) as n from retrieval_triples where negatives is not null)")
def average_positives(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "retrieval_triples").where("negatives is not null").select(F.size(F.filter("negatives", lambda x: x.isNotNull())).alias("n"))
    return rows.agg(F.count("*").alias("queries"), F.round(F.avg("n"), 2).alias("average"))


@query("select * from (select id, query from retrieval_triples where query is not null order by md5(concat_ws('|', id, '3')), id limit 50)")
def holdout_queries(spark: SparkSession, d: str) -> DataFrame:
    """A holdout of exactly 50 queries: the sampling operator."""
    return ranking.take_by_hash(table(spark, d, "retrieval_triples").select("id", "query").where("query is not null"), "id", 50, seed=3)


PASSAGES = """with w as (select doc_id, list_filter(string_split_regex(text, '\\s+'), lambda t: t <> '') as ws from documents where text is not null),
o as (select doc_id, ws, len(ws) as n, unnest(case when len(ws) <= 100 then [0] else range(0, len(ws) - 10, 90) end) as off from w where len(ws) > 10)
select doc_id, off, """


@query(PASSAGES + "array_to_string(case when n <= 100 then ws else list_slice(list_concat(ws, ws), off + 1, off + 100) end, ' ') as passage from o")
def docs2passages(spark: SparkSession, d: str) -> DataFrame:
    from answerforge.operators.passages import docs2passages as windows

    return windows(table(spark, d, "documents"), "doc_id", "text", 100, 10)


@query(PASSAGES + "row_number() over (order by doc_id, off) as pid from o")
def passage_ids(spark: SparkSession, d: str) -> DataFrame:
    from answerforge.operators.passages import docs2passages as windows
    from answerforge.operators.passages import number_rows

    return number_rows(windows(table(spark, d, "documents"), "doc_id", "text", 100, 10).select("doc_id", "off"), ["doc_id", "off"], "pid")


@query("""with w as (select doc_id, list_filter(string_split_regex(text, '\\s+'), lambda t: t <> '') as ws from documents where text is not null),
o as (select doc_id, len(ws) as n, unnest(range(0, greatest(len(ws) - 64, 0) + 32, 32)) as start from w where len(ws) > 0)
select doc_id, start, least(start + 64, n) as stop, start // 32 as window_idx from o""")
def token_windows(spark: SparkSession, d: str) -> DataFrame:
    from answerforge.operators.passages import token_windows as windows

    return windows(table(spark, d, "documents"), "doc_id", space_tokens(F.col("text")), 64, 32)


@query("""with w as (select doc_id, len(list_filter(string_split_regex(text, '\\s+'), lambda t: t <> '')) as n from documents where text is not null),
o as (select doc_id, unnest(range(0, greatest(n - 64, 0) + 32, 32)) as start, n from w where n > 0),
c as (select doc_id, count(*) as windows from o group by 1)
select doc_id, windows, coalesce(sum(windows) over (order by doc_id rows between unbounded preceding and 1 preceding), 0)::bigint as first_window from c""")
def first_feature_offset(spark: SparkSession, d: str) -> DataFrame:
    """Offset of each document's first window among all windows."""
    from answerforge.operators.passages import prefix_offsets
    from answerforge.operators.passages import token_windows as windows

    per = windows(table(spark, d, "documents"), "doc_id", space_tokens(F.col("text")), 64, 32).groupBy("doc_id").agg(F.count("*").alias("windows"))
    return prefix_offsets(per, "doc_id", "windows", "first_window")
