"""Preparation of reader and retriever training data, lookups, and audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from answerforge.functions import text
from answerforge.operators import passages, prepare, ranking, reading
from answerforge.plans.reading_queries import BOTH
from answerforge.plans.registry import query
from answerforge.plans.retrieval_queries import BM10, JUDGED, _bm25, _run
from answerforge.session import materialize, table

TOK = "list_filter(string_split_regex(context, '\\s+'), lambda t: t <> '')"
AT = f"""a as (select qa_key, len({TOK}) as n, case when answers.text is null or len(answers.text) = 0 or position(answers.text[1] in context) = 0 then -1 else len(list_filter(string_split_regex(substr(context, 1, position(answers.text[1] in context) - 1), '\\s+'), lambda t: t <> '')) end as s,
 case when answers.text is null or len(answers.text) = 0 then 0 else len(list_filter(string_split_regex(answers.text[1], '\\s+'), lambda t: t <> '')) end as l from squad_examples where context is not null),
w as (select qa_key, n, s, l, unnest(range(0, greatest(n - 64, 0) + 32, 32)) as start from a where n > 0), ww as (select qa_key, s, l, start, least(start + 64, n) as stop, start // 32 as window_idx from w)"""


def _answer_windows(spark: SparkSession, d: str) -> DataFrame:
    """Windows of each context with the token place of the first answer (-1 without one)."""
    rows = table(spark, d, "squad_examples").where("context is not null")
    answer = F.get(F.col("answers.text"), F.lit(0))
    has = F.coalesce(F.size("answers.text") > 0, F.lit(False))
    rows = rows.withColumn("s", F.when(~has, -1).when(F.expr("locate(get(answers.text, 0), context)") == 0, -1).otherwise(F.size(text.space_tokens(F.expr("substring(context, 1, locate(get(answers.text, 0), context) - 1)")))))
    rows = rows.withColumn("l", F.when(~has, 0).otherwise(F.size(text.space_tokens(answer))))
    windows = passages.token_windows(rows, "qa_key", text.space_tokens(F.col("context")), 64, 32).withColumnRenamed("doc_id", "qa_key")
    return windows.join(rows.select("qa_key", "s", "l"), "qa_key")


@query(f"with {AT} select qa_key, window_idx, case when s >= 0 and s >= start and s + l <= stop then s - start else 0 end as target_start, case when s >= 0 and s >= start and s + l <= stop then s + l - 1 - start else 0 end as target_end, case when s >= 0 and s >= start and s + l <= stop then 'SPAN' else 'NONE' end as target_type, case when s >= 0 and s >= start and s + l <= stop then 'POSITIVE' when s >= 0 then 'NEGATIVE_HAS_ANSWER' else 'NEGATIVE_NO_ANSWER' end as subsample from ww")
def window_targets(spark: SparkSession, d: str) -> DataFrame:
    """Targets of training windows and their class for subsampling."""
    out = prepare.window_targets(_answer_windows(spark, d), F.col("s"), F.col("s") + F.col("l"))
    return out.select("qa_key", "window_idx", "target_start", "target_end", "target_type", "subsample")


@query(f"with {AT}, t as (select qa_key, window_idx, case when s >= 0 and s >= start and s + l <= stop then 'POSITIVE' when s >= 0 then 'NEGATIVE_HAS_ANSWER' else 'NEGATIVE_NO_ANSWER' end as subsample, qa_key || '_' || window_idx as k from ww) select qa_key, window_idx, subsample from t where ('0x' || substr(md5(concat_ws('|', k, '2')), 1, 8))::bigint / 4294967296.0::double < case subsample when 'NEGATIVE_HAS_ANSWER' then 0.3 when 'NEGATIVE_NO_ANSWER' then 0.5 else 1.0 end")
def subsampled_windows(spark: SparkSession, d: str) -> DataFrame:
    """Training windows kept at a rate per class."""
    out = prepare.window_targets(_answer_windows(spark, d), F.col("s"), F.col("s") + F.col("l")).withColumn("k", F.concat_ws("_", "qa_key", "window_idx"))
    return prepare.keep_by_rate(out, "k", {"NEGATIVE_HAS_ANSWER": 0.3, "NEGATIVE_NO_ANSWER": 0.5}, "subsample", 2).select("qa_key", "window_idx", "subsample")


@query(f"with {AT}, c as (select qa_key, s as position, window_idx, row_number() over (partition by qa_key order by round(least(s - start, stop - 1 - s) + 0.01 * (stop - start), 6) desc, window_idx) as n from ww where s >= start and s < stop and s >= 0) select qa_key, position, window_idx from c where n = 1")
def max_context_window(spark: SparkSession, d: str) -> DataFrame:
    """The window in which the answer's first token has most context."""
    rows = _answer_windows(spark, d).where("s >= 0").withColumn("position", F.col("s").cast("bigint"))
    return prepare.best_context(rows, "qa_key", "position")


@query("""with c as (select record_id, long_answer_candidates as c, a.long_answer as l from (select record_id, long_answer_candidates, unnest(annotations) as a from nq_examples) where a is not null and a.long_answer is not null and long_answer_candidates is not null and a.long_answer.start_byte >= 0)
select record_id, l.start_byte as start_byte, len(list_filter(c, lambda x: x is not null and x.start_byte >= 0 and greatest(x.start_byte, l.start_byte) <= least(x.end_byte, l.end_byte))) as crossing from c""")
def spans_intersecting(spark: SparkSession, d: str) -> DataFrame:
    """Candidates that share a byte with each long answer."""
    notes = table(spark, d, "nq_examples").where("long_answer_candidates is not null").select("record_id", "long_answer_candidates", F.explode("annotations").alias("a")).where("a.long_answer.start_byte >= 0")
    start, stop = F.col("a.long_answer.start_byte"), F.col("a.long_answer.end_byte")
    crossing = F.filter("long_answer_candidates", lambda x: x.isNotNull() & (x["start_byte"] >= 0) & prepare.spans_intersect(x["start_byte"], x["end_byte"], start, stop))
    return notes.select("record_id", start.alias("start_byte"), F.size(crossing).cast("bigint").alias("crossing"))


@query("""select record_id, [coalesce(a.long_answer.candidate_index, -1) for a in annotations if a is not null]::varchar as passages, [coalesce(a.yes_no_answer, -1) for a in annotations if a is not null]::varchar as yes_no from nq_examples where annotations is not null""")
def annotation_columns(spark: SparkSession, d: str) -> DataFrame:
    """Annotations turned to parallel arrays, one per field."""
    notes = F.filter("annotations", lambda a: a.isNotNull())
    show = lambda c: F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: x.cast("string")), ", "), F.lit("]"))
    rows = table(spark, d, "nq_examples").where("annotations is not null")
    return rows.select("record_id", show(F.transform(notes, lambda a: F.coalesce(a["long_answer"]["candidate_index"], F.lit(-1)))).alias("passages"), show(F.transform(notes, lambda a: F.coalesce(a["yes_no_answer"], F.lit(-1)))).alias("yes_no"))


@query("""with t as (select record_id, x, i - 1 as i from (select record_id, document.tokens as ts from nq_examples), unnest(ts) with ordinality u(x, i) where x is not null),
s as (select record_id, k, s.start_token as a, s.end_token as b from (select record_id, generate_subscripts(ss, 1) as k, unnest(ss) as s from (select record_id, a.short_answers as ss from (select record_id, unnest(annotations[1:1]) as a from nq_examples) where a is not null)) where s is not null and s.start_token >= 0 and s.end_token > s.start_token)
select s.record_id, k::bigint as item_no, a as start_token, b as end_token, min(i) filter (not coalesce(x.is_html, false)) as first_plain, max(i) filter (not coalesce(x.is_html, false)) as last_plain from s left join t on t.record_id = s.record_id and i >= a and i < b group by 1, 2, 3, 4""")
def trimmed_spans(spark: SparkSession, d: str) -> DataFrame:
    """Short answers of the first annotation moved inward past HTML tokens; NULL where nothing is left."""
    rows = table(spark, d, "nq_examples").select("record_id", F.col("document.tokens").alias("ts"), F.get(F.col("annotations"), F.lit(0)).alias("a"))
    shorts = rows.select("record_id", "ts", F.posexplode("a.short_answers").alias("p", "s")).where("s.start_token >= 0 and s.end_token > s.start_token")
    kept = F.filter(F.transform(F.slice("ts", F.col("s.start_token").cast("int") + 1, (F.col("s.end_token") - F.col("s.start_token")).cast("int")), lambda t, i: F.when(t.isNotNull() & ~F.coalesce(t["is_html"], F.lit(False)), i + F.col("s.start_token"))), lambda i: i.isNotNull())
    return shorts.select("record_id", (F.col("p") + 1).cast("bigint").alias("item_no"), F.col("s.start_token").alias("start_token"), F.col("s.end_token").alias("end_token"), F.array_min(kept).alias("first_plain"), F.array_max(kept).alias("last_plain"))


@query("with " + BOTH + " select case when bool_or(yes_no = 1) then 'yes' when bool_or(yes_no = 0) then 'no' when bool_or(start >= 0) then 'short' when bool_or(passage >= 0) then 'passage' else 'none' end as route, example_id from g1 group by 2")
def boolean_routes(spark: SparkSession, d: str) -> DataFrame:
    """File an example goes to, by what its annotators say."""
    gold = reading.gold_labels(reading.newest_examples(table(spark, d, "nq_examples"))).where(F.size("golds") > 0)
    some = lambda f: F.exists("golds", f)
    route = F.when(some(lambda g: g["yes_no"] == 1), "yes").when(some(lambda g: g["yes_no"] == 0), "no").when(some(lambda g: g["start"] >= 0), "short").when(some(lambda g: g["passage"] >= 0), "passage").otherwise("none")
    return gold.select("example_id", route.alias("route"))


@query("select prediction_id, not (yes_no_answer >= 0 and start_position >= 0) and (start_position < 0) = (end_position < 0) and end_position >= start_position as valid from predictions")
def prediction_validity(spark: SparkSession, d: str) -> DataFrame:
    """A prediction is a span or a yes/no, never both, and its ends belong together."""
    valid = ~((F.col("yes_no_answer") >= 0) & (F.col("start_position") >= 0)) & ((F.col("start_position") < 0) == (F.col("end_position") < 0)) & (F.col("end_position") >= F.col("start_position"))
    return table(spark, d, "predictions").select("prediction_id", valid.alias("valid"))


@query("select qa_key, question, case when lower(trim(split)) = 'train' then answers.text[1] end as train_answer, coalesce(len(answers.text), 0) as answers, answers.text is null or len(answers.text) = 0 as impossible from squad_examples where question is not null")
def squad_processor(spark: SparkSession, d: str) -> DataFrame:
    """Training rows carry the first answer, evaluation rows their number of answers; none: impossible."""
    n = F.greatest(F.coalesce(F.size("answers.text"), F.lit(0)), F.lit(0))
    rows = table(spark, d, "squad_examples").where("question is not null")
    return rows.select("qa_key", "question", F.when(F.lower(F.trim("split")) == "train", F.get(F.col("answers.text"), F.lit(0))).alias("train_answer"), n.cast("bigint").alias("answers"), (n == 0).alias("impossible"))


@query("with a as (select qa_key, context, answers.text[1] as a from squad_examples where context is not null and answers.text is not null and len(answers.text) > 0 and length(answers.text[1]) > 0), p as (select qa_key, a, string_split(context, a) as ps from a), q as (select qa_key, length(a) as n, unnest(range(1, len(ps))) as k, ps from p) select qa_key, (list_sum(list_transform(ps[1:k], lambda x: length(x))) + (k - 1) * n)::bigint as start from q")
def all_answer_spans(spark: SparkSession, d: str) -> DataFrame:
    """Every place at which the first answer stands in its context."""
    rows = table(spark, d, "squad_examples").where("context is not null and size(answers.text) > 0").select("qa_key", "context", F.col("answers.text")[0].alias("a")).where("length(a) > 0")
    parts = rows.select("qa_key", F.length("a").alias("n"), F.split("context", F.concat(F.lit("\\Q"), "a", F.lit("\\E")), -1).alias("ps")).where("size(ps) > 1")
    each = parts.select("qa_key", "n", "ps", F.explode(F.sequence(F.lit(1), F.size("ps") - 1)).alias("k"))
    before = F.aggregate(F.slice("ps", 1, F.col("k")), F.lit(0), lambda acc, x: acc + F.length(x))
    return each.select("qa_key", (before + (F.col("k") - 1) * F.col("n")).cast("bigint").alias("start"))


@query("select title, min(doc_id) as doc_id, count(*) as passages from documents where title is not null group by 1")
def first_by_title(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("title is not null").groupBy("title").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("passages"))


@query(BM10 + " select qid, bm.doc_id, case when d.text is null then 'missing' when d.form = 'passage' then 'first shard' when d.form is not null then 'second shard' else 'missing' end as shard from bm left join documents d using (doc_id)")
def lookup_across_shards(spark: SparkSession, d: str) -> DataFrame:
    """Documents sought in two shards, the first that holds one wins, a dummy where none does."""
    docs = table(spark, d, "documents").where("text is not null")
    first, second = docs.where("form = 'passage'").select("doc_id", F.lit("first shard").alias("a")), docs.where("form <> 'passage'").select("doc_id", F.lit("second shard").alias("b"))
    return _bm25(spark, d).join(first, "doc_id", "left").join(second, "doc_id", "left").select("qid", "doc_id", F.coalesce("a", "b", F.lit("missing")).alias("shard"))


@query("""with n as (select id, x.pid as pid from (select id, unnest(negatives) as x from retrieval_triples) where x is not null), p as (select x.pid as pid, max(length(x.text)) as chars from (select unnest(negatives) as x from retrieval_triples) where x is not null group by 1)
select id, string_agg(pid, ',' order by pid) as pids, sum(chars)::bigint as chars from (select distinct id, pid, chars from n join p using (pid)) group by 1""")
def linked_passages(spark: SparkSession, d: str) -> DataFrame:
    """Links resolved against the passage table and gathered again per record; unknown links drop out."""
    each = table(spark, d, "retrieval_triples").select("id", F.explode("negatives").alias("x")).where("x is not null").select("id", F.col("x.pid").alias("pid"), F.length("x.text").alias("n"))
    known = each.groupBy("pid").agg(F.max("n").alias("chars"))
    found = each.select("id", "pid").distinct().join(known, "pid")
    return found.groupBy("id").agg(F.array_join(F.array_sort(F.collect_list("pid")), ",").alias("pids"), F.sum("chars").cast("bigint").alias("chars"))


@query(JUDGED + " select qid, doc_id, rank, label, count(*) filter (label = 1) over (partition by qid) as positives from (select bm.*, (j.doc_id is not null)::int::bigint as label from bm left join jud j on j.qid = bm.qid and j.doc_id = bm.doc_id)".replace("select qid, doc_id, rank, label,", "select qid, doc_id, rank, label,"))
def labelled_ranking(spark: SparkSession, d: str) -> DataFrame:
    """A ranking with its labels and each query's number of positives."""
    run, judged = _run(spark, d)
    marked = run.join(judged.withColumn("l", F.lit(1)), ["qid", "doc_id"], "left").withColumn("label", F.coalesce("l", F.lit(0)).cast("bigint"))
    return marked.select("qid", "doc_id", "rank", "label", F.sum("label").over(Window.partitionBy("qid")).alias("positives"))


@query(JUDGED + " select (select count(distinct qid) from jud) as judged, (select count(distinct qid) from bm) as ranked, (select count(*) from (select distinct qid from bm) anti join (select distinct qid from jud) using (qid)) as unjudged")
def query_coverage(spark: SparkSession, d: str) -> DataFrame:
    run, judged = _run(spark, d)
    j = judged.select("qid", F.lit(True).alias("j")).distinct()
    both = run.select("qid", F.lit(True).alias("r")).distinct().join(j, "qid", "full")
    return both.agg(F.count("j").alias("judged"), F.count("r").alias("ranked"), F.count(F.when(F.col("j").isNull(), 1)).alias("unjudged"))


@query(BM10 + ", t as (select distinct doc_id from bm where rank <= 3) select d.doc_id, d.title from documents d semi join t using (doc_id)")
def minicorpus(spark: SparkSession, d: str) -> DataFrame:
    """The documents any query needs in its first three hits."""
    keep = _bm25(spark, d, k=3).select("doc_id").distinct()
    return table(spark, d, "documents").join(keep, "doc_id", "left_semi").select("doc_id", "title")


@query(JUDGED + """, l as (select bm.qid, bm.doc_id, bm.rank, j.doc_id is not null as pos from bm left join jud j on j.qid = bm.qid and j.doc_id = bm.doc_id), n as (select qid, doc_id, row_number() over (partition by qid order by rank) as rn from l where not pos)
select p.qid, p.doc_id as pos, (rn - 1) // 4 as part, string_agg(n.doc_id::varchar, ',' order by rn) as negs from l p join n using (qid) where p.pos and (rn - 1) // 4 < 2 group by 1, 2, 3""".replace(", n as (select qid, doc_id, row_number()", ", ng as (select qid, doc_id, row_number()").replace("join n using (qid)", "join ng n using (qid)"))
def distillation_groups(spark: SparkSession, d: str) -> DataFrame:
    """Each positive with windows of four negatives in rank order, two windows at most."""
    run, judged = _run(spark, d)
    marked = run.join(judged.withColumn("p", F.lit(True)), ["qid", "doc_id"], "left")
    neg = marked.where("p is null").withColumn("rn", F.row_number().over(Window.partitionBy("qid").orderBy("rank"))).withColumn("part", F.floor((F.col("rn") - 1) / 4)).where("part < 2")
    lists = neg.groupBy("qid", "part").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "doc_id"))), lambda x: x["doc_id"].cast("string")), ",").alias("negs"))
    return marked.where("p").select("qid", F.col("doc_id").alias("pos")).join(lists, "qid")


@query()
def conflict_free_batches(spark: SparkSession, d: str) -> DataFrame:
    run, judged = _run(spark, d)
    return prepare.conflict_free_batches(ranking.mine_triples(run, judged, 2), 32)


@query("""with e as (select a.n_nationkey as src, b.n_nationkey as dst, round(1.0::double / (1 + abs(a.n_nationkey - b.n_nationkey)), 6) as weight from nation a join nation b on a.n_regionkey = b.n_regionkey and a.n_nationkey <> b.n_nationkey),
p0 as (select n_nationkey as start, [n_nationkey] as path, 0.0::double as score from nation),
g1 as (select start, list_append(path, dst) as path, round(score + weight, 6) as score from p0 join e on src = path[-1] where not list_contains(path, dst)), p1 as (select start, path, score from (select *, row_number() over (partition by start order by score desc, array_to_string(path, ',')) as n from g1) where n <= 2),
g2 as (select start, list_append(path, dst) as path, round(score + weight, 6) as score from p1 join e on src = path[-1] where not list_contains(path, dst)), p2 as (select start, path, score from (select *, row_number() over (partition by start order by score desc, array_to_string(path, ',')) as n from g2) where n <= 2)
select start::bigint as start, array_to_string(path, ',') as path, score from (select * from p0 union all select * from p1 union all select * from p2)""")
def beam_paths(spark: SparkSession, d: str) -> DataFrame:
    """Best paths of up to two hops between nations of a region."""
    n = table(spark, d, "nation").select("n_nationkey", "n_regionkey")
    other = n.select(F.col("n_nationkey").alias("dst"), "n_regionkey")
    edges = n.join(other, "n_regionkey").where("n_nationkey <> dst").select(F.col("n_nationkey").alias("src"), "dst", F.round(1.0 / (1 + F.abs(F.col("n_nationkey") - F.col("dst"))), 6).alias("weight"))
    out = prepare.beam_paths(materialize(edges, "edges"), n.select(F.col("n_nationkey").alias("start")), 2, 2)
    return out.select(F.col("start").cast("bigint").alias("start"), F.array_join(F.transform("path", lambda x: x.cast("string")), ",").alias("path"), "score")


@query("select doc_id, trim(regexp_replace(replace(text, '::::', ' '), '\\s+', ' ', 'g')) as clean from documents where text is not null")
def clean_passages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").select("doc_id", prepare.clean_text(F.col("text")).alias("clean"))


@query("select qa_key, '[CLS] ' || question || ' [SEP] ' || array_to_string(list_transform(string_split(coalesce(table_id, ''), '_'), lambda w: w || ' is part . '), '') || '[SEP]' as line from hybrid_questions where question is not null")
def question_row_concat(spark: SparkSession, d: str) -> DataFrame:
    parts = F.transform(F.split(F.coalesce("table_id", F.lit("")), "_"), lambda w: F.concat(w, F.lit(" is part . ")))
    return table(spark, d, "hybrid_questions").where("question is not null").select("qa_key", F.concat(F.lit("[CLS] "), "question", F.lit(" [SEP] "), F.array_join(parts, ""), F.lit("[SEP]")).alias("line"))


@query("with s as (select qa_key, question, answer_text from hybrid_questions where answer_text is not null and question is not null) select qa_key, contains(lower(question), lower(answer_text)) as in_question, list_contains(string_split(lower(question), ' '), lower(answer_text)) as is_word from s")
def weak_labels(spark: SparkSession, d: str) -> DataFrame:
    """Whether the answer stands in the text, and as a word of its own."""
    rows = table(spark, d, "hybrid_questions").where("answer_text is not null and question is not null")
    return rows.select("qa_key", F.contains(F.lower("question"), F.lower("answer_text")).alias("in_question"), F.array_contains(F.split(F.lower("question"), " "), F.lower("answer_text")).alias("is_word"))


@query("select label, vec_id from (select label, vec_id, row_number() over (partition by label order by embedding[1] desc, vec_id) as n from embeddings) where n = 1")
def argmax_row(spark: SparkSession, d: str) -> DataFrame:
    """The best row of each question."""
    best = table(spark, d, "embeddings").groupBy("label").agg(F.min(F.struct((-F.col("embedding")[0]).alias("k"), "vec_id")).alias("x"))
    return best.select("label", "x.vec_id")


@query("with b as (select label, vec_id % 2 as hit from (select label, vec_id, row_number() over (partition by label order by embedding[1] desc, vec_id) as n from embeddings) where n = 1) select round(avg(hit), 6) as accuracy, count(*) as questions from b")
def retrieval_accuracy(spark: SparkSession, d: str) -> DataFrame:
    """Mean label of the best row of each question (here: odd ids are right)."""
    best = table(spark, d, "embeddings").groupBy("label").agg(F.min(F.struct((-F.col("embedding")[0]).alias("k"), "vec_id")).alias("x"))
    return best.agg(F.round(F.avg(F.col("x.vec_id") % 2), 6).alias("accuracy"), F.count("*").alias("questions"))


@query("select checkpoint, metric from (select event_type as checkpoint, round(avg(value), 6) as metric from events group by 1) order by metric desc, checkpoint limit 1")
def tune(spark: SparkSession, d: str) -> DataFrame:
    """The checkpoint of best mean metric."""
    per = table(spark, d, "events").groupBy(F.col("event_type").alias("checkpoint")).agg(F.round(F.avg("value"), 6).alias("metric"))
    return per.orderBy(F.col("metric").desc(), "checkpoint").limit(1)


UNI = "list_filter(string_split_regex(lower({c}), '[^a-z0-9]+'), lambda t: t <> '')"


@query(f"""with s as (select qa_key, {UNI.format(c="answers.text[1]")} as g, {UNI.format(c="substr(context, answers.answer_start[1] + 1, length(answers.text[1]))")} as p from squad_examples where context is not null and answers.text is not null and answers.answer_start is not null and len(answers.text) > 0 and answers.answer_start[1] >= 0)
select qa_key, round(case when len(p) + len(g) = 0 then 0 else 2.0::double * coalesce(list_sum(list_transform(list_distinct(p), lambda t: least(len(list_filter(p, lambda x: x = t)), len(list_filter(g, lambda x: x = t))))), 0) / (len(p) + len(g)) end, 6) as rouge_1 from s""")
def rouge_1(spark: SparkSession, d: str) -> DataFrame:
    """Unigram F of each first answer and the context at its stated offset."""
    rows = table(spark, d, "squad_examples").where("context is not null and answers is not null and size(answers.text) > 0 and answers.answer_start[0] >= 0")
    g = text.words(F.col("answers.text")[0])
    p = text.words(F.substring("context", F.col("answers.answer_start")[0] + 1, F.length(F.col("answers.text")[0])))
    both = rows.select("qa_key", p.alias("p"), g.alias("g"))
    f = F.coalesce(F.try_divide(2.0 * text.token_overlap(F.col("p"), F.col("g")), (F.size("p") + F.size("g")).cast("double")), F.lit(0.0))
    return both.select("qa_key", F.round(f, 6).alias("rouge_1"))


@query("with p as (select unnest(negatives) as x from retrieval_triples), c as (select distinct x.pid as pid from p where x is not null) select pid, substr(pid, 1, position('::' in pid) - 1) as doc, regexp_extract(pid, '::[\\[(](\\d+),', 1)::bigint as first, regexp_extract(pid, ',(\\d+)[\\])]$', 1)::bigint as last, pid like '%]' as closed from c where pid like '%::%'")
def passage_boundaries(spark: SparkSession, d: str) -> DataFrame:
    """Passage ids with boundary notation taken apart: document, first and last paragraph, closed or open end."""
    ids = table(spark, d, "retrieval_triples").select(F.explode("negatives").alias("x")).where("x is not null").select(F.col("x.pid").alias("pid")).where("pid like '%::%'").distinct()
    return ids.select("pid", F.substring_index("pid", "::", 1).alias("doc"), F.regexp_extract("pid", r"::[\[(](\d+),", 1).try_cast("bigint").alias("first"), F.regexp_extract("pid", r",(\d+)[\])]$", 1).try_cast("bigint").alias("last"), F.endswith("pid", F.lit("]")).alias("closed"))


@query("""with a as (select qa_key, context, unnest(list_distinct(answers.text)) as answer from squad_examples where context is not null and answers.text is not null),
r as (select *, row_number() over (partition by qa_key order by md5(concat_ws('|', qa_key::varchar || '|' || answer, '3')), answer) as n from a where trim(answer) <> '')
select qa_key, answer, answer || ' <<sep>> ' || context as target from r where n <= 2""")
def answer_targets(spark: SparkSession, d: str) -> DataFrame:
    """At most two answers of each context as inputs of a question generator."""
    from answerforge.operators.synthesis import answer_targets

    return answer_targets(table(spark, d, "squad_examples"), "qa_key", "context", F.col("answers.text"), 2, 3)


@query(f"""with w as (select doc_id as pid, {UNI.format(c="text")}[1:8] as ws from documents where text is not null)
select pid || '-1' as qid, 'what about ' || array_to_string(ws, ' ') || '?' as question, pid from w where len(ws) >= 1""")
def synthetic_questions(spark: SparkSession, d: str) -> DataFrame:
    """Two draws a passage from a deterministic generator, whose second question is the first again and goes."""
    from answerforge.operators.synthesis import LeadGenerator, synthetic_questions

    return synthetic_questions(table(spark, d, "documents").select(F.col("doc_id").alias("pid"), "text"), LeadGenerator(), 2)


@query("select 0::bigint as clashes, true as complete, true as within_size")
def conflict_free_audit(spark: SparkSession, d: str) -> DataFrame:
    """What the batches must hold: no positive is another's negative in its batch, and no instance is lost."""
    run, judged = _run(spark, d)
    triples = materialize(ranking.mine_triples(run, judged, 2).select("qid", "pos", "neg"), "triples")
    dealt = materialize(prepare.conflict_free_batches(triples, 32), "batches")
    other = dealt.select("batch", F.col("pos").alias("neg"), F.col("qid").alias("other"))
    clashes = dealt.join(other, ["batch", "neg"]).where("qid <> other").count()
    lost = triples.exceptAll(dealt.select("qid", "pos", "neg")).count() + dealt.select("qid", "pos", "neg").exceptAll(triples).count()
    largest = dealt.groupBy("batch").count().agg(F.max("count")).first()[0] or 0
    return spark.createDataFrame([(clashes, lost == 0, largest <= 3 * 32)], "clashes bigint, complete boolean, within_size boolean")
