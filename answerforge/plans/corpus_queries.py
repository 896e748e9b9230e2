"""Classification, sampling, ordered-state and set operators, text predicates and projections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from answerforge.functions import text
from answerforge.operators import evaluate, ranking, windows
from answerforge.plans.registry import query
from answerforge.session import table

RATED = """r as (select distinct doc_id, rater, level from level_labels where level is not null), g as (select doc_id, list_sort(list(level)) as ls from r group by 1), gold as (select doc_id, ls[(len(ls) + 1) // 2] as gold from g),
both_ as (select r.rater, r.level as pred, gold from r join gold using (doc_id))"""


def _rated(spark: SparkSession, d: str) -> DataFrame:
    """Every rater's level against the median of the document."""
    r = table(spark, d, "level_labels").where("level is not null").select("doc_id", "rater", "level").distinct()
    sorted_levels = r.groupBy("doc_id").agg(F.array_sort(F.collect_list("level")).alias("ls"))
    gold = sorted_levels.select("doc_id", F.col("ls")[F.floor((F.size("ls") - 1) / 2).cast("int")].alias("gold"))
    return r.join(gold, "doc_id").select("doc_id", "rater", F.col("level").alias("pred"), "gold")


REPORT = """select scope, label, round(p, 6) as precision, round(q, 6) as recall, round(case when p + q > 0 then 2 * p * q / (p + q) else 0 end, 6) as f1, support from (
select scope, label, coalesce(tp / nullif(np, 0), 0) as p, coalesce(tp / nullif(support, 0), 0) as q, support from (
select scope, label, sum((gold = label and pred = label)::int)::double as tp, sum((pred = label)::int)::double as np, sum((gold = label)::int)::bigint as support from (
select s as scope, unnest(list_distinct([gold, pred])) as label, gold, pred from (select *, unnest(['all', rater]) as s from both_)) group by 1, 2))"""


@query(f"with {RATED} {REPORT}")
def classification_report(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.classification_report(_rated(spark, d), "gold", "pred", "rater")


@query(f"with {RATED} select gold, count(*) filter (pred = 1) as pred_1, count(*) filter (pred = 2) as pred_2, count(*) filter (pred = 3) as pred_3, count(*) filter (pred = 4) as pred_4 from both_ group by 1")
def confusion_matrix(spark: SparkSession, d: str) -> DataFrame:
    counts = [F.count(F.when(F.col("pred") == k, 1)).alias(f"pred_{k}") for k in (1, 2, 3, 4)]
    return _rated(spark, d).groupBy("gold").agg(*counts)


@query(f"with {RATED} select round(avg((gold = pred)::int), 6) as accuracy, count(*) as rows, round(avg((gold >= 3)::int), 6) as positive_share from both_")
def accuracy_summary(spark: SparkSession, d: str) -> DataFrame:
    return _rated(spark, d).agg(F.round(F.avg((F.col("gold") == F.col("pred")).cast("int")), 6).alias("accuracy"), F.count("*").alias("rows"), F.round(F.avg((F.col("gold") >= 3).cast("int")), 6).alias("positive_share"))


@query("""with s as (select level >= 3 as p, length(text) as s from level_labels join documents using (doc_id) where level is not null and text is not null), r as (select p, (select count(*) from s b where b.s < a.s) + ((select count(*) from s b where b.s = a.s) + 1) / 2.0::double as r from s a),
n as (select sum(p::int)::double as np, sum((not p)::int)::double as nn, sum(case when p then r else 0 end) as r from r) select round((r - np * (np + 1) / 2) / (np * nn), 6) as auc, round(np / (np + nn), 6) as positive_share from n""")
def roc_auc(spark: SparkSession, d: str) -> DataFrame:
    """How well length alone tells demanding documents."""
    rows = table(spark, d, "level_labels").where("level is not null").join(table(spark, d, "documents").where("text is not null").select("doc_id", F.length("text").alias("s")), "doc_id")
    return evaluate.roc_auc(rows.withColumn("p", F.col("level") >= 3), "p", "s")


@query("with l as (select doc_id, rater, level, md5(concat_ws('|', doc_id::varchar || ':' || rater, '9')) as h, doc_id::varchar || ':' || rater as k from (select distinct doc_id, rater, level from level_labels where level is not null)), m as (select min(c) as m from (select count(*) as c from l group by level)) select doc_id, rater, level from (select *, row_number() over (partition by level order by h, k) as n from l) where n <= (select m from m)")
def balance_classes(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "level_labels").where("level is not null").select("doc_id", "rater", "level").distinct().withColumn("k", F.concat(F.col("doc_id").cast("string"), F.lit(":"), "rater"))
    return ranking.balance_classes(rows, "level", "k", 9).select("doc_id", "rater", "level")


@query("with u as (select doc_id, ('0x' || substr(md5(concat_ws('|', doc_id::varchar, '4')), 1, 8))::bigint / 4294967296.0::double as u from documents) select doc_id, case when u < 0.8 then 'train' when u < 0.9 then 'dev' when u < 1.0 then 'test' end as split_name from u")
def split_by_id_hash(spark: SparkSession, d: str) -> DataFrame:
    return ranking.split_by_fraction(table(spark, d, "documents").select("doc_id"), "doc_id", {"train": 0.8, "dev": 0.1, "test": 0.1}, 4)


@query("select user_id, event_id, event_type || '_' || (row_number() over (partition by user_id, run order by ts, event_id) - 1) as run_id from (select *, sum(new) over (partition by user_id order by ts, event_id rows unbounded preceding) as run from (select *, coalesce((lag(event_type) over (partition by user_id order by ts, event_id) <> event_type)::int, 1) as new from events))")
def run_length_ids(spark: SparkSession, d: str) -> DataFrame:
    return windows.run_length_ids(table(spark, d, "events"), "user_id", ["ts", "event_id"], "event_type").select("user_id", "event_id", "run_id")


@query("""with l as (select user_id, list(value order by ts, event_id) as xs from events where value is not null group by 1)
select user_id, round(list_reduce(list_transform(xs, lambda x, i: {'n': i::double, 'v': x::double}), lambda p, x: {'n': x.n, 'v': p.v * (1 - greatest(0.01, 1 / x.n)) + greatest(0.01, 1 / x.n) * x.v}).v, 6) as average, len(xs) as rows from l""")
def moving_average(spark: SparkSession, d: str) -> DataFrame:
    return windows.moving_average(table(spark, d, "events"), "user_id", ["ts", "event_id"], "value", 0.01).withColumn("average", F.round("average", 6))


BUCKET = "(value > 10)::int + (value > 50)::int + (value > 100)::int"


@query(f"select ({BUCKET})::bigint as bucket, count(*) as count, round(sum(value), 4) as total, round(count(*)::double / sum(count(*)) over (), 6) as fraction from events where value is not null group by 1")
def threshold_distribution(spark: SparkSession, d: str) -> DataFrame:
    return windows.threshold_distribution(table(spark, d, "events"), "value", [10.0, 50.0, 100.0])


@query("select event_id, (n - 1) // 128 as batch, ((n - 1) // 128) % 4 as owner from (select event_id, row_number() over (order by ts, event_id) as n from events)")
def batch_owners(spark: SparkSession, d: str) -> DataFrame:
    return windows.batches(table(spark, d, "events").select("event_id", "ts"), ["ts", "event_id"], 128, 4).select("event_id", "batch", "owner")


@query("select date_trunc('hour', ts) as hour, event_type, count(*) as events, round(sum(value), 4) as total from events group by 1, 2")
def hourly_events(spark: SparkSession, d: str) -> DataFrame:
    """The batch twin of the streaming aggregate."""
    from answerforge.streaming.ingest import windowed_counts

    return windowed_counts(table(spark, d, "events")).select("hour", "event_type", "events", F.round("total", 4).alias("total"))


@query("select id, string_agg(w, ' ' order by i) as words from (select id, w, min(i) as i from (select id, unnest(string_split(lower(query), ' ')) as w, generate_subscripts(string_split(lower(query), ' '), 1) as i from retrieval_triples where query is not null) group by 1, 2) group by 1")
def distinct_in_order(spark: SparkSession, d: str) -> DataFrame:
    """Distinct words of a query in the order of their first occurrence."""
    return table(spark, d, "retrieval_triples").where("query is not null").select("id", F.array_join(F.array_distinct(F.split(F.lower("query"), " ")), " ").alias("words"))


@query("select count(*) as rows, count(distinct doc) as docs from (select id, regexp_extract(x.pid, '^([^:]*)', 1) as doc from (select id, unnest(negatives) as x from retrieval_triples) where x is not null)")
def distinct_doc_ids(spark: SparkSession, d: str) -> DataFrame:
    """Document ids before the ':' of passage ids."""
    rows = table(spark, d, "retrieval_triples").select(F.explode("negatives").alias("x")).where("x is not null").select(F.substring_index("x.pid", ":", 1).alias("doc"))
    return rows.agg(F.count("*").alias("rows"), F.countDistinct("doc").alias("docs"))


@query("with p as (select distinct x.title as t from (select unnest(negatives) as x from retrieval_triples) where x is not null), q as (select distinct title as t from documents) select 'both' as part, count(*) as n from (select * from p intersect select * from q) union all select 'negatives only', count(*) from (select * from p except select * from q) union all select 'documents only', count(*) from (select * from q except select * from p) union all select 'any', count(*) from (select * from p union select * from q)")
def title_sets(spark: SparkSession, d: str) -> DataFrame:
    """Union, intersection and differences of two sets of titles."""
    p = table(spark, d, "retrieval_triples").select(F.explode("negatives").alias("x")).where("x is not null").select(F.col("x.title").alias("t")).distinct()
    q = table(spark, d, "documents").select(F.col("title").alias("t")).distinct()
    named = lambda df, n: df.agg(F.count("*").alias("n")).select(F.lit(n).alias("part"), "n")
    return named(p.intersect(q), "both").unionByName(named(p.subtract(q), "negatives only")).unionByName(named(q.subtract(p), "documents only")).unionByName(named(p.union(q).distinct(), "any"))


@query("select case when lower(lang) in ('en', 'fr', 'de', 'es') then lower(lang) else 'other' end as lang, case when lower(lang) = 'en' then 0 when lower(lang) = 'fr' then 1 when lower(lang) = 'de' then 2 when lower(lang) = 'es' then 3 else 0 end::bigint as label, count(*) as docs from documents group by 1, 2")
def label_mapping(spark: SparkSession, d: str) -> DataFrame:
    """Labels to indexes; an unknown one is 0."""
    labels = F.array(*[F.lit(x) for x in ("en", "fr", "de", "es")])
    low = F.coalesce(F.lower("lang"), F.lit(""))
    index = F.greatest(F.array_position(labels, low) - 1, F.lit(0)).cast("bigint")
    return table(spark, d, "documents").groupBy(F.when(F.array_contains(labels, low), low).otherwise("other").alias("lang"), index.alias("label")).agg(F.count("*").alias("docs"))


@query("select doc_id, form from documents where form in ('qa', 'table') and text is not null")
def restrict_labels(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where(F.col("form").isin("qa", "table") & F.col("text").isNotNull()).select("doc_id", "form")


@query("""select record_id, coalesce(trim(payload), '') = '' or contains(lower(payload), 'null') or length(payload) < 40 as problematic, regexp_matches(coalesce(payload, ''), '^\\s*\\{') as is_object from nq_raw""")
def problem_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows to look at: blank, too short, or with a blacklisted substring."""
    p = F.coalesce("payload", F.lit(""))
    return table(spark, d, "nq_raw").select("record_id", ((F.trim(p) == "") | F.contains(F.lower(p), F.lit("null")) | (F.length(p) < 40)).alias("problematic"), p.rlike(r"^\s*\{").alias("is_object"))


@query("""with q as (select qa_key, translate(lower(question), '""" + text.PUNCTUATION.replace("'", "''") + """', '') as q, lag(translate(lower(question), '""" + text.PUNCTUATION.replace("'", "''") + """', '')) over (partition by table_id order by qa_key) as before from hybrid_questions where question is not null)
select qa_key, substr(q, 1, 20) = substr(before, 1, 20) or len(list_intersect(list_distinct(string_split(q, ' ')), list_distinct(string_split(before, ' ')))) > len(list_distinct(string_split(q, ' '))) / 2.0 as repeats from q where before is not null""")
def repeated_questions(spark: SparkSession, d: str) -> DataFrame:
    """A question too close to the one before: equal beginning, or more than half of the words shared."""
    from pyspark.sql import Window

    plain = F.translate(F.lower("question"), text.PUNCTUATION, "")
    rows = table(spark, d, "hybrid_questions").where("question is not null").select("qa_key", plain.alias("q"), F.col("table_id").alias("s"))
    pairs = rows.withColumn("before", F.lag("q").over(Window.partitionBy("s").orderBy("qa_key"))).where("before is not null")
    a, b = F.array_distinct(F.split("q", " ")), F.array_distinct(F.split("before", " "))
    return pairs.select("qa_key", ((F.substring("q", 1, 20) == F.substring("before", 1, 20)) | (F.size(F.array_intersect(a, b)) > F.size(a) / 2.0)).alias("repeats"))


@query("select qa_key, string_agg(trim(s), ' | ' order by i) as sentences from (select qa_key, i, s, answers.text[1] as a from (select qa_key, answers, string_split(context, '. ') as ss from squad_examples where context is not null and answers.text is not null and len(answers.text) > 0), unnest(ss) with ordinality u(s, i)) where contains(lower(s), lower(a)) group by 1")
def sentences_with_answer(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "squad_examples").where("context is not null and answers.text is not null and size(answers.text) > 0")
    held = F.filter(F.split("context", r"\. "), lambda s: F.contains(F.lower(s), F.lower(F.col("answers.text")[0])))
    return rows.select("qa_key", held.alias("hs")).where("size(hs) > 0").select("qa_key", F.array_join(F.transform("hs", lambda s: F.trim(s)), " | ").alias("sentences"))


@query("select qa_key, case when position(lower(answers.text[1]) in lower(context)) > 0 then position(lower(answers.text[1]) in lower(context)) - 1 else -1 end as found_at, (length(context) - length(replace(context, answers.text[1], ''))) // length(answers.text[1]) as times from squad_examples where context is not null and answers.text is not null and len(answers.text) > 0 and length(answers.text[1]) > 0")
def answer_positions(spark: SparkSession, d: str) -> DataFrame:
    """First place of the answer in its context, ignoring case, and how often it stands there."""
    a = F.col("answers.text")[0]
    rows = table(spark, d, "squad_examples").where("context is not null and answers.text is not null and size(answers.text) > 0").where(F.length(a) > 0)
    return rows.select("qa_key", (F.expr("locate(lower(answers.text[0]), lower(context))") - 1).cast("bigint").alias("found_at"), F.floor((F.length("context") - F.length(F.replace("context", a, F.lit("")))) / F.length(a)).alias("times"))


@query("select qa_key, coalesce(answers.text[1], '') || ' <<sep>> ' || context || ' => ' || question as line from squad_examples where context is not null and question is not null")
def question_generation_inputs(spark: SparkSession, d: str) -> DataFrame:
    first = F.coalesce(F.get(F.col("answers.text"), F.lit(0)), F.lit(""))
    return table(spark, d, "squad_examples").where("context is not null and question is not null").select("qa_key", F.concat(first, F.lit(" <<sep>> "), "context", F.lit(" => "), "question").alias("line"))


@query("with s as (select vec_id, label, embedding[1]::double as a, embedding[2]::double as b from embeddings), t as (select *, round(3.2 * a + b, 6) as ts from s) select label, vec_id, ts from (select *, row_number() over (partition by label order by ts desc, vec_id) as n from t) where n = 1")
def rerank_combined_score(spark: SparkSession, d: str) -> DataFrame:
    """3.2 * row score + span score; the best answer of each question, the first of equal ones."""
    rows = table(spark, d, "embeddings").select("vec_id", "label", F.round(3.2 * F.col("embedding")[0].cast("double") + F.col("embedding")[1].cast("double"), 6).alias("ts"))
    best = rows.groupBy("label").agg(F.min(F.struct((-F.col("ts")).alias("k"), "vec_id")).alias("x"))
    return best.select("label", F.col("x.vec_id").alias("vec_id"), (-F.col("x.k")).alias("ts"))


@query("with p as (select vec_id, unnest(range(1, 6)) as i, embedding[1:5]::double[] as v from embeddings), q as (select vec_id, i - 1 as idx, case when i = 2 then -9e19 else v[i] end as x from p) select vec_id, idx::bigint as label from (select *, row_number() over (partition by vec_id order by x desc, idx) as n from q) where n = 1")
def argmax_dropped_label(spark: SparkSession, d: str) -> DataFrame:
    """Best label once label 1 is masked."""
    v = F.transform(F.slice("embedding", 1, 5), lambda x, i: F.when(i == 1, -9e19).otherwise(x.cast("double")))
    return table(spark, d, "embeddings").select("vec_id", (F.array_position(v, F.array_max(v)) - 1).cast("bigint").alias("label"))


@query("select label, round(avg(m), 6) as loss from (select label, vec_id // 10 as g, min(embedding[1]::double) as m from embeddings group by 1, 2) group by 1")
def min_group_loss(spark: SparkSession, d: str) -> DataFrame:
    groups = table(spark, d, "embeddings").groupBy("label", F.floor(F.col("vec_id") / 10).alias("g")).agg(F.min(F.col("embedding")[0].cast("double")).alias("m"))
    return groups.groupBy("label").agg(F.round(F.avg("m"), 6).alias("loss"))


@query(f"""with t as (select id, {"list_distinct(list_filter(string_split_regex(lower(query), '[^a-z0-9]+'), lambda t: t <> ''))"} as q, {"list_distinct(list_filter(string_split_regex(lower(coalesce(positive.text, '')), '[^a-z0-9]+'), lambda t: t <> ''))"} as c from retrieval_triples where query is not null)
select id, len(list_filter(q, lambda t: not list_contains(c, t)))::bigint as missing, len(list_filter(q, lambda t: not list_contains(c, t))) > round(len(q) * 0.4 + 0.001) as dropped from t""")
def prune_hallucinations(spark: SparkSession, d: str) -> DataFrame:
    """Words of a question that its passage does not hold; too many and the question goes."""
    words = lambda c: F.array_distinct(text.words(c))
    rows = table(spark, d, "retrieval_triples").where("query is not null").select("id", words(F.col("query")).alias("q"), words(F.coalesce("positive.text", F.lit(""))).alias("c"))
    missing = F.size(F.array_except("q", "c"))
    return rows.select("id", missing.cast("bigint").alias("missing"), (missing > F.round(F.size("q") * 0.4 + 0.001)).alias("dropped"))


@query("select doc_id, string_agg(trim(s), '. ' order by i) as lead from (select doc_id, string_split(text, '. ') as ss from documents where text is not null), unnest(ss[1:2]) with ordinality u(s, i) group by 1")
def first_sentences(spark: SparkSession, d: str) -> DataFrame:
    """The first two sentences of each text."""
    parts = F.slice(F.split("text", r"\. "), 1, 2)
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.array_join(F.transform(parts, lambda s: F.trim(s)), ". ").alias("lead"))


@query("select qa_key, len(regexp_extract_all(lower(question), '([\\p{L}\\p{N}_]+|[^\\p{L}\\p{N}_\\s]+)'))::bigint as tokens from hybrid_questions where question is not null")
def tokenize_string(spark: SparkSession, d: str) -> DataFrame:
    """Words and runs of signs."""
    rows = table(spark, d, "hybrid_questions").where("question is not null")
    return rows.select("qa_key", F.size(F.regexp_extract_all(F.lower("question"), F.lit(r"([\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]+)"), F.lit(1))).cast("bigint").alias("tokens"))


ROUGE_SQL = """with p as (select qa_key, string_split_regex(trim(lower(substr(context, answers.answer_start[1] + 1, length(answers.text[1])))), '\\s+') as a, string_split_regex(trim(lower(answers.text[1])), '\\s+') as b from squad_examples where context is not null and len(answers.text) > 0 and answers.answer_start[1] >= 0),
q as (select qa_key, list_filter(a, lambda w: w <> '') as a, list_filter(b, lambda w: w <> '') as b from p),
lcs as (select qa_key, len(a) as na, len(b) as nb, list_reduce(list_concat([{'w': '', 'r': list_transform(range(len(b) + 1), lambda x: 0)}], list_transform(a, lambda w: {'w': w, 'r': []::int[]})),
 lambda old, x: {'w': '', 'r': list_transform(range(1, len(b) + 2), lambda j: list_max(list_transform(range(1, j + 1), lambda i: case when i > 1 and b[i - 1] = x.w then old.r[i - 1] + 1 else old.r[i] end)))}).r[-1] as common from q)
select round(100 * avg(case when common > 0 then 2.0 * common / (na + nb) else 0 end), 4) as rouge_l, count(*) as examples from lcs"""


@query(ROUGE_SQL)
def rouge_l(spark: SparkSession, d: str) -> DataFrame:
    """Longest common subsequence F of each first answer and the context at its stated offset."""
    from answerforge.functions.sequence import rouge_l_f

    rows = table(spark, d, "squad_examples").where("context is not null and answers is not null and size(answers.text) > 0 and answers.answer_start[0] >= 0")
    pred = F.substring("context", F.col("answers.answer_start")[0] + 1, F.length(F.col("answers.text")[0]))
    scored = rows.select("qa_key", rouge_l_f(pred, F.col("answers.text")[0]).alias("f"))
    return scored.agg(F.round(100 * F.avg("f"), 4).alias("rouge_l"), F.count("*").alias("examples"))


# White space as the splitting of a text into words takes it: all of Unicode's.
SPACE = r"[\s\v\pZ\x{85}\x{1c}-\x{1f}]+"
PACK_SQL = f"""with recursive p as (select doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^{SPACE}|{SPACE}$', '', 'g')), lambda x: x <> '') as parts from documents where text is not null),
s as (select doc_id, parts, list_transform(parts, lambda x: len(list_filter(string_split_regex(x, '{SPACE}'), lambda w: w <> ''))) as sizes from p where len(parts) > 0),
-- One step a passage: it ends where 50 words are reached, before the paragraph that would pass 100, or with the document.
e as (select doc_id, parts, sizes, 0::bigint as first, 0::bigint as stop from s union all
 select doc_id, parts, sizes, stop, list_min(list_filter(range(stop + 1, len(sizes) + 1), lambda k: k = len(sizes) or list_sum(sizes[stop + 1:k]) >= 50 or list_sum(sizes[stop + 1:k + 1]) > 100)) from e where stop < len(sizes))
select doc_id, first::int as first, stop::int as stop, list_sum(sizes[first + 1:stop])::bigint as words, array_to_string(parts[first + 1:stop], ' ') as passage from e where stop > first"""


@query(PACK_SQL)
def packed_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    """Paragraphs packed greedily to passages of 50 to 100 words."""
    from answerforge.functions.sequence import pack_paragraphs

    return pack_paragraphs(table(spark, d, "documents"), "doc_id", "text", 50, 100)


@query("""with c as (select id as pid, coalesce(title, '') as title, coalesce(txt, '') as text, row_number() over (partition by id order by k desc) as n from (select x.pid as id, x.title as title, x.text as txt, x.passage_key as k from (select unnest(negatives) as x from retrieval_triples) where x is not null)) select pid, title, text from c where n = 1""")
def document_collection(spark: SparkSession, d: str) -> DataFrame:
    """One row per passage id; of several the last one wins."""
    from answerforge.sources.readers import last_wins

    rows = table(spark, d, "retrieval_triples").select(F.explode("negatives").alias("x")).where("x is not null")
    flat = rows.select(F.col("x.pid").alias("pid"), F.coalesce("x.title", F.lit("")).alias("title"), F.coalesce("x.text", F.lit("")).alias("text"), F.col("x.passage_key").alias("k"))
    return last_wins(flat, "pid", "k").select("pid", "title", "text")


@query("select question, count(*) as times from hybrid_questions where question is not null group by 1 having count(*) > 1")
def duplicate_queries(spark: SparkSession, d: str) -> DataFrame:
    from answerforge.sources.readers import repeated_keys

    return repeated_keys(table(spark, d, "hybrid_questions").where("question is not null"), "question").withColumnRenamed("count", "times")


@query("select doc_id, to_json({'id': doc_id, 'contents': coalesce(title, '') || chr(9) || replace(text, chr(9), ' ')})::varchar as line from documents where text is not null")
def index_lines(spark: SparkSession, d: str) -> DataFrame:
    """Documents as the JSON lines an index builder reads."""
    rows = table(spark, d, "documents").where("text is not null")
    contents = F.concat(F.coalesce("title", F.lit("")), F.lit("\t"), F.replace("text", F.lit("\t"), F.lit(" ")))
    return rows.select("doc_id", F.to_json(F.struct(F.col("doc_id").alias("id"), contents.alias("contents"))).alias("line"))
