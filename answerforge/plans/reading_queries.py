"""Reader post-processing and metrics over predictions, annotated examples and question sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from answerforge.functions import text
from answerforge.operators import evaluate, reading
from answerforge.plans.registry import query
from answerforge.session import materialize, table

BOTH = """one as (select id as example_id, arg_min(coalesce(annotations, []), record_id) as notes from nq_examples group by 1),
g0 as (select example_id, a from one, unnest(notes) t(a) where a is not null),
g1 as (select example_id, coalesce(a.long_answer.candidate_index, -1) as passage, coalesce(list_filter(a.short_answers, lambda s: s is not null)[1].start_byte, -1) as start, coalesce(list_filter(a.short_answers, lambda s: s is not null)[1].end_byte, -1) as stop,
 coalesce(a.yes_no_answer, -1) as yes_no, coalesce(a.long_answer.start_byte, -1) as long_start, coalesce(a.long_answer.end_byte, -1) as long_stop from g0),
top as (select * from (select *, row_number() over (partition by example_id order by confidence_score desc, prediction_id) as n from predictions where confidence_score is not null and not isnan(confidence_score)) where n = 1),
both_ as (select o.example_id, passage_index as pp, start_position as ps, end_position as pe, yes_no_answer as py, confidence_score::double as sc, language from one o left join top using (example_id))"""
PASS = BOTH + """, v as (select b.example_id, any_value(language) as language, any_value(sc) as sc, any_value(pp) as pp, count(*) filter (passage >= 0) as n, coalesce(bool_or(passage >= 0 and passage = pp), false) as hit from both_ b left join g1 using (example_id) group by 1),
st as (select example_id, language, coalesce(sc, 0) as score, n >= 2 as has_gold, case when sc is null then not (n >= 2) else pp >= 0 end as has_pred, case when n >= 2 and sc is not null and pp >= 0 and hit then 1.0::double else 0 end as value from v)"""
F1 = "case when least(pe, stop) - greatest(ps, start) <= 0 then 0 else 2.0::double * (least(pe, stop) - greatest(ps, start)) / ((pe - ps) + (stop - start)) end"
MINI = BOTH + f""", v as (select b.example_id, any_value(language) as language, any_value(sc) as sc, any_value(ps) as ps, any_value(py) as py, count(*) filter (start >= 0 or yes_no >= 0) as n, coalesce(bool_or(py >= 0 and yes_no = py), false) as agreed, coalesce(max(case when start >= 0 then {F1} end), 0) as best from both_ b left join g1 using (example_id) group by 1),
st0 as (select *, n >= 2 as has_gold, case when sc is null then not (n >= 2) else ps >= 0 or py >= 0 end as has_pred from v),
st as (select example_id, language, coalesce(sc, 0) as score, has_gold, has_pred, case when has_gold and has_pred and agreed then 1.0::double when has_gold and has_pred then best else 0 end as value from st0)"""


def _exact_sql(a: str, b: str) -> str:
    return BOTH + f""", v as (select b.example_id, any_value(language) as language, any_value(sc) as sc, any_value(ps) as ps, count(*) filter ({a} >= 0) as n, coalesce(bool_or({a} >= 0 and {a} = ps and {b} = pe), false) as hit from both_ b left join g1 using (example_id) group by 1),
st as (select example_id, language, coalesce(sc, 0) as score, n >= 2 as has_gold, coalesce(ps >= 0, false) as has_pred, case when n >= 2 and coalesce(ps >= 0, false) and hit then 1.0::double else 0 end as value from v)"""


MACRO = """select {k} round(p, 6) as precision, round(r, 6) as recall, round(case when p + r > 0 then 2 * p * r / (p + r) else 0 end, 6) as f1, examples from
(select {k} coalesce(sum(value) / nullif(sum(has_pred::int), 0), 0) as p, coalesce(sum(value) / nullif(sum(has_gold::int), 0), 0) as r, count(*) as examples from st {g})"""
POINTS = """, cells as (select {k} score, sum(value) as v, count(*) as n from st where has_pred group by {k} score),
run as (select {k} score, sum(v) over (partition by {p} order by score desc) as tv, sum(n) over (partition by {p} order by score desc) as tn from cells),
gold as (select {k} sum(has_gold::int)::double as golds from st {g}),
pts as (select {kr} score, tv / tn as p, coalesce(tv / nullif(golds, 0), 0) as r from run {j})"""
ALL = POINTS.format(k="", p="1", g="", kr="", j="cross join gold")
BEST = "select round(score, 5) as score, round(p, 6) as precision, round(r, 6) as recall, round(f, 6) as f1 from (select *, case when p + r > 0 then 2 * p * r / (p + r) else 0 end as f from pts) order by round(f, 9) desc, score desc limit 1"


def _both(spark: SparkSession, d: str) -> DataFrame:
    gold = reading.gold_labels(reading.newest_examples(table(spark, d, "nq_examples")))
    return reading.with_gold(gold, reading.top_predictions(table(spark, d, "predictions")))


def _rounded(points: DataFrame) -> DataFrame:
    return points.select(F.round("score", 5).alias("score"), *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query("with " + PASS + MACRO.format(k="", g=""))
def tydi_passage_eval(spark: SparkSession, d: str) -> DataFrame:
    return reading.macro_f1(reading.passage_stats(_both(spark, d)))


@query("with " + MINI + MACRO.format(k="", g=""))
def tydi_minimal_eval(spark: SparkSession, d: str) -> DataFrame:
    return reading.macro_f1(reading.minimal_stats(_both(spark, d)))


@query("with " + PASS + MACRO.format(k="language,", g="group by 1"))
def tydi_language_eval(spark: SparkSession, d: str) -> DataFrame:
    return reading.macro_f1(reading.passage_stats(_both(spark, d)), "language")


@query("with " + PASS + ", m as (" + MACRO.format(k="language,", g="group by 1") + ") select round(avg(f1), 6) as macro_f1, count(*) as languages from m where language <> 'english'")
def tydi_language_macro(spark: SparkSession, d: str) -> DataFrame:
    """Mean over the languages but English."""
    per = reading.macro_f1(reading.passage_stats(_both(spark, d)), "language")
    return per.where("language <> 'english'").agg(F.round(F.avg("f1"), 6).alias("macro_f1"), F.count("*").alias("languages"))


@query("with " + MINI + ALL + " select round(score, 5) as score, round(p, 6) as precision, round(r, 6) as recall, round(case when p + r > 0 then 2 * p * r / (p + r) else 0 end, 6) as f1 from pts")
def tydi_pr_curve(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(evaluate.curve(reading.minimal_stats(_both(spark, d)), "has_gold", "has_pred", "value", "score"))


@query("with " + MINI + ALL + BEST)
def tydi_best_threshold(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(evaluate.best_point(evaluate.curve(reading.minimal_stats(_both(spark, d)), "has_gold", "has_pred", "value", "score")))


@query("with " + MINI + ALL + " select t as target, round(coalesce(max(case when p >= t then r end), 0), 6) as recall from pts, (values (0.02::double), (0.05), (0.1), (0.5)) v(t) group by 1")
def tydi_recall_at_precision(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.recall_at_precision(evaluate.curve(reading.minimal_stats(_both(spark, d)), "has_gold", "has_pred", "value", "score"), [0.02, 0.05, 0.1, 0.5])


@query("with " + _exact_sql("long_start", "long_stop") + MACRO.format(k="", g=""))
def nq_long_eval(spark: SparkSession, d: str) -> DataFrame:
    return reading.macro_f1(reading.exact_stats(_both(spark, d), "long_start", "long_stop"))


@query("with " + _exact_sql("start", "stop") + MACRO.format(k="", g=""))
def nq_short_eval(spark: SparkSession, d: str) -> DataFrame:
    return reading.macro_f1(reading.exact_stats(_both(spark, d), "start", "stop"))


@query("with " + _exact_sql("start", "stop") + ALL + BEST)
def nq_best_threshold(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(evaluate.best_point(evaluate.curve(reading.exact_stats(_both(spark, d), "start", "stop"), "has_gold", "has_pred", "value", "score")))


@query("with " + BOTH + " select example_id, count(*) filter (passage >= 0) >= 2 as has_long, count(*) filter (start >= 0) >= 2 as has_short, count(*) as annotators from g1 group by 1")
def gold_votes(spark: SparkSession, d: str) -> DataFrame:
    gold = reading.gold_labels(reading.newest_examples(table(spark, d, "nq_examples"))).where(F.size("golds") > 0)
    votes = lambda f: F.size(F.filter("golds", lambda g: g[f] >= 0)) >= 2
    return gold.select("example_id", votes("passage").alias("has_long"), votes("start").alias("has_short"), F.size("golds").cast("bigint").alias("annotators"))


@query("""with g as (select distinct id from nq_examples), p as (select distinct example_id as id from predictions)
select 'only_gold' as side, count(*) as ids from g anti join p using (id) union all select 'only_pred', count(*) from p anti join g using (id) union all select 'both', count(*) from g semi join p using (id)""")
def id_audit(spark: SparkSession, d: str) -> DataFrame:
    """Ids of examples without prediction, of predictions without example, and of both."""
    g = table(spark, d, "nq_examples").select("id").distinct()
    p = table(spark, d, "predictions").select(F.col("example_id").alias("id")).distinct()
    side = lambda df, name: df.agg(F.count("*").alias("ids")).select(F.lit(name).alias("side"), "ids")
    return side(g.join(p, "id", "left_anti"), "only_gold").unionByName(side(p.join(g, "id", "left_anti"), "only_pred")).unionByName(side(g.join(p, "id", "left_semi"), "both"))


@query("""with c as (select record_id, long_answer_candidates as c, a from (select record_id, long_answer_candidates, unnest(annotations) as a from nq_examples) where a is not null),
s as (select record_id, c, s from (select record_id, c, unnest(a.short_answers) as s from c) where s is not null and s.start_byte >= 0 and c is not null)
select record_id, s.start_byte as start_byte, s.end_byte as end_byte, coalesce((select min(i) - 1 from unnest(c) with ordinality u(x, i) where x.start_byte >= 0 and x.start_byte <= s.start_byte and s.end_byte <= x.end_byte), -1) as passage from s""")
def passage_containment(spark: SparkSession, d: str) -> DataFrame:
    """First candidate passage that contains each short answer."""
    notes = table(spark, d, "nq_examples").where("long_answer_candidates is not null").select("record_id", "long_answer_candidates", F.explode("annotations").alias("a"))
    shorts = notes.select("record_id", "long_answer_candidates", F.explode("a.short_answers").alias("s")).where("s.start_byte >= 0")
    found = reading.first_container(F.col("s.start_byte"), F.col("s.end_byte"), F.col("long_answer_candidates"))
    return shorts.select("record_id", F.col("s.start_byte").alias("start_byte"), F.col("s.end_byte").alias("end_byte"), F.coalesce(found, F.lit(-1)).cast("bigint").alias("passage"))


@query("""with t as (select record_id, x, i from (select record_id, document.tokens as ts from nq_examples), unnest(ts) with ordinality u(x, i) where x.token is not null)
select record_id, string_agg(x.token, ' ' order by i) as context, count(*) as tokens from t where not coalesce(x.is_html, false) group by 1""")
def nq_context(spark: SparkSession, d: str) -> DataFrame:
    """Plain context of the tokens that are not marked as HTML."""
    kept = F.filter("document.tokens", lambda t: t["token"].isNotNull() & ~F.coalesce(t["is_html"], F.lit(False)))
    rows = table(spark, d, "nq_examples").select("record_id", F.transform(kept, lambda t: t["token"]).alias("ts")).where("size(ts) > 0")
    return rows.select("record_id", F.array_join("ts", " ").alias("context"), F.size("ts").cast("bigint").alias("tokens"))


@query("""with t as (select record_id, x, i from (select record_id, document.tokens as ts from nq_examples), unnest(ts) with ordinality u(x, i) where x.token is not null),
p as (select record_id, i, case when not coalesce(x.is_html, false) then x.token when lower(x.token) like '<li%' then '*' end as plain from t)
select record_id, i - 1 as token_no, plain, coalesce(sum(octet_length(encode(plain)) + 1) over (partition by record_id order by i rows between unbounded preceding and 1 preceding), 0)::bigint as start_byte from p where plain is not null""")
def drop_html_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Plain tokens (list items as '*') with their byte offsets in the joined text. Windows are per document."""
    from pyspark.sql import Window

    each = table(spark, d, "nq_examples").select("record_id", F.posexplode("document.tokens").alias("i", "t")).where("t.token is not null")
    plain = F.when(~F.coalesce("t.is_html", F.lit(False)), F.col("t.token")).when(F.lower("t.token").startswith("<li"), "*")
    kept = each.select("record_id", F.col("i").cast("bigint").alias("token_no"), plain.alias("plain")).where("plain is not null")
    before = Window.partitionBy("record_id").orderBy("token_no").rowsBetween(Window.unboundedPreceding, -1)
    return kept.withColumn("start_byte", F.coalesce(F.sum(F.octet_length("plain") + 1).over(before), F.lit(0)).cast("bigint"))


@query("""select qa_key, unnest(answers.text) as answer, unnest(answers.answer_start)::bigint as start, unnest(answers.answer_start)::bigint + length(unnest(answers.text)) as stop from squad_examples where answers.text is not null and answers.answer_start is not null""")
def squad_flatten(spark: SparkSession, d: str) -> DataFrame:
    rows = reading.squad_rows(table(spark, d, "squad_examples")).select("qa_key", F.explode("targets").alias("t"))
    return rows.select("qa_key", F.col("t.text").alias("answer"), F.col("t.start").cast("bigint").alias("start"), F.col("t.stop").cast("bigint").alias("stop"))


@query("""with a as (select qa_key, context, unnest(answers.answer_start)::bigint as c from squad_examples where context is not null and answers.answer_start is not null)
select qa_key, c as char_at, octet_length(encode(substr(context, 1, c))) as byte_at, least(c, length(context)) as back from a where c >= 0""")
def byte_to_char_offsets(spark: SparkSession, d: str) -> DataFrame:
    """Character offsets to bytes and back."""
    rows = table(spark, d, "squad_examples").where("context is not null and answers is not null").select("qa_key", "context", F.explode("answers.answer_start").alias("c")).where("c >= 0")
    byte = F.octet_length(F.substring("context", F.lit(1), F.col("c"))).cast("bigint")
    return rows.withColumn("b", byte).select("qa_key", F.col("c").cast("bigint").alias("char_at"), F.col("b").alias("byte_at"), text.byte_to_char(F.col("context"), F.col("b")).alias("back"))


PUNCT = text.PUNCTUATION.replace("'", "''")


def _norm(c: str) -> str:
    return f"array_to_string(list_filter(string_split_regex(translate(lower({c}), '{PUNCT}', ''), '\\s+'), lambda t: t <> '' and t not in ('a', 'an', 'the')), ' ')"


F1SQL = """case when p = '' or g = '' then {empty} else 2.0::double * list_sum(list_transform(list_distinct(string_split(p, ' ')), lambda t: least(len(list_filter(string_split(p, ' '), lambda x: x = t)), len(list_filter(string_split(g, ' '), lambda x: x = t))))) / (len(string_split(p, ' ')) + len(string_split(g, ' '))) end"""
SQUAD = f"""s as (select qa_key, source, context, unnest(answers.text) as gold, substr(context, answers.answer_start[1] + 1, length(answers.text[1])) as pred from squad_examples where answers.text is not null and answers.answer_start is not null and len(answers.text) > 0 and context is not null and answers.answer_start[1] >= 0),
n as (select qa_key, source, {_norm("gold")} as g, {_norm("pred")} as p from s),
f as (select qa_key, source, max((p = g)::int) as em, max({F1SQL.format(empty="0")}) as f1 from n group by 1, 2)"""


def _squad(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Gold answers, and as predictions the context at the first answer's stated offset."""
    rows = table(spark, d, "squad_examples").where("context is not null and answers is not null and size(answers.text) > 0 and answers.answer_start[0] >= 0")
    gold = rows.select(F.col("qa_key").alias("id"), "source", F.col("answers.text").alias("golds"))
    pred = rows.select(F.col("qa_key").alias("id"), F.substring("context", F.col("answers.answer_start")[0] + 1, F.length(F.col("answers.text")[0])).alias("prediction"))
    return gold, pred


@query(f"with {SQUAD} select round(100 * avg(em), 6) as exact_match, round(100 * avg(f1), 6) as f1, count(*) as examples from f")
def squad_em_f1(spark: SparkSession, d: str) -> DataFrame:
    return reading.em_f1(*_squad(spark, d))


@query(f"with {SQUAD} select source, round(100 * avg(em), 6) as exact_match, round(100 * avg(f1), 6) as f1, count(*) as examples from f group by 1")
def squad_em_f1_by_source(spark: SparkSession, d: str) -> DataFrame:
    return reading.em_f1(*_squad(spark, d), by=["source"])


@query(f"with {SQUAD} select round(100 * avg(em), 6) as exact_match, round(100 * avg(f1), 6) as f1, count(*) as examples from f where source = 'mlqa'")
def mlqa_em_f1(spark: SparkSession, d: str) -> DataFrame:
    """The same with the language's own articles and punctuation."""
    gold, pred = _squad(spark, d)
    return reading.em_f1(gold.where("source = 'mlqa'").withColumn("lang", F.lit("en")), pred, lang=F.col("lang"))


HYB = f"""h as (select qa_key, lower(trim(source)) as source, answer_text, regexp_extract(question, '([^ ?.]+)[ ?.]*$', 1) as pred, question_postag is not null as tagged from hybrid_questions where question is not null and answer_text is not null),
n as (select qa_key, source, tagged, {_norm("answer_text")} as g, {_norm("pred")} as p from h), f as (select qa_key, source, tagged, (p = g)::int as em, {F1SQL.format(empty="case when p = g then 1 else 0 end")} as f1 from n)"""


def _hybrid(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Gold answers, and as predictions the last word of the question."""
    rows = table(spark, d, "hybrid_questions").where("question is not null and answer_text is not null")
    gold = rows.select(F.col("qa_key").alias("id"), F.lower(F.trim("source")).alias("source"), F.array("answer_text").alias("golds"))
    return gold, rows.select(F.col("qa_key").alias("id"), F.regexp_extract("question", r"([^ ?.]+)[ ?.]*$", 1).alias("prediction"))


@query(f"with {HYB} select source, round(100 * avg(em), 6) as exact_match, round(100 * avg(f1), 6) as f1, count(*) as examples from f group by 1")
def hybrid_em_f1(spark: SparkSession, d: str) -> DataFrame:
    gold, pred = _hybrid(spark, d)
    return reading.em_f1(gold, pred, by=["source"], empty=1.0)


@query(f"with {HYB} select round(100 * sum(case when tagged then em else 0 end)::double / count(*), 6) as exact_match, round(100 * sum(case when tagged then f1 else 0 end) / count(*), 6) as f1, count(*) as examples from f where source = 'ottqa'")
def ott_em_f1(spark: SparkSession, d: str) -> DataFrame:
    """A missing prediction adds nothing and still counts (here: questions without tags have none)."""
    gold, pred = _hybrid(spark, d)
    tagged = table(spark, d, "hybrid_questions").where("question_postag is not null").select(F.col("qa_key").alias("id"))
    return reading.em_f1(gold.where("source = 'ottqa'"), pred.join(tagged, "id", "left_semi"), empty=1.0)


@query(f"select qa_key, {_norm('answer_text')} as answer from hybrid_questions where answer_text is not null")
def normalize_answer(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "hybrid_questions").where("answer_text is not null").select("qa_key", text.normalize_answer(F.col("answer_text")).alias("answer"))


def _lang_norm(drop: str) -> str:
    return "array_to_string(list_filter(string_split_regex(regexp_replace(lower(text), '[\\p{P}$+<=>^`|~]', '', 'g'), '\\s+'), lambda t: t <> '' and t not in (" + drop + ")), ' ')"


def _drops(lang: str) -> str:
    return ", ".join(f"'{a}'" for a in text.ARTICLES[lang]) or "''"


@query("select doc_id, md5(case lang " + " ".join(f"when '{k}' then {_lang_norm(_drops(k))}" for k in ("en", "es", "de")) + f" else {_lang_norm(chr(39) * 2)} end) as plain from documents where text is not null")
def normalize_answer_lang(spark: SparkSession, d: str) -> DataFrame:
    """Whole texts normalised by language, as a digest."""
    rows = table(spark, d, "documents").where("text is not null")
    return rows.select("doc_id", F.md5(text.normalize_answer_lang(F.col("text"), F.coalesce("lang", F.lit("")))).alias("plain"))


NB = """with t as (select vec_id, embedding::double[] as v from embeddings where embedding is not null), px as (select vec_id, unnest(range(0, 64)) as i, v from t),
s as (select vec_id, i, v[i + 1] as x, row_number() over (partition by vec_id order by v[i + 1] desc, i) as n from px), e as (select vec_id, i, v[64 - i] as x, row_number() over (partition by vec_id order by v[64 - i] desc, i) as n from px),
c as (select s.vec_id, s.i as start, e.i as stop, round(s.x + e.x, 6) as score from s join e using (vec_id) where s.n <= 5 and e.n <= 5 and e.i >= s.i and e.i - s.i + 1 <= 30),
k as (select *, row_number() over (partition by vec_id order by score desc, start, stop) as rank from c), b as (select *, exp(score - max(score) over (partition by vec_id)) as x from k where rank <= 3)"""


def _nbest(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings").where("embedding is not null")
    return reading.nbest_spans(rows, F.col("embedding"), F.reverse("embedding"), "vec_id", 5, 30, 3)


@query(NB + " select vec_id, start, stop, score, rank, round(x / sum(x) over (partition by vec_id), 6) as probability from b")
def nbest_spans(spark: SparkSession, d: str) -> DataFrame:
    """Position i of a vector as start logit, position 63 - i as end logit."""
    return _nbest(spark, d)


@query(NB + ", z as (select k.vec_id, rank, score - (v[1] + v[64]) as diff, v[1] as type_logit from k join t using (vec_id) where rank <= 3) select vec_id, rank, round(diff, 5) as diff, round(diff * type_logit, 5) as scaled, round(0.5 * diff + 0.5 * type_logit, 5) as weighted from z")
def span_scorers(spark: SparkSession, d: str) -> DataFrame:
    """Span score less null score; that times the type logit; the weighted mean of both."""
    v = table(spark, d, "embeddings").where("embedding is not null").select("vec_id", F.col("embedding")[0].cast("double").alias("a"), F.col("embedding")[63].cast("double").alias("z"))
    diff = F.col("score") - (F.col("a") + F.col("z"))
    return _nbest(spark, d).join(v, "vec_id").select("vec_id", "rank", F.round(diff, 5).alias("diff"), F.round(diff * F.col("a"), 5).alias("scaled"), F.round(0.5 * diff + 0.5 * F.col("a"), 5).alias("weighted"))


@query(NB + """, t3 as (select vec_id, rank, start, stop, score from k where rank <= 3),
o as (select x.vec_id, x.rank, max(greatest(0, least(x.stop, y.stop) - greatest(x.start, y.start) + 1) * 2.0::double / ((x.stop - x.start + 1) + (y.stop - y.start + 1))) as overlap from t3 x join t3 y on x.vec_id = y.vec_id and x.rank <> y.rank group by 1, 2)
select t3.vec_id, t3.rank, round(score - avg(score) over (partition by t3.vec_id), 7) as deviation, round(score - coalesce(lead(score) over (partition by t3.vec_id order by t3.rank), score), 6) as margin, round(coalesce(overlap, 0), 4) as overlap from t3 left join o on o.vec_id = t3.vec_id and o.rank = t3.rank""")
def confidence_features(spark: SparkSession, d: str) -> DataFrame:
    """Deviation from the mean score, margin to the next candidate, best inclusive-span F1 with another one."""
    from pyspark.sql import Window

    top = _nbest(spark, d)
    every, ordered = Window.partitionBy("vec_id"), Window.partitionBy("vec_id").orderBy("rank")
    lists = top.withColumn("all", F.collect_list(F.struct("rank", "start", "stop")).over(every))  # at most three per example
    other = F.filter("all", lambda x: x["rank"] != F.col("rank"))
    f1 = lambda x: F.greatest(F.lit(0), F.least(F.col("stop"), x["stop"]) - F.greatest(F.col("start"), x["start"]) + 1) * 2.0 / ((F.col("stop") - F.col("start") + 1) + (x["stop"] - x["start"] + 1))
    return lists.select("vec_id", "rank", F.round(F.col("score") - F.avg("score").over(every), 7).alias("deviation"), F.round(F.col("score") - F.coalesce(F.lead("score").over(ordered), F.col("score")), 6).alias("margin"), F.round(F.coalesce(F.array_max(F.transform(other, f1)), F.lit(0.0)), 4).alias("overlap"))


@query("select example_id, prediction_id, case when yes_no_answer = 1 then 'YES' when yes_no_answer = 0 then 'NO' when passage_index < 0 then 'NONE' when start_position < 0 then 'PASSAGE' else 'SPAN' end as target from predictions")
def target_types(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("yes_no_answer") == 1, "YES").when(F.col("yes_no_answer") == 0, "NO").when(F.col("passage_index") < 0, "NONE").when(F.col("start_position") < 0, "PASSAGE").otherwise("SPAN")
    return table(spark, d, "predictions").select("example_id", "prediction_id", kind.alias("target"))


@query("select prediction_id, case when yes_no_answer >= 0 then -1 else start_position end as start_position, case when yes_no_answer >= 0 then -1 else end_position end as end_position, case yes_no_answer when 1 then 3 when 0 then 4 else 1 end::bigint as target from predictions where confidence_score is not null and not isnan(confidence_score) and confidence_score >= 0.5")
def score_normalizer_apply(spark: SparkSession, d: str) -> DataFrame:
    """Confident rows; boolean answers become YES (3) or NO (4) with a null span."""
    rows = table(spark, d, "predictions").where("confidence_score is not null and not isnan(confidence_score) and confidence_score >= 0.5")
    boolean = F.col("yes_no_answer") >= 0
    return rows.select("prediction_id", F.when(boolean, -1).otherwise(F.col("start_position")).alias("start_position"), F.when(boolean, -1).otherwise(F.col("end_position")).alias("end_position"), F.when(F.col("yes_no_answer") == 1, 3).when(F.col("yes_no_answer") == 0, 4).otherwise(1).cast("bigint").alias("target"))


@query("with t as (select * from (select *, row_number() over (partition by example_id order by confidence_score desc, prediction_id) as n from predictions where confidence_score is not null and not isnan(confidence_score)) where n = 1) select example_id, prediction_id, confidence_score::double as confidence_score, language from t")
def mrc_top_predictions(spark: SparkSession, d: str) -> DataFrame:
    return reading.top_predictions(table(spark, d, "predictions")).select("example_id", "prediction_id", F.col("confidence_score").cast("double").alias("confidence_score"), "language")
