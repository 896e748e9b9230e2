"""Queries of the operators that prepare training text, with their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from answerforge.session import materialize, spread, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


TOP_SQL = """
with one as (select *, row_number() over (partition by example_id, passage_index, start_position, end_position order by prediction_id) as k from predictions),
scored as (select * from one where k = 1 and confidence_score is not null and not isnan(confidence_score)),
ranked as (select *, row_number() over (partition by example_id order by confidence_score desc, rank asc nulls last, prediction_id) as pos from scored)
select {cols} from ranked where pos <= 5"""


WS = "list_transform(regexp_extract_all({c}, '[\\p{{L}}\\p{{N}}]+'), lambda w: lower(w))"


def _grams(c: str, k: int) -> str:
    """SQL: distinct k-word sequences of a text as strings."""
    return f"list_distinct(list_transform(range(1, len({c}) - {k - 2}), lambda i: array_to_string({c}[i:i + {k - 1}], ' ')))"


def _overlap_sql(name: str, source: str, k: int, threshold: float) -> str:
    """SQL: pairs of a training and an evaluation row of one scope whose sets of k-word sequences overlap enough."""
    return f"""{name}_w as (select key, scope, side, {WS.format(c="body")} as ws from ({source}) where body is not null and scope is not null and side is not null),
{name}_s as (select key, scope, side, {_grams("ws", k)} as g from {name}_w where len(ws) >= {k}),
{name}_e as (select key, scope, side, len(g) as n, unnest(g) as x from {name}_s),
{name}_p as (select a.key as t, b.key as e, count(*) as c, any_value(a.n) as na, any_value(b.n) as nb from {name}_e a join {name}_e b on a.scope = b.scope and a.x = b.x where a.side = 'train' and b.side = 'eval' group by 1, 2),
{name} as (select least(t, e) as qa_key_a, greatest(t, e) as qa_key_b, e, c / (na + nb - c) as overlap from {name}_p where c >= {threshold} * (na + nb - c) - 1e-9)"""


SIDE = "case regexp_replace(lower(split), '[^a-z]+', '', 'g') when 'train' then 'train' when 'dev' then 'eval' when 'test' then 'eval' when 'validation' then 'eval' end as side"
_OVERLAP_WITH = (
    "with "
    + _overlap_sql("h", f"select qa_key as key, trim(regexp_replace(lower(nfc_normalize(url_decode(table_id))), '[^\\p{{L}}\\p{{N}}]+', '_', 'g'), '_') as scope, question as body, {SIDE} from hybrid_questions", 1, 0.7)
    + ", "
    + _overlap_sql("c", f"select qa_key as key, 'all' as scope, context as body, {SIDE} from squad_examples", 3, 0.6)
)
OVERLAP_SQL = _OVERLAP_WITH + " select qa_key_a, qa_key_b from h union all select qa_key_a, qa_key_b from c"
OVERLAP_REPORT_SQL = (
    _OVERLAP_WITH
    + """, best as (select e, count(*) as n, max(overlap) as overlap from (select e, overlap from h union all select e, overlap from c) group by e),
about as (select qa_key, 'hybrid_questions' as table_name, split, source from hybrid_questions union all select qa_key, 'squad_examples', split, source from squad_examples)
select table_name, regexp_replace(lower(split), '[^a-z]+', '', 'g') as eval_split, lower(trim(source)) as eval_source, sum(n)::bigint as pairs, count(*) as eval_records, count(*) filter (overlap = 1) as exact_records, round(avg(overlap), 4) as mean_overlap
from best join about on qa_key = e group by 1, 2, 3"""
)
LEAK_SQL = f"""with d as (select doc_id, {WS.format(c="text")} as ws from documents where text is not null), i as (select item_id, {WS.format(c="text")} as ws from benchmark_items where text is not null),
dg as (select doc_id, unnest({_grams("ws", 12)}) as g from d where len(ws) >= 12), ig as (select item_id, unnest({_grams("ws", 12)}) as g from i where len(ws) >= 12)
select distinct doc_id, item_id from dg join ig using (g)"""
GROUP_SQL = f"""with recursive t as (select doc_id as key, text from documents union all select x.passage_key, x.text from (select unnest(negatives) as x from retrieval_triples) where x is not null),
w as (select key, {WS.format(c="text")} as ws from t where text is not null), s as (select key, {_grams("ws", 3)} as g from w where len(ws) >= 20), e as (select key, len(g) as n, unnest(g) as x from s),
p as (select a.key as a, b.key as b, count(*) as c, any_value(a.n) as na, any_value(b.n) as nb from e a join e b on a.x = b.x and a.key < b.key group by 1, 2),
l as (select a, b from p where c >= 0.5 * (na + nb - c) union all select b, a from p where c >= 0.5 * (na + nb - c)),
r as (select a as src, b as dst from l union select r.src, l.b from r join l on r.dst = l.a)
select min(dst) as key_a, src as key_b from r group by src having min(dst) < src"""


_SOURCE = "regexp_replace(lower(trim(source)), '[^\\p{L}\\p{N}]+', '_', 'g')"
BUDGET_SQL = f"""with w as (select {_SOURCE} as source, target_share, max_repeats from source_weights where source is not null),
a as (select {_SOURCE} as source, sum(length(text)) as available, count(*) as docs from documents where text <> '' group by 1),
p as (select source, target_share, max_repeats, coalesce(available, 0) as available, coalesce(docs, 0) as docs from w left join a using (source)),
live as (select * from p where available > 0 and target_share > 0 and max_repeats > 0), t as (select sum(target_share) as share from live),
m as (select min(max_repeats * available * (select share from t) / target_share) as total from live)
select source, available::bigint as available, docs::bigint as docs, round(b, 1) as budget, case when available > 0 then floor(b / available) else 0 end::int as whole_passes
from (select p.*, case when l.source is null then 0 else (select total from m) * p.target_share / (select share from t) end as b from p left join (select source from live) l using (source))"""


def _top(spark: SparkSession, d: str) -> DataFrame:
    from answerforge.llm.topn import top_n_per_group

    key = ["example_id", "passage_index", "start_position", "end_position"]
    return top_n_per_group(table(spark, d, "predictions"), "example_id", "confidence_score", "prediction_id", ["rank"], 5, key)


@query(TOP_SQL.format(cols="example_id, prediction_id"))
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _top(spark, d).select("example_id", "prediction_id")


@query(TOP_SQL.format(cols="example_id, prediction_id, cast(confidence_score as double) as score, cast(pos as bigint) as pos"))
def p2_ranked(spark: SparkSession, d: str) -> DataFrame:
    return _top(spark, d).select("example_id", "prediction_id", F.col("confidence_score").cast("double").alias("score"), F.col("pos").cast("bigint").alias("pos"))


def _edited_texts(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("key"), "text")
    negatives = table(spark, d, "retrieval_triples").select(F.explode("negatives").alias("n"))
    return spread(docs.unionByName(negatives.select(F.col("n.passage_key").alias("key"), F.col("n.text").alias("text"))))


@query(GROUP_SQL)
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    from answerforge.llm.neardup import near_duplicate_groups

    return near_duplicate_groups(_edited_texts(spark, d), "key", "text", k=3, threshold=0.5, min_words=20)


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    from answerforge.llm.leaks import leaked_passages

    return leaked_passages(spread(table(spark, d, "documents").select("doc_id", "text")), "doc_id", "text", table(spark, d, "benchmark_items"), "item_id", "text", min_words=12)


@query(LEAK_SQL)
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d).where("run_words >= 12").select("doc_id", "item_id")


@query()
def p6_leaks(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d)


def _overlaps(spark: SparkSession, d: str) -> DataFrame:
    """Overlapping rows of both tables in one run: their keys differ, and the scopes by their first word."""
    from answerforge.llm.crosssplit import overlap_classes, overlapping_rows, split_records

    questions = split_records(table(spark, d, "hybrid_questions"), "qa_key", F.concat(F.lit("table "), "table_id"), "question", "split", 1, 0.7)
    contexts = split_records(table(spark, d, "squad_examples"), "qa_key", F.lit("context"), "context", "split", 3, 0.6)
    _, members, links = overlap_classes(questions.unionByName(contexts))
    return overlapping_rows(members, links)


@query(OVERLAP_SQL)
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _overlaps(spark, d).select(F.least("train_key", "eval_key").alias("qa_key_a"), F.greatest("train_key", "eval_key").alias("qa_key_b"))


def _evaluation_rows(spark: SparkSession, d: str) -> DataFrame:
    """Per evaluation row that stands in training: its pairs, best overlap and best coverage, table, split and source."""
    found = materialize(_overlaps(spark, d), "overlaps")
    about = None
    for name in ("hybrid_questions", "squad_examples"):
        part = table(spark, d, name).select(F.col("qa_key").alias("eval_key"), F.regexp_replace(F.lower("split"), "[^a-z]+", "").alias("eval_split"), F.lower(F.trim("source")).alias("eval_source"), F.lit(name).alias("table_name"))
        about = part if about is None else about.unionByName(part)
    best = found.groupBy("eval_key").agg(F.count("*").alias("n"), F.max("eval_cover").alias("cover"), F.max("overlap").alias("overlap"))
    return best.join(about, "eval_key")


@query(OVERLAP_REPORT_SQL)
def p4_report(spark: SparkSession, d: str) -> DataFrame:
    """Per table, evaluation split and source: pairs, evaluation records concerned, exact ones, and the mean of the best overlaps."""
    return _evaluation_rows(spark, d).groupBy("table_name", "eval_split", "eval_source").agg(
        F.sum("n").alias("pairs"), F.count("*").alias("eval_records"), F.sum((F.col("overlap") == 1.0).cast("bigint")).alias("exact_records"), F.round(F.avg("overlap"), 4).alias("mean_overlap")
    )


@query()
def p4_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Per evaluation record the share of its words that chained and extended fingerprints cover at best, and its source."""
    return _evaluation_rows(spark, d).select("eval_key", "table_name", "eval_source", F.round("cover", 4).alias("coverage"))


@query()
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    from answerforge.llm.markup import structure_elements, wrong_tokens

    examples = table(spark, d, "nq_examples")
    return structure_elements(examples, "record_id", "document.html").unionByName(wrong_tokens(examples, "record_id", "document.tokens"))


@query()
def p1_clean_text(spark: SparkSession, d: str) -> DataFrame:
    from answerforge.llm.markup import cleaned_documents

    return cleaned_documents(table(spark, d, "nq_examples"), "record_id", "document.html")


def _mixed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    from answerforge.llm.mixing import mix_sources

    return mix_sources(spread(table(spark, d, "documents").select("doc_id", "text", "source")), "doc_id", "text", "source", table(spark, d, "source_weights"))


@query()
def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    return _mixed(spark, d)[0]


@query()
def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return _mixed(spark, d)[1]


@query(BUDGET_SQL)
def p7_budgets(spark: SparkSession, d: str) -> DataFrame:
    """What each source is to give, sized in characters: the plan that p7_mix makes in tokens."""
    from answerforge.llm.mixing import canonical_source, source_budgets

    sized = table(spark, d, "documents").where("text is not null and text <> ''").select("doc_id", canonical_source(F.col("source")).alias("source"), F.length("text").cast("bigint").alias("tokens"))
    budget = source_budgets(sized, table(spark, d, "source_weights"))
    return budget.where("source <> '(no target)'").select("source", "available", "docs", F.round("budget", 1).alias("budget"), "whole_passes")


def _levels(spark: SparkSession, d: str) -> DataFrame:
    from answerforge.llm.level import reading_levels

    return reading_levels(spread(table(spark, d, "documents").select("doc_id", "text", "form")), "doc_id", "text", table(spark, d, "level_labels"), "coalesce(form, '') <> 'table'", 30)


@query()
def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return _levels(spark, d).select("doc_id", "level")


@query()
def p8_profile(spark: SparkSession, d: str) -> DataFrame:
    """Documents and characters by level, language and form."""
    lang = F.lower(F.substring(F.trim("lang"), 1, 2))
    about = table(spark, d, "documents").select("doc_id", F.when(lang.isin("en", "fr", "de", "es"), lang).alias("lang"), "form", F.length("text").alias("chars"))
    levels = _levels(spark, d)
    return about.join(levels, "doc_id").groupBy("level", "lang", "form").agg(F.count("*").alias("docs"), F.sum("chars").cast("bigint").alias("chars"), F.round(F.avg("confidence"), 3).alias("mean_confidence"))


@query("""with t as (select record_id, x, i from (select record_id, document.tokens as ts from nq_examples), unnest(ts) with ordinality u(x, i) where x is not null)
select record_id, 'token' as element, (i - 1)::int as item_no from t where x.is_html is null or x.is_html <> regexp_full_match(x.token, '</?[A-Za-z][^>]*>')""")
def p1_wrong_tokens(spark: SparkSession, d: str) -> DataFrame:
    from answerforge.llm.markup import wrong_tokens

    return wrong_tokens(table(spark, d, "nq_examples"), "record_id", "document.tokens")
