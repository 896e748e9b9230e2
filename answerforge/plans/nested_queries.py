"""Queries of the nested-records operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from answerforge.operators import nested
from answerforge.plans.registry import query
from answerforge.session import table


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    payloads = nested.annotation_payloads(table(spark, d, "nq_examples"), table(spark, d, "nq_raw"))
    return nested.label_nodes(payloads, "record_id", "payload")


INT = "try_cast(json_extract_string({c}, '$') as bigint)"
NODES = f"""pay as (select record_id, case when json_valid(payload) then payload::json end as j from nq_raw union all select record_id, json_object('annotations', to_json(annotations)) from nq_examples where annotations is not null),
top as (select record_id, case when json_type(j, '$.annotations') is null and json_type(j, '$.example') is not null then case json_type(j, '$.example') when 'VARCHAR' then try_cast(json_extract_string(j, '$.example') as json) else json_extract(j, '$.example') end else j end as j from pay where json_type(j) = 'OBJECT'),
ann as (select record_id, case json_type(j, '$.annotations') when 'VARCHAR' then try_cast(json_extract_string(j, '$.annotations') as json) else json_extract(j, '$.annotations') end as a from top),
kind as (select record_id, a, case when json_type(a) = 'ARRAY' then 'list' when json_type(a) = 'OBJECT' and 'ARRAY' in (json_type(a, '$.id'), json_type(a, '$.long_answer'), json_type(a, '$.yes_no_answer')) then 'columns' when json_type(a) = 'OBJECT' then 'one' end as k from ann),
each as (
 select record_id, i as no, json_extract(a, '$[' || (i - 1) || ']') as n from (select record_id, a, unnest(range(1, json_array_length(a)::bigint + 1)) as i from kind where k = 'list')
 union all select record_id, 1, a from kind where k = 'one'
 union all select record_id, i, json_object('long_answer', json_extract(a, '$.long_answer[' || (i - 1) || ']'), 'short_answers', json_extract(a, '$.short_answers[' || (i - 1) || ']')) from (select record_id, a, unnest(range(1, greatest(coalesce(json_array_length(a, '$.id'), 0), coalesce(json_array_length(a, '$.long_answer'), 0), coalesce(json_array_length(a, '$.short_answers'), 0), coalesce(json_array_length(a, '$.yes_no_answer'), 0))::bigint + 1)) as i from kind where k = 'columns')),
note as (select * from each where json_type(n) = 'OBJECT'),
sh as (select record_id, no, json_extract(n, '$.short_answers') as s from note),
short as (
 select record_id, no, i, json_extract(s, '$[' || (i - 1) || '].start_byte') as b from (select record_id, no, s, unnest(range(1, json_array_length(s)::bigint + 1)) as i from sh where json_type(s) = 'ARRAY')
 union all select record_id, no, i, json_extract(s, '$.start_byte[' || (i - 1) || ']') from (select record_id, no, s, unnest(range(1, json_array_length(s, '$.start_byte')::bigint + 1)) as i from sh where json_type(s) = 'OBJECT' and json_type(s, '$.start_byte') = 'ARRAY')
 union all select record_id, no, 1, json_extract(s, '$.start_byte') from sh where json_type(s) = 'OBJECT' and json_type(s, '$.start_byte') <> 'ARRAY')"""


@query(f"""with {NODES}
select record_id, 'annotation' as kind, no::int as annotation_no, 0 as item_no from note
union all select record_id, 'long_answer', no::int, 0 from note where {INT.format(c="json_extract(n, '$.long_answer.start_byte')")} >= 0
union all select record_id, 'short_answer', no::int, i::int from short where {INT.format(c="b")} >= 0""")
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return nested.answer_rows(_nodes(spark, d))


@query()
def p3_short_answers(spark: SparkSession, d: str) -> DataFrame:
    return nested.node_tables(_nodes(spark, d))["short_answer"]


@query()
def p3_long_answers(spark: SparkSession, d: str) -> DataFrame:
    return nested.node_tables(_nodes(spark, d))["long_answer"]


@query()
def p3_annotations(spark: SparkSession, d: str) -> DataFrame:
    return nested.node_tables(_nodes(spark, d))["annotation"]


@query("""with a as (select record_id, i as no, n from (select record_id, annotations from nq_examples where annotations is not null), unnest(annotations) with ordinality u(n, i) where n is not null),
s as (select record_id, no, i, x from a, unnest(n.short_answers) with ordinality u(x, i) where x is not null)
select record_id, 'long_answer' as kind, no::int as annotation_no, 0 as item_no, n.long_answer.start_byte as start_byte, n.long_answer.end_byte as end_byte, n.long_answer.start_token as start_token, n.long_answer.end_token as end_token from a where n.long_answer is not null
union all select record_id, 'short_answer', no::int, i::int, x.start_byte, x.end_byte, x.start_token, x.end_token from s""")
def p3_typed_answers(spark: SparkSession, d: str) -> DataFrame:
    """Answers of the typed examples with the number of the annotation whose interval holds theirs, and all their offsets."""
    examples = table(spark, d, "nq_examples")
    payloads = nested.annotation_payloads(examples, table(spark, d, "nq_raw").where("false"))
    tables = nested.node_tables(nested.label_nodes(payloads, "record_id", "payload"))
    span = ["start_byte", "end_byte", "start_token", "end_token"]
    long = tables["long_answer"].select("record_id", F.lit("long_answer").alias("kind"), "annotation_no", F.lit(0).alias("item_no"), *span)
    return long.unionByName(tables["short_answer"].select("record_id", F.lit("short_answer").alias("kind"), "annotation_no", "item_no", *span))
