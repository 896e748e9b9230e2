"""Table questions: logical forms in their dialects, column typing, conditions, answers and cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from answerforge.functions import text
from answerforge.operators import logical_form as lf
from answerforge.plans.registry import query
from answerforge.session import table

C = lf.Condition


@query("select c_name as answer from customer where lower(c_mktsegment) = 'building' and c_acctbal > 9000")
def wikisql_select(spark: SparkSession, d: str) -> DataFrame:
    return lf.execute(table(spark, d, "customer"), lf.LogicalForm("c_name", "select", (C("c_mktsegment", "=", "BUILDING"), C("c_acctbal", ">", "9,000"))))


@query("select 'max' as aggregate, round(max(o_totalprice), 2) as answer from orders where o_orderstatus = 'O' union all select 'min', round(min(o_totalprice), 2) from orders where o_orderstatus = 'O' union all select 'count', count(*)::double from orders where o_orderstatus = 'O' union all select 'sum', round(sum(o_totalprice), 2) from orders where o_orderstatus = 'O' union all select 'avg', round(avg(o_totalprice), 4) from orders where o_orderstatus = 'O'")
def wikisql_agg(spark: SparkSession, d: str) -> DataFrame:
    orders, out = table(spark, d, "orders"), None
    for agg, places in (("max", 2), ("min", 2), ("count", 2), ("sum", 2), ("avg", 4)):
        one = lf.execute(orders, lf.LogicalForm("o_totalprice", agg, (C("o_orderstatus", "=", "o"),)))
        one = one.select(F.lit(agg).alias("aggregate"), F.round(F.col("answer").cast("double"), places).alias("answer"))
        out = one if out is None else out.unionByName(one)
    return out


@query("(select 'max' as aggregate, p_partkey, p_retailprice as answer from part where p_size > 20 order by p_retailprice desc, p_partkey desc limit 1) union all (select 'min', p_partkey, p_retailprice from part where p_size > 20 order by p_retailprice, p_partkey limit 1)")
def wikisql_tapas_minmax(spark: SparkSession, d: str) -> DataFrame:
    """One row each: of equal prices the last for max, the first for min."""
    part = table(spark, d, "part")
    one = lambda a: lf.execute(part, lf.LogicalForm("p_retailprice", a, (C("p_size", ">", 20),)), "typed", "p_partkey").select(F.lit(a).alias("aggregate"), "p_partkey", "answer")
    return one("max").unionByName(one("min"))


@query("select p_name as answer from part where list_filter(string_split_regex(lower(p_type), '\\s+'), lambda t: t <> '') = list_filter(string_split_regex(lower((select min(p_type) from part)), '\\s+'), lambda t: t <> '')")
def wikisql_typed_equality(spark: SparkSession, d: str) -> DataFrame:
    """Text cells compared as lists of tokens."""
    part = table(spark, d, "part")
    return lf.execute(part, lf.LogicalForm("p_name", "select", (C("p_type", "=", part.agg(F.min("p_type")).first()[0]),)), "typed")


CELLS = {"part": ("p_partkey", ["p_name", "p_brand", "p_type", "p_size"]), "nation": ("n_nationkey", ["n_name", "n_regionkey"]), "customer": ("c_custkey", ["c_name", "c_nationkey", "c_mktsegment"])}


def _cells_sql(name: str) -> str:
    key, columns = CELLS[name]
    return " union all ".join(f"select {key} as row_id, '{c}' as \"column\", {c}::varchar as value from {name}" for c in columns)


def _cells(spark: SparkSession, d: str, name: str) -> DataFrame:
    return lf.cells(table(spark, d, name), *CELLS[name])


@query("with " + ", ".join(f"{n}_c as ({_cells_sql(n)})" for n in CELLS) + " " + " union all ".join(f"select '{n}' as table_name, \"column\", case when bool_and(try_cast(replace(value, ',', '') as double) is not null) then 'real' else 'text' end as type, count(*) as cells from {n}_c group by 2" for n in CELLS))
def column_types(spark: SparkSession, d: str) -> DataFrame:
    out = None
    for name in CELLS:
        one = lf.column_types(_cells(spark, d, name)).withColumn("table_name", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


@query(f"select distinct \"column\", value, row_id::bigint as row_id from ({_cells_sql('nation')})")
def column_value_rows(spark: SparkSession, d: str) -> DataFrame:
    return lf.value_rows(_cells(spark, d, "nation")).withColumn("row_id", F.col("row_id").cast("bigint"))


@query("with v as (select distinct p_size::double as value from part) select value, op as operator, rows from (select value, '<' as op, (select count(*) from part where p_size < value) as rows from v union all select value, '>', (select count(*) from part where p_size > value) from v) where rows > 0")
def inequality_conditions(spark: SparkSession, d: str) -> DataFrame:
    return lf.inequality_conditions(table(spark, d, "part"), "p_partkey", "p_size")


@query(f"""with c as ({_cells_sql("customer")}), f as (select "column", value, count(*) as n from c group by 1, 2 having count(*) > 1), k as (select c.*, n from c join f using ("column", value))
select a."column" as column_a, a.value as value_a, b."column" as column_b, b.value as value_b, count(*) as rows from k a join k b on a.row_id = b.row_id and a."column" < b."column" group by 1, 2, 3, 4 having count(*) < min(least(a.n, b.n))""")
def where_pairs(spark: SparkSession, d: str) -> DataFrame:
    return lf.where_pairs(_cells(spark, d, "customer"))


@query("select round(avg((lower(trim(h.answer_text)) = lower(trim(o.answer_text)))::int), 6) as accuracy, count(*) as pairs from hybrid_questions h join hybrid_questions o on o.table_id = h.table_id and o.qa_key <> h.qa_key and o.question = h.question where h.answer_text is not null and o.answer_text is not null")
def denotation_accuracy(spark: SparkSession, d: str) -> DataFrame:
    """Agreement of the answers to questions asked twice of one table."""
    h = table(spark, d, "hybrid_questions").where("answer_text is not null").select("qa_key", "table_id", "question", F.lower(F.trim("answer_text")).alias("a"))
    o = h.select("table_id", "question", F.col("qa_key").alias("other"), F.col("a").alias("b"))
    return h.join(o, ["table_id", "question"]).where("qa_key <> other").agg(F.round(F.avg((F.col("a") == F.col("b")).cast("int")), 6).alias("accuracy"), F.count("*").alias("pairs"))


SPANS = "list_sort(list_transform(string_split({c}, ', '), lambda t: coalesce(try_cast(t as double)::varchar, lower(trim(t)))))"


@query(f"with s as (select qa_key, array_to_string(answers.text, ', ') as gold, array_to_string(list_reverse(answers.text), ', ') as pred from squad_examples where answers.text is not null and len(answers.text) > 0) select qa_key, {SPANS.format(c='gold')} = {SPANS.format(c='pred')} as correct from s")
def denotation_multiset(spark: SparkSession, d: str) -> DataFrame:
    """Answers of several spans are equal whatever their order; numbers as numbers."""
    rows = table(spark, d, "squad_examples").where("answers.text is not null and size(answers.text) > 0")
    spans = lambda c: F.array_sort(F.transform(F.split(F.array_join(c, ", "), ", "), lambda t: F.coalesce(t.try_cast("double").cast("string"), F.lower(F.trim(t)))))
    return rows.select("qa_key", (spans(F.col("answers.text")) == spans(F.reverse(F.col("answers.text")))).alias("correct"))


@query("""with c as (select qa_key, trim(answer_text) as s from hybrid_questions where answer_text is not null)
select qa_key, case when regexp_matches(s, '^[-+]?(\\d+\\.?\\d*|\\.\\d+)([eE][-+]?\\d+)?$') then try_cast(s as double) when regexp_matches(s, '^[-+]?\\d{1,3}(,\\d{3})+(\\.\\d+)?$') then try_cast(replace(s, ',', '') as double) when regexp_matches(s, '^[-+]?\\d+,\\d+$') then try_cast(replace(s, ',', '.') as double) when regexp_matches(s, '^[-+]?\\d+(\\.\\d+){2,}$') then try_cast(replace(s, '.', '') as double) end as number from c""")
def convert_to_float(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "hybrid_questions").where("answer_text is not null").select("qa_key", text.to_number(F.col("answer_text")).alias("number"))


@query("""with c as (select lower(trim(c_name)) as s from customer union all select c_acctbal::varchar from customer union all select lower(c_mktsegment) from customer union all select strftime(o_orderdate, '%Y-%m-%d') from orders)
select case when coalesce(s, '') = '' then 'empty' when regexp_matches(s, '^\\d{4}-\\d{2}-\\d{2}') then 'date' when regexp_matches(s, '^[-+]?(\\d+\\.?\\d*|\\.\\d+)([eE][-+]?\\d+)?$') then 'number' else 'word' end as kind, count(*) as cells from c group by 1""")
def cell_types(spark: SparkSession, d: str) -> DataFrame:
    """Kinds of the cells of customers and order dates."""
    customer = table(spark, d, "customer")
    values = [customer.select(F.col(c).cast("string").alias("s")) for c in ("c_name", "c_acctbal", "c_mktsegment")]
    values.append(table(spark, d, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("s")))
    out = values[0]
    for v in values[1:]:
        out = out.unionByName(v)
    return out.groupBy(text.cell_kind(F.col("s")).alias("kind")).agg(F.count("*").alias("cells"))


@query("select n_nationkey, 'n_name is ' || n_name || ' . n_regionkey is ' || n_regionkey || ' . ' as line from nation")
def linearize_rows(spark: SparkSession, d: str) -> DataFrame:
    cols = ["n_name", "n_regionkey"]
    return table(spark, d, "nation").select("n_nationkey", text.linearize(F.array(*[F.lit(c) for c in cols]), F.array(*[F.col(c).cast("string") for c in cols])).alias("line"))


@query("select r_name || ' [HEAD] n_nationkey | n_name' || string_agg(' [ROW] ' || n_nationkey || ' | ' || n_name, '' order by n_nationkey) as line from nation join region on r_regionkey = n_regionkey group by r_name")
def linearize_table(spark: SparkSession, d: str) -> DataFrame:
    """A region's nations as one line: title, head, rows."""
    rows = table(spark, d, "nation").join(table(spark, d, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    lists = rows.groupBy("r_name").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("rs"))
    body = F.array_join(F.transform("rs", lambda r: F.concat(F.lit(" [ROW] "), r["n_nationkey"].cast("string"), F.lit(" | "), r["n_name"])), "")
    return lists.select(F.concat("r_name", F.lit(" [HEAD] n_nationkey | n_name"), body).alias("line"))


@query(f"""with c as ({_cells_sql("nation")}), n as (select *, lower(trim(value)) as v, count(*) over (partition by lower(trim(value))) as same from c), a as (select lower(n_name) as v from nation where n_regionkey = 1)
select row_id::bigint as row_id, "column", value from n join a using (v) where same = 1""")
def answer_coordinates(spark: SparkSession, d: str) -> DataFrame:
    """Cells that hold an answer; an answer that stands in several cells is ambiguous and left out."""
    cells = _cells(spark, d, "nation").withColumn("v", F.lower(F.trim("value")))
    answers = table(spark, d, "nation").where("n_regionkey = 1").select(F.lower("n_name").alias("v"))
    unique = cells.groupBy("v").agg(F.count("*").alias("same"), F.min(F.struct(F.col("row_id").cast("bigint").alias("row_id"), "column", "value")).alias("x")).where("same = 1")
    return unique.join(answers, "v", "left_semi").select("x.row_id", "x.column", "x.value")


@query("select n_regionkey::bigint as region, string_agg(n_name, ', ' order by n_nationkey) as answer from nation group by 1")
def coordinates_to_answer(spark: SparkSession, d: str) -> DataFrame:
    """Selected cells joined to an answer text, in row order."""
    lists = table(spark, d, "nation").groupBy(F.col("n_regionkey").cast("bigint").alias("region")).agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("x"))
    return lists.select("region", F.array_join(F.transform("x", lambda r: r["n_name"]), ", ").alias("answer"))


@query("select c_nationkey::bigint as nation, string_agg(distinct 'customers in ' || n_name || ' [SEP] ' || c_mktsegment || ' [ENT] ' || n_name, ' # ' order by 'customers in ' || n_name || ' [SEP] ' || c_mktsegment || ' [ENT] ' || n_name) as links from customer join nation on n_nationkey = c_nationkey group by 1")
def link_generation(spark: SparkSession, d: str) -> DataFrame:
    """One line per distinct cell of a nation, joined by ' # '."""
    rows = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    line = F.concat(F.lit("customers in "), "n_name", F.lit(" [SEP] "), "c_mktsegment", F.lit(" [ENT] "), "n_name")
    distinct = rows.select(F.col("c_nationkey").cast("bigint").alias("nation"), line.alias("l")).distinct()
    return distinct.groupBy("nation").agg(F.array_join(F.array_sort(F.collect_list("l")), " # ").alias("links"))


@query("select table_id, '/wiki/' || replace(regexp_replace(table_id, '_\\d+$', ''), ' ', '_') as path, regexp_extract(table_id, '_(\\d+)$', 1) as table_no from hybrid_questions where table_id is not null group by 1")
def link_paths(spark: SparkSession, d: str) -> DataFrame:
    ids = table(spark, d, "hybrid_questions").where("table_id is not null").select("table_id").distinct()
    return ids.select("table_id", F.concat(F.lit("/wiki/"), F.replace(F.regexp_replace("table_id", r"_\d+$", ""), F.lit(" "), F.lit("_"))).alias("path"), F.regexp_extract("table_id", r"_(\d+)$", 1).alias("table_no"))


@query("""with c as (select n_nationkey as row_id, unnest([n_name, r_name, 'key ' || n_nationkey]) as cell, unnest([0, 1, 2]) as pos from nation join region on r_regionkey = n_regionkey)
select a.row_id::bigint as row_id, a.cell as hop, b.cell as answer from c a join c b on a.row_id = b.row_id and a.pos < b.pos where len(string_split(b.cell, ' ')) <= 4""")
def hybrid_chains(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of a row's cells, the second short enough to be an answer."""
    rows = table(spark, d, "nation").join(table(spark, d, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    cells = rows.select(F.col("n_nationkey").cast("bigint").alias("row_id"), F.array("n_name", "r_name", F.concat(F.lit("key "), F.col("n_nationkey").cast("string"))).alias("cs"))
    first = cells.select("row_id", "cs", F.posexplode("cs").alias("p", "hop"))
    return first.select("row_id", "hop", F.explode(F.slice("cs", F.col("p") + 2, 3)).alias("answer")).where(F.size(F.split("answer", " ")) <= 4)


W = "list_filter(string_split_regex(lower({c}), '[^a-z0-9]+'), lambda t: t <> '')"


@query(f"""with p as (select unnest(negatives) as x from retrieval_triples), c as (select x.passage_key as pk, x.text as t from p where x is not null and x.text is not null),
n as (select count(*)::double as n from c), tf as (select pk, term, count(*) as tf from (select pk, unnest({W.format(c="t")}) as term from c) group by 1, 2), df as (select term, count(*) as df from tf group by 1),
w as (select pk, term, tf * (ln((1 + (select n from n)) / (1 + df)) + 1) as w from tf join df using (term)), l as (select pk, sqrt(sum(w * w)) as len from w group by 1),
q as (select id, term, count(*) as qtf from (select id, unnest({W.format(c="query")}) as term from retrieval_triples where query is not null) group by 1, 2), qw as (select id, term, qtf * (ln((1 + (select n from n)) / (1 + df)) + 1) as w from q join df using (term)), ql as (select id, sqrt(sum(w * w)) as len from qw group by 1),
own as (select id, x.passage_key as pk from (select id, unnest(negatives) as x from retrieval_triples) where x is not null)
select own.id, own.pk, round(sum(qw.w * w.w) / any_value(ql.len * l.len), 6) as similarity from own join qw on qw.id = own.id join w on w.pk = own.pk and w.term = qw.term join ql on ql.id = own.id join l on l.pk = own.pk group by 1, 2""")
def tfidf_similarity(spark: SparkSession, d: str) -> DataFrame:
    """Cosine of tf-idf weights (smooth idf) of each query with its own negatives."""
    rows = table(spark, d, "retrieval_triples")
    own = rows.select("id", F.explode("negatives").alias("x")).where("x is not null").select("id", F.col("x.passage_key").alias("pk"), F.col("x.text").alias("t"))
    texts = own.where("t is not null").select("pk", "t")
    n = float(texts.count())
    tf = texts.select("pk", F.explode(text.words(F.col("t"))).alias("term")).groupBy("pk", "term").agg(F.count("*").alias("tf"))
    idf = tf.groupBy("term").agg((F.log((1 + F.lit(n)) / (1 + F.count("*"))) + 1).alias("idf"))
    w = tf.join(idf, "term").select("pk", "term", (F.col("tf") * F.col("idf")).alias("w"))
    length = w.groupBy("pk").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("len"))
    q = rows.where("query is not null").select("id", F.explode(text.words(F.col("query"))).alias("term")).groupBy("id", "term").agg(F.count("*").alias("qtf")).join(idf, "term").select("id", "term", (F.col("qtf") * F.col("idf")).alias("qw"))
    qlen = q.groupBy("id").agg(F.sqrt(F.sum(F.col("qw") * F.col("qw"))).alias("qlen"))
    dots = own.select("id", "pk").join(q, "id").join(w, ["pk", "term"]).groupBy("id", "pk").agg(F.sum(F.col("qw") * F.col("w")).alias("dot"))
    return dots.join(length, "pk").join(qlen, "id").select("id", "pk", F.round(F.col("dot") / (F.col("len") * F.col("qlen")), 6).alias("similarity"))


_CELL = "answer_text || case qa_key % 4 when 0 then '[12] ' when 1 then ' (in part) (x)' when 2 then '†*' else '.' end"
NORMAL_SQL = f"""with a as (select qa_key, trim(translate(strip_accents(nfc_normalize({_CELL})), '‘’´`“”‐‑‒–—−', chr(39) || chr(39) || chr(39) || chr(39) || '""------')) as x from hybrid_questions where answer_text is not null and trim(answer_text) <> ''),
b as (select qa_key, regexp_replace(trim(regexp_replace(x, '(\\[[^\\]]*\\]|[•♦†‡*#+])*$', '')), '( \\([^)]*\\))*$', '') as x from a),
c as (select qa_key, regexp_replace(trim(x), '^"([^"]*)"$', '\\1') as x from b)
select qa_key, trim(regexp_replace(lower(regexp_replace(x, '\\.$', '')), '\\s+', ' ', 'g')) as cell from c"""


@query(NORMAL_SQL)
def normalized_cells(spark: SparkSession, d: str) -> DataFrame:
    """Cells with notes, brackets and signs at their ends, normalised for comparison."""
    from answerforge.functions.cells import normalize_cell

    k = F.col("qa_key") % 4
    cell = F.concat("answer_text", F.when(k == 0, "[12] ").when(k == 1, " (in part) (x)").when(k == 2, "†*").otherwise("."))
    return table(spark, d, "hybrid_questions").where("answer_text is not null and trim(answer_text) <> ''").select("qa_key", normalize_cell(cell).alias("cell"))


@query("select qa_key, url_decode(table_id) as key from hybrid_questions where table_id is not null")
def document_keys(spark: SparkSession, d: str) -> DataFrame:
    from answerforge.functions.cells import document_key

    return table(spark, d, "hybrid_questions").where("table_id is not null").select("qa_key", document_key(F.col("table_id")).alias("key"))


@query("select vec_id, len(embedding) as dims, true as near from embeddings where embedding is not null")
def half_precision_text(spark: SparkSession, d: str) -> DataFrame:
    """Vectors through base64 of half-precision floats: every value within a half-precision step."""
    from answerforge.functions.cells import text_to_vector, vector_to_text

    e = table(spark, d, "embeddings").where("embedding is not null").select("vec_id", "embedding", text_to_vector(vector_to_text(F.col("embedding"))).alias("back"))
    near = F.forall(F.zip_with("embedding", "back", lambda a, b: F.abs(a - b) <= F.abs(a) / 1024 + 1e-7), lambda x: x)
    return e.select("vec_id", F.size("back").cast("bigint").alias("dims"), near.alias("near"))


@query("select doc_id, text from documents where text is not null")
def compressed_text(spark: SparkSession, d: str) -> DataFrame:
    """Texts through compression and back."""
    from answerforge.functions.cells import compress_text, decompress_text

    return table(spark, d, "documents").where("text is not null").select("doc_id", decompress_text(compress_text(F.col("text"))).alias("text"))
