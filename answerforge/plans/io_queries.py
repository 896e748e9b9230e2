"""Readers and writers by round trips: a table is written in a format, read back, and must be what SQL says of the table."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from answerforge.plans.registry import query
from answerforge.session import own_folder, table
from answerforge.sources import readers, writers

CLEAN = "regexp_replace(coalesce({c}, ''), '[\t\r\n]', ' ', 'g')"


def _clean(c: str) -> Column:
    return F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"[\t\r\n]", " ")


def _target(spark: SparkSession, name: str) -> str:
    return f"{own_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").select(F.col("doc_id").cast("string").alias("pid"), "text", "title")


CORPUS = f"select doc_id::varchar as pid, {CLEAN.format(c='title')} as title, {CLEAN.format(c='text')} as text from documents where text is not null"


@query(CORPUS)
def corpus_tsv(spark: SparkSession, d: str) -> DataFrame:
    path = _target(spark, "corpus")
    writers.write_corpus(_docs(spark, d), path)
    return readers.read_corpus(spark, path)


@query(CORPUS)
def corpus_tsv_gzip(spark: SparkSession, d: str) -> DataFrame:
    path = _target(spark, "corpus")
    writers.write_corpus(_docs(spark, d), path, "gzip")
    return readers.read_corpus(spark, path)


@query("select doc_id::varchar as pid, coalesce(title, '') as title, text from documents where text is not null")
def corpus_jsonl(spark: SparkSession, d: str) -> DataFrame:
    """Fields under their other names: id and contents."""
    path = _target(spark, "corpus")
    _docs(spark, d).select(F.col("pid").alias("id"), F.col("text").alias("contents"), "title").write.json(path)
    return readers.read_corpus(spark, path, "jsonl")


@query(f"select doc_id::varchar as pid, {CLEAN.format(c='text')} as text, {CLEAN.format(c='title')} as title from documents where text is not null and {CLEAN.format(c='text')} <> ''")
def passage_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines of three fields without header."""
    path = _target(spark, "lines")
    _docs(spark, d).select(F.concat_ws("\t", "pid", _clean("text"), _clean("title"))).where(_clean("text") != "").write.text(path)
    return readers.read_passage_lines(spark, path).select("pid", "text", "title")


@query("select doc_id::varchar as id, coalesce(title, '') || chr(9) || replace(text, chr(9), ' ') as contents from documents where text is not null")
def index_lines_file(spark: SparkSession, d: str) -> DataFrame:
    path = _target(spark, "index")
    writers.write_index_lines(_docs(spark, d), path)
    return spark.read.schema("id string, contents string").json(path)


@query(f"select qa_key::varchar as qid, {CLEAN.format(c='question')} as question from hybrid_questions where trim({CLEAN.format(c='question')}) <> ''")
def queries_tsv(spark: SparkSession, d: str) -> DataFrame:
    path = _target(spark, "queries")
    rows = table(spark, d, "hybrid_questions").select(F.col("qa_key").cast("string").alias("qid"), _clean("question").alias("question"))
    rows.where(F.trim("question") != "").write.options(**writers.TAB_LINES).csv(path)
    return readers.read_queries(spark, path)


@query("select qa_key::varchar as qid, question, case when answer_text is null then null else [answer_text] end as answers, 'en' as lang from hybrid_questions")
def qas_jsonl(spark: SparkSession, d: str) -> DataFrame:
    path = _target(spark, "qas")
    answers = F.when(F.col("answer_text").isNotNull(), F.array("answer_text"))
    table(spark, d, "hybrid_questions").select(F.col("qa_key").cast("string").alias("qid"), "question", answers.alias("answers"), F.lit("en").alias("lang")).write.json(path)
    return readers.read_qas(spark, path)


@query("select distinct doc_id % 50 as qid, doc_id from level_labels where level > 0 and doc_id is not null")
def qrels_tsv(spark: SparkSession, d: str) -> DataFrame:
    """Judgements; repeated lines count once, those of level 0 not at all."""
    path = _target(spark, "qrels")
    rows = table(spark, d, "level_labels").where("doc_id is not null")
    rows.select(F.col("doc_id") % 50, F.lit(0), "doc_id", F.coalesce("level", F.lit(0))).write.option("sep", "\t").csv(path)
    return readers.read_qrels(spark, path)


@query("select doc_id % 50 as qid, doc_id, row_number() over (partition by doc_id % 50 order by doc_id)::int as rank, round(1.0::double / doc_id, 9) as score from documents where doc_id > 0")
def ranking_tsv(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    path = _target(spark, "ranking")
    w = Window.partitionBy("qid").orderBy("doc_id")
    rows = table(spark, d, "documents").where("doc_id > 0").select((F.col("doc_id") % 50).alias("qid"), "doc_id", F.round(1.0 / F.col("doc_id"), 9).alias("score"))
    writers.write_ranking(rows.withColumn("rank", F.row_number().over(w)), path)
    return readers.read_ranking(spark, path)


@query("select qid, array_to_string(docs[1:2], ',') as docs from (select id as qid, list_filter(list_transform(negatives, lambda x: x.passage_key), lambda x: x is not null) as docs from retrieval_triples where negatives is not null)")
def triples_jsonl(spark: SparkSession, d: str) -> DataFrame:
    """Lines [query, passage, ...], cut to two passages."""
    path = _target(spark, "triples")
    ids = F.transform(F.filter(F.transform("negatives", lambda x: x["passage_key"]), lambda x: x.isNotNull()), lambda x: x.cast("string"))
    table(spark, d, "retrieval_triples").where("negatives is not null").select(F.to_json(F.concat(F.array("id"), ids))).write.text(path)
    return readers.read_triples(spark, path, 2).select("qid", F.array_join(F.transform("docs", lambda x: x.cast("string")), ",").alias("docs"))


@query("select id, title, context, question, array_to_string(list_transform(answers.text, lambda x: coalesce(x, '')), '|') as answers from squad_examples where answers is not null and context is not null and question is not null")
def squad_json(spark: SparkSession, d: str) -> DataFrame:
    """Nested data, paragraphs, questions; one file a partition."""
    path = _target(spark, "squad")
    rows = table(spark, d, "squad_examples").where("answers is not null and context is not null and question is not null")
    answers = F.transform(F.arrays_zip("answers.text", "answers.answer_start"), lambda a: F.struct(F.coalesce(a["text"], F.lit("")).alias("text"), a["answer_start"].alias("answer_start")))
    qas = F.array(F.struct("id", "question", answers.alias("answers")))
    article = F.struct("title", F.array(F.struct("context", qas.alias("qas"))).alias("paragraphs"))
    files = rows.groupBy(F.pmod(F.xxhash64("id"), F.lit(8)).alias("file")).agg(F.collect_list(article).alias("data"))
    files.select("data").write.option("maxRecordsPerFile", 1).json(path)
    return readers.read_squad(spark, path).select("id", "title", "context", "question", F.array_join("answers.text", "|").alias("answers"))


@query("select id, context, question, array_to_string(list_transform(answers.text, lambda x: coalesce(x, '')), '|') as answers from squad_examples where answers is not null and context is not null and question is not null")
def mrqa_jsonl(spark: SparkSession, d: str) -> DataFrame:
    path = _target(spark, "mrqa")
    rows = table(spark, d, "squad_examples").where("answers is not null and context is not null and question is not null")
    found = F.transform(F.arrays_zip("answers.text", "answers.answer_start"), lambda a: F.struct(F.coalesce(a["text"], F.lit("")).alias("text"), F.array(F.array(a["answer_start"], a["answer_start"])).alias("char_spans")))
    rows.select("context", F.array(F.struct(F.col("id").alias("qid"), "question", found.alias("detected_answers"))).alias("qas")).write.json(path)
    return readers.read_mrqa(spark, path).select("id", "context", "question", F.array_join("answers.text", "|").alias("answers"))


@query("select example_id, row_number() over (partition by example_id order by prediction_id)::int - 1 as \"order\", prediction_id from predictions where passage_index = 0")
def predictions_json(spark: SparkSession, d: str) -> DataFrame:
    """Files that are one map from example to its candidates."""
    path = _target(spark, "predictions")
    lists = table(spark, d, "predictions").where("passage_index = 0").groupBy("example_id").agg(F.array_sort(F.collect_list(F.struct("prediction_id"))).alias("cs"))
    maps = lists.groupBy(F.pmod(F.xxhash64("example_id"), F.lit(16)).alias("file")).agg(F.map_from_entries(F.collect_list(F.struct("example_id", "cs"))).alias("m"))
    maps.select(F.to_json("m")).write.option("maxRecordsPerFile", 1).text(path)
    return readers.read_predictions(spark, path).select("example_id", F.col("order").cast("int").alias("order"), F.get_json_object("candidate", "$.prediction_id").cast("bigint").alias("prediction_id"))


@query("select record_id::varchar as example_id, question.text as question_text, len(annotations)::int as annotations from nq_examples where record_id % 2 = 0 and annotations is not null")
def annotated_jsonl(spark: SparkSession, d: str) -> DataFrame:
    """Annotated examples of JSON lines, only those asked for."""
    path = _target(spark, "annotated")
    rows = table(spark, d, "nq_examples").where("annotations is not null").select(F.col("record_id").cast("string").alias("example_id"), F.col("question.text").alias("question_text"), "annotations")
    rows.write.json(path)
    ids = table(spark, d, "nq_examples").where("record_id % 2 = 0").select(F.col("record_id").cast("string").alias("id"))
    return readers.read_annotated(spark, path, ids).select("example_id", "question_text", F.size("annotations").alias("annotations"))


@query("select qid, lang, array_to_string(ctxs, '|') as ctxs from (select doc_id % 20 as qid, list(upper(form) order by doc_id)[1:3] as ctxs from documents where form is not null group by 1) left join (select unnest([1, 2, 3]) as l, unnest(['fi', 'ja', 'ko']) as lang) on l = qid")
def xor_jsonl(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    path = _target(spark, "xor")
    hits = table(spark, d, "documents").where("form is not null").select((F.col("doc_id") % 20).alias("qid"), F.row_number().over(Window.partitionBy(F.col("doc_id") % 20).orderBy("doc_id")).alias("rank"), F.upper("form").alias("text"))
    writers.write_xor(hits, spark.createDataFrame([(1, "fi"), (2, "ja"), (3, "ko")], "qid bigint, lang string"), path, 3)
    return spark.read.schema("id bigint, lang string, ctxs array<string>").json(path).select(F.col("id").alias("qid"), "lang", F.array_join("ctxs", "|").alias("ctxs"))


@query("select vec_id::varchar as pid, 'label ' || label as title, len(embedding) as dims, round(list_sum(embedding::double[]), 4) as total from embeddings")
def vectors_parquet(spark: SparkSession, d: str) -> DataFrame:
    """Passages with their vectors."""
    path = _target(spark, "vectors")
    rows = table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("pid"), F.concat(F.lit("label "), F.col("label").cast("string")).alias("title"), F.lit("").alias("text"), F.col("embedding").alias("vector"))
    writers.write_vectors(rows, path)
    total = F.aggregate("vector", F.lit(0.0).cast("double"), lambda a, x: a + x.cast("double"))
    return spark.read.parquet(path).select("pid", "title", F.size("vector").cast("bigint").alias("dims"), F.round(total, 4).alias("total"))


@query("select doc_id, n_chars from documents")
def shuffled_shards(spark: SparkSession, d: str) -> DataFrame:
    path = _target(spark, "shards")
    writers.write_shards(table(spark, d, "documents").select("doc_id", "n_chars"), path, 4, 7)
    return spark.read.parquet(path)


@query("select doc_id, form from documents where form is not null")
def routed_files(spark: SparkSession, d: str) -> DataFrame:
    """One folder per value."""
    path = _target(spark, "routed")
    writers.write_routed(table(spark, d, "documents").where("form is not null").select("doc_id", "form"), path, "form")
    return spark.read.parquet(path).select("doc_id", F.col("form").cast("string").alias("form"))


@query("select n_name as value from nation union all select r_name from region")
def lines_of_files(spark: SparkSession, d: str) -> DataFrame:
    """Lines of two compressed folders, named together."""
    paths = []
    for name, column, codec in (("nation", "n_name", "gzip"), ("region", "r_name", "bzip2")):
        paths.append(_target(spark, name))
        table(spark, d, name).select(column).write.option("compression", codec).text(paths[-1])
    return readers.read_lines(spark, paths)


@query("select (row_number() over (order by n_nationkey) - 1)::int as line_no, n_name as left_line, n_regionkey::varchar as right_line from nation")
def parallel_files(spark: SparkSession, d: str) -> DataFrame:
    """Two files joined by line number, as texts and their translations are."""
    left, right = _target(spark, "left"), _target(spark, "right")
    rows = table(spark, d, "nation").coalesce(1).sortWithinPartitions("n_nationkey")
    rows.select("n_name").write.text(left)
    rows.select(F.col("n_regionkey").cast("string")).write.text(right)
    both = readers.aligned_lines(spark, left, right).where("left <> ''")
    return both.select("line_no", F.col("left").alias("left_line"), F.col("right").alias("right_line"))


@query("select row_number() over (order by r_regionkey)::int as row_id, r_name as name, r_regionkey::varchar as key from region")
def table_cells_csv(spark: SparkSession, d: str) -> DataFrame:
    """Cells of a CSV table with a header, brought together again by row."""
    path = _target(spark, "tables")
    table(spark, d, "region").coalesce(1).sortWithinPartitions("r_regionkey").select("r_regionkey", "r_name").write.option("header", True).csv(path)
    cells = readers.read_table_cells(spark, path).where("row_id > 0")
    return cells.groupBy("table_id", "row_id").agg(F.max(F.when(F.col("col_id") == 1, F.col("value"))).alias("name"), F.max(F.when(F.col("col_id") == 0, F.col("value"))).alias("key")).select(F.col("row_id").cast("int").alias("row_id"), "name", "key")


@query("select qa_key::varchar as qid, len(string_split(x, '::'))::int as answers from (select qa_key, case when qa_key % 3 = 0 then 'a::b' else 'c' end as x from hybrid_questions)")
def answers_tsv(spark: SparkSession, d: str) -> DataFrame:
    path = _target(spark, "answers")
    rows = table(spark, d, "hybrid_questions").select(F.col("qa_key").alias("qid"), F.when(F.col("qa_key") % 3 == 0, "a::b").otherwise("c").alias("answers"))
    rows.write.option("sep", "\t").option("header", True).csv(path)
    return readers.read_answers_tsv(spark, path).select("qid", F.size("answers").alias("answers"))


@query("select n_nationkey as key, n_name as name from nation union all select r_regionkey, r_name from region")
def manifest(spark: SparkSession, d: str) -> DataFrame:
    """Datasets named in a manifest as one."""
    entries = []
    for name, key, column in (("nation", "n_nationkey", "n_name"), ("region", "r_regionkey", "r_name")):
        entries.append({"path": _target(spark, name), "format": "parquet"})
        table(spark, d, name).select(F.col(key).alias("key"), F.col(column).alias("name")).write.parquet(entries[-1]["path"])
    return readers.read_manifest(spark, entries)


@query("select case when doc_id % 3 = 0 then (row_number() over (order by doc_id))::varchar else 'd' || doc_id end as key, doc_id from documents")
def inserted_ids(spark: SparkSession, d: str) -> DataFrame:
    """Ids for rows that came without one."""
    rows = table(spark, d, "documents").select(F.when(F.col("doc_id") % 3 != 0, F.concat(F.lit("d"), F.col("doc_id").cast("string"))).alias("key"), "doc_id")
    return readers.numbered_when_empty(rows, "key", ["doc_id"])


@query("select s.event_id, event_type from events s")
def ingested_stream(spark: SparkSession, d: str) -> DataFrame:
    """Events that arrive twice, in two files and two runs, are in the target once."""
    from answerforge.streaming import ingest

    source, target, state = _target(spark, "arriving"), _target(spark, "target"), _target(spark, "state")
    rows = table(spark, d, "events").select("event_id", "event_type")
    for _ in range(2):
        rows.coalesce(2).write.mode("append").parquet(source)
        ingest.ingest_passages(ingest.read_stream(spark, source, rows.schema), target, state, "event_id")
    return spark.read.parquet(target).select("event_id", "event_type")


@query("select doc_id, coalesce(title, '') as title, text from documents where text is not null")
def stored_index_documents(spark: SparkSession, d: str) -> DataFrame:
    """The documents of a catalogued index."""
    from answerforge.service import IndexStore

    store = IndexStore(spark, _target(spark, "store"))
    made = store.generate(table(spark, d, "documents").where("text is not null").select("doc_id", "title", "text"), "VectorRetriever")
    return store.documents(made)


@query("select unnest(['pid: missing instead of string', 'title: bigint instead of string']) as difference")
def schema_differences(spark: SparkSession, d: str) -> DataFrame:
    """What a frame lacks of a schema."""
    from answerforge.operators.prepare import validate_schema

    rows = table(spark, d, "documents").select("text", F.col("doc_id").alias("title"))
    return spark.createDataFrame([(x,) for x in validate_schema(rows, "pid string, title string, text string")], "difference string")
