"""Readers of the toolkit's file formats, all as DataFrames with explicit schemas. Compression by suffix."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RANKING = "qid bigint, doc_id bigint, rank int, score double"
#: Names under which a passage's fields may come.
ALIASES = {"pid": ("pid", "id"), "title": ("title",), "text": ("text", "contents")}


def _paths(paths: str | list[str]) -> list[str]:
    return [p for one in ([paths] if isinstance(paths, str) else paths) for p in one.split(":") if p]


def with_aliases(df: DataFrame) -> DataFrame:
    """(pid, title, text) from whichever alias columns exist; a missing field is the empty string."""
    pick = lambda names: F.coalesce(*[F.col(f"`{n}`").cast("string") for n in names if n in df.columns], F.lit(""))
    return df.select(*[pick(names).alias(field) for field, names in ALIASES.items()])


def read_corpus(spark: SparkSession, paths: str | list[str], fmt: str = "tsv", fieldnames: list[str] | None = None) -> DataFrame:
    """Passages of TSV, CSV or JSON-lines files or folders of them (recursive)."""
    reader = spark.read.option("recursiveFileLookup", True)
    if fmt == "jsonl":
        return with_aliases(reader.json(_paths(paths)))
    reader = reader.option("sep", "\t" if fmt == "tsv" else ",").option("quote", '"' if fmt == "csv" else "\u0000").option("header", fieldnames is None)
    df = reader.csv(_paths(paths)) if fieldnames is None else reader.schema(", ".join(f"`{f}` string" for f in fieldnames)).csv(_paths(paths))
    return with_aliases(df)


def read_queries(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(qid, question) of TSV without header."""
    return spark.read.option("sep", "\t").option("quote", "\u0000").schema("qid string, question string").csv(_paths(paths))


def read_qas(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return spark.read.schema("qid string, question string, answers array<string>, lang string").json(_paths(paths))


def read_answers_tsv(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Queries with header; `answers` separated by '::', `relevant` by ','."""
    df = spark.read.option("sep", "\t").option("header", True).option("quote", "\u0000").csv(_paths(paths))
    for name, sep in (("answers", "::"), ("relevant", ",")):
        if name in df.columns:
            df = df.withColumn(name, F.split(name, sep))
    return df


def read_qrels(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(qid, doc_id) distinct, of lines `qid 0 pid 1`."""
    df = spark.read.option("sep", "\t").schema("qid bigint, zero int, doc_id bigint, rel int").csv(_paths(paths))
    return df.where("rel > 0").select("qid", "doc_id").distinct()


def read_ranking(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return spark.read.option("sep", "\t").schema(RANKING).csv(_paths(paths))


def read_triples(spark: SparkSession, paths: str | list[str], nway: int | None = None) -> DataFrame:
    """(qid, docs): JSON arrays [qid, pid or [pid, score], ...] cut to nway documents."""
    parts = spark.read.text(_paths(paths)).select(F.from_json("value", "array<string>").alias("a")).where("a is not null")
    ids = F.transform(F.slice("a", 2, nway or 1 << 20), lambda x: F.when(x.startswith("["), F.get_json_object(x, "$[0]")).otherwise(x).cast("bigint"))
    return parts.select(F.col("a")[0].cast("string").alias("qid"), ids.alias("docs"))


def read_predictions(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Reader output {example id: [candidate, ...]} as (example_id, order, candidate JSON); order from 0."""
    maps = spark.read.text(_paths(paths), wholetext=True).select(F.from_json("value", "map<string,array<string>>").alias("m"))
    return maps.select(F.explode("m").alias("example_id", "cs")).select("example_id", F.posexplode("cs").alias("order", "candidate"))


def read_squad(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """One row per question of nested data[].paragraphs[].qas[] files."""
    schema = "data array<struct<title:string,paragraphs:array<struct<context:string,qas:array<struct<id:string,question:string,answers:array<struct<text:string,answer_start:int>>>>>>>>"
    d = spark.read.schema(schema).option("multiLine", True).json(_paths(paths)).select(F.explode("data").alias("d"))
    p = d.select("d.title", F.explode("d.paragraphs").alias("p"))
    q = p.select("title", "p.context", F.explode("p.qas").alias("q"))
    return q.select("q.id", "title", "context", "q.question", F.struct(F.col("q.answers.text").alias("text"), F.col("q.answers.answer_start").alias("answer_start")).alias("answers"))


def read_passage_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Lines of two to four tab fields: (pid, text), (pid, text, title) or (pid, title, url, text). Others are dropped."""
    f = spark.read.text(_paths(paths)).select(F.split("value", "\t").alias("f")).withColumn("n", F.size("f")).where("n between 2 and 4")
    return f.select(F.col("f")[0].alias("pid"), F.when(F.col("n") == 3, F.get("f", F.lit(2))).when(F.col("n") == 4, F.col("f")[1]).otherwise("").alias("title"), F.when(F.col("n") == 4, F.get("f", F.lit(3))).otherwise(F.col("f")[1]).alias("text"))


def well_formed(lines: DataFrame, fields: int) -> DataFrame:
    """Lines with exactly so many tab fields once trimmed."""
    return lines.where(F.size(F.split(F.trim("value"), "\t")) == fields)


def last_wins(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key: the last in the given order. An aggregate, combined map-side."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("x")).select(key, "x.*")


def repeated_keys(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).count().where("count > 1")


def numbered_when_empty(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Ids for rows without one: their 1-based number in the given order."""
    from answerforge.operators.passages import number_rows

    return number_rows(df, order, "_n").withColumn(key, F.when(F.coalesce(F.col(key), F.lit("")) == "", F.col("_n").cast("string")).otherwise(F.col(key))).drop("_n")


def read_manifest(spark: SparkSession, entries: list[dict], seed: int = 0) -> DataFrame:
    """Union of the datasets of a manifest ({path, format, rate, key}); a rate below 1 takes that share in hash order."""
    from answerforge.operators.ranking import split_by_fraction

    out = None
    for e in entries:
        df = spark.read.format(e.get("format", "parquet")).load(e["path"])
        if e.get("rate", 1.0) < 1.0:
            df = split_by_fraction(df, e["key"], {"in": e["rate"], "out": 1 - e["rate"]}, seed).where("split_name = 'in'").drop("split_name")
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out




def read_lines(spark: SparkSession, paths: str | list[str], limit: int = 0, seed: int | None = None) -> DataFrame:
    """Lines of files (compressed by suffix) or folders; with a seed in random order, the same for the same seed."""
    lines = spark.read.option("recursiveFileLookup", True).text(_paths(paths))
    if seed is not None:
        lines = lines.orderBy(F.xxhash64("value", F.lit(seed)))
    return lines.limit(limit) if limit else lines


def pending_files(spark: SparkSession, folder: str, pattern: str, completed: DataFrame) -> DataFrame:
    """(path) of files not among the completed ones; the content is not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder).select("path")
    return files.join(completed.select("path"), "path", "left_anti")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, value) of one file, numbered by its order: for files joined by position."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.posexplode(F.split("value", "\r?\n")).alias("line_no", "value"))


def aligned_lines(spark: SparkSession, left: str, right: str) -> DataFrame:
    """Two parallel files joined by line number."""
    a, b = numbered_lines(spark, left), numbered_lines(spark, right)
    return a.withColumnRenamed("value", "left").join(b.withColumnRenamed("value", "right"), "line_no")


def read_annotated(spark: SparkSession, paths: str | list[str], ids: DataFrame | None = None) -> DataFrame:
    """Annotated examples of JSON lines, only those whose id is wanted if ids (id) are given."""
    span = "start_byte:bigint,end_byte:bigint,start_token:bigint,end_token:bigint"
    schema = f"example_id string, question_text string, annotations array<struct<annotation_id:string,long_answer:struct<{span},candidate_index:bigint>,short_answers:array<struct<{span}>>,yes_no_answer:string>>"
    df = spark.read.schema(schema).json(_paths(paths))
    return df if ids is None else df.join(ids.select(F.col("id").alias("example_id")), "example_id", "left_semi")


def read_mrqa(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(id, context, question, answers) of the lines behind the header line; first span of every detected answer."""
    schema = "context string, qas array<struct<qid:string,question:string,detected_answers:array<struct<text:string,char_spans:array<array<int>>>>>>"
    lines = spark.read.text(_paths(paths)).select(F.from_json("value", schema).alias("x")).where("x.context is not null")
    q = lines.select("x.context", F.explode("x.qas").alias("q"))
    answers = F.struct(F.transform("q.detected_answers", lambda a: a["text"]).alias("text"), F.transform("q.detected_answers", lambda a: a["char_spans"][0][0]).alias("answer_start"))
    return q.select(F.col("q.qid").alias("id"), "context", F.col("q.question").alias("question"), answers.alias("answers"))


def read_table_cells(spark: SparkSession, folder: str, pattern: str = "*.csv") -> DataFrame:
    """(table_id, row_id, col_id, value) of every CSV file in a folder; row 0 is the header."""
    whole = spark.read.text(folder, wholetext=True, pathGlobFilter=pattern, recursiveFileLookup=True)
    rows = whole.select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("table_id"), F.posexplode(F.split(F.rtrim("value"), "\r?\n")).alias("row_id", "line"))
    schema = ", ".join(f"c{i} string" for i in range(64))
    cells = rows.select("table_id", "row_id", F.from_csv("line", F.lit(schema)).alias("r"))
    return cells.select("table_id", "row_id", F.posexplode(F.array(*[F.col(f"r.c{i}") for i in range(64)])).alias("col_id", "value")).where("value is not null")
