"""Readers and writers, and the streaming ingest, by round trips."""

import bz2
import gzip
import json

from pyspark.sql import functions as F

from answerforge.sources import readers, writers
from answerforge.streaming import ingest


def test_corpus_formats(spark, tmp_path):
    with gzip.open(tmp_path / "a.tsv.gz", "wt") as f:
        f.write('id\ttext\ttitle\n1\tsome "text\tA\n2\tmore\t\n')
    with bz2.open(tmp_path / "b.csv.bz2", "wt") as f:
        f.write('pid,contents\n3,"x, y"\n')
    (tmp_path / "c.jsonl").write_text('{"id": "4", "contents": "z", "title": "T"}\n')
    tsv = readers.read_corpus(spark, str(tmp_path / "a.tsv.gz")).orderBy("pid").collect()
    assert [tuple(r) for r in tsv] == [("1", "A", 'some "text'), ("2", "", "more")]
    assert tuple(readers.read_corpus(spark, str(tmp_path / "b.csv.bz2"), "csv").first()) == ("3", "", "x, y")
    assert tuple(readers.read_corpus(spark, str(tmp_path / "c.jsonl"), "jsonl").first()) == ("4", "T", "z")


def test_ranking_round_trip(spark, tmp_path):
    r = spark.createDataFrame([(1, 7, 1, 0.5), (1, 8, 2, 0.25)], readers.RANKING)
    writers.write_ranking(r, str(tmp_path / "r"))
    assert sorted(map(tuple, readers.read_ranking(spark, str(tmp_path / "r")).collect())) == [(1, 7, 1, 0.5), (1, 8, 2, 0.25)]
    assert json.loads((tmp_path / "r.meta.json").read_text())["columns"] == ["qid", "doc_id", "rank", "score"]


def test_qrels_and_triples(spark, tmp_path):
    (tmp_path / "q.tsv").write_text("1\t0\t5\t1\n1\t0\t5\t1\n1\t0\t6\t0\n")
    assert [tuple(r) for r in readers.read_qrels(spark, str(tmp_path / "q.tsv")).collect()] == [(1, 5)]
    (tmp_path / "t.jsonl").write_text("[1, 2, 3, 4]\n[5, [6, 0.5], 7]\n\n")
    assert sorted(map(tuple, readers.read_triples(spark, str(tmp_path / "t.jsonl"), 2).collect())) == [("1", [2, 3]), ("5", [6, 7])]


def test_squad_and_predictions(spark, tmp_path):
    squad = {"data": [{"title": "T", "paragraphs": [{"context": "C", "qas": [{"id": "1", "question": "Q", "answers": [{"text": "C", "answer_start": 0}]}]}]}]}
    (tmp_path / "s.json").write_text(json.dumps(squad))
    row = readers.read_squad(spark, str(tmp_path / "s.json")).first()
    assert (row["id"], row["context"], row["answers"]["text"]) == ("1", "C", ["C"])
    (tmp_path / "p.json").write_text(json.dumps({"e": [{"a": 1}, {"a": 2}]}))
    got = readers.read_predictions(spark, str(tmp_path / "p.json")).orderBy("order").collect()
    assert [(r["example_id"], r["order"], json.loads(r["candidate"])["a"]) for r in got] == [("e", 0, 1), ("e", 1, 2)]


def test_corpus_and_nested_writers(spark, tmp_path):
    docs = spark.createDataFrame([("1", "T", "a\tb"), ("2", "", "c")], "pid string, title string, text string")
    writers.write_corpus(docs, str(tmp_path / "c"))
    back = readers.read_corpus(spark, str(tmp_path / "c")).orderBy("pid").collect()
    assert [r["text"] for r in back] == ["a b", "c"]
    hits = spark.createDataFrame([("q", 2, "b"), ("q", 1, "a"), ("z", 1, "c")], "qid string, rank int, text string")
    langs = spark.createDataFrame([("q", "fi")], "qid string, lang string")
    writers.write_xor(hits, langs, str(tmp_path / "x"), 5)
    rows = {r["id"]: r for r in spark.read.json(str(tmp_path / "x")).collect()}
    assert rows["q"]["ctxs"] == ["a", "b"] and rows["q"]["lang"] == "fi" and rows["z"]["ctxs"] == ["c"]
    writers.write_shards(docs, str(tmp_path / "s"), 2, seed=1)
    assert spark.read.parquet(str(tmp_path / "s")).count() == 2


def test_last_wins_repeated_and_numbered(spark):
    df = spark.createDataFrame([("a", "x", 1), ("a", "y", 2), ("", "z", 3), (None, "w", 4)], "pid string, text string, k int")
    assert {r["pid"]: r["text"] for r in readers.last_wins(df.where("pid = 'a'"), "pid", "k").collect()} == {"a": "y"}
    assert [r["pid"] for r in readers.repeated_keys(df, "pid").collect()] == ["a"]
    assert sorted(r["pid"] for r in readers.numbered_when_empty(df, "pid", ["k"]).collect()) == ["3", "4", "a", "a"]


def test_manifest(spark, tmp_path):
    spark.range(1000).write.parquet(str(tmp_path / "a"))
    entries = [{"path": str(tmp_path / "a")}, {"path": str(tmp_path / "a"), "rate": 0.3, "key": "id"}]
    n = readers.read_manifest(spark, entries).count()
    assert 1200 < n < 1400 and n == readers.read_manifest(spark, entries).count()


def test_ingest_goes_on_where_it_ended(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    first = spark.createDataFrame([("1", "a"), ("1", "a"), ("2", "b")], "pid string, text string")
    first.coalesce(1).write.mode("append").parquet(source)
    ingest.ingest_passages(ingest.read_stream(spark, source, first.schema), target, str(tmp_path / "cp"))
    first.withColumn("pid", F.concat("pid", F.lit("x"))).coalesce(1).write.mode("append").parquet(source)
    ingest.ingest_passages(ingest.read_stream(spark, source, first.schema), target, str(tmp_path / "cp"))
    assert sorted(r["pid"] for r in spark.read.parquet(target).collect()) == ["1", "1x", "2", "2x"]


def test_streamed_counts_equal_the_batch(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    ingest.count_stream(ingest.read_stream(spark, str(tmp_path / "in"), events.schema), str(tmp_path / "out"), str(tmp_path / "cp"))
    closed = {(r["hour"], r["event_type"]): r["events"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    batch = {(r["hour"], r["event_type"]): r["events"] for r in ingest.windowed_counts(events).collect()}
    assert closed and all(batch[k] == v for k, v in closed.items())
