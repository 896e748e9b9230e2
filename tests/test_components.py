"""Components, pipeline, index catalogue, calibration, remaining readers, preparation operators."""

import json

import pytest
from pyspark.sql import functions as F

from answerforge import components, service
from answerforge.models import calibration
from answerforge.operators import prepare, vectors
from answerforge.sources import readers

DOCS = [(1, "T", "The old town lies by the lake. It has a tower."), (2, "", "Dogs run in the park."), (3, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id bigint, title string, text string")


@pytest.fixture(scope="module")
def queries(spark):
    return spark.createDataFrame([("a", "where is the tower of the town"), ("b", "zebra")], "qid string, query string")


def test_pipeline(docs, queries):
    made = components.Pipeline(components.get("SparseRetriever", k=2), components.SentenceReader(), components.OverlapReranker())
    got = {r["qid"]: (r["answer"], r["doc_id"]) for r in made.run(queries, docs).collect()}
    assert got == {"a": ("The old town lies by the lake.", 1), "b": (None, None)}
    assert made.preview(queries, docs, 1, 7).first()["previews"] == ["The old"]
    assert isinstance(made.retriever, components.Retriever) and isinstance(made.reader, components.Reader)


def test_vector_retriever(docs, queries):
    found = components.VectorRetriever(k=1).retrieve(queries.where("qid = 'a'"), docs).first()
    assert (found["qid"], found["doc_id"], found["rank"]) == ("a", 1, 1)


def test_registry_and_parameters(spark):
    assert components.get("SparseRetriever", k=3) is components.get("SparseRetriever", k=3)
    assert components.resolve("answerforge.components.SentenceReader") is components.SentenceReader
    with pytest.raises(KeyError):
        components.resolve("Nobody")
    assert components.SparseRetriever(k=3).identity() != components.SparseRetriever(k=4).identity()
    rows = {r["name"]: r["default"] for r in components.SparseRetriever.parameters(spark).collect()}
    assert rows == {"k": "10", "k1": "0.9", "b": "0.4"}


def test_prompt(spark):
    made = components.prompt(F.lit("who?"), F.array(F.lit("x"), F.lit("y")), "Read.")
    assert spark.range(1).select(made.alias("p")).first()["p"] == "Read. Question: who? Context: x, y Answer:"


def test_index_states(spark, docs, queries, tmp_path):
    store = service.IndexStore(spark, str(tmp_path))
    assert store.status("none") == "DOES_NOT_EXIST"
    made = store.generate(docs, k=1)
    assert store.status(made) == "READY" and store.indexes().count() == 1
    assert store.retrieve(made, queries).first()["title"] == "T"
    assert store.documents(made, [2]).count() == 1
    with pytest.raises(ValueError):
        store.retrieve(made, queries, "VectorRetriever")
    with pytest.raises(Exception):
        store.generate(docs.select("doc_id"), index_id="bad")
    assert store.status("bad") in ("CORRUPT", "INDEXING")
    with pytest.raises(ValueError):
        store.documents("bad")


def test_calibration_and_centroids(spark):
    rows = spark.createDataFrame([(float(i % 10), float(i % 3), int(i % 10 > 4)) for i in range(200)], "a double, b double, y int")
    model = calibration.fit_confidence(rows, ["a", "b"], "y")
    got = calibration.apply_confidence(model, rows, ["a", "b"])
    assert got.where("(confidence > 0.5) = (y = 1)").count() == 200
    e = spark.createDataFrame([(i, [float(i % 2 * 10), float(i)]) for i in range(20)], "vec_id bigint, embedding array<float>")
    c = calibration.train_centroids(e, 2)
    assert c.count() == 2 and vectors.nearest_centroid(e, c).count() == 20


def test_more_readers(spark, tmp_path):
    (tmp_path / "l").mkdir()
    (tmp_path / "l" / "a.txt").write_text("x\ny\n")
    (tmp_path / "l" / "b.txt").write_text("u\nv\n")
    assert readers.read_lines(spark, str(tmp_path / "l")).count() == 4
    assert readers.read_lines(spark, str(tmp_path / "l"), 3, seed=1).count() == 3
    done = readers.pending_files(spark, str(tmp_path / "l"), "*.txt", spark.createDataFrame([], "path string")).where("path like '%a.txt'")
    assert [r["path"][-5:] for r in readers.pending_files(spark, str(tmp_path / "l"), "*.txt", done).collect()] == ["b.txt"]
    both = readers.aligned_lines(spark, str(tmp_path / "l" / "a.txt"), str(tmp_path / "l" / "b.txt")).orderBy("line_no").collect()
    assert [(r["left"], r["right"]) for r in both][:2] == [("x", "u"), ("y", "v")]
    (tmp_path / "m.jsonl").write_text('{"header": 1}\n' + json.dumps({"context": "C d", "qas": [{"qid": "1", "question": "q", "detected_answers": [{"text": "d", "char_spans": [[2, 2], [0, 0]]}]}]}) + "\n")
    row = readers.read_mrqa(spark, str(tmp_path / "m.jsonl")).first()
    assert (row["id"], row["answers"]["answer_start"]) == ("1", [2])
    (tmp_path / "n.jsonl").write_text('{"example_id": "1", "annotations": [{"annotation_id": "9", "yes_no_answer": "NONE"}]}\n{"example_id": "2"}\n')
    ids = spark.createDataFrame([("1",)], "id string")
    assert readers.read_annotated(spark, str(tmp_path / "n.jsonl"), ids).count() == 1
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "t1.csv").write_text('h,k\n1,"a, b"\n')
    cells = readers.read_table_cells(spark, str(tmp_path / "t")).orderBy("row_id", "col_id").collect()
    assert [(r["table_id"], r["row_id"], r["col_id"], r["value"]) for r in cells] == [("t1.csv", 0, 0, "h"), ("t1.csv", 0, 1, "k"), ("t1.csv", 1, 0, "1"), ("t1.csv", 1, 1, "a, b")]
    passages = tmp_path / "p.tsv"
    passages.write_text("1\ttext\n2\ttext\ttitle\n3\tt\tu\tbody\nbad\n")
    assert sorted(tuple(r) for r in readers.read_passage_lines(spark, str(passages)).collect()) == [("1", "", "text"), ("2", "title", "text"), ("3", "t", "body")]


def test_conflict_free_batches(spark):
    rows = [(q, q, (q + 1 + n) % 30) for q in range(30) for n in range(4)]
    df = spark.createDataFrame(rows, "qid bigint, pos bigint, neg bigint")
    got = prepare.conflict_free_batches(df, 8).collect()
    assert sorted((r["qid"], r["pos"], r["neg"]) for r in got) == sorted(rows)
    for a in got:
        assert not any(b["batch"] == a["batch"] and b["qid"] != a["qid"] and b["neg"] == a["pos"] for b in got)


def test_schema_check_and_defaults(spark):
    df = spark.createDataFrame([(1, "x")], "a int, b string")
    assert prepare.validate_schema(df, "a int") == []
    assert prepare.validate_schema(df, "a bigint, c string") == ["a: int instead of bigint", "c: missing instead of string"]
    assert prepare.search_defaults(10)["ndocs"] == 256 and prepare.search_defaults(2000)["ndocs"] == 8000
    assert prepare.partition_count(10_000) == 512


def test_http_server(spark, tmp_path):
    import json
    import threading
    from urllib.error import HTTPError
    from urllib.request import Request, urlopen

    from answerforge.server import serve

    server = serve(spark, str(tmp_path), port=0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"

    def ask(path, body=None):
        try:
            with urlopen(Request(base + path, json.dumps(body).encode() if body is not None else None, method="POST" if body is not None else "GET")) as r:
                return r.status, json.loads(r.read())
        except HTTPError as e:
            return e.code, json.loads(e.read())

    try:
        status, made = ask("/indexes", {"documents": [{"doc_id": 1, "title": "T", "text": "red hill"}, {"doc_id": 2, "text": "blue sea"}], "config": {"k": 1}})
        assert status == 201
        index = made["index_id"]
        assert ask(f"/indexes/{index}") == (200, {"index_id": index, "state": "READY"})
        assert [i["index_id"] for i in ask("/indexes")[1]] == [index]
        status, hits = ask("/retrieve", {"index_id": index, "queries": ["a red one", "sea", "nothing"]})
        assert status == 200 and [[h["document"]["doc_id"] for h in hs] for hs in hits] == [[1], [2], []]
        assert ask(f"/indexes/{index}/documents?ids=2")[1][0]["text"] == "blue sea"
        assert ask("/retrieve", {"index_id": "none", "queries": ["x"]})[0] == 400 and ask("/indexes/none")[0] == 404
        assert ask("/nowhere")[0] == 404 and len(ask("/retrievers")[1]) == 2
    finally:
        server.shutdown()
        server.server_close()


def test_bm25_index_agrees_with_the_scan(spark, tmp_path):
    from answerforge.operators import sparse

    texts = [(i, " ".join(f"w{(i * j) % 37}" for j in range(1, 3 + i % 20))) for i in range(200)] + [(900, None), (901, ""), (902, "...")]
    d = spark.createDataFrame(texts, "doc_id bigint, text string").withColumn("h", F.lit("clash"))
    q = spark.createDataFrame([("a", "w1 w2 w2"), ("b", "W3 unknown"), ("c", "unknown"), ("d", None), ("e", "")], "qid string, query string")
    sparse.BM25Index.build(d, str(tmp_path / "i"))
    found = sorted(map(tuple, sparse.BM25Index(spark, str(tmp_path / "i")).search(q, 7).collect()))
    assert found == sorted(map(tuple, sparse.bm25_topk(d, q, 7).collect())) and {r[0] for r in found} == {"a", "b"}
    sparse.BM25Index.build(d.where("false"), str(tmp_path / "none"))
    assert sparse.BM25Index(spark, str(tmp_path / "none")).search(q, 7).count() == 0


def test_temporary_tables_are_removed(spark):
    import os

    from answerforge.session import materialize, temporary_tables

    with temporary_tables(spark):
        path = materialize(spark.range(3)).inputFiles()[0].removeprefix("file://")
        assert os.path.exists(path)
    assert not os.path.exists(path)


def test_searchable_corpus(spark, docs, queries, tmp_path):
    for retriever in (components.SparseRetriever(k=2), components.VectorRetriever(k=2)):
        corpus = components.SearchableCorpus(spark, str(tmp_path / type(retriever).__name__), retriever)
        corpus.add(spark.createDataFrame([(1, "Hill", "red stone"), (2, "", "blue sea")], "doc_id bigint, title string, text string"))
        asked = spark.createDataFrame([("a", "hill"), ("b", "deep sea"), ("c", "zzz")], "qid string, query string")
        first = {r["qid"]: r["doc_ids"] for r in corpus.search(asked).collect()}
        assert first["a"][0] == 1 and first["b"][0] == 2
        corpus.add(spark.createDataFrame([(3, None, "deep blue sea")], "doc_id bigint, title string, text string"))
        again = {r["qid"]: (r["doc_ids"], r["scores"]) for r in corpus.search(asked).collect()}
        assert again["b"][0][0] == 3 and all(len(i) == len(s) for i, s in again.values())
    assert first["c"] is not None


def test_adding_to_a_corpus_leaves_what_it_has(spark, tmp_path):
    corpus = components.SearchableCorpus(spark, str(tmp_path / "c"))

    def files():
        return {p: p.stat().st_mtime_ns for p in (tmp_path / "c").rglob("*.parquet")}

    corpus.add(spark.createDataFrame([(1, "Hill", "red stone")], "doc_id bigint, title string, text string"))
    first = files()
    corpus.add(spark.createDataFrame([(2, "", "blue stone stone")], "doc_id bigint, title string, text string"))
    assert first.items() <= files().items()
    assert spark.read.parquet(str(tmp_path / "c/documents")).columns == ["doc_id", "title", "text", "part"]  # no second copy of the text
    asked = spark.createDataFrame([("a", "stone"), ("b", "hill")], "qid string, query string")
    assert {r["qid"]: r["doc_ids"] for r in corpus.search(asked).collect()} == {"a": [2, 1], "b": [1]}
    assert {(r["doc_id"], r["searched"]) for r in corpus.documents().collect()} == {(1, "Hill red stone"), (2, "blue stone stone")}


def test_prompted_pipeline(spark):
    docs = spark.createDataFrame([(1, "The hill is red. It is old."), (2, "The sea is blue.")], "doc_id bigint, text string")
    asked = spark.createDataFrame([("a", "what is the hill"), ("b", "zzz")], "qid string, query string")
    made = components.Pipeline(components.SparseRetriever(k=2), components.PromptReader(contexts=1), components.OverlapReranker())
    got = {r["qid"]: r["answer"] for r in made.run(asked, docs).collect()}
    assert got == {"a": "The hill is red.", "b": None}


def test_synthetic_questions(spark):
    from answerforge.operators import synthesis

    passages = spark.createDataFrame([(1, "Red stone hill in the north"), (2, None), (3, ""), (4, "x")], "pid bigint, text string")
    examples = spark.createDataFrame([("why?",), (None,), ("how?",)], "question string")

    class Joined:
        def generate(self, passage, example):
            return F.concat(example, F.lit(" "), passage)

    got = synthesis.synthetic_questions(passages, Joined(), 6, examples, 3).collect()
    assert {r["pid"] for r in got} == {1} and {r["question"].split("?")[0] for r in got} == {"why", "how"}
    assert len({r["qid"] for r in got}) == len(got) == 2
    targets = synthesis.answer_targets(spark.createDataFrame([(1, "t", ["a", "a", "b", "c", " ", None]), (2, None, ["a"]), (3, "u", None)], "k int, t string, a array<string>"), "k", "t", F.col("a"), 2).collect()
    assert len(targets) == 2 and all(r["target"] == r["answer"] + " <<sep>> t" for r in targets)
