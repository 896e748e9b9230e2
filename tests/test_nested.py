"""Nested records: all shapes give the positions of a plain list, and labels nest."""

import json

import pytest

from answerforge.operators import nested

ANNOTATIONS = [
    {"id": "1", "long_answer": {"start_byte": 5, "end_byte": 9, "start_token": 0, "end_token": 1, "candidate_index": 0}, "short_answers": [{"start_byte": 5, "end_byte": 6, "start_token": 0, "end_token": 1, "text": "x"}, {"start_byte": -1, "end_byte": -1, "start_token": -1, "end_token": -1, "text": None}], "yes_no_answer": -1},
    {"id": "2", "long_answer": {"start_byte": -1, "end_byte": -1, "start_token": -1, "end_token": -1, "candidate_index": -1}, "short_answers": [], "yes_no_answer": 1},
]
COLUMNAR = {
    "id": ["1", "2"],
    "long_answer": [a["long_answer"] for a in ANNOTATIONS],
    "yes_no_answer": [-1, 1],
    "short_answers": [{k: [s[k] for s in a["short_answers"]] for k in ("start_byte", "end_byte", "start_token", "end_token", "text")} for a in ANNOTATIONS],
}
EXPECTED = [("annotation", 1, 0), ("annotation", 2, 0), ("long_answer", 1, 0), ("short_answer", 1, 1)]
SHAPES = {
    "list": {"annotations": ANNOTATIONS},
    "text": {"annotations": json.dumps(ANNOTATIONS)},
    "columns": {"annotations": COLUMNAR},
    "wrapped": {"example": {"annotations": ANNOTATIONS}},
    "wrapped text": {"example": json.dumps({"annotations": json.dumps(ANNOTATIONS)})},
    "strings": json.loads(json.dumps({"annotations": ANNOTATIONS}).replace('"start_byte": 5', '"start_byte": "5"')),
}


def found(spark, payloads):
    df = spark.createDataFrame(list(enumerate(payloads)), "record_id bigint, payload string")
    return sorted(tuple(r) for r in nested.answer_rows(nested.label_nodes(df, "record_id", "payload")).collect())


@pytest.mark.parametrize("shape", SHAPES)
def test_shapes(spark, shape):
    assert [r[1:] for r in found(spark, [json.dumps(SHAPES[shape])])] == EXPECTED


def test_one_object_and_null_elements(spark):
    single = {"annotations": {"id": "1", "short_answers": {"start_byte": 3, "end_byte": 4}}}
    holes = {"annotations": [None, {}, {"short_answers": [None, {"start_byte": 0}]}]}
    assert found(spark, [json.dumps(single), json.dumps(holes)]) == [(0, "annotation", 1, 0), (0, "short_answer", 1, 1), (1, "annotation", 2, 0), (1, "annotation", 3, 0), (1, "short_answer", 3, 2)]


def test_what_gives_nothing(spark):
    good = json.dumps({"annotations": ANNOTATIONS})
    assert found(spark, [None, "", " ", good[:-1], good + " x", '"annotations": []', "[]", "null", "5", '{"annotations": NaN}', '{"annotations": null}', "{}"]) == []


def test_labels_nest(spark):
    df = spark.createDataFrame([(1, json.dumps(SHAPES["list"]))], "record_id bigint, payload string")
    nodes = nested.label_nodes(df, "record_id", "payload").collect()
    by_pre = {n["pre"]: n for n in nodes}
    assert len({n["post"] for n in nodes}) == len(nodes)
    for n in nodes:
        if n["parent_pre"]:
            parent = by_pre[n["parent_pre"]]
            assert parent["pre"] < n["pre"] and parent["post"] > n["post"]
        for m in nodes:  # intervals nest or are apart
            assert not (n["pre"] < m["pre"] and n["post"] > m["post"]) or m["parent_pre"] == n["pre"]
    tables = nested.node_tables(nested.label_nodes(df, "record_id", "payload"))
    assert tables["short_answer"].select("annotation_no", "item_no", "text").orderBy("item_no").collect()[0]["text"] == "x"
    assert tables["annotation"].count() == 2 and tables["long_answer"].count() == 2


def test_clashing_columns_and_empty_table(spark):
    df = spark.createDataFrame([(1, json.dumps(SHAPES["list"]), 9, "x")], "record_id bigint, payload string, pre int, item_no string")
    assert nested.answer_rows(nested.label_nodes(df, "record_id", "payload")).count() == 4
    assert nested.answer_rows(nested.label_nodes(df.where("false"), "record_id", "payload")).count() == 0
