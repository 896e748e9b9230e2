"""Known results of the text functions and metrics."""

import pytest
from pyspark.sql import functions as F

from answerforge.functions import sequence, text
from answerforge.operators import reading


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def metric(spark, rows, lang=None):
    gold = spark.createDataFrame([(i, g) for i, (g, _) in enumerate(rows)], "id int, golds array<string>")
    pred = spark.createDataFrame([(i, p) for i, (_, p) in enumerate(rows) if p is not None], "id int, prediction string")
    if lang:
        gold = gold.withColumn("lang", F.lit(lang))
    r = reading.em_f1(gold, pred, lang=F.col("lang") if lang else None).first()
    return r["exact_match"], r["f1"]


def test_em_f1_english(spark):
    rows = [(["Denver Broncos"], "Denver Broncos"), (["Carolina Panthers"], "Carolina Panthers"), (["Levi's Stadium"], "Levi's Stadium in the San Francisco Bay Area")]
    assert metric(spark, rows) == pytest.approx((66.666667, 81.481481), abs=1e-5)


def test_em_f1_chinese(spark):
    # Question-answer pairs whose result is known.
    same = ["宪法保障宗教自由", "BFG 9000和电锯", "赫尔辛基", "1993", "压力、经济环境，网路上的娱乐和资讯", "蚁酸"]
    rows = [([x], x) for x in same] + [(["伊斯兰教"], "伊斯兰"), (["十支"], "十"), (["《毁灭战士3》"], "《毁灭战士3"), (["《毁灭战士3》"], "毁灭战士3")]
    assert metric(spark, rows, "zh") == pytest.approx((80.0, 95.238095), abs=1e-5)


def test_missing_prediction_scores_nothing(spark):
    assert metric(spark, [(["a b"], None), (["x"], "x")]) == (50.0, 50.0)


@pytest.mark.parametrize(("raw", "number"), [("1,234", 1234.0), ("1,234.5", 1234.5), ("3,5", 3.5), ("1.234.567", 1234567.0), ("-2e3", -2000.0), ("abc", None), ("", None), ("nan", None), ("12a", None)])
def test_to_number(spark, raw, number):
    assert one(spark, text.to_number(F.lit(raw))) == number


@pytest.mark.parametrize(("raw", "kind"), [("", "empty"), ("Yes", "bool"), ("3 - 2", "score"), ("12 march 1999", "date"), ("5 km", "unit"), ("1,000", "number"), ("Paris", "word")])
def test_cell_kind(spark, raw, kind):
    assert one(spark, text.cell_kind(F.lit(raw))) == kind


def test_row_line(spark):
    line = text.linearize(F.array(F.lit("player_name"), F.lit("score")), F.array(F.lit("sachin"), F.lit("100")))
    assert one(spark, line) == "player_name is sachin . score is 100 . "


def test_byte_offsets_of_wide_characters(spark):
    word = "aé€😀b"
    for cut in range(len(word.encode()) + 1):
        expected = len(word.encode()[:cut].decode("utf-8", "replace"))
        assert one(spark, text.byte_to_char(F.lit(word), F.lit(cut))) == expected
    assert one(spark, text.byte_to_char(F.lit(word), F.lit(-1))) == -1
    assert one(spark, text.byte_slice(F.lit(word), F.lit(1), F.lit(3))) == "é"


@pytest.mark.parametrize(("body", "answer", "found"), [("The Old Town.", "old town", True), ("The golden town", "old", False), ("x", "", True), ("a b c", "a c", False)])
def test_has_answer(spark, body, answer, found):
    assert one(spark, text.has_answer(F.lit(body), F.lit(answer))) is found


def test_longest_common_subsequence():
    assert sequence.lcs_length("a b c d".split(), "b x d".split()) == 2
    assert sequence.lcs_length([], ["a"]) == 0


def test_greedy_ranges():
    assert sequence.greedy_ranges([20, 40, 60, 10, 5], 50, 100) == [(0, 2), (2, 3), (3, 5)]
    assert sequence.greedy_ranges([], 50, 100) == []
    assert sequence.greedy_ranges([200, 1], 50, 100) == [(0, 1), (1, 2)]


def test_cells_keys_and_encodings(spark):
    from answerforge.functions import cells

    given = ["Café [1]", '"Quoted"', "A – B†‡", "x (note) (more)", "[1]", "(all)", "End.", "  Two   words ", "<b>Bold</b>", "", None]
    expected = ["cafe", "quoted", "a - b", "x", "", "(all)", "end", "two words", "bold", "", None]
    df = spark.createDataFrame([(i, g) for i, g in enumerate(given)], "i int, c string")
    assert [r["x"] for r in df.select("i", cells.normalize_cell(F.col("c")).alias("x")).orderBy("i").collect()] == expected
    urls = spark.createDataFrame([("a%20b+c",), ("100%",), (None,)], "u string")
    assert [r["k"] for r in urls.select(cells.document_key(F.col("u")).alias("k")).collect()] == ["a b+c", "100%", None]
    v = spark.createDataFrame([(1, [1.0, -0.5, 3.25]), (2, []), (3, None)], "i int, v array<float>")
    back = v.select("i", cells.text_to_vector(cells.vector_to_text(F.col("v"))).alias("b")).orderBy("i").collect()
    assert [r["b"] for r in back] == [[1.0, -0.5, 3.25], [], None]
    t = df.select(cells.decompress_text(cells.compress_text(F.col("c"))).alias("b"))
    assert {r["b"] for r in t.collect()} == set(given)
