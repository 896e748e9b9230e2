"""Reading comprehension: adaptation of nested examples, span candidates, gold votes and per-example scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from answerforge.functions.text import normalize_answer, normalize_answer_lang, token_f1
from answerforge.operators.evaluate import span_overlap_f1


def newest_examples(examples: DataFrame) -> DataFrame:
    """One row per example id: the one with the smallest record id."""
    return examples.groupBy("id").agg(F.min_by(F.struct("annotations", "long_answer_candidates"), "record_id").alias("x")).select(F.col("id").alias("example_id"), "x.*")


def gold_labels(examples: DataFrame) -> DataFrame:
    """(example_id, golds): per annotator passage index, first short span and yes/no; -1 stands for none."""
    first = lambda a: F.get(F.filter(a["short_answers"], lambda s: s.isNotNull()), F.lit(0))
    label = lambda a: F.struct(
        F.coalesce(a["long_answer"]["candidate_index"], F.lit(-1)).alias("passage"),
        F.coalesce(first(a)["start_byte"], F.lit(-1)).alias("start"),
        F.coalesce(first(a)["end_byte"], F.lit(-1)).alias("stop"),
        F.coalesce(a["yes_no_answer"], F.lit(-1)).alias("yes_no"),
        F.coalesce(a["long_answer"]["start_byte"], F.lit(-1)).alias("long_start"),
        F.coalesce(a["long_answer"]["end_byte"], F.lit(-1)).alias("long_stop"),
    )
    notes = F.filter(F.coalesce("annotations", F.array()), lambda a: a.isNotNull())
    return examples.select("example_id", F.transform(notes, label).alias("golds"))


def top_predictions(predictions: DataFrame) -> DataFrame:
    """The most confident scored candidate of each example, then the smallest id."""
    w = Window.partitionBy("example_id").orderBy(F.col("confidence_score").desc(), "prediction_id")
    scored = predictions.where("confidence_score is not null and not isnan(confidence_score)")
    return scored.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def with_gold(gold: DataFrame, top: DataFrame) -> DataFrame:
    p = top.select("example_id", F.col("passage_index").alias("p_passage"), F.col("start_position").alias("p_start"), F.col("end_position").alias("p_stop"), F.col("yes_no_answer").alias("p_yes_no"), F.col("confidence_score").cast("double").alias("score"), "language")
    return gold.join(p, "example_id", "left")


def passage_stats(both: DataFrame, votes: int = 2) -> DataFrame:
    """has_gold, has_pred, value: passage index equal to any annotator's. An example without prediction
    counts as predicted exactly when it has no gold."""
    real = F.filter("golds", lambda g: g["passage"] >= 0)
    has_gold = F.size(real) >= votes
    has_pred = F.when(F.col("score").isNull(), ~has_gold).otherwise(F.col("p_passage") >= 0)
    hit = F.exists(real, lambda g: g["passage"] == F.col("p_passage"))
    return both.select("example_id", "language", F.coalesce("score", F.lit(0.0)).alias("score"), has_gold.alias("has_gold"), has_pred.alias("has_pred"), F.when(has_gold & has_pred & hit, 1.0).otherwise(0.0).alias("value"))


def minimal_stats(both: DataFrame, votes: int = 2) -> DataFrame:
    """value: 1 for an agreed yes or no, else the best byte-span F1 over the annotators."""
    real = F.filter("golds", lambda g: (g["start"] >= 0) | (g["yes_no"] >= 0))
    has_gold = F.size(real) >= votes
    has_pred = F.when(F.col("score").isNull(), ~has_gold).otherwise((F.col("p_start") >= 0) | (F.col("p_yes_no") >= 0))
    agreed = (F.col("p_yes_no") >= 0) & F.exists(real, lambda g: g["yes_no"] == F.col("p_yes_no"))
    best = F.array_max(F.transform(F.filter(real, lambda g: g["start"] >= 0), lambda g: span_overlap_f1(F.col("p_start"), F.col("p_stop"), g["start"], g["stop"])))
    value = F.when(agreed, 1.0).otherwise(F.coalesce(best, F.lit(0.0)))
    return both.select("example_id", "language", F.coalesce("score", F.lit(0.0)).alias("score"), has_gold.alias("has_gold"), has_pred.alias("has_pred"), F.when(has_gold & has_pred, value).otherwise(0.0).alias("value"))


def exact_stats(both: DataFrame, start: str, stop: str, votes: int = 2) -> DataFrame:
    """value: the predicted span equals an annotator's exactly."""
    real = F.filter("golds", lambda g: g[start] >= 0)
    has_gold = F.size(real) >= votes
    has_pred = F.coalesce(F.col("p_start") >= 0, F.lit(False))
    hit = F.exists(real, lambda g: (g[start] == F.col("p_start")) & (g[stop] == F.col("p_stop")))
    return both.select("example_id", "language", F.coalesce("score", F.lit(0.0)).alias("score"), has_gold.alias("has_gold"), has_pred.alias("has_pred"), F.when(has_gold & has_pred & hit, 1.0).otherwise(0.0).alias("value"))


def macro_f1(stats: DataFrame, by: str | None = None) -> DataFrame:
    """Precision, recall and F1 of all examples, or per value of `by`."""
    keys = [by] if by else []
    sums = stats.groupBy(*keys).agg(F.sum("value").alias("v"), F.sum(F.col("has_pred").cast("double")).alias("np"), F.sum(F.col("has_gold").cast("double")).alias("ng"), F.count("*").alias("examples"))
    p, r = F.coalesce(F.try_divide("v", "np"), F.lit(0.0)), F.coalesce(F.try_divide("v", "ng"), F.lit(0.0))
    return sums.select(*keys, F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)), 6).alias("f1"), "examples")


def em_f1(gold: DataFrame, pred: DataFrame, lang: Column | None = None, by: list[str] | None = None, empty: float = 0.0) -> DataFrame:
    """exact_match and f1 in percent over gold (id, golds ARRAY<STRING>) and pred (id, prediction).

    The best of several golds counts; an example without prediction scores 0; `empty` is the F1 of two
    texts without tokens. With `lang` the language's own normalisation applies.
    """
    norm = (lambda c: normalize_answer_lang(c, lang)) if lang is not None else lambda c: normalize_answer(c)
    rows = gold.join(pred, "id", "left")
    p = norm(F.coalesce("prediction", F.lit("")))
    scored = rows.withColumn("p", p).withColumn("g", F.transform("golds", norm))
    em = F.when(F.col("prediction").isNull(), 0.0).otherwise(F.exists("g", lambda g: g == F.col("p")).cast("double"))
    f1 = F.when(F.col("prediction").isNull(), 0.0).otherwise(F.coalesce(F.array_max(F.transform("g", lambda g: token_f1(F.col("p"), g, empty))), F.lit(0.0)))
    return scored.groupBy(*(by or [])).agg(F.round(100 * F.avg(em), 6).alias("exact_match"), F.round(100 * F.avg(f1), 6).alias("f1"), F.count("*").alias("examples"))


def nbest_spans(logits: DataFrame, start: Column, stop: Column, key: str, n_best: int, longest: int, keep: int) -> DataFrame:
    """(key, start, stop, score, rank, probability): the best pairs of the n_best starts and ends.

    Candidates per row are n_best * n_best, built from arrays: only the rows of one example meet.
    """
    best = lambda c, name: F.slice(F.sort_array(F.transform(c, lambda x, i: F.struct((-x.cast("double")).alias("neg"), i.alias("at")))), 1, n_best).alias(name)
    tops = logits.select(key, best(start, "s"), best(stop, "e"))
    pairs = tops.select(key, F.explode("s").alias("s"), "e").select(key, "s", F.explode("e").alias("e"))
    ok = pairs.where((F.col("e.at") >= F.col("s.at")) & (F.col("e.at") - F.col("s.at") + 1 <= longest))
    scored = ok.select(key, F.col("s.at").cast("bigint").alias("start"), F.col("e.at").cast("bigint").alias("stop"), F.round(-F.col("s.neg") - F.col("e.neg"), 6).alias("score"))
    w = Window.partitionBy(key).orderBy(F.col("score").desc(), "start", "stop")
    kept = scored.withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= keep)
    every = Window.partitionBy(key)
    e = F.exp(F.col("score") - F.max("score").over(every))
    return kept.withColumn("e", e).withColumn("probability", F.round(F.col("e") / F.sum("e").over(every), 6)).drop("e")


def first_container(start: Column, stop: Column, candidates: Column) -> Column:
    """Index of the first candidate span that contains [start, stop); -1 if none does."""
    return F.array_position(F.transform(candidates, lambda c: F.coalesce((c["start_byte"] <= start) & (stop <= c["end_byte"]) & (c["start_byte"] >= 0), F.lit(False))), True) - 1


def squad_rows(examples: DataFrame) -> DataFrame:
    """Answers as arrays of structs: text, start, end = start + length, with the whole context as passage 0."""
    zipped = F.arrays_zip(F.col("answers.text").alias("text"), F.col("answers.answer_start").alias("start"))
    target = F.transform(zipped, lambda a: F.struct(a["text"].alias("text"), a["start"].alias("start"), (a["start"] + F.length(a["text"])).alias("stop"), F.lit(0).alias("passage")))
    return examples.where("answers is not null and answers.text is not null and answers.answer_start is not null").withColumn("targets", target)
