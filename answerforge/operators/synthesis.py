"""Questions made for passages: answers sampled as targets, and a pipeline around a pluggable generator."""

from __future__ import annotations

from typing import Protocol, runtime_checkable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from answerforge.functions.text import words
from answerforge.operators.ranking import hash_order, take_by_hash

#: Stands between an answer and its passage in a generator's input: a fixed value.
SEPARATOR = " <<sep>> "
#: Example questions among which a prompt's one is drawn.
EXAMPLES = 200


@runtime_checkable
class Generator(Protocol):
    def generate(self, passage: Column, example: Column) -> Column:
        """A question for the passage, given an example question (may be NULL): an expression, or a pandas UDF around a model."""


class LeadGenerator:
    """The first words of the passage as a question: the offline stand-in for a model."""

    def __init__(self, size: int = 8):
        self.size = size

    def generate(self, passage: Column, example: Column) -> Column:
        return F.concat(F.lit("what about "), F.array_join(F.slice(words(passage), 1, self.size), " "), F.lit("?"))


def answer_targets(df: DataFrame, key: str, text: str, answers: Column, n: int, seed: int = 0) -> DataFrame:
    """(key, answer, target): at most n different answers of each passage, in hash order, as `answer <<sep>> text`.
    NULL and blank answers and NULL texts give none."""
    each = df.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text"), F.explode(F.array_distinct(answers)).alias("answer"))
    named = each.where(F.trim("answer") != "").withColumn("choice", F.concat_ws("|", F.col("key").cast("string"), "answer"))
    return take_by_hash(named, "choice", n, ["key"], seed).select(F.col("key").alias(key), "answer", F.concat("answer", F.lit(SEPARATOR), "text").alias("target"))


def synthetic_questions(passages: DataFrame, generator: Generator, times: int = 1, examples: DataFrame | None = None, least_words: int = 3, seed: int = 0) -> DataFrame:
    """(qid, question, pid): `times` questions for each of the passages (pid, text), each with an example drawn by hash from
    `examples` (question; at most EXAMPLES of them, the prompt's pool); questions that are short or were made before for the passage go."""
    drawn = passages.where("text is not null").withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(times))))
    if examples is None:
        drawn = drawn.withColumn("example", F.lit(None).cast("string"))
    else:
        pool = [r["question"] for r in examples.where("question is not null").orderBy(hash_order("question", seed=seed), "question").limit(EXAMPLES).select("question").collect()]
        at = F.pmod(F.xxhash64("pid", "draw", F.lit(seed)), F.lit(max(1, len(pool)))).cast("int")
        drawn = drawn.withColumn("example", F.get(F.array(*map(F.lit, pool)).cast("array<string>"), at))
    made = drawn.select("pid", "draw", generator.generate(F.col("text"), F.col("example")).alias("question")).where(F.size(words(F.col("question"))) >= least_words)
    once = made.groupBy("pid", "question").agg(F.min("draw").alias("draw"))
    return once.select(F.concat_ws("-", F.col("pid").cast("string"), F.col("draw").cast("string")).alias("qid"), "question", "pid")
