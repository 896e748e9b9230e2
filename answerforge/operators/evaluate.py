"""Retrieval, reading, classification and table metrics as aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from answerforge.session import materialize


def running_totals(df: DataFrame, order: str, values: list[str], by: list[str] | None = None) -> DataFrame:
    """Adds total_<value>: sums over rows with the same or a higher `order` (one row per value of it and group).

    Rows are range-partitioned, summed per partition, and only those few sums are put in sequence, so no
    task holds a whole group.
    """
    keys = by or []
    parts = materialize(df.repartitionByRange(*[F.col(k) for k in keys], F.col(order).desc()).withColumn("_p", F.spark_partition_id()), "ranges")
    before = Window.partitionBy(*(keys or [F.lit(1)])).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    sums = parts.groupBy(*keys, "_p").agg(*[F.sum(v).alias(f"_s_{v}") for v in values])
    offsets = sums.select(*keys, "_p", *[F.coalesce(F.sum(f"_s_{v}").over(before), F.lit(0)).alias(f"_o_{v}") for v in values])
    inside = Window.partitionBy(*keys, "_p").orderBy(F.col(order).desc()).rowsBetween(Window.unboundedPreceding, 0)
    out = parts.join(offsets, [*keys, "_p"])
    for v in values:
        out = out.withColumn(f"total_{v}", F.col(f"_o_{v}") + F.sum(v).over(inside))
    return out.drop("_p", *[f"_o_{v}" for v in values])


def first_relevant(ranking: DataFrame, qrels: DataFrame) -> DataFrame:
    """Per judged query: rank of the first relevant hit (NULL if none) and number of relevant documents."""
    judged = qrels.groupBy("qid").agg(F.count("*").alias("n_rel"))
    hits = ranking.join(qrels, ["qid", "doc_id"], "left_semi").groupBy("qid").agg(F.min("rank").alias("first_rank"))
    return judged.join(hits, "qid", "left")


def mrr_success_recall(ranking: DataFrame, qrels: DataFrame, depths: list[int]) -> DataFrame:
    """One row per depth: mrr, success and recall over the judged queries."""
    hits = ranking.join(qrels, ["qid", "doc_id"], "left_semi")
    per = hits.groupBy("qid").agg(F.min("rank").alias("f"), *[F.sum((F.col("rank") <= d).cast("bigint")).alias(f"h{d}") for d in depths])
    judged = qrels.groupBy("qid").agg(F.count("*").alias("n_rel")).join(per, "qid", "left")
    row = [F.struct(F.lit(d).cast("bigint").alias("depth"), F.when(F.col("f") <= d, 1.0 / F.col("f")).otherwise(0.0).alias("rr"), F.when(F.col("f") <= d, 1.0).otherwise(0.0).alias("hit"), (F.coalesce(F.col(f"h{d}"), F.lit(0)) / F.col("n_rel")).alias("rec")) for d in depths]
    each = judged.select(F.explode(F.array(*row)).alias("x")).select("x.*")
    return each.groupBy("depth").agg(F.round(F.avg("rr"), 6).alias("mrr"), F.round(F.avg("hit"), 6).alias("success"), F.round(F.avg("rec"), 6).alias("recall"), F.count("*").alias("queries"))


def ndcg(ranking: DataFrame, qrels: DataFrame, depth: int = 10) -> DataFrame:
    """Mean nDCG with binary gains; the ideal has all judged documents first."""
    gains = ranking.where(F.col("rank") <= depth).join(qrels, ["qid", "doc_id"], "left_semi").groupBy("qid").agg(F.sum(1.0 / F.log2(F.col("rank") + 1)).alias("dcg"))
    judged = qrels.groupBy("qid").agg(F.least(F.count("*"), F.lit(depth)).cast("int").alias("n"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.col("n")), F.lit(0.0).cast("double"), lambda acc, r: acc + 1.0 / F.log2(r + 1))
    per = judged.join(gains, "qid", "left").withColumn("v", F.coalesce(F.col("dcg"), F.lit(0.0)) / ideal)
    return per.agg(F.round(F.avg("v"), 6).alias("ndcg"), F.count("*").alias("queries"))


def curve(stats: DataFrame, has_gold: str, has_pred: str, value: str, score: str, by: list[str] | None = None) -> DataFrame:
    """Precision-recall points, one per distinct score: every row with that score or more counts.

    Columns: by.., score, precision, recall, f1. Rows without a prediction count only as gold.
    """
    keys = by or []
    golds = stats.groupBy(*keys).agg(F.sum(F.col(has_gold).cast("double")).alias("golds"))
    cells = stats.where(has_pred).groupBy(*keys, F.col(score).alias("score")).agg(F.sum(value).alias("v"), F.count("*").alias("n"))
    run = running_totals(cells, "score", ["v", "n"], keys).withColumnsRenamed({"total_v": "tv", "total_n": "tn"})
    joined = run.join(golds, keys) if keys else run.withColumn("golds", F.lit(float(golds.first()[0] or 0.0)))
    p, r = F.col("tv") / F.col("tn"), F.coalesce(F.try_divide(F.col("tv"), F.col("golds")), F.lit(0.0))
    return joined.select(*keys, "score", p.alias("precision"), r.alias("recall"), F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)).alias("f1"))


def best_point(points: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The point of best F1; of equal ones the highest score. An aggregate, combined map-side."""
    row = F.struct(F.round("f1", 9).alias("k"), "score", "precision", "recall", "f1")
    return points.groupBy(*(by or [])).agg(F.max(row).alias("x")).select(*(by or []), "x.score", "x.precision", "x.recall", "x.f1")


def recall_at_precision(points: DataFrame, targets: list[float]) -> DataFrame:
    """Best recall among points of at least each target precision, 0 where there is none."""
    each = points.withColumn("target", F.explode(F.array(*[F.lit(t) for t in targets])))
    return each.groupBy("target").agg(F.round(F.coalesce(F.max(F.when(F.col("precision") >= F.col("target"), F.col("recall"))), F.lit(0.0)), 6).alias("recall"))


def span_overlap_f1(ps: Column, pe: Column, gs: Column, ge: Column) -> Column:
    """F1 of two half-open spans by length of overlap."""
    both = F.greatest(F.lit(0), F.least(pe, ge) - F.greatest(ps, gs)).cast("double")
    p, r = F.coalesce(F.try_divide(both, (pe - ps).cast("double")), F.lit(0.0)), F.coalesce(F.try_divide(both, (ge - gs).cast("double")), F.lit(0.0))
    return F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))


def classification_report(df: DataFrame, gold: str, pred: str, by: str | None = None) -> DataFrame:
    """Precision, recall, F1 and support of every label, over all rows and, if `by` is given, per value of it."""
    label = F.explode(F.array_distinct(F.array(gold, pred)))
    each = df.select(*( [by] if by else []), gold, pred, label.alias("label"))
    counts = [F.sum(((F.col(gold) == F.col("label")) & (F.col(pred) == F.col("label"))).cast("bigint")).alias("tp"), F.sum((F.col(pred) == F.col("label")).cast("bigint")).alias("np"), F.sum((F.col(gold) == F.col("label")).cast("bigint")).alias("support")]
    whole = each.groupBy("label").agg(*counts).withColumn("scope", F.lit("all"))
    table = whole if not by else whole.unionByName(each.groupBy("label", by).agg(*counts).withColumnRenamed(by, "scope"))
    p, r = F.coalesce(F.try_divide(F.col("tp"), F.col("np")), F.lit(0.0)), F.coalesce(F.try_divide(F.col("tp"), F.col("support")), F.lit(0.0))
    return table.select("scope", "label", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)), 6).alias("f1"), "support")


def roc_auc(df: DataFrame, positive: str, score: str) -> DataFrame:
    """Area under the ROC curve by rank sums, ties sharing their mean rank."""
    cells = df.groupBy(F.col(score).alias("s")).agg(F.sum(F.col(positive).cast("bigint")).alias("p"), F.count("*").alias("n"))
    above = running_totals(cells, "s", ["n"])
    total = cells.agg(F.sum("n")).first()[0] or 0
    ranks = above.withColumn("mean_rank", F.lit(total) - F.col("total_n") + (F.col("n") + 1) / 2.0)
    sums = ranks.agg(F.sum(F.col("p") * F.col("mean_rank")).alias("r"), F.sum("p").cast("double").alias("np"), F.sum(F.col("n") - F.col("p")).cast("double").alias("nn"))
    return sums.select(F.round((F.col("r") - F.col("np") * (F.col("np") + 1) / 2) / (F.col("np") * F.col("nn")), 6).alias("auc"), F.round(F.col("np") / (F.col("np") + F.col("nn")), 6).alias("positive_share"))
