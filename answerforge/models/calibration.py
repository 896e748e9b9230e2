"""Confidence of reader answers: logistic regression over their features, and centroids by k-means."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fit_confidence(rows: DataFrame, features: list[str], label: str, penalty: float = 0.01):
    """A model for `apply_confidence`; rows with NULL features are left out of the fit."""
    known = rows.where(" and ".join(f"{c} is not null" for c in [*features, label])).withColumn("_label", F.col(label).cast("double"))
    return LogisticRegression(featuresCol="_x", labelCol="_label", regParam=penalty).fit(VectorAssembler(inputCols=features, outputCol="_x").transform(known))


def apply_confidence(model, rows: DataFrame, features: list[str], name: str = "confidence") -> DataFrame:
    """Adds the probability of a right answer; NULL features count as 0."""
    filled = rows.fillna(0.0, features)
    scored = model.transform(VectorAssembler(inputCols=features, outputCol="_x").transform(filled))
    return scored.withColumn(name, vector_to_array("probability")[1]).drop("_x", "rawPrediction", "probability", "prediction")


def train_centroids(vectors: DataFrame, k: int, vector: str = "embedding", seed: int = 123) -> DataFrame:
    """(cid, centroid) of a k-means over the vectors: k rows."""
    rows = vectors.where(F.col(vector).isNotNull()).select(array_to_vector(F.transform(vector, lambda x: x.cast("double"))).alias("features"))
    centers = KMeans(k=k, seed=seed).fit(rows).clusterCenters()
    return vectors.sparkSession.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(centers)], "cid bigint, centroid array<double>")
