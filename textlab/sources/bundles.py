"""Saved classifiers with what is needed to score new text."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from textlab.functions import names as N

_META = (
    "model_name string, feature_file string, dims int, split_seed int, "
    "test_f1 double, test_accuracy double"
)


@dataclass(frozen=True)
class Bundle:
    """A fitted classifier, its feature set and its scores on the first split."""

    classifier: PipelineModel
    model_name: str
    feature_file: str
    dims: int
    split_seed: int
    test_f1: float
    test_accuracy: float

    def describe(self, spark: SparkSession):
        """One row: name, embedding and scores."""
        row = (self.model_name, self.feature_file, self.dims, self.split_seed,
               self.test_f1, self.test_accuracy)
        config = N.embedding_config(F.col("feature_file"))
        return spark.createDataFrame([row], _META).withColumn("embedding", config).withColumn(
            "name", N.bundle_name(F.col("embedding"), F.col("model_name"))
        )


def save_bundle(spark: SparkSession, bundle: Bundle, path: str) -> None:
    bundle.classifier.write().overwrite().save(f"{path}/classifier")
    bundle.describe(spark).write.mode("overwrite").parquet(f"{path}/metadata")


def load_bundle(spark: SparkSession, path: str) -> Bundle:
    row = spark.read.parquet(f"{path}/metadata").first()
    return Bundle(
        PipelineModel.load(f"{path}/classifier"), row["model_name"], row["feature_file"],
        row["dims"], row["split_seed"], row["test_f1"], row["test_accuracy"],
    )
