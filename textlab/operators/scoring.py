"""Scores of binary predictions and the nearest-centroid scorer.

Every aggregate here is a handful of conditional sums, combined before the
shuffle; the results have one row per split or class.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textlab.functions import vectors as V
from textlab.operators.vectors import aggregate_elements, vector_dims


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def split_scores(predictions: DataFrame, by: Sequence[str] = ("split_no",)) -> DataFrame:
    """F1 of class 1 (0 when undefined) and accuracy per split."""
    hit = F.col("label") == F.col("prediction")
    tp = F.sum(F.when(hit & (F.col("label") == 1), 1).otherwise(0))
    wrong = F.sum(F.when(hit, 0).otherwise(1))
    rows = F.count(F.lit(1))
    return predictions.groupBy(*by).agg(
        _share(2.0 * tp, 2.0 * tp + wrong).alias("f1"), ((rows - wrong) / rows).alias("accuracy")
    )


def mean_variance(scores: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean and population variance of the scores."""
    return scores.groupBy(*by).agg(
        F.avg("f1").alias("f1_mean"), F.var_pop("f1").alias("f1_var"),
        F.avg("accuracy").alias("acc_mean"), F.var_pop("accuracy").alias("acc_var"),
    )


def classification_report(predictions: DataFrame) -> DataFrame:
    """Precision, recall, F1, support per class, with accuracy and averages.

    Rows: one per class, then ``accuracy``, ``macro avg``, ``weighted avg``.
    """
    hit = F.col("label") == F.col("prediction")
    pairs = predictions.groupBy("label", "prediction").agg(F.count(F.lit(1)).alias("n"))
    # At most classes x classes rows from here on.
    sides = pairs.select(
        F.explode(F.array(
            F.struct(F.col("label").alias("cls"), F.col("n").alias("support"),
                     F.lit(0).cast("bigint").alias("predicted"),
                     F.when(hit, F.col("n")).otherwise(0).alias("tp")),
            F.struct(F.col("prediction").alias("cls"), F.lit(0).cast("bigint").alias("support"),
                     F.col("n").alias("predicted"), F.lit(0).cast("bigint").alias("tp")),
        )).alias("s")
    ).select("s.*").groupBy("cls").agg(
        F.sum("support").alias("support"), F.sum("predicted").alias("predicted"),
        F.sum("tp").alias("tp"),
    )
    classes = sides.select(
        F.col("cls").cast("string").alias("row"),
        _share(F.col("tp"), F.col("predicted")).alias("precision"),
        _share(F.col("tp"), F.col("support")).alias("recall"),
        _share(2.0 * F.col("tp"), F.col("support") + F.col("predicted")).alias("f1"),
        F.col("support"), F.col("tp"),
    )
    names = ("precision", "recall", "f1")
    total = F.sum("support")
    accuracy = classes.agg(
        (F.sum("tp") / total).alias("f1"), total.alias("support")
    ).select(
        F.lit("accuracy").alias("row"), F.lit(None).cast("double").alias("precision"),
        F.lit(None).cast("double").alias("recall"), "f1", "support",
    )
    macro = classes.agg(
        *[F.avg(c).alias(c) for c in names], total.alias("support")
    ).withColumn("row", F.lit("macro avg"))
    weighted = classes.agg(
        *[(F.sum(F.col(c) * F.col("support")) / total).alias(c) for c in names],
        total.alias("support"),
    ).withColumn("row", F.lit("weighted avg"))
    return (
        classes.drop("tp").unionByName(accuracy).unionByName(macro).unionByName(weighted)
    )


def class_sums(features: DataFrame, by: Sequence[str], dims: int) -> DataFrame:
    """Vector sums and row counts per class within groups."""
    return aggregate_elements(
        features, [*by, "label"], dims, F.sum, extra=[F.count(F.lit(1)).alias("n")]
    )


def centroids(sums: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row per group with the mean vectors of class 0 and class 1."""
    mean = V.scale(F.col("vector"), 1.0 / F.col("n"))
    return sums.withColumn("vector", mean).groupBy(*by).agg(
        F.max(F.when(F.col("label") == 0, F.col("vector"))).alias("c0"),
        F.max(F.when(F.col("label") == 1, F.col("vector"))).alias("c1"),
    )


def nearest(vector: Column, c0: Column, c1: Column) -> Column:
    """1 if the vector lies nearer to the centroid of class 1, or no other exists."""
    closer = V.squared_distance(vector, c1) < V.squared_distance(vector, c0)
    return F.when(c0.isNull() | closer, 1).otherwise(0)


def centroid_predictions(
    features: DataFrame, splits: DataFrame, dims: int | None = None
) -> DataFrame:
    """Fit class centroids on each training part, predict its test part.

    ``features`` is ``row_id, vector, label``; ``splits`` is ``row_id, split_no,
    part``. The centroid table has one row per split.
    """
    dims = dims or vector_dims(features)
    rows = features.join(splits, "row_id")
    fitted = centroids(
        class_sums(rows.where(F.col("part") == "train"), ["split_no"], dims), ["split_no"]
    )
    test = rows.where(F.col("part") == "test").join(F.broadcast(fitted), "split_no")
    prediction = nearest(F.col("vector"), F.col("c0"), F.col("c1"))
    return test.select("row_id", "split_no", "label", prediction.alias("prediction"))


def cv_predictions(features: DataFrame, folds: DataFrame, dims: int | None = None) -> DataFrame:
    """Predict every fold with the centroids of the other folds, per split.

    ``folds`` is ``row_id, split_no, fold``. A training set of a fold is all
    rows of its split less the fold, so class sums per fold give every model
    without repeating a row for each of them.
    """
    dims = dims or vector_dims(features)
    rows = features.join(folds, "row_id")
    sums = class_sums(rows, ["split_no", "fold"], dims)
    # Splits x folds x classes rows.
    whole = aggregate_elements(
        sums, ["split_no", "label"], dims, F.sum, extra=[F.sum("n").alias("n_all")]
    ).withColumnRenamed("vector", "v_all")
    others = sums.join(F.broadcast(whole), ["split_no", "label"]).select(
        "split_no", "fold", "label", (F.col("n_all") - F.col("n")).alias("n"),
        F.zip_with("v_all", "vector", lambda a, b: a - b).alias("vector"),
    )
    fitted = centroids(others, ["split_no", "fold"])
    prediction = nearest(F.col("vector"), F.col("c0"), F.col("c1"))
    return rows.join(F.broadcast(fitted), ["split_no", "fold"]).select(
        "row_id", "split_no", "fold", "label", prediction.alias("prediction")
    )


def cv_objective_scores(predictions: DataFrame) -> DataFrame:
    """Mean over splits of the mean F1 over folds: one row ``objective``."""
    per_fold = split_scores(predictions, ["split_no", "fold"])
    per_split = per_fold.groupBy("split_no").agg(F.avg("f1").alias("f1"))
    return per_split.agg(F.avg("f1").alias("objective"))
