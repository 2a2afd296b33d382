"""Balancing, hold-out splits, folds and class weights.

All draws come from hashes of a seed and a row key, and only row keys are
shuffled to make splits and folds, never the vectors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textlab.functions import hashing as H
from textlab.functions import vectors as V
from textlab.operators.neighbours import nearest_neighbours
from textlab.operators.ranking import hash_cutoffs, positions
from textlab.operators.vectors import DIGITS
from textlab.session import written


def holdout_splits(rows: DataFrame, n: int = 5, test: float = 0.2, first_seed: int = 1) -> DataFrame:
    """``row_id, split_no, part``: ``n`` independent splits by hash order.

    Each has exactly ``ceil(test * rows)`` test rows. A split needs only the
    hash of its last test row, so rows are compared with ``n`` cut-offs.
    """
    ids = rows.select("row_id")
    seeds = F.explode(F.sequence(F.lit(first_seed), F.lit(first_seed + n - 1))).alias("split_no")
    keyed = ids.select("row_id", seeds).withColumn(
        "key", H.order_key(F.col("split_no"), F.col("row_id"))
    )
    quota = F.ceil(F.lit(float(test)) * F.col("n"))
    cutoffs = hash_cutoffs(keyed, "key", quota, "split_no")
    part = F.when(F.col("key") <= F.col("cutoff"), "test").otherwise("train")
    return keyed.join(F.broadcast(cutoffs), "split_no").select(
        "row_id", "split_no", part.alias("part")
    )


def stratified_folds(rows: DataFrame, n: int = 5, within: tuple[str, ...] = ()) -> DataFrame:
    """``row_id, label, fold``: consecutive blocks per class in ``row_id`` order.

    Fold sizes follow the interleaving rule: with the rows sorted by class,
    classes in order of first appearance, fold ``i`` of a class has as many rows
    as there are places ``p`` with ``p % n = i`` in its stretch.
    """
    keys = list(within)
    ranked = positions(rows.select(*keys, "row_id", "label"), ["row_id"], "pos", [*keys, "label"])
    # One row per class (and group).
    classes = ranked.groupBy(*keys, "label").agg(
        F.count(F.lit(1)).alias("n"), F.min("row_id").alias("first")
    )
    before = Window.partitionBy(*keys).orderBy("first").rowsBetween(Window.unboundedPreceding, -1)
    classes = classes.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)))

    def places_upto(i: int):
        # Rows of the class in the folds 0..i.
        sizes = [
            F.floor((F.col("start") + F.col("n") - 1 - j) / n)
            - F.floor((F.col("start") - 1 - j) / n)
            for j in range(i + 1)
        ]
        return sum(sizes[1:], sizes[0])

    bounds = classes.select(
        *keys, "label", F.array(*[places_upto(i) for i in range(n)]).alias("bounds")
    )
    fold = F.size(F.filter("bounds", lambda b: b <= F.col("pos")))
    return ranked.join(F.broadcast(bounds), [*keys, "label"]).select(
        *keys, "row_id", "label", fold.alias("fold")
    )


def class_weights(rows: DataFrame) -> DataFrame:
    """Rows with ``weight = n / (classes * n_class)``."""
    counts = rows.groupBy("label").agg(F.count(F.lit(1)).alias("_n"))
    totals = counts.withColumn("_all", F.sum("_n").over(Window.partitionBy())).withColumn(
        "_k", F.count(F.lit(1)).over(Window.partitionBy())
    )
    weight = F.col("_all") / (F.col("_k") * F.col("_n"))
    weights = totals.select("label", weight.alias("weight"))
    # One row per class.
    return rows.join(F.broadcast(weights), "label")


def class_sizes(features: DataFrame) -> tuple[int, int, int]:
    """The minority label, its row count and the rows it lacks."""
    rows = features.groupBy("label").count().orderBy("count", F.desc("label")).collect()
    if len(rows) != 2:
        raise ValueError("balancing needs exactly two classes")
    return rows[0]["label"], rows[0]["count"], rows[1]["count"] - rows[0]["count"]


def synthetic_keys(spark, n_new: int, n_minority: int, k: int) -> DataFrame:
    """``j, base, rank, gap`` of every synthetic row.

    They depend on ``j`` only: two tables of the same documents balanced with
    the same ``k`` draw the same base rows, neighbour ranks and gaps.
    """
    j = F.col("j")
    return spark.range(n_new).withColumnRenamed("id", "j").select(
        "j",
        F.floor(H.uniform("b", j) * F.lit(n_minority)).alias("base"),
        (F.floor(H.uniform("n", j) * F.lit(k)) + 1).alias("rank"),
        H.uniform("g", j).alias("gap"),
    )


def smote(features: DataFrame, k: int = 5) -> DataFrame:
    """Oversample the minority class to the size of the other.

    A synthetic row lies on the segment from a minority row to one of its ``k``
    nearest minority neighbours. Result: ``row_id, vector, label, is_synthetic``;
    synthetic rows are numbered after the largest ``row_id``. The features are
    read several times, so pass a written table, not a long computation.
    """
    spark = features.sparkSession
    label, n_minority, n_new = class_sizes(features)
    originals = features.select("row_id", "vector", "label").withColumn(
        "is_synthetic", F.lit(False)
    )
    if n_new == 0:
        return originals
    if n_minority <= k:
        raise ValueError(f"{k} neighbours need more than {k} minority rows")
    minority = features.where(F.col("label") == label).select("row_id", "vector")
    minority = written(minority, "minority")
    base = positions(minority.select("row_id"), ["row_id"], "base")
    pairs = nearest_neighbours(minority, k)
    drawn = (
        synthetic_keys(spark, n_new, n_minority, k)
        .join(base, "base").join(pairs.select("row_id", "rank", "neighbour"), ["row_id", "rank"])
    )
    other = minority.select(F.col("row_id").alias("neighbour"), F.col("vector").alias("v2"))
    point = V.rounded(V.interpolate(F.col("vector"), F.col("v2"), F.col("gap")), DIGITS)
    last = features.agg(F.max("row_id")).scalar()
    synthetic = (
        drawn.join(minority, "row_id").join(other, "neighbour")
        .select((last + 1 + F.col("j")).alias("row_id"), point.alias("vector"),
                F.lit(label).alias("label"), F.lit(True).alias("is_synthetic"))
    )
    return originals.unionByName(synthetic)
