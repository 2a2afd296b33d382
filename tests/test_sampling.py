"""Neighbours, balancing, splits and folds."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from textlab.operators.neighbours import nearest_neighbours
from textlab.operators.sampling import class_weights, holdout_splits, smote, stratified_folds
from textlab.plans.experiments import balanced_training_part, prepare_data


def table(spark, rows):
    return spark.createDataFrame(rows, "row_id bigint, vector array<double>, label int")


@pytest.fixture(scope="module")
def features(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(3.0 if i % 7 == 0 else 0.0, 1.0, 3).tolist(), int(i % 7 == 0)) for i in range(120)]
    return table(spark, rows)


@pytest.mark.parametrize("block_rows", [2000, 16])
def test_neighbours_equal_brute_force(spark, block_rows):
    rng = np.random.default_rng(1)
    points = rng.normal(size=(90, 4)).round(2)
    points[20:50] = points[3]                            # a third of the rows are copies
    points[50:60] = points[5]
    df = spark.createDataFrame([(i * 2, p.tolist()) for i, p in enumerate(points)], "row_id bigint, vector array<double>")
    got: dict = {}
    for r in nearest_neighbours(df, 5, block_rows).orderBy("row_id", "rank").collect():
        got.setdefault(r["row_id"], []).append(r["neighbour"])
    for i, p in enumerate(points):
        d = np.sqrt(((points - p) ** 2).sum(axis=1)).round(9)
        order = [2 * j for j in np.lexsort((np.arange(len(points)), d)) if j != i][:5]
        assert got[2 * i] == order


def test_smote(spark, features):
    balanced = smote(features).collect()
    counts = {c: sum(r["label"] == c for r in balanced) for c in (0, 1)}
    assert counts[0] == counts[1] == 102
    assert len({r["row_id"] for r in balanced}) == len(balanced)
    minority = np.array([r["vector"] for r in balanced if r["label"] == 1 and not r["is_synthetic"]])
    for row in balanced:
        if row["is_synthetic"]:
            p = np.array(row["vector"])
            # On the segment between two originals: the detour is zero.
            to = np.sqrt(((minority - p) ** 2).sum(axis=1))
            between = np.sqrt(((minority[:, None] - minority[None]) ** 2).sum(axis=2))
            assert np.abs(to[:, None] + to[None] - between).min() < 1e-8
    again = {r["row_id"]: r["vector"] for r in smote(features.repartition(9)).collect()}
    assert again == {r["row_id"]: r["vector"] for r in balanced}


def test_smote_needs_more_rows_than_neighbours(spark):
    rows = [(i, [float(i)], int(i < 3)) for i in range(10)]
    with pytest.raises(ValueError):
        smote(table(spark, rows))
    even = [(i, [float(i)], i % 2) for i in range(10)]
    assert smote(table(spark, even)).count() == 10


@pytest.mark.parametrize(("rows", "test"), [(10, 0.2), (35, 0.2), (101, 0.3), (1, 0.2)])
def test_split_sizes(spark, rows, test):
    df = spark.range(rows).withColumnRenamed("id", "row_id")
    got = holdout_splits(df, 3, test).collect()
    for number in (1, 2, 3):
        parts = [r["part"] for r in got if r["split_no"] == number]
        assert len(parts) == rows and parts.count("test") == math.ceil(test * rows)
    again = holdout_splits(df.repartition(5), 3, test).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, got))


def test_folds_follow_the_interleaving_rule(spark):
    labels = [1] * 13 + [0] * 24
    got = {r["row_id"]: r["fold"] for r in stratified_folds(
        spark.createDataFrame(list(enumerate(labels)), "row_id bigint, label int")).collect()}
    for label, start, n in ((1, 0, 13), (0, 13, 24)):
        rows = [i for i, x in enumerate(labels) if x == label]
        folds = [got[i] for i in rows]
        assert folds == sorted(folds)                    # consecutive blocks
        assert [folds.count(f) for f in range(5)] == [
            sum(p % 5 == f for p in range(start, start + n)) for f in range(5)]


def test_class_weights(spark, features):
    got = {(r["label"], round(r["weight"], 9)) for r in class_weights(features).collect()}
    assert got == {(1, round(120 / 36, 9)), (0, round(120 / 204, 9))}


def test_balance_before_or_after_the_split(spark, features):
    balanced, splits = prepare_data(features)
    assert balanced.count() == 204 and splits.where("split_no = 1 AND part = 'test'").count() == 41
    plain, splits = prepare_data(features, balance="train_only")
    part = balanced_training_part(plain, splits, 1)
    counts = {r["label"]: r["count"] for r in part.groupBy("label").count().collect()}
    assert counts[0] == counts[1]
    test_ids = {r["row_id"] for r in splits.where("split_no = 1 AND part = 'test'").collect()}
    assert not test_ids & {r["row_id"] for r in part.where(~F.col("is_synthetic")).collect()}
    with pytest.raises(ValueError):
        prepare_data(features, balance="never")
