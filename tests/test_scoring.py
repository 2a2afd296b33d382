"""Scores, reports, errors and the centroid scorer."""

import pytest
from pyspark.sql import functions as F

from textlab.operators import corpus as K
from textlab.operators import errors as E
from textlab.operators import scoring as S
from textlab.operators.errors import RULE


def predictions(spark, rows):
    return spark.createDataFrame(rows, "row_id bigint, split_no int, label int, prediction int")


def test_f1_and_accuracy(spark):
    rows = [(1, 1, 1, 1), (2, 1, 1, 0), (3, 1, 0, 0), (4, 1, 0, 1), (5, 2, 0, 0), (6, 2, 0, 0)]
    scores = S.split_scores(predictions(spark, rows))
    got = {r["split_no"]: (r["f1"], r["accuracy"]) for r in scores.collect()}
    assert got == {1: (0.5, 0.5), 2: (0.0, 1.0)}         # no positives at all: F1 is 0
    row = S.mean_variance(scores).first()
    assert (row["f1_mean"], row["f1_var"], row["acc_var"]) == (0.25, 0.0625, 0.0625)


def test_classification_report(spark):
    rows = [(i, 1, 1, 1) for i in range(3)] + [(9, 1, 1, 0), (10, 1, 0, 1)]
    got = {r["row"]: r for r in S.classification_report(predictions(spark, rows)).collect()}
    assert (got["1"]["precision"], got["1"]["recall"], got["1"]["support"]) == (0.75, 0.75, 4)
    assert (got["0"]["precision"], got["0"]["f1"], got["0"]["support"]) == (0.0, 0.0, 1)
    assert got["accuracy"]["f1"] == pytest.approx(0.6) and got["accuracy"]["precision"] is None
    assert got["macro avg"]["f1"] == pytest.approx(0.375)
    assert got["weighted avg"]["recall"] == pytest.approx(0.6)


def test_errors_and_report(spark):
    rows = [(2, 1, 1, 0), (10, 1, 1, 0), (2, 2, 1, 0), (3, 1, 0, 0), (99, 1, 1, 0)]
    table = predictions(spark, rows).withColumn("is_synthetic", F.col("row_id") == 99)
    errors = E.misclassified(table)
    assert sorted((r["label"], r["doc_id"]) for r in errors.collect()) == [(1, 2), (1, 10)]
    assert [tuple(r) for r in E.error_counts(errors).collect()] == [(1, 2)]
    corpus = spark.createDataFrame(
        [(i, v, f"é\n{v} {i}") for i in (2, 3, 10) for v in ("original", "masked")],
        "doc_id bigint, variant string, text string")
    docs = E.error_documents(errors, corpus).withColumn("name", F.concat(F.lit("post_"), "doc_id"))
    got = E.error_report(docs).where("variant = 'masked'").orderBy("seq").collect()
    whole = "".join(r["section"] for r in got)
    assert whole == f"post_2:\né\nmasked 2\n\n{RULE}post_10:\né\nmasked 10\n\n{RULE}"
    assert all(whole[r["start"]:].startswith(r["section"]) for r in got)


def test_cross_validation_needs_no_copies(spark):
    features = spark.createDataFrame(
        [(i, [float(i % 2) + 0.01 * i], i % 2) for i in range(20)], "row_id bigint, vector array<double>, label int")
    folds = features.select("row_id", F.lit(1).alias("split_no"), (F.col("row_id") % 5).cast("int").alias("fold"))
    got = S.cv_predictions(features, folds, 1).collect()
    for row in got:
        train = [i for i in range(20) if i % 5 != row["fold"]]
        centre = [sum(i % 2 + 0.01 * i for i in train if i % 2 == c) / sum(i % 2 == c for i in train) for c in (0, 1)]
        x = row["row_id"] % 2 + 0.01 * row["row_id"]
        assert row["prediction"] == int(abs(x - centre[1]) < abs(x - centre[0]))


def test_corpus_statistics(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a  b c"), (0, "x")], "label int, text string")
    assert [tuple(r) for r in K.class_counts(docs).collect()] == [(1, 2), (0, 1)]
    assert {tuple(r) for r in K.mean_words_by_class(docs).collect()} == {(1, 2.5), (0, 1.0)}
    per_author = spark.createDataFrame([("a", 1), ("b", 4)], "author string, n_posts bigint")
    row = K.corpus_stats(per_author, docs).first()
    assert (row["n_posts"], row["mean_posts"], row["median_posts"], row["median_chars"]) == (5, 2.5, 2.5, 3.0)
