"""Classifiers, search, bundles and prediction on separable invented data."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from textlab.operators import models as M
from textlab.operators import scoring as S
from textlab.operators.sampling import holdout_splits
from textlab.operators.search import SPACE, trial_table
from textlab.plans.experiments import variant_experiment
from textlab.plans.predict import embed_texts, predict, train_bundle
from textlab.operators.vectors import vector_lookup
from textlab.sources.bundles import load_bundle, save_bundle
from textlab.streaming.scoring import first_arrivals, mask_and_score_stream, stream_documents

LOGISTIC = {"model": "Logistic Regression", "c": 10.0, "penalty": "l2", "class_weight": "balanced"}
FOREST = {"model": "Random Forest", "n_estimators": 5, "max_features": "log2", "criterion": "entropy"}
NETWORK = {"model": "Neural Network", "hidden_layer_sizes": "(8, 4)", "batch_size": 16, "learning_rate_init": 0.01}


@pytest.fixture(scope="module")
def features(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(2.5 * (i % 3 == 0), 1.0, 4).tolist(), int(i % 3 == 0)) for i in range(150)]
    return spark.createDataFrame(rows, "row_id bigint, vector array<double>, label int").cache()


@pytest.mark.parametrize("params", [LOGISTIC, FOREST, NETWORK], ids=lambda p: p["model"])
def test_fits_beat_the_majority_and_repeat(spark, features, params):
    splits = holdout_splits(features, 1)
    first = M.fit_predict_splits(features, splits, params, 50)
    scores = S.split_scores(first).first()
    assert scores["accuracy"] > 0.8 and scores["f1"] > 0.7
    again = M.fit_predict_splits(features, splits, params, 50)
    assert sorted(map(tuple, first.collect())) == sorted(map(tuple, again.collect()))


def test_trials_lie_in_their_ranges(spark):
    keys = spark.createDataFrame([("a",), ("b",)], "filename string")
    for model, space in SPACE.items():
        rows = trial_table(keys, model, 50).collect()
        assert len(rows) == 100
        for name, (kind, *rest) in space.items():
            values = [r[name] for r in rows]
            if kind == "choice":
                assert set(values) == set(rest)
            else:
                assert all(rest[0] <= v <= rest[1] for v in values) and len(set(values)) > 30
        assert [r[2:] for r in rows if r["filename"] == "a"] == [
            r[2:] for r in trial_table(keys.where("filename = 'a'"), model, 50).collect()]


def test_unknown_model():
    with pytest.raises(ValueError):
        M.build_classifier({"model": "x"}, 1, 1)


TEXTS = [(0, "oak oak pine"), (1, "elm elm"), (2, "  \n "), (3, "OAK red oak"), (4, "nothing")]


def test_bundle_batch_and_stream(spark, tmp_path):
    vectors = {"oak": [1.0, 0.0], "pine": [0.9, 0.2], "elm": [-1.0, 0.1]}
    lookup = vector_lookup(
        spark.createDataFrame(list(vectors.items()), "word string, vector array<double>"),
        spark.createDataFrame([], "word string, lemma string"))
    rows = [(i, [1.0 if i % 2 else -1.0, 0.01 * i], i % 2) for i in range(40)]
    features = spark.createDataFrame(rows, "row_id bigint, vector array<double>, label int")
    bundle = train_bundle(features, holdout_splits(features), LOGISTIC, "word_embeddings_2_average.csv", 2)
    assert bundle.test_f1 == 1.0
    save_bundle(spark, bundle, str(tmp_path / "bundle"))
    loaded = load_bundle(spark, str(tmp_path / "bundle"))
    assert loaded.describe(spark).first()["name"] == "glove_twitter_2_average_logistic_regression"

    def score(texts, with_bundle=loaded):
        return predict(texts, with_bundle, lambda t: embed_texts(t, ["red"], lookup, 2))

    texts = spark.createDataFrame(TEXTS, "doc_id bigint, text string")
    batch = {r["doc_id"]: r for r in score(texts).collect()}
    assert batch.keys() == {0, 1, 3, 4}                     # the blank text is left out
    assert batch[0]["label_text"] == "Positive (1)" and batch[1]["label_text"] == "Control (0)"
    assert batch[0]["confidence"].endswith("%") and batch[0]["probability"] > 0.5
    before = {r["doc_id"]: r for r in score(texts, bundle).collect()}
    assert before == batch
    # One text alone gives what it gives in the batch.
    assert score(texts.where("doc_id = 3")).first() == batch[3]

    folder = str(tmp_path / "incoming")
    sink, log = str(tmp_path / "sink"), str(tmp_path / "log")
    for part in ("doc_id < 2", "doc_id >= 2"):
        texts.where(part).coalesce(1).write.mode("append").parquet(folder)
        source = stream_documents(spark, folder, texts.schema, max_files=1)
        mask_and_score_stream(source, score, sink, log).awaitTermination()
    streamed = {r["doc_id"]: r for r in spark.read.parquet(sink).drop("batch").collect()}
    assert streamed == batch


def test_documents_that_arrive_twice(spark, tmp_path):
    """In one batch, in another, and after a restart."""
    folder, sink, log = (str(tmp_path / n) for n in ("incoming", "sink", "log"))
    schema = "doc_id bigint, at timestamp"
    for ids in ([1, 1, 2, None], [2, 3, None], [3, 1, 4]):
        rows = spark.createDataFrame([(i,) for i in ids], "doc_id bigint").withColumn("at", F.lit("2024-01-01").cast("timestamp"))
        rows.write.mode("append").parquet(folder)
        source = first_arrivals(stream_documents(spark, folder, schema))
        mask_and_score_stream(source, lambda batch: batch, sink, log).awaitTermination()
    assert sorted(r["doc_id"] or 0 for r in spark.read.parquet(sink).collect()) == [0, 1, 2, 3, 4]
    timed = first_arrivals(stream_documents(spark, folder, schema), time="at")
    mask_and_score_stream(timed, lambda batch: batch, str(tmp_path / "s2"), str(tmp_path / "l2")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "s2")).count() == 5


def test_variant_experiment_with_a_classifier(spark):
    rng = np.random.default_rng(2)
    rows = [(i, v, rng.normal(3.0 * (i % 4 == 0), 1.0, 2).tolist(), int(i % 4 == 0))
            for i in range(60) for v in ("masked", "original")]
    features = spark.createDataFrame(rows, "doc_id bigint, variant string, vector array<double>, label int")
    row = variant_experiment(features, "f.csv", 2).first().asDict()
    assert len(row) == 17 and row["file"] == "f.csv"
    assert all(0.8 < v <= 1 for k, v in row.items() if k.endswith("acc_mean"))
