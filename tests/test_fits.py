"""Fits that run together against single fits, gradients against differences, and the search."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from textlab.operators import many_fits as L
from textlab.operators import models as M
from textlab.operators import networks as N
from textlab.operators import scoring as S
from textlab.operators.sampling import holdout_splits
from textlab.operators.search import SPACE, trial_table
from textlab.plans import tuning

SCHEMA = "row_id bigint, vector array<double>, label int"


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(5)
    rows = [(i, (rng.normal(1.2 * (i % 3 == 0), 1.0, 6) * [1, 3, 0.2, 1, 1, 1] + 2).tolist(), int(i % 3 == 0)) for i in range(240)]
    features = spark.createDataFrame(rows, SCHEMA).repartition(3).cache()
    splits = holdout_splits(features, 2).cache()
    return features, splits, *L.folded(features, splits)


PARAMS = [
    {"model": "Logistic Regression", "c": c, "penalty": p, "class_weight": w}
    for c, p, w in ((10.0, "l2", None), (0.05, "l2", "balanced"), (0.1, "l1", None), (5.0, "l1", "balanced"))
]


def objective(x, y, weight, beta, params, n):
    z = x @ beta[:-1] + beta[-1]
    loss = (weight * (np.logaddexp(0, z) - y * z)).sum() / weight.sum()
    size = np.abs(beta[:-1]).sum() if params["penalty"] == "l1" else 0.5 * (beta[:-1] ** 2).sum()
    return loss + size / (params["c"] * n)


def test_together_as_alone(spark, data):
    features, splits, rows, numbers = data
    fits = [L.Fit.of(p, s, f) for p in PARAMS for s in range(2) for f in (None, 0, 3)]
    beta = L.fit_all(rows, fits)
    alone = np.concatenate([L.fit_all(rows, [fit]) for fit in fits[:3]])
    assert np.allclose(alone, beta[:3], atol=1e-4)
    local = {r["row_id"]: r for r in rows.collect()}
    for (params, split), own in {(i, s): beta[i * 6 + s * 3] for i in range(4) for s in range(2)}.items():
        train = [r for r in local.values() if r["folds"][split] != L.OUT]
        x, y = np.array([r["vector"] for r in train]), np.array([r["label"] for r in train])
        params = PARAMS[params]
        counts = np.bincount(y)
        weight = len(y) / (2 * counts[y]) if params["class_weight"] else np.ones(len(y))
        ml = spark.createDataFrame([(r["vector"], r["label"], float(w)) for r, w in zip(train, weight)],
                                   "vector array<double>, label int, weight double").withColumn("features", array_to_vector("vector"))
        single = M.build_classifier(params, len(y), 6, 2000).setTol(1e-10).fit(ml)
        other = np.append(single.coefficients.toArray(), single.intercept)
        # No worse than the single fit, and nearly the same.
        assert objective(x, y, weight, own, params, len(y)) <= objective(x, y, weight, other, params, len(y)) + 1e-7
        assert np.allclose(own, other, atol=2e-3 * max(1, np.abs(other).max()))


def test_scores_and_predictions_are_those_of_the_coefficients(spark, data):
    _, splits, rows, numbers = data
    fits = [L.Fit.of(PARAMS[0], s, f) for s in range(2) for f in (None, 2)]
    beta = L.fit_all(rows, fits)
    f1, accuracy = L.tested(rows, fits, beta)
    local = rows.collect()
    for fit, b, want_f1, want in zip(fits, beta, f1, accuracy):
        own = [r for r in local if r["folds"][fit.split] == (L.OUT if fit.fold is None else fit.fold)]
        said = [int(np.dot(r["vector"], b[:-1]) + b[-1] > 0) for r in own]
        tp = sum(p and r["label"] for p, r in zip(said, own))
        wrong = sum(p != r["label"] for p, r in zip(said, own))
        assert want_f1 == pytest.approx(2 * tp / (2 * tp + wrong)) and want == pytest.approx(1 - wrong / len(own))
    tests = L.predictions(rows, numbers, fits[::2], beta[::2])
    assert {(r["row_id"], r["split_no"]) for r in tests.collect()} == {
        (r["row_id"], r["split_no"]) for r in splits.where("part = 'test'").collect()}
    assert [r["accuracy"] for r in S.split_scores(tests).orderBy("split_no").collect()] == pytest.approx(accuracy[::2].tolist())


def test_search_equals_single_objectives_and_resumes(spark, data, tmp_path, monkeypatch):
    features, splits, *_ = data
    path = str(tmp_path / "trials")
    model = ["Logistic Regression"]
    first = {r["trial"]: r["objective"] for r in tuning.search(features, splits, "f.csv", model, 3, path).collect()}
    counted = []
    real = L.fit_all
    monkeypatch.setattr(L, "fit_all", lambda rows, fits, m: counted.append(len(fits)) or real(rows, fits, m))
    more = {r["trial"]: r["objective"] for r in tuning.search(features, splits, "f.csv", model, 5, path).collect()}
    assert counted == [2 * 10] and more.keys() == set(range(5)) and {t: more[t] for t in first} == first
    again = {r["trial"]: r["objective"] for r in tuning.search(features, splits, "f.csv", model, 5, path).collect()}
    assert len(counted) == 1 and again == more
    monkeypatch.undo()
    keys = spark.createDataFrame([("f.csv",)], "filename string")
    params = trial_table(keys, model[0], 1).first().asDict()
    rows, numbers = L.folded(features, splits)
    fits = [L.Fit.of(params, s, f) for s in range(len(numbers)) for f in range(5)]
    local, f1 = rows.collect(), []
    for fit, b in zip(fits, L.fit_all(rows, fits)):
        own = [(int(np.dot(r["vector"], b[:-1]) + b[-1] > 0), r["label"]) for r in local if r["folds"][fit.split] == fit.fold]
        tp, wrong = sum(p and y for p, y in own), sum(p != y for p, y in own)
        f1.append(2 * tp / (2 * tp + wrong) if tp or wrong else 0.0)
    assert first[0] == pytest.approx(np.mean(f1))


def test_tuned_results_have_the_best_parameters(data):
    features, splits, *_ = data
    row = tuning.tune(features, splits, "f.csv", ["Logistic Regression"], 4).first()
    trials = tuning.search(features, splits, "f.csv", ["Logistic Regression"], 4).collect()
    best = max(trials, key=lambda r: (r["objective"], -r["trial"]))
    assert (row["trial"], row["c"], row["penalty"], row["objective"]) == (best["trial"], best["c"], best["penalty"], best["objective"])
    assert 70 < row["accuracy"] <= 100 and row["hidden_layer_sizes"] is None


@pytest.mark.parametrize("activation", ["relu", "tanh", "logistic"])
def test_gradients_equal_differences(activation):
    rng = np.random.default_rng(2)
    net = N.Network(0, None, (5, 4), activation, 8, 0.01, "constant")
    x, y, weight = rng.normal(size=(7, 3)), rng.integers(0, 2, 7), rng.uniform(0.5, 2, 7)
    flat = N.initial(net, 3) + 0.05
    _, slope = N.loss_and_gradient(net, flat, x, y, weight)
    for i in range(len(flat)):
        step = np.zeros_like(flat)
        step[i] = 1e-6
        up, down = (N.loss_and_gradient(net, flat + s, x, y, weight)[0] for s in (step, -step))
        assert slope[i] == pytest.approx((up - down) / 2e-6, abs=1e-6)


def network(**changes):
    params = {"model": "Neural Network", "hidden_layer_sizes": "(8, 4)", "batch_size": 32, "activation": "relu",
              "learning_rate": "constant", "learning_rate_init": 0.01}
    return N.Network.of(params | changes, 0)


def test_recorded_parameters_change_the_network(data):
    *_, rows, numbers = data
    nets = [network(), network(activation="tanh"), network(activation="logistic"), network(learning_rate="invscaling"),
            network(learning_rate="adaptive", learning_rate_init=0.05), network(batch_size=200), network(hidden_layer_sizes="(4,)"), network()]
    states = {r["net"]: bytes(r["state"]) for r in N.fit_all(rows, nets, 12).collect()}
    assert states[0] == states[7] and len(set(states.values())) == 7
    again = {r["net"]: bytes(r["state"]) for r in N.fit_all(rows.repartition(5), nets[:1], 12).collect()}
    assert again[0] == states[0]                                 # alone as together, in any partitioning
    with pytest.raises(ValueError):
        network(activation="step")
    with pytest.raises(ValueError):
        network(learning_rate="cyclic")


def test_adaptive_rates_fall_and_training_ends(data):
    *_, rows, _ = data
    nets = [network(learning_rate="adaptive", learning_rate_init=0.1), network(learning_rate_init=0.1)]
    states = {r["net"]: N.State(bytes(r["state"])) for r in N.fit_all(rows, nets, 400).collect()}
    assert states[0].rate < 0.1 and states[1].rate == 0.1 and states[1].updates < 400 * 6


@pytest.mark.parametrize("shard_rows", [1 << 16, 40])
def test_networks_beat_the_majority(spark, data, shard_rows, monkeypatch):
    monkeypatch.setattr(N, "SHARD_ROWS", shard_rows)
    features, splits, rows, numbers = data
    nets = [N.Network.of({"hidden_layer_sizes": "(8, 4)", "batch_size": 16, "learning_rate_init": 0.01, "class_weight": "balanced"}, s)
            for s in range(2)]
    said = N.predictions(rows, numbers, nets, N.fit_all(rows, nets, 100))
    tests = splits.where("part = 'test'")
    assert said.count() == tests.count()
    assert all(r["accuracy"] > 0.75 for r in S.split_scores(said).collect())
    assert said.where("probability < 0.5 OR probability > 1").isEmpty()


@pytest.mark.parametrize("n", [5, 8])
def test_networks_train_in_tasks_of_their_own(data, n):
    *_, rows, _ = data
    copies, shards, lanes = N.dealt(rows, [network()] * n)
    groups = copies.select("lane", "shard", F.spark_partition_id().alias("task")).distinct()
    assert (shards, lanes, groups.count()) == (1, n, n)
    assert groups.groupBy("task").count().where("count > 1").isEmpty()


def test_networks_compute_in_single_precision(data):
    *_, rows, _ = data
    part, _ = N.matrices(rows.limit(20).toArrow())
    net = network(learning_rate="adaptive")
    state = N.State(N.State.start(net, part.x.shape[1]))
    state.epoch(net, part.x, part.y, np.ones(len(part.y)), np.arange(len(part.y)))
    assert {a.dtype for a in (part.x, state.flat, state.first, state.second, *N.forward(net, state.flat, part.x))} == {np.dtype("float32")}
    sure = np.full_like(state.flat, 100)                         # a loss is finite however sure a network is
    assert np.isfinite(N.loss_and_gradient(net, sure, np.abs(part.x) + 1, np.zeros(len(part.y)), np.ones(len(part.y)))[0])


def test_networks_in_the_search(data):
    features, splits, rows, numbers = data
    params = {"hidden_layer_sizes": "(4,)", "batch_size": 64, "learning_rate_init": 0.01}
    scores = tuning.objectives("Neural Network", features, splits, rows, 2, [params] * 2, 20)
    assert scores[0] == scores[1] > 0.4


def test_recorded_classifiers_are_scored_or_missing(spark, data):
    features, splits, *_ = data
    recorded = spark.createDataFrame(
        [("f.csv", "Logistic Regression", 10.0, "l1", None, None), ("f.csv", "Neural Network", None, None, "(8, 4)", 0.02),
         ("g.csv", "Logistic Regression", 1.0, "l2", None, None)],
        "filename string, model string, c double, penalty string, hidden_layer_sizes string, learning_rate_init double")
    once, twice = ({(r["filename"], r["model"]): r for r in tuning.evaluate_recorded(recorded, {"f.csv": (features, splits)}, 60).collect()}
                   for _ in range(2))
    assert once == twice and len(once) == 3
    assert once["g.csv", "Logistic Regression"]["status"] == "missing" and once["g.csv", "Logistic Regression"]["acc_mean"] is None
    for model in ("Logistic Regression", "Neural Network"):
        r = once["f.csv", model]
        assert r["status"] == "scored" and r["acc_mean"] > 0.7 and 0 <= r["f1_var"] < 0.1


def test_every_searched_model_can_be_built(spark):
    keys = spark.createDataFrame([("a",)], "filename string")
    for model in SPACE:
        params = trial_table(keys, model, 1).first().asDict()
        assert M.build_classifier(params, 100, 4) is not None


def test_recorded_classifiers_run_side_by_side(spark, data, monkeypatch):
    """Classifiers of several files do not wait for each other."""
    import threading
    features, splits, *_ = data
    both = threading.Barrier(2)

    def score(model, *_):
        both.wait(60)
        return 0.5, 0.0, 0.75, 0.0

    monkeypatch.setattr(tuning, "test_scores", score)
    recorded = spark.createDataFrame([(f, "Logistic Regression") for f in ("f.csv", "g.csv", "h.csv")], "filename string, model string")
    found = tuning.evaluate_recorded(recorded, {f: (features, splits) for f in ("f.csv", "g.csv")}).collect()
    assert sorted((r["filename"], r["status"], r["acc_mean"]) for r in found) == [
        ("f.csv", "scored", 0.75), ("g.csv", "scored", 0.75), ("h.csv", "missing", None)]
