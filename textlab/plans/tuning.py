"""Search, training and evaluation of classifiers, in one run that can be resumed."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from multiprocessing.pool import ThreadPool

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlab.operators import many_fits as L
from textlab.operators import models as M
from textlab.operators import networks as N
from textlab.operators import scoring as S
from textlab.operators.report import RESULT_COLUMNS
from textlab.operators.search import SPACE, trial_table

TRIALS = "filename string, model string, trial int, objective double"
PARALLEL = 12  # recorded classifiers fitted at a time
LONGEST = ("Neural Network", "Logistic Regression", "Random Forest")  # many small rounds first, so that forests fill the tasks between
NETWORK_TRIALS = 4  # trials of networks that are trained together
SCORES = "f1_mean double, f1_var double, acc_mean double, acc_var double"


def objectives(
    model: str, features: DataFrame, splits: DataFrame, rows: DataFrame, n_splits: int, trials: Sequence[Mapping], max_iter: int,
) -> list[float]:
    """The mean over splits of the mean F1 over folds, for every trial of one classifier."""
    if model == "Logistic Regression":
        return L.search(rows, n_splits, trials, max_iter=max_iter)
    if model == "Neural Network":
        out = []
        for at in range(0, len(trials), NETWORK_TRIALS):
            some = trials[at:at + NETWORK_TRIALS]
            nets = [N.Network.of(t, s, f) for t in some for s in range(n_splits) for f in range(5)]
            said = N.predictions(rows, list(range(n_splits)), nets, N.fit_all(rows, nets, max_iter))
            f1 = {r["net"]: r["f1"] for r in S.split_scores(said, ["net"]).collect()}
            out += np.array([f1.get(i, 0.0) for i in range(len(nets))]).reshape(len(some), -1).mean(axis=1).tolist()
        return out
    return [M.cv_objective(features, splits, lambda n, d, t=t: M.build_classifier(t, n, d, max_iter)) for t in trials]


def read_trials(spark, path: str | None) -> DataFrame:
    """The trials an earlier run has recorded; none if there is no such table."""
    if path is not None:
        try:
            return spark.read.schema(TRIALS).parquet(path)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
    return spark.createDataFrame([], TRIALS)


def search(
    features: DataFrame, splits: DataFrame, filename: str, models: Sequence[str] = tuple(SPACE), n_trials: int = 100,
    path: str | None = None, seed: int = M.SEED, max_iter: int = 1000,
) -> DataFrame:
    """``filename, model, trial, objective`` and the parameters of every trial.

    With a ``path``, scores are appended there model by model, and trials recorded
    there by an earlier run are not fitted again.
    """
    spark = features.sparkSession
    keys = spark.createDataFrame([(filename,)], "filename string")
    rows, numbers = L.folded(features, splits)
    tables = []
    for model in models:
        table = trial_table(keys, model, n_trials, seed)
        own = (F.col("filename") == filename) & (F.col("model") == model)
        known = {r["trial"]: r["objective"] for r in read_trials(spark, path).where(own).collect()}  # a number for each trial
        trials = [r.asDict() for r in table.orderBy("trial").collect()]
        new = [t for t in trials if t["trial"] not in known]
        if new:
            scores = objectives(model, features, splits, rows, len(numbers), new, max_iter)
            found = [(filename, model, t["trial"], s) for t, s in zip(new, scores)]
            if path is not None:
                spark.createDataFrame(found, TRIALS).coalesce(1).write.mode("append").parquet(path)
            known |= {t: s for _, _, t, s in found}
        wanted = {t["trial"] for t in trials}
        scored = spark.createDataFrame([(t, s) for t, s in known.items() if t in wanted], "trial int, objective double")
        tables.append(table.join(F.broadcast(scored), "trial"))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def best_trials(trials: DataFrame) -> list[dict]:
    """Of each classifier the trial with the highest objective, the first of equals."""
    best = {}
    for row in trials.orderBy(F.desc("objective"), "trial").collect():
        best.setdefault(row["model"], row.asDict())
    return list(best.values())


def test_scores(
    model: str, features: DataFrame, splits: DataFrame, rows: DataFrame, numbers: Sequence[int], params: Mapping, max_iter: int = 1000,
) -> tuple[float, float, float, float]:
    """Mean and variance of F1, and of accuracy, over the test parts of the splits."""
    if model == "Logistic Regression":
        fits = [L.Fit.of(params, s) for s in range(len(numbers))]
        f1, accuracy = L.tested(rows, fits, L.fit_all(rows, fits, max_iter))
        return float(f1.mean()), float(f1.var()), float(accuracy.mean()), float(accuracy.var())
    if model == "Neural Network":
        nets = [N.Network.of(params, s) for s in range(len(numbers))]
        said = N.predictions(rows, numbers, nets, N.fit_all(rows, nets, max_iter))
    else:
        said = M.fit_predict_splits(features, splits, params, max_iter)
    row = S.mean_variance(S.split_scores(said)).first()
    return row["f1_mean"], row["f1_var"], row["acc_mean"], row["acc_var"]


test_scores.__test__ = False  # not a test of pytest


def tune(
    features: DataFrame, splits: DataFrame, filename: str, models: Sequence[str] = tuple(SPACE), n_trials: int = 100,
    path: str | None = None, max_iter: int = 1000,
) -> DataFrame:
    """A row of results for each classifier: its best parameters, and its scores on the test parts in percent."""
    trials = search(features, splits, filename, models, n_trials, path, max_iter=max_iter)
    rows, numbers = L.folded(features, splits)
    tables = []
    for params in best_trials(trials):
        f1, f1_var, accuracy, acc_var = test_scores(params["model"], features, splits, rows, numbers, params, max_iter)
        own = trials.where((F.col("model") == params["model"]) & (F.col("trial") == params["trial"]))
        tables.append(own.withColumns({
            "f1": F.lit(100 * f1), "accuracy": F.lit(100 * accuracy), "f1_variance": F.lit(f1_var), "accuracy_variance": F.lit(acc_var)}))
    found = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)
    return found.select(*[
        (F.col(c) if c in found.columns else F.lit(None)).cast(t).alias(c) for c, t in RESULT_COLUMNS.items()], "trial", "objective")


def evaluate_recorded(results: DataFrame, feature_sets: Mapping[str, tuple[DataFrame, DataFrame]], max_iter: int = 1000) -> DataFrame:
    """Every recorded classifier fitted and scored again: ``filename, model, status, f1_mean, f1_var, acc_mean, acc_var``.

    ``feature_sets`` maps file names to balanced features and splits. A file that it does not
    have is ``missing``, without scores. The classifiers of a file share its folds, the
    five fits of a regression or a network run together, and ``PARALLEL`` classifiers at a time.
    """
    spark = results.sparkSession
    recorded = {name: [r.asDict() for r in results.where(F.col("filename") == name).collect()] for name in feature_sets}  # a few of each file
    named = [name for name, own in recorded.items() if own]
    inherited = inheritable_thread_target(spark)

    def scored(job: tuple[str, Mapping, DataFrame, list[int]]) -> tuple:
        name, params, rows, numbers = job
        return name, params["model"], *test_scores(params["model"], *feature_sets[name], rows, numbers, params, max_iter)

    # Classifiers wait for each other's rounds, not for each other: few of them keep all tasks busy.
    with ThreadPool(max(1, min(PARALLEL, sum(map(len, recorded.values()))))) as pool:
        folds = dict(zip(named, pool.map(inherited(lambda name: L.folded(*feature_sets[name])), named)))
        jobs = [(name, params, *folds[name]) for name in named for params in recorded[name]]
        jobs.sort(key=lambda job: (LONGEST.index(job[1]["model"]) if job[1]["model"] in LONGEST else 0, job[0]))
        found = pool.map(inherited(scored), jobs, chunksize=1)
    scored = spark.createDataFrame(found, "filename string, model string, " + SCORES)
    status = F.when(F.col("f1_mean").isNull(), "missing").otherwise("scored")
    return results.select("filename", "model").join(F.broadcast(scored), ["filename", "model"], "left").select(
        "filename", "model", status.alias("status"), "f1_mean", "f1_var", "acc_mean", "acc_var")
