"""Classifiers on Spark ML, from recorded parameters.

Networks are trained by mini-batches (``operators.networks``), with the recorded
activation, rate and schedule. Only a saved classifier is Spark's multilayer
perceptron, which has sigmoid units and l-bfgs. Forests that are only scored grow in
the tasks that hold their rows (``operators.forests``), saved ones and those of a search
are Spark's. Trees stop at depth 30, Spark's limit.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.ml.classification import (
    LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier,
)
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlab.operators import forests, many_fits, networks
from textlab.operators.ranking import positions
from textlab.operators.sampling import class_weights, stratified_folds
from textlab.operators.vectors import vector_dims
from textlab.session import written

SEED = 42
TOLERANCE = 1e-4  # a fit stops when an iteration gains less, at ``max_iter`` at the latest
PARALLEL_FITS = 4
PART_ROWS = 10_000  # training rows of a task at least


def build_classifier(params: Mapping, n_rows: int, dims: int, max_iter: int = 1000):
    """An unfitted estimator from one row of recorded parameters.

    Its inputs are ``features``, ``label`` and, for balanced class weights,
    ``weight``.
    """
    model = params["model"]
    balanced = params.get("class_weight") == "balanced"
    if model == "Random Forest":
        estimator = RandomForestClassifier(
            numTrees=int(params.get("n_estimators") or 100), maxDepth=30, seed=SEED,
            featureSubsetStrategy=params.get("max_features") or "sqrt",
            impurity=params.get("criterion") or "gini", maxMemoryInMB=1024, cacheNodeIds=True,
        )
    elif model == "Logistic Regression":
        estimator = LogisticRegression(
            regParam=1.0 / (float(params.get("c") or 1.0) * n_rows), maxIter=max_iter,
            elasticNetParam=1.0 if params.get("penalty") == "l1" else 0.0, standardization=False, tol=TOLERANCE,
        )
    elif model == "Neural Network":
        hidden = [int(x) for x in re.findall(r"\d+", str(params["hidden_layer_sizes"]))]
        return MultilayerPerceptronClassifier(
            layers=[dims, *hidden, 2], blockSize=int(params.get("batch_size") or 128),
            maxIter=max_iter, seed=SEED, tol=TOLERANCE,
        )
    else:
        raise ValueError(f"unknown model: {model}")
    return estimator.setWeightCol("weight") if balanced else estimator


def as_ml(features: DataFrame) -> DataFrame:
    """Add the ``features`` vector column from the ``vector`` array, if absent."""
    if "features" in features.columns:
        return features
    return features.withColumn("features", array_to_vector("vector"))


def fit(train: DataFrame, params: Mapping, dims: int | None = None, max_iter: int = 1000):
    """Fit one classifier; class weights come from the training rows."""
    train = as_ml(class_weights(train)).select("features", "label", "weight")
    train.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        n_rows = train.count()
        dims = dims or train.first()["features"].size
        # A fit runs many short jobs: few rows go to few tasks.
        packed = train.coalesce(-(-max(1, n_rows) // PART_ROWS))
        return build_classifier(params, n_rows, dims, max_iter).fit(packed)
    finally:
        train.unpersist()


def predict_rows(model, rows: DataFrame) -> DataFrame:
    """Rows with ``prediction`` and the ``probability`` of that class."""
    out = model.transform(as_ml(rows))
    of_class = F.get(vector_to_array("probability"), F.col("prediction").cast("int"))
    return out.withColumn("probability", of_class).withColumn(
        "prediction", F.col("prediction").cast("int")
    ).drop("features", "rawPrediction")


def fit_predict_splits(
    features: DataFrame, splits: DataFrame, params: Mapping, max_iter: int = 1000,
    parallelism: int = PARALLEL_FITS,
) -> DataFrame:
    """``row_id, split_no, label, prediction``: one fit per split, some at a time; networks all together."""
    if params["model"] == "Neural Network":
        return _network_predictions(features, splits, params, max_iter)
    forest = params["model"] == "Random Forest"
    rows = (features if forest else as_ml(features)).join(splits, "row_id").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        numbers = sorted(r["split_no"] for r in splits.select("split_no").distinct().collect())

        def run(number: int) -> DataFrame:
            split = rows.where(F.col("split_no") == number)
            train, test = (split.where(F.col("part") == part) for part in ("train", "test"))
            kept = [c for c in ("row_id", "split_no", "label", "is_synthetic") if c in test.columns]
            if forest:
                return forests.predictions(train, test, params, kept)
            model = fit(train, params, max_iter=max_iter)
            return written(predict_rows(model, test).select(*kept, "prediction"), "predictions")

        with ThreadPool(parallelism) as pool:
            parts = pool.map(inheritable_thread_target(features.sparkSession)(run), numbers)
        return reduce(lambda a, b: a.unionByName(b), parts)
    finally:
        rows.unpersist()


def _network_predictions(features: DataFrame, splits: DataFrame, params: Mapping, max_epochs: int) -> DataFrame:
    rows, numbers = many_fits.folded(features, splits)
    nets = [networks.Network.of(params, place) for place in range(len(numbers))]
    said = networks.predictions(rows, numbers, nets, networks.fit_all(rows, nets, max_epochs))
    said = written(said.select("row_id", "split_no", "label", "prediction"), "predictions")
    if "is_synthetic" not in features.columns:
        return said
    return said.join(features.select("row_id", "is_synthetic"), "row_id").select(
        "row_id", "split_no", "label", "is_synthetic", "prediction")


def cv_objective(
    features: DataFrame, splits: DataFrame, estimator_of: Callable, parallelism: int = 4
) -> float:
    """Mean over splits of the mean 5-fold F1 of an estimator on the training part.

    ``estimator_of(n_rows, dims)`` returns the unfitted estimator.
    """
    dims = vector_dims(features)
    f1 = MulticlassClassificationEvaluator(metricName="fMeasureByLabel", metricLabel=1.0)
    train = splits.where(F.col("part") == "train")
    folds = written(stratified_folds(
        train.join(features.select("row_id", "label"), "row_id"), within=("split_no",)
    ).drop("label"), "folds")
    scores = []
    for number in sorted(r["split_no"] for r in folds.select("split_no").distinct().collect()):
        rows = as_ml(class_weights(
            features.join(folds.where(F.col("split_no") == number), "row_id")
        )).select("features", "label", "weight", "fold").persist(StorageLevel.MEMORY_AND_DISK)
        try:
            search = CrossValidator(
                estimator=estimator_of(rows.count(), dims), evaluator=f1, foldCol="fold",
                estimatorParamMaps=ParamGridBuilder().build(), numFolds=5,
                parallelism=parallelism,
            )
            scores.append(search.fit(rows).avgMetrics[0])
        finally:
            rows.unpersist()
    return sum(scores) / len(scores)


@F.udf(VectorUDT())
def _sparse(size, entries):
    return Vectors.sparse(size, [(e["term_id"], e["weight"]) for e in entries or []])


def sparse_features(weights: DataFrame, docs: DataFrame) -> DataFrame:
    """``docs`` with ``features``: their rows of a TF-IDF table as sparse vectors.

    Terms are numbered in alphabetical order by a distributed sort; no
    vocabulary is held in one place. Documents without a term get a zero vector.
    """
    terms = positions(weights.select("term").distinct(), ["term"], "term_id")
    terms = terms.withColumn("term_id", F.col("term_id").cast("int"))
    size = terms.count()
    rows = weights.join(terms, "term").groupBy("doc_id").agg(
        F.sort_array(F.collect_list(F.struct("term_id", "weight"))).alias("entries")
    )
    joined = docs.join(rows, "doc_id", "left")
    return joined.withColumn("features", _sparse(F.lit(size), "entries")).drop("entries")


def pipeline_of(model) -> PipelineModel:
    """A fitted classifier as a pipeline, the form in which bundles store it."""
    return model if isinstance(model, PipelineModel) else PipelineModel(stages=[model])


def fit_pipeline(train: DataFrame, params: Mapping, max_iter: int = 1000) -> PipelineModel:
    return pipeline_of(fit(train, params, max_iter=max_iter))
