"""Hyper-parameter search space and seeded random trials."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textlab.functions import hashing as H

# The ranges searched per classifier.
SPACE = {
    "Random Forest": {
        "n_estimators": ("int", 50, 200),
        "max_features": ("choice", "sqrt", "log2"),
        "criterion": ("choice", "entropy", "gini"),
        "class_weight": ("choice", None, "balanced"),
    },
    "Logistic Regression": {
        "c": ("log", 0.001, 100.0),
        "class_weight": ("choice", None, "balanced"),
        "penalty": ("choice", "l1", "l2"),
        "solver": ("choice", "liblinear", "saga"),
    },
    "Neural Network": {
        "hidden_layer_sizes": (
            "choice", "(256, 128, 128, 64, 64)", "(256, 128, 64, 64, 32)",
            "(256, 128, 64, 32, 32)", "(256, 128, 64, 32, 16)",
        ),
        "activation": ("choice", "relu", "tanh", "logistic"),
        "batch_size": ("choice", 64, 128, 256, 512, 1024),
        "learning_rate": ("choice", "constant", "invscaling", "adaptive"),
        "learning_rate_init": ("log", 0.001, 0.1),
    },
}


def _draw(rule: tuple, u: Column) -> Column:
    kind, *rest = rule
    if kind == "int":
        low, high = rest
        return (F.floor(u * F.lit(high - low + 1)) + low).cast("int")
    if kind == "log":
        low, high = (math.log(x) for x in rest)
        return F.exp(F.lit(low) + u * F.lit(high - low))
    return F.get(F.array(*[F.lit(x) for x in rest]), F.floor(u * F.lit(len(rest))).cast("int"))


def trial_table(keys: DataFrame, model: str, n: int = 100, seed: int = 42) -> DataFrame:
    """``n`` parameter sets for every row of ``keys(filename)``.

    A value depends on the seed, file, trial and parameter only.
    """
    trials = keys.select(
        "filename", F.lit(model).alias("model"),
        F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("trial"),
    )
    return trials.select("*", *[
        _draw(rule, H.uniform(seed, F.concat_ws("/", "filename", "trial", F.lit(name)))).alias(name)
        for name, rule in SPACE[model].items()
    ])
