"""Scoring of new texts."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlab.functions import names as N
from textlab.functions import text as T
from textlab.operators import models as M
from textlab.operators.filters import non_blank
from textlab.operators.scoring import split_scores
from textlab.operators.vectors import aggregate_vectors
from textlab.sources.bundles import Bundle

LABELS = {1: "Positive", 0: "Control"}


def embed_texts(texts: DataFrame, terms: Sequence[str], lookup: DataFrame, dims: int,
                how: str = "mean") -> DataFrame:
    """Masked word-vector features of texts that are not blank."""
    masked = non_blank(texts).select("doc_id", T.mask_terms(F.col("text"), terms).alias("text"))
    return aggregate_vectors(masked, lookup, how, dims)


def train_bundle(
    features: DataFrame, splits: DataFrame, params: Mapping, feature_file: str, dims: int
) -> Bundle:
    """Fit on the first split and record the scores of its test part."""
    rows = features.join(splits.where(F.col("split_no") == 1), "row_id")
    model = M.fit_pipeline(rows.where(F.col("part") == "train"), params)
    scores = split_scores(M.predict_rows(model, rows.where(F.col("part") == "test"))).first()
    return Bundle(model, params["model"], feature_file, dims, 1, scores["f1"], scores["accuracy"])


def predict(
    texts: DataFrame, bundle: Bundle, embed: Callable[[DataFrame], DataFrame],
    labels: Mapping[int, str] = LABELS,
) -> DataFrame:
    """``doc_id, prediction, probability, label_text, confidence`` of every text.

    ``embed`` maps ``doc_id, text`` to ``doc_id, vector``.
    """
    scored = M.predict_rows(bundle.classifier, embed(texts))
    return scored.select(
        "doc_id", "prediction", "probability",
        N.format_prediction(F.col("prediction"), labels).alias("label_text"),
        N.format_percent(F.col("probability") * 100.0, 1).alias("confidence"),
    )
