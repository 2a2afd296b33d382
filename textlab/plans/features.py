"""From a labelled corpus to features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlab.functions import text as T
from textlab.operators.ranking import first_rows
from textlab.operators.tfidf import tfidf
from textlab.operators.vectors import aggregate_vectors


def with_variants(corpus: DataFrame, terms: Sequence[str], order: str = "shortest") -> DataFrame:
    """Every document twice: ``variant`` original and masked."""
    both = F.explode(F.array(
        F.struct(F.lit("original").alias("variant"), F.col("text").alias("text")),
        F.struct(F.lit("masked").alias("variant"),
                 T.mask_terms(F.col("text"), terms, order).alias("text")),
    )).alias("v")
    others = [c for c in corpus.columns if c != "text"]
    return corpus.select(*others, both).select(*others, "v.variant", "v.text")


def tfidf_tokens(docs: DataFrame, stop_words: Sequence[str]) -> DataFrame:
    """Documents with the tokens the TF-IDF features are made of."""
    tokens = T.vectorizer_tokens(T.alnum_tokens(F.col("text"), stop_words))
    return docs.withColumn("tokens", tokens).drop("text")


def masked_tfidf(
    corpus: DataFrame, terms: Sequence[str], stop_words: Sequence[str], min_df: int = 3
) -> DataFrame:
    """TF-IDF weights of the masked corpus."""
    masked = corpus.withColumn("text", T.mask_terms(F.col("text"), terms))
    return tfidf(tfidf_tokens(masked, stop_words), min_df)


def top_terms(weights: DataFrame, labels: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` terms of highest total weight per class."""
    totals = weights.join(labels, "doc_id").groupBy("label", "term").agg(
        F.sum("weight").alias("total"), F.count(F.lit(1)).alias("n_docs")
    )
    rounded = totals.withColumn("total", F.round("total", 6))
    return first_rows(rounded, ["label"], [F.desc("total"), "term"], k, "rank")


def variant_features(
    corpus: DataFrame, terms: Sequence[str], lookup: DataFrame, dims: int, how: str = "mean"
) -> DataFrame:
    """Word-vector features of both variants: ``doc_id, variant, vector, label``.

    Both variants go through one aggregate, keyed by document and variant.
    """
    docs = with_variants(corpus, terms)
    key = F.struct("doc_id", "variant", "label").alias("doc_id")
    vectors = aggregate_vectors(docs.select(key, "text"), lookup, how, dims)
    return vectors.select("doc_id.doc_id", "doc_id.variant", "vector", "doc_id.label")
