"""Labelled corpora: unions, counts and length statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlab.functions import text as T


def union_labelled(positive: DataFrame, control: DataFrame) -> DataFrame:
    """Positive rows with label 1 and control rows with label 0, all kept."""
    return positive.withColumn("label", F.lit(1)).unionByName(
        control.withColumn("label", F.lit(0))
    )


def class_counts(df: DataFrame) -> DataFrame:
    """Rows per class, largest first."""
    return df.groupBy("label").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "label")


def mean_words_by_class(df: DataFrame, text: str = "text") -> DataFrame:
    words = F.avg(T.word_count(F.col(text)))
    return df.groupBy("label").agg(F.round(words, 2).alias("mean_words"))


def median(df: DataFrame, column: str, name: str) -> DataFrame:
    """Exact median of an integer column.

    Equal values are counted first, so the final aggregate holds one entry per
    distinct value and not one per row.
    """
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("_n"))
    return counts.agg(F.percentile(F.col(column), 0.5, F.col("_n")).alias(name))


def corpus_stats(posts_per_author: DataFrame, docs: DataFrame) -> DataFrame:
    """Sum, mean, median of posts per author; mean, median of characters."""
    chars = docs.select(F.length("text").alias("chars"))
    counts = posts_per_author.agg(
        F.sum("n_posts").alias("n_posts"), F.avg("n_posts").alias("mean_posts")
    )
    # Every table below has exactly one row.
    return counts.select(
        "n_posts",
        F.round("mean_posts", 6).alias("mean_posts"),
        median(posts_per_author, "n_posts", "m").scalar().alias("median_posts"),
        F.round(chars.agg(F.avg("chars")).scalar(), 6).alias("mean_chars"),
        median(chars, "chars", "m").scalar().alias("median_chars"),
    )
