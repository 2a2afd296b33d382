"""Misclassified documents and their reports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textlab.functions import names as N
from textlab.operators.filters import original_rows
from textlab.operators.ranking import positions

RULE = "-" * 38 + "\n"  # fixed value: the line under every document


def misclassified(predictions: DataFrame) -> DataFrame:
    """Distinct original rows ``label, doc_id`` predicted wrong in any split."""
    wrong = predictions.where(F.col("prediction") != F.col("label"))
    if "is_synthetic" in predictions.columns:
        wrong = original_rows(wrong)
    return wrong.select("label", F.col("row_id").alias("doc_id")).distinct()


def error_documents(
    errors: DataFrame, corpus: DataFrame, variants: Callable[[DataFrame], DataFrame] | None = None
) -> DataFrame:
    """Every misclassified document in each of its variants, text unchanged.

    ``corpus`` has a ``variant`` per row, or ``variants`` makes them of the
    misclassified documents alone.
    """
    if variants is not None:
        wrong = errors.select("doc_id").distinct()
        corpus = variants(corpus.join(wrong, "doc_id", "left_semi"))
    return errors.join(corpus.select("doc_id", "variant", "text"), "doc_id")


def error_counts(errors: DataFrame) -> DataFrame:
    return errors.groupBy("label").agg(F.count(F.lit(1)).alias("n_errors"))


def error_report(documents: DataFrame) -> DataFrame:
    """The concatenated report of every class and variant, one row per document.

    ``documents`` is ``label, variant, name, text``. Sections follow the number
    in the document name; ``seq`` is the place of a section and ``start`` the
    character at which it begins, so the sections written in order are the
    report. A class is never gathered into one string.
    """
    keys = ["label", "variant"]
    section = F.concat("name", F.lit(":\n"), "text", F.lit("\n\n" + RULE))
    rows = documents.select(
        *keys, "name", N.document_number(F.col("name")).alias("n"), section.alias("section")
    ).withColumn("length", F.length("section"))
    placed = positions(
        rows.select(*keys, "name", "n", "length"), ["n", "name"], "seq", within=keys
    )
    # Offsets of blocks of sections first, then inside the blocks: no window
    # holds more than the larger of a block and the number of blocks.
    blocks = placed.withColumn("block", F.floor(F.col("seq") / F.lit(10_000)))
    sizes = blocks.groupBy(*keys, "block").agg(F.sum("length").alias("_size"))
    earlier = Window.partitionBy(*keys).orderBy("block").rowsBetween(
        Window.unboundedPreceding, -1
    )
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_size").over(earlier), F.lit(0)))
    inside = Window.partitionBy(*keys, "block").orderBy("seq").rowsBetween(
        Window.unboundedPreceding, -1
    )
    starts = blocks.join(sizes.drop("_size"), [*keys, "block"]).withColumn(
        "start", F.col("_before") + F.coalesce(F.sum("length").over(inside), F.lit(0))
    )
    return rows.drop("length").join(
        starts.select(*keys, "name", "seq", "start"), [*keys, "name"]
    ).select(*keys, "seq", "start", "section")
