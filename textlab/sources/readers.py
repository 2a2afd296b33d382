"""Readers of corpora, term lists, features and results."""

from __future__ import annotations

import os
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textlab.operators.lexicon import clean_terms
from textlab.operators.report import RESULT_COLUMNS
from textlab.session import mounted_path
from textlab.sources.writers import NO_NAME

READ_BYTES = 1 << 22  # of texts that a task hands on at once


def read_corpus(
    spark: SparkSession, path: str, label: int | None = None, variant: str | None = None
) -> DataFrame:
    """The ``.txt`` files of a folder, one row each; sub-folders are skipped.

    The file name without its ending is the document name. Prefer Parquet for
    large corpora: a file per document costs a listing entry and a task share.
    """
    files = spark.read.text(path, wholetext=True, pathGlobFilter="*.txt")
    out = files.select(
        F.regexp_replace(F.col("_metadata.file_name"), r"\.txt$", "").alias("name"),
        F.col("value").alias("text"),
    )
    if label is not None:
        out = out.withColumn("label", F.lit(label))
    return out if variant is None else out.withColumn("variant", F.lit(variant))


def read_named_texts(spark: SparkSession, path: str) -> DataFrame:
    """``name, text`` of a folder by :func:`~textlab.sources.writers.write_named_texts`.

    In a mounted folder a task lists and reads the files of one of its folders, so neither the
    driver nor Spark's plan holds the list of files. In other stores Spark lists and packs them by their
    size and ``spark.sql.files.openCostInBytes``.
    """
    root = mounted_path(spark, path)
    if root is None:
        files = spark.read.schema("value string, name string").text(path, wholetext=True, pathGlobFilter="*.txt")
        return files.select("name", F.substring("value", F.lit(1), F.length("value") - 1).alias("text"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                names, texts, size = [], [], 0
                with os.scandir(f"{root}/{folder}") as files:
                    for file in files:
                        with open(file.path, "rb") as text:
                            texts.append(text.read()[:-1])
                        names.append(unquote(file.name.removesuffix(".txt")))
                        size += len(texts[-1])
                        if size >= READ_BYTES:
                            yield _named(names, texts)
                            names, texts, size = [], [], 0
                yield _named(names, texts)

    folders = spark.read.schema("folder string").parquet(f"{path}/folders")
    # A row for each thousand files, dealt evenly.
    return folders.coalesce(1).repartition(max(1, folders.count())).mapInArrow(read, "name string, text string")


def _named(names: list[str], texts: list[bytes]) -> pa.RecordBatch:
    names = [None if n == NO_NAME else n for n in names]
    return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(texts, pa.binary()).cast(pa.string())], names=["name", "text"])


def read_documents(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    """Documents in Parquet, in the splits of the scan or in so many ``partitions``.

    Ask for partitions where a few large files or row groups would keep most
    cores idle; that moves every text once.
    """
    documents = spark.read.parquet(path)
    return documents if partitions is None else documents.repartition(partitions)


def read_terms(spark: SparkSession, path: str, lower: bool = True) -> DataFrame:
    """A term list, one phrase per line."""
    return clean_terms(spark.read.text(path), lower=lower)


def feature_schema(dims: int) -> str:
    return ", ".join([*(f"d{i} DOUBLE" for i in range(dims)), "label INT"])


def read_features(spark: SparkSession, path: str, dims: int, header: bool = True) -> DataFrame:
    """A feature CSV: all columns but the last are the vector, the last the label."""
    table = spark.read.csv(path, header=header, schema=feature_schema(dims), enforceSchema=True)
    return table.select(F.array(*table.columns[:-1]).alias("vector"), "label")


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """A results CSV; blanks are nulls."""
    schema = ", ".join(f"{c} {t}" for c, t in RESULT_COLUMNS.items())
    return spark.read.csv(path, header=True, schema=schema, escape='"')
