"""Writers of corpora, features, results and evaluations."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlab.operators.report import as_results
from textlab.session import mounted_path

FOLDER_FILES = 1_000  # texts in a folder, which one task reads
NO_NAME = "__HIVE_DEFAULT_PARTITION__"  # stands for null and the empty name, as in Spark's folders


def write_corpus(docs: DataFrame, path: str) -> None:
    """Documents by class and variant."""
    docs.write.partitionBy("label", "variant").parquet(path)


def write_features(features: DataFrame, path: str) -> None:
    """Vectors and labels by feature set and variant."""
    features.write.partitionBy("feature_set", "variant").parquet(path)


def write_feature_csv(features: DataFrame, path: str, dims: int) -> None:
    """A feature CSV with a header, the label last."""
    columns = [F.get("vector", F.lit(i)).alias(f"d{i}") for i in range(dims)]
    features.select(*columns, "label").write.csv(path, header=True)


def write_results(results: DataFrame, path: str) -> None:
    """The fixed result columns; missing parameters are blank."""
    as_results(results).write.csv(path, header=True, nullValue="", escape='"')


def append_new(results: DataFrame, path: str, key: str = "filename") -> None:
    """Append the rows whose key is not stored yet, so a run can be resumed.

    A path that doesn't exist yet holds no rows: the first run stores all.
    """
    try:
        stored = results.sparkSession.read.parquet(path).select(key).distinct()
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        new = results
    else:
        new = results.join(stored, key, "left_anti").select(*results.columns)
    new.write.mode("append").parquet(path)


def write_evaluation(table: DataFrame, path: str) -> None:
    """An evaluation or comparison table as CSV."""
    table.write.csv(path, header=True, escape='"')


def write_error_report(report: DataFrame, path: str) -> None:
    """Report sections as text files, in order, by class and variant."""
    (
        report.repartitionByRange("label", "variant", "seq")
        .sortWithinPartitions("label", "variant", "seq")
        # The writer ends every row with a line end, as the section does.
        .select("label", "variant", F.expr("left(section, length(section) - 1)").alias("section"))
        .write.partitionBy("label", "variant").option("lineSep", "\n").text(path)
    )


def write_named_texts(docs: DataFrame, path: str) -> None:
    """A ``.txt`` file for each row of ``docs(name, text)``, called by its name; names are unique.

    The text is followed by one line feed. Tasks of a mounted folder put their files into
    folders of their own, ``FOLDER_FILES`` in each; the table ``folders`` names those
    of the attempts that count, so what a failed one leaves is never read. In other stores Spark
    writes a folder for each name. A path that exists is an error.
    """
    named = docs.select("name", "text")
    root = mounted_path(docs.sparkSession, path)
    if root is None:
        return named.write.partitionBy("name").text(path)
    os.makedirs(root)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folders, placed = [], {}
        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                if name not in placed:
                    if len(placed) % FOLDER_FILES == 0:
                        folders.append(f"texts-{uuid.uuid4().hex}")
                        os.mkdir(f"{root}/{folders[-1]}")
                    placed[name] = f"{root}/{folders[-1]}/{quote(name or NO_NAME, safe='')}.txt"
                with open(placed[name], "ab") as out:  # a name that comes again in a task goes on in its file
                    out.write((text or b"") + b"\n")
        yield pa.RecordBatch.from_arrays([pa.array(folders, pa.string())], names=["folder"])

    named.mapInArrow(put, "folder string").write.parquet(f"{path}/folders")
