"""Tables that several writers append to, each append whole or not at all.

An append writes its rows to a folder of its own and then publishes that folder
by an entry of a log: the entry is written under a hidden name and renamed to the
next number, which fails where another writer has taken that number. Readers see
the folders of the log's entries only, so a failed append leaves nothing to read.
The guarantee is that of the file system's rename without overwriting, or link
(HDFS and mounted folders have it; an object store needs a connector with
conditional writes).
"""

from __future__ import annotations

import json
import os
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def log_entries(spark: SparkSession, path: str) -> list[dict]:
    """``number, run, folder, schema`` of every published append, in order; one small row per append."""
    try:
        lines = spark.read.text(f"{path}/log", wholetext=True)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return []
    rows = lines.select(F.col("_metadata.file_name").cast("int").alias("number"), "value").collect()
    return [{"number": n} | json.loads(value) for n, value in sorted(map(tuple, rows))]


def _publish(spark: SparkSession, path: str, number: int, entry: dict) -> bool:
    """Whether this writer's entry got ``number``."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    name = jvm.org.apache.hadoop.fs.Path
    hidden, final = name(f"{path}/log/.{uuid.uuid4().hex}"), name(f"{path}/log/{number:08d}")
    files = final.getFileSystem(conf)
    content = json.dumps(entry).encode()
    if files.getUri().getScheme() == "file":
        return _publish_locally(hidden.toUri().getPath(), final.toUri().getPath(), content)
    out = files.create(hidden, False)
    try:
        out.write(bytearray(content))
    finally:
        out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), conf)
    no_options = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        context.rename(files.makeQualified(hidden), files.makeQualified(final), no_options)
        return True
    except Py4JJavaError as failed:
        if not failed.java_exception.getClass().getName().endswith("FileAlreadyExistsException"):
            raise
        return False
    finally:
        files.delete(hidden, False)


def _publish_locally(hidden: str, final: str, content: bytes) -> bool:
    """The same in a mounted folder, by a link: a rename there may replace what another writer has put."""
    os.makedirs(os.path.dirname(final), exist_ok=True)
    with open(hidden, "wb") as out:
        out.write(content)
    try:
        os.link(hidden, final)
        return True
    except FileExistsError:
        return False
    finally:
        os.unlink(hidden)


def read_published(spark: SparkSession, path: str, entries: list[dict] | None = None) -> DataFrame | None:
    """The rows of all published appends; None before the first."""
    entries = log_entries(spark, path) if entries is None else entries
    if not entries:
        return None
    schema = StructType.fromJson(json.loads(entries[0]["schema"]))
    return spark.read.schema(schema).parquet(*[f"{path}/data/{e['folder']}" for e in entries])


def append_published(rows: DataFrame, path: str, key: str = "filename", run: str | None = None) -> int:
    """Append the rows whose key is not published yet; return the number of the log's entry.

    Any number of writers may append at once: whoever comes second drops the
    keys that the first has published and writes again, so a key is never
    stored by two appends. ``run`` names the append: once published, the same
    name appends nothing more, whatever its rows are, so a job that failed after
    its last step can be started again. All appends have the columns of the
    first. A null key is a key like others. Rows of one append may share a key.
    """
    spark = rows.sparkSession
    run = run or uuid.uuid4().hex
    while True:
        entries = log_entries(spark, path)
        for entry in entries:
            if entry["run"] == run:
                return entry["number"]
        stored, new = read_published(spark, path, entries), rows
        if stored is not None:
            known = stored.select(F.col(key).alias("_stored")).distinct()
            new = rows.join(known, rows[key].eqNullSafe(known["_stored"]), "left_anti").select(*stored.columns)
        folder = f"{run}-{uuid.uuid4().hex}"
        new.write.parquet(f"{path}/data/{folder}")
        number = entries[-1]["number"] + 1 if entries else 0
        schema = entries[0]["schema"] if entries else rows.schema.json()
        if _publish(spark, path, number, {"run": run, "folder": folder, "schema": schema}):
            return number
