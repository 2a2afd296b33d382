"""Session helpers: the shared scratch folder and written intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_made: list[str] = []  # paths given out by this process


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder of the session, from ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own; on a
    cluster a machine-local folder would be lost with its executor, so a
    missing setting is an error there.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if context.getCheckpointDir() is None:
        if configured:
            context.setCheckpointDir(configured)
        elif context.master.startswith("local"):
            context.setCheckpointDir(tempfile.mkdtemp(prefix="textlab-"))
        else:
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    return configured or context.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str, keep: bool = False) -> str:
    """A path under the shared folder that nothing else uses; ``keep``: beyond :func:`clear_scratch`."""
    path = f"{checkpoint_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if not keep:
        _made.append(path)
    return path


def mounted_path(spark: SparkSession, path: str) -> str | None:
    """The path of a mounted folder as the operating system names it; None for any other store."""
    name = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = name.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return files.makeQualified(name).toUri().getPath() if files.getUri().getScheme() == "file" else None


def clear_scratch(spark: SparkSession) -> None:
    """Delete the tables this application has written to the shared folder.

    For use between independent queries, once their results have been read.
    """
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in map(jvm.org.apache.hadoop.fs.Path, _made):
        path.getFileSystem(conf).delete(path, True)
    _made.clear()


def written(df: DataFrame, name: str = "table", keep: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage, survives the loss of executors, fixes values that depend
    on the physical layout (row ids) and gives the optimizer the true size, so
    that it can choose between broadcast and shuffle joins by itself.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name, keep)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
