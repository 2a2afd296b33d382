"""Masking and scoring over a stream of files.

The per-row steps are those of the batch plan. Word-vector aggregates are per
document, so they run inside each micro-batch; a document is one row and never
spans two of them. A document that arrives twice is known from the state store.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def stream_documents(spark: SparkSession, path: str, schema, max_files: int = 1000) -> DataFrame:
    """New Parquet files under a path or glob."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def first_arrivals(source: DataFrame, key: str = "doc_id", time: str | None = None, late: str = "1 day") -> DataFrame:
    """Each key once, over all micro-batches and restarts.

    The state holds every key seen; with an event ``time`` only those of the last
    ``late``, so that it stays bounded in a stream that never ends, and a
    key that comes again later than that is new. Null keys count as one.
    """
    if time is None:
        return source.dropDuplicates([key])
    return source.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def mask_and_score_stream(
    source: DataFrame, score: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str
) -> StreamingQuery:
    """Score all files that have arrived, then stop.

    ``score`` is the batch plan, such as ``predict`` with its bundle. Each
    micro-batch goes to a folder of its own, which a retry overwrites, so a
    restart leaves neither gaps nor copies.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        score(batch).write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")

    return (
        source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
