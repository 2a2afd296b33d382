"""Written tables whose rows went through Python in small batches."""

from __future__ import annotations

from pyspark.sql import DataFrame

from textlab.session import written

SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH = "8m"


def materialised(df: DataFrame, name: str = "table") -> DataFrame:
    """:func:`~textlab.session.written`, with at most 8 MB (or a row) sent to a Python worker at a time.

    Texts differ in length by orders of magnitude, so a number of rows bounds no
    memory. The session's own setting is put back afterwards.
    """
    conf = df.sparkSession.conf
    before = conf.get(SETTING, None)
    conf.set(SETTING, BATCH)
    try:
        return written(df, name)
    finally:
        if before is None:
            conf.unset(SETTING)
        else:
            conf.set(SETTING, before)
