"""Exploding computed arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def exploded(df: DataFrame, keep: list[str], items: Column, name: str, pos: str | None = None) -> DataFrame:
    """One row per array element: ``keep`` columns, ``pos`` if named, ``name``.

    Before an inner explode the optimizer filters on ``size(items) > 0``, and so
    computes an array such as the tokens of a text once more, in the scan. The
    outer explode with a null test afterwards computes it once.
    """
    if pos is None:
        out = df.select(*keep, F.explode_outer(items).alias(name))
    else:
        out = df.select(*keep, F.posexplode_outer(items).alias(pos, name))
    return out.where(F.col(name).isNotNull())
