"""Ranks that never bring a whole group, or the whole table, into one task.

``row_number() <= k`` is limited before its shuffle by Spark itself, so plain
windows serve for top-k. Full ranks use :func:`positions`: a range-partitioned
sort spreads any group over many tasks, and the rank of a row is its place in
its partition plus the rows of the partitions before it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textlab.session import written

_LOCAL_BITS = 33  # monotonically_increasing_id: partition number above, row below


def first_rows(
    df: DataFrame, partition_by: Sequence[str], order_by: Sequence[Column | str], n: int,
    rank: str | None = None,
) -> DataFrame:
    """The first ``n`` rows of every group, with their 1-based rank if named."""
    name = rank or "_rank"
    window = Window.partitionBy(*partition_by).orderBy(*order_by)
    out = df.withColumn(name, F.row_number().over(window)).where(F.col(name) <= n)
    return out if rank else out.drop(name)


def positions(
    df: DataFrame, order_by: Sequence[Column | str], name: str = "pos",
    within: Sequence[str] = (), size: str | None = None,
) -> DataFrame:
    """Add the 0-based place of every row in a total order, or within groups.

    ``size`` names a column for the rows of the group.

    Pass slim tables with a unique key in ``order_by`` and join wide columns
    later. The sorted table is written once, which fixes the row places.
    """
    ordered = df.orderBy(*within, *order_by).withColumn("_id", F.monotonically_increasing_id())
    ordered = written(ordered, "positions")
    part = F.shiftright("_id", _LOCAL_BITS)
    ordered = ordered.withColumn("_part", part)
    # One row per sorted partition: as many as there are shuffle partitions.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        ordered.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows"))
        .select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    )
    local = F.col("_id") - F.shiftleft(F.col("_part"), _LOCAL_BITS)
    ranked = (
        ordered.join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_offset") + local)
        .drop("_id", "_part", "_offset")
    )
    if not within:
        return ranked
    sizes = [F.count(F.lit(1)).alias(size)] if size else []
    starts = ranked.groupBy(*within).agg(F.min(name).alias("_start"), *sizes)
    return (
        ranked.join(starts, list(within))
        .withColumn(name, F.col(name) - F.col("_start"))
        .drop("_start")
    )


def hash_cutoffs(keys: DataFrame, hash_col: str, quota: Column, group: str) -> DataFrame:
    """Per group, the hash of the last of the ``quota`` smallest hashes.

    ``quota`` is an expression over ``n``, the rows of a group. Rows are counted
    by the first four digits of their hash, which spreads them evenly over
    65,536 buckets; only the bucket that holds the cut is ranked.
    """
    digits = keys.select(group, hash_col, F.substring(hash_col, 1, 4).alias("_bucket"))
    counts = digits.groupBy(group, "_bucket").agg(F.count(F.lit(1)).alias("_rows"))
    upto = Window.partitionBy(group).orderBy("_bucket")
    everything = Window.partitionBy(group)
    cut = (
        counts.withColumn("_upto", F.sum("_rows").over(upto))
        .withColumn("n", F.sum("_rows").over(everything))
        .withColumn("_quota", quota)
        .where((F.col("_upto") >= F.col("_quota")) & (F.col("_upto") - F.col("_rows") < F.col("_quota")))
        .select(group, "_bucket", (F.col("_quota") - F.col("_upto") + F.col("_rows")).alias("_nth"))
    )
    # One row per group.
    inside = digits.join(F.broadcast(cut), [group, "_bucket"])
    nth = Window.partitionBy(group).orderBy(hash_col)
    return (
        inside.withColumn("_rank", F.row_number().over(nth))
        .where(F.col("_rank") == F.col("_nth"))
        .select(group, F.col(hash_col).alias("cutoff"))
    )
