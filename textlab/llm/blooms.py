"""Blocked Bloom filters of a fixed size, as small tables of 64-bit blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Blocks of 64 bits: 1 MB whatever is listed, so a filter may be broadcast. Longer lists let
#: more rows through to the join that follows; its result is the same.
BLOCKS = 1 << 17
BITS_PER_KEY = 6


def block_of(*key: Column | str) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(BLOCKS)).cast("int")


def mask_of(*key: Column | str) -> Column:
    """The bits of a key within its block, from a second hash."""
    other = F.xxhash64(F.lit("bits"), *key)
    mask = F.lit(0).cast("long")
    for i in range(BITS_PER_KEY):
        position = F.pmod(F.shiftright(other, 9 * i), F.lit(64)).cast("int")
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), position))
    return mask


def bloom(listed: DataFrame, *key: Column | str) -> DataFrame:
    """``block, word``: the filter of the listed keys, at most ``BLOCKS`` rows."""
    return listed.groupBy(block_of(*key).alias("block")).agg(F.bit_or(mask_of(*key)).alias("word"))


def passing(rows: DataFrame, blocks: DataFrame, *key: Column | str) -> DataFrame:
    """The rows whose key may be listed."""
    hit = rows.withColumn("block", block_of(*key)).join(F.broadcast(blocks), "block")
    return hit.where(F.col("word").bitwiseAND(mask_of(*key)) == mask_of(*key)).drop("block", "word")


def might_contain(rows: DataFrame, listed: DataFrame, key: str) -> DataFrame:
    """A cheap first cut of a join: the rows whose ``key`` may be in ``listed``."""
    return passing(rows, bloom(listed, key), key)
