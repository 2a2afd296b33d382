"""Hash-based keys and reproducible uniforms.

Sampling never uses ``rand()``: a value depends on a seed and a key only, so a
result does not change with partitioning, retries or lost executors.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_author(name: Column) -> Column:
    """SHA-1 hex digest of a UTF-8 string."""
    return F.sha1(name)


def text_digest(text: Column) -> Column:
    """SHA-256 hex digest of a text, a fixed-size join key."""
    return F.sha2(text, 256)


def order_key(seed: Column | int | str, key: Column) -> Column:
    """A pseudo-random hex key; sorting by it shuffles rows reproducibly."""
    seed = seed if isinstance(seed, Column) else F.lit(str(seed))
    return F.md5(F.concat(seed.cast("string"), F.lit(":"), key.cast("string")))


def uniform(seed: Column | int | str, key: Column) -> Column:
    """A reproducible number in [0, 1) with 32 random bits."""
    head = F.substring(order_key(seed, key), 1, 8)
    return F.conv(head, 16, 10).cast("double") / F.lit(4294967296.0)
