"""Registration of queries and of the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def cte(name: str, body: str, *needs: str) -> None:
    """Name a SQL building block and the blocks it reads."""
    CTES[name] = (needs, body)


def sql(body: str, *needs: str) -> str:
    """A statement with the building blocks it needs, dependencies first."""
    done: list[str] = []

    def visit(name: str) -> None:
        if name not in done:
            for other in CTES[name][0]:
                visit(other)
            done.append(name)

    for name in needs:
        visit(name)
    if not done:
        return body
    blocks = ",\n".join(f"{n} AS ({CTES[n][1]})" for n in done)
    return f"WITH {blocks}\n{body}"


def query(name: str, oracle: str | None = None, needs: tuple[str, ...] = ()):
    """Register a function ``(spark, sf_dir) -> DataFrame`` under a key."""

    def register(function):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = function
        if oracle is not None:
            ORACLES[name] = sql(oracle, *needs)
        return function

    return register


def long_form(df: DataFrame, *keys: str, vector: str = "vector") -> DataFrame:
    """One row per vector element: ``keys, dim, value``."""
    return df.select(*keys, F.posexplode(vector).alias("dim", "value")).withColumn(
        "value", F.round("value", 6)
    )
