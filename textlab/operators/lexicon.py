"""Term lists and document-term pairs."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlab.functions import text as T
from textlab.operators.explode import exploded


def clean_terms(lines: DataFrame, column: str = "value", lower: bool = True) -> DataFrame:
    """Distinct trimmed terms of a table of lines; blank lines are dropped."""
    term = F.regexp_replace(column, rf"^{T.WHITESPACE}|{T.WHITESPACE}$", "")
    return (
        lines.select((F.lower(term) if lower else term).alias("term"))
        .where(F.col("term") != "").distinct()
    )


def union_terms(*lists: DataFrame) -> DataFrame:
    """Distinct union of term lists."""
    return reduce(lambda a, b: a.unionByName(b), lists).distinct()


def term_pairs(docs: DataFrame, terms: Sequence[str], text: str = "text") -> DataFrame:
    """Document-term pairs with the number of occurrences, one pass per document.

    The terms are literals, so there is no join and only real pairs leave a row.
    """
    content = F.lower(text)
    found = F.array(*[
        F.struct(F.lit(t).alias("term"), T.count_occurrences(content, t).alias("n"))
        for t in terms if t
    ])
    pairs = exploded(docs, ["doc_id"], F.filter(found, lambda p: p["n"] > 0), "pair")
    return pairs.select("doc_id", "pair.term", "pair.n")
