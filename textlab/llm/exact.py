"""Exact deduplication by content-defined chunk recipes, in SQL functions only.

A text without its white space is cut where its content says so, so equal texts
give equal chunks. Every distinct chunk moves once, to verify that its digest
stands for one content only; after that a document is an ordered list of chunk
identifiers (its recipe), and only recipes are grouped and joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textlab.session import written

WHITE_SPACE = r"[\x20\x09-\x0D]+"
#: A chunk has 256 to 4096 characters and ends after two of these letters in a row, or where the text ends.
CHUNK = r"(?s).{256,4094}?[aehinrst][adeilnou]|.{1,4096}"


def normalised(text: Column) -> Column:
    """The text without white space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE_SPACE, "")


def chunks(text: Column) -> Column:
    """The content-defined chunks of a normalised text, in order; together they are the text."""
    return F.regexp_extract_all(text, F.lit(CHUNK), F.lit(0))


def chunk_id(chunk: Column) -> Column:
    return F.unhex(F.sha2(chunk, 256))


def ambiguous_ids(docs: DataFrame) -> DataFrame:
    """Identifiers that stand for more than one chunk content: ``chunk_id``.

    Equal chunks collapse in the task that cuts them, so a chunk of millions of
    documents arrives once per task.
    """
    return (
        docs.select(F.explode(F.array_distinct(chunks(normalised(F.col("text"))))).alias("chunk"))
        .groupBy(chunk_id(F.col("chunk")).alias("chunk_id"))
        .agg(F.min("chunk").alias("_least"), F.max("chunk").alias("_most"))
        .where(F.col("_least") != F.col("_most"))
        .select("chunk_id")
    )


def recipes(docs: DataFrame, ambiguous: list[bytes]) -> DataFrame:
    """``doc_id, n_chars, text_sha256, recipe``: one row per document.

    The recipe is the list of chunk identifiers. A chunk whose identifier is
    ambiguous is named by its whole content instead, so that recipes are equal
    exactly when the texts are.
    """
    text = normalised(F.col("text"))

    def name(chunk: Column) -> Column:
        if not ambiguous:
            return chunk_id(chunk)
        return F.when(chunk_id(chunk).isin(ambiguous), F.encode(chunk, "UTF-8")).otherwise(chunk_id(chunk))

    return docs.select(
        "doc_id", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"),
        F.sha2(text, 256).alias("text_sha256"), F.transform(chunks(text), name).alias("recipe"),
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Group texts that are equal but for white space; one row per row of ``docs``.

    Returns ``doc_id, keep_id, group_size, kept, text_sha256``. The longest
    original text of a group stays, of equally long ones the smallest id.

    Null and empty texts, and texts of white space only, are equal to each
    other. A null id is kept only if no other row of its group is as long. Rows
    that repeat an id count as rows of the group and share its decision. An
    empty table gives an empty result; other columns are not read.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    # Two contents of one SHA-256 digest: none are known, so this list stays empty at any size.
    ambiguous = [bytes(r.chunk_id) for r in ambiguous_ids(docs).collect()]
    listed = written(recipes(docs, ambiguous), "recipes")
    # The longest first, then the smallest id, null last: with all bits turned, ids fall as they grew.
    best = F.max(F.struct("n_chars", F.bitwise_not("doc_id").alias("turned"))).alias("best")
    groups = written(
        listed.groupBy("recipe").agg(best, F.count(F.lit(1)).alias("group_size"))
        .select("recipe", F.bitwise_not("best.turned").alias("keep_id"), "group_size"), "groups",
    )
    # Groups are unique, so adaptive execution can split a group that holds a large share of all rows.
    return listed.join(groups, "recipe").select(
        "doc_id", "keep_id", "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256",
    )
