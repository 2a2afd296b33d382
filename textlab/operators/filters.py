"""Filters and projections over posts, documents and file names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textlab.functions import text as T


def has_author(posts: DataFrame) -> DataFrame:
    return posts.where(F.col("author").isNotNull())


def text_posts(posts: DataFrame) -> DataFrame:
    """Posts with a body, reduced to the columns a history needs."""
    return posts.where(F.col("body") != "").select(
        "doc_id", "author", "ts", "community", "title", "body"
    )


def min_length(posts: DataFrame, n: int = 60) -> DataFrame:
    return posts.where(F.length("body") >= n)


def is_member(community: Column, members: Sequence[str], case_sensitive: bool = False) -> Column:
    """True if the community is in the list; the list is always lower-cased."""
    names = [m.strip().lower() for m in members]
    return (community if case_sensitive else F.lower(community)).isin(names)


def mentions_topic(
    community: Column, text: Column, members: Sequence[str], patterns: Sequence[str],
    case_sensitive: bool = False,
) -> Column:
    """True if the community is listed or the text holds a listed phrase."""
    return is_member(community, members, case_sensitive) | T.match_any(text, patterns)


def file_names(
    df: DataFrame, column: str = "filename", contains: str | None = None,
    startswith: str | None = None, endswith: str | None = None,
) -> DataFrame:
    name = F.col(column)
    if contains is not None:
        df = df.where(name.contains(contains))
    if startswith is not None:
        df = df.where(name.startswith(startswith))
    if endswith is not None:
        df = df.where(name.endswith(endswith))
    return df


def original_rows(df: DataFrame) -> DataFrame:
    """Rows that balancing did not add."""
    return df.where(~F.col("is_synthetic"))


def non_blank(df: DataFrame, column: str = "text") -> DataFrame:
    """Rows whose text holds more than white space."""
    return df.where(F.length(F.regexp_replace(column, T.WHITESPACE, "")) > 0)
