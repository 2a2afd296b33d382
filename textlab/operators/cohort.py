"""Post histories: index events, time windows, exclusions and numbering.

Author keys may be very uneven. Aggregates combine before their shuffle, top-k
windows are limited before it, and the joins below have one row per author on
their other side, so adaptive execution can broadcast that side or split a hot
author.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textlab.functions import hashing as H
from textlab.operators.ranking import first_rows, positions


def history_order(posts: DataFrame) -> DataFrame:
    """Every post's 1-based place in its author's history, oldest first."""
    slim = posts.select("author", "ts", "doc_id")
    ranked = positions(slim, ["ts", "doc_id"], name="seq", within=["author"])
    return ranked.select("author", "doc_id", (F.col("seq") + 1).alias("seq"))


def recent_posts(posts: DataFrame, n: int) -> DataFrame:
    """The newest ``n`` posts of every author."""
    return first_rows(posts, ["author"], [F.desc("ts"), F.desc("doc_id")], n)


def first_seeds(posts: DataFrame, n: int) -> DataFrame:
    """The first ``n`` rows of a seed list by arrival."""
    return posts.orderBy("arrival").limit(n)


def posts_per_author(posts: DataFrame) -> DataFrame:
    return posts.groupBy("author").agg(F.count(F.lit(1)).alias("n_posts"))


def index_window(start: Column, days: int = 365) -> Column:
    """End of the window that begins at a timestamp (UTC, inclusive)."""
    return start + F.expr(f"INTERVAL {int(days)} DAYS")


def first_index_event(posts: DataFrame, predicate: Column) -> DataFrame:
    """Per author, the earliest post for which the predicate holds."""
    first = F.min(F.struct("ts", "doc_id")).alias("first")
    return (
        posts.where(predicate).groupBy("author").agg(first)
        .select("author", F.col("first.ts").alias("index_ts"),
                F.col("first.doc_id").alias("index_doc"))
    )


def indexed_authors(posts: DataFrame, index_events: DataFrame) -> DataFrame:
    """Posts of authors that have an index event."""
    return posts.join(index_events.select("author"), "author", "left_semi")


def window_after(posts: DataFrame, index_events: DataFrame, days: int = 365) -> DataFrame:
    """Posts from the index event on, until ``days`` later, both inclusive."""
    joined = posts.join(index_events, "author")
    after = F.struct("ts", "doc_id") >= F.struct("index_ts", "index_doc")
    return joined.where(after & (F.col("ts") <= index_window(F.col("index_ts"), days)))


def top_k_per_author(posts: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` longest bodies per author; ties in time order."""
    return first_rows(posts, ["author"], [F.desc(F.length("body")), "ts", "doc_id"], k, "rank")


def keep_first(df: DataFrame, keys: list[str], order_by: list) -> DataFrame:
    """The first arrival per key wins."""
    return first_rows(df, keys, order_by, 1)


def exclude_authors(posts: DataFrame, seen: DataFrame) -> DataFrame:
    """Drop posts whose hashed author is in ``seen(author_key)``."""
    keyed = posts.withColumn("author_key", H.hash_author(F.col("author")))
    return keyed.join(seen.select("author_key").distinct(), "author_key", "left_anti")


def exclude_topic_authors(posts: DataFrame, history: DataFrame, topic: Column) -> DataFrame:
    """Drop authors any of whose posts in ``history`` mention the topic."""
    flagged = history.where(topic).select("author").distinct()
    return posts.join(flagged, "author", "left_anti")


def drop_known_texts(docs: DataFrame, existing: DataFrame, order_by: list) -> DataFrame:
    """Drop documents whose exact text is stored already or came earlier.

    Copies collapse to their first arrival before the join, so a text that makes
    up much of the table meets the join once.
    """
    digest = H.text_digest(F.col("text"))
    first = keep_first(docs.withColumn("digest", digest), ["digest", "text"], order_by)
    known = existing.select("text").distinct().withColumn("digest", digest)
    return first.join(known, ["digest", "text"], "left_anti").drop("digest")


def assign_sequence(docs: DataFrame, order_by: list, base: int = 0) -> DataFrame:
    """Number documents by arrival, after the ``base`` that exist already."""
    ranked = positions(docs, order_by, name="seq")
    return ranked.withColumn("seq", F.col("seq") + F.lit(base + 1))
