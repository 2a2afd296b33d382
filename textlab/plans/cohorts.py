"""Author cohorts from post histories."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textlab.functions import text as T
from textlab.operators import cohort as C
from textlab.operators import filters as P


def seed_authors(seeds: DataFrame, seen: DataFrame) -> DataFrame:
    """``author, arrival``: authors of a seed list that were not seen before.

    Grouping keeps the first arrival of an author over all queries.
    """
    known = C.exclude_authors(P.has_author(seeds), seen)
    return known.groupBy("author").agg(F.min("arrival").alias("arrival"))


def positive_cohort(
    posts: DataFrame, seeds: DataFrame, seen: DataFrame, existing: DataFrame,
    predicate: Column, members: Sequence[str], days: int = 365, k: int = 5, min_chars: int = 60,
    base: int = 0,
) -> DataFrame:
    """Documents of authors with an index event: ``seq, doc_id, author, text``.

    ``posts`` are the histories, ``seeds`` is ``author, arrival``, ``seen`` is
    ``author_key``, ``existing`` is ``text``. Of the posts from the index event
    on, those of a member community that are long enough qualify, the index post
    included; the ``k`` longest of an author are kept, in time order if there
    are fewer. Exact copies go to the first arrival.
    """
    authors = seed_authors(seeds, seen)
    history = P.text_posts(posts).join(authors.select("author"), "author", "left_semi")
    events = C.first_index_event(history, predicate)
    after = C.window_after(history, events, days)
    accepted = P.min_length(after.where(P.is_member(F.col("community"), members)), min_chars)
    chosen = C.top_k_per_author(accepted, k)
    # At most k rows per author from here on.
    held = chosen.groupBy("author").agg(F.count(F.lit(1)).alias("held"))
    placed = chosen.join(held, "author").join(authors, "author").withColumn(
        "place", F.when(F.col("held") >= k, F.col("rank")).otherwise(F.lit(0))
    )
    order = ["arrival", "place", "ts", "doc_id"]
    docs = placed.withColumn("text", T.document_text(F.col("title"), F.col("body")))
    fresh = C.drop_known_texts(docs.select("author", "text", *order), existing, order)
    numbered = C.assign_sequence(fresh.select("author", "doc_id", "text", "arrival", "place", "ts"), order, base)
    return numbered.select("seq", "doc_id", "author", "text")


def control_cohort(
    posts: DataFrame, seeds: DataFrame, visited: DataFrame, existing: DataFrame, topic: Column,
    min_chars: int = 60, base: int = 0,
) -> DataFrame:
    """Seed posts of authors who never mention the topic: ``seq, doc_id, author, text``.

    ``seeds`` are posts with ``arrival``; ``visited`` is ``author_key`` of every
    author looked at for the positive cohort. A seed that is too short does not
    use up its author; every other visit does.
    """
    candidates = C.exclude_authors(P.has_author(seeds), visited)
    first = C.keep_first(P.min_length(candidates, min_chars), ["author"], ["arrival"])
    clean = C.exclude_topic_authors(first, P.text_posts(posts), topic)
    docs = clean.withColumn("text", T.document_text(F.col("title"), F.col("body")))
    fresh = C.drop_known_texts(docs.select("author", "doc_id", "text", "arrival"), existing, ["arrival"])
    return C.assign_sequence(fresh, ["arrival"], base).select("seq", "doc_id", "author", "text")
