"""Cohort rules on invented posts."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from textlab.functions import hashing as H
from textlab.functions import text as T
from textlab.operators import cohort as C
from textlab.operators import filters as P
from textlab.operators.ranking import positions
from textlab.plans.cohorts import control_cohort, positive_cohort

SCHEMA = "doc_id bigint, author string, ts timestamp, community string, title string, body string"
START = datetime(2024, 1, 1)
LONG = "x" * 60


def posts(spark, rows):
    return spark.createDataFrame(
        [(i, a, START + timedelta(days=d), c, t, b) for i, a, d, c, t, b in rows], SCHEMA)


def nothing(spark, schema):
    return spark.createDataFrame([], schema)


def run_positive(spark, table, seeds, seen=(), existing=(), k=5):
    seen_keys = spark.createDataFrame([(s,) for s in seen], "a string").select(
        H.hash_author(F.col("a")).alias("author_key"))
    stored = spark.createDataFrame([(t,) for t in existing], "text string")
    text = T.post_text(F.col("title"), F.col("body"))
    cohort = positive_cohort(
        table, spark.createDataFrame(seeds, "author string, arrival bigint"), seen_keys, stored,
        T.match_near(text, ["start"], ["never"], ["tree"]), ["garden"], 365, k)
    return [(r["seq"], r["doc_id"]) for r in cohort.orderBy("seq").collect()]


def test_positive_cohort(spark):
    table = posts(spark, [
        (1, "ann", 0, "garden", "before", LONG),                   # before the index event
        (2, "ann", 1, "Garden", "start tree", LONG),               # index event, mixed case community
        (3, "ann", 366, "garden", "last day", LONG + "y"),         # exactly 365 days later
        (4, "ann", 367, "garden", "too late", LONG),
        (5, "ann", 2, "kitchen", "elsewhere", LONG),
        (6, "ann", 3, "garden", "short", "x" * 59),
        (7, "bob", 0, "garden", "start never tree", LONG),         # rejected
        (8, "cid", 0, "garden", "start tree", LONG),               # seen before
        (9, "dan", 0, "kitchen", "start tree", LONG),              # index event outside the communities
        (10, "dan", 1, "garden", "copy", LONG),
        (11, "eve", 0, "garden", "start tree", LONG + "z"),
        (12, "eve", 1, "garden", "copy", LONG),                    # same text as 10, arrives later
        (13, "eve", 2, "garden", "stored", LONG),
        (14, "fay", 0, "garden", "start tree", ""),                # no body
    ])
    seeds = [(a, i) for i, a in enumerate(["dan", "ann", "bob", "cid", "eve", "fay", "ann"])] + [(None, 9)]
    got = run_positive(spark, table, seeds, seen=["cid"], existing=[f"stored\n{LONG}"])
    assert got == [(1, 10), (2, 2), (3, 3), (4, 11)]


def test_top_k_before_duplicates(spark):
    rows = [(i, "ann", i, "garden", "start tree" if i == 0 else f"t{i}", "x" * (60 + i)) for i in range(7)]
    rows.append((7, "ann", 8, "garden", "t6", "x" * 66))           # a copy of post 6
    got = run_positive(spark, posts(spark, rows), [("ann", 0)])
    # The five longest are 6, 7, 5, 4, 3; the copy uses up a place.
    assert got == [(1, 6), (2, 5), (3, 4), (4, 3)]
    few = run_positive(spark, posts(spark, rows[:4]), [("ann", 0)])
    assert [d for _, d in few] == [0, 1, 2, 3]                      # fewer than five: time order


def test_control_cohort(spark):
    table = posts(spark, [
        (1, "ann", 0, "chat", "hi", "x" * 10),      # short seed does not use up the author
        (2, "ann", 1, "chat", "hi", LONG),
        (3, "ann", 2, "chat", "again", LONG),       # second long seed of the author
        (4, "bob", 0, "chat", "tree", LONG),        # mentions the topic
        (5, "cid", 0, "chat", "fine", LONG),
        (6, "cid", 1, "Garden", "other", "y"),      # topic community elsewhere in the history
        (7, "dan", 0, "chat", "hi", LONG),          # same text as 2
        (8, None, 0, "chat", "gone", LONG),
        (9, "eve", 0, "chat", "seen", LONG),
        (10, "fay", 0, "chat", "new", LONG),
    ])
    topic = P.mentions_topic(F.col("community"), T.post_text(F.col("title"), F.col("body")), ["garden"], ["tree", ""])
    visited = spark.range(1).select(H.hash_author(F.lit("eve")).alias("author_key"))
    seeds = table.withColumn("arrival", F.col("doc_id"))
    cohort = control_cohort(table, seeds, visited, nothing(spark, "text string"), topic, base=7)
    assert [(r["seq"], r["doc_id"]) for r in cohort.orderBy("seq").collect()] == [(8, 2), (9, 10)]


def test_members_with_case(spark):
    df = spark.createDataFrame([("Garden",), ("garden",)], "c string")
    got = df.select(P.is_member(F.col("c"), ["GARDEN"]), P.is_member(F.col("c"), ["GARDEN"], True)).collect()
    assert [tuple(r) for r in got] == [(True, False), (True, True)]


def test_positions_of_a_hot_group(spark):
    df = spark.range(5000).select(
        F.when(F.col("id") % 3 > 0, "hot").otherwise(F.col("id").cast("string")).alias("g"), "id")
    got = positions(df.repartition(7), ["id"], "pos", within=["g"], size="n").where("g = 'hot'")
    ids = [r["id"] for r in got.orderBy("pos").collect()]
    assert ids == [i for i in range(5000) if i % 3 > 0]
    assert [r["pos"] for r in got.orderBy("pos").collect()] == list(range(len(ids)))
    assert {r["n"] for r in got.select("n").distinct().collect()} == {len(ids)}


def test_history_and_recent(spark):
    table = posts(spark, [(i, "ann", 5 - i, "c", "t", "b") for i in range(5)])
    order = C.history_order(table).orderBy("seq").collect()
    assert [r["doc_id"] for r in order] == [4, 3, 2, 1, 0]
    assert {r["doc_id"] for r in C.recent_posts(table, 2).collect()} == {0, 1}
