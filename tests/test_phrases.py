"""Tables of phrases against lists, the locality-sensitive index against all pairs, encoders."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from textlab.functions import text as T
from textlab.operators import lexicon, lsh, phrases
from textlab.operators.encoders import batched, model_encoder
from textlab.operators.neighbours import nearest_neighbours
from textlab.operators.vectors import embed_chunks

SIGNS = "ab AB.,-_é É ß1٣ſKkı İ \n"


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(3)
    rows = [(i, "".join(rng.choices(SIGNS, k=rng.randint(0, 60)))) for i in range(300)]
    rows += [(300, None), (301, ""), (302, "aaa aaaa"), (303, "x" * 50_000 + " ab")]
    return spark.createDataFrame(rows, "doc_id bigint, text string").cache()


def terms_table(spark, terms):
    return spark.createDataFrame([(t,) for t in terms], "term string")


TERMS = ["a", "ab", "a b", "aa", "b", "é", "é a", "ab a", "-a", "1", "b.a", "ss", "k"]


@pytest.mark.parametrize("part", [8_000_000, 3])
def test_occurrences_equal_the_list_form(spark, texts, part, monkeypatch):
    monkeypatch.setattr(phrases, "PART_CHARS", part)
    want = sorted(tuple(r) for r in lexicon.term_pairs(texts, TERMS).collect())
    got = phrases.occurrences(texts, terms_table(spark, [*TERMS, "a", ""]))
    assert sorted(tuple(r) for r in got.collect()) == want
    any_of = texts.where(T.match_any(F.col("text"), ["ab a", "é b", "1a"]))
    some = phrases.holding_any(texts.withColumn("more", F.lit(1)), terms_table(spark, ["ab a", "é b", "1a"]))
    assert sorted(r["doc_id"] for r in some.collect()) == sorted(r["doc_id"] for r in any_of.collect())
    assert phrases.occurrences(texts, terms_table(spark, [""])).count() == 0 == phrases.holding_any(texts, terms_table(spark, [""])).count()


@pytest.mark.parametrize("order", ["shortest", "longest"])
def test_masking_equals_the_regular_expression(spark, texts, order):
    want = {r["doc_id"]: r["m"] for r in texts.select("doc_id", T.mask_terms(F.col("text"), TERMS, order).alias("m")).collect()}
    got = {r["doc_id"]: r["text"] for r in phrases.mask_with_table(texts, terms_table(spark, TERMS), order).collect()}
    assert got == want


def test_near_terms_equal_the_regular_expression(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choices(["ab", "c-d", "ee", "fff", "reject", "g1h", "é", "lorem", "ipsum"], weights=[1, 1, 6, 6, 0.2, 3, 1, 20, 20], k=60)))
            for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    lists = ["ab", "é"], ["reject"], ["c d", "g h", "x", "g1h"]
    for window in (8, 30, 80):
        want = docs.where(T.match_near(F.col("text"), *lists, window))
        got = phrases.near_table(docs, *(terms_table(spark, x) for x in lists), window=window)
        assert sorted(r[0] for r in got.collect()) == sorted(r["doc_id"] for r in want.collect())
        assert 0 < got.count() < 400


def test_very_many_phrases_in_one_pass(spark):
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefgh", k=8)) for _ in range(100_000)]
    listed = spark.createDataFrame([(w,) for w in words], "term string")
    rows = [(i, " ".join(rng.choices(words, k=20)) if i % 2 else "none of them here") for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = phrases.occurrences(docs, listed).groupBy("doc_id").agg(F.sum("n").alias("n")).collect()
    assert {r["doc_id"] for r in found} == set(range(1, 50, 2)) and all(r["n"] >= 20 for r in found)


def points(spark, n=800, dims=12):
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(12, dims))
    x = centres[rng.integers(0, 12, n)] + rng.normal(scale=0.4, size=(n, dims))
    x[100:260] = x[5]                                     # one vector is a fifth of all
    x[400:560] = x[6] + rng.normal(scale=1e-3, size=(160, dims))  # and one region is crowded
    return spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(x)], "row_id bigint, vector array<double>").cache()


def test_the_index_finds_most_neighbours(spark):
    df = points(spark)
    exact = {(r["row_id"], r["neighbour"]) for r in nearest_neighbours(df, 5).collect()}
    rows = lsh.approximate_neighbours(df, 5, bucket_rows=64).collect()
    found = {(r["row_id"], r["neighbour"]) for r in rows}
    assert len(found & exact) >= 0.9 * len(exact)
    by_row: dict = {}
    for r in sorted(rows, key=lambda r: (r["row_id"], r["rank"])):
        by_row.setdefault(r["row_id"], []).append(r["distance"])
    assert all(d == sorted(d) for d in by_row.values())
    assert {(r["row_id"], r["neighbour"]) for r in lsh.approximate_neighbours(df, 5).collect()} == exact  # one bucket


def test_buckets_are_of_bounded_size_and_rows_move_in_proportion(spark):
    df = points(spark)
    reps = lsh.collapsed(df, 5).select("rep", "vector").cache()
    index = lsh.index_of(reps, 3, 4, 64)
    sizes = index.members.groupBy("place", "prefix", "depth").count().agg(F.max("count").alias("m")).first()["m"]
    n = reps.count()
    assert sizes <= 64 and index.members.count() == 3 * n and index.probes.count() <= 3 * 4 * n


def test_the_recall_of_a_sample_is_known_from_codes(spark):
    reps = lsh.collapsed(points(spark), 5).select("rep", "vector").cache()
    sample = reps.where("rep % 9 = 0").cache()
    truth = lsh.sampled_exact(reps, sample, 5)
    buckets, alone = lsh.Buckets(reps, 64), lsh.index_of(reps, 3, 2, 64)
    buckets.grow(2)
    buckets.grow(3)                                       # tables added are those made at once
    index = buckets.index(2)
    assert index.members.exceptAll(alone.members).isEmpty() and index.probes.exceptAll(alone.probes).isEmpty()
    assert buckets.own.columns == ["place", "rep", "code"]
    searched = lsh.near(lsh.Index(index.members, index.probes.join(sample.select("rep"), "rep")), 5)
    share = lsh.recall(buckets.meetings(sample, truth, 2), truth)
    assert share == lsh.recall(searched, truth) and 0.1 < share < 1


def test_encoders_get_texts_of_similar_length(spark):
    groups = []

    def encode(some):
        groups.append([len(t) for t in some])
        return np.array([[len(t), t.count("a")] for t in some])

    texts = ["a" * (i * 37 % 101) for i in range(101)]
    out = batched(encode, texts, 2, 10)
    assert out[:, 0].tolist() == [len(t) for t in texts] and sum(map(len, groups)) == 101
    assert [x for g in groups for x in g] == sorted(map(len, texts))
    with pytest.raises(ValueError):
        batched(lambda some: np.zeros((1, 3)), texts, 2, 10)
    docs = spark.createDataFrame([(1, "a b a"), (2, ""), (3, " ".join(["a"] * 450))], "doc_id bigint, text string")

    def load():
        return lambda some: np.array([[t.count("a"), 1.0] for t in some])

    got = {r["doc_id"]: r["vector"] for r in embed_chunks(docs, model_encoder(load, 2), 2).collect()}
    assert got == {1: [2.0, 1.0], 2: [0.0, 1.0], 3: [150.0, 1.0]}
