"""Vector aggregates against plain Python."""

import re

import pytest
from pyspark.sql import functions as F

from textlab.functions import vectors as V
from textlab.operators import vectors as W

WORDS = {"oak": [1.0, 2.0], "pine": [3.0, -1.0], "trees": [5.0, 5.0], "elms": [9.0, 9.0], "elm": [0.5, 0.25]}
LEMMAS = {"trees": "tree", "elms": "elm", "ivies": "ivy"}  # "tree" has no vector
DOCS = {
    1: "Oak, pine! oak", 2: "trees oak trees pine elms", 3: "nothing known 123", 4: "",
    5: "trees trees", 6: "oak unknown pine", 7: "ivies oak",
}


@pytest.fixture(scope="module")
def lookup(spark):
    vectors = spark.createDataFrame(list(WORDS.items()), "word string, vector array<double>")
    lemmas = spark.createDataFrame(list(LEMMAS.items()), "word string, lemma string")
    return W.vector_lookup(vectors, lemmas)


def expected(text, how):
    kept = [LEMMAS.get(w, w) for w in re.findall("[a-z]+", text.lower()) if w in WORDS]
    known = [WORDS[w] for w in kept if w in WORDS]
    if how == "sum":
        return [sum(v[d] for v in known) for d in range(2)]
    if how == "mean":
        return [sum(v[d] for v in known) / len(known) if known else 0.0 for d in range(2)]
    value = [0.0, 0.0]
    for place, word in enumerate(kept):
        if word in WORDS:
            value = [(place * a + b) / (place + 1) for a, b in zip(value, WORDS[word])]
    return value


@pytest.mark.parametrize("how", ["sum", "mean", "running"])
def test_aggregates(spark, lookup, how):
    docs = spark.createDataFrame(list(DOCS.items()), "doc_id bigint, text string")
    for pieces in (1, 5):
        got = {r["doc_id"]: r["vector"] for r in W.aggregate_vectors(
            docs.repartition(pieces), lookup, how, 2).collect()}
        assert got.keys() == DOCS.keys()
        for key, text in DOCS.items():
            assert got[key] == pytest.approx(expected(text, how), abs=1e-9), (key, how)


def test_unknown_aggregate(spark, lookup):
    with pytest.raises(ValueError):
        W.aggregate_vectors(spark.createDataFrame([(1, "a")], "doc_id bigint, text string"), lookup, "max", 2)


def test_lemma_after_vocabulary(spark):
    tokens = spark.createDataFrame([(1, 0, "elms"), (1, 1, "ivies"), (1, 2, "oak")], "doc_id int, pos int, word string")
    vocabulary = spark.createDataFrame([(w,) for w in WORDS], "word string")
    lemmas = spark.createDataFrame(list(LEMMAS.items()), "word string, lemma string")
    got = W.lemmatize(W.known_tokens(tokens, vocabulary), lemmas).collect()
    assert sorted(r["word"] for r in got) == ["elm", "oak"]


def test_chunk_mean_counts_the_empty_tail(spark, lookup):
    text = " ".join(["oak"] * 400)                      # chunks of 200, 200 and 0 words
    docs = spark.createDataFrame([(1, text), (2, "pine")], "doc_id bigint, text string")
    got = {r["doc_id"]: r["vector"] for r in W.embed_chunks(
        docs, W.word_vector_encoder(lookup, 2), 2).collect()}
    assert got[1] == pytest.approx([2 / 3, 4 / 3]) and got[2] == [3.0, -1.0]


def test_expressions(spark):
    a, b = F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(1.0))
    row = spark.range(1).select(
        V.cosine(a, b), V.add(a, b), V.scale(a, 3), V.interpolate(a, b, F.lit(0.5)), V.squared_distance(a, b),
        V.cosine(a, V.zeros(2))).first()
    assert row[0] == pytest.approx(0.5 ** 0.5)
    assert list(row)[1:] == [[2.0, 1.0], [3.0, 0.0], [1.0, 0.5], 1.0, 0.0]


@pytest.mark.parametrize("how", ["sum", "mean", "running"])
def test_dictionary_in_slices(spark, lookup, monkeypatch, how):
    monkeypatch.setattr(W, "SLICE_ROWS", 2)
    monkeypatch.setattr(W, "WORD_ROWS", 2)
    docs = spark.createDataFrame(list(DOCS.items()), "doc_id bigint, text string")
    got = {r["doc_id"]: r["vector"] for r in W.aggregate_vectors(docs, lookup, how, 2).collect()}
    assert got.keys() == DOCS.keys()
    for key, text in DOCS.items():
        assert got[key] == pytest.approx(expected(text, how), abs=1e-9), (key, how)


@pytest.mark.parametrize("how", ["mean", "running"])
def test_tokens_do_not_move_to_large_dictionaries(spark, lookup, capsys, how):
    """However small a table Spark broadcasts by itself."""
    docs = spark.createDataFrame(list(DOCS.items()), "doc_id bigint, text string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        W.aggregate_vectors(docs, lookup, how, 2).explain()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    plan = capsys.readouterr().out
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


@pytest.mark.parametrize("how", ["sum", "mean", "running"])
def test_slices_share_one_pass(spark, monkeypatch, how):
    """Sums of several slices are not written; words, documents and vectors that come twice, nulls and blank texts count as with one."""
    vectors = spark.createDataFrame(
        [(w, [float(i + j) / 3 if (i + j) % 7 else None for j in range(40)]) for i, w in enumerate(WORDS)] + [("oak", [0.1] * 40), ("ash", None)],
        "word string, vector array<double>")
    lookup = W.vector_lookup(vectors, spark.createDataFrame(list(LEMMAS.items()), "word string, lemma string"))
    docs = spark.createDataFrame([*DOCS.items(), (1, "elm ash"), (None, "oak"), (8, None), (9, "oak " * 50)], "doc_id bigint, text string")
    one = {r["doc_id"]: r["vector"] for r in W.aggregate_vectors(docs, lookup, how, 40).collect()}
    monkeypatch.setattr(W, "SLICE_ROWS", 2)
    monkeypatch.setattr(W, "GATHERED", 2)
    monkeypatch.setattr(W, "written", None)
    for held in (0, 100):
        monkeypatch.setattr(W, "HELD", held)
        many = {r["doc_id"]: r["vector"] for r in W.aggregate_vectors(docs, lookup, how, 40).collect()}
        assert many.keys() == one.keys() and 8 not in many and None in many
        for key in one:
            assert many[key] == pytest.approx(one[key], abs=1e-9)


@pytest.mark.parametrize("rows", [2, 1 << 17])
def test_sum_and_mean_in_one_pass(spark, lookup, monkeypatch, rows):
    """Both vectors at once are those of either alone; tasks, not the driver, make what is broadcast, and it can be released."""
    monkeypatch.setattr(W, "SLICE_ROWS", rows)
    docs = spark.createDataFrame([(1, "a b b zz"), (2, ""), (3, "b a"), (4, None), (3, "b")], "doc_id bigint, text string")
    alone = {how: {r["doc_id"]: r["vector"] for r in W.aggregate_vectors(docs, lookup, how).collect()} for how in ("sum", "mean")}

    def refuse(*_):
        raise AssertionError("made by the driver")

    monkeypatch.setattr(W, "_word_slice", refuse)
    sent = []
    both = W.aggregate_both(docs, lookup, kept=sent).collect()
    assert len(both) == len(alone["sum"]) and bool(sent) == (rows == 2)
    for r in both:
        assert r["sum"] == alone["sum"][r["doc_id"]] and r["mean"] == alone["mean"][r["doc_id"]]
    for one in sent:
        one.destroy()
