"""Language spans against known mixtures, Viterbi and mixing against brute force."""

import random

import numpy as np
import pytest

from tests.llm.helpers import SCHEMA, corpus, table
from textlab.llm import language, mixing

VOICES = {"aa": "the of and to in is that it for on was with be as by".split(),
          "bb": "der die und das von mit ist nicht ein zu auf für den im".split(),
          "cc": "и в не на что с по как это из у к то все за он".split()}


@pytest.fixture(scope="module")
def model(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choices(VOICES[k], k=40)), k) for i, k in enumerate(list(VOICES) * 20)]
    rows += [(900, None, "aa"), (901, "12 34", "bb"), (902, "x", None)]
    return language.fit(table(spark, rows, "doc_id long, text string, lang string"), rows=10)


def test_texts_and_spans(spark, model):
    rng = random.Random(2)
    a, b, c = (" ".join(rng.choices(VOICES[k], k=30)) for k in VOICES)
    rows = [(1, a), (2, b.upper()), (3, a + "; " + b), (4, "12 -- 3"), (5, None), (6, ""), (7, c), (None, a), (1, a), (8, "и " + c + " " + b * 60)]
    docs = table(spark, rows, "doc_id long, text string").selectExpr("doc_id", "text", "'zz' AS lang_pred_", "0.5 AS score_")
    got = language.identify(docs, model, spans=True).collect()
    by_id = {r.doc_id: r for r in got}
    assert len(got) == len(rows) and model.languages == ["aa", "bb", "cc"]
    assert [by_id[i].lang_pred for i in (1, 2, 4, 5, 6, 7, None, 8)] == ["aa", "bb", "und", "und", "und", "cc", "aa", "bb"]
    assert by_id[5].score == 0 and by_id[1].score > 0.9 and by_id[3].score < 0.7
    assert [s.lang for s in by_id[3].spans] == ["aa", "bb"] and abs(by_id[3].spans[1].first - 30) <= 2
    assert [s.lang for s in by_id[8].spans] == ["cc", "bb"]
    assert language.identify(docs.limit(0), model).count() == 0


def test_nothing_learnt(spark):
    docs = table(spark, [(1, "abc", None)], "doc_id long, text string, lang string")
    empty = language.fit(docs)
    assert [r.lang_pred for r in language.identify(docs, empty).collect()] == ["und"]


def test_viterbi_is_optimal():
    rng = np.random.default_rng(1)
    for _ in range(10):
        lengths = rng.choice([0, 1, 5, 31, 32, 33, 90], 6)
        first = np.concatenate([[0], np.cumsum(lengths)])
        scores = -rng.integers(0, 5, (first[-1], 3)).astype(np.float32)
        labels = language.viterbi(scores, first, 2.5)
        for a, b in zip(first[:-1], first[1:]):
            if a < b:
                best = scores[a].astype(float)
                for i in range(a + 1, b):
                    best = np.maximum(best, best.max() - 2.5) + scores[i]
                own = sum(scores[i, labels[i]] for i in range(a, b)) - 2.5 * np.count_nonzero(np.diff(labels[a:b]))
                assert own == pytest.approx(best.max())


def test_viterbi_with_many_languages():
    scores = np.full((300, 200), -5, np.float32)
    scores[:, 199] = 0
    scores[150:, 199], scores[150:, 130] = -5, 0
    labels = language.viterbi(scores, np.array([0, 300]), 2.5)
    assert labels.tolist() == [199] * 150 + [130] * 150


def test_signs_that_are_no_letters(spark):
    rows = [(1, "ba bo ba " * 20, "aa"), (2, "² ½ ³ 12", None), (3, "²ba½bo ³", None), (4, "ⅷ ①", None), (5, None, None)]
    docs = table(spark, rows, "doc_id long, text string, lang string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(docs, language.fit(docs)).collect()}
    assert got == {1: ("aa", 1.0), 2: ("und", 0.0), 3: ("aa", 1.0), 4: ("und", 0.0), 5: ("und", 0.0)}
    assert language.words_of("²Ba½bo ³ x") == ["ba", "bo", "x"]


def water_level(sizes, weights, most=3.0):
    """Targets by sharing the excess again and again."""
    total, capped = sum(sizes.values()), {}
    while True:
        rest = {s: w for s, w in weights.items() if s not in capped}
        left = total - sum(capped.values())
        share = {s: left * w / sum(rest.values()) for s, w in rest.items()}
        over = {s: most * sizes[s] for s in rest if share[s] > most * sizes[s]}
        if not over:
            return {**capped, **share}
        capped |= over


def test_mix_reaches_targets(spark):
    rng = random.Random(4)
    rows = [r for r in corpus() if r[0] != 10**12]
    rows += [(10_000 + i, "w " * rng.randint(1, 60), None, rng.choice(["b", "c", "c", "c", "d", None]), 0) for i in range(600)]
    rows += [(20_000, "w w", None, "tiny", 0), (20_001, None, None, "void", 0)]
    docs = table(spark, rows).withColumnRenamed("n_chars", "size")
    got = mixing.mix_sources(docs).collect()
    assert len(got) == len(rows)
    words = {r[0]: len((r[1] or "").split()) for r in rows}  # no other spaces occur in these texts
    sizes = {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + words[r[0]]
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None]
    targets = water_level(sizes, {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)})
    largest = {s: max(words[r[0]] for r in rows if r[3] == s) for s in sizes}
    for r in got:
        assert r.size == words[r.doc_id] and r.source_size == sizes[r.source]
        assert r.target == pytest.approx(targets[r.source]) and r.taken == r.copies * r.size <= 3 * r.size
    for s in sizes:
        assert abs(sum(r.taken for r in got if r.source == s) - targets[s]) <= largest[s] / 2
    again = mixing.mix_sources(docs.repartition(7)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_importance_and_an_empty_table(spark):
    from pyspark.sql import functions as F
    rows = [(i, "w", None, "a" if i % 2 else "b", 0) for i in range(2000)]
    docs = table(spark, rows)
    heavy = F.when(F.col("doc_id") < 1000, 4.0).otherwise(1.0)
    got = mixing.mix_sources(docs, cycle=(1, 3), importance=heavy).collect()
    taken = [sum(r.copies for r in got if (r.doc_id < 1000) is low and r.source == "a") for low in (True, False)]
    assert sum(taken) == 500 and taken[0] > 2.5 * taken[1]
    assert mixing.mix_sources(docs.limit(0)).count() == 0
