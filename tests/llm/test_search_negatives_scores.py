"""Ranked search, hard negatives and language-model scores against brute force."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tests.llm.helpers import corpus, edited, prose, table, words
from textlab.llm import backoff, ball_tree, negatives

ITEMS = "item_id long, text string, doc_id long, score long, term string, rank int"


def terms(text):
    return [t.translate({c: c + 32 for c in range(65, 91)}) for t in re.findall(
        "[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")]


def best_documents(rows, items, most=10):
    """Every item's best documents, without ids for the item."""
    docs = [(i, Counter(terms(t)), len(terms(t))) for i, t in rows if terms(t)]
    total, count = sum(n for _, _, n in docs), len(docs)
    df = Counter(t for _, c, _ in docs for t in c)
    out = []
    for item, text in items:
        asked, found = Counter(terms(text)), []
        for i, c, n in docs:
            m = 25 + 75 * n * count // total
            score = sum(q * math.floor(1000 * math.log((2 * count + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m))
                        for t, q in asked.items() if c[t])
            if score > 0:
                found.append((-score, i is None, i or 0))
        out += [(item, k + 1, None if none else i, -s) for k, (s, none, i) in enumerate(sorted(found)[:most])]
    return sorted(out, key=str)


def search_case():
    rng = random.Random(8)
    rows = [(r[0], r[1]) for r in corpus()]
    rows += [(2000 + i, edited(rng, rows[i % 12][1], 0.4)) for i in range(300)]
    rows += [(None, rows[3][1]), (None, "alone Été-9 alone"), (5000, rows[4][1]), (5000, rows[4][1]), (5001, "!?")]
    items = [(i, prose(rng, 12)) for i in range(20)]
    items += [(20, "ALONE été"), (21, None), (22, ""), (None, "rosti bade"), (None, "fiven"), (3, "lamro lamro norxil"), (24, rows[0][1]), (25, "nowhere")]
    return rows, items


def test_ranked_search_is_brute_force(spark, monkeypatch):
    rows, items = search_case()
    docs = spark.createDataFrame([(t, i, 1, "x") for i, t in rows], "text string, doc_id long, item_id long, term string").repartition(5)
    queries = spark.createDataFrame([(i, t, 0, 0, "", 0) for i, t in items], ITEMS)
    got = sorted([tuple(r) for r in ball_tree.ranked(docs, queries).collect()], key=str)
    assert got == best_documents(rows, items)
    # In many small trees and blocks of queries, too.
    monkeypatch.setattr(ball_tree, "BLOCK_TERMS", 30)
    for docs_of_tree, entries in ((1, 1 << 20), (40, 100)):
        monkeypatch.setattr(ball_tree, "TREE_DOCS", docs_of_tree)
        monkeypatch.setattr(ball_tree, "TREE_ENTRIES", entries)
        few = ball_tree.ranked(docs, queries.limit(6), most=3)
        assert sorted([tuple(r) for r in few.collect()], key=str) == best_documents(rows, items[:6], 3)


def test_ranked_search_of_empty_tables(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    for a, b in ((docs, items), (docs.limit(0), items.limit(0)), (spark.createDataFrame([(1, None)], docs.schema), items)):
        found = ball_tree.ranked(a, b)
        assert found.columns == ["item_id", "rank", "doc_id", "score"] and found.count() == 0


def rows_of(matrix):
    first = np.arange(0, matrix.size + 1, matrix.shape[1])
    return ball_tree.Rows(first, np.tile(np.arange(matrix.shape[1]), len(matrix)), matrix.ravel(), np.arange(len(matrix)))


def test_balls_bound_scores_and_prune():
    rng = np.random.default_rng(1)
    centers = rng.integers(0, 10**6, (8, 40))
    matrix = np.abs(centers[rng.integers(0, 8, 1000)] + rng.integers(-2000, 2000, (1000, 40)))
    root = ball_tree.grown(rows_of(matrix), 40, leaf=16)
    nodes, leaves = [root], 0
    while nodes:
        node = nodes.pop()
        below = [node]
        while any(n.rows is None for n in below):
            below = [c for n in below for c in (n.children or [n])]
        docs = np.concatenate([n.rows.doc for n in below])
        assert node.least == docs.min()
        query = rng.integers(0, 3, 40).astype(float)
        assert node.bound(query, math.sqrt(query @ query)) >= (matrix[docs] @ query.astype(int)).max()
        nodes += node.children or []
        leaves += node.rows is not None
    query = ball_tree.Query(np.array([3, 17]), np.array([1, 2]), 5)
    dense = np.zeros(40)
    dense[query.term] = query.count
    query.search(root, dense, dense.astype(np.int64))
    want = sorted(zip((-(matrix[:, 3] + 2 * matrix[:, 17])).tolist(), range(1000)))[:5]
    assert sorted((-s, -d) for s, d in query.best) == want and query.leaves < leaves / 2


def test_equal_documents_go_by_id():
    same = np.tile(np.array([[5, 7]]), (500, 1))
    root = ball_tree.grown(rows_of(same), 2, leaf=16)
    query = ball_tree.Query(np.array([0]), np.array([1]), 3)
    query.search(root, np.array([1.0, 0.0]), np.array([1, 0]))
    assert sorted(query.best) == [(5, -2), (5, -1), (5, 0)]


def mined(rows, positives=5, most=5):
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` of all rows compared."""
    kept = [(n, i, label, [math.floor(256 * x) for x in v]) for n, (i, v, label) in enumerate(rows)
            if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, i, label, v in kept:
        if i is None or i % 100:
            continue
        scored = [(-min(max(sum(x * y for x, y in zip(v, w)), -2**63), 2**63 - 1), j is None, j or 0, other, m) for m, j, other, w in kept if m != n]
        name = lambda t: None if t[1] else t[2]
        for p in sorted(t for t in scored if t[3] == label)[:positives]:
            inside = sorted(t for t in scored if t[3] != label and 80 * -p[0] <= 100 * -t[0] <= 100 * -p[0])
            out += [(i, name(p), k + 1, name(t), -p[0], -t[0]) for k, t in enumerate(inside[:most])]
    return sorted(out, key=str)


VECTORS = "vec_id long, embedding array<float>, label int, row long, v int, target int, score long"


def vectors_table(spark, rows):
    return spark.createDataFrame([(i, v, label, 1, 2, 3, 4) for i, v, label in rows], VECTORS).repartition(5)


def vector_rows():
    rng = random.Random(4)
    centers = [[rng.gauss(0, 0.3) for _ in range(20)] for _ in range(6)]
    single = lambda x: float(np.float32(x))
    rows = []
    for i in range(700):
        c = rng.choice(centers)
        rows.append((i * 10, [single(x + rng.gauss(0, 0.1)) for x in c], rng.randrange(4)))
    rows += [(i, rows[0][1], i % 4) for i in range(7001, 7080)]  # one common vector
    rows += [(100, rows[3][1], 1), (100, rows[3][1], 1), (300, rows[5][1], 2), (None, rows[7][1], 1), (None, rows[0][1], 0)]
    rows += [(10_000, None, 1), (10_100, rows[1][1], None), (10_200, [None] * 20, 1), (10_300, [math.nan] * 20, 1),
             (10_400, [math.inf] * 20, 2), (10_500, [], 1), (10_600, [0.5, 0.25], 1), (10_700, [0.0] * 20, 3), (10_800, [1.0] * 20, 9)]
    return rows


@pytest.mark.parametrize("sample", [4096, 40, 1])
def test_hard_negatives_are_brute_force(spark, monkeypatch, sample):
    rows = vector_rows()
    monkeypatch.setattr(negatives, "SAMPLE", sample)
    if sample == 40:
        monkeypatch.setattr(negatives, "BLOCK_ANCHORS", 30)
    got = sorted([tuple(r) for r in negatives.mine(vectors_table(spark, rows)).collect()], key=str)
    assert got == mined(rows) and len(got) > 500


def test_hard_negatives_of_very_large_components(spark):
    rng = random.Random(5)
    rows = [(i * 50, [float(np.float32(rng.uniform(0.5, 1) * 10**7)) for _ in range(8)], i % 3) for i in range(60)]
    rows += [(9000, [1e30] * 8, 0), (9100, [1e30] * 8, 0), (9050, [3e17] * 8, 1)]
    got = sorted([tuple(r) for r in negatives.mine(vectors_table(spark, rows)).collect()], key=str)
    assert {r[0] for r in got} and all(-2**63 <= r[5] <= r[4] < 2**63 for r in got)
    small = [r for r in mined(rows[:60])]
    assert sorted([tuple(r) for r in negatives.mine(vectors_table(spark, rows[:60])).collect()], key=str) == small and small


def test_hard_negatives_of_few_rows(spark):
    for rows in ([], [(0, [1.0], 1)], [(0, [1.0], 1), (1, [1.0], 1)], [(0, [-1.0], 1), (1, [1.0], 1), (2, [1.0], 2)]):
        assert negatives.mine(vectors_table(spark, rows)).collect() == []


def test_postings_leave_out_what_norms_cover():
    """The join is exact at any threshold, and follows fewer dimensions at high ones."""
    import pyarrow as pa

    rng = np.random.default_rng(3)
    v = rng.integers(-50, 50, (200, 40))

    def batch(rows):
        return pa.record_batch({"row": pa.array(rows), "vec_id": pa.array(rows), "label": pa.array(rows % 3), "v": pa.array([v[i].tolist() for i in rows])})

    anchors, some = (negatives.Vectors(batch(r), 40) for r in (np.arange(0, 30), np.arange(30, 200)))
    exact = anchors.v @ some.v.T
    for least in (-10**9, 0, 2000, 9000, 20000, 10**7):
        i, k, score = negatives.reaching(anchors, anchors.suffix_norms(), some, np.full(30, least), np.ones(exact.shape, bool))
        assert sorted(zip(i, k, score)) == [(a, b, exact[a, b]) for a, b in zip(*np.nonzero(exact >= least))]


def language_model(rows, prior=backoff.PRIOR):
    texts = [(i, [w.translate(backoff.LOWER) for w in words(t)] + [b"</s>"]) for i, t in rows]
    held = [i is None or zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in rows]
    single, pairs = Counter(), Counter()
    for (_, ws), out in zip(texts, held):
        if not out:
            single.update(ws)
            pairs.update(zip([b"</s>", *ws], ws))
    total, types = sum(single.values()), len(single)
    p = lambda w: (single[w] + 0.5) / (total + 0.5 * (types + 1))
    q = lambda h, w: (pairs[h, w] + prior * p(w)) / (single[h] + prior)
    return {(i, t): (out, len(ws), sum(single[w] > 0 for w in ws), total, sum(math.log10(p(w)) for w in ws),
                     sum(math.log10(q(h, w)) for h, w in zip([b"</s>", *ws], ws)))
            for (i, ws), out, (_, t) in zip(texts, held, rows)}, (single, p, q)


def model_rows():
    rng = random.Random(6)
    rows = [(r[0], r[1]) for r in corpus()] + [(3000 + i, prose(rng, 80)) for i in range(40)]
    rows += [(None, "only Here"), (None, None), (4000, "Ä ä É"), (4000, "twice the id"), (4001, "q" * 100_000), (4002, "ab " * 20_000)]
    return rows


def test_scores_are_brute_force(spark, monkeypatch):
    rows = model_rows()
    want, _ = language_model(rows)
    docs = spark.createDataFrame([(t, i, 9, 9) for i, t in rows], "text string, doc_id long, chunk long, part int").repartition(4)
    for chunk, part in ((8 << 20, 4_000_000), (2000, 500)):
        monkeypatch.setattr(backoff, "CHUNK_BYTES", chunk)
        monkeypatch.setattr(backoff, "PART_TOKENS", part)
        got = backoff.score_texts(docs.where("doc_id IS NULL OR doc_id <> 4000")).collect()
        part_rows = [r for r in rows if r[0] != 4000]
        want, _ = language_model(part_rows)
        assert len(got) == len(part_rows)
        for r in got:
            if r.doc_id is None:
                assert r.held_out
                continue
            out, n, known, total, base, score = next(v for (i, _), v in want.items() if i == r.doc_id)
            assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (out, n, known, total)
            assert math.isclose(r.base_score, base, rel_tol=1e-9) and math.isclose(r.score, score, rel_tol=1e-9)
    assert backoff.score_texts(docs).count() == len(rows)


def test_probabilities_add_up_to_one():
    rows = model_rows()
    _, (single, p, q) = language_model(rows, prior=7)
    for state in (b"</s>", b"ab", b"never seen"):
        assert math.isclose(sum(q(state, w) for w in single) + q(state, b"another"), 1, rel_tol=1e-9)


def test_pairs_predict_held_out_text_better(spark):
    rng = random.Random(9)
    follows = {w: [prose(rng, 1) for _ in range(2)] for w in {prose(rng, 1) for _ in range(400)}}

    def chain(n):
        out = ["rosti"]
        while len(out) < n:
            out.append(rng.choice(follows.get(out[-1]) or list(follows)))
        return " ".join(out)

    found = backoff.score_texts(table(spark, [(i, chain(300), "", "", 0) for i in range(300)])).where("held_out")
    r = found.selectExpr("sum(score) AS score", "sum(base_score) AS base").first()
    assert r.score > r.base + 0.05 * abs(r.base)


def test_scores_without_rows_or_training(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert backoff.score_texts(empty).collect() == []
    r = backoff.score_texts(spark.createDataFrame([(None, "a b")], empty.schema)).first()
    assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) == (True, 3, 0, 0, 0.0, 0.0)


def test_packed_numbers_come_back():
    for x in ([], [0], [3, -5, 2**62, -2**63], list(range(1000))):
        assert backoff.unpack(backoff.pack(np.array(x, np.int64))).tolist() == x
