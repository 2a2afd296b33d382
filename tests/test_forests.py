"""Forests grown in the tasks that hold their rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from textlab.operators import forests
from textlab.operators import models as M
from textlab.operators import scoring as S
from textlab.operators.sampling import holdout_splits

PARAMS = {"model": "Random Forest", "n_estimators": 6}
KEEP = ["row_id", "label"]


def dense(spark, n=400):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(1.5 * (i % 3 == 0), 1.0, 6).round(2).tolist(), int(i % 3 == 0)) for i in range(n)]
    return spark.createDataFrame(rows, "row_id bigint, vector array<double>, label int")


def sparse(spark, n=300):
    rng, rows = np.random.default_rng(4), []
    for i in range(n):
        terms = sorted(set(rng.integers(0, 40, 8).tolist()) | ({40, 41} if i % 3 == 0 else set()))
        rows.append((i, (terms if i % 50 else [], [round(float(w), 3) for w in rng.uniform(0.1, 1, len(terms))] if i % 50 else []), int(i % 3 == 0)))
    return spark.createDataFrame(rows, "row_id bigint, vector struct<terms: array<int>, weights: array<double>>, label int")


@pytest.mark.parametrize("make", [dense, sparse])
@pytest.mark.parametrize("criterion, weight", [("gini", None), ("entropy", "balanced")])
def test_splitting_large_nodes_first_gives_the_same_trees(spark, make, criterion, weight, monkeypatch):
    """One task for all rows of a tree, or many, and many partitions: the same predictions."""
    rows = make(spark).cache()
    train, test = rows.where("row_id % 4 <> 1"), rows.where("row_id % 4 = 1")
    params = PARAMS | {"criterion": criterion, "class_weight": weight, "max_features": "sqrt"}
    whole = {tuple(r) for r in forests.predictions(train, test, params, KEEP).collect()}
    assert len(whole) == test.count()
    assert np.mean([label == said for _, label, said in whole]) > 0.8
    monkeypatch.setattr(forests, "LOCAL_CELLS", 700)
    monkeypatch.setattr(forests, "SHARD_ROWS", 20)
    monkeypatch.setattr(forests, "ENTRIES", 16)
    assert {tuple(r) for r in forests.predictions(train.repartition(3), test, params, KEEP).collect()} == whole


def grown_by_hand(forest, x, y, n, tree, node=1):
    """A tree of nested tuples, split by trying every bin of every feature."""
    t1, t0 = int(n[y == 1].sum()), int(n[y == 0].sum())
    share = t1 / max(1, t0 + t1)
    factor, shift = (int(v[0]) for v in forests.draws(forest, tree, np.array([node])))
    chosen = {factor * (f - shift) % forest.dims: f for f in range(forest.dims)}
    best = (forests.LEAST_GAIN, None, None)
    gini = lambda a, b: 1 - (a * a + b * b) / max(1, a + b) ** 2
    for j in range(forest.drawn):
        for cut in np.unique(x[:, chosen[j]]):
            right = x[:, chosen[j]] >= cut
            r1, r0 = n[right & (y == 1)].sum(), n[right & (y == 0)].sum()
            if 0 < r0 + r1 < t0 + t1:
                gain = gini(t0, t1) - ((r0 + r1) * gini(r0, r1) + (t0 + t1 - r0 - r1) * gini(t0 - r0, t1 - r1)) / (t0 + t1)
                if round(gain, 12) > best[0]:
                    best = (round(gain, 12), chosen[j], cut)
    if best[1] is None:
        return share
    right = x[:, best[1]] >= best[2]
    return (best[1], best[2], *(grown_by_hand(forest, x[s], y[s], n[s], tree, 2 * node + i) for i, s in enumerate((~right, right))))


def test_trees_agree_with_trying_every_split():
    import pyarrow as pa
    rng = np.random.default_rng(8)
    x, y, hashes = rng.integers(0, 5, (200, 9)).astype(np.uint8), rng.integers(0, 2, 200), rng.integers(0, 1 << 62, 200)
    table = pa.table({"label": pa.array(y), "hash": pa.array(hashes), "bins": pa.array([r.tobytes() for r in x], pa.binary())})
    terms = [np.flatnonzero(r) for r in x]
    entries = pa.table({"label": pa.array(y), "hash": pa.array(hashes), "terms": pa.array(terms, pa.list_(pa.int32())),
                        "bins": pa.array([r[t].tobytes() for r, t in zip(x, terms)], pa.binary())})
    forest = forests.Forest(3, "sqrt", "gini", 9)

    def said(tree, row):
        while isinstance(tree, tuple):
            tree = tree[2 + (row[tree[0]] >= tree[1])]
        return tree

    for tree in range(3):
        n = forests.copies(forest, tree, hashes)
        assert 0.8 < n.mean() < 1.2
        kept = n > 0
        by_hand = grown_by_hand(forest, x[kept], y[kept], n[kept], tree)
        wanted = np.array([said(by_hand, r) for r in x])
        for some in (table, entries):
            block = forests.Block(some, 9)
            grown = forests.Tree.read(forests.grown(forest, block, tree, 1).stored())
            assert np.allclose(grown.shares(block, np.arange(200)), wanted)


def test_a_forest_keeps_no_tree_in_the_driver(spark, monkeypatch):
    """Scored forests are not Spark's, whose trees the driver holds whole; repeated ids keep their rows."""
    def refuse(*_):
        raise AssertionError("fitted by the driver")
    monkeypatch.setattr(M, "fit", refuse)
    rows = dense(spark, 120)
    rows = rows.unionByName(rows.where("row_id = 7"))
    found = M.fit_predict_splits(rows, holdout_splits(rows.distinct(), 2), PARAMS)
    want = rows.join(holdout_splits(rows.distinct(), 2).where("part = 'test'"), "row_id")
    assert found.count() == want.count()
    assert S.split_scores(found).agg(F.min("accuracy")).first()[0] > 0.7


def test_chosen_terms_are_read_from_their_own_entries(monkeypatch):
    """A node of many sparse rows looks at the entries of the terms it chose, not at all that its rows hold."""
    import pyarrow as pa
    rng = np.random.default_rng(5)
    n, dims, drawn = 600, 900, 30
    terms = [np.sort(rng.choice(dims, 40, replace=False)).astype(np.int32) for _ in range(n)]
    terms[7] = np.sort(np.append(terms[7], terms[7][:3]))                 # a term that comes twice
    table = pa.table({"label": pa.array(rng.integers(0, 2, n)), "hash": pa.array(rng.integers(0, 1 << 62, n)), "terms": pa.array(terms, pa.list_(pa.int32())),
                      "bins": pa.array([rng.integers(1, 33, len(t)).astype(np.uint8).tobytes() for t in terms], pa.binary())})
    forest, block = forests.Forest(1, "sqrt", "gini", dims), forests.Block(table, dims)
    rows, node = np.arange(0, n, 2), np.arange(n // 2) % 3
    factor, shift = forests.draws(forest, 0, np.array([4, 5, 6]))
    read = []
    real = forests.Block.by_terms

    def counted(*args):
        out = real(*args)
        read.append(sum(len(i) for i, _, _ in out))
        return out

    monkeypatch.setattr(forests.Block, "by_terms", counted)
    got = sorted(zip(*(x.tolist() for x in block.chosen(rows, node, factor, shift, drawn))))
    want = sorted((i, int(j), int(b)) for i, r in enumerate(rows) for t, b in zip(terms[r], block.bins[block.first[r]:block.first[r + 1]])
                  if (j := factor[node[i]] * (int(t) - shift[node[i]]) % dims) < drawn)
    assert got == want and read == [len(want)]
    feature, cut = np.array([terms[7][0], 3, -1]), np.array([5, 2, 0])
    inner = node < 2
    assert (block.goes_right(rows[inner], node[inner], feature, cut) == (block.at(rows[inner], feature[node[inner]]) >= cut[node[inner]])).all()


def test_small_trees_go_to_the_rows(spark, monkeypatch):
    """Rows are classified where all trees are, if these are small, and move once; either way gives the same."""
    rows = sparse(spark).cache()
    train, test = rows.where("row_id % 4 <> 1"), rows.where("row_id % 4 = 1")
    real, moved = forests.dealt, []
    monkeypatch.setattr(forests, "dealt", lambda *a, **k: moved.append(k["train"]) or real(*a, **k))
    found = []
    for trees, cells in ((1 << 26, 1 << 24), (0, 1 << 24), (1 << 26, 700)):
        monkeypatch.setattr(forests, "TREES", trees)
        monkeypatch.setattr(forests, "LOCAL_CELLS", cells)
        found.append({tuple(r) for r in forests.predictions(train, test, PARAMS, KEEP).collect()})
    assert found[0] == found[1] == found[2] and len(found[0]) == 75
    assert moved == [True, True, False, True]


def test_cuts_are_quantiles(spark, monkeypatch):
    """Of few rows exactly, of many to a thousandth of the ranks, in one pass for all elements."""
    rng = np.random.default_rng(9)
    few, many = (np.stack([rng.normal(size=n), rng.integers(0, 5, n) * 1.0, rng.exponential(size=n)], axis=1) for n in (700, 30_000))

    def refuse(*_):
        raise AssertionError("a sketch for each element")

    monkeypatch.setattr(F, "percentile_approx", refuse)
    for x, slack in ((few, 0), (many, 1e-3)):
        rows = [(v.tolist(),) for v in x] + ([([None, None, None],)] if not slack else [])
        found = forests.dense_cuts(spark.createDataFrame(rows, "vector array<double>").repartition(3), 3)
        for i, cuts in enumerate(found):
            own, shares = np.sort(x[:, i]), np.arange(1, forests.BINS) / forests.BINS
            if not slack:
                assert cuts.tolist() == np.unique(own[np.ceil(shares * len(own)).astype(int) - 1]).tolist()
            below, upto = np.searchsorted(own, cuts) / len(own), np.searchsorted(own, cuts, side="right") / len(own)
            assert all(((below <= s + slack) & (s <= upto + slack)).any() for s in shares)
