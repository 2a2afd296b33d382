"""Near-duplicates against all pairs of full sets."""

import itertools
import math

import numpy as np

from tests.llm.helpers import corpus, table
from textlab.llm import minhash
from textlab.llm.components import components


def shingles(text) -> set:
    w = [x for x in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").translate(
        dict.fromkeys([9, 10, 11, 12, 13], " ")).split(" ") if x]
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_components_equal_all_pairs(spark):
    rows = [r[:2] for r in corpus()]
    docs = table(spark, [*rows, (None, rows[0][1])], "doc_id long, text string").selectExpr("doc_id", "text", "'x' AS set_id", "1 AS a")
    got = {r.doc_id: r for r in minhash.near_duplicates(docs).collect()}
    sets = {d: shingles(t) for d, t in rows}
    smallest = {d: d for d in sets}
    changed = True
    links = [(a, b) for a, b in itertools.combinations(sets, 2)
             if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            low = min(smallest[a], smallest[b])
            changed |= smallest[a] != low or smallest[b] != low
            smallest[a] = smallest[b] = low
    assert len(links) > 20
    for d, s in sets.items():
        assert (got[d].n_shingles, got[d].component_id, got[d].kept) == (len(s), smallest[d], smallest[d] == d)
    assert got[None].component_id is None and got[None].kept


def test_repeated_ids_and_an_empty_table(spark):
    docs = table(spark, [(1, "a b c"), (1, "a b c"), (2, "A b\tc"), (3, None)], "doc_id long, text string")
    got = sorted(tuple(r) for r in minhash.near_duplicates(docs).collect())
    assert got == [(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True)]
    assert minhash.near_duplicates(docs.limit(0)).count() == 0


def test_a_chain_is_one_component(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in components(chain).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_least_matches_keeps_the_miss_probability():
    for n in (16, 64, 128):
        m = minhash.least_matches(n)
        lost = sum(math.comb(n + 1, k) * 0.75**k * 0.25 ** (n + 1 - k) for k in range(m))
        assert lost < minhash.MISS and m > 0 or n == 16


def test_edited_copies_of_a_large_group_are_not_compared_in_pairs(spark, monkeypatch):
    """Copies that share their edits with others, but too few with any one of them."""
    rng = np.random.default_rng(5)
    texts = []
    for _ in range(60):
        words = [f"w{i}" for i in range(200)]
        for p in rng.choice(33, 7, replace=False) * 6:
            words[p] = f"x{p}"
        texts.append(" ".join(words))
    sets = minhash.shingle_sets([t.encode() for t in texts])
    alike = sum(
        len(np.intersect1d(a, b)) * 100 >= 75 * len(np.union1d(a, b)) for i, a in enumerate(sets) for b in sets[:i])
    compared, pruned = [], minhash.bayes_pruned

    def counted(pairs):
        compared.append(pairs.count())
        return pruned(pairs)

    monkeypatch.setattr(minhash, "bayes_pruned", counted)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    minhash.near_duplicates(docs).collect()
    assert sum(compared) <= 2 * alike + 60  # of 1,770 pairs


def test_sketches_differ_in_no_more_bits_than_sets_in_shingles():
    rng = np.random.default_rng(6)
    sets = [np.unique(rng.integers(0, 500, n).astype(np.uint64)) for n in (0, 1, 40, 300, 4000)]
    odd = minhash.odd_sketches(sets)
    for a, x in zip(sets, odd):
        for b, y in zip(sets, odd):
            assert sum(int(w).bit_count() for w in (x ^ y).view(np.uint64)) <= len(np.setxor1d(a, b))


def test_shingles_of_one_set_only_are_counted(spark):
    few = [np.array(x, dtype=np.uint64).tobytes() for x in ([1, 2, 3], [3, 4], [5], [])]
    sets = spark.createDataFrame([(i, bytearray(x)) for i, x in enumerate(few)], "doc long, shingles binary").coalesce(1)
    own = minhash.shared_counts(sets, 3)
    assert {tuple(r) for r in own.collect()} == {(0, 2), (1, 1), (2, 1)}
