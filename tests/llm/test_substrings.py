"""Repeated bytes and words against sets of all windows."""

import hashlib
import random

import numpy as np
import pytest

from tests.llm.helpers import corpus, prose, table, words
from textlab.llm import minhash, repeats, suffix_array, suffix_tree
from textlab.llm.arrays import Anchors, Words, sliding_least


def brute(rows, size, by_word):
    seen, out = set(), {}
    for doc, text in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        tokens = words(text) if by_word else list((text or "").encode())
        gone = [False] * len(tokens)
        for i in range(len(tokens) - size + 1):
            window = tuple(tokens[i:i + size])
            if window in seen:
                gone[i:i + size] = [True] * size
            seen.add(window)
        left = [t for t, g in zip(tokens, gone) if not g]
        left = b" ".join(left) if by_word else bytes(left)
        runs = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out[doc] = (len(tokens), sum(gone), runs, left)
    return out


@pytest.mark.parametrize("shape", [suffix_array.SHAPE, repeats.Shape(12, 5, False)])
def test_bytes_equal_brute_force(spark, shape, monkeypatch):
    monkeypatch.setattr(suffix_array, "BUCKET_SUFFIXES", 40)  # many bucket boundaries
    rows = [r[:2] for r in corpus()] + [(None, corpus()[0][1])]
    docs = table(spark, rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 AS doc", "2 AS low")
    got = {r.doc_id: r for r in suffix_array.remove_repeated_bytes(docs, shape=shape, texts=True).collect()}
    want = brute(rows, shape.size, False)
    assert got.keys() == want.keys()
    for doc, (n, removed, runs, left) in want.items():
        r = got[doc]
        assert (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) == (n, removed, runs, left)
        assert r.kept_sha256 == hashlib.sha256(left).hexdigest()


@pytest.mark.parametrize("group", [8192, 3])
def test_words_equal_brute_force(spark, group, monkeypatch):
    monkeypatch.setattr(suffix_tree, "GROUP_SUFFIXES", group)  # with 3, prefixes grow to whole windows
    rows = [r[:2] for r in corpus()] + [(None, corpus()[0][1])]
    docs = table(spark, rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 AS key", "2 AS suffix")
    got = {r.doc_id: r for r in suffix_tree.remove_repeated_words(docs, texts=True).collect()}
    want = brute(rows, 20, True)
    assert got.keys() == want.keys()
    for doc, (n, removed, _, left) in want.items():
        r = got[doc]
        assert (r.n_words, r.n_removed, bytes(r.kept)) == (n, removed, left)
        assert r.kept_sha256 == hashlib.sha256(left).hexdigest()


def brute_places(rows, size, by_word):
    """``doc, length, removed, left`` of every row, where ids may repeat or be null."""
    nameless = sorted((t or "" for d, t in rows if d is None), key=lambda t: hashlib.sha256(t.encode()).hexdigest())
    placed = [((0, d), t) for d, t in rows if d is not None] + [((1, i), t) for i, t in enumerate(nameless)]
    split = lambda t: words(t) if by_word else list((t or "").encode())
    first, gone = {}, {}
    windows = [(tuple(tokens[i:i + size]), place, i) for place, t in placed for tokens in [split(t)] for i in range(len(tokens) - size + 1)]
    for window, place, i in windows:
        first[window] = min(first.get(window, (place, i)), (place, i))
    for window, place, i in windows:
        if first[window] != (place, i):
            gone.setdefault(place, set()).update(range(i, i + size))
    out = []
    for place, t in placed:
        tokens = split(t)
        left = [x for i, x in enumerate(tokens) if i not in gone.get(place, ())]
        out.append((str(None if place[0] else place[1]), len(tokens), len(tokens) - len(left), b" ".join(left) if by_word else bytes(left)))
    return sorted(out)


@pytest.mark.parametrize("by_word", [False, True])
@pytest.mark.parametrize("small", [8192, 3])
def test_repeated_and_null_ids_equal_brute_force(spark, by_word, small, monkeypatch):
    monkeypatch.setattr(suffix_array, "BUCKET_SUFFIXES", small)
    monkeypatch.setattr(suffix_tree, "GROUP_SUFFIXES", small)
    rng = random.Random(31)
    one, two, three, passage = prose(rng, 70), prose(rng, 90), prose(rng, 60), prose(rng, 30)
    rows = [(5, one), (5, one), (5, one), (7, two), (7, three + " " + passage), (3, passage), (9, one + " " + two), (9, "short")]
    rows += [(None, t) for t in (two, prose(rng, 80), prose(rng, 50) + " " + passage, prose(rng, 95), None, "")]
    rows += [(None, three + " " + prose(rng, 9))] + [(None, prose(random.Random(32), 77))] * 3
    docs = table(spark, rows, "doc_id long, text string", parts=5)
    find = suffix_tree.remove_repeated_words if by_word else suffix_array.remove_repeated_bytes
    got = sorted((str(r[0]), r[1], r["n_removed"], bytes(r.kept)) for r in find(docs, texts=True).collect())
    assert got == brute_places(rows, 20 if by_word else 100, by_word)


@pytest.mark.parametrize("by_word", [False, True])
@pytest.mark.parametrize("part_bytes", [1, 40, 1 << 23])
def test_few_rows_in_many_parts(spark, by_word, part_bytes, monkeypatch):
    """Most parts get no run."""
    monkeypatch.setattr(repeats, "PART_BYTES", part_bytes)
    find = suffix_tree.remove_repeated_words if by_word else suffix_array.remove_repeated_bytes
    one = prose(random.Random(5), 40)
    for texts in ([one], [one, one, "x " + one], ["short", None, one, one[10:], ""]):
        rows = list(enumerate(texts))
        got = sorted((str(r[0]), r[1], r["n_removed"], bytes(r.kept)) for r in find(table(spark, rows, "doc_id long, text string"), texts=True).collect())
        assert got == brute_places(rows, 20 if by_word else 100, by_word)


def thue_morse(n: int) -> list[bool]:
    return [bool(i.bit_count() & 1) for i in range(n)]


def test_built_words_do_not_collide(spark):
    """A polynomial hash modulo a power of two gives both words one value, for any odd base."""
    one = "".join("ab"[t] for t in thue_morse(2048))
    other = "".join("ba"[t] for t in thue_morse(2048))
    found = Words([f"{one} {other}".encode()])
    assert found.hash[0] != found.hash[1]
    rng = random.Random(7)
    rows = [(1, " ".join([one] * 20)), (2, " ".join([other] * 20)), (3, one), (4, other), (5, prose(rng, 50))]
    docs = table(spark, rows, "doc_id long, text string")
    for find, by_word in ((suffix_tree.remove_repeated_words, True), (suffix_array.remove_repeated_bytes, False)):
        got = sorted((str(r[0]), r[1], r["n_removed"], bytes(r.kept)) for r in find(docs, texts=True).collect())
        assert got == brute_places(rows, 20 if by_word else 100, by_word)
    assert all(r.kept for r in minhash.near_duplicates(docs).collect())


def test_repeated_ids_and_empty_tables(spark):
    docs = table(spark, [(1, "a b"), (1, "a b"), (2, None)], "doc_id long, text string")
    assert suffix_tree.remove_repeated_words(docs).count() == 3
    nothing = table(spark, [], "doc_id long, text string")
    assert suffix_array.remove_repeated_bytes(nothing).count() == 0
    assert suffix_tree.remove_repeated_words(nothing).count() == 0


def test_multikey_order_is_the_sorted_order():
    rng = np.random.default_rng(5)
    for width in (1, 3):
        keys = rng.integers(0, 3, (200, width)).astype(np.uint64)
        order, new = suffix_array.multikey_order(keys)
        rows = [tuple(k) for k in keys[order]]
        assert rows == sorted(rows) and sorted(order) == list(range(200))
        assert new.tolist() == [i == 0 or rows[i] != rows[i - 1] for i in range(200)]


def test_subtree_depths_and_nodes():
    rows = np.array([[1, 2, 3], [1, 2, 4], [0, 5, 5], [1, 2, 3]])
    order, depth = suffix_tree.subtree(rows)
    assert rows[order].tolist() == sorted(rows.tolist()) and depth.tolist() == [0, 0, 3, 2]
    assert suffix_tree.deep_nodes(depth, 3).tolist() == [0, 1, 1, 2]


def test_equal_windows_have_equal_anchors():
    rng = np.random.default_rng(2)
    tokens = rng.integers(0, 4, 400).astype(np.uint64)
    first = np.array([0, 150, 155, 400])
    found = Anchors(tokens, first, 10, 3)
    place = {}
    for text, at, low, high in zip(found.text, found.at, found.low, found.high):
        for p in range(low, high + 1):
            window = tuple(tokens[first[text] + p:first[text] + p + 10])
            assert place.setdefault(window, at - p) == at - p
    assert sum(found.high - found.low + 1) == sum(max(0, n - 9) for n in np.diff(first))


def test_words_and_sliding_least():
    texts = [b"ab  c\x0bd", b"", b" \n", b"\xc3\xa9 ab"]
    found = Words(texts)
    assert np.diff(found.first).tolist() == [3, 0, 0, 2]
    assert found.hash[0] == found.hash[4] and len(set(found.hash.tolist())) == 4
    values = np.array([5, 3, 4, 1, 2, 9])
    for width in range(1, 7):
        assert sliding_least(values, width).tolist() == [min(values[i:i + width]) for i in range(7 - width)]
