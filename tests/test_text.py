"""Matching, masking, tokenising and chunking, against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from textlab.functions import text as T


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "text string").select(column(F.col("text"))).first()[0]


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("red oak tree", " tree"),          # "red oak" is tried before "red oak tree"
        ("RED OAK!", "!"),                  # any case, punctuation stays
        ("red oaks", "red oaks"),           # no part of a longer word
        ("éred oak", "éred oak"),           # a letter in front is no boundary
        ("a pine, b", "a , b"),             # spacing is untouched
        ("x\nred oak\ny", "x\n\ny"),
        ("c++ code", "c++ code"),           # no word boundary after a sign
    ],
)
def test_mask_shortest_first(spark, text, expected):
    terms = ["red oak tree", "red oak", "pine", " ", "", "c++"]
    assert one(spark, text, lambda c: T.mask_terms(c, terms)) == expected


def test_mask_longest_first_and_twice(spark):
    terms = ["red oak tree", "red oak"]
    assert one(spark, "red oak tree", lambda c: T.mask_terms(c, terms, "longest")) == ""
    once = one(spark, "the Red Oak tree of red oak", lambda c: T.mask_terms(c, terms))
    assert one(spark, once, lambda c: T.mask_terms(c, terms)) == once
    assert one(spark, "as is", lambda c: T.mask_terms(c, [])) == "as is"
    with pytest.raises(ValueError):
        T.mask_pattern(terms, "random")


def near(text, triggers, rejects, conditions, window):
    """All places of all triggers, contexts by slicing."""
    if any(r in text for r in rejects):
        return False
    for trigger in triggers:
        at = text.find(trigger)
        while at >= 0:
            context = text[max(0, at - window):at + window]
            letters = "".join(x if x.isalpha() else " " for x in context)
            if any(c in letters for c in conditions):
                return True
            at = text.find(trigger, at + 1)
    return False


def test_match_near_equals_brute_force(spark):
    rng = random.Random(7)
    texts = ["".join(rng.choice("ab.é ") for _ in range(rng.randint(0, 60))) for _ in range(600)]
    # The condition at each distance from a trigger, on both sides.
    texts += ["q" * a + "aab" + "." * d + "b é" for a in (0, 3) for d in range(20)]
    texts += ["b é" + "." * d + "aab" for d in range(20)]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for window in (5, 9):
        triggers, rejects, conditions = ["aab", "aa"], ["bbb"], ["b é", "b  a", "x-y"]
        got = df.select("text", T.match_near(F.col("text"), triggers, rejects, conditions, window).alias("m"))
        for row in got.collect():
            assert row["m"] == near(row["text"], triggers, rejects, conditions, window), row["text"]


def test_match_any_skips_blank_phrases(spark):
    assert one(spark, "abc", lambda c: T.match_any(c, ["", "x"])) is False
    assert one(spark, "abc", lambda c: T.match_any(c, ["", "bc"])) is True


def test_context_window(spark):
    text = "0123456789 ab-cd"
    got = one(spark, text, lambda c: T.context_window(c, F.locate("ab", c), 4))
    assert got == "".join(x if x.isalpha() else " " for x in text[7:15])


def test_words_are_those_of_python_split(spark):
    text = " a\tb c d\x0be\x1cf\x85g　h  i\r\n"
    assert one(spark, text, T.whitespace_words) == text.split()
    assert one(spark, "  \n", T.word_count) == 0


def test_alnum_tokens(spark):
    text = "The well-known cat's 3 cafés, a_b v1.2 don't THE e2e"
    got = one(spark, text, lambda c: T.alnum_tokens(c, ["the"]))
    assert got == ["cat", "s", "3", "cafés", "don", "t", "e2e"]
    kept = one(spark, text, lambda c: T.vectorizer_tokens(T.alnum_tokens(c, ["the"])))
    assert kept == ["cat", "cafés", "don", "e2e"]


def test_letters_tokens(spark):
    assert one(spark, "It's 2x Éa-B", T.letters_tokens) == ["it", "s", "x", "a", "b"]
    assert one(spark, "12 34", T.letters_tokens) == []


@pytest.mark.parametrize("n", [0, 1, 255, 256, 399, 400, 401, 600])
def test_chunks(spark, n):
    words = [f"w{i}" for i in range(n)]
    text = "  ".join(words)
    got = one(spark, text, T.chunk_words)
    if n < 256:
        assert got == [text]
    else:
        assert len(got) == n // 200 + 1
        assert got == [" ".join(words[i * 200:(i + 1) * 200]) for i in range(n // 200 + 1)]
        tidy = one(spark, text, lambda c: T.chunk_words(c, drop_empty_tail=True))
        assert tidy == [c for c in got if c]


def test_count_occurrences(spark):
    assert one(spark, "aaaa ab", lambda c: T.count_occurrences(c, "aa")) == 2
