"""Text expressions: matching, masking, tokenising and chunking.

Term and phrase lists are plain Python lists: they are user parameters that
become literals of the plan, like a regular expression would.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every character that separates words (Unicode white space).
WHITESPACE = r"[\t-\r\x1C-\x20\x{85}\p{Z}]+"
# A word; parts joined by - . / _ form one token, which is not alphanumeric.
WORD = r"[\p{L}\p{N}\p{M}]+(?:[-./_][\p{L}\p{N}\p{M}]+)*"
ALPHANUMERIC = r"^[\p{L}\p{N}]+$"

_REGEX_SPECIAL = re.compile(r"([\\.^$|?*+()\[\]{}\-&#~ ])")


def quote(term: str) -> str:
    """Quote a term for a regular expression."""
    return _REGEX_SPECIAL.sub(r"\\\1", term).replace("\n", r"\n").replace("\t", r"\t")


def post_text(title: Column, body: Column) -> Column:
    """Lower-cased title and body, the text that phrases are looked up in."""
    return F.concat(F.lower(title), F.lit(" "), F.lower(body))


def document_text(title: Column, body: Column) -> Column:
    """Title and body as one document."""
    return F.concat(title, F.lit("\n"), body)


def _any(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def match_any(text: Column, phrases: Sequence[str]) -> Column:
    """True if any phrase is a substring of the text; empty phrases are skipped."""
    return _any([text.contains(p) for p in phrases if p])


def count_occurrences(text: Column, phrase: str) -> Column:
    """Number of non-overlapping occurrences of a phrase."""
    shorter = F.length(F.replace(text, F.lit(phrase), F.lit("")))
    return ((F.length(text) - shorter) / F.lit(len(phrase))).cast("int")


def match_near(
    text: Column,
    triggers: Sequence[str],
    rejects: Sequence[str],
    conditions: Sequence[str],
    window: int = 80,
) -> Column:
    """True if no reject phrase occurs and a condition term lies near a trigger.

    For a trigger starting at ``i`` the context is ``[i - window, i + window)``
    with every non-letter read as a space; a condition term must lie wholly in
    the context of some occurrence. All of it is one regular expression, which
    stops at the first match: a look-ahead finds the trigger, then the term is
    searched to its right or, from inside a look-behind, to its left.
    """
    triggers = [t for t in triggers if t]
    # A term with anything but letters and spaces cannot occur in a context.
    usable = [
        c for c in conditions
        if c and len(c) <= 2 * window and all(x.isalpha() or x == " " for x in c)
    ]
    if not triggers or not usable:
        return F.lit(False) & text.isNotNull()
    near = []
    for term in usable:
        body = "".join(r"[^\p{L}]" if x == " " else quote(x) for x in term)
        if len(term) <= window:
            near.append(rf"(?=.{{0,{window - len(term)}}}{body})")
        # A start m to the left fits while the end stays inside the context.
        least = max(1, len(term) - window)
        near.append(rf"(?<=(?={body}).{{{least},{window}}})")
    start = "|".join(quote(t) for t in triggers)
    pattern = rf"(?s)(?=(?:{start}))(?:{'|'.join(near)})"
    # The cheap substring tests come first and spare most texts the regex.
    return ~match_any(text, rejects) & match_any(text, triggers) & text.rlike(pattern)


def phrase_positions(text: Column, phrase: str) -> Column:
    """The 1-based positions of a phrase in a text, in order; occurrences don't overlap."""
    parts = F.split(text, rf"\Q{phrase}\E", -1)
    before = lambda i: F.aggregate(F.slice(parts, 1, i + 1), F.lit(0), lambda n, x: n + F.length(x))
    places = F.sequence(F.lit(0), F.size(parts) - 2)
    return F.when(F.size(parts) > 1, F.transform(places, lambda i: before(i) + i * F.lit(len(phrase)) + 1)).otherwise(
        F.array().cast("array<int>"))


def context_window(text: Column, position: Column, window: int = 80) -> Column:
    """The context round a 1-based position, every non-letter read as a space."""
    first = F.greatest(position - F.lit(window), F.lit(1))
    cut = F.substring(text, first, position + F.lit(window) - first)
    return F.regexp_replace(cut, r"[^\p{L}]", " ")


def mask_pattern(terms: Sequence[str], order: str = "shortest") -> str:
    """The regular expression of :func:`mask_terms`.

    Alternatives are tried in order, so with ``shortest`` the text "a b c" under
    the terms "a b" and "a b c" keeps " c"; ``longest`` removes all of it.
    """
    if order not in ("shortest", "longest"):
        raise ValueError("order must be 'shortest' or 'longest'")
    sign = 1 if order == "shortest" else -1
    unique = sorted({t.strip() for t in terms} - {""}, key=lambda t: (sign * len(t), t))
    return rf"(?iuU)\b(?:{'|'.join(quote(t) for t in unique)})\b" if unique else ""


def mask_terms(text: Column, terms: Sequence[str], order: str = "shortest") -> Column:
    """Delete whole-word, case-insensitive occurrences; spacing is untouched."""
    pattern = mask_pattern(terms, order)
    return F.regexp_replace(text, pattern, "") if pattern else text


def _words(text: Column, separator: str) -> Column:
    return F.filter(F.split(text, separator), lambda w: w != "")


def letters_tokens(text: Column) -> Column:
    """Runs of ASCII letters, lower-cased."""
    return _words(F.lower(F.regexp_replace(text, "[^a-zA-Z]+", " ")), " ")


def whitespace_words(text: Column) -> Column:
    """Words between white space."""
    return _words(text, WHITESPACE)


def word_count(text: Column) -> Column:
    """Number of words between white space."""
    return F.size(whitespace_words(text))


def alnum_tokens(text: Column, stop_words: Sequence[str] = ()) -> Column:
    """Lower-cased alphanumeric words without stop words; repeats are kept.

    Contractions are cut at the apostrophe. A compound such as "well-known" is
    one token and is dropped, since it is not alphanumeric.
    """
    tokens = F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))
    stops = list(stop_words)
    if not stops:
        return F.filter(tokens, lambda w: w.rlike(ALPHANUMERIC))
    return F.filter(tokens, lambda w: ~w.isin(stops) & w.rlike(ALPHANUMERIC))


def vectorizer_tokens(tokens: Column) -> Column:
    """Tokens of two characters or more."""
    return F.filter(tokens, lambda w: F.length(w) >= 2)


def chunk_words(
    text: Column, size: int = 200, limit: int = 256, drop_empty_tail: bool = False
) -> Column:
    """Split a text into chunks of ``size`` words.

    A text of fewer than ``limit`` words is one chunk, unchanged. Otherwise
    there are ``words // size + 1`` chunks; the last is empty when the word
    count is a multiple of ``size``, unless ``drop_empty_tail`` is set.
    """

    def cut(words: Column) -> Column:
        rest = 1 if drop_empty_tail else 0
        last = F.floor((F.size(words) - rest) / F.lit(size)).cast("int")
        chunks = F.transform(
            F.sequence(F.lit(0), last),
            lambda i: F.array_join(F.slice(words, i * size + 1, F.lit(size)), " "),
        )
        return F.when(F.size(words) < limit, F.array(text)).otherwise(chunks)

    # The words are bound to a variable, so a text is split once, not per chunk.
    return F.get(F.transform(F.array(whitespace_words(text)), cut), F.lit(0))
