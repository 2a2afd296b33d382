"""Long lists of phrases, from a table.

Lists of a few phrases are literals of a plan (see ``functions.text``). A table
of them becomes automata: a task reads each text once, whatever the number of
phrases. Tables are taken in parts of bounded size, one automaton each.
"""

from __future__ import annotations

import uuid
from bisect import bisect_left
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textlab.session import written

PART_CHARS = 8_000_000  # characters of the phrases that one automaton holds
WORD_SIGN = regex.compile(r"\w")


def listed(phrases: DataFrame, column: str = "term") -> Iterator[list[str]]:
    """The distinct phrases but empty ones, in parts of at most ``PART_CHARS`` characters (or one phrase)."""
    held, size = [], 0
    for row in phrases.select(column).where(F.col(column) != "").distinct().toLocalIterator():
        if held and size + len(row[0]) > PART_CHARS:
            yield held
            held, size = [], 0
        held.append(row[0])
        size += len(row[0])
    if held:
        yield held


def automaton(phrases: Sequence[str]) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for number, phrase in enumerate(phrases):
        found.add_word(phrase, (number, len(phrase)))
    found.make_automaton()
    return found


_built: dict[str, object] = {}


class Sent:
    """A broadcast list, and what a worker builds of it once for all of its tasks."""

    def __init__(self, spark: SparkSession, value, build: Callable):
        self.key, self.build, self.broadcast = uuid.uuid4().hex, build, spark.sparkContext.broadcast(value)

    def built(self):
        if self.key not in _built:
            _built.clear()
            _built[self.key] = self.build(self.broadcast.value)
        return _built[self.key]


def occurrences(docs: DataFrame, phrases: DataFrame, column: str = "term") -> DataFrame:
    """``doc_id, term, n``: the phrases in every text of ``docs(doc_id, text)``, and how often.

    As with :func:`~textlab.operators.lexicon.term_pairs` on lower-cased texts:
    phrases are substrings, and occurrences of one phrase don't overlap.
    """

    def search(part: list[str]) -> DataFrame:
        sent = Sent(docs.sparkSession, part, automaton)

        def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = sent.built()
            for batch in batches:
                rows, terms, counts = [], [], []
                for i, text in enumerate(batch.column(1).to_pylist()):
                    counted: dict[int, list[int]] = {}
                    if text and len(known):
                        for end, (number, length) in known.iter(text):
                            own = counted.setdefault(number, [0, -1])
                            if end - length >= own[1]:  # begins after the last one that counted
                                own[:] = own[0] + 1, end
                    rows += [i] * len(counted)
                    terms += [sent.broadcast.value[number] for number in counted]
                    counts += [n for n, _ in counted.values()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(terms, pa.string()), pa.array(counts, pa.int32())],
                    names=["doc_id", "term", "n"])

        return docs.select("doc_id", F.lower("text").alias("text")).mapInArrow(find, "doc_id long, term string, n int")

    found = [search(part) for part in listed(phrases, column)]
    if not found:
        return docs.sparkSession.createDataFrame([], "doc_id long, term string, n int")
    return reduce(DataFrame.unionByName, found)


def holding_any(docs: DataFrame, phrases: DataFrame, text: str = "text", column: str = "term") -> DataFrame:
    """The rows of ``docs`` whose text holds a phrase of the table; the search of a text ends at the first."""
    parts = list(listed(phrases, column))
    schema = docs.schema
    names = schema.fieldNames()
    place = names.index(text)

    def keep(rows: DataFrame, part: list[str], wanted: bool) -> DataFrame:
        sent = Sent(docs.sparkSession, part, automaton)

        def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = sent.built()
            for batch in batches:
                hit = [bool(t) and next(known.iter(t), None) is not None for t in batch.column(place).to_pylist()]
                yield batch.filter(pa.array([h is wanted for h in hit], pa.bool_()))

        return rows.mapInArrow(find, schema)

    if not parts:
        return docs.limit(0)
    found, rest = [], docs
    for part in parts:  # what one part does not find is left to the next
        found.append(keep(rest, part, True))
        rest = written(keep(rest, part, False), "rest") if part is not parts[-1] else rest
    return reduce(DataFrame.unionByName, found)


def folded(text: str) -> str:
    """A text of the same length that is equal for texts that differ in case only."""
    low = text.lower()
    if len(low) == len(text) and low.isascii():
        return low

    def one(sign: str) -> str:
        up = sign.upper()
        up = up if len(up) == 1 else sign
        return up.lower() if len(up.lower()) == 1 else up

    return "".join(map(one, text))


def boundaries(text: str) -> Callable[[int], bool]:
    """Whether a word begins or ends before a place of the text."""

    def inside(i: int) -> bool:
        return 0 <= i < len(text) and WORD_SIGN.match(text[i]) is not None

    return lambda i: inside(i - 1) != inside(i)


def masked(text: str, known: ahocorasick.Automaton, sign: int) -> str:
    """The text without whole-word occurrences; of those that begin at one place the shortest
    (``sign`` 1) or the longest goes, and the search goes on behind it."""
    edge, places = boundaries(text), []
    for end, (_, length) in known.iter(folded(text)):
        first = end - length + 1
        if edge(first) and edge(end + 1):
            places.append((first, sign * length, end + 1))
    if not places:
        return text
    out, at = [], 0
    for first, _, end in sorted(places):
        if first >= at:
            out.append(text[at:first])
            at = end
    return "".join(out) + text[at:]


def mask_with_table(docs: DataFrame, phrases: DataFrame, order: str = "shortest", column: str = "term") -> DataFrame:
    """``doc_id, text`` without the phrases of the table, as :func:`~textlab.functions.text.mask_terms`
    does it for a list. The table must fit into one automaton (``PART_CHARS``): which phrase goes
    depends on all of them."""
    if order not in ("shortest", "longest"):
        raise ValueError("order must be 'shortest' or 'longest'")
    trimmed = phrases.select(F.trim(column).alias("term"))
    parts = list(listed(trimmed))
    if len(parts) > 1:
        raise ValueError(f"the phrases have more than {PART_CHARS} characters")
    if not parts:
        return docs.select("doc_id", "text")
    sent = Sent(docs.sparkSession, sorted({folded(p) for p in parts[0]}), automaton)
    sign = 1 if order == "shortest" else -1

    def mask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.built()
        for batch in batches:
            texts = [t if t is None else masked(t, known, sign) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return docs.select("doc_id", "text").mapInArrow(mask, "doc_id long, text string")


def near_table(
    docs: DataFrame, triggers: DataFrame, rejects: DataFrame, conditions: DataFrame, window: int = 80, column: str = "term"
) -> DataFrame:
    """``doc_id`` of the texts without a reject phrase in which a condition term lies near a trigger,
    as :func:`~textlab.functions.text.match_near` finds them for lists."""
    texts = docs.select("doc_id", "text")
    some = list(listed(triggers, column)), list(listed(conditions, column))
    if not all(some):
        return texts.select("doc_id").limit(0)
    if len(some[0]) > 1 or len(some[1]) > 1:
        raise ValueError(f"the phrases have more than {PART_CHARS} characters")
    # A term with anything but letters and spaces cannot occur in a context.
    usable = [c for c in some[1][0] if len(c) <= 2 * window and all(x.isalpha() or x == " " for x in c)]
    sent = Sent(docs.sparkSession, (some[0][0], usable), lambda lists: tuple(map(automaton, lists)))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, terms = sent.built()
        letters = regex.compile(r"[^\p{L}]")
        for batch in batches:
            hits = []
            for text in batch.column(1).to_pylist():
                places = sorted({end - n + 1 for end, (_, n) in starts.iter(text)}) if text and len(starts) else []
                hit = False
                if places and len(terms):
                    for end, (_, n) in terms.iter(letters.sub(" ", text)):
                        # In the context of a trigger at a place from here on, which goes back no further.
                        at = bisect_left(places, end + 1 - window)
                        if at < len(places) and places[at] <= end - n + 1 + window:
                            hit = True
                            break
                hits.append(hit)
            yield batch.select(["doc_id"]).filter(pa.array(hits, pa.bool_()))

    found = texts.mapInArrow(find, "doc_id long")
    rejected = holding_any(texts, rejects, column=column).select("doc_id")
    return found.join(rejected, "doc_id", "left_anti")
