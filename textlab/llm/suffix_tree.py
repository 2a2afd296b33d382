"""Substring deduplication of word sequences by prefix-partitioned suffix trees.

Suffixes begin at the anchors of texts that may repeat, and are split by a prefix
of variable length: an anchor's words where its suffixes fit into memory
together, and a whole window where they don't. A group's subtree is built
locally in array form, from sorted suffixes and the depths at which neighbours
part. Its deep internal nodes are the repeats.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlab.llm.repeats import Shape, kept_texts, keyed, later_places, later_windows, repeated_spans
from textlab.llm.suffix_array import runs_of
from textlab.session import written

SHAPE = Shape(size=20, gram=6, words=True)
GROUP_SUFFIXES = 8_192  # segments whose windows fit into a task's memory with ease


def subtree(suffixes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A suffix tree in array form: the order of the suffixes (rows of word numbers),
    and how many words each shares with the one before."""
    order = np.lexsort(suffixes.T[::-1]) if len(suffixes) else np.zeros(0, dtype=int)
    ordered = suffixes[order]
    differ = ordered[1:] != ordered[:-1]
    depth = np.where(differ.any(axis=1), differ.argmax(axis=1), suffixes.shape[1])
    return order, np.append(0, depth)[: len(order)]


def deep_nodes(depth: np.ndarray, least: int) -> np.ndarray:
    """For every leaf, in order, the number of the highest node at least ``least`` deep
    that it hangs under; leaves under none have a number of their own."""
    return np.cumsum(depth < least) - 1


def windows_of(before: list[bytes], suffix: list[bytes], windows: np.ndarray, size: int) -> np.ndarray:
    """The windows of every segment as rows of word numbers."""
    words = [w for pair in zip(before, suffix) for x in pair for w in x.split()]
    numbers: dict[bytes, int] = {}
    coded = np.array([numbers.setdefault(w, len(numbers)) for w in words], dtype=np.int32)
    starts = np.concatenate([[0], np.cumsum(windows + size - 1)[:-1]]).astype(np.int64)
    within = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
    return np.lib.stride_tricks.sliding_window_view(coded, size)[np.repeat(starts, windows) + within]


def tree_repeats(segments: DataFrame, shape: Shape) -> DataFrame:
    """Spans of windows that also start earlier, for groups that fit into memory."""
    size = shape.size
    bins = max(1, -(-segments.count() // GROUP_SUFFIXES))

    def grow(table: pa.Table) -> pa.Table:
        doc, low = table.column("doc").to_numpy(), table.column("low").to_numpy()
        windows = table.column("windows").to_numpy().astype(np.int64)
        leaves = windows_of(table.column("before").to_pylist(), table.column("suffix").to_pylist(), windows, size)
        segment = np.repeat(np.arange(len(doc)), windows)
        start = low[segment] + np.arange(len(segment)) - np.repeat(np.cumsum(windows) - windows, windows)
        order, depth = subtree(leaves)
        node = deep_nodes(depth, size)
        by = np.lexsort((start[order], doc[segment[order]], node))
        heads = np.append(True, node[by][1:] != node[by][:-1])
        by = order[by]
        later = by[later_places(heads, doc[segment[by]], start[by])]
        later = later[np.lexsort((start[later], doc[segment[later]]))]
        a, b = runs_of(doc[segment[later]], start[later])
        return pa.table({"doc": doc[segment[later[a]]], "low": start[later[a]], "high": start[later[b]] + size})

    return segments.groupBy(F.pmod(F.xxhash64("key"), F.lit(bins)).alias("bin")).applyInArrow(
        grow, "doc long, low long, high long"
    )


def whole_windows(segments: DataFrame, shape: Shape) -> DataFrame:
    """``digest, doc, low``: every window of the segments by itself."""
    size = shape.size

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, docs, lows = [], [], []
            columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("doc", "low", "before", "suffix")]
            for doc, low, before, suffix in zip(*columns):
                words = before.split() + suffix.split()
                for i in range(len(words) - size + 1):
                    digests.append(hashlib.blake2b(b" ".join(words[i:i + size]), digest_size=16).digest())
                    docs.append(doc)
                    lows.append(low + i)
            yield pa.RecordBatch.from_arrays(
                [pa.array(digests, pa.binary()), pa.array(docs, pa.int64()), pa.array(lows, pa.int64())],
                names=["digest", "doc", "low"],
            )

    return segments.mapInArrow(split, "digest binary, doc long, low long")


def repeated_windows(segments: DataFrame, shape: Shape) -> DataFrame:
    # Prefixes with more suffixes than a task should hold: at most one for GROUP_SUFFIXES segments.
    long = written(
        segments.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > GROUP_SUFFIXES).select("key"), "prefixes"
    )
    within = tree_repeats(segments.join(long, "key", "left_anti"), shape)
    return within.unionByName(later_windows(whole_windows(segments.join(long, "key", "left_semi"), shape), shape.size))


def remove_repeated_words(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shape: Shape = SHAPE, texts: bool = False
) -> DataFrame:
    """Remove every word that a window of ``shape.size`` words covers which also starts earlier.

    Words are what white space separates, unchanged. Earlier means in a document
    of smaller id, or before in the same one; windows are judged on the input.
    Returns ``doc_id, n_words, n_removed, kept_sha256`` and, with ``texts``,
    ``kept``, the words that are left joined by one space.

    One row per row of ``docs``. A null text has no words; rows with a null id
    come after all others, each in a place of its own, in the order of a digest
    of their text. Texts shorter than a window lose nothing. Ids should be unique:
    rows that repeat an id are one place, so equal windows at equal starts don't
    count as earlier than each other (equal texts both stay), and all lose what
    any of them does. An empty table gives an empty result.
    """
    docs, last, parts = keyed(docs, id_col, text_col)
    spans = repeated_spans(docs, shape, repeated_windows, parts)
    return kept_texts(docs, spans, shape, last, texts).select(
        "doc_id", F.col("n_tokens").alias("n_words"), "n_removed", "kept_sha256", *["kept"] * texts
    )
