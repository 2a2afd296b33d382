"""Suffix-array deduplication of byte strings.

Suffixes begin at the anchors of texts that may repeat. Spark's sampled
splitters range-partition them by their leading bytes; a bucket sorts the
windows of its suffixes by multikey quicksort and finds equal neighbours. Windows
that agree with a bucket's least or greatest suffix may occur in the next bucket
too: those are compared once more across buckets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlab.llm.batches import materialised
from textlab.llm.repeats import Shape, kept_texts, keyed, later_places, later_windows, repeated_spans

#: Strings of 100 bytes; a third of them is enough of an anchor to be rare.
SHAPE = Shape(size=100, gram=50, words=False)
BUCKET_SUFFIXES = 8_192


def multikey_order(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of rows of ``keys`` (unsigned numbers), and which rows differ from the one before.

    Multikey quicksort: rows are partitioned by one key at a time, and only
    groups that are still equal go on to the next key. All open groups of a
    round are partitioned together.
    """
    n, width = keys.shape
    order = np.arange(n)
    new = np.zeros(n, dtype=bool)
    if n:
        new[0] = True
    open_rows = np.arange(n) if n > 1 else np.zeros(0, dtype=int)  # places in ``order``
    for column in range(width):
        if not len(open_rows):
            break
        group = np.cumsum(new)[open_rows]
        value = keys[order[open_rows], column]
        by = np.lexsort((value, group))
        order[open_rows] = order[open_rows][by]
        value, group = value[by], group[by]
        new[open_rows[1:]] |= (value[1:] != value[:-1]) | (group[1:] != group[:-1])
        alone = new[open_rows] & np.append(new[open_rows[1:]] | (group[1:] != group[:-1]), True)
        open_rows = open_rows[~alone]
    return order, new


def bucket_windows(suffixes: list[bytes], before: list[bytes], windows: np.ndarray, size: int) -> np.ndarray:
    """The windows of every segment as rows of big-endian numbers, in order."""
    data = np.frombuffer(b"".join(x for pair in zip(before, suffixes) for x in pair), np.uint8)
    starts = np.concatenate([[0], np.cumsum(windows + size - 1)[:-1]]).astype(np.int64)
    within = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
    rows = np.lib.stride_tricks.sliding_window_view(data, size)[np.repeat(starts, windows) + within]
    padded = np.zeros((len(rows), -(-size // 8) * 8), np.uint8)
    padded[:, :size] = rows
    return padded.view(">u8").astype(np.uint64)


def shared_prefixes(texts: list[bytes], other: bytes, most: int) -> np.ndarray:
    """How many bytes, up to ``most``, each text and ``other`` begin with in common."""
    rows = np.frombuffer(b"".join(t[:most].ljust(most, b"\0") for t in texts), np.uint8).reshape(-1, most)
    differ = rows != np.frombuffer(other[:most].ljust(most, b"\0"), np.uint8)
    return np.where(differ.any(axis=1), differ.argmax(axis=1), most)


def runs_of(doc: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last places of neighbouring windows, for rows sorted by document and start."""
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (low[1:] > low[:-1] + 1)
    first = np.flatnonzero(new)
    return first, np.append(first[1:], len(doc))[: len(first)] - 1


def sorted_buckets(segments: DataFrame, shape: Shape) -> DataFrame:
    """Spans of windows that start earlier in the same bucket (``digest`` null), and with
    their digest the first windows that a neighbouring bucket may hold as well."""
    size = shape.size

    def bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        doc, low = table.column("doc").to_numpy(), table.column("low").to_numpy()
        windows = table.column("windows").to_numpy().astype(np.int64)
        before, suffix = table.column("before").to_pylist(), table.column("suffix").to_pylist()
        # What another bucket's suffix shares with one of these, it shares with the least or the greatest.
        reach = np.maximum(shared_prefixes(suffix, min(suffix), size), shared_prefixes(suffix, max(suffix), size))
        keys = bucket_windows(suffix, before, windows, size)
        segment = np.repeat(np.arange(len(doc)), windows)
        within = np.arange(len(segment)) - np.repeat(np.cumsum(windows) - windows, windows)
        start = low[segment] + within
        order, new = multikey_order(keys)
        group = np.cumsum(new) - 1
        # The first place of every group of equal windows.
        by = np.lexsort((start[order], doc[segment[order]], group))
        heads = np.append(True, group[by][1:] != group[by][:-1])
        by = order[by]
        first = np.zeros(len(order), dtype=bool)
        first[by[heads]] = True
        later = by[later_places(heads, doc[segment[by]], start[by])]
        later = later[np.lexsort((start[later], doc[segment[later]]))]
        a, b = runs_of(doc[segment[later]], start[later])
        spans = [doc[segment[later[a]]], start[later[a]], start[later[b]] + size]
        # A window has so many bytes from the anchor on.
        right = size - np.array([len(x) for x in before])[segment] + within
        edge = np.flatnonzero(first & (reach[segment] >= right))
        raw = keys[edge].astype(">u8").tobytes()
        step = keys.shape[1] * 8
        digests = [hashlib.blake2b(raw[i * step:(i + 1) * step], digest_size=16).digest() for i in range(len(edge))]
        yield pa.RecordBatch.from_arrays([
            pa.array(np.concatenate([spans[0], doc[segment[edge]]])), pa.array(np.concatenate([spans[1], start[edge]])),
            pa.array(np.concatenate([spans[2], start[edge] + size])),
            pa.array([None] * len(a) + digests, pa.binary()),
        ], names=["doc", "low", "high", "digest"])

    buckets = max(1, -(-segments.count() // BUCKET_SUFFIXES))
    ranged = segments.repartitionByRange(buckets, "suffix", "doc", "low")
    return ranged.mapInArrow(bucket, "doc long, low long, high long, digest binary")


def repeated_windows(segments: DataFrame, shape: Shape) -> DataFrame:
    found = materialised(sorted_buckets(segments, shape), "buckets")
    within = found.where("digest IS NULL").select("doc", "low", "high")
    return within.unionByName(later_windows(found.where("digest IS NOT NULL").drop("high"), shape.size))


def remove_repeated_bytes(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shape: Shape = SHAPE, texts: bool = False
) -> DataFrame:
    """Remove every byte that a string of ``shape.size`` bytes covers which also starts earlier.

    Earlier means in a document of smaller id, or before in the same one; strings
    are judged on the input. Returns ``doc_id, n_bytes, n_removed, n_spans,
    kept_sha256`` and, with ``texts``, ``kept`` (bytes: a cut may split a character).

    One row per row of ``docs``. A null text is empty; rows with a null id come
    after all others, each in a place of its own, in the order of a digest of
    their text. Texts shorter than a string lose nothing. Ids should be unique:
    rows that repeat an id are one place, so equal strings at equal starts don't
    count as earlier than each other (equal texts both stay), and all lose what
    any of them does. An empty table gives an empty result.
    """
    docs, last, parts = keyed(docs, id_col, text_col)
    spans = repeated_spans(docs, shape, repeated_windows, parts)
    return kept_texts(docs, spans, shape, last, texts).select(
        "doc_id", F.col("n_tokens").alias("n_bytes"), "n_removed", "n_spans", "kept_sha256", *["kept"] * texts
    )
