"""What the two substring operators share: candidates, segments and removal.

All windows of a fixed number of tokens are judged, but hardly any is moved.
Every task cuts its texts into runs of windows with a common content-defined
anchor (see :class:`~textlab.llm.arrays.Anchors`) and sends two hashes and a
position per run. Runs of equal content need no more: all but the first are
covered. Only the first runs of different content around one anchor (*edges*)
may share some windows and not others; their texts are fetched, and the operator
decides by its own method.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlab.llm.arrays import BYTES, Anchors, Words, joined, mix, slices
from textlab.llm.batches import materialised
from textlab.llm.blooms import might_contain
from textlab.operators.ranking import positions
from textlab.session import written

LAST = (1 << 63) - 1  # the greatest place
FLUSH = 1 << 17  # runs a task holds before it sends them
PART_BYTES = 8 << 20  # of text for each part of the runs: bounds what one task compares
SENT = np.dtype([("key", "<u8"), ("content", "<u8"), ("doc", "<i8"), ("at", "<u4"), ("left", "<u2"), ("run", "<u2")])
SPAN = "doc long, low long, high long"
EDGE = "doc long, at long, low long, high long, key long"
SEGMENT = "doc long, low long, windows int, key long, before binary, suffix binary"


@dataclass(frozen=True)
class Shape:
    """Windows of ``size`` tokens (bytes, or words), anchored at ``gram`` of them."""

    size: int
    gram: int
    words: bool

    def tokens(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        if self.words:
            words = Words(texts)
            return words.hash, words.first
        data, first = joined(texts)
        return BYTES[data], first


def encoded(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def keyed(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, int, int]:
    """``doc, text``, the greatest id and the number of parts that all runs are dealt to.

    Every row with a null id has a place of its own after the greatest id, in the order of a
    digest of the text."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    found = docs.agg(
        F.max("doc").alias("last"), F.count_if(F.col("doc").isNull()).alias("nulls"),
        F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes"),
    ).first()
    last = -1 if found["last"] is None else found["last"]
    parts = max(1, -(-int(found["bytes"]) // PART_BYTES))
    if not found["nulls"]:
        return docs, last, parts
    if last + found["nulls"] > LAST:
        raise ValueError("no places are left after the greatest id for rows without one")
    nameless = docs.where("doc IS NULL").select(
        "text", F.sha2(F.coalesce("text", F.lit("")), 256).alias("_mark"), F.monotonically_increasing_id().alias("_tie"))
    placed = positions(nameless, ["_mark", "_tie"]).select((F.col("pos") + F.lit(last + 1)).alias("doc"), "text")
    return docs.where("doc IS NOT NULL").unionByName(written(placed, "nameless")), last, parts


def anchored(docs: DataFrame, shape: Shape, parts: int) -> DataFrame:
    """``part, runs, covered``: packed runs by the hash of their anchor, and the
    spans that an equal run of the same slice covers already."""

    def packed(runs: list[np.ndarray], covered: list[np.ndarray]) -> pa.RecordBatch:
        runs, covered = np.concatenate(runs), np.concatenate(covered)
        where = (mix(runs["key"]) % np.uint64(parts)).astype(np.int64)
        order = np.argsort(where, kind="stable")
        runs, ends = runs[order], np.cumsum(np.bincount(where, minlength=parts))
        cuts = np.linspace(0, len(covered), parts + 1).astype(int)
        some = [
            (k, b"".join(runs[a:b][c].tobytes() for c in SENT.names), covered[low:high].tobytes())
            for k, (a, b, low, high) in enumerate(zip(ends - np.diff(ends, prepend=0), ends, cuts[:-1], cuts[1:]))
            if b > a or high > low
        ]
        columns = zip(*some) if some else ([], [], [])
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.binary(), pa.binary()))], names=["part", "runs", "covered"])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, covered, held = [], [], 0
        for batch in batches:
            docs, texts = batch.column(0).to_numpy(), encoded(batch.column(1))
            for a, b in slices([len(t) for t in texts]):
                found = Anchors(*shape.tokens(texts[a:b]), shape.size, shape.gram)
                rows = np.empty(len(found.key), SENT)
                rows["key"], rows["content"], rows["doc"] = found.key, found.content, docs[a:b][found.text]
                rows["at"], rows["left"], rows["run"] = found.at, found.at - found.low, found.high - found.low
                first, later = firsts(rows)
                runs.append(rows[first])
                covered.append(spans_of(rows[later], shape.size))
                held += len(rows)
            if held > FLUSH:
                yield packed(runs, covered)
                runs, covered, held = [], [], 0
        if held:
            yield packed(runs, covered)

    return docs.mapInArrow(send, "part int, runs binary, covered binary")


def later_places(new: np.ndarray, doc: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Of rows in the order of their group, ``doc`` and ``at``, those at another place than
    the first row of their group; ``new`` is where groups begin. As a mask."""
    head = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
    return (doc != doc[head]) | (at != at[head])


def firsts(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of rows with equal content, one at the first place, and all at later places; as masks.

    Rows that repeat an id may have more runs at the first place: they are that place."""
    order = np.lexsort((rows["at"], rows["doc"], rows["key"], rows["content"]))
    content, key = rows["content"][order], rows["key"][order]
    new = np.ones(len(rows), dtype=bool)
    new[1:] = (content[1:] != content[:-1]) | (key[1:] != key[:-1])
    first, later = np.empty(len(rows), dtype=bool), np.empty(len(rows), dtype=bool)
    first[order], later[order] = new, later_places(new, rows["doc"][order], rows["at"][order])
    return first, later


def spans_of(rows: np.ndarray, size: int) -> np.ndarray:
    """``doc, low, high`` (end excluded) of what the windows of runs cover."""
    low = rows["at"].astype(np.int64) - rows["left"]
    return np.stack([rows["doc"], low, low + rows["run"] + size], axis=1)


def compared(sent: DataFrame, shape: Shape) -> DataFrame:
    """Runs of one anchor together: rows of spans (``key`` null) and of edges."""
    size = shape.size

    def judge(table: pa.Table) -> pa.Table:
        parts = []
        for blob in table.column("runs").to_pylist():
            n, at = len(blob) // SENT.itemsize, 0
            part = np.empty(n, SENT)
            for name in SENT.names:
                part[name] = np.frombuffer(blob, SENT[name], n, at)
                at += n * SENT[name].itemsize
            parts.append(part)
        rows = np.concatenate(parts)
        # Most anchors occur once.
        order = np.argsort(rows["key"], kind="stable")
        key = rows["key"][order]
        same = key[1:] == key[:-1]
        rows = rows[order[(np.append(same, False) | np.append(False, same))[:len(order)]]]
        first, later = firsts(rows)
        covered = spans_of(rows[later], size)
        rows = rows[first]
        keys, inverse, counts = np.unique(rows["key"], return_inverse=True, return_counts=True)
        edges = rows[counts[inverse] > 1]
        low = edges["at"].astype(np.int64) - edges["left"]
        known = [np.frombuffer(x, np.int64).reshape(-1, 3) for x in table.column("covered").to_pylist()]
        spans = np.concatenate([covered, *known])
        nothing = pa.nulls(len(spans), pa.int64())
        spans = [pa.array(spans[:, 0]), nothing, pa.array(spans[:, 1]), pa.array(spans[:, 2]), nothing]
        edges = [pa.array(x) for x in (edges["doc"].copy(), edges["at"].astype(np.int64), low, low + edges["run"], edges["key"].astype(np.int64))]
        return pa.table([pa.chunked_array([a, b]) for a, b in zip(spans, edges)], names=["doc", "at", "low", "high", "key"])

    return sent.groupBy("part").applyInArrow(judge, EDGE)


def fetched(docs: DataFrame, edges: DataFrame, shape: Shape) -> DataFrame:
    """The text of every edge: what comes before its anchor, and the suffix there."""
    by_doc = edges.groupBy("doc").agg(F.collect_list(F.struct("at", "low", "high", "key")).alias("edges"))
    # Texts without an edge stay where they are.
    candidates = might_contain(docs, edges.select("doc").distinct(), "doc")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, docs = encoded(batch.column(1)), batch.column(0).to_numpy()
            for a, b in slices([len(t) for t in texts]):
                lists = batch.column(2).slice(a, b - a)
                flat = lists.flatten()
                at, low, high, key = (flat.field(i).to_numpy() for i in range(4))
                doc = np.repeat(docs[a:b], np.diff(lists.offsets.to_numpy()))
                text = np.repeat(np.arange(b - a), np.diff(lists.offsets.to_numpy()))
                before, suffix = [], []
                words = Words(texts[a:b]) if shape.words else None
                length = np.diff(words.first) if shape.words else np.array([len(t) for t in texts[a:b]])
                # Edges of a longer text with the same id.
                inside = high + shape.size <= length[text]
                at, low, high, key, doc, text = (x[inside] for x in (at, low, high, key, doc, text))
                if shape.words:
                    data, first, start, end = words.data.tobytes(), words.first, words.start, words.end
                    spell = lambda i, j: b" ".join(data[s:e] for s, e in zip(start[i:j], end[i:j]))
                    for t, x, lo, hi in zip(text, at, low, high):
                        base = first[t]
                        before.append(spell(base + lo, base + x))
                        suffix.append(spell(base + x, base + hi + shape.size))
                else:
                    for t, x, lo, hi in zip(text, at, low, high):
                        before.append(texts[a + t][lo:x])
                        suffix.append(texts[a + t][x:hi + shape.size])
                yield pa.RecordBatch.from_arrays([
                    pa.array(doc), pa.array(low), pa.array((high - low + 1).astype(np.int32)), pa.array(key),
                    pa.array(before, pa.binary()), pa.array(suffix, pa.binary()),
                ], names=["doc", "low", "windows", "key", "before", "suffix"])

    return candidates.join(by_doc, "doc").select("doc", "text", "edges").mapInArrow(cut, SEGMENT)


def later_windows(windows: DataFrame, size: int) -> DataFrame:
    """Spans of the windows (``digest, doc, low``) that are not the first of their digest."""
    first = F.min(F.struct("doc", "low")).alias("first")
    repeated = written(
        windows.groupBy("digest").agg(first, F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "windows"
    )
    return (
        windows.join(repeated, "digest")
        .where((F.col("doc") != F.col("first.doc")) | (F.col("low") != F.col("first.low")))
        .select("doc", "low", (F.col("low") + size).alias("high"))
    )


def repeated_spans(
    docs: DataFrame, shape: Shape, decide: Callable[[DataFrame, Shape], DataFrame], parts: int
) -> DataFrame:
    """``doc, low, high``: what windows that also start earlier cover, in tokens.

    ``decide`` finds the windows of segments that also start earlier. Runs are dealt to
    ``parts`` by the hash of their anchor.
    """
    found = materialised(compared(anchored(docs, shape, parts), shape), "runs")
    edges = found.where("key IS NOT NULL")
    segments = materialised(fetched(docs, edges, shape), "segments")
    return found.where("key IS NULL").select("doc", "low", "high").unionByName(decide(segments, shape))


def merged(spans: np.ndarray, length: int) -> np.ndarray:
    """A mask of the tokens that spans cover."""
    step = np.zeros(length + 1, dtype=np.int64)
    np.add.at(step, np.minimum(spans[:, 0], length), 1)
    np.add.at(step, np.minimum(spans[:, 1], length), -1)
    return np.cumsum(step)[:length] > 0


def kept_texts(docs: DataFrame, spans: DataFrame, shape: Shape, last: int, texts: bool = False) -> DataFrame:
    """Per document (without an id after place ``last``) its tokens, removed tokens, runs of removed tokens, the digest
    of what is left, and, if asked for, the text that is left."""
    by_doc = spans.groupBy("doc").agg(F.collect_list(F.struct("low", "high")).alias("spans"))

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            contents, rows = encoded(batch.column(1)), []
            lists = batch.column(2)
            offsets = lists.offsets.to_numpy()
            low, high = (lists.values.field(i).to_numpy() for i in range(2))
            for i, text in enumerate(contents):
                a, b = offsets[i], offsets[i + 1]
                if shape.words:
                    tokens = text.split()
                    n = len(tokens)
                else:
                    tokens, n = np.frombuffer(text, np.uint8), len(text)
                removed, runs, left = 0, 0, None
                if b > a:
                    gone = merged(np.stack([low[a:b], high[a:b]], axis=1), n)
                    removed, runs = int(gone.sum()), int(np.count_nonzero(np.diff(gone, prepend=False) & gone))
                    left = [w for w, g in zip(tokens, gone.tolist()) if not g] if shape.words else tokens[~gone].tobytes()
                elif shape.words:
                    left = tokens
                else:
                    left = text
                left = b" ".join(left) if shape.words else left
                rows.append((n, removed, runs, hashlib.sha256(left).hexdigest(), *([left] if texts else [])))
            columns = list(zip(*rows)) if rows else [[]] * (4 + texts)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))],
                names=["doc", "n_tokens", "n_removed", "n_spans", "kept_sha256", "kept"][: 5 + texts],
            )

    schema = "doc long, n_tokens long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * texts
    out = materialised(docs.join(by_doc, "doc", "left").select("doc", "text", "spans").mapInArrow(remove, schema), "kept")
    return out.withColumn("doc_id", F.when(F.col("doc") <= F.lit(last), F.col("doc"))).drop("doc")
