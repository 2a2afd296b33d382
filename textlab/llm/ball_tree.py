"""Ranked lexical search by exact inner products over sparse ball trees.

A document is a sparse vector of integers over the terms that the queries hold,
a query one of term counts; their inner product is the score. Every task builds
ball trees over its documents, a bounded number at a time: nodes hold a centroid
and a radius, so ``query . centroid + |query| * radius`` bounds every score below
them. A search takes nodes best bound first and ends where no bound reaches the
scores already found. Bounds are floats rounded up beyond their largest possible
error; leaves are scored in integers, so results are exact.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlab.llm.batches import materialised
from textlab.llm.repeats import encoded
from textlab.operators.ranking import first_rows
from textlab.session import written

#: ASCII letters in lower case, everything else of ASCII but digits as a blank.
FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)
)
BLOCK_TERMS = 16_384  # terms of the queries searched for at once (or one query)
TREE_DOCS, TREE_ENTRIES = 8_192, 1 << 20  # documents of a tree, and entries of their vectors (or one document)
LEAF = 32
LAST_ID = 1 << 64  # stands for a null id: after all others


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


def blocks(queries: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple]]:
    """Queries as ``(id, terms with their counts)`` in blocks of bounded size, one partition
    of the table held at a time. Queries without a term find nothing and are left out."""
    held, size = [], 0
    for row in queries.select(id_col, text_col).toLocalIterator():
        terms = Counter(terms_of((row[1] or "").encode("utf-8", "replace")))
        if not terms:
            continue
        if held and size + len(terms) > BLOCK_TERMS:
            yield held
            held, size = [], 0
        held.append((row[0], terms))
        size += len(terms)
    if held:
        yield held


def counted(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """``doc, n, term, tf``: per document with terms their number, and which of the vocabulary it holds how often."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = sent.value.get
        for batch in batches:
            rows, lengths, term, tf, offsets = [], [], [], [], [0]
            for i, text in enumerate(encoded(batch.column(1))):
                words = terms_of(text)
                if not words:
                    continue
                found = Counter(map(number, words))
                found.pop(None, None)
                rows.append(i)
                lengths.append(len(words))
                term.extend(found)
                tf.extend(found.values())
                offsets.append(len(term))
            lists = [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(x, pa.int64())) for x in (term, tf)]
            ids = batch.column(0).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(lengths, pa.int64()), *lists], names=["doc", "n", "term", "tf"])

    found = materialised(docs.mapInArrow(count, "doc long, n long, term array<long>, tf array<long>"), "terms")
    sent.destroy()
    return found


class Rows:
    """Sparse vectors of documents: entries ``first[i]:first[i + 1]`` belong to row ``i``."""

    def __init__(self, first: np.ndarray, term: np.ndarray, value: np.ndarray, doc: np.ndarray):
        self.first, self.term, self.value, self.doc = first, term, value, doc
        self.real = value.astype(np.float64)

    def __len__(self) -> int:
        return len(self.doc)

    def dot(self, dense: np.ndarray) -> np.ndarray:
        """Every row's inner product, in the numbers of ``dense``."""
        value = self.real if dense.dtype == np.float64 else self.value
        return np.add.reduceat(value * dense[self.term], self.first[:-1])

    def take(self, rows: np.ndarray) -> Rows:
        sizes = np.diff(self.first)[rows]
        first = np.concatenate([[0], np.cumsum(sizes)])
        entries = np.arange(first[-1]) + np.repeat(self.first[rows] - first[:-1], sizes)
        return Rows(first, self.term[entries], self.value[entries], self.doc[rows])


def slack(entries: int) -> float:
    """More than the relative error of a sum of so many products of doubles."""
    return (entries + 16) * 2.0 ** -50


class Node:
    """A ball around documents; ``least`` is their smallest id, for equal scores."""

    __slots__ = ("term", "center", "radius", "least", "rows", "children")

    def bound(self, query: np.ndarray, norm: float) -> int:
        """No document below scores higher."""
        high = float(query[self.term] @ self.center) + norm * self.radius
        return math.ceil(high * (1 + slack(len(self.term)))) + 1


def grown(rows: Rows, terms: int, leaf: int = LEAF) -> Node:
    """The tree over ``rows``: nodes split at the median between two documents far apart."""
    node = Node()
    center = np.bincount(rows.term, rows.real, terms) / len(rows)
    node.term = np.flatnonzero(center)
    node.center = center[node.term]
    norms = np.add.reduceat(rows.real * rows.real, rows.first[:-1])
    middle = float(node.center @ node.center)
    error = slack(len(rows.term) + len(node.term)) * (norms + middle)  # of the squared distances
    distance = np.maximum(norms - 2 * rows.dot(center) + middle, 0)
    node.radius = math.sqrt(float((distance + 4 * error).max())) * (1 + 2.0 ** -50)
    node.least = int(rows.doc.min()) if rows.doc.dtype != object else min(rows.doc)
    node.rows = node.children = None
    if len(rows) <= leaf or (distance <= 4 * error).all():
        node.rows = rows
        return node

    def spread(row: int) -> np.ndarray:
        dense = np.zeros(terms)
        part = slice(rows.first[row], rows.first[row + 1])
        dense[rows.term[part]] = rows.real[part]
        return rows.dot(dense)

    a = int(distance.argmax())
    near_a = spread(a)
    b = int((norms - 2 * near_a).argmax())
    order = np.argsort(near_a - spread(b), kind="stable")
    half = len(order) // 2
    node.children = [grown(rows.take(np.sort(part)), terms, leaf) for part in (order[:half], order[half:])]
    return node


class Query:
    """The ``most`` best documents so far of one query, as a heap of ``(score, -id)``."""

    __slots__ = ("term", "count", "norm", "most", "best", "leaves")

    def __init__(self, term: np.ndarray, count: np.ndarray, most: int):
        self.term, self.count, self.most, self.best, self.leaves = term, count, most, [], 0
        self.norm = math.sqrt(float((count.astype(np.float64) ** 2).sum())) * (1 + slack(len(count)))

    def beaten(self, bound: int, least: int) -> bool:
        """Whether nothing of so high a bound and so small an id can be among the best."""
        return bound <= 0 or len(self.best) == self.most and (bound, -least) <= self.best[0]

    def search(self, root: Node, dense: np.ndarray, exact: np.ndarray) -> None:
        """Best bound first through a tree; ``dense`` and ``exact`` hold this query's counts by term."""
        queue, order = [(-root.bound(dense, self.norm), 0, root)], 1
        while queue:
            negative, _, node = heapq.heappop(queue)
            if len(self.best) == self.most and -negative < self.best[0][0]:
                return  # all other bounds are no higher
            if self.beaten(-negative, node.least):
                continue
            if node.rows is None:
                for child in node.children:
                    bound = child.bound(dense, self.norm)
                    if not self.beaten(bound, child.least):
                        heapq.heappush(queue, (-bound, order, child))
                        order += 1
                continue
            self.leaves += 1
            scores = node.rows.dot(exact)
            floor = max(self.best[0][0], 1) if len(self.best) == self.most else 1
            for i in np.flatnonzero(scores >= floor).tolist():
                entry = (int(scores[i]), -int(node.rows.doc[i]))
                if len(self.best) < self.most:
                    heapq.heappush(self.best, entry)
                elif entry > self.best[0]:
                    heapq.heapreplace(self.best, entry)


def part_values(tf: np.ndarray, n: np.ndarray, weight: np.ndarray, documents: int, length: int) -> np.ndarray:
    """What every term of a document adds to a score for each time a query holds it."""
    most = 75 * documents * int(n.max(initial=0))
    if most >= 1 << 63 or 10**9 * int(tf.max(initial=0)) >= 1 << 63:
        tf, n = tf.astype(object), n.astype(object)
    m = 100 - 75 + (75 * n * documents) // length
    return weight * ((1_000_000_000 * tf) // (1000 * tf + 8 * m)).astype(np.int64)


def trees(batches: Iterator[pa.RecordBatch], weight: np.ndarray, documents: int, length: int) -> Iterator[Node]:
    """Trees over the documents of a task, a bounded number at a time."""
    held, docs, entries = [], 0, 0

    def tree() -> Node:
        n, doc, sizes, term, tf = (np.concatenate(x) for x in zip(*held))
        value = part_values(tf, np.repeat(n, sizes), weight[term], documents, length)
        return grown(Rows(np.concatenate([[0], np.cumsum(sizes)]), term, value, doc), len(weight))

    for batch in batches:
        sizes = np.diff(batch.column(2).offsets.to_numpy())
        some = np.flatnonzero(sizes)
        n = batch.column(1).to_numpy()[some]
        ids = batch.column(0)
        doc = np.array([LAST_ID if x is None else x for x in ids.to_pylist()], object) if ids.null_count else ids.to_numpy()
        doc, sizes = doc[some], sizes[some]
        term, tf = batch.column(2).flatten().to_numpy(), batch.column(3).flatten().to_numpy()
        ends = np.cumsum(sizes)
        at = 0
        while at < len(sizes):
            base = ends[at - 1] if at else 0
            room = int(np.searchsorted(ends, base + TREE_ENTRIES - entries, "right"))
            to = min(room, at + TREE_DOCS - docs, len(sizes))
            if to <= at and not held:
                to = at + 1
            if to > at:
                part = slice(base, ends[to - 1])
                held.append((n[at:to], doc[at:to], sizes[at:to], term[part], tf[part]))
                docs, entries, at = docs + to - at, entries + int(ends[to - 1] - base), to
            if at < len(sizes):
                yield tree()
                held, docs, entries = [], 0, 0
    if held:
        yield tree()


def searched(vectors: DataFrame, items: list[tuple], vocabulary: dict[bytes, int], weight: np.ndarray,
             documents: int, length: int, most: int) -> DataFrame:
    """``item, item_id, doc_id, score``: the best of every task for each query of a block."""
    known = [
        (i, np.array([vocabulary[t] for t in terms], np.int64), np.array(list(terms.values()), np.int64))
        for i, terms in items
    ]
    sent = vectors.sparkSession.sparkContext.broadcast((known, weight))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, weight = sent.value
        queries = [Query(term, count, most) for _, term, count in known]
        dense, exact = np.zeros(len(weight)), np.zeros(len(weight), np.int64)
        for root in trees(batches, weight, documents, length):
            for query in queries:
                dense[query.term] = exact[query.term] = query.count
                query.search(root, dense, exact)
                dense[query.term] = exact[query.term] = 0
        rows = [
            (k, known[k][0], None if -doc == LAST_ID else -doc, score)
            for k, query in enumerate(queries) for score, doc in query.best
        ]
        columns = list(zip(*rows)) if rows else [[]] * 4
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.int64(), pa.int64(), pa.int64()))],
            names=["item", "item_id", "doc_id", "score"],
        )

    found = vectors.mapInArrow(search, "item int, item_id long, doc_id long, score long")
    best = first_rows(found, ["item"], [F.desc("score"), F.asc_nulls_last("doc_id")], most, "rank")
    best = written(best.select("item_id", "rank", "doc_id", "score"), "ranked")
    sent.destroy()
    return best


def ranked(
    docs: DataFrame, queries: DataFrame, most: int = 10, id_col: str = "doc_id", text_col: str = "text",
    query_id: str = "item_id", query_text: str = "text",
) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``most`` best documents of every query.

    Terms are runs of ASCII letters (in lower case), digits and all other than
    ASCII characters. A term weighs ``floor(1000 ln((2N + 2) / (2df + 1)))``, and
    adds that times ``(10^9 tf) div (1000 tf + 8m)`` for each time the query holds
    it; all sums are exact integers.

    Documents without a query term are never returned, so texts that are null,
    empty or without terms are not. Equal scores go by ascending id, null ids
    last; rows that repeat an id are ranked each by itself. So is every row of
    ``queries``, also with null or repeated ids; one without terms has no result.
    Empty tables give an empty result; other columns are not read. Queries are
    searched for in blocks of ``BLOCK_TERMS`` terms, each in one pass over the texts.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    found = []
    for items in blocks(queries.withColumn(query_id, F.col(query_id).cast("long")), query_id, query_text):
        vocabulary: dict[bytes, int] = {}
        for _, terms in items:
            for term in terms:
                vocabulary.setdefault(term, len(vocabulary))
        vectors = counted(docs, vocabulary)
        total = vectors.agg(F.count(F.lit(1)).alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("length")).first()
        documents, length = int(total["documents"]), int(total["length"])
        if not documents:
            break
        frequency = np.zeros(len(vocabulary), np.int64)  # one number for each term of the block
        for row in vectors.select(F.explode("term").alias("term")).groupBy("term").count().collect():
            frequency[row["term"]] = row["count"]
        weight = np.array(
            [math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1))) for df in frequency.tolist()], np.int64)
        found.append(searched(vectors, items, vocabulary, weight, documents, length, most))
    if not found:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return reduce(DataFrame.unionByName, found)
