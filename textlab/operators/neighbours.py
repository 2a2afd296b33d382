"""Exact nearest neighbours without a cross join.

Rows are dealt into hash groups of bounded size, and every pair of a group of
queries and a group of points is one task, whatever the size of the table. A
task multiplies two blocks, takes the points that may be among the ``k`` nearest
and measures those exactly; it returns ``k`` rows per query, not its pairs. Each
row is sent once per group of the other side, so the shuffle holds ``rows * rows /
block_rows`` rows per side: the comparisons of an exact search are quadratic, and
larger blocks buy fewer copies with memory. Copies of a vector are collapsed
first: each keeps its ``k + 1`` smallest ids, which is all that the copies can
contribute. Tables of few blocks deal their queries into smaller groups, so that
there is work for many tasks.

Vectors are arrays, or sparse rows (a struct ``terms, weights``). Blocks of sparse
rows are compared through an inverted index of the points: a query's terms are
read by falling weight until what is left of its norm cannot lift another point
among the ``k`` nearest, and only points that can still be among them are measured.
In a large block most terms would be read before that; there a batch of queries is
multiplied with the points, by a matrix for terms that many points hold and by the
index for the others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlab.operators.ranking import first_rows
from textlab.session import written

BLOCK_ROWS = 16_384
QUERY_ROWS = 256  # queries measured at once: bounds the block of distances in a task
QUERY_PART, TASKS = 1_024, 64  # queries are dealt into groups no smaller than this while there are fewer tasks
PRODUCT_ROWS = 1_024  # points from which sparse rows are multiplied in batches
FREQUENT, COLUMNS = 8, 512  # terms that one point of so many holds become columns of a matrix, so many at most
_FOUND = "rep bigint, near bigint, distance double"
DIGITS = 9  # distances are compared after rounding, ties go to the smaller id


def _collapse(points: DataFrame, k: int) -> DataFrame:
    """One row per distinct vector: ``vector, ids`` with at most ``k + 1`` ids."""
    kept = first_rows(points.select("row_id", "vector"), ["vector"], ["row_id"], k + 1)
    return kept.groupBy("vector").agg(F.sort_array(F.collect_list("row_id")).alias("ids"))


def _search(k: int):
    """Per block: the ``k`` nearest points of every query, itself excluded."""
    columns = ["rep", "near", "distance"]

    def run(queries: pd.DataFrame, points: pd.DataFrame) -> pd.DataFrame:
        matrices = (np.array(t["vector"].tolist(), dtype=float) for t in (queries, points))
        parts = _nearest_of(k, *(x for t, m in zip((queries, points), matrices) for x in (t["rep"].to_numpy(), m)))
        return pd.DataFrame(dict(zip(columns, parts))).astype({"rep": "int64", "near": "int64", "distance": "float64"})

    return run


def _arrow_search(k: int):
    """As :func:`_search`, on Arrow tables."""

    def run(queries: pa.Table, points: pa.Table) -> pa.Table:
        both = [x for t in (queries, points) for x in (t.column("rep").to_numpy(), _matrix(t.column("vector")))]
        kinds = (pa.int64(), pa.int64(), pa.float64())
        return pa.table([pa.array(c, t) for c, t in zip(_nearest_of(k, *both), kinds)], names=["rep", "near", "distance"])

    return run


def _matrix(vectors: pa.ChunkedArray) -> np.ndarray:
    return pa.compute.list_flatten(vectors).to_numpy().reshape(len(vectors), -1) if len(vectors) else np.zeros((0, 0))


def _nearest_of(k: int, query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, where: np.ndarray) -> list:
    """Ids of queries, ids of their ``k`` nearest points, and distances."""
    squares = (where**2).sum(axis=1) if len(where) else where
    found = []
    for start in range(0, len(query_ids) if len(ids) else 0, QUERY_ROWS):
        reps, rows = query_ids[start:start + QUERY_ROWS], queries[start:start + QUERY_ROWS]
        own = (rows**2).sum(axis=1)
        near = own[:, None] + squares[None, :] - 2.0 * (rows @ where.T)
        near[reps[:, None] == ids[None, :]] = np.inf
        last = np.partition(near, k - 1, axis=1)[:, k - 1] if len(ids) > k else np.full(len(rows), np.inf)
        # The product is exact to about 1e-15 of the squares; what may be near is measured again.
        slack = 1e-9 * (own + squares.max() + 1.0)
        q, p = np.nonzero((near <= (last + slack)[:, None]) & np.isfinite(near))
        d = np.sqrt(((rows[q] - where[p]) ** 2).sum(axis=1)).round(DIGITS)
        order = np.lexsort((ids[p], d, q))
        q, p, d = q[order], p[order], d[order]
        first = np.arange(len(q)) - np.searchsorted(q, q) < k
        found.append((reps[q[first]], ids[p[first]], d[first]))
    return [np.concatenate(x) for x in zip(*found)] if found else [[], [], []]


class SparseBlock:
    """Sparse rows of a task: entries ``first[i]:first[i + 1]`` belong to row ``i``."""

    def __init__(self, table: pa.Table):
        self.ids = table.column("rep").to_numpy()
        vectors = table.column("vector").combine_chunks()
        if isinstance(vectors, pa.ChunkedArray):  # an empty table
            vectors = pa.concat_arrays(vectors.chunks or [pa.array([], vectors.type)])
        terms, weights = (pa.compute.struct_field(vectors, i) for i in (0, 1))
        offsets = terms.offsets.to_numpy()
        self.first = (offsets - offsets[:1]).astype(np.int64) if len(offsets) else np.zeros(1, np.int64)
        self.term, self.weight = terms.flatten().to_numpy(), weights.flatten().to_numpy()
        sums = np.concatenate([[0.0], np.cumsum(self.weight**2)])
        self.squares = sums[self.first[1:]] - sums[self.first[:-1]]

    def row(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        part = slice(self.first[i], self.first[i + 1])
        return self.term[part], self.weight[part]


class SparseIndex:
    """Points by term, and exact distances to some of them."""

    def __init__(self, points: SparseBlock):
        self.points = points
        self.size = int(points.term.max(initial=-1)) + 1
        order = np.argsort(points.term, kind="stable")
        self.start = np.searchsorted(points.term[order], np.arange(self.size + 1))
        self.row = np.repeat(np.arange(len(points.ids)), np.diff(points.first))[order]
        self.weight = points.weight[order]
        self.place = np.full(self.size, -1)

    def candidates(self, term: np.ndarray, weight: np.ndarray, own: int, k: int) -> tuple[np.ndarray, int]:
        """Points that may be among the ``k`` nearest but the one with id ``own``, and how many terms were read.

        Weights are not negative, so partial products only grow. Of points, the greatest
        ``2 x.y - y.y`` are nearest; the ``k``-th greatest partial one is a lower bound of the
        last that counts.
        """
        squares = self.points.squares
        others = self.points.ids != own
        if others.sum() <= k:
            return np.flatnonzero(others), 0
        norms, order = np.sqrt(squares), np.argsort(-weight, kind="stable")
        left = np.sqrt(np.append(np.cumsum((weight**2)[order][::-1])[::-1], 0.0))
        gathered = np.zeros(len(squares))
        slack = 1e-9 * (1.0 + squares.max(initial=0.0) + (weight**2).sum())
        for read, at in enumerate(order, 1):
            if term[at] < self.size:
                part = slice(self.start[term[at]], self.start[term[at] + 1])
                gathered[self.row[part]] += weight[at] * self.weight[part]
            if read % 8 == 0 or read == len(order):
                value = np.where(others, 2 * gathered - squares, -np.inf)
                last = np.partition(value, len(value) - k)[len(value) - k]
                possible = value + 2 * left[read] * norms >= last - slack
                if possible.sum() <= 4 * k or read == len(order):
                    return np.flatnonzero(possible & others), read
        value = np.where(others, -squares, -np.inf)
        last = np.partition(value, len(value) - k)[len(value) - k]
        return np.flatnonzero(value >= last - slack), 0

    def frequent(self) -> tuple[np.ndarray, np.ndarray]:
        """The column of every term in a matrix of the frequent ones (-1: none), and that matrix."""
        held = np.diff(self.start)
        chosen = np.argsort(-held, kind="stable")[:COLUMNS]
        chosen = chosen[held[chosen] * FREQUENT > len(self.points.ids)]
        column = np.full(self.size, -1)
        column[chosen] = np.arange(len(chosen))
        matrix = np.zeros((len(chosen), len(self.points.ids)))
        for at, term in enumerate(chosen):
            part = slice(self.start[term], self.start[term + 1])
            np.add.at(matrix[at], self.row[part], self.weight[part])
        return column, matrix

    def products(self, queries: SparseBlock, begin: int, end: int, column: np.ndarray, matrix: np.ndarray) -> np.ndarray:
        """Inner products of the queries ``begin`` to ``end`` with all points."""
        part = slice(queries.first[begin], queries.first[end])
        of = np.repeat(np.arange(end - begin), np.diff(queries.first[begin:end + 1]))
        known = queries.term[part] < self.size
        of, term, weight = of[known], queries.term[part][known], queries.weight[part][known]
        in_matrix = column[term] >= 0
        dense = np.zeros((end - begin, len(matrix)))
        np.add.at(dense, (of[in_matrix], column[term[in_matrix]]), weight[in_matrix])
        out = dense @ matrix
        of, term, weight = of[~in_matrix], term[~in_matrix], weight[~in_matrix]
        bounds = np.searchsorted(of, np.arange(end - begin + 1))
        for i in range(end - begin):
            mine = slice(bounds[i], bounds[i + 1])
            first, sizes = self.start[term[mine]], self.start[term[mine] + 1] - self.start[term[mine]]
            entry = np.arange(sizes.sum()) + np.repeat(first - np.cumsum(sizes) + sizes, sizes)
            out[i] += np.bincount(self.row[entry], np.repeat(weight[mine], sizes) * self.weight[entry], minlength=out.shape[1])
        return out

    def batches(self, queries: SparseBlock, k: int) -> Iterator[tuple[int, np.ndarray]]:
        """Per query, the points that may be among the ``k`` nearest, from all inner products.

        Products are exact to about 1e-13 of the squares; what is that close to the last counts.
        """
        squares, ids = self.points.squares, self.points.ids
        column, matrix = self.frequent()
        for begin in range(0, len(queries.ids), QUERY_ROWS):
            end = min(begin + QUERY_ROWS, len(queries.ids))
            value = 2 * self.products(queries, begin, end, column, matrix) - squares
            others = queries.ids[begin:end, None] != ids[None, :]
            value[~others] = -np.inf
            place = max(0, len(ids) - k)
            last = np.partition(value, place, axis=1)[:, place]
            slack = 1e-9 * (1.0 + squares.max(initial=0.0) + queries.squares[begin:end])
            possible = (value >= (last - slack)[:, None]) & others
            for i in range(begin, end):
                yield i, np.flatnonzero(possible[i - begin])

    def distances(self, term: np.ndarray, weight: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Distances as sums of squares over the union of both supports: nothing cancels out."""
        sizes = self.points.first[rows + 1] - self.points.first[rows]
        of = np.repeat(np.arange(len(rows)), sizes)
        entry = np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + self.points.first[rows][of]
        known = term < self.size
        self.place[term[known]] = np.flatnonzero(known)
        where, value = self.place[self.points.term[entry]], self.points.weight[entry]
        self.place[term[known]] = -1
        dense = np.zeros((len(rows), len(term)))
        hit = where >= 0
        dense[of[hit], where[hit]] = value[hit]
        total = ((weight[None, :] - dense) ** 2).sum(axis=1)
        return np.sqrt(total + np.bincount(of[~hit], value[~hit] ** 2, minlength=len(rows)))


def _sparse_search(k: int):
    """As :func:`_search`, for sparse rows."""

    def run(queries: pa.Table, points: pa.Table) -> pa.Table:
        found = [[], [], []]
        if queries.num_rows and points.num_rows:
            block, index = SparseBlock(queries), SparseIndex(SparseBlock(points))
            if points.num_rows >= PRODUCT_ROWS:
                possible = index.batches(block, k)
            else:
                possible = ((i, index.candidates(*block.row(i), rep, k)[0]) for i, rep in enumerate(block.ids))
            for i, rows in possible:
                near = index.distances(*block.row(i), rows).round(DIGITS)
                order = np.lexsort((index.points.ids[rows], near))[:k]
                found[0].append(np.full(len(order), block.ids[i]))
                found[1].append(index.points.ids[rows][order])
                found[2].append(near[order])
        columns = [np.concatenate(x) if x else [] for x in found]
        kinds = (pa.int64(), pa.int64(), pa.float64())
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds)], names=["rep", "near", "distance"])

    return run


def is_sparse(points: DataFrame) -> bool:
    return points.schema["vector"].dataType.typeName() == "struct"


def _nearest_distinct(reps: DataFrame, k: int, block_rows: int) -> DataFrame:
    """``rep, near, distance``: the ``k`` nearest other distinct vectors."""
    rows = reps.count()
    groups = max(1, -(-rows // block_rows))
    parts = max(groups, min(-(-rows // QUERY_PART), -(-TASKS // groups)))
    own = {n: F.pmod(F.xxhash64("rep"), F.lit(n)).cast("int") for n in (groups, parts)}
    every = {n: F.explode(F.sequence(F.lit(0), F.lit(n - 1))) for n in (groups, parts)}
    queries = reps.select("rep", "vector", own[parts].alias("query"), every[groups].alias("point"))
    points = reps.select("rep", "vector", own[groups].alias("point"), every[parts].alias("query"))
    keys = ["query", "point"]
    blocks = queries.groupBy(*keys).cogroup(points.groupBy(*keys))
    found = blocks.applyInArrow(_sparse_search(k), _FOUND) if is_sparse(reps) else blocks.applyInPandas(_search(k), _FOUND)
    return first_rows(found, ["rep"], ["distance", "near"], k)


def collapsed(points: DataFrame, k: int) -> DataFrame:
    """``vector, ids, rep``: the distinct vectors, each named by its smallest id."""
    return _collapse(points, k).withColumn("rep", F.get("ids", F.lit(0)))


def nearest_neighbours(
    points: DataFrame, k: int = 5, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """The ``k`` nearest other rows by Euclidean distance, for every row.

    ``points`` is ``row_id, vector``, of dense vectors, or of sparse ones with
    weights of 0 or more; the result ``row_id, rank, neighbour,
    distance`` has ranks from 1, ties going to the smaller id.
    """
    reps = written(collapsed(points, k), "distinct")
    return expanded(points, reps, _nearest_distinct(reps, k, block_rows), k)


def expanded(points: DataFrame, reps: DataFrame, near: DataFrame, k: int) -> DataFrame:
    """Neighbours of all rows from those of the distinct vectors."""
    ids = reps.select(F.col("rep").alias("near"), F.col("ids").alias("near_ids"))
    candidates = near.join(ids, "near").groupBy("rep").agg(
        F.collect_list(F.struct("distance", "near_ids")).alias("sets")
    )
    # Per distinct vector: at most k sets of at most k + 1 ids, and its own.
    own = F.transform("ids", lambda i: F.struct(F.lit(0.0).alias("distance"), i.alias("id")))
    others = F.flatten(F.transform("sets", lambda s: F.transform(
        s["near_ids"], lambda i: F.struct(s["distance"].alias("distance"), i.alias("id")))))
    pool = F.array_sort(F.concat(own, F.coalesce(others, F.array().cast(
        "array<struct<distance:double,id:bigint>>"))))
    pooled = reps.join(candidates, "rep", "left").select(
        "vector", F.slice(pool, 1, k + 1).alias("pool"))
    top = F.slice(F.filter("pool", lambda c: c["id"] != F.col("row_id")), 1, k)
    return (
        points.select("row_id", "vector").join(pooled, "vector")
        .select("row_id", F.posexplode(top).alias("rank", "c"))
        .select("row_id", (F.col("rank") + 1).alias("rank"),
                F.col("c.id").alias("neighbour"), F.col("c.distance").alias("distance"))
    )
