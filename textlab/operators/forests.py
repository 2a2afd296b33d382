"""Random forests whose trees grow in the tasks that hold their rows.

Features become bins of equal frequency, a byte each; of sparse rows only the terms
they hold do. A node of more rows than a task holds is split by counts that the tasks
send for it, level by level, for all trees at once. The rows of a smaller node move to
one task, which grows everything below it. What is drawn depends on the seed, the tree,
the node and the row's id only, so a tree is the same wherever its nodes were split.
Trees are written, by the nodes their parts begin at, and rows come to them to be
classified; the driver holds the splits of the large nodes, not the trees.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlab.operators.neighbours import is_sparse
from textlab.session import written

BINS = 32  # of equal frequency; absent terms have one more
ACCURACY = 1_000  # of the quantiles: their ranks are right to a thousandth
DEPTH = 30
LANES = 16  # copies of the rows of a small table: its trees grow side by side
LOCAL_CELLS = 1 << 24  # bytes of the binned rows that a task holds; an entry of a sparse row counts twice
LOCAL_PART = 16  # where a tree's rows do not fit, nodes of sparse rows are split by counts down to such a part of what fits, so few rows move
SHARD_ROWS = 1 << 16  # rows that a task classifies
TREES, TASKS = 1 << 26, 32  # bytes of trees that go to all rows; if there are more, rows go to the trees. Tasks that classify at least
GROUPS = 1 << 8  # tasks that grow small nodes, or classify their rows, at most
BIN_CELLS, PARTS = 1 << 18, 64  # bytes of binned rows for each partition of their table, so many partitions at most
ENTRIES = 1 << 20  # entries of sparse rows looked at at once
COUNTED = 8  # cells of a table of counts for each number counted; above, numbers are sorted
LEAST_GAIN = 1e-12
SHARES = 1 << 40  # shares are added as integers, so that no order of additions shows
_KEY_BITS, _COUNT_BITS = 6, 6
#: Probabilities of 0, 1, .. copies of a row in a bootstrap sample.
POISSON = np.cumsum(np.exp(-1) / np.cumprod(np.concatenate([[1.0], np.arange(1.0, 31.0)])))


@dataclass(frozen=True)
class Forest:
    """What a forest is; ``weights`` are those of the two classes."""

    trees: int
    subset: str
    criterion: str
    dims: int
    weights: tuple[float, float] = (1.0, 1.0)
    seed: int = 42

    @classmethod
    def of(cls, params: Mapping, dims: int, counts: Sequence[int]) -> Forest:
        criterion, subset = params.get("criterion") or "gini", params.get("max_features") or "sqrt"
        if criterion not in ("gini", "entropy"):
            raise ValueError(f"unknown criterion: {criterion}")
        if subset not in ("sqrt", "log2", "all"):
            raise ValueError(f"unknown share of features: {subset}")
        weights = (1.0, 1.0)
        if params.get("class_weight") == "balanced":
            held = sum(n > 0 for n in counts)
            weights = tuple(sum(counts) / (held * n) if n else 0.0 for n in counts)
        return cls(int(params.get("n_estimators") or 100), subset, criterion, dims, weights)

    @property
    def drawn(self) -> int:
        """Features that a node looks at."""
        size = {"sqrt": np.sqrt(self.dims), "log2": np.log2(max(2, self.dims)), "all": self.dims}[self.subset]
        return min(self.dims, max(1, int(np.ceil(size))))


def mixed(*numbers) -> np.ndarray:
    """A hash of 64 bits of some integers, or of arrays of them."""
    out = np.zeros(1, np.uint64)
    with np.errstate(over="ignore"):
        for number in numbers:
            z = out + np.asarray(number, np.int64).astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
            z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            out = z ^ (z >> np.uint64(31))
    return out


def copies(forest: Forest, tree: int, hashes: np.ndarray) -> np.ndarray:
    """How often each row is in the bootstrap sample of a tree."""
    share = (mixed(forest.seed, tree, hashes) >> np.uint64(11)) / float(1 << 53)
    return np.searchsorted(POISSON, share, side="right")


def draws(forest: Forest, tree: int, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Factor and shift by which a node chooses features: those that
    ``factor * (feature - shift) % dims`` takes below the number of features drawn."""
    p = forest.dims
    shift = (mixed(forest.seed, tree, nodes, -1) % np.uint64(p)).astype(np.int64)
    factor = np.zeros(len(nodes), np.int64)
    for attempt in range(64):
        if factor.all():
            break
        new = 1 + (mixed(forest.seed, tree, nodes, attempt) % np.uint64(max(1, p - 1))).astype(np.int64)
        factor = np.where((factor == 0) & (np.gcd(new, p) == 1), new, factor)
    return np.where(factor == 0, 1, factor), shift


def inverses(factor: np.ndarray, p: int) -> np.ndarray:
    """Of each factor, the one that undoes it modulo ``p``."""
    each, place = np.unique(factor, return_inverse=True)
    return np.array([pow(int(f), -1, p) if p > 1 else 0 for f in each], np.int64)[place]


class Block:
    """Binned rows of a task, dense or sparse."""

    def __init__(self, table: pa.Table, dims: int):
        table = table.combine_chunks()
        column = lambda name: table.column(name).combine_chunks()
        self.dims, self.n = dims, table.num_rows
        self.y, self.hashes = column("label").to_numpy(zero_copy_only=False), column("hash").to_numpy()
        self.y = np.nan_to_num(self.y.astype(float)).astype(np.int64)  # rows without a label are only classified
        data = b"".join(column("bins").to_pylist())
        self.bins = np.frombuffer(data, np.uint8)
        self.sparse = "terms" in table.column_names
        if self.sparse:
            terms = column("terms")
            if isinstance(terms, pa.ChunkedArray):
                terms = pa.concat_arrays(terms.chunks or [pa.array([], terms.type)])
            offsets = terms.offsets.to_numpy() if self.n else np.zeros(1, np.int32)
            self.first = (offsets - offsets[0]).astype(np.int64)
            self.term = terms.flatten().to_numpy()
        else:
            self.bins = self.bins.reshape(self.n, dims)

    @cached_property
    def code(self) -> np.ndarray:
        """Entries by row and term, and one behind them."""
        return np.append(np.repeat(np.arange(self.n), np.diff(self.first)) * self.dims + self.term, -1)

    @cached_property
    def after(self) -> np.ndarray:
        """The bins of the entries, and one behind them."""
        return np.append(self.bins, np.uint8(0))

    @cached_property
    def columns(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Entries by term: where each term begins, rows, bins, and bins that are 0 where a row holds the term once more."""
        order = np.argsort(self.term, kind="stable")
        start = np.concatenate([[0], np.cumsum(np.bincount(self.term, minlength=self.dims))])
        row, bins = np.repeat(np.arange(self.n, dtype=np.int32), np.diff(self.first))[order], self.bins[order]
        term = self.term[order]
        again = np.flatnonzero((np.diff(row, prepend=-1) == 0) & (np.diff(term, prepend=-1) == 0))
        once = bins
        if len(again):
            once = bins.copy()
            once[again] = 0
        return start, row, bins, once

    def at(self, rows: np.ndarray, features: np.ndarray) -> np.ndarray:
        """The bins of some rows, each in a feature of its own."""
        if not self.sparse:
            return self.bins[rows, features]
        wanted = rows * self.dims + features
        place = np.searchsorted(self.code[:-1], wanted)
        return np.where(self.code[place] == wanted, self.after[place], 0)

    def holding(self, feature: int, cut: int) -> np.ndarray:
        """The rows that a split sends to the right, of sparse rows."""
        start, row, _, once = self.columns
        part = slice(start[feature], start[feature + 1])
        return row[part][once[part] >= cut]

    def goes_right(self, rows: np.ndarray, node: np.ndarray, feature: np.ndarray, cut: np.ndarray) -> np.ndarray:
        """Which rows go to the right of their nodes' splits."""
        if self.sparse:
            split = np.flatnonzero(feature >= 0)
            start, row, _, once = self.columns
            first, sizes = start[feature[split]], start[feature[split] + 1] - start[feature[split]]
            if sizes.sum() <= 16 * len(rows):
                place = np.full(self.n, -1)
                place[rows] = np.arange(len(rows))
                of = np.repeat(split, sizes)
                entry = np.arange(len(of)) + np.repeat(first - np.cumsum(sizes) + sizes, sizes)
                i = place[row[entry]]
                hit = (i >= 0) & (node[i] == of) & (once[entry] >= cut[of])
                out = np.zeros(len(rows), bool)
                out[i[hit]] = True
                return out
        return self.at(rows, feature[node]) >= cut[node]

    def chosen(self, rows: np.ndarray, node: np.ndarray, factor: np.ndarray, shift: np.ndarray, drawn: int):
        """``i, j, bin``: places in ``rows``, numbers of the features their nodes chose, and bins above the lowest."""
        p = self.dims
        if not self.sparse:
            features = (shift[:, None] + inverses(factor, p)[:, None] * np.arange(drawn)) % p
            found = self.bins[rows[:, None], features[node]]
            i, j = np.nonzero(found)
            return i, j, found[i, j]
        sizes = self.first[rows + 1] - self.first[rows]
        # A node of many entries reads the terms it chose, not all that its rows hold.
        large = np.bincount(node, sizes, minlength=len(factor)) > 4 * drawn + 2 * drawn * len(self.term) / p
        out = []
        if large.any():
            out += self.by_terms(np.flatnonzero(large), rows, node, factor, shift, drawn)
        places = np.flatnonzero(~large[node])
        sizes, rows = sizes[places], rows[places]
        upto, begin = np.cumsum(sizes), 0
        while begin < len(rows):
            before = upto[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(upto, before + ENTRIES, side="right")))
            part = slice(begin, end)
            i = np.repeat(places[part], sizes[part])
            entry = np.arange(len(i)) + np.repeat(self.first[rows[part]] - (upto[part] - sizes[part] - before), sizes[part])
            own = node[i]
            j = factor[own] * (self.term[entry] - shift[own]) % p
            hit = np.flatnonzero(j < drawn)
            out.append((i[hit], j[hit], self.bins[entry[hit]]))
            begin = end
        if not out:
            return (np.zeros(0, np.int64),) * 3
        return tuple(np.concatenate(x) for x in zip(*out))

    def by_terms(self, nodes: np.ndarray, rows: np.ndarray, node: np.ndarray, factor: np.ndarray, shift: np.ndarray, drawn: int):
        """What ``chosen`` gives for the rows of some nodes, from the entries of the terms that these chose."""
        start, row, bins, _ = self.columns
        place = np.full(self.n, -1)
        place[rows] = np.arange(len(rows))
        out = []
        for some in np.array_split(nodes, -(-len(nodes) * drawn // ENTRIES)):
            features = (shift[some][:, None] + inverses(factor[some], self.dims)[:, None] * np.arange(drawn)) % self.dims
            features = features.ravel()
            sizes = start[features + 1] - start[features]
            upto, begin = np.cumsum(sizes), 0
            while begin < len(features):
                before = upto[begin - 1] if begin else 0
                end = max(begin + 1, int(np.searchsorted(upto, before + ENTRIES, side="right")))
                part = slice(begin, end)
                which = np.repeat(np.arange(begin, end), sizes[part])
                entry = np.arange(len(which)) + np.repeat(start[features[part]] - (upto[part] - sizes[part] - before), sizes[part])
                i = place[row[entry]]
                hit = np.flatnonzero((i >= 0) & (node[i] == some[which // drawn]))
                out.append((i[hit], which[hit] % drawn, bins[entry[hit]]))
                begin = end
        return out


def counted(node: np.ndarray, j: np.ndarray, bins: np.ndarray, n: np.ndarray, y: np.ndarray, drawn: int):
    """Sorted keys of node, feature and bin, with the rows of either class."""
    key = (node * drawn + j) << _KEY_BITS | bins.astype(np.int64)
    if len(key) and int(key.max()) < COUNTED * len(key):
        n1 = np.bincount(key, n * y).astype(np.int64)
        n0 = np.bincount(key, n).astype(np.int64) - n1
        key = np.flatnonzero(n0 + n1)
        return key, n0[key], n1[key]
    packed = np.sort(key << _COUNT_BITS | n << 1 | y)
    key, n, y = packed >> _COUNT_BITS, (packed >> 1) & 31, packed & 1
    return merged(key, n * (1 - y), n * y)


def merged(key: np.ndarray, n0: np.ndarray, n1: np.ndarray):
    """Sums of the counts of equal keys, which come sorted."""
    if not len(key):
        return key, n0, n1
    first = np.flatnonzero(np.diff(key, prepend=key[0] - 1))
    return key[first], np.add.reduceat(n0, first), np.add.reduceat(n1, first)


def impurity(a: np.ndarray, b: np.ndarray, criterion: str) -> np.ndarray:
    total = np.maximum(a + b, 1e-300)
    p, q = a / total, b / total
    if criterion == "gini":
        return 1 - p * p - q * q
    return -(p * np.log2(np.maximum(p, 1e-300)) + q * np.log2(np.maximum(q, 1e-300)))


def best_splits(forest: Forest, key: np.ndarray, n0: np.ndarray, n1: np.ndarray, t0: np.ndarray, t1: np.ndarray):
    """``node, j, bin`` of the best split of every node that has one; rows from that bin on go right."""
    if not len(key):
        return (np.zeros(0, np.int64),) * 3
    group = key >> _KEY_BITS
    last = np.append(np.flatnonzero(np.diff(group)), len(key) - 1)
    end = np.repeat(last, np.diff(last, prepend=-1))
    c0, c1 = np.cumsum(n0), np.cumsum(n1)
    node = group // forest.drawn
    r0, r1 = c0[end] - c0 + n0, c1[end] - c1 + n1
    l0, l1 = t0[node] - r0, t1[node] - r1
    w0, w1 = forest.weights
    left, right, total = l0 * w0 + l1 * w1, r0 * w0 + r1 * w1, t0 * w0 + t1 * w1
    whole = impurity(t0 * w0, t1 * w1, forest.criterion)[node] * total[node]
    gain = whole - left * impurity(l0 * w0, l1 * w1, forest.criterion) - right * impurity(r0 * w0, r1 * w1, forest.criterion)
    gain = np.where((l0 + l1 > 0) & (r0 + r1 > 0), (gain / np.maximum(total[node], 1e-300)).round(12), -1.0)
    first = np.flatnonzero(np.diff(node, prepend=-1))
    top = np.repeat(np.maximum.reduceat(gain, first), np.diff(np.append(first, len(node))))
    hit = np.flatnonzero((gain == top) & (gain > LEAST_GAIN))
    of, at = np.unique(node[hit], return_index=True)
    best = hit[at]
    return of, group[best] % forest.drawn, key[best] & ((1 << _KEY_BITS) - 1)


def named(forest: Forest, factor: np.ndarray, shift: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The features that nodes chose as number ``j``."""
    return (shift + inverses(factor, forest.dims) * j) % forest.dims


class Tree:
    """Nodes in order of their levels: feature (-1: a leaf), bin, left child (the right one follows), share of class 1."""

    def __init__(self, feature, cut, left, share):
        self.feature, self.cut, self.left, self.share = feature, cut, left, share

    def stored(self) -> bytes:
        return (np.int64(len(self.feature)).tobytes() + self.share.astype(np.float64).tobytes() + self.feature.astype(np.int32).tobytes()
                + self.left.astype(np.int32).tobytes() + self.cut.astype(np.uint8).tobytes())

    @classmethod
    def read(cls, data: bytes) -> Tree:
        n = int(np.frombuffer(data, np.int64, 1)[0])
        at, parts = 8, []
        for kind in (np.float64, np.int32, np.int32, np.uint8):
            parts.append(np.frombuffer(data, kind, n, at))
            at += parts[-1].nbytes
        return cls(parts[1], parts[3], parts[2], parts[0])

    def shares(self, block: Block, rows: np.ndarray, place: np.ndarray | None = None) -> np.ndarray:
        """The shares of class 1 that rows end at, from the root or from the roots at ``place``."""
        place = np.zeros(len(rows), np.int64) if place is None else place.copy()
        inner = np.flatnonzero(self.feature[place] >= 0)
        while len(inner):
            at = place[inner]
            right = block.at(rows[inner], self.feature[at].astype(np.int64)) >= self.cut[at]
            place[inner] = self.left[at] + right
            inner = inner[self.feature[place[inner]] >= 0]
        return self.share[place]


def shares_of(forest: Forest, t0: np.ndarray, t1: np.ndarray) -> np.ndarray:
    a, b = t0 * forest.weights[0], t1 * forest.weights[1]
    return b / np.maximum(a + b, 1e-300)


def grown(forest: Forest, block: Block, tree: int, root: int | np.ndarray, below: np.ndarray | None = None) -> Tree:
    """What is below a node, from all of its rows; or below several, ``below`` says which for each row. Roots come first."""
    n = copies(forest, tree, block.hashes)
    rows = np.flatnonzero(n)
    ids = np.atleast_1d(np.asarray(root, np.int64))
    node, made, out = np.zeros(len(rows), np.int64) if below is None else below[rows], len(ids), []
    while len(ids):
        y, w = block.y[rows], n[rows]
        t1 = np.bincount(node, w * y, minlength=len(ids))
        t0 = np.bincount(node, w, minlength=len(ids)) - t1
        feature, cut, left = np.full(len(ids), -1, np.int64), np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
        is_open = (t0 > 0) & (t1 > 0) & (ids < 1 << DEPTH)
        kept = is_open[node]
        rows, node = rows[kept], node[kept]
        factor, shift = draws(forest, tree, ids)
        i, j, bins = block.chosen(rows, node, factor, shift, forest.drawn)
        of, number, bound = best_splits(forest, *counted(node[i], j, bins, n[rows[i]], block.y[rows[i]], forest.drawn), t0, t1)
        feature[of], cut[of] = named(forest, factor[of], shift[of], number), bound
        left[of] = made + 2 * np.arange(len(of))
        made += 2 * len(of)
        out.append((feature, cut, left, shares_of(forest, t0, t1)))
        kept = feature[node] >= 0
        rows, node = rows[kept], node[kept]
        right = block.goes_right(rows, node, feature, cut)
        rank = np.zeros(len(ids), np.int64)
        rank[of] = np.arange(len(of))
        node = 2 * rank[node] + right
        ids = (2 * ids[of][:, None] + np.arange(2)).ravel()
    return Tree(*(np.concatenate(x) for x in zip(*out)))


#: Of a tree's large nodes: their feature and bin, or the share of class 1 in a large leaf.
Tops = dict[int, dict[int, tuple[int, int, float | None]]]


def ends(tops: Tops, tree: int, block: Block, rows: np.ndarray) -> np.ndarray:
    """The first nodes on the rows' ways that no split of ``tops`` is known for."""
    known = tops.get(tree, {})
    if block.sparse:
        # Rows that go left keep their slot, so a split touches only rows that hold its term.
        slot, names, slots = np.zeros(block.n, np.int64), [1], {1: 0}
        for at in sorted(known):
            feature, cut, share = known[at]
            if share is None:
                own = slots[at]
                held = block.holding(feature, cut)
                slot[held[slot[held] == own]] = len(names)
                slots[2 * at], slots[2 * at + 1], names[own] = own, len(names), 2 * at
                names.append(2 * at + 1)
        return np.array(names)[slot[rows]]
    node = np.ones(len(rows), np.int64)
    for at in sorted(known):
        feature, cut, share = known[at]
        if share is None:
            here = np.flatnonzero(node == at)
            right = block.at(rows[here], np.full(len(here), feature)) >= cut
            node[here] = 2 * at + right
    return node


def dense_cuts(train: DataFrame, dims: int) -> list[np.ndarray]:
    """The quantiles of every element of the vectors.

    A batch of rows sends every ``step``-th of an element's sorted values, for the ``step`` values
    up to it, so a rank is right to half of ``1 / ACCURACY``; few rows send all their values.
    """

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            flat = batch.column(0).flatten()
            x = np.sort(flat.to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, dims), axis=0)  # nulls come last
            held = batch.num_rows - (np.asarray(flat.is_null()).reshape(batch.num_rows, dims).sum(axis=0) if flat.null_count else np.zeros(dims, np.int64))
            step = max(1, batch.num_rows // (2 * ACCURACY))
            places = [np.append(np.arange(step - 1, n - 1, step), n - 1) if n else np.zeros(0, np.int64) for n in held.tolist()]
            yield pa.RecordBatch.from_arrays([
                pa.array(np.arange(dims, dtype=np.int32)), pa.array([x[at, i].tobytes() for i, at in enumerate(places)], pa.binary()),
                pa.array([np.diff(at, prepend=-1).astype(np.int64).tobytes() for at in places], pa.binary())], names=["element", "part", "counts"])

    def cut(table: pa.Table) -> pa.Table:
        x = np.frombuffer(b"".join(table.column("part").to_pylist()))
        n = np.frombuffer(b"".join(table.column("counts").to_pylist()), np.int64)
        order = np.argsort(x, kind="stable")
        x, upto = x[order], np.cumsum(n[order])
        wanted = np.ceil(np.arange(1, BINS) / BINS * upto[-1]) if len(x) else np.zeros(0)
        found = np.unique(x[np.searchsorted(upto, wanted)]) if len(x) else x
        return pa.table([table.column("element").slice(0, 1), pa.array([found.tobytes()], pa.binary())], names=["element", "cuts"])

    found = train.select("vector").mapInArrow(gather, "element int, part binary, counts binary").groupBy("element").applyInArrow(
        cut, "element int, cuts binary").collect()  # a row for each element
    cuts = {r["element"]: np.frombuffer(bytes(r["cuts"])) for r in found}
    return [cuts.get(i, np.zeros(0)) for i in range(dims)]


def binned(features: DataFrame, train: DataFrame, dims: int) -> DataFrame:
    """``features`` with ``bins``, and ``terms`` if sparse, by quantiles of the training rows."""
    shares = [i / BINS for i in range(1, BINS)]
    if not is_sparse(features):
        cuts = dense_cuts(train, dims)

        def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = batch.column(batch.schema.get_field_index("vector")).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, dims)
                bins = np.stack([np.searchsorted(c, x[:, i]) for i, c in enumerate(cuts)], axis=1).astype(np.uint8)
                at = batch.schema.get_field_index("vector")
                columns = [c for i, c in enumerate(batch.columns) if i != at] + [pa.array([b.tobytes() for b in bins], pa.binary())]
                names = [n for n in batch.schema.names if n != "vector"] + ["bins"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

        kept = [f"{f.name} {f.dataType.simpleString()}" for f in features.schema if f.name != "vector"]
        return features.mapInArrow(encode, ", ".join([*kept, "bins binary"]))
    entry = F.explode(F.arrays_zip("vector.terms", "vector.weights")).alias("e")
    held = F.col("e.weights") != 0
    cuts = train.select(entry).where(held).groupBy(F.col("e.terms").alias("term")).agg(
        F.array_distinct(F.percentile_approx("e.weights", shares, ACCURACY)).alias("cuts"))
    weight = F.col("weight")
    bin_of = 1 + F.size(F.filter("cuts", lambda c: c < weight))
    cells = features.select("key", entry).where(held).select("key", F.col("e.terms").alias("term"), F.col("e.weights").alias("weight")).join(
        written(cuts, "cuts"), "term").select("key", F.struct("term", bin_of.cast("tinyint").alias("bin")).alias("c"))
    rows = cells.groupBy("key").agg(F.sort_array(F.collect_list("c")).alias("c"))
    none = F.array()
    return features.drop("vector").join(rows, "key", "left").withColumns({
        "terms": F.coalesce("c.term", none.cast("array<int>")), "bins": F.coalesce("c.bin", none.cast("array<tinyint>"))}).drop("c")


def packed(rows: DataFrame) -> DataFrame:
    """Bins as bytes."""
    if dict(rows.dtypes)["bins"] == "binary":
        return rows

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("bins")
            lists = batch.column(at)
            offsets, data = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False).astype(np.uint8).tobytes()
            joined = pa.array([data[a:b] for a, b in zip(offsets[:-1], offsets[1:])], pa.binary())
            yield pa.RecordBatch.from_arrays([joined if i == at else c for i, c in enumerate(batch.columns)], names=batch.schema.names)

    kinds = [f"{f.name} {'binary' if f.name == 'bins' else f.dataType.simpleString()}" for f in rows.schema]
    return rows.mapInArrow(pack, ", ".join(kinds))


def large_nodes(forest: Forest, train: DataFrame, n_rows: int, limit: int) -> Tops:
    """Splits of all nodes of more than ``limit`` rows, from counts by node, feature and bin."""
    tops: Tops = {}
    opened = {tree: {1} for tree in range(forest.trees)} if n_rows > limit else {}
    counts = "tree int, node long, key array<long>, n0 array<long>, n1 array<long>, t0 long, t1 long, rows long"
    while opened:
        now, known = dict(opened), {t: dict(v) for t, v in tops.items()}

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                block = Block(pa.Table.from_batches([batch]), forest.dims)
                out = [[] for _ in range(8)]
                for tree, nodes in now.items():
                    n = copies(forest, tree, block.hashes)
                    rows = np.flatnonzero(n)
                    ids = np.array(sorted(nodes), np.int64)
                    at = ends(known, tree, block, rows)
                    node = np.searchsorted(ids, at)
                    kept = np.append(ids, 0)[node] == at
                    rows, node = rows[kept], node[kept]
                    y, w = block.y[rows], n[rows]
                    i, j, bins = block.chosen(rows, node, *draws(forest, tree, ids), forest.drawn)
                    key, n0, n1 = counted(node[i], j, bins, w[i], y[i], forest.drawn)
                    of = (key >> _KEY_BITS) // forest.drawn
                    all1, all_rows = (np.bincount(node, x, minlength=len(ids)).astype(np.int64) for x in (w * y, np.ones(len(node))))
                    all0 = np.bincount(node, w, minlength=len(ids)).astype(np.int64) - all1
                    bounds = np.searchsorted(of, np.arange(len(ids) + 1))
                    for place, name in enumerate(ids):
                        part = slice(bounds[place], bounds[place + 1])
                        values = (tree, int(name), key[part] - (place * forest.drawn << _KEY_BITS), n0[part], n1[part],
                                  int(all0[place]), int(all1[place]), int(all_rows[place]))
                        for column, value in zip(out, values):
                            column.append(value)
                lists = pa.list_(pa.int64())
                kinds = (pa.int32(), pa.int64(), lists, lists, lists, pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)],
                                                 names=["tree", "node", "key", "n0", "n1", "t0", "t1", "rows"])

        def split(table: pa.Table) -> pa.Table:
            flat = lambda name: pc.list_flatten(table.column(name)).to_numpy()
            total = lambda name: np.array([sum(table.column(name).to_pylist())], np.int64)
            tree, node = table.column("tree")[0].as_py(), table.column("node")[0].as_py()
            key, n0, n1 = flat("key"), flat("n0"), flat("n1")
            order = np.argsort(key, kind="stable")
            t0, t1 = total("t0"), total("t1")
            found = ((),) * 3
            if t0[0] and t1[0] and node < 1 << DEPTH:
                found = best_splits(forest, *merged(key[order], n0[order], n1[order]), t0, t1)
            factor, shift = draws(forest, tree, np.array([node]))
            feature = int(named(forest, factor, shift, found[1])[0]) if len(found[0]) else None
            cut = int(found[2][0]) if feature is not None else None
            return pa.table([pa.array([v], k) for v, k in (
                (tree, pa.int32()), (node, pa.int64()), (feature, pa.int32()), (cut, pa.int32()),
                (float(shares_of(forest, t0, t1)[0]), pa.float64()), (int(total("rows")[0]), pa.int64()))],
                names=["tree", "node", "feature", "cut", "share", "rows"])

        found = train.mapInArrow(count, counts).groupBy("tree", "node").applyInArrow(
            split, "tree int, node long, feature int, cut int, share double, rows long")
        opened = {}
        for r in found.collect():  # a row for each large node
            own = tops.setdefault(r["tree"], {})
            if r["rows"] <= limit:
                continue
            if r["feature"] is None:
                own[r["node"]] = (-1, 0, r["share"])
                continue
            own[r["node"]] = (r["feature"], r["cut"], None)
            opened.setdefault(r["tree"], set()).update((2 * r["node"], 2 * r["node"] + 1))
    return tops


def dealt(rows: DataFrame, forest: Forest, tops: Tops, lanes: int, train: bool, shards: int = 1) -> DataFrame:
    """Rows by ``lane, node, shard``: all that the trees of a lane learn, or classify, below a node.

    Without large nodes a lane has several trees, which share their rows.
    """
    schema = rows.schema

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            block = Block(pa.Table.from_batches([batch]), forest.dims)
            shard = mixed(block.hashes) % np.uint64(shards)
            for lane in range(lanes):
                held, node = np.arange(block.n), np.ones(block.n, np.int64)
                if any(tops.values()):
                    if train:
                        held = np.flatnonzero(copies(forest, lane, block.hashes))
                    node = ends(tops, lane, block, held)
                    leaves = [k for k, v in tops.get(lane, {}).items() if v[2] is not None]
                    if train:
                        inside = ~np.isin(node, leaves)
                        held, node = held[inside], node[inside]
                part = batch.take(pa.array(held))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(np.full(len(held), lane, np.int32)), pa.array(node), pa.array(shard[held].astype(np.int32))],
                    names=[*batch.schema.names, "lane", "node", "shard"])

    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in schema]
    return rows.mapInArrow(deal, ", ".join([*kinds, "lane int", "node long", "shard int"]))


def predictions(train: DataFrame, test: DataFrame, params: Mapping, keep: Sequence[str]) -> DataFrame:
    """``test`` rows (columns ``keep``) with the ``prediction`` of a forest grown on ``train``; written.

    Both have ``row_id, vector, label``; vectors are arrays, or sparse rows (a struct
    ``terms, weights``) with weights of 0 or more. Training rows without a label are left out.
    """
    spark = train.sparkSession
    if "vector" not in train.columns:
        train, test = (t.withColumn("vector", vector_to_array("features")) for t in (train, test))
    columns = ["vector", F.col("label").cast("int").alias("label"), F.xxhash64("row_id").alias("hash")]
    learnt = train.where("label IS NOT NULL").select(F.lit(True).alias("train"), *columns, *[F.lit(None).cast(test.schema[c].dataType).alias(f"_{c}") for c in keep])
    judged = test.select(F.lit(False).alias("train"), *columns, *[F.col(c).alias(f"_{c}") for c in keep])
    rows = written(learnt.unionByName(judged).withColumn("key", F.monotonically_increasing_id()), "rows")
    learnt = rows.where("train")
    sparse = is_sparse(rows)
    size = F.size("vector.terms") if sparse else F.size("vector")
    dims = (F.max(F.array_max("vector.terms")) + 1) if sparse else F.max(size)
    facts = rows.agg(
        F.count_if("train").alias("n"), F.count_if(F.col("train") & (F.col("label") == 0)).alias("n0"),
        F.count_if(F.col("train") & (F.col("label") == 1)).alias("n1"), F.count_if(~F.col("train")).alias("tested"),
        F.avg(size).alias("cells"), dims.alias("dims")).first()
    if not facts["n"]:
        raise ValueError("a forest needs labelled rows")
    if facts["n0"] + facts["n1"] != facts["n"]:
        raise ValueError("labels are 0 and 1")
    forest = Forest.of(params, int(facts["dims"] or 1), (facts["n0"], facts["n1"]))
    slim = rows.select("key", "train", "label", "hash", "vector")
    cells = max(1.0, (2 if sparse else 1) * facts["cells"])
    parts = 1 + min(PARTS - 1, int(cells * (facts["n"] + facts["tested"])) // BIN_CELLS)
    bins = written(packed(binned(slim, learnt, forest.dims)).repartition(parts, "hash"), "bins")
    limit, buckets = int(LOCAL_CELLS / cells), None
    if sparse and facts["n"] > limit:
        buckets, limit = -(-2 * facts["n"] // max(1, limit)), max(1, limit // LOCAL_PART)
    tops = large_nodes(forest, bins.where("train").drop("train"), facts["n"], limit)
    split = any(tops.values())
    lanes = forest.trees if split else min(LANES, forest.trees)
    shards = max(1, -(-facts["tested"] // SHARD_ROWS))
    groups = min(GROUPS, 2 * lanes * (1 + max((len(v) for v in tops.values()), default=0)))
    # Small nodes of sparse rows are grown some at a time, as many as a task holds.
    bucket = F.pmod(F.xxhash64("node"), F.lit(buckets)).cast("long") if buckets else F.col("node")

    def grow(table: pa.Table) -> pa.Table:
        lane, bucket = table.column("lane")[0].as_py(), table.column("bucket")[0].as_py()
        table = table.sort_by("hash")
        block = Block(table, forest.dims)
        roots, below = np.unique(table.column("node").to_numpy(), return_inverse=True)
        trees = range(lane, forest.trees, lanes)
        stored = [grown(forest, block, tree, roots, below).stored() for tree in trees]
        n = len(stored)
        return pa.table([pa.array(list(trees), pa.int32()), pa.array([lane] * n, pa.int32()), pa.array([bucket] * n, pa.int64()),
                         pa.array([roots] * n, pa.list_(pa.int64())), pa.array(stored, pa.binary())], names=["tree", "lane", "bucket", "roots", "data"])

    own = dealt(bins.where("train").drop("train"), forest, tops, lanes, train=True).withColumn("bucket", bucket)
    trees = written(own.repartition(groups, "lane", "bucket").groupBy("lane", "bucket").applyInArrow(
        grow, "tree int, lane int, bucket long, roots array<long>, data binary"), "trees")

    def parts_of(table: pa.Table) -> dict[int, list[tuple[np.ndarray, bytes]]]:
        out: dict[int, list[tuple[np.ndarray, bytes]]] = {}
        for tree, roots, data in zip(*(table.column(c).to_pylist() for c in ("tree", "roots", "data"))):
            out.setdefault(tree, []).append((np.array(roots, np.int64), data))
        return out

    def voted(block: Block, tree: int, at: np.ndarray, parts: list[tuple[np.ndarray, bytes]]) -> np.ndarray:
        """The shares of class 1 by a tree, of rows that its large nodes sent to ``at``."""
        leaves = sorted((node, share) for node, (_, _, share) in tops.get(tree, {}).items() if share is not None)
        nodes, said = np.array([node for node, _ in leaves] + [0], np.int64), np.array([share for _, share in leaves] + [0.0])
        place = np.searchsorted(nodes[:-1], at)
        share = np.where(nodes[place] == at, said[place], 0.0)
        for roots, data in parts:
            place = np.searchsorted(roots, at)
            rows = np.flatnonzero(np.append(roots, 0)[place] == at)
            share[rows] = Tree.read(data).shares(block, rows, place[rows])
        return np.round(share * SHARES).astype(np.int64)

    def judged(left: pa.Table, say: Callable[[Block], np.ndarray]) -> pa.Table:
        total, keys = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if left.num_rows:
            keys, total = left.column("key").combine_chunks().to_numpy(), say(Block(left, forest.dims))
        return pa.table([pa.array(keys, pa.int64()), pa.array(total, pa.int64())], names=["key", "total"])

    def by_rows(left: pa.Table, right: pa.Table) -> pa.Table:
        parts = parts_of(right)
        every = range(forest.trees)
        return judged(left, lambda block: sum(voted(block, t, ends(tops, t, block, np.arange(block.n)), parts.get(t, [])) for t in every))

    def by_trees(left: pa.Table, right: pa.Table) -> pa.Table:
        parts = parts_of(right)
        of = list(parts) or ([left.column("lane")[0].as_py()] if left.num_rows else [])
        return judged(left, lambda block: sum(voted(block, t, left.column("node").to_numpy(), parts.get(t, [])) for t in of))

    asked, spread = bins.where("NOT train").drop("train"), trees
    if (trees.agg(F.sum(F.length("data"))).first()[0] or 0) <= TREES:
        by, groups, say = ["shard"], max(shards, min(TASKS, -(-facts["tested"] * TASKS // SHARD_ROWS))), by_rows
        shards = groups
        asked = asked.withColumn("shard", F.pmod(F.xxhash64("hash"), F.lit(shards)).cast("int"))
    else:
        by, say = ["lane", "bucket", "shard"], by_trees
        asked = dealt(asked, forest, tops, lanes, train=False, shards=shards).withColumn("bucket", bucket)
    spread = spread.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(max(0, shards - 1)))))
    said = asked.repartition(max(1, groups), *by).groupBy(*by).cogroup(spread.repartition(max(1, groups), *by).groupBy(*by)).applyInArrow(
        say, "key long, total long")
    votes = said.groupBy("key").agg(F.sum("total").alias("total"))
    positive = 2 * F.col("total") > F.lit(forest.trees * SHARES)
    out = rows.where("NOT train").join(votes, "key").select(
        *[F.col(f"_{c}").alias(c) for c in keep], positive.cast("int").alias("prediction"))
    return written(out, "predictions")
