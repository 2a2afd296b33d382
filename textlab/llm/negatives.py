"""Hard-negative mining by threshold joins over inner products.

Anchors are joined with all rows whose score reaches a threshold, by an inverted
index in the manner of L2AP: the dimensions of a row behind which its remaining
norm cannot reach any anchor's threshold are not indexed; partial scores gather
over the postings of the indexed ones, and a pair goes as soon as its partial
score and the product of both remaining norms stay below the threshold. Pairs
that are left are scored exactly. Thresholds begin high and are lowered for the
anchors whose windows have not filled, down to the end of their windows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textlab.llm.batches import materialised
from textlab.operators.ranking import first_rows
from textlab.session import written

SCALE = 256
BLOCK_ANCHORS = 1_024  # anchors joined at once: bounds what tasks are sent
SAMPLE = 4_096  # rows from which the first thresholds are read; results don't depend on them
PAIRS = 1 << 20  # of anchors and rows that a task holds partial scores of
GROUP = 16  # neighbouring dimensions whose postings are worked on together
SPARSE = 0.05  # share of pairs left at which they are followed one by one
NOTHING = np.iinfo(np.int64).max  # a threshold that no score reaches
LEAST, MOST = -(1 << 63), (1 << 63) - 1  # of a long
EXACT = 1 << 52  # sums below are exact in doubles
FOUND = "target int, row long, vec_id long, score long"


def quantised(vectors: DataFrame, id_col: str, vector_col: str, label: Column) -> DataFrame:
    """``row, vec_id, label, v``: rows that take part, each with a number of its own and integer components."""
    x = F.col(vector_col)
    odd = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    scaled = F.transform(x, lambda c: F.floor(c.cast("double") * F.lit(float(SCALE))))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), label.cast("long").alias("label"), x.alias(vector_col))
    rows = rows.where(F.col("label").isNotNull() & x.isNotNull() & ~odd).select("vec_id", "label", scaled.alias("v"))
    return written(rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", "v"), "vectors")


class Vectors:
    """Rows as arrays; components missing at the end of a vector are 0."""

    def __init__(self, batch: pa.RecordBatch | pa.Table, dims: int):
        column = lambda name: batch.column(batch.schema.get_field_index(name))
        self.row = column("row").to_numpy()
        self.label = column("label").to_numpy()
        ids = column("vec_id")
        self.nameless = ids.is_null().to_numpy(zero_copy_only=False)
        self.vec_id = ids.fill_null(MOST).to_numpy()
        lists = column("v")
        sizes = np.diff(lists.offsets.to_numpy())
        self.v = np.zeros((len(sizes), dims), np.int64)
        self.v[np.arange(dims) < sizes[:, None]] = lists.flatten().to_numpy()

    def part(self, rows: slice | np.ndarray) -> Vectors:
        out = object.__new__(Vectors)
        for name in ("row", "label", "nameless", "vec_id", "v"):
            setattr(out, name, getattr(self, name)[rows])
        return out

    def suffix_norms(self) -> np.ndarray:
        """The norm of what is left of every vector from each group of dimensions on, rounded up; a last column of 0."""
        n, dims = self.v.shape
        groups = -(-dims // GROUP)
        squares = np.zeros((n, groups * GROUP))
        squares[:, :dims] = self.v.astype(np.float64) ** 2
        left = np.zeros((n, groups + 1))
        left[:, :-1] = squares.reshape(n, groups, GROUP).sum(axis=2)[:, ::-1].cumsum(axis=1)[:, ::-1]
        return np.sqrt(left) * (1 + 1e-9)


def scores(a: Vectors, b: Vectors, i: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Exact inner products of the pairs; beyond a long they are held at its ends."""
    most = float(np.abs(a.v).max(initial=0)) * float(np.abs(b.v).max(initial=0)) * a.v.shape[1]
    if most < EXACT:
        return np.einsum("ij,ij->i", a.v[i], b.v[k])
    pairs = zip(a.v[i].tolist(), b.v[k].tolist())
    return np.array([min(max(sum(x * y for x, y in zip(p, q)), LEAST), MOST) for p, q in pairs], np.int64)


def reaching(anchors: Vectors, rest: np.ndarray, rows: Vectors, least: np.ndarray, wanted: np.ndarray):
    """The wanted pairs whose score is at least the anchor's ``least``: anchor, row, score.

    ``rest`` are the anchors' suffix norms. All bounds are doubles, rounded away
    from the threshold by more than their error.
    """
    left = rows.suffix_norms()
    groups = left.shape[1] - 1
    least = least.astype(np.float64)
    low = least - np.abs(least) * 1e-9 - 1e-3
    error = 1e-9 * rest[:, 0].max(initial=0) * left[:, 0].max(initial=0) + 1e-3  # of partial scores
    # Postings end where no anchor's threshold can be reached with what is left.
    with np.errstate(divide="ignore", invalid="ignore"):
        share = np.where(rest[:, 0] > 0, low / rest[:, 0], np.where(low > 0, np.inf, -np.inf))
    share = share.min(initial=np.inf)
    indexed = (left[:, :-1] >= share).sum(axis=1) if share > 0 else np.full(len(left), groups)
    alive = wanted & (np.multiply.outer(rest[:, 0], left[:, 0]) >= low[:, None] - error)
    if share > 0:
        alive &= indexed > 0
    gathered = np.zeros(alive.shape)
    i = k = None
    for g in range(groups):
        dims = slice(g * GROUP, (g + 1) * GROUP)
        if i is None:
            if not alive.any():
                break
            if alive.mean() < SPARSE:
                i, k = np.nonzero(alive)
                partial = gathered[i, k]
            else:
                posted = np.flatnonzero(indexed > g)
                posted = slice(None) if len(posted) == len(left) else posted
                scored = anchors.v[:, dims].astype(np.float64) @ rows.v[posted, dims].astype(np.float64).T
                scored += gathered[:, posted]
                gathered[:, posted] = scored
                scored += np.multiply.outer(rest[:, g + 1], left[posted, g + 1])
                alive[:, posted] &= scored >= low[:, None] - error
                continue
        if not len(i):
            break
        posted = np.flatnonzero(indexed[k] > g)
        a, b = i[posted], k[posted]
        partial[posted] += np.einsum("ij,ij->i", anchors.v[a, dims].astype(np.float64), rows.v[b, dims].astype(np.float64))
        stays = np.ones(len(i), bool)
        stays[posted] = partial[posted] + rest[a, g + 1] * left[b, g + 1] >= low[a] - error
        i, k, partial = i[stays], k[stays], partial[stays]
    if i is None:
        i, k = np.nonzero(alive)
    found = scores(anchors, rows, i, k)
    high = found >= least[i]
    return i[high], k[high], found[high]


def best(found: list[np.ndarray], most: int) -> list[np.ndarray]:
    """Of ``target, nameless, vec_id, row, score`` the first ``most`` of every target."""
    target, nameless, vec_id, row, score = found
    order = np.lexsort((row, vec_id, nameless, ~score, target))  # ~x falls as x grows, without overflow
    new = np.append(True, target[order][1:] != target[order][:-1])[: len(order)]
    place = np.arange(len(order)) - np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    return [x[order[place < most]] for x in found]


def joined(rows: DataFrame, anchors: Vectors, low: np.ndarray, high: np.ndarray, same: bool, most: int, name: str) -> DataFrame:
    """``target, row, vec_id, score, rank``, written: the first ``most`` rows of every open window.

    ``low`` and ``high`` have a row for each anchor and a column for each of its
    windows, targets are numbered by both; a window is open unless ``low`` is
    ``NOTHING``. ``same``: rows of the anchor's label, but itself, or rows of others.
    """
    dims = anchors.v.shape[1]
    open_ones = np.flatnonzero((low != NOTHING).any(axis=1))
    sent = rows.sparkSession.sparkContext.broadcast((anchors.part(open_ones), low[open_ones], high[open_ones], open_ones))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, low, high, numbers = sent.value
        rest, windows = anchors.suffix_norms(), low.shape[1]
        held = [np.zeros(0, np.int64)] * 5
        step = max(1, PAIRS // max(1, len(numbers)))
        for batch in batches:
            every = Vectors(batch, dims)
            for at in range(0, len(every.row), step):
                some = every.part(slice(at, at + step))
                wanted = np.equal.outer(anchors.label, some.label) == same
                wanted &= np.not_equal.outer(anchors.row, some.row)
                i, k, score = reaching(anchors, rest, some, low.min(axis=1), wanted)
                pair, window = np.nonzero((score[:, None] >= low[i]) & (score[:, None] <= high[i]))
                i, k, score = i[pair], k[pair], score[pair]
                new = [numbers[i] * windows + window, some.nameless[k].astype(np.int64), some.vec_id[k], some.row[k], score]
                held = best([np.concatenate(x) for x in zip(held, new)], most)
        target, nameless, vec_id, row, score = held
        yield pa.RecordBatch.from_arrays(
            [pa.array(target.astype(np.int32)), pa.array(row), pa.array(vec_id, mask=nameless > 0), pa.array(score)],
            names=["target", "row", "vec_id", "score"])

    found = rows.mapInArrow(join, FOUND)
    order = [F.desc("score"), F.asc_nulls_last("vec_id"), F.asc("row")]
    out = materialised(first_rows(found, ["target"], order, most, "rank"), name)
    sent.destroy()
    return out


def thresholds(scores: np.ndarray, most: int) -> list[int]:
    """From sampled scores within a window, thresholds to try: the best of the sample, and its
    last of ``most``, which that many rows reach for sure."""
    top = np.sort(scores)[::-1]
    return [int(top[0]) if len(top) else NOTHING, int(top[most - 1]) if len(top) >= most else NOTHING]


def rounds(rows: DataFrame, sample: Vectors, anchors: Vectors, low: np.ndarray, high: np.ndarray, same: bool, most: int, name: str):
    """Joins at falling thresholds: pairs of a written join and the targets whose windows it has filled.

    Windows that the last threshold, their own end, does not fill are short of rows.
    """
    tries = np.full((2, *low.shape), NOTHING)
    for i in range(len(anchors.row)):
        one = np.full(len(sample.row), i)
        wanted = ((sample.label == anchors.label[i]) == same) & (sample.row != anchors.row[i])
        found = scores(anchors, sample, one[wanted], np.flatnonzero(wanted))
        for w in np.flatnonzero(low[i] != NOTHING):
            tries[:, i, w] = thresholds(found[(found >= low[i, w]) & (found <= high[i, w])], most)
    pending = low != NOTHING
    for at in range(3):
        now = np.where(pending, low if at == 2 else tries[at], NOTHING)
        if not (now != NOTHING).any():
            continue
        result = joined(rows, anchors, now, high, same, most, f"{name}{at}")
        # At most ``most`` rows for each window of a block.
        full = {r["target"] for r in result.groupBy("target").count().where(F.col("count") >= most).collect()}
        done = pending if at == 2 else np.zeros_like(pending)
        done.flat[[t for t in full if pending.flat[t]]] = True
        targets = np.flatnonzero(done)
        if len(targets):
            yield result, targets
        pending = pending & ~done


def arrow(df: DataFrame, dims: int) -> Vectors:
    table = df.select("row", "vec_id", "label", "v").toArrow().combine_chunks()
    return Vectors(pa.RecordBatch.from_arrays(
        [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in table.columns], names=table.column_names), dims)


def mine(
    vectors: DataFrame, positives: int = 5, negatives: int = 5, least: tuple[int, int] = (80, 100), every: int = 100,
    id_col: str = "vec_id", vector_col: str = "embedding", label: Column | str = "label",
) -> DataFrame:
    """For each anchor and positive, the hardest rows of other labels that score no higher than the positive.

    Anchors are the rows whose id is divisible by ``every``; their positives are
    the first ``positives`` other rows of their label. Negatives score at most
    the positive's score and at least ``least`` (a fraction) of it. Scores are
    integer inner products of components times 256, rounded down; higher ones
    come first, equal ones by ascending id. Returns ``anchor_id, positive_id, rank,
    negative_id, positive_score, negative_score``.

    Rows whose label or vector is null, or with a component that is null or not
    finite, take no part. Components missing at the end of a shorter vector are
    0, and an empty vector scores 0. Rows with a null id are never anchors and
    come last among equal scores. Rows that repeat an id are rows by themselves,
    also as anchors and as their positives. Scores beyond a long are held at its
    ends. An empty table gives an empty result; other columns are not read.
    """
    spark = vectors.sparkSession
    rows = quantised(vectors, id_col, vector_col, F.col(label) if isinstance(label, str) else label)
    chosen = rows.where(F.col("vec_id") % every == 0)
    total = rows.agg(F.max(F.size("v")).alias("dims"), F.count_if(F.col("vec_id") % every == 0).alias("anchors")).first()
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not total["anchors"]:
        return spark.createDataFrame([], schema)
    dims = max(1, int(total["dims"]))
    sample = arrow(rows.orderBy(F.xxhash64("row"), "row").limit(SAMPLE), dims)
    found = []
    blocks = -(-int(total["anchors"]) // BLOCK_ANCHORS)
    for block in range(blocks):
        # Dealt by a hash: blocks differ little in size.
        anchors = arrow(chosen.where(F.pmod(F.xxhash64("row", F.lit("block")), F.lit(blocks)) == block), dims)
        if not len(anchors.row):
            continue
        n = len(anchors.row)
        low, high = np.full((n, 1), LEAST), np.full((n, 1), MOST)
        picked = []
        for result, targets in rounds(rows, sample, anchors, low, high, True, positives, "positives"):
            picked += [r for r in result.where(F.col("target").isin(targets.tolist())).collect()]  # ``positives`` for each anchor
        low, high = np.full((n, positives), NOTHING), np.full((n, positives), MOST)
        pairs, place = [], [0] * n
        for r in sorted(picked, key=lambda r: (r["target"], -r["score"], r["vec_id"] is None, r["vec_id"] or 0, r["row"])):
            i = r["target"]
            w, place[i] = place[i], place[i] + 1
            end = -(-least[0] * r["score"] // least[1])  # the least whole number not below
            if end <= r["score"]:
                low[i, w], high[i, w] = max(end, LEAST), r["score"]
                pairs.append((i * positives + w, int(anchors.vec_id[i]), r["vec_id"], r["score"]))
        if not pairs:
            continue
        named = spark.createDataFrame(pairs, "target int, anchor_id long, positive_id long, positive_score long")
        for result, targets in rounds(rows, sample, anchors, low, high, False, negatives, "negatives"):
            closed = spark.createDataFrame([(int(t),) for t in targets], "target int")
            found.append(result.join(F.broadcast(closed), "target").join(F.broadcast(named), "target"))
    if not found:
        return spark.createDataFrame([], schema)
    mined = reduce(DataFrame.unionByName, found)
    return mined.select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score",
        F.col("score").alias("negative_score"))
