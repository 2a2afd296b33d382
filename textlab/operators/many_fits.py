"""Many logistic regressions fitted in the same passes over the data.

A search fits one classifier for each trial, split and fold. Their training rows
overlap nearly wholly, so a pass over the rows adds up the gradients of all of
them at once, keyed by fit; as many numbers leave a task as the fits have
coefficients, whatever the number of rows. One more pass gathers the second
moments of all rows, which bound the curvature of every fit's loss: in that metric
the fits advance together by accelerated proximal steps, so few passes suffice
whatever the scale of the features, and drop out as they converge.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlab.operators.sampling import stratified_folds
from textlab.session import written

BLOCK = 512  # fits whose sums travel in one row
CELLS = 1 << 21  # of rows times fits that a task holds at once
TOLERANCE = 1e-6  # of the gradient, by which a fit has converged
INNER = 500  # steps of the small problem that a pass with an absolute penalty ends in, at most
OUT = -1  # the fold of rows outside the training part


@dataclass(frozen=True)
class Fit:
    """A logistic regression on the rows of a split's training part, less one fold of it."""

    split: int  # place in the rows' ``folds``
    fold: int | None
    c: float
    penalty: str
    balanced: bool

    @classmethod
    def of(cls, params: Mapping, split: int, fold: int | None = None) -> Fit:
        return cls(split, fold, float(params.get("c") or 1.0), params.get("penalty") or "l2", params.get("class_weight") == "balanced")


def folded(features: DataFrame, splits: DataFrame, n: int = 5) -> tuple[DataFrame, list[int]]:
    """``row_id, vector, label, folds``, written, and the numbers of the splits.

    ``folds`` holds for each split the row's fold within the training part, or ``OUT``.
    """
    labels = features.select("row_id", "label")
    numbers = sorted(r["split_no"] for r in splits.select("split_no").distinct().collect())
    train = splits.where(F.col("part") == "train").join(labels, "row_id").select("split_no", "row_id", "label")
    parts = stratified_folds(train, n, within=("split_no",))
    place = [F.coalesce(F.max(F.when(F.col("split_no") == s, F.col("fold"))), F.lit(OUT)) for s in numbers]
    wide = parts.groupBy("row_id").agg(F.array(*place).cast("array<int>").alias("folds"))
    nowhere = F.array(*[F.lit(OUT)] * len(numbers))
    rows = features.select("row_id", "vector", "label").join(wide, "row_id", "left")
    return written(rows.withColumn("folds", F.coalesce("folds", nowhere)), "folded"), numbers


class Part:
    """Some rows of a task as arrays; vectors less a centre, and a last column of ones."""

    def __init__(self, batch: pa.RecordBatch, centre: np.ndarray):
        column = lambda name: batch.column(batch.schema.get_field_index(name))
        n = batch.num_rows
        self.x = np.ones((n, len(centre) + 1))
        self.x[:, :-1] = column("vector").flatten().to_numpy().reshape(n, -1) - centre
        self.y = column("label").to_numpy().astype(np.int64)
        self.folds = column("folds").flatten().to_numpy().reshape(n, -1)

    def member(self, groups: Sequence[tuple[int, int | None]], inside: bool = True) -> np.ndarray:
        """Rows by groups: whether a row trains them, or (not ``inside``) tests them."""
        out = np.empty((len(self.y), len(groups)), bool)
        for g, (split, fold) in enumerate(groups):
            own = self.folds[:, split]
            out[:, g] = (own != OUT) & (own != (OUT if fold is None else fold)) if inside else own == (OUT if fold is None else fold)
        return out


def parts(batches: Iterator[pa.RecordBatch], centre: np.ndarray, width: int) -> Iterator[Part]:
    step = max(1, CELLS // max(1, width))
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            yield Part(batch.slice(at, step), centre)


def summed(rows: DataFrame, shape: tuple[int, int], add: Callable[[Iterator[pa.RecordBatch], np.ndarray], None]) -> np.ndarray:
    """The sum over all tasks of the matrix of ``shape`` that ``add`` gathers from a task's rows."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(shape)
        add(batches, out)
        blocks = list(range(0, shape[0], BLOCK))
        yield pa.RecordBatch.from_arrays(
            [pa.array(blocks, pa.int32()), pa.array([out[b:b + BLOCK].tobytes() for b in blocks], pa.binary())], names=["first", "block"])

    def total(table: pa.Table) -> pa.Table:
        out = sum(np.frombuffer(x.as_py()) for x in table.column("block"))
        return pa.table({"first": table.column("first").slice(0, 1), "block": pa.array([out.tobytes()], pa.binary())})

    schema = "first int, block binary"
    sums = rows.mapInArrow(gather, schema).groupBy("first").applyInArrow(total, schema)
    out = np.zeros(shape)
    for r in sums.collect():  # as large as the matrix, whatever the number of rows
        block = np.frombuffer(bytes(r["block"])).reshape(-1, shape[1])
        out[r["first"]:r["first"] + len(block)] = block
    return out


def fit_all(rows: DataFrame, fits: Sequence[Fit], max_iter: int = 1000) -> np.ndarray:
    """A row of coefficients, the intercept last, for each fit.

    ``rows`` is a table of :func:`folded`. A fit minimises the mean loss of its training
    rows plus ``penalty(coefficients) / (c * rows)``; balanced class weights come from
    its own rows. The intercept is not penalised.
    """
    dims = rows.select(F.size("vector").alias("d")).first()["d"]
    groups = sorted({(f.split, f.fold) for f in fits}, key=str)
    group = np.array([groups.index((f.split, f.fold)) for f in fits])
    zero = np.zeros(dims)

    def moments(batches: Iterator[pa.RecordBatch], out: np.ndarray) -> None:
        for part in parts(batches, zero, dims):
            out[:dims + 1, :dims + 1] += part.x.T @ part.x
            for g, own in enumerate(part.member(groups).T):
                out[dims + 1 + g, :2] += np.bincount(part.y[own], minlength=2)[:2]

    found = summed(rows, (dims + 1 + len(groups), max(2, dims + 1)), moments)
    n_rows = found[dims, dims]
    centre = found[dims, :dims] / n_rows
    spread = found[:dims, :dims] - n_rows * np.outer(centre, centre)
    counts = found[dims + 1:, :2][group]  # of each fit's classes
    n = counts.sum(axis=1)
    if (n == 0).any():
        raise ValueError("a fit has no training rows")
    balanced = np.array([f.balanced for f in fits])[:, None]
    weight = np.where(balanced, n[:, None] / (2 * np.maximum(counts, 1)), 1.0)
    total = (weight * counts).sum(axis=1)
    reg = 1 / (np.array([f.c for f in fits]) * n)
    l1 = np.array([f.penalty == "l1" for f in fits])
    # The rows of a fit are some of all rows, so the moments of all bound its curvature; around
    # the mean of all rows, that of the coefficients and that of the intercept are apart.
    bend = 0.25 * weight.max(axis=1) / total
    values, basis = np.linalg.eigh(spread)
    metric = bend[:, None] * np.maximum(values, 1e-10 * max(values[-1], 1e-12)) + np.where(l1, 0, reg)[:, None]
    beta, ahead = np.zeros((len(fits), dims + 1)), np.zeros((len(fits), dims + 1))
    speed = np.ones(len(fits))
    open_fits = np.arange(len(fits))
    for _ in range(max_iter):
        at, own_groups, own_weight = ahead[open_fits], group[open_fits], weight[open_fits]

        def gradients(batches: Iterator[pa.RecordBatch], out: np.ndarray) -> None:
            for part in parts(batches, centre, len(at)):
                share = 1 / (1 + np.exp(-np.clip(part.x @ at.T, -500, 500)))
                share -= part.y[:, None]
                share *= part.member(groups)[:, own_groups] * own_weight[:, part.y].T
                out += share.T @ part.x

        slope = summed(rows, at.shape, gradients) / total[open_fits, None]
        slope[:, :-1] += np.where(l1[open_fits], 0, reg[open_fits])[:, None] * at[:, :-1]
        new = at.copy()
        new[:, -1] -= slope[:, -1] / (bend[open_fits] * n_rows)
        own = metric[open_fits]
        new[:, :-1] -= (slope[:, :-1] @ basis / own) @ basis.T
        some = l1[open_fits]
        if some.any():
            new[some, :-1] = shrunk(at[some, :-1], slope[some, :-1], own[some], basis, reg[open_fits][some])
        # The step in the metric is the gradient that is left, penalty included.
        left = at - new
        left[:, :-1] = (left[:, :-1] @ basis * own) @ basis.T
        left[:, -1] *= bend[open_fits] * n_rows
        # Momentum starts afresh where it points uphill.
        old = beta[open_fits]
        uphill = (left * (new - old)).sum(axis=1) > 0
        before = np.where(uphill, 1.0, speed[open_fits])
        after = (1 + np.sqrt(1 + 4 * before**2)) / 2
        beta[open_fits] = new
        ahead[open_fits] = new + np.where(uphill, 0, (before - 1) / after)[:, None] * (new - old)
        speed[open_fits] = after
        open_fits = open_fits[np.abs(left).max(axis=1) > TOLERANCE]
        if not len(open_fits):
            break
    beta[:, -1] -= beta[:, :-1] @ centre
    return beta


def shrunk(at: np.ndarray, slope: np.ndarray, metric: np.ndarray, basis: np.ndarray, reg: np.ndarray) -> np.ndarray:
    """Where ``slope (z - at) + (z - at) metric (z - at) / 2 + reg |z|`` is least, for each row.

    ``metric`` holds eigenvalues along ``basis``. It is a problem of as many numbers as a
    fit has coefficients, without the data.
    """
    step = 1 / metric.max(axis=1, keepdims=True)
    point, ahead, speed = at.copy(), at.copy(), np.ones(len(at))
    for _ in range(INNER):
        bent = slope + ((ahead - at) @ basis * metric) @ basis.T
        new = ahead - step * bent
        new = np.sign(new) * np.maximum(np.abs(new) - step * reg[:, None], 0)
        uphill = ((ahead - new) * (new - point)).sum(axis=1) > 0
        before = np.where(uphill, 1.0, speed)
        speed = (1 + np.sqrt(1 + 4 * before**2)) / 2
        moved = np.abs((ahead - new) / step).max()
        ahead = new + np.where(uphill, 0, (before - 1) / speed)[:, None] * (new - point)
        point = new
        if moved < TOLERANCE / 10:
            break
    return point


def tested(rows: DataFrame, fits: Sequence[Fit], beta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """F1 of class 1 (0 when undefined) and accuracy of each fit on the rows it left out."""
    groups = sorted({(f.split, f.fold) for f in fits}, key=str)
    group = np.array([groups.index((f.split, f.fold)) for f in fits])
    zero = np.zeros(beta.shape[1] - 1)

    def count(batches: Iterator[pa.RecordBatch], out: np.ndarray) -> None:
        for part in parts(batches, zero, len(fits)):
            said, own = part.x @ beta.T > 0, part.member(groups, inside=False)[:, group]
            truth = (part.y == 1)[:, None]
            out[:, 0] += (own & said & truth).sum(axis=0)
            out[:, 1] += (own & (said != truth)).sum(axis=0)
            out[:, 2] += own.sum(axis=0)

    hits, wrong, n = summed(rows, (len(fits), 3), count).T
    with np.errstate(invalid="ignore", divide="ignore"):
        f1 = np.where(2 * hits + wrong > 0, 2 * hits / (2 * hits + wrong), 0.0)
        return f1, np.where(n > 0, (n - wrong) / n, 0.0)


def predictions(rows: DataFrame, numbers: Sequence[int], fits: Sequence[Fit], beta: np.ndarray) -> DataFrame:
    """``row_id, split_no, label, prediction, probability`` on the rows outside of each split's training part."""

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            part = Part(batch, np.zeros(beta.shape[1] - 1))
            share = 1 / (1 + np.exp(-np.clip(part.x @ beta.T, -500, 500)))
            fit, row = np.nonzero(part.member([(f.split, None) for f in fits], inside=False).T)
            said = share[row, fit] > 0.5
            ids = batch.column(batch.schema.get_field_index("row_id"))
            yield pa.RecordBatch.from_arrays([
                ids.take(pa.array(row)), pa.array(np.array([numbers[f.split] for f in fits], np.int32)[fit]),
                pa.array(part.y[row].astype(np.int32)), pa.array(said.astype(np.int32)),
                pa.array(np.where(said, share[row, fit], 1 - share[row, fit])),
            ], names=["row_id", "split_no", "label", "prediction", "probability"])

    return rows.mapInArrow(predict, "row_id long, split_no int, label int, prediction int, probability double")


def search(rows: DataFrame, n_splits: int, trials: Sequence[Mapping], n_folds: int = 5, max_iter: int = 1000) -> list[float]:
    """The objective of every trial: the mean over splits of the mean F1 over folds."""
    fits = [Fit.of(t, s, f) for t in trials for s in range(n_splits) for f in range(n_folds)]
    f1, _ = tested(rows, fits, fit_all(rows, fits, max_iter))
    return f1.reshape(len(trials), -1).mean(axis=1).tolist()
