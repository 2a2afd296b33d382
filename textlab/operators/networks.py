"""Feed-forward networks trained by mini-batches, many at a time.

Rows lie in shards by a hash of their id, of a size that does not depend on how
many there are. A round takes every network through some epochs over each shard:
mini-batches, Adam, the recorded activation, rate and schedule. After a round the
copies of a network are averaged over its shards; a table of one shard is
trained as on one machine. States travel, rows stay in the partitions they were
dealt to once. Every round's states are written, so a lost executor costs a
round at most, and every order is drawn from a seed, so reruns agree.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlab.operators.many_fits import OUT, Part
from textlab.session import written

SHARD_ROWS = 1 << 16
LANES = 8  # copies of the rows at most: networks of different lanes are trained side by side
SPREAD = 4  # partitions for each group of a lane and shard, so that few tasks get several
ROUND = 5  # epochs between two averages
PATIENCE = 2  # rounds without a gain before a network stops, or its adaptive rate falls
TOLERANCE, LEAST_RATE = 1e-4, 1e-6
#: Weight decay and the constants of Adam.
DECAY, BETA_1, BETA_2, EPSILON = 1e-4, 0.9, 0.999, 1e-8
STATE = "net int, lane int, state binary"
KIND = np.float32  # of the weights and rows while training and scoring; losses, sums and averages are double


@dataclass(frozen=True)
class Network:
    """What one network is, and which rows of which split it learns from (see ``Fit``)."""

    split: int
    fold: int | None
    hidden: tuple[int, ...]
    activation: str
    batch: int
    rate: float
    schedule: str
    balanced: bool = False
    seed: int = 42

    @classmethod
    def of(cls, params: Mapping, split: int, fold: int | None = None) -> Network:
        hidden = tuple(int(x) for x in re.findall(r"\d+", str(params["hidden_layer_sizes"])))
        activation, schedule = params.get("activation") or "relu", params.get("learning_rate") or "constant"
        if activation not in ACTIVATIONS:
            raise ValueError(f"unknown activation: {activation}")
        if schedule not in ("constant", "invscaling", "adaptive"):
            raise ValueError(f"unknown schedule: {schedule}")
        return cls(split, fold, hidden, activation, int(params.get("batch_size") or 200),
                   float(params.get("learning_rate_init") or 0.001), schedule, params.get("class_weight") == "balanced")


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -80, 80)))  # within single precision


#: Units, and their slope as a function of what they give.
ACTIVATIONS = {
    "relu": (lambda z: np.maximum(z, 0), lambda a: (a > 0).astype(a.dtype)),
    "tanh": (np.tanh, lambda a: 1 - a**2),
    "logistic": (sigmoid, lambda a: a * (1 - a)),
}


def layers(net: Network, dims: int) -> list[tuple[int, int]]:
    """Inputs and outputs of each layer; the last has one logistic unit."""
    sizes = [dims, *net.hidden, 1]
    return list(zip(sizes[:-1], sizes[1:]))


def unfolded(net: Network, dims: int, flat: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Views of the weights and biases of each layer."""
    out, at = [], 0
    for a, b in layers(net, dims):
        out.append((flat[at:at + a * b].reshape(a, b), flat[at + a * b:at + a * b + b]))
        at += a * b + b
    return out


def initial(net: Network, dims: int) -> np.ndarray:
    """Uniform weights, in a range by the units of both sides."""
    rng = np.random.default_rng(net.seed)
    parts = []
    for a, b in layers(net, dims):
        bound = np.sqrt((2.0 if net.activation == "logistic" else 6.0) / (a + b))
        parts.append(rng.uniform(-bound, bound, a * b + b))
    return np.concatenate(parts)


def forward(net: Network, flat: np.ndarray, x: np.ndarray) -> list[np.ndarray]:
    """What every layer gives, the input first."""
    unit, _ = ACTIVATIONS[net.activation]
    values = [x]
    stack = unfolded(net, x.shape[1], flat)
    for i, (w, b) in enumerate(stack):
        z = values[-1] @ w + b
        values.append(sigmoid(z) if i == len(stack) - 1 else unit(z))
    return values


def loss_and_gradient(net: Network, flat: np.ndarray, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, np.ndarray]:
    """Mean log-loss with weight decay, and its gradient."""
    values = forward(net, flat, x)
    share = np.clip(values[-1][:, 0].astype(np.float64), 1e-12, 1 - 1e-12)
    total = len(y)
    loss = -(weight * np.log(np.where(y == 1, share, 1 - share))).sum() / total
    slope = ACTIVATIONS[net.activation][1]
    out = np.empty_like(flat)
    stack, slots = unfolded(net, x.shape[1], flat), unfolded(net, x.shape[1], out)
    error = (weight * (values[-1][:, 0] - y)).astype(x.dtype)[:, None] / total
    for i in range(len(stack) - 1, -1, -1):
        w, _ = stack[i]
        np.matmul(values[i].T, error, out=slots[i][0])
        slots[i][0][:] += DECAY / total * w
        slots[i][1][:] = error.sum(axis=0)
        loss += 0.5 * DECAY * float(np.vdot(w, w)) / total
        if i:
            error = (error @ w.T) * slope(values[i])
    return loss, out


class State:
    """Weights, both moments of Adam, updates made, and the rate they are made at."""

    def __init__(self, data: bytes):
        numbers = np.frombuffer(data)
        self.updates, self.rate = numbers[:2]
        self.flat, self.first, self.second = numbers[2:].reshape(3, -1).astype(KIND)

    @staticmethod
    def start(net: Network, dims: int) -> bytes:
        flat = initial(net, dims)
        return np.concatenate([[0.0, net.rate], flat, np.zeros(2 * len(flat))]).tobytes()

    def stored(self) -> bytes:
        return np.concatenate([[self.updates, self.rate], self.flat, self.first, self.second]).tobytes()

    def epoch(self, net: Network, x: np.ndarray, y: np.ndarray, weight: np.ndarray, order: np.ndarray) -> float:
        """One pass over the rows in the given order; the mean loss of its batches."""
        total, step, scale = 0.0, np.empty_like(self.flat), np.empty_like(self.flat)
        for at in range(0, len(order), net.batch):
            rows = order[at:at + net.batch]
            loss, slope = loss_and_gradient(net, self.flat, x[rows], y[rows], weight[rows])
            total += loss * len(rows)
            self.updates += 1
            rate = self.rate / np.sqrt(self.updates) if net.schedule == "invscaling" else self.rate
            tempered = float(rate * np.sqrt(1 - BETA_2**self.updates) / (1 - BETA_1**self.updates))
            self.first *= BETA_1
            self.first += np.multiply(slope, 1 - BETA_1, out=step)
            self.second *= BETA_2
            np.multiply(slope, slope, out=step)
            self.second += np.multiply(step, 1 - BETA_2, out=step)
            np.sqrt(self.second, out=scale)
            scale += EPSILON
            np.divide(self.first, scale, out=step)
            step *= tempered
            self.flat -= step
        return total / max(1, len(order))


def matrices(table: pa.Table) -> tuple[Part, np.ndarray]:
    """The rows of a shard in the order of their ids, and the ids."""
    table = table.sort_by("row_id").combine_chunks()
    batch = table.to_batches()[0]
    dims = len(batch.column(batch.schema.get_field_index("vector"))[0])
    part = Part(batch, np.zeros(dims))
    part.x = np.ascontiguousarray(part.x[:, :-1], KIND)
    return part, batch.column(batch.schema.get_field_index("row_id")).to_numpy()


def dealt(rows: DataFrame, nets: Sequence[Network]) -> tuple[DataFrame, int, int]:
    """Rows by lane and shard, and how many of either there are."""
    shards = max(1, -(-rows.count() // SHARD_ROWS))
    lanes = max(1, min(LANES, len(nets)))
    lane = F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))).alias("lane")
    copies = rows.select("row_id", "vector", "label", "folds", F.pmod(F.xxhash64("row_id"), F.lit(shards)).cast("int").alias("shard"), lane)
    return copies.repartition(SPREAD * shards * lanes, "lane", "shard"), shards, lanes


def fit_all(rows: DataFrame, nets: Sequence[Network], max_epochs: int = 1000) -> DataFrame:
    """``net, lane, state``, written: every network at the end of its training.

    ``rows`` is a table of :func:`~textlab.operators.many_fits.folded`. A network stops
    when its loss has not fallen by ``TOLERANCE`` for ``PATIENCE`` rounds; with an
    adaptive rate, that is divided by 5 instead until it is tiny.
    """
    spark = rows.sparkSession
    dims = rows.select(F.size("vector").alias("d")).first()["d"]
    copies, shards, lanes = dealt(rows, nets)
    copies.persist(StorageLevel.MEMORY_AND_DISK)  # lost blocks are dealt again from the written rows
    counts = classes(rows, nets)
    every = F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard")

    def train(left: pa.Table, right: pa.Table, first_epoch: int, epochs: int, rates: dict[int, float]) -> pa.Table:
        part, _ = matrices(left) if left.num_rows else (None, None)
        out = [[], [], [], [], []]
        for number, lane, data in zip(right.column("net").to_pylist(), right.column("lane").to_pylist(), right.column("state").to_pylist()):
            net, state, loss, n = nets[number], State(data), 0.0, 0
            state.rate = rates[number]
            if part is not None:
                own = part.member([(net.split, net.fold)])[:, 0]
                x, y, n = part.x[own], part.y[own], int(own.sum())
                weight = counts[number][y]
                for epoch in range(first_epoch, first_epoch + epochs if n else first_epoch):
                    order = np.random.default_rng((net.seed, epoch, int(left.column("shard")[0].as_py()))).permutation(n)
                    loss = state.epoch(net, x, y, weight, order)
            for column, value in zip(out, (number, lane, state.stored(), loss * n, n)):
                column.append(value)
        kinds = (pa.int32(), pa.int32(), pa.binary(), pa.float64(), pa.int64())
        return pa.table([pa.array(c, k) for c, k in zip(out, kinds)], names=["net", "lane", "state", "loss", "n"])

    def round_of(first: int, epochs: int, now: dict[int, float]) -> Callable[[pa.Table, pa.Table], pa.Table]:
        return lambda left, right: train(left, right, first, epochs, now)

    def average(table: pa.Table) -> pa.Table:
        n = np.array(table.column("n").to_pylist(), float)
        share = n / n.sum() if n.sum() else np.full(len(n), 1 / len(n))
        states = [np.frombuffer(x) for x in table.column("state").to_pylist()]
        mean = sum(s * x for s, x in zip(share, states))
        loss = sum(table.column("loss").to_pylist()) / max(1.0, n.sum())
        return pa.table({"net": table.column("net").slice(0, 1), "lane": table.column("lane").slice(0, 1),
                         "state": pa.array([mean.tobytes()], pa.binary()), "loss": pa.array([loss])})

    try:
        def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    number = batch.column(0)[i].as_py()
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([number], pa.int32()), pa.array([number % lanes], pa.int32()),
                         pa.array([State.start(nets[number], dims)], pa.binary())], names=["net", "lane", "state"])

        states = written(spark.range(len(nets), numPartitions=lanes).mapInArrow(begin, STATE), "networks")
        rates = {i: net.rate for i, net in enumerate(nets)}
        best, waited, done = {}, dict.fromkeys(rates, 0), []
        for first in range(0, max_epochs, ROUND):
            epochs, now = min(ROUND, max_epochs - first), dict(rates)

            spread = states.select("net", "lane", "state", every)
            trained = copies.groupBy("lane", "shard").cogroup(spread.groupBy("lane", "shard")).applyInArrow(
                round_of(first, epochs, now), STATE + ", loss double, n long")
            found = written(trained.groupBy("net").applyInArrow(average, STATE + ", loss double"), "networks")
            ended = []
            for r in found.select("net", "loss").collect():  # a number for each network
                net = r["net"]
                if r["loss"] > best.get(net, np.inf) - TOLERANCE:
                    waited[net] += 1
                else:
                    waited[net] = 0
                best[net] = min(r["loss"], best.get(net, np.inf))
                if waited[net] >= PATIENCE and nets[net].schedule == "adaptive" and rates[net] / 5 >= LEAST_RATE:
                    rates[net], waited[net] = rates[net] / 5, 0
                elif waited[net] >= PATIENCE or not np.isfinite(r["loss"]):
                    ended.append(net)
            found = found.drop("loss")
            done.append(found.where(F.col("net").isin(ended)))
            states = found.where(~F.col("net").isin(ended))
            for net in ended:
                del rates[net]
            if not rates:
                break
        out = states
        for some in done:
            out = out.unionByName(some)
        return written(out, "trained")
    finally:
        copies.unpersist()


def classes(rows: DataFrame, nets: Sequence[Network]) -> list[np.ndarray]:
    """The weight of either class for each network, from its own training rows."""
    if not any(net.balanced for net in nets):
        return [np.ones(2)] * len(nets)
    cells = []
    for i, net in enumerate(nets):
        own = F.get("folds", F.lit(net.split))
        inside = (own != OUT) & (own != (OUT if net.fold is None else net.fold))
        cells += [F.count_if(inside & (F.col("label") == c)).alias(f"n{i}_{c}") for c in (0, 1)]
    found = rows.agg(*cells).first()
    out = []
    for i, net in enumerate(nets):
        n = np.array([found[f"n{i}_0"], found[f"n{i}_1"]], float)
        out.append(n.sum() / (2 * np.maximum(n, 1)) if net.balanced else np.ones(2))
    return out


def predictions(rows: DataFrame, numbers: Sequence[int], nets: Sequence[Network], states: DataFrame) -> DataFrame:
    """``net, row_id, split_no, label, prediction, probability`` on the rows each network has left out:
    those of its fold, or all outside of the training part."""
    copies, shards, lanes = dealt(rows, nets)
    every = F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard")
    placed = states.select("net", (F.col("net") % lanes).cast("int").alias("lane"), "state", every)

    def predict(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [[] for _ in range(6)]
        if left.num_rows:
            part, ids = matrices(left)
            for number, data in zip(right.column("net").to_pylist(), right.column("state").to_pylist()):
                net = nets[number]
                own = part.member([(net.split, net.fold)], inside=False)[:, 0]
                share = forward(net, State(data).flat, part.x[own])[-1][:, 0]
                said = share > 0.5
                n = len(share)
                for column, value in zip(out, (np.full(n, number), ids[own], np.full(n, numbers[net.split]), part.y[own], said,
                                               np.where(said, share, 1 - share))):
                    column.append(np.asarray(value))
        kinds = (np.int32, np.int64, np.int32, np.int32, np.int32, np.float64)
        names = ("net", "row_id", "split_no", "label", "prediction", "probability")
        return pa.table({n: pa.array(np.concatenate([np.zeros(0, k), *(x.astype(k) for x in c)])) for n, c, k in zip(names, out, kinds)})

    return copies.groupBy("lane", "shard").cogroup(placed.groupBy("lane", "shard")).applyInArrow(
        predict, "net int, row_id long, split_no int, label int, prediction int, probability double")
