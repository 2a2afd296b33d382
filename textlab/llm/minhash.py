"""Near-duplicates by MinHash with sequential Bayesian verification.

Documents of equal shingle sets are one class. Classes that agree in a band of
their signatures are candidates. A candidate pair is compared a batch of hashes
at a time and given up as soon as the posterior probability that it is similar
enough falls under the chosen miss probability; what survives is verified on
full sets.

A bucket is never expanded into all its pairs: its smallest members (centres)
are compared with the others, and pairs that are connected already are left out.
Rounds with ever more centres go on until no untested pair between components
is left, so no link between different components is lost. Shingles that no other
set holds bound the similarities of a document from above: heavily edited copies,
linked with nothing, need not be compared with their whole group to know that.
So do odd sketches, which bound from below in how many shingles two sets differ:
of a large group, few pairs but the links themselves are ever compared.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textlab.llm.arrays import U, Words, mix, slices
from textlab.llm.batches import materialised
from textlab.llm.blooms import might_contain
from textlab.llm.components import extended
from textlab.llm.repeats import encoded
from textlab.session import written

SHINGLE, THRESHOLD = 5, 0.75
BANDS, ROWS = 32, 4  # a pair at the threshold misses every band with probability 5e-6
BATCH, MISS = 16, 1e-9  # hashes compared at a time; probability of giving up a pair that is similar enough
CENTRES = 8  # each round has so many times the centres of the one before
PART_SHINGLES = 1 << 20  # shingles that one task counts, at most
SKETCH_WORDS = 16  # 64-bit words of an odd sketch
MANY = -(1 << 63)  # stands for more than one document
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_ODD = (mix(np.arange(1, BANDS * ROWS + 1, dtype=U)) >> U(32)).astype(np.uint32) | np.uint32(1)
_XOR = (mix(np.arange(1001, BANDS * ROWS + 1001, dtype=U)) >> U(32)).astype(np.uint32)


def shingle_sets(texts: list[bytes], shingle: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; with fewer words, one of them all."""
    words = Words([t.translate(_LOWER) for t in texts])
    hashes, first = words.hash, words.first
    rolled = np.zeros(max(0, len(hashes) - shingle + 1), dtype=U)
    for i in range(shingle):
        rolled = mix(rolled + hashes[i:i + len(rolled)])
    sets = []
    for a, b in zip(first[:-1], first[1:]):
        if b - a >= shingle:
            sets.append(np.unique(rolled[a:b - shingle + 1]))
        elif b > a:
            one = np.array([b - a], dtype=U)
            for h in hashes[a:b]:
                one = mix(one + h)
            sets.append(one)
        else:
            sets.append(np.zeros(0, dtype=U))
    return sets


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """MinHash signatures of non-empty sets, a row each."""
    out = np.empty((len(_ODD), len(sets)), dtype=np.uint32)
    if sets:
        starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
        values = (np.concatenate(sets) >> U(32)).astype(np.uint32)
        for j in range(len(_ODD)):
            out[j] = np.minimum.reduceat((values ^ _XOR[j]) * _ODD[j], starts)
    return out.T.copy()


def odd_sketches(sets: list[np.ndarray]) -> np.ndarray:
    """A row of bits for each set, as 64-bit words: whether an odd number of its shingles falls on a bit.

    Shared shingles cancel out between two rows, so sets differ in at least as many
    shingles as their rows in bits.
    """
    bits = 64 * SKETCH_WORDS
    out = np.zeros((len(sets), bits), dtype=bool)
    for row, one in zip(out, sets):
        row[:] = np.bincount((mix(one) % U(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(out, axis=1).view(np.int64)


def least_matches(n: int, threshold: float = THRESHOLD, miss: float = MISS) -> int:
    """The fewest of ``n`` equal hashes with which a pair goes on.

    With a uniform prior, the posterior of the similarity after ``m`` matches is
    Beta(m + 1, n - m + 1), and it exceeds the threshold with the probability of
    at most ``m`` successes in ``n + 1`` trials.
    """
    total = 0.0
    for m in range(n + 1):
        total += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        if total >= miss:
            return m
    return n


def described(docs: DataFrame) -> DataFrame:
    """``doc, n_shingles, set_id, signature, bands, sketch``: the last three are null for empty sets."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = encoded(batch.column(1))
            for a, b in slices([len(t) for t in texts]):
                sets = shingle_sets(texts[a:b])
                some = [i for i, s in enumerate(sets) if len(s)]
                rows = signatures([sets[i] for i in some])
                bands = np.zeros((len(some), BANDS), dtype=U)
                for r in range(ROWS):
                    bands = mix(bands + rows[:, r::ROWS].astype(U))
                odd = odd_sketches([sets[i] for i in some])
                keys, sign, ids, sketch = ([None] * (b - a) for _ in range(4))
                for row, i in enumerate(some):
                    ids[i] = hashlib.blake2b(sets[i].tobytes(), digest_size=16).digest()
                    sign[i], keys[i] = rows[row].tobytes(), bands[row].view(np.int64).tolist()
                    sketch[i] = odd[row].tolist()
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(a, b - a), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(ids, pa.binary()), pa.array(sign, pa.binary()), pa.array(keys, pa.list_(pa.int64())),
                    pa.array(sketch, pa.list_(pa.int64())),
                ], names=["doc", "n_shingles", "set_id", "signature", "bands", "sketch"])

    return docs.mapInArrow(
        describe, "doc long, n_shingles long, set_id binary, signature binary, bands array<long>, sketch array<long>"
    )


def bayes_pruned(pairs: DataFrame) -> DataFrame:
    """Of ``a, b, sign_a, sign_b`` the pairs ``a, b`` that may be similar enough."""
    least = [(n, least_matches(n)) for n in range(BATCH, BANDS * ROWS + 1, BATCH)]

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            one, other = (
                np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint32).reshape(batch.num_rows, -1) for i in (2, 3)
            )
            alive, matches = np.arange(batch.num_rows), np.zeros(batch.num_rows, dtype=np.int64)
            for n, m in least:
                matches[alive] += (one[alive, n - BATCH:n] == other[alive, n - BATCH:n]).sum(axis=1)
                alive = alive[matches[alive] >= m]
            kept = batch.take(pa.array(alive))
            yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1)], names=["a", "b"])

    return pairs.select("a", "b", "sign_a", "sign_b").mapInArrow(prune, "a long, b long")


def full_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``doc, shingles``: the packed sets of the wanted documents, from their whole texts."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = encoded(batch.column(1))
            for a, b in slices([len(t) for t in texts]):
                packed = [s.tobytes() for s in shingle_sets(texts[a:b])]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(packed, pa.binary())], names=["doc", "shingles"]
                )

    # An inner join with distinct ids: a semi join would be moved below the filter.
    some = might_contain(docs, wanted, "doc").join(wanted, "doc")
    return some.select("doc", "text").mapInArrow(sets, "doc long, shingles binary")


def shared_counts(sets: DataFrame, parts: int) -> DataFrame:
    """``doc, n_own``: how many shingles of a document no other set holds.

    Documents without any are left out. A shingle that a slice holds twice is
    sent once, without a document, so a very frequent one never gathers. Each part
    answers a slice with one packed row, not one for each of its documents.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for place, (batch, (a, b)) in enumerate(
            (batch, cut) for batch in batches for cut in slices(pc.binary_length(batch.column(1)).to_pylist(), 1 << 23)
        ):
            packed = batch.column(1).slice(a, b - a).to_pylist()
            if packed:
                keys = np.frombuffer(b"".join(packed), U)
                owner = np.repeat(batch.column(0).to_numpy()[a:b], [len(x) // 8 for x in packed])
                keys, first, counts = np.unique(keys, return_index=True, return_counts=True)
                owner = np.where(counts == 1, owner[first], MANY)
                where = (mix(keys) % U(parts)).astype(np.int64)
                order = np.argsort(where, kind="stable")
                keys, owner, ends = keys[order], owner[order], np.cumsum(np.bincount(where, minlength=parts))[:-1]
                yield pa.RecordBatch.from_arrays([
                    pa.array(range(parts), pa.int32()),
                    pa.array([(TaskContext.get().partitionId() << 32) + place] * parts, pa.int64()),
                    pa.array([x.tobytes() for x in np.split(keys, ends)], pa.binary()),
                    pa.array([x.tobytes() for x in np.split(owner, ends)], pa.binary()),
                ], names=["part", "slice", "keys", "owners"])

    def judge(table: pa.Table) -> pa.Table:
        keys = np.frombuffer(b"".join(table.column("keys").to_pylist()), U)
        sent = table.column("owners").to_pylist()
        owner = np.frombuffer(b"".join(sent), np.int64)
        _, first, counts = np.unique(keys, return_index=True, return_counts=True)
        own = np.sort(first[counts == 1])
        own = own[owner[own] != MANY]
        ends = np.searchsorted(own, np.cumsum([len(x) // 8 for x in sent])[:-1])
        return pa.table({
            "slice": table.column("slice"),
            "owners": pa.array([x.tobytes() for x in np.split(owner[own], ends)], pa.binary()),
        })

    def gather(table: pa.Table) -> pa.Table:
        docs, n = np.unique(np.frombuffer(b"".join(table.column("owners").to_pylist()), np.int64), return_counts=True)
        return pa.table({"doc": docs, "n_own": n.astype(np.int64)})

    sent = sets.mapInArrow(send, "part int, slice long, keys binary, owners binary")
    told = sent.groupBy("part").applyInArrow(judge, "slice long, owners binary")
    counted = told.groupBy("slice").applyInArrow(gather, "doc long, n_own long")
    return counted.groupBy("doc").agg(F.sum("n_own").alias("n_own"))


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs ``a, b`` whose full sets are similar enough."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_py(), U), np.frombuffer(y.as_py(), U)
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * common >= round(100 * THRESHOLD) * (len(x) + len(y) - common))
            kept = batch.filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1)], names=["a", "b"])

    one = sets.select(F.col("doc").alias("a"), F.col("shingles").alias("set_a"))
    other = sets.select(F.col("doc").alias("b"), F.col("shingles").alias("set_b"))
    return pairs.join(one, "a").join(other, "b").select("a", "b", "set_a", "set_b").mapInArrow(verify, "a long, b long")


def alike(n: Column, shared: Column, n_other: Column) -> Column:
    """Whether a set of ``n`` shingles, ``shared`` of them with any other set, can be similar
    enough to one of ``n_other``: what two sets have in common is at most ``shared``."""
    percent = round(100 * THRESHOLD)
    return (100 + percent) * shared >= percent * (n + n_other)


def near_sketches(n: Column, sketch: Column, n_other: Column, sketch_other: Column) -> Column:
    """Whether sets whose odd sketches differ in so many bits can be similar enough."""
    percent, total = round(100 * THRESHOLD), n + n_other
    differ = sum((F.bit_count(F.get(sketch, F.lit(i)).bitwiseXOR(F.get(sketch_other, F.lit(i)))) for i in range(SKETCH_WORDS)), F.lit(0))
    return (100 + percent) * (total - differ) >= 2 * percent * total


def near_components(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """``node, component`` of the classes that verified links connect with others.

    ``classes``: ``doc, n_shingles, signature, bands, sketch`` of one document per set.
    """
    spark = docs.sparkSession
    total = classes.agg(F.coalesce(F.sum("n_shingles"), F.lit(0)).alias("n")).first()["n"]
    parts = max(1, -(-int(total) // PART_SHINGLES))
    members = classes.select("doc", F.posexplode("bands").alias("band", "key")).select(
        "doc", F.xxhash64("band", "key").alias("bucket")
    )
    # Buckets of one member hold no pair.
    crowded = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("bucket")
    crowded = written(members.join(crowded, "bucket"), "buckets")
    partnered = crowded.select("doc").distinct()
    sets = materialised(full_sets(docs, partnered), "sets")
    own = materialised(shared_counts(sets, parts), "own")
    # What a document shares with no other set bounds every similarity that it can have.
    sizes = classes.join(own, "doc", "left").select(
        "doc", F.col("n_shingles").alias("n"), (F.col("n_shingles") - F.coalesce("n_own", F.lit(0))).alias("shared"), "signature", "sketch"
    ).where(alike(F.col("n"), F.col("shared"), F.ceil(F.col("n") * THRESHOLD)))
    sizes = written(sizes.join(partnered, "doc"), "sizes")
    open_rows = written(crowded.join(sizes.drop("signature"), "doc").withColumn("label", F.col("doc")), "buckets")
    labels = spark.createDataFrame([], "node long, component long")
    centres = 1
    while not open_rows.isEmpty():
        by_id = Window.partitionBy("bucket").orderBy("doc")
        # Written, so that adaptive execution can split the joins with very large buckets.
        middle = open_rows.withColumn("place", F.row_number().over(by_id)).where(F.col("place") <= centres)
        middle = written(middle.select("bucket", *(F.col(c).alias(f"{c}_a") for c in ("doc", "label", "n", "shared", "sketch"))), "centres")
        # A centre meets the members after it that it isn't connected with yet.
        possible = alike(F.col("n"), F.least("shared", "shared_a"), F.col("n_a")) & near_sketches(
            F.col("n"), F.col("sketch"), F.col("n_a"), F.col("sketch_a"))
        pairs = (
            middle.join(open_rows, "bucket")
            .where((F.col("doc_a") < F.col("doc")) & (F.col("label_a") != F.col("label")) & possible)
            .select(F.col("doc_a").alias("a"), F.col("doc").alias("b")).distinct()
        )
        one = sizes.select(F.col("doc").alias("a"), F.col("signature").alias("sign_a"))
        other = sizes.select(F.col("doc").alias("b"), F.col("signature").alias("sign_b"))
        survivors = materialised(bayes_pruned(pairs.join(one, "a").join(other, "b")), "survivors")
        wanted = survivors.select(F.explode(F.array("a", "b")).alias("doc")).distinct()
        found = materialised(verified(survivors, might_contain(sets, wanted, "doc")), "links")
        if not found.isEmpty():
            labels = extended(labels, found)
        # Centres have met everyone in their bucket and leave it; buckets within one component are done.
        rest = (
            open_rows.drop("label").join(middle.select("bucket", F.col("doc_a").alias("doc")), ["bucket", "doc"], "left_anti")
            .join(labels, F.col("doc") == F.col("node"), "left")
            .select("bucket", "doc", "n", "shared", "sketch", F.coalesce("component", "doc").alias("label"))
        )
        rest = written(rest, "rest")
        mixed = rest.groupBy("bucket").agg(
            F.min("label").alias("low"), F.max("label").alias("high"), F.min("n").alias("least_n")).where("low < high")
        mixed = written(mixed.select("bucket", "least_n"), "mixed")
        # So are members whose shared shingles are too few for the smallest set left.
        open_rows = rest.join(mixed, "bucket").where(alike(F.col("n"), F.col("shared"), F.col("least_n"))).drop("least_n")
        open_rows = written(open_rows, "buckets")
        centres *= CENTRES
    return labels


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Components of documents whose sets of 5-word shingles have a Jaccard similarity of 0.75 or more.

    Returns ``doc_id, n_shingles, component_id, kept``, one row per row of
    ``docs``; the smallest id of a component stays. Links are verified on full
    sets; a pair at the threshold is missed with a probability of about 1e-5,
    more similar ones with far less.

    Words are lower-cased from A to Z. Texts of one to four words have one
    shingle; null texts and texts without words have none and stay alone. A row
    with a null id takes no part: it has no component and is kept. Rows that
    repeat an id count as one document, of the repeated texts the first by
    digest. An empty table gives an empty result.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    every = materialised(described(docs), "signatures")
    known = every.where("doc IS NOT NULL AND set_id IS NOT NULL")
    # One class per set: all documents of equal sets, named by the smallest id.
    named = known.groupBy("set_id").agg(F.min("doc").alias("class"))
    named = written(named, "classes")
    classes = (
        known.join(named, (known["set_id"] == named["set_id"]) & (known["doc"] == named["class"]), "left_semi")
        .dropDuplicates(["doc"])
    )
    first_texts = docs.where("doc IS NOT NULL")
    labels = near_components(first_texts, written(classes, "classes"))
    whole = named.join(labels, named["class"] == labels["node"], "left").select(
        "set_id", F.coalesce("component", "class").alias("component_id")
    )
    out = every.join(written(whole, "components"), "set_id", "left").withColumn(
        "component_id", F.when(F.col("doc").isNotNull(), F.coalesce("component_id", "doc"))
    )
    return out.select(
        F.col("doc").alias("doc_id"), "n_shingles", "component_id",
        (F.col("doc").isNull() | (F.col("doc") == F.col("component_id"))).alias("kept"),
    )
