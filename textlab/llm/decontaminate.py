"""Benchmark decontamination by latent semantic retrieval.

Passages (overlapping windows of every text) are TF-IDF vectors over the words
that tell benchmark items apart. A distributed randomised SVD of all passages
gives a latent space; passages near an item there are candidates. A candidate is
confirmed by the longest common subsequence of the text around it with the whole
item, weighted by how rare words are, and by the same check of the item's answer
(its last third). Changed, added and dropped words lower both checks but do not
defeat them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlab.llm.arrays import BYTES, SIGNS, U, joined, mix, release, slices
from textlab.llm.batches import materialised
from textlab.llm.blooms import might_contain

WINDOW, STRIDE = 24, 12
PART = 48  # words of an item that are searched for together
LEAST_TERMS = 8  # of every item, its rarest half of words is in the latent space, and so many at least
RANK, SKETCH = 64, 80
COSINE, EXACT_COSINE = 0.4, 0.25
OVERLAP, ANSWER = 0.6, 0.5
BLOCK_ITEMS = 500  # items searched for at once: bounds what tasks are sent
TERM_BLOCK = 512
CELLS = 1 << 22  # documents times words that are counted at once, or one document
CHUNK = 25_000  # term hits a task works on at once
LETTERS, STEP = ~SIGNS, U(0x9E3779B97F4A7C15)
PACKED = (
    "ids array<long>, counts array<int>, places binary, doc binary, window binary, first binary, second binary, "
    "start binary, term binary"
)


def plain(texts: list[str | None]) -> list[bytes]:
    return [(t or "").lower().encode("utf-8", "replace") for t in texts]


class Words:
    """The words of some texts: their ``hash``, and ``first``, the index of each text's first
    word (one more entry for the end).

    A word's hash is the sum of scrambled letters and places, which needs no sums over
    the whole text and no second hash: letters that change places change it.
    """

    def __init__(self, texts: list[bytes]):
        data, starts = joined([t + b" " for t in texts])
        inside = LETTERS[data]
        edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        if len(data) and inside[0]:
            edges = np.concatenate([[0], edges])
        start, length = edges[::2], edges[1::2] - edges[::2]  # every text ends outside a word
        self.first = np.searchsorted(start, starts)
        head = np.cumsum(length) - length
        place = np.arange(length.sum()) - np.repeat(head, length)
        letters = BYTES[data[inside]] + place.astype(U) * STEP
        letters = (letters ^ (letters >> U(32))) * U(0xBF58476D1CE4E5B9)
        letters ^= letters >> U(29)
        self.hash = mix(np.add.reduceat(letters, head)) if len(head) else np.zeros(0, dtype=U)


class Items:
    """Benchmark items as word hashes, and what is known of their words."""

    def __init__(self, rows: list[tuple[int, str]]):
        words = Words(plain([t for _, t in rows]))
        every = [words.hash[a:b] for a, b in zip(words.first[:-1], words.first[1:])]
        self.ids = [i for (i, _), w in zip(rows, every) if len(w)]
        self.words = [w for w in every if len(w)]
        self.vocabulary = np.unique(np.concatenate([*self.words, np.zeros(0, dtype=U)]))

    def weigh(self, frequency: np.ndarray, documents: int) -> None:
        """Choose the latent terms and set the weights of words by document frequency."""
        self.idf = np.log((documents + 1) / (frequency + 1)) + 0.01
        chosen = np.zeros(len(self.vocabulary), dtype=bool)
        for words in self.words:
            own = np.unique(np.searchsorted(self.vocabulary, words))
            rare = own[np.argsort(-self.idf[own], kind="stable")]
            chosen[rare[:max(LEAST_TERMS, len(own) // 2)]] = True
        self.terms, self.weight = self.vocabulary[chosen], self.idf[chosen].astype(np.float32)
        # Of every item: its length, its latent terms and their weights in it, and the weight of its other words.
        self.bounds = []
        for words in self.words:
            place, hit = found_in(self.terms, words)
            own, counts = np.unique(place[hit], return_counts=True)
            total = self.idf[np.searchsorted(self.vocabulary, words)].sum()
            share = counts * self.idf[chosen][own] / total
            self.bounds.append((len(words), own, share, 1 - share.sum()))
        parts, of = [], []
        for i, words in enumerate(self.words):
            for part in np.array_split(words, -(-len(words) // PART)):
                row = np.zeros(len(self.terms), dtype=np.float32)
                place, hit = found_in(self.terms, part)
                np.add.at(row, place[hit], self.weight[place[hit]])
                if row.any():
                    parts.append(row / np.linalg.norm(row))
                    of.append(i)
        self.parts = np.array(parts, dtype=np.float32).reshape(len(parts), len(self.terms))
        self.part_of = np.array(of, dtype=np.int64)


def found_in(vocabulary: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in a sorted vocabulary, and whether the words are there."""
    place = np.minimum(np.searchsorted(vocabulary, hashes), max(0, len(vocabulary) - 1))
    return place, vocabulary[place] == hashes if len(vocabulary) else np.zeros(len(hashes), dtype=bool)


def document_frequency(docs: DataFrame, vocabulary: np.ndarray) -> tuple[np.ndarray, int]:
    """In how many documents each word of the vocabulary occurs, and how many there are."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        total = np.zeros(len(known) + 1, dtype=np.int64)
        for batch in batches:
            texts = plain(batch.column(1).to_pylist())
            total[-1] += len(texts)
            for a, b in slices([len(t) for t in texts]):
                words = Words(texts[a:b])
                place, hit = found_in(known, words.hash)
                doc = np.repeat(np.arange(b - a), np.diff(words.first))
                doc, place = doc[hit], place[hit]
                step = max(1, CELLS // len(known))
                for low in range(0, b - a, step):
                    held = np.zeros((min(step, b - a - low), len(known)), dtype=bool)
                    some = slice(*np.searchsorted(doc, (low, low + step)))
                    held[doc[some] - low, place[some]] = True
                    total[:-1] += np.count_nonzero(held, axis=0)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["term", "n"])

    rows = docs.mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(len(vocabulary) + 1, dtype=np.int64)  # as many rows as the items have words
    for row in rows:
        out[row.term] = row.n
    shared.destroy()
    return out[:-1], int(out[-1])


class Passages:
    """The passages of some documents as a sparse matrix of unit rows.

    Passages are windows of two strides, so a hit counts in two of them. Hits are kept
    by stride (cell): ``doc`` and ``window`` of every row, its ``first`` and ``second``
    cell (-1: without a hit), where the hits of a cell ``start``, and their ``term``.
    """

    STORED = tuple((name, np.int32) for name in ("doc", "window", "first", "second", "start", "term"))

    def __init__(self, weight: np.ndarray, **arrays: np.ndarray):
        self.__dict__.update(arrays)
        self.value = weight[self.term]
        ends = np.append(self.start[1:], len(self.term))
        self.cell = np.repeat(np.arange(len(self.start)), ends - self.start)
        squares = np.append(np.add.reduceat(self.value**2, self.start), 0)  # the last for cells without a hit
        self.scale = (1 / np.sqrt(squares[self.first] + squares[self.second]))[:, None]
        # The cells of a row lie side by side.
        self.low = self.start[np.where(self.first < 0, self.second, self.first)]
        self.high = ends[np.where(self.second < 0, self.first, self.second)]

    @classmethod
    def of(cls, places: np.ndarray, terms: np.ndarray, counts: np.ndarray, weight: np.ndarray) -> Passages:
        doc, stride = np.repeat(np.arange(len(counts)), counts), places // STRIDE
        new = np.ones(len(doc), dtype=bool)
        new[1:] = (doc[1:] != doc[:-1]) | (stride[1:] != stride[:-1])
        start = np.flatnonzero(new)
        doc, stride, cell = doc[start], stride[start], np.arange(len(start))
        before = stride > 0
        # Row and cell of every first and second half, then rows in order.
        of = np.concatenate([doc, doc[before]]), np.concatenate([stride, stride[before] - 1])
        half, cells = np.repeat([0, 1], [len(doc), before.sum()]), np.concatenate([cell, cell[before]])
        order = np.lexsort((of[1], of[0]))
        row_doc, row_window = of[0][order], of[1][order]
        head = np.ones(len(order), dtype=bool)
        head[1:] = (row_doc[1:] != row_doc[:-1]) | (row_window[1:] != row_window[:-1])
        row, halves = np.cumsum(head) - 1, np.full((2, head.sum()), -1)
        halves[half[order], row] = cells[order]
        return cls(weight, doc=row_doc[head], window=row_window[head], first=halves[0], second=halves[1], start=start, term=terms)

    @classmethod
    def stored(cls, row: dict, weight: np.ndarray) -> Passages:
        return cls(weight, **{name: np.frombuffer(row[name], kind) for name, kind in cls.STORED})

    def times(self, matrix: np.ndarray) -> np.ndarray:
        cells = np.add.reduceat(matrix[self.term] * self.value[:, None], self.start, axis=0)
        cells = np.concatenate([cells, np.zeros((1, cells.shape[1]), cells.dtype)])
        return (cells[self.first] + cells[self.second]) * self.scale

    def transposed_times(self, matrix: np.ndarray, out: np.ndarray) -> None:
        """Add the product of the transposed passages and ``matrix`` to ``out``."""
        scaled = matrix * self.scale
        cells = np.zeros((len(self.start) + 1, matrix.shape[1]), scaled.dtype)
        cells[self.first] += scaled  # each cell is the first half of one row at most, and the second of one
        cells[-1] = 0
        cells[self.second] += scaled
        order = np.argsort(self.term, kind="stable")
        term = self.term[order]
        starts = np.flatnonzero(np.append(True, term[1:] != term[:-1]))
        sums = np.add.reduceat(cells[self.cell[order]], starts, axis=0)
        out[term[starts]] += sums * self.value[order][starts, None]


def passages_of(docs: DataFrame, terms: np.ndarray, weight: np.ndarray) -> DataFrame:
    """The passages that hold latent terms, packed: some documents with their hits in a row,
    at most ``CHUNK`` hits or one document."""
    shared = docs.sparkSession.sparkContext.broadcast((terms, weight))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, weight = shared.value
        prefixes = np.zeros(1 << 16, dtype=bool)
        prefixes[terms >> U(48)] = True
        held, size = [], 0

        def packed() -> pa.RecordBatch:
            ids, counts, places, found = (np.concatenate(x) for x in zip(*held))
            passages = Passages.of(places, found, counts, weight)
            columns = {"ids": pa.array([ids.tolist()], pa.list_(pa.int64())), "counts": pa.array([counts.tolist()], pa.list_(pa.int32())),
                       "places": pa.array([places.astype(np.int32).tobytes()])}
            for name, kind in Passages.STORED:
                columns[name] = pa.array([getattr(passages, name).astype(kind).tobytes()])
            return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

        for batch in batches:
            texts, ids = plain(batch.column(1).to_pylist()), batch.column(0).to_numpy()
            for a, b in slices([len(t) for t in texts]):
                words = Words(texts[a:b])
                at = np.flatnonzero(prefixes[words.hash >> U(48)])  # most words are no latent terms
                place, hit = found_in(terms, words.hash[at])
                at, place = at[hit], place[hit]
                doc = np.searchsorted(words.first, at, side="right") - 1
                counts = np.bincount(doc, minlength=b - a)
                some = counts > 0
                if some.any():
                    if held and size + counts.sum() > CHUNK:
                        yield packed()
                        held, size = [], 0
                    held.append((ids[a:b][some], counts[some], at - words.first[doc], place))
                    size += counts.sum()
        if held:
            yield packed()

    return docs.mapInArrow(find, PACKED)


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]
        release()


def gram_times(packed: DataFrame, weight: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """The product of the passages' Gram matrix over terms with ``matrix``, summed by Spark."""
    shared = packed.sparkSession.sparkContext.broadcast((weight, matrix.astype(np.float32)))
    width = matrix.shape[1]

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, matrix = shared.value
        out = np.zeros(matrix.shape, dtype=np.float64)
        for row in rows_of(batches):
            passages = Passages.stored(row, weight)
            passages.transposed_times(passages.times(matrix), out)
        blocks = range(0, len(out), TERM_BLOCK)
        yield pa.RecordBatch.from_arrays([
            pa.array(list(blocks), pa.int32()), pa.array([out[i:i + TERM_BLOCK].tobytes() for i in blocks], pa.binary()),
        ], names=["first", "block"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_py()) for x in table.column("block"))
        return pa.table({"first": table.column("first").slice(0, 1), "block": pa.array([total.tobytes()], pa.binary())})

    schema = "first int, block binary"
    some = packed.select(*(name for name, _ in Passages.STORED))
    sums = some.mapInArrow(multiply, schema).groupBy("first").applyInArrow(add, schema)
    out = np.zeros(matrix.shape)
    for row in sums.collect():  # terms times columns, whatever the number of passages
        block = np.frombuffer(bytes(row.block)).reshape(-1, width)
        out[row.first:row.first + len(block)] = block
    shared.destroy()
    return out


def latent_space(packed: DataFrame, weight: np.ndarray, rank: int = RANK, sketch: int = SKETCH, seed: int = 11) -> np.ndarray:
    """A unit vector for every term, from the right singular vectors of the passages: a
    randomised range finder with a Rayleigh-Ritz step."""
    width = min(sketch, len(weight))
    basis = np.random.default_rng(seed).standard_normal((len(weight), width))
    basis, _ = np.linalg.qr(gram_times(packed, weight, basis))
    small = basis.T @ gram_times(packed, weight, basis)
    _, vectors = np.linalg.eigh((small + small.T) / 2)
    space = basis @ vectors[:, ::-1][:, :rank]
    # Rare words load little on the first vectors; at unit length, each counts by its weight.
    return (space / np.maximum(np.linalg.norm(space, axis=1, keepdims=True), 1e-12)).astype(np.float32)


def candidates(packed: DataFrame, items: Items, space: np.ndarray) -> DataFrame:
    """``doc, item, first, last``: neighbouring windows whose cosine with an item's part is high
    in the latent space, and not low in the space of terms, where the text around them
    holds enough of the item's words."""
    latent = items.parts @ space
    latent /= np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-12)
    shared = packed.sparkSession.sparkContext.broadcast((items.weight, space, latent, items.parts, items.part_of, items.bounds))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, space, latent, parts, part_of, bounds = shared.value
        for stored in rows_of(batches):
            passages = Passages.stored(stored, weight)
            rows = passages.times(space)
            rows /= np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)
            row, part = np.nonzero(rows @ latent.T >= COSINE)
            size = (passages.high - passages.low)[row]
            pair = np.repeat(np.arange(len(row)), size)
            entry = np.arange(len(pair)) - np.repeat(np.cumsum(size) - size, size) + passages.low[row][pair]
            cosine = np.bincount(pair, parts[part[pair], passages.term[entry]] * passages.value[entry], minlength=len(row))
            cosine *= passages.scale[row, 0]
            row, item = row[cosine >= EXACT_COSINE], part_of[part[cosine >= EXACT_COSINE]]
            order = np.lexsort((passages.window[row], item, passages.doc[row]))
            doc, item, window = passages.doc[row][order], item[order], passages.window[row][order]
            new = np.ones(len(doc), dtype=bool)
            new[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (window[1:] > window[:-1] + 2)
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(doc))[: len(first)] - 1
            offsets = np.concatenate([[0], np.cumsum(stored["counts"])])
            places, terms = np.frombuffer(stored["places"], np.int32), passages.term
            possible = np.zeros(len(first), dtype=bool)
            for i, (f, e) in enumerate(zip(first, last)):
                length, own, share, other = bounds[item[f]]
                low, high = region_of(window[f], window[e], length)
                at = offsets[doc[f]] + np.searchsorted(places[offsets[doc[f]]:offsets[doc[f] + 1]], (low, high))
                # No subsequence weighs more than the latent terms that are there and all other words.
                possible[i] = share[np.isin(own, terms[at[0]:at[1]])].sum() + other >= OVERLAP - 1e-6
            first, last = first[possible], last[possible]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.array(stored["ids"])[doc[first]]), pa.array(item[first]), pa.array(window[first].astype(np.int64)),
                 pa.array(window[last].astype(np.int64))], names=["doc", "item", "first", "last"]
            )

    found = materialised(packed.mapInArrow(search, "doc long, item long, first long, last long"), "candidates")
    shared.destroy()
    return found


def region_of(first: int, last: int, length: int) -> tuple[int, int]:
    """The words around neighbouring windows in which an item of so many words may lie."""
    return max(0, first * STRIDE - length), last * STRIDE + WINDOW + length


def common_weight(item: np.ndarray, text: np.ndarray, weights: np.ndarray) -> float:
    """The weight of the heaviest common subsequence; without weights, its length."""
    best = np.zeros(len(text) + 1)
    for word, weight in zip(item, weights):
        with_word = np.where(text == word, best[:-1] + weight, 0.0)
        best[1:] = np.maximum(best[1:], with_word)
        np.maximum.accumulate(best, out=best)
    return float(best[-1])


def confirmed(docs: DataFrame, found: DataFrame, items: Items) -> DataFrame:
    """``doc, item_id, overlap, answer`` of the candidates that pass both checks."""
    weights = [items.idf[np.searchsorted(items.vocabulary, w)] for w in items.words]
    shared = docs.sparkSession.sparkContext.broadcast((items.ids, items.words, weights))
    by_doc = found.groupBy("doc").agg(F.collect_list(F.struct("item", "first", "last")).alias("places"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, known, weights = shared.value
        for batch in batches:
            rows = []
            texts = plain(batch.column(1).to_pylist())
            for a, b in slices([len(t) for t in texts]):
                words = Words(texts[a:b])
                for i in range(a, b):
                    own = words.hash[words.first[i - a]:words.first[i - a + 1]]
                    for place in batch.column(2)[i].as_py():
                        item, weight = known[place["item"]], weights[place["item"]]
                        low, high = region_of(place["first"], place["last"], len(item))
                        region = own[low:high]
                        overlap = common_weight(item, region, weight) / weight.sum()
                        if overlap < OVERLAP:
                            continue
                        from_word = len(item) * 2 // 3
                        answer = common_weight(item[from_word:], region, weight[from_word:]) / weight[from_word:].sum()
                        if answer >= ANSWER:
                            rows.append((batch.column(0)[i].as_py(), ids[place["item"]], overlap, answer))
            columns = list(zip(*rows)) if rows else [[]] * 4
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), k) for c, k in zip(columns, kinds)], names=["doc", "item_id", "overlap", "answer"]
            )

    some = might_contain(docs, found.select("doc").distinct(), "doc").join(by_doc, "doc")
    return some.select("doc", "text", "places").mapInArrow(check, "doc long, item_id long, overlap double, answer double")


def leaks(docs: DataFrame, benchmark: list[tuple[int, str]]) -> DataFrame:
    """``doc, item_id, overlap, answer``: leaks of one block of benchmark items in ``docs(doc, text)``."""
    items = Items(benchmark)
    if not items.ids:
        return docs.sparkSession.createDataFrame([], "doc long, item_id long, overlap double, answer double")
    items.weigh(*document_frequency(docs, items.vocabulary))
    packed = materialised(passages_of(docs, items.terms, items.weight), "passages")
    space = latent_space(packed, items.weight)
    return confirmed(docs, candidates(packed, items, space), items)


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """Which documents hold a benchmark item, also a changed one.

    Returns ``doc_id, contaminated, item_id, overlap, answer, n_items``, one row
    per row of ``docs``: of the confirmed items the one with the largest overlap
    (ties: the smaller id), and how many there are. All passages of all texts are
    searched for all items, in blocks of items.

    Null and empty texts are clean; null or empty items, or items without an id,
    match nothing. Rows with a null id are judged like one document without a
    name; rows that repeat an id share the judgement of all its texts. Items of
    equal texts are all found. An empty table gives an empty result.
    """
    # Null ids need a place of their own for joins.
    nothing = -(1 << 63)
    docs = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(nothing)).alias("doc"), F.col(text_col).alias("text"))
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).alias("text"))
    items = items.where("item_id IS NOT NULL AND text IS NOT NULL")
    n_blocks = max(1, -(-items.count() // BLOCK_ITEMS))
    found = None
    for block in range(n_blocks):
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == block)
        some = leaks(docs, sorted((r.item_id, r.text) for r in own.collect()))
        found = some if found is None else found.unionByName(some)
    best = F.max(F.struct("overlap", F.bitwise_not("item_id").alias("turned"), "answer")).alias("best")
    judged = materialised(found, "leaks").groupBy("doc").agg(best, F.countDistinct("item_id").alias("n_items"))
    return docs.select("doc").join(judged, "doc", "left").select(
        F.when(F.col("doc") != nothing, F.col("doc")).alias("doc_id"), F.col("n_items").isNotNull().alias("contaminated"),
        F.bitwise_not("best.turned").alias("item_id"), F.col("best.overlap").alias("overlap"),
        F.col("best.answer").alias("answer"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
    )
