"""Language-model scores by a weighted backoff automaton.

The model is smoothed word pairs over smoothed words: a pair seen ``c`` times
after a word seen ``n`` times has the probability ``(c + PRIOR p) / (n + PRIOR)``,
where ``p`` is the second word's own. As an automaton, every word is a state; a
seen pair is an arc with its log-probability, and a failure arc with the weight
``PRIOR / (n + PRIOR)`` leads to the root, which has an arc for every word. One
traversal from left to right carries the state and adds up the weights.

No task holds the model. Documents are written in chunks; each chunk sends its
words and pairs with their counts to the parts they hash to, packed and sorted,
so a frequent one moves once per chunk. Parts add up what all chunks have sent and
answer every chunk in the order it asked, without repeating the keys. The
answers are all that a chunk's share of the automaton is built from.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlab.llm.arrays import U, mix
from textlab.llm.batches import materialised
from textlab.llm.repeats import encoded

FOLDS, HELD_OUT = 5, 1
PRIOR = 1_000  # words of prior mass that the single words have after each word
CHUNK_BYTES = 8 << 20  # text of a chunk, or one document
PART_TOKENS = 4_000_000  # tokens, and so pairs at most, for each part
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
END = b""  # the token that ends a text, and the state before its first word

CHUNK = "chunk long, doc array<long>, learn binary, held_out binary, sizes binary, n_tokens long, tokens binary, words binary"
ASK = "part int, chunk long, words binary, n_words binary, pairs binary, n_pairs binary"
ANSWER = "part int, chunk long, n_words binary, n_pairs binary, tokens long, types long"
SCORE = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def pack(array: np.ndarray) -> bytes:
    """Numbers as compressed bytes, equal places of all numbers together."""
    raw = np.ascontiguousarray(array, np.int64).view(np.uint8).reshape(-1, 8).T.tobytes()
    return len(array).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpack(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    raw = pa.decompress(data[8:], decompressed_size=8 * n, codec="zstd", asbytes=True)
    return np.frombuffer(raw, np.uint8).reshape(8, n).T.copy().view(np.int64).reshape(n)


def pack_text(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def unpack_text(data: bytes) -> bytes:
    return pa.decompress(data[8:], decompressed_size=int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)


def part_of(key: np.ndarray, parts: int) -> np.ndarray:
    """Parts are ranges of keys, of equal width."""
    return ((key >> U(32)) * U(parts) >> U(32)).astype(np.int64)


def chunk_row(number: int, docs: list, learn: list, held: list, texts: list[bytes]) -> pa.RecordBatch:
    """A chunk's documents as numbers of its own words, the most frequent first."""
    known: dict[bytes, int] = defaultdict(count().__next__)
    parts, sizes = [], []
    for text in texts:
        words = text.translate(LOWER).split()
        words.append(END)
        parts.append(np.fromiter(map(known.__getitem__, words), np.int64, len(words)))
        sizes.append(len(words))
    tokens = np.concatenate(parts)
    order = np.argsort(-np.bincount(tokens, minlength=len(known)), kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    words = list(known)
    return pa.RecordBatch.from_arrays([
        pa.array([number], pa.int64()), pa.array([docs], pa.list_(pa.int64())),
        pa.array([pack(np.array(learn))]), pa.array([pack(np.array(held))]), pa.array([pack(np.array(sizes))]),
        pa.array([len(tokens)], pa.int64()), pa.array([pack(place[tokens])]),
        pa.array([pack_text(b" ".join(words[i] for i in order))]),
    ], names=["chunk", "doc", "learn", "held_out", "sizes", "n_tokens", "tokens", "words"])


def chunked(docs: DataFrame) -> DataFrame:
    """The documents (``doc, learn, held_out, text``) in chunks, written: their numbers hold from now on."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held, size = [[], [], [], []], 0
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns[:3]]
            for *row, text in zip(*columns, encoded(batch.column(3))):
                if size and size + len(text) > CHUNK_BYTES:
                    yield chunk_row(number, *held)
                    number, held, size = number + 1, [[], [], [], []], 0
                for column, value in zip(held, (*row, text)):
                    column.append(value)
                size += len(text) + 8
        if size:
            yield chunk_row(number, *held)

    return materialised(docs.mapInArrow(cut, CHUNK), "chunks")


def grouped(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sorted order of numbers, where groups of equal ones begin in it, and the group of every number."""
    order = np.argsort(values)
    ordered = values[order]
    new = np.append(True, ordered[1:] != ordered[:-1])[:len(order)]
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(new) - 1
    return order, np.flatnonzero(new), group


class Chunk:
    """A chunk and the order in which it asks: words by part, pairs by key, whose first bits are the part."""

    def __init__(self, row: dict, parts: int):
        self.doc, self.tokens, self.sizes = row["doc"], unpack(row["tokens"]), unpack(row["sizes"])
        self.learn, self.held_out = unpack(row["learn"]) > 0, unpack(row["held_out"]) > 0
        self.words = unpack_text(row["words"]).split(b" ")
        n = len(self.words)
        self.starts = np.cumsum(self.sizes) - self.sizes
        # The state in which every token is read: the token before it. A text begins in the
        # state that the end of another has reached.
        state = np.empty_like(self.tokens)
        state[1:] = self.tokens[:-1]
        state[self.starts] = self.words.index(END)
        learnt = np.repeat(self.learn, self.sizes)
        code = state * n + self.tokens
        order, first, self.pair = grouped(code)
        code = code[order[first]]  # of every different pair
        self.state, self.word = code // n, code % n
        counts = np.add.reduceat(learnt[order].astype(np.int64), first)
        hashes = mix(np.array([xxhash.xxh3_64_intdigest(w) for w in self.words], U))
        key = mix(mix(hashes)[self.state] + hashes[self.word])
        self.order = np.argsort(key)
        self.key, self.pair_counts = key[self.order], counts[self.order]
        self.pair_ends = np.searchsorted(part_of(self.key, parts), np.arange(parts), "right")
        part = part_of(hashes, parts)
        self.word_order = np.argsort(part, kind="stable")
        self.word_counts = np.bincount(self.tokens[learnt], minlength=n)[self.word_order]
        self.word_ends = np.searchsorted(part[self.word_order], np.arange(parts), "right")

    def asks(self) -> Iterator[tuple]:
        a = c = 0
        for part, (b, d) in enumerate(zip(self.word_ends.tolist(), self.pair_ends.tolist())):
            if b > a or d > c:
                steps = np.diff(self.key[c:d], prepend=U(0)).view(np.int64)
                words = b" ".join(self.words[i] for i in self.word_order[a:b])
                yield (part, pack_text(words) if b > a else None, pack(self.word_counts[a:b]), pack(steps), pack(self.pair_counts[c:d]))
            a, c = b, d


def asked(chunks: DataFrame, parts: int) -> DataFrame:
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                part, *columns = zip(*Chunk(row, parts).asks())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part, pa.int32()), pa.array([row["chunk"]] * len(part), pa.int64()),
                     *(pa.array(c, pa.binary()) for c in columns)],
                    names=["part", "chunk", "words", "n_words", "pairs", "n_pairs"])

    return chunks.mapInArrow(ask, ASK)


def answer(table: pa.Table) -> pa.Table:
    """The counts of all chunks for every word and pair that a chunk has asked for; with the
    first answer of a part, how many tokens and different words it has counted."""
    words = [None if w is None else unpack_text(w).split(b" ") for w in table.column("words").to_pylist()]
    counts = [unpack(x) for x in table.column("n_words").to_pylist()]
    total: dict[bytes, int] = {}
    for some, times in zip(words, counts):
        for word, n in zip(some or (), times.tolist()):
            total[word] = total.get(word, 0) + n
    n_words = [pack(np.array([total[w] for w in some or ()], np.int64)) for some in words]
    keys = [np.cumsum(unpack(x).view(U), dtype=U) for x in table.column("pairs").to_pylist()]
    times = np.concatenate([unpack(x) for x in table.column("n_pairs").to_pylist()])
    order, first, group = grouped(np.concatenate(keys))
    sums = np.add.reduceat(times[order], first) if len(order) else times
    ends = np.cumsum([len(k) for k in keys])
    n_pairs = [pack(x) for x in np.split(sums[group], ends[:-1])]
    rest = [0] * (table.num_rows - 1)
    return pa.table({
        "part": table.column("part"), "chunk": table.column("chunk"),
        "n_words": pa.array(n_words, pa.binary()), "n_pairs": pa.array(n_pairs, pa.binary()),
        "tokens": pa.array([sum(total.values()), *rest], pa.int64()),
        "types": pa.array([sum(n > 0 for n in total.values()), *rest], pa.int64()),
    })


class Automaton:
    """The states and arcs that a chunk can reach. State and word numbers are the chunk's."""

    def __init__(self, words: np.ndarray, state: np.ndarray, word: np.ndarray, pairs: np.ndarray, tokens: int, types: int, prior: float):
        self.root = np.log10((words + 0.5) / (tokens + 0.5 * (types + 1)))
        self.back = np.log10(prior / (words + prior))
        # For each state and word: the arc of a seen pair, else the failure arc to the root and its arc for the word.
        arc = np.log10((pairs + prior * 10 ** self.root[word]) / (words[state] + prior))
        self.step = np.where(pairs > 0, arc, self.back[state] + self.root[word])

    def scores(self, pair: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The log-probability of every text: the weights of its steps, added up from left to right.

        A step leads into the state of the word it reads, so the states that a traversal
        carries through the texts are known, and one pass takes the steps of them all."""
        return np.add.reduceat(self.step[pair], starts)


def scored(chunks: DataFrame, answers: DataFrame, parts: int, tokens: int, types: int, prior: float) -> DataFrame:
    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        chunk = Chunk(left.to_pylist()[0], parts)
        by_part = right.sort_by("part")
        words, pairs = (np.zeros(n, np.int64) for n in (len(chunk.words), len(chunk.state)))
        words[chunk.word_order] = np.concatenate([unpack(x) for x in by_part.column("n_words").to_pylist()])
        pairs[chunk.order] = np.concatenate([unpack(x) for x in by_part.column("n_pairs").to_pylist()])
        automaton = Automaton(words, chunk.state, chunk.word, pairs, tokens, types, prior)
        found = automaton.scores(chunk.pair, chunk.starts)
        rows = len(chunk.sizes)
        return pa.table({
            "doc_id": pa.array(chunk.doc, pa.int64()), "held_out": pa.array(chunk.held_out), "n_tokens": pa.array(chunk.sizes),
            "n_known": pa.array(np.add.reduceat((words > 0)[chunk.tokens].astype(np.int64), chunk.starts)),
            "train_tokens": pa.array([tokens] * rows, pa.int64()),
            "base_score": pa.array(np.add.reduceat(automaton.root[chunk.tokens], chunk.starts)),
            "score": pa.array(found, pa.float64()),
        })

    return chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(score, SCORE)


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prior: float = PRIOR) -> DataFrame:
    """Score whole texts by a model of the texts that are not held out.

    Tokens are the words between white space, with A-Z in lower case, and one end
    for each text. Returns ``doc_id, held_out, n_tokens, n_known`` (tokens seen in
    training), ``train_tokens, base_score`` (single words only) and ``score``, both
    the base-10 logarithm of the text's probability. The base gives a word seen
    ``c`` times ``(c + 0.5) / (N + 0.5 (V + 1))``.

    One row per row of ``docs``. Null and empty texts have one token, their end.
    Held out is a fifth of the ids by CRC-32, and every row with a null id: its
    remainder is unknown, so nothing is learnt from it. Rows that repeat an id are
    scored and learnt from each by itself. Without a text to learn from, ``N`` and
    ``V`` are 0. Words are compared as they are, pairs by 64-bit hashes. An empty
    table gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    held = F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(FOLDS)) == HELD_OUT, F.lit(True))
    docs = docs.select(
        F.col(id_col).cast("long").alias("doc"), (~held).cast("int").alias("learn"), held.cast("int").alias("held_out"),
        F.col(text_col).alias("text"))
    chunks = chunked(docs)
    total = chunks.agg(F.sum("n_tokens").alias("n")).first()["n"]
    if total is None:
        return spark.createDataFrame([], SCORE)
    parts = max(1, -(-int(total) // PART_TOKENS))
    answers = materialised(asked(chunks, parts).groupBy("part").applyInArrow(answer, ANSWER), "answers")
    counted = answers.agg(F.sum("tokens").alias("tokens"), F.sum("types").alias("types")).first()
    return materialised(scored(
        chunks, answers.select("part", "chunk", "n_words", "n_pairs"), parts, int(counted["tokens"]), int(counted["types"]), prior), "scores")
