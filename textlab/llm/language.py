"""Language identification with spans: scripts, word scores and Viterbi.

A model scores words by their letters: smoothed log-probabilities of hashed
character n-grams and of the word itself. The scripts of a word's letters narrow
the languages it may have. Viterbi over a text's words, with a penalty for
switching, then labels spans, so mixed texts fall into their languages.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlab.llm.arrays import BYTES, SLICE_BYTES, U, Hashes, slices
from textlab.llm.batches import materialised
from textlab.operators.ranking import hash_cutoffs

#: Labelled rows the model is fitted on, for each language: those whose hashes of the id are least.
FIT_ROWS = 2_000
BUCKETS = 1 << 16
GRAMS = (1, 2, 3, 4)  # of UTF-8 bytes, with a space on both sides
SMOOTHING = 0.5
SWITCH = 6.0  # log-odds a word must bring to change the language
WORK = 8 << 20  # bytes of text times languages that are followed together, at most
UNKNOWN = "und"
WORDS = re.compile(r"[^\W\d_]+")  # also of numbers that are no digits, such as fractions
#: First code points of Unicode's ranges of letters, and the script from there on.
SCRIPTS = (
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"),
    (0x0600, "Arabic"), (0x0700, "other"), (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "Gurmukhi"),
    (0x0A80, "Gujarati"), (0x0B00, "other"), (0x0B80, "Tamil"), (0x0C00, "Telugu"), (0x0C80, "Kannada"),
    (0x0D00, "Malayalam"), (0x0D80, "Sinhala"), (0x0E00, "Thai"), (0x0E80, "Lao"), (0x0F00, "Tibetan"),
    (0x1000, "Myanmar"), (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Ethiopic"), (0x13A0, "other"),
    (0x1780, "Khmer"), (0x1800, "other"), (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, "other"),
    (0x3040, "Kana"), (0x3100, "other"), (0x3400, "Han"), (0xA000, "other"), (0xAC00, "Hangul"),
    (0xD7B0, "other"), (0xF900, "Han"), (0xFB00, "other"), (0x20000, "Han"), (0x30000, "other"),
)
_STARTS = np.array([s for s, _ in SCRIPTS])
_NAMES = sorted({name for _, name in SCRIPTS})
_CODES = np.array([_NAMES.index(name) for _, name in SCRIPTS])


@dataclass(frozen=True)
class Model:
    """Languages in alphabetical order, log-probabilities (bucket, language), and
    which scripts (rows) a language (column) is written in."""

    languages: list[str]
    weights: np.ndarray
    scripts: np.ndarray


def words_of(text: str | None) -> list[str]:
    """Runs of letters in lower case; signs of numbers that are no digits end a word."""
    if not text:
        return []
    found = WORDS.findall(text.lower())
    if all(map(str.isalpha, found)):
        return found
    return [w for x in found for w in "".join(c if c.isalpha() else " " for c in x).split()]


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of all n-grams of all words, and where each word's begin (and the end)."""
    parts = [f" {w} ".encode() for w in words]
    lengths = np.array([len(p) for p in parts], dtype=np.int64)
    first = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    hashes = Hashes(BYTES[np.frombuffer(b"".join(parts), np.uint8)])
    owner = np.repeat(np.arange(len(words)), lengths)
    places = np.arange(first[-1])
    room = first[owner + 1] - places
    found, of = [hashes.of(first[:-1], first[1:])], [np.arange(len(words))]
    for k in GRAMS:
        fits = room >= k
        found.append(hashes.of(places[fits], places[fits] + k))
        of.append(owner[fits])
    found, of = np.concatenate(found), np.concatenate(of)
    order = np.argsort(of, kind="stable")
    starts = np.searchsorted(of[order], np.arange(len(words) + 1))
    return (found[order] % U(BUCKETS)).astype(np.int64), starts


def scripts_of(words: list[str]) -> np.ndarray:
    """Words by scripts: true where a letter of the word is in the script."""
    letters = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    script = _CODES[np.searchsorted(_STARTS, letters, side="right") - 1]
    owner = np.repeat(np.arange(len(words)), [len(w) for w in words])
    out = np.zeros((len(words), len(_NAMES)), dtype=bool)
    out[owner, script] = True
    return out


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        rows: int = FIT_ROWS) -> Model:
    """Fit on at most ``rows`` labelled documents of each language, on their whole texts."""
    labelled = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    labelled = labelled.where("lang IS NOT NULL AND text IS NOT NULL")
    labelled = labelled.withColumn("digest", F.md5(F.col("doc_id").cast("string")))
    # The digest of the last row of each language: a row per language, so texts stay in place.
    cut = hash_cutoffs(labelled.select("lang", "digest"), "digest", F.least(F.col("n"), F.lit(rows)), "lang")
    sample = labelled.join(F.broadcast(cut), "lang").where(F.col("digest") <= F.col("cutoff")).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = words_of(text)
                if words:
                    total = counts.setdefault(lang, np.zeros(BUCKETS + len(_NAMES), dtype=np.int64))
                    total[:BUCKETS] += np.bincount(features(words)[0], minlength=BUCKETS)
                    total[BUCKETS:] += scripts_of(words).sum(axis=0)
        for lang, total in counts.items():
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(some)), pa.array(some.astype(np.int32)), pa.array(total[some])],
                names=["lang", "bucket", "n"],
            )

    counted = sample.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    # At most languages times buckets rows, however many documents there are.
    table = counted.toPandas()
    languages = sorted(table["lang"].unique())
    totals = np.zeros((BUCKETS + len(_NAMES), len(languages)))
    totals[table["bucket"], table["lang"].map({x: i for i, x in enumerate(languages)})] = table["n"]
    grams, scripts = totals[:BUCKETS] + SMOOTHING, totals[BUCKETS:]
    weights = np.log(grams / grams.sum(axis=0)) if languages else grams
    return Model(languages, weights.astype(np.float32), scripts >= 0.01 * scripts.sum(axis=0))


def word_scores(words: list[str], model: Model) -> np.ndarray:
    """Words by languages: mean log-probability of a word's n-grams times its letters,
    less the best one; languages not written in the word's scripts are far behind."""
    buckets, starts = features(words)
    sums = np.add.reduceat(model.weights[buckets], starts[:-1], axis=0)
    scores = sums / np.diff(starts)[:, None] * np.array([len(w) for w in words])[:, None]
    fits = (scripts_of(words).astype(np.int64) @ model.scripts) > 0
    scores = np.where(fits | ~fits.any(axis=1, keepdims=True), scores, scores - 50)
    return (scores - scores.max(axis=1, keepdims=True)).astype(np.float32)


class ScoredWords:
    """Scores of words, kept for the texts to come: a task computes those of a frequent word once."""

    MOST = 1 << 20  # words times languages that are kept, and those of one slice besides

    def __init__(self, model: Model):
        self.model, self.numbers, self.scores, self.letters = model, {}, None, None

    def of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The scores and the number of letters of every word."""
        if len(self.numbers) * len(self.model.languages) > self.MOST:
            self.numbers, self.scores = {}, None
        numbers, before = self.numbers, len(self.numbers)
        flat = np.array([numbers.setdefault(w, len(numbers)) for w in words], dtype=np.int64)
        new = list(islice(numbers, before, None))
        if new:
            scores, letters = word_scores(new, self.model), np.array([len(w) for w in new])
            kept = self.scores is not None
            self.scores = np.concatenate([self.scores, scores]) if kept else scores
            self.letters = np.concatenate([self.letters, letters]) if kept else letters
        return self.scores[flat], self.letters[flat]


def viterbi(scores: np.ndarray, first: np.ndarray, switch: float) -> np.ndarray:
    """The best language of every word: least loss, where each change costs ``switch``.

    ``first``: index of each text's first word, and the end. All texts are followed
    together, word by word, the longest first; what is kept grows with words times languages.
    """
    langs, lengths = scores.shape[1], np.diff(first)
    order = np.argsort(-lengths, kind="stable")
    starts = first[:-1][order]
    alive = len(lengths) - np.cumsum(np.bincount(lengths))  # texts with a word at each place
    value = np.zeros((len(order), langs), dtype=np.float32)
    changed = np.zeros(scores.shape, dtype=bool)
    top = np.zeros(len(scores), dtype=np.int32)
    rows = np.arange(len(order))
    for place, k in enumerate(alive.tolist()):
        at, here = starts[:k] + place, value[:k]
        best = here.argmax(axis=1)
        change = (here[rows[:k], best] - np.float32(switch))[:, None]
        changed[at], top[at] = here < change, best
        np.maximum(here, change, out=here)
        here += scores[at]
    out = np.zeros(len(scores), dtype=np.int64)
    state = value.argmax(axis=1)
    for place in range(len(alive) - 1, -1, -1):
        k = alive[place]
        at, here = starts[:k] + place, state[:k]
        out[at] = here
        state[:k] = np.where(changed[at, here], top[at], here)
    return out


def identify(
    docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", switch: float = SWITCH,
    keep: tuple[str, ...] = (), spans: bool = False,
) -> DataFrame:
    """The language of every text: ``doc_id, lang_pred, score``, the columns ``keep``
    and, with ``spans``, ``spans``: ``lang, first, words`` of every span in order.

    The language with most letters in its spans is the text's; the score is its
    share of them. A null text, or one without a letter, is ``und`` with score 0
    and no span; so is every text if nothing could be learnt. Ties go to the first
    language in the alphabet. One row per row of ``docs``; null ids and repeated
    rows are judged like others, an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    chosen = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"), *keep)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        languages = np.array(known.languages, dtype=object)
        most = min(SLICE_BYTES, WORK // max(1, len(languages)))
        scored = ScoredWords(known)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            predicted, score, parts = [UNKNOWN] * len(texts), [0.0] * len(texts), [[] for _ in texts]
            # Texts of similar length together: their words are followed side by side.
            order = sorted(range(len(texts)), key=lambda i: -len(texts[i] or ""))
            for a, b in slices([len(texts[i] or "") for i in order], most):
                rows = order[a:b]
                found = [words_of(texts[i]) if len(languages) else [] for i in rows]
                first = np.concatenate([[0], np.cumsum([len(w) for w in found])]).astype(np.int64)
                if not first[-1]:
                    continue
                scores, letters = scored.of([w for ws in found for w in ws])
                labels = viterbi(scores, first, switch)
                text_of = np.repeat(np.arange(b - a), np.diff(first))
                amount = np.bincount(text_of * len(languages) + labels, letters, minlength=(b - a) * len(languages))
                amount = amount.reshape(b - a, len(languages))
                top, whole = amount.argmax(axis=1), amount.sum(axis=1)
                for i, row in enumerate(rows):
                    if not whole[i]:
                        continue
                    predicted[row], score[row] = languages[top[i]], amount[i, top[i]] / whole[i]
                    if spans:
                        own = labels[first[i]:first[i + 1]]
                        cut = np.flatnonzero(np.diff(own, prepend=-1))
                        ends = np.append(cut[1:], len(own))
                        parts[row] = [
                            {"lang": languages[own[c]], "first": int(c), "words": int(e - c)} for c, e in zip(cut, ends)
                        ]
            columns = [batch.column(0), *(batch.column(2 + i) for i in range(len(keep))),
                       pa.array(predicted, pa.string()), pa.array(score, pa.float64())]
            if spans:
                columns.append(pa.array(parts, pa.list_(pa.struct([
                    ("lang", pa.string()), ("first", pa.int32()), ("words", pa.int32())]))))
            yield pa.RecordBatch.from_arrays(columns, names=names)

    fields = [f"{f.name} {f.dataType.simpleString()}" for f in chosen.drop("_text").schema]
    fields += ["lang_pred string", "score double"]
    fields += ["spans array<struct<lang: string, first: int, words: int>>"] * spans
    names = [f.split(" ")[0] for f in fields]
    found = materialised(chosen.mapInArrow(label, ", ".join(fields)), "languages")
    shared.destroy()
    return found


def held_out(doc_id, folds: int = 5):
    """Whether a row is never learnt from: a fifth of the ids by CRC-32, and null ids."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(folds)) == 0, F.lit(True))
