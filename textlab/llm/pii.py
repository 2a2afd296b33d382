"""Personal data: generated candidates, boosted trees and calibrated thresholds.

Exact formats (the base) are always found. Beyond them, generators of high
recall propose overlapping spans: addresses spelled out, numbers grouped in any
way. A proposal that fails the check of its kind is none; boosted trees judge the
others by their format and context. They are trained on what the corpus itself
labels: base spans, also written as the generators expect them (:func:`rewritten`),
against proposals that fail and against decoys put in the place of base spans:
numbers and phrases that pass the check and are no personal data (:func:`decoys`).
Proposals that pass are in no fit and no calibration. A kind without labels of its
own learns from fixed examples. A threshold per kind is calibrated on rows that
were not trained on. Secrets and formats without a generator are not proposed.
"""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlab.llm.batches import materialised
from textlab.session import written

KINDS = ("email", "ip", "card", "phone")
#: Labelled proposals the trees are fitted and calibrated on, of each kind and label, at most.
FIT_ROWS = 5_000
FIT_PARTS, PART_ROWS = 6, 100_000  # parts of a fit at least, and rows of a part at most
TREES, DEPTH = 20, 5
PRECISION = 0.98  # that proposals above a threshold must reach on held-out rows

#: The exact formats.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

SPELLED = re.compile(
    r"[\w.%+-]{1,64}[ ]?(?:\(at\)|\[at\]|\{at\}|[ ]at[ ])[ ]?[\w-]+(?:[ ]?(?:\(dot\)|\[dot\]|\{dot\}|[ ]dot[ ]|\.)[ ]?[\w-]+)+", re.I)
AT = re.compile(r"\(at\)|\[at\]|\{at\}| at [\w-]+ dot ", re.I)
NUMBER = re.compile(r"[+(]?[0-9](?:[ ().\-/:_]{0,3}[0-9])*")
CONTEXT = (
    re.compile(r"\b(?:e-?mail|mail|contact|write|address)\b", re.I), re.compile(r"\b(?:ip|host|server|addr|network)\b", re.I),
    re.compile(r"\b(?:card|visa|credit|payment|account)\b", re.I), re.compile(r"\b(?:phone|tel|call|mobile|fax|cell)\b", re.I),
)
UNSPELL = ((re.compile(r" ?(?:\(at\)|\[at\]|\{at\}| at ) ?", re.I), "@"), (re.compile(r" ?(?:\(dot\)|\[dot\]|\{dot\}| dot ) ?", re.I), "."))
DOMAIN = re.compile(r"[^@]+@([A-Za-z0-9-]+\.)+[A-Za-z]{2,}")
#: A letter or digit of the same word before a number, unless the word names what follows; a letter after it, unless it is an extension.
WORD_BEFORE, WORD_AFTER = re.compile(r"[A-Za-z0-9]+$"), re.compile(r"(?!(?:x|ext)\.?[0-9]{1,6}\b)[A-Za-z]", re.I)
#: Dates, with or without a time, and spans of years.
DATE = re.compile(
    r"(?:(?:19|20)[0-9]{2}[-/. ](?:0?[1-9]|1[0-2])[-/. ](?:0?[1-9]|[12][0-9]|3[01])"
    r"|(?:0?[1-9]|[12][0-9]|3[01])[-/. ](?:0?[1-9]|1[0-2])[-/. ](?:19|20)[0-9]{2})"
    r"(?:[ _]{1,3}[0-9]{2}:[0-9]{2}(?::[0-9]{2}(?:\.[0-9]+)?)?)?|(?:19|20)[0-9]{2} ?[-/] ?(?:19|20)[0-9]{2}")
#: Words and signs before a number that is no personal data.
COUNTED = (
    "build", "order", "order no.", "id", "ticket", "invoice", "version", "release", "section", "item", "serial", "ref", "total", "sum",
    "row", "batch", "part", "isbn", "page", "code", "number", "no.", "#", "$", "id=",
)
OTHER = re.compile(r"(?:\b(?:" + "|".join(re.escape(w) for w in COUNTED if w[0].isalpha() and w[-1].isalpha())
                   + r"|no\.|nr|id=)|[#$€£=])[ :.#]{0,3}$", re.I)
#: Of each kind, spans from ranges set aside for documentation or tests, and spans that fail the check.
EXAMPLES = (
    (("ann.lee@example.com", "info@mail.example.org", "j_doe7@example.co.uk"), ("meet (at) noon.9", "look [at] page.7", "sale (at) shop.2x")),
    (("192.0.2.17", "198.51.100.234", "203.0.113.8"), ("1.20.300.4", "999.1.2.3", "12.345.67.8")),
    (("4111 1111 1111 1111", "5500-0000-0000-0004", "340000000000009"), ("4111 1111 1111 1112", "1234567890123456", "3400-0000-0000-008")),
    (("+1 202 555 0143", "+44 20 7946 0958", "+49 30 23125 604"), ("a1b20255501430c", "f4402079460958e", "0d4930231256044ab")),
)
AROUND = ("{}", "contact {} now", "it is {}.", "write or call: {}", "({})", "from {} on")
SPAN = "kind: int, start: int, end: int"
SCANNED = (
    f"doc_id long, base array<struct<{SPAN}>>, "
    f"candidates array<struct<{SPAN}, label: int, features: array<double>>>"
)


def octet(part: str) -> bool:
    """Whether digits are 255 at most; int() itself refuses very long ones."""
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        value = int(d) * (1 + i % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """What ``EMAIL.finditer`` finds, looking only around each ``@``."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        found = EMAIL.match(text, start) if start < at else None
        if found:
            done = found.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``start, kind, end`` of the exact formats, by start, then kind."""
    found = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    if NUMBER.search(text):
        found += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(map(octet, m.group().split(".")))]
        for m in CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
                    found.append((m.start(), 3, m.end()))
    return sorted(found)


def proposals(text: str) -> list[tuple[int, int, int]]:
    """``kind, start, end`` that a generator of high recall proposes; they may overlap."""
    found = []
    if AT.search(text):
        found += [(0, m.start(), m.end()) for m in SPELLED.finditer(text)]
    for m in NUMBER.finditer(text):
        span, digits = m.group(), sum(c.isdigit() for c in m.group())
        if len(re.findall("[0-9]+", span)) == 4 and digits <= 12:
            found.append((1, m.start(), m.end()))
        if 12 <= digits <= 19:
            found.append((2, m.start(), m.end()))
        if 7 <= digits <= 15:
            found.append((3, m.start(), m.end()))
    return found


def isbn(digits: str) -> bool:
    """Whether digits are a book's number of 13 digits."""
    return len(digits) == 13 and digits[:3] in ("978", "979") and sum(int(d) * (1 + 2 * (i % 2)) for i, d in enumerate(digits)) % 10 == 0


def passes(text: str, kind: int, start: int, end: int) -> bool:
    """Whether a proposal passes the check of its kind: a domain once it is un-spelled,
    four octets, Luhn's sum, a phone's number of digits; and no number is a part of a word,
    a date or a book's number."""
    span = text[start:end]
    if kind == 0:
        for pattern, sign in UNSPELL:
            span = pattern.sub(sign, span)
        return bool(DOMAIN.fullmatch(span))
    word = WORD_BEFORE.search(text[max(0, start - 40):start])
    if word and not CONTEXT[kind].fullmatch(word.group()) or WORD_AFTER.match(text, end):
        return False
    groups = re.findall("[0-9]+", span)
    digits = "".join(groups)
    if DATE.fullmatch(span) or isbn(digits):
        return False
    if kind == 1:
        return len(groups) == 4 and all(map(octet, groups))
    return 12 <= len(digits) <= 19 and luhn(digits) if kind == 2 else 7 <= len(digits) <= 15


def rewritten(span: str, kind: int) -> list[str]:
    """An exact span as it may be written otherwise: spelled out, with other separators, without ``+``."""
    chance = zlib.crc32(span.encode())  # every way gets its share
    if kind == 0:
        name, domain = span.split("@", 1)
        ways = ((" (at) ", " (dot) "), (" at ", " dot "), ("[at]", "[dot]"), ("(at)", "."), (" [at] ", " [dot] "), (" {at} ", "."))
        first = chance % len(ways)
        forms = [name + at + domain.replace(".", dot) for at, dot in (ways[first], ways[first - 3])]
        return [f for f in forms if AT.search(f) and SPELLED.fullmatch(f)]
    groups = re.findall("[0-9]+", span)
    if kind == 1:
        return [" . ".join(groups), ("-", ":", "/")[chance % 3].join(groups)]
    if kind == 2:
        digits = "".join(groups)
        fours = [digits[i:i + 4] for i in range(0, len(digits), 4)]
        return [(".", "/", " - ", "_", "  ")[chance % 5].join(fours), (".", "/")[chance % 2].join(groups)]
    forms = [span.replace("+", ""), (".", "-", " ", "/")[chance % 4].join(groups)]
    if len(groups) > 1 and sum(map(len, groups[1:])) >= 7:
        forms.append(span.split(groups[0], 1)[1].lstrip(" ).-"))  # without the country's number
        forms.append("0" + " ".join(groups[1:]))
        forms.append(("-", ".", " ")[chance % 3].join(groups[1:]))
    return [f.strip() for f in forms if not f.strip().startswith("+") and 7 <= sum(c.isdigit() for c in f) <= 15]


def decoys(span: str, kind: int) -> list[tuple[str, str]]:
    """``lead, form``: what passes the check of a kind, or nearly, and is no personal data.

    Its digits follow from the span. An empty lead stands for the span's own context
    without the words that announce its kind.
    """
    draw = random.Random(zlib.crc32(span.encode()))
    number = lambda n: str(draw.randint(1, 9)) + "".join(draw.choices("0123456789", k=n - 1))
    lead = lambda: draw.choice(COUNTED) + " "
    if kind == 0:
        verbs, then = ("arrive", "look", "stop", "meet", "gather", "reconvene"), ("Then", "We", "It", "So", "Afterwards", "Everyone")
        places = ("noon", "home", "work", "night", "school", "Christmas", "headquarters", "university")
        return [("", f"{draw.choice(verbs)} at {draw.choice(places)}.{draw.choice(then)}") for _ in range(2)]
    if kind == 1:
        four = [str(draw.randint(0, 40)) for _ in range(4)]
        return [(lead(), draw.choice(("-", "/", ":", " ")).join(four)), ("", " ".join(four))]
    if kind == 2:
        body = number(draw.randint(12, 16))
        body = next(b for b in (body + str(d) for d in range(10)) if luhn(b))
        cut = draw.randint(3, 9)
        return [(lead(), f"{body[:cut]}{draw.choice('./_')}{body[cut:]}"), ("", f"{body[:1]}.{body[1:]}")]
    bare, date = number(draw.randint(7, 13)), f"20{draw.randint(10, 29)}-{draw.randint(1, 12):02d}-{draw.randint(1, 28):02d}"
    thousands = f"{number(draw.randint(1, 3))}{draw.choice(' .')}{number(3)}{draw.choice(' .')}{number(3)}"
    return [(lead(), bare), ("", number(draw.randint(7, 13))), ("", f"{date} {number(2)}"), (lead(), thousands),
            (lead(), f"{number(draw.randint(3, 5))}{draw.choice('-/_.')}{number(draw.randint(4, 6))}")]


def labelled(text: str, base: list[tuple[int, int, int]]) -> list[tuple]:
    """``kind, start, end, label, features`` of the base spans, as they are and rewritten
    (label 1), of decoys in their place (0), and of the proposals outside them: 0 if they
    fail their check, else null."""
    rows = []
    for a, k, b in base:
        rows.append((k, a, b, 1, features(text, k, a, b)))
        before, after = text[max(0, a - 40):a], text[b:b + 40]
        plain = CONTEXT[k].sub("", before)  # the same without the words that announce the kind
        for form in rewritten(text[a:b], k):
            for ahead in {before, before if form.isdigit() else plain}:
                rows.append((k, a, b, 1, features(ahead + form + after, k, len(ahead), len(ahead) + len(form))))
        for lead, form in decoys(text[a:b], k):
            ahead = plain + lead
            rows.append((k, a, b, 0, features(ahead + form + after, k, len(ahead), len(ahead) + len(form))))
    for k, a, b in proposals(text):
        if all(b <= x or y <= a for x, _, y in base):
            rows.append((k, a, b, None if passes(text, k, a, b) else 0, features(text, k, a, b)))
    return rows


def examples(kind: int, label: int) -> list[list[float]]:
    """The features of the fixed examples of a kind and label."""
    out = []
    for span in EXAMPLES[kind][1 - label]:
        for form in [span, *(rewritten(span, kind) if label else [])]:
            for around in AROUND:
                a = around.index("{}")
                out.append(features(around.format(form), kind, a, a + len(form)))
    if label == 0:
        for span in EXAMPLES[kind][0]:
            for around in AROUND:
                for lead, form in decoys(span + around, kind):
                    ahead = CONTEXT[kind].sub("", around.split("{}")[0]) + lead
                    out.append(features(ahead + form, kind, len(ahead), len(ahead) + len(form)))
    return out


def features(text: str, kind: int, start: int, end: int) -> list[float]:
    """Format and context of a span."""
    span, before, after = text[start:end], text[max(0, start - 40):start], text[end:end + 1]
    groups = re.findall("[0-9]+", span)
    digits = "".join(groups)
    lengths = [len(g) for g in groups] or [0]
    signs = [c for c in span if not c.isalnum()]
    return [
        *(float(kind == k) for k in range(len(KINDS))), float(len(span)), float(len(digits)), float(len(groups)),
        float(max(lengths)), float(min(lengths)), float(len(set(signs))), float(len(signs)),
        float(luhn(digits or "1")),
        float(len(groups) == 4 and all(int(g) <= 255 for g in groups if len(g) < 4) and max(lengths) < 4),
        float("+" in span), float("(" in span), float("@" in span),
        float(before[-1:].isalnum()), float(after.isalnum()), float(before[-1:] in ("=", '"', "'", "#", "/")),
        float(bool(CONTEXT[kind].search(before))), float(bool(OTHER.search(before))), float("dot" in span.lower()),
        float(bool(set(span) & set("([{"))), float(span[-2:].isalpha()), float(lengths[-1]), float(lengths[0]), float(span[:1] == "0"), sum(c.isalpha() for c in span) / max(1, len(span)),
    ]


def scanned(docs: DataFrame) -> DataFrame:
    """``doc_id, base, candidates`` of every row of ``doc_id, text``."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = [("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]
        wide = pa.struct([*span, ("label", pa.int32()), ("features", pa.list_(pa.float64()))])
        for batch in batches:
            bases, candidates = [], []
            for text in batch.column(1).to_pylist():
                text = text or ""
                base = base_spans(text)
                rows = labelled(text, base)
                bases.append([{"kind": k, "start": a, "end": b} for a, k, b in base])
                candidates.append([dict(zip(("kind", "start", "end", "label", "features"), r)) for r in rows])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(bases, pa.list_(pa.struct(span))), pa.array(candidates, pa.list_(wide))],
                names=["doc_id", "base", "candidates"],
            )

    return docs.mapInArrow(scan, SCANNED)


def labelled_rows(candidates: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """Every labelled proposal; ``fold`` 0 is for calibration. Kinds and labels weigh as ``rows`` proposals at most."""
    groups = candidates.where("label IS NOT NULL").groupBy("kind", "label").agg(F.count(F.lit(1)).alias("n"))
    digest = F.md5(F.concat_ws(":", "row", "place"))
    # One row per kind and label.
    return candidates.where("label IS NOT NULL").join(F.broadcast(groups), ["kind", "label"]).select(
        "kind", "label", array_to_vector("features").alias("vector"), F.pmod(F.crc32(digest), F.lit(5)).alias("fold"),
        (F.least(F.col("n"), F.lit(rows)) / F.col("n")).alias("weight")
    )


def calibrated(scored: list[tuple], precision: float = PRECISION) -> float:
    """The least threshold whose rows ``(label, probability)`` reach the precision; above 1 if none does.

    A third element is the weight of a row, 1 otherwise.
    """
    best, right, total = 2.0, 0, 0
    ordered = sorted(scored, key=lambda x: -x[1])
    for n, (label, probability, *weight) in enumerate(ordered, 1):
        total += sum(weight) if weight else 1
        right += label * (sum(weight) if weight else 1)
        if right >= precision * total and (n == len(ordered) or ordered[n][1] < probability):
            best = probability
    return best


def selected(candidates: DataFrame) -> DataFrame | None:
    """``row, kind, start, end, score`` of the proposals above the threshold of their kind."""
    rest = candidates.where("label IS NULL").withColumn("vector", array_to_vector("features"))
    if rest.isEmpty():
        return None
    parts = max(FIT_PARTS, -(-candidates.where("label IS NOT NULL").count() // PART_ROWS))
    rows = written(labelled_rows(candidates).repartition(parts), "labelled")
    known = {(r.kind, r.label, r.fold > 0) for r in rows.select("kind", "label", "fold").distinct().collect()}
    # Kinds without a label of the corpus to fit or to calibrate on; at most a few hundred rows.
    fixed = [
        (k, label, f, i % 5, 1.0) for k in range(len(KINDS)) for label in (0, 1) if not {(k, label, True), (k, label, False)} <= known
        for i, f in enumerate(examples(k, label))
    ]
    if fixed:
        spark = candidates.sparkSession
        more = spark.createDataFrame(fixed, "kind int, label int, features array<double>, fold int, weight double")
        rows = rows.unionByName(more.withColumn("vector", array_to_vector("features")).drop("features"))
    model = GBTClassifier(featuresCol="vector", labelCol="label", weightCol="weight", maxIter=TREES, maxDepth=DEPTH, seed=7).fit(
        rows.where("fold > 0"))
    chance = F.round(F.get(vector_to_array("probability"), F.lit(1)), 6)
    held = model.transform(rows.where("fold = 0")).groupBy("kind", "label", chance.alias("p")).agg(F.sum("weight").alias("weight"))
    held = held.collect()  # probabilities of six digits: bounded, and few, as sums of leaves
    limits = [calibrated([(r.label, r.p, r.weight) for r in held if r.kind == k]) for k in range(len(KINDS))]
    return (
        model.transform(rest).withColumn("score", chance)
        .where(F.col("score") >= F.get(F.array(*map(F.lit, limits)), F.col("kind")))
        .select("row", "kind", "start", "end", "score")
    )


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Personal data in every text: base spans, and proposals that the trees select.

    Returns ``doc_id, n_email, n_ip, n_card, n_phone`` (base spans), ``base_sha256``,
    ``spans``, ``n_added`` and ``added`` (spans with their score), one row per row of
    ``docs``. Spans are ``kind:start:end`` in code points, the end excluded, by
    start, then kind. Of overlapping proposals the better one stays (ties: the
    earlier, then by kind), and none overlaps a base span.

    A null text is empty and has no span. Null ids and repeated rows are judged
    like others. Only proposals that pass the check of their kind are added; dates
    and books' numbers never do. An empty table gives an empty result.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    found = materialised(scanned(docs).select(F.monotonically_increasing_id().alias("row"), "*"), "scanned")
    candidates = found.select("row", F.posexplode("candidates").alias("place", "c")).select("row", "place", "c.*")
    chosen = selected(candidates)
    rows = found.select("row", "doc_id", "base")
    if chosen is None:
        listed = rows.withColumn("added", F.lit(None).cast("array<struct<score: double, kind: int, start: int, end: int>>"))
    else:
        by_row = chosen.groupBy("row").agg(F.collect_list(F.struct("score", "kind", "start", "end")).alias("added"))
        listed = rows.join(by_row, "row", "left")

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text = lambda spans: ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))
        for batch in batches:
            out = []
            for doc, base, more in zip(*(batch.column(i).to_pylist() for i in range(3))):
                base = [(s["start"], s["kind"], s["end"]) for s in base]
                taken, scores = list(base), []
                for s in sorted(more or [], key=lambda s: (-s["score"], s["start"], s["kind"])):
                    if all(s["end"] <= a or b <= s["start"] for a, _, b in taken):
                        taken.append((s["start"], s["kind"], s["end"]))
                        scores.append(f"{KINDS[s['kind']]}:{s['start']}:{s['end']}:{s['score']}")
                counts = [sum(k == i for _, k, _ in base) for i in range(len(KINDS))]
                out.append((doc, *counts, hashlib.sha256(text(base).encode()).hexdigest(), text(taken), len(scores), scores))
            kinds = [pa.int64()] * 5 + [pa.string(), pa.string(), pa.int64(), pa.list_(pa.string())]
            columns = list(zip(*out)) if out else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), k) for c, k in zip(columns, kinds)],
                names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added", "added"],
            )

    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long, added array<string>"
    return listed.select("doc_id", "base", "added").mapInArrow(report, schema)
