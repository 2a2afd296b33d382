"""Small tables and brute-force versions for the tests of this folder."""

import random
import re

LONG_ID = 10**12
WORDS = [a + b for a in "ba de fi go ku lam nor pex".split() for b in "ro sti ven wa xil yor zum".split()]


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) for _ in range(n))


def edited(rng: random.Random, text: str, share: float) -> str:
    return " ".join(rng.choice(WORDS) if rng.random() < share else w for w in text.split(" "))


def corpus(seed: int = 3) -> list[tuple]:
    """``doc_id, text, lang, source, n_chars``: copies, near copies, shared passages, odd rows."""
    rng = random.Random(seed)
    base = [prose(rng, rng.choice([30, 60, 120])) for _ in range(12)]
    passage = prose(rng, 40)
    texts = list(base)
    texts += [base[0]] * 6 + [base[1] + "\n", "  " + base[1].replace(" ", "\t")]
    texts += [edited(rng, base[2], 0.02) for _ in range(10)]
    texts += [prose(rng, 15) + " " + passage + " " + prose(rng, 10) for _ in range(8)]
    texts += ["ha " * 150, "ha " * 90, base[3] + " " + base[3], "", None, None, "   \n", "one two", "ONE two", "é" * 120 + " ñandú", "\u0000x\u0007"]
    texts += [prose(rng, 6000), "z" * 3000]
    sources = ["a", "b", None, "b", "ä"]
    rows = [(i * 7 % 997, t, "xx", sources[i % 5], len(t or "")) for i, t in enumerate(texts)]
    return [*rows, (LONG_ID, base[4], None, "a", 0)]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, rows, schema=SCHEMA, parts=3):
    return spark.createDataFrame(rows, schema).repartition(parts)


def words(text) -> list[bytes]:
    return [w for w in re.split(rb"[\x20\x09-\x0D]+", (text or "").encode()) if w]
