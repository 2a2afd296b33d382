"""Personal data and benchmark leaks against planted cases and brute force."""

import hashlib
import random
import re

import numpy as np
import pytest

from tests.llm.helpers import corpus, prose, table
from textlab.llm import decontaminate, pii

BASE = ["x a.b@c-d.ef y", "a@b@c.d", "a@b.c@d.e", "@b.c", "1.2.3.4 1.2.3.256 1.2.3.4.5", "4111 1111-1111 1111", "4111111111111112",
        "+1 (555) 010-9999", "+1 2", "+49301234567890123456", "é+4930123456x@y.z", "1.2.3.4@h.io +44 20 7946 0958", "", None, "no digits"]


def expected(text):
    text, found = text or "", []
    for k, pattern in enumerate((pii.EMAIL, pii.IP, pii.CARD, pii.PHONE)):
        for m in pattern.finditer(text):
            digits = re.sub("[^0-9]", "", m.group())
            ok = (True, all(int(p) <= 255 for p in m.group().split(".")) if k == 1 else True,
                  12 <= len(digits) <= 19 and sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(digits[::-1])) % 10 == 0,
                  9 <= len(digits) <= 15)[k]
            if ok:
                found.append((m.start(), k, m.end()))
    return ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in sorted(found))


def test_base_spans_equal_the_patterns(spark):
    rng = random.Random(6)
    noise = ["".join(rng.choices("ab1.9@+-() é%5", k=60)) for _ in range(400)]
    texts = [*BASE, *noise]
    rows = [(None if i == 3 else i % 300, t) for i, t in enumerate(texts)]
    docs = table(spark, rows, "doc_id long, text string").selectExpr("doc_id", "text", "'r' AS row", "1 AS base")
    got = pii.find_personal_data(docs).collect()
    want = sorted((str(d), hashlib.sha256(expected(t).encode()).hexdigest()) for d, t in rows)
    assert sorted((str(r.doc_id), r.base_sha256) for r in got) == want
    for r in got:
        assert len(r.spans.split(",") if r.spans else []) == r.n_email + r.n_ip + r.n_card + r.n_phone + r.n_added


def test_trees_add_what_looks_like_the_base(spark):
    rng = random.Random(8)
    rows = [(i, f"{prose(rng, 8)} call +1 555 {rng.randint(100, 999)} {rng.randint(1000, 9999)} {prose(rng, 5)}") for i in range(200)]
    rows += [(1000 + i, f"{prose(rng, 8)} x{rng.randint(10**8, 10**9)}y {prose(rng, 5)}") for i in range(200)]
    rows += [(5000, "please call 1 555 321 4321 today")]
    got = {r.doc_id: r for r in pii.find_personal_data(table(spark, rows, "doc_id long, text string")).collect()}
    assert got[5000].spans == "phone:12:26" and got[5000].n_added == 1 and got[5000].n_phone == 0
    assert all(r.n_phone == (d < 1000) and r.n_added == 0 for d, r in got.items() if d < 5000)


def with_check(number: str) -> str:
    return next(n for n in (number + str(d) for d in range(10)) if pii.luhn(n))


def test_many_other_forms_are_found_and_no_negatives(spark):
    """As many spelled-out and unsigned cases as exact ones, and proposals that fail their check."""
    rng = random.Random(12)
    name = lambda: "".join(rng.choices("abcdefgh", k=6))
    number = lambda k: "".join(rng.choices("123456789", k=k))
    fours = lambda n, sep: sep.join(n[i:i + 4] for i in range(0, len(n), 4))
    rows, want = [], {}

    def put(kind, span, found):
        start, doc = prose(rng, 6) + " ", len(rows)
        rows.append((doc, start + span + " " + prose(rng, 5)))
        want[doc] = f"{pii.KINDS[kind]}:{len(start)}:{len(start) + len(span)}" if found else ""

    for _ in range(120):
        put(0, f"{name()}@{name()}.com", True)
        put(2, fours(with_check(number(15)), " "), True)
        put(3, f"+1 555 {number(3)} {number(4)}", True)
        put(0, f"{name()} (at) {name()} (dot) com", True)
        put(2, fours(with_check(number(15)), "."), True)
        put(3, f"555 {number(3)} {number(4)}", True)
        put(0, f"{name()} (at) {name()}.9", False)
        card = with_check(number(15))
        put(2, fours(card[:-1] + str((int(card[-1]) + 1) % 10), "."), False)
        put(3, f"x{number(10)}y", False)
    got = {r.doc_id: r.spans for r in pii.find_personal_data(table(spark, rows, "doc_id long, text string")).collect()}
    missed = [d for d, w in want.items() if w and got[d] != w]
    wrong = [d for d, w in want.items() if not w and got[d]]
    assert not wrong and len(missed) <= 0.02 * len(want), [(rows[d][1], got[d], want[d]) for d in missed[:5] + wrong[:5]]


def test_numbers_that_are_no_data_are_left_alone(spark):
    """Build and order numbers, dates, ISBNs, amounts and sections next to phones in other forms."""
    rng = random.Random(21)
    number = lambda k: str(rng.randint(1, 9)) + "".join(rng.choices("0123456789", k=k - 1))
    rows, want, negatives = [], {}, set()

    def put(text, span, found):
        start, doc = prose(rng, 6) + " " + text, len(rows)
        rows.append((doc, f"{start}{span} {prose(rng, 5)}"))
        if found:
            want[doc] = f"phone:{len(start)}:{len(start) + len(span)}"
        else:
            negatives.add(doc)

    for i in range(200):
        put("call ", f"+1 555 {number(3)} {number(4)}", True)
    for i in range(60):
        put("call ", f"1 555 {number(3)} {number(4)}", True)
        put("", f"555-{number(3)}-{number(4)}", True)
        put("build ", number(9), False)
        put("", number(9), False)
        put("shipped as order ", number(10), False)
        put("on ", f"20{rng.randint(10, 24)}-0{rng.randint(1, 9)}-1{rng.randint(0, 9)}", False)
        while True:  # one that is not a card's number as well
            body = "978" + number(9)
            check = next(d for d in "0123456789" if pii.isbn(body + d))
            if not pii.luhn(body + check):
                break
        put("ISBN ", f"{body[:3]}-{body[3]}-{body[4:6]}-{body[6:]}-{check}", False)
        put("total $", f"{number(2)} {number(3)} {number(3)}", False)
        put("from ", f"19{rng.randint(10, 99)}-20{rng.randint(10, 24)}", False)
    got = {r.doc_id: r.spans for r in pii.find_personal_data(table(spark, rows, "doc_id long, text string")).collect()}
    wrong = [rows[d][1] for d in negatives if got[d]]
    missed = [rows[d][1] for d, w in want.items() if got[d] != w]
    assert len(wrong) <= 0.02 * len(negatives) and len(missed) <= 0.1 * len(want), (len(wrong), wrong[:4], len(missed), missed[:4])


def test_decoys_repeat_and_pass_as_numbers():
    assert pii.decoys("+1 555 0100", 3) == pii.decoys("+1 555 0100", 3)
    assert all(pii.luhn(re.sub("[^0-9]", "", form)) for _, form in pii.decoys("4111 1111 1111 1111", 2))
    assert pii.isbn("9783161484100") and not pii.isbn("9783161484101")
    for dated in ("2024-01-15", "15.01.2024", "2024-01-15 10:30:59", "1998-2004"):
        assert pii.DATE.fullmatch(dated) and not pii.passes(dated, 3, 0, len(dated))
    assert not pii.DATE.fullmatch("555-321-4321")


def test_kinds_without_exact_spans_get_additions(spark):
    rows = [(i, f"notes of day {i}: write to ann{chr(97 + i % 26)} (at) mail (dot) org for more") for i in range(40)]
    got = pii.find_personal_data(table(spark, rows, "doc_id long, text string")).collect()
    assert all(r.n_email == 0 and r.n_added == 1 and r.spans.startswith("email:") for r in got)


def test_checks_of_proposals():
    judge = lambda kind, span, text="{}": pii.passes(text.format(span), kind, text.index("{}"), text.index("{}") + len(span))
    assert judge(0, "x (at) y (dot) com") and judge(0, "x at y dot com") and not judge(0, "meet (at) noon.9")
    assert judge(1, "1-2-3-255") and not judge(1, "1-2-3-256")
    assert judge(2, "4111.1111.1111.1111") and not judge(2, "4111.1111.1111.1112")
    assert judge(3, "555 321 4321") and judge(3, "5553214321", "tel{}") and judge(3, "5553214321", "{}x12")
    assert not judge(3, "5553214321", "ab{}") and not judge(3, "5553214321", "{}f")


def test_very_long_numbers_are_no_octets():
    text = "9" * 5000 + ".1.2.3 and " + "0" * 5000 + "1.2.3.4"
    assert [k for _, k, _ in pii.base_spans(text)] == [1] and not pii.octet("256") and pii.octet("00255")
    assert not pii.passes("9" * 5000 + "-1-2-3", 1, 0, 5006)


def test_no_documents(spark):
    assert pii.find_personal_data(table(spark, [], "doc_id long, text string")).count() == 0


def test_calibrated_thresholds():
    assert pii.calibrated([]) > 1 and pii.calibrated([(0, 0.9)]) > 1
    assert pii.calibrated([(1, 0.9), (1, 0.8), (0, 0.7)]) == 0.8
    assert pii.calibrated([(1, 0.9), (0, 0.9)]) > 1


@pytest.fixture(scope="module")
def bench():
    rng = random.Random(10)
    # Items need words that tell them apart.
    own = lambda: " ".join("".join(rng.choices("bcdfgklmnprstvz", k=4)) + rng.choice("aeiou") for _ in range(rng.randint(14, 60)))
    return [(i, own()) for i in range(25)]


def test_words_and_their_counts(spark):
    texts = ["", "red oak, red-oak", "éa aé", "  ", "ab ba " * 3, "x" * 70_000 + " x", "oak"]
    words = decontaminate.Words(decontaminate.plain(texts))
    split = [re.findall(r"[^\x00-/:-@\[-`{-\x7f]+", t) for t in texts]
    assert np.diff(words.first).tolist() == [len(w) for w in split]
    of = dict(zip(sum(split, []), words.hash.tolist()))
    assert [of[w] for w in sum(split, [])] == words.hash.tolist() and len(set(of.values())) == len(of)
    assert decontaminate.Words([]).hash.tolist() == [] and decontaminate.Words([b""]).first.tolist() == [0, 0]
    vocabulary = np.unique(words.hash)
    docs = table(spark, [(i, t) for i, t in enumerate([*texts, None])], "doc long, text string")
    counts, n = decontaminate.document_frequency(docs, vocabulary)
    assert n == len(texts) + 1
    assert dict(zip(vocabulary.tolist(), counts.tolist())) == {h: sum(w in s for s in split) for w, h in of.items()}


def test_planted_leaks(spark, bench):
    rng = random.Random(11)
    docs = [(i, prose(rng, 150)) for i in range(150)]
    change = lambda text, share: " ".join(rng.choice(["foo", w + " bar", ""]) if rng.random() < share else w for w in text.split())
    for i, (item, text) in enumerate(bench):
        docs.append((1000 + item, prose(rng, rng.randint(0, 90)) + " " + text.upper() + ". " + prose(rng, 20)))
        docs.append((2000 + item, prose(rng, rng.randint(0, 90)) + " " + change(text, 0.15) + " " + prose(rng, 20)))
        docs.append((3000 + item, prose(rng, 60) + " " + " ".join(text.split()[:4]) + " " + prose(rng, 20)))
    docs += [(9000, None), (9001, ""), (9002, "..."), (None, bench[3][1]), (9003, bench[1][1] + " " + bench[2][1])]
    items = [*bench, (99, None), (98, " "), (None, "some words of an item without a name")]
    frame = table(spark, docs, "doc_id long, text string").selectExpr("doc_id", "text", "'d' AS doc", "7 AS item_id")
    bench_frame = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.decontaminate(frame, bench_frame).collect()}
    assert len(got) == len(docs)
    for item, _ in bench:
        assert got[1000 + item].item_id == item and got[1000 + item].overlap == pytest.approx(1)
        assert not got[3000 + item].contaminated
    assert sum(got[2000 + i].item_id == i for i, _ in bench) >= 0.9 * len(bench)
    assert not any(r.contaminated for d, r in got.items() if d is not None and (d < 1000 or 9000 <= d < 9003))
    assert got[None].item_id == 3 and (got[9003].item_id, got[9003].n_items) == (1, 2)


def test_no_documents_or_items(spark, bench):
    docs = table(spark, [(1, "a b c")], "doc_id long, text string")
    items = spark.createDataFrame(bench, "item_id long, text string")
    assert decontaminate.decontaminate(docs.limit(0), items).count() == 0
    assert [r.contaminated for r in decontaminate.decontaminate(docs, items.limit(0)).collect()] == [False]
    assert [r.contaminated for r in decontaminate.decontaminate(docs, items).collect()] == [False]


def test_every_labelled_proposal_is_learned_from(spark):
    rows = [(i, 0, 1, int(i % 4 == 0), [float(i)]) for i in range(40)] + [(40, 0, 1, None, [0.0])]
    table = spark.createDataFrame(rows, "row long, place int, kind int, label int, features array<double>")
    got = pii.labelled_rows(table, 15).collect()
    assert len(got) == 40
    for label, n in ((0, 30), (1, 10)):
        assert abs(sum(r.weight for r in got if r.label == label) - min(n, 15)) < 1e-9


def test_weighted_thresholds():
    assert pii.calibrated([(1, 0.9, 1.0), (1, 0.8, 2.5), (0, 0.7, 0.5)]) == 0.8
