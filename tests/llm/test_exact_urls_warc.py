"""Exact dedup, URL filters and WARC archives against plain Python."""

import base64
import hashlib
import re

import pytest

from tests.llm.helpers import SCHEMA, corpus, table
from textlab.llm import exact, urls, warc


def test_exact_dedup_equals_brute_force(spark):
    rows = [*corpus(), (None, "same", None, None, 0), (5000, "sa me", None, None, 0), (5001, "same ", None, None, 0)]
    got = exact.exact_dedup(table(spark, rows).withColumnRenamed("n_chars", "recipe")).collect()
    groups = {}
    for doc, text, *_ in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", text or ""), []).append((-len(text or ""), doc is None, doc))
    want = set()
    for norm, members in groups.items():
        keep = min(members)[2]
        digest = hashlib.sha256(norm.encode()).hexdigest()
        want |= {(d, keep, len(members), d == keep, digest) for _, _, d in members}
    assert len(got) == len(rows) and {tuple(r) for r in got} == want


def test_chunks_make_up_the_text_and_ambiguous_names_do_not_merge(spark):
    docs = table(spark, corpus()).select("doc_id", "text").cache()
    cut = docs.select(exact.normalised("text").alias("n"), exact.chunks(exact.normalised("text")).alias("c")).collect()
    assert all("".join(r.c) == r.n for r in cut)
    assert exact.ambiguous_ids(docs).count() == 0
    name = hashlib.sha256("onetwo".encode()).digest()
    named = {r.doc_id: r.recipe for r in exact.recipes(docs, [name]).collect()}
    assert [b"onetwo"] in [list(map(bytes, r)) for r in named.values()]


def test_exact_dedup_of_the_least_and_greatest_ids(spark):
    rows = [(d, "same", "", "", 0) for d in (-2**63, 2**63 - 1, -1, 0, None)]
    assert {(r.doc_id, r.keep_id) for r in exact.exact_dedup(table(spark, rows)).collect()} == {(r[0], -2**63) for r in rows}


def test_exact_dedup_of_an_empty_table(spark):
    assert exact.exact_dedup(table(spark, [])).count() == 0


RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"),
         ("org", "/fr/", "block"), (None, "/", "block"), ("", "/", "block"), ("com", None, "block")]
URLS = ["http://A.Example.NET/en/x", "https://example.net/e", "ftp://x.org/fr/1?q#f", "http://x.com", "http://org.fr/fr/",
        "x.net/", None, "", "://net/", "http://b.net?x/", "http://b.net/?x", "http://notexample.com/de/", "http://é.net/ü#"]


def test_a_host_of_very_many_labels(spark):
    pages = spark.createDataFrame([(1, "http://" + "a." * 16_000 + "example.com/de/x"), (2, "http://" + "a." * 16_000)], "page_id long, url string")
    listed = spark.createDataFrame(RULES, "host string, path string, verdict string")
    got = {r.page_id: (r.rule, r.verdict) for r in urls.filter_urls(pages, listed).collect()}
    assert got == {1: ("example.com/de/", "block"), 2: (None, "allow")}
    assert urls.filter_urls(pages.limit(0), listed).count() == 0


@pytest.mark.parametrize("rules", [RULES, []])
def test_urls_equal_brute_force(spark, rules):
    pages = spark.createDataFrame([(i % 11, u, "h") for i, u in enumerate(URLS)], "page_id long, url string, host string")
    listed = spark.createDataFrame(rules, "host string, path string, verdict string")
    got = sorted((tuple(r) for r in urls.filter_urls(pages, listed).collect()), key=str)
    want = []
    for i, url in enumerate(URLS):
        host = path = ""
        if url and "://" in url:
            rest = url.split("://", 1)[1]
            host = re.match(r"[^/?#]*", rest)[0]
            path = re.match(r"[^?#]*", rest[len(host):])[0]
            host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
        fits = [(len(h) + len(p or ""), len(h), h + (p or ""), v == "block") for h, p, v in rules
                if h and (host == h or host.endswith("." + h)) and path.startswith(p or "")]
        best = max(fits, default=None)
        want.append((i % 11, host, path, best and best[2], "allow" if not best or not best[3] else "block"))
    assert got == sorted(want, key=str)


PAGES = [(1, "http://a/", "<p>x</p>"), (2, "http://b/\r\nX: y", "<p>x</p>"), (3, None, None), (4, "http://c/", ""),
         (None, "http://d/", "<p>x</p>"), (2, "http://b/", "<p>x</p>"), (7, "http://e/ü", "a\r\n\r\nWARC/1.1\r\n\r\né\u0000"),
         (8, "http://f/", "y" * 700_000), (9, "http://g/", "y" * 700_000)]


def test_archives_come_back_whole(spark, tmp_path):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").repartition(2)
    out = warc.archive_pages(pages, str(tmp_path / "w")).collect()
    want = []
    for page, _, html in PAGES:
        body = (html or "").encode()
        same = [p for p, _, h in PAGES if (h or "") == (html or "") and p is not None]
        want.append((page, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), min(same)))
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.refers_to) for r in out), key=str)
    assert [g[:3] for g in got] == [w[:3] for w in sorted(want, key=str)]
    for r in out:
        first = next(w[3] for w in want if w[2] == r.payload_digest)
        assert (r.record_type, r.refers_to) in {("response", None), ("revisit", first)}
        assert r.intact is (None if r.record_type == "revisit" else True)
    assert sum(r.record_type == "response" for r in out) == len({w[2] for w in want})
    full = warc.read_archives(spark, str(tmp_path / "w/deduplicated"), payloads=True).collect()
    assert {r.payload for r in full if r.record_type == "response"} == {h or "" for _, _, h in PAGES}
    assert {r.payload for r in full if r.record_type == "revisit"} == {""}
    again = warc.archive_pages(pages, str(tmp_path / "v"), least_bytes=10).collect()
    assert sum(r.record_type == "revisit" for r in again) == 1


def test_archives_of_no_pages_and_of_many_members(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.archive_pages(pages, str(tmp_path / "w")).count() == 0
    import gzip
    record = b"WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    parsed = list(warc._parsed(gzip.compress(record) + gzip.compress(record * 2)))
    assert [b for _, b in parsed] == [b"abc"] * 3
