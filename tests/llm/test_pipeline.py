"""The pipeline against plain Python, and the registration of this folder's queries."""

import random
import re

import pytest

import corpus_pipeline
from __spark_entry__ import oracle_sql, queries
from tests.llm.helpers import SCHEMA, edited, prose, table
from tests.llm.test_language_mixing import VOICES
from tests.llm.test_near_duplicates import shingles


def test_every_operator_has_a_query():
    numbers = [int(m[1]) for m in (re.match(r"op(\d+)_", n) for n in queries()) if m]
    assert sorted(numbers) == list(range(1, 14)) and "pipeline" in queries()
    assert {"op6_warc", "op7_url_filter", "op9_exact_dedup", "op11_ranked_search", "op12_hard_negatives"} <= oracle_sql().keys()
    assert len(corpus_pipeline.STAGES) == 5


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(21)
    say = lambda n: " ".join(rng.choices(VOICES["aa"], k=3)) + " " + prose(rng, n)
    clean = [say(rng.randint(30, 90)) for _ in range(40)]
    items = [" ".join("".join(rng.choices("bcdfgklm", k=5)) + "a" for _ in range(25)) for _ in range(4)]
    texts = list(clean)
    texts += [clean[0]] * 5 + [clean[1].replace(" ", "\n") + "  "]
    texts += [edited(rng, clean[2], 0.02) for _ in range(6)]
    texts += [say(20) + " " + item + " " + say(20) for item in items]
    texts += [None, "", "1 2 3", "..."]
    rows = [(i, t, "aa", ["s1", "s2", None][i % 3], len(t or "")) for i, t in enumerate(texts)]
    path = tmp_path_factory.mktemp("corpus")
    table(spark, rows, SCHEMA).write.parquet(str(path / "documents.parquet"))
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(str(path / "benchmark.parquet"))
    return str(path), rows, len(clean), items


def test_stages_equal_brute_force(spark, folder):
    path, rows, n_clean, items = folder
    docs, kept = spark.read.parquet(f"{path}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, path).cache()
        assert docs.columns == [c.split()[0] for c in SCHEMA.split(", ")]
        kept.append({r.doc_id for r in docs.collect()})
    text = {r[0]: r[1] for r in rows}
    letters = {d for d, t in text.items() if re.search("[a-z]", t or "")}
    assert kept[0] == letters
    groups: dict = {}
    for d in letters:
        groups.setdefault(re.sub(r"\s", "", text[d]), []).append((-len(text[d]), d))
    distinct = {min(g)[1] for g in groups.values()}
    assert kept[1] == distinct
    sets = {d: shingles(text[d]) for d in distinct}
    links = [(a, b) for a in distinct for b in distinct if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    linked: dict = {d: d for d in distinct}
    for _ in links:
        for a, b in links:
            linked[a] = linked[b] = min(linked[a], linked[b])
    near = {d for d in distinct if linked[d] == d}
    assert kept[2] == near
    assert kept[3] == {d for d in near if not any(i in text[d] for i in items)}
    last = corpus_pipeline.STAGES[-1][1](spark, docs, path).collect()
    sizes = {d: len(text[d].split()) for d in kept[3]}
    assert {r.doc_id for r in last} <= kept[3] and all(r.taken == r.copies * sizes[r.doc_id] > 0 for r in last)
    assert abs(sum(r.taken for r in last) - sum(sizes.values())) <= 3 * max(sizes.values()) / 2


def test_run_returns_the_mix(spark, folder):
    path, rows, *_ = folder
    out = corpus_pipeline.run(spark, path)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "copies", "taken"]
    text = {r[0]: r[1] for r in rows}
    assert all(r.text == text[r.doc_id] for r in out.collect())


def test_columns_of_any_name_and_kind(spark, folder):
    path, rows, *_ = folder
    names = ["key", "row", "Copies", "taken", "pos", "first", "mark", "gone", "id", "size", "_row"]
    docs = table(spark, rows, SCHEMA)
    for i, name in enumerate(names):
        docs = docs.withColumn(name, docs.doc_id + i)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs_out = corpus_pipeline.written(stage(spark, docs, path), "stage")
        assert docs_out.columns == docs.columns and docs_out.where("key <> doc_id OR `_row` <> doc_id + 10").isEmpty()
        docs = docs_out
    last = corpus_pipeline.STAGES[-1][1](spark, docs, path)
    assert last.columns == [c for c in docs.columns if c not in ("Copies", "taken")] + ["copies", "taken"]
    assert last.where("pos <> doc_id + 4 OR taken < copies").isEmpty()


def test_null_and_repeated_ids_are_judged_row_by_row(spark, tmp_path):
    rng = random.Random(22)
    say = lambda n: " ".join(rng.choices(VOICES["aa"], k=3)) + " " + prose(rng, n)
    item = " ".join("".join(rng.choices("bcdfgklm", k=5)) + "a" for _ in range(25))
    named, nameless, twice = [say(40) for _ in range(12)], [say(30 + i) for i in range(6)], [say(35) for _ in range(3)]
    near = nameless[1] + " fi"
    leak = say(20) + " " + item + " " + say(20)
    rows = list(enumerate(named)) + [(None, t) for t in [*nameless, "...", named[0], near, leak, nameless[2]]]
    rows += [(50, t) for t in [*twice, "1 2", named[1]]] + [(60, nameless[3]), (60, leak + " fi")]
    rows = [(d, t, "aa", "s", len(t)) for d, t in rows]
    table(spark, rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    keys = [r[corpus_pipeline.KEY] for r in corpus_pipeline.keyed(docs).collect()]
    assert len(set(keys)) == len(rows) and None not in keys
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = corpus_pipeline.written(stage(spark, kept, str(tmp_path)), "stage")
    texts = sorted(r.text for r in kept.collect())
    want = sorted([*named, *nameless, *twice])
    assert texts in (want, sorted([*(t for t in want if t != nameless[1]), near]))
    assert (50, named[1]) not in {(r.doc_id, r.text) for r in kept.collect()}
    last = corpus_pipeline.STAGES[-1][1](spark, kept, str(tmp_path)).collect()
    assert 0 < len(last) <= len(texts) and all(r.taken == r.copies * len(r.text.split()) for r in last)
