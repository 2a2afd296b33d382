"""Readers and writers."""

from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from textlab.operators import report as R
from textlab.session import scratch_path, written
from textlab.sources import published, readers, writers


def test_text_folder(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name, text in {"post_1.txt": "one\ntwo\n", "post_2.txt": "é", "notes.md": "x", "sub/post_3.txt": "y"}.items():
        (tmp_path / name).write_text(text, encoding="utf-8")
    got = readers.read_corpus(spark, str(tmp_path), label=1, variant="masked").collect()
    assert {tuple(r) for r in got} == {("post_1", "one\ntwo\n", 1, "masked"), ("post_2", "é", 1, "masked")}


def test_named_texts(spark, tmp_path):
    rows = [("post_1", "one\ntwo\n"), ("post_2", ""), ("post_3", "\r\n é "), ("a b=c%", "x")]
    path = str(tmp_path / "texts")
    writers.write_named_texts(spark.createDataFrame(rows, "name string, text string"), path)
    assert sorted(map(tuple, readers.read_named_texts(spark, path).collect())) == sorted(rows)


def test_named_texts_do_not_cost_a_folder_each(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(writers, "FOLDER_FILES", 100)
    path = tmp_path / "texts"
    rows = [(f"post_{i}", f"text {i}\n" * (i % 3)) for i in range(450)] + [(None, "no name"), ("post_x", None)]
    writers.write_named_texts(spark.createDataFrame(rows, "name string, text string").coalesce(1), str(path))
    assert len([f for f in path.iterdir() if f.is_dir() and f.name != "folders"]) == 5
    assert len(list(path.glob("*/*.txt"))) == 452
    (path / "texts-of-a-failed-attempt").mkdir()
    (path / "texts-of-a-failed-attempt" / "post_1.txt").write_text("part")
    back = readers.read_named_texts(spark, str(path))
    assert back.rdd.getNumPartitions() == 5
    assert sorted(map(str, map(tuple, back.collect()))) == sorted(str((n, t or "")) for n, t in rows)


def test_term_list(spark, tmp_path):
    (tmp_path / "terms.txt").write_text(" Red Oak\nred oak\n\n   \nPine", encoding="utf-8")
    path = str(tmp_path / "terms.txt")
    assert {r["term"] for r in readers.read_terms(spark, path).collect()} == {"red oak", "pine"}
    kept = {r["term"] for r in readers.read_terms(spark, path, lower=False).collect()}
    assert kept == {"Red Oak", "red oak", "Pine"}


def test_feature_csv_keeps_the_first_row(spark, tmp_path):
    features = spark.createDataFrame([([0.1, -2.0], 1), ([3.5, 1e-9], 0)], "vector array<double>, label int")
    writers.write_feature_csv(features, str(tmp_path / "a"), 2)
    assert sorted(map(tuple, readers.read_features(spark, str(tmp_path / "a"), 2).collect())) == [
        ([0.1, -2.0], 1), ([3.5, 1e-9], 0)]
    (tmp_path / "b.csv").write_text("1.0,2.0,1\n3.0,4.0,0\n")
    bare = readers.read_features(spark, str(tmp_path / "b.csv"), 2, header=False)
    assert bare.count() == 2


def test_results_with_blanks(spark, tmp_path):
    rows = R.union_results(
        spark.createDataFrame([("f1", "Random Forest", 90.5, 100)], "filename string, model string, f1 double, n_estimators int"),
        spark.createDataFrame([("f1", "Neural Network", "(256, 128)")], "filename string, model string, hidden_layer_sizes string"))
    path = str(tmp_path / "results")
    writers.write_results(rows, path)
    got = {r["model"]: r for r in readers.read_results(spark, path).collect()}
    assert list(got["Random Forest"].asDict()) == list(R.RESULT_COLUMNS)
    assert got["Random Forest"]["n_estimators"] == 100 and got["Random Forest"]["c"] is None
    assert got["Neural Network"]["hidden_layer_sizes"] == "(256, 128)" and got["Neural Network"]["f1"] is None


def test_resume(spark, tmp_path):
    path = str(tmp_path / "results")
    schema = "filename string, f1 double"
    writers.append_new(spark.createDataFrame([("a", 1.0)], schema), path)  # nothing is stored yet
    writers.append_new(spark.createDataFrame([("a", 9.0), ("b", 2.0)], schema), path)
    writers.append_new(spark.createDataFrame([("b", 7.0)], schema), path)
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == [("a", 1.0), ("b", 2.0)]


ROWS = "filename string, f1 double"


def test_published_appends(spark, tmp_path):
    path = str(tmp_path / "table")
    frame = lambda *rows: spark.createDataFrame(rows, ROWS)
    stored = lambda: sorted(map(str, published.read_published(spark, path).collect()))
    assert published.read_published(spark, path) is None
    assert published.append_published(frame(), path, run="none") == 0 and stored() == []
    assert published.append_published(frame(("a", 1.0), ("a", 2.0), (None, 0.0)), path, run="first") == 1
    assert published.append_published(frame(("c", 5.0)), path, run="first") == 1  # the same run again
    assert published.append_published(frame(("a", 9.0), (None, 9.0), ("b", 3.0)), path) == 2
    assert stored() == sorted(map(str, frame(("a", 1.0), ("a", 2.0), (None, 0.0), ("b", 3.0)).collect()))


def test_a_failed_append_leaves_nothing(spark, tmp_path):
    path, mark = str(tmp_path / "table"), tmp_path / "failed"
    published.append_published(spark.createDataFrame([("a", 1.0)], ROWS), path)

    def rows(batches):
        for batch in batches:
            if not mark.exists():
                mark.write_text("once")
                raise ValueError("lost")
            yield batch

    more = spark.createDataFrame([("b", 2.0)], ROWS).mapInArrow(rows, ROWS)
    with pytest.raises(Exception, match="lost"):
        published.append_published(more, path, run="b")
    assert [r.filename for r in published.read_published(spark, path).collect()] == ["a"]
    published.append_published(more, path, run="b")
    assert sorted(r.filename for r in published.read_published(spark, path).collect()) == ["a", "b"]


def test_many_writers_at_once(spark, tmp_path):
    path = str(tmp_path / "table")
    frames = [spark.createDataFrame([("all", float(i)), (f"own{i}", float(i))], ROWS) for i in range(4)]
    with ThreadPoolExecutor(4) as pool:
        numbers = list(pool.map(lambda f: published.append_published(f, path), frames))
    assert sorted(numbers) == [0, 1, 2, 3]
    names = sorted(r.filename for r in published.read_published(spark, path).collect())
    assert names == ["all", "own0", "own1", "own2", "own3"]


def test_only_one_writer_gets_a_number(spark, tmp_path):
    path = str(tmp_path / "table")
    got = [published._publish(spark, path, 0, {"run": str(i), "folder": "x", "schema": ""}) for i in range(3)]
    assert got == [True, False, False] and [e["run"] for e in published.log_entries(spark, path)] == ["0"]


def test_error_report_file(spark, tmp_path):
    texts = [f"post_{i}:\nx{'y' * i}\n\n---\n" for i in range(30)]
    starts = [sum(map(len, texts[:i])) for i in range(30)]
    report = spark.createDataFrame(
        [(1, "masked", i, starts[i], texts[i]) for i in range(30)],
        "label int, variant string, seq bigint, start bigint, section string").repartition(5)
    writers.write_error_report(report, str(tmp_path / "report"))
    files = sorted((tmp_path / "report" / "label=1" / "variant=masked").glob("*.txt"))
    whole = "".join(f.read_text() for f in files)
    assert whole == "".join(texts)
    assert all(whole[a:].startswith(f"post_{i}:") for i, a in enumerate(starts))


def test_written_tables_go_to_the_configured_folder(spark):
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    assert root is None or scratch_path(spark, "x").startswith(root)
    df = written(spark.range(5).withColumn("u", F.lit("x")))
    assert df.count() == 5 and len(df.inputFiles()) > 0


def test_documents_in_so_many_partitions(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(100).write.parquet(path)
    assert readers.read_documents(spark, path, 7).rdd.getNumPartitions() == 7
    assert readers.read_documents(spark, path).count() == 100
