from pyspark.sql import functions as F

from textlab.functions import hashing as H
from textlab.functions import names as N
from textlab.operators import report as R


def test_file_names(spark):
    rows = [("word_embeddings/word_embeddings_200_average.csv",), ("transformer/transformer_gtr_t5_base.csv",)]
    path = F.col("p")
    config = N.embedding_config(path)
    got = spark.createDataFrame(rows, "p string").select(
        N.feature_name(path).alias("name"), config.alias("c"),
        N.bundle_name(config, F.lit("Random Forest")).alias("bundle")).collect()
    assert [r["name"] for r in got] == ["200-D (average)", "GTR T5 base"]
    assert [tuple(r["c"]) for r in got] == [
        ("glove", "glove-twitter-200", "average"),
        ("sentence_transformer", "sentence-transformers/gtr-t5-base", None)]
    assert [r["bundle"] for r in got] == [
        "glove_twitter_200_average_random_forest", "gtr_t5_base_random_forest"]


def test_formats(spark):
    row = spark.range(1).select(
        N.parse_percent(F.lit("93.24%")), N.format_percent(F.lit(93.236)),
        N.parse_layer_sizes(F.lit("(256, 128, 64)")), N.null_to_blank(F.lit(None)),
        N.blank_to_null(F.lit("")), N.format_prediction(F.lit(1), {1: "A", 0: "B"}),
        N.document_number(F.lit("post_12.txt"))).first()
    assert list(row) == [93.24, "93.24%", [256, 128, 64], "", None, "A (1)", 12]


def test_uniform_is_in_range_and_spread(spark):
    u = H.uniform(1, F.col("id"))
    row = spark.range(2000).agg(F.min(u), F.max(u), F.avg(u)).first()
    assert 0 <= row[0] < row[1] < 1 and abs(row[2] - 0.5) < 0.03


def test_pivot_refuses_duplicates(spark):
    rows = [("a", "Random Forest", 1.0), ("a", "Random Forest", 2.0)]
    df = spark.createDataFrame(rows, "features string, model string, f1 double")
    try:
        R.pivot_scores(df, "features", R.MODELS).collect()
    except Exception as error:  # noqa: BLE001
        assert "duplicate entries" in str(error)
    else:
        raise AssertionError("duplicates passed")


def test_order_and_best_row(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 3.0), ("c", 3.0)], "features string, f1 double")
    assert R.best_row(df, "f1", ["features"]).first()["features"] == "b"
    got = [tuple(r) for r in R.custom_order(df, "features", ["c", "x", "a"]).collect()]
    assert got == [("c", 0, 3.0), ("x", 1, None), ("a", 2, 1.0)]
