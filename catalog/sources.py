"""Sources and sinks: every sink is read back."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import functions as F

from catalog import fixtures as X
from catalog.registry import long_form, query
from textlab.functions import names as N
from textlab.functions import text as T
from textlab.operators import models as M
from textlab.operators import report as R
from textlab.operators.sampling import holdout_splits
from textlab.plans.features import with_variants
from textlab.plans.predict import train_bundle
from textlab.session import scratch_path
from textlab.sources import published, readers, writers
from textlab.sources.bundles import load_bundle, save_bundle


@query("scan_corpus", """
    SELECT doc_id, label, 'original' AS variant, length(text) AS n_chars, md5(text) AS digest
    FROM corpus""", ("corpus",))
def scan_corpus(spark, sf):
    return X.corpus(spark, sf).select(
        "doc_id", "label", F.lit("original").alias("variant"),
        F.length("text").cast("bigint").alias("n_chars"), F.md5("text").alias("digest"))


@query("scan_text_files", """
    SELECT 'post_' || doc_id AS name, length(text) AS n_chars, md5(text) AS digest FROM corpus""", ("corpus",))
def scan_text_files(spark, sf):
    """The labelled documents as text files, one for each, and read again."""
    path = scratch_path(spark, "texts")
    named = X.corpus(spark, sf).select(F.concat(F.lit("post_"), F.col("doc_id").cast("string")).alias("name"), "text")
    writers.write_named_texts(named, path)
    return readers.read_named_texts(spark, path).select(
        "name", F.length("text").cast("bigint").alias("n_chars"), F.md5("text").alias("digest"))


@query("scan_terms", """
    SELECT DISTINCT lower(trim(title)) AS term FROM posts WHERE trim(title) <> ''""", ("posts",))
def scan_terms(spark, sf):
    path = scratch_path(spark, "terms")
    lines = X.posts(spark, sf).select(F.concat(F.lit(" "), "title", F.lit("  ")))
    lines.write.text(path)
    return readers.read_terms(spark, path)


@query("scan_feature_table", """
    SELECT label, i - 1 AS dim, round(sum(vector[i]), 6) + 0.0 AS total, count(*) AS n
    FROM features, dims GROUP BY label, i""", ("features", "dims"))
def scan_feature_table(spark, sf):
    path = scratch_path(spark, "features")
    writers.write_feature_csv(X.features(spark, sf), path, X.DIMS)
    table = readers.read_features(spark, path, X.DIMS)
    cells = table.select("label", F.posexplode("vector").alias("dim", "v"))
    return cells.groupBy("label", F.col("dim").cast("bigint").alias("dim")).agg(
        F.round(F.sum("v"), 6).alias("total"), F.count(F.lit(1)).alias("n"))


@query("write_feature_table", """
    SELECT CASE WHEN row_id % 2 = 0 THEN 'word_embeddings_64_sum.csv'
                ELSE 'word_embeddings_64_average.csv' END AS feature_set,
           CASE WHEN row_id % 3 = 0 THEN 'masked' ELSE 'original' END AS variant,
           row_id, label, i - 1 AS dim, round(vector[i], 6) + 0.0 AS value
    FROM features, dims""", ("features", "dims"))
def write_feature_table(spark, sf):
    row = F.col("row_id")
    aggregation = F.when(row % 2 == 0, "sum").otherwise("average")
    table = X.features(spark, sf).select(
        "row_id", "vector", "label",
        N.feature_file_name(F.lit(X.DIMS), aggregation).alias("feature_set"),
        F.when(row % 3 == 0, "masked").otherwise("original").alias("variant"))
    path = scratch_path(spark, "features")
    writers.write_features(table, path)
    back = spark.read.parquet(path)
    return long_form(back, "feature_set", "variant", "row_id", "label").withColumn(
        "dim", F.col("dim").cast("bigint"))


@query("write_corpus", """
    SELECT doc_id, label, 'original' AS variant, md5(text) AS digest FROM corpus
    UNION ALL SELECT doc_id, label, 'masked', md5(text) FROM masked""", ("corpus", "masked"))
def write_corpus(spark, sf):
    path = scratch_path(spark, "corpus")
    writers.write_corpus(with_variants(X.corpus(spark, sf), X.TERMS), path)
    return spark.read.parquet(path).select("doc_id", "label", "variant", F.md5("text").alias("digest"))


@query("write_results", f"SELECT {', '.join(R.RESULT_COLUMNS)} FROM results", ("results",))
def write_results(spark, sf):
    path = scratch_path(spark, "results")
    writers.write_results(X.results(spark, sf), path)
    return readers.read_results(spark, path)


@query("incremental_append", """
    SELECT filename, model, CASE WHEN filename LIKE 'transformer/%' THEN -1.0::DOUBLE ELSE f1 END AS f1
    FROM results""", ("results",))
def incremental_append(spark, sf):
    """A run from nothing, resumed twice; files already stored keep their rows."""
    rows = X.results(spark, sf).select("filename", "model", "f1")
    path = scratch_path(spark, "resumed")
    done = rows.where(F.col("filename").startswith("transformer/"))
    writers.append_new(done.withColumn("f1", F.lit(-1.0)), path)
    writers.append_new(rows, path)
    writers.append_new(rows.withColumn("f1", F.lit(-2.0)), path)
    return spark.read.parquet(path)


@query("concurrent_append", "SELECT filename, model FROM results", ("results",))
def concurrent_append(spark, sf):
    """Two writers of overlapping files at once, and one of them again; each file is stored by one."""
    rows = X.results(spark, sf).select("filename", "model", "f1")
    path = scratch_path(spark, "published")
    parts = {"some": rows.where(F.col("filename").startswith("transformer/")), "all": rows}
    with ThreadPoolExecutor(2) as writers_at_once:
        list(writers_at_once.map(lambda run: published.append_published(parts[run], path, run=run), parts))
    published.append_published(rows, path, run="all")
    return published.read_published(spark, path).select("filename", "model")


@query("write_evaluation", """
    SELECT filename, round(avg(f1), 6) AS mean_f1 FROM results GROUP BY filename""", ("results",))
def write_evaluation(spark, sf):
    path = scratch_path(spark, "evaluation")
    table = R.mean_by_group(X.results(spark, sf), ["filename"])
    writers.write_evaluation(table.withColumn("mean_f1", F.round("mean_f1", 6)), path)
    return spark.read.csv(path, header=True, schema="filename string, mean_f1 double")


LOGISTIC = {"model": "Logistic Regression", "c": 1.0, "penalty": "l2", "class_weight": "balanced"}


@query("save_load_bundle", "SELECT row_id, true AS same FROM features", ("features",))
def save_load_bundle(spark, sf):
    """Predictions of a saved and loaded classifier next to those before."""
    features = X.features(spark, sf)
    bundle = train_bundle(features, holdout_splits(features), LOGISTIC,
                          "word_embeddings_64_average.csv", X.DIMS)
    path = scratch_path(spark, "bundle")
    save_bundle(spark, bundle, path)
    loaded = load_bundle(spark, path)
    before = M.predict_rows(bundle.classifier, features).select("row_id", "prediction")
    after = M.predict_rows(loaded.classifier, features).select(
        "row_id", F.col("prediction").alias("prediction_loaded"))
    return before.join(after, "row_id").select(
        "row_id", F.col("prediction").eqNullSafe(F.col("prediction_loaded")).alias("same"))


@query("embedding_config", """
    SELECT filename,
           CASE WHEN b IN ('transformer_all_minilm_l6_v2', 'transformer_all_mpnet_base_v2',
                           'transformer_gtr_t5_base', 'transformer_sentence_t5_base')
                THEN 'sentence_transformer' ELSE 'glove' END AS type,
           CASE b WHEN 'transformer_all_minilm_l6_v2' THEN 'sentence-transformers/all-MiniLM-L6-v2'
                  WHEN 'transformer_all_mpnet_base_v2' THEN 'sentence-transformers/all-mpnet-base-v2'
                  WHEN 'transformer_gtr_t5_base' THEN 'sentence-transformers/gtr-t5-base'
                  WHEN 'transformer_sentence_t5_base' THEN 'sentence-transformers/sentence-t5-base'
                  ELSE 'glove-twitter-' || split_part(b, '_', 3) END AS model,
           CASE WHEN starts_with(b, 'word') THEN split_part(b, '_', 4) END AS aggregation
    FROM (SELECT filename, replace(split_part(filename, '/', 2), '.csv', '') AS b FROM feature_sets)""",
    ("feature_sets",))
def embedding_config(spark, sf):
    config = N.embedding_config(F.col("filename")).alias("c")
    return X.feature_sets(spark, sf).select("filename", config).select("filename", "c.*")


@query("bundle_name", """
    SELECT filename, model, CASE WHEN starts_with(b, 'word')
        THEN 'glove_twitter_' || split_part(b, '_', 3) || '_' || split_part(b, '_', 4)
        ELSE replace(b, 'transformer_', '') END
        || '_' || lower(replace(model, ' ', '_')) AS bundle
    FROM (SELECT filename, model, replace(split_part(filename, '/', 2), '.csv', '') AS b FROM results)""",
    ("results",))
def bundle_name(spark, sf):
    config = N.embedding_config(F.col("filename"))
    return X.results(spark, sf).select("filename", "model", config.alias("c")).select(
        "filename", "model", N.bundle_name(F.col("c"), F.col("model")).alias("bundle"))
