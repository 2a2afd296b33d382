"""Balancing, splits, selection, models and their evaluation."""

from __future__ import annotations

from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.sql import functions as F

from catalog import fixtures as X
from catalog.aggregates import tokens
from catalog.joins import error_variants, predictions, variants
from catalog.registry import cte, long_form, query
from textlab.operators import errors as E
from textlab.operators import models as M
from textlab.operators import scoring as S
from textlab.operators.report import EXPERIMENTS
from textlab.operators.sampling import (
    class_weights, holdout_splits, smote, stratified_folds,
)
from textlab.operators.search import SPACE, trial_table
from textlab.operators.neighbours import nearest_neighbours
from textlab.operators.selection import mutual_information, top_percent
from textlab.operators.sparse import balance_weights, numbered_terms, sparse_rows
from textlab.operators.tfidf import tfidf
from textlab.operators.vectors import aggregate_vectors
from textlab.plans import tuning
from textlab.plans.experiments import prepare_data, variant_experiment
from textlab.plans.features import tfidf_tokens
from textlab.plans.predict import embed_texts, predict, train_bundle
from textlab.session import written

_U = "CAST(('0x' || substr(md5('{0}:' || {1}), 1, 8)) AS BIGINT) / 4294967296.0"


def uniform_sql(seed: str, key: str) -> str:
    return _U.format(seed, key)


cte("draws", f"""
    SELECT j, CAST(floor({uniform_sql('b', 'j')} * n1) AS BIGINT) AS base,
           1 + CAST(floor({uniform_sql('n', 'j')} * 5) AS BIGINT) AS rank, {uniform_sql('g', 'j')} AS gap
    FROM (SELECT unnest(range(0, n0 - n1)) AS j, n1 FROM (
        SELECT CAST(sum(1 - label) AS BIGINT) AS n0, CAST(sum(label) AS BIGINT) AS n1 FROM features))""", "features")
cte("synthetic", """
    SELECT (SELECT max(row_id) FROM features) + 1 + j AS row_id, i,
           round(a.vector[i] + d.gap * (b.vector[i] - a.vector[i]), 12) AS value
    FROM draws d JOIN (SELECT *, row_number() OVER (ORDER BY row_id) - 1 AS base FROM minority) a USING (base)
    JOIN neighbours n ON n.row_id = a.row_id AND n.rank = d.rank
    JOIN minority b ON b.row_id = n.neighbour, dims""", "draws", "minority", "neighbours", "dims")


@query("smote_balance", """
    SELECT row_id, label, 0 AS synthetic, i - 1 AS dim, round(vector[i], 6) + 0.0 AS value FROM features, dims
    UNION ALL SELECT row_id, 1, 1, i - 1, round(value, 6) + 0.0 FROM synthetic""",
    ("features", "dims", "synthetic"))
def smote_balance(spark, sf):
    balanced = smote(X.features(spark, sf)).withColumn("synthetic", F.col("is_synthetic").cast("int"))
    return long_form(balanced, "row_id", "label", "synthetic").withColumn("dim", F.col("dim").cast("bigint"))


@query("train_test_splits", """
    SELECT row_id, CAST(split_no AS INTEGER) AS split_no, part FROM splits""", ("splits",))
def train_test_splits(spark, sf):
    return holdout_splits(X.features(spark, sf))


# Fold sizes by the interleaving rule, as in the operator: f(i) rows of a class
# that starts at place s lie in the folds up to i.
_FOLD = """
    SELECT {keys}row_id, label, len(list_filter(bounds, lambda b: b <= pos)) AS fold
    FROM (SELECT *, list_transform(range(0, 5), lambda i: list_sum(list_transform(range(0, i + 1),
              lambda j: floor((s + n - 1 - j) / 5.0) - floor((s - 1 - j) / 5.0)))) AS bounds
          FROM (SELECT {keys}row_id, label,
                       row_number() OVER (PARTITION BY {keys}label ORDER BY row_id) - 1 AS pos
                FROM {rows}) JOIN (
                SELECT {keys}label, count(*) AS n, coalesce(sum(count(*)) OVER ({part} ORDER BY min(row_id)
                           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s
                FROM {rows} GROUP BY {keys}label) USING ({keys}label))"""
cte("folds", _FOLD.format(keys="", rows="features", part=""), "features")
cte("train_rows", """
    SELECT s.split_no, f.row_id, f.label FROM features f JOIN splits s USING (row_id)
    WHERE s.part = 'train'""", "features", "splits")
cte("split_folds", _FOLD.format(keys="split_no, ", rows="train_rows", part="PARTITION BY split_no"), "train_rows")


@query("stratified_folds", """
    SELECT row_id, label, CAST(fold AS INTEGER) AS fold FROM folds""", ("folds",))
def folds(spark, sf):
    return stratified_folds(X.features(spark, sf))


def _mi_ctes(name: str, weights: str, rows: str) -> None:
    """Cells of term, label and bin, from weights(doc_id, term, weight) and rows(doc_id, label)."""
    cte(f"{name}_rows", f"""
    SELECT term, label, floor((row_number() OVER (PARTITION BY term ORDER BY round(weight, 9), doc_id) - 1) * 4
               / CAST(count(*) OVER (PARTITION BY term) AS DOUBLE)) AS bin
    FROM {weights} JOIN (SELECT doc_id, label FROM {rows}) USING (doc_id)""", weights, rows)
    cte(f"{name}_cells", f"""
    SELECT term, label, bin, count(*) AS n FROM {name}_rows GROUP BY ALL
    UNION ALL
    SELECT t.term, c.label, -1, c.n - coalesce(m.n, 0) FROM (SELECT DISTINCT term FROM {name}_rows) t
    CROSS JOIN (SELECT label, count(*) AS n FROM {rows} GROUP BY label) c
    LEFT JOIN (SELECT term, label, count(*) AS n FROM {name}_rows GROUP BY ALL) m
        ON m.term = t.term AND m.label = c.label""", f"{name}_rows", rows)


def _mi_scores(name: str, digits: int) -> str:
    return f"""
    SELECT term, round(sum(CASE WHEN n > 0 THEN n / total * ln(n * total / (r * c)) ELSE 0 END), {digits})
               + 0.0 AS score
    FROM (SELECT m.term, CAST(m.n AS DOUBLE) AS n, sum(m.n) OVER (PARTITION BY m.term, m.bin) AS r,
                 sum(m.n) OVER (PARTITION BY m.term, m.label) AS c,
                 CAST(sum(m.n) OVER (PARTITION BY m.term) AS DOUBLE) AS total FROM {name}_cells m)
    GROUP BY term"""


cte("v_draws", f"""
    SELECT j, CAST(floor({uniform_sql('b', 'j')} * n1) AS BIGINT) AS base,
           1 + CAST(floor({uniform_sql('n', 'j')} * 5) AS BIGINT) AS rank, {uniform_sql('g', 'j')} AS gap
    FROM (SELECT unnest(range(0, n0 - n1)) AS j, n1 FROM (
        SELECT CAST(sum(1 - label) AS BIGINT) AS n0, CAST(sum(label) AS BIGINT) AS n1 FROM corpus))""", "corpus")
# The TF-IDF rows of the smaller class, their nearest neighbours and the points between them.
cte("sparse_minority", """
    SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS base FROM corpus WHERE label = 1""", "corpus")
cte("sparse_entries", """
    SELECT t.doc_id, t.term, t.weight AS w FROM tfidf t JOIN sparse_minority m USING (doc_id)""", "tfidf", "sparse_minority")
cte("sparse_distances", """
    SELECT a, b, round(sqrt(coalesce(sum((wa - wb) * (wa - wb)), 0)), 9) AS d FROM (
        SELECT p.a, p.b, e.w AS wa, coalesce(f.w, 0) AS wb
        FROM (SELECT a.doc_id AS a, b.doc_id AS b FROM sparse_minority a JOIN sparse_minority b ON a.doc_id <> b.doc_id) p
        LEFT JOIN sparse_entries e ON e.doc_id = p.a
        LEFT JOIN sparse_entries f ON f.doc_id = p.b AND f.term = e.term
        UNION ALL
        SELECT a.doc_id, f.doc_id, 0, f.w FROM sparse_minority a JOIN sparse_entries f ON f.doc_id <> a.doc_id
        ANTI JOIN sparse_entries e ON e.doc_id = a.doc_id AND e.term = f.term)
    GROUP BY a, b""", "sparse_minority", "sparse_entries")
cte("sparse_neighbours", """
    SELECT a AS doc_id, b AS neighbour, d, row_number() OVER (PARTITION BY a ORDER BY d, b) AS rank
    FROM sparse_distances QUALIFY rank <= 5""", "sparse_distances")
cte("sparse_drawn", """
    SELECT (SELECT max(doc_id) FROM corpus) + 1 + j AS doc_id, m.doc_id AS one, n.neighbour AS other, gap
    FROM v_draws d JOIN sparse_minority m USING (base)
    JOIN sparse_neighbours n ON n.doc_id = m.doc_id AND n.rank = d.rank""",
    "corpus", "v_draws", "sparse_minority", "sparse_neighbours")
cte("sparse_synthetic", """
    SELECT doc_id, term, round(sum(CASE WHEN side = 1 THEN w ELSE 0 END) + gap * (
        sum(CASE WHEN side = 2 THEN w ELSE 0 END) - sum(CASE WHEN side = 1 THEN w ELSE 0 END)), 12) AS weight
    FROM (SELECT s.doc_id, s.gap, 1 AS side, e.term, e.w FROM sparse_drawn s JOIN sparse_entries e ON e.doc_id = s.one
          UNION ALL
          SELECT s.doc_id, s.gap, 2, e.term, e.w FROM sparse_drawn s JOIN sparse_entries e ON e.doc_id = s.other)
    GROUP BY doc_id, term, gap HAVING weight <> 0""", "sparse_drawn", "sparse_entries")
cte("balanced_tfidf", """
    SELECT doc_id, term, weight FROM tfidf JOIN (SELECT doc_id FROM corpus) USING (doc_id)
    UNION ALL SELECT doc_id, term, weight FROM sparse_synthetic""", "tfidf", "corpus", "sparse_synthetic")
cte("balanced_corpus", """
    SELECT doc_id, label FROM corpus UNION ALL SELECT doc_id, 1 FROM sparse_drawn""", "corpus", "sparse_drawn")
_mi_ctes("mi", "tfidf", "corpus")
_mi_ctes("balanced_mi", "balanced_tfidf", "balanced_corpus")


def balanced_weights(spark, sf):
    """TF-IDF weights and rows of the labelled documents, balanced."""
    weights = written(tfidf(tokens(spark, sf)), "weights")
    docs = written(X.corpus(spark, sf).select("doc_id", "label"), "labels")
    return balance_weights(weights.join(docs.select("doc_id"), "doc_id", "left_semi"), docs)


@query("sparse_neighbours", """
    SELECT doc_id AS row_id, CAST(rank AS INTEGER) AS rank, neighbour, round(d, 6) AS distance
    FROM sparse_neighbours""", ("sparse_neighbours",))
def sparse_neighbours(spark, sf):
    """The nearest TF-IDF rows of every row of the smaller class."""
    weights, docs = tfidf(tokens(spark, sf)), X.corpus(spark, sf).where("label = 1").select("doc_id")
    weights = written(weights, "weights")
    rows = sparse_rows(weights, docs, numbered_terms(weights)).withColumnRenamed("doc_id", "row_id")
    return nearest_neighbours(written(rows, "rows"), 5).withColumn("distance", F.round("distance", 6))


@query("tfidf_balance", """
    SELECT doc_id, label, is_synthetic, count(term) AS n_terms, round(coalesce(sum(weight), 0), 6) + 0.0 AS total
    FROM (SELECT doc_id, label, false AS is_synthetic FROM corpus
          UNION ALL SELECT doc_id, 1, true FROM sparse_drawn)
    LEFT JOIN balanced_tfidf USING (doc_id) GROUP BY ALL""", ("corpus", "sparse_drawn", "balanced_tfidf"))
def tfidf_balance(spark, sf):
    """Rows of the balanced TF-IDF matrix, with their terms and the sum of their weights."""
    weights, docs = balanced_weights(spark, sf)
    sums = weights.groupBy("doc_id").agg(F.count("term").alias("n_terms"), F.sum("weight").alias("total"))
    total = F.round(F.coalesce("total", F.lit(0.0)), 6)
    return docs.join(sums, "doc_id", "left").select(
        "doc_id", "label", "is_synthetic", F.coalesce("n_terms", F.lit(0)).cast("bigint").alias("n_terms"), total.alias("total"))


@query("mutual_information", _mi_scores("balanced_mi", 6), ("balanced_mi_cells",))
def mutual_information_scores(spark, sf):
    """Terms of the balanced matrix by what they tell of the label."""
    return mutual_information(*balanced_weights(spark, sf)).withColumn("score", F.round("score", 6))


@query("raw_mutual_information", _mi_scores("mi", 6), ("mi_cells",))
def raw_mutual_information(spark, sf):
    """The same for the rows as they are."""
    weights = tfidf(tokens(spark, sf))
    labels = X.corpus(spark, sf).select("doc_id", "label")
    return mutual_information(weights, labels).withColumn("score", F.round("score", 6))


@query("top_k_percent_features", f"""
    SELECT pct, rank, term, score FROM (
        SELECT term, score, row_number() OVER (ORDER BY score DESC, term) AS rank, count(*) OVER () AS n
        FROM ({_mi_scores("balanced_mi", 9)})),
        (SELECT unnest(CAST([0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.45] AS DOUBLE[])) AS pct)
    WHERE rank <= floor(pct * n)""", ("balanced_mi_cells",))
def top_k_percent_features(spark, sf):
    """The best shares of the vocabulary by mutual information with the label, on the balanced matrix."""
    scores = mutual_information(*balanced_weights(spark, sf))
    return top_percent(scores.withColumn("score", F.round("score", 9)))


@query("balanced_class_weights", """
    SELECT doc_id, label, round(count(*) OVER () / (2.0 * count(*) OVER (PARTITION BY label)), 6) AS weight
    FROM corpus""", ("corpus",))
def balanced_class_weights(spark, sf):
    weighted = class_weights(X.corpus(spark, sf).select("doc_id", "label"))
    return weighted.select("doc_id", "label", F.round("weight", 6).alias("weight"))


def _draw_sql(name: str, rule: tuple) -> str:
    u = uniform_sql("42", f"filename || '/' || trial || '/{name}'")
    kind, *rest = rule
    if kind == "int":
        return f"CAST(floor({u} * {rest[1] - rest[0] + 1}) + {rest[0]} AS INTEGER)"
    if kind == "log":
        low, high = (f"ln(CAST({x} AS DOUBLE))" for x in rest)
        return f"round(exp({low} + {u} * ({high} - {low})), 6)"
    items = ", ".join("NULL" if x is None else repr(x) for x in rest)
    return f"([{items}])[CAST(floor({u} * {len(rest)}) AS INTEGER) + 1]"


_TRIAL_COLUMNS = sorted({c for space in SPACE.values() for c in space})
_TRIALS = " UNION ALL ".join(
    f"SELECT filename, '{model}' AS model, CAST(trial AS INTEGER) AS trial, " + ", ".join(
        f"{_draw_sql(c, space[c]) if c in space else 'NULL'} AS {c}" for c in _TRIAL_COLUMNS
    ) + " FROM feature_sets, (SELECT unnest(range(0, 100)) AS trial)"
    for model, space in SPACE.items()
)


@query("search_trials", _TRIALS, ("feature_sets",))
def search_trials(spark, sf):
    """100 trials of every classifier for every recorded feature set."""
    sets = X.feature_sets(spark, sf)
    tables = [trial_table(sets, model) for model in SPACE]
    trials = tables[0]
    for other in tables[1:]:
        trials = trials.unionByName(other, allowMissingColumns=True)
    for name in ("c", "learning_rate_init"):
        trials = trials.withColumn(name, F.round(name, 6))
    return trials.select("filename", "model", "trial", *_TRIAL_COLUMNS)


cte("fold_sums", """
    SELECT split_no, fold, c.label, i, sum(value) AS total, count(*) AS n
    FROM feature_cells c JOIN split_folds s USING (row_id) GROUP BY ALL""", "feature_cells", "split_folds")
cte("fold_centres", """
    SELECT a.split_no, a.fold, a.label, a.i, (b.total - a.total) / (b.n - a.n) AS centre
    FROM fold_sums a JOIN (SELECT split_no, label, i, sum(total) AS total, sum(n) AS n FROM fold_sums
                           GROUP BY ALL) b USING (split_no, label, i)""", "fold_sums")
cte("fold_predictions", """
    SELECT split_no, fold, row_id, label,
           CASE WHEN sum(CASE WHEN centre_label = 1 THEN d END) < sum(CASE WHEN centre_label = 0 THEN d END)
                THEN 1 ELSE 0 END AS prediction
    FROM (SELECT s.split_no, s.fold, c.row_id, c.label, k.label AS centre_label,
                 (c.value - k.centre) * (c.value - k.centre) AS d
          FROM feature_cells c JOIN split_folds s USING (row_id)
          JOIN fold_centres k ON k.split_no = s.split_no AND k.fold = s.fold AND k.i = c.i)
    GROUP BY ALL""", "feature_cells", "split_folds", "fold_centres")


@query("cv_objective", """
    SELECT round(avg(f1), 6) AS objective FROM (
        SELECT split_no, avg(f1) AS f1 FROM (
            SELECT split_no, fold, 2.0 * sum(CASE WHEN label = 1 AND prediction = 1 THEN 1 ELSE 0 END)
                / (2 * sum(CASE WHEN label = 1 AND prediction = 1 THEN 1 ELSE 0 END)
                   + sum(CASE WHEN label <> prediction THEN 1 ELSE 0 END)) AS f1
            FROM fold_predictions GROUP BY ALL) GROUP BY split_no)""", ("fold_predictions",))
def cv_objective(spark, sf):
    features = X.features(spark, sf)
    train = holdout_splits(features).where("part = 'train'").join(features.select("row_id", "label"), "row_id")
    parts = stratified_folds(train, within=("split_no",)).drop("label")
    scores = S.cv_objective_scores(S.cv_predictions(features, parts, X.DIMS))
    return scores.select(F.round("objective", 6).alias("objective"))


cte("balanced_cells", """
    SELECT row_id, label, i, value, false AS is_synthetic FROM feature_cells
    UNION ALL SELECT row_id, 1, i, value, true FROM synthetic""", "feature_cells", "synthetic")
cte("balanced_splits", """
    SELECT split_no, row_id, CASE WHEN row_number() OVER (PARTITION BY split_no
               ORDER BY md5(split_no || ':' || row_id)) <= ceil(CAST(0.2 AS DOUBLE) * count(*) OVER (PARTITION BY split_no))
           THEN 'test' ELSE 'train' END AS part
    FROM (SELECT DISTINCT row_id FROM balanced_cells), (SELECT unnest([1, 2, 3, 4, 5]) AS split_no)""",
    "balanced_cells")
cte("balanced_centres", """
    SELECT s.split_no, c.label, c.i, sum(c.value) / count(*) AS centre
    FROM balanced_cells c JOIN balanced_splits s USING (row_id) WHERE s.part = 'train' GROUP BY ALL""",
    "balanced_cells", "balanced_splits")
cte("balanced_predictions", """
    SELECT row_id, split_no, label, is_synthetic,
           CASE WHEN sum(CASE WHEN centre_label = 1 THEN d END) < sum(CASE WHEN centre_label = 0 THEN d END)
                THEN 1 ELSE 0 END AS prediction
    FROM (SELECT c.row_id, s.split_no, c.label, c.is_synthetic, k.label AS centre_label,
                 (c.value - k.centre) * (c.value - k.centre) AS d
          FROM balanced_cells c JOIN balanced_splits s ON s.row_id = c.row_id AND s.part = 'test'
          JOIN balanced_centres k ON k.split_no = s.split_no AND k.i = c.i)
    GROUP BY ALL""", "balanced_cells", "balanced_splits", "balanced_centres")
cte("balanced_report", """
    SELECT label, variant, row_number() OVER w - 1 AS seq,
           CAST(coalesce(sum(length(section)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
                AS BIGINT) AS start, section
    FROM (SELECT e.label, d.variant, d.doc_id, 'post_' || d.doc_id || ':' || chr(10) || d.text
                 || chr(10) || chr(10) || repeat('-', 38) || chr(10) AS section
          FROM (SELECT DISTINCT label, row_id AS doc_id FROM balanced_predictions
                WHERE prediction <> label AND NOT is_synthetic) e
          JOIN document_variants d USING (doc_id))
    WINDOW w AS (PARTITION BY label, variant ORDER BY doc_id)""", "balanced_predictions", "document_variants")


@query("misclassified_documents", """
    SELECT label, variant, seq, start, md5(section) AS digest FROM balanced_report""", ("balanced_report",))
def misclassified_documents(spark, sf):
    """Errors on original rows after balancing, with both forms of the documents."""
    balanced, splits = prepare_data(X.features(spark, sf))
    predicted = S.centroid_predictions(balanced, splits, X.DIMS).join(
        balanced.select("row_id", "is_synthetic"), "row_id")
    docs = error_variants(spark, sf, E.misclassified(predicted))
    named = docs.withColumn("name", F.concat(F.lit("post_"), F.col("doc_id").cast("string")))
    return E.error_report(named).select("label", "variant", "seq", "start", F.md5("section").alias("digest"))


cte("v_rows", """
    SELECT variant, doc_id AS row_id, label, i, value FROM variant_features""", "variant_features")
cte("v_minority", """
    SELECT variant, row_id, list(value ORDER BY i) AS vector FROM v_rows WHERE label = 1
    GROUP BY variant, row_id""", "v_rows")
cte("v_neighbours", """
    SELECT a.variant, a.row_id, b.row_id AS neighbour,
           row_number() OVER (PARTITION BY a.variant, a.row_id
               ORDER BY round(list_distance(a.vector, b.vector), 9), b.row_id) AS rank
    FROM v_minority a JOIN v_minority b ON a.variant = b.variant AND a.row_id <> b.row_id
    QUALIFY rank <= 5""", "v_minority")
cte("v_balanced", """
    SELECT variant, row_id, label, i, value FROM v_rows
    UNION ALL
    SELECT a.variant, (SELECT max(doc_id) FROM corpus) + 1 + j, 1, i,
           round(a.vector[i] + d.gap * (b.vector[i] - a.vector[i]), 12)
    FROM v_draws d JOIN (SELECT *, row_number() OVER (PARTITION BY variant ORDER BY row_id) - 1 AS base
                         FROM v_minority) a ON a.base = d.base
    JOIN v_neighbours n ON n.variant = a.variant AND n.row_id = a.row_id AND n.rank = d.rank
    JOIN v_minority b ON b.variant = a.variant AND b.row_id = n.neighbour, dims""",
    "v_rows", "corpus", "v_draws", "v_minority", "v_neighbours", "dims")
cte("v_keys", "SELECT DISTINCT row_id, label FROM v_balanced", "v_balanced")
cte("v_folds", _FOLD.format(keys="", rows="v_keys", part=""), "v_keys")
cte("v_centres", """
    SELECT b.variant, t.fold, b.label, b.i, avg(b.value) AS centre
    FROM v_balanced b JOIN v_folds f USING (row_id), (SELECT unnest(range(0, 5)) AS fold) t
    WHERE f.fold <> t.fold GROUP BY ALL""", "v_balanced", "v_folds")
cte("v_predictions", """
    SELECT train_variant, test_variant, fold, row_id, label,
           CASE WHEN sum(CASE WHEN centre_label = 1 THEN d END) < sum(CASE WHEN centre_label = 0 THEN d END)
                THEN 1 ELSE 0 END AS prediction
    FROM (SELECT c.variant AS train_variant, b.variant AS test_variant, f.fold, b.row_id, b.label,
                 c.label AS centre_label, (b.value - c.centre) * (b.value - c.centre) AS d
          FROM v_balanced b JOIN v_folds f USING (row_id) JOIN v_centres c ON c.fold = f.fold AND c.i = b.i)
    GROUP BY ALL""", "v_balanced", "v_folds", "v_centres")
cte("v_scores", """
    SELECT experiment, avg(f1) AS f1_mean, var_pop(f1) AS f1_var, avg(acc) AS acc_mean, var_pop(acc) AS acc_var
    FROM (SELECT 'train_' || train_variant || '_test_' || test_variant AS experiment, fold,
                 2.0 * sum(CASE WHEN label = 1 AND prediction = 1 THEN 1 ELSE 0 END)
                 / (2 * sum(CASE WHEN label = 1 AND prediction = 1 THEN 1 ELSE 0 END)
                    + sum(CASE WHEN label <> prediction THEN 1 ELSE 0 END)) AS f1,
                 avg(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END) AS acc
          FROM v_predictions GROUP BY ALL) GROUP BY experiment""", "v_predictions")
_WIDE = ", ".join(
    f"round(max(CASE WHEN experiment = '{e}' THEN {m} END), 6) AS {e}_{m}"
    for e, _, _ in EXPERIMENTS for m in ("f1_mean", "f1_var", "acc_mean", "acc_var")
)


@query("variant_experiment", f"""
    SELECT 'word_embeddings_64_average.csv' AS file, {_WIDE} FROM v_scores""", ("v_scores",))
def variant_experiments(spark, sf):
    return variant_experiment(variants(spark, sf), "word_embeddings_64_average.csv", X.DIMS)


@query("variant_experiment_fitted")
def variant_experiment_fitted(spark, sf):
    """The same with a forest of 100 trees for each variant and fold."""
    params = {"model": "Random Forest", "n_estimators": 100}
    return variant_experiment(variants(spark, sf), "word_embeddings_64_average.csv", X.DIMS, params)


FOREST = {"model": "Random Forest", "n_estimators": 50, "max_features": "sqrt", "criterion": "gini"}
LOGISTIC = {"model": "Logistic Regression", "c": 10.0, "penalty": "l2", "class_weight": "balanced"}
NETWORK = {"model": "Neural Network", "hidden_layer_sizes": "(256, 128, 64, 32, 16)", "batch_size": 128,
           "activation": "relu", "learning_rate": "adaptive", "learning_rate_init": 0.001}


# What SQL can say of a trained classifier: its test rows, and that it beats the larger class.
_TESTED = """
    SELECT CAST(split_no AS INTEGER) AS split_no, count(*) AS n_test, CAST(sum(label) AS BIGINT) AS n_positive,
           true AS beats_majority
    FROM (SELECT DISTINCT row_id, label FROM balanced_cells) JOIN balanced_splits USING (row_id)
    WHERE part = 'test' GROUP BY split_no"""


def _split_scores(spark, sf, params):
    """Test rows of a classifier over the five splits of the balanced features, and
    whether its accuracy beats the share of the larger class."""
    balanced, splits = prepare_data(X.features(spark, sf))
    predicted = M.fit_predict_splits(balanced, splits, params)
    tests = predicted.groupBy("split_no").agg(
        F.count(F.lit(1)).alias("n_test"), F.sum("label").cast("bigint").alias("n_positive"))
    larger = F.greatest("n_positive", F.col("n_test") - F.col("n_positive")) / F.col("n_test")
    return tests.join(S.split_scores(predicted), "split_no").select(
        "split_no", "n_test", "n_positive", (F.col("accuracy") > larger).alias("beats_majority"))


@query("random_forest", _TESTED, ("balanced_cells", "balanced_splits"))
def random_forest(spark, sf):
    return _split_scores(spark, sf, FOREST)


@query("logistic_regression", _TESTED, ("balanced_cells", "balanced_splits"))
def logistic_regression(spark, sf):
    return _split_scores(spark, sf, LOGISTIC)


@query("mlp", _TESTED, ("balanced_cells", "balanced_splits"))
def mlp(spark, sf):
    return _split_scores(spark, sf, NETWORK)


@query("classifier_scores")
def classifier_scores(spark, sf):
    """F1 and accuracy of the three classifiers on each split of the balanced features."""
    balanced, splits = prepare_data(X.features(spark, sf))
    tables = [
        S.split_scores(M.fit_predict_splits(balanced, splits, p)).withColumn("model", F.lit(p["model"]))
        for p in (FOREST, LOGISTIC, NETWORK)
    ]
    return tables[0].unionByName(tables[1]).unionByName(tables[2]).select("model", "split_no", "f1", "accuracy")


@query("tune_logistic")
def tune_logistic(spark, sf):
    """100 trials of the regression on the balanced features: the best parameters, their
    objective, and their scores on the test parts. All 2,500 fits run together."""
    balanced, splits = prepare_data(X.features(spark, sf))
    return tuning.tune(balanced, splits, "word_embeddings/word_embeddings_64_average.csv", ["Logistic Regression"])


@query("evaluate_recorded")
def evaluate_recorded(spark, sf):
    """Every recorded classifier, fitted and scored again where the features of its file can be
    built here; the others are reported as missing."""
    recorded = written(X.results(spark, sf), "results")
    names = [r["filename"] for r in recorded.select("filename").distinct().collect()]  # one for each file
    table = X.features_by_file(spark, sf)
    built = [name for name, _, _ in X.sets_of_files(names)]

    def prepared(name):
        return prepare_data(table.where(F.col("filename") == name).select("row_id", "vector", "label"))

    with ThreadPool(max(1, len(built))) as pool:
        sets = dict(zip(built, pool.map(inheritable_thread_target(spark)(prepared), built)))
    return tuning.evaluate_recorded(recorded, sets)


@query("recorded_coverage", """
    SELECT r.filename, r.model, CASE WHEN b.filename IS NULL THEN 'missing' ELSE 'built' END AS status, b.dims,
           CASE WHEN b.filename IS NOT NULL THEN (SELECT count(*) FROM corpus) END AS n_rows
    FROM results r LEFT JOIN built_files b USING (filename)""", ("results", "built_files", "corpus"))
def recorded_coverage(spark, sf):
    """Which recorded classifiers have features here, of which size and how many rows."""
    built = X.features_by_file(spark, sf).groupBy("filename").agg(
        F.min(F.size("vector")).alias("dims"), F.count(F.lit(1)).alias("n_rows"))
    status = F.when(F.col("dims").isNull(), "missing").otherwise("built")
    return X.results(spark, sf).select("filename", "model").join(built, "filename", "left").select(
        "filename", "model", status.alias("status"), "dims", "n_rows")


def _corpus_features(spark, sf, masked=False):
    corpus, lookup = X.corpus(spark, sf), X.lookup(spark, sf)
    if masked:
        vectors = embed_texts(corpus.select("doc_id", "text"), X.TERMS, lookup, X.DIMS)
    else:
        vectors = aggregate_vectors(corpus, lookup, "mean", X.DIMS)
    return vectors.join(corpus.select("doc_id", "label"), "doc_id").withColumnRenamed("doc_id", "row_id")


def masked_bundle(spark, sf):
    """A classifier of the labelled documents, fitted on their masked features after balancing."""
    features, splits = prepare_data(_corpus_features(spark, sf, masked=True))
    return train_bundle(features, splits, LOGISTIC, "word_embeddings_64_average.csv", X.DIMS)


def _predicted(spark, sf):
    """Every document with the label and probability by a classifier of the labelled ones."""
    lookup = X.lookup(spark, sf)
    return predict(
        X.documents(spark, sf), masked_bundle(spark, sf), lambda t: embed_texts(t, X.TERMS, lookup, X.DIMS))


@query("batch_predict_scores")
def batch_predict_scores(spark, sf):
    """Label, probability and confidence of every document that is not blank."""
    return _predicted(spark, sf).select("doc_id", "prediction", "label_text", "probability", "confidence")


@query("batch_predict", """
    SELECT doc_id, true AS labelled, true AS likely FROM documents WHERE trim(text, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') <> ''""")
def batch_predict(spark, sf):
    """Mask, embed and classify every document with a classifier fitted on the labelled ones.

    It is fitted on the masked features of labelled documents after balancing.
    SQL checks that every text gets a label, and that the label is the likelier one.
    """
    return _predicted(spark, sf).select(
        "doc_id", F.col("label_text").isin("Positive (1)", "Control (0)").alias("labelled"),
        (F.col("probability") >= 0.5).alias("likely"))


_REPORTED = """
    SELECT CAST(label AS VARCHAR) AS cls, count(*) AS support FROM (
        SELECT label, row_number() OVER (ORDER BY md5('42:' || doc_id)) AS place, count(*) OVER () AS n FROM corpus)
    WHERE place <= ceil(CAST(0.3 AS DOUBLE) * n) GROUP BY label"""


def _forest_report(features):
    """Fit on 70 % of the rows and report on 30 %."""
    splits = holdout_splits(features, n=1, test=0.3, first_seed=42)
    return S.classification_report(M.fit_predict_splits(features, splits, {"model": "Random Forest", "n_estimators": 100}))


def _supports(report):
    """The classes and their test rows: what SQL can check of a report."""
    return report.where(F.col("row").isin("0", "1")).select(F.col("row").alias("cls"), "support")


def _tfidf_rows(spark, sf):
    docs = written(tfidf_tokens(X.corpus(spark, sf), X.STOP_WORDS), "tokens")
    weights = written(tfidf(docs), "weights")
    rows = sparse_rows(weights, docs.select("doc_id").distinct(), numbered_terms(weights))
    rows = docs.select("doc_id", "label").join(rows, "doc_id")
    return written(rows.withColumnRenamed("doc_id", "row_id"), "features")


@query("tfidf_forest", _REPORTED, ("corpus",))
def tfidf_forest(spark, sf):
    return _supports(_forest_report(_tfidf_rows(spark, sf)))


@query("tfidf_forest_report")
def tfidf_forest_report(spark, sf):
    """Precision, recall and F1 per class of a forest on TF-IDF, and their averages."""
    return _forest_report(_tfidf_rows(spark, sf))


@query("embedding_forest", _REPORTED, ("corpus",))
def embedding_forest(spark, sf):
    return _supports(_forest_report(written(_corpus_features(spark, sf), "features")))


@query("embedding_forest_report")
def embedding_forest_report(spark, sf):
    """The same of a forest on document vectors."""
    return _forest_report(written(_corpus_features(spark, sf), "features"))


@query("nearest_centroid", "SELECT row_id, CAST(split_no AS INTEGER) AS split_no, label, prediction FROM predictions",
       ("predictions",))
def nearest_centroid(spark, sf):
    return predictions(spark, sf)
