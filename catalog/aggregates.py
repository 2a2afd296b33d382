"""Aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import fixtures as X
from catalog.filters import DISPLAY_SQL
from catalog.joins import error_variants, predictions
from catalog.registry import cte, long_form, query
from textlab.functions import names as N
from textlab.functions import text as T
from textlab.operators import cohort as C
from textlab.operators import corpus as K
from textlab.operators import errors as E
from textlab.operators import filters as P
from textlab.operators import report as R
from textlab.operators import scoring as S
from textlab.operators import tfidf as D
from textlab.operators import vectors as W
from textlab.operators.encoders import model_encoder
from textlab.plans.features import masked_tfidf, tfidf_tokens, top_terms

_WORDS = r"len(list_filter(regexp_split_to_array(text, '[\t-\r\x1C-\x20\x{85}\p{Z}]+'), lambda w: w <> ''))"


@query("class_counts", "SELECT label, count(*) AS n FROM corpus GROUP BY label", ("corpus",))
def class_counts(spark, sf):
    return K.class_counts(X.corpus(spark, sf))


@query("mean_words_by_class", f"""
    SELECT label, round(avg({_WORDS}), 2) AS mean_words FROM corpus GROUP BY label""", ("corpus",))
def mean_words_by_class(spark, sf):
    return K.mean_words_by_class(X.corpus(spark, sf))


@query("corpus_stats", """
    SELECT CAST(sum(n) AS BIGINT) AS n_posts, round(avg(n), 6) AS mean_posts, median(n) AS median_posts,
           (SELECT round(avg(length(text)), 6) FROM documents) AS mean_chars,
           (SELECT median(length(text)) FROM documents) AS median_chars
    FROM (SELECT count(*) AS n FROM history WHERE length(body) >= 60 GROUP BY author)""", ("history",))
def corpus_stats(spark, sf):
    accepted = P.min_length(X.history(spark, sf))
    return K.corpus_stats(C.posts_per_author(accepted), X.documents(spark, sf))


@query("posts_per_author", """
    SELECT author, count(*) AS n_posts FROM history WHERE length(body) >= 60 GROUP BY author""", ("history",))
def posts_per_author(spark, sf):
    return C.posts_per_author(P.min_length(X.history(spark, sf)))


cte("lookup_words", """
    SELECT t.doc_id, t.pos, k.word, k.lemma, k.vector FROM letter_words t JOIN lookup k ON k.word = t.word""",
    "letter_words", "lookup")


def _vectors_sql(divisor: str) -> str:
    return f"""
    SELECT d.doc_id, i - 1 AS dim, round(coalesce(v.value, 0.0), 6) + 0.0 AS value
    FROM documents d CROSS JOIN dims LEFT JOIN (
        SELECT doc_id, i, sum(n * vector[i]) / {divisor} AS value
        FROM (SELECT doc_id, vector, count(*) AS n FROM lookup_words WHERE vector IS NOT NULL
              GROUP BY doc_id, vector), dims GROUP BY doc_id, i) v USING (doc_id, i)"""


def _as_cells(df):
    return long_form(df, "doc_id").withColumn("dim", F.col("dim").cast("bigint"))


@query("vector_sum", _vectors_sql("1"), ("lookup_words", "dims"))
def vector_sum(spark, sf):
    return _as_cells(W.aggregate_vectors(X.documents(spark, sf), X.lookup(spark, sf), "sum", X.DIMS))


@query("vector_mean", _vectors_sql("sum(n)"), ("lookup_words", "dims"))
def vector_mean(spark, sf):
    return _as_cells(W.aggregate_vectors(X.documents(spark, sf), X.lookup(spark, sf), "mean", X.DIMS))


cte("running", """
    SELECT doc_id, i, list_reduce(
        list_prepend({'k': -1::BIGINT, 'v': 0.0::DOUBLE}, list({'k': k, 'v': v} ORDER BY k)),
        lambda a, b: {'k': b.k, 'v': CASE WHEN b.v IS NULL THEN a.v
                                          ELSE (b.k * a.v + b.v) / (b.k + 1) END}).v AS value
    FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY doc_id, i ORDER BY pos) - 1 AS k,
                 vector[i] AS v FROM lookup_words, dims) GROUP BY doc_id, i""", "lookup_words", "dims")


@query("vector_running_mean", """
    SELECT d.doc_id, i - 1 AS dim, round(coalesce(r.value, 0.0), 6) + 0.0 AS value
    FROM documents d CROSS JOIN dims LEFT JOIN running r USING (doc_id, i)""", ("running", "dims"))
def vector_running_mean(spark, sf):
    return _as_cells(W.aggregate_vectors(X.documents(spark, sf), X.lookup(spark, sf), "running", X.DIMS))


cte("chunks", r"""
    SELECT doc_id, c AS chunk, CASE WHEN n < 256 THEN text
           ELSE array_to_string(ws[c * 200 + 1:c * 200 + 200], ' ') END AS text
    FROM (SELECT doc_id, text, ws, len(ws) AS n,
                 unnest(range(0, CASE WHEN len(ws) < 256 THEN 1 ELSE len(ws) // 200 + 1 END)) AS c
          FROM (SELECT doc_id, text, list_filter(regexp_split_to_array(
                    text, '[\t-\r\x1C-\x20\x{85}\p{Z}]+'), lambda w: w <> '') AS ws FROM documents))""")
cte("chunk_means", """
    SELECT doc_id, chunk, i, sum(n * vector[i]) / sum(n) AS value FROM (
        SELECT doc_id, chunk, vector, count(*) AS n FROM (
            SELECT doc_id, chunk, unnest(string_split(lower(
                regexp_replace(text, '[^a-zA-Z]+', ' ', 'g')), ' ')) AS word FROM chunks) w
        JOIN lookup k ON k.word = w.word AND k.vector IS NOT NULL GROUP BY doc_id, chunk, vector), dims
    GROUP BY doc_id, chunk, i""", "chunks", "lookup", "dims")


@query("chunk_vector_mean", """
    SELECT c.doc_id, d.i - 1 AS dim,
           round(sum(coalesce(m.value, 0.0)) / count(*), 6) + 0.0 AS value
    FROM (SELECT doc_id, chunk FROM chunks) c CROSS JOIN dims d
    LEFT JOIN chunk_means m ON m.doc_id = c.doc_id AND m.chunk = c.chunk AND m.i = d.i
    GROUP BY c.doc_id, d.i""", ("chunks", "chunk_means", "dims"))
def chunk_vector_mean(spark, sf):
    encoder = W.word_vector_encoder(X.lookup(spark, sf), X.DIMS)
    return _as_cells(W.embed_chunks(X.documents(spark, sf), encoder, X.DIMS))


cte("chunk_lengths", """
    SELECT doc_id, chunk, len(w) AS n_chars, count(*) OVER (PARTITION BY doc_id, chunk) AS n
    FROM (SELECT doc_id, chunk, unnest(string_split(lower(regexp_replace(text, '[^a-zA-Z]+', ' ', 'g')), ' ')) AS w FROM chunks)
    WHERE w <> ''""", "chunks")


@query("chunk_encoder_mean", """
    SELECT c.doc_id, d.i AS dim, round(sum(coalesce(l.share, 0.0)) / count(*), 6) + 0.0 AS value
    FROM (SELECT doc_id, chunk FROM chunks) c CROSS JOIN (SELECT unnest(range(0, 8)) AS i) d
    LEFT JOIN (SELECT doc_id, chunk, n_chars % 8 AS i, count(*) / CAST(min(n) AS DOUBLE) AS share
               FROM chunk_lengths GROUP BY ALL) l ON l.doc_id = c.doc_id AND l.chunk = c.chunk AND l.i = d.i
    GROUP BY c.doc_id, d.i""", ("chunks", "chunk_lengths"))
def chunk_encoder_mean(spark, sf):
    """Mean chunk vectors by an encoder of the user's own, loaded once per worker."""
    encoder = model_encoder(length_encoder, 8)
    return _as_cells(W.embed_chunks(X.documents(spark, sf), encoder, 8)).withColumn("dim", F.col("dim").cast("bigint"))


def length_encoder():
    """A model that needs no file: the shares of words by their length."""
    import re

    import numpy as np

    def encode(texts):
        out = np.zeros((len(texts), 8))
        for row, text in zip(out, texts):
            lengths = [len(w) % 8 for w in re.findall("[a-zA-Z]+", text)]
            row += np.bincount(lengths, minlength=8) / max(1, len(lengths))
        return out

    return encode


_ALNUM = r"""list_filter(regexp_extract_all(lower({0}),
        '[\p{{L}}\p{{N}}\p{{M}}]+(?:[-./_][\p{{L}}\p{{N}}\p{{M}}]+)*'),
        lambda w: regexp_full_match(w, '[\p{{L}}\p{{N}}]+') AND w NOT IN ({1}))"""


def alnum_sql(column: str) -> str:
    return _ALNUM.format(column, ", ".join(f"'{w}'" for w in X.STOP_WORDS))


@query("term_frequency_by_class", f"""
    SELECT label, term, count(*) AS n
    FROM (SELECT label, unnest({alnum_sql('text')}) AS term FROM corpus) GROUP BY label, term
    QUALIFY row_number() OVER (PARTITION BY label ORDER BY count(*) DESC, term) <= 200""", ("corpus",))
def term_frequency_by_class(spark, sf):
    tokens = T.alnum_tokens(F.col("text"), X.STOP_WORDS)
    return D.term_frequency_by_class(X.corpus(spark, sf).withColumn("tokens", tokens))


cte("term_tokens", f"""
    SELECT doc_id, term FROM (SELECT doc_id, unnest({alnum_sql('text')}) AS term FROM documents)
    WHERE length(term) >= 2""")
cte("tfidf", """
    SELECT doc_id, term, tf, df, raw / sqrt(sum(raw * raw) OVER (PARTITION BY doc_id)) AS weight
    FROM (SELECT t.doc_id, t.term, t.tf, d.df,
                 t.tf * (ln((1.0 + (SELECT count(*) FROM documents)) / (1.0 + d.df)) + 1) AS raw
          FROM (SELECT doc_id, term, count(*) AS tf FROM term_tokens GROUP BY doc_id, term) t
          JOIN (SELECT term, count(DISTINCT doc_id) AS df FROM term_tokens GROUP BY term) d
            ON d.term = t.term AND d.df >= 3)""", "term_tokens")


def tokens(spark, sf):
    return tfidf_tokens(X.documents(spark, sf), X.STOP_WORDS)


@query("document_frequency", """
    SELECT term, count(DISTINCT doc_id) AS df FROM term_tokens GROUP BY term HAVING df >= 3""",
    ("term_tokens",))
def document_frequency(spark, sf):
    return D.document_frequency(tokens(spark, sf))


@query("tfidf", "SELECT doc_id, term, tf, df, round(weight, 6) AS weight FROM tfidf", ("tfidf",))
def tfidf(spark, sf):
    return D.tfidf(tokens(spark, sf)).withColumn("weight", F.round("weight", 6))


cte("masked_tokens", f"""
    SELECT doc_id, term FROM (SELECT doc_id, unnest({alnum_sql('text')}) AS term FROM masked)
    WHERE length(term) >= 2""", "masked")
cte("masked_tfidf", """
    SELECT doc_id, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY doc_id)) AS weight
    FROM (SELECT t.doc_id, t.term,
                 t.tf * (ln((1.0 + (SELECT count(*) FROM masked)) / (1.0 + d.df)) + 1) AS raw
          FROM (SELECT doc_id, term, count(*) AS tf FROM masked_tokens GROUP BY doc_id, term) t
          JOIN (SELECT term, count(DISTINCT doc_id) AS df FROM masked_tokens GROUP BY term) d
            ON d.term = t.term AND d.df >= 3)""", "masked_tokens")


@query("masked_top_terms", """
    SELECT label, CAST(rank AS INTEGER) AS rank, term, n_docs, total FROM (
        SELECT label, term, round(sum(weight), 6) AS total, count(*) AS n_docs,
               row_number() OVER (PARTITION BY label ORDER BY round(sum(weight), 6) DESC, term) AS rank
        FROM masked_tfidf JOIN masked USING (doc_id) GROUP BY label, term)
    WHERE rank <= 10""", ("masked", "masked_tfidf"))
def masked_top_terms(spark, sf):
    corpus = X.corpus(spark, sf)
    weights = masked_tfidf(corpus, X.TERMS, X.STOP_WORDS)
    return top_terms(weights, corpus.select("doc_id", "label"))


cte("scores", """
    SELECT split_no, 2.0 * tp / (2 * tp + wrong) AS f1, (n - wrong) / n AS accuracy
    FROM (SELECT split_no, sum(CASE WHEN label = 1 AND prediction = 1 THEN 1 ELSE 0 END) AS tp,
                 sum(CASE WHEN label <> prediction THEN 1 ELSE 0 END) AS wrong, count(*) AS n
          FROM predictions GROUP BY split_no)""", "predictions")


@query("binary_f1_accuracy", """
    SELECT CAST(split_no AS INTEGER) AS split_no, round(f1, 6) AS f1, round(accuracy, 6) AS accuracy
    FROM scores""", ("scores",))
def binary_f1_accuracy(spark, sf):
    scores = S.split_scores(predictions(spark, sf))
    return scores.select("split_no", F.round("f1", 6).alias("f1"), F.round("accuracy", 6).alias("accuracy"))


@query("score_mean_variance", """
    SELECT round(avg(f1), 6) AS f1_mean, round(var_pop(f1), 6) AS f1_var,
           round(avg(accuracy), 6) AS acc_mean, round(var_pop(accuracy), 6) AS acc_var FROM scores""",
    ("scores",))
def score_mean_variance(spark, sf):
    table = S.mean_variance(S.split_scores(predictions(spark, sf)))
    return table.select(*[F.round(c, 6).alias(c) for c in table.columns])


cte("class_scores", """
    SELECT CAST(c AS VARCHAR) AS row, coalesce(tp / nullif(predicted, 0), 0.0) AS precision,
           coalesce(tp / nullif(support, 0), 0.0) AS recall,
           coalesce(2.0 * tp / nullif(support + predicted, 0), 0.0) AS f1, support
    FROM (SELECT c, sum(CASE WHEN label = c AND prediction = c THEN 1 ELSE 0 END) AS tp,
                 sum(CASE WHEN prediction = c THEN 1 ELSE 0 END) AS predicted,
                 sum(CASE WHEN label = c THEN 1 ELSE 0 END) AS support
          FROM predictions, (VALUES (0), (1)) v(c) GROUP BY c)""", "predictions")


@query("classification_report", """
    SELECT row, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1,
           CAST(support AS BIGINT) AS support FROM (
        SELECT row, precision, recall, f1, support FROM class_scores
        UNION ALL SELECT 'accuracy', NULL, NULL,
            (SELECT avg(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END) FROM predictions),
            (SELECT count(*) FROM predictions)
        UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM class_scores
        UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support),
            sum(recall * support) / sum(support), sum(f1 * support) / sum(support), sum(support)
            FROM class_scores)""", ("class_scores",))
def classification_report(spark, sf):
    table = S.classification_report(predictions(spark, sf))
    numbers = ("precision", "recall", "f1")
    return table.select("row", *[F.round(c, 6).alias(c) for c in numbers], "support")


cte("named_results", f"SELECT *, {DISPLAY_SQL} AS features FROM results", "results")


def named_results(spark, sf):
    return X.results(spark, sf).withColumn("features", N.feature_name(F.col("filename")))


@query("mean_by_group", r"""
    SELECT CAST(split_part(features, '-', 1) AS INTEGER) AS dims,
           regexp_extract(features, '\((\w+)\)', 1) AS method, model, round(avg(f1), 6) AS mean_f1
    FROM named_results WHERE starts_with(filename, 'word_embeddings')
    GROUP BY GROUPING SETS ((dims, method), (model))""", ("named_results",))
def mean_by_group(spark, sf):
    named = P.file_names(named_results(spark, sf), startswith="word_embeddings").select(
        N.display_dims(F.col("features")).alias("dims"),
        N.display_method(F.col("features")).alias("method"), "model", "f1")
    by_set = R.mean_by_group(named, ["dims", "method"])
    by_model = R.mean_by_group(named, ["model"])
    return by_set.unionByName(by_model, allowMissingColumns=True).withColumn(
        "mean_f1", F.round("mean_f1", 6))


@query("pivot_scores", """
    SELECT features, round(max(CASE WHEN model = 'Random Forest' THEN f1 END), 2) AS random_forest,
           round(max(CASE WHEN model = 'Logistic Regression' THEN f1 END), 2) AS logistic_regression,
           round(max(CASE WHEN model = 'Neural Network' THEN f1 END), 2) AS neural_network
    FROM named_results GROUP BY features""", ("named_results",))
def pivot_scores(spark, sf):
    return R.pivot_scores(named_results(spark, sf), "features", R.MODELS)


@query("distinct_errors", "SELECT label, doc_id FROM errors", ("errors",))
def distinct_errors(spark, sf):
    return E.misclassified(predictions(spark, sf))


cte("report", """
    SELECT label, variant, row_number() OVER w - 1 AS seq,
           CAST(coalesce(sum(length(section)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
                AS BIGINT) AS start, section
    FROM (SELECT e.label, d.variant, d.doc_id, 'post_' || d.doc_id || ':' || chr(10) || d.text
                 || chr(10) || chr(10) || repeat('-', 38) || chr(10) AS section
          FROM errors e JOIN document_variants d USING (doc_id))
    WINDOW w AS (PARTITION BY label, variant ORDER BY doc_id)""", "errors", "document_variants")


@query("concat_error_report", "SELECT label, variant, seq, start, md5(section) AS digest FROM report", ("report",))
def concat_error_report(spark, sf):
    docs = error_variants(spark, sf, E.misclassified(predictions(spark, sf)))
    named = docs.withColumn("name", F.concat(F.lit("post_"), F.col("doc_id").cast("string")))
    return E.error_report(named).select("label", "variant", "seq", "start", F.md5("section").alias("digest"))


@query("error_counts", "SELECT label, count(*) AS n_errors FROM errors GROUP BY label", ("errors",))
def error_counts(spark, sf):
    return E.error_counts(E.misclassified(predictions(spark, sf)))
