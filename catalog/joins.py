"""Joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import fixtures as X
from catalog.filters import TOPIC_SQL, topic
from catalog.registry import cte, query
from textlab.functions import text as T
from textlab.functions import vectors as V
from textlab.operators import cohort as C
from textlab.operators import errors as E
from textlab.operators import lexicon as L
from textlab.operators import phrases as P
from textlab.operators import report as R
from textlab.operators import vectors as W
from textlab.operators.lsh import approximate_neighbours
from textlab.operators.neighbours import nearest_neighbours
from textlab.operators.sampling import holdout_splits
from textlab.operators.scoring import centroid_predictions
from textlab.plans.features import variant_features, with_variants

LSH_BUCKET = 256  # rows of a bucket, for tables of a few thousand rows


cte("variant_docs", """
    SELECT doc_id, label, 'original' AS variant, text FROM corpus
    UNION ALL SELECT doc_id, label, 'masked', text FROM masked""", "corpus", "masked")
cte("variant_words", """
    SELECT doc_id, label, variant, unnest(string_split(lower(
        regexp_replace(text, '[^a-zA-Z]+', ' ', 'g')), ' ')) AS word FROM variant_docs""", "variant_docs")
cte("variant_means", """
    SELECT v.doc_id, v.label, v.variant, i,
           round(sum(w.n * k.vector[i]) / sum(w.n), 12) AS value
    FROM variant_docs v JOIN (SELECT doc_id, variant, word, count(*) AS n FROM variant_words
                              GROUP BY ALL) w ON w.doc_id = v.doc_id AND w.variant = v.variant
    JOIN lookup k ON k.word = w.word AND k.vector IS NOT NULL, dims
    GROUP BY ALL""", "variant_docs", "variant_words", "lookup", "dims")
cte("variant_features", """
    SELECT v.doc_id, v.label, v.variant, d.i, coalesce(m.value, 0.0) AS value
    FROM (SELECT doc_id, label, variant FROM variant_docs) v CROSS JOIN dims d
    LEFT JOIN variant_means m ON m.doc_id = v.doc_id AND m.variant = v.variant AND m.i = d.i""",
    "variant_docs", "dims", "variant_means")


def variants(spark, sf):
    return variant_features(X.corpus(spark, sf), X.TERMS, X.lookup(spark, sf), X.DIMS)


@query("join_variants", """
    SELECT a.doc_id, a.label, round(sum((a.value - b.value) * (a.value - b.value)), 6) AS shift
    FROM variant_features a JOIN variant_features b ON a.doc_id = b.doc_id AND a.i = b.i
    WHERE a.variant = 'masked' AND b.variant = 'original' GROUP BY a.doc_id, a.label""",
    ("variant_features",))
def join_variants(spark, sf):
    """Masked and original features of the same document, and how far apart they lie."""
    both = variants(spark, sf)
    masked = both.where("variant = 'masked'").select("doc_id", "label", F.col("vector").alias("a"))
    original = both.where("variant = 'original'").select("doc_id", F.col("vector").alias("b"))
    shift = V.squared_distance(F.col("a"), F.col("b"))
    return masked.join(original, "doc_id").select("doc_id", "label", F.round(shift, 6).alias("shift"))


@query("join_token_vectors", """
    SELECT t.doc_id, count(*) AS n_known, round(sum(v.vector[1]), 6) + 0.0 AS first_sum
    FROM letter_words t JOIN word_vectors v ON v.word = t.word GROUP BY t.doc_id""",
    ("letter_words", "word_vectors"))
def join_token_vectors(spark, sf):
    # Words are counted where a document is read: a row for each word of it moves, not one for each token.
    counted = W.document_tokens(X.documents(spark, sf)).groupBy("doc_id", "word").agg(F.count(F.lit(1)).alias("n"))
    known = W.token_vectors(counted, X.word_vectors(spark, sf))
    return known.groupBy("doc_id").agg(
        F.sum("n").alias("n_known"), F.round(F.sum(F.col("n") * F.get("vector", F.lit(0))), 6).alias("first_sum"))


@query("join_token_lemma", """
    SELECT coalesce(l.lemma, t.word) AS word, count(*) AS n
    FROM letter_words t JOIN word_vectors v ON v.word = t.word LEFT JOIN lemmas l ON l.word = t.word
    GROUP BY 1""", ("letter_words", "word_vectors", "lemmas"))
def join_token_lemma(spark, sf):
    # A word is looked up once, however often it occurs.
    counted = W.document_tokens(X.documents(spark, sf)).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    known = W.known_tokens(counted, X.word_vectors(spark, sf))
    return W.lemmatize(known, X.lemmas(spark, sf)).groupBy("word").agg(F.sum("n").alias("n"))


@query("anti_join_seen_authors", """
    SELECT doc_id, sha1(author) AS author_key FROM posts WHERE author IS NOT NULL
        AND sha1(author) NOT IN (SELECT author_key FROM seen)""", ("posts", "seen"))
def anti_join_seen_authors(spark, sf):
    posts = X.posts(spark, sf).where("author IS NOT NULL")
    return C.exclude_authors(posts, X.seen_authors(spark, sf)).select("doc_id", "author_key")


@query("anti_join_existing_text", """
    SELECT min(doc_id) AS doc_id FROM documents WHERE text NOT IN (SELECT text FROM existing)
    GROUP BY text""", ("existing",))
def anti_join_existing_text(spark, sf):
    return C.drop_known_texts(X.documents(spark, sf), X.existing_texts(spark, sf), ["doc_id"]).select("doc_id")


cte("index_events", """
    SELECT author, ts AS index_ts, doc_id AS index_doc FROM history WHERE doc_id IN (SELECT doc_id FROM near)
    QUALIFY row_number() OVER (PARTITION BY author ORDER BY ts, doc_id) = 1""", "history", "near")


@query("semi_join_indexed_authors", """
    SELECT doc_id, author FROM history WHERE author IN (SELECT author FROM index_events)""",
    ("history", "index_events"))
def semi_join_indexed_authors(spark, sf):
    posts = X.history(spark, sf)
    events = C.first_index_event(posts, X.near_predicate())
    return C.indexed_authors(posts, events).select("doc_id", "author")


@query("not_exists_topic_authors", f"""
    SELECT doc_id, author FROM history
    WHERE author NOT IN (SELECT author FROM history WHERE {TOPIC_SQL})""", ("history",))
def not_exists_topic_authors(spark, sf):
    posts = X.history(spark, sf)
    return C.exclude_topic_authors(posts, posts, topic()).select("doc_id", "author")


cte("in_window", """
    SELECT h.*, e.index_ts, e.index_doc FROM history h JOIN index_events e ON e.author = h.author
    WHERE (h.ts > e.index_ts OR (h.ts = e.index_ts AND h.doc_id >= e.index_doc))
      AND h.ts <= e.index_ts + INTERVAL 7 DAYS""", "history", "index_events")


@query("join_index_window", "SELECT doc_id, author, index_doc FROM in_window", ("in_window",))
def join_index_window(spark, sf):
    posts = X.history(spark, sf)
    events = C.first_index_event(posts, X.near_predicate())
    return C.window_after(posts, events, X.HORIZON_DAYS).select("doc_id", "author", "index_doc")


@query("theta_join_text_terms", """
    SELECT doc_id, term, CAST((length(t) - length(replace(t, term, ''))) // length(term) AS INTEGER) AS n
    FROM (SELECT doc_id, lower(text) AS t FROM documents),
         (VALUES ('and the'), ('and the by'), ('the by'), ('of the'), ('with')) v(term)
    WHERE contains(t, term)""")
def theta_join_text_terms(spark, sf):
    return L.term_pairs(X.documents(spark, sf), X.TERMS)


cte("minority", "SELECT row_id, vector FROM features WHERE label = 1", "features")
cte("neighbours", """
    SELECT a.row_id, b.row_id AS neighbour, round(list_distance(a.vector, b.vector), 9) AS distance,
           row_number() OVER (PARTITION BY a.row_id
               ORDER BY round(list_distance(a.vector, b.vector), 9), b.row_id) AS rank
    FROM minority a JOIN minority b ON a.row_id <> b.row_id
    QUALIFY rank <= 5""", "minority")


@query("knn_self_join", """
    SELECT row_id, CAST(rank AS INTEGER) AS rank, neighbour, round(distance, 6) AS distance
    FROM neighbours""", ("neighbours",))
def knn_self_join(spark, sf):
    minority = X.features(spark, sf).where("label = 1")
    return nearest_neighbours(minority, 5).withColumn("distance", F.round("distance", 6))


@query("join_params_features", """
    SELECT filename, model, dense_rank() OVER (ORDER BY first) - 1 AS file_order
    FROM (SELECT filename, model, min(recorded) OVER (PARTITION BY filename) AS first FROM results)""",
    ("results",))
def join_params_features(spark, sf):
    joined = R.parameters_by_file(X.results(spark, sf), X.feature_sets(spark, sf))
    return joined.select("filename", "model", "file_order")


@query("join_params_feature_rows", """
    SELECT r.filename, r.model, CAST(min(e.dims) AS INTEGER) AS dims, count(DISTINCT e.doc_id) AS n_rows,
           CAST(sum(CASE WHEN e.i = 1 THEN e.label ELSE 0 END) AS BIGINT) AS n_positive,
           round(sum(CASE WHEN e.i = 1 THEN e.value END), 6) + 0.0 AS first_sum,
           round(sum(CASE WHEN e.i = e.dims THEN e.value END), 6) + 0.0 AS last_sum
    FROM results r JOIN file_edges e USING (filename) GROUP BY r.filename, r.model""", ("results", "file_edges"))
def join_params_feature_rows(spark, sf):
    """Recorded classifiers with the rows of their feature files; only recorded files are read."""
    recorded = X.results(spark, sf).select("filename", "model")
    joined = X.features_by_file(spark, sf).join(recorded, "filename")
    size = F.size("vector")
    ends = F.sum(F.get("vector", F.lit(0))), F.sum(F.element_at("vector", -1))
    return joined.groupBy("filename", "model").agg(
        F.min(size).alias("dims"), F.count(F.lit(1)).alias("n_rows"), F.sum("label").alias("n_positive"),
        *[F.round(e, 6).alias(n) for e, n in zip(ends, ("first_sum", "last_sum"))])


# Long lists of phrases, as tables: words of the benchmark, and neighbouring words there.
cte("listed_words", r"""
    SELECT DISTINCT word AS term FROM (
        SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM benchmark) WHERE length(word) >= 4""")
cte("listed_pairs", r"""
    SELECT DISTINCT words[i] || ' ' || words[i + 1] AS term FROM (
        SELECT words, unnest(range(1, len(words))) AS i
        FROM (SELECT regexp_extract_all(lower(text), '[a-z]+') AS words FROM benchmark))""")


def listed_words(spark, sf):
    words = F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("term")
    return X.table(spark, sf, "benchmark").select(words).where(F.length("term") >= 4).distinct()


def listed_pairs(spark, sf):
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))
    pairs = F.zip_with(F.slice("w", F.lit(1), F.greatest(F.size("w") - 1, F.lit(0))), F.slice("w", F.lit(2), F.size("w")),
                       lambda a, b: F.concat_ws(" ", a, b))
    return X.table(spark, sf, "benchmark").select(words.alias("w")).select(F.explode(pairs).alias("term")).distinct()


@query("theta_join_term_table", """
    SELECT doc_id, term, CAST((length(t) - length(replace(t, term, ''))) // length(term) AS INTEGER) AS n
    FROM (SELECT doc_id, lower(text) AS t FROM documents), listed_words WHERE contains(t, term)""", ("listed_words",))
def theta_join_term_table(spark, sf):
    """Document-term pairs for every term of a table, in one pass over the texts."""
    return P.occurrences(X.documents(spark, sf), listed_words(spark, sf))


@query("match_any_phrase_table", """
    SELECT doc_id FROM near_text WHERE EXISTS (SELECT 1 FROM listed_pairs WHERE contains(t, term))""",
    ("near_text", "listed_pairs"))
def match_any_phrase_table(spark, sf):
    """Posts with any phrase of a table."""
    text = T.post_text(F.col("title"), F.col("body"))
    posts = X.posts(spark, sf).select("doc_id", text.alias("text"))
    return P.holding_any(posts, listed_pairs(spark, sf)).select("doc_id")


@query("match_near_table", "SELECT doc_id FROM near", ("near",))
def match_near_table(spark, sf):
    """Posts with a condition term near a trigger, the lists being tables."""
    text = T.post_text(F.col("title"), F.col("body"))
    posts = X.posts(spark, sf).select("doc_id", text.alias("text"))
    lists = (spark.createDataFrame([(x,) for x in words], "term string") for words in (X.TRIGGERS, X.REJECTS, X.CONDITIONS))
    return P.near_table(posts, *lists)


@query("mask_terms_table", f"""
    SELECT doc_id, length(m) AS n_chars, md5(m) AS digest
    FROM (SELECT doc_id, {X.mask_sql('text')} AS m FROM documents)""")
def mask_terms_table(spark, sf):
    """Documents without the terms of a table."""
    terms = spark.createDataFrame([(t,) for t in X.TERMS], "term string")
    masked = P.mask_with_table(X.documents(spark, sf), terms)
    return masked.select("doc_id", F.length("text").cast("bigint").alias("n_chars"), F.md5("text").alias("digest"))


@query("knn_lsh_join")
def knn_lsh_join(spark, sf):
    """Neighbours of all features by the locality-sensitive index; most of the true ones."""
    found = approximate_neighbours(X.features(spark, sf), 5, bucket_rows=LSH_BUCKET)
    return found.withColumn("distance", F.round("distance", 6))


@query("lsh_recall", """
    SELECT (SELECT 5 * count(*) FROM features) AS n_neighbours, true AS nine_tenths_found""", ("features",))
def lsh_recall(spark, sf):
    """Whether the index finds nine tenths of the neighbours that the exact join finds."""
    points = X.features(spark, sf)
    keys = ["row_id", "neighbour"]
    found = approximate_neighbours(points, 5, bucket_rows=LSH_BUCKET).select(*keys, F.lit(1).alias("hit"))
    both = nearest_neighbours(points, 5).select(*keys).join(found, keys, "left")
    return both.agg(F.count(F.lit(1)).alias("n_neighbours"), (F.avg(F.coalesce("hit", F.lit(0))) >= 0.9).alias("nine_tenths_found"))


cte("splits", """
    SELECT split_no, row_id, CASE WHEN row_number() OVER (PARTITION BY split_no
               ORDER BY md5(split_no || ':' || row_id)) <= ceil(CAST(0.2 AS DOUBLE) * count(*) OVER (PARTITION BY split_no))
           THEN 'test' ELSE 'train' END AS part
    FROM features, (SELECT unnest([1, 2, 3, 4, 5]) AS split_no)""", "features")
cte("feature_cells", "SELECT row_id, label, i, vector[i] AS value FROM features, dims", "features", "dims")
cte("split_centres", """
    SELECT s.split_no, c.label, c.i, sum(c.value) / count(*) AS centre
    FROM feature_cells c JOIN splits s USING (row_id) WHERE s.part = 'train' GROUP BY ALL""",
    "feature_cells", "splits")
cte("predictions", """
    SELECT row_id, split_no, label,
           CASE WHEN sum(CASE WHEN centre_label = 1 THEN d END) < sum(CASE WHEN centre_label = 0 THEN d END)
                THEN 1 ELSE 0 END AS prediction
    FROM (SELECT c.row_id, s.split_no, c.label, k.label AS centre_label,
                 (c.value - k.centre) * (c.value - k.centre) AS d
          FROM feature_cells c JOIN splits s ON s.row_id = c.row_id AND s.part = 'test'
          JOIN split_centres k ON k.split_no = s.split_no AND k.i = c.i)
    GROUP BY ALL""", "feature_cells", "splits", "split_centres")
cte("errors", """
    SELECT DISTINCT label, row_id AS doc_id FROM predictions WHERE prediction <> label""", "predictions")


def predictions(spark, sf):
    features = X.features(spark, sf)
    return centroid_predictions(features, holdout_splits(features), X.DIMS)


def error_variants(spark, sf, errors):
    """Misclassified documents, original and masked; no other document is masked or moved."""
    return E.error_documents(errors, X.documents(spark, sf), lambda docs: with_variants(docs, X.TERMS))


cte("document_variants", f"""
    SELECT doc_id, 'original' AS variant, text FROM documents
    UNION ALL SELECT doc_id, 'masked', {X.mask_sql('text')} FROM documents""")


@query("join_errors_documents", """
    SELECT e.label, e.doc_id, d.variant, md5(d.text) AS digest
    FROM errors e JOIN document_variants d USING (doc_id)""", ("errors", "document_variants"))
def join_errors_documents(spark, sf):
    joined = error_variants(spark, sf, E.misclassified(predictions(spark, sf)))
    return joined.select("label", "doc_id", "variant", F.md5("text").alias("digest"))


@query("cross_join_experiments", """
    SELECT filename, 'train_' || a || '_test_' || b AS experiment, a AS train_variant,
           b AS test_variant, CAST(fold AS INTEGER) AS fold
    FROM feature_sets, (VALUES ('masked'), ('original')) x(a), (VALUES ('masked'), ('original')) y(b),
         (SELECT unnest([0, 1, 2, 3, 4]) AS fold)""", ("feature_sets",))
def cross_join_experiments(spark, sf):
    return R.experiment_grid(X.feature_sets(spark, sf))


