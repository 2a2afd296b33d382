"""Window functions, cohorts, sorts, limits and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import fixtures as X
from catalog.filters import DISPLAY_SQL, MEMBERS_SQL, ORDER, TOPIC_SQL, topic
from catalog.registry import cte, query
from textlab.functions import hashing as H
from textlab.operators import cohort as C
from textlab.operators import corpus as K
from textlab.operators import lexicon as L
from textlab.operators import report as R
from textlab.plans.cohorts import control_cohort, positive_cohort
from catalog.aggregates import named_results


@query("history_order", """
    SELECT author, doc_id, row_number() OVER (PARTITION BY author ORDER BY ts, doc_id) AS seq
    FROM history""", ("history",))
def history_order(spark, sf):
    return C.history_order(X.history(spark, sf))


@query("first_index_event", "SELECT author, index_doc FROM index_events", ("index_events",))
def first_index_event(spark, sf):
    return C.first_index_event(X.history(spark, sf), X.near_predicate()).select("author", "index_doc")


@query("top_k_per_author", """
    SELECT author, doc_id, CAST(row_number() OVER (PARTITION BY author
               ORDER BY length(body) DESC, ts, doc_id) AS INTEGER) AS rank
    FROM history QUALIFY rank <= 5""", ("history",))
def top_k_per_author(spark, sf):
    return C.top_k_per_author(X.history(spark, sf)).select("author", "doc_id", "rank")


@query("keep_first_duplicate", """
    SELECT 'author' AS kind, min(doc_id) AS doc_id FROM history GROUP BY author
    UNION ALL SELECT 'text', min(doc_id) FROM documents GROUP BY text""", ("history",))
def keep_first_duplicate(spark, sf):
    authors = C.keep_first(X.history(spark, sf).select("author", "doc_id"), ["author"], ["doc_id"])
    docs = X.documents(spark, sf).select("doc_id", H.text_digest(F.col("text")).alias("digest"), "text")
    texts = C.keep_first(docs, ["digest", "text"], ["doc_id"])
    return authors.select(F.lit("author").alias("kind"), "doc_id").unionByName(
        texts.select(F.lit("text").alias("kind"), "doc_id"))


@query("assign_sequence", """
    SELECT doc_id, (SELECT count(*) FROM existing) + row_number() OVER (ORDER BY ts, doc_id) AS seq
    FROM history""", ("history", "existing"))
def assign_sequence(spark, sf):
    base = X.existing_texts(spark, sf).distinct().count()
    arrivals = X.history(spark, sf).select("ts", "doc_id")
    return C.assign_sequence(arrivals, ["ts", "doc_id"], base).select("doc_id", "seq")


cte("seed_authors", """
    SELECT author, min(doc_id) AS arrival FROM posts
    WHERE author IS NOT NULL AND lang IN ('en', 'fr') AND sha1(author) NOT IN (SELECT author_key FROM seen)
    GROUP BY author""", "posts", "seen")
cte("cohort_events", """
    SELECT * FROM index_events WHERE author IN (SELECT author FROM seed_authors)""",
    "index_events", "seed_authors")
cte("cohort_top", f"""
    SELECT w.*, s.arrival, row_number() OVER (PARTITION BY w.author
               ORDER BY length(body) DESC, ts, doc_id) AS rank
    FROM in_window w JOIN seed_authors s ON s.author = w.author
    WHERE community IN ({MEMBERS_SQL}) AND length(body) >= 60 QUALIFY rank <= 5""",
    "in_window", "seed_authors")
cte("cohort_docs", """
    SELECT author, arrival, ts, doc_id, title || chr(10) || body AS text,
           CASE WHEN count(*) OVER (PARTITION BY author) >= 5 THEN rank ELSE 0 END AS place
    FROM cohort_top""", "cohort_top")
cte("cohort_first", """
    SELECT * FROM cohort_docs
    QUALIFY row_number() OVER (PARTITION BY text ORDER BY arrival, place, ts, doc_id) = 1""", "cohort_docs")


def seeds(spark, sf):
    return X.posts(spark, sf).where("lang IN ('en', 'fr')").select(
        "author", F.col("doc_id").alias("arrival"))


@query("cohort_positive", """
    SELECT row_number() OVER (ORDER BY arrival, place, ts, doc_id) AS seq, doc_id, author, md5(text) AS digest
    FROM cohort_first WHERE text NOT IN (SELECT text FROM existing)""", ("cohort_first", "existing"))
def cohort_positive(spark, sf):
    cohort = positive_cohort(
        X.posts(spark, sf), seeds(spark, sf), X.seen_authors(spark, sf), X.existing_texts(spark, sf),
        X.near_predicate(), X.MEMBERS, X.HORIZON_DAYS)
    return cohort.select("seq", "doc_id", "author", F.md5("text").alias("digest"))


cte("control_first", """
    SELECT author, doc_id, title || chr(10) || body AS text FROM posts
    WHERE author IS NOT NULL AND lang = 'en' AND length(body) >= 60
      AND sha1(author) NOT IN (SELECT author_key FROM seen)
    QUALIFY row_number() OVER (PARTITION BY author ORDER BY doc_id) = 1""", "posts", "seen")
cte("control_docs", f"""
    SELECT * FROM control_first
    WHERE author NOT IN (SELECT author FROM history WHERE {TOPIC_SQL})
    QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1""", "control_first", "history")


@query("cohort_control", """
    SELECT row_number() OVER (ORDER BY doc_id) AS seq, doc_id, author, md5(text) AS digest
    FROM control_docs WHERE text NOT IN (SELECT text FROM existing)""", ("control_docs", "existing"))
def cohort_control(spark, sf):
    posts = X.posts(spark, sf)
    starts = posts.where("lang = 'en'").withColumn("arrival", F.col("doc_id"))
    cohort = control_cohort(posts, starts, X.seen_authors(spark, sf), X.existing_texts(spark, sf), topic())
    return cohort.select("seq", "doc_id", "author", F.md5("text").alias("digest"))


@query("limit_recent", """
    SELECT 'recent' AS kind, doc_id FROM history
    QUALIFY row_number() OVER (PARTITION BY author ORDER BY ts DESC, doc_id DESC) <= 3
    UNION ALL (SELECT 'seed', doc_id FROM posts ORDER BY doc_id LIMIT 100)""", ("posts", "history"))
def limit_recent(spark, sf):
    recent = C.recent_posts(X.history(spark, sf).select("author", "ts", "doc_id"), 3)
    arrivals = X.posts(spark, sf).withColumn("arrival", F.col("doc_id"))
    first = C.first_seeds(arrivals.select("doc_id", "arrival"), 100)
    return recent.select(F.lit("recent").alias("kind"), "doc_id").unionByName(
        first.select(F.lit("seed").alias("kind"), "doc_id"))


@query("argmax_score", """
    SELECT filename, model, f1, accuracy FROM results ORDER BY f1 DESC, recorded LIMIT 1""", ("results",))
def argmax_score(spark, sf):
    return R.best_row(X.results(spark, sf), "f1", ["recorded"]).select("filename", "model", "f1", "accuracy")


@query("custom_order", f"""
    SELECT CAST(o.seq AS INTEGER) AS seq, o.features, n.f1 FROM (VALUES (0, '200-D (average)'),
        (1, 'All MiniLM L6 v2'), (2, 'All MPNet base v2'), (3, 'GTR T5 base'), (4, 'Sentence T5 base'),
        (5, 'not recorded')) o(seq, features)
    LEFT JOIN (SELECT {DISPLAY_SQL} AS features, f1 FROM results WHERE model = 'Random Forest') n
        ON n.features = o.features""", ("results",))
def custom_order(spark, sf):
    named = named_results(spark, sf).where("model = 'Random Forest'").select("features", "f1")
    return R.custom_order(named, "features", [*ORDER, "not recorded"])


@query("numeric_suffix_sort", """
    SELECT 'post_' || doc_id AS name, doc_id AS n, row_number() OVER (ORDER BY doc_id) - 1 AS seq
    FROM documents""")
def numeric_suffix_sort(spark, sf):
    return R.number_order(X.documents(spark, sf).select(
        F.concat(F.lit("post_"), F.col("doc_id").cast("string")).alias("name")))


@query("union_labelled", """
    SELECT doc_id, 1 AS label FROM documents WHERE lang = 'en'
    UNION ALL SELECT doc_id, 0 FROM documents WHERE lang <> 'en'""")
def union_labelled(spark, sf):
    docs = X.table(spark, sf, "documents").select("doc_id", "lang")
    return K.union_labelled(docs.where("lang = 'en'"), docs.where("lang <> 'en'")).select("doc_id", "label")


@query("union_distinct_terms", """
    SELECT term FROM (SELECT unnest(string_split(lower(title), ' ')) AS term FROM posts
        UNION SELECT community FROM posts UNION SELECT lang FROM posts) WHERE term <> ''""", ("posts",))
def union_distinct_terms(spark, sf):
    posts = X.posts(spark, sf)
    words = posts.select(F.explode(F.split(F.lower("title"), " ")).alias("term")).where("term <> ''")
    return L.union_terms(words, posts.select(F.col("community").alias("term")),
                         posts.select(F.col("lang").alias("term")))


@query("union_ragged_results", """
    SELECT filename, model, n_estimators, max_features, c, penalty, hidden_layer_sizes, batch_size
    FROM results""", ("results",))
def union_ragged_results(spark, sf):
    rows = X.results(spark, sf)
    parts = [
        rows.where(F.col("model") == model).select("filename", "model", *columns)
        for model, columns in (
            ("Random Forest", ["n_estimators", "max_features"]),
            ("Logistic Regression", ["c", "penalty"]),
            ("Neural Network", ["hidden_layer_sizes", "batch_size"]),
        )
    ]
    return R.union_results(*parts)


