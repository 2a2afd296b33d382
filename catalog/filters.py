"""Filters, predicates and projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import fixtures as X
from catalog.registry import query
from textlab.functions import names as N
from textlab.functions import text as T
from textlab.operators import filters as P
from textlab.operators.sampling import smote

MEMBERS_SQL = ", ".join(f"'{m}'" for m in X.MEMBERS)
TOPIC_SQL = (
    "(community IN ('src3') OR contains(lower(title) || ' ' || lower(body), 'with the by') "
    "OR contains(lower(title) || ' ' || lower(body), 'that is of'))"
)
ANY_PHRASES = ["and the by", "the that with", "of the in"]


def topic():
    return P.mentions_topic(F.col("community"), T.post_text(F.col("title"), F.col("body")),
                            X.TOPIC_MEMBERS, X.TOPIC_PATTERNS)


@query("filter_has_author", "SELECT doc_id, author FROM posts WHERE author IS NOT NULL", ("posts",))
def filter_has_author(spark, sf):
    return P.has_author(X.posts(spark, sf)).select("doc_id", "author")


@query("filter_text_posts", """
    SELECT doc_id, author, community, title, md5(body) AS body FROM posts WHERE body <> ''""", ("posts",))
def filter_text_posts(spark, sf):
    return P.text_posts(X.posts(spark, sf)).select(
        "doc_id", "author", "community", "title", F.md5("body").alias("body"))


@query("filter_min_length", "SELECT doc_id FROM posts WHERE length(body) >= 60", ("posts",))
def filter_min_length(spark, sf):
    return P.min_length(X.posts(spark, sf), 60).select("doc_id")


@query("filter_member", f"SELECT doc_id, community FROM posts WHERE community IN ({MEMBERS_SQL})", ("posts",))
def filter_member(spark, sf):
    member = P.is_member(F.col("community"), [m.upper() for m in X.MEMBERS])
    return X.posts(spark, sf).where(member).select("doc_id", "community")


@query("match_any_phrase", """
    SELECT doc_id FROM near_text WHERE contains(t, 'and the by') OR contains(t, 'the that with')
        OR contains(t, 'of the in')""", ("near_text",))
def match_any_phrase(spark, sf):
    text = T.post_text(F.col("title"), F.col("body"))
    return X.posts(spark, sf).where(T.match_any(text, ANY_PHRASES)).select("doc_id")


@query("match_phrase_near_term", "SELECT doc_id FROM near", ("near",))
def match_phrase_near_term(spark, sf):
    return X.posts(spark, sf).where(X.near_predicate()).select("doc_id")


@query("flag_topic_mention", f"SELECT doc_id, CAST({TOPIC_SQL} AS INTEGER) AS mentions FROM posts", ("posts",))
def flag_topic_mention(spark, sf):
    return X.posts(spark, sf).select("doc_id", topic().cast("int").alias("mentions"))


@query("filter_file_pattern", """
    SELECT filename FROM feature_sets WHERE starts_with(filename, 'word_embeddings')
        AND contains(filename, 'average') AND ends_with(filename, '.csv')""", ("feature_sets",))
def filter_file_pattern(spark, sf):
    return P.file_names(X.feature_sets(spark, sf), contains="average",
                        startswith="word_embeddings", endswith=".csv")


# The display names of a results chart, in its order.
ORDER = ["200-D (average)", "All MiniLM L6 v2", "All MPNet base v2", "GTR T5 base", "Sentence T5 base"]
DISPLAY_SQL = """
    CASE WHEN starts_with(split_part(filename, '/', 2), 'word_embeddings')
         THEN split_part(filename, '_', 4) || '-D ('
              || replace(split_part(filename, '_', 5), '.csv', '') || ')'
         WHEN contains(filename, 'all_minilm_l6_v2') THEN 'All MiniLM L6 v2'
         WHEN contains(filename, 'all_mpnet_base_v2') THEN 'All MPNet base v2'
         WHEN contains(filename, 'gtr_t5_base') THEN 'GTR T5 base'
         WHEN contains(filename, 'sentence_t5_base') THEN 'Sentence T5 base' END"""


@query("filter_isin_ordered", f"""
    SELECT * FROM (SELECT filename, model, {DISPLAY_SQL} AS features FROM results)
    WHERE features IN ('200-D (average)', 'All MiniLM L6 v2', 'All MPNet base v2', 'GTR T5 base',
                       'Sentence T5 base') AND model = 'Random Forest'""", ("results",))
def filter_isin_ordered(spark, sf):
    named = X.results(spark, sf).select("filename", "model", N.feature_name(F.col("filename")).alias("features"))
    return named.where(F.col("features").isin(ORDER) & (F.col("model") == "Random Forest"))


@query("project_document", "SELECT doc_id, md5(title || chr(10) || body) AS digest FROM posts", ("posts",))
def project_document(spark, sf):
    text = T.document_text(F.col("title"), F.col("body"))
    return X.posts(spark, sf).select("doc_id", F.md5(text).alias("digest"))


@query("filter_original_rows", "SELECT row_id, label FROM features", ("features",))
def filter_original_rows(spark, sf):
    return P.original_rows(smote(X.features(spark, sf))).select("row_id", "label")


@query("filter_blank_input", r"""
    SELECT doc_id FROM posts WHERE length(regexp_replace(body, '\s+', '', 'g')) > 0""", ("posts",))
def filter_blank_input(spark, sf):
    return P.non_blank(X.posts(spark, sf), "body").select("doc_id")
