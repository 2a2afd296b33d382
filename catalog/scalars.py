"""Scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import fixtures as X
from catalog.aggregates import alnum_sql, named_results
from catalog.filters import DISPLAY_SQL
from catalog.registry import query
from textlab.functions import hashing as H
from textlab.functions import names as N
from textlab.functions import text as T
from textlab.functions import vectors as V
from textlab.operators.cohort import index_window
from textlab.operators.explode import exploded


@query("mask_terms", f"""
    SELECT doc_id, length(m) AS n_chars, md5(m) AS digest
    FROM (SELECT doc_id, {X.mask_sql('text')} AS m FROM documents)""")
def mask_terms(spark, sf):
    masked = T.mask_terms(F.col("text"), X.TERMS)
    return X.documents(spark, sf).select("doc_id", masked.alias("m")).select(
        "doc_id", F.length("m").cast("bigint").alias("n_chars"), F.md5("m").alias("digest"))


@query("letters_only_tokens", """
    SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS tokens FROM letter_words GROUP BY doc_id""",
    ("letter_words",))
def letters_only_tokens(spark, sf):
    tokens = F.concat_ws(" ", T.letters_tokens(F.col("text")))
    return X.documents(spark, sf).select("doc_id", tokens.alias("tokens")).where("tokens <> ''")


@query("filter_vocabulary", """
    SELECT doc_id, CAST(pos AS INTEGER) AS pos, word FROM letter_words
    WHERE word IN (SELECT word FROM word_vectors)""", ("letter_words", "word_vectors"))
def filter_vocabulary(spark, sf):
    from textlab.operators.vectors import document_tokens, known_tokens

    tokens = document_tokens(X.documents(spark, sf))
    return known_tokens(tokens, X.word_vectors(spark, sf)).select("doc_id", "pos", "word")


@query("tokenize_alnum", f"""
    SELECT doc_id, array_to_string({alnum_sql('text')}, ' ') AS tokens FROM documents""")
def tokenize_alnum(spark, sf):
    tokens = F.concat_ws(" ", T.alnum_tokens(F.col("text"), X.STOP_WORDS))
    return X.documents(spark, sf).select("doc_id", tokens.alias("tokens"))


@query("vectorizer_tokens", f"""
    SELECT doc_id, array_to_string(list_filter({alnum_sql('text')}, lambda w: length(w) >= 2), ' ') AS tokens
    FROM documents""")
def vectorizer_tokens(spark, sf):
    tokens = T.vectorizer_tokens(T.alnum_tokens(F.col("text"), X.STOP_WORDS))
    return X.documents(spark, sf).select("doc_id", F.concat_ws(" ", tokens).alias("tokens"))


@query("word_count", r"""
    SELECT doc_id, CAST(len(list_filter(regexp_split_to_array(text, '[\t-\r\x1C-\x20\x{85}\p{Z}]+'),
        lambda w: w <> '')) AS INTEGER) AS n_words FROM documents""")
def word_count(spark, sf):
    return X.documents(spark, sf).select("doc_id", T.word_count(F.col("text")).alias("n_words"))


@query("chunk_words", """
    SELECT doc_id, CAST(chunk AS INTEGER) AS chunk, md5(text) AS digest FROM chunks""", ("chunks",))
def chunk_words(spark, sf):
    from textlab.operators.vectors import chunk_table

    return chunk_table(X.documents(spark, sf)).select("doc_id", "chunk", F.md5("text").alias("digest"))


@query("hash_author", "SELECT DISTINCT author, sha1(author) AS author_key FROM posts WHERE author IS NOT NULL",
       ("posts",))
def hash_author(spark, sf):
    authors = X.posts(spark, sf).where("author IS NOT NULL").select("author").distinct()
    return authors.select("author", H.hash_author(F.col("author")).alias("author_key"))


@query("index_window_bounds", """
    SELECT doc_id, s AS start_s, s + 365 * 86400 AS end_s
    FROM (SELECT doc_id, CAST(floor(epoch(ts)) AS BIGINT) AS s FROM posts)""", ("posts",))
def index_window_bounds(spark, sf):
    """Epoch seconds to a timestamp, and the end of its window."""
    seconds = F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")
    start = F.timestamp_seconds(seconds)
    return X.posts(spark, sf).select(
        "doc_id", F.unix_seconds(start).alias("start_s"), F.unix_seconds(index_window(start)).alias("end_s"))


@query("context_window", r"""
    SELECT doc_id, phrase, CAST(p AS INTEGER) AS place,
           regexp_replace(substr(t, greatest(p - 80, 1), p + 80 - greatest(p - 80, 1)), '[^\p{L}]', ' ', 'g') AS context
    FROM (SELECT doc_id, t, phrase, unnest(list_transform(range(0, len(parts) - 1), lambda i: CAST(1 + i * length(phrase)
              + list_sum(list_transform(parts[1:i + 1], lambda x: length(x))) AS BIGINT))) AS p
          FROM (SELECT doc_id, t, phrase, string_split(t, phrase) AS parts
                FROM near_text, (VALUES ('and the'), ('of the')) x(phrase)))""", ("near_text",))
def context_window(spark, sf):
    """The context of every occurrence of every trigger phrase."""
    posts = X.posts(spark, sf).select("doc_id", T.post_text(F.col("title"), F.col("body")).alias("t"))
    found = F.flatten(F.array(*[
        F.transform(T.phrase_positions(F.col("t"), phrase), lambda p: F.struct(F.lit(phrase).alias("phrase"), p.alias("place")))
        for phrase in X.TRIGGERS
    ]))
    return exploded(posts, ["doc_id", "t"], found, "f").select(
        "doc_id", "f.phrase", "f.place", T.context_window(F.col("t"), F.col("f.place")).alias("context"))


@query("cosine_similarity", """
    SELECT w.word, l.lemma, round(list_cosine_similarity(w.vector, v.vector), 6) AS similarity
    FROM lemmas l JOIN word_vectors w ON w.word = l.word JOIN word_vectors v ON v.word = l.lemma""",
    ("word_vectors", "lemmas"))
def cosine_similarity(spark, sf):
    """Similarity of every word to its lemma."""
    words = X.word_vectors(spark, sf)
    other = words.select(F.col("word").alias("lemma"), F.col("vector").alias("b"))
    pairs = X.lemmas(spark, sf).join(words, "word").join(other, "lemma")
    return pairs.select("word", "lemma", F.round(V.cosine(F.col("vector"), F.col("b")), 6).alias("similarity"))


@query("vector_arith", """
    SELECT w.word, i - 1 AS dim, round((w.vector[i] + v.vector[i]) * 0.5, 6) + 0.0 AS value
    FROM lemmas l JOIN word_vectors w ON w.word = l.word JOIN word_vectors v ON v.word = l.lemma, dims""",
    ("word_vectors", "lemmas", "dims"))
def vector_arith(spark, sf):
    words = X.word_vectors(spark, sf)
    other = words.select(F.col("word").alias("lemma"), F.col("vector").alias("b"))
    pairs = X.lemmas(spark, sf).join(words, "word").join(other, "lemma")
    middle = V.scale(V.add(F.col("vector"), F.col("b")), 0.5)
    return pairs.select("word", F.posexplode(middle).alias("dim", "value")).select(
        "word", F.col("dim").cast("bigint").alias("dim"), F.round("value", 6).alias("value"))


@query("parse_percent", """
    SELECT filename, model, printf('%.2f%%', f1) AS text,
           CAST(rtrim(printf('%.2f%%', f1), '%') AS DOUBLE) AS value FROM results""", ("results",))
def parse_percent(spark, sf):
    text = N.format_percent(F.col("f1"))
    return X.results(spark, sf).select("filename", "model", text.alias("text")).withColumn(
        "value", N.parse_percent(F.col("text")))


@query("feature_name", f"SELECT filename, {DISPLAY_SQL} AS features FROM feature_sets", ("feature_sets",))
def feature_name(spark, sf):
    return X.feature_sets(spark, sf).select("filename", N.feature_name(F.col("filename")).alias("features"))


@query("extract_dims_method", r"""
    SELECT DISTINCT features, CAST(split_part(features, '-', 1) AS INTEGER) AS dims,
           regexp_extract(features, '\((\w+)\)', 1) AS method
    FROM named_results WHERE starts_with(filename, 'word_embeddings')""", ("named_results",))
def extract_dims_method(spark, sf):
    named = named_results(spark, sf).where(F.col("filename").startswith("word_embeddings"))
    name = F.col("features")
    return named.select("features", N.display_dims(name).alias("dims"),
                        N.display_method(name).alias("method")).distinct()


@query("parse_layer_sizes", r"""
    SELECT filename, i - 1 AS layer, CAST(s[i] AS INTEGER) AS units
    FROM (SELECT filename, regexp_extract_all(hidden_layer_sizes, '\d+') AS s FROM results
          WHERE hidden_layer_sizes IS NOT NULL), (SELECT unnest(range(1, 6)) AS i)""", ("results",))
def parse_layer_sizes(spark, sf):
    sizes = N.parse_layer_sizes(F.col("hidden_layer_sizes"))
    return X.results(spark, sf).select("filename", F.posexplode(sizes).alias("layer", "units")).withColumn(
        "layer", F.col("layer").cast("bigint"))


@query("null_to_blank", """
    SELECT filename, model, coalesce(class_weight, '') AS written, class_weight AS restored
    FROM results""", ("results",))
def null_to_blank(spark, sf):
    written = X.results(spark, sf).select(
        "filename", "model", N.null_to_blank(F.col("class_weight")).alias("written"))
    return written.withColumn("restored", N.blank_to_null(F.col("written")))


@query("format_prediction", """
    SELECT doc_id, CASE WHEN quality = 0 THEN 'Positive (1)' ELSE 'Control (0)' END AS label_text,
           printf('%.1f%%', 50 + CAST(doc_id % 500 AS DOUBLE) / 10) AS confidence
    FROM labels""")
def format_prediction(spark, sf):
    labels = X.table(spark, sf, "labels")
    probability = 50 + (F.col("doc_id") % 500) / F.lit(10.0)
    return labels.select(
        "doc_id", N.format_prediction(1 - F.col("quality"), {1: "Positive", 0: "Control"}).alias("label_text"),
        N.format_percent(probability, 1).alias("confidence"))
