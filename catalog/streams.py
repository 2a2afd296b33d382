"""The streaming form of prediction."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import fixtures as X
from catalog.joins import variants
from catalog.learning import masked_bundle
from catalog.registry import cte, query
from textlab.operators.scoring import centroids, class_sums, nearest
from textlab.plans.predict import embed_texts, predict
from textlab.session import scratch_path, written
from textlab.sources.bundles import load_bundle, save_bundle
from textlab.streaming.scoring import first_arrivals, mask_and_score_stream, stream_documents

cte("all_masked_words", """
    SELECT doc_id, unnest(string_split(lower(regexp_replace(text, '[^a-zA-Z]+', ' ', 'g')), ' ')) AS word
    FROM document_variants WHERE variant = 'masked'""", "document_variants")
cte("all_masked_means", """
    SELECT doc_id, i, sum(n * vector[i]) / sum(n) AS value FROM (
        SELECT doc_id, vector, count(*) AS n FROM all_masked_words w
        JOIN lookup k ON k.word = w.word AND k.vector IS NOT NULL GROUP BY doc_id, vector), dims
    GROUP BY doc_id, i""", "all_masked_words", "lookup", "dims")
cte("masked_centres", """
    SELECT label, i, sum(value) / count(*) AS centre FROM variant_features
    WHERE variant = 'masked' GROUP BY label, i""", "variant_features")


@query("stream_mask_score", """
    SELECT doc_id, CASE WHEN sum(CASE WHEN label = 1 THEN d END) < sum(CASE WHEN label = 0 THEN d END)
                        THEN 1 ELSE 0 END AS prediction
    FROM (SELECT v.doc_id, c.label, (coalesce(m.value, 0) - c.centre) * (coalesce(m.value, 0) - c.centre) AS d
          FROM documents v CROSS JOIN masked_centres c
          LEFT JOIN all_masked_means m ON m.doc_id = v.doc_id AND m.i = c.i)
    GROUP BY doc_id""", ("masked_centres", "all_masked_means"))
def stream_mask_score(spark, sf):
    """All documents as a stream of files, scored with centroids of the labelled ones."""
    labelled = variants(spark, sf).where("variant = 'masked'").withColumnRenamed("doc_id", "row_id")
    fitted = written(centroids(class_sums(labelled, [], X.DIMS)), "centroids")
    lookup = X.lookup(spark, sf)

    def score(texts):
        vectors = embed_texts(texts, X.TERMS, lookup, X.DIMS)
        # One row of centroids.
        scored = vectors.join(F.broadcast(fitted), F.lit(True))
        return scored.select("doc_id", nearest(F.col("vector"), F.col("c0"), F.col("c1")).alias("prediction"))

    schema = X.table(spark, sf, "documents").schema
    source = stream_documents(spark, f"{sf}/documents*.parquet", schema)
    sink = scratch_path(spark, "scored")
    stream = mask_and_score_stream(source, score, sink, scratch_path(spark, "stream"))
    stream.awaitTermination()
    return spark.read.parquet(sink).select("doc_id", "prediction")


@query("stream_saved_classifier", """
    SELECT doc_id, true AS same FROM documents
    WHERE trim(text, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') <> ''""")
def stream_saved_classifier(spark, sf):
    """A saved classifier over a stream that is stopped and started again, next to the same over a batch.

    Half of the documents arrive first; then, after a restart, all of them, so that half arrives twice.
    """
    path = scratch_path(spark, "bundle")
    save_bundle(spark, masked_bundle(spark, sf), path)
    bundle, lookup = load_bundle(spark, path), X.lookup(spark, sf)
    docs = X.documents(spark, sf)

    def score(texts):
        return predict(texts, bundle, lambda t: embed_texts(t, X.TERMS, lookup, X.DIMS))

    arriving, sink, log = (scratch_path(spark, n) for n in ("arriving", "scored", "stream"))
    for part in (docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0), docs):
        part.write.mode("append").parquet(arriving)
        source = first_arrivals(stream_documents(spark, arriving, docs.schema))
        mask_and_score_stream(source, score, sink, log).awaitTermination()
    streamed = spark.read.parquet(sink).select(
        F.col("doc_id").alias("_id"), F.struct("prediction", "label_text", "confidence").alias("_got"))
    batch = score(docs).select("doc_id", F.struct("prediction", "label_text", "confidence").alias("_want"))
    return batch.join(streamed, F.col("doc_id") == F.col("_id"), "full").select(
        F.coalesce("doc_id", "_id").alias("doc_id"), F.col("_got").eqNullSafe(F.col("_want")).alias("same"))
