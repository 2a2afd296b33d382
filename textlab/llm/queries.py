"""The registered queries of this package, each next to its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textlab.llm import (
    backoff, ball_tree, decontaminate, exact, language, minhash, mixing, negatives, pii, suffix_array, suffix_tree, urls, warc,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(function):
        QUERIES[name] = function
        if oracle is not None:
            ORACLES[name] = oracle
        return function

    return register


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


@query("op1_suffix_array_dedup")
def op1_suffix_array_dedup(spark, sf_dir):
    return suffix_array.remove_repeated_bytes(documents(spark, sf_dir))


@query("op2_decontamination")
def op2_decontamination(spark, sf_dir):
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.decontaminate(documents(spark, sf_dir), benchmark)


@query("op3_language")
def op3_language(spark, sf_dir):
    docs = documents(spark, sf_dir)
    docs = docs.withColumn("held_out", language.held_out(F.col("doc_id")))
    model = language.fit(docs.where(~F.col("held_out")))
    return language.identify(docs, model, keep=("held_out",))


@query("op4_minhash")
def op4_minhash(spark, sf_dir):
    return minhash.near_duplicates(documents(spark, sf_dir))


@query("op5_suffix_tree_dedup")
def op5_suffix_tree_dedup(spark, sf_dir):
    return suffix_tree.remove_repeated_words(documents(spark, sf_dir))


@query("op6_warc", r"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS digest FROM pages
), r AS (
  SELECT page_id, octet_length(encode(html)) AS payload_bytes, array_to_string(list_transform(range(0, 32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((CAST('0x' || substr(digest, CAST(5 * (i // 4) + 1 AS BIGINT), 5) AS INTEGER)
      >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31) AS BIGINT), 1)), '') AS payload_digest,
    min(page_id) OVER (PARTITION BY html) AS first_id FROM p
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to FROM r
""")
def op6_warc(spark, sf_dir):
    records = warc.archived(pages(spark, sf_dir))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: The rules of the query.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))


@query("op7_url_filter", r"""
WITH rules(host, path, verdict) AS (
  VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
), cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), hosts AS (
  SELECT page_id, regexp_extract(rest, '^[^/?#]*', 0, 's') AS host, rest FROM cut
), parsed AS (
  SELECT page_id, translate(host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(substr(rest, length(host) + 1), '^[^?#]*', 0, 's') AS path FROM hosts
), fits AS (
  SELECT p.page_id, r.host || r.path AS rule, r.verdict,
    row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.host) + length(r.path) DESC, length(r.host) DESC) AS place
  FROM parsed p JOIN rules r
    ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
)
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.verdict, 'allow') AS verdict
FROM parsed p LEFT JOIN fits f ON f.page_id = p.page_id AND f.place = 1
""")
def op7_url_filter(spark, sf_dir):
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return urls.filter_urls(pages(spark, sf_dir), rules)


@query("op8_mixing")
def op8_mixing(spark, sf_dir):
    mixed = mixing.mix_sources(documents(spark, sf_dir))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies")


@query("op9_exact_dedup", r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents
)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
  doc_id = first_value(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM d WINDOW w AS (PARTITION BY norm ORDER BY n DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
""")
def op9_exact_dedup(spark, sf_dir):
    return exact.exact_dedup(documents(spark, sf_dir))


@query("op10_personal_data")
def op10_personal_data(spark, sf_dir):
    found = pii.find_personal_data(documents(spark, sf_dir))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added")


@query("op11_ranked_search", r"""
WITH doc_terms AS (
  SELECT row_number() OVER () AS r, doc_id, list_transform(
    regexp_extract_all(coalesce(text, ''), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'),
    lambda t: translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS terms
  FROM documents
), docs AS (SELECT r, doc_id, terms, len(terms) AS n FROM doc_terms WHERE len(terms) > 0),
total AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS len_docs FROM docs),
asked AS (
  SELECT item, item_id, term, count(*) AS qtf FROM (
    SELECT row_number() OVER () AS item, item_id, unnest(list_transform(
      regexp_extract_all(coalesce(text, ''), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'),
      lambda t: translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))) AS term FROM benchmark
  ) GROUP BY ALL
), held AS (
  SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, n, unnest(terms) AS term FROM docs)
  WHERE term IN (SELECT term FROM asked) GROUP BY ALL
), weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w
  FROM (SELECT term, count(*) AS df FROM held GROUP BY term), total
), scores AS (
  SELECT item, any_value(item_id) AS item_id, r, any_value(doc_id) AS doc_id,
    CAST(sum(qtf * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // len_docs)))) AS BIGINT) AS score
  FROM asked JOIN held USING (term) JOIN weights USING (term), total GROUP BY item, r
), ranked AS (
  SELECT item_id, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id) AS rank, doc_id, score
  FROM scores WHERE score > 0
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 10
""")
def op11_ranked_search(spark, sf_dir):
    return ball_tree.ranked(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@query("op12_hard_negatives", r"""
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.r AS anchor, a.vec_id AS anchor_id, b.r, b.vec_id, a.label = b.label AS same,
    CAST(list_inner_product(a.e, b.e) AS BIGINT) AS score
  FROM v a JOIN v b ON a.r <> b.r WHERE a.vec_id % 100 = 0
), positives AS (
  SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id) <= 5
), mined AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor, p.r ORDER BY n.score DESC, n.vec_id) AS rank
  FROM positives p JOIN s n ON n.anchor = p.anchor AND NOT n.same
    AND 80 * p.score <= 100 * n.score AND n.score <= p.score
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score
FROM mined WHERE rank <= 5
""")
def op12_hard_negatives(spark, sf_dir):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.col("label").cast("long")
    return negatives.mine(vectors, label=F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label))


@query("op13_language_model")
def op13_language_model(spark, sf_dir):
    return backoff.score_texts(documents(spark, sf_dir))
