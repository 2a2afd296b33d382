"""A training corpus from raw documents, in five stages.

Every stage takes ``(spark, docs, sf_dir)`` and returns the documents it keeps, with
the columns of ``docs``; the last adds how often each document is taken. Stages
are written as Parquet and read again, so a lost executor costs one stage at most.
Decisions are made and joined by a key that every row has for itself, so null and
repeated ids are judged row by row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textlab.llm import decontaminate, exact, language, minhash, mixing
from textlab.operators.ranking import positions
from textlab.session import written

#: A text is rejected if no language has so large a share of its letters.
LEAST_SHARE = 0.4


KEY, ROW = "key", "row"
LAST = (1 << 63) - 1


def keyed(docs: DataFrame) -> DataFrame:
    """``key, row``: every document as a struct, whatever its columns are called, with its key.

    The key is the id where it is the only one, or the first of its rows by a hash of the
    text; for all other rows, and rows without an id, a number after all ids. Only rows
    with null or repeated ids are sorted and written.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias(KEY), F.struct("*").alias(ROW))
    named = docs.where(F.col(KEY).isNotNull())
    repeated = written(named.groupBy(KEY).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(KEY), "repeated")
    found = docs.agg(F.max(KEY).alias("last"), F.count(F.lit(1)).alias("rows"), F.count(KEY).alias("named")).first()
    some = not repeated.isEmpty()
    if found["rows"] == found["named"] and not some:
        return docs
    last = -1 if found["last"] is None else found["last"]
    odd = docs.where(F.col(KEY).isNull())
    if some:
        odd = odd.unionByName(named.join(repeated, KEY).select(KEY, ROW))
        named = named.join(repeated, KEY, "left_anti").select(KEY, ROW)
    order = [F.col(KEY).asc_nulls_last(), "mark", "tie"]
    placed = positions(odd.withColumn("mark", F.xxhash64("row.text")).withColumn("tie", F.monotonically_increasing_id()), order)
    placed = written(placed.drop("mark", "tie"), "placed")
    if last + placed.count() > LAST:
        raise ValueError("no keys are left after the greatest id")
    own = F.col("pos") + F.lit(last + 1)
    again = placed.where(F.col(KEY).isNotNull())
    again = again.join(again.groupBy(KEY).agg(F.min("pos").alias("first")), KEY)
    again = again.withColumn(KEY, F.when(F.col("pos") == F.col("first"), F.col(KEY)).otherwise(own))
    nameless = placed.where(F.col(KEY).isNull()).withColumn(KEY, own)
    return named.unionByName(again.select(KEY, ROW)).unionByName(nameless.select(KEY, ROW))


def read(docs: DataFrame, *columns: str) -> DataFrame:
    """The key, text and some more columns of keyed documents, for an operator."""
    return docs.select(KEY, "row.text", *(f"row.{c}" for c in columns))


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The documents whose key is not listed; only keys are moved while the list is small."""
    listed = written(gone.select(F.col("doc_id").alias("gone")), "gone")
    return docs.join(listed, docs[KEY] == listed["gone"], "left_anti").select("row.*")


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop texts without letters, and texts in which no language prevails."""
    learn = docs.where(~language.held_out(F.col("doc_id"))).select("doc_id", "text", "lang")
    docs = keyed(docs)
    judged = language.identify(read(docs), language.fit(learn), id_col=KEY)
    return without(docs, judged.where((F.col("lang_pred") == language.UNKNOWN) | (F.col("score") < LEAST_SHARE)))


def distinct_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the longest of texts that are equal but for white space."""
    docs = keyed(docs)
    return without(docs, exact.exact_dedup(read(docs), id_col=KEY).where(~F.col("kept")))


def distinct_shingles(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each component of near-duplicates."""
    docs = keyed(docs)
    return without(docs, minhash.near_duplicates(read(docs), id_col=KEY).where(~F.col("kept")))


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    docs = keyed(docs)
    return without(docs, decontaminate.decontaminate(read(docs), benchmark, id_col=KEY).where("contaminated"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the mix takes, with ``copies`` and ``taken`` words in place of columns so named."""
    kept = [f"row.`{c}`" for c in docs.columns if c.lower() not in ("copies", "taken")]
    docs = keyed(docs)
    plan = mixing.mix_sources(read(docs, "source"), id_col=KEY).where("copies > 0")
    plan = plan.select(F.col("doc_id").alias("id"), "copies", "taken")
    return docs.join(plan, docs[KEY] == plan["id"]).select(*kept, "copies", "taken")


STAGES = [
    ("language", known_language),
    ("exact_dedup", distinct_texts),
    ("near_dedup", distinct_shingles),
    ("decontamination", uncontaminated),
    ("mixing", mixed),
]

#: Trained models, iterated components and a randomised decomposition: not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
