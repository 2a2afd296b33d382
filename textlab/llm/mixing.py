"""Mixing sources to target weights by Pareto order sampling.

A source whose target is ``r`` times its size takes every document ``floor(r)``
times and a sample for the rest. The sample ranks documents by random odds
divided by inclusion odds (Rosén's Pareto sampling) and takes the first ones, up
to the words that are missing. The cut of each source is found by counting
words in ranges of that rank, so no source is ever sorted or gathered as a whole.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textlab.session import written

WORD = r"[^\x20\x09-\x0D]+"
RANGES = 1024  # ranges of a rank, and again within the range that holds the cut


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def cycled_weights(sizes: DataFrame, cycle: Sequence[float]) -> DataFrame:
    """Give ``sizes(source, source_size)`` the weights of ``cycle``, by code point, null last."""
    # One row per source.
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weights = F.array(*[F.lit(float(w)) for w in cycle])
    return sizes.withColumn("weight", F.get(weights, F.pmod(F.row_number().over(order) - 1, F.lit(len(cycle)))))


def targets(weighted: DataFrame, most: float) -> DataFrame:
    """Add ``target`` to ``weighted(source, source_size, weight)``.

    Targets share all words by weight and stop at ``most`` times their source's
    size; what is over is shared again by weight until none is above. The fixed
    point gives ``min(most * size, level * weight)`` for one level, which a
    running sum over sources in the order of ``size / weight`` finds.
    """
    upto = Window.orderBy((F.col("source_size") / F.col("weight")), F.col("source").asc_nulls_last())
    earlier, later = upto.rowsBetween(Window.unboundedPreceding, -1), upto.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy()
    total = F.sum("source_size").over(whole)
    level = (total - most * F.coalesce(F.sum("source_size").over(earlier), F.lit(0))) / F.sum("weight").over(later)
    capped = most * F.col("source_size") <= level * F.col("weight")
    # The sources before the first that isn't capped are at their cap; that one's level holds for the rest.
    return (
        weighted.withColumn("_level", F.when(~capped, level))
        .withColumn("_level", F.first("_level", ignorenulls=True).over(upto.rowsBetween(
            Window.unboundedPreceding, Window.unboundedFollowing)))
        .withColumn("target", F.coalesce(
            F.least(most * F.col("source_size"), F.col("_level") * F.col("weight")),
            (most * F.col("source_size")).cast("double")))
        .drop("_level")
    )


def uniform(seed: int, *keys: Column) -> Column:
    """A number between 0 and 1, both excluded, from a hash: the same in every run and task."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *keys), 12)
    return (bits + F.lit(0.5)) / F.lit(float(1 << 52))


def pareto_rank(u: Column, inclusion: Column) -> Column:
    """Random odds over inclusion odds, mapped to 0..1 without a change of order."""
    odds = (u / (1 - u)) * ((1 - inclusion) / inclusion)
    return odds / (1 + odds)


def mix_sources(
    docs: DataFrame, cycle: Sequence[float] = (5, 2, 1), most: float = 3.0, seed: int = 17,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", importance: Column | None = None,
) -> DataFrame:
    """How often each document enters a mix of the whole size of ``docs``.

    Returns ``doc_id, size, source_size, target, copies, taken, inclusion, source``,
    one row per row of ``docs``. ``taken`` is ``copies * size``; the taken words of
    a source differ from its target by at most half its largest document, and by
    far less where it has documents of many sizes.
    ``importance`` (default: equal) raises the inclusion odds of a document
    within its source; ``most`` copies of a document are never exceeded.

    A null text has size 0 and a null source is a source of its own, last in
    order. Documents without words take none. Ties of the rank go by id, then by
    a hash of the text; rows that repeat both are taken in any order, alike. An
    empty table gives an empty result.
    """
    docs = docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"),
        F.xxhash64(text_col).alias("mark"), (F.lit(1.0) if importance is None else importance).alias("importance"),
    )
    sized = written(docs, "sizes")
    by_source = sized.groupBy("source").agg(
        F.sum("size").alias("source_size"), F.sum(F.col("size") * F.col("importance")).alias("_scale")
    )
    plan = written(
        targets(cycled_weights(by_source, cycle), most)
        .withColumn("whole", F.floor(F.col("target") / F.greatest("source_size", F.lit(1))))
        .withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")), "targets",
    )
    # One row per source; Spark broadcasts it while it is small.
    same = sized["source"].eqNullSafe(plan["source"])
    share = F.try_divide(F.col("importance") * F.col("rest"), F.col("_scale"))  # null in a source without words
    drawn = (
        sized.join(plan, same).drop(plan["source"])
        .withColumn("inclusion", F.least(F.greatest(F.coalesce(share, F.lit(0.0)), F.lit(1e-12)), F.lit(1 - 1e-12)))
        .withColumn("rank", pareto_rank(uniform(seed, F.col("doc_id"), F.col("mark")), F.col("inclusion")))
    )
    place = F.col("rank") * RANGES
    drawn = drawn.withColumn("coarse", F.least(F.floor(place), F.lit(RANGES - 1)))
    drawn = drawn.withColumn("fine", F.least(F.floor((place - F.col("coarse")) * RANGES), F.lit(RANGES - 1)))
    drawn = written(drawn.select(
        "doc_id", "mark", "source", "size", "source_size", "target", "whole", "rest", "inclusion", "rank", "coarse", "fine"
    ), "ranked")

    def cut(rows: DataFrame, level: str, before: Column) -> DataFrame:
        """Per source the range of ``level`` that holds the cut and the words before it."""
        counted = rows.groupBy("source", level).agg(F.sum("size").alias("words"), F.first("rest").alias("rest"),
                                                    F.first(before).alias("before"))
        upto = Window.partitionBy("source").orderBy(level)  # at most RANGES rows per source
        return (
            counted.withColumn("upto", F.col("before") + F.sum("words").over(upto))
            .where((F.col("upto") > F.col("rest")) & (F.col("upto") - F.col("words") <= F.col("rest")))
            .select(F.col("source").alias("_source"), F.col(level).alias(f"cut_{level}"),
                    (F.col("upto") - F.col("words")).alias(f"before_{level}"))
        )

    def with_cut(rows: DataFrame, found: DataFrame) -> DataFrame:
        return rows.join(found, rows["source"].eqNullSafe(found["_source"]), "left").drop("_source")

    drawn = with_cut(drawn, written(cut(drawn, "coarse", F.lit(0)), "cuts"))
    inside = drawn.where(F.col("coarse") == F.col("cut_coarse"))
    drawn = with_cut(drawn, written(cut(inside, "fine", F.col("before_coarse")), "cuts"))
    # Within one range of a million, rank by rank.
    at_cut = (F.col("coarse") == F.col("cut_coarse")) & (F.col("fine") == F.col("cut_fine"))
    before = F.col("cut_coarse").isNull() | (F.col("coarse") < F.col("cut_coarse")) | (
        (F.col("coarse") == F.col("cut_coarse")) & (F.col("fine") < F.col("cut_fine")))
    order = Window.partitionBy("source").orderBy("rank", "doc_id", "mark")
    edge = (
        drawn.where(at_cut)
        .withColumn("_upto", F.col("before_fine") + F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("extra", F.col("_upto") <= F.col("rest")).drop("_upto")
    )
    sampled = rest_of(drawn, at_cut, before).unionByName(edge)
    sampled = written(sampled.withColumn("extra", (F.col("extra") & (F.col("rest") > 0) & (F.col("size") > 0))), "sampled")
    # The last document of a source is, of those not drawn, the one whose size fits best into what is missing.
    gaps = sampled.groupBy("source").agg(
        (F.first("rest") - F.sum(F.when(F.col("extra"), F.col("size")).otherwise(0))).alias("gap")
    ).select(F.col("source").alias("_source"), "gap")
    gaps = written(gaps, "gaps")
    sampled = sampled.join(gaps, sampled["source"].eqNullSafe(gaps["_source"]))
    misfit = F.abs(F.col("size") - F.col("gap"))
    last = sampled.where(~F.col("extra") & (F.col("size") > 0) & (misfit < F.col("gap"))).groupBy("_source").agg(
        F.min(F.struct(misfit, "rank", "doc_id", "mark")).alias("last")
    ).select(F.col("_source").alias("_of"), "last.rank", "last.doc_id", "last.mark")
    last = written(last.toDF("_of", "_rank", "_id", "_mark"), "last")
    is_last = F.coalesce(
        (F.col("rank") == F.col("_rank")) & F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("mark").eqNullSafe(F.col("_mark")),
        F.lit(False),
    )
    copies = F.when(F.col("size") == 0, F.lit(0)).otherwise(
        F.least(F.col("whole") + (F.col("extra") | is_last).cast("long"), F.lit(int(most))))
    return (
        sampled.join(last, sampled["_source"].eqNullSafe(last["_of"]), "left")
        .withColumn("copies", copies.cast("long"))
        .select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"),
                "copies", "inclusion", "source")
    )


def rest_of(drawn: DataFrame, at_cut: Column, before: Column) -> DataFrame:
    """The rows outside the range of the cut: drawn if they come before it."""
    return drawn.where(~F.coalesce(at_cut, F.lit(False))).withColumn("extra", before)
