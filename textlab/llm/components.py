"""Connected components of a link table, by hooking and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlab.session import written


def components(links: DataFrame) -> DataFrame:
    """``node, component`` for the nodes of ``links(a, b)``: the smallest node reachable.

    Every round each node, and the node that it is labelled with, take the
    smallest label around it; then every label is replaced by its own label. Trees
    hook onto trees and halve in depth, so rounds grow with the logarithm of the
    number of nodes. Labels are written each round; only a count comes to the driver.
    """
    both = written(
        links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        .where("a <> b").distinct(), "links"
    )
    labels = written(
        both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("component")), "labels"
    )
    while True:
        seen = labels.select(F.col("node").alias("b"), F.col("component").alias("near"))
        around = both.join(seen, "b").groupBy("a").agg(F.min("near").alias("near"))
        offers = labels.join(around, F.col("node") == F.col("a")).select(
            F.explode(F.array(F.struct(F.col("node").alias("to"), "near"), F.struct(F.col("component").alias("to"), "near"))).alias("o")
        ).select("o.*").groupBy("to").agg(F.min("near").alias("near"))
        hooked = labels.join(offers, F.col("node") == F.col("to"), "left").select(
            "node", F.col("component").alias("before"), F.least("component", "near").alias("component")
        )
        hooked = written(hooked, "hooked")
        parents = hooked.select(F.col("node").alias("parent"), F.col("component").alias("above"))
        jumped = written(
            hooked.join(parents, F.col("component") == F.col("parent"), "left")
            .select("node", "before", F.least("component", "above").alias("component")), "labels"
        )
        labels = jumped.select("node", "component")
        if jumped.where(F.col("component") != F.col("before")).isEmpty():
            return labels


def extended(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels(node, component)`` after more ``links(a, b)``: only components are linked anew."""
    a, b = (labels.select(F.col("node").alias(c), F.col("component").alias(f"{c}_root")) for c in "ab")
    rooted = written(
        links.join(a, "a", "left").join(b, "b", "left")
        .select("a", "b", F.coalesce("a_root", "a").alias("a_root"), F.coalesce("b_root", "b").alias("b_root")), "rooted"
    )
    joined = components(rooted.select(F.col("a_root").alias("a"), F.col("b_root").alias("b")))
    ends = F.explode(F.array(
        F.struct(F.col("a").alias("node"), F.col("a_root").alias("root")), F.struct(F.col("b").alias("node"), F.col("b_root").alias("root"))
    ))
    nodes = labels.select("node", F.col("component").alias("root")).unionByName(
        rooted.select(ends.alias("e")).select("e.*")).distinct()
    higher = joined.select(F.col("node").alias("root"), "component")
    return written(
        nodes.join(higher, "root", "left").select("node", F.coalesce("component", "root").alias("component")), "labels"
    )
