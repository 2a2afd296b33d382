"""URL filters: a blocked Bloom filter in front of an exact hash join.

A rule names a host and the beginning of a path. A URL can only be hit by a
rule that names one of its host's suffixes and a beginning of its path, so every
URL lists those names (its probes). A Bloom filter of the listed rules drops
nearly all probes; a hash join with the rules removes its false positives.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textlab.llm.blooms import bloom, passing


def canonical(url: Column) -> tuple[Column, Column]:
    """Host and path of a URL; both are empty without ``://``."""
    rest = F.substring_index(url, "://", 1)
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.length(rest) + F.lit(4)))
    host = F.regexp_extract(rest, r"(?s)^[^/?#]*", 0)
    after = F.substr(rest, F.length(host) + F.lit(1))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    path = F.regexp_extract(after, r"(?s)^[^?#]*", 0)
    return F.coalesce(F.translate(host, upper, lower), F.lit("")), F.coalesce(path, F.lit(""))


def host_suffixes(host: Column, most: int) -> Column:
    """The host and the hosts above it, of at most ``most`` labels: ``a.b.c`` gives ``a.b.c``, ``b.c`` and ``c``."""
    labels = F.split(F.substring_index(host, ".", -most), r"\.")
    n = F.size(labels)
    return F.transform(
        F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(labels, i, n - i + F.lit(1)), ".")
    )


def filter_urls(
    pages: DataFrame, rules: DataFrame, keep: Sequence[str] = ("page_id",), url_col: str = "url",
    default: str = "allow",
) -> DataFrame:
    """Judge every URL by ``rules(host, path, verdict)``; one row per row of ``pages``.

    Returns the columns ``keep`` and ``host, path, rule, verdict``. A rule fits
    its host and all subdomains where the path begins with the rule's path. The
    longest rule (host and path together, then the longer host) wins; if a list
    holds both verdicts for one rule, ``block`` wins. Without a rule, ``rule`` is
    null and the verdict is ``default``.

    A null URL, or one without ``://``, has an empty host and path and is hit by
    no rule, as rules with a null or empty host are dropped. A null rule path
    is empty. Repeated rules count once, repeated pages stay.
    """
    rules = (
        rules.select("host", F.coalesce("path", F.lit("")).alias("path"), "verdict")
        .where((F.col("host") != "") & F.col("verdict").isNotNull())
        .groupBy("host", "path").agg(F.max(F.col("verdict") == "block").alias("blocked"))
    )
    host, path = canonical(F.col(url_col))
    parsed = pages.select(*keep, host.alias("host"), path.alias("path"))
    # The lengths that rule paths have: at most as many as the longest path has characters.
    lengths = sorted(r[0] for r in rules.select(F.length("path")).distinct().collect())
    fitting = F.filter(F.lit(lengths).cast("array<int>"), lambda n: n <= F.length("path"))
    # No longer end of a host than the longest rule's can match.
    labels = rules.agg(F.coalesce(F.max(F.size(F.split("host", r"\."))), F.lit(1)).alias("n")).first()["n"]
    # A judgement depends on host and path only, so each such pair is looked up once.
    distinct = parsed.where("host <> ''").select("host", "path").distinct()
    probes = (
        distinct.select("host", "path", F.explode(host_suffixes(F.col("host"), labels)).alias("rule_host"))
        .where("rule_host <> ''")
        .select("host", "path", "rule_host", F.explode(fitting).alias("_length"))
        .select("host", "path", "rule_host", F.substr("path", F.lit(1), "_length").alias("rule_path"))
    )
    possible = passing(probes, bloom(rules, "host", "path"), "rule_host", "rule_path")
    exact = possible.join(
        rules.select(F.col("host").alias("rule_host"), F.col("path").alias("rule_path"), "blocked"),
        ["rule_host", "rule_path"],
    )
    longest = F.max(F.struct(
        (F.length("rule_host") + F.length("rule_path")).alias("n"), F.length("rule_host").alias("n_host"),
        F.concat("rule_host", "rule_path").alias("rule"), "blocked",
    ))
    judged = exact.groupBy("host", "path").agg(longest.alias("best"))
    verdict = F.when(F.col("best.blocked"), "block").when(~F.col("best.blocked"), "allow").otherwise(default)
    return parsed.join(judged, ["host", "path"], "left").select(
        *keep, "host", "path", F.col("best.rule").alias("rule"), verdict.alias("verdict")
    )
