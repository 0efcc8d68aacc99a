"""Verdicts for feed urls from host and path rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, rows_in

#: rules up to this many are broadcast; more are joined by a shuffle
BROADCAST_RULES = 100_000


def split_url(url) -> tuple:
    """(host, path) columns of a url: host after the first ://, lower case; both empty without ://."""
    url = F.coalesce(url, F.lit(""))
    return (lower_ascii(F.regexp_extract(url, "://([^/?#]*)", 1)),
            F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1))


def _expressions(pages: DataFrame, host_lengths: list[int], path_lengths: list[int]) -> DataFrame:
    """Every (host suffix, path prefix) of a page whose lengths some rule has.

    Lengths that no rule has can't match, so the fan-out is bounded by the rules and
    not by the url, and string prefixes that end inside a path segment still fit.
    """
    host, path = F.col("host"), F.col("path")
    suffixes = F.filter(F.array(*[F.lit(n) for n in host_lengths]), lambda n: (F.length(host) == n) | (
        (F.length(host) > n) & (F.substring(host, F.length(host) - n, F.lit(1)) == ".")))
    prefixes = F.filter(F.array(*[F.lit(n) for n in path_lengths]), lambda n: F.length(path) >= n)
    return (pages.select("host", "path", F.explode(suffixes).alias("_h"))
            .select("host", "path", "_h", F.explode(prefixes).alias("_p"))
            .select("host", "path", F.concat(F.substring(host, F.length(host) - F.col("_h") + 1, F.col("_h")),
                                             F.substring(path, F.lit(1), F.col("_p"))).alias("_expression")))


def judge_feed_urls(feeds: DataFrame, rules: DataFrame, default: str = "allow",
                    broadcast_rules: int = BROADCAST_RULES) -> DataFrame:
    """(dataset_id, url, host, path, rule, verdict) for every row of `feeds` (dataset_id, url).

    `feeds` are the open-data addresses that a city is built from; `rules` has host, path
    and verdict. Each distinct (host, path) is expanded into host suffixes and path
    prefixes, these meet the rules by an equi-join on the first 32 bits of their SHA-256,
    the full digest confirms, and the longest host, then the longest path, wins; equal
    rules with different verdicts give the alphabetically last one.

    A null url or one without :// has an empty host and path, fits no rule and gets
    `default` with a null rule. Repeated rows stay, null ids stay, other columns of
    `feeds` are ignored, no rules means `default` for all.
    """
    host, path = split_url(F.col("url"))
    feeds = feeds.select("dataset_id", "url").withColumns({"host": host, "path": path})
    ruled = (rules.filter("host is not null and path is not null")
             .select(lower_ascii(F.col("host")).alias("_host"), F.col("path").alias("_path"), F.col("verdict").alias("_verdict")))
    ruled = (ruled.groupBy("_host", "_path").agg(F.max("_verdict").alias("_verdict"))
             .withColumn("_rule", F.concat("_host", "_path")).withColumn("_digest", F.sha2("_rule", 256)))
    # distinct lengths: bounded by the longest rule, not by their number
    host_lengths = sorted(r[0] for r in ruled.select(F.length("_host")).distinct().collect())
    path_lengths = sorted(r[0] for r in ruled.select(F.length("_path")).distinct().collect())
    if not host_lengths:
        return feeds.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    if rows_in(ruled) <= broadcast_rules:
        ruled = F.broadcast(ruled)
    asked = _expressions(feeds.select("host", "path").distinct(), host_lengths, path_lengths)
    asked = asked.withColumn("_digest_asked", F.sha2("_expression", 256))
    prefix = F.substring("_digest_asked", 1, 8) == F.substring("_digest", 1, 8)
    won = (asked.join(ruled, prefix & (F.col("_digest_asked") == F.col("_digest")))
           .groupBy("host", "path")
           .agg(F.max(F.struct(F.length("_host").alias("h"), F.length("_path").alias("p"),
                               F.col("_rule").alias("rule"), F.col("_verdict").alias("verdict"))).alias("_won")))
    return (feeds.join(won, ["host", "path"], "left")
            .select("dataset_id", "url", "host", "path", F.col("_won.rule").alias("rule"),
                    F.coalesce("_won.verdict", F.lit(default)).alias("verdict")))
