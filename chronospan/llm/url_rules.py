"""URL filters: host-suffix and path-prefix expressions, joined on short hash prefixes, confirmed by full digests.

A rule is (action, host, path). It fits its host and all its subdomains if the URL's path starts with the rule's.
Each URL is expanded into the expressions that could be rules: the suffixes of its host that have as many labels
as some rule, times the prefixes of its path that are as long as some rule's path. The expansion is therefore
bounded by the rules, not by the URL. Expressions meet the rules in an equi-join on the first bytes of their
SHA-256; full digests then confirm, and of several rules that fit the longest wins.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Hex digits of the digest that the join goes by.
PREFIX_DIGITS = 8
#: Up to so many rules go to every executor; more are joined by a shuffle.
MANY_RULES = 100_000


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null or without ``://``."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty for null or without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def _digest(expression: Column) -> Column:
    return F.sha2(expression.cast("binary"), 256)


def match_rules(pages: DataFrame, rules: Sequence[tuple[str, str, str]], key: str = "page_id", url: str = "url", otherwise: str = "allow") -> DataFrame:
    """Per row of pages: key, host, path, the rule that decides (host and path in one, else null), verdict (allow or block).

    The longest rule (host and path together) wins; among equally long ones that fit, block goes before allow.
    URLs that no rule fits get ``otherwise``. Null URLs and those without ``://`` have an empty host and path, and
    fit a rule only if it has both empty. Rows are judged each for itself, so repeated keys and null keys stay as
    they are; other columns are not looked at. No rules: every row gets ``otherwise``.
    """
    spark = pages.sparkSession
    base = pages.select(F.col(key).alias("key"), F.coalesce(F.col(url), F.lit("")).alias("url"))
    split = [host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")]
    if not rules:
        return base.select(F.col("key").alias(key), *split, F.lit(None).cast("string").alias("rule"), F.lit(otherwise).alias("verdict"))
    listed = spark.createDataFrame([tuple(r) for r in rules], "action string, rule_host string, rule_path string").select(
        "action", F.concat("rule_host", "rule_path").alias("rule"), _digest(F.concat_ws("\x00", "rule_host", "rule_path")).alias("full")
    ).withColumn("short", F.substring("full", 1, PREFIX_DIGITS))

    labels = sorted({h.count(".") + 1 for _, h, _ in rules if h})
    hosts = [F.when(F.size(F.split("host", r"\.")) >= n, F.substring_index("host", ".", -n)) for n in labels]
    if any(h == "" for _, h, _ in rules):
        hosts.append(F.when(F.col("host") == "", F.lit("")))
    lengths = sorted({len(p) for _, _, p in rules})
    paths = [F.when(F.char_length("path") >= n, F.substring("path", 1, n)) for n in lengths]

    # Each distinct URL is judged once, so that the verdicts meet their rows by the URL itself: a third of all rows may have the same.
    # All expressions of a URL stay in one row of at most (label counts x lengths) entries until the join.
    expanded = base.select("url").distinct().select("url", *split).withColumn("_h", F.explode(F.array_compact(F.array(*hosts)))).withColumn("_p", F.explode(F.array_compact(F.array(*paths))))
    expressions = expanded.select("url", _digest(F.concat_ws("\x00", "_h", "_p")).alias("asked"))
    expressions = expressions.withColumn("short", F.substring("asked", 1, PREFIX_DIGITS))
    fits = expressions.join(F.broadcast(listed) if len(rules) <= MANY_RULES else listed, "short").where(F.col("asked") == F.col("full"))
    # One row per URL and rule at most; the best is found by a partial aggregate on each side of the shuffle.
    best = fits.groupBy("url").agg(F.max(F.struct(F.char_length("rule").alias("n"), (F.col("action") == "block").alias("b"), F.col("rule").alias("rule"), F.col("action").alias("action"))).alias("best"))
    return base.join(best, "url", "left").select(F.col("key").alias(key), *split, F.col("best.rule").alias("rule"), F.coalesce(F.col("best.action"), F.lit(otherwise)).alias("verdict"))
