"""URL rules by expressions: host suffixes x path prefixes, short hashes, full digests.

Each url becomes the expressions (host suffix + path prefix) that a rule of its table could
have; they meet the rules in an equi-join on eight hex digits of SHA-256, and a hit counts
only if the full digests agree. The longest rule wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SHORT = 8


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _rest(url: Column) -> Column:
    at = F.instr(url, F.lit("://"))
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """``pages``: page_id, url. ``rules``: host, path, verdict (allow or block).

    Returns page_id, host, path, rule, verdict, one row for each row of ``pages``. A null url
    or one without ``://`` has an empty host and path and gets ``default``, as does every url
    that no rule fits. Of rules of equal length the one with the longer host wins, then block.
    Repeated pages give repeated rows, an empty table an empty result; a rule with a null host,
    path or verdict takes no part; other columns are ignored.

    The driver holds the distinct lengths of the rules' hosts and paths: numbers no larger than
    the longest host and path, whatever the number of rules. An url has as many expressions as
    label boundaries at such lengths times such path lengths, so a url of any length stays small.
    """
    rules = (
        rules.select("host", "path", "verdict")
        .dropna()
        .withColumn("rule", F.concat("host", "path"))
        .withColumn("digest", F.sha2("rule", 256))
    )
    lengths = rules.agg(
        F.sort_array(F.collect_set(F.length("host"))).alias("hosts"),
        F.sort_array(F.collect_set(F.length("path"))).alias("paths"),
    ).first()
    # Rules that say the same thing twice, or both things: block stands.
    known = rules.groupBy("digest", "host", "path", "rule").agg(F.max("verdict").alias("rule_verdict")).select(
        F.substring("digest", 1, SHORT).alias("short"),
        F.col("digest").alias("rule_digest"),
        F.struct(
            F.length("rule").alias("chars"), F.length("host").alias("host_chars"), "rule_verdict", "rule"
        ).alias("fits"),
    )

    urls = (
        pages.select("page_id", "url")
        .groupBy("page_id", "url")
        .agg(F.count(F.lit(1)).alias("copies"))
        .withColumn("host", host_of(F.col("url")))
        .withColumn("path", path_of(F.col("url")))
    )
    whole = F.length("host")
    suffixes = F.filter(
        F.array(*[F.lit(n) for n in lengths.hosts]).cast("array<int>"),
        lambda n: (n <= whole) & ((n == whole) | (F.col("host").substr(whole - n, F.lit(1)) == ".")),
    )
    prefixes = F.filter(F.array(*[F.lit(n) for n in lengths.paths]).cast("array<int>"), lambda n: n <= F.length("path"))
    expressions = F.flatten(
        F.transform(
            suffixes,
            lambda h: F.transform(
                prefixes,
                lambda p: F.concat(
                    F.col("host").substr(whole - h + 1, h), F.col("path").substr(F.lit(1), p)
                ),
            ),
        )
    )
    asked = urls.select("*", F.explode_outer(expressions).alias("expression")).withColumn(
        "digest", F.sha2("expression", 256)
    )
    hit = F.when(F.col("digest") == F.col("rule_digest"), F.col("fits"))
    judged = (
        asked.withColumn("short", F.substring("digest", 1, SHORT))
        .join(known, "short", "left")
        .groupBy("page_id", "url")
        .agg(
            F.first("host").alias("host"),
            F.first("path").alias("path"),
            F.first("copies").alias("copies"),
            F.max(hit).alias("won"),
        )
    )
    return judged.select(
        "page_id",
        "host",
        "path",
        F.col("won.rule").alias("rule"),
        F.coalesce(F.col("won.rule_verdict"), F.lit(default)).alias("verdict"),
        F.explode(F.sequence(F.lit(1).cast("bigint"), "copies")).alias("copy"),
    ).drop("copy")
