"""URL filters: host-suffix and path-prefix expressions looked up among rules by short hash prefix, then confirmed.

A rule is (host, path, action) and fits its host and all subdomains of it if the URL's path starts with the rule's.
Each distinct URL is expanded into expressions: every suffix of its host (whole labels) with every prefix of its path whose length some rule
has. Expressions are equi-joined with the rules on the first 32 bits of their SHA-256, which gives the rules of that prefix; among them
the full digest confirms. The longest rule wins (host and path together), then the longer host, then block before allow.

Defined results: a null URL, or one without ``://``, has an empty host and path, which no rule fits; rules with a null
or empty host are ignored, a null path is empty; rules that repeat count once; empty tables give empty tables or no fits; further columns
pass through (names starting with ``_u_`` are reserved; columns named host, path, rule or verdict are replaced). The rules are
broadcast only if counted within the bound.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small


def host_of(url: Column) -> Column:
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _digest(host: Column, path: Column) -> Column:
    return F.unhex(F.sha2(F.encode(F.concat(host, F.lit(" "), path), "utf-8"), 256))


def _prefix(digest: Column) -> Column:
    return F.conv(F.hex(F.substring(digest, 1, 4)), 16, 10).cast("long")


def prepared(rules: DataFrame) -> DataFrame:
    """(_u_prefix, _u_rules): the rules (digest, rank, rule, action) of each digest prefix; more than one only where digests share it."""
    host, path = F.col("host"), F.coalesce("path", F.lit(""))
    digest = _digest(host, path)
    length = F.length(host) + F.length(path)
    block = (F.col("action") == "block").cast("int")
    rank = F.struct(length.alias("a"), F.length(host).alias("b"), block.alias("c"))
    rows = rules.where((host != "") & F.col("action").isNotNull())
    rows = rows.select(_prefix(digest).alias("_u_prefix"), F.struct(digest.alias("digest"), rank.alias("rank"), F.concat(host, path).alias("rule"), "action").alias("_u_rule"))
    return rows.groupBy("_u_prefix").agg(F.collect_set("_u_rule").alias("_u_rules"))


def filter_urls(urls: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """Adds host, path, rule (null if none fits) and verdict to the rows of ``urls`` (a column ``url``)."""
    ready = small(prepared(rules))
    # the lengths of rule paths: few, as a path has no more characters than a URL
    lengths = [r[0] for r in rules.select(F.length(F.coalesce("path", F.lit("")))).distinct().collect()]
    url = F.col("url")
    labels = F.split("_u_host", r"\.")
    n = F.size(labels)
    suffixes = F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(labels, i, n), "."))
    known = F.array(*[F.lit(x) for x in sorted(lengths)]).cast("array<int>")
    prefixes = F.transform(F.filter(known, lambda k: k <= F.length("_u_path")), lambda k: F.substring(F.col("_u_path"), F.lit(1), k))
    hits = (
        urls.select(url.alias("_u_url"))
        .distinct()
        .select("_u_url", host_of(F.col("_u_url")).alias("_u_host"), path_of(F.col("_u_url")).alias("_u_path"))
        .where("_u_host <> ''")
        .select("_u_url", F.explode(suffixes).alias("h"), prefixes.alias("p"))
        .select("_u_url", "h", F.explode("p").alias("p"))
        .select("_u_url", _digest(F.col("h"), F.col("p")).alias("_u_full"))
        .withColumn("_u_prefix", _prefix(F.col("_u_full")))
        .join(ready, "_u_prefix")
        .select("_u_url", F.explode(F.filter("_u_rules", lambda r: r["digest"] == F.col("_u_full"))).alias("r"))
        .groupBy("_u_url")
        .agg(F.max(F.struct("r.rank", "r.rule", "r.action")).alias("_u_best"))
    )
    out = urls.join(hits, url == F.col("_u_url"), "left")
    return out.withColumns(
        {
            "host": host_of(url),
            "path": path_of(url),
            "rule": F.col("_u_best.rule"),
            "verdict": F.coalesce("_u_best.action", F.lit(default)),
        }
    ).drop("_u_url", "_u_best")
