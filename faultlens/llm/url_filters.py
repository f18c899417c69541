"""URL rules: expand host suffixes and path prefixes, join on short hash prefixes, confirm full digests.

A rule is a host and a path prefix. Each distinct (host, path) of the input expands
into host suffix x path prefix expressions (suffixes only of as many labels and prefixes
only of such lengths as some rule has); they meet the rules on the first four bytes of SHA-256, then the whole digest
confirms. The longest rule wins; of equals the one with the longer host, then block.

Defined results: a null url, or one without ``://``, has empty host and path and no
rule; a rule without a host fits nothing; without rules everything is allowed; repeated rows are each judged; columns of the
input that have the name of a result are replaced by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Stored, ascii_lower, small_side, without

#: (action, rule) as the contract lists them.
RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]
PREFIX_HEX = 8


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to / ? # or the end, A-Z lower-cased; path: then up to ? # or the end."""
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.split_part(F.split_part(rest, F.lit("?"), F.lit(1)), F.lit("#"), F.lit(1))
    host = F.split_part(rest, F.lit("/"), F.lit(1))
    return ascii_lower(host), F.substring(rest, F.length(host) + 1, F.length(rest))


def rule_table(spark, rules: list[tuple[str, str]]) -> DataFrame:
    each = F.explode(F.array(*[F.struct(F.lit(a).alias("action"), F.lit(b).alias("rule")) for a, b in rules]))
    return spark.range(1).select(each.alias("r")).select("r.action", "r.rule")


def digests(rules: DataFrame) -> DataFrame:
    """One row for each rule text: the action (block if both are given), the digest and the lengths."""
    one = rules.where(F.col("rule").isNotNull() & ~F.startswith("rule", F.lit("/"))).groupBy("rule").agg(F.max("action").alias("action"))
    host = F.split_part("rule", F.lit("/"), F.lit(1))
    path = F.length("rule") - F.length(host)
    return one.select("rule", "action", F.sha2("rule", 256).alias("digest"), F.length(host).alias("host_len"), path.alias("path_len"), F.size(F.split(host, r"\.")).alias("labels")).withColumn(
        "short", F.substring("digest", 1, PREFIX_HEX)
    )


def expressions(places: DataFrame, label_counts: list[int], path_lengths: list[int]) -> DataFrame:
    """``places`` (host, path) times their expressions."""
    # A host of fewer labels is a suffix of itself.
    suffixes = F.array_distinct(F.array(*[F.substring_index("host", ".", -n) for n in label_counts]))
    lengths = F.filter(F.array(*map(F.lit, path_lengths)), lambda n: n <= F.length("path"))
    prefixes = F.transform(lengths, lambda n: F.substring(F.col("path"), F.lit(1), n))
    every = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p))))
    return places.withColumn("expression", F.explode(F.array_distinct(every))).withColumn("full", F.sha2("expression", 256))


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """Every row of ``pages`` with host, path, rule and verdict."""
    host, path = host_and_path(F.col(url))
    placed = without(pages, ["host", "path", "rule", "verdict"]).withColumns({"host": host, "path": path})
    known = digests(rules)
    # Each at most as many as the longest rule has characters.
    lengths, labels = (sorted(r[0] for r in known.select(c).distinct().collect()) for c in ("path_len", "labels"))
    if not lengths:
        return placed.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    found = expressions(placed.select("host", "path").where("host <> ''").distinct(), labels, lengths)
    # Rules beyond the bound shuffle; the common expressions' rows are then split by AQE.
    near = found.join(small_side(known, 256), F.substring("full", 1, PREFIX_HEX) == F.col("short")).where(F.col("full") == F.col("digest"))
    best = F.max(F.struct(F.length("rule").alias("n"), "host_len", "action", "rule"))
    won = near.groupBy("host", "path").agg(best.alias("b")).select(F.col("host").alias("__h"), F.col("path").alias("__p"), "b.rule", F.col("b.action").alias("__a"))
    # Only what some rule fits is kept; where that is much, AQE splits the rows of a common url.
    won = Stored(won, "fits").df
    out = placed.join(small_side(won, 64), (F.col("host") == F.col("__h")) & (F.col("path") == F.col("__p")), "left")
    return out.withColumn("verdict", F.coalesce("__a", F.lit(default))).drop("__h", "__p", "__a")
