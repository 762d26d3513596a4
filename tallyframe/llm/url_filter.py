"""URL rules by host suffix and path prefix, looked up by digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RULE_SCHEMA = "host string, path string, verdict string"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://([^/?#]*)", 1)
    return F.translate(rest, _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://[^/?#]*(/[^?#]*)", 1)


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(rules, RULE_SCHEMA)


def _stem(path: Column) -> Column:
    """A path up to its last slash: where rules and URLs are cut to meet."""
    return F.regexp_extract(path, r"^(?s:.*/)?", 0)


def _digest(host: Column, stem: Column) -> Column:
    return F.unhex(F.sha2(F.concat(host, F.lit("\n"), stem), 256))


def _short(digest: Column) -> Column:
    return F.substring(digest, 1, 4)


def host_suffixes(host: Column, most: int) -> Column:
    """The host and its parent domains, of up to ``most`` labels."""
    labels = F.split(host, r"\.", -1)
    first = F.greatest(F.lit(1), F.size(labels) - most + 1)
    return F.transform(
        F.sequence(first, F.size(labels)),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels) - i + 1), "."),
    )


def path_stems(path: Column, most: int) -> Column:
    """'' and the path up to each of its first ``most`` slashes."""
    steps = F.split(path, "/", -1)
    last = F.least(F.lit(most), F.size(steps) - 1)
    return F.transform(
        F.sequence(F.lit(0), last),
        lambda i: F.when(i == 0, "").otherwise(F.concat(F.array_join(F.slice(steps, 1, i), "/"), F.lit("/"))),
    )


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", url: str = "url") -> DataFrame:
    """``pages`` with the columns host, path, rule and verdict (columns of these names are replaced).

    Every distinct host and path is expanded into host suffixes and path
    prefixes ending in a slash; rules are filed under the same expressions. They
    meet on four bytes of a SHA-256 digest; then the whole digest and the rest of
    the rule's path must agree. Suffixes with more labels, and prefixes with more
    slashes, than any rule has are left out. The longest rule wins; of rules
    as long the one with the longer host, and of equal rules ``block``.

    Null URLs and those without ``://`` have an empty host and path and get the
    default, as do all pages if there are no rules. Rules with a null part
    or an empty host never apply. Rows that repeat are all returned.
    """
    rules = rules.dropna(subset=["host", "path", "verdict"]).where("host <> ''")
    rules = rules.withColumn("host", F.translate("host", _UPPER, _LOWER))
    slashes = F.size(F.split("path", "/", -1)) - 1
    most = rules.agg(F.max(F.size(F.split("host", r"\.", -1))), F.max(slashes)).first()
    labels, depth = most[0] or 1, most[1] or 0
    filed = rules.select(
        _digest(F.col("host"), _stem(F.col("path"))).alias("rule_digest"),
        F.col("path").alias("rule_path"),
        F.struct(
            (F.length("host") + F.length("path")).alias("length"),
            F.length("host").alias("host_length"),
            (F.col("verdict") == "block").alias("blocks"),
            F.concat("host", "path").alias("rule"),
            "verdict",
        ).alias("found"),
    ).withColumn("short", _short(F.col("rule_digest")))
    own = pages.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    places = own.select("host", "path").where("host <> ''").distinct()
    expressions = places.withColumn("suffix", F.explode(host_suffixes(F.col("host"), labels)))
    expressions = expressions.withColumn("stem", F.explode(path_stems(F.col("path"), depth)))
    expressions = expressions.withColumn("digest", _digest(F.col("suffix"), F.col("stem")))
    expressions = expressions.withColumn("short", _short(F.col("digest"))).select("host", "path", "digest", "short")
    matches = expressions.join(filed, "short").where(
        (F.col("digest") == F.col("rule_digest")) & F.expr("startswith(path, rule_path)")
    )
    best = matches.groupBy("host", "path").agg(F.max("found").alias("found"))
    kept = [own[c] for c in own.columns if c not in ("rule", "verdict")]
    return own.join(best, ["host", "path"], "left").select(
        *kept,
        F.col("found.rule").alias("rule"),
        F.coalesce("found.verdict", F.lit(default)).alias("verdict"),
    )
