"""URL filter: host-suffix and path-prefix expressions against a rule table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"://([^/?#]*)([^?#]*)"
#: Rule tables up to this many rows (some 100 bytes each) may be broadcast.
BROADCAST_RULES = 100_000


def url_parts(url):
    """(host, path) columns; both empty for a null url or one without '://'."""
    u = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(u, _PARTS, 1), UPPER, LOWER), F.regexp_extract(u, _PARTS, 2)


def url_filter(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow", broadcast_rules: int = BROADCAST_RULES) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict.

    ``rules`` has host, path and verdict (allow or block). A rule fits its host
    and every subdomain if the url's path starts with the rule's path. The
    longest rule (host and path together) wins; of equally long ones the one
    with the longer host, then block. Without a fitting rule ``rule`` is null and
    the verdict is ``default``.

    Each distinct (host, path) is expanded into host suffixes at label borders
    times path prefixes of the lengths that occur among the rules, joined to the
    rules on the first 32 bits of the digest and confirmed on the full digest.
    Rules are broadcast after a count shows they are at most ``broadcast_rules``;
    beyond that the join shuffles. A url that fills a third of the table is
    expanded once.

    Edge cases: null urls have empty host and path and fit no rule; null ids and
    repeated rows pass through; rules with a null or empty host, or a null
    verdict, fit nothing; a null rule path is the empty path; very long urls are
    expanded whole; an empty table gives an empty result, no rules give every page
    the default; further columns are ignored.
    """
    host, path = url_parts(F.col(url_col))
    base = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    known = (
        rules.select(F.translate("host", UPPER, LOWER).alias("rh"), F.coalesce("path", F.lit("")).alias("rp"), "verdict")
        .where("rh <> '' AND verdict IS NOT NULL")
        .groupBy("rh", "rp")
        .agg(F.max("verdict").alias("rv"))  # 'block' sorts after 'allow'
        .withColumn("rd", F.sha2(F.concat("rh", F.lit("\x00"), "rp"), 256))
        .withColumn("rk", F.substring("rd", 1, 8))
    )
    lens = sorted(r[0] for r in known.select(F.length("rp")).distinct().collect())  # as many as there are distinct path lengths
    if small(known, broadcast_rules):
        known = F.broadcast(known)

    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    tries = (
        base.where("host <> ''")
        .select("host", "path")
        .distinct()
        .select("host", "path", F.explode(suffixes).alias("sh"))
        .select("host", "path", "sh", F.explode(F.array(*map(F.lit, lens)).cast("array<int>")).alias("n"))
        .where(F.col("n") <= F.length("path"))
        .select("host", "path", F.sha2(F.concat("sh", F.lit("\x00"), F.expr("substring(path, 1, n)")), 256).alias("d"))
        .withColumn("k", F.substring("d", 1, 8))
    )
    # inside coalesce() the full digest is no join key: it is compared where the short ones are equal
    hits = tries.join(known, (F.col("k") == F.col("rk")) & F.coalesce(F.col("d") == F.col("rd"), F.lit(False)))
    best = (
        hits.groupBy("host", "path")
        .agg(F.max(F.struct((F.length("rh") + F.length("rp")).alias("n"), F.length("rh").alias("hn"), "rv", "rh", "rp")).alias("b"))
        .select(F.col("host").alias("bh"), F.col("path").alias("bp"), F.concat("b.rh", "b.rp").alias("rule"), F.col("b.rv").alias("rv"))
    )
    return base.join(best, (F.col("host") == F.col("bh")) & (F.col("path") == F.col("bp")), "left").select(
        "page_id", "host", "path", "rule", F.coalesce("rv", F.lit(default)).alias("verdict")
    )
