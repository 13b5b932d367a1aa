"""URL filters by hashed expressions, with DataFrame functions only.

A url's host is cut into its suffixes of as many labels as rules have and its path into the prefixes of their lengths; host suffix
and path prefix make an expression. Expressions meet the rules in an equi-join on the first 32 bits of their SHA-256, the
full digests confirm, and the longest rule wins: its action is the verdict, `DEFAULT` where none fits.

Distinct pairs of host and path (no longer than the longest rule) are expanded once, so that a frequent host costs no
more; verdicts of frequent pairs, of which there are 10,000 at most, are broadcast to their pages. Rules are broadcast up to `BROADCAST_RULES` of them, counted beforehand, and joined by shuffle beyond.

Nulls and odd rows: a null url or one without `://` has an empty host and path and fits no rule; null and repeated ids
are rows like any other; rules with a null part are ignored; of equal rules the one with the smallest action counts; an
empty table gives an empty result. Columns of pages named like the result's are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, hot, others, packed_up, unpacked

DEFAULT = "allow"
BROADCAST_RULES = 200_000


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.contains(url, F.lit("://")), F.substr(url, F.locate("://", url) + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"(?s)^([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def judge(pages: DataFrame, rules: DataFrame, url: str = "url") -> DataFrame:
    """pages with host, path, rule (as host and path in one; null if none) and verdict. rules: host, path, action."""
    own = rules.where("host is not null and path is not null and action is not null").groupBy("host", "path").agg(F.min("action").alias("action"))
    own = own.select(F.concat("host", "path").alias("rule"), F.length("host").alias("rule_host"), F.length("path").alias("rule_path"), (F.regexp_count("host", F.lit(r"\.")) + 1).alias("rule_labels"), "action", _digest(F.col("host"), F.col("path")).alias("rule_digest"))
    own = own.withColumn("short", F.substring("rule_digest", 1, 8))
    facts = own.agg(F.count("*").alias("n"), F.sort_array(F.collect_set("rule_path")).alias("lengths"), F.sort_array(F.collect_set("rule_labels")).alias("labels")).first()
    lengths, labels = facts["lengths"] or [0], facts["labels"] or [1]
    columns = others(pages, "host", "path", "rule", "verdict")
    host, path = host_and_path(F.col(url).cast("string"))
    named = pages.select(packed_up(columns), host.alias("host"), path.alias("path")).withColumn("path_head", F.substring("path", 1, max(lengths)))
    counted = cut(named.groupBy("host", "path_head").agg(F.count("*").alias("n")))
    hosts = counted.select("host", "path_head").where("host <> ''")
    # only suffixes of as many labels as some rule has: a host of very many dots makes no more of them
    suffixes = F.array_distinct(F.array(*[F.substring_index("host", ".", -k) for k in labels]))
    each = F.flatten(F.transform(suffixes, lambda h: F.transform(F.filter(F.lit(lengths), lambda n: n <= F.length("path_head")), lambda n: F.struct(_digest(h, F.substr(F.col("path_head"), F.lit(1), n)).alias("digest")))))
    tried = hosts.select("host", "path_head", F.explode(each).alias("e")).select("host", "path_head", "e.digest", F.substring("e.digest", 1, 8).alias("short"))
    table = F.broadcast(own) if facts["n"] <= BROADCAST_RULES else own
    fits = tried.join(table, "short").where(F.col("digest") == F.col("rule_digest"))
    best = fits.groupBy("host", "path_head").agg(F.max(F.struct(F.length("rule").alias("n"), F.col("rule_host").alias("h"), "rule", "action")).alias("best"))
    best = cut(best)
    rows = counted.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    often = F.broadcast(hot(counted, rows).select("host", "path_head").join(best, ["host", "path_head"], "left").withColumn("frequent", F.lit(True)))
    # frequent pairs have their verdict from a broadcast of at most 10,000, the others by a shuffle
    marked = named.join(often, ["host", "path_head"], "left")
    judged = marked.where("frequent").drop("frequent").unionByName(marked.where("frequent is null").drop("frequent", "best").join(best, ["host", "path_head"], "left"))
    return judged.select(*unpacked(columns), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.action", F.lit(DEFAULT)).alias("verdict"))
