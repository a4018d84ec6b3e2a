"""URL allow and block rules by host suffix and path prefix.

A rule (host, path) fits the host and all its subdomains where the url's path starts with the
rule's; the longest fitting rule (host and path together, then host) decides.

Sort-merge range join: the canonical key of a rule is its host with the labels reversed, then its
path. For each of a url's host suffixes that some rule has, the url gets the key of that suffix and
its path; the rule is then a plain prefix of the key, and the keys with a prefix form an interval.
Intervals of prefixes are nested or apart, so a sweep over the sorted keys has the active rules on
a stack: the last rule that began, and those around it. The stack of each rule is made once from
the rules; the sweep carries it forward with a window, and takes the deepest that holds the key.

Scale: urls are first reduced to distinct (host, path). The sweep runs per rule host, and a host is
cut into as many salts as its share of all keys needs, its rules repeated for each; so no task gets
more than its share. Up to MOST_HOSTS rule hosts (counted first) are broadcast to find the urls that
have them; more are joined by shuffling. Only DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MOST_HOSTS = 200_000  # rows of a host name and a number: some 20 MB
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to / ? # or the end, A-Z lower-cased. Path: then up to ? # or
    the end. Both empty without ://."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def _reversed_labels(host: Column) -> Column:
    return F.array_join(F.reverse(F.split(host, r"\.", -1)), ".")


def _rule_stacks(rules: DataFrame) -> DataFrame:
    """(rule_host, key, stack): each rule with all rules it is nested in and itself, deepest first.

    A rule lies inside another of its host if that one's key is a prefix of its own, so its prefixes
    are looked up by equality."""
    keyed = (rules.groupBy("rule_host", "rule_path").agg(F.min("verdict").alias("verdict"))
             .withColumn("key", F.concat(_reversed_labels(F.col("rule_host")), F.lit("/"), "rule_path")))
    outer = keyed.select("rule_host", F.col("key").alias("prefix"), "rule_path", "verdict")
    inner = keyed.select("rule_host", "key", F.explode(F.sequence(F.lit(1), F.length("key"))).alias("n"))
    return (inner.select("rule_host", "key", F.substring("key", F.lit(1), F.col("n")).alias("prefix"))
            .join(outer, ["rule_host", "prefix"])
            .groupBy("rule_host", "key")
            .agg(F.sort_array(F.collect_list(F.struct(F.length("prefix").alias("n"), "prefix", "rule_path", "verdict")), asc=False)
                 .alias("stack")))


def judge_urls(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow") -> DataFrame:
    """pages with host, path, rule and verdict added (columns of these names are replaced).

    rules: (host, path, verdict). Urls that no rule fits get a null rule and the verdict `default`;
    so do null urls and such without ://. Of equal rules with different verdicts the smaller verdict
    (allow) counts. Rules without a host or path count as empty there; an empty host fits only
    empty hosts.
    """
    spark = pages.sparkSession
    host, path = host_and_path(F.col(url_col))
    parsed = pages.drop("host", "path", "rule", "verdict").withColumns({"host": host, "path": path}) \
        if url_col not in ("host", "path", "rule", "verdict") else pages.withColumns({"host": host, "path": path}).drop("rule", "verdict")
    stacks = _rule_stacks(rules.select(F.translate(F.coalesce("host", F.lit("")), UPPER, LOWER).alias("rule_host"),
                                       F.coalesce("path", F.lit("")).alias("rule_path"), "verdict"))
    targets = parsed.select("host", "path").distinct()
    labels = F.split("host", r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)),
                           lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    hosts = stacks.select("rule_host").distinct()
    # rule hosts are small beside urls, but only a counted table is broadcast
    small = F.broadcast if hosts.limit(MOST_HOSTS + 1).count() <= MOST_HOSTS else lambda df: df
    points = targets.select("host", "path", F.explode(suffixes).alias("rule_host")).join(small(hosts), "rule_host")

    # as many salts for a host as tasks that its share of all points fills
    tasks = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    sizes = points.groupBy("rule_host").agg(F.count(F.lit(1)).alias("n"))
    total = sizes.agg(F.sum("n")).first()[0] or 1
    salts = sizes.select("rule_host", F.greatest(F.lit(1), F.ceil(F.col("n") * tasks / F.lit(total))).cast("bigint").alias("salts"))
    none = F.lit(None).cast(stacks.schema["stack"].dataType)
    starts = stacks.join(salts, "rule_host").select(
        "rule_host", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("salts") - 1)).alias("salt"), "key",
        F.lit(0).alias("kind"), "stack", F.lit(None).cast("string").alias("host"), F.lit(None).cast("string").alias("path"))
    swept = points.join(small(salts), "rule_host").select(
        "rule_host", F.pmod(F.xxhash64("host", "path"), F.col("salts")).alias("salt"),
        F.concat(_reversed_labels(F.col("rule_host")), F.lit("/"), "path").alias("key"),
        F.lit(1).alias("kind"), none.alias("stack"), "host", "path")
    sweep = Window.partitionBy("rule_host", "salt").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, 0)
    active = starts.union(swept).withColumn("active", F.last("stack", ignorenulls=True).over(sweep)).filter("kind = 1")
    fitting = F.get(F.filter("active", lambda r: F.col("key").startswith(r.prefix)), F.lit(0))
    best = (active.withColumn("fit", fitting).filter("fit is not null")
            .groupBy("host", "path")
            .agg(F.max(F.struct((F.length("rule_host") + F.length("fit.rule_path")).alias("n"), F.length("rule_host").alias("h"),
                                F.concat("rule_host", "fit.rule_path").alias("rule"), F.col("fit.verdict").alias("verdict"))).alias("best")))
    judged = parsed.join(best, ["host", "path"], "left")
    return judged.withColumns({"rule": F.col("best.rule"), "verdict": F.coalesce("best.verdict", F.lit(default))}).drop("best")
