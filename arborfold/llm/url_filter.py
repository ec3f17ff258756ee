"""URL filters by a sort-merge range join, by DataFrame functions alone.

A host is keyed by its labels from the last to the first, each closed by a dot, so a rule for a host and its
subdomains is an interval of keys: all that begin with the rule's. Intervals of prefixes nest or are disjoint. Keys and
starts of intervals are sorted together and cut into ranges; a sweep through each range keeps the stack of the rules
that are open, a slot for each depth of nesting, and reads off at each key the slots that hold it. What is open where a
range begins are the rules that its first key begins with. A first sweep finds the hosts of rules that hold a url's
host, a second sweeps keys of those hosts with the url's path, where rules' paths are the intervals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rules of the query: (host, path, verdict).
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
VERDICT = "allow"  # of a url that no rule fits


def host_of(url: Column) -> Column:
    """After the first :// up to a slash, ? or #, with A-Z in lower case; empty if there is none."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What stands between host and ? or #."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def reversed_host(host: Column) -> Column:
    """``www.example.net`` as ``net.example.www.``; an empty host stays empty."""
    labels = F.concat(F.array_join(F.reverse(F.split(host, "\\.")), "."), F.lit("."))
    return F.when(host == "", "").otherwise(labels)


def sweep(points: DataFrame, prefixes: DataFrame, name: str) -> DataFrame:
    """``points`` (key, rid, more) with ``open``: the payloads of all ``prefixes`` (prefix, payload) that key begins with,
    the shortest first.

    Prefixes must not be empty or repeat. Equal keys are spread by rid, so that a range holds its share of rows
    whatever the keys. Ranges are written out, so a task that runs again meets the same rows; an event is a row
    of points or of prefixes, and a range gets at most one more row for each prefix of its first key.
    """
    size = F.length("prefix")
    longest = prefixes.agg(F.max(size)).first()[0]
    if longest is None:
        kind = prefixes.schema["payload"].dataType.simpleString()
        return points.withColumn("open", F.array().cast(f"array<{kind}>"))
    heads = lambda key: F.explode(F.transform(F.sequence(F.lit(1), F.least(F.length(key), F.lit(longest))), lambda n: F.substring(key, 1, n)))
    inside = prefixes.select("prefix", heads(F.col("prefix")).alias("outer")).join(prefixes.select(F.col("prefix").alias("outer")), "outer")
    depth = inside.groupBy("prefix").agg(F.count("*").cast("int").alias("depth"))
    starts = common.materialise(prefixes.join(depth, "prefix"), f"{name}-starts")
    deepest = starts.agg(F.max("depth")).first()[0]
    opened = F.struct("prefix", "payload").alias("opened")
    events = points.unionByName(starts.select(F.col("prefix").alias("key"), "depth", opened), allowMissingColumns=True)
    dealt = common.materialise(events.repartitionByRange("key", "rid").withColumn("part", F.spark_partition_id()), f"{name}-ranges")
    first = dealt.groupBy("part").agg(F.min("key").alias("first")).select("part", heads(F.col("first")).alias("prefix"))
    carried = first.join(starts, "prefix").select("part", F.col("prefix").alias("key"), "depth", opened)
    through = Window.partitionBy("part").orderBy("key", F.col("rid").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    slots = [F.last(F.when(F.col("depth") == d, F.col("opened")), ignorenulls=True).over(through) for d in range(1, deepest + 1)]
    swept = dealt.unionByName(carried, allowMissingColumns=True).withColumn("slots", F.array(*slots)).where("rid IS NOT NULL")
    held = F.filter("slots", lambda s: s.isNotNull() & F.startswith(F.col("key"), s["prefix"]))
    return swept.withColumn("open", F.transform(held, lambda s: s["payload"])).select(*points.columns, "open")


def filter_urls(pages: DataFrame, rules: DataFrame, verdict: str = VERDICT) -> DataFrame:
    """page_id, host, path, rule, verdict of every row of ``pages`` (page_id, url).

    ``rules`` (host, path, verdict) fit a url whose host is the rule's or a subdomain of it and whose path starts
    with the rule's (null: any path); the longest host decides, then the longest path, and ``block`` where a rule is given both ways. Rule
    hosts are put in lower case. Rules without a host fit nothing. Urls no rule fits get ``verdict``.
    Null urls and those without :// have neither host nor path. Ports and a trailing dot are part of the host.
    Repeated rows and null page_ids stay; other columns are ignored; an empty table gives an empty result.
    """
    url = F.col("url").cast("string")
    rows = common.materialise(pages.select(F.monotonically_increasing_id().alias("rid"), "page_id", host_of(url).alias("host"), path_of(url).alias("path")), "url-rows")
    host = F.translate("host", UPPER, LOWER)
    kept = rules.where("host <> ''").select(host.alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict")
    kept = kept.groupBy("host", "path").agg(F.max_by("verdict", F.struct(F.col("verdict") == "block", "verdict")).alias("verdict"))
    kept = common.materialise(kept.withColumn("key", reversed_host(F.col("host"))), "url-rules")
    hosts = kept.select(F.col("key").alias("prefix")).distinct().withColumn("payload", F.col("prefix"))
    # hosts hold no slash, so one closes the host's key
    paths = kept.select(F.concat("key", F.lit("/"), "path").alias("prefix"), F.struct(F.length("key").alias("n"), F.length("path").alias("m"), F.concat("host", "path").alias("rule"), "verdict").alias("payload"))
    keys = rows.where("host <> ''").select(reversed_host(F.col("host")).alias("key"), "rid", "path")
    fits = sweep(keys, hosts, "url-hosts").select("rid", "path", F.explode("open").alias("of"))
    found = sweep(fits.select(F.concat("of", F.lit("/"), "path").alias("key"), "rid"), paths, "url-paths")
    best = found.where(F.size("open") > 0).groupBy("rid").agg(F.max(F.try_element_at("open", F.lit(-1))).alias("best"))
    out = rows.join(best, "rid", "left")
    return out.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(verdict)).alias("verdict"))


_VALUES = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
ORACLE_SQL = f"""
WITH u AS (
  SELECT row_number() OVER () AS r, page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), '{UPPER}', '{LOWER}') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages
), rules(h, p, v) AS (VALUES {_VALUES}),
j AS (SELECT u.*, h || p AS rule, v, row_number() OVER (PARTITION BY r ORDER BY length(h) DESC NULLS LAST, length(p) DESC) AS n
  FROM u LEFT JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT page_id, host, path, rule, coalesce(v, '{VERDICT}') AS verdict FROM j WHERE n = 1
"""


def query_rules(spark: SparkSession) -> DataFrame:
    values = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
    return spark.sql(f"SELECT * FROM VALUES {values} AS r(host, path, verdict)")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on all pages under the rules above."""
    return filter_urls(common.table(spark, sf_dir, "pages"), query_rules(spark))
