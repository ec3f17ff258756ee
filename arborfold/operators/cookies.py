"""Cookies as a relation: stored from headers, matched to requests, kept as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.url import url_parts


def domain_match(host: Column, domain: Column) -> Column:
    """Equal, or a suffix at a label's start."""
    return (host == domain) | ((F.length(domain) > 0) & F.endswith(host, F.concat(F.lit("."), domain)))


def path_match(path: Column, cookie_path: Column) -> Column:
    """Equal, or a prefix at a segment's end."""
    rest = F.substring(path, F.length(cookie_path) + 1, F.lit(1))
    return (path == cookie_path) | (F.startswith(path, cookie_path) & (F.endswith(cookie_path, F.lit("/")) | (rest == "/")))


def default_path(path: Column) -> Column:
    cut = F.regexp_extract(path, r"^(.*)/[^/]*$", 1)
    return F.when(cut == "", "/").otherwise(cut)


def store(headers: DataFrame) -> DataFrame:
    """The jar that Set-Cookie headers (profile, seq, url, header) leave, in order of ``seq``.

    A cookie replaces the one of its profile, name, domain and path and moves to the end. A Domain that the host does
    not match drops the cookie; expiry is not looked at. One shuffle, by profile and cookie.
    """
    rows = headers.withColumn("u", url_parts("url")).where("u.error IS NULL")
    parts = F.transform(F.split("header", ";"), lambda p: F.trim(p))
    first = F.get(F.split("header", ";"), F.lit(0))
    rows = rows.withColumn("pair", first).where(F.col("pair").contains("=")).withColumn("parts", F.slice(parts, 2, 10_000))
    key = lambda p: F.lower(F.regexp_extract(p, r"^([^=]*)", 1))
    value = lambda p: F.trim(F.regexp_extract(p, r"^[^=]*=(.*)$", 1))
    has = lambda name: F.filter("parts", lambda p: p.contains("=") & (key(p) == name))
    last = lambda name: value(F.try_element_at(has(name), F.lit(-1)))
    flag = lambda name: F.exists("parts", lambda p: ~p.contains("=") & (F.lower(p) == name))
    domain = F.lower(F.trim(F.regexp_replace(last("domain"), r"^\.+", "")))
    rows = rows.select(
        "profile", "seq", F.trim(F.regexp_extract("pair", r"^([^=]*)", 1)).alias("name"), value(F.col("pair")).alias("value"),
        F.coalesce(domain, F.col("u.host")).alias("domain"), last("path").alias("given"), default_path(F.col("u.path")).alias("fallback"),
        flag("secure").alias("secure"), last("domain").isNull().alias("host_only"), flag("httponly").alias("http_only"), F.col("u.host").alias("host"),
    )
    rows = rows.withColumn("path", F.when(F.col("given").startswith("/"), F.col("given")).otherwise(F.col("fallback")))
    rows = rows.where(F.col("host_only") | ((F.col("domain") != "") & domain_match(F.lower("host"), F.col("domain"))))
    newest = Window.partitionBy("profile", "name", "domain", "path").orderBy(F.desc("seq"))
    rows = rows.withColumn("n", F.row_number().over(newest)).where("n = 1")
    return rows.select("profile", "seq", "name", "value", "domain", "path", "secure", "host_only", "http_only")


def header_for(requests: DataFrame, jar: DataFrame, script: bool = False) -> DataFrame:
    """The Cookie header of each request (request_id, profile, url): request_id, header (null if none).

    With ``script``, what a page's script sees: no http-only cookies. Joined on the profile.
    """
    rows = requests.withColumn("u", url_parts("url"))
    c = jar.where(~F.col("http_only")) if script else jar
    c = c.select(F.col("profile").alias("c_profile"), "seq", "name", "value", "domain", F.col("path").alias("c_path"), "secure", "host_only")
    host = F.col("u.host")
    fits = F.when(F.col("host_only"), host == F.col("domain")).otherwise(domain_match(host, F.col("domain")))
    fits = fits & path_match(F.col("u.path"), F.col("c_path")) & (~F.col("secure") | (F.col("u.scheme") == "https"))
    pairs = rows.join(c, (F.col("profile") == F.col("c_profile")) & fits, "left").groupBy("request_id")
    ordered = F.array_sort(F.collect_list(F.when(F.col("seq").isNotNull(), F.struct("seq", F.concat("name", F.lit("="), "value").alias("pair")))))
    return pairs.agg(ordered.alias("o")).select("request_id", F.when(F.size("o") > 0, F.array_join(F.transform("o", lambda x: x["pair"]), "; ")).alias("header"))


def escape(value: Column) -> Column:
    """Percent signs, controls and all but ASCII as %XX."""
    pairs = F.regexp_extract_all(F.hex(value.cast("binary")), F.lit("(..)"), 1)
    return F.array_join(F.transform(pairs, _byte), "")


def _byte(pair: Column) -> Column:
    n = F.conv(pair, 16, 10).cast("int")
    return F.when((n < 32) | (n >= 127) | (n == 37), F.concat(F.lit("%"), pair)).otherwise(F.char(n))


def to_lines(jar: DataFrame) -> DataFrame:
    """One tab-separated line a cookie, in the jar's order: profile, seq, line."""
    bit = lambda c: F.col(c).cast("int").cast("string")
    return jar.select("profile", "seq", F.concat_ws("\t", "name", "domain", "path", bit("secure"), bit("host_only"), bit("http_only"), escape(F.col("value"))).alias("line"))


def from_lines(lines: DataFrame) -> DataFrame:
    """The jar of ``to_lines``; lines that don't have seven fields are left out."""
    rows = lines.withColumn("f", F.split("line", "\t")).where("size(f) = 7")
    value = F.url_decode(F.regexp_replace(F.regexp_replace(F.col("f")[6], r"\+", "%2B"), r"%(?![0-9A-Fa-f]{2})", "%25"))
    one = lambda k: F.col("f")[k] == "1"
    return rows.select("profile", "seq", F.col("f")[0].alias("name"), value.alias("value"), F.col("f")[1].alias("domain"), F.col("f")[2].alias("path"), one(3).alias("secure"), one(4).alias("host_only"), one(5).alias("http_only"))
