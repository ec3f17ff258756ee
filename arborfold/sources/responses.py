"""Responses and redirects as relations: requests are joined to them instead of a network."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bytes import decode_auto
from ..functions.url import same_origin, url_join, url_parts
from . import store

MAX_REDIRECTS = 10
#: Headers that don't go along to another origin.
KEPT_HOME = ("authorization", "cookie")


def with_target(redirects: DataFrame) -> DataFrame:
    """``redirects`` (url, status, location) with the address each leads to; a missing location leads nowhere."""
    return redirects.where(F.col("status").isin(301, 302, 303, 307, 308)).select("url", "status", url_join("url", "location")["href"].alias("target"))


def chains(redirects: DataFrame, most: int = MAX_REDIRECTS) -> DataFrame:
    """Where each redirecting address ends: url, target, hops, turned (a hop that turns other methods into GET), crossed
    (one that leaves the origin), error.

    Chains double in length each round, so as many rounds as the cap's bits do, and only redirects are joined, never
    requests; each round is written to the shared folder and the one before deleted. Repeated addresses count once, by their smallest status and place. Beyond ``most`` hops the error is
    "too many redirects"; a redirect without a place is "protocol", and ends where it stands.
    """
    one = with_target(redirects).groupBy("url").agg(F.min(F.struct("status", "target")).alias("r")).select("url", "r.status", "r.target")
    crossed = F.coalesce(~same_origin(url_parts("url"), url_parts("target")), F.lit(False))
    lost = F.col("target").isNull()
    at = one.select(
        "url", F.coalesce("target", "url").alias("target"), F.lit(1).alias("hops"), ((F.col("status") < 304) & ~lost).alias("turned"),
        F.when(lost, False).otherwise(crossed).alias("crossed"), F.when(lost, "protocol").alias("error"),
    )
    at = store.materialise(at, "redirects")
    for _ in range(most.bit_length()):
        shorter = at
        on = at.select(F.col("url").alias("n_url"), *(F.col(c).alias(f"n_{c}") for c in ("target", "hops", "turned", "crossed", "error")))
        both = at.join(on, (F.col("target") == F.col("n_url")) & F.col("error").isNull(), "left")
        at = both.select(
            "url", F.coalesce("n_target", "target").alias("target"), (F.col("hops") + F.coalesce("n_hops", F.lit(0))).alias("hops"),
            (F.col("turned") | F.coalesce("n_turned", F.lit(False))).alias("turned"), (F.col("crossed") | F.coalesce("n_crossed", F.lit(False))).alias("crossed"),
            F.coalesce("error", "n_error").alias("error"),
        )
        at = store.materialise(at, "redirects")
        store.drop(shorter)
    return at.withColumn("error", F.when(F.col("hops") > most, "too many redirects").otherwise(F.col("error")))


def follow(requests: DataFrame, redirects: DataFrame, most: int = MAX_REDIRECTS) -> DataFrame:
    """Where requests (request_id, method, url) end: request_id, method, url, hops, crossed, error.

    301 to 303 turn any method but GET into GET; 307 and 308 keep it. A request beyond ``most`` hops has the error "too many
    redirects" and the place its chain had then been followed to. Requests are joined once, whatever their number.
    """
    end = chains(redirects, most).withColumnRenamed("url", "from")
    rows = requests.join(end, F.col("url") == F.col("from"), "left")
    method = F.when(F.col("turned"), "GET").otherwise(F.col("method"))
    return rows.select("request_id", method.alias("method"), F.coalesce("target", "url").alias("url"), F.coalesce("hops", F.lit(0)).alias("hops"), F.coalesce("crossed", F.lit(False)).alias("crossed"), "error")


def key_of(at: Column) -> Column:
    """An address as requests name it: without its fragment."""
    return F.regexp_replace(at, "#.*$", "")


def send(requests: DataFrame, responses: DataFrame, redirects: DataFrame | None = None, most: int = MAX_REDIRECTS) -> DataFrame:
    """Requests (request_id, method, url, headers, body) answered from ``responses`` (method, url, form, status, headers, body):
    request_id, method, url (where they end), sent (headers), sent_body, hops, status, headers, body, error.

    A body goes as form under its method until a hop turns the method into GET; headers that belong to one origin are
    left behind once a hop crosses it. Without a response the error is "not found". Null headers are none.
    """
    asked = requests.select("request_id", F.upper("method").alias("method"), key_of(F.col("url")).alias("url"), "headers", F.coalesce("body", F.lit("")).alias("sent_body"))
    if redirects is None:
        rows = asked.select("*", F.lit(0).alias("hops"), F.lit(False).alias("crossed"), F.lit(None).cast("string").alias("error")).withColumn("kept", F.col("sent_body"))
    else:
        end = chains(redirects.withColumn("url", key_of(F.col("url"))), most).withColumnRenamed("url", "from")
        rows = asked.join(end, F.col("url") == F.col("from"), "left").withColumn("turned", F.coalesce("turned", F.lit(False)) & (F.col("method") != "GET"))
        rows = rows.withColumn("url", key_of(F.coalesce("target", "url"))).withColumn("kept", F.when(F.col("turned"), "").otherwise(F.col("sent_body")))
        rows = rows.withColumn("method", F.when(F.col("turned"), "GET").otherwise(F.col("method"))).withColumn("hops", F.coalesce("hops", F.lit(0))).withColumn("crossed", F.coalesce("crossed", F.lit(False)))
    own = F.coalesce("headers", F.array().cast("array<struct<name:string,value:string>>"))
    sent = F.when(F.col("crossed"), F.filter(own, lambda h: ~F.lower(h["name"]).isin(*KEPT_HOME))).otherwise(own)
    rows = rows.select("request_id", "method", "url", sent.alias("sent"), F.col("kept").alias("sent_body"), "hops", "error")
    got = responses.select(F.upper("method").alias("r_method"), key_of(F.col("url")).alias("r_url"), F.coalesce("form", F.lit("")).alias("r_form"), "status", "headers", "body")
    out = rows.join(got, (F.col("method") == F.col("r_method")) & (F.col("url") == F.col("r_url")) & (F.col("sent_body") == F.col("r_form")), "left")
    return out.select("request_id", "method", "url", "sent", "sent_body", "hops", "status", "headers", "body", F.coalesce("error", F.when(F.col("status").isNull(), "not found")).alias("error"))


def texts(responses: DataFrame) -> DataFrame:
    """``responses`` (headers, body, more) with text: the body under its declared or sniffed charset."""
    kind = F.get(F.filter("headers", lambda h: h["name"] == "content-type"), F.lit(0))["value"]
    return responses.withColumn("text", decode_auto("body", kind))


def parse_headers(column: str):
    """Header lines as an array of (name, value), names lower-cased, repeats kept."""
    lines = F.filter(F.split(column, r"\r?\n"), lambda s: s.contains(":"))
    return F.transform(lines, lambda s: F.struct(F.lower(F.trim(F.regexp_extract(s, r"^([^:]*)", 1))).alias("name"), F.trim(F.regexp_extract(s, r"^[^:]*:(.*)$", 1)).alias("value")))
