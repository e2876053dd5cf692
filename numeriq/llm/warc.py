"""WARC not-modified records: each revisit is resolved to the latest earlier full response of its canonical URL.

Records: record_id long, url string, ts long, type string (response or revisit), status int, etag string, last_modified string,
digest string (of the payload), headers map<string,string>. More columns are ignored.

A full response has type response, status 200 and a digest. Earlier means a smaller (ts, record_id). A revisit gets

    no_response          no earlier full response of its canonical URL
    validator_mismatch   the latest one has another ETag (compared weakly) or, where an ETag is missing on a side, another Last-Modified
    unvalidated          neither validator is there on both sides
    resolved             otherwise; its headers are those of the response, replaced by the permitted ones of the revisit

Nulls: a null URL, ts or record_id takes no part in the join (no_response); null headers count as none; header names are
compared in lower case, the first of a name counts. Repeated rows are resolved each. An empty table gives no rows.
Values of any length are compared and carried whole.

The join is two windows, both native. Timelines are cut at quantiles of ts, so a URL with a third of all records is dealt to many
tasks; what a block hands on is one response, and the second window reads one row per URL and block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

#: Fields that a 304 response may update in a stored response.
PERMITTED = ("age", "cache-control", "content-location", "date", "etag", "expires", "last-modified", "set-cookie", "vary", "warning")


def canonical_url(url: Column) -> Column:
    """Host in lower case without user, www. and a default port; path without trailing slashes; sorted query without utm_ fields; no scheme, no fragment."""
    rest = F.regexp_replace(F.regexp_replace(F.trim(url), r"#.*$", ""), r"^([a-zA-Z][a-zA-Z0-9+.-]*:)?//", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(rest, r"^[^/?]*", 0)), r"^[^@]*@|:(80|443)$", ""), r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(rest, r"^[^/?]*([^?]*)", 1), r"/+$", "")
    fields = F.filter(F.split(F.regexp_extract(rest, r"^[^?]*\?(.*)$", 1), "&"), lambda x: (x != "") & ~x.startswith("utm_"))
    query = F.array_join(F.array_sort(fields), "&")
    return F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def lower_names(headers: Column) -> Column:
    entries = F.coalesce(F.map_entries(headers), F.expr("cast(array() as array<struct<key:string,value:string>>)"))
    names = F.array_distinct(F.transform(entries, lambda e: F.lower(e["key"])))
    return F.map_from_arrays(names, F.transform(names, lambda n: F.element_at(F.filter(entries, lambda e: F.lower(e["key"]) == n), 1)["value"]))


def merge_headers(stored: Column, update: Column) -> Column:
    allowed = F.map_filter(update, lambda k, v: k.isin(*PERMITTED))
    return F.map_concat(F.map_filter(stored, lambda k, v: ~F.array_contains(F.map_keys(allowed), k)), allowed)


def resolve_revisits(records: DataFrame, blocks: int = 64) -> DataFrame:
    """record_id, url_key, response_id, outcome, digest, headers for every revisit."""
    r = records.select(
        F.col("record_id").cast("long").alias("record_id"), F.col("ts").cast("long").alias("ts"), F.col("type"), F.col("status").cast("int").alias("status"),
        F.col("etag"), F.col("last_modified"), F.col("digest"), lower_names(F.col("headers")).alias("headers"), canonical_url(F.col("url")).alias("url_key"),
    )
    # At most `blocks` numbers come to the driver.
    found = r.agg(F.percentile_approx("ts", [i / blocks for i in range(1, blocks)], 1000).alias("cuts")).first()["cuts"]
    cuts = sorted(set(found or []))
    block = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col("ts"))) if cuts else F.lit(0)
    full = (F.col("type") == "response") & (F.col("status") == 200) & F.col("digest").isNotNull() & F.col("url_key").isNotNull() & F.col("ts").isNotNull() & F.col("record_id").isNotNull()
    stored = F.struct("ts", "record_id", "etag", "last_modified", "digest", "headers")
    r = r.withColumn("block", F.coalesce(block, F.lit(0))).withColumn("stored", F.when(full, stored))
    # Revisits without a usable place in a timeline get a key that no response has, of their id or else a hash of their fields: a retried task
    # deals them alike, and no task holds them all.
    lost = F.col("url_key").isNull() | F.col("ts").isNull() | F.col("record_id").isNull()
    r = r.withColumn("key", F.when(lost, F.concat(F.lit("\u0000"), F.coalesce(F.col("record_id"), F.xxhash64("ts", "type", "status", "etag", "last_modified", "digest", "url_key")).cast("string"))).otherwise(F.col("url_key")))
    within = Window.partitionBy("key", "block").orderBy("ts", "record_id").rowsBetween(Window.unboundedPreceding, -1)
    near = r.withColumn("near", F.last("stored", ignorenulls=True).over(within)).filter(F.col("type") == "revisit")
    handed = r.filter("stored is not null").groupBy("key", "block").agg(F.max(F.struct("ts", "record_id")).alias("at"), F.max_by("stored", F.struct("ts", "record_id")).alias("handed"))
    # (key, block) of every revisit, and what earlier blocks handed on.
    places = near.select("key", "block").distinct().join(handed.drop("at"), ["key", "block"], "full_outer")
    across = Window.partitionBy("key").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = places.withColumn("far", F.last("handed", ignorenulls=True).over(across)).drop("handed").filter("far is not null")
    seen = near.join(before, ["key", "block"], "left").withColumn("of", F.coalesce("near", "far"))

    def weak(c):
        return F.regexp_replace(c, r"^W/", "")

    tags = F.col("etag").isNotNull() & F.col("of.etag").isNotNull()
    dates = F.col("last_modified").isNotNull() & F.col("of.last_modified").isNotNull()
    outcome = (
        F.when(F.col("of").isNull(), "no_response")
        .when(tags, F.when(weak(F.col("etag")) == weak(F.col("of.etag")), "resolved").otherwise("validator_mismatch"))
        .when(dates, F.when(F.col("last_modified") == F.col("of.last_modified"), "resolved").otherwise("validator_mismatch"))
        .otherwise("unvalidated")
    )
    ok = F.col("outcome") == "resolved"
    return seen.withColumn("outcome", outcome).select(
        "record_id", "url_key", F.when(ok, F.col("of.record_id")).alias("response_id"), "outcome",
        F.when(ok, F.col("of.digest")).alias("digest"), F.when(ok, merge_headers(F.col("of.headers"), F.col("headers"))).alias("headers"),
    )


def page_records(pages: DataFrame) -> DataFrame:
    """Crawl records that `pages` stand for: each page is a full response; it is asked for again a while later by another spelling of
    its URL, and once before or at about its own time, and both times the answer is that the text which this page holds is current."""
    p = pages.select(F.col("page_id").cast("long").alias("id"), "url", F.sha2(F.coalesce("html", F.lit("")), 256).alias("digest"))
    tag = F.concat(F.lit('"'), F.substring("digest", 1, 16), F.lit('"'))
    at = F.col("id") * 10
    again, early = F.pmod(F.col("id") * 7919, F.lit(5000)) * 10 + 5, F.pmod(F.col("id"), F.lit(7)) * 10 - 35

    def record(n, when, kind, status, url, etag, headers):
        return F.struct(
            (F.col("id") * 4 + n).alias("record_id"), when.alias("ts"), F.lit(kind).alias("type"), F.lit(status).alias("status"), url.alias("url"), etag.alias("etag"),
            F.lit(None).cast("string").alias("last_modified"), F.when(F.lit(n == 0), F.col("digest")).alias("digest"), headers.alias("headers"),
        )

    def headers(kind, when):
        return F.create_map(F.lit("ETag"), tag, F.lit("Date"), when.cast("string"), F.lit("Content-Type"), F.lit(kind))

    rows = F.array(
        record(0, at, "response", 200, F.col("url"), tag, F.map_concat(headers("text/html", at), F.create_map(F.lit("Server"), F.lit("a")))),
        record(1, at + again, "revisit", 304, F.concat(F.col("url"), F.lit("#again")), F.concat(F.lit("W/"), tag), headers("text/plain", at + again)),
        record(2, at + early, "revisit", 304, F.col("url"), tag, headers("text/plain", at + early)),
    )
    return p.select(F.inline(rows))


def op9_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every revisit record of `pages`, resolved; headers as sorted name=value fields."""
    out = resolve_revisits(page_records(table(spark, sf_dir, "pages").select("page_id", "url", "html")))
    fields = F.array_join(F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ";")
    return out.select("record_id", "url_key", "response_id", "outcome", "digest", fields.alias("headers"))
