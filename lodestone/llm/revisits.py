"""Resolution of not-modified revisit records of a web archive.

A revisit record holds the headers of a 304 answer and no body. It is resolved by an as-of join: the latest full
response to the same canonical URL from before it. Validators must agree (entity tags by weak comparison, else dates of last
modification, else payload digests); then the response's headers are taken over, with those replaced that a 304 answer
may update.

The as-of join is two-level. Within a slice of time of a URL a range window finds the latest response strictly before a
revisit; the last responses of earlier slices come from map-side combined aggregates, one row per URL and slice. So
a URL with a large share of all records is dealt by time. Bodies and headers are not in the windows; they are joined by
record id afterwards.

Defined cases: a null URL or date has no base (status ``no_base``), a response without URL, date or body is no base; of
responses at one time the largest id is taken, a response at the revisit's own time is not earlier; without a common
validator the base stands as ``unchecked``; responses that repeat an id and date count once; repeated revisits are each
resolved; null headers are empty; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lodestone.registry import query
from lodestone.session import table

SLICE_SECONDS = 3600

#: Headers of a 304 answer that replace those of the stored response.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "vary")

_TRACKING = "^(utm_[^=]*|gclid|fbclid)(=|$)"
_URL = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?([^#]*))?"


def canonical_url(url: Column) -> Column:
    """Host in lower case without user, default port and www, path, and the sorted parameters that are not for tracking."""
    part = lambda i: F.regexp_extract(url, _URL, i)
    host = F.regexp_replace(F.lower(part(2)), "^.*@|:(80|443)$", "")
    host = F.regexp_replace(host, r"^www\.", "")
    path = F.when(part(3) == "", "/").otherwise(part(3))
    held = F.array_sort(F.filter(F.split(part(5), "&"), lambda p: (p != "") & ~p.rlike(_TRACKING)))
    asked = F.array_join(held, "&")
    return F.when(url.rlike(_URL), F.concat(host, path, F.when(asked == "", "").otherwise(F.concat(F.lit("?"), asked))))


def _tag(headers: Column) -> Column:
    return F.regexp_replace(headers["etag"], "^W/", "")


def resolve_revisits(records: DataFrame, slice_seconds: int = SLICE_SECONDS) -> DataFrame:
    """One row per revisit: record_id, base_id, status, headers (merged) and body (of the base, where validators agree).

    ``records`` has record_id, kind (response or revisit), url, seconds (long), headers (map with lower-case
    names), digest and body.
    """
    rows = records.select(
        "record_id", "kind", canonical_url(F.col("url")).alias("site"), "seconds",
        F.coalesce("headers", F.create_map().cast("map<string,string>")).alias("headers"), "digest", "body")
    full = (F.col("kind") == "response") & F.col("body").isNotNull()
    keyed = rows.filter("site IS NOT NULL AND seconds IS NOT NULL").select(
        "record_id", "kind", "site", "seconds", F.floor(F.col("seconds") / slice_seconds).alias("part"),
        F.when(full, F.struct("seconds", "record_id")).alias("at"))
    before = Window.partitionBy("site", "part").orderBy("seconds").rangeBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy("site").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = keyed.groupBy("site", "part").agg(F.max("at").alias("last")).withColumn("carried", F.max("last").over(earlier)).drop("last")
    near = keyed.filter("at IS NOT NULL OR kind = 'revisit'").withColumn("near", F.max("at").over(before)).filter("kind = 'revisit'")
    found = near.join(carried, ["site", "part"], "left").select(
        "record_id", "seconds", "site", F.coalesce("near", "carried").alias("base")).distinct()
    revisits = rows.filter("kind = 'revisit'").drop("body", "kind")
    placed = revisits.join(found, ["record_id", "site", "seconds"], "left")
    bases = rows.filter(full & F.col("seconds").isNotNull()).dropDuplicates(["record_id", "seconds"]).select(
        F.struct("seconds", "record_id").alias("base"), F.col("headers").alias("b_headers"), F.col("digest").alias("b_digest"), "body")
    joined = placed.join(bases, "base", "left")
    tags, own = (_tag(F.col("headers")), _tag(F.col("b_headers"))), lambda a, b: a.isNotNull() & b.isNotNull()
    dates = (F.col("headers")["last-modified"], F.col("b_headers")["last-modified"])
    sums = (F.col("digest"), F.col("b_digest"))
    agree = F.lit(None).cast("boolean")
    for pair in (sums, dates, tags):
        agree = F.when(own(*pair), pair[0] == pair[1]).otherwise(agree)
    status = F.when(F.col("base").isNull(), "no_base").when(agree.isNull(), "unchecked").when(agree, "resolved").otherwise("mismatch")
    usable = status.isin("resolved", "unchecked")
    news = F.map_filter("headers", lambda k, _: k.isin(*PERMITTED))
    merged = F.map_concat(F.map_filter("b_headers", lambda k, _: ~F.array_contains(F.map_keys(news), k)), news)
    return joined.select(
        "record_id", F.col("base.record_id").alias("base_id"), status.alias("status"), F.when(usable, merged).alias("headers"),
        F.when(usable, F.col("body")).alias("body"))


def page_records(pages: DataFrame) -> DataFrame:
    """Archive records from pages: neighbouring pages of a site are captures of one URL, every third one in full."""
    site = F.regexp_replace("url", "/[0-9]+", F.concat(F.lit("/"), (F.col("page_id") % 7).cast("string")))
    full = F.col("page_id") % 3 == 0
    tag = F.when(F.col("page_id") % 11 == 5, F.concat(F.lit('"'), F.col("page_id").cast("string"), F.lit('"'))).otherwise(F.concat(F.lit('"'), F.md5(F.regexp_extract("url", _URL, 2)), F.lit('"')))
    tag = F.when(F.col("page_id") % 10 == 1, F.concat(F.lit("W/"), tag)).otherwise(tag)
    pairs = [
        (F.lit("etag"), F.when(F.col("page_id") % 4 != 2, tag)), (F.lit("date"), F.col("page_id").cast("string")),
        (F.lit("content-type"), F.when(full, "text/html")), (F.lit("expires"), F.when(F.col("page_id") % 2 == 0, (F.col("page_id") + 60).cast("string"))),
        (F.lit("content-length"), F.length("html").cast("string"))]
    headers = F.map_filter(F.create_map(*[c for p in pairs for c in p]), lambda _, v: v.isNotNull())
    return pages.select(
        F.col("page_id").alias("record_id"), F.when(full, "response").otherwise("revisit").alias("kind"), site.alias("url"),
        (F.col("page_id") * 97).alias("seconds"), headers.alias("headers"), F.lit(None).cast("string").alias("digest"), F.when(full, F.col("html")).alias("body"))


OP6_SQL = r"""
WITH p AS (
  SELECT page_id, html, regexp_replace(url, '/[0-9]+', '/' || CAST(page_id % 7 AS VARCHAR), 'g') AS u, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?([^#]*))?', 2) AS h FROM pages),
r AS (
  SELECT page_id AS id, page_id % 3 = 0 AS full_one, page_id * 97 AS s, html,
         regexp_replace(regexp_replace(lower(regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?([^#]*))?', 2)), '^.*@|:(80|443)$', '', 'g'), '^www\.', '') AS host,
         regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?([^#]*))?', 3) AS path,
         array_to_string(list_sort(list_filter(string_split(regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?([^#]*))?', 5), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[^=]*|gclid|fbclid)(=|$)'))), '&') AS q,
         CASE WHEN page_id % 4 <> 2 THEN CASE WHEN page_id % 11 = 5 THEN '"' || CAST(page_id AS VARCHAR) || '"' ELSE '"' || md5(h) || '"' END END AS tag,
         page_id % 10 = 1 AS weak FROM p),
k AS (SELECT *, host || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN q = '' THEN '' ELSE '?' || q END AS site FROM r),
m AS (
  SELECT v.id AS record_id, b.id AS base_id, v.tag AS vt, b.tag AS bt, v.weak AS vw, b.weak AS bw, b.html AS html
  FROM (SELECT * FROM k WHERE NOT full_one) v ASOF LEFT JOIN (SELECT * FROM k WHERE full_one) b ON v.site = b.site AND v.s > b.s),
st AS (
  SELECT *, CASE WHEN base_id IS NULL THEN 'no_base' WHEN vt IS NULL OR bt IS NULL THEN 'unchecked' WHEN vt = bt THEN 'resolved' ELSE 'mismatch' END AS status FROM m)
SELECT record_id, base_id, status,
       CASE WHEN status IN ('resolved', 'unchecked') THEN array_to_string(list_sort(list_filter([
         'content-length: ' || CAST(length(html) AS VARCHAR), 'content-type: text/html', 'date: ' || CAST(record_id AS VARCHAR),
         'etag: ' || coalesce(CASE WHEN vw THEN 'W/' ELSE '' END || vt, CASE WHEN bw THEN 'W/' ELSE '' END || bt),
         'expires: ' || CASE WHEN record_id % 2 = 0 THEN CAST(record_id + 60 AS VARCHAR) WHEN base_id % 2 = 0 THEN CAST(base_id + 60 AS VARCHAR) END], lambda x: x IS NOT NULL)), chr(10)) END AS headers,
       CASE WHEN status IN ('resolved', 'unchecked') THEN sha256(html) END AS body_sha256
FROM st
"""


@query("op6_warc_revisits", OP6_SQL)
def op6(spark, sf_dir):
    found = resolve_revisits(page_records(table(spark, sf_dir, "pages")))
    lines = F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit(": "), e["value"])))
    return found.select("record_id", "base_id", "status", F.array_join(lines, "\n").alias("headers"), F.sha2("body", 256).alias("body_sha256"))
