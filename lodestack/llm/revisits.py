"""Resolution of not-modified revisit records in web archives: an as-of join to the latest earlier full response.

A capture with status 304 has no payload of its own. It is resolved by the latest earlier full response of the same
canonical URL: its validators are checked, and the headers that a 304 may update replace the stored ones (RFC 9110, sections
13 and 15.4.5). The as-of join has two levels, so that one hot URL spreads over many tasks: captures are cut into slices of
near equal rows in the order of URL and time; within a slice a window finds the response, and the few URLs that go on from
one slice to the next carry their last full response along."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shuffle_parts, staged

# Headers that a not-modified response may update (RFC 9111, section 3.2 leaves out those of the payload).
PERMITTED_HEADERS = ["cache-control", "date", "etag", "expires", "last-modified", "vary"]
# Query parameters that identify a visit and not a resource.
TRACKING = r"^(utm_[a-z]+|ref|fbclid|gclid|sessionid|sid)(=|$)"

CAPTURE = ["record_id", "url", "seen", "status", "headers", "digest", "length"]


def canonical_url(url: Column) -> Column:
    """Scheme, www. and m. host prefixes, default ports, fragment, tracking parameters and the final slash go; the host is in lower case, parameters are sorted."""
    plain = F.regexp_replace(F.regexp_replace(F.trim(url), r"(?s)#.*$", ""), r"(?i)^[a-z][a-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(plain, r"^([^/?]*)", 1)), r"^(www|m)\.", ""), r":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(plain, r"^[^/?]*([^?]*)", 1), r"/+$", "")
    query = F.regexp_extract(plain, r"\?(.*)$", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (F.length(p) > 0) & ~F.lower(p).rlike(TRACKING)))
    return F.when(url.isNotNull(), F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")))


def resolve_revisits(captures: DataFrame, slice_rows: int = 1_000_000) -> DataFrame:
    """One row for each capture: CAPTURE columns, canonical, is_revisit, refers_to, outcome, resolved_headers, resolved_digest, resolved_length.

    captures: record_id (orders captures of one instant), url, seen (long, e.g. epoch microseconds), status, headers (map of
    lower-case names), digest and length of the payload (those of a revisit are what it claims, or null).
    outcome: `full` for a full response, `resolved`, `mismatch` when a validator (digest, etag or last-modified) that both
    sides have differs, `orphan` without an earlier full response, `other` for another status. Only `resolved` rows take the
    payload and the merged headers. slice_rows: rows of a slice, about, on large tables; slices grow in number with the rows.

    Nulls: a null url or time finds nothing (`orphan`); a validator missing on either side is not compared; a null record_id
    comes before others of its instant. Captures alike in time are ordered by record_id; of those alike in both, a full
    response is not earlier than the others, and later captures refer to the one greatest by digest, length and digest of the
    headers. Repeated rows are resolved alike. Headers are carried whole, however long. Further columns are not read. An
    empty table gives no rows."""
    rows = captures.select(*CAPTURE).withColumns({
        "canonical": canonical_url(F.col("url")),
        "is_revisit": F.coalesce(F.col("status") == 304, F.lit(False)),
        "is_full": F.coalesce(F.col("status").between(200, 299), F.lit(False)),
    })
    # A null url would be one hot key of rows that find nothing: they get keys of their own.
    lone = F.col("canonical").isNull() | F.col("seen").isNull()
    keyed = rows.withColumn("key", F.when(lone, F.concat(F.lit("\x00"), F.coalesce(F.col("record_id").cast("string"), F.lit("")))).otherwise(F.col("canonical")))
    spark, count = captures.sparkSession, captures.count()
    slices = max(1, min(shuffle_parts(spark), -(-count // 10_000)), -(-count // slice_rows))
    ranged = keyed.repartitionByRange(slices, "key", "seen", "record_id") if slices > 1 else keyed.coalesce(1)
    ranged = staged(ranged.withColumn("slice", F.spark_partition_id()), "revisit-slices")
    stored = F.when(F.col("is_full") & F.col("canonical").isNotNull() & F.col("seen").isNotNull(), F.struct("seen", "record_id", "digest", "length", "headers"))
    turn = ["seen", "record_id", "is_full", "digest", "length", F.xxhash64(F.map_entries("headers"))]
    own = Window.partitionBy("key", "slice").orderBy(*turn).rowsBetween(Window.unboundedPreceding, -1)
    within = ranged.withColumn("near", F.last(stored, ignorenulls=True).over(own))
    # URLs on both sides of a cut: each is the first or last of its slices, so there are at most two for each slice.
    edges = ranged.groupBy("slice").agg(F.array(F.min("key"), F.max("key")).alias("k")).select("slice", F.explode("k").alias("key")).distinct()
    across = edges.groupBy("key").count().filter("count > 1").select("key")
    before = Window.partitionBy("key").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    ends = ranged.filter(stored.isNotNull()).join(F.broadcast(across), "key", "left_semi").groupBy("key", "slice").agg(F.max_by(stored, F.struct(*turn)).alias("end"))
    # A slice in the middle may hold no full response, but has to hand on what comes before it.
    places = edges.join(F.broadcast(across), "key", "left_semi").join(ends, ["key", "slice"], "left")
    carried = places.withColumn("carry", F.last("end", ignorenulls=True).over(before)).filter(F.col("carry").isNotNull()).select("key", "slice", "carry")
    carried = staged(carried, "revisit-carried")
    within = within.join(F.broadcast(carried) if slices <= 10_000 else carried, ["key", "slice"], "left")
    base = F.coalesce("near", "carry")
    differs = lambda a, b: F.coalesce(a != b, F.lit(False))
    header = lambda m, k: F.try_element_at(m, F.lit(k))
    weak = lambda e: F.regexp_replace(e, "^W/", "")
    found = within.withColumn("base", F.when(F.col("is_revisit"), base))
    conflict = (
        differs(F.col("digest"), F.col("base.digest"))
        | differs(weak(header(F.col("headers"), "etag")), weak(header(F.col("base.headers"), "etag")))
        | (header(F.col("headers"), "etag").isNull() & differs(header(F.col("headers"), "last-modified"), header(F.col("base.headers"), "last-modified")))
    )
    outcome = F.when(F.col("is_full"), "full").when(~F.col("is_revisit"), "other").when(F.col("base").isNull(), "orphan").when(conflict, "mismatch").otherwise("resolved")
    found = found.withColumn("outcome", outcome)
    update = F.map_filter(F.coalesce("headers", F.create_map().cast("map<string,string>")), lambda k, v: k.isin(PERMITTED_HEADERS))
    kept = F.map_filter(F.coalesce("base.headers", F.create_map().cast("map<string,string>")), lambda k, v: ~F.map_contains_key(update, k))
    resolved = F.col("outcome") == "resolved"
    return found.select(
        *CAPTURE, "canonical", "is_revisit", F.col("base.record_id").alias("refers_to"), "outcome",
        F.when(resolved, F.map_concat(kept, update)).otherwise(F.col("headers")).alias("resolved_headers"),
        F.when(resolved, F.col("base.digest")).otherwise(F.col("digest")).alias("resolved_digest"),
        F.when(resolved, F.col("base.length")).otherwise(F.col("length")).alias("resolved_length"),
    )


def with_payload(resolved: DataFrame, bodies: DataFrame) -> DataFrame:
    """Resolved captures with the body of their own record or of the one they refer to (bodies: record_id, body)."""
    own = F.when(F.col("outcome") == "resolved", F.col("refers_to")).when(F.col("outcome") == "full", F.col("record_id"))
    return resolved.withColumn("_own", own).join(bodies.select(F.col("record_id").alias("_own"), "body"), "_own", "left").drop("_own")


def captures_of(pages: DataFrame) -> DataFrame:
    """The pages table as two crawls in order of page_id.

    The first fetches every page (ids divisible by 11 failed with 503); the second gets 304 for each, with the digest and
    the validator of what its client held (for ids divisible by 21 a stale one)."""
    held = F.concat(F.lit('"'), F.substring(F.md5(F.regexp_replace(canonical_url(F.col("url")), r"\?.*$", "").cast("binary")), 1, 12), F.lit('"'))
    body = F.coalesce("html", F.lit(""))
    seen = pages.select("page_id", "url", held.alias("held"), F.md5(body.cast("binary")).alias("digest"), F.octet_length(body).cast("long").alias("size"))
    crawls = seen.withColumn("crawl", F.explode(F.array(F.lit(0), F.lit(1))))
    again = F.col("crawl") == 1
    failed = ~again & (F.col("page_id") % 11 == 0)
    etag = F.when(again & (F.col("page_id") % 21 == 0), F.lit('"stale"')).otherwise(F.col("held"))
    date = F.concat(F.col("crawl").cast("string"), F.lit("-"), F.col("page_id").cast("string"))
    headers = F.when(again, F.create_map(F.lit("etag"), etag, F.lit("date"), date, F.lit("content-length"), F.lit("0"))).otherwise(
        F.create_map(F.lit("etag"), etag, F.lit("date"), date, F.lit("content-type"), F.lit("text/html"))
    )
    return crawls.select(
        (F.col("page_id") * 2 + F.col("crawl")).alias("record_id"), "url", (F.col("page_id") + F.col("crawl") * 10_000_000_000).alias("seen"),
        F.when(again, 304).when(failed, 503).otherwise(200).alias("status"), headers.alias("headers"),
        F.when(~failed, F.col("digest")).alias("digest"), F.when(~failed & ~again, F.col("size")).alias("length"),
    )


def op7_revisit_resolution(spark, sf_dir: str) -> DataFrame:
    """Every capture of the pages table with what it resolves to."""
    found = resolve_revisits(captures_of(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    return found.select("record_id", "canonical", "status", "outcome", "refers_to", "resolved_digest", "resolved_length", F.try_element_at("resolved_headers", F.lit("etag")).alias("etag"), F.try_element_at("resolved_headers", F.lit("date")).alias("header_date"), F.try_element_at("resolved_headers", F.lit("content-type")).alias("content_type"))


OP7_SQL = r"""
WITH raw AS (
  SELECT page_id, url, html, regexp_replace(regexp_replace(trim(url), '#.*$', '', 's'), '^[a-zA-Z][a-zA-Z0-9+.-]*://', '') AS plain
  FROM pages
), parts AS (
  SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(plain, '^([^/?]*)', 1)), '^(www|m)\.', ''), ':(80|443)$', '') AS host,
    regexp_replace(regexp_extract(plain, '^[^/?]*([^?]*)', 1), '/+$', '') AS path,
    list_sort(list_filter(string_split(regexp_extract(plain, '\?(.*)$', 1), '&'), lambda p: length(p) > 0 AND NOT regexp_matches(lower(p), '^(utm_[a-z]+|ref|fbclid|gclid|sessionid|sid)(=|$)'))) AS kept
  FROM raw
), crawled AS (
  SELECT *, unnest([0, 1]) AS crawl FROM parts
), captures AS (
  SELECT page_id * 2 + crawl AS record_id, host || path || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END AS canonical,
    page_id + crawl * 10000000000 AS seen, CASE WHEN crawl = 1 THEN 304 WHEN page_id % 11 = 0 THEN 503 ELSE 200 END AS status,
    CASE WHEN crawl = 1 AND page_id % 21 = 0 THEN '"stale"' ELSE '"' || substr(md5(host || path), 1, 12) || '"' END AS etag,
    crawl || '-' || page_id AS date,
    CASE WHEN crawl = 1 OR page_id % 11 <> 0 THEN md5(coalesce(html, '')) END AS digest,
    CASE WHEN crawl = 0 AND page_id % 11 <> 0 THEN CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) END AS length
  FROM crawled
), matched AS (
  SELECT c.*, f.record_id AS base_id, f.digest AS base_digest, f.length AS base_length, f.etag AS base_etag
  FROM captures c ASOF LEFT JOIN (SELECT * FROM captures WHERE status = 200) f ON c.canonical = f.canonical AND c.seen > f.seen
), judged AS (
  SELECT *, CASE WHEN status = 200 THEN 'full' WHEN status = 503 THEN 'other' WHEN base_id IS NULL THEN 'orphan' WHEN etag <> base_etag OR digest <> base_digest THEN 'mismatch' ELSE 'resolved' END AS outcome
  FROM matched
)
SELECT record_id, canonical, CAST(status AS INTEGER) AS status, outcome, CASE WHEN status = 304 THEN base_id END AS refers_to,
  CASE WHEN outcome = 'resolved' THEN base_digest ELSE digest END AS resolved_digest,
  CASE WHEN outcome = 'resolved' THEN base_length ELSE length END AS resolved_length, etag, date AS header_date,
  CASE WHEN outcome IN ('full', 'other', 'resolved') THEN 'text/html' END AS content_type
FROM judged
"""
