"""Web archives: not-modified revisits resolved to the full responses they stand for.

A revisit is joined as of its time to the latest strictly earlier full response of the same canonical URL.
The join runs over distinct (URL, time) points: within slices of time by a window, across slices by
another over one row a slice, so the captures of one hot URL are spread over as many tasks as it has
slices, and captures at one time are one point. Then validators are compared and permitted headers merged. All on the
DataFrame's own functions.

Records: record_id long, url string, ts long, status int, headers array<struct<name, value>>, and any more columns.
Verdicts of a revisit (status 304):
  resolved     a validator that both have agrees (entity tags by weak comparison, else Last-Modified)
  changed      the entity tags, or for want of one of them the Last-Modified dates, differ
  unverified   there is an earlier response, but no validator that both have
  no_response  there is no earlier full response (status 200)
A resolved revisit's headers are the response's, with those that a 304 may renew taken from the revisit.

Cases: a null url or ts joins with nothing (no_response); null or empty headers are none; of several responses at
one time the largest record_id counts, of responses that share a record_id the greatest headers, of repeated
rows each revisit is returned; a response at the revisit's own time is
not earlier; extra columns are not looked at; empty tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import stored

SLICES = 1024
# Header fields that a 304 renews.
RENEWED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")


def canonical_url(url: Column) -> Column:
    """host/path?query without scheme, www, default port, fragment, trailing slash and utm_ parameters; parameters sorted."""
    bare = F.regexp_replace(F.trim(url), "#.*$", "")
    rest = F.regexp_replace(bare, "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(rest, "^([^/?]*)", 1)), "^www[0-9]*[.]", ""), ":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(rest, "^[^/?]*([^?]*)", 1), "/+$", "")
    query = F.regexp_extract(rest, "[?](.*)$", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.lower(p).startswith("utm_")))
    tail = F.array_join(kept, "&")
    return F.concat(host, F.when(path == "", "/").otherwise(path), F.when(tail == "", "").otherwise(F.concat(F.lit("?"), tail)))


def header(headers: Column, name: str) -> Column:
    """The first value of a header, by lower-case name; null if there is none."""
    return F.get(F.filter(headers, lambda h: F.lower(h["name"]) == name), F.lit(0))["value"]


def _tag(headers: Column) -> Column:
    return F.regexp_replace(header(headers, "etag"), "^W/", "")


def as_of(points: DataFrame) -> DataFrame:
    """points: key, ts, id (null where there is no response). Adds target, the id of the latest point strictly earlier that has one.

    (key, ts) is distinct and not null.
    """
    low, high = points.agg(F.min("ts"), F.max("ts")).first()
    width = max(1, -(-((high or 0) - (low or 0) + 1) // SLICES))
    sliced = points.withColumn("slice", F.floor((F.col("ts") - F.lit(low or 0)) / F.lit(width)))
    last = F.struct("ts", "id")
    latest = F.max(F.when(F.col("id").isNotNull(), last))
    before = Window.partitionBy("key").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = sliced.groupBy("key", "slice").agg(latest.alias("own")).select("key", "slice", F.max("own").over(before).alias("carried"))
    within = Window.partitionBy("key", "slice").orderBy("ts").rowsBetween(Window.unboundedPreceding, -1)
    found = sliced.withColumn("near", F.max(F.when(F.col("id").isNotNull(), last)).over(within))
    return found.join(carried, ["key", "slice"]).select("key", "ts", F.coalesce("near", "carried")["id"].alias("target"))


def resolve(records: DataFrame) -> DataFrame:
    """Every revisit: record_id, canonical_url, ts, target_id, verdict and the merged headers (null unless resolved)."""
    # Four plans read these columns; written once, URLs and whatever the records come from are worked out once.
    r = stored(records.where("status in (200, 304)").select("record_id", canonical_url(F.col("url")).alias("key"), "ts", "status", "headers"), "records")
    full, visits = r.where("status = 200"), r.where("status = 304")
    usable = "key is not null and ts is not null"
    points = full.where(usable).groupBy("key", "ts").agg(F.max("record_id").alias("id")).unionByName(visits.where(usable).select("key", "ts", F.lit(None).cast("long").alias("id")))
    points = points.groupBy("key", "ts").agg(F.max("id").alias("id"))
    to = visits.join(as_of(points), ["key", "ts"], "left").withColumnRenamed("headers", "asked")
    to = stored(to.select("record_id", "key", "ts", "asked", "target"), "targets")
    # Responses are written once, too: the join's sides are then plain shuffles, and Spark splits the revisits of a hot target.
    # Revisits without a target are not joined at all.
    responses = stored(full.groupBy(F.col("record_id").alias("target")).agg(F.max("headers").alias("old")), "responses")
    both = to.where("target is not null").join(responses, "target", "left").unionByName(to.where("target is null").withColumn("old", F.lit(None).cast(r.schema["headers"].dataType)))
    both = both.withColumnRenamed("asked", "headers")
    old, new = F.coalesce("old", F.array().cast(r.schema["headers"].dataType)), F.coalesce("headers", F.array().cast(r.schema["headers"].dataType))
    tags, dates = _tag(old) == _tag(new), header(old, "last-modified") == header(new, "last-modified")
    same = F.coalesce(tags, dates)
    verdict = F.when(F.col("target").isNull(), "no_response").when(same, "resolved").when(~same, "changed").otherwise("unverified")
    renewed = F.filter(new, lambda h: F.lower(h["name"]).isin(*RENEWED))
    names = F.transform(renewed, lambda h: F.lower(h["name"]))
    merged = F.concat(F.filter(old, lambda h: ~F.array_contains(names, F.lower(h["name"]))), renewed)
    return both.select("record_id", F.col("key").alias("canonical_url"), "ts", F.col("target").alias("target_id"), verdict.alias("verdict"), F.when(verdict == "resolved", merged).alias("headers"))


def captures(pages: DataFrame) -> DataFrame:
    """An archive of the pages table: of each page a full response and five revisits with different validators.

    A page's captures lie at ts 10 * page_id + k: 0 asks before the response (1) is there, 2 repeats its entity tag
    weakly, 3 has another, 4 has its date alone, 5 has no validator.
    """
    etag, date = F.concat(F.lit('"'), F.md5("html"), F.lit('"')), F.concat(F.lit("day "), F.col("page_id").cast("string"))
    pair = lambda name, value: F.struct(F.lit(name).alias("name"), value.alias("value"))
    at = 10 * F.col("page_id")
    now = lambda k: pair("Date", F.concat(F.lit("t"), (at + k).cast("string")))
    kinds = [
        (304, [pair("ETag", etag), now(0)]),
        (200, [pair("Content-Type", F.lit("text/html")), pair("Content-Length", F.length("html").cast("string")), pair("ETag", etag), pair("Last-Modified", date), now(1)]),
        (304, [pair("etag", F.concat(F.lit("W/"), etag)), now(2), pair("Content-Length", F.lit("0"))]),
        (304, [pair("ETag", F.lit('"other"')), pair("Last-Modified", date), now(3)]),
        (304, [pair("Last-Modified", date), pair("Expires", F.lit("never")), now(4)]),
        (304, [now(5)]),
    ]
    made = F.array(*[F.struct((at + k).alias("record_id"), (at + k).alias("ts"), F.lit(status).alias("status"), F.array(*headers).alias("headers")) for k, (status, headers) in enumerate(kinds)])
    return pages.select("url", F.explode(made).alias("r")).select("r.record_id", "url", "r.ts", "r.status", "r.headers")


def op4_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = resolve(captures(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    lines = F.array_join(F.transform("headers", lambda h: F.concat(F.lower(h["name"]), F.lit("="), h["value"])), "\n")
    return rows.select("record_id", "canonical_url", "ts", "target_id", "verdict", F.coalesce(F.size("headers"), F.lit(0)).alias("n_headers"), F.md5(F.when(F.col("headers").isNotNull(), lines)).alias("headers_md5"))


OP4_SQL = r"""
WITH p AS (
  SELECT page_id, '"' || md5(html) || '"' AS etag, 'day ' || page_id AS day, length(html) AS n, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS rest FROM pages
), u AS (
  SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(rest, '^([^/?]*)', 1)), '^www[0-9]*[.]', ''), ':(80|443)$', '') AS host,
    regexp_replace(regexp_extract(rest, '^[^/?]*([^?]*)', 1), '/+$', '') AS path,
    array_to_string(list_sort(list_filter(string_split(regexp_extract(rest, '[?](.*)$', 1), '&'), lambda x: x <> '' AND NOT starts_with(lower(x), 'utm_'))), '&') AS q FROM p
), c AS (
  SELECT page_id, etag, day, n, host || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN q = '' THEN '' ELSE '?' || q END AS canonical_url FROM u
), visits AS (
  SELECT 10 * page_id + k AS record_id, 10 * page_id + k AS ts, k, canonical_url, CASE k WHEN 0 THEN etag WHEN 2 THEN etag WHEN 3 THEN '"other"' END AS tag, CASE WHEN k IN (3, 4) THEN day END AS date
  FROM c, (VALUES (0), (2), (3), (4), (5)) AS v(k)
), responses AS (SELECT 10 * page_id + 1 AS id, canonical_url, etag, day, n FROM c
), j AS (
  SELECT v.*, r.id AS target_id, r.etag, r.day, r.n, coalesce(v.tag = r.etag, v.date = r.day) AS same FROM visits v ASOF LEFT JOIN responses r ON v.canonical_url = r.canonical_url AND v.ts > r.id
), d AS (
  SELECT *, CASE WHEN target_id IS NULL THEN 'no_response' WHEN same THEN 'resolved' WHEN NOT same THEN 'changed' ELSE 'unverified' END AS verdict,
    'content-type=text/html' || chr(10) || 'content-length=' || n AS body FROM j
)
SELECT record_id, canonical_url, ts, target_id, verdict, CASE WHEN verdict <> 'resolved' THEN 0 WHEN k = 4 THEN 6 ELSE 5 END AS n_headers,
  CASE WHEN verdict = 'resolved' THEN md5(body || chr(10) || CASE k
    WHEN 0 THEN 'last-modified=' || day || chr(10) || 'etag=' || etag || chr(10) || 'date=t' || ts
    WHEN 2 THEN 'last-modified=' || day || chr(10) || 'etag=W/' || etag || chr(10) || 'date=t' || ts
    WHEN 4 THEN 'etag=' || etag || chr(10) || 'last-modified=' || day || chr(10) || 'expires=never' || chr(10) || 'date=t' || ts
    ELSE '' END) END AS headers_md5
FROM d
"""
