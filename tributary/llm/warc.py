"""WARC not-modified revisits: an as-of join by canonical url to the latest earlier
full response, a check of validators, and a merge of the headers a 304 may change.

DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import ascii_lower, stash, table, url_host, url_path

#: Fixed list: headers that a not-modified response may change.
PERMITTED = ["age", "cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary", "warning"]
#: Parameters that do not tell pages apart: these names, and names that begin so.
TRACKING = ["ref", "fbclid", "gclid", "sessionid"]
TRACKING_PREFIX = "utm_"
#: Seconds of a url's captures that one window sorts: at one capture a second, as WARC
#: dates have it, 3600 distinct moments at most.
BUCKET_SECONDS = 3600
RECORDS = "record_id long, kind string, url string, ts timestamp, status int, etag string, last_modified string, digest string, headers map<string,string>"


def canonical_url(url: Column) -> Column:
    """Host in lower case without ``www.`` and default port, path without trailing
    slash, parameters sorted and without tracking. Scheme and fragment don't count.
    Null for null and for a url without ``://``."""
    host = F.regexp_replace(F.regexp_replace(url_host(url), r"^www\.", ""), r":(80|443)$", "")
    path = F.regexp_replace(url_path(url), "/+$", "")
    query = F.regexp_extract(url, r"(?s)^[^#?]*\?([^#]*)", 1)
    name = lambda p: ascii_lower(F.substring_index(p, "=", 1))
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~name(p).isin(TRACKING) & ~name(p).startswith(TRACKING_PREFIX)))
    whole = F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))
    return F.when(url.contains("://"), whole)


def _latest(asked: DataFrame, full: DataFrame) -> DataFrame:
    """(key, ts) of asked with the record_id of the latest full response before it.

    Both sides are distinct moments of a url. A window sees one hour of one url;
    what earlier hours have comes from one row an hour.
    """
    moments = full.selectExpr("key", "ts", "record_id", "1 AS turn").unionByName(asked.selectExpr("key", "ts", "CAST(NULL AS long) AS record_id", "0 AS turn"))
    moments = moments.withColumn("bucket", F.floor(F.unix_seconds("ts") / BUCKET_SECONDS))
    within = Window.partitionBy("key", "bucket").orderBy("ts", "turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = moments.withColumn("own", F.last("record_id", ignorenulls=True).over(within))
    hours = moments.groupBy("key", "bucket").agg(F.max_by("record_id", F.when(F.col("record_id").isNotNull(), F.col("ts"))).alias("last"))
    before = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = hours.withColumn("carried", F.last("last", ignorenulls=True).over(before)).select("key", "bucket", "carried")
    return seen.where("turn = 0").join(carried, ["key", "bucket"]).select("key", "ts", F.coalesce("own", "carried").alias("refers_to"))


def resolve_revisits(records: DataFrame) -> DataFrame:
    """One row per revisit of records (RECORDS): record_id, key, ts, refers_to, verdict, headers, digest.

    refers_to is the full response (kind response, status 200) of the same
    canonical url with the latest earlier ts; at one ts the greatest record_id.
    verdict: `missing` without one; `mismatch` where a validator that both have
    differs (payload digest, else entity tag, compared weakly, else last-modified);
    `unverified` where they have none in common; else `resolved`. headers, names in
    lower case, are the response's with the PERMITTED ones of the revisit in place
    of its own; null unless resolved; digest is then the response's.

    Revisits with a null or malformed url or a null ts are missing; responses with
    one are passed over. Header names that differ by case alone are one: the first
    value counts. Repeated revisits come out repeated, repeated responses count once:
    of those with one record_id the latest, by ts. Empty tables give no rows. Columns beside RECORDS are ignored. A url
    that holds a third of all records is split by hour, and the joins that bring
    rows back can be split by Spark.
    """
    rows = records.select("record_id", "kind", "ts", "status", "etag", "last_modified", "digest", "headers", canonical_url(F.col("url")).alias("key"))
    entries = F.coalesce(F.map_entries("headers"), F.array().cast("array<struct<key:string,value:string>>"))
    names = F.array_distinct(F.transform(entries, lambda e: ascii_lower(e["key"])))
    first_of = lambda n: F.element_at(F.filter(entries, lambda e: ascii_lower(e["key"]) == n), 1)["value"]
    rows = rows.withColumn("headers", F.map_from_arrays(names, F.transform(names, first_of)))
    full = rows.where("kind = 'response' AND status = 200 AND key IS NOT NULL AND ts IS NOT NULL")
    revisits = rows.where("kind = 'revisit'")
    moments = full.groupBy("key", "ts").agg(F.max("record_id").alias("record_id"))
    asked = revisits.where("key IS NOT NULL AND ts IS NOT NULL").select("key", "ts").distinct()
    found = _latest(asked, moments)
    fields = ["etag", "last_modified", "digest", "headers"]
    given = full.groupBy(F.col("record_id").alias("refers_to")).agg(F.max_by(F.struct(*fields), F.struct("ts", "key", "digest", "etag", "last_modified")).alias("r"))
    given = given.select("refers_to", *[F.col(f"r.{c}").alias(f"r_{c}") for c in fields])
    # Rows that cannot meet anything stay out of the joins, where they would share one key.
    placed = revisits.where("key IS NOT NULL AND ts IS NOT NULL").join(found, ["key", "ts"])
    alone = revisits.where("key IS NULL OR ts IS NULL").unionByName(placed.where("refers_to IS NULL"), allowMissingColumns=True)
    both = placed.where("refers_to IS NOT NULL").join(given, "refers_to").unionByName(alone, allowMissingColumns=True)
    weak = lambda c: F.regexp_replace(c, "^W/", "")
    equal = F.coalesce(F.col("digest") == F.col("r_digest"), weak("etag") == weak("r_etag"), F.col("last_modified") == F.col("r_last_modified"))
    verdict = F.when(F.col("refers_to").isNull(), "missing").when(equal.isNull(), "unverified").when(equal, "resolved").otherwise("mismatch")
    news = F.map_filter("headers", lambda k, _: k.isin(PERMITTED))
    kept = F.map_filter("r_headers", lambda k, _: ~F.map_contains_key(news, k))
    return both.withColumn("verdict", verdict).select(
        "record_id", "key", "ts", "refers_to", "verdict",
        F.when(F.col("verdict") == "resolved", F.map_concat(kept, news)).alias("headers"),
        F.when(F.col("verdict") == "resolved", F.col("r_digest")).alias("digest"),
    )


def fill_revisits(records: DataFrame, payload: str = "payload") -> DataFrame:
    """Resolved revisits as full responses: record_id, ts, status 200, headers, digest
    and the payload of the response they refer to."""
    bodies = records.where("kind = 'response'").groupBy(F.col("record_id").alias("refers_to")).agg(F.first(payload).alias(payload))
    done = resolve_revisits(records).where("verdict = 'resolved'")
    return done.join(bodies, "refers_to").select("record_id", "key", "ts", F.lit(200).alias("status"), "headers", "digest", payload, "refers_to")


def captures(pages: DataFrame) -> DataFrame:
    """Four capture records (RECORDS) of every page: a full response, if it has html;
    a revisit a day later through a tagged url; one two days later, by another entity
    tag on each third page; and one a day before the response."""
    tag = F.concat(F.lit('"'), F.substring(F.md5("html"), 1, 16), F.lit('"'))
    base = stash(pages.select("page_id", "url", F.md5("html").alias("digest"), tag.alias("etag"), F.length("html").alias("n")), "captures")
    at = lambda days: F.timestamp_seconds(F.lit(1_704_067_200) + F.col("page_id") * 37 + days * 86_400)
    no = F.lit(None).cast("string")
    other = F.when(F.col("page_id") % 3 == 0, F.lit('"changed"')).otherwise(F.concat(F.lit("W/"), F.col("etag")))

    def record(k: int, kind: str, url: Column, days: int, etag: Column, digest: Column, **headers: Column) -> DataFrame:
        named = [x for n, c in headers.items() for x in (F.lit(n.replace("_", "-")), c)]
        return base.select(
            (F.col("page_id") * 4 + k).alias("record_id"), F.lit(kind).alias("kind"), url.alias("url"), at(days).alias("ts"),
            F.lit(200 if kind == "response" else 304).alias("status"), etag.alias("etag"), no.alias("last_modified"), digest.alias("digest"),
            F.create_map(F.lit("Date"), at(days).cast("string"), *named).alias("headers"),
        )

    tagged = F.concat(F.regexp_replace("url", "[?#].*$", ""), F.lit("?utm_medium=feed"))
    whole = record(0, "response", F.col("url"), 0, F.col("etag"), F.col("digest"), Content_Length=F.col("n").cast("string"), Cache_Control=F.lit("max-age=60"))
    parts = [
        whole.where("digest IS NOT NULL"),
        record(1, "revisit", tagged, 1, no, F.col("digest"), Cache_Control=F.lit("max-age=120"), Content_Length=F.lit("0")),
        record(2, "revisit", F.col("url"), 2, other, no, Cache_Control=F.lit("no-store")),
        record(3, "revisit", F.col("url"), -1, F.col("etag"), F.col("digest")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def op5_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    done = resolve_revisits(captures(pages))
    line = F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
    return done.select("record_id", "key", "refers_to", "verdict", F.array_join(line, "\n").alias("headers"), "digest")


_KEY = f"""CASE WHEN contains(url, '://') THEN regexp_replace(regexp_replace(
    translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '^www\\.', ''), ':(80|443)$', '')
    || regexp_replace(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '/+$', '')
    || CASE WHEN len(params) > 0 THEN '?' || array_to_string(params, '&') ELSE '' END END"""
OP5_SQL = f"""
WITH base AS (SELECT page_id, url, md5(html) AS digest, '"' || md5(html)[1:16] || '"' AS etag, length(html) AS n, 1704067200 + page_id * 37 AS t FROM pages),
records AS (
    SELECT page_id * 4 AS record_id, 'response' AS kind, url, t, etag, digest, n::VARCHAR AS n, 'max-age=60' AS cache FROM base WHERE digest IS NOT NULL
    UNION ALL SELECT page_id * 4 + 1, 'revisit', regexp_replace(url, '[?#].*$', '') || '?utm_medium=feed', t + 86400, NULL, digest, NULL, 'max-age=120' FROM base
    UNION ALL SELECT page_id * 4 + 2, 'revisit', url, t + 172800, CASE WHEN page_id % 3 = 0 THEN '"changed"' ELSE 'W/' || etag END, NULL, NULL, 'no-store' FROM base
    UNION ALL SELECT page_id * 4 + 3, 'revisit', url, t - 86400, etag, digest, NULL, NULL FROM base),
split AS (SELECT *, list_sort(list_filter(string_split(regexp_extract(url, '^[^#?]*\\?([^#]*)', 1), '&'), lambda p: p <> ''
    AND NOT lower(split_part(p, '=', 1)) IN ({", ".join(f"'{t}'" for t in TRACKING)}) AND NOT starts_with(lower(split_part(p, '=', 1)), '{TRACKING_PREFIX}'))) AS params FROM records),
keyed AS (SELECT *, {_KEY} AS key FROM split),
ranked AS (SELECT v.record_id, r.record_id AS refers_to, row_number() OVER (PARTITION BY v.record_id ORDER BY r.t DESC, r.record_id DESC) AS k
    FROM keyed v JOIN keyed r ON v.key = r.key AND r.t < v.t WHERE v.kind = 'revisit' AND r.kind = 'response'),
judged AS (SELECT v.record_id, v.key, x.refers_to, v.t, v.cache, r.etag, r.n, r.cache AS r_cache, r.digest, CASE WHEN x.refers_to IS NULL THEN 'missing'
    ELSE coalesce(CASE WHEN v.digest = r.digest THEN 'resolved' WHEN v.digest <> r.digest THEN 'mismatch' END,
        CASE WHEN regexp_replace(v.etag, '^W/', '') = r.etag THEN 'resolved' WHEN v.etag <> r.etag THEN 'mismatch' END, 'unverified') END AS verdict
    FROM keyed v LEFT JOIN (SELECT * FROM ranked WHERE k = 1) x ON v.record_id = x.record_id LEFT JOIN keyed r ON r.record_id = x.refers_to WHERE v.kind = 'revisit')
SELECT record_id, key, refers_to, verdict, CASE WHEN verdict = 'resolved' THEN 'cache-control: ' || coalesce(cache, r_cache) || chr(10) || 'content-length: ' || n || chr(10)
    || 'date: ' || strftime(make_timestamp(t * 1000000), '%Y-%m-%d %H:%M:%S') END AS headers, CASE WHEN verdict = 'resolved' THEN digest END AS digest FROM judged"""
