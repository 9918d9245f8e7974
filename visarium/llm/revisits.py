"""Revisit records resolved against earlier responses: an as-of join by canonical URL, in DataFrame expressions alone.

A revisit that says "not modified" holds no payload. It belongs to the latest full response of its canonical URL that was
recorded before it, if their validators agree. The resolved record has the response's payload and headers, with those
headers taken from the revisit that a not-modified answer may update.

The as-of join runs in two levels: within buckets of time a window finds the last response of the same bucket; between
buckets only each bucket's last response is carried on. So a URL with very many records is spread over its buckets, and
payloads never move - records carry the id of their response.

Defined results: of records at one time the smaller record_id is the earlier; a null or empty URL, a null time, or no
earlier response: `no_response`; no validator on the revisit: `no_validator`; validators that differ or that the
response lacks: `mismatch`; else `resolved`. Null headers are no headers; header names compare in lower case; repeated records
come back each; empty tables give no rows; further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Headers that a not-modified answer may carry for the stored response (HTTP semantics, fixed values).
PERMITTED = ["cache-control", "content-location", "date", "etag", "expires", "vary"]
#: Query parameters that name a visit and not a page, and the status of a full response.
IGNORED_PARAMETERS, FULL = ("utm_[^=]*", "fbclid", "gclid"), 200
#: Seconds of a time bucket.
BUCKET = 3600


def canonical_url(url: Column, ignored: tuple[str, ...] = IGNORED_PARAMETERS, keep_scheme: bool = True) -> Column:
    """Scheme and host in lower case without the scheme's own default port, path without slashes at its end, parameters sorted
    without the ignored ones (patterns of names); no fragment. Null for null or empty. Without keep_scheme the key has none,
    so that http and https are one page."""
    pattern = "^[A-Za-z][A-Za-z0-9+.-]*://"
    bare = F.regexp_replace(F.trim(url), "#.*$", "")
    scheme = F.lower(F.regexp_extract(bare, "^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    host = F.lower(F.regexp_extract(bare, pattern + "([^/?]*)", 1))
    host = F.when(scheme == "http", F.regexp_replace(host, ":80$", "")).when(scheme == "https", F.regexp_replace(host, ":443$", "")).otherwise(host)
    rest = F.regexp_replace(bare, pattern + "[^/?]*", "")
    path = F.regexp_replace(F.regexp_extract(rest, "^([^?]*)", 1), "/+$", "")
    visit = f"^({'|'.join(ignored)})(=|$)" if ignored else "^$"
    query = F.array_join(F.array_sort(F.filter(F.split(F.regexp_extract(rest, "\\?(.*)$", 1), "&"), lambda p: (p != "") & ~p.rlike(visit))), "&")
    out = F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    whole = F.concat(F.when(scheme != "", F.concat(scheme, F.lit("://"))).otherwise(""), out) if keep_scheme else out
    return F.when(out != "", whole)


def _lower_keys(headers: Column) -> Column:
    """Header names in lower case; of names that differ in case only, the last value."""
    entries = F.map_entries(F.coalesce(headers, F.create_map().cast("map<string,string>")))
    low = F.transform(entries, lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    return F.aggregate(low, F.create_map().cast("map<string,string>"), lambda m, e: F.map_concat(F.map_filter(m, lambda k, _: k != e["key"]), F.map_from_arrays(F.array(e["key"]), F.array(e["value"]))))


def _weak(tag: Column) -> Column:
    return F.regexp_replace(tag, "^W/", "")


def resolve_revisits(records: DataFrame, bucket: int = BUCKET, ignored: tuple[str, ...] = IGNORED_PARAMETERS, keep_scheme: bool = True) -> DataFrame:
    """record_id, url_key, outcome, response_id, headers of every revisit among the records.

    records: record_id, url, kind ("response" or "revisit"), at (timestamp), headers (map of strings), and if there is one
    status (int): only responses of status 200 are full; where the column is missing or null they count as such.
    """
    full = F.coalesce(F.col("status"), F.lit(FULL)) == FULL if "status" in records.columns else F.lit(True)
    rows = records.filter((F.col("kind") == "revisit") | ((F.col("kind") == "response") & full)).select("record_id", canonical_url(F.col("url"), ignored, keep_scheme).alias("url_key"), "kind", "at", _lower_keys(F.col("headers")).alias("headers"))
    lost = rows.filter((F.col("kind") == "revisit") & (F.col("url_key").isNull() | F.col("at").isNull()))
    rows = rows.filter(F.col("url_key").isNotNull() & F.col("at").isNotNull()).withColumn("bucket", F.floor(F.unix_micros("at") / (bucket * 1_000_000)).cast("long"))
    mine = F.when(F.col("kind") == "response", F.struct("record_id", "headers"))
    inside = Window.partitionBy("url_key", "bucket").orderBy("at", F.asc_nulls_first("record_id")).rowsBetween(Window.unboundedPreceding, -1)
    between = Window.partitionBy("url_key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    last = rows.filter("kind = 'response'").groupBy("url_key", "bucket").agg(F.max_by(F.struct("record_id", "headers"), F.struct("at", "record_id")).alias("own"))
    # Every bucket that asks is in the carry table too, so the join finds a row for it.
    asked = rows.filter("kind = 'revisit'").select("url_key", "bucket").distinct()
    carry = asked.join(last, ["url_key", "bucket"], "full").select("url_key", "bucket", F.last("own", ignorenulls=True).over(between).alias("carried"))
    found = rows.withColumn("near", F.last(mine, ignorenulls=True).over(inside)).filter("kind = 'revisit'")
    found = found.join(carry, ["url_key", "bucket"], "left").withColumn("hit", F.coalesce("near", "carried"))
    mine_tag, its_tag = F.col("headers")["etag"], F.col("hit.headers")["etag"]
    mine_time, its_time = F.col("headers")["last-modified"], F.col("hit.headers")["last-modified"]
    agrees = F.when(mine_tag.isNotNull(), F.coalesce(_weak(mine_tag) == _weak(its_tag), F.lit(False))).otherwise(F.coalesce(mine_time == its_time, F.lit(False)))
    outcome = F.when(F.col("hit").isNull(), "no_response").when(mine_tag.isNull() & mine_time.isNull(), "no_validator").when(agrees, "resolved").otherwise("mismatch")
    fresh = F.map_filter("headers", lambda k, _: k.isin(PERMITTED))
    merged = F.map_concat(F.map_filter("hit.headers", lambda k, _: ~F.array_contains(F.map_keys(fresh), k)), fresh)
    ok = F.col("outcome") == "resolved"
    out = found.withColumn("outcome", outcome).select("record_id", "url_key", "outcome", F.when(ok, F.col("hit.record_id")).alias("response_id"), F.when(ok, merged).alias("headers"))
    none = lost.select("record_id", "url_key", F.lit("no_response").alias("outcome"), F.lit(None).cast(records.schema["record_id"].dataType).alias("response_id"), F.lit(None).cast("map<string,string>").alias("headers"))
    return out.unionAll(none)


def crawl_of(pages: DataFrame) -> DataFrame:
    """Crawl records of a table of pages: each page's full response, and thirty days on a revisit of the same page.

    The n-th page is fetched in minute n; where page_id mod 10 is 9 with status 503, so that response is none to go back to. A
    revisit names its page with another fragment; where page_id mod 4 is 3 the page has changed meanwhile, so its validator
    differs, and where page_id mod 7 is 3 it has no validator.
    """
    tag = F.concat(F.lit('"'), F.substring(F.md5("html"), 1, 16), F.lit('"'))
    clock = lambda seconds: F.timestamp_seconds(F.lit(1_700_000_000) + F.col("page_id") * 60 + seconds)
    header = lambda *kv: F.map_from_arrays(F.array(*(F.lit(k) for k in kv[::2])), F.array(*kv[1::2]))
    n = F.col("page_id")
    first = pages.select((n * 2).alias("record_id"), "url", F.lit("response").alias("kind"), F.when(n % 10 == 9, 503).otherwise(FULL).alias("status"), clock(0).alias("at"), header("Content-Type", F.lit("text/html"), "ETag", tag, "Date", F.col("page_id").cast("string"), "Content-Length", F.octet_length("html").cast("string")).alias("headers"))
    again = pages.select((F.col("page_id") * 2 + 1).alias("record_id"), F.concat(F.regexp_replace("url", "#.*$", ""), F.lit("#again")).alias("url"), F.lit("revisit").alias("kind"), F.lit(304).alias("status"), clock(30 * 86400).alias("at"), F.when(n % 7 == 3, header("Date", (n + 43200).cast("string"))).otherwise(header("ETag", F.when(n % 4 == 3, F.lit('"changed"')).otherwise(F.concat(F.lit("W/"), tag)), "Date", (n + 43200).cast("string"), "Content-Length", F.lit("0"))).alias("headers"))
    return first.unionAll(again)
