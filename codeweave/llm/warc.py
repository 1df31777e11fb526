"""WARC revisits: a 304 record takes its payload from the latest earlier full response for the same canonical URL.

Records are (record_id, url, ts, status, headers, payload digest and length). The as-of join runs in time slices: ranges of
(ts, record_id) by sampled bounds, of SLICE_ROWS records each, so equal times are cut too. In a (url, slice) the last full
response is carried forward; each slice's last one is carried over to the slices after it. A url with a third of all
records is spread over all slices, and no window holds more than a slice, or one row for each slice.

Validators (RFC 9110, 13.1): if the 304 names an ETag, it must equal the response's, weakness prefixes apart; else a
Last-Modified that both have must be equal; a 304 with neither is taken, as `unchecked`. Of the 304's headers only those that
may update a stored response (PERMITTED) replace it; Content-Length and the like stay the response's own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
#: Query parameters that don't name a resource.
TRACKING = r"^(utm_[a-z]+|gclid|fbclid|ref)(=|$)"
#: Slices at least, and records of a slice at most (about: bounds are sampled).
MIN_SLICES, SLICE_ROWS = 64, 1_000_000


def canonical_url(url: Column) -> Column:
    """host[:port]/path[?query]: without scheme, user, fragment, default port, `www.`, tracking parameters or a final slash.

    A-Z of the host are lower-cased, parameters sorted. A url without `://`, or null, is null.
    """
    rest = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^#]*)", 1)
    host = F.lower(F.regexp_extract(rest, r"^(?:[^/?@]*@)?([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(host, r":(80|443)$", ""), r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(rest, r"^[^/?]*([^?]*)", 1), r"/+$", "")
    query = F.array_join(F.array_sort(F.filter(F.split(F.regexp_extract(rest, r"^[^?]*\?(.*)$", 1), "&"), lambda p: (p != "") & ~p.rlike(TRACKING))), "&")
    whole = F.concat(host, path, F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))
    return F.when(host != "", whole)


def resolve_revisits(records: DataFrame, slices: int | None = None) -> DataFrame:
    """One row a record: record_id, canonical_url, status, outcome, source_id, headers, digest, length.

    records: record_id, url, ts (long), status (int), headers (map, lower-case names), digest, length. outcome is `response`
    for a full response (status 200), which is its own source; for a 304 `resolved`, `unchecked`, `mismatch` (validators differ) or
    `missing` (no earlier full response, or no canonical url); `other` for all other records. Where a 304 isn't taken, source_id,
    digest and length are null and headers its own. Null headers count as none, and a null ts or record_id comes first.
    Repeated rows are answered each. Other columns are ignored; an empty table gives no rows. slices: as many as the rows need, by default.
    """
    r = records.select(
        F.col("record_id").cast("long").alias("record_id"), canonical_url(F.col("url").cast("string")).alias("canonical_url"), F.col("ts").cast("long").alias("ts"),
        F.col("status").cast("int").alias("status"), F.coalesce("headers", F.create_map().cast("map<string,string>")).alias("headers"), F.col("digest").cast("string").alias("digest"), F.col("length").cast("long").alias("length"),
    )
    if slices is None:
        slices = max(MIN_SLICES, -(-records.count() // SLICE_ROWS))
    # nulls come first, as in the windows below; a partition is a slice, and what it holds is stored with its number
    r = materialise(r.repartitionByRange(slices, F.col("ts").asc_nulls_first(), F.col("record_id").asc_nulls_first()).withColumn("slice", F.spark_partition_id()), "warc-records")
    r = r.withColumn("full", F.expr("if(status = 200 and canonical_url is not null, struct(record_id, headers, digest, length), null)"))
    # a null url stands alone, and so does each record without need of a partner
    r = r.withColumn("place", F.coalesce("canonical_url", F.concat(F.lit("#"), F.col("record_id").cast("string"), F.lit("/"), F.col("ts").cast("string")), F.lit("#")))
    order = "order by ts, record_id rows between unbounded preceding and"
    r = r.selectExpr("*", f"last_value(full) ignore nulls over (partition by place, slice {order} 1 preceding) as near")
    ends = r.filter("full is not null").groupBy("place", "slice").agg(F.max_by("full", F.struct("ts", "record_id")).alias("full"))
    # one row for each slice of a url: at most `slices` in a window
    gaps = r.filter("status = 304 and near is null and slice > 0").select("place", "slice").distinct().withColumn("full", F.lit(None).cast(ends.schema["full"].dataType))
    known = ends.union(gaps).groupBy("place", "slice").agg(F.first("full", ignorenulls=True).alias("full"))
    known = known.selectExpr("place", "slice", "last_value(full) ignore nulls over (partition by place order by slice rows between unbounded preceding and 1 preceding) as far")
    r = r.join(known, ["place", "slice"], "left").withColumn("source", F.coalesce("near", "far"))
    weak = "regexp_replace({}, '^W/', '')"
    etag, stored = "headers['etag']", "source.headers['etag']"
    outcome = f"""case when status = 200 then 'response' when status is null or status <> 304 then 'other' when source is null then 'missing'
        when {etag} is not null then if({weak.format(etag)} = coalesce({weak.format(stored)}, ''), 'resolved', 'mismatch')
        when headers['last-modified'] is not null and source.headers['last-modified'] is not null then if(headers['last-modified'] = source.headers['last-modified'], 'resolved', 'mismatch')
        else 'unchecked' end"""
    r = r.withColumn("outcome", F.expr(outcome)).withColumn("taken", F.expr("outcome in ('resolved', 'unchecked')"))
    names = ", ".join(f"'{x}'" for x in PERMITTED)
    merged = f"map_concat(map_filter(source.headers, (k, v) -> not (k in ({names}) and map_contains_key(headers, k))), map_filter(headers, (k, v) -> k in ({names})))"
    own = "if(taken, source.{0}, if(status = 200, {0}, null)) as {0}"
    return r.selectExpr("record_id", "canonical_url", "status", "outcome", "if(taken, source.record_id, if(status = 200, record_id, null)) as source_id", f"if(taken, {merged}, headers) as headers", own.format("digest"), own.format("length"))


def attach_payloads(resolved: DataFrame, payloads: DataFrame) -> DataFrame:
    """resolved with the column payload of (record_id, payload), by source_id; null where there is no source."""
    return resolved.join(payloads.select(F.col("record_id").alias("source_id"), "payload"), "source_id", "left")


def captures(pages: DataFrame) -> DataFrame:
    """Records derived from pages (page_id, url, html): one to three full responses for each page, and two 304s for it.

    The table has no captures of its own, so times, validators and headers follow from page_id and the page. Response v of
    page p (v from 0 to p % 3) has number 8 p + v and comes at 100 p + 900 v, with digest and ETag of html, `#` and v. The 304s,
    8 p + 4 and 8 p + 5, come at 100 p + 50 + 1000 (p % 3) and at 100 p + 1950, the first 100 p - 50 where p is divisible by 11. They name
    the ETag of response p % 2 and of response p % 3, weak where p is divisible by 3, or none where it is divisible by 5.
    """
    base = pages.select(F.col("page_id").cast("long").alias("p"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    base = base.selectExpr("p", "url", "md5(concat(html, '#0')) as d0", "md5(concat(html, '#1')) as d1", "md5(concat(html, '#2')) as d2", "octet_length(html) as length")
    full = base.select("*", F.explode(F.expr("sequence(0, p % 3)")).alias("v")).selectExpr("*", "element_at(array(d0, d1, d2), cast(v + 1 as int)) as digest", "p * 100 + v * 900 as ts")
    full = full.selectExpr(
        "p * 8 + v as record_id", "url", "ts", "200 as status", "digest", "length",
        """map('content-type', 'text/html', 'content-length', cast(length as string), 'etag', concat('"', left(digest, 16), '"'), 'cache-control', 'max-age=60',
            'date', cast(ts as string), 'last-modified', cast(ts - 7 as string)) as headers""",
    )
    again = base.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("w"))
    again = again.selectExpr("*", "case when w = 1 then p * 100 + 1950 when p % 11 = 0 then p * 100 - 50 else p * 100 + 50 + p % 3 * 1000 end as ts", "element_at(array(d0, d1, d2), cast(if(w = 0, p % 2, p % 3) + 1 as int)) as named")
    again = again.selectExpr(
        "p * 8 + 4 + w as record_id", "concat(url, '#again') as url", "ts", "304 as status", "cast(null as string) as digest", "cast(null as int) as length",
        """map_filter(map('content-length', '0', 'etag', case when p % 5 = 0 then null when p % 3 = 0 then concat('W/"', left(named, 16), '"') else concat('"', left(named, 16), '"') end,
            'cache-control', if(p % 2 = 0, 'max-age=120', null), 'date', cast(ts as string), 'expires', cast(ts + 120 as string), 'last-modified', if(p % 10 = 0, cast(p * 100 - 7 as string), null)), (k, v) -> v is not null) as headers""",
    )
    return full.unionByName(again)
