"""WARC: resolution of not-modified revisits.

A revisit that says "not modified" has no body of its own: an as-of join by canonical URL gives
it the latest earlier full response.  Its validators must agree with that response's
(entity tags weakly, else Last-Modified); then the response's headers stand, updated by
those of the revisit's headers that a not-modified answer may change.

The join is a prefix scan that no URL can overload: records are range-partitioned by
(URL, time), so a hot URL spans several partitions; within a partition a window carries the last full
response on, and across partitions only one row for each URL and partition is carried.

Defined cases: a null URL resolves nothing (`no-url`); without an earlier full response `missing`;
with disagreeing validators, or none on either side, `validator-mismatch`; equal times are ordered
by record_id, so repeated rows are stable, each resolved for itself; a null time counts as the earliest; null
headers count as none.  Statuses other than 200 and 304 are `other`.  Extra columns are dropped by `resolve` and kept
by `with_responses`.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm import scratch

#: Headers that a not-modified answer doesn't change.
FIXED_HEADERS = ["connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive", "proxy-authenticate", "te", "trailer", "transfer-encoding", "upgrade"]
#: Query parameters that don't name a resource.
TRACKING = "^(utm_[a-z]+|ref|fbclid|gclid)="


def canonical_url(url: Column) -> Column:
    """Host in lower case without www., default port, user and fragment; path without a last slash; query parameters sorted, tracking ones left out."""
    bare = F.regexp_replace(F.regexp_replace(url, "#.*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://([^/?@]*@)?", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(bare, "^[^/?]*", 0)), r"^www\.|:(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(bare, r"^[^/?]*([^?]*)", 1), "/+$", "")
    query = F.regexp_extract(bare, r"\?(.*)$", 1)
    kept = F.array_join(F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING))), "&")
    return F.concat(host, path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(""))


def _tag(headers: Column) -> Column:
    return F.regexp_replace(F.element_at(headers, "etag"), '^W/|^w/', "")


def agree(revisit: Column, response: Column) -> Column:
    """Whether the validators agree: entity tags where both have one, else Last-Modified where both have one."""
    tags = _tag(revisit).isNotNull() & _tag(response).isNotNull()
    dates = F.element_at(revisit, "last-modified").isNotNull() & F.element_at(response, "last-modified").isNotNull()
    return F.when(tags, _tag(revisit) == _tag(response)).when(dates, F.element_at(revisit, "last-modified") == F.element_at(response, "last-modified")).otherwise(F.lit(False))


def merge_headers(response: Column, revisit: Column) -> Column:
    allowed = F.map_filter(revisit, lambda k, v: ~k.isin(FIXED_HEADERS))
    kept = F.map_filter(response, lambda k, v: ~F.array_contains(F.map_keys(allowed), k))
    return F.map_concat(kept, allowed)


def resolve(records: DataFrame) -> DataFrame:
    """records (record_id, url, ts, status, headers map<string,string>) with header names in lower case ->
    record_id, canonical_url, ts, resolution, refers_to, headers (merged).

    resolution: full, resolved, validator-mismatch, missing, no-url, other.
    """
    return _resolved(records, []).drop("whole")


def _resolved(records: DataFrame, carried: list[str]) -> DataFrame:
    """What resolve gives, and the carried columns of the record as `whole`."""
    spark = records.sparkSession
    parts = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    headers = F.coalesce(F.col("headers"), F.create_map().cast("map<string,string>"))
    rows = records.select(F.col("record_id").cast("long").alias("record_id"), canonical_url(F.col("url")).alias("canonical_url"), "ts", F.col("status").cast("int").alias("status"), headers.alias("headers"), F.struct(F.lit(0).alias("nothing"), *carried).alias("whole"))
    order = ["ts", "record_id"]
    rows = scratch.table(rows.repartitionByRange(parts, "canonical_url", *order).withColumn("part", F.spark_partition_id()), "records")
    full = F.when(F.col("status") == 200, F.struct("record_id", "headers"))
    seen = Window.partitionBy("canonical_url", "part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = rows.filter("canonical_url IS NOT NULL").withColumn("near", F.last(full, ignorenulls=True).over(seen))
    tails = rows.filter("status = 200 AND canonical_url IS NOT NULL").groupBy("canonical_url", "part").agg(F.max_by(F.struct("record_id", "headers"), F.struct(*order)).alias("tail"))
    spans = rows.filter("canonical_url IS NOT NULL").groupBy("canonical_url").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).filter("lo < hi").select("canonical_url")
    heads = rows.join(spans, "canonical_url", "left_semi").select("canonical_url", "part").distinct().join(tails, ["canonical_url", "part"], "left")
    before = Window.partitionBy("canonical_url").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    earlier = heads.select("canonical_url", "part", F.last("tail", ignorenulls=True).over(before).alias("far"))
    joined = local.join(earlier, ["canonical_url", "part"], "left").withColumn("match", F.coalesce("near", "far"))
    none = rows.filter("canonical_url IS NULL").select("record_id", "canonical_url", "ts", F.when(F.col("status") == 304, "no-url").when(F.col("status") == 200, "full").otherwise("other").alias("resolution"), F.lit(None).cast("long").alias("refers_to"), "headers", "whole")
    revisit = F.col("status") == 304
    how = (
        F.when(F.col("status") == 200, "full").when(~revisit | F.col("status").isNull(), "other").when(F.col("match").isNull(), "missing")
        .when(agree(F.col("headers"), F.col("match.headers")), "resolved").otherwise("validator-mismatch")
    )
    out = joined.withColumn("resolution", how)
    done = F.col("resolution") == "resolved"
    return out.select(
        "record_id", "canonical_url", "ts", "resolution", F.when(done, F.col("match.record_id")).alias("refers_to"),
        F.when(done, merge_headers(F.col("match.headers"), F.col("headers"))).otherwise(F.col("headers")).alias("headers"), "whole",
    ).union(none)


def with_responses(records: DataFrame) -> DataFrame:
    """records, one row for each of them, with merged headers in place of their own and canonical_url, resolution and refers_to at the end (in place of columns of those names)."""
    added = ["canonical_url", "resolution", "refers_to"]
    kept = [c for c in records.columns if c.lower() not in added]
    found = _resolved(records, [c for c in kept if c != "headers"])
    return found.select(*[F.col("headers") if c == "headers" else F.col("whole").getField(c).alias(c) for c in kept], *added)


def records_of_pages(pages: DataFrame) -> DataFrame:
    """Crawl records made from pages (page_id, url, html): each page's response, and a later not-modified revisit of it.

    Of every five pages one answers the revisit only; of every seven one has changed its tag meanwhile.
    """
    tag = F.concat(F.lit('"'), F.substring(F.md5(F.coalesce(F.col("html"), F.lit("")).cast("binary")), 1, 12), F.lit('"'))
    first = F.create_map(
        F.lit("content-type"), F.lit("text/html"), F.lit("content-length"), F.octet_length(F.coalesce("html", F.lit(""))).cast("string"),
        F.lit("etag"), tag, F.lit("date"), (F.col("page_id") * 10).cast("string"),
    )
    again = F.create_map(
        F.lit("content-length"), F.lit("0"), F.lit("etag"), F.when(F.col("page_id") % 7 == 0, F.lit('"changed"')).otherwise(F.concat(F.lit("W/"), tag)),
        F.lit("date"), (F.col("page_id") * 10 + 5).cast("string"), F.lit("cache-control"), F.lit("max-age=60"),
    )
    kinds = F.array(
        F.struct((F.col("page_id") * 2).alias("record_id"), (F.col("page_id") * 10).alias("ts"), F.when(F.col("page_id") % 5 == 0, 304).otherwise(200).alias("status"), first.alias("headers")),
        F.struct((F.col("page_id") * 2 + 1).alias("record_id"), (F.col("page_id") * 10 + 5).alias("ts"), F.lit(304).alias("status"), again.alias("headers")),
    )
    return pages.select("url", F.explode(kinds).alias("k")).select("k.record_id", "url", "k.ts", "k.status", "k.headers")
