"""Not-modified revisits resolved to the full response that they refer to.

An as-of join by canonical URL: each revisit gets the latest earlier full response
of its URL, its validators are checked (entity tag first, else modification date),
and header fields that a 304 may update are laid over the stored ones.

All records of one URL are never brought together: records are range-partitioned
over (URL, time, id), each range is scanned on its own, and the last response of
earlier ranges is carried in from one row for each URL and range.

Records: record_id, url, at (a number or timestamp), kind (`response` or
`revisit`), etag, last_modified, headers map<string,string> and digest.

Defined results (`outcome`): `resolved`; `mismatch` if validators differ;
`unvalidated` if the revisit has none that the response has too (it is not
resolved); `no_response` without an earlier response, also for a NULL URL or
time; `response` for responses themselves. Records at one time are ordered by
record_id; repeated records are reported each; a NULL header map counts as
empty; other kinds are `ignored`; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import settle

#: Fields that a 304 may carry to update a stored response (RFC 9110, section 15.4.5; RFC 9111, section 3.2).
PERMITTED = ["age", "cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary", "warning"]
#: Query parameters that do not choose a resource.
TRACKING = r"^(utm_[a-z]+|ref|fbclid|gclid)(=|$)"


def canonical_url(url: Column) -> Column:
    """Host in lower case without `www.` and default port, path without a closing slash, chosen query parameters in order; no scheme or fragment. NULL if there is no host."""
    bare = F.regexp_replace(F.trim(url), "#.*$", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(bare, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?@]*@)?([^/?]+)", 1)), r":(80|443)$", ""), r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(bare, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?]+([^?]*)", 1), "/+$", "")
    query = F.array_sort(F.filter(F.split(F.regexp_extract(bare, r"\?(.*)$", 1), "&"), lambda p: (p != "") & ~F.lower(p).rlike(TRACKING)))
    return F.when(host != "", F.concat(host, path, F.when(F.size(query) > 0, F.concat(F.lit("?"), F.array_join(query, "&"))).otherwise("")))


def merged_headers(stored: Column, update: Column) -> Column:
    """Stored fields overlaid with the permitted fields of the revisit; names in lower case."""
    def lower(m: Column) -> Column:
        # of names that differ in case only, the first in order stays
        low = F.transform(F.array_sort(F.map_entries(m)), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
        names = F.array_distinct(F.transform(low, lambda e: e["key"]))
        return F.map_from_arrays(names, F.transform(names, lambda n: F.filter(low, lambda e: e["key"] == n)[0]["value"]))

    allowed = F.map_filter(lower(update), lambda k, v: k.isin(PERMITTED))
    return F.map_zip_with(lower(stored), allowed, lambda k, a, b: F.coalesce(b, a))


def resolve(records: DataFrame, ranges: int | None = None) -> DataFrame:
    """Every record with canonical_url, outcome, response_id, response_digest and merged headers."""
    spark = records.sparkSession
    n = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    empty = F.create_map().cast("map<string,string>")
    rows = records.select(
        "record_id", canonical_url(F.col("url")).alias("canonical_url"), "at", "kind", "etag", "last_modified", F.coalesce("headers", empty).alias("headers"), "digest",
    )
    full = (F.col("kind") == "response") & F.col("canonical_url").isNotNull() & F.col("at").isNotNull()
    rows = rows.withColumn("response", F.when(full, F.struct("record_id", "etag", "last_modified", "headers", "digest")))
    # the range is a column of a settled table, so it stays the same when a task runs again
    ranged = settle(rows.repartitionByRange(n, "canonical_url", "at", "record_id").withColumn("range", F.spark_partition_id()))
    within = Window.partitionBy("range", "canonical_url").orderBy("at", "record_id", "digest").rowsBetween(Window.unboundedPreceding, -1)
    scanned = ranged.withColumn("own", F.last("response", ignorenulls=True).over(within))
    cells = ranged.where("canonical_url IS NOT NULL").groupBy("canonical_url", "range").agg(
        F.max_by("response", F.when(F.col("response").isNotNull(), F.struct("at", "record_id", "digest"))).alias("last_response")
    )
    earlier = Window.partitionBy("canonical_url").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    carried = cells.withColumn("carried", F.last("last_response", ignorenulls=True).over(earlier)).where("carried IS NOT NULL").select("canonical_url", "range", "carried")
    joined = scanned.join(carried, ["canonical_url", "range"], "left").withColumn("from", F.when((F.col("kind") == "revisit") & F.col("at").isNotNull() & F.col("canonical_url").isNotNull(), F.coalesce("own", "carried")))
    by_tag = F.col("etag").isNotNull() & F.col("from.etag").isNotNull()
    by_date = F.col("last_modified").isNotNull() & F.col("from.last_modified").isNotNull()
    weak = r"^W/"
    agree = F.when(by_tag, F.regexp_replace("etag", weak, "") == F.regexp_replace("from.etag", weak, "")).when(by_date, F.col("last_modified") == F.col("from.last_modified"))
    outcome = (
        F.when(F.col("kind") == "response", "response").when(~F.coalesce(F.col("kind") == "revisit", F.lit(False)), "ignored")
        .when(F.col("from").isNull(), "no_response").when(agree.isNull(), "unvalidated").when(agree, "resolved").otherwise("mismatch")
    )
    done = joined.withColumn("outcome", outcome)
    good = F.col("outcome") == "resolved"
    return done.select(
        "record_id", "canonical_url", "at", "kind", "outcome", F.when(good, F.col("from.record_id")).alias("response_id"),
        F.when(good, F.col("from.digest")).alias("response_digest"), F.when(good, merged_headers(F.col("from.headers"), F.col("headers"))).alias("merged"),
    )
