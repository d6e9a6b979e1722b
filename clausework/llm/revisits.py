"""WARC not-modified revisits resolved to the response they stand for (operator 10).

A revisit record says that a page was unchanged since an earlier capture;
its content is that of the latest full response of the same canonical URL
before it.  The as-of join is made in two steps, so that a URL with a third
of all captures is no one task's work: captures are grouped by canonical URL
and time slice; inside a slice a window gives each revisit the latest
response before it, and where the slice has none yet, the last response of
the earlier slices is brought in, found over one row per URL and slice.

The revisit is resolved when its validators allow it: equal entity tags
(compared weakly) decide; without them on both sides, equal Last-Modified
dates; without either the revisit can't be checked.  Headers are merged as
for a 304 answer: the permitted headers of the revisit replace those of the
response, all others stay as stored.

Cases: a null URL is the empty canonical URL; a record without a time can't
be placed: a revisit is ``no_response``, a response is never used; records
at one time are ordered by id; repeated rows each give a row; header names
are compared in lower case, null headers are empty; empty tables give an
empty table.  Only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clausework.llm.common import written

# Seconds of a time slice.
SLICE_SECONDS = 6 * 3600
# Headers that a 304 answer may update.
PERMITTED = ("age", "cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary", "warning")
TRACKING = r"(?:utm_[^=&]*|ref|fbclid|gclid)"


def canonical_url(url: Column) -> Column:
    """Lower-cased host without ``www.`` or ``m.``, path without a final slash or ``.html``,
    query without tracking keys; no scheme and no fragment."""
    url = F.regexp_replace(F.coalesce(url, F.lit("")), r"#.*$", "")
    rest = F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(rest, r"^([^/?]*)", 1)), r"^(?:www|m)\.", "")
    path = F.regexp_replace(F.regexp_extract(rest, r"^[^/?]*([^?]*)", 1), r"(?:/|\.html)$", "")
    query = F.regexp_extract(rest, r"\?(.*)$", 1)
    query = F.regexp_replace(F.regexp_replace(query, rf"(^|&){TRACKING}=[^&]*", ""), r"^&", "")
    return F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def _plain_tag(headers: Column) -> Column:
    return F.regexp_replace(headers["etag"], r"^[Ww]/", "")


def merged_headers(stored: Column, update: Column) -> Column:
    """Stored headers with the permitted ones of a not-modified answer put in their place."""
    new = F.map_filter(update, lambda k, v: k.isin(*PERMITTED))
    return F.map_concat(F.map_filter(stored, lambda k, v: ~F.array_contains(F.map_keys(new), k)), new)


def header_text(headers: Column) -> Column:
    """Headers as sorted lines ``name: value``."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(headers)), lambda e: F.concat(e["key"], F.lit(": "), F.coalesce(e["value"], F.lit("")))), "\n")


def resolve(records: DataFrame, slice_seconds: int = SLICE_SECONDS) -> DataFrame:
    """``record_id, canonical_url, response_id, status, headers`` for each revisit of
    ``records`` (``record_id long, kind, url, seconds long, headers map``).

    ``kind`` is ``response`` or ``revisit``; status is ``resolved``,
    ``mismatch`` (the latest response has other validators), ``unchecked``
    (none to compare) or ``no_response``.
    """
    headers = F.coalesce(F.col("headers"), F.create_map().cast("map<string,string>"))
    plain = F.size(F.array_distinct(F.transform(F.map_keys(headers), lambda k: F.lower(k)))) == F.size(headers)
    # of names that differ in case alone the last in order counts
    kept = F.map_filter(headers, lambda k, v: ~F.exists(F.map_keys(headers), lambda o: (F.lower(o) == F.lower(k)) & (o > k)))
    lower = F.when(plain, F.transform_keys(headers, lambda k, v: F.lower(k))).otherwise(F.transform_keys(kept, lambda k, v: F.lower(k)))
    rows = records.where(F.col("kind").isin("response", "revisit")).select(
        "record_id", "kind", canonical_url(F.col("url")).alias("canonical_url"), "seconds", lower.alias("headers"))
    rows = written(rows.withColumn("slice", F.floor(F.col("seconds") / slice_seconds)), "captures")
    timed = rows.where("seconds is not null")
    order = ["seconds", "record_id"]
    answer = F.when(F.col("kind") == "response", F.struct("record_id", "headers"))
    inside = Window.partitionBy("canonical_url", "slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    seen = timed.withColumn("found", F.last(answer, ignorenulls=True).over(inside)).where("kind = 'revisit'")

    # the last response of each slice, carried to the URL's next slices
    last = timed.groupBy("canonical_url", "slice").agg(F.max_by(answer, F.when(F.col("kind") == "response", F.struct(*order))).alias("last"))
    before = Window.partitionBy("canonical_url").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.withColumn("carried", F.last("last", ignorenulls=True).over(before)).where("carried is not null").select("canonical_url", "slice", "carried")
    carried = written(carried, "carried")
    joined = (seen.join(carried, ["canonical_url", "slice"], "left").withColumn("found", F.coalesce("found", "carried")).drop("carried", "slice")
              .unionByName(rows.where("kind = 'revisit' and seconds is null").withColumn("found", F.lit(None).cast(seen.schema["found"].dataType)).drop("slice")))
    old, new = F.col("found.headers"), F.col("headers")
    tags, dates = _plain_tag(old) == _plain_tag(new), old["last-modified"] == new["last-modified"]
    status = (F.when(F.col("found").isNull(), "no_response").when(tags, "resolved").when(~tags, "mismatch")
              .when(dates, "resolved").when(~dates, "mismatch").otherwise("unchecked"))
    joined = joined.withColumn("status", status)
    return joined.select("record_id", "canonical_url", F.when(F.col("status") != "mismatch", F.col("found.record_id")).alias("response_id"), "status",
                         F.when(F.col("status").isin("resolved", "unchecked"), merged_headers(old, new)).otherwise(new).alias("headers"))
