"""Not-modified revisits resolved to the responses that they stand for.

A revisit (a 304 capture) is joined to the latest earlier full response of the same canonical URL. Its validators
must agree with that response, and the headers that a 304 may update are merged over the response's.

The as-of join carries compact pointers only. Captures lie in ranges of (URL, time) of about equally many rows: the
last full response of a URL's earlier ranges is carried forward, and a window within a range finds the nearer ones, so
one URL with a third of all captures is spread over its ranges. Payloads are joined to pointers at the end, those of a
carried response once a range, so that a response with very many revisits isn't one task either.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stallwise.session import checkpoint

#: Headers that a 304 response may update, fixed values, lower case.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary", "age", "warning", "set-cookie")
#: Query parameters that do not change a page, fixed values.
TRACKING = r"^(utm_[a-z]+|ref|fbclid|gclid|sessionid)="
SLICE_ROWS = 20_000
#: Up to so many rows of one URL, or one number, each are broadcast.
SMALL_ROWS = 50_000
#: Marks a response in its revisit's own range.
NEAR = -1


def canonical_url(url: Column) -> Column:
    """Host (lower case, without www., default ports) and path with its remaining parameters, sorted.

    The scheme, user, fragment, tracking parameters, a final slash and a final .html are left out.
    """
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), r"#.*$", ""), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?@]*@)?", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(bare, r"^([^/?]*)", 1)), r":(80|443)$", ""), r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(bare, r"^[^/?]*([^?]*)", 1), r"(/|/index\.html|\.html)$", "")
    query = F.split(F.regexp_extract(bare, r"\?(.*)$", 1), "&")
    kept = F.sort_array(F.filter(query, lambda x: (x != "") & ~x.rlike(TRACKING)))
    return F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit("")))


def header(headers: Column, name: str) -> Column:
    """A header's value by its name in any case; null where there is none."""
    return F.get(F.map_values(F.map_filter(headers, lambda k, v: F.lower(k) == name)), F.lit(0))


def _strong(etag: Column) -> Column:
    return F.regexp_replace(etag, r"^W/", "")


def merge_headers(base: Column, update: Column) -> Column:
    """The base's headers, lower case, with those of ``update`` that a 304 may change in their place."""
    lower = lambda m: F.map_from_entries(F.transform(F.array_distinct(F.transform(F.map_keys(m), F.lower)), lambda k: F.struct(k, F.get(F.map_values(F.map_filter(m, lambda k2, v: F.lower(k2) == k)), F.lit(0)))))
    base, update = lower(base), F.map_filter(lower(update), lambda k, v: k.isin(*PERMITTED) & v.isNotNull())
    kept = F.map_filter(base, lambda k, v: ~F.array_contains(F.map_keys(update), k))
    return F.map_concat(kept, update)


def _bounded(rows: DataFrame, n: int) -> DataFrame:
    """``rows``, of which there are at most ``n``, as the broadcast side of a join while that many are small."""
    return F.broadcast(rows) if n <= SMALL_ROWS else rows


def resolve_revisits(captures: DataFrame, payload: str = "payload") -> DataFrame:
    """A row for each revisit of ``captures``: (record_id, url, ts, status, headers, payload).
    ``ts`` is a whole number.

    Captures with status 304 are revisits, those with status 200 full responses; others are neither. Returns
    record_id, canonical_url, ts, base_id, outcome, headers and the payload. ``outcome`` is ``resolved``,
    ``mismatch`` (an ETag, else a Last-Modified, differs from the response's), ``unchecked`` (no validator on both
    sides; taken as resolved) or ``missing`` (no earlier response). Mismatched and missing revisits keep their own
    headers and have no payload. Of responses at one time the highest record_id counts; a response at the
    revisit's own time is not earlier. A null url or ts resolves to nothing. Repeated revisits give repeated rows,
    of repeated responses one is used. Null headers count as none.
    """
    rows = captures.select(
        "record_id", canonical_url(F.col("url")).alias("canonical_url"), "ts", F.col("status").cast("int").alias("status"),
        F.coalesce("headers", F.create_map().cast("map<string,string>")).alias("headers"),
    ).where(F.col("status").isin(200, 304))
    pointers = checkpoint(
        rows.select("record_id", "canonical_url", "ts", "status", _strong(header(F.col("headers"), "etag")).alias("etag"), header(F.col("headers"), "last-modified").alias("modified"))
    )
    placed = F.col("canonical_url").isNotNull() & F.col("ts").isNotNull()
    n_slices = max(1, pointers.where(placed).count() // SLICE_ROWS)
    dealt = checkpoint(pointers.where(placed).repartitionByRange(n_slices, "canonical_url", "ts").withColumn("_slice", F.spark_partition_id()))
    full = F.when(F.col("status") == 200, F.struct("ts", "record_id", "etag", "modified"))
    sums = dealt.groupBy("canonical_url", "_slice").agg(F.max(full).alias("_last"))
    before = Window.partitionBy("canonical_url").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.select("canonical_url", "_slice", F.max("_last").over(before).alias("_carried")).where("_carried is not null")
    earlier = Window.partitionBy("canonical_url", "_slice").orderBy("ts").rangeBetween(Window.unboundedPreceding, -1)
    found = dealt.withColumn("_near", F.max(full).over(earlier)).where("status = 304")
    # a URL has a carried response where it goes on from the range before: once a range at most
    found = found.join(_bounded(carried, n_slices), ["canonical_url", "_slice"], "left").withColumn("_base", F.coalesce("_near", "_carried"))
    found = found.withColumn("_copy", F.when(F.col("_near").isNull(), F.col("_slice")).otherwise(NEAR))
    nowhere = pointers.where((F.col("status") == 304) & ~placed)
    found = found.drop("_near", "_carried", "_slice").unionByName(nowhere, allowMissingColumns=True)
    tag, date = F.col("_base.etag"), F.col("_base.modified")
    outcome = (
        F.when(F.col("_base").isNull(), "missing")
        .when(F.col("etag").isNotNull() & tag.isNotNull(), F.when(F.col("etag") == tag, "resolved").otherwise("mismatch"))
        .when(F.col("modified").isNotNull() & date.isNotNull(), F.when(F.col("modified") == date, "resolved").otherwise("mismatch"))
        .otherwise("unchecked")
    )
    headers = F.coalesce("headers", F.create_map().cast("map<string,string>"))
    own = captures.where(F.col("status") == 304).select("record_id", headers.alias("_own")).dropDuplicates(["record_id"])
    found = found.select("record_id", "canonical_url", "ts", F.col("_base.record_id").alias("base_id"), outcome.alias("outcome"), "_copy")
    found = checkpoint(found.join(own, "record_id", "left"))
    took = F.col("outcome").isin("resolved", "unchecked")
    base = captures.where(F.col("status") == 200).select(F.col("record_id").alias("base_id"), headers.alias("_headers"), F.col(payload).alias("payload"))
    near = found.where(took & (F.col("_copy") == NEAR)).join(base.dropDuplicates(["base_id"]), "base_id", "left")
    far = found.where(took & (F.col("_copy") != NEAR))
    copies = checkpoint(far.select("base_id", "_copy").distinct())
    few = base.join(_bounded(copies.select("base_id").distinct(), n_slices), "base_id", "left_semi").dropDuplicates(["base_id"])
    far = far.join(few.join(_bounded(copies, n_slices), "base_id"), ["base_id", "_copy"], "left")
    joined = near.unionByName(far).unionByName(found.where(~took), allowMissingColumns=True)
    return joined.select(
        "record_id", "canonical_url", "ts", "base_id", "outcome",
        F.when(took, merge_headers(F.col("_headers"), F.col("_own"))).otherwise(F.col("_own")).alias("headers"),
        "payload",
    )
