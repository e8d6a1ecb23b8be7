"""Operational counters: conditional counts in one pass a table, channel quality and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def count_if(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def admin_counters(listings: DataFrame, reports: DataFrame, removals: DataFrame, channels: DataFrame, raw: DataFrame, as_of: Column) -> DataFrame:
    """One row of counters; each table is read once. ``as_of`` is a date, windows are whole days."""
    state = lambda s: count_if(F.col("status") == s).alias(s)
    a = listings.agg(state("queued"), count_if((F.col("status") == "queued") & (F.col("posted_at") >= F.date_sub(as_of, 1))).alias("queued_24h"), state("live"), state("hidden"), state("removed"))
    b = reports.agg(F.count("*").alias("reports"), count_if(F.col("created_on") >= F.date_sub(as_of, 7)).alias("reports_7d"))
    c = removals.agg(count_if(F.col("status") == "pending").alias("removals_pending"))
    d = channels.agg(F.count("*").alias("channels"), count_if(F.col("active")).alias("channels_active"))
    e = raw.agg(F.count("*").alias("raw_messages"), count_if(F.col("processed_at").isNull()).alias("raw_unprocessed"), F.max("posted_at").alias("last_captured"))
    one = a
    for other in (b, c, d, e):  # single rows side by side
        one = one.join(F.broadcast(other))
    return one


def ingest_stats(channels: DataFrame, raw: DataFrame) -> DataFrame:
    """Messages and last message of each channel, none included."""
    per = raw.groupBy("channel_id").agg(F.count("*").alias("n"), F.max("posted_at").alias("last_posted"))
    return channels.join(per, F.col("id") == F.col("channel_id"), "left").select("id", "username", F.coalesce("n", F.lit(0)).alias("n_messages"), "last_posted")


def channel_rows(channels: DataFrame, sightings: DataFrame, listings: DataFrame) -> DataFrame:
    """Channel quality by rows: sightings, and those whose listing is live or removed."""
    per = sightings.join(listings.select(F.col("id").alias("listing_id"), "status"), "listing_id").groupBy("channel_id").agg(
        F.count("*").alias("n"), count_if(F.col("status") == "live").alias("live"), count_if(F.col("status") == "removed").alias("removed")
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return channels.join(per, F.col("id") == F.col("channel_id"), "left").select("id", F.coalesce("n", F.lit(0)).alias("sightings"), zero("live"), zero("removed"))


def channel_quality(channels: DataFrame, sightings: DataFrame, listings: DataFrame) -> DataFrame:
    """Channel quality by distinct listings, with the share removed in percent, one decimal; null without listings."""
    pairs = sightings.select("channel_id", "listing_id").distinct()
    per = pairs.join(listings.select(F.col("id").alias("listing_id"), "status"), "listing_id").groupBy("channel_id").agg(F.count("*").alias("n"), count_if(F.col("status") == "removed").alias("removed"))
    n, removed = F.coalesce("n", F.lit(0)), F.coalesce("removed", F.lit(0))
    share = F.round(removed.cast("decimal(20,0)") * 100 / F.when(n > 0, n).cast("decimal(20,0)"), 1).cast("double")
    return channels.join(per, F.col("id") == F.col("channel_id"), "left").select("id", n.alias("listings"), removed.alias("removed"), share.alias("rejection_pct"))


def category_counts(categories: DataFrame, listings: DataFrame) -> DataFrame:
    """Live listings of each category that has any, most first."""
    live = listings.where(F.col("status") == "live").groupBy("category_slug").agg(F.count("*").alias("n"))
    return categories.join(live, F.col("slug") == F.col("category_slug")).select("slug", "name_en", "n").orderBy(F.desc("n"), "slug")


def landing_totals(listings: DataFrame, raw: DataFrame) -> DataFrame:
    """Live listings, sightings seen, copies collapsed, last capture and messages still to process."""
    live = F.col("status") == "live"
    a = listings.agg(count_if(live).alias("live"), F.coalesce(F.sum(F.when(live, F.col("seen_in_channels"))), F.lit(0)).alias("seen"))
    b = raw.agg(F.max("posted_at").alias("last_capture"), count_if(F.col("processed_at").isNull()).alias("pending"))
    return a.join(F.broadcast(b)).withColumn("collapsed", F.greatest(F.col("seen") - F.col("live"), F.lit(0)))


def cluster_rollup(sightings: DataFrame) -> DataFrame:
    """Each listing's price range, distinct channels and first phone."""
    return sightings.groupBy("listing_id").agg(
        F.min("price_etb").alias("min_etb"), F.max("price_etb").alias("max_etb"), F.countDistinct("channel_id").alias("n_channels"),
        F.min_by("phone_normalized", F.when(F.col("phone_normalized").isNotNull(), F.struct("posted_at", "raw_message_id"))).alias("first_phone"),
    )


def ratings_by_seller(ratings: DataFrame) -> DataFrame:
    return ratings.groupBy("seller_id").agg(F.avg("score").alias("rating_avg"), F.count("*").alias("rating_count"))


def over_threshold(reports: DataFrame, at_least: int = 3) -> DataFrame:
    """Listings with ``at_least`` reports."""
    return reports.groupBy("listing_id").agg(F.count("*").alias("n_reports")).where(F.col("n_reports") >= at_least)


def confidence_histogram(rows: DataFrame, column: str) -> DataFrame:
    """Five bins over 0 to 1, the last closed, with share of all rows and a bar's length of at most 35."""
    c = F.col(column)
    binned = rows.where(c.isNotNull()).select(F.least(F.floor(c * 5 + 1e-9), F.lit(4)).cast("int").alias("bin"))
    counts = binned.groupBy("bin").agg(F.count("*").alias("n"))
    whole = counts.agg(F.sum("n").alias("total"), F.max("n").alias("most"))
    out = counts.join(F.broadcast(whole))
    return out.select("bin", "n", F.floor(F.col("n") * 35 / F.col("most")).cast("int").alias("bar"), F.round(100.0 * F.col("n") / F.col("total"), 2).alias("pct"))


def field_coverage(rows: DataFrame, fields: list[str]) -> DataFrame:
    """Percent of rows in which each field is set."""
    return rows.agg(*[(F.round(100.0 * F.count(f) / F.count("*"), 4)).alias(f"{f}_pct") for f in fields])


def latency_summary(samples: DataFrame, target: float = 200.0) -> DataFrame:
    return samples.agg(F.avg("ms").alias("avg_ms"), F.max("ms").alias("max_ms"), (F.max("ms") < target).alias("passed"))


def report_feed(reports: DataFrame, listings: DataFrame, limit: int = 100) -> DataFrame:
    """Newest reports with their listing's title and status."""
    named = listings.select(F.col("id").alias("listing_id"), "title_en", "status")
    return reports.join(named, "listing_id").select("id", "listing_id", "title_en", "status", "created_on").orderBy(F.desc("id")).limit(limit)


def removal_feed(removals: DataFrame, listings: DataFrame, newest_first: bool, limit: int = 100) -> DataFrame:
    """Pending removal requests with titles, in either order."""
    named = listings.select(F.col("id").alias("listing_id"), "title_en")
    rows = removals.where(F.col("status") == "pending").join(named, "listing_id").select("id", "listing_id", "title_en", "created_on")
    return rows.orderBy(F.desc("id") if newest_first else F.asc("id")).limit(limit)
