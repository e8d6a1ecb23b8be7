"""Moderation: routing reasons, the queue, decisions and removal requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stallwise.operators import price

#: Publishing and borderline confidences, reports that hide, queue size; fixed values.
PUBLISH_CONFIDENCE, BORDERLINE_CONFIDENCE, REPORT_LIMIT, QUEUE = 0.80, 0.90, 3, 50


def queue_reason(confidence: Column, price_etb: Column, median: Column, low_fence: Column, flagged: Column, reports: Column, seen: Column) -> Column:
    """The first of five reasons that holds, or null. Unknown medians and fences claim nothing."""
    outlier = (price_etb < price.OUTLIER_RATIO * median) | (price_etb < low_fence)
    return (
        F.when(confidence < PUBLISH_CONFIDENCE, "low_confidence").when(outlier, "price_outlier").when(flagged, "flagged_phone").when(reports >= REPORT_LIMIT, "report_threshold")
        .when((seen > 1) & (confidence < BORDERLINE_CONFIDENCE), "borderline_dedup")
    )


def flagged_phones(sightings: DataFrame, listings: DataFrame) -> DataFrame:
    """Phones that a removed listing was posted with."""
    removed = listings.where(F.col("status") == "removed").select(F.col("id").alias("listing_id"))
    return sightings.where(F.col("phone_normalized").isNotNull()).join(removed, "listing_id", "left_semi").select("phone_normalized").distinct()


def scraped_queue(listings: DataFrame, sightings: DataFrame, channels: DataFrame, reports: DataFrame, stats: DataFrame, probe: int = QUEUE + 1) -> DataFrame:
    """Queued listings, least confident first, with their reason.

    The first ``probe`` sighting rows are taken before they are reduced to one row a listing, as a page's probe does;
    so listings with many sightings take up several of them.
    """
    queued = listings.where(F.col("status") == "queued")
    rows = sightings.join(queued, sightings["listing_id"] == queued["id"]).drop("listing_id").join(F.broadcast(channels.select(F.col("id").alias("channel_id"), "username")), "channel_id")
    first = rows.orderBy("extraction_confidence", "id", "raw_message_id").limit(probe)
    one = first.groupBy("id").agg(F.min_by(F.struct(*[c for c in first.columns if c != "id"]), "raw_message_id").alias("x")).select("id", "x.*")
    flags = F.broadcast(flagged_phones(sightings, listings).withColumn("_flagged", F.lit(True)).join(F.broadcast(one.select("phone_normalized").distinct()), "phone_normalized", "left_semi"))
    counts = reports.join(F.broadcast(one.select(F.col("id").alias("listing_id"))), "listing_id", "left_semi").groupBy("listing_id").agg(F.count("*").alias("n_reports"))
    found = price.ladder(one.join(flags, "phone_normalized", "left").join(counts, F.col("id") == counts["listing_id"], "left").drop("listing_id"), stats, price.MODERATION_MIN_SAMPLE)
    precise = F.col("scope").isin("term", "term+condition")
    reason = queue_reason(F.col("extraction_confidence"), F.col("price_etb_listing"), F.col("median_etb"), F.when(precise, F.col("low_fence_etb")), F.coalesce("_flagged", F.lit(False)), F.coalesce("n_reports", F.lit(0)), F.col("seen_in_channels"))
    return found.select("id", F.lit("scraped").alias("origin"), "username", "extraction_confidence", reason.alias("reason")).orderBy("extraction_confidence", "id")


def merged_queue(native: DataFrame, scraped: DataFrame, limit: int = QUEUE) -> DataFrame:
    """Native posts first, then scraped ones, at most ``limit``."""
    both = native.withColumn("_rank", F.lit(0)).unionByName(scraped.withColumn("_rank", F.lit(1)))
    return both.orderBy("_rank", "extraction_confidence", "id").limit(limit).drop("_rank")


def decide(listings: DataFrame, decisions: DataFrame) -> DataFrame:
    """``listings`` after ``decisions`` (id, action, new_title, new_price): only queued ones change.

    approve publishes; approve_with_edits also replaces what is given; reject and ban_channel remove. Of several
    decisions on a listing the first counts.
    """
    d = decisions.groupBy("id").agg(F.min_by(F.struct("action", "new_title", "new_price"), "decision_id").alias("d"))
    open_ = (F.col("status") == "queued") & F.col("d").isNotNull()
    action = F.col("d.action")
    edit = open_ & (action == "approve_with_edits")
    status = F.when(open_ & action.isin("approve", "approve_with_edits"), "live").when(open_ & action.isin("reject", "ban_channel"), "removed").otherwise(F.col("status"))
    return listings.join(d, "id", "left").select(
        *[c for c in listings.columns if c not in ("status", "title_en", "price_etb")], status.alias("status"),
        F.when(edit, F.coalesce("d.new_title", "title_en")).otherwise(F.col("title_en")).alias("title_en"), F.when(edit, F.coalesce("d.new_price", "price_etb")).otherwise(F.col("price_etb")).alias("price_etb"),
    )


def banned_channels(decisions: DataFrame, sightings: DataFrame) -> DataFrame:
    """The first sighting's channel of each listing that a ban_channel decision names."""
    banned = decisions.where(F.col("action") == "ban_channel").select(F.col("id").alias("listing_id")).distinct()
    return sightings.join(banned, "listing_id", "left_semi").groupBy("listing_id").agg(F.min_by("channel_id", "raw_message_id").alias("channel_id")).select("channel_id").distinct()


def ban_cascade(listings: DataFrame, sightings: DataFrame, banned: DataFrame) -> DataFrame:
    """``listings`` whose queued rows with any sighting in a banned channel are removed."""
    hit = sightings.join(F.broadcast(banned), "channel_id", "left_semi").select(F.col("listing_id").alias("id")).distinct().withColumn("_hit", F.lit(True))
    return listings.join(hit, "id", "left").withColumn("status", F.when((F.col("status") == "queued") & F.col("_hit"), "removed").otherwise(F.col("status"))).drop("_hit")


def audit_log(listings: DataFrame, decisions: DataFrame) -> DataFrame:
    """One row for each decision that took effect, with the fields before and after as JSON."""
    before = F.to_json(F.struct(F.col("title_en"), F.col("price_etb")))
    after = F.to_json(F.struct(F.coalesce("new_title", "title_en").alias("title_en"), F.coalesce("new_price", "price_etb").alias("price_etb")))
    edited = F.col("action") == "approve_with_edits"
    return decisions.join(listings.where(F.col("status") == "queued"), "id").select("decision_id", "id", "action", F.when(edited, before).alias("edits_before"), F.when(edited, after).alias("edits_after"))


def auto_hide(listings: DataFrame, reports: DataFrame) -> DataFrame:
    """``listings`` with live ones of ``REPORT_LIMIT`` reports hidden."""
    n = reports.groupBy(F.col("listing_id").alias("id")).agg(F.count("*").alias("_n"))
    hide = (F.col("status") == "live") & (F.col("_n") >= REPORT_LIMIT)
    return listings.join(n, "id", "left").withColumn("status", F.when(hide, "hidden").otherwise(F.col("status"))).drop("_n")


def accepted_removals(listings: DataFrame, requests: DataFrame) -> DataFrame:
    """Requests that open: for indexed listings, and one pending at a time (the first)."""
    indexed = listings.where(F.col("tier") == "indexed").select(F.col("id").alias("listing_id"))
    pending = requests.where(F.col("status") == "pending").join(indexed, "listing_id", "left_semi")
    order = Window.partitionBy("listing_id").orderBy("id")
    return pending.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def apply_removals(listings: DataFrame, requests: DataFrame) -> DataFrame:
    """``listings`` whose approved requests removed them."""
    gone = requests.where(F.col("status") == "approved").select(F.col("listing_id").alias("id")).distinct().withColumn("_gone", F.lit(True))
    return listings.join(gone, "id", "left").withColumn("status", F.when(F.col("_gone") & (F.col("tier") == "indexed"), "removed").otherwise(F.col("status"))).drop("_gone")


def native_status(trust: Column) -> Column:
    return F.when(trust == "established", "live").otherwise("queued")


def contact_view(listings: DataFrame, phone: str = "phone", handle: str = "handle") -> DataFrame:
    """``listings`` with contacts nulled unless the listing is live."""
    live = F.col("status") == "live"
    return listings.withColumns({c: F.when(live, F.col(c)) for c in (phone, handle)})
