"""Deposit holds: amounts, lapse, the active hold, creation, settlement and one-time codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Seconds until an unpaid hold lapses; deposit share and bounds; fixed values.
PENDING_SECONDS, SHARE, LEAST, MOST = 15 * 60, 0.05, 50, 1000


def deposit(price: Column) -> Column:
    """5 % of a price within 50 and 1000, to the nearest 10 (halves up), never above the price; null unless positive."""
    bounded = F.least(F.greatest(price * SHARE, F.lit(float(LEAST))), F.lit(float(MOST)))
    return F.when(price > 0, F.least((F.floor(bounded / 10 + 0.5) * 10).cast("int"), price.cast("int")))


def lapsed(as_of: Column) -> Column:
    return (F.col("expires_at") <= as_of) | ((F.col("status") == "pending") & (F.col("created_at") + PENDING_SECONDS <= as_of))


def active_holds(reservations: DataFrame, as_of: Column) -> DataFrame:
    """Each listing's latest pending or paid hold that has not lapsed."""
    open_ = reservations.where(F.col("status").isin("pending", "paid"))
    last = open_.groupBy("listing_id").agg(F.max_by(F.struct("id", "buyer_id", "status", "created_at", "expires_at"), F.struct("created_at", "id")).alias("x")).select("listing_id", "x.*")
    return last.where(~lapsed(as_of))


def requested_holds(requests: DataFrame, listings: DataFrame, holds: DataFrame) -> DataFrame:
    """For each request (id, listing_id, buyer_id) why it fails, or null; of those that may, the first holds."""
    named = requests.join(listings.select(F.col("id").alias("listing_id"), "status", "price_etb", "seller_id"), "listing_id", "left").join(holds.select("listing_id", F.lit(True).alias("_held")), "listing_id", "left")
    reason = (
        F.when(F.col("status").isNull(), "not_found").when(F.col("status") != "live", "not_live").when(F.col("seller_id").isNull(), "no_seller").when(F.col("seller_id") == F.col("buyer_id"), "own_listing")
        .when(F.col("price_etb").isNull(), "no_price").when(deposit(F.col("price_etb")).isNull(), "no_deposit").when(F.col("_held"), "already_held")
    )
    checked = named.withColumn("reason", reason)
    order = Window.partitionBy("listing_id", F.col("reason").isNull()).orderBy("id")
    raced = F.when(F.col("reason").isNull() & (F.row_number().over(order) > 1), "raced").otherwise(F.col("reason"))
    return checked.select("id", "listing_id", "buyer_id", raced.alias("reason"), F.when(raced.isNull(), deposit(F.col("price_etb"))).alias("deposit_etb"))


def settle(reservations: DataFrame, results: DataFrame) -> DataFrame:
    """``reservations`` after payment results (id, paid): only pending ones change, so a repeat changes nothing."""
    r = results.groupBy("id").agg(F.max("paid").alias("_paid"))
    status = F.when((F.col("status") == "pending") & F.col("_paid").isNotNull(), F.when(F.col("_paid"), "paid").otherwise("failed")).otherwise(F.col("status"))
    return reservations.join(r, "id", "left").withColumn("status", status).drop("_paid")


def close(reservations: DataFrame, requests: DataFrame) -> DataFrame:
    """``reservations`` whose buyer asked (id, user_id) to complete a paid hold."""
    r = requests.select("id", F.col("user_id").alias("buyer_id")).distinct().withColumn("_ask", F.lit(True))
    return reservations.join(r, ["id", "buyer_id"], "left").withColumn("status", F.when((F.col("status") == "paid") & F.col("_ask"), "completed").otherwise(F.col("status"))).drop("_ask")


def paid_counts(reservations: DataFrame) -> DataFrame:
    return reservations.groupBy("buyer_id").agg(F.count(F.when(F.col("status").isin("paid", "completed"), 1)).alias("paid"))


def buyer_list(reservations: DataFrame, buyer: int, limit: int = 50) -> DataFrame:
    return reservations.where(F.col("buyer_id") == buyer).orderBy(F.desc("created_at"), "id").limit(limit)


def usable_codes(codes: DataFrame, as_of: Column, attempts: int = 5) -> DataFrame:
    """Each phone's newest code that is neither consumed, expired nor tried too often."""
    order = Window.partitionBy("phone").orderBy(F.desc("created_at"), F.desc("id"))
    ok = codes.where(F.col("consumed_at").isNull() & (F.col("expires_at") > as_of) & (F.col("attempts") < attempts))
    return ok.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")
