"""Threads between buyers and sellers: inbox, thread view, polling, unread counts and payment requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows of an inbox and a thread, characters of a body and a preview; fixed values.
INBOX, THREAD, BODY, PREVIEW = 100, 500, 2000, 200


def participant(viewer: Column) -> Column:
    return (F.col("buyer_id") == viewer) | (F.col("seller_id") == viewer)


def role(viewer: Column) -> Column:
    return F.when(F.col("buyer_id") == viewer, "buyer").when(F.col("seller_id") == viewer, "seller")


def unread(viewer: Column) -> Column:
    """Not read, and from the system or the other side."""
    return F.col("read_at").isNull() & (F.col("sender_id").isNull() | (F.col("sender_id") != viewer))


def inbox(threads: DataFrame, messages: DataFrame, viewer: int, limit: int = INBOX) -> DataFrame:
    """A viewer's threads, newest activity first, with the last message's preview and the unread count.

    Messages are reduced to the viewer's threads and aggregated once for both.
    """
    v = F.lit(viewer)
    own = threads.where(participant(v))
    side = messages.join(F.broadcast(own.select(F.col("id").alias("conversation_id"))), "conversation_id", "left_semi").groupBy("conversation_id").agg(
        F.max_by(F.substring(F.trim("body"), 1, PREVIEW), F.struct("created_at", "id")).alias("preview"), F.count(F.when(unread(v), 1)).alias("unread")
    )
    rows = own.join(side, own["id"] == side["conversation_id"], "left").select("id", "listing_id", role(v).alias("role"), "last_message_at", "preview", F.coalesce("unread", F.lit(0)).alias("unread"))
    return rows.orderBy(F.desc_nulls_last("last_message_at"), "id").limit(limit)


def inboxes(threads: DataFrame, messages: DataFrame) -> DataFrame:
    """Unread counts of every viewer over all their threads."""
    viewers = threads.select("id", F.explode(F.array("buyer_id", "seller_id")).alias("viewer_id"))
    rows = viewers.join(messages, viewers["id"] == messages["conversation_id"]).select("viewer_id", "read_at", "sender_id")
    return rows.groupBy("viewer_id").agg(F.count(F.when(unread(F.col("viewer_id")), 1)).alias("unread"))


def thread(threads: DataFrame, messages: DataFrame, id_: int, viewer: int, since: int | None = None, limit: int = THREAD) -> DataFrame:
    """A thread's messages in order, authors seen from the viewer; none for who takes no part in it."""
    v = F.lit(viewer)
    own = threads.where((F.col("id") == id_) & participant(v)).select(F.col("id").alias("conversation_id"))
    author = F.when(F.col("sender_id").isNull(), "system").when(F.col("sender_id") == v, "me").otherwise("them")
    rows = messages.join(F.broadcast(own), "conversation_id", "left_semi")
    if since is not None:
        rows = rows.where(F.col("created_at") > since)
    return rows.select("id", author.alias("author"), F.substring(F.trim("body"), 1, BODY).alias("body"), "created_at").orderBy("created_at", "id").limit(limit)


def last_messages(messages: DataFrame) -> DataFrame:
    """Each thread's latest message id and sender."""
    return messages.groupBy("conversation_id").agg(F.max_by(F.struct("id", "sender_id"), F.struct("created_at", "id")).alias("x")).select("conversation_id", "x.*")


def mark_read(messages: DataFrame, viewer: Column, at: Column) -> DataFrame:
    return messages.withColumn("read_at", F.when(unread(viewer), at).otherwise(F.col("read_at")))


def payment_requests(messages: DataFrame, threads: DataFrame, listings: DataFrame, reservations: DataFrame, viewer: int) -> DataFrame:
    """State of each thread's payment requests: stale unless the newest, on a live listing without a hold; who can pay."""
    asked = messages.where(F.col("kind") == "payment_request")
    newest = Window.partitionBy("conversation_id").orderBy(F.desc("created_at"), F.desc("id"))
    ranked = asked.withColumn("_n", F.row_number().over(newest)).join(threads.select(F.col("id").alias("conversation_id"), "listing_id", "buyer_id", "seller_id"), "conversation_id")
    hold = reservations.groupBy("listing_id").agg(F.max(F.col("status").isin("paid", "completed")).alias("_paid"), F.max(F.col("status").isin("pending", "paid")).alias("_held"))
    rows = ranked.join(hold, "listing_id", "left").join(listings.select(F.col("id").alias("listing_id"), F.col("status").alias("listing_status")), "listing_id", "left")
    state = F.when(F.coalesce("_paid", F.lit(False)), "paid").when((F.col("_n") > 1) | (F.coalesce("listing_status", F.lit("")) != "live") | F.coalesce("_held", F.lit(False)), "stale").otherwise("open")
    return rows.select("id", "conversation_id", state.alias("state"), ((state == "open") & (F.col("buyer_id") == viewer)).alias("can_pay"))


def can_message(listings: DataFrame, viewer: int, threads: DataFrame) -> DataFrame:
    """Whether a viewer may write to each listing's seller, and the thread they have."""
    own = threads.where(F.col("buyer_id") == viewer).groupBy("listing_id").agg(F.min("id").alias("thread_id"))
    may = F.col("seller_id").isNotNull() & (F.col("status") == "live") & (F.col("seller_id") != viewer)
    return listings.join(F.broadcast(own), listings["id"] == own["listing_id"], "left").select("id", F.coalesce(may, F.lit(False)).alias("can_message"), "thread_id")


def get_or_create(threads: DataFrame, wanted: DataFrame) -> DataFrame:
    """Threads after requests (listing_id, buyer_id, seller_id): one a listing and buyer; existing ones stay."""
    new = wanted.groupBy("listing_id", "buyer_id").agg(F.min("seller_id").alias("seller_id")).join(threads.select("listing_id", "buyer_id"), ["listing_id", "buyer_id"], "left_anti")
    return threads.select("listing_id", "buyer_id", "seller_id").unionByName(new.select("listing_id", "buyer_id", "seller_id"))


def post(threads: DataFrame, messages: DataFrame) -> DataFrame:
    """``threads`` with last_message_at raised to their messages' latest."""
    last = messages.groupBy("conversation_id").agg(F.max("created_at").alias("_last"))
    return threads.join(last, threads["id"] == last["conversation_id"], "left").select(*[c for c in threads.columns if c != "last_message_at"], F.greatest("last_message_at", "_last").alias("last_message_at"))
