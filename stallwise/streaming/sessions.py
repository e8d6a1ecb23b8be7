"""Event-time operators that run on batches and on streams: albums, rate limits, alerts and the raw sink."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stallwise.session import ship_package


def albums(messages: DataFrame, gap: str = "3 seconds", watermark: str | None = None) -> DataFrame:
    """Albums of (channel_id, grouped_id): messages within ``gap`` of each other, folded to one row.

    The lowest message id is the primary one, the first caption that is not blank counts, media references are in id
    order and the highest id is the mark to resume from. Works on a stream where ``watermark`` is given.
    """
    source = messages.withWatermark("ts", watermark) if watermark else messages
    part = F.struct("message_id", "caption", "media")
    folded = source.groupBy("channel_id", "grouped_id", F.session_window("ts", gap).alias("w")).agg(F.collect_list(part).alias("_parts"))
    parts = F.array_sort("_parts")
    captions = F.filter(F.transform(parts, lambda p: F.trim(p["caption"])), lambda c: c.isNotNull() & (c != ""))
    return folded.select(
        "channel_id", "grouped_id", F.get(parts, F.lit(0))["message_id"].alias("message_id"), F.get(captions, F.lit(0)).alias("caption"),
        F.filter(F.transform(parts, lambda p: p["media"]), lambda m: m.isNotNull()).alias("media_refs"), F.get(parts, F.size(parts) - 1)["message_id"].alias("high_water"),
    )


def consecutive_runs(messages: DataFrame) -> DataFrame:
    """Runs of consecutive messages of a channel with one grouped_id, numbered from 1 (the batch form)."""
    order = Window.partitionBy("channel_id").orderBy("message_id")
    starts = F.when(F.col("grouped_id").eqNullSafe(F.lag("grouped_id").over(order)) & F.col("grouped_id").isNotNull(), 0).otherwise(1)
    return messages.withColumn("_start", starts).withColumn("run", F.sum("_start").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_start")


def trailing_counts(hits: DataFrame, seconds: int) -> DataFrame:
    """For each hit, earlier hits of its key within the window (the report form: refused ones count too)."""
    window = Window.partitionBy("key").orderBy("us").rangeBetween(-seconds * 1_000_000, -1)
    return hits.withColumn("us", F.unix_micros("ts")).withColumn("in_window", F.count("*").over(window)).drop("us")


def limited(hits: DataFrame, limit: int, seconds: int) -> DataFrame:
    """(id, accepted): a hit is accepted while fewer than ``limit`` accepted ones are in the window before it.

    The state of a key is at most ``limit`` times. Keys' hits come sorted and in pages, so a key's rows are never in
    memory as a whole.
    """
    ship_package(hits.sparkSession)
    rows = hits.select("id", "key", F.unix_micros("ts").alias("us"))
    return rows.repartition("key").sortWithinPartitions("key", "us", "id").mapInPandas(_sorted_pages(limit, seconds), "id long, accepted boolean")


def _sorted_pages(limit: int, seconds: int):
    def run(pages: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, accepted = None, []
        for page in pages:
            ok = []
            for k, us in zip(page["key"], page["us"], strict=True):
                if k != key:
                    key, accepted = k, []
                accepted = [t for t in accepted if t > us - seconds * 1_000_000]
                ok.append(len(accepted) < limit)
                if ok[-1]:
                    accepted.append(us)
            yield pd.DataFrame({"id": page["id"], "accepted": ok})

    return run


def backoff_minutes(attempts: Column) -> Column:
    return F.least(F.pow(F.lit(2), attempts), F.lit(60)).cast("int")


def next_job_state(attempts: Column, failed: Column) -> Column:
    """A job's state after an attempt: done, failed at the fifth failure, else pending again."""
    return F.when(~failed, "done").when(attempts >= 5, "failed").otherwise("pending")


def merge_each_batch(stream: DataFrame, merge, checkpoint_dir: str):
    """Run ``merge(batch, batch_id)`` on every micro-batch of what has arrived, then stop; idempotent merges make replays harmless."""
    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint_dir).trigger(availableNow=True).start()


def allowlisted(messages: DataFrame, versions: DataFrame, every: int = 60) -> DataFrame:
    """Messages whose channel was active when the allowlist was last read, which is every ``every`` seconds, as a whole.

    ``messages`` has channel_id and ts, ``versions`` channel_id, active and changed_at, all in whole seconds; of versions of one
    second an active one counts. A channel without a version by then is not allowed. A channel is judged once a
    reading and not once a message. On a stream, ``merge_each_batch`` reads the list anew for each batch.
    """
    read = messages.withColumn("_read", F.col("ts") - F.col("ts") % every)
    known = versions.select(F.col("channel_id").alias("_c"), F.col("changed_at").alias("_at"), F.col("active").alias("_active"))
    asked = read.select("channel_id", "_read").distinct().join(known, (F.col("channel_id") == F.col("_c")) & (F.col("_at") <= F.col("_read")))
    allowed = asked.groupBy("channel_id", "_read").agg(F.max_by("_active", F.struct("_at", "_active")).alias("_ok")).where("_ok").drop("_ok")
    return read.join(allowed, ["channel_id", "_read"], "left_semi").drop("_read")


def claimed(jobs: DataFrame, now: int, most: int = 1) -> DataFrame:
    """``jobs`` after a worker took the ``most`` that have waited longest: pending, due by ``now``, first by run_after and id.

    They are running and have one more attempt. ``most`` is a worker's share, a few rows, and so is broadcast.
    """
    due = jobs.where((F.col("status") == "pending") & (F.col("run_after") <= now)).orderBy("run_after", "id").limit(most).select("id", F.lit(True).alias("_mine"))
    rows, mine = jobs.join(F.broadcast(due), "id", "left"), F.col("_mine").isNotNull()
    return rows.withColumns({"status": F.when(mine, "running").otherwise(F.col("status")), "attempts": F.when(mine, F.col("attempts") + 1).otherwise(F.col("attempts"))}).drop("_mine")
