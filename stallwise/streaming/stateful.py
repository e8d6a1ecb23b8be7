"""Keyed state with timers on streams: albums after a silence, and rate limits that know what they accepted.

Both need a state store with timers: set ``spark.sql.streaming.stateStore.providerClass`` to ``ROCKSDB``. State is kept with the stream's
checkpoint, so a restarted query goes on where the last one stopped, and pending albums flush at its first batch after their silence.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from stallwise.session import ship_package

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_ALBUM = "channel_id long, grouped_id long, message_id long, caption string, media_refs array<string>, high_water long"


class AlbumDebouncer(StatefulProcessor):
    """The parts of an album until none has come for ``idle_ms``: every part sets the timer anew, and the timer folds them once."""

    def __init__(self, idle_ms: int) -> None:
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.parts = handle.getListState("parts", "message_id long, caption string, media string")
        self.due = handle.getValueState("due", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for page in rows:
            text = lambda x: x if isinstance(x, str) else None
            self.parts.appendList([(int(m), text(c), text(r)) for m, c, r in zip(page["message_id"], page["caption"], page["media"], strict=True)])
        if self.due.exists():
            self.handle.deleteTimer(self.due.get()[0])
        at = timerValues.getCurrentProcessingTimeInMs() + self.idle_ms
        self.handle.registerTimer(at)
        self.due.update((at,))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        parts = sorted({tuple(p) for p in self.parts.get()}, key=lambda p: p[0])
        self.parts.clear()
        self.due.clear()
        if not parts:
            return
        captions = [c.strip(" ") for _, c, _ in parts if c is not None and c.strip(" ")]
        yield pd.DataFrame({
            "channel_id": [key[0]], "grouped_id": [key[1]], "message_id": [parts[0][0]], "caption": [captions[0] if captions else None],
            "media_refs": [[m for _, _, m in parts if m is not None]], "high_water": [parts[-1][0]],
        })

    def close(self) -> None:
        pass


def debounced_albums(messages: DataFrame, idle_ms: int = 3000) -> DataFrame:
    """Albums of a stream (channel_id, grouped_id, message_id, caption, media), ``idle_ms`` after their last part arrived.

    The row is that of ``sessions.albums``: least id, first caption that is not blank, media in id order, greatest id. A part sent
    twice counts once. A part that comes after its album went out starts a new one, whose row the idempotent
    sink merges into the first. An album is a few parts, which is what its state holds.
    """
    ship_package(messages.sparkSession)
    keyed = messages.select("channel_id", "grouped_id", "message_id", "caption", "media").groupBy("channel_id", "grouped_id")
    return keyed.transformWithStateInPandas(AlbumDebouncer(idle_ms), _ALBUM, "Append", "ProcessingTime")


class RateLimit(StatefulProcessor):
    """Accepts a hit while fewer than ``limit`` accepted ones are within ``seconds`` before it; holds these only."""

    def __init__(self, limit: int, seconds: int) -> None:
        self.limit, self.window = limit, seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.accepted = handle.getListState("accepted", "us long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = [x[0] for x in self.accepted.get()] if self.accepted.exists() else []
        hits = sorted((int(us), int(i)) for page in rows for us, i in zip(page["us"], page["id"], strict=True))
        out = []
        for us, i in hits:
            held = [t for t in held if t > us - self.window]
            out.append((i, len(held) < self.limit))
            if out[-1][1]:
                held.append(us)
        if held:
            self.accepted.put([(t,) for t in held])
        else:
            self.accepted.clear()
        yield pd.DataFrame(out, columns=["id", "accepted"])

    def close(self) -> None:
        pass


def limited_stream(hits: DataFrame, limit: int, seconds: int) -> DataFrame:
    """(id, accepted) of a stream of hits (id, key, ts), as ``sessions.limited`` says of the same hits in batches that come in order.

    A key's state is at most ``limit`` times. Within a micro-batch hits are judged by time, then id.
    """
    ship_package(hits.sparkSession)
    keyed = hits.select("id", "key", F.unix_micros("ts").alias("us")).groupBy("key")
    return keyed.transformWithStateInPandas(RateLimit(limit, seconds), "id long, accepted boolean", "Append", "None")
