"""Posts of channels as JSON lines in numbered batches: a data source that Spark reads in slices, resumed, pruned or as a stream.

A batch is the folder ``batch=<20 digits>/channel=<id>`` below the source's path, and counts once Spark has put its ``_SUCCESS`` there.
The classes are shipped by value, so executors need nothing but PySpark and pyarrow.
"""

from __future__ import annotations

import json
import re
import sys
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition

NAME = "stallwise_posts"
SCHEMA = "channel_id long, message_id long, grouped_id long, ts long, text string"
ARROW = pa.schema([("channel_id", pa.int64()), ("message_id", pa.int64()), ("grouped_id", pa.int64()), ("ts", pa.int64()), ("text", pa.string())])
ROWS = 4096


@dataclass
class Slice(InputPartition):
    """The lines of a file that begin at a byte from ``start`` up to, not with, ``end``."""

    path: str
    channel: int
    start: int
    end: int


def _filesystem(path: str):
    return pa.fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def _batches(path: str) -> list[int]:
    """Numbers of the batches that are whole, in order, up to the first that is not."""
    fs, root = _filesystem(path)
    found = fs.get_file_info(pa.fs.FileSelector(root, allow_not_found=True))
    numbers = sorted(int(m.group(1)) for i in found if (m := re.fullmatch(r"batch=(\d+)", i.base_name)))
    whole = []
    for n in numbers:
        if fs.get_file_info(f"{root}/batch={n:020d}/_SUCCESS").type != pa.fs.FileType.File:
            break
        whole.append(n)
    return whole


def _slices(path: str, batches: list[int], most: int, channels: set[int] | None) -> list[Slice]:
    fs, root = _filesystem(path)
    out = []
    for n in batches:
        for info in fs.get_file_info(pa.fs.FileSelector(f"{root}/batch={n:020d}", recursive=True)):
            m = re.search(r"/channel=(-?\d+)/[^/_.][^/]*\.json$", info.path)
            if info.type == pa.fs.FileType.File and m and (channels is None or int(m.group(1)) in channels):
                out += [Slice(info.path, int(m.group(1)), at, min(at + most, info.size)) for at in range(0, info.size, most)]
    return out


def _lines(fs, part: Slice):
    """The slice's lines; a line belongs to the slice that holds its first byte."""
    with fs.open_input_file(part.path) as f:
        at = part.start
        if at:
            f.seek(at - 1)
            while (block := f.read(1 << 16)) and b"\n" not in block:
                at += len(block)
            if not block:
                return
            at += block.index(b"\n")
        f.seek(at)
        rest = b""
        while at < part.end and (block := f.read(1 << 20)):
            *whole, rest = (rest + block).split(b"\n")
            for line in whole:
                if at >= part.end:
                    return
                yield line
                at += len(line) + 1
        if rest and at < part.end:
            yield rest


def _number(value) -> int | None:
    return value if isinstance(value, int) and not isinstance(value, bool) else None


def _rows(path: str, part: Slice, above: int | None, since: int | None):
    """Record batches of a slice. A line that is no JSON object with a whole ``message_id`` is left out; other fields of a wrong type are null."""
    fs, _ = _filesystem(path)
    held: list[dict] = []
    for line in _lines(fs, part):
        try:
            post = json.loads(line)
        except ValueError:
            continue
        if not isinstance(post, dict) or (number := _number(post.get("message_id"))) is None:
            continue
        ts = _number(post.get("ts"))
        if (above is not None and number <= above) or (since is not None and (ts is None or ts < since)):
            continue
        text = post.get("text")
        held.append({"channel_id": part.channel, "message_id": number, "grouped_id": _number(post.get("grouped_id")), "ts": ts, "text": text if isinstance(text, str) else None})
        if len(held) == ROWS:
            yield pa.RecordBatch.from_pylist(held, schema=ARROW)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=ARROW)


class _Reader(DataSourceReader):
    def __init__(self, path: str, most: int, since: int | None) -> None:
        self.path, self.most, self.since, self.above, self.channels = path, most, since, None, None

    def pushFilters(self, filters):
        for f in filters:
            match f:
                case EqualTo(("channel_id",), value) if value is not None:
                    self.channels = {value} if self.channels is None else self.channels & {value}
                case In(("channel_id",), values):
                    self.channels = set(values) if self.channels is None else self.channels & set(values)
                case GreaterThan(("message_id",), value) if value is not None:
                    self.above = value if self.above is None else max(self.above, value)
                case GreaterThanOrEqual(("ts",), value) if value is not None:
                    self.since = value if self.since is None else max(self.since, value)
                case _:
                    yield f

    def partitions(self):
        # Spark reads one partition where there is none, and so gets an empty one
        return _slices(self.path, _batches(self.path), self.most, self.channels) or [Slice("", 0, 0, 0)]

    def read(self, partition):
        return _rows(self.path, partition, self.above, self.since) if partition.path else iter(())


class _StreamReader(DataSourceStreamReader):
    """Offsets are batch numbers, so they do not grow with channels or files."""

    def __init__(self, path: str, most: int, since: int | None) -> None:
        self.path, self.most, self.since = path, most, since

    def initialOffset(self):
        return {"batch": -1}

    def latestOffset(self):
        return {"batch": max(_batches(self.path), default=-1)}

    def partitions(self, start, end):
        return _slices(self.path, [n for n in _batches(self.path) if start["batch"] < n <= end["batch"]], self.most, None)

    def read(self, partition):
        return _rows(self.path, partition, None, self.since)


class PostsSource(DataSource):
    """Options: ``path``; ``since``, the earliest second; ``maxBytes`` of a slice, 64 MiB by default."""

    @classmethod
    def name(cls):
        return NAME

    def schema(self):
        return SCHEMA

    def _arguments(self):
        since = self.options.get("since")
        return self.options["path"], int(self.options.get("maxBytes", 64 << 20)), None if since is None else int(since)

    def reader(self, schema):
        return _Reader(*self._arguments())

    def streamReader(self, schema):
        return _StreamReader(*self._arguments())


def register(spark: SparkSession) -> None:
    """Make the source known to the session, with filters pushed into it."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PostsSource)


def read(spark: SparkSession, path: str, **options: str) -> DataFrame:
    register(spark)
    return spark.read.format(NAME).options(path=path, **options).load()


def read_stream(spark: SparkSession, path: str, **options: str) -> DataFrame:
    register(spark)
    return spark.readStream.format(NAME).options(path=path, **options).load()


def append(posts: DataFrame, path: str, batch: int) -> None:
    """Write ``posts`` (``SCHEMA``) as the batch of that number; a batch that was broken off is written anew, a whole one stays."""
    if batch not in _batches(path):
        posts.withColumn("channel", F.col("channel_id")).drop("channel_id").write.partitionBy("channel").mode("overwrite").json(f"{path}/batch={batch:020d}")


def resumed(posts: DataFrame, marks: DataFrame) -> DataFrame:
    """``posts`` behind their channel's mark (channel_id, last_message_id; none or null: 0, so all of its posts)."""
    known = marks.groupBy("channel_id").agg(F.max("last_message_id").alias("_mark"))
    return posts.join(known, "channel_id", "left").where(F.col("message_id") > F.coalesce("_mark", F.lit(0))).drop("_mark")


def marks_after(posts: DataFrame, marks: DataFrame) -> DataFrame:
    """(channel_id, last_message_id) after ``posts`` were taken: marks only rise."""
    seen = posts.groupBy("channel_id").agg(F.max("message_id").alias("last_message_id"))
    return marks.select("channel_id", "last_message_id").unionByName(seen).groupBy("channel_id").agg(F.max("last_message_id").alias("last_message_id"))
