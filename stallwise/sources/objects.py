"""An object store of packs: put, get and exists for whole tables of keys, bytes stored once, commits that show all of a write or nothing.

A write's tasks make Parquet packs in a folder of that write. The driver's commit lists the packs of the attempts that
succeeded as the next version; a write that fails is never listed, so nobody reads its packs.
"""

from __future__ import annotations

import os
import uuid

import pyarrow.parquet
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stallwise.sources import versions

#: ``content`` is null where the bytes lie in another row; ``put`` is a number that rises with every write.
SCHEMA = "key string, sha256 string, size long, put long, content binary"


class _Packed:
    """A pack, by its path below the store, and its rows."""

    def __init__(self, pack: str, rows: int) -> None:
        self.pack, self.rows = pack, rows


class _Writer:
    """A write of one job, which comes after version ``seen``."""

    def __init__(self, path: str, seen: int) -> None:
        self.path, self.seen, self.job = path, seen, uuid.uuid4().hex

    def write(self, rows: DataFrame) -> list[_Packed]:
        """The packs of the tasks' attempts that succeeded, by Spark's own writer, so rows do not pass through Python."""
        folder = f"packs/{self.job}"
        rows.write.parquet(f"{self.path}/{folder}")
        top = os.path.join(versions._local(self.path), folder)
        packs = sorted(n for n in os.listdir(top) if n.endswith(".parquet"))
        return [_Packed(f"{folder}/{n}", pyarrow.parquet.read_metadata(os.path.join(top, n)).num_rows) for n in packs]

    def commit(self, messages: list[_Packed]) -> None:
        packs = [m.pack for m in messages if m.rows]
        if packs:
            # a version lists its own packs only, so commits stay as small as their writes
            versions.commit(self.path, self.seen + 1, {"packs": packs})


def _packs(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    last = versions.newest(path) if version is None else version
    files = [f"{path}/{p}" for v in range(1, last + 1) for p in versions.manifest(path, v)["packs"]]
    return spark.read.schema(SCHEMA).parquet(*files) if files else spark.createDataFrame([], SCHEMA)


def put(objects: DataFrame, path: str) -> int:
    """Store (key, content) rows and give the version. Bytes that are stored already, or come twice, are stored once.

    Rows with a null key or null content are left out; of several contents of one key in a write the one of the greatest hash stays.
    Raises ``versions.Conflict`` if another write was committed meanwhile; then nothing of this one is to be seen.
    """
    spark = objects.sparkSession
    seen = versions.newest(path)
    rows = objects.where("key is not null and content is not null").select("key", F.sha2("content", 256).alias("sha256"), F.octet_length("content").cast("long").alias("size"), "content")
    names = rows.groupBy("key").agg(F.max(F.struct("sha256", "size")).alias("n")).select("key", "n.*")
    stored = _packs(spark, path, seen).where("content is not null").select("sha256")
    # bytes need one of their keys only, so each key's chosen hash brings them along
    fresh = rows.join(names.select("key", "sha256"), ["key", "sha256"], "left_semi").join(stored, "sha256", "left_anti").groupBy("sha256", "size").agg(F.first("content").alias("content"))
    out = names.select("key", "sha256", "size", F.lit(seen + 1).cast("long").alias("put"), F.lit(None).cast("binary").alias("content"))
    bytes_ = fresh.select(F.lit(None).cast("string").alias("key"), "sha256", "size", F.lit(seen + 1).cast("long").alias("put"), "content")
    writer = _Writer(path, seen)
    writer.commit(writer.write(out.unionByName(bytes_)))
    return versions.newest(path)


def listing(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """(key, sha256, size) of all objects at a version: a key's last put counts."""
    named = _packs(spark, path, version).where("key is not null")
    return named.groupBy("key").agg(F.max_by(F.struct("sha256", "size"), "put").alias("n")).select("key", "n.*")


def get(keys: DataFrame, path: str, version: int | None = None) -> DataFrame:
    """(key, sha256, content) of those of the ``keys`` that are stored."""
    spark = keys.sparkSession
    held = _packs(spark, path, version).where("content is not null").select("sha256", "content")
    return keys.select("key").distinct().join(listing(spark, path, version), "key").join(held, "sha256").select("key", "sha256", "content")


def exists(keys: DataFrame, path: str, version: int | None = None) -> DataFrame:
    """(key, found) of the distinct ``keys``."""
    known = listing(keys.sparkSession, path, version).select("key", F.lit(True).alias("found"))
    return keys.select("key").distinct().join(known, "key", "left").select("key", F.coalesce("found", F.lit(False)).alias("found"))
