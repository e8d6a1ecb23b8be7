"""Tables in versions: a commit names the next version or fails, merges rewrite the buckets that they touch, old versions stay readable.

A version is a small JSON file that lists folders of Parquet files. Its name is claimed by a hard link, which exists or
does not, so of two writers of one version exactly one succeeds; the folder must be one that all machines mount.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Conflict(Exception):
    """Another writer has committed the version."""


def _local(root: str) -> str:
    return root[len("file:") :].replace("///", "/", 1) if root.startswith("file:") else root


def _claim(path: str, content: dict) -> bool:
    """Put ``content`` at ``path``, whole or not at all; False if something is there."""
    os.makedirs(os.path.dirname(path), exist_ok=True)
    own = f"{path}.{uuid.uuid4().hex}"
    with open(own, "x") as f:
        json.dump(content, f)
        f.flush()
        os.fsync(f.fileno())
    try:
        os.link(own, path)
        return True
    except FileExistsError:
        return False
    finally:
        os.unlink(own)


def newest(root: str) -> int:
    """The last committed version, 0 where there is none."""
    folder = os.path.join(_local(root), "_versions")
    names = os.listdir(folder) if os.path.isdir(folder) else []
    return max((int(n[:-5]) for n in names if n[:-5].isdigit() and n.endswith(".json")), default=0)


def manifest(root: str, version: int | None = None) -> dict:
    version = newest(root) if version is None else version
    if not version:
        return {}
    with open(os.path.join(_local(root), "_versions", f"{version:020d}.json")) as f:
        return json.load(f)


def commit(root: str, version: int, content: dict) -> int:
    """Make ``content`` the given version; raises ``Conflict`` if it is taken."""
    if not _claim(os.path.join(_local(root), "_versions", f"{version:020d}.json"), content):
        raise Conflict(f"version {version} of {root}")
    return version


def _bucket(keys: list[str], n: int):
    return F.pmod(F.xxhash64(*keys), F.lit(n)).cast("int")


def _write(rows: DataFrame, root: str, keys: list[str], n: int) -> str:
    folder = f"data-{uuid.uuid4().hex}"
    rows.withColumn("_bucket", _bucket(keys, n)).write.partitionBy("_bucket").parquet(f"{root}/{folder}")
    return folder


def replace(rows: DataFrame, root: str, keys: list[str], buckets: int = 64, seen: int | None = None) -> int:
    """Commit ``rows`` as the whole table behind version ``seen`` (by default the newest as the writing begins)."""
    seen = newest(root) if seen is None else seen
    folder = _write(rows, root, keys, buckets)
    present = _present(root, folder)
    return commit(root, seen + 1, {"keys": keys, "buckets": buckets, "schema": rows.schema.json(), "folders": {str(b): folder for b in present}})


def _present(root: str, folder: str) -> list[int]:
    return [int(n.split("=")[1]) for n in os.listdir(os.path.join(_local(root), folder)) if n.startswith("_bucket=")]


def read(spark: SparkSession, root: str, version: int | None = None, only: list[int] | None = None) -> DataFrame:
    """The table at a version, by default the newest; ``only`` reads these buckets."""
    from pyspark.sql.types import StructType

    known = manifest(root, version)
    if not known:
        raise ValueError(f"no version of {root}")
    schema = StructType.fromJson(json.loads(known["schema"]))
    paths = [f"{root}/{folder}/_bucket={b}" for b, folder in known["folders"].items() if only is None or int(b) in only]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def merge(batch: DataFrame, root: str, merged: Callable[[DataFrame, DataFrame], DataFrame], tries: int = 5) -> int:
    """Commit ``merged(old, batch)`` of the buckets that ``batch`` touches; the others keep their files.

    ``merged`` must work key by key. After a conflict it is done again on the newer version, so no other writer's rows are lost.
    ``batch`` is read twice; an empty one commits nothing.
    """
    spark = batch.sparkSession
    for _ in range(tries):
        seen = newest(root)
        known = manifest(root, seen)
        touched = [r[0] for r in batch.select(_bucket(known["keys"], known["buckets"])).distinct().collect()]  # at most the number of buckets
        if not touched:
            return seen
        old = read(spark, root, seen, touched)
        folder = _write(merged(old, batch).select(*old.columns), root, known["keys"], known["buckets"])
        folders = {b: f for b, f in known["folders"].items() if int(b) not in touched} | {str(b): folder for b in _present(root, folder)}
        try:
            return commit(root, seen + 1, {**known, "folders": folders})
        except Conflict:
            continue
    raise Conflict(f"{tries} tries of {root}")


def refresh(root: str, build: Callable[[], DataFrame], keys: list[str], buckets: int = 64, patience: float = 3600.0) -> int | None:
    """Rebuild a table, unless another refresh of the same version is under way; then None.

    A refresh that has been silent for ``patience`` seconds is taken for dead, and its turn is given to the next; should it live
    after all, the commit lets only one of the two through.
    """
    seen = newest(root)
    for turn in range(1000):
        lock = os.path.join(_local(root), "_refresh", f"{seen:020d}-{turn:03d}.json")
        if _claim(lock, {"since": time.time()}):
            break
        with open(lock) as f:
            if time.time() - json.load(f)["since"] < patience:
                return None
    else:
        return None
    try:
        return replace(build(), root, keys, buckets, seen)
    except Conflict:
        return None
    except Exception:
        os.unlink(lock)
        raise


def vacuum(root: str, keep: int = 2, age: float = 86400.0) -> list[str]:
    """Names of data folders that none of the newest ``keep`` versions reads, for a caller to remove.

    Folders that are younger than ``age`` seconds may belong to writes under way, and are not named.
    """
    last, top = newest(root), _local(root)
    used = {f for v in range(max(1, last - keep + 1), last + 1) for f in manifest(root, v)["folders"].values()}
    old = lambda n: os.path.getmtime(os.path.join(top, n)) <= time.time() - age
    return sorted(n for n in os.listdir(top) if n.startswith("data-") and n not in used and old(n))
