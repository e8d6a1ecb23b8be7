"""Posts as a source, tables in versions and the object store: resumed reads, commits, conflicts and what a lost attempt leaves."""

from __future__ import annotations

import json
import threading
import time

import pytest
from pyspark.sql import functions as F

from stallwise.sources import history, objects, versions


def _posts(spark, rows):
    return spark.createDataFrame(rows, history.SCHEMA)


def _ids(df):
    return sorted((r["channel_id"], r["message_id"]) for r in df.collect())


def _some(lo, hi, channels=(1, -7)):
    return [(c, i, None, i * 10, f"text {i} ዋጋ\nline") for c in channels for i in range(lo, hi)]


def test_slices_hold_each_line_once(spark, tmp_path):
    path = str(tmp_path)
    rows = _some(1, 9) + [(2, 1, 5, None, None), (2, 2, 5, 3, ""), (2, 3, None, 4, "x" * 300)]
    history.append(_posts(spark, rows).coalesce(1), path, 0)
    for size in ("19", "57", "211", "10000000"):
        got = history.read(spark, path, maxBytes=size).collect()
        assert sorted(map(tuple, got), key=repr) == sorted(rows, key=repr)


def test_filters_reach_the_source(spark, tmp_path):
    path = str(tmp_path)
    history.append(_posts(spark, _some(1, 50)), path, 0)
    read = history.read(spark, path)
    assert _ids(read.where("channel_id = -7 and message_id > 40 and text like '%4%'")) == [(-7, i) for i in range(41, 50)]
    assert _ids(read.where("channel_id in (1, 99) and ts >= 450")) == [(1, i) for i in range(45, 50)]
    assert _ids(read.where("channel_id = 1 and channel_id = -7")) == [] and _ids(history.read(spark, path, since="480")) == [(-7, 48), (-7, 49), (1, 48), (1, 49)]
    reader = history._Reader(path, 1 << 20, None)
    left = list(reader.pushFilters([history.EqualTo(("channel_id",), 1), history.GreaterThan(("ts",), 3)]))
    assert left == [history.GreaterThan(("ts",), 3)] and {s.channel for s in reader.partitions()} == {1}


def test_damaged_lines_and_folders(spark, tmp_path):
    assert history.read(spark, str(tmp_path / "none")).count() == 0
    history.append(_posts(spark, _some(1, 3, (1,))), str(tmp_path), 0)
    (tmp_path / f"batch={0:020d}" / "channel=1" / "extra.json").write_text('{"message_id": 9}\nnot json\n[1]\n{"message_id": "4"}\n\n{"message_id": 8, "ts": "x", "text": 3, "other": 1}')
    assert _ids(history.read(spark, str(tmp_path))) == [(1, 1), (1, 2), (1, 8), (1, 9)]
    broken = tmp_path / f"batch={1:020d}" / "channel=1"
    broken.mkdir(parents=True)
    (broken / "part.json").write_text('{"message_id": 77}')
    assert (1, 77) not in _ids(history.read(spark, str(tmp_path)))
    history.append(_posts(spark, _some(20, 22, (1,))), str(tmp_path), 1)
    assert _ids(history.read(spark, str(tmp_path)))[-2:] == [(1, 20), (1, 21)]


def test_resumed_reads_have_no_gap_and_no_duplicate(spark, tmp_path):
    path, marks, taken = str(tmp_path), spark.createDataFrame([(1, 4), (5, None)], "channel_id long, last_message_id long"), []
    for batch, (lo, hi) in enumerate([(1, 9), (9, 20), (20, 21)]):
        history.append(_posts(spark, _some(lo, hi, (1, 5, 6))), path, batch)
        fresh = history.resumed(history.read(spark, path), marks)
        taken += _ids(fresh)
        rows = history.marks_after(fresh, marks).collect()
        marks = spark.createDataFrame(rows, "channel_id long, last_message_id long")
    assert sorted(taken) == sorted([(1, i) for i in range(5, 21)] + [(c, i) for c in (5, 6) for i in range(1, 21)])


def test_stream_goes_on_behind_its_checkpoint(spark, tmp_path):
    path = str(tmp_path / "posts")
    for batch in range(3):
        history.append(_posts(spark, _some(batch * 5 + 1, batch * 5 + 6)), path, batch)
        history.append(_posts(spark, _some(900, 901)), path, batch)  # the batch is whole and stays as it is
        out = history.read_stream(spark, path).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(str(tmp_path / "out"))
        assert out.awaitTermination(60)
    assert _ids(spark.read.parquet(str(tmp_path / "out"))) == [(c, i) for c in (-7, 1) for i in range(1, 16)]


def _upsert(old, batch):
    return old.join(batch, "k", "left_anti").unionByName(batch)


def test_merges_rewrite_touched_buckets_only(spark, tmp_path):
    root = str(tmp_path / "t")
    frame = lambda pairs: spark.createDataFrame(pairs, "k long, v string")
    assert versions.replace(frame([(i, "a") for i in range(500)]), root, ["k"], 32) == 1
    assert versions.merge(frame([(3, "b"), (1000, "c")]), root, _upsert) == 2
    before, after = versions.manifest(root, 1)["folders"], versions.manifest(root, 2)["folders"]
    assert len(before) == 32 and sum(before[b] != after[b] for b in before) <= 2
    want = {i: "a" for i in range(500)} | {3: "b", 1000: "c"}
    assert {r["k"]: r["v"] for r in versions.read(spark, root).collect()} == want and versions.read(spark, root).count() == 501
    assert versions.read(spark, root, 1).where("v = 'a'").count() == 500
    assert versions.merge(frame([]), root, _upsert) == 2
    assert versions.vacuum(root, 1, 0) == [] and versions.replace(frame([]), root, ["k"]) == 3 and versions.read(spark, root).count() == 0
    assert versions.vacuum(root, 2, 0) == [f for f in sorted(p.name for p in (tmp_path / "t").glob("data-*")) if f not in {*before.values(), *after.values()}]
    assert set(before.values()) < set(versions.vacuum(root, 1, 0)) and versions.vacuum(root, 1) == []
    with pytest.raises(ValueError):
        versions.read(spark, str(tmp_path / "none"))


def test_a_merge_that_loses_is_done_again(spark, tmp_path):
    root = str(tmp_path / "t")
    frame = lambda pairs: spark.createDataFrame(pairs, "k long, v string")
    versions.replace(frame([(1, "a"), (2, "a")]), root, ["k"], 1)
    calls = []

    def slow(old, batch):
        if not calls:
            calls.append(versions.merge(frame([(2, "other")]), root, _upsert))
        return _upsert(old, batch)

    assert versions.merge(frame([(1, "mine")]), root, slow) == 3
    assert {r["k"]: r["v"] for r in versions.read(spark, root).collect()} == {1: "mine", 2: "other"}
    with pytest.raises(versions.Conflict):
        versions.commit(root, 3, {})


def test_of_two_refreshes_one_builds(spark, tmp_path):
    root, began, go, out = str(tmp_path / "t"), threading.Event(), threading.Event(), []

    def build():
        began.set()
        go.wait(30)
        return spark.createDataFrame([(1, "x")], "k long, v string")

    first = threading.Thread(target=lambda: out.append(versions.refresh(root, build, ["k"], 4)))
    first.start()
    began.wait(30)
    assert versions.refresh(root, lambda: pytest.fail("built twice"), ["k"], 4) is None
    go.set()
    first.join(60)
    assert out == [1] and versions.newest(root) == 1
    # a dead refresh gives its turn away after a while, a failed one at once
    (tmp_path / "t" / "_refresh" / f"{1:020d}-000.json").write_text(json.dumps({"since": time.time() - 100}))
    assert versions.refresh(root, build, ["k"], 4) is None and versions.refresh(root, build, ["k"], 4, patience=50) == 2
    with pytest.raises(ZeroDivisionError):
        versions.refresh(root, lambda: 1 // 0, ["k"], 4)
    assert versions.refresh(root, build, ["k"], 4) == 3


def test_objects_are_stored_once_and_read_back(spark, tmp_path):
    root = str(tmp_path / "o")
    frame = lambda pairs: spark.createDataFrame(pairs, "key string, content binary")
    first = [(f"k{i}", bytes([i % 5]) * 100) for i in range(40)] + [(None, b"x"), ("none", None), ("empty", b"")]
    assert objects.put(frame(first).repartition(6), root) == 1
    assert objects._packs(spark, root).where("content is not null").count() == 6
    assert objects.put(frame([("k0", b"new"), ("k1", bytes([3]) * 100)]), root) == 2
    assert objects._packs(spark, root).where("content is not null").count() == 7
    want = {k: c for k, c in first if k and c is not None} | {"k0": b"new", "k1": bytes([3]) * 100}
    keys = spark.createDataFrame([(k,) for k in [*want, "absent", "k0"]], "key string")
    assert {r["key"]: bytes(r["content"]) for r in objects.get(keys, root).collect()} == want
    assert {r["key"]: bytes(r["content"]) for r in objects.get(keys.where("key = 'k0'"), root, 1).collect()} == {"k0": bytes(100)}
    assert {r["key"] for r in objects.exists(keys, root).collect() if not r["found"]} == {"absent"}


def test_a_failed_write_shows_nothing(spark, tmp_path):
    root = str(tmp_path / "o")
    objects.put(spark.createDataFrame([("a", b"1")], "key string, content binary"), root)
    bad = spark.range(40, numPartitions=4).select(F.col("id").cast("string").alias("key"), F.when(F.col("id") == 39, F.raise_error(F.lit("lost")).cast("binary")).otherwise(F.encode(F.col("id").cast("string"), "utf-8")).alias("content"))
    with pytest.raises(Exception, match="lost"):
        objects.put(bad, root)
    assert versions.newest(root) == 1 and [r["key"] for r in objects.listing(spark, root).collect()] == ["a"]
    writer = objects._Writer(root, 0)
    with pytest.raises(versions.Conflict):
        writer.commit([objects._Packed("packs/x.parquet", 1)])


def test_objects_are_written_without_python(spark, tmp_path):
    root = str(tmp_path / "o")
    frame = spark.createDataFrame([("a", b"1")], "key string, content binary")
    assert objects.put(frame.limit(0), root) == 0 and objects.put(frame, root) == 1 and objects.put(frame.limit(0), root) == 1
    assert not hasattr(objects, "DataSourceArrowWriter") and all(p.startswith("packs/") for p in versions.manifest(root, 1)["packs"])
