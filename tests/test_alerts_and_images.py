"""Interval alerts, image hashes and keyword tables against plain forms."""

from __future__ import annotations

import math
import random
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from stallwise.functions import imagehash
from stallwise.operators import phrases
from stallwise.streaming import alerts

SEARCH = "id long, category string, area string, min_price int, max_price int, last_alert_at int, alerts_on boolean"
LISTING = "id long, category_slug string, location_area string, price_etb int, posted_at int, status string"


@pytest.mark.parametrize("seed", [1, 2])
def test_alerts_equal_the_loop(spark, seed):
    rnd = random.Random(seed)
    pick = lambda *xs: rnd.choice(xs)
    edge = lambda: pick(None, 0, 1, 3, 4, 15, 16, 17, 63, 64, 1000, 149_999, 150_000, rnd.randrange(200_000), rnd.randrange(200), -5, 2**31 - 1)
    searches = [(i, pick(None, "a", "b", ""), pick(None, "x", "y"), edge(), edge(), pick(None, 3, 7), rnd.random() < 0.8) for i in range(300)]
    listings = [(i, pick(None, "a", "b", ""), pick(None, "x", "y"), edge(), rnd.randrange(10), pick("live", "live", "queued")) for i in range(300)]

    def meets(s, x):
        _, cat, area, low, high, last, on = s
        price = x[3]
        return (
            on and x[5] == "live" and (cat is None or cat == x[1]) and (area is None or area == x[2]) and (low is None or (price is not None and price >= low))
            and (high is None or high >= 150_000 or (price is not None and price <= high)) and (last is None or x[4] > last)
        )

    want = sorted((s[0], x[0]) for s in searches for x in listings if meets(s, x))
    out = alerts.alerts(spark.createDataFrame(listings, LISTING), spark.createDataFrame(searches, SEARCH))
    assert sorted(map(tuple, out.collect())) == want and len(want) > 500
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_alerts_without_searches(spark):
    some = spark.createDataFrame([(1, "a", "x", 5, 1, "live")], LISTING)
    assert alerts.alerts(some, spark.createDataFrame([], SEARCH)).collect() == []
    assert alerts.alerts(some, spark.createDataFrame([(1, None, None, None, None, None, False)], SEARCH)).columns == ["search_id", "listing_id"]


def _loops(pixels):
    """The hash of rows of grey pixels by loops over the filter's definition."""

    def shrink(line, out):
        n, scale = len(line), len(line) / out
        wide = max(scale, 1.0)
        done = []
        for o in range(out):
            mid = (o + 0.5) * scale
            lo, hi = max(0, int(mid - 3 * wide + 0.5)), min(n, int(mid + 3 * wide + 0.5))
            sinc = lambda x: 1.0 if x == 0 else math.sin(math.pi * x) / (math.pi * x)
            ws = [sinc(x) * sinc(x / 3) if abs(x) < 3 else 0.0 for x in ((i + 0.5 - mid) / wide for i in range(lo, hi))]
            total = sum(w / sum(ws) * line[lo + k] for k, w in enumerate(ws))
            done.append(min(255, max(0, math.floor(total + 0.5))))
        return done

    rows = [shrink(r, 9) for r in pixels]
    columns = [shrink([r[x] for r in rows], 8) for x in range(9)]
    bits = [columns[x][y] > columns[x + 1][y] for y in range(8) for x in range(8)]
    return f"{int(''.join('01'[b] for b in bits), 2):016x}"


def _png(pixels, filters, colour=0, planes=1):
    """Rows of samples as a PNG, with the given filter for each row in turn."""
    out, above = b"", [0] * len(pixels[0])
    for y, row in enumerate(pixels):
        kind, line = filters[y % len(filters)], []
        for i, v in enumerate(row):
            a, b, c = (row[i - planes] if i >= planes else 0), above[i], (above[i - planes] if i >= planes else 0)
            p = a + b - c
            near = a if abs(p - a) <= abs(p - b) and abs(p - a) <= abs(p - c) else b if abs(p - b) <= abs(p - c) else c
            line.append((v - [0, a, b, (a + b) // 2, near][kind]) & 255)
        out, above = out + bytes([kind, *line]), row
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    packed = zlib.compress(out)
    head = struct.pack(">IIBBBBB", len(pixels[0]) // planes, len(pixels), 8, colour, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", packed[:20]) + chunk(b"IDAT", packed[20:]) + chunk(b"IEND", b"")


@pytest.mark.parametrize("size", [(9, 8), (40, 23), (1, 1), (3, 200), (101, 7)])
def test_hashes_equal_the_loops(size):
    rnd = random.Random(5)
    w, h = size
    pixels = [[min(255, max(0, x * 255 // w + rnd.randrange(-60, 60))) for x in range(w)] for _ in range(h)]
    want = _loops(pixels)
    assert imagehash.hash_of(b"P5\n# made\n%d %d\n255\n" % size + bytes(v for r in pixels for v in r)) == want
    assert imagehash.hash_of(_png(pixels, [0, 1, 2, 3, 4])) == want
    alpha = [[v for p in r for v in (p, 7)] for r in pixels]
    assert imagehash.hash_of(_png(alpha, [4, 3, 1], colour=4, planes=2)) == want
    grey = [[v for p in r for v in (p, p, p)] for r in pixels]
    assert imagehash.hash_of(_png(grey, [4, 1], colour=2, planes=3)) == want == imagehash.hash_of(b"P6 %d %d 255\n" % size + bytes(v for r in grey for v in r))


def test_damaged_images_are_null_and_copies_stay_near(spark):
    rnd = random.Random(8)
    pixels = [[(x * 5 + y * 3) % 200 + rnd.randrange(20) for x in range(64)] for y in range(48)]
    whole = _png(pixels, [4])
    lighter = _png([[min(255, v + 20) for v in r] for r in pixels], [1])
    broken = [None, b"", b"P5", b"P5 3 3 255\n12", b"P5 0 9 255\n", whole[:-30], whole[:60] + b"?" + whole[61:], b"P5 1 1 70000\nx", b"\xff\xd8\xff\xe0 no jpeg"]
    rows = [(i, bytearray(b) if b is not None else None) for i, b in enumerate([whole, lighter, *broken])]
    got = [r["h"] for r in spark.createDataFrame(rows, "id int, b binary").select("id", imagehash.image_hash_of_bytes(F.col("b")).alias("h")).orderBy("id").collect()]
    assert got[2:] == [None] * len(broken) and bin(int(got[0], 16) ^ int(got[1], 16)).count("1") <= 6


def test_hashes_of_all_texts_as_images(spark, sf_dir):
    from stallwise.plans import registry, registry_sources  # noqa: F401

    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    got = {r["id"]: r["phash"] for r in registry.QUERIES["v04_hash_of_bytes"](spark, sf_dir).collect()}
    assert got.keys() == texts.keys()
    for key in sorted(texts)[:40]:
        data = (texts[key] or "").encode()
        rows = [list(data[i : i + 32].ljust(32, b"\0")) for i in range(0, len(data), 32)]
        assert got[key] == (_loops(rows) if rows else None)


def test_labels_of_a_dictionary_table(spark):
    words = [("c", "tv", "audio", 1), ("c", "sofa", "home", 2), ("c", "sofa bed", "sleep", 3), ("c", "tvs", "x", 9), ("c", "tvz", "y", 8), ("a", "bole", "bole", 0), ("a", "ቦሌ", "bole", 0), ("a", "piassa", "piassa", 0)]
    texts = ["tv on a sofa", "sofa bed bole", "tvs tvz ቦሌ bole", "bole and piassa", "", None, "xx", "so"]
    got = phrases.labels(spark.createDataFrame(list(enumerate(texts)), "id int, text string"), spark.createDataFrame(words, "kind string, phrase string, label string, rank int"), ["id"], unclear=("a",))
    assert {(r["id"], r["kind"]): r["label"] for r in got.collect()} == {(0, "c"): "home", (1, "c"): "sleep", (1, "a"): "bole", (2, "c"): "y", (2, "a"): "bole"}
    assert phrases.labels(spark.createDataFrame([(1, "a")], "id int, text string"), spark.createDataFrame([], "kind string, phrase string, label string, rank int"), ["id"]).collect() == []


def test_alerts_offer_a_listing_in_few_keys(spark):
    listings = [(i, "abc"[i % 3], "xy"[i % 2], None if i % 7 == 0 else i * 997 % 600_000, i % 10, "live") for i in range(200)]
    searches = [(i, "a" if i % 2 else None, "x" if i % 3 else None, i * 7 % 99_999 if i % 4 else None, i * 7 % 99_999 + i * 131 % 70_000 if i % 5 else None, None, True) for i in range(200)]
    offered, wants = alerts._sides(spark.createDataFrame(listings, LISTING), spark.createDataFrame(searches, SEARCH))
    assert offered.groupBy("listing_id").count().agg(F.max("count")).first()[0] <= 12
    assert wants.groupBy("search_id").count().agg(F.max("count")).first()[0] <= alerts.FAN + 2


def test_equal_texts_are_labelled_once(spark):
    texts = spark.createDataFrame([(i, "red box" if i % 2 else "old box") for i in range(40)], "id int, text string")
    words = spark.createDataFrame([("a", "red", "RED", 0), ("a", "box", "BOX", 1), ("b", "old", "OLD", 0)], "kind string, phrase string, label string, rank int")
    out = phrases.labels(texts, words, ["id"])
    assert sorted((r["id"], r["kind"], r["label"]) for r in out.collect()) == sorted([(i, "a", "RED" if i % 2 else "BOX") for i in range(40)] + [(i, "b", "OLD") for i in range(0, 40, 2)])
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [_text" in plan[plan.index("Generate") :]
