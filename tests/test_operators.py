"""Operators on small tables: rules by example, clustering and state against brute force, streams against batches."""

from __future__ import annotations

import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from stallwise.functions import similarity, text
from stallwise.operators import browse, dedup, merge, nlparse, price, ranking, search
from stallwise.sources import files
from stallwise.streaming import sessions


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "s string").select(column(F.col("s")).alias("x")).first()["x"]


@pytest.mark.parametrize("raw", ["0911223344", "+251911223344", "251911223344", "+251 911 22 33 44", "09 11 22 33 44", "0911-22-33-44"])
def test_phones_in_texts(spark, raw):
    assert [p["normalised"] for p in one(spark, text.phones, f"ስልክ {raw}, ok")] == ["+251911223344"]


def test_handles(spark):
    assert one(spark, text.handles, "Contact @addis_seller or check t.me/bole_market for details @my_shop") == ["@addis_seller", "@bole_market", "@my_shop"]


def _plain_handles(t):
    """Handles by walking over each ``@`` and each link, without patterns."""
    word = lambda c: c.isalnum() or c == "_"
    ascii_run = lambda s: len(s) - len(s.lstrip("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_"))
    found = set()
    for i, c in enumerate(t):
        n = ascii_run(t[i + 1 :])
        if c == "@" and not (i and word(t[i - 1])) and 4 <= n <= 32 and not (i + 1 + n < len(t) and word(t[i + 1 + n])):
            found.add("@" + t[i + 1 : i + 1 + n])
    low = t.lower()
    for head in ("t.me/", "telegram.me/"):
        for i in range(len(t)):
            if low.startswith(head, i):
                rest = t[i + len(head) :]
                if ascii_run(rest) >= 4:
                    found.add("@" + rest[: min(32, ascii_run(rest))])
    return ",".join(sorted(found))


def test_handles_of_all_messages_equal_a_plain_walk(spark, sf_dir):
    from stallwise.plans import registry, registry_more  # noqa: F401

    hard = ["mail jane@example.com or @jane_doe.", "see https://T.me/bole_market, telegram.me/abc t.me/abcd", "@ab @abcd @" + "x" * 33, "@abcdé ça@abcd", None, ""]
    made = spark.createDataFrame(list(enumerate(hard)), "id int, t string").select("id", F.array_join(text.handles(F.col("t")), ",").alias("h"))
    assert {r["id"]: r["h"] for r in made.collect()} == {i: _plain_handles(t or "") for i, t in enumerate(hard)}
    got = {r["id"]: r["handles"] for r in registry.QUERIES["x04_handles"](spark, sf_dir).collect()}
    texts = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    assert got == {r["doc_id"]: _plain_handles(r["text"] or "") for r in texts}


@pytest.mark.parametrize("partitions", [1, 7])
def test_numbers_and_maxima_across_ranges(spark, partitions):
    rng = random.Random(4)
    rows = [(i, rng.choice(["hot", "hot", "hot", "b", None]), rng.randint(0, 9), rng.choice([None, 1, 2, 3, 4, 5])) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, key string, t int, v int")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        numbers = {r["id"]: r["n"] for r in ranking.numbered(df, "key", [F.desc("t"), "id"], "n").collect()}
        highs = {r["id"]: r["m"] for r in ranking.running_max(df, "key", [F.desc("t"), "id"], "v", "m").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    for key in ("hot", "b", None):
        high = None
        for n, (i, _, _, v) in enumerate(sorted((r for r in rows if r[1] == key), key=lambda r: (-r[2], r[0])), 1):
            high = v if high is None or v is not None and v > high else high
            assert (numbers[i], highs[i]) == (n, high)
    assert len(numbers) == len(highs) == len(rows)
    empty = df.where("id < 0")
    assert ranking.numbered(empty, "key", ["t", "id"], "n").count() == ranking.running_max(empty, "key", ["t", "id"], "v", "m").count() == 0


def test_first_pass(spark):
    got = one(spark, text.first_pass, "iPhone 13 ዋጋ 45,000 ብር ድርድር 0911223344")
    assert (got["price_etb"], got["negotiable"], got["phone_normalized"], got["is_potential_listing"]) == (45_000, True, "+251911223344", True)
    assert not one(spark, text.first_pass, "join our channel price 5000 birr")["is_potential_listing"]
    assert not one(spark, text.first_pass, None)["is_potential_listing"]


def test_masked_texts_leak_nothing(spark):
    posts = files.corpus(spark, 300).withColumn("m", text.mask(F.concat("text", F.lit(" @seller_x t.me/seller_y 09 11 22 33 44")))["masked"])
    assert posts.where(text.leaks(F.col("m"))).count() == 0
    assert files.corpus(spark, 300).where(text.price(F.col("text"))["etb"] == F.col("price_etb")).count() == 300


def test_upsert_twice_is_once(spark):
    old = spark.createDataFrame([(1, "a", 5), (2, None, 7)], "k int, v string, n int")
    new = spark.createDataFrame([(2, "b", 3), (3, "c", 9)], "k int, v string, n int")
    rules = {"v": merge.newer_if_set, "n": merge.lesser}
    first = merge.upsert(old, new, ["k"], rules)
    assert sorted(map(tuple, first.collect())) == [(1, "a", 5), (2, "b", 3), (3, "c", 9)]
    assert sorted(map(tuple, merge.upsert(first, new, ["k"], rules).collect())) == sorted(map(tuple, first.collect()))


def test_keyset_pages_make_the_whole(spark):
    rows = [(i, random.Random(i).randint(1, 20)) for i in range(100)]
    df = spark.createDataFrame(rows, "id long, price_etb int")
    seen, after = [], None
    while True:
        page = [tuple(r) for r in browse.keyset_page(df, "price_asc", after=after, size=13).collect()]
        seen += page[:13]
        if len(page) < 14:
            break
        after = (page[12][1], page[12][0])
    assert seen == sorted(rows, key=lambda r: (r[1], r[0]))
    assert browse.decode_cursor(browse.encode_cursor(5, 7)) == (5, 7) and browse.decode_cursor("!") is None


def test_query_parameters():
    q = browse.parse_query({"minPrice": "100", "maxPrice": "x", "condition": "fair,bad", "sort": "nope", "q": " a "})
    assert (q.min_price, q.max_price, q.conditions, q.sort, q.q) == (100, None, ("fair",), "newest", "a")


def _item(spark, **kw):
    base = {"category_slug": None, "title": "iphone 13", "phone": None, "price_etb": None, "phash": None, "embedding": [1.0, 0.0]}
    return {**base, **kw}


@pytest.mark.parametrize(
    ("a", "b", "want"),
    [
        ({"phone": "1", "price_etb": 90000}, {"phone": "1", "price_etb": 85000}, "auto_merge"),
        ({"phone": "1", "price_etb": 90000, "embedding": [1.0, 0.0]}, {"phone": "1", "price_etb": 60000, "embedding": [0.0, 1.0]}, "borderline"),
        ({"phone": "1", "category_slug": "a"}, {"phone": "1", "category_slug": "b"}, "distinct"),
        ({"phone": "1"}, {"phone": "1", "title": "iphone 14"}, "distinct"),
        ({"phone": "1", "phash": "f" * 16}, {"phone": "2", "phash": "f" * 16}, "distinct"),
        ({"phash": "f" * 16}, {"phash": "f" * 15 + "e"}, "auto_merge"),
    ],
)
def test_decisions(spark, a, b, want):
    kind = "struct<category_slug:string,title:string,phone:string,price_etb:int,phash:string,embedding:array<double>>"
    row = spark.createDataFrame([(_item(spark, **a), _item(spark, **b))], f"a {kind}, b {kind}")
    assert row.select(dedup.decision()["decision"].alias("d")).first()["d"] == want


def test_leaders_equal_the_sequential_pass(spark):
    rng = random.Random(7)
    items, edges, want = [], [], {}
    for g in range(12):
        n = rng.randint(2, 12)
        near = {(i, j) for i in range(n) for j in range(i) if rng.random() < 0.3}
        lead = []
        for i in range(n):
            hit = next((j for j in lead if (i, j) in near), None)
            want[100 * g + i] = 100 * g + (i if hit is None else hit)
            lead += [i] if hit is None else []
        items += [(100 * g + i, 100 * g + i) for i in range(n)]
        edges += [(100 * g + j, 100 * g + i) for i, j in near]
    frame = spark.createDataFrame(items, "id long, ord long")
    links = spark.createDataFrame(edges, "a long, b long").select(F.struct(F.col("a").alias("ord"), F.col("a").alias("id")).alias("ka"), F.struct(F.col("b").alias("ord"), F.col("b").alias("id")).alias("kb"))
    assert {r["id"]: r["leader_id"] for r in dedup.leaders(frame, links).collect()} == want


def test_leader_clusters_equal_the_sequential_pass_over_all_pairs(spark):
    rng = random.Random(11)
    hashes = [f"{rng.getrandbits(64):016x}" for _ in range(3)]
    hashes += [f"{int(hashes[0], 16) ^ 0b111:016x}", None, "bad"]
    rows = [
        (i, rng.randint(0, 40), rng.choice(["a", "a", "b", None, ""]), rng.choice(["iphone 13", "iphone 14", "sofa", None]), rng.choice(["1", "2", "", None]), rng.choice([None, 0, 100, 110, 400]), rng.choice(hashes), rng.choice([[1.0, 0.0], [0.9, 0.3], [0.0, 1.0]]))
        for i in range(160)
    ]
    rows += [(200 + i, 50, *rows[i % 3][2:]) for i in range(60)]
    items = spark.createDataFrame(rows, "id long, ord long, category_slug string, title string, phone string, price_etb int, phash string, embedding array<double>")
    side = lambda n: items.select(F.struct("ord", "id").alias(f"k{n}"), F.struct(*dedup.ITEM).alias(n))
    pairs = side("a").crossJoin(side("b")).where("ka < kb").where(dedup.decision()["decision"] == "auto_merge").select("ka.id", F.col("kb.id").alias("b")).collect()
    near, lead, want = {tuple(r) for r in pairs}, [], {}
    for i in (r[0] for r in sorted(rows, key=lambda r: (r[1], r[0]))):
        hit = next((j for j in lead if (j, i) in near), None)
        want[i] = i if hit is None else hit
        lead += [i] if hit is None else []
    links = dedup.merge_links(items)
    of = {r["b_id"]: r["a_id"] for r in links.where("decision is null").collect()}
    heads = {i: of.get(i, i) for i in want}
    firsts = {(r["a_id"], r["b_id"]) for r in links.where("decision is not null").collect()}
    assert firsts == {(a, b) for a, b in near if heads[a] == a and heads[b] == b} and of
    joined = lambda a, b: heads[a] == heads[b] or (heads[a], heads[b]) in firsts or (heads[b], heads[a]) in firsts
    assert all(((a, b) in near or (b, a) in near) == joined(a, b) for a in want for b in want if a < b)
    got = dedup.leader_clusters(items).collect()
    assert len(got) == len(rows) and {r["id"]: r["leader_id"] for r in got} == want and 1 < len(lead) < len(rows) / 2


def test_peeling_equals_all_pairs_on_a_hot_phone_and_on_no_rows(spark):
    rng = random.Random(3)
    rows = [(i, i // 3, rng.choice(["a", "b", "", None]), rng.choice(["iphone 13", "m1", "sofa"]), "1" if i % 5 else None, rng.choice([0, None, *range(100, 2000, 60)]) if i % 9 else 10**6 + i, f"{i % 4:016x}", [1.0, 0.0] if i % 2 else None) for i in range(90)]
    items = spark.createDataFrame(rows, "id long, ord long, category_slug string, title string, phone string, price_etb int, phash string, embedding array<double>")
    got = {r["id"]: r["leader_id"] for r in dedup.peeled(items).collect()}
    want = {r["id"]: r["leader_id"] for r in dedup.leaders(items.select("id", "ord"), dedup.merge_edges(items)).collect()}
    assert got == want and 1 < len(set(want.values())) < len(rows)
    assert dedup.peeled(items.limit(0)).collect() == []


def test_cluster_rows_and_images(spark):
    items = spark.createDataFrame(
        [(1, 5, "!!!", 300, "aa", 7, ["k1", None, "k2"]), (2, 6, "b", None, "bb", 8, ["k2", "", "k3"]), (3, 7, "c", 200, None, 7, None), (4, 8, "d", None, None, None, ["k4", "k5"])],
        "id long, ord long, title string, price_etb int, phash string, channel_id long, media_refs array<string>",
    )
    clusters = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (4, 4)], "id long, leader_id long")
    rows = {r["leader_id"]: r.asDict() for r in dedup.cluster_rows(items, clusters).collect()}
    assert rows[1] == {"leader_id": 1, "title_en": "!!!", "phash": "aa", "lowest_etb": 200, "n_channels": 2, "n_members": 3, "slug": "item-1"}
    assert (rows[4]["lowest_etb"], rows[4]["n_channels"], rows[4]["n_members"], rows[4]["slug"]) == (None, 1, 1, "d-4")
    derived = lambda k: hashlib.sha256(k.encode()).hexdigest()[:16]
    got = {(r["leader_id"], r["r2_key"]): (r["phash"], r["sort_order"]) for r in dedup.cluster_images(items, clusters).collect()}
    assert got == {(1, "k1"): ("aa", 0), (1, "k2"): (derived("k2"), 0), (1, "k3"): (derived("k3"), 2), (4, "k4"): (None, 0), (4, "k5"): (derived("k5"), 1)}
    assert dedup.cluster_images(items.limit(0), clusters).collect() == []


@pytest.mark.parametrize("name", ["v09_leader_clusters", "v10_canonical_rows", "a18_dedup_report"])
def test_clusters_take_every_sighting(spark, sf_dir, name):
    from stallwise.plans import market, registry, registry_more  # noqa: F401

    out = registry.QUERIES[name](spark, sf_dir)
    n = {"v09_leader_clusters": F.count("*"), "v10_canonical_rows": F.sum("n_members"), "a18_dedup_report": F.sum("evaluated")}[name]
    m = market.Market(spark, sf_dir)
    own = m.sightings if name == "a18_dedup_report" else m.sightings.join(m.listings.where("extraction_confidence >= 0.3 and title_en <> ''").select(F.col("id").alias("listing_id")), "listing_id", "left_semi")
    assert out.agg(n.alias("n")).first()["n"] == own.count() > 0


def test_every_live_place_is_known_among_many(spark):
    listings = spark.range(30_000).selectExpr("'live' as status", "concat('area ', id) as location_area")
    listings = listings.unionByName(spark.createDataFrame([("live", a) for a in list(browse.AREA_SPELLINGS)[3:]] + [("queued", a) for a in browse.AREA_SPELLINGS], "status string, location_area string"))
    sure = {r.value: r.sure for r in nlparse.places(listings).collect()}
    assert sure == {a: nlparse.UNSEEN_AREA if i < 3 else nlparse.KNOWN_AREA for i, a in enumerate(browse.AREA_SPELLINGS)}


def test_bands_share_one_at_six_flips(spark):
    rng = random.Random(3)
    rows = []
    for _ in range(200):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), 6):
            b ^= 1 << bit
        rows.append((f"{a:016x}", f"{b:016x}"))
    df = spark.createDataFrame(rows, "a string, b string")
    assert df.where(F.size(F.array_intersect(dedup.hash_bands(F.col("a")), dedup.hash_bands(F.col("b")))) == 0).count() == 0
    assert df.where(similarity.hamming(F.col("a"), F.col("b")) != 6).count() == 0


SYNONYMS = [
    ("laptop", "laptop", "computers"), ("laptop", "ላፕቶፕ", "computers"), ("dell", "ዴል", "computers"), ("phone", "ስልክ", "phones"), ("iphone", "iphone", "phones"), ("iphone", "አይፎን", "phones"), ("samsung", "samsung", "phones"),
    ("sofa", "sofa", "furniture"), ("sofa", "ሶፋ", "furniture"), ("sofa", "soffa", "furniture"), ("sofa", "couch", "furniture"), ("table", "ጠረጴዛ", "furniture"), ("tv", "ቴሌቪዥን", "tv-audio"), ("bag", "bag", "fashion"),
]


SENTENCES = [
        ("ላፕቶፕ under 20000", {"category": "computers", "max_price": 20000}), ("bag less than 3000 birr", {"category": "fashion", "max_price": 3000, "q": "bag"}),
        ("ስልክ ከ10000 በታች ቦሌ", {"category": "phones", "max_price": 10000, "area": "Bole"}), ("ሶፋ ቦሌ", {"category": "furniture", "area": "Bole", "q": "sofa"}), ("አዲስ አይፎን", {"category": "phones", "condition": "brand_new", "q": "iphone"}),
        ("የቤት እቃ ከ5ሺ በላይ", {"category": "furniture", "min_price": 5000}), ("ጠረጴዛ ከ2000 እስከ 8000", {"category": "furniture", "min_price": 2000, "max_price": 8000, "q": "table"}), ("ቴሌቪዥን መገናኛ", {"category": "tv-audio", "area": "Megenagna", "q": "tv"}),
        ("laptop 20k", {"category": "computers", "max_price": 20000}), ("ላፕቶፕ ዴል", {"category": "computers", "q": "dell"}), ("brand new samsung in bole", {"category": "phones", "area": "Bole", "condition": "brand_new", "q": "samsung"}),
        ("laptop 20000", {"category": "computers"}), ("iphone 13 under 30k bole", {"category": "phones", "area": "Bole", "max_price": 30000, "q": "iphone 13"}), ("", {}), ("x" * 300, {"q": "x" * 200}),
        ("sofa between 100 and 400", {"category": "furniture", "q": "sofa between 100 400"}), ("bag 2k-3k", {"category": "fashion", "min_price": 2000, "max_price": 3000, "q": "bag"}), ("bag 900 - 100", {"category": "fashion", "q": "bag 100"}),
        ("iphone13 no more than 1,500 etb", {"max_price": 1500, "q": "iphone13"}), ("bag more than 5000 under 900", {"category": "fashion", "min_price": 5000, "max_price": 900, "q": "bag"}), ("bag 128gb", {"category": "fashion", "q": "bag 128gb"}),
        ("bag in 22 over 4m", {"category": "fashion", "min_price": 4_000_000, "q": "bag"}), ("sofa table bag", {"q": "sofa bag table"}), (None, {}), ("bag ከ3000 birr በታች 9000", {"category": "fashion", "max_price": 3000, "q": "bag 9000"}), ("cheap nice bag for me", {"category": "fashion", "q": "bag"}),
        ("toyota 2018", {"q": "toyota 2018"}),
]


def test_sentences(spark):
    synonyms = spark.createDataFrame(SYNONYMS, "canonical_term string, synonym string, category_slug string")
    categories = spark.createDataFrame([("furniture", "የቤት እቃ")], "slug string, name_en string")
    listings = spark.createDataFrame([("live", "Bole"), ("live", "Megenagna"), ("queued", "Hayahulet")], "status string, location_area string")
    queries = spark.createDataFrame([(i, q) for i, (q, _) in enumerate(SENTENCES)], "query_id int, query string")
    parsed = nlparse.assembled(nlparse.parse(queries, synonyms, categories, listings))
    got = {r["query_id"]: {k: r[k] for k in (*nlparse.FIELDS, "q") if r[k] is not None} for r in parsed.collect()}
    for i, (q, want) in enumerate(SENTENCES):
        assert got[i] == want, q


def test_models_fill_gaps(spark):
    kind = "category struct<value:string,sure:double>, min_price struct<value:long,sure:double>"
    rows = spark.createDataFrame([((("phones", 0.9), None), (("books", 0.99), (5000, 0.99))), ((("phones", 0.5), (9000, 0.9)), (("books", 0.6), (100, 0.3)))], f"rules struct<{kind}>, model struct<category:struct<value:string,sure:double>,max_price:struct<value:long,sure:double>>")
    side = lambda x, names: {n: F.col(f"{x}.{n}") for n in names}
    out = nlparse.fill_gaps(side("rules", ("category", "min_price")), side("model", ("category", "max_price")))
    got = [tuple(tuple(v) if v else None for v in r) for r in rows.select(*[c.alias(n) for n, c in out.items()]).collect()]
    assert got == [(("phones", 0.9), None, (5000, 0.85)), (("books", 0.6), (9000, 0.9), None)]


def test_expansions_agree():
    rows = [{"canonical_term": c, "synonym": s} for c, s, _ in SYNONYMS]
    assert search.expand("sofa", rows) == search.expand("ሶፋ", rows) == search.expand("soffa", rows) and "couch" in search.expand("sofa", rows)


def test_albums_on_a_stream_equal_the_batch(spark, tmp_path):
    rows = [(1, 77, 4824 + i, "caption" if i == 0 else None, f"m{i}", f"2024-01-01 00:00:0{i}") for i in range(4)] + [(1, 78, 4900, " ", "x", "2024-01-01 00:05:00"), (2, 77, 5000, "b", None, "2024-01-01 00:00:01")]
    frame = spark.createDataFrame(rows, "channel_id long, grouped_id long, message_id long, caption string, media string, ts string").withColumn("ts", F.to_timestamp("ts"))
    frame.write.parquet(str(tmp_path / "in"))
    batch = sorted(map(tuple, sessions.albums(frame).collect()), key=str)
    assert (1, 77, 4824, "caption", ["m0", "m1", "m2", "m3"], 4827) in batch
    stream = spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in"))
    query = sessions.albums(stream, watermark="1 second").writeStream.outputMode("append").format("memory").queryName("albums").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    streamed = [tuple(r) for r in spark.table("albums").collect()]
    assert set(map(str, streamed)) <= set(map(str, batch)) and len(streamed) >= 1


def test_raw_sink_is_idempotent(spark, tmp_path):
    frame = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (1, 2, "c")], "channel_id long, message_id long, raw_text string")
    frame.write.parquet(str(tmp_path / "in"))
    target = str(tmp_path / "out")

    def put(batch, batch_id):
        files.snapshot(merge.enforce_first(batch, ["channel_id", "message_id"], [F.col("raw_text")]), target, batch_id)

    for _ in range(2):
        sessions.merge_each_batch(spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in")), put, str(tmp_path / "ck")).awaitTermination(120)
    assert sorted(map(tuple, files.restore(spark, target).collect())) == [(1, 1, "a"), (1, 2, "b")]


def test_rate_limit_equals_a_plain_loop(spark):
    rng = random.Random(5)
    rows = [(i, rng.randint(0, 3), rng.randint(0, 2000)) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, key long, t long").withColumn("ts", F.timestamp_seconds("t"))
    got = {r["id"]: r["accepted"] for r in sessions.limited(df, 3, 100).collect()}
    for key in range(4):
        kept = []
        for i, _, t in sorted((r for r in rows if r[1] == key), key=lambda r: (r[2], r[0])):
            kept = [x for x in kept if x > t - 100]
            assert got[i] == (len(kept) < 3)
            if len(kept) < 3:
                kept.append(t)


def test_fixture_shapes(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"id": 1, "telegramId": -5, "username": "u", "active": true, "_note": "x"}]')
    (tmp_path / "b.json").write_text('{"channels": [{"id": 2, "telegram_id": -6, "username": "v", "active": false}]}')
    got = [tuple(r)[:3] for f in ("a", "b") for r in files.read_channels(spark, str(tmp_path / f"{f}.json")).collect()]
    assert got == [(1, -5, "u"), (2, -6, "v")]


def test_empty_tables(spark):
    listings = spark.createDataFrame([], "id long, title_en string, title_am string, status string, price_etb int, category_slug string, condition string")
    synonyms = spark.createDataFrame([], "canonical_term string, synonym string, category_slug string")
    termed = price.best_term(listings, synonyms)
    assert price.price_stats(termed).count() == 0 and price.price_context(termed, price.price_stats(termed)).count() == 0


def test_text_rules_search_a_text_once_for_each_pattern(spark):
    rows = spark.createDataFrame([("x",)], "t string")
    searches = lambda c: rows.select(c.alias("x"))._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all")
    t = F.col("t")
    assert searches(text.price(t)) <= 4 and searches(text.phones(t)) <= 1 and searches(text.first_pass(t)) <= 7
    assert searches(text.mask(t)) <= 3 and searches(text.leaks(t)) <= 3


def test_text_rules_know_odd_letters_and_digits(spark):
    texts = ["PR\u0130CE 900", "pr\u0131ce: 900", "12\u212a", "4k 12k tv", "@abcd T.ME/abcd", "mened\u00a00911223344", "mNEGx", None]
    got = [r["x"] for r in spark.createDataFrame([(i, s) for i, s in enumerate(texts)], "i int, s string").coalesce(1).select(text.first_pass(F.col("s")).alias("x")).collect()]
    assert [x["price_etb"] for x in got] == [900, 900, 12000, 12000, None, None, None, None]
    assert [x["handles"] for x in got][4] == ["@abcd"] and got[5]["all_phones_normalized"] == ["+251911223344"]
    assert [x["negotiable"] for x in got] == [False, False, False, False, None, None, True, None]


def test_hashed_embedding_equals_the_loop(spark):
    words = ["", None, "a", "a b c d e", "b b b", "one two three four five six seven"]
    signs = spark.createDataFrame([(i, w) for i, s in enumerate(words) for w in (s or "").split()], "i int, w string")
    known = signs.select("i", F.pmod(F.xxhash64("w"), F.lit(8)).alias("slot"), F.when(F.pmod(F.xxhash64("w", F.lit(1)), F.lit(2)) == 0, 1.0).otherwise(-1.0).alias("sign")).collect()
    want = {i: [0.0] * 8 for i in range(len(words))}
    for r in known:
        want[r["i"]][r["slot"]] += r["sign"]
    for i, v in want.items():
        n = math.sqrt(sum(x * x for x in v))
        want[i] = [x / n for x in v] if n else ([1.0] + [0.0] * 7 if any(r["i"] == i for r in known) else v)
    e = similarity.hashed_embedding(F.col("s"), 8)
    frame = spark.createDataFrame(list(enumerate(words)), "i int, s string").select("i", e.alias("e"))
    assert {r["i"]: r["e"] for r in frame.collect()} == want
    assert "array_position" not in frame._jdf.queryExecution().optimizedPlan().toString()


def test_equal_sentences_are_parsed_once(spark, monkeypatch):
    seen = []
    parse = nlparse._parse
    monkeypatch.setattr(nlparse, "_parse", lambda queries, *a: seen.append(queries.count()) or parse(queries, *a))
    queries = spark.createDataFrame([(i, ["ring under 3000", "plate", None][i % 3]) for i in range(60)], "query_id int, query string")
    synonyms = spark.createDataFrame([("ring", "ring", "household")], "canonical_term string, synonym string, category_slug string")
    categories = spark.createDataFrame([("household", "All household")], "slug string, name_en string")
    listings = spark.createDataFrame([("Bole", "live")], "location_area string, status string")
    got = {r["query_id"]: r for r in nlparse.parse(queries, synonyms, categories, listings).collect()}
    assert seen == [3] and len(got) == 60
    assert {r["max_price"]["value"] for i, r in got.items() if i % 3 == 0} == {3000} and all(r["max_price"] is None and r["q"] is None for i, r in got.items() if i % 3 == 2)


def test_clusters_shuffle_no_vectors_and_do_not_depend_on_broadcasts(spark, monkeypatch):
    rows = [(i, i % 7, "ab"[i % 2], "t", None if i % 5 == 0 else f"p{i % 2}", 100 + i % 4 * 60, f"{i % 3:016x}", [float(i % 3 == 0), 1.0]) for i in range(24)]
    items = spark.createDataFrame(rows, "id long, ord int, category_slug string, title string, phone string, price_etb int, phash string, embedding array<double>")
    assert "embedding" not in dedup._folded(items)[1].columns
    want = {r["id"]: r["leader_id"] for r in dedup.leader_clusters(items).collect()}
    monkeypatch.setattr(dedup, "SMALL", -1)
    assert {r["id"]: r["leader_id"] for r in dedup.leader_clusters(items).collect()} == want and len(want) == 24


def test_places_as_numbers_keep_the_order_and_the_ids(spark):
    ids = [-(2**63), -5, 0, 7, 2**63 - 1]
    rows = [(i, o) for i in ids for o in (None, -(2**31), -1, 0, 3, 2**31 - 1)]
    items = spark.createDataFrame(rows, "id long, ord int")
    placed = items.withColumn("k", dedup._place(items)).withColumn("s", F.struct("ord", "id"))
    assert placed.dtypes[2][1].startswith("decimal")
    got = placed.select("s", dedup._id(placed, "k").alias("id")).orderBy("k").collect()
    want = placed.select("s", F.col("id")).orderBy("s").collect()
    assert got == want and len(got) == len(rows)
    parts = placed.select("s", dedup._parted(placed, "k").alias("p"))
    assert [r["s"] for r in parts.orderBy("p").collect()] == [r["s"] for r in want] and {r["p"]["id"] for r in parts.collect()} == set(ids)


def test_pairs_meet_once_whatever_their_categories_and_confidence(spark):
    rows = [(i, i, c, t, "p", price, h, v) for i, (c, t, price, h, v) in enumerate((c, t, price, h, v) for c in ("a", "b", "", None) for t in ("m1", "m2", "sofa") for price in (100, 90, None, 0) for h, v in (("0" * 16, [1.0, 0.0]), ("f" * 16, [0.9, 0.1])))]
    rows += [(1000 + r[0], 50 - r[1], *r[2:4], None, *r[5:]) for r in rows[::5]]
    items = spark.createDataFrame(rows, "id long, ord int, category_slug string, title string, phone string, price_etb int, phash string, embedding array<double>")
    side = lambda n: items.select(F.struct("ord", "id").alias(f"k{n}"), F.struct(*dedup.ITEM).alias(n))
    every = side("a").crossJoin(side("b")).where("ka < kb").select("ka.id", F.col("kb.id").alias("b"), dedup.decision().alias("d")).where("d.decision = 'auto_merge'").select("id", "b", "d.confidence")
    want = sorted(map(tuple, every.collect()))
    got = dedup.merge_edges(items).select("ka.id", F.col("kb.id").alias("b"), "confidence").collect()
    assert sorted(map(tuple, got)) == want and {r[2] for r in want} == {0.98, 0.92, 0.90}


def test_report_needs_the_sizes_of_clusters_alone(spark):
    items = spark.createDataFrame([(1, 1, 7, 30), (2, 1, 8, None), (3, 1, 7, 20), (4, 4, None, None)], "id long, leader_id long, channel_id long, price_etb int")
    sizes = dedup.cluster_sizes(items)
    assert sorted(map(tuple, sizes.collect())) == [(1, 20, 2, 3), (4, None, 1, 1)]
    assert dedup.dedup_report(items, sizes).first().asDict() == {"evaluated": 4, "clusters": 2, "auto_merges": 2, "cross_channel": 1, "max_channels": 2}
    assert dedup.dedup_report(items, sizes.limit(0)).first().asDict() == {"evaluated": 4, "clusters": 0, "auto_merges": 0, "cross_channel": 0, "max_channels": None}


def test_titles_keep_no_classes_of_leaders_apart(spark):
    rows = [(i, i // 4, "a", f"title {i}", "p" if i % 2 else None, 100 if i % 2 else i, "0" * 16, [1.0, 0.5]) for i in range(40)]
    items = spark.createDataFrame(rows, "id long, ord int, category_slug string, title string, phone string, price_etb int, phash string, embedding array<double>")
    assert dedup._folded(items, titles=False)[1].count() == 2 and dedup._folded(items)[1].count() == 21
    assert {r["leader_id"] for r in dedup.leader_clusters(items).collect()} == {0}
