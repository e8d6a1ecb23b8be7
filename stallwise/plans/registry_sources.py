"""Registered queries over written sources: posts read back by the data source, versioned tables, stored objects; and alerts, image bytes and keyword tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from stallwise.functions import imagehash, text
from stallwise.operators import dedup, merge, outcomes, phrases
from stallwise.plans.registry import _NEW, _STATS, _stats, query
from stallwise.plans.registry_more import _described, _vectors
from stallwise.session import shared_folder
from stallwise.sources import history, objects, versions
from stallwise.streaming import alerts

L = F.lit


def _folder(m, name: str) -> str:
    """A new folder among those that driver and executors share."""
    return f"{shared_folder(m.spark)}/{name}-{uuid.uuid4().hex}"


def _posted(m, path: str, batches: int = 2) -> None:
    """All messages as posts below ``path``, the later half of ids in a later batch."""
    posts = m.raw_messages.select("channel_id", "message_id", F.when(F.col("message_id") % 7 == 0, F.col("message_id")).alias("grouped_id"), F.col("posted_at").cast("long").alias("ts"), F.col("raw_text").alias("text")).where("channel_id is not null")
    for n in range(batches):
        history.append(posts.where(F.pmod(F.xxhash64("message_id"), L(batches)) == n), path, n)


@query(
    "sc07_history",
    """select r.channel_id, r.message_id, case when r.message_id % 7 = 0 then r.message_id end as grouped_id, cast(r.posted_at as bigint) as ts, sha256(r.raw_text) as text_hash
from raw_messages r left join channels c on c.id = r.channel_id where r.channel_id is not null and r.message_id > coalesce(c.last_message_id, 0) and r.posted_at >= 6000""",
)
def _(m):
    path = _folder(m, "posts")
    _posted(m, path)
    marks = m.channels.select(F.col("id").alias("channel_id"), "last_message_id")
    return history.resumed(history.read(m.spark, path, since="6000"), marks).select("channel_id", "message_id", "grouped_id", "ts", F.sha2("text", 256).alias("text_hash"))


@query("sc08_live_stream", "select r.channel_id, count(*) as n, max(r.message_id) as last_message_id from raw_messages r join channels c on c.id = r.channel_id where c.active group by r.channel_id")
def _(m):
    path, out = _folder(m, "posts"), _folder(m, "received")
    allowed = m.channels.where("active").select(F.col("id").alias("channel_id"))
    for n in (1, 2):  # the second run goes on behind the first one's checkpoint
        _posted(m, path, n)
        stream = history.read_stream(m.spark, path).select("channel_id", "message_id").join(allowed, "channel_id", "left_semi")
        run = stream.writeStream.format("parquet").option("checkpointLocation", f"{out}-checkpoint").trigger(availableNow=True).start(out)
        run.awaitTermination()
    got = m.spark.read.schema("channel_id long, message_id long").parquet(out)
    # a post that is sent again is the same post
    return got.distinct().groupBy("channel_id").agg(F.count("*").alias("n"), F.max("message_id").alias("last_message_id"))


@query(
    "sc16_objects",
    """with o as (select concat('raw/', cast(channel_id as string), '/', cast(message_id as string)) as key, raw_text from raw_messages where raw_text is not null and channel_id is not null)
select key, sha256(raw_text) as sha256, true as found, cast(octet_length(encode(raw_text)) as bigint) as size from o union all select concat(key, '.none'), null, false, null from o""",
)
def _(m):
    path = _folder(m, "objects")
    key = F.concat(L("raw/"), F.col("channel_id").cast("string"), L("/"), F.col("message_id").cast("string"))
    rows = m.raw_messages.where("raw_text is not null and channel_id is not null").select(key.alias("key"), F.encode("raw_text", "utf-8").alias("content"))
    objects.put(rows, path)
    asked = rows.select("key").unionByName(rows.select(F.concat("key", L(".none")).alias("key")))
    held = objects.get(asked, path).select("key", F.sha2("content", 256).alias("sha256"), F.octet_length("content").cast("long").alias("size"))
    return objects.exists(asked, path).join(held, "key", "left").select("key", "sha256", "found", "size")


@query(
    "sc11_versioned_merge",
    f"""with n as ({_NEW}), o as (select id, title_en, price_etb, status from listings where id % 2 = 0)
select coalesce(o.id, n.id) as id, case when n.id is null then o.title_en else n.title_en end as title_en, case when n.id is null then o.price_etb when o.id is null then n.price_etb else least(o.price_etb, n.price_etb) end as price_etb,
  case when o.id is null then 'live' else o.status end as status from o full join n on o.id = n.id""",
)
def _(m):
    cols, root = ["id", "title_en", "price_etb", "status"], _folder(m, "listings")
    versions.replace(m.listings.where("id % 2 = 0").select(*cols), root, ["id"])
    batch = m.listings.where("id % 3 = 0").withColumn("price_etb", (F.col("price_etb") * 2).cast("int")).select(*cols).unionByName(m.listings.where("id % 50 = 1").withColumn("id", F.col("id") + 100_000_000).select(*cols))
    versions.merge(batch, root, lambda old, new: merge.upsert(old, new, ["id"], {"price_etb": merge.lesser, "status": merge.older}, {"status": L("live")}))
    return versions.read(m.spark, root)


@query("a02_refreshed_stats", f"with {_STATS} select * from stats")
def _(m):
    root = _folder(m, "stats")
    versions.refresh(root, lambda: _stats(m), ["bucket_key"], 16)
    return versions.read(m.spark, root)


@query(
    "st04_interval_alerts",
    """with s as (select c_custkey as id, case when c_custkey % 3 > 0 then lower(c_mktsegment) end as category, case when c_custkey % 3 = 0 or c_custkey % 2 = 0 then n_name end as area,
  case when c_custkey % 4 > 0 then cast(floor(abs(c_acctbal) * 10) as int) end as min_price, case when c_custkey % 5 > 0 then cast(floor(abs(c_acctbal) * 10) + c_custkey % 70000 as int) end as max_price,
  case when c_custkey % 2 = 0 then date '1995-06-01' end as last_alert_at, c_custkey % 9 > 0 as alerts_on from customer join nation on n_nationkey = c_nationkey)
select s.id as search_id, l.id as listing_id from listings l join s on l.status = 'live' and alerts_on and (category is null or category = category_slug) and (area is null or area = location_area)
  and (min_price is null or price_etb >= min_price) and (max_price is null or max_price >= 150000 or price_etb <= max_price) and (last_alert_at is null or l.posted_at > last_alert_at)""",
)
def _(m):
    k, money = F.col("c_custkey"), F.floor(F.abs("c_acctbal") * 10)
    searches = m.customer.join(m.nation, F.col("n_nationkey") == F.col("c_nationkey")).select(
        k.alias("id"), F.when(k % 3 > 0, F.lower("c_mktsegment")).alias("category"), F.when((k % 3 == 0) | (k % 2 == 0), F.col("n_name")).alias("area"),
        F.when(k % 4 > 0, money.cast("int")).alias("min_price"), F.when(k % 5 > 0, (money + k % 70_000).cast("int")).alias("max_price"),
        F.when(k % 2 == 0, L("1995-06-01").cast("date")).alias("last_alert_at"), (k % 9 > 0).alias("alerts_on"),
    )
    return alerts.alerts(m.listings, searches)


#: A text's bytes as a PGM image of 32 columns, the last row filled with zeros.
_PGM = "concat(encode(concat('P5\n32 ', cast(ceil(octet_length(raw_text) / 32) as string), '\n255\n'), 'utf-8'), rpad(encode(raw_text, 'utf-8'), cast(ceil(octet_length(raw_text) / 32) * 32 as int), X'00'))"


@query("v04_hash_of_bytes")
def _(m):
    """Hashes of all texts' bytes as images; null for texts without any. Tested against plain loops."""
    return m.raw_messages.select("id", F.expr(_PGM).alias("content")).select("id", imagehash.image_hash_of_bytes(F.col("content")).alias("phash"))


_DICTIONARY = """select 'category' as kind, p_name as phrase, min(lower(p_brand)) as label, min(p_partkey) as rank from part group by p_name
union all select 'category', w, max(lower(p_brand)), min(p_partkey) from (select {word} as w, p_brand, p_partkey from part) x group by w
union all select 'condition', lower(replace(p_brand, '#', ' ')), min(lower(p_name)), min(p_partkey) from part group by p_brand
union all select 'area', {word}, lower(replace(p_brand, '#', ' ')), 0 from part group by all"""


@query(
    "x16_keyword_tables",
    f"""with d as ({_DICTIONARY.format(word="string_split(p_name, ' ')[2]")}), t as (select id, lower(title_en) as t from listings),
u as (select distinct t from t), m as (select t, kind, arg_max(label, (length(phrase), -rank)) as label, min(label) <> max(label) as two from u join d on contains(t, phrase) group by t, kind)
select id, coalesce(any_value(label) filter (kind = 'category'), 'other') as category, any_value(label) filter (kind = 'condition') as condition, any_value(label) filter (kind = 'area' and not two) as area from t left join m using (t) group by id""",
)
def _(m):
    part, word = m.part, "split(p_name, ' ')[1]"
    dictionary = m.spark.sql(_DICTIONARY.format(word=word).replace("from part", "from {part}"), part=part)
    titles = m.listings.select("id", F.lower("title_en").alias("text"))
    found = phrases.labels(titles.select("text").distinct(), dictionary, ["text"], unclear=("area",))
    one = lambda k: F.max(F.when(F.col("kind") == k, F.col("label"))).alias(k)
    each = found.groupBy("text").agg(one("category"), one("condition"), one("area"))
    return titles.join(each, "text", "left").drop("text").fillna({"category": "other"})


@query("v07_outcomes")
def _(m):
    """Pairs of eligible sightings by outcome. All pairs are too many for SQL; tested against all pairs of small tables."""
    return outcomes.outcome_counts(dedup.eligible(_described(m, m.sightings_by_listing)), _vectors(m))


@query(
    "sc12_upsert_images",
    """with o as (select r2_key, listing_id, case when sort_order % 3 > 0 then phash end as phash, sort_order from images where listing_id % 2 = 0),
n as (select r2_key, listing_id + 1 as listing_id, case when sort_order % 2 = 0 then reverse(phash) end as phash, cast(sort_order + 10 as int) as sort_order from images where listing_id % 3 = 0)
select r2_key, coalesce(o.listing_id, n.listing_id) as listing_id, coalesce(n.phash, o.phash) as phash, coalesce(n.sort_order, o.sort_order) as sort_order from o full join n using (r2_key)""",
)
def _(m):
    held = m.images.where("listing_id % 2 = 0").select("r2_key", "listing_id", F.when(F.col("sort_order") % 3 > 0, F.col("phash")).alias("phash"), "sort_order")
    new = m.images.where("listing_id % 3 = 0").select("r2_key", (F.col("listing_id") + 1).alias("listing_id"), F.when(F.col("sort_order") % 2 == 0, F.reverse("phash")).alias("phash"), (F.col("sort_order") + 10).cast("int").alias("sort_order"))
    return merge.upsert(held, new, ["r2_key"], {"listing_id": merge.older, "phash": merge.newer_if_set})


@query("x11_leaks_of_posts", "select count(*) as n, count(*) filter (kind in (0, 1, 3, 6, 7)) as with_phone, count(*) filter (kind in (1, 4)) as with_handle, 0::bigint as leaking from posts")
def _(m):
    masked = m.posts.select("raw_text", text.mask(F.col("raw_text")).alias("x")).select("raw_text", F.col("x.masked").alias("masked"))
    has = lambda what: F.count(F.when(F.col("masked").contains(what), 1))
    return masked.agg(F.count("*").alias("n"), has("[PHONE_1]").alias("with_phone"), has("[USER_1]").alias("with_handle"), F.count(F.when(text.leaks(F.col("masked")), 1)).alias("leaking"))
