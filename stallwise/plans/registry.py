"""The registered queries over the marketplace views, each with its DuckDB twin where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stallwise.functions import similarity, text
from stallwise.operators import browse, counters, dedup, holds, merge, messaging, moderation, price, ranking, search
from stallwise.plans.market import Market, twin
from stallwise.streaming import sessions

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f: Callable[[Market], DataFrame]) -> Callable[[Market], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: f(Market(spark, sf_dir))
        if sql is not None:
            SQL[name] = twin(sql)
        return f

    return register


L = F.lit
AS_OF = "1998-06-01"

# -- scans, sinks and merges (SC, F) --------------------------------------------------------------------


@query("sc01_active_channels", "select id, username from channels where active")
def _(m):
    return m.channels.where("active").orderBy("id").select("id", "username")


@query("sc02_channel_lookup", "select id, username from channels where lower(username) = 'supplier_000000003' or telegram_id = -1000000000004")
def _(m):
    keys = ["@Supplier_000000003", "-1000000000004"]
    hit = [F.col("telegram_id") == int(k) if k.lstrip("-").isdigit() else F.lower("username") == k.lstrip("@").lower() for k in keys]
    return m.channels.where(hit[0] | hit[1]).select("id", "username")


@query("sc03_unprocessed", "select id, channel_id, posted_at from raw_messages where processed_at is null order by posted_at, id limit 40")
def _(m):
    return m.raw_messages.where("processed_at is null").orderBy("posted_at", "id").limit(40).select("id", "channel_id", "posted_at")


@query("sc04_all_raw", "select id, channel_id, posted_at from raw_messages")
def _(m):
    return m.raw_messages.select("id", "channel_id", "posted_at")


@query(
    "sc09_upsert_raw",
    """with v as (select user_id as k, event_type as c, event_id as ver, case when event_id % 3 = 0 then null else value end as value, ts from events)
select k as channel_id, c as message_kind, arg_max(ts, ver) as posted_at, arg_max(value, ver) filter (value is not null) as value from v group by k, c""",
)
def _(m):
    v = m.events.select(F.col("user_id").alias("channel_id"), F.col("event_type").alias("message_kind"), F.col("event_id").alias("ver"), F.when(F.col("event_id") % 3 != 0, F.col("value")).alias("value"), F.col("ts").alias("posted_at"))
    return merge.fold(v, ["channel_id", "message_kind"], "ver", ["posted_at"], ["value"])


@query("sc10_append", "select id, 'v1' as prompt_version from raw_messages union all select id, 'v2' from raw_messages where id % 2 = 0")
def _(m):
    v1 = m.raw_messages.select("id", L("v1").alias("prompt_version"))
    return v1.unionByName(m.raw_messages.where("id % 2 = 0").select("id", L("v2").alias("prompt_version")))


_NEW = "select id, title_en, cast(price_etb * 2 as int) as price_etb, status from listings where id % 3 = 0 union all select id + 100000000, title_en, price_etb, status from listings where id % 50 = 1"


@query(
    "sc11_upsert_listings",
    f"""with n as ({_NEW}), o as (select id, title_en, price_etb, status from listings where id % 2 = 0)
select coalesce(o.id, n.id) as id, case when n.id is null then o.title_en else n.title_en end as title_en, case when n.id is null then o.price_etb when o.id is null then n.price_etb else least(o.price_etb, n.price_etb) end as price_etb,
  case when o.id is null then 'live' else o.status end as status from o full join n on o.id = n.id""",
)
def _(m):
    cols = ["id", "title_en", "price_etb", "status"]
    new = m.listings.where("id % 3 = 0").withColumn("price_etb", (F.col("price_etb") * 2).cast("int")).select(*cols).unionByName(m.listings.where("id % 50 = 1").withColumn("id", F.col("id") + 100_000_000).select(*cols))
    return merge.upsert(m.listings.where("id % 2 = 0").select(*cols), new, ["id"], {"price_etb": merge.lesser, "status": merge.older}, {"status": L("live")})


@query(
    "sc12_upsert_sources",
    """with o as (select raw_message_id, listing_id, price_etb from sightings where raw_message_id % 2 = 0), n as (select raw_message_id, listing_id + 1 as listing_id, price_etb + 5 as price_etb from sightings where raw_message_id % 3 = 0)
select coalesce(o.raw_message_id, n.raw_message_id) as raw_message_id, coalesce(o.listing_id, n.listing_id) as listing_id, cast(case when n.raw_message_id is null then o.price_etb else n.price_etb end as int) as price_etb from o full join n on o.raw_message_id = n.raw_message_id""",
)
def _(m):
    s = m.sightings.select("raw_message_id", "listing_id", "price_etb")
    new = s.where("raw_message_id % 3 = 0").select("raw_message_id", (F.col("listing_id") + 1).alias("listing_id"), (F.col("price_etb") + 5).alias("price_etb"))
    return merge.upsert(s.where("raw_message_id % 2 = 0"), new, ["raw_message_id"], {"listing_id": merge.older})


@query("sc13_insert_absent", "select slug, name_en from categories union all select 'extra', 'Extra'")
def _(m):
    new = m.spark.createDataFrame([("extra", "Extra"), ("other", "Changed")], "slug string, name_en string")
    return merge.insert_absent(m.categories.select("slug", "name_en"), new, ["slug"])


@query("sc14_upsert_channels", "select id, case when id % 2 = 0 then concat(title, ' new') else title end as title, last_message_id, case when id % 2 = 0 then true else active end as active from channels")
def _(m):
    cols = ["id", "title", "last_message_id", "active"]
    new = m.channels.where("id % 2 = 0").select("id", F.concat("title", L(" new")).alias("title"), L(None).cast("long").alias("last_message_id"), L(True).alias("active"))
    return merge.upsert(m.channels.select(*cols), new, ["id"], {"last_message_id": merge.older})


@query("sc15_high_water", "select id, greatest(coalesce(last_message_id, 0), n) as last_message_id from channels join (select channel_id, max(message_id) as n from raw_messages group by channel_id) r on r.channel_id = id")
def _(m):
    seen = m.raw_messages.groupBy("channel_id").agg(F.max("message_id").alias("n"))
    return m.channels.join(seen, F.col("id") == F.col("channel_id")).select("id", merge.high_water(F.col("last_message_id"), F.col("n")).alias("last_message_id"))


@query("sc16_storage_key", "select id, concat('raw/', cast(channel_id as string), '/', cast(message_id as string), '_0_', substr(sha256(raw_text), 1, 8), '.jpg') as key from raw_messages")
def _(m):
    return m.raw_messages.select("id", text.storage_key(F.col("channel_id"), F.col("message_id"), L(0), F.col("raw_text")).alias("key"))


@query("sc18_image_url", "select r2_key, concat('/media/', r2_key) as url from images union all select '/x', '/x' union all select 'http://y', 'http://y'")
def _(m):
    extra = m.spark.createDataFrame([("/x",), ("http://y",)], "r2_key string")
    return m.images.select("r2_key").unionByName(extra).select("r2_key", text.image_url(F.col("r2_key"), "/media").alias("url"))


_F01 = browse.ListingQuery(category="household", conditions=("brand_new", "fair"), tiers=("claimed", "verified"), min_price=20_000, max_price=120_000, sort="price_asc")


@query("f01_browse_filter", "select id, price_etb from listings where status = 'live' and category_slug = 'household' and condition in ('brand_new', 'fair') and tier in ('claimed', 'verified') and price_etb between 20000 and 120000")
def _(m):
    return m.listings.where(browse.conditions(_F01)).select("id", "price_etb")


@query("f01_unbounded_price", "select id from listings where status = 'live' and price_etb is not null and price_etb >= 0")
def _(m):
    return m.listings.where(browse.conditions(browse.ListingQuery(min_price=0, max_price=150_000, sort="price_desc"))).select("id")


@query("f01_open_maximum", "select id from listings where status = 'live' and price_etb is not null")
def _(m):
    return m.listings.where(browse.conditions(browse.ListingQuery(max_price=150_000))).select("id")


@query("f02_area_aliases", "select * from (values ('bole', 'bole'), ('bole', 'Bole'), ('bole', 'ቦሌ'), ('NATION_3', 'NATION_3')) t(area, spelling)")
def _(m):
    return m.spark.createDataFrame([(a, s) for a in ("bole", "NATION_3") for s in browse.area_aliases(a)], "area string, spelling string")


@query("f05_with_image", "select id from listings where exists (select 1 from images where listing_id = id)")
def _(m):
    return m.listings.select("id").join(m.images.select(F.col("listing_id").alias("id")), "id", "left_semi")


@query("f06_without_report", "select id from listings where status = 'live' and not exists (select 1 from reports where listing_id = listings.id)")
def _(m):
    return m.listings.where("status = 'live'").select("id").join(m.reports.select(F.col("listing_id").alias("id")), "id", "left_anti")


@query("f07_related", "select id, title_en from listings where status = 'live' and id <> 2 and category_slug = (select category_slug from listings where id = 2) order by posted_at desc, id limit 4")
def _(m):
    return browse.related(m.listings, 2).select("id", "title_en")


@query("f09_promotion", "select id, regexp_matches(raw_text, '(?i)cross\\s*promo|ፕሮሞሽን|ለማስተዋወቅ|join\\s*our\\s*channel|ቻናላችንን\\s*ይቀላቀሉ') as promotion from raw_messages")
def _(m):
    return m.raw_messages.select("id", text.promotion(F.col("raw_text")).alias("promotion"))


@query("f10_participant", "select id, case when buyer_id = 7 then 'buyer' else 'seller' end as role from threads where buyer_id = 7 or seller_id = 7")
def _(m):
    return m.threads.where(messaging.participant(L(7))).select("id", messaging.role(L(7)).alias("role"))


@query("f11_json_equal", "select event_id, cast(json_extract(props, '$.k') as bigint) % 2 = 0 as even from events")
def _(m):
    parsed = F.from_json("props", "k long")
    return m.events.select("event_id", parsed.eqNullSafe(F.struct((F.floor(parsed["k"] / 2) * 2).alias("k"))).alias("even"))


@query("f13_sane_bounds", "select id, coalesce(price_etb between 50 and 150000000, false) as sane, substr(title_en, 1, 140) as title from listings")
def _(m):
    return m.listings.select("id", F.coalesce(F.col("price_etb").between(text.LEAST_PRICE, text.MOST_PRICE), L(False)).alias("sane"), F.substring("title_en", 1, 140).alias("title"))


# -- joins (J) --------------------------------------------------------------------------------------------


@query("j01_extraction_rows", "select r.id, r.channel_id, c.username, r.posted_at from raw_messages r join channels c on c.id = r.channel_id")
def _(m):
    return m.raw_messages.join(F.broadcast(m.channels.select(F.col("id").alias("channel_id"), "username")), "channel_id").select("id", "channel_id", "username", "posted_at")


@query("j02_category_label", "select l.id, c.name_en from listings l left join categories c on c.slug = l.category_slug")
def _(m):
    label = F.broadcast(m.categories.select(F.col("slug").alias("category_slug"), "name_en"))
    return m.listings.join(label, "category_slug", "left").select("id", "name_en")


@query("j03_sources_of_page", "select s.listing_id, s.raw_message_id, c.username from sightings s join channels c on c.id = s.channel_id where s.listing_id in (select id from listings where status = 'live' order by id limit 24)")
def _(m):
    page = m.listings.where("status = 'live'").orderBy("id").limit(24).select(F.col("id").alias("listing_id"))
    rows = m.sightings.join(F.broadcast(page), "listing_id", "left_semi")
    return rows.join(F.broadcast(m.channels.select(F.col("id").alias("channel_id"), "username")), "channel_id").select("listing_id", "raw_message_id", "username")


@query("j04_best_phone", "select listing_id, phone_normalized from (select *, row_number() over (partition by listing_id order by confidence_score desc, raw_message_id) as n from sightings where phone_normalized is not null) where n = 1")
def _(m):
    known = m.sightings.where("phone_normalized is not null")
    return known.groupBy("listing_id").agg(F.min_by("phone_normalized", F.struct((-F.col("confidence_score")).alias("c"), "raw_message_id")).alias("phone_normalized"))


@query("j05_ingest_stats", "select c.id, c.username, count(r.id) as n_messages, max(r.posted_at) as last_posted from channels c left join raw_messages r on r.channel_id = c.id group by c.id, c.username")
def _(m):
    return counters.ingest_stats(m.channels, m.raw_messages)


@query("j08_cluster_sightings", "select s.listing_id, s.raw_message_id, c.username, s.price_etb, s.phone_normalized from sightings s join channels c on c.id = s.channel_id join listings l on l.id = s.listing_id where l.status = 'live' and l.seen_in_channels >= 3")
def _(m):
    live = m.listings.where("status = 'live' and seen_in_channels >= 3").select(F.col("id").alias("listing_id"))
    rows = m.sightings.join(live, "listing_id", "left_semi").join(F.broadcast(m.channels.select(F.col("id").alias("channel_id"), "username")), "channel_id")
    return rows.select("listing_id", "raw_message_id", "username", "price_etb", "phone_normalized")


@query("j10_native_queue", "select l.id, l.extraction_confidence, count(i.r2_key) as n_images from listings l left join images i on i.listing_id = l.id where l.status = 'queued' and l.seller_id is not null group by all")
def _(m):
    pictures = m.images.groupBy("listing_id").agg(F.count("*").alias("n"))
    queued = m.listings.where("status = 'queued' and seller_id is not null")
    return queued.join(pictures, queued["id"] == pictures["listing_id"], "left").select("id", "extraction_confidence", F.coalesce("n", L(0)).alias("n_images"))


@query("j11_both_names", "select t.id, b.c_name as buyer, s.c_name as seller from threads t join customer b on b.c_custkey = t.buyer_id left join customer s on s.c_custkey = t.seller_id")
def _(m):
    who = m.customer.select("c_custkey", "c_name")
    buyer, seller = who.select(F.col("c_custkey").alias("buyer_id"), F.col("c_name").alias("buyer")), who.select(F.col("c_custkey").alias("seller_id"), F.col("c_name").alias("seller"))
    return m.threads.join(buyer, "buyer_id").join(seller, "seller_id", "left").select("id", "buyer", "seller")


@query(
    "j12_scalar_lookups",
    "select l.id, (select r2_key from images i where i.listing_id = l.id order by sort_order, r2_key limit 1) as cover, (select count(*) from reports r where r.listing_id = l.id) as n_reports from listings l where l.status = 'queued'",
)
def _(m):
    cover = m.images.groupBy("listing_id").agg(F.min_by("r2_key", F.struct("sort_order", "r2_key")).alias("cover"))
    n = m.reports.groupBy("listing_id").agg(F.count("*").alias("n"))
    rows = m.listings.where("status = 'queued'").select(F.col("id").alias("listing_id")).join(cover, "listing_id", "left").join(n, "listing_id", "left")
    return rows.select(F.col("listing_id").alias("id"), "cover", F.coalesce("n", L(0)).alias("n_reports"))


_TERM = """select l.*, t.term from listings l left join (
  select id, term from (select l.id, canonical_term as term, row_number() over (partition by l.id order by length(synonym) desc, canonical_term) as n
    from listings l join synonyms s on s.category_slug = l.category_slug and contains(lower(concat(title_en, ' ', title_am)), lower(synonym))) where n = 1) t on t.id = l.id"""


@query("j13_best_term", f"select id, term from ({_TERM})")
def _(m):
    return price.best_term(m.listings, m.synonyms).select("id", "term")


@query("j15_flagged_phones", "select distinct phone_normalized from sightings join listings on listing_id = id where status = 'removed' and phone_normalized is not null")
def _(m):
    return moderation.flagged_phones(m.sightings, m.listings)


@query("j17_promote", "select id, case when id in (select id from listings where tier = 'indexed' and price_etb is not null and id in (select listing_id from images) order by id limit 6) then 'claimed' else tier end as tier from listings")
def _(m):
    chosen = m.listings.where("tier = 'indexed' and price_etb is not null").join(m.images.select(F.col("listing_id").alias("id")), "id", "left_semi").orderBy("id").limit(6).select("id", L(True).alias("_up"))
    return m.listings.join(F.broadcast(chosen), "id", "left").select("id", F.when(F.col("_up"), "claimed").otherwise(F.col("tier")).alias("tier"))


@query("j17_ban_cascade", "select l.id, case when l.status = 'queued' and exists (select 1 from sightings s where s.listing_id = l.id and s.channel_id in (3, 4)) then 'removed' else l.status end as status from listings l")
def _(m):
    banned = m.channels.where("id in (3, 4)").select(F.col("id").alias("channel_id"))
    return moderation.ban_cascade(m.listings, m.sightings, banned).select("id", "status")


@query("j18_report_feed", "select r.id, r.listing_id, l.title_en, l.status, cast(r.created_on as string) as created_on from reports r join listings l on l.id = r.listing_id order by r.id desc limit 100")
def _(m):
    return counters.report_feed(m.reports, m.listings).withColumn("created_on", F.col("created_on").cast("string"))


@query("j18_removals_newest", "select r.id, r.listing_id, l.title_en, cast(r.created_on as string) as created_on from removal_requests r join listings l on l.id = r.listing_id where r.status = 'pending' order by r.id desc limit 100")
def _(m):
    return counters.removal_feed(m.removal_requests, m.listings, newest_first=True).withColumn("created_on", F.col("created_on").cast("string"))


@query("j18_removals_oldest", "select r.id, r.listing_id, l.title_en, cast(r.created_on as string) as created_on from removal_requests r join listings l on l.id = r.listing_id where r.status = 'pending' order by r.id limit 100")
def _(m):
    return counters.removal_feed(m.removal_requests, m.listings, newest_first=False).withColumn("created_on", F.col("created_on").cast("string"))


# -- aggregates (A) and price semantics (M01-M03) -------------------------------------------------------

#: Statistics of every bucket that a live, priced listing belongs to. Prices beyond 3 interquartile ranges of a bucket of 12 or
#: more go, and fences are 1.5 interquartile ranges of the logarithms beyond the quartiles.
_STATS = f"""
offers as (
  select id, price_etb, unnest([
    {{'k': 'term:' || term || '|cond:' || condition, 's': 'term+condition'}}, {{'k': 'term:' || term || '|cond:*', 's': 'term'}},
    {{'k': 'cat:' || category_slug || '|cond:' || condition, 's': 'category+condition'}}, {{'k': 'cat:' || category_slug || '|cond:*', 's': 'category'}}]) as b
  from ({_TERM}) where status = 'live' and price_etb > 0),
fenced as (
  select b.k as bucket_key, b.s as scope, price_etb, count(*) over w as offered, quantile_cont(price_etb, 0.25) over w as lower_quarter, quantile_cont(price_etb, 0.75) over w as upper_quarter
  from offers where b.k is not null window w as (partition by b.k)),
quantiles as (
  select bucket_key, scope, offered, count(*) as used, quantile_cont(price_etb, [0.25, 0.5, 0.75]) as price, quantile_cont(ln(price_etb), [0.25, 0.75]) as log_price, min(price_etb) as min_etb, max(price_etb) as max_etb
  from fenced where offered < 12 or price_etb between lower_quarter - 3 * (upper_quarter - lower_quarter) and upper_quarter + 3 * (upper_quarter - lower_quarter) group by all),
stats as (
  select bucket_key, scope, offered::int as raw_sample_size, used::int as sample_size, (offered - used)::int as trimmed_count,
    round_even(price[2], 0)::int as median_etb, round_even(price[1], 0)::int as p25_etb, round_even(price[3], 0)::int as p75_etb, min_etb, max_etb,
    greatest(1, round_even(exp(log_price[1] - 1.5 * (log_price[2] - log_price[1])), 0)::int) as low_fence_etb, round_even(exp(log_price[2] + 1.5 * (log_price[2] - log_price[1])), 0)::int as high_fence_etb
  from quantiles)"""


def _termed(m):
    return price.best_term(m.listings, m.synonyms)


def _stats(m):
    return price.price_stats(_termed(m))


@query("a01_price_stats", f"with {_STATS} select * from stats")
def _(m):
    return _stats(m)


@query("a02_staleness", "select 1 as run, true as stale union all select 2, false union all select 3, true")
def _(m):
    runs = m.spark.createDataFrame([(1, None), (2, 9_500), (3, 9_000)], "run int, computed_at long")
    return runs.select("run", price.stale(F.col("computed_at"), L(10_000)).alias("stale"))


@query("a03_bucket_summary", f"""with {_STATS} select count(*) as buckets, count(*) filter (sample_size >= 8) as usable, count(distinct case when sample_size >= 8 and bucket_key like 'cat:%' then regexp_extract(bucket_key, '^[a-z]+:(.*)\\|cond:', 1) end) as categories,
  count(distinct case when sample_size >= 8 and bucket_key like 'term:%' then regexp_extract(bucket_key, '^[a-z]+:(.*)\\|cond:', 1) end) as terms from stats""")
def _(m):
    return price.bucket_summary(_stats(m))


_LADDER = f"""with {_STATS},
rungs as (
  select id, 0 as rank, 'term:' || term || '|cond:' || condition as bucket_key from ({_TERM}) union all select id, 1, 'term:' || term || '|cond:*' from ({_TERM})
  union all select id, 2, 'cat:' || category_slug || '|cond:' || condition from ({_TERM}) union all select id, 3, 'cat:' || category_slug || '|cond:*' from ({_TERM})),
ladder as (select id, s.* from (select r.id, r.bucket_key, row_number() over (partition by r.id order by r.rank) as n from rungs r join stats s on s.bucket_key = r.bucket_key and s.sample_size >= MIN and SCOPES) x join stats s using (bucket_key) where x.n = 1)"""


@query("j14_ladder", _LADDER.replace("MIN", "5").replace("SCOPES", "true") + " select l.id, x.bucket_key, x.median_etb from listings l left join ladder x on x.id = l.id")
def _(m):
    return price.ladder(_termed(m), _stats(m), price.MODERATION_MIN_SAMPLE).select("id", "bucket_key", "median_etb")


@query(
    "m02_price_context",
    _LADDER.replace("MIN", "8").replace("SCOPES", "true") + """,
c as (select t.id, t.price_etb, case when t.price_etb is null then 'no_price' when t.category_slug is null and t.term is null then 'no_category' when x.bucket_key is null then 'insufficient_sample' end as reason, x.*
  from (""" + _TERM + """) t left join ladder x on x.id = t.id where t.status <> 'removed')
select id, reason, case when reason is null then scope end as basis, case when reason is null then sample_size end as sample_size,
  case when reason is not null then null when scope in ('term', 'term+condition') and (price_etb < low_fence_etb or price_etb < median_etb * 0.3) then 'suspicious' when scope in ('term', 'term+condition') and price_etb > high_fence_etb then 'above'
    when price_etb < p25_etb then 'below' when price_etb > p75_etb then 'above' else 'fair' end as verdict,
  case when reason is not null then null when scope in ('term', 'term+condition') and (price_etb < low_fence_etb or price_etb < median_etb * 0.3) then 'low' when scope in ('term', 'term+condition') and price_etb > high_fence_etb then 'high' end as outlier,
  case when reason is null then floor((price_etb - median_etb)::double / median_etb * 100 + 0.5)::int end as delta_pct from c""",
)
def price_verdicts(m):
    return price.price_context(_termed(m), _stats(m))


@query("m03_suggestion", _LADDER.replace("MIN", "5").replace("SCOPES", "s.scope in ('category+condition', 'category')") + " select id, bucket_key, median_etb, p25_etb, p75_etb, sample_size from ladder")
def _(m):
    return price.suggestion(_termed(m), _stats(m))


@query("m01_verdict_counts", "select count(*) as n_listings from listings where status <> 'removed'")
def _(m):
    return price_verdicts(m).agg(F.count("*").alias("n_listings"))


@query(
    "a04_admin_counters",
    f"""select * from (select count(*) filter (status = 'queued') as queued, count(*) filter (status = 'queued' and posted_at >= date '{AS_OF}' - 1) as queued_24h, count(*) filter (status = 'live') as live, count(*) filter (status = 'hidden') as hidden, count(*) filter (status = 'removed') as removed from listings),
  (select count(*) as reports, count(*) filter (created_on >= date '{AS_OF}' - 7) as reports_7d from reports), (select count(*) filter (status = 'pending') as removals_pending from removal_requests),
  (select count(*) as channels, count(*) filter (active) as channels_active from channels), (select count(*) as raw_messages, count(*) filter (processed_at is null) as raw_unprocessed, max(posted_at) as last_captured from raw_messages)""",
)
def _(m):
    return counters.admin_counters(m.listings, m.reports, m.removal_requests, m.channels, m.raw_messages, F.to_date(L(AS_OF)))


@query("a06a_channel_rows", "select c.id, count(l.id) as sightings, count(*) filter (l.status = 'live') as live, count(*) filter (l.status = 'removed') as removed from channels c left join sightings s on s.channel_id = c.id left join listings l on l.id = s.listing_id group by c.id")
def _(m):
    return counters.channel_rows(m.channels, m.sightings, m.listings)


@query(
    "a06b_channel_quality",
    "select c.id, count(distinct l.id) as listings, count(distinct case when l.status = 'removed' then l.id end) as removed, round(count(distinct case when l.status = 'removed' then l.id end)::decimal(20,4) * 100 / nullif(count(distinct l.id), 0)::decimal(20,4), 1)::double as rejection_pct from channels c left join sightings s on s.channel_id = c.id left join listings l on l.id = s.listing_id group by c.id",
)
def _(m):
    return counters.channel_quality(m.channels, m.sightings, m.listings)


@query("a07_category_counts", "select c.slug, c.name_en, count(l.id) as n from categories c left join listings l on l.category_slug = c.slug and l.status = 'live' group by c.slug, c.name_en having count(l.id) > 0")
def _(m):
    return counters.category_counts(m.categories, m.listings)


@query("a08_landing_totals", "select a.*, b.*, greatest(seen - live, 0) as collapsed from (select count(*) filter (status = 'live') as live, coalesce(sum(seen_in_channels) filter (status = 'live'), 0)::bigint as seen from listings) a, (select max(posted_at) as last_capture, count(*) filter (processed_at is null) as pending from raw_messages) b")
def _(m):
    return counters.landing_totals(m.listings, m.raw_messages)


@query("a09_cluster_rollup", "select listing_id, min(price_etb) as min_etb, max(price_etb) as max_etb, count(distinct channel_id) as n_channels, arg_min(phone_normalized, (posted_at, raw_message_id)) filter (phone_normalized is not null) as first_phone from sightings group by listing_id")
def _(m):
    return counters.cluster_rollup(m.sightings)


@query("a10_ratings", "select seller_id, avg(score) as rating_avg, count(*) as rating_count from ratings group by seller_id")
def _(m):
    return counters.ratings_by_seller(m.ratings)


@query("a11_filter_options", "select distinct location_area from listings where status = 'live' and location_area is not null")
def _(m):
    return browse.filter_options(m.listings)


@query("a12_unread", "select v as viewer_id, count(*) filter (read_at is null and (sender_id is null or sender_id <> v)) as unread from (select id, unnest([buyer_id, seller_id]) as v from threads) t join messages m on m.conversation_id = t.id group by v")
def _(m):
    return messaging.inboxes(m.threads, m.messages)


@query("a13_over_threshold", "select listing_id, count(*) as n_reports from reports group by listing_id having count(*) >= 3")
def _(m):
    return counters.over_threshold(m.reports)


@query("a15_confidence_histogram", "with b as (select least(floor(extraction_confidence * 5 + 1e-9), 4)::int as bin from listings), c as (select bin, count(*) as n from b group by bin) select bin, n, floor(n * 35 / (select max(n) from c))::int as bar, round(100.0::double * n / (select sum(n) from c), 2) as pct from c")
def _(m):
    return counters.confidence_histogram(m.listings, "extraction_confidence")


@query("a16_hit_rates", "select count(*) as n, count(*) filter (regexp_matches(raw_text, '(^|[^[:word:]])@[a-zA-Z0-9_]{4,32}($|[^[:word:]])') or regexp_matches(raw_text, '(?i)t(elegram)?\\.me/[a-zA-Z0-9_]{4,32}')) as with_handle from raw_messages")
def _(m):
    rows = m.raw_messages.select(text.handles(F.col("raw_text")).alias("h"))
    return rows.agg(F.count("*").alias("n"), counters.count_if(F.size("h") > 0).alias("with_handle"))


@query("a14_extraction_metrics")
def _(m):
    rows = m.raw_messages.select(text.first_pass(F.col("raw_text")).alias("x"))
    c = counters.count_if
    return rows.agg(F.count("*").alias("messages"), c(F.col("x.has_price")).alias("with_price"), c(F.col("x.has_phone")).alias("with_phone"), c(F.col("x.has_handle")).alias("with_handle"), c(F.col("x.is_potential_listing")).alias("potential"))


@query("a17_field_coverage", "select round(100.0::double * count(price_etb) / count(*), 4) as price_etb_pct, round(100.0::double * count(category_slug) / count(*), 4) as category_slug_pct, round(100.0::double * count(condition) / count(*), 4) as condition_pct from listings")
def _(m):
    return counters.field_coverage(m.listings, ["price_etb", "category_slug", "condition"])


@query("a19_cluster_aggregates", "select listing_id, min(price_etb) as lowest_etb, greatest(1, count(distinct channel_id)) as n_channels from sightings group by listing_id")
def _(m):
    return m.sightings.groupBy("listing_id").agg(F.min("price_etb").alias("lowest_etb"), F.greatest(L(1), F.countDistinct("channel_id")).cast("long").alias("n_channels"))


@query("a20_paid_holds", "select buyer_id, count(*) filter (status in ('paid', 'completed')) as paid from reservations group by buyer_id")
def _(m):
    return holds.paid_counts(m.reservations)


@query("a20_buyer_list", "select id, status, created_at from reservations where buyer_id = 7 order by created_at desc, id limit 50")
def _(m):
    return holds.buyer_list(m.reservations, 7).select("id", "status", "created_at")


@query("a21_latency_summary", "select avg(value) as avg_ms, max(value) as max_ms, max(value) < 200 as passed from events where event_type = 'view'")
def _(m):
    return counters.latency_summary(m.events.where("event_type = 'view'").select(F.col("value").alias("ms")))


# -- ranking (W), paging (T) and sets (U) -----------------------------------------------------------------


@query("w01_first_per_listing", "with p as (select l.id, l.extraction_confidence, s.raw_message_id from sightings s join listings l on l.id = s.listing_id where l.status = 'queued' order by 2, 1, 3 limit 51) select id, extraction_confidence, min(raw_message_id) as raw_message_id from p group by 1, 2 order by 2, 1 limit 50")
def _(m):
    queued = m.listings.where("status = 'queued'").select("id", "extraction_confidence")
    probe = queued.join(m.sightings.select(F.col("listing_id").alias("id"), "raw_message_id"), "id").orderBy("extraction_confidence", "id", "raw_message_id").limit(51)
    return probe.groupBy("id", "extraction_confidence").agg(F.min("raw_message_id").alias("raw_message_id")).orderBy("extraction_confidence", "id").limit(50)


@query("w02_last_message", "select conversation_id, id, sender_id from (select *, row_number() over (partition by conversation_id order by created_at desc, id desc) as n from messages) where n = 1")
def _(m):
    return messaging.last_messages(m.messages)


@query("w03_price_rank", "select id, category_slug, row_number() over (partition by category_slug order by price_etb, id)::int as price_rank from listings where status = 'live' and price_etb is not null")
def _(m):
    return price.running_rank(m.listings)


@query("w04_newest_request", "select conversation_id, max(id) as id from messages where kind = 'payment_request' group by conversation_id")
def _(m):
    return m.messages.where("kind = 'payment_request'").groupBy("conversation_id").agg(F.max_by("id", F.struct("created_at", "id")).alias("id"))


@query("w05_trailing_hits", "select event_id as id, count(*) over (partition by user_id order by ts range between interval 1 hour preceding and interval 1 microsecond preceding) as in_window from events")
def _(m):
    hits = m.events.select(F.col("event_id").alias("id"), F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("ts"))
    return sessions.trailing_counts(hits, 3600).select("id", "in_window")


@query("w06_running_high_water", "select id, max(message_id) over (partition by channel_id order by posted_at desc, id rows unbounded preceding) as high_water from raw_messages")
def _(m):
    rows = m.raw_messages.select("id", "channel_id", "posted_at", "message_id")
    return ranking.running_max(rows, "channel_id", [F.desc("posted_at"), "id"], "message_id", "high_water").select("id", "high_water")


@query("w07_batches", "select id, channel_id, floor((n - 1) / 20)::int as batch, ((n - 1) % 20 + 1)::int as position from (select id, channel_id, row_number() over (partition by channel_id order by posted_at, id) as n from raw_messages)")
def _(m):
    n = F.col("n") - 1
    rows = ranking.numbered(m.raw_messages.select("id", "channel_id", "posted_at"), "channel_id", ["posted_at", "id"], "n")
    return rows.select("id", "channel_id", F.floor(n / 20).cast("int").alias("batch"), (n % 20 + 1).cast("int").alias("position"))


@query("t01_first_page", "select id, price_etb from listings where status = 'live' and price_etb is not null order by price_etb, id limit 25")
def _(m):
    return browse.keyset_page(m.listings.where(browse.conditions(browse.ListingQuery(sort="price_asc"))), "price_asc").select("id", "price_etb")


@query("t01_next_page", "select id, price_etb from listings where status = 'live' and price_etb is not null and (price_etb > 60000 or price_etb = 60000 and id > 100) order by price_etb, id limit 25")
def _(m):
    return browse.keyset_page(m.listings.where(browse.conditions(browse.ListingQuery(sort="price_asc"))), "price_asc", after=(60_000, 100)).select("id", "price_etb")


@query("t01_previous_page", "select id, price_etb from listings where status = 'live' and price_etb is not null and (price_etb < 60000 or price_etb = 60000 and id < 100) order by price_etb desc, id desc limit 25")
def _(m):
    return browse.keyset_page(m.listings.where(browse.conditions(browse.ListingQuery(sort="price_asc"))), "price_asc", before=(60_000, 100)).select("id", "price_etb")


@query("t01_newest_page", f"select id, cast(posted_at as string) as posted_at from listings where status = 'live' and (posted_at < date '{AS_OF}' or posted_at = date '{AS_OF}' and id < 500) order by listings.posted_at desc, id desc limit 25")
def _(m):
    return browse.keyset_page(m.listings.where(browse.conditions(browse.ListingQuery())), "newest", after=(AS_OF, 500)).select("id", F.col("posted_at").cast("string").alias("posted_at"))


@query("t02_page_count", "select count(*) as total, greatest(1, ceil(count(*) / 24))::bigint as pages from listings where status = 'live'")
def _(m):
    return browse.page_count(m.listings.where("status = 'live'"))


_PAGE24 = "(select id, row_number() over (order by id) as position from (select id from listings where status = 'live' order by id limit 24))"


@query(
    "t03_assemble",
    f"""with p as {_PAGE24},
s as (select listing_id, count(*)::int as n_sources, count(distinct channel_id)::int as n_channels, min(price_etb) as lowest_etb, arg_min(username, (-epoch(posted_at::timestamp), raw_message_id)) as newest_channel,
  arg_min(phone_normalized, (-confidence_score, raw_message_id)) filter (phone_normalized is not null) as phone from sightings join channels c on c.id = channel_id group by listing_id),
i as (select listing_id, count(*)::int as n_images, arg_min(r2_key, (sort_order, r2_key)) as cover from images group by listing_id),
r as (select seller_id, avg(score) as rating_avg, count(*)::int as rating_count from ratings group by seller_id)
select p.position::int as position, l.id, title_en, price_etb, name_en as category_label, coalesce(n_sources, 0) as n_sources, coalesce(n_channels, 0) as n_channels, lowest_etb, newest_channel, coalesce(n_images, 0) as n_images, cover, phone, rating_avg, coalesce(rating_count, 0) as rating_count
from p join listings l on l.id = p.id left join categories c on c.slug = l.category_slug left join s on s.listing_id = l.id left join i on i.listing_id = l.id left join r on r.seller_id = l.seller_id""",
)
def _(m):
    first = m.listings.where("status = 'live'").orderBy("id").limit(24).select("id")
    ids = first.withColumn("position", F.row_number().over(Window.orderBy("id")))
    return browse.assemble(ids, m.listings, m.categories, m.sightings, m.channels, m.images, m.ratings)


@query("t04_busiest_bucket", f"with {_STATS} select bucket_key, sample_size from stats order by sample_size desc, bucket_key limit 1")
def _(m):
    return _stats(m).select("bucket_key", "sample_size").orderBy(F.desc("sample_size"), "bucket_key").limit(1)


@query("t07_nearest", "with q as (select embedding as e from embeddings where vec_id = 0) select vec_id, round(list_cosine_similarity(embedding::double[], e::double[]), 6) as score from embeddings, q order by list_cosine_similarity(embedding::double[], e::double[]) desc, vec_id limit 24")
def _(m):
    first = m.embeddings.where("vec_id = 0").select("embedding").first()["embedding"]
    return search.nearest(m.embeddings, first).select("vec_id", F.round("score", 6).alias("score"))


@query("u01_union_all", "select id from listings where tier = 'claimed' union all select id from listings where status = 'live'")
def _(m):
    return m.listings.where("tier = 'claimed'").select("id").unionByName(m.listings.where("status = 'live'").select("id"))


@query("u02_token_sets", "select id, array_to_string(list_sort(list_distinct(list_concat(string_split(title_en, ' '), ['sale', 'ring']))), ' ') as tokens from listings")
def _(m):
    return m.listings.select("id", F.array_join(F.array_sort(F.array_union(F.split("title_en", " "), F.array(L("sale"), L("ring")))), " ").alias("tokens"))


@query("u03_distinct_in_order", "select id, len(list_distinct(string_split(body, ' '))) as n from messages")
def _(m):
    return m.messages.select("id", F.size(F.array_distinct(F.split("body", " "))).cast("long").alias("n"))
