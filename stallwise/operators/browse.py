"""Browsing: filters, keyset pages and row assembly."""

from __future__ import annotations

import base64
import json
from collections.abc import Mapping
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A price filter at or above this is no filter; rows on a page.
MAX_PRICE_FILTER, PAGE = 150_000, 24

#: Spellings of places by their canonical name, fixed values.
AREA_SPELLINGS: dict[str, tuple[str, ...]] = {
    "Bole": ("bole", "ቦሌ"),
    "Piassa": ("piassa", "piazza", "ፒያሳ"),
    "Merkato": ("merkato", "mercato", "መርካቶ"),
    "Megenagna": ("megenagna", "megenagn", "መገናኛ"),
    "Sarbet": ("sarbet", "ሳርቤት"),
    "CMC": ("cmc", "ሲኤምሲ"),
    "Gerji": ("gerji", "ገርጂ"),
    "Kazanchis": ("kazanchis", "ካዛንቺስ"),
    "Ayat": ("ayat", "አያት"),
    "Summit": ("summit", "ሰሚት"),
    "Lebu": ("lebu", "ለቡ"),
    "Saris": ("saris", "ሳሪስ"),
    "Jemo": ("jemo", "ጀሞ"),
    "Kolfe": ("kolfe", "ኮልፌ"),
    "Shiro Meda": ("shiro meda", "shiromeda", "ሽሮ ሜዳ"),
    "Arat Kilo": ("arat kilo", "4 kilo", "አራት ኪሎ"),
    "Gurd Shola": ("gurd shola", "ጉርድ ሾላ"),
    "Hayahulet": ("hayahulet", "22", "ሃያሁለት"),
    "Kality": ("kality", "ቃሊቲ"),
    "Old Airport": ("old airport", "ኦልድ ኤርፖርት"),
    "Ayer Tena": ("ayer tena", "አየር ጤና"),
    "Torhailoch": ("torhailoch", "ቶር ሃይሎች"),
    "Mexico": ("mexico", "ሜክሲኮ"),
}


@dataclass(frozen=True)
class ListingQuery:
    """Filters and order of a browse page; empty fields filter nothing."""

    q: str | None = None
    category: str | None = None
    conditions: tuple[str, ...] = ()
    tiers: tuple[str, ...] = ()
    area: str | None = None
    min_price: int | None = None
    max_price: int | None = None
    sort: str = "newest"
    extra: Mapping[str, str] = field(default_factory=dict)


#: Sort name: column, descending, whether rows without a price are left out.
SORTS = {"newest": ("posted_at", True, False), "oldest": ("posted_at", False, False), "price_asc": ("price_etb", False, True), "price_desc": ("price_etb", True, True)}


def area_aliases(area: str) -> list[str]:
    """Every stored spelling of a place, itself first, without repeats."""
    by_spelling = {s: name for name, all_ in AREA_SPELLINGS.items() for s in all_}
    name = by_spelling.get(area.strip().lower(), area)
    all_ = AREA_SPELLINGS.get(name, ())
    return list(dict.fromkeys([area, name, *all_, *(s[:1].upper() + s[1:] for s in all_)]))


def conditions(query: ListingQuery, text: Column | None = None) -> Column:
    """The conjunction of a query's filters; ``text`` is the full-text predicate of ``q``, if any."""
    parts = [F.col("status") == "live"]
    if query.q and text is not None:
        parts.append(text)
    if query.category:
        parts.append(F.col("category_slug") == query.category)
    if query.conditions:
        parts.append(F.col("condition").isin(*query.conditions))
    if query.tiers:
        parts.append(F.col("tier").isin(*query.tiers))
    if query.area:
        parts.append(F.col("location_area").isin(*area_aliases(query.area)))
    if query.min_price is not None:
        parts.append(F.col("price_etb") >= query.min_price)
    if query.max_price is not None and query.max_price < MAX_PRICE_FILTER:
        parts.append(F.col("price_etb") <= query.max_price)
    if query.min_price is not None or query.max_price is not None or SORTS[query.sort][2]:
        parts.append(F.col("price_etb").isNotNull())
    return reduce(lambda a, b: a & b, parts)


def active_filters(query: ListingQuery) -> int:
    """Filters in effect; a minimum of 0 and an unbounded maximum are none."""
    return sum([bool(query.category), bool(query.area), bool(query.conditions), bool(query.tiers), bool(query.min_price), query.max_price is not None and query.max_price < MAX_PRICE_FILTER])


def parse_query(params: Mapping[str, str | list[str]]) -> ListingQuery:
    """URL parameters as a query; unknown names, sorts, tiers and conditions and numbers that are not finite go."""
    many = lambda k: [v for v in (params.get(k) if isinstance(params.get(k), list) else str(params.get(k) or "").split(",")) if v]

    def number(k: str) -> int | None:
        try:
            return int(float(str(params.get(k)))) if params.get(k) not in (None, "") else None
        except (ValueError, OverflowError):
            return None

    return ListingQuery(
        q=str(params.get("q") or "").strip() or None, category=str(params.get("category") or "") or None, area=str(params.get("area") or "") or None,
        conditions=tuple(c for c in many("condition") if c in ("brand_new", "lightly_used", "fair")), tiers=tuple(t for t in many("tier") if t in ("indexed", "claimed", "verified")),
        min_price=number("minPrice"), max_price=number("maxPrice"), sort=str(params.get("sort")) if params.get("sort") in SORTS else "newest",
    )


def encode_cursor(value: object, id_: int) -> str:
    return base64.urlsafe_b64encode(json.dumps([value, id_], separators=(",", ":")).encode()).decode().rstrip("=")


def decode_cursor(cursor: str) -> tuple[object, int] | None:
    try:
        value, id_ = json.loads(base64.urlsafe_b64decode(cursor + "=" * (-len(cursor) % 4)))
        return value, id_
    except (ValueError, TypeError):
        return None


def keyset_page(rows: DataFrame, sort: str = "newest", after: tuple[object, int] | None = None, before: tuple[object, int] | None = None, size: int = PAGE) -> DataFrame:
    """One page and a row more, seen from the cursor: (sort value, id) structs are compared as a whole.

    Going backward reads in the opposite order; ``position`` numbers the page's rows in page order, from 1. The probe
    row, where there is one, is the row furthest from the cursor. Only ``size`` + 1 rows leave the executors' top-k.
    """
    column, down, _ = SORTS[sort]
    key = F.struct(F.col(column), F.col("id"))
    backward = before is not None
    cursor = before if backward else after
    reading_down = down != backward
    if cursor is not None:
        at = F.struct(F.lit(cursor[0]).cast(rows.schema[column].dataType).alias(column), F.lit(cursor[1]).cast("long").alias("id"))
        rows = rows.where(key < at if reading_down else key > at)
    order = [F.col(column).desc_nulls_last(), F.col("id").desc()] if reading_down else [F.col(column).asc_nulls_last(), F.col("id").asc()]
    return rows.orderBy(*order).limit(size + 1)


def page_count(rows: DataFrame, size: int = PAGE) -> DataFrame:
    return rows.agg(F.count("*").alias("total"), F.greatest(F.lit(1), F.ceil(F.count("*") / size)).cast("long").alias("pages"))


def assemble(ids: DataFrame, listings: DataFrame, categories: DataFrame, sightings: DataFrame, channels: DataFrame, images: DataFrame, ratings: DataFrame) -> DataFrame:
    """Rows of ``ids`` (id, position) with category label, sources, images, best phone and seller rating.

    Sources are newest first, images by sort order; of equally confident phones the lowest message id counts.
    Side tables are reduced to the page's ids before they are aggregated.
    """
    wanted = F.broadcast(ids)
    source = sightings.join(wanted.select(F.col("id").alias("listing_id")), "listing_id", "left_semi").join(F.broadcast(channels.select(F.col("id").alias("channel_id"), "username")), "channel_id")
    sources = source.groupBy("listing_id").agg(
        F.count("*").cast("int").alias("n_sources"), F.countDistinct("channel_id").cast("int").alias("n_channels"), F.min("price_etb").alias("lowest_etb"),
        F.min_by("username", F.struct((-F.unix_date("posted_at")).alias("d"), "raw_message_id")).alias("newest_channel"),
        F.min_by("phone_normalized", F.when(F.col("phone_normalized").isNotNull(), F.struct((-F.col("confidence_score")).alias("c"), F.col("raw_message_id")))).alias("phone"),
    )
    picture = images.join(wanted.select(F.col("id").alias("listing_id")), "listing_id", "left_semi").groupBy("listing_id").agg(F.count("*").cast("int").alias("n_images"), F.min_by("r2_key", F.struct("sort_order", "r2_key")).alias("cover"))
    rating = ratings.groupBy("seller_id").agg(F.avg("score").alias("rating_avg"), F.count("*").cast("int").alias("rating_count"))
    label = F.broadcast(categories.select(F.col("slug").alias("category_slug"), F.col("name_en").alias("category_label")))
    rows = listings.join(wanted, "id").join(label, "category_slug", "left").join(sources, F.col("id") == sources["listing_id"], "left").drop("listing_id").join(picture, F.col("id") == picture["listing_id"], "left").drop("listing_id")
    live = F.col("status") == "live"
    return rows.join(rating, "seller_id", "left").select(
        "position", "id", "title_en", "price_etb", "category_label", F.coalesce("n_sources", F.lit(0)).alias("n_sources"), F.coalesce("n_channels", F.lit(0)).alias("n_channels"), "lowest_etb", "newest_channel",
        F.coalesce("n_images", F.lit(0)).alias("n_images"), "cover", F.when(live, F.col("phone")).alias("phone"), "rating_avg", F.coalesce("rating_count", F.lit(0)).alias("rating_count"),
    )


def related(listings: DataFrame, id_: int, limit: int = 4) -> DataFrame:
    """Live listings of the same category as ``id_``, itself aside, newest first."""
    own = F.broadcast(listings.where(F.col("id") == id_).select(F.col("category_slug").alias("_category")))
    return listings.where((F.col("status") == "live") & (F.col("id") != id_)).join(own, F.col("category_slug") == F.col("_category"), "left_semi").orderBy(F.desc("posted_at"), "id").limit(limit)


def filter_options(listings: DataFrame) -> DataFrame:
    """Areas of live listings."""
    return listings.where((F.col("status") == "live") & F.col("location_area").isNotNull()).select("location_area").distinct()
