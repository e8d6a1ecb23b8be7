"""Price statistics: bucket quartiles with trimming, the widening ladder and verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stallwise.operators import ranking
from stallwise.session import checkpoint

#: Least samples of a bucket by use, and the trimming and outlier rules; fixed values.
MIN_SAMPLE, MODERATION_MIN_SAMPLE, AUTOFILL_MIN_SAMPLE, TRIM_MIN_SAMPLE, OUTLIER_RATIO = 8, 5, 5, 12, 0.3


def best_term(listings: DataFrame, synonyms: DataFrame) -> DataFrame:
    """``listings`` with ``term``: the canonical of the longest synonym that the titles contain, in the category.

    Titles are compared in lower case. Of equally long synonyms the first canonical in binary order wins. The synonym
    table is a dictionary of a few hundred rows, so the containment join broadcasts it.
    """
    title = F.lower(F.concat_ws(" ", F.coalesce("title_en", F.lit("")), F.coalesce("title_am", F.lit(""))))
    word = F.broadcast(synonyms.select(F.col("canonical_term").alias("_term"), F.lower("synonym").alias("_word"), F.col("category_slug").alias("_category")))
    hits = listings.select("id", "category_slug", title.alias("_title")).join(word, (F.col("_category") == F.col("category_slug")) & F.contains("_title", "_word"))
    best = hits.groupBy("id").agg(F.min(F.struct((-F.length("_word")).alias("n"), F.col("_term").alias("term"))).alias("x")).select("id", F.col("x.term").alias("term"))
    return listings.join(best, "id", "left")


def bucket_keys(category: Column, condition: Column, term: Column) -> Column:
    """Array of (key, scope, rank) rungs, most specific first; rungs with an unknown part are null."""
    rung = lambda rank, kind, name, cond, scope: F.struct(
        F.concat(F.lit(f"{kind}:"), name, F.lit("|cond:"), cond).alias("bucket_key"), F.lit(scope).alias("scope"), F.lit(rank).alias("rank")
    )
    any_ = F.lit("*")
    rungs = F.array(rung(0, "term", term, condition, "term+condition"), rung(1, "term", term, any_, "term"), rung(2, "cat", category, condition, "category+condition"), rung(3, "cat", category, any_, "category"))
    return F.filter(rungs, lambda r: r["bucket_key"].isNotNull())


def price_counts(listings: DataFrame) -> DataFrame:
    """(bucket_key, scope, price_etb, n) of live, priced ``listings`` (with ``term``): how often each bucket has each price.

    Counts of separate sets of listings add up, so yesterday's can be kept and today's merged into them.
    """
    live = listings.where((F.col("status") == "live") & (F.col("price_etb") > 0))
    each = live.select("price_etb", F.explode(bucket_keys(F.col("category_slug"), F.col("condition"), F.col("term"))).alias("b"))
    return each.groupBy("b.bucket_key", "b.scope", "price_etb").agg(F.count("*").alias("n"))


def _quantiles(summed: DataFrame, spans: DataFrame, shares: dict[str, float]) -> DataFrame:
    """For each bucket of ``spans`` (bucket_key, first, k), the quantiles of its ``k`` prices from rank ``first`` (0 is the lowest) on.

    ``summed`` has each price's count ``n`` and the count ``upto`` it. A quantile lies between the prices at two ranks, columns
    ``{name}_lo`` and ``{name}_hi``, by the part ``{name}_f``.
    """
    aggs = []
    for name, share in shares.items():
        at = (F.col("k") - 1) * F.lit(share)
        for end, rank in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            rank = F.col("first") + rank
            aggs.append(F.max(F.when((F.col("upto") - F.col("n") <= rank) & (rank < F.col("upto")), F.col("price_etb"))).alias(f"{name}_{end}"))
        aggs.append(F.max(at - F.floor(at)).alias(f"{name}_f"))
    return summed.join(spans, "bucket_key").groupBy("bucket_key").agg(*aggs)


def _between(name: str, f=lambda c: c) -> Column:
    low, high, part = f(F.col(f"{name}_lo").cast("double")), f(F.col(f"{name}_hi").cast("double")), F.col(f"{name}_f")
    return low + (high - low) * part


def price_stats(listings: DataFrame) -> DataFrame:
    return stats_of_counts(price_counts(listings))


def stats_of_counts(counts: DataFrame) -> DataFrame:
    """Statistics of each bucket of ``price_counts``.

    Prices beyond three interquartile ranges go from buckets of ``TRIM_MIN_SAMPLE`` or more. Quartiles interpolate and
    round ties to even; fences are Tukey's in log space, the low one at least 1.

    Quantiles are exact and no bucket is gathered: running sums of counts in ranges of (bucket, price) say where each rank lies,
    and the prices that are kept are a run of ranks, so both passes read the same sums.
    """
    summed = checkpoint(ranking.running_sum(counts, "bucket_key", ["price_etb"], "n", "upto"))
    totals = summed.groupBy("bucket_key", "scope").agg(F.sum("n").alias("raw_n"))
    raw = _quantiles(summed, totals.select("bucket_key", F.lit(0).cast("long").alias("first"), F.col("raw_n").alias("k")), {"q1": 0.25, "q3": 0.75})
    bounds = totals.join(raw, "bucket_key").select("bucket_key", "scope", "raw_n", _between("q1").alias("q1"), _between("q3").alias("q3"))
    spread = 3 * (F.col("q3") - F.col("q1"))
    keeps = (F.col("raw_n") < TRIM_MIN_SAMPLE) | F.col("price_etb").between(F.col("q1") - spread, F.col("q3") + spread)
    kept = checkpoint(
        summed.drop("scope").join(bounds, "bucket_key").where(keeps).groupBy("bucket_key", "scope", "raw_n")
        .agg(F.sum("n").alias("k"), F.min(F.col("upto") - F.col("n")).alias("first"), F.min("price_etb").alias("min_etb"), F.max("price_etb").alias("max_etb"))
    )
    found = kept.join(_quantiles(summed, kept.select("bucket_key", "first", "k"), {"p25": 0.25, "p50": 0.5, "p75": 0.75}), "bucket_key")
    whole = lambda c: F.rint(c).cast("int")
    l25, l75 = _between("p25", F.log), _between("p75", F.log)
    reach = 1.5 * (l75 - l25)
    return found.select(
        "bucket_key", "scope", F.col("raw_n").cast("int").alias("raw_sample_size"), F.col("k").cast("int").alias("sample_size"), (F.col("raw_n") - F.col("k")).cast("int").alias("trimmed_count"),
        whole(_between("p50")).alias("median_etb"), whole(_between("p25")).alias("p25_etb"), whole(_between("p75")).alias("p75_etb"), "min_etb", "max_etb",
        F.greatest(F.lit(1), whole(F.exp(l25 - reach))).alias("low_fence_etb"), whole(F.exp(l75 + reach)).alias("high_fence_etb"),
    )


def ladder(listings: DataFrame, stats: DataFrame, min_sample: int, scopes: tuple[str, ...] | None = None) -> DataFrame:
    """``listings`` with the statistics of their first rung that has ``min_sample`` samples; nulls where none has."""
    rungs = listings.select("id", F.explode(bucket_keys(F.col("category_slug"), F.col("condition"), F.col("term"))).alias("b")).select("id", "b.bucket_key", "b.rank")
    usable = stats.where(F.col("sample_size") >= min_sample)
    if scopes:
        usable = usable.where(F.col("scope").isin(*scopes))
    names = [c for c in stats.columns]
    found = rungs.join(usable, "bucket_key").groupBy("id").agg(F.min_by(F.struct(*names), "rank").alias("s"))
    return listings.join(found.select("id", "s.*"), "id", "left")


def verdict(price: Column) -> tuple[Column, Column]:
    """(verdict, outlier) of a price against its row's bucket; outliers are claimed for term buckets only."""
    precise = F.col("scope").isin("term", "term+condition")
    low = precise & ((price < F.col("low_fence_etb")) | (price < F.col("median_etb") * OUTLIER_RATIO))
    high = precise & (price > F.col("high_fence_etb"))
    name = F.when(low, "suspicious").when(high, "above").when(price < F.col("p25_etb"), "below").when(price > F.col("p75_etb"), "above").otherwise("fair")
    return name, F.when(low, "low").when(high, "high")


def price_context(listings: DataFrame, stats: DataFrame, min_sample: int = MIN_SAMPLE) -> DataFrame:
    """For each listing that is not removed why there is no context, or its verdict, outlier and delta in percent."""
    found = ladder(listings.where(F.col("status") != "removed"), stats, min_sample)
    reason = F.when(F.col("price_etb").isNull(), "no_price").when(F.col("category_slug").isNull() & F.col("term").isNull(), "no_category").when(F.col("bucket_key").isNull(), "insufficient_sample")
    name, outlier = verdict(F.col("price_etb"))
    known = reason.isNull()
    delta = F.floor((F.col("price_etb") - F.col("median_etb")) / F.col("median_etb") * 100 + 0.5).cast("int")
    when = lambda c: F.when(known, c)
    return found.select("id", reason.alias("reason"), when(F.col("scope")).alias("basis"), when(F.col("sample_size")).alias("sample_size"), when(name).alias("verdict"), when(outlier).alias("outlier"), when(delta).alias("delta_pct"))


def suggestion(listings: DataFrame, stats: DataFrame) -> DataFrame:
    """A seller's price suggestion from category buckets of ``AUTOFILL_MIN_SAMPLE`` or more."""
    found = ladder(listings, stats, AUTOFILL_MIN_SAMPLE, ("category+condition", "category"))
    return found.where(F.col("bucket_key").isNotNull()).select("id", "bucket_key", "median_etb", "p25_etb", "p75_etb", "sample_size")


def stale(stats_max: Column, as_of: Column, ttl_seconds: int = 900) -> Column:
    """Whether statistics of ``stats_max`` (seconds) need a refresh: there are none, or they are older than the TTL."""
    return stats_max.isNull() | (stats_max < as_of - ttl_seconds)


def bucket_summary(stats: DataFrame) -> DataFrame:
    """Buckets, usable ones, and categories and terms with a usable bucket."""
    usable = F.col("sample_size") >= MIN_SAMPLE
    kind, name = F.substring_index("bucket_key", ":", 1), F.regexp_extract("bucket_key", "^[a-z]+:(.*)\\|cond:", 1)
    return stats.agg(
        F.count("*").alias("buckets"), F.count(F.when(usable, 1)).alias("usable"), F.countDistinct(F.when(usable & (kind == "cat"), name)).alias("categories"),
        F.countDistinct(F.when(usable & (kind == "term"), name)).alias("terms"),
    )


def running_rank(listings: DataFrame) -> DataFrame:
    """Each live priced listing's price rank in its category, cheapest first, ties by id."""
    live = listings.where((F.col("status") == "live") & F.col("price_etb").isNotNull()).select("id", "category_slug", "price_etb")
    return ranking.numbered(live, "category_slug", ["price_etb", "id"], "price_rank").select("id", "category_slug", F.col("price_rank").cast("int").alias("price_rank"))
