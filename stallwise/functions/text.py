"""Deterministic text rules as Column functions: phones, handles, prices, flags, masks, slugs and formats.

Java's classes are ASCII by default; patterns that read Amharic use ``(?U)``.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and word lists that results depend on, fixed values.
PHONE = r"(?U)(?<!\d)(?:(?:\+|00)?251[\s.-]?[97](?:[\s.-]?\d){8}|0[97](?:[\s.-]?\d){8}|(?:\b[97](?:[\s.-]?\d){8}\b))(?!\d)"
HANDLE = r"(?U)(?<!\w)@([a-zA-Z0-9_]{4,32})(?!\w)"
LINK = r"(?i)(?:https?://)?(?:t(?:elegram)?\.me)/([a-zA-Z0-9_]{4,32})"
CURRENCY = r"(?:ብር|birr|br|etb|dollar|\$)"
PRICE_WORDS = r"(?:ዋጋ|መነሻ|መነሻ\s*ዋጋ|price|fixed\s*price|fixed|ዋጋው)"
UNIT = r"k|ሺ|ሺህ|ሽ|m|ሚሊዮን|ሚ"
NUMBER = r"\d{1,3}(?:,\d{3})+|\d+(?:\.\d+)?"
WITH_UNIT = rf"(?iuU)(?<!\w)(\d+(?:[.,]\d+)?)\s*({UNIT})(?:\s*{CURRENCY})?(?!\w)"
WITH_CURRENCY = rf"(?iuU)(?<!\w)({NUMBER})\s*{CURRENCY}(?!\w)"
WITH_PREFIX = rf"(?iuU){PRICE_WORDS}[\s:፡-]*({NUMBER})\s*({UNIT})?(?:\s*{CURRENCY})?"
BARE_NUMBER = r"(?U)(?<!\w)(\d{1,3}(?:,\d{3})+)(?!\w)"
DISPLAY = r"(?iuU)(?:uhd|hdr|oled|qled|\bled\b|resolution|\btv\b|monitor|projector|camera|inch|ኢንች|ቲቪ|ቴሌቪዥን|ካሜራ|ስክሪን|screen|display)"
NEGOTIABLE = r"(?iuU)(?:የሚደራደር|ድርድር|ይደራደራል|መነሻ\s*ዋጋ|negotiable|neg)"
PROMOTION = r"(?iuU)cross\s*promo|ፕሮሞሽን|ለማስተዋወቅ|join\s*our\s*channel|ቻናላችንን\s*ይቀላቀሉ|^[\s\W]*welcome[\s\W]*$"
# What a match of the patterns above must contain, in forms that are quick to rule out; digits are those that the patterns read.
DIGIT, GROUPED = r"\p{Nd}", r"\p{Nd},\p{Nd}"
SUBSCRIBER = r"(?U)[97](?:[\s.-]?\d){8}"
UNIT_BEHIND, CURRENCY_BEHIND = rf"(?iuU)\d\s*(?:{UNIT})", rf"(?iuU)\d\s*{CURRENCY}"
LEAST_PRICE, MOST_PRICE = 50, 150_000_000


def _matches(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _clean(text: Column) -> Column:
    return F.replace(F.coalesce(text, F.lit("")), F.lit("\u00a0"), F.lit(" "))


def _has(text: Column, *words: str) -> Column:
    """Whether a text contains one of the words, given in lower case."""
    return bind(F.lower(text), lambda t: reduce(or_, [t.contains(w) for w in words]))


def normalise_phone(raw: Column) -> Column:
    """``+251`` and nine digits from local, international and bare forms; null for others."""
    d = F.regexp_replace(raw, r"\D", "")
    n = F.length(d)
    local = F.substring(d, 1, 1).isin("9", "7")
    return (
        F.when(d.startswith("251") & (n == 12), F.concat(F.lit("+"), d)).when(d.rlike("^0[97]") & (n == 10), F.concat(F.lit("+251"), F.substring(d, 2, 20)))
        .when((n == 9) & local, F.concat(F.lit("+251"), d)).when(d.startswith("00251") & (n == 14), F.concat(F.lit("+"), F.substring(d, 3, 20)))
    )


def strict_phone(raw: Column) -> Column:
    """Like ``normalise_phone`` for typed input: the subscriber number must start with 9 or 7."""
    d = F.regexp_replace(raw, r"[^0-9+]", "")
    tail = F.regexp_extract(d, r"^(?:\+?251|0)?([79][0-9]{8})$", 1)
    return F.when(tail != "", F.concat(F.lit("+251"), tail))


def bind(value: Column, f) -> Column:
    """``f`` of a value that it reads many times and that is computed once a row."""
    return F.transform(F.array(value), f)[0]


def _numbers(text: Column) -> Column:
    """(raw, normalised) of each written number of a clean text, repeated ones too; texts without a subscriber's nine digits are not searched."""
    found = F.when(text.rlike(SUBSCRIBER), _matches(text, PHONE)).otherwise(F.array().cast("array<string>"))
    return F.filter(F.transform(found, lambda m: F.struct(F.trim(m).alias("raw"), normalise_phone(m).alias("normalised"))), lambda x: x["normalised"].isNotNull())


def _first_forms(numbers: Column) -> Column:
    nothing = F.array().cast("array<struct<raw:string,normalised:string>>")
    distinct = lambda all_: F.aggregate(all_, nothing, lambda kept, x: F.when(F.exists(kept, lambda y: y["normalised"] == x["normalised"]), kept).otherwise(F.concat(kept, F.array(x))))
    return bind(numbers, lambda n: F.when(F.size(n) < 2, n).otherwise(distinct(n)))


def phones(text: Column) -> Column:
    """(raw, normalised) of each distinct normalised number, first raw form first."""
    return bind(_clean(text), lambda t: _first_forms(_numbers(t)))


def handles(text: Column) -> Column:
    """Sorted distinct @handles, those of t.me links among them."""

    def of(t: Column) -> Column:
        none = F.array().cast("array<string>")
        at = F.when(t.contains("@"), _matches(t, HANDLE, 1)).otherwise(none)
        link = F.when(t.rlike(r"\.[mM][eE]/"), _matches(t, LINK, 1)).otherwise(none)
        return F.concat(at, link)

    both = bind(F.coalesce(text, F.lit("")), of)
    return F.array_sort(F.array_distinct(F.transform(both, lambda h: F.concat(F.lit("@"), h))))


def price_value(number: Column, unit: Column) -> Column:
    """A number with its unit in whole birr, ties to even; null outside the sane bounds."""
    u = F.lower(F.coalesce(unit, F.lit("")))
    factor = F.when(u.isin("k", "ሺ", "ሺህ", "ሽ"), 1_000).when(u.isin("m", "ሚሊዮን", "ሚ"), 1_000_000).otherwise(1)
    value = F.rint(F.regexp_replace(number, ",", "").try_cast("double") * factor)
    return F.when(value.between(LEAST_PRICE, MOST_PRICE), value.cast("int"))


def price(text: Column) -> Column:
    """(etb, raw) of the first valid amount: with a unit, with a currency, after a price word, or grouped in thousands.

    A single digit and k is a resolution where the text speaks of displays; a bare number counts only beside
    a currency or price word.
    """


    def of(t: Column) -> Column:
        def first(pattern: str, units: bool, skip_spec: bool = False) -> Column:
            # a match alone has the groups that it has in its text: what stands around it only bounds where it ends
            part = lambda raw, n: F.regexp_extract(raw, pattern, n)
            read = lambda raw: F.struct(price_value(part(raw, 1), part(raw, 2) if units else F.lit("")).alias("etb"), F.trim(raw).alias("raw"))
            raws = _matches(t, pattern)
            if skip_spec:
                raws = F.filter(raws, lambda r: ~(F.trim(r).rlike(r"(?i)^[2458]\s*k$") & t.rlike(DISPLAY)))
            rows = F.filter(F.transform(raws, read), lambda x: x["etb"].isNotNull())
            return F.get(rows, F.lit(0))

        # each later rule is tried only where those before it find nothing; the letters ı and İ match i too
        unit = F.when(t.rlike(UNIT_BEHIND), first(WITH_UNIT, True, skip_spec=True))
        currency = F.when(t.rlike(CURRENCY_BEHIND), first(WITH_CURRENCY, False))
        prefix = F.when(_has(t, "ዋጋ", "መነሻ", "price", "fixed") | t.rlike("[ıİ]"), first(WITH_PREFIX, True))
        bare = F.when(t.rlike(GROUPED) & (t.rlike(f"(?iu){CURRENCY}") | t.rlike(f"(?iu){PRICE_WORDS}")), first(BARE_NUMBER, False))
        return F.when(t.rlike(DIGIT), F.coalesce(unit, currency, prefix, bare))

    return bind(_clean(text), of)


def negotiable(text: Column) -> Column:
    return bind(F.coalesce(text, F.lit("")), lambda t: _has(t, "የሚደራደር", "ድርድር", "ይደራደራል", "መነሻ", "neg") & t.rlike(NEGOTIABLE))


def promotion(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).rlike(PROMOTION)


def first_pass(text: Column) -> Column:
    """All of the above for one message as a struct of 13 fields; negotiable is null without price or token."""

    def of(t: Column) -> Column:
        return bind(F.struct(price(t).alias("found"), phones(t).alias("numbers"), handles(t).alias("names"), negotiable(t).alias("negotiable")), lambda x: fields(t, x))

    def fields(t: Column, x: Column) -> Column:
        found, numbers, names = x["found"], x["numbers"], x["names"]
        has_price, has_phone = found.isNotNull(), F.size(numbers) > 0
        # words are counted for texts with a phone only; promotion is looked for in what may be a listing otherwise
        words = lambda: F.size(F.filter(F.split(t, r"(?U)\s+"), lambda w: w != ""))
        listing = (has_price | (has_phone & ~t.startswith("http") & (words() >= 4))) & ~promotion(t)
        return F.struct(
            found["etb"].alias("price_etb"), found["raw"].alias("price_raw"), F.when(has_price | x["negotiable"], x["negotiable"]).alias("negotiable"), F.lit("ETB").alias("currency"),
            F.get(numbers, F.lit(0))["raw"].alias("phone_raw"), F.get(numbers, F.lit(0))["normalised"].alias("phone_normalized"),
            F.transform(numbers, lambda x: x["raw"]).alias("all_phones"), F.transform(numbers, lambda x: x["normalised"]).alias("all_phones_normalized"), names.alias("handles"),
            has_price.alias("has_price"), has_phone.alias("has_phone"), (F.size(names) > 0).alias("has_handle"), (listing & (t != "")).alias("is_potential_listing"),
        )

    return bind(F.trim(F.coalesce(text, F.lit(""))), of)


def mask(text: Column) -> Column:
    """(masked, phones, handles): every matching span becomes [PHONE] or [USER] with its subject's number.

    Each written form of a number is masked, so nothing that the finder knows is left.
    """

    def put(acc: Column, raw: Column, token: Column) -> Column:
        return F.replace(acc, raw, token)

    def masked(t: Column, numbers: Column, all_numbers: Column, names: Column) -> Column:
        known = F.transform(numbers, lambda y: y["normalised"])
        each = lambda known: F.reverse(F.array_sort(F.transform(all_numbers, lambda x: F.struct(F.length(x["raw"]).alias("n"), x["raw"].alias("raw"), F.array_position(known, x["normalised"]).alias("k")))))
        out = F.aggregate(bind(known, each), t, lambda acc, x: put(acc, x["raw"], F.concat(F.lit("[PHONE_"), x["k"].cast("string"), F.lit("]"))))
        named = F.reverse(F.array_sort(F.transform(names, lambda h, i: F.struct(F.length(h).alias("n"), h.alias("h"), (i + 1).alias("k")))))
        user = lambda x: F.concat(F.lit("[USER_"), x["k"].cast("string"), F.lit("]"))
        link = lambda x: F.concat(F.lit(r"(?i)(?:https?://)?t(?:elegram)?\.me/"), F.substring(x["h"], 2, 40), F.lit(r"(?![A-Za-z0-9_])"))

        def unnamed(named: Column) -> Column:
            at = F.aggregate(named, out, lambda acc, x: put(acc, x["h"], user(x)))
            return F.aggregate(named, at, lambda acc, x: F.regexp_replace(acc, link(x), user(x)))

        return F.struct(F.when(F.size(names) > 0, bind(named, unnamed)).otherwise(out).alias("masked"), F.transform(numbers, lambda x: x["raw"]).alias("phones"), names.alias("handles"))

    def of(t: Column) -> Column:
        found = bind(_numbers(t["clean"]), lambda all_: F.struct(_first_forms(all_).alias("first"), all_.alias("all")))
        return bind(F.struct(found.alias("p"), handles(t["own"]).alias("names")), lambda x: masked(t["clean"], x["p"]["first"], x["p"]["all"], x["names"]))

    return bind(F.struct(_clean(text).alias("clean"), text.alias("own")), of)


def leaks(masked: Column) -> Column:
    """Whether a masked text still holds a phone or a handle."""
    t = F.regexp_replace(masked, r"\[(PHONE|USER)_[0-9]+\]", " ")
    return bind(t, lambda t: (F.size(phones(t)) > 0) | (F.size(handles(t)) > 0))


def reattach(value: Column, mapping: Column) -> Column:
    """A token's raw value; for another value the value of the least token, placeholders without one being dropped."""
    least = F.element_at(mapping, F.array_min(F.map_keys(mapping)))
    known = F.try_element_at(mapping, value)
    return F.when(value.isNull(), None).otherwise(F.coalesce(known, F.when(value.rlike(r"^\[(PHONE|USER)_[0-9]+\]$"), F.when(F.size(mapping) > 0, least)).otherwise(value)))


def content_hash(text: Column) -> Column:
    return F.sha2(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " ")), 256)


def strip_contact_lines(text: Column) -> Column:
    """A text without its lines from a contact word on."""
    return F.trim(F.regexp_replace(text, r"(?imU)^\s*(?:contact|call|phone|tel|inbox|ስልክ|ይደውሉ|አድራሻ)\b.*$", ""))


def slug_unicode(title: Column, id_: Column) -> Column:
    body = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(title, F.lit(""))), r"(?U)[^\w\s-]", ""), r"(?U)[\s_-]+", "-")
    body = F.regexp_replace(body, "^-+|-+$", "")
    return F.concat_ws("-", F.substring(F.when(body == "", "item").otherwise(body), 1, 60), id_.cast("string"))


def slug_ascii(title: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(title), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def mask_phone(phone: Column) -> Column:
    """First four and last two characters, at least three stars between; up to six characters stay."""
    n = F.length(phone)
    return F.when(n <= 6, phone).otherwise(F.concat(F.substring(phone, 1, 4), F.rpad(F.lit(""), F.greatest(n - 6, F.lit(3)), "*"), F.substring(phone, -2, 2)))


def since(argument: str, as_of: Column) -> Column:
    """A look-back such as 7d or 24h from ``as_of``, or an ISO date."""
    if argument[-1:] in "dh" and argument[:-1].isdigit():
        return as_of - F.expr(f"interval {argument[:-1]} {'days' if argument[-1] == 'd' else 'hours'}")
    return F.lit(argument).cast("timestamp")


def channel_variants(id_: Column) -> Column:
    """A channel's id in its short, negative and -100 prefixed forms, sorted."""
    base = F.lit(1_000_000_000_000)
    short = F.when(id_ <= -base, -id_ - base).otherwise(F.abs(id_))
    return F.array_sort(F.array_distinct(F.array(id_, short, -short, -base - short)))


def money(etb: Column) -> Column:
    return F.concat(F.format_number(etb, 0), F.lit(" ETB"))


def time_left(minutes: Column) -> Column:
    """Minutes below an hour, hours below two days, then days, halves up."""
    return (
        F.when(minutes < 60, F.concat(minutes.cast("string"), F.lit("m"))).when(minutes < 48 * 60, F.concat(F.floor(minutes / 60).cast("string"), F.lit("h")))
        .otherwise(F.concat(F.floor(minutes / 1440 + 0.5).cast("string"), F.lit("d")))
    )


def escape_html(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def safe_path(path: Column) -> Column:
    """A path of this site, or ``/``: no scheme-relative, backslash or control characters, 512 characters at most."""
    ok = path.rlike(r"^/(?![/\\])[^\x00-\x1f\x7f]*$") & (F.length(path) <= 512)
    return F.when(F.coalesce(ok, F.lit(False)), path).otherwise(F.lit("/"))


def normalise_query(text: Column) -> Column:
    """Lower case, zero-width characters gone, Ethiopic punctuation and no-break blanks as blanks, 200 characters."""
    marks = "\u00a0\u1361\u1362\u1363\u1364\u1365\u1366\u1367\u1368"
    t = F.translate(F.coalesce(text, F.lit("")), marks + "\u200b\u200c\u200d\ufeff", " " * len(marks))
    return F.substring(F.trim(F.regexp_replace(F.lower(t), r"(?U)\s+", " ")), 1, 200)


def merged_confidence(value: Column, is_listing: Column) -> Column:
    """A model's confidence within 0 and 1; without one 0.85 for listings and 0 for others."""
    return F.least(F.greatest(F.coalesce(value, F.when(is_listing, 0.85).otherwise(0.0)), F.lit(0.0)), F.lit(1.0))


def image_url(key: Column, base: str) -> Column:
    return F.when(key.startswith("/") | key.startswith("http"), key).otherwise(F.concat(F.lit(base.rstrip("/") + "/"), key))


def storage_key(channel: Column, message: Column, index: Column, content: Column) -> Column:
    return F.concat(F.lit("raw/"), channel.cast("string"), F.lit("/"), message.cast("string"), F.lit("_"), index.cast("string"), F.lit("_"), F.substring(F.sha2(content, 256), 1, 8), F.lit(".jpg"))


def longest_keyword(text: Column, keywords: list[tuple[str, str]], default: str | None = None) -> Column:
    """The label of the longest keyword that the lower-cased text contains; of equal ones the first listed."""
    ordered = sorted(enumerate(keywords), key=lambda x: (-len(x[1][0]), x[0]))
    out = F.lit(default)
    for _, (word, label) in reversed(ordered):
        out = F.when(F.contains(F.lower(text), F.lit(word)), label).otherwise(out)
    return out


def only_label(text: Column, spellings: dict[str, tuple[str, ...]]) -> Column:
    """The one label of which the text contains a spelling; null for none or several."""
    t = F.lower(text)
    hits = F.array(*[F.when(F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(t, w)), F.lit(name)) for name, words in spellings.items()])
    hits = F.filter(hits, lambda x: x.isNotNull())
    return F.when(F.size(hits) == 1, F.get(hits, F.lit(0)))
