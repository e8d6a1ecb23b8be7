"""Similarities of vectors, hashes, prices and words as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision; 0 for empty, null, unequally long or zero vectors."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.coalesce(F.when((F.size(a) == F.size(b)) & (norms > 0), dot(a, b) / norms), F.lit(0.0))


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two 16-digit hex hashes; 64 where one is not such a hash."""
    ok = a.rlike("^[0-9a-fA-F]{16}$") & b.rlike("^[0-9a-fA-F]{16}$")
    part = lambda x, at: F.conv(F.substring(x, at, 8), 16, 10).cast("long")
    bits = F.bit_count(part(a, 1).bitwiseXOR(part(b, 1))) + F.bit_count(part(a, 9).bitwiseXOR(part(b, 9)))
    return F.when(F.coalesce(ok, F.lit(False)), bits).otherwise(64)


def price_difference(a: Column, b: Column) -> Column:
    return F.abs(a - b) / F.nullif(F.greatest(a, b), F.lit(0))


def unaccent(text: Column) -> Column:
    """Letters of Western Europe without their accents, sharp s as two letters."""
    return F.replace(F.translate(text, "àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ", "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY"), F.lit("ß"), F.lit("ss"))


def trigrams(text: Column) -> Column:
    """Distinct trigrams of the lower-cased words, each padded by two blanks before and one behind."""
    words = F.filter(F.split(F.lower(text), r"(?U)[^\w]+"), lambda w: w != "")

    def of(word: Column) -> Column:
        padded = F.concat(F.lit("  "), word, F.lit(" "))
        return F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substring(padded, i, F.lit(3)))

    return F.array_distinct(F.flatten(F.transform(words, of)))


def trigram_similarity(a: Column, b: Column) -> Column:
    """Shared trigrams over all trigrams of both; 0 without any."""
    x, y = trigrams(unaccent(a)), trigrams(unaccent(b))
    return F.coalesce(F.size(F.array_intersect(x, y)) / F.nullif(F.size(F.array_union(x, y)), F.lit(0)), F.lit(0.0))


def image_hash(key: Column) -> Column:
    """A 16-digit hex hash as it is, in lower case; otherwise one derived from the key."""
    return F.when(key.rlike("^[0-9a-fA-F]{16}$"), F.lower(key)).otherwise(F.substring(F.sha2(key, 256), 1, 16))


def hashed_embedding(text: Column, dims: int = 768) -> Column:
    """A deterministic unit vector of a text's words by signed feature hashing; zeros for a text without words.

    Words whose signs cancel everywhere give the unit vector of the first slot, so that only texts without words are
    zeros. Stands in for a model where none is plugged in, so that clustering and search run end to end.
    """
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"(?U)[^\w]+"), lambda w: w != "")
    hashed = F.transform(words, lambda w: F.struct(F.pmod(F.xxhash64(w), F.lit(dims)).alias("slot"), F.when(F.pmod(F.xxhash64(w, F.lit(1)), F.lit(2)) == 0, 1.0).otherwise(-1.0).alias("sign")))
    # Arrays of one element bind what the lambda functions within read many times.
    bind = lambda value, f: F.transform(F.array(value), f)[0]

    def sparse(h: Column) -> Column:
        slots = F.array_distinct(F.transform(h, lambda x: x["slot"]))
        of = lambda s: F.aggregate(F.filter(h, lambda x: x["slot"] == s), F.lit(0.0), lambda acc, x: acc + x["sign"])
        return bind(slots, lambda at: F.struct(at.alias("at"), F.transform(at, of).alias("sums")))

    zeros = lambda n: F.array_repeat(F.lit(0.0), n)

    def dense(v: Column) -> Column:
        norm = F.sqrt(F.aggregate(v["sums"], F.lit(0.0), lambda acc, x: acc + x * x))
        placed = F.array_sort(F.zip_with(v["at"], v["sums"], lambda at, s: F.struct(at.cast("int").alias("at"), s.alias("sum"))))

        def spread(p: Column, n: Column) -> Column:
            # runs of zeros between the slots in order, so the work is that of the words and not of all slots times them
            gap = lambda x, i: zeros(x["at"] - F.coalesce(F.get(p, i - 1)["at"], F.lit(-1)) - 1)
            behind = zeros(F.lit(dims - 1) - F.coalesce(F.get(p, F.size(p) - 1)["at"], F.lit(-1)))
            unit = F.concat(F.flatten(F.transform(p, lambda x, i: F.concat(gap(x, i), F.array(x["sum"] / n)))), behind)
            return F.when(n > 0, unit).when(F.size(p) > 0, F.concat(F.array(F.lit(1.0)), zeros(F.lit(dims - 1)))).otherwise(zeros(F.lit(dims)))

        return bind(F.struct(placed.alias("p"), norm.alias("n")), lambda x: spread(x["p"], x["n"]))

    return bind(hashed, lambda h: bind(sparse(h), dense))
