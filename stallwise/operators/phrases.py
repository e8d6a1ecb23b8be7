"""Phrases of a dictionary table in short texts, by equi-joins of their substrings and word n-grams with it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def longest_phrase(texts: DataFrame, dictionary: DataFrame, keys: list[str], text: str = "text", name: str = "found") -> DataFrame:
    """``keys`` and ``name``, a struct (phrase, and the dictionary's other columns) of the longest phrase that a text contains anywhere.

    ``dictionary`` has phrase and ``rank``; of phrases of one length the least rank wins. Texts without one are left out. Every substring
    of a length that the dictionary has is looked up, so the work does not depend on the number of phrases.
    """
    lengths = [r[0] for r in dictionary.select(F.char_length("phrase")).distinct().collect() if r[0]]
    size = F.char_length(text)
    cut = lambda n: F.transform(F.sequence(F.lit(1), size - (n - 1)), lambda i: F.substring(text, i, F.lit(n)))
    parts = [F.when(size >= n, cut(n)) for n in lengths]
    every = F.array_distinct(F.flatten(F.filter(F.array(*parts), lambda x: x.isNotNull()))) if parts else F.array().cast("array<string>")
    met = texts.select(*keys, F.explode(every).alias("phrase")).join(dictionary, "phrase")
    found = F.struct("phrase", *[c for c in dictionary.columns if c != "phrase"])
    return met.groupBy(*keys).agg(F.max_by(found, F.struct(F.char_length("phrase"), -F.col("rank"))).alias(name))


def word_phrases(texts: DataFrame, dictionary: DataFrame, keys: list[str], tokens: Column) -> DataFrame:
    """``keys``, ``tokens``, and ``terms``: the dictionary's phrases among a token array, longer and then earlier ones first, without overlaps.

    A term is a struct (n, i, ...) of its words, its place and the dictionary's columns; ``dictionary`` has one row a phrase.
    """
    longest = dictionary.agg(F.max(F.size(F.split("phrase", " ")))).first()[0] or 0
    own = texts.select(*keys, tokens.alias("tokens"))
    grams = lambda n: F.transform(F.sequence(F.lit(0), F.size("tokens") - n), lambda i: F.struct((-F.lit(n)).alias("n"), i.alias("i"), F.array_join(F.slice("tokens", i + 1, n), " ").alias("phrase")))
    some = F.filter(F.array(*[F.when(F.size("tokens") >= n, grams(n)) for n in range(1, longest + 1)]), lambda x: x.isNotNull()) if longest else F.array().cast("array<array<struct<n:int,i:int,phrase:string>>>")
    met = own.select(*keys, F.explode(F.flatten(some)).alias("g")).select(*keys, "g.*").join(dictionary, "phrase")
    each = F.struct("n", "i", *dictionary.columns)
    held = met.groupBy(*keys).agg(F.sort_array(F.collect_list(each)).alias("hits"))
    joined = own.join(held, keys, "left")
    kind = held.schema["hits"].dataType.simpleString()
    apart = lambda kept, x: ~F.exists(kept, lambda k: (k["i"] < x["i"] - x["n"]) & (x["i"] < k["i"] - k["n"]))
    kept = F.aggregate(F.coalesce("hits", F.array().cast(kind)), F.array().cast(kind), lambda acc, x: F.when(apart(acc, x), F.concat(acc, F.array(x))).otherwise(acc))
    return joined.select(*keys, "tokens", kept.alias("terms"))


def labels(texts: DataFrame, dictionary: DataFrame, keys: list[str], text: str = "text", unclear: tuple[str, ...] = ()) -> DataFrame:
    """(``keys``, kind, label): a text's label of each kind for which it contains a phrase, by one look-up for all kinds.

    ``dictionary`` has kind, phrase, label and ``rank``. The longest phrase counts, of equally long ones that of the least rank;
    a kind in ``unclear`` has no label where phrases of two labels are contained. Phrases and texts are compared as they are, equal texts once.
    """
    if keys != [text]:
        own = texts.select(*keys, F.col(text).alias("_text"))
        return own.join(labels(own.select("_text").distinct(), dictionary, ["_text"], "_text", unclear), "_text").select(*keys, "kind", "label")
    lengths = [r[0] for r in dictionary.select(F.char_length("phrase")).distinct().collect() if r[0]]
    size = F.char_length(text)
    cut = lambda n: F.transform(F.sequence(F.lit(1), size - (n - 1)), lambda i: F.substring(text, i, F.lit(n)))
    parts = F.filter(F.array(*[F.when(size >= n, cut(n)) for n in sorted(lengths)]), lambda x: x.isNotNull()) if lengths else F.array().cast("array<array<string>>")
    met = texts.select(*keys, F.explode(F.array_distinct(F.flatten(parts))).alias("phrase")).join(dictionary, "phrase")
    best = F.max_by("label", F.struct(F.char_length("phrase"), -F.col("rank")))
    found = met.groupBy(*keys, "kind").agg(best.alias("label"), (F.min("label") != F.max("label")).alias("_two"))
    return found.where(~(F.col("kind").isin(*unclear) & F.col("_two")) if unclear else F.lit(True)).drop("_two")
