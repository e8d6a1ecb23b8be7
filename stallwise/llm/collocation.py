"""Phrases whose words meet more often than chance has it.

First, the n-grams of every text are counted in count-min sketches: two rows of counters, a counter for a range
of hashes. Tasks send the counters that they touched as compressed parts; parts of the same range are added. A counter is at
least the count of each n-gram that it holds, so an n-gram with a counter below the threshold in either row is not frequent. What is
left of a merged sketch is one bit a counter. One sketch has words and pairs, a second one longer n-grams, of which it
takes those whose pairs have passed. Then the texts are read once more, an n-gram is kept if its counters and those of its
first and last words pass, and the survivors are counted by their text: exact, and nothing frequent is lost. Tasks send
their survivors packed by hash bucket, each once.

Scores and subsumption are joins of that table of frequent n-grams with itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stallwise.llm.common import text_or_empty
from stallwise.session import ship_package, stored

#: Counters of one sent part, n-grams that a task holds before it sends parts, and bytes of text at once.
PART, HELD, SLICE = 1 << 18, 1 << 23, 2 << 20
#: Rows of a sketch, n-grams for each counter of a row as a multiple of the threshold (of these, in text, most are of frequent ones, which share
#: few counters), and most counters of a row: 256 MB of bits for both rows, which the driver hands on.
ROWS, LOAD, MOST_COUNTERS = 2, 2, 1 << 30
#: Counters are added up to here; a threshold may be as large.
FULL = 255
#: Languages whose word counts are broadcast.
MOST_LANGS = 10_000
#: Words that a worker remembers, survivors that it holds before it sends them, and survivors of one bucket.
REMEMBERED, SURVIVORS, BUCKET = 300_000, 200_000, 20_000

#: The marks at which texts are cut to pieces, as one of them; none is part of a word.
_CUT = bytes.maketrans(b".,;:!?\n\x0b\x0c\r", b"..........")
_EDGE = b"."
#: The first sketch's longest n-grams.
SHORT = 2
_MIX = np.uint64(0x9E3779B97F4A7C15)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def tokens(text: str | None) -> list[bytes]:
    """Words of a text in order, A-Z lower-cased, with an edge mark wherever a piece ends."""
    return (text or "").encode("utf-8", "surrogatepass").lower().translate(_CUT).replace(_EDGE, b" . ").split()


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[list[str | None], list[str]]]:
    texts, langs, held = [], [], 0
    for text, lang in zip(batch.column("text"), batch.column("lang").to_pylist(), strict=True):
        texts.append(text.as_py())
        langs.append(lang)
        held += text.as_buffer().size if text.is_valid else 0
        if held >= SLICE:
            yield texts, langs
            texts, langs, held = [], [], 0
    if texts:
        yield texts, langs


def _grams(texts: list[str | None], langs: list[str], most: int, known: _Hashes) -> tuple[list[bytes], np.ndarray, np.ndarray, list[np.ndarray]]:
    """Tokens, each one's place in ``langs``, which are words, and for each k hashes of the k words from each place on.

    The hashes of k words are those of places whose k words lie in one piece; elsewhere they are not used.
    """
    if len(known) > REMEMBERED:
        known.clear()
    flat: list[bytes] = []
    sizes = []
    for text in texts:
        own = tokens(text)
        own.append(_EDGE)
        flat += own
        sizes.append(len(own))
    word = np.fromiter(map(known.__getitem__, flat), np.uint64, len(flat))
    at = np.repeat(np.arange(len(texts)), sizes)
    seeds = {lang: xxhash.xxh3_64_intdigest(lang.encode("utf-8", "surrogatepass"), seed=1) for lang in set(langs)}
    seed = np.array([seeds[lang] for lang in langs], np.uint64)[at]
    inside = word != np.uint64(known[_EDGE])
    hashes, h = [], seed
    for k in range(most):
        h = h[: len(h) - (k > 0)] ^ word[k:]
        h *= _MIX
        h ^= h >> np.uint64(29)
        hashes.append(h)
    return flat, at, inside, hashes


def _together(inside: np.ndarray, k: int) -> np.ndarray:
    """Places from which k words follow in one piece."""
    out = inside[: max(0, len(inside) - k + 1)].copy()
    for j in range(1, k):
        out &= inside[j : len(out) + j]
    return out


def _cells(h: np.ndarray, row: int, counters: int) -> np.ndarray:
    return ((h >> np.uint64(33 * row)) & np.uint64(counters - 1)).astype(np.uint32)


def _passes(h: np.ndarray, bits: list[np.ndarray]) -> np.ndarray:
    out = np.ones(len(h), bool)
    for row in range(ROWS):
        cell = _cells(h, row, 8 * len(bits[row]))
        out &= (bits[row][cell >> 3] >> (cell & 7).astype(np.uint8)) & 1 == 1
    return out


def _alive(hashes: list[np.ndarray], inside: np.ndarray, bits: list[list[np.ndarray]]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each k the places of n-grams whose parts have passed, and which of them pass; the last sketch holds for every longer n-gram."""
    alive = inside
    for k, h in enumerate(hashes, 1):
        where = np.flatnonzero(inside[: len(h)] if k == 1 else alive[: len(h)] & alive[1 : len(h) + 1])
        own = bits[0] if k <= SHORT else bits[1] if len(bits) > 1 else None
        passed = _passes(h[where], own) if own is not None else np.ones(len(where), bool)
        yield k, where, passed
        alive = np.zeros(len(h), bool)
        alive[where[passed]] = True


def _sketch(ks: range, counters: int, shared):
    """Parts (row, part, places, counts) of the sketch of a task's texts, a few times a task; places is null where all counters are sent."""
    names, kinds = ["row", "part", "places", "counts"], [pa.int32(), pa.int32(), pa.binary(), pa.binary()]
    part = min(PART, counters)

    def parts(h: np.ndarray) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for row in range(ROWS):
            cells = _cells(h, row, counters)
            cells.sort()
            ends = np.searchsorted(cells, np.arange(part, counters + 1, part, dtype=np.uint64)).tolist()
            start = 0
            for p, end in enumerate(ends):
                if end > start:
                    own, places = cells[start:end] & np.uint32(part - 1), None
                    if len(own) < part // 16:
                        own, counts = np.unique(own, return_counts=True)
                        places = press.compress(np.diff(own, prepend=own.dtype.type(0)).tobytes())
                    else:
                        counts = np.bincount(own, minlength=part)
                    counts = press.compress(np.minimum(counts, FULL).astype(np.uint8).tobytes())
                    yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip((row, p, places, counts), kinds, strict=True)], names)
                start = end

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value if shared is not None else []
        known, held, n = _Hashes(), np.empty(HELD, np.uint64), 0
        for batch in batches:
            for texts, langs in _slices(batch):
                _, _, inside, hashes = _grams(texts, langs, ks[-1], known)
                if bits:
                    new = [hashes[k - 1][where] for k, where, _ in _alive(hashes, inside, bits) if k in ks]
                else:
                    new = [hashes[k - 1][_together(inside, k)] for k in ks]
                for h in new:
                    while len(h):
                        more = h[: HELD - n]
                        held[n : n + len(more)] = more
                        n, h = n + len(more), h[len(more) :]
                        if n == HELD:
                            yield from parts(held)
                            n = 0
        if n:
            yield from parts(held[:n])

    return run


def _passing(threshold: int, counters: int):
    """A bit for each counter of a part that reaches the threshold; parts come sorted by (row, part)."""
    part = min(PART, counters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press, key, total = zstandard.ZstdDecompressor(), None, np.zeros(part, np.uint16)
        closed = lambda: pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), pa.array([np.packbits(total >= threshold, bitorder="little").tobytes()], pa.binary())], ["row", "part", "bits"])
        for batch in batches:
            for row, p, places, counts in zip(*(batch.column(c).to_pylist() for c in ("row", "part", "places", "counts")), strict=True):
                if key != (row, p):
                    if key is not None:
                        yield closed()
                    key, total = (row, p), np.zeros(part, np.uint16)
                counts = np.frombuffer(press.decompress(counts), np.uint8)
                at = slice(None) if places is None else np.cumsum(np.frombuffer(press.decompress(places), np.uint32))
                total[at] = np.minimum(total[at] + counts, FULL)
        if key is not None:
            yield closed()

    return run


def sketch_bits(docs: DataFrame, ks: range, threshold: int, counters: int, shared=None) -> list[np.ndarray]:
    """For each row of the merged sketch of n-grams of ``ks`` words, the bits of the counters that reach ``threshold``."""
    part = min(PART, counters)
    made = docs.mapInArrow(_sketch(ks, counters, shared), "row int, part int, places binary, counts binary")
    added = made.repartition("row", "part").sortWithinPartitions("row", "part").mapInArrow(_passing(threshold, counters), "row int, part int, bits binary")
    out = [np.zeros(counters // 8, np.uint8) for _ in range(ROWS)]
    for found in added.collect():
        at = found["part"] * part // 8
        bits = np.frombuffer(found["bits"], np.uint8)
        out[found["row"]][at : at + len(bits)] = bits
    return out


_SENT = "bucket int, langs array<string>, lang binary, k binary, phrases binary, f binary"


def _survivors(most: int, buckets: int, shared):
    """The n-grams of a task that the sketches leave, a row for each bucket, as compressed columns; k is 0 for all words of a language.

    Phrases are joined by line feeds, of which they have none.
    """
    names = ["bucket", "langs", "lang", "k", "phrases", "f"]

    def sent(held: dict[int, list]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        by: dict[int, list] = {}
        for key, row in held.items():
            by.setdefault((key >> 20) % buckets, []).append(row)
        for bucket, rows in by.items():
            rows.sort()
            langs = {lang: i for i, lang in enumerate(dict.fromkeys(r[0] for r in rows))}
            packed = [np.array([langs[r[0]] for r in rows], np.int32), np.array([r[1] for r in rows], np.int8), "\n".join(r[2] for r in rows).encode("utf-8", "surrogatepass"), np.array([r[3] for r in rows], np.int64)]
            columns = [pa.array([press.compress(x if isinstance(x, bytes) else x.tobytes())], pa.binary()) for x in packed]
            yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([list(langs)], pa.list_(pa.string())), *columns], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, known, held = shared.value, _Hashes(), {}
        for batch in batches:
            for texts, langs in _slices(batch):
                flat, at, inside, hashes = _grams(texts, langs, most, known)
                codes = {lang: i for i, lang in enumerate(dict.fromkeys(langs))}
                n = np.bincount(np.array([codes[lang] for lang in langs])[at[inside]], minlength=len(codes)).tolist()
                for lang, i in codes.items():
                    held.setdefault(xxhash.xxh3_64_intdigest(lang.encode("utf-8", "surrogatepass"), seed=2), [lang, 0, "", 0])[3] += n[i]
                for k, where, passed in _alive(hashes, inside, bits):
                    where = where[passed]
                    found, first, counts = np.unique(hashes[k - 1][where], return_index=True, return_counts=True)
                    for key, i, c in zip(found.tolist(), where[first].tolist(), counts.tolist(), strict=True):
                        if (old := held.get(key)) is not None:
                            old[3] += c
                        else:
                            held[key] = [langs[at[i]], k, b" ".join(flat[i : i + k]).decode("utf-8", "surrogatepass"), c]
                if len(held) >= SURVIVORS:
                    yield from sent(held)
                    held = {}
        if held:
            yield from sent(held)

    return run


def _added(threshold: int):
    """Exact counts of the n-grams of each bucket, which come sorted by bucket; those of ``threshold`` or more stay."""

    def kept(total: dict[tuple, int]) -> Iterator[pa.RecordBatch]:
        rows = [(*key, f) for key, f in total.items() if f >= threshold or key[1] == 0]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(v, kind) for v, kind in zip(zip(*rows, strict=True), (pa.string(), pa.int32(), pa.string(), pa.int64()), strict=True)], ["lang", "k", "phrase", "f"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press, bucket, total = zstandard.ZstdDecompressor(), None, {}
        for batch in batches:
            for own, langs, *packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if own != bucket:
                    yield from kept(total)
                    bucket, total = own, {}
                lang, k, phrases, f = map(press.decompress, packed)
                for row in zip(np.frombuffer(lang, np.int32).tolist(), np.frombuffer(k, np.int8).tolist(), phrases.decode("utf-8", "surrogatepass").split("\n"), np.frombuffer(f, np.int64).tolist(), strict=True):
                    key = (langs[row[0]], row[1], row[2])
                    total[key] = total.get(key, 0) + row[3]
        yield from kept(total)

    return run


def frequent_ngrams(docs: DataFrame, text: str = "text", lang: str = "lang", most: int = 5, threshold: int = 100, max_counters: int = MOST_COUNTERS) -> DataFrame:
    """Every n-gram of 1 to ``most`` words that occurs ``threshold`` times or more in a language: lang, k, phrase, f; k 0 has all words.

    A sketch has a counter for each ``LOAD * threshold`` n-grams, up to ``max_counters``; beyond that it lets more n-grams
    pass to the exact count, whose result stays the same. Within a task n-grams are told apart by 64-bit hashes, and by text after it.
    """
    if not 1 <= threshold <= FULL:
        raise ValueError(f"a threshold from 1 to {FULL}")
    spark = docs.sparkSession
    ship_package(spark)
    read = docs.select(text_or_empty(F.col(text)).alias("text"), F.coalesce(F.col(lang), F.lit("und")).alias("lang"))
    chars = read.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    wanted = chars * min(most, SHORT) // (6 * LOAD * threshold)
    counters = min(max_counters, 1 << max(12, int(wanted).bit_length()))
    bits = [sketch_bits(read, range(1, min(most, SHORT) + 1), threshold, counters)]
    if most > SHORT:
        bits.append(sketch_bits(read, range(SHORT + 1, most + 1), threshold, counters, spark.sparkContext.broadcast(bits)))
    likely = sum(min(int(np.bitwise_count(row).sum()) for row in x) for x in bits)
    sent = read.mapInArrow(_survivors(most, 16 + likely // BUCKET, spark.sparkContext.broadcast(bits)), _SENT)
    return sent.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_added(threshold), "lang string, k int, phrase string, f long")


def score_phrases(grams: DataFrame) -> DataFrame:
    """Candidates (k of 2 or more) with the cut of least score, ties to the first: lang, k, phrase, a, l, r, n, score.

    The score is floor(1000 * a * n / (l * r)) in decimals of 38 digits.
    """
    parts = grams.where("k > 0").select("lang", "phrase", "f")
    words = grams.where("k = 0").select("lang", F.col("f").alias("n"))
    cuts = (
        grams.where("k > 1").withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1)))
        .select("lang", "k", "phrase", F.col("f").alias("a"), "cut", F.expr("substring_index(phrase, ' ', cut)").alias("head"), F.expr("substring_index(phrase, ' ', cut - k)").alias("tail"))
    )
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l")), ["lang", "head"]).join(parts.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r")), ["lang", "tail"])
    score = F.expr("(cast(1000 AS decimal(4, 0)) * cast(a AS decimal(14, 0)) * cast(n AS decimal(16, 0))) div (cast(l AS decimal(16, 0)) * cast(r AS decimal(16, 0)))")
    # Languages are few; where they are not, their counts are shuffled.
    few = len(words.take(MOST_LANGS + 1)) <= MOST_LANGS
    least = cuts.join(F.broadcast(words) if few else words, "lang").withColumn("score", score).groupBy("lang", "k", "phrase").agg(F.min(F.struct("score", "cut", "a", "l", "r", "n")).alias("best"))
    return least.select("lang", "k", "phrase", *[F.col(f"best.{c}").alias(c) for c in ("a", "l", "r", "n", "score")])


def drop_subsumed(scored: DataFrame, percent: int = 100) -> DataFrame:
    """Without candidates whose words lie inside a longer one that has ``percent`` or more of their count.

    A phrase occurs at least as often as any longer one around it, so a longer one that suffices implies that some one of just one
    word more does, and it is a candidate; only those are looked at.
    """
    inner = F.array(F.expr("substring_index(phrase, ' ', k - 1)"), F.expr("substring_index(phrase, ' ', 1 - k)"))
    longer = scored.where("k > 2").select("lang", F.explode(inner).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("around"))
    return scored.join(longer, ["lang", "phrase"], "left").where(F.col("around").isNull() | (100 * F.col("around") < percent * F.col("a"))).drop("around")


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", most: int = 5, threshold: int = 100, percent: int = 100, top: int = 2000, max_counters: int = MOST_COUNTERS) -> DataFrame:
    """Each language's ``top`` phrases of 2 to ``most`` words: lang, rank, phrase, a, l, r, n, score.

    Texts are cut at ``[.,;:!?\\x0A-\\x0D]`` to pieces and these at blanks and tabs to words, A-Z lower-cased; counts are of occurrences within
    pieces. A null text is empty, a null language is ``und`` (as is a language of that name). Repeated rows count as often as they occur. Ties of score and count go
    by the phrase's UTF-8 bytes. Very long texts are read whole, one at a time; an empty table gives no rows. Other columns are not read.
    """
    grams = stored(frequent_ngrams(docs, text, lang, most, threshold, max_counters))
    best = drop_subsumed(stored(score_phrases(grams)), percent)
    by = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = best.withColumn("rank", F.row_number().over(by).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
