"""Class-based n-gram language model with Brown exchange clustering.

Exchange clustering assigns words to classes so that adjacent classes tell as much about each other as possible, in two
steps. The most frequent words (*seeds*) and units of all other words' endings are clustered on the driver, on a unit bigram
table that is counted over all training rows and whose size the number of units fixes. Then, in Spark, every other word is
moved to the class where its own left and right neighbours, counted over all training rows, fit best.

A text's probability is the product, over its tokens, of the transition from the history class of the token before to the
token's class, and of the word's emission by its class, each smoothed. The history class of a seed is its class, that of
another word the class of its ending, so it is known without a table of all words.

The vocabulary never goes to the driver: words' counts and classes are joined by a shuffle, but for a table of the most
frequent ones, whose size is fixed.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stallwise.session import checkpoint, ship_package

#: Defaults of ``fit``: seeds, units of endings, classes, and words whose counts and classes every task holds.
SEEDS, ENDINGS, CLASSES, HELD = 1000, 256, 48, 50_000
#: Hash that stands for the end of a text; words' hashes are even.
END_HASH = 1
REMEMBERED = 500_000
MARKS = b".,;:!?\"'()[]|*&%$#-"


def word_hash(word: bytes) -> int:
    h = xxhash.xxh3_64_intdigest(word) & ~1
    return h - (1 << 64) if h >> 63 else h


def ending(word: bytes, endings: int) -> int:
    """One of the ending units, by the last bytes of a word without closing marks."""
    return zlib.crc32((word.rstrip(MARKS) or word)[-3:]) % endings


class Model(NamedTuple):
    """Tables of fixed size.

    ``seeds`` maps a word hash to its class, ``ends`` has the class of each ending; ``held`` maps a word hash to
    (count, class). ``transition`` is log10 P(class | history class), ``class_log_total`` log10 of a class's smoothed words.
    """

    seeds: dict[int, int]
    ends: np.ndarray
    held: dict[int, tuple[int, int]]
    transition: np.ndarray
    class_log_total: np.ndarray
    tokens: int
    distinct: int
    texts: int


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def _slices(batch: pa.RecordBatch, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    start = held = 0
    for i, value in enumerate(batch.column("text")):
        n = value.as_buffer().size if value.is_valid else 0
        if held and held + n > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < batch.num_rows:
        yield batch.slice(start)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, n) of the words of this part, of each once for every ``REMEMBERED`` words."""
    seen: Counter[bytes] = Counter()

    def flush() -> Iterator[pa.RecordBatch]:
        words = list(seen)
        for at in range(0, len(words), 100_000):
            some = words[at : at + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array([word_hash(w) for w in some], pa.int64()), pa.array([seen[w] for w in some], pa.int64())], ["h", "n"])
        seen.clear()

    for whole in batches:
        for batch in _slices(whole):
            for text in batch.column("text").to_pylist():
                seen.update(_words(text))
            if len(seen) > REMEMBERED:
                yield from flush()
    yield from flush()


class _Units(dict):
    """Word to unit, for counting bigrams; emptied when it grows past a bound."""

    def __init__(self, top: dict[int, int], endings: int) -> None:
        self.top, self.endings = top, endings

    def __missing__(self, word: bytes) -> int:
        unit = self.top.get(word_hash(word), -1)
        unit = self[word] = unit if unit >= 0 else len(self.top) + ending(word, self.endings)
        return unit


def _bigrams(top: dict[int, int], endings: int):
    """Counts of unit pairs; the last unit is the end of a text."""
    units = len(top) + endings + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, seen = _Units(top, endings), np.zeros(units * units, np.int64)
        for whole in batches:
            for batch in _slices(whole):
                if len(table) > REMEMBERED:
                    table.clear()
                line = [units - 1]
                for text in batch.column("text").to_pylist():
                    line.extend(map(table.__getitem__, _words(text)))
                    line.append(units - 1)
                u = np.array(line, np.int64)
                seen += np.bincount(u[:-1] * units + u[1:], minlength=units * units)
        some = np.flatnonzero(seen)
        for at in range(0, len(some), 200_000):
            part = some[at : at + 200_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(seen[part])], ["pair", "n"])

    return run


def exchange_classes(bigrams: np.ndarray, classes: int, sweeps: int = 8, fixed: int | None = None) -> np.ndarray:
    """A class for each unit: each in turn moves where the class bigrams' mutual information is highest.

    Starts from units dealt out by frequency; ends when a sweep moves none. Unit ``fixed`` keeps a class, the last,
    to itself.
    """
    n = bigrams.astype(np.float64)
    left, right = n.sum(axis=1), n.sum(axis=0)
    order = np.argsort(-(left + right), kind="stable")
    moving = [u for u in order if u != fixed and left[u] + right[u] > 0]
    free = classes - (fixed is not None)
    of = np.zeros(len(n), np.int64)
    of[[u for u in order if u != fixed]] = np.arange(len(order) - (fixed is not None)) % free
    if fixed is not None:
        of[fixed] = classes - 1
    member = np.zeros((len(n), classes))
    member[np.arange(len(n)), of] = 1
    table, rows, cols = member.T @ n @ member, member.T @ left, member.T @ right
    phi = lambda x: x * np.log(np.maximum(x, 1e-300))
    for _ in range(sweeps):
        moved = 0
        for u in moving:
            c, own = of[u], n[u, u]
            out, into = np.bincount(of, n[u], classes), np.bincount(of, n[:, u], classes)
            out[c] -= own
            into[c] -= own
            table[c] -= out
            table[:, c] -= into
            table[c, c] -= own
            rows[c] -= left[u]
            cols[c] -= right[u]
            table = np.maximum(table, 0)
            now = phi(table)
            gain = (phi(table + out) - now).sum(axis=1) + (phi(table + into[:, None]) - now).sum(axis=0)
            d = np.arange(classes)
            diagonal = table[d, d]
            gain += phi(diagonal + out + into + own) - phi(diagonal + out) - phi(diagonal + into) + phi(diagonal)
            gain -= phi(rows + left[u]) - phi(rows) + phi(cols + right[u]) - phi(cols)
            best = int(np.argmax(gain[:free]))
            if gain[best] <= gain[c] + 1e-9:
                best = c
            moved += best != c
            of[u] = best
            table[best] += out
            table[:, best] += into
            table[best, best] += own
            rows[best] += left[u]
            cols[best] += right[u]
        if not moved:
            break
    return of


class _Local(dict):
    """Word to a row of hashes and history classes; row 0 is the end of a text."""

    def __init__(self, seeds: dict[int, int], ends: list[int], end_class: int) -> None:
        self.seeds, self.ends, self.end_class = seeds, ends, end_class
        self.empty()

    def empty(self) -> None:
        self.clear()
        self.hashes, self.history = [END_HASH], [self.end_class]

    def __missing__(self, word: bytes) -> int:
        h = word_hash(word)
        at = self[word] = len(self.hashes)
        known = self.seeds.get(h, -1)
        self.hashes.append(h)
        self.history.append(known if known >= 0 else self.ends[ending(word, len(self.ends))])
        return at


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    k, n = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k, kind="stable")
    k, n = k[order], n[order]
    at = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
    return k[at], np.add.reduceat(n, at)


def _contexts(seeds: dict[int, int], ends: np.ndarray, classes: int):
    """(h, near) for each word: its neighbours' history classes, left ones from 0 and right ones from ``classes``.

    An entry of ``near`` is 256 times a count, plus the class.
    """
    width = 2 * classes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _Local(seeds, ends.tolist(), classes - 1)
        keys: list[np.ndarray] = []
        counts: list[np.ndarray] = []

        def flush() -> Iterator[pa.RecordBatch]:
            if keys:
                k, n = _summed(keys, counts)
                word, first = np.unique(k // width, return_index=True)
                h, near = np.array(table.hashes, np.int64)[word], (n << 8) | (k % width)
                bounds = np.r_[first, len(k)]
                for at in range(0, len(word), 50_000):
                    part = bounds[at : at + 50_001]
                    lists = pa.ListArray.from_arrays(pa.array((part - part[0]).astype(np.int32)), pa.array(near[part[0] : part[-1]]))
                    yield pa.RecordBatch.from_arrays([pa.array(h[at : at + 50_000]), lists], ["h", "near"])
            keys.clear()
            counts.clear()
            table.empty()

        for whole in batches:
            for batch in _slices(whole):
                line = [0]
                for text in batch.column("text").to_pylist():
                    line.extend(map(table.__getitem__, _words(text)))
                    line.append(0)
                w = np.array(line, np.int64)
                g = np.array(table.history, np.int64)[w]
                k, n = np.unique(np.r_[w[1:] * width + g[:-1], w[:-1] * width + classes + g[1:]], return_counts=True)
                keys.append(k)
                counts.append(n)
                if sum(map(len, keys)) > 6_000_000:
                    k, n = _summed(keys, counts)
                    keys[:], counts[:] = [k], [n]
                if len(table) > REMEMBERED or (len(keys) == 1 and len(keys[0]) > 6_000_000):
                    yield from flush()
        yield from flush()

    return run


def _assign(seeds: dict[int, int], fit_: np.ndarray, classes: int):
    """(h, n, class, history) of each word, whose rows come sorted by h, and at the end the transitions of this part.

    ``fit_`` has, for each left and right class, how well it goes with each class. A row of transitions has no h.
    """
    names, kinds = ["h", "n", "class", "history"], [pa.int64(), pa.int64(), pa.int32(), pa.int32()]
    fixed = np.array(sorted(seeds), np.int64)
    of_fixed = np.array([seeds[h] for h in fixed.tolist()], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros((classes, classes), np.int64)
        kept_h, kept = np.empty(0, np.int64), np.empty((0, 2 * classes))

        def closed(h: np.ndarray, near: np.ndarray) -> pa.RecordBatch:
            best = (near @ fit_).argmax(axis=1)
            if len(fixed):
                at = np.minimum(np.searchsorted(fixed, h), len(fixed) - 1)
                best = np.where(fixed[at] == h, of_fixed[at], best)
            best = np.where(h == END_HASH, classes - 1, best)
            left = near[:, :classes].astype(np.int64)
            for c in np.unique(best).tolist():
                table[:, c] += left[best == c].sum(axis=0)
            return pa.RecordBatch.from_arrays([pa.array(h), pa.array(left.sum(axis=1)), pa.array(best.astype(np.int32)), pa.nulls(len(h), pa.int32())], names)

        for batch in batches:
            if not batch.num_rows:
                continue
            h = batch.column("h").to_numpy()
            lists = batch.column("near")
            flat = lists.flatten().to_numpy()
            word = np.cumsum(np.r_[True, h[1:] != h[:-1]]) - 1
            owner = np.repeat(word, lists.value_lengths().to_numpy())
            near = np.bincount(owner * 2 * classes + (flat & 255), flat >> 8, (word[-1] + 1) * 2 * classes).reshape(-1, 2 * classes)
            h = h[np.r_[True, h[1:] != h[:-1]]]
            if len(kept_h) and kept_h[0] == h[0]:
                near[0] += kept[0]
            elif len(kept_h):
                h, near = np.r_[kept_h, h], np.r_[kept, near]
            if len(h) > 1:
                yield closed(h[:-1], near[:-1])
            kept_h, kept = h[-1:], near[-1:]
        if len(kept_h):
            yield closed(kept_h, kept)
        g, c = np.nonzero(table)
        if len(g):
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip([[None] * len(g), table[g, c], c.astype(np.int32), g.astype(np.int32)], kinds, strict=True)], names)

    return run


def most_frequent(counts: DataFrame, most: int) -> list:
    """About the ``most`` rows (h, n and more) of highest n, of equal ones those of least h, and no more rows than that.

    The bound between them is read from a histogram of log n, so that only rows above it leave the executors.
    """
    step = F.floor(F.log2(F.col("n").cast("double")) * 64).cast("int")
    room, low, part, size = most, None, 0, 0
    for r in sorted(counts.groupBy(step.alias("step")).agg(F.count("*").alias("k")).collect(), key=lambda r: -r["step"]):
        low, part, size = r["step"], min(room, r["k"]), r["k"]
        room -= part
        if not room:
            break
    if low is None:
        return []
    edge = int(part / size * (1 << 64)) - (1 << 63)
    some = counts.where((step > low) | ((step == low) & ((F.lit(part) == size) | (F.col("h") < F.lit(min(edge, (1 << 63) - 1))))))
    return sorted(some.collect(), key=lambda r: (-r["n"], r["h"]))[:most]


def fit(docs: DataFrame, training: Column, classes: int = CLASSES, seeds: int = SEEDS, endings: int = ENDINGS, held: int = HELD) -> tuple[Model, DataFrame]:
    """The model of the rows that satisfy ``training``, and every word's count and class as (h, n, class).

    ``classes`` (at most 128) are shared by all words; ``seeds`` and ``endings`` fix the units of the first step of the
    clustering, and thereby its memory and time on the driver; ``held`` only saves shuffling. Counts cover all rows.

    A null or empty text is one end token. Without training rows every count is 0 and smoothing is uniform. Repeated rows count
    each time. Very long texts are read whole. The model does not depend on how rows lie in partitions. Other columns of ``docs`` than ``text``
    and those in ``training`` are not read.
    """
    if not 2 <= classes <= 128:
        raise ValueError("from 2 to 128 classes")
    ship_package(docs.sparkSession)
    texts = docs.where(training).select("text")
    top = {r["h"]: i for i, r in enumerate(most_frequent(checkpoint(texts.mapInArrow(_counted, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))), seeds))}
    units = len(top) + endings + 1
    pairs = texts.mapInArrow(_bigrams(top, endings), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    bigrams = np.zeros(units * units)
    bigrams[np.asarray(pairs.column("pair"))] = np.asarray(pairs.column("n"))
    bigrams = bigrams.reshape(units, units)
    of = exchange_classes(bigrams, classes, fixed=units - 1)
    member = np.zeros((units, classes))
    member[np.arange(units), of] = 1
    table = member.T @ bigrams @ member

    # How well a left or right class goes with a class: log of its share among the class's neighbours.
    likely = lambda t: np.log((t + 10 * (t.sum(axis=1, keepdims=True) + 0.5) / (t.sum() + 0.5 * classes)) / (t.sum(axis=0, keepdims=True) + 10))
    goes = np.concatenate([likely(table), likely(table.T)])
    goes[:, classes - 1] = -1e9
    of_seed, ends = {h: int(of[i]) for h, i in top.items()}, of[len(top) : units - 1]
    near = texts.mapInArrow(_contexts(of_seed, ends, classes), "h long, near array<long>").repartition("h").sortWithinPartitions("h")
    made = checkpoint(near.mapInArrow(_assign(of_seed, goes, classes), "h long, n long, class int, history int"))
    words = made.where("h is not null").select("h", "n", "class")

    transitions = np.zeros((classes, classes))
    for r in made.where("h is null").groupBy("history", "class").agg(F.sum("n").alias("n")).collect():
        transitions[r["history"], r["class"]] = r["n"]
    n_class, v_class = np.zeros(classes), np.zeros(classes)
    for r in words.groupBy("class").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():
        n_class[r["class"]], v_class[r["class"]] = r["n"], r["v"]
    share = (transitions.sum(axis=0) + 0.5) / (transitions.sum() + 0.5 * classes)
    transition = np.log10((transitions + 10 * share) / (transitions.sum(axis=1, keepdims=True) + 10))
    frequent = most_frequent(words.where(F.col("h") != END_HASH), held)
    model = Model(
        of_seed, ends, {r["h"]: (r["n"], r["class"]) for r in frequent}, transition, np.log10(n_class + 0.5 * (v_class + 1)),
        int(n_class.sum()), int(v_class.sum()), int(n_class[classes - 1]),
    )
    return model, words


class _Vocabulary(dict):
    """Word to a row of (hash, count or -1, class, history class); the class of one that is not held is its ending's."""

    def __init__(self, model: Model) -> None:
        self.model, self.ends = model, model.ends.tolist()
        self.empty()

    def empty(self) -> None:
        self.clear()
        end = len(self.model.transition) - 1
        self.rows = [(END_HASH, self.model.texts, end, end)]

    def __missing__(self, word: bytes) -> int:
        h = word_hash(word)
        by_ending = self.ends[ending(word, len(self.ends))]
        n, c = self.model.held.get(h, (-1, by_ending))
        at = self[word] = len(self.rows)
        self.rows.append((h, n, c, self.model.seeds.get(h, by_ending)))
        return at


def _partial(model: Model):
    """Sums over the words that are held, and the others: ``rare`` hashes and, packed, counts and classes."""
    end = len(model.transition) - 1
    names = ["kept", "n_tokens", "known", "base", "score", "rare", "how"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Vocabulary(model)
        made = np.empty((0, 4), np.int64)
        base_total = math.log10(model.tokens + 0.5 * (model.distinct + 1))
        for whole in batches:
            for batch in _slices(whole):
                if len(words) > REMEMBERED:
                    words.empty()
                    made = made[:0]
                line: list[int] = []
                first = [0]
                for text in batch.column("text").to_pylist():
                    line.extend(map(words.__getitem__, _words(text)))
                    line.append(0)
                    first.append(len(line))
                if len(words.rows) > len(made):
                    made = np.concatenate([made, np.array(words.rows[len(made) :], np.int64)])
                w = np.array(line, np.int64)
                h, n, c, g = made[w].T
                before = np.r_[end, g[:-1]]
                known = n >= 0
                logs = np.where(known, np.log10(np.maximum(n, 0) + 0.5), 0.0)
                score = np.where(known, model.transition[before, c] + np.where(c == end, 0.0, logs - model.class_log_total[c]), 0.0)
                starts, bounds = np.array(first[:-1]), np.array(first)
                total = lambda x, starts=starts: np.add.reduceat(x, starts) if len(starts) else x[:0]
                length = np.diff(bounds)
                # Each text's rare words with the classes before and of their endings, once each.
                at = np.flatnonzero(~known)
                doc = np.searchsorted(bounds, at, side="right") - 1
                how = (before[at] << 8) | c[at]
                order = np.lexsort((how, h[at], doc))
                doc, rare, how = doc[order], h[at][order], how[order]
                new = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (rare[1:] != rare[:-1]) | (how[1:] != how[:-1])]) if len(doc) else np.empty(0, np.int64)
                times = np.diff(np.r_[new, len(doc)])
                offsets = pa.array(np.searchsorted(doc[new], np.arange(len(length) + 1)).astype(np.int32))
                columns = [
                    batch.column("kept"), pa.array(length), pa.array(total((known & (n > 0)).astype(np.int64))), pa.array(total(logs) - base_total * length), pa.array(total(score)),
                    pa.ListArray.from_arrays(offsets, pa.array(rare[new])), pa.ListArray.from_arrays(offsets, pa.array((times << 16) | how[new])),
                ]
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def score(docs: DataFrame, model: Model, words: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` of every row, n_tokens, n_known, train_tokens, base_score and score (log10 probabilities).

    ``base_score`` is the unigram model's, with a half added to every count and one slot for unseen words. An unseen word has
    the class of its ending. A null or empty text is its end token alone. Repeated rows get equal scores; every row is kept. A
    kept column of the name of one of the results is replaced by it; other names do not matter.
    """
    spark = docs.sparkSession
    ship_package(spark)
    results = ("n_tokens", "n_known", "train_tokens", "base_score", "score")
    names = [k for k in keep if k not in results]
    kept = F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(names)], F.lit(0).alias("none"))
    picked = docs.select(kept.alias("kept"), "text")
    kinds = {"n_tokens": T.LongType(), "known": T.LongType(), "base": T.DoubleType(), "score": T.DoubleType(), "rare": T.ArrayType(T.LongType()), "how": T.ArrayType(T.LongType())}
    schema = T.StructType([picked.schema["kept"], *(T.StructField(k, t) for k, t in kinds.items())])
    made = checkpoint(picked.mapInArrow(_partial(model), schema).withColumn("row", F.monotonically_increasing_id()))
    some = made.select("row", F.explode(F.arrays_zip("rare", "how")).alias("x")).select("row", F.col("x.rare").alias("h"), F.col("x.how").alias("how"))
    joined = some.join(words, "h", "left").select(
        "row", F.coalesce("n", F.lit(0)).alias("n"), F.shiftright("how", 16).alias("times"), F.shiftright("how", 8).bitwiseAND(255).cast("int").alias("g"),
        F.coalesce("class", F.col("how").bitwiseAND(255).cast("int")).alias("c"),
    )
    size = len(model.transition)
    logs = [(g, c, float(model.transition[g, c] - model.class_log_total[c])) for g in range(size) for c in range(size)]
    joined = joined.join(F.broadcast(spark.createDataFrame(logs, "g int, c int, log double")), ["g", "c"])
    own = F.log10(F.col("n") + 0.5)
    found = joined.groupBy("row").agg(
        F.sum(F.col("times") * own).alias("logs"), F.sum(F.col("times") * (own + F.col("log"))).alias("scores"), F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("more")
    )
    return made.drop("rare", "how").join(found, "row", "left").select(
        *[F.col(f"kept.k{i}").alias(k) for i, k in enumerate(names)],
        "n_tokens",
        (F.col("known") + F.coalesce("more", F.lit(0))).cast("long").alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("logs", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("scores", F.lit(0.0))).alias("score"),
    )


def perplexity(scored: DataFrame) -> DataFrame:
    """One row: perplexities of the base and the class model over all tokens of ``scored``."""
    n = F.sum("n_tokens")
    return scored.agg(F.pow(F.lit(10.0), -F.sum("base_score") / n).alias("base_perplexity"), F.pow(F.lit(10.0), -F.sum("score") / n).alias("perplexity"))
