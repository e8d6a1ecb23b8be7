"""Toxicity: a character n-gram linear classifier whose features are scaled by naive Bayes log-count ratios.

Features are the presence of hashed byte n-grams of the lower-cased text. The classifier is fitted on a bounded
sample of labelled rows: their feature counts are summed in Spark, the features that tell the classes apart
best are kept, each is scaled by its log-count ratio, and a regularised logistic regression over the scaled
features is solved on the driver. Scoring is one pass over whole texts with a weight table of fixed size.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stallwise.session import checkpoint, ship_package

LENGTHS = (4, 5, 6)
TABLE_BITS = 18
PART = 1 << 20
SLOTS = len(LENGTHS) << TABLE_BITS
#: Most labelled rows and features that a fit uses.
MAX_ROWS, MAX_FEATURES = 12_000, 16_384

_BLANK = bytes(32 if i in (9, 10, 11, 12, 13) else i for i in range(256))


class Model(NamedTuple):
    """Slots in ascending order, their weights (log-count ratios included) and the intercept."""

    slots: np.ndarray
    weights: np.ndarray
    bias: float


def ngram_slots(text: str | None) -> np.ndarray:
    """The slot of every byte n-gram of a text, repeats included; the ends count as blanks."""
    data = b"  " + (text or "").encode("utf-8", "surrogatepass").lower().translate(_BLANK) + b"  "
    b = np.frombuffer(data, np.uint8).astype(np.uint32)
    pairs = b[:-1] | (b[1:] << np.uint32(8))
    fours = pairs[:-2] | (pairs[2:] << np.uint32(16))
    mix, shift = np.uint32(0x9E3779B1), np.uint32(32 - TABLE_BITS)
    five = (fours[:-1] * np.uint32(0x85EBCA6B)) ^ (b[4:] * np.uint32(0xC2B2AE35))
    six = (fours[:-2] * np.uint32(0x27D4EB2F)) ^ (pairs[4:] * np.uint32(0x165667B1))
    out = [((x * mix) >> shift) + np.uint32(i << TABLE_BITS) for i, x in enumerate((fours, five, six))]
    return np.concatenate(out)


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


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen = np.zeros((2, SLOTS), np.int64)
    for batch in batches:
        for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist(), strict=True):
            seen[label][np.unique(ngram_slots(text))] += 1
    some = np.flatnonzero(seen.sum(axis=0))
    for at in range(0, len(some), 100_000):
        part = some[at : at + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(seen[0][part]), pa.array(seen[1][part])], ["slot", "n0", "n1"])


def _active(slots: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = np.zeros(SLOTS, bool)
        kept[slots] = True
        for batch in batches:
            found = []
            for text in batch.column("text").to_pylist():
                h = ngram_slots(text)
                found.append(np.searchsorted(slots, np.unique(h[kept[h]])).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(found, pa.list_(pa.int32()))], ["label", "features"])

    return run


def _logistic(rows: list[np.ndarray], labels: np.ndarray, ratios: np.ndarray, penalty: float = 1.0, steps: int = 300) -> tuple[np.ndarray, float]:
    """L2-regularised logistic regression over the present features, each worth its ratio; accelerated descent."""
    n, m = len(rows), len(ratios)
    # Parts of about a million present features: only they have whole arrays of weights at a time.
    size = np.array([len(r) for r in rows], np.int64)
    edges = np.searchsorted(np.cumsum(size), np.arange(0, size.sum() + PART, PART)) if n else np.zeros(1, int)
    parts = [(a, np.concatenate(rows[a:b]), size[a:b]) for a, b in zip(edges, [*edges[1:], n], strict=True) if b > a]

    def forward(w: np.ndarray) -> np.ndarray:
        worth = ratios * w
        out = np.zeros(n)
        for a, index, sizes in parts:
            out[a : a + len(sizes)] = np.bincount(np.repeat(np.arange(len(sizes)), sizes), worth[index], len(sizes))
        return out

    def backward(rest: np.ndarray) -> np.ndarray:
        return ratios * sum((np.bincount(index, np.repeat(rest[a : a + len(sizes)], sizes), m) for a, index, sizes in parts), np.zeros(m))

    probe = np.ones(m)
    top = 1.0
    for _ in range(20):
        probe = backward(forward(probe))
        top = np.linalg.norm(probe) or 1.0
        probe = probe / top
    rate = 1.0 / (0.25 * (top + n) + penalty)
    w, b, pw, pb = np.zeros(m), 0.0, np.zeros(m), 0.0
    for step in range(steps):
        ahead = step / (step + 3)
        w_, b_ = w + ahead * (w - pw), b + ahead * (b - pb)
        wrong = 1 / (1 + np.exp(-np.clip(forward(w_) + b_, -35, 35))) - labels
        pw, pb = w, b
        slope = backward(wrong) + penalty * w_
        w = w_ - rate * slope
        b = b_ - rate * wrong.sum()
        if abs(wrong.sum()) + np.abs(slope).max(initial=0.0) < 1e-3:
            break
    return w, float(b)


def fit(docs: DataFrame, labels: DataFrame, usable: Column | None = None, max_rows: int = MAX_ROWS, max_features: int = MAX_FEATURES) -> Model:
    """Fit on at most ``max_rows`` labelled documents, those whose doc_ids' hashes are least, with ``max_features`` n-grams.

    Both bound the driver's memory; scores are of whole texts of all rows. ``usable`` restricts the labels by a condition on
    their doc_id. Null labels and null doc_ids are left out; of several labels of one doc_id the highest holds, of several
    texts of one doc_id the one whose hash is least. Without labels of both classes the model scores every
    text by the share of toxic labels alone (0 without labels).
    """
    ship_package(docs.sparkSession)
    picked = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
    if usable is not None:
        picked = picked.where(usable)
    picked = checkpoint(picked.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label")))
    # A bound on the hash leaves little more than the rows wanted, so that no task hands on more than its share of them.
    share = min(1.0, 1.1 * (max_rows + 100) / max(1, picked.count()))
    if share < 1:
        picked = picked.where(F.xxhash64("doc_id") < F.lit(int(share * (1 << 64)) - (1 << 63)))
    picked = picked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    sample = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.first("label").alias("label"))
    sample = sample.select("text", F.when(F.col("label") > 0, 1).otherwise(0).alias("label"))
    sample = sample.repartition(8).persist()
    try:
        size = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
        n0, n1 = size.get(0, 0), size.get(1, 0)
        if not n0 or not n1:
            return Model(np.empty(0, np.int64), np.empty(0), 35.0 if n1 else -35.0)
        counts = sample.mapInArrow(_counts, "slot long, n0 long, n1 long").groupBy("slot").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
        a, b = F.col("n0").cast("double"), F.col("n1").cast("double")
        apart = F.pow(b * n0 - a * n1, F.lit(2)) / ((a + b) * (F.lit(float(n0 + n1)) - a - b + 1))
        best = counts.where(a + b >= 4).orderBy(apart.desc(), "slot").limit(max_features).collect()
        best = sorted((r["slot"], r["n0"], r["n1"]) for r in best)
        slots = np.array([r[0] for r in best], np.int64)
        f0, f1 = np.array([r[1] for r in best], float), np.array([r[2] for r in best], float)
        ratios = np.log((f1 + 1) / (n1 + 2)) - np.log((f0 + 1) / (n0 + 2))
        found = sample.mapInArrow(_active(slots), "label int, features array<int>").toArrow()
        rows = [np.asarray(x.values, np.int32) for x in found.column("features")]
        labels_ = np.asarray(found.column("label"), float)
        del found
        w, bias = _logistic(rows, labels_, ratios)
        return Model(slots, w * ratios, bias)
    finally:
        sample.unpersist()


def _score(model: Model, whole_rows: bool, column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = np.zeros(SLOTS, bool)
        kept[model.slots] = True
        table = np.zeros(SLOTS)
        table[model.slots] = model.weights
        for whole in batches:
            for batch in _slices(whole):
                scores = []
                for text in batch.column("text").to_pylist():
                    h = ngram_slots(text)
                    z = model.bias + table[np.unique(h[kept[h]])].sum()
                    scores.append(1 / (1 + np.exp(-np.clip(z, -35, 35))))
                kept_names = batch.schema.names if whole_rows else batch.schema.names[:-1]
                yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept_names), pa.array(scores, pa.float64())], [*kept_names, column])

    return run


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] | None = ("doc_id",), column: str = "score") -> DataFrame:
    """Columns ``keep`` of every row (None: all) and ``column``, the probability that its whole text is toxic.

    A null or empty text scores as one without features. Repeated rows get equal scores. A column of ``docs`` of
    the name ``column`` is replaced.
    """
    ship_package(docs.sparkSession)
    names = [c for c in (docs.columns if keep is None else keep) if c not in ("text", column)]
    picked = docs.select(*names, "text")
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields[: None if keep is None else -1]]
    scored = picked.mapInArrow(_score(model, keep is None, column), ", ".join([*fields, f"`{column}` double"]))
    return scored if keep is not None else scored.select(*[c for c in docs.columns if c != column], column)
