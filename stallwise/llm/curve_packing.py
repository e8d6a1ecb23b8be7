"""Packing along a space-filling curve.

Each document's tokens are hashed to a vector and projected to three dimensions; its cell's index on a
Hilbert curve is its key. Documents are range-sorted by key, so neighbours on the curve are alike, and each
range is cut into sequences of a fixed length. What is left of a range is laid out in sequences whose
lengths are powers of two, so nothing is padded anywhere.
"""

from __future__ import annotations

import os
import sys
import zlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stallwise.session import checkpoint, ship_package

DIMS, BITS, HASHED = 3, 10, 64
#: Distinct chunks of text whose ids a Python worker remembers; beyond it the memory is emptied.
REMEMBERED = 1_000_000
#: Bits of a cell of the curve, least bytes of ids in a range, and most ranges.
CELL_BITS, RANGE_BYTES, MOST_RANGES = 14, 8 << 20, 200_000


def hilbert_index(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Positions on the Hilbert curve of points with integer coordinates below ``2**bits``, a row each.

    Gray-code walk from the highest bit down: exchanges and inversions undo the curve's rotations, then
    the bits of the axes are interleaved.
    """
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            swap = (x[0] ^ x[i]) & low
            x[0] = np.where(high, x[0] ^ low, x[0] ^ swap)
            if i:
                x[i] = np.where(high, x[i], x[i] ^ swap)
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        flip = np.where((x[n - 1] & q) != 0, flip ^ (q - 1), flip)
        q >>= 1
    x ^= flip
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


#: Closing marks that are looked up apart from their words.
MARKS = frozenset(".,;:!?")


class _Tokens:
    """A tokenizer with a memory of chunks between spaces, as two little-endian bytes an id.

    Its normalizer and its splitter must never look across a space or a line feed, so that the ids of a text are those
    of its chunks in order; a tokenizer that gives other ids for ``PROBES`` is refused, and one whose special tokens take blanks. Special
    tokens that a text names get their ids, as the library does without further settings. One lives in each Python worker.
    """

    PROBES = ("a b", " a  b\nc ", "The cat's 12 345.67 (x) ... \n\n\tend", "\u00e9 e\u0301 \ud55c\uad6d\uc5b4 \U0001f600\u200d x", "a\u00a0b\r\nc ---- ## 1 2 3", "a <|endoftext|> b<|endoftext|>c <|startoftext|><|endoftext |>", "End. Word, WHY? no! So: it; x.. \u00e9. \ud55c, It's. a1. (B). <X>. <|endoftext|>.")

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        if any(" " in t.content or "\n" in t.content or t.lstrip or t.rstrip or t.single_word for t in self.model.get_added_tokens_decoder().values()):
            raise ValueError("special tokens that take blanks or look at their neighbours")
        if self.model.get_vocab_size() > 1 << 16:
            raise ValueError("ids of more than two bytes")
        self.known: dict[str, bytes] = {}
        whole = [np.array(self.model.encode(t, add_special_tokens=False).ids, "<u2").tobytes() for t in self.PROBES]
        if whole != self(list(self.PROBES)):
            raise ValueError(f"{path} does not encode words apart from each other")

    def __call__(self, texts: list[str]) -> list[bytes]:
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        split = [t.replace("\n", " ").split(" ") for t in texts]
        parts = []
        for chunk in set().union(*split).difference(known):
            # a mark behind a letter is a piece of its own, and case is folded anyway where a special token cannot be; PROBES prove both
            word, mark = (chunk[:-1], chunk[-1]) if chunk[-1:] in MARKS and chunk[-2:-1].isalpha() else (chunk, "")
            parts.append((chunk, word.lower() if word.isascii() and "<" not in word else word, mark))
        new = list({p[1] for p in parts}.union(MARKS).difference(known))
        for at in range(0, len(new), 4096):
            self._encode(new[at : at + 4096])
        for chunk, word, mark in parts:
            known[chunk] = known[word] + known[mark] if mark else known[word]
        return [b"".join(map(known.__getitem__, chunks)) for chunks in split]

    def _encode(self, chunks: list[str]) -> None:
        """Ids of many chunks by one call over a line of them, told apart by where each id's text starts."""
        e = self.model.encode(" ".join(chunks), add_special_tokens=False)
        first = np.cumsum([0, *(len(c) + 1 for c in chunks)])
        at = np.searchsorted(first, np.fromiter((o[0] for o in e.offsets), np.int64, len(e)), side="right") - 1
        data = np.array(e.ids, "<u2").tobytes()
        bounds = (2 * np.cumsum([0, *np.bincount(at, minlength=len(chunks)).tolist()])).tolist()
        for i, chunk in enumerate(chunks):
            self.known[chunk] = data[bounds[i] : bounds[i + 1]]


def _tokens(path: str) -> _Tokens:
    made = sys.modules[__name__].__dict__.setdefault("_LOADED", {})
    if path not in made:
        made[path] = _Tokens(path)
    return made[path]


def _hashing(seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each two-byte id a slot and a sign, and the projection of slots to dimensions."""
    rng = np.random.default_rng(seed)
    return rng.integers(0, HASHED, 1 << 16), rng.choice([-1.0, 1.0], 1 << 16), rng.normal(size=(HASHED, DIMS)) / np.sqrt(HASHED)


def curve_keys(ids: list[np.ndarray], hashing: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    slots, signs, plane = hashing
    vectors = np.array([np.bincount(slots[x], signs[x], HASHED) for x in ids]).reshape(-1, HASHED)
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    low = (vectors / np.where(norms > 0, norms, 1.0)) @ plane
    cells = np.clip(((np.tanh(4 * low) + 1) / 2 * (1 << BITS)).astype(np.int64), 0, (1 << BITS) - 1)
    return hilbert_index(cells)


def _encode(path: str, end: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, hashing = _tokens(path), _hashing(seed)
        tail = np.array([end], "<u2").tobytes()
        for whole in batches:
            for batch in _slices(whole):
                made = tokens([t or "" for t in batch.column("text").to_pylist()])
                keys = curve_keys([np.frombuffer(x, "<u2") for x in made], hashing)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(keys, pa.int64()), pa.array([x + tail for x in made], pa.binary())], ["doc_id", "curve_key", "ids"]
                )

    return run


def _slices(batch: pa.RecordBatch, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of at most about ``most`` bytes of text, or of one row."""
    start = held = 0
    for i, value in enumerate(batch.column("text")):
        n = value.as_buffer().size if value.is_valid else 0
        if held and held + n > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < batch.num_rows:
        yield batch.slice(start)


def cut(sizes: Iterator[tuple[object, int]], length: int) -> Iterator[tuple[object, int, int, int, int]]:
    """(document, start, length, sequence, offset) pieces of documents laid end to end in sequences.

    A sequence is ``length`` long. What remains at the end goes to sequences whose lengths are the powers
    of two of its size, largest first.
    """
    sequence, at = 0, 0
    last: list[tuple[object, int, int]] = []
    for key, n in sizes:
        start = 0
        while start < n:
            take = min(n - start, length - at)
            last.append((key, start, take))
            start, at = start + take, at + take
            if at == length:
                offset = 0
                for k, s, m in last:
                    yield k, s, m, sequence, offset
                    offset += m
                sequence, at, last = sequence + 1, 0, []
    left, room, offset = at, 0, 0
    for key, start, n in last:
        while n:
            if not room:
                room = 1 << (left.bit_length() - 1)
                left, offset = left - room, 0
            take = min(n, room)
            yield key, start, take, sequence, offset
            start, n, room, offset = start + take, n - take, room - take, offset + take
            if not room:
                sequence += 1


def _pack(length: int, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[object, np.ndarray]] = {}

        def documents() -> Iterator[tuple[int, int, int]]:
            row = 0
            for batch in batches:
                for part, doc, ids in zip(batch.column("part").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("ids"), strict=True):
                    held[row] = (doc, np.frombuffer(ids.as_buffer(), "<u2").astype("<u4"))
                    yield part, row, len(held[row][1])
                    row += 1

        out: list[tuple] = []
        for part, rows in groupby(documents(), key=lambda x: x[0]):
            for row, start, n, sequence, offset in cut(((r, k) for _, r, k in rows), length):
                doc, ids = held[row]
                piece = ids[start : start + n]
                out.append((doc, start, n, zlib.crc32(piece.tobytes()), len(ids), (part << 40) + sequence, offset, *([piece.tobytes()] if keep_ids else [])))
                if start + n == len(ids):
                    del held[row]
                if len(out) >= (512 if keep_ids else 8192):
                    yield _batch(out)
                    out = []
        if out:
            yield _batch(out)

    def _batch(out: list[tuple]) -> pa.RecordBatch:
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *(["ids"] if keep_ids else [])]
        kinds = [pa.int64()] * 7 + [pa.binary()] * keep_ids
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return run


def _in_ranges(keyed: DataFrame) -> tuple[DataFrame, int]:
    """``keyed`` with ``part``, its range of the curve, and the number of ranges of about ``RANGE_BYTES`` of ids each.

    Bounds come from a histogram of fixed size over cells of the curve. A cell that is heavier than a range is dealt out by hash.
    """
    cell = F.shiftright("curve_key", DIMS * BITS - CELL_BITS).cast("int")
    cells = sorted(keyed.groupBy(cell.alias("cell")).agg(F.sum(F.length("ids")).alias("n")).collect())
    most = max(RANGE_BYTES, sum(r["n"] for r in cells) // MOST_RANGES)
    placed, part, room = [], -1, 0
    for r in cells:
        k = -(-r["n"] // most)
        if k > 1 or r["n"] > room:
            placed.append((r["cell"], part + 1, k))
            part, room = part + k, most - r["n"] if k == 1 else 0
        else:
            placed.append((r["cell"], part, 1))
            room -= r["n"]
    plan = keyed.sparkSession.createDataFrame(placed, "cell int, first long, k long")
    dealt = keyed.withColumn("cell", cell).join(F.broadcast(plan), "cell").withColumn("part", F.expr("first + pmod(tie, k)"))
    return dealt.select("part", "curve_key", "tie", "doc_id", "ids"), max(1, part + 1)


def pack_along_curve(
    docs: DataFrame, tokenizer: str, length: int = 4096, end: int = 2, seed: int = 5, keep_ids: bool = True
) -> DataFrame:
    """Pieces of token sequences: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids.

    ``tokenizer`` is the path of a tokenizers file that every executor has. Each document is its ids and then
    ``end``; ``ids`` has a piece's ids as little-endian unsigned 32-bit integers.

    A null or empty text is its end id alone. Null and repeated doc_ids are packed row by row. Documents of
    equal keys (copies) are spread by a hash, so a key with a third of all rows still splits. An empty table
    gives no pieces. Other columns of ``docs`` are not read. Reruns give the same pieces.
    """
    ship_package(docs.sparkSession)
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    encoded = checkpoint(picked.mapInArrow(_encode(tokenizer, end, seed), "doc_id long, curve_key long, ids binary"))
    laid, parts = _in_ranges(encoded.withColumn("tie", F.xxhash64("doc_id", "ids")))
    laid = laid.repartitionById(parts, F.col("part").cast("int")).sortWithinPartitions("part", "curve_key", "tie", "doc_id")
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids binary" * keep_ids
    return laid.select("part", "doc_id", "ids").mapInArrow(_pack(length, keep_ids), schema)
