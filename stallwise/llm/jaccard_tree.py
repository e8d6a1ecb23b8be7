"""Exact n-gram Jaccard self-join with signature trees.

A document is its set of hashed word shingles. Documents with equal sets are one *class*. A pair of classes
with Jaccard similarity t or more must share one of its first ``n - ceil(t n) + 1`` shingles in any common
order, so the roots of the trees are the blocks of classes that have such a prefix shingle in common.

The order puts shingles that many documents share last. Which these are is read from a sketch of fixed size, in which every
shingle of every document counts at its hash's bucket; an order by such a sketch is as exact as any. A passage that
a third of all documents share is then no key at all, unless a document consists of little else.

A block of up to ``LEAF`` classes is one signature tree: leaves are classes, inner nodes hold the OR of their members' token
bitmaps, size ranges and least bit counts, and a dual traversal of the tree with itself drops node pairs whose largest
possible overlap is too small. A bitmap has as many bits as its set has members or up to twice as many, so it stays
selective, and folds in half to meet a smaller one. Blocks of the same members are one tree. The pairs that the traversal leaves
form a graph, of which a spanning forest is kept; the forests of all trees join classes to *families*, beyond which no tree
has a possible pair. A family's sets are shipped once and checked where its own tree leaves a pair.

A block of more classes is first compared, by bitmaps, with its routing class, the one that most large blocks have, which is
linear in the block and puts most near copies into one family. A family of more than ``LEAF`` classes is checked in leaves
of neighbours by size, and against its routing class. If a large block or family is in several components still, its classes are
laid out in order of (outside of the largest component, size) in leaves of about ``LEAF``; pairs of leaves are dropped by
size range and component range, and the trees of each remaining pair are traversed against each other.

Every link is checked against whole shingle sets; nothing is capped or sampled. Shingles and sets are compared by 64-bit hashes.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stallwise.session import checkpoint, ship_package

#: Documents beyond a bucket's usual count that make its shingles common ones, and buckets.
HOT = 256
BUCKETS, PART = 1 << 18, 1 << 12
#: Least and most bits of a bitmap.
BITS, MOST_BITS = 512, 1 << 17
#: Classes of a tree, and partners of a class that one task compares.
LEAF = CHUNK = 256
#: Parts over which the rows of a common shingle are dealt.
SALTS = 64
#: Rows that one reading of a class's text serves.
TAGS = 10_000
#: Sets of more shingles are compared one pair at a time.
LONG = 1 << 14
#: Rows below which a table of class ids is broadcast; above it is joined by a shuffle.
SMALL_ROWS = 500_000
REMEMBERED = 600_000


# -- sets --------------------------------------------------------------------------------------------


class _Hashes(dict):
    """Word to 64-bit hash, emptied when it grows past a bound; one a Python worker."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def _hashes() -> _Hashes:
    made = sys.modules[__name__].__dict__.setdefault("_WORDS", _Hashes())
    if len(made) > REMEMBERED:
        made.clear()
    return made


def shingle_set(text: str | None, size: int = 4) -> np.ndarray:
    """Sorted distinct hashes (int64) of the ``size``-word shingles of a whole text, A-Z lower-cased.

    A text of fewer words is one shingle; one without words, or null, has none.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.int64)
    known = _hashes()
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    size = min(size, len(h))
    out = np.full(len(h) - size + 1, size, np.uint64)
    for i in range(size):
        out ^= h[i : len(h) - size + 1 + i]
        out *= np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(32)
    return np.unique(out.view(np.int64))


def bitmap(shingles: np.ndarray) -> np.ndarray:
    """A bit for each shingle's low bits, as int64 words; as many bits as the next power of two of the set's size, within bounds."""
    m = min(MOST_BITS, max(BITS, 1 << (len(shingles) - 1).bit_length())) if len(shingles) else BITS
    flags = np.zeros(m, np.uint8)
    flags[shingles & (m - 1)] = 1
    return np.packbits(flags).view(np.int64)


def prefix_length(n: int, percent: int) -> int:
    return n - (percent * n + 99) // 100 + 1


def _slices(batch: pa.RecordBatch, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    start = held = 0
    for i, value in enumerate(batch.column("text")):
        n = value.as_buffer().size if value.is_valid else 0
        if held and held + n > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < batch.num_rows:
        yield batch.slice(start)


def _class_id(shingles: np.ndarray) -> int | None:
    return int(np.uint64(xxhash.xxh3_64_intdigest(shingles.tobytes())).view(np.int64)) if len(shingles) else None


def _describe(size: int):
    """A row for each document, and at a partition's end the parts of its bucket counts."""
    names = ["doc_id", "tid", "cid", "n", "bits", "part", "counts"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.int32(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(BUCKETS, np.int64)
        for whole in batches:
            for batch in _slices(whole):
                sets = [shingle_set(t, size) for t in batch.column("text").to_pylist()]
                seen += np.bincount(np.concatenate(sets) & (BUCKETS - 1), minlength=BUCKETS)
                none = [None] * len(sets)
                columns = [batch.column("doc_id"), batch.column("tid"), [_class_id(s) for s in sets], [len(s) for s in sets], [bitmap(s) for s in sets], none, none]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)
        parts = [p for p in range(BUCKETS // PART) if seen[p * PART : (p + 1) * PART].any()]
        if parts:
            none = [None] * len(parts)
            columns = [none, none, none, none, none, parts, [seen[p * PART : (p + 1) * PART].tobytes() for p in parts]]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return run


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sums of the counts of each part."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, counts in zip(batch.column("part").to_pylist(), batch.column("counts"), strict=True):
            total[part] = total.get(part, 0) + np.frombuffer(counts.as_buffer(), np.int64)
    if total:
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([c.tobytes() for c in total.values()], pa.binary())], ["part", "counts"])


def common_buckets(parts: DataFrame) -> np.ndarray:
    """Which buckets count far more than the mean: eight standard deviations of a Poisson count, and ``HOT``.

    Sums in two steps, and gets one array of fixed size to the driver.
    """
    schema = "part int, counts binary"
    some = parts.withColumn("_salt", F.spark_partition_id() % 64).repartition("part", "_salt").select("part", "counts").mapInArrow(_add, schema)
    counts = np.zeros(BUCKETS, np.int64)
    for row in some.repartition("part").mapInArrow(_add, schema).collect():
        counts[row["part"] * PART : (row["part"] + 1) * PART] = np.frombuffer(row["counts"], np.int64)
    return counts > counts.mean() + 8 * np.sqrt(counts.mean()) + HOT


def _prefixes(size: int, percent: int, common: np.ndarray):
    """A row (token, late, cid) for each prefix shingle, in hash order with common (``late``) ones last.

    A class gives its rows once for each run of up to ``REMEMBERED`` classes of a task, so copies hardly add any.
    """
    packed = np.packbits(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = np.unpackbits(packed)[:BUCKETS].astype(bool)
        given: set[int] = set()
        for whole in batches:
            for batch in _slices(whole):
                tokens, lates, cids, sizes = [], [], [], []
                if len(given) > REMEMBERED:
                    given.clear()
                for text in batch.column("text").to_pylist():
                    s = shingle_set(text, size)
                    cid = _class_id(s)
                    if cid is None or cid in given:
                        continue
                    given.add(cid)
                    p, late = prefix_length(len(s), percent), last[s & (BUCKETS - 1)]
                    first = s[~late][:p]
                    rest = s[late][: p - len(first)]
                    tokens += [first, rest]
                    lates += [len(first), len(rest)]
                    cids.append(cid)
                    sizes.append(len(first) + len(rest))
                if cids:
                    late = np.repeat(np.tile([False, True], len(cids)), lates)
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens)), pa.array(late), pa.array(np.repeat(np.array(cids, np.int64), sizes))], ["token", "late", "cid"])

    return run


def _blocks(leaf: int):
    """Member lists of the tokens that several classes have; rows come sorted by (token, cid).

    A ``large`` block is more than ``leaf`` members, or of a late token, and comes in several lists.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["token", "large", "members"]
        kept_t, kept_c, kept_l = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)
        open_large = None

        def lists(t: np.ndarray, c: np.ndarray, large: np.ndarray) -> pa.RecordBatch:
            starts = np.r_[True, t[1:] != t[:-1]]
            offsets = np.r_[np.flatnonzero(starts), len(t)].astype(np.int32)
            return pa.RecordBatch.from_arrays([pa.array(t[starts]), pa.array(large[starts]), pa.ListArray.from_arrays(pa.array(offsets), pa.array(c))], names)

        def closed(t: np.ndarray, c: np.ndarray, late: np.ndarray, partly: int | None) -> Iterator[pa.RecordBatch]:
            if not len(t):
                return
            at = np.flatnonzero(np.r_[True, t[1:] != t[:-1]])
            n = np.diff(np.r_[at, len(t)])
            large = late[at] | (n > leaf) | (t[at] == partly if partly is not None else False)
            keep = np.repeat((n > 1) | large, n)
            if keep.any():
                yield lists(t[keep], c[keep], np.repeat(large, n)[keep])

        for batch in batches:
            if not batch.num_rows:
                continue
            t, c, late = (batch.column(k).to_numpy(zero_copy_only=False) for k in ("token", "cid", "late"))
            t, c, late = np.r_[kept_t, t], np.r_[kept_c, c], np.r_[kept_l, late]
            new = np.r_[True, (t[1:] != t[:-1]) | (c[1:] != c[:-1])]
            t, c, late = t[new], c[new], late[new]
            tail = int(np.searchsorted(t, t[-1]))
            if len(t) - tail > leaf and t[-1] != open_large:
                yield from closed(t[:tail], c[:tail], late[:tail], open_large)
                open_large, t, c, late, tail = t[-1], t[tail:], c[tail:], late[tail:], 0
            if t[-1] == open_large:
                tail = len(t) - 1
            yield from closed(t[:tail], c[:tail], late[:tail], open_large)
            kept_t, kept_c, kept_l = t[tail:], c[tail:], late[tail:]
        yield from closed(kept_t, kept_c, kept_l, open_large)

    return run


# -- signature trees ---------------------------------------------------------------------------------


def _count(words: np.ndarray) -> np.ndarray:
    return np.bitwise_count(words.view(np.uint64)).sum(axis=-1, dtype=np.int64)


def tree_pairs(n: np.ndarray, bits: list[np.ndarray], group: np.ndarray, side: np.ndarray, percent: int, fan: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of members of different groups that may reach ``percent``, by dual tree traversal.

    ``side`` is 0 or 1 for members of two chunks that are compared with each other only, or 2 for all members of
    a chunk that is compared with itself. Members whose bitmaps are equally long share a tree; for members on
    either side of a step in length, which is a step in size, the longer bitmaps are folded.
    """
    width = np.array([len(x) for x in bits])
    found = []
    for w in np.unique(width):
        own = np.flatnonzero(width == w)
        found.append(_tree(own, n, np.stack([bits[k] for k in own]), group, side, percent, fan))
        step = w * 64
        low = own[100 * n[own].astype(np.int64) > percent * step]
        high = np.flatnonzero((width == 2 * w) & (percent * n.astype(np.int64) <= 100 * step))
        if len(low) and len(high):
            folded = [bits[k] for k in low] + [bits[k][:w] | bits[k][w:] for k in high]
            both = np.r_[low, high]
            i, j = _tree(both, n, np.stack(folded), group, side, percent, fan)
            apart = width[i] != width[j]
            found.append((i[apart], j[apart]))
    return np.concatenate([i for i, _ in found]), np.concatenate([j for _, j in found])


def _tree(rows: np.ndarray, n: np.ndarray, bits: np.ndarray, group: np.ndarray, side: np.ndarray, percent: int, fan: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((bits[:, 0], n[rows]))
    rows, bits = rows[order], bits[order]
    size, g, s = n[rows].astype(np.int64), group[rows], side[rows]
    levels = [(size, size, bits, _count(bits), g, g, s, s)]
    while len(levels[-1][0]) > fan:
        low, high, ored, ones, g0, g1, s0, s1 = levels[-1]
        at = np.arange(0, len(low), fan)
        least, most = np.minimum.reduceat, np.maximum.reduceat
        levels.append((least(low, at), most(high, at), np.bitwise_or.reduceat(ored, at, axis=0), least(ones, at), least(g0, at), most(g1, at), least(s0, at), most(s1, at)))
    a, b = np.triu_indices(len(levels[-1][0]))
    shift = np.arange(fan)
    for depth in range(len(levels) - 1, -1, -1):
        low, high, ored, ones, g0, g1, s0, s1 = levels[depth]
        if depth < len(levels) - 1:
            m = len(low)
            a, b = (a[:, None, None] * fan + shift[None, :, None] + 0 * shift[None, None, :]).ravel(), (b[:, None, None] * fan + shift[None, None, :] + 0 * shift[None, :, None]).ravel()
            inside = (a < m) & (b < m) & (a <= b)
            a, b = a[inside], b[inside]
        if depth == 0:
            a, b = a[a < b], b[a < b]
        apart = ~((g0[a] == g1[a]) & (g0[b] == g1[b]) & (g0[a] == g0[b])) & ~((s0[a] == s1[a]) & (s0[b] == s1[b]) & (s0[a] == s0[b]) & (s0[a] < 2))
        near = (100 * high[a] >= percent * low[b]) & (100 * high[b] >= percent * low[a]) & apart
        a, b = a[near], b[near]
        shared = _count(ored[a] & ored[b])
        lost_a, lost_b = np.maximum(0, ones[a] - shared), np.maximum(0, ones[b] - shared)
        fits = (100 * high[a] - percent * low[b] >= (100 + percent) * lost_a) & (100 * high[b] - percent * low[a] >= (100 + percent) * lost_b)
        a, b = a[fits], b[fits]
    return rows[a], rows[b]


_GROUP = ("root", "p", "q")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
    """Column arrays of whole (root, p, q) groups, which come sorted."""
    held: list[dict] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in batch.schema.names}
        new = np.zeros(batch.num_rows, bool)
        for c in _GROUP:
            new[1:] |= cols[c][1:] != cols[c][:-1]
        starts = np.r_[0, np.flatnonzero(new), batch.num_rows]
        for i, j in zip(starts[:-1], starts[1:], strict=True):
            part = {c: v[i:j] for c, v in cols.items()}
            if held and any(held[-1][c][0] != part[c][0] for c in _GROUP):
                yield {c: np.concatenate([x[c] for x in held]) for c in held[0]}
                held = []
            held.append(part)
    if held:
        yield {c: np.concatenate([x[c] for x in held]) for c in held[0]}


def _sides(g: dict[str, np.ndarray]) -> np.ndarray:
    own = g["p"][0] == g["q"][0]
    return np.full(len(g["leaf"]), 2) if own else (g["leaf"] == g["q"]).astype(np.int64)


def forest(i: np.ndarray, j: np.ndarray, members: int) -> list[tuple[int, int]]:
    """A spanning forest of the graph of pairs (i, j), from the member of most pairs outwards, as (parent, child)."""
    ends = np.r_[i, j]
    order = np.argsort(ends, kind="stable")
    near = np.r_[j, i][order]
    degree = np.bincount(ends, minlength=members)
    first = np.r_[0, np.cumsum(degree)]
    seen = np.zeros(members, bool)
    out = []
    for start in np.argsort(-degree, kind="stable"):
        if seen[start] or not degree[start]:
            continue
        seen[start] = True
        queue = [int(start)]
        for x in queue:
            new = near[first[x] : first[x + 1]]
            new = np.unique(new[~seen[new]])
            seen[new] = True
            queue += new.tolist()
            out += [(x, y) for y in new.tolist()]
    return out


def _traverse(percent: int):
    """(a, b): a spanning forest of the possible pairs of each tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for g in _groups(batches):
            i, j = tree_pairs(g["n"], list(g["bits"]), g["cid"], np.full(len(g["n"]), 2), percent)
            if len(i):
                out += [(int(g["cid"][x]), int(g["cid"][y])) for x, y in forest(i, j, len(g["n"]))]
            if len(out) > 10_000:
                yield _edges(out)
                out = []
        if out:
            yield _edges(out)

    return run


def _edges(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["a", "b"])


def _between(percent: int, longest: int):
    """Of each tree or pair of trees, the members that have a possible partner in another component.

    Pairs with a long set come as pairs: ``b`` is the partner of ``cid``; other members have no ``b``.
    """
    names = [*_GROUP, "leaf", "comp", "cid", "b"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _groups(batches):
            i, j = tree_pairs(g["n"], list(g["bits"]), g["comp"], _sides(g), percent)
            if not len(i):
                continue
            long = np.maximum(g["n"][i], g["n"][j]) > longest
            rows = np.unique(np.r_[i[~long], j[~long]])
            columns = [np.r_[g[c][rows], g[c][i[long]]] for c in names[:-1]]
            b = pa.array(np.r_[np.zeros(len(rows), np.int64), g["cid"][j[long]]], mask=np.r_[np.ones(len(rows), bool), np.zeros(int(long.sum()), bool)])
            yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in columns), b], names)

    return run


def _links(percent: int):
    """Links between components of each group: enough of them to join all that its similar pairs join."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _groups(batches):
            sets = [np.frombuffer(x, np.int64) for x in g["members"]]
            i, j = tree_pairs(np.array([len(x) for x in sets]), [bitmap(x) for x in sets], g["comp"], _sides(g), percent)
            root = {c: c for c in np.unique(g["comp"]).tolist()}

            def find(c: int, root: dict[int, int] = root) -> int:
                while root[c] != c:
                    root[c] = root[root[c]]
                    c = root[c]
                return c

            a, b = [], []
            for x, y in zip(i.tolist(), j.tolist(), strict=True):
                cx, cy = find(int(g["comp"][x])), find(int(g["comp"][y]))
                if cx != cy and similar(sets[x], sets[y], percent):
                    root[max(cx, cy)] = min(cx, cy)
                    a.append(int(g["cid"][x]))
                    b.append(int(g["cid"][y]))
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether the Jaccard similarity of two sorted sets is ``percent`` or more."""
    low, high = (x, y) if len(x) <= len(y) else (y, x)
    if not len(low) or 100 * len(low) < percent * len(high):
        return False
    at = np.searchsorted(high, low)
    at[at == len(high)] = 0
    both = int((high[at] == low).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


# -- checks and components ---------------------------------------------------------------------------


def _ship(size: int, fields: tuple[str, ...]):
    """A row for each tag of a text: the tag's ``fields``, the class and its whole set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _slices(whole, 2 << 20):
                rows: list[tuple] = []
                for text, cid, tags in zip(batch.column("text").to_pylist(), batch.column("cid").to_pylist(), batch.column("tags").to_pylist(), strict=True):
                    data = shingle_set(text, size).tobytes()
                    for t in tags:
                        rows.append((*(t[f] for f in fields), cid, data))
                        if len(rows) >= 1000:
                            yield _batch(rows)
                            rows = []
                if rows:
                    yield _batch(rows)

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64()] * (len(fields) + 1) + [pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [*fields, "cid", "members"])

    return run


def _compare(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, of, last = None, None, None
        for batch in batches:
            a, b = [], []
            for h, role, cid, data in zip(batch.column("hub").to_pylist(), batch.column("role").to_pylist(), batch.column("cid").to_pylist(), batch.column("members"), strict=True):
                members = np.frombuffer(data.as_buffer(), np.int64)
                if role == 0:
                    hub, of, last = h, members, None
                elif h == hub and cid != last:
                    last = cid
                    if similar(of, members, percent):
                        a.append(h)
                        b.append(cid)
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def settled(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """A checkpoint of a table of ids, in no more partitions than its counted rows fill.

    One of a single partition is joined and grouped with others like it without a shuffle.
    """
    made = checkpoint(df)
    return made.coalesce(max(1, -(-made.count() // rows)))


def _small(df: DataFrame, weight: Column | None = None) -> DataFrame:
    """``df`` for a join's lesser side: broadcast where its counted rows, or their ``weight``, are few, else left to a shuffle."""
    size = df.agg(F.sum(F.lit(1) if weight is None else weight).alias("n")).first()["n"] or 0
    return F.broadcast(df) if size <= SMALL_ROWS else df


def _with_sets(docs: DataFrame, classes: DataFrame, tagged: DataFrame, fields: tuple[str, ...], size: int) -> DataFrame:
    """``fields``, cid and members of each row of ``tagged`` (cid and fields): sets computed from one text a class.

    A class of very many tags has its text read several times, for up to about ``TAGS`` each.
    """
    tagged = settled(tagged.select("cid", *[F.col(f).cast("long").alias(f) for f in fields]))
    many = tagged.groupBy("cid").agg(F.ceil(F.count("*") / F.lit(TAGS)).alias("_s")).where("_s > 1")
    tags = tagged.join(_small(many), "cid", "left").withColumn("_s", F.pmod(F.xxhash64(*fields), F.coalesce("_s", F.lit(1))))
    tags = tags.groupBy("cid", "_s").agg(F.collect_list(F.struct(*fields)).alias("tags"))
    wanted = settled(tags.join(classes, "cid").select("cid", "tags", "rep.tid", F.col("rep.doc_id").alias("rep_id")))
    found = docs.join(_small(wanted, F.size("tags") + 1), "tid").where(F.col("doc_id").eqNullSafe(F.col("rep_id"))).select("text", "cid", "tags")
    return found.mapInArrow(_ship(size, fields), ", ".join(f"{f} long" for f in fields) + ", cid long, members binary")


def _verified(docs: DataFrame, classes: DataFrame, pairs: DataFrame, size: int, percent: int) -> DataFrame:
    """Of the class pairs (a, b), those whose whole shingle sets are similar enough.

    The sets of a hub's partners travel to it once, in chunks, each with a copy of the hub's own set.
    """
    pairs = pairs.select("a", "b").distinct()
    many = pairs.groupBy("a").agg(F.ceil(F.count("*") / F.lit(2 * CHUNK)).alias("s")).where("s > 1")
    partner = pairs.join(_small(many), "a", "left").select(F.col("b").alias("cid"), F.col("a").alias("hub"), F.expr("pmod(xxhash64(b), coalesce(s, 1L))").alias("salt"), F.lit(1).alias("role"))
    own = partner.select(F.col("hub").alias("cid"), "hub", "salt", F.lit(0).alias("role")).distinct()
    sets = _with_sets(docs, classes, partner.unionByName(own), ("hub", "salt", "role"), size)
    sorted_ = sets.repartition("hub", "salt").sortWithinPartitions("hub", "salt", "role", "cid")
    return sorted_.mapInArrow(_compare(percent), "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of the undirected ``edges`` (a, b), root the least node that is reachable.

    Alternates large-star and small-star steps, with a checkpoint each, until no edge changes.
    """
    now = settled(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = None
    while True:
        seen = now.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        if seen == state or not seen["n"]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = seen
        turned = lambda *ends: F.inline(F.array(*[F.struct(F.col(x).alias("a"), F.col(y).alias("b")) for x, y in ends]))
        both = now.select(turned(("a", "b"), ("b", "a")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(turned(("b", "m"), ("a", "m"))).where("a <> b")
        now = settled(small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())


def _large_blocks(blocks: DataFrame) -> DataFrame:
    """(root, cid) of the large blocks, joined where they have the same routing class, which is the root.

    A block's routing class is the one of its members that most large blocks have.
    """
    large = settled(blocks.where("large").select("token", F.explode("members").alias("cid")))
    if large.isEmpty():
        return large.select(F.col("token").alias("root"), "cid")
    same = [F.count("*").alias("m"), F.bit_xor(F.xxhash64("cid")).alias("x0"), F.bit_xor(F.xxhash64(F.lit(1), "cid")).alias("x1")]
    one_each = settled(large.groupBy("token").agg(*same).where("m > 1").groupBy("m", "x0", "x1").agg(F.min("token").alias("token")).select("token"))
    large = settled(large.join(_small(one_each), "token"))
    routing = _routing(large.withColumnRenamed("token", "root"), large.groupBy("cid").agg(F.count("*").alias("w"))).withColumnsRenamed({"root": "token", "a": "root"})
    return settled(large.join(_small(routing), "token").select("root", "cid").distinct())


def _routing(member: DataFrame, weights: DataFrame) -> DataFrame:
    """(root, a): of the members (root, cid) of each root the one of most weight."""
    weighed = member.join(_small(settled(weights)), "cid", "left")
    return settled(weighed.groupBy("root").agg(F.max_by("cid", F.struct(F.coalesce("w", F.lit(0)), "cid")).alias("a")))


def _stars(member: DataFrame, routing: DataFrame, shape: DataFrame, percent: int) -> DataFrame:
    """(a, b): each member (root, cid) that may be similar to the routing class (root, a) of its root."""
    pairs = settled(member.join(_small(routing), "root").where("cid <> a").select("a", F.col("cid").alias("b")).distinct())
    a, b = (shape.select(F.col("cid").alias(x), F.col("n").alias(f"n_{x}"), F.col("bits").alias(f"bits_{x}")) for x in "ab")
    hubs = settled(a.join(_small(routing.select("a").distinct()), "a", "left_semi"), 1000)
    return pairs.join(b, "b").join(_small(hubs, F.size("bits_a")), "a").where(_similar_bitmaps(percent)).select("a", "b")


def _laid_out(mine: DataFrame) -> DataFrame:
    """``mine`` (root, cid, out, n and more) with ``leaf``: neighbours in the order of (out, n), about ``LEAF`` a leaf.

    The order is by a histogram of sizes and, within a size, by a hash.
    """
    mine = settled(mine)
    sizes = mine.groupBy("root", "out", "n").agg(F.count("*").alias("k"))
    before = Window.partitionBy("root").orderBy("out", "n").rowsBetween(Window.unboundedPreceding, -1)
    sizes = settled(sizes.select("root", "out", "n", "k", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("k0")))
    return mine.join(_small(sizes), ["root", "out", "n"]).withColumn("leaf", F.expr(f"(k0 + pmod(xxhash64(cid, root), k)) div {LEAF}")).drop("k", "k0")


def _leaf_pairs(member: DataFrame, shape: DataFrame, percent: int) -> DataFrame:
    """Rows (root, cid, comp, p, q, leaf) of the leaves (p, q) that may hold links between components of a root's members."""
    shares = member.groupBy("root", "comp").agg(F.count("*").alias("k"))
    mixed = settled(shares.groupBy("root").agg(F.max_by("comp", F.struct("k", "comp")).alias("main"), F.count("*").alias("c")).where("c > 1").select("root", "main"))
    mine = member.join(_small(mixed), "root").join(shape.select("cid", "n"), "cid").select("root", "cid", "comp", (F.col("comp") != F.col("main")).alias("out"), "n")
    placed = settled(_laid_out(mine))
    nodes = placed.groupBy("root", "leaf").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.min("comp").alias("c0"), F.max("comp").alias("c1"))
    p, q = (nodes.select("root", *[F.col(c).alias(f"{x}_{c}") for c in nodes.columns[1:]]) for x in "pq")
    fits = f"p_leaf <= q_leaf and 100L * p_high >= {percent}L * q_low and 100L * q_high >= {percent}L * p_low and not (p_c0 = p_c1 and q_c0 = q_c1 and p_c0 = q_c0)"
    pairs = settled(p.join(q, "root").where(fits).select("root", F.col("p_leaf").alias("p"), F.col("q_leaf").alias("q")))
    visits = pairs.select("root", "p", "q", F.explode(F.array_distinct(F.array("p", "q"))).alias("leaf"))
    return placed.join(_small(visits), ["root", "leaf"]).select("root", "cid", "comp", "p", "q", "leaf")


def _searched(docs: DataFrame, classes: DataFrame, member: DataFrame, shape: DataFrame, size: int, percent: int) -> DataFrame:
    """Links (a, b) between components (root, p, q, leaf, cid, comp) of each leaf, or pair of leaves p < q."""
    dealt = member.join(shape, "cid").select(*_GROUP, "leaf", "comp", "cid", "n", "bits").repartition(*_GROUP).sortWithinPartitions(*_GROUP)
    left = settled(dealt.mapInArrow(_between(percent, LONG), "root long, p long, q long, leaf long, comp long, cid long, b long"))
    sets = _with_sets(docs, classes, left.where("b is null"), (*_GROUP, "leaf", "comp"), size).repartition(*_GROUP).sortWithinPartitions(*_GROUP, "leaf", "cid")
    links = sets.mapInArrow(_links(percent), "a long, b long")
    long = left.where("b is not null").select(F.col("cid").alias("a"), "b")
    return links if long.isEmpty() else links.unionByName(_verified(docs, classes, long, size, percent))


def _similar_bitmaps(percent: int) -> str:
    """Whether classes a and b may be similar, by their sizes and bitmaps, the longer of which is folded."""
    lost = "aggregate(zip_with({0}, {1}, (x, y) -> bit_count(x & ~y)), 0, (s, x) -> s + x)"
    fold = "zip_with(slice(bits_{0}, 1, size(bits_{1})), slice(bits_{0}, size(bits_{1}) + 1, size(bits_{1})), (x, y) -> x | y)"
    fits = lambda x, y: (
        f"100 * n_a - {percent} * n_b >= {100 + percent} * {lost.format(x, y)} and 100 * n_b - {percent} * n_a >= {100 + percent} * {lost.format(y, x)}"
    )
    return (
        f"100 * n_a >= {percent} * n_b and 100 * n_b >= {percent} * n_a and case when size(bits_a) = size(bits_b) then {fits('bits_a', 'bits_b')} "
        f"when size(bits_a) < size(bits_b) then {fits('bits_a', fold.format('b', 'a'))} else {fits(fold.format('a', 'b'), 'bits_b')} end"
    )


def jaccard_components(docs: DataFrame, text: str = "text", size: int = 4, percent: int = 85) -> DataFrame:
    """A row for each input row: doc_id, n_shingles, component_id, n_class.

    Two documents link when 100 times their sets' intersection is at least ``percent`` times the union;
    ``component_id`` is the least doc_id that links reach, itself included; ``n_class`` counts rows whose set is
    equal. A null, empty or blank text has no shingles and links with nothing, so its component is itself.
    Repeated rows are copies of each other. A null doc_id takes part but is never a component's id unless the
    whole component has none. Columns other than doc_id and the text are not read.
    """
    out = _rooted(docs, text, size, percent)
    return out.select(
        "doc_id",
        F.col("n").cast("long").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
        F.coalesce("n_class", F.lit(1).cast("long")).alias("n_class"),
    )


def first_of_components(docs: DataFrame, text: str = "text", size: int = 4, percent: int = 85) -> DataFrame:
    """The rows of ``docs`` with the least doc_id (null last) of each component, and those without shingles.

    Rows that are equal in doc_id and text are one.
    """
    out = _rooted(docs, text, size, percent)
    first = out.where("n > 0").groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "tid")).alias("x"))
    kept = first.select(F.col("x.doc_id").alias("_id"), F.col("x.tid").alias("_tid")).unionByName(out.where("n = 0").select(F.col("doc_id").alias("_id"), F.col("tid").alias("_tid")).distinct())
    same = F.xxhash64(docs[text]) == kept["_tid"]
    return docs.join(kept, same & docs["doc_id"].cast("long").eqNullSafe(kept["_id"]), "left_semi").dropDuplicates(["doc_id", text])


def _rooted(docs: DataFrame, text: str, size: int, percent: int) -> DataFrame:
    """doc_id, tid, n, cid, root, component_id and n_class of every row; the last three null without shingles."""
    ship_package(docs.sparkSession)
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("tid"))
    described = checkpoint(read.mapInArrow(_describe(size), "doc_id long, tid long, cid long, n int, bits array<long>, part int, counts binary"))
    common = common_buckets(described.where("part is not null").select("part", "counts"))
    sketched = described.where("part is null").drop("part", "counts")
    classes = checkpoint(
        sketched.where("n > 0").groupBy("cid").agg(F.min(F.struct("doc_id", "tid")).alias("rep"), F.min("doc_id").alias("least"), F.count("*").alias("n_class"), F.first("n").alias("n"), F.first("bits").alias("bits"))
    )
    shape = classes.select("cid", "n", "bits")
    rows = read.mapInArrow(_prefixes(size, percent, common), "token long, late boolean, cid long")
    rows = rows.withColumn("_salt", F.when(F.col("late"), F.pmod("cid", F.lit(SALTS)))).repartition("token", "_salt").sortWithinPartitions("token", "_salt", "cid")
    blocks = checkpoint(rows.select("token", "late", "cid").mapInArrow(_blocks(LEAF), "token long, large boolean, members array<long>"))

    # Small blocks: a tree for each list of members.
    lists = blocks.where("not large").select(F.xxhash64("members").alias("root"), "members").groupBy("root").agg(F.first("members").alias("members"))
    trees = settled(lists.select("root", F.explode("members").alias("cid")))
    dealt = trees.join(shape, "cid").repartition("root").sortWithinPartitions("root").select("root", F.lit(0).cast("long").alias("p"), F.lit(0).cast("long").alias("q"), "cid", "n", "bits")
    near = settled(dealt.mapInArrow(_traverse(percent), "a long, b long").distinct())
    # Large blocks: every member against the routing class.
    large = _large_blocks(blocks)
    if not large.isEmpty():
        near = settled(near.unionByName(_stars(large, settled(large.select("root", F.col("root").alias("a")).distinct()), shape, percent)))

    # Families: whole sets are compared in leaves, and in families of several leaves with the routing class too.
    families = components(near)
    families = settled(families.select("root", F.col("node").alias("cid")).unionByName(families.select("root", F.col("root").alias("cid")).distinct()))
    many = settled(families.groupBy("root").agg(F.count("*").alias("k")).where(f"k > {LEAF}").select("root"))
    wide = families.join(_small(many), "root", "left_semi")
    leaves = families.join(_small(many), "root", "left_anti").select("root", "cid", F.lit(0).cast("long").alias("leaf"))
    if not many.isEmpty():
        leaves = leaves.unionByName(_laid_out(wide.join(shape.select("cid", "n"), "cid").select("root", "cid", F.lit(False).alias("out"), "n")).select("root", "cid", "leaf"))
    own = leaves.select("root", "cid", F.col("cid").alias("comp"), F.col("leaf").alias("p"), F.col("leaf").alias("q"), "leaf")
    linked = settled(_searched(read, classes, own, shape, size, percent))
    if not many.isEmpty():
        often = near.groupBy(F.col("a").alias("cid")).agg(F.count("*").alias("w"))
        linked = settled(linked.unionByName(_verified(read, classes, _stars(wide, _routing(wide, often), shape, percent), size, percent)))
    roots = components(linked)

    # What is left: large blocks and families of several components.
    if not (many.isEmpty() and large.isEmpty()):
        of = roots.select(F.col("node").alias("cid"), F.col("root").alias("comp"))
        member = settled(large.unionByName(wide).join(of, "cid", "left").select("root", "cid", F.coalesce("comp", "cid").alias("comp")))
        more = _searched(read, classes, _leaf_pairs(member, shape, percent), shape, size, percent)
        roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more))

    # The least doc_id of each component, back to every row.
    rooted = classes.select("cid", "least", "n_class").join(roots.withColumnRenamed("node", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(least, "root").select("cid", "root", "component_id", "n_class")
    return sketched.select("doc_id", "tid", "n", "cid").join(named, "cid", "left")
