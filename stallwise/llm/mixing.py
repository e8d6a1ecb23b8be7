"""Mixing sources to target weights by min-cost flow.

Documents that belong to the same set of sources are interchangeable for the mix, so the flow network has
one supply node for each *membership pattern*, not for each document. A pattern offers its tokens once at
cost 1, a second time at cost 2, a third at cost 3 (convex), and routes them to the quotas of its sources.
Then documents are selected in seeded order, each pattern giving exactly the tokens that the flow took.

The network is solved on the driver: it has a row a pattern, whose count ``max_patterns`` checks. Everything
that has a row a document stays in Spark: one pass over the texts, and a prefix sum that is dealt out by
(pattern, hash bucket), so a source with a third of all rows is spread over as many buckets as it needs.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Sequence
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from stallwise.llm.common import unused, word_count
from stallwise.session import checkpoint

#: Rows of a hash bucket, on average, that a prefix sum sorts in one task.
BUCKET_ROWS = 5_000
#: Least and most buckets of a pattern, as powers of two.
LEAST_BUCKETS, MOST_BUCKETS = 6, 17
SEED = 17


def water_fill(sizes: Sequence[int], weights: Sequence[int], total: int, most: int) -> list[Fraction]:
    """Shares of ``total`` by weight, none above ``most`` times its size; excess is reshared by weight."""
    shares = [Fraction(0)] * len(sizes)
    open_, left = list(range(len(sizes))), Fraction(total)
    while open_:
        weight = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] > weight * most * sizes[i]]
        if not over:
            for i in open_:
                shares[i] = left * weights[i] / weight
            break
        for i in over:
            shares[i] = Fraction(most * sizes[i])
            left -= shares[i]
        open_ = [i for i in open_ if i not in set(over)]
    return shares


class _Network:
    """Integer max-flow by Dinic's method; arcs may be raised between calls."""

    def __init__(self, nodes: int) -> None:
        self.arcs: list[list[int]] = [[] for _ in range(nodes)]
        self.to: list[int] = []
        self.room: list[int] = []

    def arc(self, a: int, b: int, room: int) -> int:
        self.arcs[a].append(len(self.to))
        self.arcs[b].append(len(self.to) + 1)
        self.to += [b, a]
        self.room += [room, 0]
        return len(self.to) - 2

    def _levels(self, s: int, t: int) -> list[int]:
        level = [-1] * len(self.arcs)
        level[s] = 0
        queue = deque([s])
        while queue:
            a = queue.popleft()
            for e in self.arcs[a]:
                if self.room[e] and level[self.to[e]] < 0:
                    level[self.to[e]] = level[a] + 1
                    queue.append(self.to[e])
        return level

    def augment(self, s: int, t: int) -> None:
        while (level := self._levels(s, t))[t] >= 0:
            at = [0] * len(self.arcs)
            path: list[int] = []
            a = s
            while True:
                if a == t:
                    least = min(self.room[e] for e in path)
                    for e in path:
                        self.room[e] -= least
                        self.room[e ^ 1] += least
                    path, a = [], s
                while at[a] < len(self.arcs[a]):
                    e = self.arcs[a][at[a]]
                    if self.room[e] and level[self.to[e]] == level[a] + 1:
                        path.append(e)
                        a = self.to[e]
                        break
                    at[a] += 1
                else:
                    if a == s:
                        break
                    a = self.to[path.pop() ^ 1]
                    at[a] += 1


def route(capacities: Sequence[int], members: Sequence[Sequence[int]], quotas: Sequence[int], repeats: int = 3) -> list[dict[int, int]]:
    """Cheapest routing of pattern tokens to source quotas: for each pattern, source to tokens.

    The r-th use of a token costs r, whichever source takes it, so every augmenting path costs as its first
    arc. Successive shortest paths are then one max-flow for each use, opening the r-th use of every
    pattern only when no cheaper path is left; earlier flow may still be rerouted between sources.
    """
    p, s = len(capacities), len(quotas)
    net = _Network(p + s + 2)
    source, sink = p + s, p + s + 1
    supply = [net.arc(source, i, 0) for i in range(p)]
    arcs = [{j: net.arc(i, p + j, repeats * capacities[i]) for j in members[i]} for i in range(p)]
    for j, q in enumerate(quotas):
        net.arc(p + j, sink, q)
    for _ in range(repeats):
        for i, e in enumerate(supply):
            net.room[e] += capacities[i]
        net.augment(source, sink)
    return [{j: net.room[e ^ 1] for j, e in row.items() if net.room[e ^ 1]} for row in arcs]


def _documents(docs: DataFrame, sources: Column, size: Column, seed: int) -> DataFrame:
    """Compact rows: pattern (sorted distinct members, null among them), size and seeded order."""
    return docs.select("doc_id", size.alias("size"), sources.alias("pattern"), _row_order(seed, sources).alias("_order"))


def _row_order(seed: int, sources: Column) -> Column:
    return F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text"), _pattern_key(sources))


def _members(sources: Column | None) -> Column:
    """The sorted distinct sources of a row; of a null array the null source."""
    member = F.array(F.col("source")) if sources is None else sources
    return F.coalesce(F.sort_array(F.array_distinct(member)), F.array(F.lit(None).cast("string")))


def _pattern_key(pattern: Column) -> Column:
    """A hash of a pattern that tells a null member from none."""
    return F.xxhash64(F.transform(pattern, lambda x: F.coalesce(F.concat(F.lit("="), x), F.lit("null"))))


def mix_to_weights(docs: DataFrame, *args, **kwargs) -> DataFrame:
    """A row for each row of ``docs``: see ``_mix``, whose row key it leaves out."""
    return _mix(docs, *args, **kwargs).drop("_order")


def mixed_documents(docs: DataFrame, *args, **kwargs) -> DataFrame:
    """The rows of ``docs``, each as often as ``mix_to_weights`` uses it.

    Rows that are equal in doc_id, text and sources are one document here, repeated by the sum of their uses; if they differ
    in other columns, the one whose hash is least stands for them. Columns of any name are kept.
    """
    order, used, use, row = unused(docs.columns, "_order", "_uses", "_use", "_row")
    uses = _mix(docs, *args, **kwargs).groupBy(F.col("_order").alias(order)).agg(F.sum("uses").alias(used)).where(F.col(used) > 0)
    key = _row_order(kwargs.get("seed", SEED), _members(args[0] if args else kwargs.get("sources")))
    keyed = docs.select(key.alias(order), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(row)).groupBy(order).agg(F.min_by(row, F.xxhash64(row)).alias(row))
    again = keyed.join(uses, order).withColumn(use, F.explode(F.sequence(F.lit(1).cast("long"), F.col(used))))
    return again.select(f"{row}.*")


def _mix(
    docs: DataFrame,
    sources: Column | None = None,
    size: Column | None = None,
    weights: Sequence[int] = (1, 2, 3),
    budget: float = 1.0,
    repeats: int = 3,
    seed: int = SEED,
    max_patterns: int = 200_000,
) -> DataFrame:
    """How often the mix uses each document, so that sources come near their target sizes.

    ``sources`` is an array column of a document's sources (default: its ``source`` alone), which may
    overlap between documents; ``size`` is its token count (default: words of ``text``). Sources in code
    point order, null last, weigh ``weights`` in turn and share ``budget`` times all tokens; none gets more
    than ``repeats`` times the tokens of its documents, and what is above goes to the others by weight.

    Returns a row for each input row: doc_id, sources, size, taken (tokens used, repeats counted),
    uses (whole copies), source_size, target and share (its sources' smallest-named one's figures), and
    pattern_taken (tokens the flow takes from its pattern). Uses of one document differ from its pattern's
    mean by less than one, and from run to run they are the same.

    A null source is a source of its own, last; a null or empty text has size 0 and is never used; an
    empty array belongs to no source and is not used. Repeated rows are counted and used row by row. An empty table gives
    no rows. Columns other than doc_id, text and those that ``sources`` and ``size`` name are not read.
    """
    rows = checkpoint(_documents(docs, _members(sources), size if size is not None else word_count(F.col("text")), seed))
    spark = docs.sparkSession

    patterns = rows.groupBy("pattern").agg(F.sum("size").alias("size"), F.count("*").alias("n")).limit(max_patterns + 1).collect()
    if len(patterns) > max_patterns:
        raise ValueError(f"more than {max_patterns} membership patterns; raise max_patterns or coarsen the sources")
    key = lambda x: (x is None, (x or "").encode())
    patterns = sorted(((tuple(sorted(p["pattern"], key=key)), p["size"], p["n"]) for p in patterns), key=lambda x: [key(y) for y in x[0]])
    names = sorted({x for p, _, _ in patterns for x in p}, key=key)
    at = {x: i for i, x in enumerate(names)}
    held = [0] * len(names)
    for p, n, _ in patterns:
        for x in p:
            held[at[x]] += n
    weight = [weights[i % len(weights)] for i in range(len(names))]
    total = int(budget * sum(n for _, n, _ in patterns))
    targets = water_fill(held, weight, min(total, repeats * sum(n for _, n, _ in patterns)), repeats)
    flow = route([n for _, n, _ in patterns], [[at[x] for x in p] for p, _, _ in patterns], [round(t) for t in targets], repeats)

    count = sum(n for _, _, n in patterns)
    buckets = 1 << min(MOST_BUCKETS, max(LEAST_BUCKETS, (max(1, count // BUCKET_ROWS) - 1).bit_length()))
    plan = spark.createDataFrame(
        [
            (list(p), sum(f.values()), held[at[p[0]]] if p else 0, float(targets[at[p[0]]]) if p else 0.0, n, [(names[j], f[j]) for j in sorted(f)])
            for (p, n, _), f in zip(patterns, flow, strict=True)
        ],
        T.StructType(
            [
                T.StructField("pattern", T.ArrayType(T.StringType())),
                T.StructField("pattern_taken", T.LongType()),
                T.StructField("source_size", T.LongType()),
                T.StructField("target", T.DoubleType()),
                T.StructField("pattern_size", T.LongType()),
                T.StructField("routes", T.ArrayType(T.StructType([T.StructField("source", T.StringType()), T.StructField("tokens", T.LongType())]))),
            ]
        ),
    )
    # Prefix sums in seeded order: of buckets within a pattern, then of rows within a bucket.
    rows = rows.withColumns({"_p": _pattern_key(F.col("pattern")), "_b": F.shiftright(F.col("_order"), 64 - (buckets.bit_length() - 1)) if buckets > 1 else F.lit(0).cast("long")})
    sums = rows.groupBy("_p", "_b").agg(F.sum("size").alias("_s"))
    before = Window.partitionBy("_p").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("_p", "_b", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_base"))
    base = base.join(F.broadcast(plan.withColumn("_p", _pattern_key(F.sort_array("pattern"))).drop("pattern")), "_p")
    within = Window.partitionBy("_p", "_b").orderBy("_order", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    start = rows.withColumn("_in", F.coalesce(F.sum("size").over(within), F.lit(0))).join(base, ["_p", "_b"])
    start = start.withColumn("_start", F.col("_base") + F.col("_in"))
    # The pattern's documents, in order, are laid end to end again and again; a use counts where it starts
    # within the tokens taken, at the nearer side, so each pattern is off by half a document at most.
    uses = F.when(
        (F.col("size") > 0) & (F.col("pattern_taken") > 0),
        F.expr(f"least({repeats}L, greatest(0L, (pattern_taken - _start - size div 2 + pattern_size - 1) div pattern_size))"),
    ).otherwise(F.lit(0).cast("long"))
    return start.withColumn("uses", uses).select(
        "doc_id",
        F.col("pattern").alias("sources"),
        "size",
        "source_size",
        "target",
        (F.col("uses") * F.col("size")).alias("taken"),
        "uses",
        "pattern_taken",
        "routes",
        "_order",
    )
