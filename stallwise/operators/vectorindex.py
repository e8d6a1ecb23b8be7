"""Nearest vectors for many queries: exactly, in blocks of queries, and through an index of cells.

The index is a coarse quantiser: k-means over a bounded sample gives centroids, every row goes to its nearest one's cell. A query meets the rows
of its nearest cells only, by an equi-join on the cell; large cells are cut into parts. What it finds is ranked by
exact cosines. Where too few rows of these cells pass the callers' filter, a query takes more cells, in the end all.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stallwise.session import checkpoint, ship_package

#: Rows that the centroids are fitted on at most, rows of a cell that one task compares, and queries that a task meets at once.
SAMPLE, PART, BLOCK = 20_000, 20_000, 1_000


def _unit(column: pa.ChunkedArray | pa.Array, dims: int) -> np.ndarray:
    """Vectors as unit rows; other lengths than ``dims`` and zero vectors are zeros, whose cosine is 0."""
    lists = column.to_pylist()
    out = np.zeros((len(lists), dims))
    for i, v in enumerate(lists):
        if v is not None and len(v) == dims and None not in v:
            out[i] = v
    norm = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return np.divide(out, norm, out=np.zeros_like(out), where=norm > 0)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` largest scores, ties to the least id."""
    if len(scores) > 4 * k:
        near = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    else:
        near = np.arange(len(scores))
    return near[np.lexsort((ids[near], -scores[near]))[:k]]


def _top(rows: DataFrame, k: int) -> DataFrame:
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return rows.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", "id", "score", "rank")


def nearest_many(vectors: DataFrame, queries: DataFrame, k: int, key: str = "id") -> DataFrame:
    """Exactly the ``k`` nearest rows (query_id, id, score, rank) of each query (query_id, embedding), by cosine, ties by id.

    Queries are a stated set that the driver holds in blocks of ``BLOCK``; each block is one scan, of which every task keeps its own best.
    """
    ship_package(vectors.sparkSession)
    asked = [(r["query_id"], r["embedding"]) for r in queries.select("query_id", "embedding").collect()]
    rows = vectors.where(F.col("embedding").isNotNull()).select(F.col(key).cast("long").alias("id"), "embedding")
    found = None
    for at in range(0, len(asked), BLOCK):
        part = rows.mapInArrow(_scan(asked[at : at + BLOCK], k), "query_id long, id long, score double")
        found = part if found is None else found.unionByName(part)
    return _top(found if found is not None else rows.selectExpr("id AS query_id", "id", "0d AS score").where("false"), k)


def _scan(asked: list[tuple], k: int):
    dims = max((len(v) for _, v in asked), default=0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = _unit(pa.array([v for _, v in asked], pa.list_(pa.float64())), dims)
        kept: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0), np.empty(0, np.int64))] * len(asked)
        for batch in batches:
            ids = batch.column("id").to_numpy(zero_copy_only=False)
            scores = q @ _unit(batch.column("embedding"), dims).T
            for i in range(len(asked)):
                s, n = np.r_[kept[i][0], scores[i]], np.r_[kept[i][1], ids]
                best = _best(s, n, k)
                kept[i] = (s[best], n[best])
        yield from _rows([a for a, _ in asked], kept)

    return run


def _rows(query_ids: list, kept: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    qs = np.repeat(np.array(query_ids, np.int64), [len(s) for s, _ in kept])
    if len(qs):
        yield pa.RecordBatch.from_arrays([pa.array(qs), pa.array(np.concatenate([n for _, n in kept]).astype(np.int64)), pa.array(np.concatenate([s for s, _ in kept]))], ["query_id", "id", "score"])


@dataclass(frozen=True)
class Cells:
    """Centroids as unit rows, the rows (cell, part, id, embedding and callers' columns) and the cells' sizes."""

    centroids: np.ndarray
    rows: DataFrame
    parts: dict[int, int]


def fit_centroids(vectors: DataFrame, n_cells: int, key: str = "id", rounds: int = 12) -> np.ndarray:
    """Spherical k-means over the at most ``SAMPLE`` rows of least hashed id; deterministic."""
    some = vectors.where(F.col("embedding").isNotNull()).orderBy(F.xxhash64(F.col(key)), key).limit(SAMPLE).select("embedding").collect()
    lists = [r["embedding"] for r in some]
    dims = max((len(v) for v in lists), default=1)
    x = _unit(pa.array(lists, pa.list_(pa.float64())), dims)
    x = np.unique(x[(x != 0).any(axis=1)], axis=0)
    if not len(x):
        return np.zeros((1, dims))
    c = x[np.random.default_rng(0).permutation(len(x))[:n_cells]]
    for _ in range(rounds):
        own = (x @ c.T).argmax(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        norm = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        c = np.where(norm > 0, sums / np.where(norm > 0, norm, 1), c)
    return c


def _nearest_cells(centroids: np.ndarray, probes: int, name: str):
    """Each batch with a row for each of the ``probes`` nearest cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                near = np.argsort(-(_unit(batch.column("embedding"), centroids.shape[1]) @ centroids.T), axis=1, kind="stable")[:, :probes]
                table = pa.Table.from_batches([batch]).take(pa.array(np.repeat(np.arange(batch.num_rows), near.shape[1])))
                yield from table.append_column(name, pa.array(near.ravel().astype(np.int32))).to_batches()

    return run


def build(vectors: DataFrame, path: str, n_cells: int | None = None, key: str = "id") -> Cells:
    """The index of all rows of ``vectors`` with a vector, written below ``path`` in folders by cell.

    ``n_cells`` is the square root of the rows' number by default, 4,096 at most.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    rows = vectors.where(F.col("embedding").isNotNull())
    if n_cells is None:
        n_cells = min(4096, max(1, round(rows.count() ** 0.5)))
    centroids = fit_centroids(rows, n_cells, key)
    rows = rows.withColumnRenamed(key, "id")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    rows.mapInArrow(_nearest_cells(centroids, 1, "cell"), f"{fields}, cell int").repartition("cell", F.pmod(F.xxhash64("id"), F.lit(8))).write.mode("overwrite").partitionBy("cell").parquet(path)
    table = spark.read.parquet(path)
    sizes = {r["cell"]: r["count"] for r in table.groupBy("cell").count().collect()}
    return Cells(centroids, table, {c: -(-n // PART) for c, n in sizes.items()})


def _compare(k: int, dims: int):
    def run(queries: pa.Table, rows: pa.Table) -> pa.Table:
        ids = rows.column("id").to_numpy()
        scores = _unit(queries.column("embedding"), dims) @ _unit(rows.column("embedding"), dims).T if len(rows) else np.zeros((len(queries), 0))
        kept = [(s[b := _best(s, ids, k)], ids[b]) for s in scores]
        made = list(_rows(queries.column("query_id").to_pylist(), kept))
        return pa.Table.from_batches(made) if made else pa.table({"query_id": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})

    return run


def search(index: Cells, queries: DataFrame, k: int, probes: int = 8, passing: DataFrame | None = None) -> DataFrame:
    """The ``k`` nearest of the index's rows (query_id, id, score, rank) in the ``probes`` cells nearest to each query (query_id, embedding).

    ``passing`` (id) is what the callers' filter keeps. Queries with fewer than ``k`` rows take four times as many cells,
    and so on until all, whose result is exact. A cell of more than ``PART`` rows is compared in parts.
    """
    ship_package(index.rows.sparkSession)
    cells, dims = len(index.centroids), index.centroids.shape[1]
    rows = index.rows.select("id", "embedding", "cell")
    if passing is not None:
        rows = rows.join(passing.select("id").distinct(), "id", "left_semi")
    spread = F.create_map(*[F.lit(x) for c, n in index.parts.items() for x in (c, n)]) if index.parts else F.create_map(F.lit(0), F.lit(1))
    n_parts = F.coalesce(F.try_element_at(spread, F.col("cell")), F.lit(1))
    rows = rows.select(F.col("id").cast("long").alias("id"), "embedding", "cell", F.pmod(F.xxhash64("id"), n_parts).cast("int").alias("part"))
    left, found = checkpoint(queries.select(F.col("query_id").cast("long").alias("query_id"), "embedding")), None
    kind = left.schema["embedding"].dataType.simpleString()
    while True:
        probes = min(probes, cells)
        asked = left.mapInArrow(_nearest_cells(index.centroids, probes, "cell"), f"query_id long, embedding {kind}, cell int").withColumn("part", F.explode(F.sequence(F.lit(0), n_parts - 1)))
        met = asked.groupBy("cell", "part").cogroup(rows.groupBy("cell", "part")).applyInArrow(_compare(k, dims), "query_id long, id long, score double")
        best = checkpoint(_top(met, k))
        full = best.groupBy("query_id").count().where(F.col("count") >= k).select("query_id")
        done = best if probes == cells else best.join(full, "query_id", "left_semi")
        found = done if found is None else found.unionByName(done)
        if probes == cells:
            return found
        left = checkpoint(left.join(full, "query_id", "left_anti"))
        if not left.take(1):
            return found
        probes *= 4
