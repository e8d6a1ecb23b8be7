"""Whitening of embeddings by covariance sums of every dimension pair, made in one Spark aggregation.

Entries become integers, ``x = floor(scale * c)``. The fit list has each distinct vector once. A first aggregation gives its
size and sums; the second has one generated SQL sum for each pair (i, j), i <= j, of products of entries centred by
the nearest integer to the mean. Such products and sums are whole numbers and exact below 2**53, so they do not depend on the order
of rows; what is left of the mean, at most a half, is taken off with exact integers on the driver, where LAPACK
decomposes the covariance. The driver holds a dimension's square of numbers, whatever the table's size.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stallwise.llm.common import unused
from stallwise.session import stored

#: Pairs that one aggregation sums; vectors of more than 69 dimensions take several.
PAIRS = 2_500


def pair_sums(n_dims: int, shifts: list[int], vector: str = "x") -> tuple[list[str], list[str]]:
    """SQL for centred entries ``c0, c1, ...`` and for the sum ``s{i}_{j}`` of every pair of the upper triangle.

    Both are never null, which spares a test for each row and pair.
    """
    entries = [f"coalesce(cast({vector}[{i}] - ({m}L) as double), 0d) AS c{i}" for i, m in enumerate(shifts)]
    sums = [f"sum(c{i} * c{j}) AS s{i}_{j}" for i in range(n_dims) for j in range(i, n_dims)]
    return entries, sums


def _covariance(fit: DataFrame, n: int, sums: list[int]) -> np.ndarray:
    d = len(sums)
    shifts = [round(Fraction(s, n)) for s in sums]
    entries, pairs = pair_sums(d, shifts)
    centred = fit.selectExpr(*entries)
    found: dict[str, float] = {}
    for at in range(0, len(pairs), PAIRS):
        found |= centred.selectExpr(*pairs[at : at + PAIRS]).first().asDict()
    left = [s - n * m for s, m in zip(sums, shifts, strict=True)]
    out = np.zeros((d, d))
    for i in range(d):
        for j in range(i, d):
            out[i, j] = out[j, i] = float((n * Fraction(found[f"s{i}_{j}"]) - left[i] * left[j]) / (n * n))
    return out


def components(covariance: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues, falling, and their unit eigenvectors as columns; those without variance are left out."""
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1][:most], vectors[:, ::-1][:, :most]
    real = values > 1e-12 * max(np.trace(covariance), 1e-300)
    return values[real], vectors[:, real]


def _projection(vector: str, mean: np.ndarray, weights: np.ndarray) -> str:
    """SQL for the dot product of a centred vector and ``weights``."""
    return " + ".join(f"({vector}[{i}] - {m!r}d) * {w!r}d" for i, (m, w) in enumerate(zip(mean.tolist(), weights.tolist(), strict=True)))


def whiten(df: DataFrame, vector: str = "embedding", most: int = 4, scale: int = 256) -> DataFrame:
    """Each row's whitened components, a row for each; the callers' other columns stay.

    Adds component (from 1, by falling variance), n (distinct vectors), deviation (exact sum over dimensions of
    (n*x - S)**2), whitened, explained (a share of the variance) and identity_error (how far the covariance of the whitened
    distinct vectors is from the identity, one value). A column of the same name as one of these, regardless of case, is replaced.

    Rows are left out whose vector is null or holds a null, NaN or infinite entry. Vectors that are shorter than the longest
    count as padded with zeros. Repeated rows stay and count once in the fit; ties in variance are
    in LAPACK's order. Components without variance are left out, so a table of a single distinct vector, an empty table and empty vectors
    give no rows. Entries of any size to 2**31 / scale are taken.
    """
    spark = df.sparkSession
    added = {"component", "n", "deviation", "whitened", "explained", "identity_error"}
    kept = [c for c in df.columns if c.lower() not in added and c != vector]
    x, = unused(df.columns, "x")
    entry = lambda c: F.floor(c.cast("double") * F.lit(float(scale))) + F.lit(0)
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf"))
    rows = df.where(F.col(vector).isNotNull()).where(F.forall(vector, finite)).select(*kept, F.transform(vector, entry).alias(x))
    d = rows.agg(F.max(F.size(x))).first()[0] or 0
    empty = rows.select(*kept, F.lit(0).alias("component"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("deviation"), *[F.lit(0.0).alias(c) for c in ("whitened", "explained", "identity_error")]).where("false")
    if d == 0:
        return empty
    rows = rows.withColumn(x, F.when(F.size(x) < d, F.concat(x, F.array_repeat(F.lit(0).cast("long"), F.lit(d) - F.size(x)))).otherwise(F.col(x)))
    fit = stored(rows.select(F.col(x).alias("x")).distinct())
    totals = fit.selectExpr("count(1) AS n", *[f"sum(x[{i}]) AS s{i}" for i in range(d)]).first()
    n, sums = totals["n"], [totals[f"s{i}"] for i in range(d)]
    covariance = _covariance(fit, n, sums)
    values, vectors = components(covariance, most)
    k = len(values)
    if k == 0:
        return empty
    mean = np.array([float(Fraction(s, n)) for s in sums])
    weights = vectors / np.sqrt(values)
    white = fit.selectExpr(*[f"{_projection('x', mean, weights[:, i])} AS w{i}" for i in range(k)])
    products = white.selectExpr(*[f"avg(w{i}) AS m{i}" for i in range(k)], *[f"avg(w{i} * w{j}) AS p{i}_{j}" for i in range(k) for j in range(i, k)]).first()
    error = max(abs(products[f"p{i}_{j}"] - products[f"m{i}"] * products[f"m{j}"] - (i == j)) for i in range(k) for j in range(i, k))
    deviation = " + ".join(f"({n}L * {x}[{i}] - ({s}L)) * ({n}L * {x}[{i}] - ({s}L))" for i, s in enumerate(sums))
    share = values / np.trace(covariance)
    each = ", ".join(f"struct({i + 1} AS component, {_projection(x, mean, weights[:, i])} AS whitened, {float(share[i])!r}d AS explained)" for i in range(k))
    out = rows.select(*kept, F.expr(deviation).alias("deviation"), F.expr(f"array({each})").alias(x)).select(*kept, "deviation", F.explode(x).alias(x))
    return out.select(
        *kept, F.col(f"{x}.component").alias("component"), F.lit(n).cast("long").alias("n"), "deviation",
        F.col(f"{x}.whitened").alias("whitened"), F.col(f"{x}.explained").alias("explained"), F.lit(error).alias("identity_error"),
    )
