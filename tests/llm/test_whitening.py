"""Whitening against numpy on the same integers."""

from __future__ import annotations

import numpy as np
import pytest

from stallwise.llm.whitening import whiten

SCHEMA = "vec_id long, embedding array<float>"


def brute(vectors: np.ndarray, most: int = 4):
    x = np.floor(256 * vectors.astype(np.float64)).astype(np.int64)
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    c = fit - sums / n
    cov = c.T @ c / n
    e, v = np.linalg.eigh(cov)
    e, v = e[::-1][:most], v[:, ::-1][:, :most]
    return n, ((n * x - sums) ** 2).sum(axis=1), (x - sums / n) @ v / np.sqrt(e), e / np.trace(cov)


@pytest.mark.parametrize("offset", [0.0, 30.0])
def test_equals_numpy(spark, offset):
    rng = np.random.default_rng(5)
    vectors = (rng.normal(size=(300, 9)) * np.arange(1, 10) + offset).astype(np.float32)
    vectors = np.r_[vectors, vectors[:40], np.repeat(vectors[:1], 100, axis=0)]
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    got = whiten(spark.createDataFrame(rows, SCHEMA).repartition(3)).toPandas().sort_values(["vec_id", "component"])
    n, deviation, white, explained = brute(vectors)
    assert len(got) == 4 * len(vectors) and set(got.n) == {n}
    assert got.deviation.tolist() == np.repeat(deviation, 4).tolist()
    mine = got.whitened.to_numpy().reshape(-1, 4)
    sign = np.sign((mine * white).sum(axis=0))
    assert np.allclose(mine * sign, white, atol=1e-9)
    assert np.allclose(got.explained.to_numpy()[:4], explained, rtol=1e-9)
    assert got.identity_error.nunique() == 1 and got.identity_error.iloc[0] < 1e-9


def test_does_not_depend_on_partitions(spark):
    rng = np.random.default_rng(6)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(200, 5)).astype(np.float32))]
    a, b = (sorted(map(tuple, whiten(spark.createDataFrame(rows, SCHEMA).repartition(k)).collect())) for k in (1, 7))
    assert [r[:4] for r in a] == [r[:4] for r in b] and np.allclose([r[4] for r in a], [r[4] for r in b], atol=1e-12)


def test_rows_left_out_and_kept(spark):
    rng = np.random.default_rng(7)
    good = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(20, 3)).astype(np.float32))]
    bad = [(50, None), (51, [1.0, None, 2.0]), (52, [float("nan"), 0.0, 0.0]), (53, [float("inf"), 0.0, 0.0])]
    odd = [(None, [0.5, 0.25, 1.0]), (60, [0.5])]
    got = whiten(spark.createDataFrame(good + bad + odd, SCHEMA)).collect()
    assert {r.vec_id for r in got} == {*range(20), None, 60} and len(got) == 22 * 3
    alone = whiten(spark.createDataFrame(good + bad + odd[:1] + [(60, [0.5, 0.0, 0.0])], SCHEMA)).collect()
    assert {(r.vec_id, r.component, r.deviation) for r in got} == {(r.vec_id, r.component, r.deviation) for r in alone}


@pytest.mark.parametrize("rows", [[], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, None)], [(1, [])]])
def test_no_variance_gives_no_rows(spark, rows):
    got = whiten(spark.createDataFrame(rows, SCHEMA))
    assert got.collect() == [] and got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_clashing_and_extra_columns(spark):
    rng = np.random.default_rng(8)
    rows = [(i, v.tolist(), "k", i, 7) for i, v in enumerate(rng.normal(size=(30, 3)).astype(np.float32))]
    got = whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>, x string, N long, c0 int"))
    assert got.columns == ["vec_id", "x", "c0", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert {(r.x, r.c0, r.n) for r in got.collect()} == {("k", 7, 30)}
