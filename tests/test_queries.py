"""Every registered query against its DuckDB twin on the smallest tables."""

from __future__ import annotations

import pytest

import __spark_entry__
from stallwise.plans import registry, registry_more, registry_sources  # noqa: F401
from tests.oracle import connect, same


@pytest.fixture(scope="module")
def db(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_its_twin(spark, sf_dir, db, name):
    same(registry.QUERIES[name](spark, sf_dir), db, registry.SQL[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_query_without_twin_runs(spark, sf_dir, name):
    assert registry.QUERIES[name](spark, sf_dir).collect() is not None


def test_entry(spark):
    assert __spark_entry__.entry(spark).take(1)
