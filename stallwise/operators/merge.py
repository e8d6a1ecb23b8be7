"""Keyed merges: every update is a pure transform from old and new rows to the next version of a table."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Rule = Callable[[Column, Column], Column]


def newer(old: Column, new: Column) -> Column:
    return new


def older(old: Column, new: Column) -> Column:
    return old


def newer_if_set(old: Column, new: Column) -> Column:
    return F.coalesce(new, old)


def newer_if_filled(old: Column, new: Column) -> Column:
    """For arrays: the new value unless it is null or empty."""
    return F.when(F.size(new) > 0, new).otherwise(old)


def lesser(old: Column, new: Column) -> Column:
    return F.least(old, new)


def high_water(old: Column, new: Column) -> Column:
    """The greater of both, at least 0: never decreases."""
    return F.greatest(F.coalesce(old, F.lit(0)), new)


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], rules: Mapping[str, Rule], inserted: Mapping[str, Column] | None = None) -> DataFrame:
    """``old`` with ``new`` merged by ``keys``: matched rows follow each column's rule (default: the new value).

    Rows of ``new`` that match none are inserted, with ``inserted`` columns in their place. Keys must be unique in both.
    One shuffle on the keys; a merge of the same rows again changes nothing where rules are idempotent.
    """
    names = [c for c in old.columns if c not in keys]
    both = old.select(*keys, F.struct(*names).alias("_old"), F.lit(True).alias("_had")).join(
        new.select(*keys, F.struct(*[F.col(c) if c in new.columns else F.lit(None).cast(old.schema[c].dataType).alias(c) for c in names]).alias("_new"), F.lit(True).alias("_has")), list(keys), "full"
    )
    inserted = inserted or {}

    def value(c: str) -> Column:
        o, n = F.col(f"_old.{c}"), F.col(f"_new.{c}")
        fresh = inserted.get(c, n)
        return F.when(F.col("_has").isNull(), o).when(F.col("_had").isNull(), fresh).otherwise(rules.get(c, newer)(o, n)).alias(c)

    return both.select(*keys, *[value(c) for c in names])


def fold(versions: DataFrame, keys: Sequence[str], version: str, latest: Sequence[str], last_set: Sequence[str] = ()) -> DataFrame:
    """One row a key from a log of versions: columns of the latest, and the last values that are set.

    ``version`` orders the rows of a key and must be unique in it. Partial aggregates fold each task's rows first.
    """
    set_ = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col(version))).alias(c) for c in last_set]
    return versions.groupBy(*keys).agg(*[F.max_by(c, version).alias(c) for c in latest], *set_)


def insert_absent(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``old`` and the rows of ``new`` whose keys it lacks."""
    return old.unionByName(new.join(old.select(*keys), list(keys), "left_anti").select(*old.columns))


def enforce_first(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Uniqueness as a transform: of the rows of a key the first in ``order`` stays."""
    names = [c for c in rows.columns if c not in keys]
    picked = rows.groupBy(*keys).agg(F.min_by(F.struct(*names), F.struct(*order)).alias("_row"))
    return picked.select(*keys, "_row.*")
