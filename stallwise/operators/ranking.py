"""Row numbers and running maxima in the order of a key whose rows need not fit one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stallwise.session import checkpoint

Order = list[Column | str]


def _dealt(rows: DataFrame, key: str, order: Order) -> DataFrame:
    """``rows`` in ranges of (key, order), numbered by ``_range``: a hot key lies in several consecutive ones."""
    return checkpoint(rows.repartitionByRange(F.col(key), *order).withColumn("_range", F.spark_partition_id()))


def _carried(dealt: DataFrame, key: str, part: Column, total) -> DataFrame:
    """``dealt`` with ``_before``: ``total`` over the ``part`` of the key's earlier ranges, null in its first.

    A range holds whole runs of keys, so the table of parts has a row a key and one more a range.
    """
    before = Window.partitionBy("_k").orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    parts = dealt.groupBy(F.col(key).alias("_k"), F.col("_range").alias("_r")).agg(part.alias("_part")).withColumn("_before", total("_part").over(before)).where("_before is not null")
    return dealt.join(parts.select("_k", "_r", "_before"), (F.col("_range") == F.col("_r")) & F.col(key).eqNullSafe(F.col("_k")), "left").drop("_k", "_r")


def numbered(rows: DataFrame, key: str, order: Order, name: str) -> DataFrame:
    """``rows`` with ``name``: each one's number (long, from 1) within its ``key`` in ``order``, which has no ties. Null is a key."""
    dealt = _dealt(rows, key, order)
    here = F.row_number().over(Window.partitionBy("_range", key).orderBy(*order))
    return _carried(dealt.withColumn("_here", here), key, F.count("*"), F.sum).withColumn(name, F.col("_here") + F.coalesce("_before", F.lit(0))).drop("_range", "_here", "_before")


def running_max(rows: DataFrame, key: str, order: Order, value: str, name: str) -> DataFrame:
    """``rows`` with ``name``: the greatest ``value`` of its ``key`` up to each row in ``order``, which has no ties. Null is a key."""
    dealt = _dealt(rows, key, order)
    here = F.max(value).over(Window.partitionBy("_range", key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return _carried(dealt.withColumn("_here", here), key, F.max(value), F.max).withColumn(name, F.greatest("_here", "_before")).drop("_range", "_here", "_before")


def running_sum(rows: DataFrame, key: str, order: Order, value: str, name: str) -> DataFrame:
    """``rows`` with ``name``: the sum of ``value`` (a count, never null) of its ``key`` up to each row in ``order``, which has no ties. Null is a key."""
    dealt = _dealt(rows, key, order)
    here = F.sum(value).over(Window.partitionBy("_range", key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return _carried(dealt.withColumn("_here", here), key, F.sum(value), F.sum).withColumn(name, F.col("_here") + F.coalesce("_before", F.lit(0))).drop("_range", "_here", "_before")
