"""Orders over whole tables that no single task sees: running totals and dense ranks by ranges of the key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges that an order is cut into.
RANGES = 64


def range_of(key: Column, bounds: list) -> Column:
    """Number of the range that the key falls in; ``bounds`` ascend."""
    return sum((F.coalesce((key > F.lit(b)).cast("int"), F.lit(0)) for b in bounds), F.lit(0))


def bounds_of(rows: DataFrame, key: str, ranges: int = RANGES) -> list:
    """Upper bounds of ranges with about as many distinct keys each: at most ``ranges`` numbers reach the driver.

    Keys that are no numbers are cut by their hashes' least keys, which are a
    sample of the distinct keys; it decides where ranges end, not what counts.
    """
    if dict(rows.dtypes)[key] in ("double", "float", "int", "bigint"):
        return sorted(set(rows.stat.approxQuantile(key, [i / ranges for i in range(1, ranges)], 0.001)))
    found = rows.select(key).where(F.col(key).isNotNull()).distinct().withColumn("h", F.xxhash64(key)).orderBy("h").limit(ranges * 16).select(key)
    keys = sorted(r[0] for r in found.toLocalIterator())
    return sorted(set(keys[i * len(keys) // ranges] for i in range(1, ranges))) if len(keys) > ranges else []


def running_total(rows: DataFrame, key: str, amount: str, name: str, ranges: int = RANGES) -> DataFrame:
    """``rows`` (one for each key) with the sum of ``amount`` over all smaller keys.

    Each range is summed by its own task; the ranges' totals, a row each, are
    summed on their own and joined.  A null key comes after all others.
    """
    bounds = bounds_of(rows, key, ranges)
    r = rows.withColumn("range", F.when(F.col(key).isNull(), len(bounds)).otherwise(range_of(F.col(key), bounds)))
    within = Window.partitionBy("range").orderBy(F.asc_nulls_last(key)).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    # a row for each of the ranges, RANGES at most
    before = r.groupBy("range").agg(F.sum(amount).alias("of_range")).select("range", F.coalesce(F.sum("of_range").over(every), F.lit(0)).alias("before"))
    return r.withColumn("own", F.coalesce(F.sum(amount).over(within), F.lit(0))).join(F.broadcast(before), "range").withColumn(name, F.col("own") + F.col("before")).drop("range", "own", "before")


def running(rows: DataFrame, keys: Sequence[str], order: str, amount: Column, name: str, ranges: int = RANGES) -> DataFrame:
    """``rows``, one for each (keys, order), with the sum of ``amount`` over the smaller orders of the same keys.

    A key's rows are cut into ranges of the order, so that one key is not one
    task; a row for each key and range is then summed on its own.
    """
    r = rows.withColumns({"_range": range_of(F.col(order), bounds_of(rows, order, ranges)), "_amount": amount})
    within = Window.partitionBy(*keys, "_range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = r.groupBy(*keys, "_range").agg(F.sum("_amount").alias("_all")).withColumn("_before", F.coalesce(F.sum("_all").over(every), F.lit(0))).drop("_all")
    return r.join(before, [*keys, "_range"]).withColumn(name, F.coalesce(F.sum("_amount").over(within), F.lit(0)) + F.col("_before")).drop("_range", "_amount", "_before")


def least_from_here(rows: DataFrame, keys: Sequence[str], order: str, value: Column, name: str, ranges: int = RANGES) -> DataFrame:
    """The same for the least ``value`` of this and all greater orders."""
    r = rows.withColumns({"_range": range_of(F.col(order), bounds_of(rows, order, ranges)), "_value": value})
    within = Window.partitionBy(*keys, "_range").orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy(*keys).orderBy(F.desc("_range")).rowsBetween(Window.unboundedPreceding, -1)
    later = r.groupBy(*keys, "_range").agg(F.min("_value").alias("_own")).withColumn("_later", F.min("_own").over(every)).drop("_own")
    return r.join(later, [*keys, "_range"]).withColumn(name, F.least(F.min("_value").over(within), F.col("_later"))).drop("_range", "_value", "_later")


def dense_places(keys: DataFrame, key: str, name: str, ranges: int = RANGES) -> DataFrame:
    """Distinct keys with their place, from 1, in the order of all."""
    each = keys.select(key).distinct().withColumn("one", F.lit(1))
    return running_total(each, key, "one", name, ranges).select(key, (F.col(name) + 1).alias(name))
