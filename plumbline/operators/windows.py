"""Running totals and carried headings that scale past one task."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


#: Ranges of a running total at most.
MAX_RANGES = 2000


def range_of(value: Column, cuts: list[float]) -> Column:
    """The number of sorted `cuts` below a value, by two steps of about the square root of their number each."""
    width = max(1, math.isqrt(len(cuts)))
    blocks = [cuts[i : i + width] for i in range(0, len(cuts), width)]
    below = lambda a: F.size(F.filter(a, lambda c: c < value))
    numbers = lambda x: F.array(*[F.lit(float(c)) for c in x]).cast("array<double>")
    if len(blocks) < 2:
        return below(numbers(cuts))
    block = below(numbers([b[0] for b in blocks[1:]]))
    return block * width + below(F.element_at(F.array(*[numbers(b) for b in blocks]), block + 1))


def running_total(df: DataFrame, order: str, value: str, name: str, range_rows: int = 100_000) -> DataFrame:
    """Sum of `value` up to each row, by `order` (unique, numeric; null last), over the whole table.

    Rows fall into ranges of the order column; the ranges' totals (a small table) are
    summed first, then each range is summed alone from its offset.
    """
    n = df.count()
    ranges = min(max(1, -(-n // range_rows)), MAX_RANGES)
    # Cut at quantiles, so clustered keys do not fall into one range.
    cuts = sorted(set(df.approxQuantile(order, [i / ranges for i in range(1, ranges)], 0.2 / ranges))) if ranges > 1 else []
    cut = df.withColumn("__r", F.when(F.col(order).isNull(), len(cuts)).otherwise(range_of(F.col(order), cuts)))
    totals = cut.groupBy("__r").agg(F.sum(value).alias("__s"))
    before = W.orderBy("__r").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select("__r", F.coalesce(F.sum("__s").over(before), F.lit(0)).alias("__o"))
    inside = W.partitionBy("__r").orderBy(F.col(order).asc_nulls_last()).rowsBetween(W.unboundedPreceding, 0)
    return cut.withColumn("__w", F.sum(value).over(inside)).join(offsets, "__r").withColumn(name, F.col("__w") + F.col("__o")).drop("__r", "__w", "__o")


def carry_down(df: DataFrame, column: str, partition: list[str], order: str) -> DataFrame:
    """Null cells take the last value above them."""
    w = W.partitionBy(*partition).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumn(column, F.last(column, ignorenulls=True).over(w))
