"""Global ranks and running sums without bringing all rows into one task: rows are dealt by ranges, and only the ranges' totals are added up."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..tables import settle


def _ranges(df: DataFrame, order: Sequence[Column | str]) -> DataFrame:
    """df with _range and _place (from 0 inside the range), in a written table, since ranges come from a sample."""
    place = F.monotonically_increasing_id()
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", place)
    return settle(dealt).select(*df.columns, F.shiftright("_id", 33).alias("_range"), F.col("_id").bitwiseAND((1 << 33) - 1).alias("_place"))


def _before(ranges: DataFrame, amount: Column) -> DataFrame:
    totals = ranges.groupBy("_range").agg(F.sum(amount).alias("_sum"))  # one row a range
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    return F.broadcast(totals.select("_range", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before")))


def numbered(df: DataFrame, order: Sequence[Column | str], name: str) -> DataFrame:
    """df with the place of each row, from 1, in a total order."""
    ranges = _ranges(df, order)
    out = ranges.join(_before(ranges, F.lit(1)), "_range")
    return out.select(*df.columns, (F.col("_before") + F.col("_place") + 1).cast("long").alias(name))


def running(df: DataFrame, order: Sequence[Column | str], amount: str, name: str) -> DataFrame:
    """df with the sum of ``amount`` up to each row, itself included."""
    ranges = _ranges(df, order)
    inside = F.sum(amount).over(Window.partitionBy("_range").orderBy("_place").rowsBetween(Window.unboundedPreceding, 0))
    return ranges.withColumn("_inside", inside).join(_before(ranges, F.col(amount)), "_range").select(*df.columns, (F.col("_before") + F.col("_inside")).alias(name))
