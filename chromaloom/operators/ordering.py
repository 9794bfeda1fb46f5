"""Global positions and prefix sums without one task that sorts everything.

Rows are cut into a fixed number of ranges of their integer key; only the ranges'
totals, at most RANGES rows, are summed in order in one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

RANGES = 1024


def with_prefix(rows: DataFrame, key: str, value: Column | str | None = None, name: str = "position") -> DataFrame:
    """``rows`` with the sum of ``value`` (default 1) over all rows with a smaller
    key, and the number of rows or the sum overall as ``{name}_total``. Keys
    should differ; of equal keys the order is free. Null keys are left out."""
    v = F.lit(1).cast("bigint") if value is None else F.col(value) if isinstance(value, str) else value
    valued = rows.filter(F.col(key).isNotNull()).withColumn("_v", v)
    ends = valued.agg(F.min(key).alias("_lo"), F.max(key).alias("_hi"))
    width = F.floor((F.col("_hi") - F.col("_lo")) / RANGES) + 1
    ranged = valued.crossJoin(F.broadcast(ends)).withColumn("_range", F.floor((F.col(key) - F.col("_lo")) / width)).drop("_lo", "_hi")
    totals = ranged.groupBy("_range").agg(F.sum("_v").alias("_sum"))
    w = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select("_range", F.coalesce(F.sum("_sum").over(w), F.lit(0)).alias("_before"), F.sum("_sum").over(Window.partitionBy()).alias(f"{name}_total"))
    inner = Window.partitionBy("_range").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    summed = ranged.withColumn("_inner", F.coalesce(F.sum("_v").over(inner), F.lit(0)))
    # at most RANGES rows
    return summed.join(F.broadcast(before), "_range").withColumn(name, F.col("_before") + F.col("_inner")).drop("_range", "_before", "_inner", "_v")
