"""Dense places of all rows without a window over all rows.

Rows are dealt to slices of the order; each slice is ranked by itself and gets the
number of rows of the slices before it (one collected count per slice).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLICES = 64


def _placed(df: DataFrame, part: Column, by: list) -> DataFrame:
    sliced = df.withColumn("__slice", part)
    before, at = [], 0
    for r in sliced.groupBy("__slice").count().orderBy("__slice").collect():  # SLICES rows at most
        before.append((r["__slice"], at))
        at += r["count"]
    side = df.sparkSession.createDataFrame(before, "__slice int, __before long")
    inside = F.row_number().over(Window.partitionBy("__slice").orderBy(*by))
    return sliced.join(F.broadcast(side), "__slice").withColumn("place", inside + F.col("__before")).drop("__slice", "__before")


def ordered_place(df: DataFrame, order: str, tie: str, slices: int = SLICES) -> DataFrame:
    """df with ``place`` (from 1) in the order of a numeric column, ties by another; slices are cut at approximate quantiles."""
    value = F.col(order).cast("double")
    cuts = sorted(set(df.select(value.alias("v")).approxQuantile("v", [i / slices for i in range(1, slices)], 0.005)))
    part = F.lit(0)
    for c in cuts:
        part = part + F.coalesce(value > c, F.lit(False)).cast("int")
    return _placed(df, part, [order, tie])


def hashed_place(df: DataFrame, keys: list[str], slices: int = SLICES) -> DataFrame:
    """df with ``place`` (from 1) in the order of a hash of the keys."""
    h = F.xxhash64(F.lit(41), *keys)
    return _placed(df, F.pmod(F.shiftrightunsigned(h, 40), F.lit(slices)).cast("int"), [h, *keys])


def grouped_rank(df: DataFrame, by: list[str], order: str, slices: int = SLICES) -> DataFrame:
    """df with ``rank`` (from 1) and ``size`` within its group, in the order of a numeric column.

    A group of any size is ranked in slices of the whole column's order, so it is never one task's rows.
    """
    value = F.col(order).cast("double")
    cuts = sorted(set(df.select(value.alias("v")).approxQuantile("v", [i / slices for i in range(1, slices)], 0.005)))
    part = F.lit(0)
    for c in cuts:
        part = part + F.coalesce(value > c, F.lit(False)).cast("int")
    sliced = df.withColumn("__slice", part)
    counts = sliced.groupBy(*by, "__slice").agg(F.count("*").alias("__n"))  # at most ``slices`` rows for each group
    group = Window.partitionBy(*by)
    places = counts.select(*by, "__slice", F.coalesce(F.sum("__n").over(group.orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"), F.sum("__n").over(group).alias("size"))
    inside = F.row_number().over(Window.partitionBy(*by, "__slice").orderBy(order))
    return sliced.withColumn("__inside", inside).join(places, [*by, "__slice"]).withColumn("rank", F.col("__inside") + F.col("__before")).drop("__slice", "__inside", "__before")


MAX_GRID = 10_000


def bounded(value: Column, most: int = MAX_GRID) -> Column:
    """A numeric value over a whole result table, which must have at most so many rows: one more stops the job."""
    n = F.count(F.lit(1)).over(Window.partitionBy(F.lit(1)))
    return F.when(n <= most, value).otherwise(F.raise_error(F.lit(f"a grid has at most {most} rows")).cast("double"))
