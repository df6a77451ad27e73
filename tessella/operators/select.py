"""Exact order statistics of groups of any size, by distributed selection.

A rank is narrowed down by histograms: first over magnitudes (BINS to a doubling), then over equal parts of the bucket that holds the rank, three times, which
tells any two doubles apart. Histograms are summed partially before the shuffle, and only the rows of the bucket sought are looked at further,
so a group takes at most PARTS counts a task, however many distinct values it has, and no task sees a group's rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BINS, PARTS = 32, 1 << 16
ROUNDS = 3


def magnitude(x: Column) -> Column:
    """A whole number that never falls as x rises; NaN comes last."""
    size = F.floor(F.log2(F.abs(x)) * BINS) + 1100 * BINS
    far = F.lit(10_000 * BINS)
    return F.when(F.isnan(x), far + 1).when(F.abs(x) == float("inf"), F.signum(x).cast("long") * far).when(x == 0, 0).otherwise(F.signum(x).cast("long") * size)


def part(x: Column, lo: Column, hi: Column) -> Column:
    return F.when(hi > lo, F.floor((x - lo) / (hi - lo) * (PARTS - 1))).otherwise(0)


def nth(df: DataFrame, by: list[str], column: str, rank: Callable[[Column], Column]) -> DataFrame:
    """by, value: of each group's numbers (up to 2 ** 53, if whole) the one of this rank, by their count, from below. Nulls don't count."""
    rows = df.select(*by, F.col(column).cast("double").alias("__x")).filter("__x IS NOT NULL")
    over, sought, bucket = Window.partitionBy(*by), None, magnitude(F.col("__x"))
    for _ in range(ROUNDS + 1):
        here = rows
        if sought is not None:
            here = rows.join(sought, by).filter("__x BETWEEN __lo AND __hi")
            bucket = part(F.col("__x"), F.col("__lo"), F.col("__hi"))
        counts = here.groupBy(*by, bucket.cast("long").alias("__b")).agg(F.count(F.lit(1)).alias("__c"), *([] if sought is None else [F.max("__rank").alias("__rank")]), F.min("__x").alias("__lo"), F.max("__x").alias("__hi"))
        counts = counts.withColumn("__upto", F.sum("__c").over(over.orderBy("__b")))
        if sought is None:
            counts = counts.withColumn("__rank", rank(F.sum("__c").over(over)).cast("long"))
        held = counts.filter("__upto >= __rank AND __upto - __c < __rank")
        sought = held.select(*by, (F.col("__rank") - F.col("__upto") + F.col("__c")).alias("__rank"), "__lo", "__hi")
    return sought.select(*by, F.col("__lo").alias("value"))
