"""Ordered scans over series that are larger than a task.

A series is cut into segments along its order: each segment is one task's window, whatever the series' length, for rows are dealt by series and segment.
What a segment hands on (its last row, its sums, its greatest values) is found by partial aggregation before any shuffle; these carries, one row a
segment, are scanned by series, and each segment begins with what it is handed. One exchange of the rows, as a plain window needs; a hot series
becomes as many tasks' work as it has segments.

Segments are stretches of the order's first column, `width` long: choose it so that a segment's rows fit into a task. A series must not have null keys.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEGMENT = "__segment"


def segmented(df: DataFrame, order: list[str], width: int) -> DataFrame:
    return df.withColumn(SEGMENT, F.floor(F.col(order[0]) / width).cast("bigint"))


def _handed(df: DataFrame, by: list[str], **made: Column) -> DataFrame:
    """What each segment hands on, a row each, before any window is laid."""
    return df.groupBy(*by, SEGMENT).agg(*[c.alias(n) for n, c in made.items()])


def neighbour(df: DataFrame, by: list[str], order: list[str], width: int, columns: dict[str, str], ahead: bool = False) -> DataFrame:
    """df with columns of the row before in the series (or ahead of it): {new name: column}; null at its beginning (or end)."""
    rows = segmented(df, order, width)
    at, what = F.struct(*order), F.struct(*[F.col(c).alias(n) for n, c in columns.items()])
    pick = (F.min_by if ahead else F.max_by)(what, at)
    step = F.lead if ahead else F.lag
    carry = _handed(rows, by, __edge=pick).withColumn("__edge", step("__edge").over(Window.partitionBy(*by).orderBy(SEGMENT)))
    inner = rows.withColumn("__next", step(what).over(Window.partitionBy(*by, SEGMENT).orderBy(*order)))
    both = inner.join(carry, [*by, SEGMENT], "left").withColumn("__next", F.coalesce("__next", "__edge"))
    return both.select(*df.columns, *[F.col(f"__next.{n}").alias(n) for n in columns])


def running(df: DataFrame, by: list[str], order: list[str], width: int, sums: dict[str, Column] | None = None, greatest: dict[str, Column] | None = None) -> DataFrame:
    """df with running sums and running maxima (nulls are skipped) of each series up to and with the row."""
    sums, greatest = sums or {}, greatest or {}
    rows = segmented(df, order, width).withColumns({f"__v_{n}": c for n, c in {**sums, **greatest}.items()})
    before = Window.partitionBy(*by).orderBy(SEGMENT).rowsBetween(Window.unboundedPreceding, -1)
    made = {f"__c_{n}": F.sum(f"__v_{n}") for n in sums} | {f"__c_{n}": F.max(f"__v_{n}") for n in greatest}
    carry = _handed(rows, by, **made).select(*by, SEGMENT, *[f(f"__c_{n}").over(before).alias(f"__c_{n}") for f, names in ((F.sum, sums), (F.max, greatest)) for n in names])
    here = Window.partitionBy(*by, SEGMENT).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    both = rows.join(carry, [*by, SEGMENT], "left")
    out = {n: F.coalesce(F.sum(f"__v_{n}").over(here), F.lit(0)) + F.coalesce(f"__c_{n}", F.lit(0)) for n in sums}
    out |= {n: F.greatest(F.max(f"__v_{n}").over(here), F.col(f"__c_{n}")) for n in greatest}
    return both.withColumns(out).select(*df.columns, *out)


def since_break(df: DataFrame, by: list[str], order: list[str], width: int, name: str, columns: list[str], breaks: Callable[[Column, Column], Column], counted: Column | None = None) -> DataFrame:
    """df with how many rows (that are counted) the series has since its last break, both ends included if they count; since its beginning if there is
    none. breaks(before, row) says, of two structs with the columns, whether a row that follows the other is a break; before is null at the series' beginning.

    A count less the count at the last break, so no run of rows needs a task of its own. Each segment is counted once by itself; whether its first
    row is a break, what was counted before it and where the last break was, is found from the segments' first and last rows and sums."""
    rows = segmented(df, order, width)
    here = Window.partitionBy(*by, SEGMENT).orderBy(*order)
    upto = here.rowsBetween(Window.unboundedPreceding, 0)
    one = F.lit(1) if counted is None else F.when(counted, 1).otherwise(0)
    rows = rows.withColumns({"__row": F.struct(*columns), "__one": one}).withColumns({"__before": F.lag("__row").over(here), "__n": F.sum("__one").over(upto)})
    inner = F.col("__before").isNotNull() & breaks(F.col("__before"), F.col("__row"))
    rows = rows.withColumn("__last", F.max(F.when(inner, F.col("__n") - F.col("__one"))).over(upto))
    at = F.struct(*order)
    ends = rows.groupBy(*by, SEGMENT).agg(F.max("__n").alias("__all"), F.max("__last").alias("__mark"), F.min_by("__row", at).alias("__first"), F.max_by("__row", at).alias("__end"))
    over = Window.partitionBy(*by).orderBy(SEGMENT)
    ahead = over.rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumns({"__sum": F.coalesce(F.sum("__all").over(ahead), F.lit(0)), "__prev": F.lag("__end").over(over)})
    start = F.when(breaks(F.col("__prev"), F.col("__first")), F.col("__sum"))
    ends = ends.withColumn("__start", start).withColumn("__mark", F.greatest(F.col("__sum") + F.col("__mark"), "__start"))
    carry = ends.select(*by, SEGMENT, "__sum", F.coalesce("__start", F.max("__mark").over(ahead), F.lit(0)).alias("__from"))
    both = rows.join(carry, [*by, SEGMENT], "left")
    return both.withColumn(name, F.col("__sum") + F.col("__n") - F.coalesce(F.col("__sum") + F.col("__last"), "__from")).select(*df.columns, name)
