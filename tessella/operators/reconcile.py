"""Comparing two large inventories that hardly differ, by a hash tree.

Keys fall into buckets by the leading bits of their hash. Each side's buckets are digests: how many rows and the sum of the rows' hashes, summed partially before
the shuffle. Buckets whose digests agree are left alone; those that don't are cut by BITS more, and only the rows that are left at the end meet. Two
inventories of n rows that differ in k shuffle at most tasks x 2 ** BITS digests a side and level, and then the rows of k buckets of n / 2 ** (BITS x LEVELS).

A row's digest has 128 bits, over key and values; equal sums of unequal sets of rows are as unlikely as a collision of those. Keys may repeat: a key differs if its
rows as a whole do. Null keys and values count like others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS, LEVELS = 12, 2
#: Buckets that differ, broadcast at most.
MOST_BUCKETS = 100_000


def _hashed(side: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    columns = [F.coalesce(F.to_json(F.array(F.col(c).cast("string"))), F.lit("")) for c in (*keys, *values)]
    h = F.xxhash64(*columns[: len(keys)])
    whole = [F.xxhash64(*columns), F.xxhash64(F.lit("r"), *reversed(columns))]
    return side.select(*keys, *values, h.alias("__h"), *[x.cast("decimal(38,0)").alias(f"__d{i}") for i, x in enumerate(whole)])


def _differing(left: DataFrame, right: DataFrame, bits: int) -> DataFrame:
    """Buckets whose digests differ."""
    at = F.shiftrightunsigned("__h", 64 - bits).alias("__b")
    digests = [s.groupBy(at).agg(F.count(F.lit(1)).alias("n"), F.sum("__d0").alias("x"), F.sum("__d1").alias("y")).select("__b", F.struct("n", "x", "y").alias(name)) for s, name in ((left, "__l"), (right, "__r"))]
    return digests[0].join(digests[1], "__b", "full_outer").filter(~F.col("__l").eqNullSafe(F.col("__r"))).select("__b")


def _within(side: DataFrame, buckets: DataFrame, bits: int, few: bool) -> DataFrame:
    return side.join(F.broadcast(buckets) if few else buckets, F.shiftrightunsigned("__h", 64 - bits) == F.col("__b"), "left_semi")


def reconcile(left: DataFrame, right: DataFrame, keys: list[str], values: list[str], bits: int = BITS, levels: int = LEVELS) -> DataFrame:
    """keys, action: insert (only in right), delete (only in left), update (their rows differ in values); equal keys have no row."""
    sides = [_hashed(x, keys, values) for x in (left, right)]
    for level in range(1, levels + 1):
        found = _differing(*sides, bits * level)
        few = found.limit(MOST_BUCKETS + 1).count() <= MOST_BUCKETS
        sides = [_within(s, found, bits * level, few) for s in sides]
    rows = [s.groupBy(*keys).agg(F.struct(F.count(F.lit(1)), F.sum("__d0"), F.sum("__d1")).alias(name)) for s, name in zip(sides, ("__l", "__r"), strict=True)]
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys]
    both = rows[0].alias("l").join(rows[1].alias("r"), same, "full_outer").filter(~F.col("__l").eqNullSafe(F.col("__r")))
    action = F.when(F.col("__l").isNull(), "insert").when(F.col("__r").isNull(), "delete").otherwise("update")
    return both.select(*[F.coalesce(f"l.{k}", f"r.{k}").alias(k) for k in keys], action.alias("action"))
