"""Hydrate: plans that spread chunks over nodes, and reports of what arrived."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.policy import mib_per_s
from ..session import shared_path
from .placement import small

MOST_ERRORS = 32


def numbered(df: DataFrame, order: list, name: str = "i") -> DataFrame:
    """Row numbers from 0 in the given order without one task for all: range partitions, as many as the session shuffles into, their counts, then
    numbers within each.

    Ranges come from a sample, which differs from one evaluation to the next, so the partitioned rows are written to the shared folder once."""
    path = shared_path(df.sparkSession, "numbered")
    df.repartitionByRange(*order).withColumn("__p", F.spark_partition_id()).write.parquet(path)
    ranged = df.sparkSession.read.parquet(path)
    counts = ranged.groupBy("__p").agg(F.count(F.lit(1)).alias("__n"))
    ahead = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("__p", F.coalesce(F.sum("__n").over(ahead), F.lit(0)).alias("__s"))
    within = Window.partitionBy("__p").orderBy(*order)
    return ranged.withColumn("__r", F.row_number().over(within)).join(F.broadcast(starts), "__p").withColumn(name, F.col("__s") + F.col("__r") - 1).drop("__p", "__s", "__r")


def shard_plan(chunks: DataFrame, targets: DataFrame) -> DataFrame:
    """Chunk i (by mount, blob, offset) goes to target i mod n (in target order)."""
    t = targets.withColumn("t", F.row_number().over(Window.orderBy("grp", "node_id")) - 1)
    n = targets.count()
    c = numbered(chunks, ["mount", "blob", "offset"]).withColumn("t", (F.col("i") % n).cast("int"))
    return c.join(small(t.select("t", "node_id")), "t").select("node_id", "i", "mount", "blob", "offset", "len")


def broadcast_plan(targets: DataFrame) -> DataFrame:
    """Every receiver takes from every other source."""
    s = targets.select(F.col("node_id").alias("source"))
    return targets.select(F.col("node_id").alias("receiver")).join(s, F.col("receiver") != F.col("source"))


def ring_plan(targets: DataFrame) -> DataFrame:
    """step k of n - 1: rank r takes from rank r - 1 the shard that began at rank r - k; none for fewer than two nodes."""
    ranks = targets.select("node_id", (F.row_number().over(Window.orderBy("node_id")) - 1).alias("r"), F.count(F.lit(1)).over(Window.partitionBy()).alias("n"))
    steps = ranks.filter("n >= 2").select("node_id", "r", "n", F.explode(F.sequence(F.lit(1).cast("bigint"), F.greatest(F.col("n") - 1, F.lit(1)))).alias("step"))
    name = lambda a: ranks.select(F.col("r").alias(f"{a}_r"), F.col("node_id").alias(a))
    s = steps.withColumns({"prev_r": ((F.col("r") + F.col("n") - 1) % F.col("n")).cast("int"), "source_r": ((F.col("r") + F.col("n") - F.col("step")) % F.col("n")).cast("int")})
    return s.join(name("prev"), "prev_r").join(name("source"), "source_r").select("step", F.col("node_id").alias("receiver"), "prev", "source")


def ring_run(plan: DataFrame, shards: DataFrame, reported: DataFrame, bytes_per_ms: int) -> DataFrame:
    """plan: step, receiver, prev, source; shards: node_id, chunks, bytes -> by step: receivers, those unknown (without a report), what the others
    moved, and when the step begins and ends: it lasts as long as its slowest transfer, and begins when every one of the step before has ended."""
    known = reported.select(F.col("node_id").alias("receiver"), F.lit(True).alias("known"))
    moved = plan.join(shards.withColumnRenamed("node_id", "source"), "source", "left").join(known, "receiver", "left")
    told = lambda c: F.when(F.col("known"), c).otherwise(0)
    steps = moved.groupBy("step").agg(
        F.count(F.lit(1)).alias("receivers"),
        F.count_if(F.col("known").isNull()).alias("unknown"),
        F.sum(told(F.coalesce("chunks", F.lit(0)))).cast("bigint").alias("chunks"),
        F.sum(told(F.coalesce("bytes", F.lit(0)))).cast("bigint").alias("bytes"),
        F.max(told(F.ceil(F.coalesce("bytes", F.lit(0)) / bytes_per_ms))).cast("bigint").alias("ms"),
    )
    ends = F.sum("ms").over(Window.orderBy("step").rowsBetween(Window.unboundedPreceding, 0))
    return steps.withColumn("ends_ms", ends).select("step", "receivers", "unknown", "chunks", "bytes", (F.col("ends_ms") - F.col("ms")).alias("starts_ms"), "ends_ms")


def interleave(chunks: DataFrame) -> DataFrame:
    """Order of fetches over several sources: every source's i-th chunk before any's i+1-th.

    A chunk's turn is its number within receiver and source; its place is how many chunks of the receiver's sources come before that turn, and
    how many of the lesser sources have it: counts by receiver and source, so no task sees a receiver's chunks."""
    i = numbered(chunks.select("receiver", "source", "chunk"), ["receiver", "source", "chunk"])
    sizes = i.groupBy("receiver", "source").agg(F.count(F.lit(1)).alias("n"), F.min("i").alias("from"))
    every = sizes.groupBy("receiver").agg(F.array_sort(F.collect_list(F.struct("source", "n"))).alias("all"))
    r = i.join(small(sizes.join(every, "receiver")), ["receiver", "source"]).withColumn("turn", F.col("i") - F.col("from") + 1)
    total = lambda f: F.aggregate(F.transform("all", f), F.lit(0).cast("bigint"), lambda a, x: a + x)
    before = total(lambda s: F.least(s["n"], F.col("turn") - 1))
    here = total(lambda s: F.when((s["source"] <= F.col("source")) & (s["n"] >= F.col("turn")), 1).otherwise(0).cast("bigint"))
    return r.select("receiver", "source", "chunk", "turn", (before + here).alias("place"))


def shard_report(tasks: DataFrame, most: int = MOST_ERRORS) -> DataFrame:
    """peer: assigned, fetched, bytes, and the first errors by task; only those are collected."""
    ranked = tasks.filter("error IS NOT NULL").withColumn("r", F.row_number().over(Window.partitionBy("peer").orderBy("task", "error"))).filter(F.col("r") <= most)
    line = F.concat(F.col("task").cast("string"), F.lit(": "), F.col("error"))
    errors = ranked.groupBy("peer").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", line.alias("e")))), lambda x: x["e"]).alias("errors"))
    totals = tasks.groupBy("peer").agg(F.count(F.lit(1)).alias("assigned"), F.count("got").alias("fetched"), F.coalesce(F.sum("got"), F.lit(0)).cast("bigint").alias("bytes"))
    return totals.join(errors, "peer", "left").withColumn("errors", F.coalesce("errors", F.array().cast("array<string>")))


def silent_loss(report: DataFrame) -> DataFrame:
    """Chunks neither fetched nor reported; the worker adds a line for them, so the coordinator counts one fewer."""
    lost = lambda n: F.greatest(F.lit(0), F.col("assigned") - F.col("fetched") - n)
    r = report.withColumn("n_errors", F.size("errors")).withColumn("lost_worker", lost(F.col("n_errors")))
    return r.withColumn("lost_coordinator", lost(F.col("n_errors") + F.when(F.col("lost_worker") > 0, 1).otherwise(0))).select("peer", "assigned", "fetched", "n_errors", "lost_worker", "lost_coordinator")


def unhealthy(report: DataFrame) -> DataFrame:
    return report.filter((F.size("errors") > 0) | ((F.col("assigned") > 0) & (F.col("fetched") != F.col("assigned")))).select("peer", "assigned", "fetched", F.size("errors").cast("bigint").alias("n_errors"))


def phase_stats(tasks: DataFrame) -> DataFrame:
    g = tasks.groupBy("phase").agg(F.coalesce(F.sum("got"), F.lit(0)).cast("bigint").alias("bytes"), F.count("error").alias("errors"), (F.max("t1") - F.min("t0")).alias("ms"))
    return g.withColumn("mib_s", F.round(mib_per_s(F.col("bytes"), F.col("ms")), 6))


def totals(chunks: DataFrame, ms: int) -> DataFrame:
    g = chunks.agg(F.count_distinct("mount", "blob").alias("files"), F.count(F.lit(1)).alias("chunks"), F.coalesce(F.sum("len"), F.lit(0)).cast("bigint").alias("bytes"))
    return g.withColumn("mib_s", F.round(mib_per_s(F.col("bytes"), F.lit(ms)), 6))


def ring_report(tasks: DataFrame) -> DataFrame:
    """By step (task mod 4): bytes, first start, last end; a step begins when every task of the one before has ended."""
    g = tasks.groupBy((F.col("task") % 4).alias("step")).agg(F.coalesce(F.sum("got"), F.lit(0)).cast("bigint").alias("bytes"), F.min("t0").alias("first"), F.max("t1").alias("last"), F.count("error").alias("errors"))
    return g.withColumn("may_start", F.lag("last").over(Window.orderBy("step")))
