"""Replays of stateful decisions as relations: LRU hits, sequential detection, prefetch, request sharing, routing."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scan import running, since_break

#: Events of a series in one segment of a scan.
SEGMENT = 100_000


def replay_lru(trace: DataFrame, cap: int, oversize: str = "flush") -> DataFrame:
    """trace: node, seq, key, size -> with hit, by the cache itself: the least recently used go until what is held fits into the cap.

    A cache's decisions follow one another, so a node's trace is one task's, in order; it streams through in Arrow batches, and only the keys
    that the cache holds are in memory, however long the trace. oversize: 'flush', a key above the cap empties the cache; 'reject', it is never
    stored and disturbs nothing.
    """
    names = ["node", "seq", "key", "size"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, held, total = None, OrderedDict(), 0
        for batch in batches:
            hits = []
            for node, key, size in zip(*[batch.column(i).to_pylist() for i in (0, 2, 3)], strict=True):
                if node != here:
                    here, held, total = node, OrderedDict(), 0
                if oversize == "reject" and size > cap:
                    hits.append(False)
                    continue
                was = held.pop(key, None)
                hits.append(was is not None)
                total += size - (was or 0)
                held[key] = size
                while total > cap:
                    total -= held.popitem(last=False)[1]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hits, pa.bool_())], names=[*names, "hit"])

    rows = trace.select(*[F.col(c).cast("bigint") for c in names]).repartition("node").sortWithinPartitions("node", "seq")
    return rows.mapInArrow(run, "node bigint, seq bigint, key bigint, size bigint, hit boolean")


def lru_content(trace: DataFrame, cap: int, width: int = SEGMENT) -> DataFrame:
    """What each node's cache holds after its trace: node, key, size, last, evict_order (the least recently used goes first).

    Of its distinct keys, the most recent whose sizes add up to no more than the cap (a key's size is constant)."""
    keys = trace.groupBy("node", "key").agg(F.max("seq").alias("last"), F.max("size").alias("size")).withColumn("__ago", -F.col("last"))
    held = running(keys, ["node"], ["__ago"], width, sums={"__sum": F.col("size")}).filter(F.col("__sum") <= cap)
    # What is held is bounded by the cap.
    return held.select("node", "key", "size", "last", F.row_number().over(Window.partitionBy("node").orderBy("last")).cast("bigint").alias("evict_order"))


def bloom_versions(replayed: DataFrame, rebuilds: DataFrame) -> DataFrame:
    """replayed: node, seq, hit; rebuilds: node, seq -> by node the filter's version (an insert and a rebuild each raise it), its inserts and
    rebuilds, and pending: the inserts since the last rebuild began, which the rebuilt filter gets as well."""
    inserts = replayed.filter("NOT hit").select("node", "seq", F.lit(1).alias("i"))
    both = inserts.unionByName(rebuilds.select("node", "seq", F.lit(0).alias("i")))
    last = rebuilds.groupBy("node").agg(F.max("seq").alias("last"))
    late = (F.col("i") == 1) & (F.col("seq") >= F.coalesce("last", F.lit(-1)))
    return both.join(last, "node", "left").groupBy("node").agg(F.count(F.lit(1)).alias("version"), F.sum("i").cast("bigint").alias("inserts"), F.count_if(F.col("i") == 0).alias("rebuilds"), F.count_if(late).alias("pending"))


def hit_miss(replayed: DataFrame) -> DataFrame:
    return replayed.groupBy("node").agg(
        F.count_if("hit").alias("hits"),
        F.count_if(~F.col("hit")).alias("misses"),
        F.sum(F.when(~F.col("hit"), F.col("size")).otherwise(0)).cast("bigint").alias("bytes_inserted"),
    )


def detect_sequential(reads: DataFrame, chunk_size: int, width: int = SEGMENT) -> DataFrame:
    """blob, seq, off, len -> consecutive: how many reads in a row began within a chunk after the last one's end (which begins at 0)."""

    def jumps(before: Column, row: Column) -> Column:
        gap = row["off"] - F.coalesce(before["off"] + before["len"], F.lit(0))
        return ~F.coalesce((gap >= 0) & (gap <= chunk_size), F.lit(False))

    return since_break(reads, ["blob"], ["seq"], width, "consecutive", ["off", "len"], jumps)


def blob_streak(reads: DataFrame, reset: str = "flag = 'A'", width: int = SEGMENT) -> DataFrame:
    """How many origin fetches in a row; a peer's success starts again at 0."""
    r = reads.withColumn("__peer", F.coalesce(F.expr(reset), F.lit(False)))
    return since_break(r, ["blob"], ["seq"], width, "streak", ["__peer"], lambda _, row: row["__peer"], ~F.col("__peer")).drop("__peer")


def prefetch_plan(reads: DataFrame, chunk_size: int, depth: int = 16, threshold: int = 3, file_size: int = 1 << 40) -> DataFrame:
    """After `threshold` reads in a row the next `depth` chunks, up to the end of the file."""
    d = detect_sequential(reads, chunk_size).filter(F.col("consecutive") >= threshold)
    here = F.floor(F.col("off") / chunk_size) * chunk_size
    c = d.select("blob", "seq", F.explode(F.transform(F.sequence(F.lit(1), F.lit(depth)), lambda k: here + k * chunk_size)).alias("next"))
    return c.filter(F.col("next") < file_size)


def prefetch_skips(candidates: DataFrame, cached: DataFrame, writing: DataFrame, fetching: DataFrame) -> DataFrame:
    """What becomes of each candidate: cached first, then being written, then being fetched, else issued."""
    out = candidates
    for name, have in (("cached", cached), ("writing", writing), ("fetching", fetching)):
        out = out.join(have.select("blob", "next").distinct().withColumn(name, F.lit(True)), ["blob", "next"], "left")
    reason = F.when(F.col("cached"), "cached").when(F.col("writing"), "in_flight_write").when(F.col("fetching"), "in_flight_fetch").otherwise("issued")
    return out.select("blob", "seq", "next", reason.alias("outcome"))


def singleflight(fetches: DataFrame) -> DataFrame:
    """id, key, t0, t1 -> role and leader: the first of a key leads until it ends; who starts before that follows, the next one leads.

    A key's fetches stream in order through one task, which remembers the leader alone."""
    names = ["id", "key", "t0", "t1"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, leader, until = None, None, None
        for batch in batches:
            roles, leaders = [], []
            for i, key, t0, t1 in zip(*[batch.column(c).to_pylist() for c in range(4)], strict=True):
                if key != here or t0 >= until:
                    here, leader, until = key, i, t1
                    roles.append("leader")
                else:
                    roles.append("follower")
                leaders.append(leader)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(roles, pa.string()), pa.array(leaders, pa.int64())], names=["id", "key", "role", "leader"])

    rows = fetches.select(*[F.col(c).cast("bigint") for c in names]).repartition("key").sortWithinPartitions("key", "t0", "id")
    return rows.mapInArrow(run, "id bigint, key bigint, role string, leader bigint")


def route(requests: DataFrame) -> DataFrame:
    """requests with flags by source -> the first that serves: writes in flight, peers' memory, disk, a shared fetch, sure then possible holders, stampede guard, origin."""
    order = ("writing", "peer_lru", "disk", "shared", "yes", "maybe")
    c = F.lit(None).cast("string")
    for name in reversed(order):
        c = F.when(F.col(name), name).otherwise(c)
    stampede = F.when((F.col("wait_ms") > 0) & F.col("has_peers") & ~F.col("yes"), "stampede").otherwise("origin")
    return requests.withColumn("source", F.coalesce(c, stampede))


def stampede_roles(requests: DataFrame, self_id: str) -> DataFrame:
    """Of a chunk nobody surely holds, the highest-scored node leads, the others follow until wait_ms has passed, then go on alone."""
    lead = F.col("owner") == F.lit(self_id)
    return requests.withColumn("role", F.when(lead, "leader").when(F.col("leader_ms") <= F.col("wait_ms"), "follower").otherwise("timed_out"))
