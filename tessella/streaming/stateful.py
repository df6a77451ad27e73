"""Continuous forms of the engine's stateful operators, on Structured Streaming.

State is kept per key and bounded by what the key needs: a counter's last sample, a member's winning record, a node's cache contents.
Within a micro-batch a key's rows are replayed in their own order (epoch, sequence), so results equal the batch operators' when
batches arrive in order. For that order a key's rows of one micro-batch are held as numbers in columns, 8 bytes each, and are replayed and
returned a slice at a time.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.policy import DEAD_AFTER, SUSPECT_AFTER

#: Rows of a slice.
SLICE = 10_000


def in_order(pdfs: Iterator[pd.DataFrame], columns: list[str], order: list[str]) -> Iterator[list[np.ndarray]]:
    """The columns of all rows, ordered, in slices. The frames go as they come: only the columns' numbers and their order are held."""
    held: dict[str, list[np.ndarray]] = {c: [] for c in columns}
    for pdf in pdfs:
        for c in columns:
            held[c].append(pdf[c].to_numpy(copy=True))
        del pdf
    # Each column's pieces go before the next one is joined.
    whole = {c: np.concatenate(held.pop(c)) for c in columns}
    at = np.lexsort([whole[c] for c in reversed(order)])
    for i in range(0, len(at), SLICE):
        yield [whole[c][at[i : i + SLICE]] for c in columns]


DELTA = "host string, metric string, e0 bigint, epoch_ms bigint, dt bigint, delta bigint"
LAST = "epoch_ms bigint, value bigint"


def counter_deltas(samples: DataFrame, mode: str = "clamp") -> DataFrame:
    """host, metric, epoch_ms, value -> increments between a counter's consecutive samples, across micro-batches."""

    def step(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get if state.exists else None
        for epochs, values in in_order(pdfs, ["epoch_ms", "value"], ["epoch_ms", "value"]):
            out = []
            for e, v in zip(epochs.tolist(), values.tolist(), strict=True):
                if last is not None and e > last[0]:
                    raw = v - last[1]
                    delta = max(0, raw) if mode == "clamp" else v if mode == "reset" and raw < 0 else raw
                    out.append((*key, last[0], e, e - last[0], delta))
                last = (e, v)
            yield pd.DataFrame(out, columns=[f.split()[0] for f in DELTA.split(", ")])
        state.update(last)

    return samples.groupBy("host", "metric").applyInPandasWithState(step, DELTA, LAST, "append", GroupStateTimeout.NoTimeout)


MEMBER = "id string, incarnation bigint, last_seen bigint, state string, action string"
RANKS = {"Alive": 0, "Suspect": 1, "Dead": 2}


def membership(records: DataFrame, cluster_hash: str, self_id: str) -> DataFrame:
    """Gossip records -> every change of a member: join, or update by a greater (incarnation, last seen, state's rank)."""

    def step(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        best = state.get if state.exists else None
        known, out = best is not None, None
        for pdf in pdfs:
            for i, s, st in zip(pdf["incarnation"].tolist(), pdf["last_seen"].tolist(), pdf["state"].tolist(), strict=True):
                new = (i, s, st)
                if best is None or (i, s, RANKS[st]) > (best[0], best[1], RANKS[best[2]]):
                    best = out = new
        if out is not None:
            state.update(best)
            yield pd.DataFrame([(key[0], *best, "update" if known else "join")], columns=[f.split()[0] for f in MEMBER.split(", ")])

    ours = records.filter((F.col("cluster_hash") == cluster_hash) & (F.col("id") != self_id))
    return ours.groupBy("id").applyInPandasWithState(step, MEMBER, "incarnation bigint, last_seen bigint, state string", "update", GroupStateTimeout.NoTimeout)


SWEPT = "id string, n bigint, incarnation bigint, last_seen bigint, state string, failed boolean"


def swept_membership(records: DataFrame, cluster_hash: str, self_id: str, suspect_after: int = SUSPECT_AFTER, dead_after: int = DEAD_AFTER) -> DataFrame:
    """Gossip records with an event time `ts` -> every change of a member (its n-th), by gossip or by the clock.

    A timer stands for each member at the time from which on it is suspect, then dead; the stream's watermark is the clock, so a member falls silent
    even in a batch that doesn't name it. failed marks the change to dead, upon which its filter is dropped."""

    def step(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, *best = state.get if state.exists else (0, None)
        was = tuple(best) if state.exists else None
        best, now = was, state.getCurrentWatermarkMs()
        if not state.hasTimedOut:
            for pdf in pdfs:
                for i, s, st in zip(pdf["incarnation"].tolist(), pdf["last_seen"].tolist(), pdf["state"].tolist(), strict=True):
                    if best is None or (i, s) > best[:2] or (i, s) == best[:2] and RANKS[st] > RANKS[best[2]]:
                        best = (i, s, st)
        seen = best[1] * 1000
        due = [t for t in (seen + 1000 * suspect_after, seen + 1000 * dead_after) if t >= now and t > 0]
        if len(due) < 2:
            best = (*best[:2], "Suspect" if due else "Dead")
        if due:
            state.setTimeoutTimestamp(due[0])
        changed = best != was
        state.update((n + changed, *best))
        if changed:
            yield pd.DataFrame([(key[0], n + 1, *best, best[2] == "Dead" and (was is None or was[2] != "Dead"))], columns=[f.split()[0] for f in SWEPT.split(", ")])

    ours = records.withWatermark("ts", "0 seconds").filter((F.col("cluster_hash") == cluster_hash) & (F.col("id") != self_id))
    return ours.groupBy("id").applyInPandasWithState(step, SWEPT, "n bigint, incarnation bigint, last_seen bigint, state string", "append", GroupStateTimeout.EventTimeTimeout)


ACCESS = "node bigint, seq bigint, key bigint, hit boolean, evicted bigint"


def lru(trace: DataFrame, cap: int, reject_oversize: bool = False) -> DataFrame:
    """node, seq, key, size (sizes may change) -> hit, and how many entries the access evicted."""

    def step(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        cache = OrderedDict(zip(*state.get, strict=True)) if state.exists else OrderedDict()
        total = sum(cache.values())
        for rows in in_order(pdfs, ["seq", "key", "size"], ["seq"]):
            out = []
            for seq, k, size in zip(*[x.tolist() for x in rows], strict=True):
                if reject_oversize and size > cap:
                    out.append((key[0], seq, k, False, 0))
                    continue
                hit = cache.get(k) == size
                total += size - cache.pop(k, 0)
                cache[k] = size
                evicted = 0
                while total > cap:
                    total -= cache.popitem(last=False)[1]
                    evicted += 1
                out.append((key[0], seq, k, hit, evicted))
            yield pd.DataFrame(out, columns=[f.split()[0] for f in ACCESS.split(", ")])
        state.update((list(cache), list(cache.values())))

    return trace.groupBy("node").applyInPandasWithState(step, ACCESS, "keys array<bigint>, sizes array<bigint>", "append", GroupStateTimeout.NoTimeout)


def windowed_increase(samples: DataFrame, width: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """host, ts, value -> count and sum by window and host, final once the watermark has passed."""
    w = samples.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "host")
    return w.agg(F.count(F.lit(1)).alias("n"), F.sum("cents").alias("cents")).select("host", F.col("w.start").alias("start"), "n", "cents")


def drain(stream: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Runs a stream over all there is and returns what it wrote: exactly once, by checkpoint and committed files."""
    spark: SparkSession = stream.sparkSession
    out = f"{path}/out"

    if mode == "append":
        q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    else:
        q = stream.writeStream.foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{out}/batch={n}")).outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception():
        raise q.exception()
    return spark.read.schema(stream.schema).parquet(out)
