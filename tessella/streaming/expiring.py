"""State that expires by itself: folder listings and jobs, with value and map state and timers on the event time.

A listing is fresh for TTL seconds after it was loaded, a finished job is kept for KEEP seconds: when that time has passed on the stream's clock, the watermark, a
timer ends the entry, whether or not an event names its key again. So the state holds what is alive and no more. Timers run on the state store's own index
(RocksDB), not on a pass over all keys.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .stateful import in_order

LISTING_TTL_S, JOB_KEEP_S = 30, 3600
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

LOOKED = "folder string, t_s bigint, req bigint, action string"
JOBS = "owner string, job bigint, t_s bigint, action string, held bigint"


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


class Listings(StatefulProcessor):
    """Per folder: when it was loaded. A lookup finds it fresh or lists it again; a timer ends what nobody looks up."""

    def __init__(self, ttl_s: int):
        self.ttl = ttl_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.loaded = handle.getValueState("loaded", "at bigint")

    def _until(self, at: int) -> int:
        return (at + self.ttl) * 1000

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        at = (self.loaded.get() or (None,))[0]
        old = at
        for times, reqs in in_order(rows, ["t_s", "req"], ["t_s", "req"]):
            out = []
            for t, req in zip(times.tolist(), reqs.tolist(), strict=True):
                if at is not None and t - at < self.ttl:
                    out.append((key[0], t, req, "fresh"))
                    continue
                out.append((key[0], t, req, "list" if at is None else "relist"))
                at = t
            yield pd.DataFrame(out, columns=["folder", "t_s", "req", "action"])
        if at != old:
            if old is not None:
                self.handle.deleteTimer(self._until(old))
            self.loaded.update((at,))
            self.handle.registerTimer(self._until(at))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.loaded.clear()
        yield pd.DataFrame([(key[0], expiredTimerInfo.getExpiryTimeInMs() // 1000, -1, "expired")], columns=["folder", "t_s", "req", "action"])

    def close(self) -> None:
        pass


class Jobs(StatefulProcessor):
    """Per owner: its jobs, by number, with the time at which each ended, and by the time that they are due to be forgotten which jobs those are. A
    timer stands for each such time, so forgetting looks at what is due and at nothing else; times are rounded up to multiples of `grain_s`, which bounds the
    timers. State is asked once for each job of a batch."""

    def __init__(self, keep_s: int, grain_s: int):
        self.keep, self.grain = keep_s, grain_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.jobs = handle.getMapState("jobs", "job bigint", "ended bigint")
        self.due = handle.getMapState("due", "t_s bigint", "jobs array<bigint>")
        self.count = handle.getValueState("count", "n bigint")

    def _held(self) -> int:
        return (self.count.get() or (0,))[0]

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held, ended, was = self._held(), {}, {}
        for times, jobs in in_order(rows, ["t_s", "job"], ["t_s", "job"]):
            out = []
            for t, job in zip(times.tolist(), jobs.tolist(), strict=True):
                if job not in ended:
                    ended[job] = was[job] = (self.jobs.getValue((job,)) or (None,))[0]
                if ended[job] is not None and ended[job] >= t:
                    continue
                held += ended[job] is None
                out.append((key[0], job, t, "ended" if ended[job] is None else "again", held))
                ended[job] = t
            yield pd.DataFrame(out, columns=["owner", "job", "t_s", "action", "held"])
        due: dict[int, list[int]] = {}
        for job, t in ended.items():
            if t != was[job]:
                self.jobs.updateValue((job,), (t,))
                due.setdefault(-(-(t + self.keep) // self.grain) * self.grain, []).append(job)
        for t, jobs in due.items():
            already = self.due.getValue((t,))
            self.due.updateValue((t,), ([*(already[0] if already else []), *jobs],))
            self.handle.registerTimer(t * 1000)
        self.count.update((held,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, held, out = expiredTimerInfo.getExpiryTimeInMs() // 1000, self._held(), []
        due = self.due.getValue((now,))
        for job in sorted({int(j) for j in due[0]} if due else []):
            # A job that ended again since is due later.
            ended = self.jobs.getValue((job,))
            if ended and ended[0] + self.keep <= now:
                self.jobs.removeKey((job,))
                held -= 1
                out.append((key[0], job, now, "forgotten", held))
        self.due.removeKey((now,))
        if held:
            self.count.update((held,))
        else:
            self.count.clear()
        yield pd.DataFrame(out, columns=["owner", "job", "t_s", "action", "held"])

    def close(self) -> None:
        pass


def _clocked(rows: DataFrame, late: str) -> DataFrame:
    return rows.withColumn("ts", F.timestamp_seconds("t_s")).withWatermark("ts", late)


def listings(lookups: DataFrame, ttl_s: int = LISTING_TTL_S, late: str = "0 seconds") -> DataFrame:
    """lookups: folder, t_s (seconds), req -> what each lookup finds (fresh, list, relist), and expired when a listing ends unasked."""
    use_rocksdb(lookups.sparkSession)
    return _clocked(lookups, late).groupBy("folder").transformWithStateInPandas(Listings(ttl_s), LOOKED, "Append", "EventTime")


def jobs(ended: DataFrame, keep_s: int = JOB_KEEP_S, late: str = "0 seconds", grain_s: int = 1) -> DataFrame:
    """ended: owner, job, t_s (seconds) -> ended (or again, if the job is known), forgotten, each with the number of jobs then held for the owner."""
    use_rocksdb(ended.sparkSession)
    return _clocked(ended, late).groupBy("owner").transformWithStateInPandas(Jobs(keep_s, grain_s), JOBS, "Append", "EventTime")
