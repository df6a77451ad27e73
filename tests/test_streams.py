"""Streams over several files read one a batch: state carries across batches, and the results equal those of one batch."""

import uuid
import weakref

import pandas as pd
import pytest
from compare import SF
from pyspark.sql import functions as F
from test_operators import simulate

from tessella.operators import membership
from tessella.session import shared_dir
from tessella.streaming import expiring, stateful


@pytest.fixture(scope="module")
def files(spark):
    """The events in eight files, in order of time."""
    path = f"{shared_dir(spark)}/events-{uuid.uuid4().hex}"
    e = spark.read.parquet(f"{SF}/events.parquet").orderBy("ts", "event_id").collect()
    schema = spark.read.parquet(f"{SF}/events.parquet").schema
    for i in range(8):
        spark.createDataFrame(e[i * len(e) // 8 : (i + 1) * len(e) // 8], schema).coalesce(1).write.mode("append").parquet(path)
    return path, schema


def streamed(spark, files):
    return spark.readStream.schema(files[1]).option("maxFilesPerTrigger", 1).parquet(files[0])


def drained(spark, stream, mode="append"):
    return stateful.drain(stream, f"{shared_dir(spark)}/drain-{uuid.uuid4().hex}", mode)


def gossip(events):
    at = F.expr("timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', ts)")
    state = F.when(F.col("event_type") == "error", "Dead").when(F.col("event_type") == "view", "Suspect").otherwise("Alive")
    return events.select(
        F.concat(F.lit("n"), (F.col("user_id") % 9).cast("string")).alias("id"), (F.col("event_id") % 7).alias("incarnation"), at.alias("last_seen"), state.alias("state"), F.lit("h").alias("cluster_hash"), F.timestamp_seconds(at).alias("ts")
    )


def test_batches_are_several(spark, files):
    q = streamed(spark, files).writeStream.format("noop").option("checkpointLocation", f"{shared_dir(spark)}/n-{uuid.uuid4().hex}").trigger(availableNow=True).start()
    q.awaitTermination()
    assert len([p for p in q.recentProgress if p["numInputRows"]]) == 8


def test_membership(spark, files):
    out = drained(spark, stateful.membership(gossip(streamed(spark, files)), "h", "n0"), "update").collect()
    want = {r.id: (r.incarnation, r.last_seen, r.state) for r in membership.merge_members(gossip(spark.read.parquet(files[0])), "h", "n0").collect()}
    got = {}
    for r in out:
        got[r.id] = max(got.get(r.id, (-1, -1, "")), (r.incarnation, r.last_seen, r.state))
    assert got == want and sum(r.action == "join" for r in out) == len(want) < len(out)


def test_sweep(spark, files):
    """A member that falls silent is suspect, then dead, in a batch that may not name it; a greater record brings it back."""
    out = drained(spark, stateful.swept_membership(gossip(streamed(spark, files)), "h", "n0", 3600, 7200)).orderBy("id", "n").collect()
    rows = gossip(spark.read.parquet(files[0]))
    now = rows.agg(F.max("ts")).first()[0].timestamp()
    best = {r.id: r for r in membership.merge_members(rows, "h", "n0").collect()}
    last = {r.id: r for r in out}
    age = lambda r: now - r.last_seen
    assert {i: r.state for i, r in last.items()} == {i: "Dead" if age(r) > 7200 else "Suspect" if age(r) > 3600 else r.state for i, r in best.items()}
    for i in best:
        mine = [r for r in out if r.id == i]
        assert [r.n for r in mine] == list(range(1, len(mine) + 1))
        assert all(r.failed == (r.state == "Dead" and (k == 0 or mine[k - 1].state != "Dead")) for k, r in enumerate(mine))
    assert any(r.failed for r in out)


@pytest.mark.parametrize("mode", ["clamp", "reset"])
def test_deltas(spark, files, mode):
    cols = [F.concat(F.lit("h"), (F.col("user_id") % 3).cast("string")).alias("host"), F.col("event_type").alias("metric"), F.col("event_id").alias("epoch_ms"), (F.col("event_id") * (F.col("event_id") % 7)).alias("value")]
    from tessella.operators import telemetry

    order = ["host", "metric", "epoch_ms"]
    got = drained(spark, stateful.counter_deltas(streamed(spark, files).select(*cols), mode)).orderBy(*order).collect()
    want = telemetry.counter_delta(spark.read.parquet(files[0]).select(*cols), ["host", "metric"], mode).select(*got[0].__fields__).orderBy(*order).collect()
    assert got == want


def test_lru(spark, files):
    cols = [(F.col("user_id") % 2).alias("node"), F.col("event_id").alias("seq"), (F.col("event_id") * 7 % 31).alias("key"), (1 + F.col("event_id") * 7 % 31 % 5).alias("size")]
    trace = streamed(spark, files).select(*cols)
    got = drained(spark, stateful.lru(trace, 40)).orderBy("node", "seq").collect()
    for node in (0, 1):
        rows = spark.read.parquet(files[0]).select(*cols).filter(F.col("node") == node).orderBy("seq").collect()
        assert [r.hit for r in got if r.node == node] == simulate([(r.key, r["size"]) for r in rows], 40, False)


def test_rows_of_a_key_are_held_as_numbers(monkeypatch):
    """A key's frames of one micro-batch go as they come, and its rows are ordered and returned in slices."""
    monkeypatch.setattr(stateful, "SLICE", 100)
    alive = []

    def frames():
        for i in range(20):
            pdf = pd.DataFrame({"key": [(i * 50 + j) * 7 % 1000 for j in range(50)], "size": range(50), "seq": [(i * 50 + j) * 7 % 1000 // 2 for j in range(50)]})
            alive.append(weakref.ref(pdf))
            yield pdf
            del pdf
            assert sum(r() is not None for r in alive) <= 1

    slices = list(stateful.in_order(frames(), ["seq", "key"], ["seq", "key"]))
    assert [len(x) for x, _ in slices] == [100] * 10
    assert [k for _, x in slices for k in x.tolist()] == list(range(1000)) and [k for x, _ in slices for k in x.tolist()] == [k // 2 for k in range(1000)]


def test_windows_close_once(spark, files):
    e = streamed(spark, files).select(F.lit("h").alias("host"), F.expr("to_timestamp(cast(ts AS string))").alias("ts"), F.lit(1).alias("cents"))
    out = drained(spark, stateful.windowed_increase(e, "1 hour")).collect()
    assert len({r.start for r in out}) == len(out) > 100
    assert 0 < sum(r.n for r in out) <= spark.read.parquet(files[0]).count()


def numbered(spark, files, **columns):
    """The stream's rows in the order of their files, with a time in seconds that rises from file to file."""
    return streamed(spark, files).select(*[c.alias(n) for n, c in columns.items()])


def states(q):
    return [sum(s["numRowsTotal"] for s in p["stateOperators"]) for p in q.recentProgress if p["stateOperators"]]


@pytest.fixture(scope="module")
def ticks(spark):
    """Twelve batches of lookups and ended jobs, 100 s apart."""
    path, schema = f"{shared_dir(spark)}/ticks-{uuid.uuid4().hex}", "k string, job bigint, t_s bigint, req bigint"
    rows = [(f"k{(b * 7 + i * i) % 23 if i % 3 else b % 23}", (b + i) % 9, 1_000_000 + 100 * b + i * 7 % 100, 1000 * b + i) for b in range(12) for i in range(15)]
    for b in range(12):
        spark.createDataFrame(rows[15 * b : 15 * (b + 1)], schema).coalesce(1).write.mode("append").parquet(path)
    return (path, spark.read.parquet(path).schema), rows


def test_listings_expire_without_a_lookup(spark, ticks):
    files, rows = ticks
    src = streamed(spark, files).select(F.col("k").alias("folder"), "t_s", "req")
    path = f"{shared_dir(spark)}/ttl-{uuid.uuid4().hex}"
    out = stateful.drain(expiring.listings(src, 250), path)
    got = out.collect()
    loaded, want = {}, {}
    for k, _, t, req in sorted(rows, key=lambda r: (r[2], r[3])):
        want[req] = "fresh" if k in loaded and t - loaded[k] < 250 else "list"
        if want[req] == "list":
            loaded[k] = t
    assert {r.req: r.action.replace("relist", "list") for r in got if r.req >= 0} == want and len(got) > len(want)
    # What expired: every listing that the clock has passed, though no event names its folder then.
    now = max(r[2] for r in rows)
    last = {}
    for r in got:
        if r.action == "expired":
            last[r.folder] = max(last.get(r.folder, 0), r.t_s)
    assert {k for k, t in loaded.items() if t + 250 < now} == {k for k, t in last.items() if t == loaded[k] + 250}


def test_state_of_jobs_stays_bounded(spark, ticks):
    """A job is forgotten its time after it ended, and the store holds what is alive only."""
    files, rows = ticks
    src = streamed(spark, files).select(F.col("k").alias("owner"), "job", "t_s")
    path = f"{shared_dir(spark)}/jobs-{uuid.uuid4().hex}"
    q = expiring.jobs(src, 250).writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    assert not q.exception() and "RocksDB" in spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    got = spark.read.schema("owner string, job bigint, t_s bigint, action string, held bigint").parquet(f"{path}/out").collect()
    ended, now = {}, max(r[2] for r in rows)
    for k, job, t, _ in rows:
        ended[k, job] = max(ended.get((k, job), 0), t)
    gone = {}
    for r in got:
        if r.action == "forgotten":
            gone[r.owner, r.job] = max(gone.get((r.owner, r.job), 0), r.t_s)
    assert {j for j, t in ended.items() if t + 250 < now} == {j for j, t in gone.items() if t >= ended[j] + 250}
    alive = {j for j, t in ended.items() if t + 250 >= now}
    # Jobs, a timer each, and a count for each owner.
    sizes = states(q)
    assert len(sizes) >= 12 and sizes[-1] <= 6 * len(alive) + 2 * 23 and max(sizes[6:]) < 2.5 * max(sizes[:6])
