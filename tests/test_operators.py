"""Operators against direct simulation."""

from collections import OrderedDict

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessella.operators import chunking, membership, placement, replay, telemetry, transfer
from tessella.sources import docs, text


def simulate(trace, cap, reject):
    cache, hits = OrderedDict(), []
    for key, size in trace:
        if reject and size > cap:
            hits.append(False)
            continue
        hits.append(key in cache)
        cache.pop(key, None)
        cache[key] = size
        while sum(cache.values()) > cap:
            cache.popitem(last=False)
    return hits


@given(st.lists(st.lists(st.integers(0, 12), min_size=1, max_size=60), min_size=1, max_size=4), st.integers(1, 30), st.booleans())
@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
def test_lru_equals_simulation(spark, traces, cap, reject):
    rows = [(n, i, k, 1 + k % 7) for n, t in enumerate(traces) for i, k in enumerate(t)]
    got = replay.replay_lru(spark.createDataFrame(rows, "node bigint, seq bigint, key bigint, size bigint"), cap, "reject" if reject else "flush").orderBy("node", "seq").collect()
    want = [h for t in traces for h in simulate([(k, 1 + k % 7) for k in t], cap, reject)]
    assert [r.hit for r in got] == want


def test_interleave(spark):
    rows = [(r, s, 10 * r + 100 * s + k) for r in range(2) for s, n in ((0, 4), (1, 2), (2, 3)) for k in range(n)]
    got = {(x.receiver, x.source, x.chunk): x.place for x in transfer.interleave(spark.createDataFrame(rows, "receiver bigint, source bigint, chunk bigint")).collect()}
    turn = {row: sorted(x for x in rows if x[:2] == row[:2]).index(row) for row in rows}
    for r in range(2):
        want = sorted((x for x in rows if x[0] == r), key=lambda x: (turn[x], x[1]))
        assert [got[x] for x in want] == list(range(1, len(want) + 1))


def test_singleflight(spark):
    rows = [(1, 7, 0, 10), (2, 7, 5, 9), (3, 7, 10, 12), (4, 8, 5, 6), (5, 7, 11, 40)]
    got = {r.id: (r.role, r.leader) for r in replay.singleflight(spark.createDataFrame(rows, "id bigint, key bigint, t0 bigint, t1 bigint")).collect()}
    assert got == {1: ("leader", 1), 2: ("follower", 1), 3: ("leader", 3), 4: ("leader", 4), 5: ("follower", 3)}


def test_reads(spark):
    r = spark.createDataFrame([(1, "b", 5, 10, 18), (2, "b", 0, 0, 18), (3, "b", 17, 9, 18), (4, "b", 20, 3, 18)], "req_id bigint, blob string, off bigint, len bigint, file_size bigint")
    assert [x.verdict for x in chunking.align_reads(r, 8).orderBy("req_id").collect()] == ["ok", "empty", "ok", "empty"]
    cut = [tuple(x)[2:] for x in chunking.slice_reads(r, 8).orderBy("req_id", "chunk_offset").collect()]
    assert cut == [(0, 8, 5, 8), (8, 8, 0, 7), (16, 2, 1, 2)]


def test_plans(spark):
    t = spark.createDataFrame([("b", 0), ("a", 1), ("c", 1)], "node_id string, grp int")
    ring = [tuple(r) for r in transfer.ring_plan(t).orderBy("step", "receiver").collect()]
    assert ring == [(1, "a", "c", "c"), (1, "b", "a", "a"), (1, "c", "b", "b"), (2, "a", "c", "b"), (2, "b", "a", "c"), (2, "c", "b", "a")]
    assert transfer.ring_plan(t.limit(1)).count() == 0
    assert transfer.broadcast_plan(t).count() == 6
    chunks = spark.createDataFrame([("m", f"b{i:02d}", 0, 1) for i in range(10)], "mount string, blob string, offset bigint, len bigint")
    plan = transfer.shard_plan(chunks, t).orderBy("i").collect()
    assert [r.node_id for r in plan] == ["b", "a", "c"] * 3 + ["b"] and [r.blob for r in plan] == [f"b{i:02d}" for i in range(10)]


def test_losses(spark):
    rows = [(i, 1, "shard", 5, 5 if i < 3 else None, "x" if i == 3 else None, 0, 1) for i in range(6)]
    t = spark.createDataFrame(rows, "task bigint, peer bigint, phase string, len bigint, got bigint, error string, t0 bigint, t1 bigint")
    r = transfer.silent_loss(transfer.shard_report(t)).first()
    assert (r.lost_worker, r.lost_coordinator) == (2, 1)


def test_merge_is_a_maximum(spark):
    rows = [("a", 1, 5, "Alive", "h"), ("a", 1, 5, "Dead", "h"), ("a", 0, 9, "Dead", "h"), ("b", 2, 1, "Alive", "x"), ("me", 9, 9, "Dead", "h")]
    got = membership.merge_members(spark.createDataFrame(rows, "id string, incarnation bigint, last_seen bigint, state string, cluster_hash string"), "h", "me").collect()
    assert [tuple(r) for r in got] == [("a", 1, 5, "Dead", 3)]


def test_bloom_holds_what_was_put_in(spark, monkeypatch):
    keys = spark.createDataFrame([("m", "b", i) for i in range(50)], "mount string, blob string, offset bigint")
    inv = keys.filter("offset < 25").withColumn("node_id", F.lit("n"))
    hit = {r.offset for r in placement.probe_blooms(keys, inv, 1 << 16).collect()}
    assert set(range(25)) <= hit and len(hit) < 30
    bits = {r.bit for r in placement.build_blooms(inv, 1 << 16).collect()}
    words = placement.build_filters(inv, 1 << 16).first().words
    assert {64 * i + b for i, w in enumerate(words) for b in range(64) if w >> b & 1} == bits and len(words) == 1024
    # Filters too large to broadcast: the same by a join.
    monkeypatch.setattr(placement, "MOST_FILTER_BYTES", 1)
    assert {r.offset for r in placement.probe_blooms(keys, inv, 1 << 16).collect()} == hit


def test_candidates_either_way(spark, monkeypatch):
    keys = spark.createDataFrame([("m", "b", i) for i in range(40)], "mount string, blob string, offset bigint")
    inv = keys.withColumn("node_id", F.concat(F.lit("n"), (F.col("offset") % 3).cast("string")))
    alive = spark.createDataFrame([(f"n{i}",) for i in range(9)], "node_id string")
    few = sorted(map(tuple, placement.rank_candidates(keys, alive, inv, 1 << 10, 2, 3).collect()))
    monkeypatch.setattr(placement, "MOST_FILTER_BYTES", 1)
    assert sorted(map(tuple, placement.rank_candidates(keys, alive, inv, 1 << 10, 2, 3).collect())) == few and len(few) >= 160


def test_owners_of_many_nodes(spark, monkeypatch):
    """Nodes in one array or in several: the same owners and ranks."""
    keys = spark.createDataFrame([("m", "b", i) for i in range(60)], "mount string, blob string, offset bigint")
    nodes = spark.createDataFrame([(f"n{i:02d}",) for i in range(30)], "node_id string")
    take = lambda: [sorted(map(tuple, f(keys, nodes).collect())) for f in (placement.hrw_owner, placement.hrw_rank, placement.scored)]
    one = take()
    monkeypatch.setattr(placement, "MOST_NODES", 7)
    assert placement.blocks(nodes) == 5 and take() == one
    assert {r[:3]: r[3] for r in one[0]} == {r[:3]: r[3] for r in one[1] if r[5] == 1}


def test_quantiles(spark):
    h = spark.createDataFrame([("n", 1.0, 0), ("n", 2.0, 5), ("n", 4.0, 10), ("e", 1.0, 0)], "node string, le double, cum bigint")
    ub = {r.node: r.q for r in telemetry.quantile_upper_bound(h, ["node"], {"q": 0.5}).collect()}
    assert ub == {"n": 2.0, "e": None}
    assert {r.node: r.q for r in telemetry.quantile_interpolated(h, ["node"], {"q": 0.25}).collect()} == {"n": 1.5, "e": None}


def test_counter_modes(spark):
    s = spark.createDataFrame([("h", "m", 0, 5), ("h", "m", 10, 9), ("h", "m", 20, 2), ("h", "m", 20, 2)], "host string, metric string, epoch_ms bigint, value bigint")
    d = {m: [r.delta for r in telemetry.counter_delta(s, ["host", "metric"], m).orderBy("epoch_ms").collect()] for m in ("clamp", "reset", "raw")}
    assert d == {"clamp": [4, 0], "reset": [4, 2], "raw": [4, -7]}


def test_text_sources(spark, tmp_path):
    p = tmp_path / "a.prom"
    p.write_text("# HELP x\nx 1\n\nx{a=\"b\"} 2.5\nx 3\ny nope\n")
    got = {r.key: r.value for r in text.parse_exposition(text.read_lines(spark, f"file://{p}")).collect()}
    assert got == {"x": 3.0, 'x{a="b"}': 2.5}
    lines = spark.createDataFrame([(0, "pod1\tn1\tfiles=1\tbytes=2\twall_s=3.5"), (1, "E0428 websocket"), (2, "pod2 files=3 bytes=4 wall_s=5")], "line_no int, line string")
    good, bad = text.parse_passes(lines)
    assert [(r.pod, r.node, r.wall_s) for r in good.orderBy("line_no").collect()] == [("pod1", "n1", 3.5), ("pod2", None, 5.0)] and bad.count() == 1


def test_exposition_is_ordered(spark, tmp_path):
    rows = [(m, f"h{h}", m_i * 10 + h) for m_i, m in enumerate(("b_total", "a_total")) for h in range(3)]
    docs.write_exposition(spark.createDataFrame(rows, "metric string, host string, value bigint"), f"file://{tmp_path}/x")
    parts = sorted(p for p in (tmp_path / "x").iterdir() if p.name.startswith("part"))
    got = "".join(p.read_text() for p in parts).splitlines()
    assert got[0] == "# TYPE a_total counter" and got[4] == "# TYPE b_total counter" and got[1] == 'a_total{node="h0"} 10' and len(got) == 8


def test_config(spark):
    toml = '[cache]\nchunk_size = 5000\n[[mounts]]\nname = "m"\naccount = ""\ncontainer = "c"\n'
    rules = {r.rule for r in docs.config_violations(docs.load_config(spark, toml).withColumn("cfg", F.lit(1)), "cfg").collect()}
    assert rules == {"chunk_size", "mount_fields"}


def test_numbers_are_whole_and_stored_tables_can_go(spark):
    import os

    from tessella import session

    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"))
    n = transfer.numbered(rows, ["k"])
    assert [r.i for r in n.orderBy("k").collect()] == list(range(1000))
    kept = set(session._written)
    path = session.shared_path(spark, "x")
    rows.write.parquet(path)
    session._written.difference_update(kept)
    session.remove_stored(spark)
    session._written.update(kept)
    assert not os.path.exists(path.removeprefix("file://"))
