"""Published figures and identities of real runs, on inputs retyped for them."""

import statistics

import pytest
from pyspark.sql import functions as F

from tessella.functions import policy
from tessella.operators import telemetry, transfer

#: Bytes, milliseconds and MiB/s of five runs (fixed values).
RUNS = [(413340567567, 16052, 24557.207), (413340567567, 15931, 24743.725), (413340567567, 16178, 24365.947), (413340567567, 15642, 25200.888), (413315401642, 15937, 24732.904)]


def test_rate_identity(spark):
    df = spark.createDataFrame(RUNS, "bytes bigint, ms bigint, want double")
    for r in df.select(policy.mib_per_s(F.col("bytes"), F.col("ms")).alias("got"), "want").collect():
        assert r.got == pytest.approx(r.want, abs=5e-4)


def test_an_unhealthy_run(spark):
    """17 nodes of 5812 chunks; seven fail on six of them, and the sums say so though the run reports success."""
    lost = {2: 2, 5: 1, 7: 1, 9: 1, 11: 1, 16: 1}
    base = spark.range(17 * 5812).select(F.col("id").alias("task"), (F.col("id") % 17).alias("peer"), F.floor(F.col("id") / 17).alias("k"))
    gone = F.lit(False)
    for p, n in lost.items():
        gone = gone | ((F.col("peer") == p) & (F.col("k") < n))
    t = base.select("task", "peer", F.when(~gone, 1).alias("got"), F.when(gone, "HTTP 403").alias("error"))
    report = transfer.shard_report(t)
    assert report.agg(F.sum("assigned")).first()[0] == 98804 and report.agg(F.sum("fetched")).first()[0] == 98797
    sick = transfer.unhealthy(report).collect()
    assert {r.peer: r.n_errors for r in sick} == lost and sum(r.n_errors for r in sick) == 7
    assert {r.lost_worker for r in transfer.silent_loss(report).collect()} == {0}
    assert RUNS[0][0] - RUNS[4][0] == 25165925


def test_shares_differ_by_one(spark):
    """6465 chunks over 17 targets: 380 or 381 each, all of them dealt."""
    chunks = spark.range(6465).select(F.lit("m").alias("mount"), F.lit("b").alias("blob"), F.col("id").alias("offset"), F.lit(1).alias("len"))
    targets = spark.createDataFrame([(f"n{i:02d}", min(i, 1)) for i in range(17)], "node_id string, grp int")
    n = [r["count"] for r in transfer.shard_plan(chunks, targets).groupBy("node_id").count().collect()]
    assert sum(n) == 6465 and sorted(set(n)) == [380, 381]


def test_pass_statistics(spark):
    """Every pod reads the same bytes; the rate is all bytes over the slowest pod, the median the upper one, as over 17 pods of the published passes."""
    walls = [797.289, 1054.103, 838.299] + [800.0 + i for i in range(14)]
    rows = [(f"p{i}", "n", "413328348544", w, 0) for i, w in enumerate(walls)] + [("bad", "n", "n/a", 1.0, 1)]
    one = telemetry.wall_stats(spark.createDataFrame(rows, "pod string, node string, bytes_text string, wall_s double, rc int"), ["node"]).first()
    assert (one.pods, one.failed, one.max_s, one.bytes) == (18, 1, 1054.103, 17 * 413328348544)
    assert one.bytes / one.max_s / 2**30 == pytest.approx(6.208, abs=5e-4)
    assert one.p50_s == sorted([*walls, 1.0])[18 // 2] == statistics.median_high([*walls, 1.0])


def test_a_shortfall_in_chunks():
    assert 12_582_912 / 4_194_304 == 3


def test_range_rates(spark):
    """Samples every 15 s, by hand: (30, 90] holds four of them; a reset counts from zero."""
    rows = [("h", t * 1000, t, v) for t, v in ((0, 0), (15, 10), (30, 20), (45, 30), (60, 5), (75, 15), (90, 25))]
    s = spark.createDataFrame(rows, "host string, epoch_ms bigint, line_no bigint, value bigint")
    plain = {r.t_ms: r for r in telemetry.range_rate(s, ["host"], 60, 30).collect()}
    assert (plain[90000].increase, plain[90000].span) == (25, 45000) and plain[90000].per_s == pytest.approx(25 / 45)
    assert plain[60000].increase == 10 + 10 + 5 and plain[30000].per_s == pytest.approx(20 / 30)
    wide = {r.t_ms: r.per_s for r in telemetry.range_rate(s, ["host"], 60, 30, extrapolate=True).collect()}
    # 15 s to the range's start, none to its end: 45 s and 15 s of 60 s.
    assert wide[90000] == pytest.approx(25 * (60 / 45) / 60)
    # The counter was zero at the first sample: nothing is carried on before it, and the end is at hand.
    assert wide[30000] == pytest.approx(20 / 60)


def test_local_is_clamped_once_in_total(spark):
    """An interval in which peers and origin served more than was read counts 0 there, and less in the total."""
    rows = [("h", 0, 0, 0, 0, 0, 0), ("h", 1000, 1, 10, 40, 0, 1), ("h", 2000, 2, 110, 40, 0, 2)]
    r = telemetry.split_rates(spark.createDataFrame(rows, "host string, epoch_ms bigint, line_no bigint, fuse bigint, peer bigint, blob bigint, reads bigint"), 10).first()
    assert r.local == 10.0 and r.total_local == 70


def test_ties_go_to_the_even_digit(spark):
    got = spark.createDataFrame([(1, 800), (3, 800), (5, 800)], "a int, b int").select(policy.percent(F.col("a"), F.col("b"), 2).alias("p")).collect()
    assert [r.p for r in got] == [0.12, 0.38, 0.62]
