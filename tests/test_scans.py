"""Segmented scans, as-of joins, instant vectors, distributed selection, hash-tree reconciliation and folder roll-ups against brute force."""

import datetime as dt
import math
import random
import re
from bisect import bisect_right
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F
from test_plans import plan

from tessella.operators import asof, namespace, placement, replay, scan, select, telemetry
from tessella.operators import reconcile as rc
from tessella.plans import views


def samples(spark, n=300, series=3, seed=1, ties=True):
    rng = random.Random(seed)
    rows = [(f"s{rng.randrange(series)}", rng.randrange(n * 20) // (10 if ties else 1), i, rng.randrange(100)) for i in range(n)]
    return rows, spark.createDataFrame(rows, "host string, epoch_ms bigint, line_no bigint, value bigint")


@pytest.mark.parametrize("width", [1, 37, 10**6])
def test_neighbours_and_running_values(spark, width):
    rows, df = samples(spark)
    by = defaultdict(list)
    for r in rows:
        by[r[0]].append(r)
    want = {}
    for s in by.values():
        s.sort(key=lambda r: (r[1], r[2]))
        total, most, since = 0, None, 0
        for k, r in enumerate(s):
            total += r[3]
            if r[3] % 5 == 0:
                most = max(r[3], most if most is not None else r[3])
            since = 1 if r[3] % 7 == 0 else since + 1
            want[r[2]] = (s[k - 1][3] if k else None, s[k + 1][3] if k + 1 < len(s) else None, total, most, since)
    order = ["epoch_ms", "line_no"]
    out = scan.neighbour(df, ["host"], order, width, {"before": "value"})
    out = scan.neighbour(out, ["host"], order, width, {"after": "value"}, ahead=True)
    out = scan.running(out, ["host"], order, width, sums={"total": F.col("value")}, greatest={"most": F.when(F.col("value") % 5 == 0, F.col("value"))})
    out = scan.since_break(out, ["host"], order, width, "since", ["value"], lambda _, row: row["value"] % 7 == 0)
    assert out.columns == [*df.columns, "before", "after", "total", "most", "since"]
    assert {r.line_no: (r.before, r.after, r.total, r.most, r.since) for r in out.collect()} == want
    assert out.filter("false").count() == 0


def test_one_series_is_many_tasks_work(spark):
    """No window over rows lies on the series alone: only that of the segments' carries does."""
    reads = spark.range(1000).select((F.col("id") % 1).alias("blob"), F.col("id").alias("seq"), (F.col("id") * 256).alias("off"), F.lit(256).alias("len"), F.lit("A").alias("flag"))
    for df in (replay.detect_sequential(reads, 256, 100), replay.blob_streak(reads, width=100)):
        text = plan(df)
        for at in re.findall(r"Window\n(?:.*\n)*?Arguments: \[(.*?)\], \[(.*?)\]", text):
            assert "__segment" in at[1] or re.search("__edge|__c_|__all|__end|__mark", at[0]), at
        assert "SinglePartition" not in text
    assert [r.consecutive for r in replay.detect_sequential(reads, 256, 100).orderBy("seq").collect()] == list(range(1, 1001))
    spread = replay.detect_sequential(reads, 256, 100).groupBy(F.spark_partition_id()).count().collect()
    assert len(spread) > 1


def test_sequential_reads_and_streaks(spark):
    rng = random.Random(2)
    rows, at = [], Counter()
    for i in range(400):
        b = rng.choice([1, 1, 1, 2])
        at[b] = at[b] if rng.random() < 0.8 else rng.randrange(10_000)
        rows.append((b, i, at[b], 256, rng.choice("ANR")))
        at[b] += 256
    df = spark.createDataFrame(rows, "blob bigint, seq bigint, off bigint, len bigint, flag string")
    end, run, streak, want = Counter(), Counter(), Counter(), {}
    for b, i, off, n, flag in rows:
        run[b] = run[b] + 1 if 0 <= off - end[b] <= 256 else 1
        end[b] = off + n
        streak[b] = 0 if flag == "A" else streak[b] + 1
        want[i] = (run[b], streak[b])
    for width in (7, 10**6):
        got = replay.detect_sequential(df, 256, width).join(replay.blob_streak(df, width=width).select("seq", "streak"), "seq")
        assert {r.seq: (r.consecutive, r.streak) for r in got.collect()} == want


def test_counters_across_segments(spark, monkeypatch):
    _, df = samples(spark, 200)
    df = df.withColumn("metric", F.lit("m"))
    take = lambda: [sorted(map(tuple, x.collect())) for x in (telemetry.counter_delta(df, ["host", "metric"]), telemetry.range_rate(df, ["host"], 1, 1))]
    whole = take()
    monkeypatch.setattr(telemetry, "SEGMENT_MS", 50)
    assert take() == whole and whole[0] and whole[1]


def test_bucket_counts_in_segments(spark, tmp_path):
    """As the view's SQL, null hosts, times and values included; no window over a whole series."""
    rng = random.Random(5)
    start = dt.datetime(2024, 1, 1)
    rows = [(i, start + dt.timedelta(seconds=rng.randrange(2_600_000)) if i % 50 else None, rng.randrange(9) if i % 7 else None, rng.choice(["click", "view", None]), rng.choice([None, 5.0, rng.random() * 200]), None) for i in range(1, 900)]
    spark.createDataFrame(rows, "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    df, want = (f(spark, str(tmp_path), "v_buckets") for f in (views.view, views.plain_view))
    assert df.columns == want.columns and [x.dataType for x in df.schema] == [x.dataType for x in want.schema]
    assert sorted(map(str, df.collect())) == sorted(map(str, want.collect()))
    wide = telemetry.bucket_rates(views.view(spark, str(tmp_path), "v_bucket_counts"), ["metric", "host"], views.BOUNDS, 60, 30)
    per = telemetry.range_rate(df, ["metric", "host", "le"], 60, 30)
    assert sorted(map(str, wide.select(per.columns).collect())) == sorted(map(str, per.collect()))
    for text in (plan(df), plan(per), plan(wide)):
        for at in re.findall(r"Window\n(?:.*\n)*?Arguments: \[(.*?)\], \[(.*?)\]", text):
            assert "__segment" in at[1] or re.search("__edge|__c_", at[0]), at
    held = per.groupBy().agg(F.count(F.lit(1)), F.sum("increase")).first()
    by = defaultdict(list)
    for r in want.filter("epoch_ms IS NOT NULL").collect():
        by[r.metric, r.host, r.le].append((r.epoch_ms, r.line_no, r.value))
    steps = defaultdict(list)
    for k, s in by.items():
        s.sort()
        for i, (t, _, v) in enumerate(s):
            for at in range(-(-t // 30_000) * 30_000, t + 60_000, 30_000):
                steps[(*k, at)].append((t, v - s[i - 1][2] if i and s[i - 1][0] > at - 60_000 else 0))
    full = [sum(x for _, x in v) for v in steps.values() if len(v) > 1 and v[-1][0] > v[0][0]]
    assert tuple(held) == (len(full), sum(full))


@pytest.mark.parametrize("width", [50, 10**6])
def test_instant_vectors(spark, width):
    """A row a step for each series that is not silent; values that fall; of equal times the later line."""
    rows, df = samples(spark, 120, 3)
    rows = [r for r in rows if not (r[0] == "s1" and 60 <= r[1] < 200)]
    df = df.filter("NOT (host = 's1' AND epoch_ms >= 60 AND epoch_ms < 200)").withColumn("epoch_ms", F.col("epoch_ms") * 1000)
    want = {}
    for h in {r[0] for r in rows}:
        s = sorted((r[1], r[2], r[3]) for r in rows if r[0] == h)
        for t in range(0, 700, 7):
            k = bisect_right(s, (t, math.inf)) - 1
            if k >= 0 and t - s[k][0] < 30:
                want[h, t * 1000] = (s[k][2], (t - s[k][0]) * 1000)
    got = asof.instant_vector(df, ["host"], 7, 30, width).collect()
    assert len(got) == len({(r.host, r.t_ms) for r in got})
    assert {(r.host, r.t_ms): (r.value, r.age_ms) for r in got} == want
    assert not [1 for h, t in want if h == "s1" and 90_000 < t < 200_000] and len({v for v, _ in want.values()}) > 20


@pytest.mark.parametrize("width", [40, 10**6])
def test_asof_join(spark, width):
    rng = random.Random(3)
    left = [(rng.choice("ab"), rng.randrange(300), i) for i in range(80)] + [("c", 5, 99), ("a", 5, 5), ("a", 5, 5)]
    right = [(rng.choice("ab"), rng.randrange(300), rng.randrange(50)) for _ in range(60)]
    l, r = spark.createDataFrame(left, "k string, t bigint, id bigint"), spark.createDataFrame(right, "k string, t bigint, v bigint")
    for strict, tolerance in ((False, None), (True, 20), (False, 20)):
        want = []
        for k, t, i in left:
            held = max(((rt, v) for rk, rt, v in right if rk == k and (rt < t if strict else rt <= t)), default=None)
            want.append((k, t, i, held[1] if held and (tolerance is None or t - held[0] <= tolerance) else None))
        got = asof.asof_join(l, r, ["k"], "t", ["v"], tolerance, width, strict)
        assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
        assert not re.search("NestedLoopJoin|CartesianProduct", plan(got))


def test_selection_is_exact(spark):
    rng = random.Random(4)
    values = [rng.choice([-1, 1]) * 10.0 ** rng.uniform(-300, 300) for _ in range(300)] + [0.0, -0.0, math.inf, -math.inf, 5e-324, -5e-324, 1.7e308] + [1 + k * 2.0**-52 for k in range(50)] + [7.0] * 90
    rows = [(f"g{i % 3}", v) for i, v in enumerate(values)] + [("one", 3.5), ("nulls", None), ("g0", None)]
    df = spark.createDataFrame(rows, "g string, x double")
    by = defaultdict(list)
    for g, v in rows:
        if v is not None:
            by[g].append(v)
    for rank, of in ((lambda n: n * 0 + 1, lambda n: 1), (lambda n: n, lambda n: n), (lambda n: F.floor(n / 2) + 1, lambda n: n // 2 + 1), (lambda n: F.floor(n / 3) + 1, lambda n: n // 3 + 1), (lambda n: F.least(n, F.lit(120)), lambda n: min(n, 120))):
        assert {r.g: r.value for r in select.nth(df, ["g"], "x", rank).collect()} == {g: sorted(v)[of(len(v)) - 1] for g, v in by.items()}
    nan = spark.createDataFrame([("a", math.nan), ("a", 1.0), ("a", 2.0)], "g string, x double")
    assert select.nth(nan, ["g"], "x", lambda n: n * 0 + 2).first().value == 2.0 and math.isnan(select.nth(nan, ["g"], "x", lambda n: n).first().value)
    assert "percentile" not in plan(select.nth(df, ["g"], "x", lambda n: n))


def test_reconciliation(spark):
    rng = random.Random(5)
    left = [(f"k{i}", i % 7 if i % 11 else None, "x") for i in range(800)] + [(None, 1, "x"), ("twice", 1, "x"), ("twice", 2, "x")]
    right = [r for r in left if r[0] != "k5"] + [("new", 1, "x")]
    for _ in range(12):
        i = rng.randrange(len(right) - 4)
        right[i] = (right[i][0], 99, "x")
    right[-2] = ("twice", 3, "x")
    frame = lambda rows: spark.createDataFrame(rows, "name string, size bigint, etag string")
    of = lambda rows: {k: sorted(str(r) for r in rows if r[0] == k) for k in {r[0] for r in rows}}
    a, b = of(left), of(right)
    want = {k: "insert" if k not in a else "delete" if k not in b else "update" for k in a.keys() | b.keys() if a.get(k) != b.get(k)}
    for bits, levels in ((2, 1), (4, 3), (12, 2)):
        assert {r.name: r.action for r in rc.reconcile(frame(left), frame(right), ["name"], ["size", "etag"], bits, levels).collect()} == want
    assert rc.reconcile(frame(left), frame(left), ["name"], ["size", "etag"]).count() == 0
    assert rc.reconcile(frame([]), frame(left[:9]), ["name"], ["size", "etag"]).count() == 9


def test_few_differences_shuffle_few_rows(spark):
    """Of two inventories with the same 20000 rows but three, those that meet in the end are those of three buckets."""
    left = spark.range(20_000).select(F.concat(F.lit("k"), "id").alias("name"), F.col("id").alias("size"))
    right = left.withColumn("size", F.when(F.col("id") % 7000 == 1, -1).otherwise(F.col("size"))) if "id" in left.columns else left.withColumn("size", F.when(F.col("size") % 7000 == 1, -1).otherwise(F.col("size")))
    sides = [rc._hashed(x, ["name"], ["size"]) for x in (left, right)]
    found = rc._differing(*sides, 12)
    assert found.count() == 3
    assert rc._within(sides[0], found, 12, True).count() < 60
    assert {(r.name, r.action) for r in rc.reconcile(left, right, ["name"], ["size"]).collect()} == {("k1", "update"), ("k7001", "update"), ("k14001", "update")}


def test_folders(spark):
    blobs = ["a/b/c/1", "a/b/2", "a/3", "4", "x/y/", "x/5", "a/b/c/6", "", "//7", "ü/8"]
    listing = spark.createDataFrame([(b, i + 1) for i, b in enumerate(blobs)], "blob string, content_length bigint")
    want = {}
    for i, b in enumerate(blobs):
        parts = b.split("/")
        for d in range(len(parts)):
            f = "".join(p + "/" for p in parts[:d])
            w = want.setdefault(f, [0, set(), 0, 0])
            if d + 1 < len(parts):
                w[1].add("".join(p + "/" for p in parts[: d + 1]))
            if not b.endswith("/"):
                w[0] += d + 1 == len(parts)
                w[2] += 1
                w[3] += i + 1
    got = {r.folder: [r.files, r.dirs, r.blobs, r.bytes] for r in namespace.folder_rollup(listing).collect()}
    assert got == {f: [a, len(b), c, d] for f, (a, b, c, d) in want.items()}
    children = namespace.children(listing)
    for folder in ("", "a/", "a/b/", "x/"):
        one = namespace.list_directory(listing.filter("blob <> '' AND blob NOT LIKE '%/' AND blob NOT LIKE '//%' AND blob NOT LIKE 'ü%'"), folder)
        here = children.filter((F.col("folder") == folder) & ~F.col("name").isin("", "ü", "y"))
        assert sorted(map(tuple, here.select("name", "kind", "size").collect()), key=str) == sorted(map(tuple, one.collect()), key=str)
    assert namespace.folder_rollup(listing.filter("false")).count() == 0


def test_refresh_sees_rewritten_and_touched_blobs(spark):
    t = spark.createDataFrame([("a", "file", 1, "e", 5), ("b", "file", 1, "e", 5), ("c", "file", 1, "e", 5), ("d", "dir", None, None, None), ("gone", "file", 1, "e", 5), ("n", "file", 1, None, 5)], "name string, kind string, size bigint, etag string, mtime bigint")
    l = spark.createDataFrame([("a", "file", 1, "e", 5), ("b", "file", 1, "f", 5), ("c", "file", 1, "e", 6), ("d", "file", 9, "x", 9), ("new", "file", 1, "e", 5), ("n", "file", 1, None, 5)], t.schema)
    assert {r.name: r.action for r in namespace.refresh(t, l).collect()} == {"a": "keep", "b": "update", "c": "update", "d": "keep", "gone": "delete", "new": "insert", "n": "keep"}
    assert {r.name: r.action for r in namespace.refresh(t.drop("etag", "mtime"), l).collect()}["b"] == "keep"


def test_slices_of_many_nodes(spark, monkeypatch):
    """200 nodes, so four words a slice: the same holders as the filters, word by word; either way that slices meet chunks."""
    keys = spark.createDataFrame([("m", f"b{i % 9}", i * 10) for i in range(400)], "mount string, blob string, offset bigint")
    inv = keys.select("*", F.concat(F.lit("n"), F.lpad((F.col("offset") % 199).cast("string"), 3, "0")).alias("node_id"))
    m = 1 << 9
    filters = {r.node_id: r.words for r in placement.build_filters(inv, m).collect()}
    bits = {(r.mount, r.blob, r.offset): r.bits for r in placement.with_bits(keys, m).collect()}
    want = sorted((*k, n) for k, bs in bits.items() for n, w in filters.items() if all(w[b >> 6] >> (b & 63) & 1 for b in bs))
    assert len(want) > 400
    for most in (placement.MOST_FILTER_BYTES, 1):
        monkeypatch.setattr(placement, "MOST_FILTER_BYTES", most)
        got = placement.probe_blooms(keys, inv, m)
        assert sorted(map(tuple, got.collect())) == want
        assert not re.search("BroadcastNestedLoopJoin|CartesianProduct", plan(got))
