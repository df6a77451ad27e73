"""Telemetry: counter deltas and rates, merged histograms and their two quantiles, splits and summaries.

Rates are evaluated at steps over the sliding range that ends there, open at its start: increase over elapsed time, counter resets handled by
counting from zero. Without extrapolation it is the time between the range's first and last sample that counts; with it the increase is
carried on to the range's edges, by half a sample's distance at most where they are far, and never below a counter's zero. A range with
fewer than two samples has no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..units import GBIT_BYTES
from .asof import SEGMENT_MS
from .scan import neighbour
from .select import nth


def counter_delta(samples: DataFrame, by: list[str], mode: str = "clamp") -> DataFrame:
    """Consecutive samples of a counter (by, epoch_ms, value): dt and delta. A fall gives 0 (clamp), the new value (reset) or itself (raw)."""
    p = neighbour(samples.select(*by, "epoch_ms", "value"), by, ["epoch_ms", "value"], SEGMENT_MS, {"e0": "epoch_ms", "v0": "value"})
    p = p.withColumns({"dt": F.col("epoch_ms") - F.col("e0"), "raw": F.col("value") - F.col("v0")}).filter("dt > 0")
    delta = {"clamp": F.greatest(F.lit(0), F.col("raw")), "reset": F.when(F.col("raw") < 0, F.col("value")).otherwise(F.col("raw")), "raw": F.col("raw")}[mode]
    return p.select(*by, "e0", "epoch_ms", "dt", delta.cast("bigint").alias("delta"))


def split_rates(samples: DataFrame, width_s: int) -> DataFrame:
    """host, epoch_ms, line_no, fuse, peer, blob, reads -> rates by bucket, and totals.

    Each interval's clamped deltas go to the bucket of its midpoint since the first sample; local is what neither peers nor the origin served in
    the interval. total_local is clamped once, of the totals, and isn't the sum of the buckets'. Empty buckets have no row."""
    names = ("fuse", "peer", "blob", "reads")
    p = neighbour(samples, ["host"], ["epoch_ms", "line_no"], SEGMENT_MS, {"e0": "epoch_ms", **{f"{c}0": c for c in names}}).filter(F.col("epoch_ms") > F.col("e0"))
    d = p.select("e0", "epoch_ms", *[F.greatest(F.lit(0), F.col(c) - F.col(f"{c}0")).alias(c) for c in names])
    d = d.withColumn("local", F.greatest(F.lit(0), F.col("fuse") - F.col("peer") - F.col("blob")))
    t0 = samples.agg(F.min("epoch_ms").alias("t0"))
    k = F.floor(((F.col("e0") + F.col("epoch_ms")) / 2 - F.col("t0")) / 1000 / width_s).cast("bigint")
    total = lambda c: F.sum(c).cast("bigint").alias(c)
    g = d.crossJoin(F.broadcast(t0)).groupBy(k.alias("bucket")).agg(*[total(c) for c in (*names, "local")])
    every = g.agg(*[F.sum(c).cast("bigint").alias(f"total_{c}") for c in names])
    every = every.withColumn("total_local", F.greatest(F.lit(0), F.col("total_fuse") - F.col("total_peer") - F.col("total_blob")))
    rate = [F.round(F.col(c) / width_s, 6).alias(c) for c in (*names, "local")]
    return g.crossJoin(F.broadcast(every)).select("bucket", (F.col("bucket") * width_s + width_s / 2).cast("double").alias("t_s"), *rate, "total_fuse", "total_peer", "total_blob", "total_reads", "total_local")


def range_rate(samples: DataFrame, by: list[str], range_s: int = 60, step_s: int = 30, extrapolate: bool = False) -> DataFrame:
    """by, epoch_ms, line_no, value -> by, t_ms (the step), increase, span (ms between first and last sample), per_s.

    One ordered pass over each series, in segments, finds what a sample adds to the one before; a sample then goes to the range_s / step_s steps whose range
    holds it, where an increase counts if the sample before lies in the range as well. A segment is a step, so there are no more of them than rows of the
    result, about; a series' key may be null."""
    s = samples.select(F.struct(*by).alias("__series"), "epoch_ms", "line_no", "value")
    p = neighbour(s, ["__series"], ["epoch_ms", "line_no"], 1000 * step_s, {"e0": "epoch_ms", "v0": "value"})
    p = p.select(*[F.col("__series")[c].alias(c) for c in by], "epoch_ms", "line_no", "value", "e0", "v0")
    p = p.withColumn("inc", F.when(F.col("v0").isNull(), 0).when(F.col("value") < F.col("v0"), F.col("value")).otherwise(F.col("value") - F.col("v0")))
    step, span = 1000 * step_s, 1000 * range_s
    first = F.ceil(F.col("epoch_ms") / step).cast("bigint") * step
    p = p.select(*by, "epoch_ms", "line_no", "value", "e0", "inc", F.explode(F.sequence(first, F.col("epoch_ms") + span - 1, F.lit(step).cast("bigint"))).alias("t_ms"))
    g = p.groupBy(*by, "t_ms").agg(
        F.sum(F.when(F.col("e0") > F.col("t_ms") - span, F.col("inc")).otherwise(0)).cast("bigint").alias("increase"),
        F.min("epoch_ms").alias("first"),
        F.max("epoch_ms").alias("last"),
        F.count(F.lit(1)).alias("n"),
        F.min(F.struct("epoch_ms", "line_no", "value"))["value"].alias("from"),
    )
    g = g.filter("n >= 2 AND last > first").withColumn("span", F.col("last") - F.col("first"))
    if not extrapolate:
        return g.select(*by, "t_ms", "increase", "span", (F.col("increase") * 1000 / F.col("span")).alias("per_s"))
    apart = F.col("span") / (F.col("n") - 1)
    edge = lambda gap: F.when(gap >= apart * 1.1, apart / 2).otherwise(gap)
    start = edge(F.col("first") - (F.col("t_ms") - span))
    zero = F.when((F.col("increase") > 0) & (F.col("from") >= 0), F.col("span") * F.col("from") / F.col("increase"))
    whole = F.col("span") + F.least(start, F.coalesce(zero, start)) + edge(F.col("t_ms") - F.col("last"))
    return g.select(*by, "t_ms", "increase", "span", (F.col("increase") * (whole / F.col("span")) / range_s).alias("per_s"))


def bucket_rates(samples: DataFrame, by: list[str], bounds: tuple[float, ...], range_s: int = 60, step_s: int = 30) -> DataFrame:
    """by, epoch_ms, line_no, counts (an array, one for each bound) -> by, le, t_ms, increase, span, per_s: range_rate of every bound's series.

    A scrape's counts stay side by side until they are summed up by step, so its rows aren't multiplied by the bounds before."""
    step, span = 1000 * step_s, 1000 * range_s
    s = samples.select(F.struct(*by).alias("__series"), "epoch_ms", "line_no", "counts")
    p = neighbour(s, ["__series"], ["epoch_ms", "line_no"], step, {"e0": "epoch_ms", "c0": "counts"})
    first = F.ceil(F.col("epoch_ms") / step).cast("bigint") * step
    p = p.withColumn("t_ms", F.explode(F.sequence(first, F.col("epoch_ms") + span - 1, F.lit(step).cast("bigint"))))

    def increase(i: int) -> Column:
        now, was = F.get("counts", F.lit(i)), F.get("c0", F.lit(i))
        inc = F.when(was.isNull(), 0).when(now < was, now).otherwise(now - was)
        return F.sum(F.when(F.col("e0") > F.col("t_ms") - span, inc).otherwise(0)).cast("bigint")

    g = p.groupBy("__series", "t_ms").agg(F.min("epoch_ms").alias("first"), F.max("epoch_ms").alias("last"), F.count(F.lit(1)).alias("n"), *[increase(i).alias(f"i{i}") for i in range(len(bounds))])
    g = g.filter("n >= 2 AND last > first").withColumn("span", F.col("last") - F.col("first"))
    g = g.select("*", F.explode(F.array(*[F.struct(F.lit(le).alias("le"), F.col(f"i{i}").alias("increase")) for i, le in enumerate(bounds)])).alias("b"))
    return g.select(*[F.col("__series")[c].alias(c) for c in by], "b.le", "t_ms", "b.increase", "span", (F.col("b.increase") * 1000 / F.col("span")).alias("per_s"))


def hist_delta(hist: DataFrame, by: list[str]) -> DataFrame:
    """Bucket counts after less before, a missing bucket counting 0."""
    side = lambda phase, name: hist.filter(F.col("phase") == phase).select(*by, "le", F.col("cum").alias(name))
    j = side("post", "after").join(side("pre", "before"), [*by, "le"], "full_outer")
    return j.select(*by, "le", (F.coalesce("after", F.lit(0)) - F.coalesce("before", F.lit(0))).cast("bigint").alias("cum"))


def merge_hist(deltas: DataFrame, by: list[str]) -> DataFrame:
    return deltas.groupBy(*by, "le").agg(F.sum("cum").cast("bigint").alias("cum"))


def _buckets(hist: DataFrame, by: list[str]) -> DataFrame:
    """A histogram's buckets as one array per group: as many as bounds."""
    return hist.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("le", "cum"))).alias("b")).withColumn("total", F.element_at("b", -1)["cum"])


def quantile_upper_bound(hist: DataFrame, by: list[str], qs: dict[str, float]) -> DataFrame:
    """The first bound whose cumulative count reaches the share; null for an empty histogram."""
    b = _buckets(hist, by)
    bound = lambda q: F.when(F.col("total") > 0, F.filter("b", lambda x: x["cum"] >= F.col("total") * F.lit(q))[0]["le"])
    return b.select(*by, *[bound(q).alias(name) for name, q in qs.items()], "total")


def quantile_interpolated(hist: DataFrame, by: list[str], qs: dict[str, float], digits: int = 6) -> DataFrame:
    """Linear within the bucket that holds the rank; the bound below the last for ranks in the last, unbounded one."""
    b = _buckets(hist, by)

    def at(q: float) -> Column:
        rank = F.col("total") * F.lit(q)
        k = F.array_position(F.transform("b", lambda x: x["cum"] >= rank), F.lit(True)).cast("int")
        prev = lambda f: F.when(k > 1, F.get(F.col("b"), k - 2)[f]).otherwise(F.lit(0))
        here = F.get(F.col("b"), k - 1)
        inside = prev("le") + (here["le"] - prev("le")) * (rank - prev("cum")) / (here["cum"] - prev("cum"))
        return F.when(F.col("total") > 0, F.when(k == F.size("b"), prev("le").cast("double")).otherwise(inside))

    return b.select(*by, *[F.round(at(q), digits).alias(name) for name, q in qs.items()])


def hist_mean(sums: Column, count: Column) -> Column:
    return F.when(count > 0, sums / count)


def before_after(before: DataFrame, after: DataFrame, how: str = "left") -> DataFrame:
    """pod, metric, delta. left: every counter after, missing before is 0; full_outer: all keys, without zero deltas; inner: keys in both."""
    j = after.withColumnRenamed("value", "a").join(before.withColumnRenamed("value", "b"), ["pod", "metric"], how)
    d = j.select("pod", "metric", (F.coalesce("a", F.lit(0)) - F.coalesce("b", F.lit(0))).cast("bigint").alias("delta"))
    return d.filter("delta <> 0") if how == "full_outer" else d


def wall_stats(passes: DataFrame, by: list[str]) -> DataFrame:
    """Upper median, maximum, and bytes over the slowest pod's wall time; unreadable bytes count 0."""
    nbytes = F.coalesce(F.col("bytes_text").try_cast("bigint"), F.lit(0))
    passes = passes.withColumn("__all", F.lit(1))
    keys = [*by, "__all"]
    g = passes.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("pods"),
        F.max("wall_s").alias("max_s"),
        F.sum(nbytes).cast("bigint").alias("bytes"),
        F.count_if(F.col("rc") != 0).alias("failed"),
    )
    g = g.join(nth(passes, keys, "wall_s", lambda n: F.floor(n / 2) + 1).withColumnRenamed("value", "p50_s"), keys, "left")
    return g.select(*by, "pods", "failed", "bytes", "max_s", "p50_s", F.round(F.col("bytes") / F.col("max_s"), 6).alias("bytes_per_s"), F.round(F.col("bytes") / F.col("max_s") / GBIT_BYTES, 9).alias("gbps"))


def brackets(samples: DataFrame) -> DataFrame:
    """Sampler rows -> by host the bracket's milliseconds and each counter's last value less its first, never negative."""
    at = F.struct("epoch_ms", "line_no")
    ends = samples.groupBy("host").agg(*[f(c, at).alias(f"{c}_{x}") for c in ("epoch_ms", "fuse", "peer", "blob", "reads") for f, x in ((F.min_by, "a"), (F.max_by, "z"))])
    gain = lambda c: F.greatest(F.lit(0), F.col(f"{c}_z") - F.col(f"{c}_a")).cast("bigint")
    return ends.select("host", gain("epoch_ms").alias("ms"), *[gain(c).alias(c) for c in ("fuse", "peer", "blob", "reads")])


def first_last(samples: DataFrame, by: list[str], order: str) -> DataFrame:
    """Last less first value in row order, never negative; groups with one row are left out."""
    g = samples.groupBy(*by).agg(F.min_by("value", order).alias("a"), F.max_by("value", order).alias("z"), F.count(F.lit(1)).alias("n")).filter("n >= 2")
    return g.select(*by, F.greatest(F.lit(0), F.col("z") - F.col("a")).cast("bigint").alias("delta"))


def source_split(total: Column, peer: Column, blob: Column) -> dict[str, Column]:
    """Where reads came from: local is what neither peers nor the origin served."""
    local = F.greatest(F.lit(0), total - peer - blob)
    share = lambda x: F.round(F.lit(100.0) * x / F.when(total == 0, 1).otherwise(total), 6)
    return {"local": local, "local_pct": share(local), "peer_pct": share(peer), "blob_pct": share(blob)}
