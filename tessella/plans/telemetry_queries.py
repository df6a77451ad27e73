"""Telemetry: deltas, rates, histograms, splits, summaries and the dashboard's expressions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import policy as P
from ..operators import asof as A
from ..operators import chunking as C
from ..operators import telemetry as T
from .common import query
from .placement_queries import BIG, CH
from .views import BOUNDS as VIEW_BOUNDS

BOUNDS = "[5.0, 10.0, 20.0, 40.0, 80.0, 160.0, 1000000.0]"
HD = "hd AS (SELECT node, le, coalesce(a.cum, 0) - coalesce(b.cum, 0) AS cum FROM (SELECT * FROM v_hist WHERE phase = 'post') a FULL JOIN (SELECT * FROM v_hist WHERE phase = 'pre') b USING (node, le)), hm AS (SELECT le, CAST(sum(cum) AS BIGINT) AS cum FROM hd GROUP BY le)"
QS = {"p50": 0.5, "p95": 0.95, "p99": 0.99}


def deltas(V):
    return T.hist_delta(V("v_hist"), ["node"])


def ub(q: float, src: str = "hd", by: str = "node") -> str:
    return f"(SELECT min(x.le) FROM {src} x WHERE x.{by} = g.{by} AND x.cum >= g.total * CAST({q} AS DOUBLE))"


@query("flagship_latency_quantiles", f"WITH {HD}, g AS (SELECT node, max(cum) AS total FROM hd GROUP BY node) SELECT node, {', '.join(f'CASE WHEN total > 0 THEN {ub(q)} END AS {n}' for n, q in QS.items())}, total FROM g")
def _(V):
    """Per node, quantile bounds of the latency histogram between two snapshots."""
    return T.quantile_upper_bound(deltas(V), ["node"], QS)


@query("f_hist_quantile_ub", f"WITH {HD}, hn AS (SELECT 1 AS one, * FROM hm), g AS (SELECT one, max(cum) AS total FROM hn GROUP BY one) SELECT {', '.join(f'CASE WHEN total > 0 THEN {ub(q, chr(104) + chr(110), chr(111) + chr(110) + chr(101))} END AS {n}' for n, q in QS.items())}, total FROM g")
def _(V):
    return T.quantile_upper_bound(T.merge_hist(deltas(V), []), [], QS)


@query("agg_hist_merge", f"WITH {HD} SELECT le, cum FROM hm")
def _(V):
    return T.merge_hist(deltas(V), [])


@query("set_key_union", "SELECT node, le FROM v_hist WHERE phase = 'pre' UNION SELECT node, le FROM v_hist WHERE phase = 'post' AND node % 2 = 0")
def _(V):
    h = V("v_hist")
    return h.filter("phase = 'pre'").select("node", "le").union(h.filter("phase = 'post' AND node % 2 = 0").select("node", "le")).distinct()


CD = "cd AS (SELECT host, metric, e0, epoch_ms, epoch_ms - e0 AS dt, greatest(0, value - v0) AS clamp, CASE WHEN value < v0 THEN value ELSE value - v0 END AS reset, value - v0 AS raw FROM (SELECT *, lag(epoch_ms) OVER w AS e0, lag(value) OVER w AS v0 FROM v_counters WINDOW w AS (PARTITION BY host, metric ORDER BY epoch_ms, value)) WHERE epoch_ms > e0)"
BY = ["host", "metric"]

for _mode in ("clamp", "reset", "raw"):

    @query("win_counter_delta" if _mode == "clamp" else f"win_counter_delta_{_mode}", f"WITH {CD} SELECT host, metric, e0, epoch_ms, dt, CAST({_mode} AS BIGINT) AS delta FROM cd")
    def _(V, mode=_mode):
        return T.counter_delta(V("v_counters"), BY, mode)


NAMES = ("fuse", "peer", "blob", "reads")
SPLIT_RATES = f"""sd AS (SELECT host, epoch_ms, e0, {", ".join(f"greatest(0, {c} - {c}0) AS {c}" for c in NAMES)} FROM (SELECT *, lag(epoch_ms) OVER w AS e0, {", ".join(f"lag({c}) OVER w AS {c}0" for c in NAMES)} FROM v_sampler WINDOW w AS (PARTITION BY host ORDER BY epoch_ms, line_no)) WHERE epoch_ms > e0),
  sb AS (SELECT CAST(floor(((e0 + epoch_ms) / 2 - (SELECT min(epoch_ms) FROM v_sampler)) / 1000 / 3600) AS BIGINT) AS bucket, *, greatest(0, fuse - peer - blob) AS local FROM sd),
  st AS (SELECT {", ".join(f"CAST(sum({c}) AS BIGINT) AS total_{c}" for c in NAMES)} FROM sd)"""


@query("win_rate_bucket", f"WITH {SPLIT_RATES} SELECT bucket, CAST(bucket * 3600 + 1800 AS DOUBLE) AS t_s, {', '.join(f'round(CAST(sum({c}) AS BIGINT) / 3600, 6) AS {c}' for c in (*NAMES, 'local'))}, any_value(total_fuse) AS total_fuse, any_value(total_peer) AS total_peer, any_value(total_blob) AS total_blob, any_value(total_reads) AS total_reads, any_value(greatest(0, total_fuse - total_peer - total_blob)) AS total_local FROM sb, st GROUP BY bucket")
def _(V):
    return T.split_rates(V("v_sampler"), 3600)


RANGE, STEP = 60, 30
BY_METRIC = ["host", "metric"]


def range_sql(name: str, view: str, by: str) -> str:
    """Range rates by `by` as `name`; exact in integers up to the last division."""
    span, step = RANGE * 1000, STEP * 1000
    return f"""{name}_s AS (SELECT *, lag(epoch_ms) OVER w AS e0, lag(value) OVER w AS v0 FROM {view} WINDOW w AS (PARTITION BY {by} ORDER BY epoch_ms, line_no)),
  {name}_x AS (SELECT *, CASE WHEN v0 IS NULL THEN 0 WHEN value < v0 THEN value ELSE value - v0 END AS inc, unnest(range((epoch_ms + {step - 1}) // {step} * {step}, epoch_ms + {span}, {step})) AS t_ms FROM {name}_s),
  {name}_g AS (SELECT {by}, t_ms, CAST(sum(CASE WHEN e0 > t_ms - {span} THEN inc ELSE 0 END) AS BIGINT) AS increase, max(epoch_ms) - min(epoch_ms) AS span, count(*) AS n, min(epoch_ms) AS first, max(epoch_ms) AS last, arg_min(value, struct_pack(e := epoch_ms, l := line_no)) AS base
      FROM {name}_x GROUP BY {by}, t_ms HAVING count(*) >= 2 AND max(epoch_ms) > min(epoch_ms)),
  {name} AS (SELECT *, increase * 1000 / span AS per_s FROM {name}_g)"""


RATE = range_sql("pr", "v_scrapes", "host, metric")


def rates(V, extrapolate: bool = False):
    return T.range_rate(V("v_scrapes"), BY_METRIC, RANGE, STEP, extrapolate)


@query("pq_rate", f"WITH {RATE} SELECT host, metric, t_ms, increase, span, round(per_s, 9) AS per_s FROM pr")
def _(V):
    """rate(M[1m]) of every counter at steps of 30 s"""
    return rates(V).withColumn("per_s", F.round("per_s", 9))


@query("pq_rate_extrapolated", f"""WITH {RATE}, ap AS (SELECT *, span / (n - 1) AS apart, first - (t_ms - {RANGE * 1000}) AS s0, t_ms - last AS e0 FROM pr_g),
  ed AS (SELECT *, CASE WHEN s0 >= apart * CAST(1.1 AS DOUBLE) THEN apart / 2 ELSE s0 END AS s1, CASE WHEN e0 >= apart * CAST(1.1 AS DOUBLE) THEN apart / 2 ELSE e0 END AS e1 FROM ap)
  SELECT host, metric, t_ms, increase, span, round(increase * ((span + least(s1, CASE WHEN increase > 0 AND base >= 0 THEN span * base / increase ELSE s1 END) + e1) / span) / {RANGE}, 9) AS per_s FROM ed""")
def _(V):
    """The same, carried on to the range's edges"""
    return rates(V, True).withColumn("per_s", F.round("per_s", 9))


#: The dashboard's panels and the counters that they sum (fixed names).
PANELS_SUM = {"pq01": "fuse_read_bytes", "pq02": "peer_chunk_bytes_served", "pq03": "blob_fetch_bytes", "pq09": "peer_ok", "pq10": "peer_miss", "pq11": "peer_err", "pq17": "giveups", "pq18": "retry_sleep_s", "pq20": "blob_fetches"}
for _name, _metric in PANELS_SUM.items():

    @query(_name, f"WITH {RATE} SELECT t_ms, round(sum(per_s), 6) AS value FROM pr WHERE metric = '{_metric}' GROUP BY t_ms")
    def _(V, metric=_metric):
        """sum(rate(metric[1m]))"""
        return rates(V).filter(F.col("metric") == metric).groupBy("t_ms").agg(F.round(F.sum("per_s"), 6).alias("value"))


for _name, _metric, _re in (("pq04", "fuse_read_bytes", "node[0-3]"), ("pq19", "blob_fetch_bytes", "node.*"), ("label_regex", "cache_hits", "node[12]")):

    @query(_name, f"WITH {RATE} SELECT host, t_ms, round(sum(per_s), 6) AS value FROM pr WHERE metric = '{_metric}' AND regexp_full_match(host, '{_re}') GROUP BY host, t_ms")
    def _(V, metric=_metric, pattern=_re):
        """sum by (node)(rate(metric{node=~pattern}[1m])), the pattern anchored at both ends"""
        return rates(V).filter((F.col("metric") == metric) & F.col("host").rlike(f"^(?:{pattern})$")).groupBy("host", "t_ms").agg(F.round(F.sum("per_s"), 6).alias("value"))


@query("pq05", f"WITH {RATE}, h AS (SELECT host, t_ms, sum(per_s) FILTER (WHERE metric = 'cache_hits') AS hit, sum(per_s) FILTER (WHERE metric = 'cache_misses') AS miss FROM pr GROUP BY host, t_ms) SELECT host, t_ms, round(hit / greatest(hit + miss, 1), 6) AS ratio FROM h WHERE hit IS NOT NULL AND miss IS NOT NULL")
def _(V):
    """Hit ratio, its denominator at least 1 a second: below that it is understated."""
    side = lambda m: F.sum(F.when(F.col("metric") == m, F.col("per_s")))
    g = rates(V).filter(F.col("metric").isin("cache_hits", "cache_misses")).groupBy("host", "t_ms").agg(side("cache_hits").alias("hit"), side("cache_misses").alias("miss")).filter("hit IS NOT NULL AND miss IS NOT NULL")
    return g.select("host", "t_ms", F.round(F.col("hit") / F.greatest(F.col("hit") + F.col("miss"), F.lit(1.0)), 6).alias("ratio"))


LOOKBACK = 300


def instant_sql(name: str, view: str, by: str) -> str:
    """Instant vectors as `name`: at each step the latest sample of each series."""
    back, step = LOOKBACK * 1000, STEP * 1000
    same = " AND ".join(f"q.{c} = s.{c}" for c in by.split(", "))
    return f"""{name}_s AS (SELECT {by}, epoch_ms, arg_max(value, line_no) AS value FROM {view} GROUP BY ALL),
  {name}_t AS (SELECT unnest(range((min(epoch_ms) + {step - 1}) // {step} * {step}, max(epoch_ms) + {back}, {step})) AS t_ms FROM {name}_s),
  {name}_q AS (SELECT * FROM (SELECT DISTINCT {by} FROM {name}_s) CROSS JOIN {name}_t),
  {name} AS (SELECT {", ".join("q." + c for c in by.split(", "))}, q.t_ms, s.value, q.t_ms - s.epoch_ms AS age_ms FROM {name}_q q ASOF JOIN {name}_s s ON {same} AND q.t_ms >= s.epoch_ms WHERE q.t_ms - s.epoch_ms < {back})"""


GAUGES, TOTALS = instant_sql("ig", "v_gauges", "host, metric"), instant_sql("it", "(SELECT * FROM v_scrapes WHERE metric = 'blob_fetch_bytes')", "host")


def gauge(V, metric: str):
    return A.instant_vector(V("v_gauges").filter(F.col("metric") == metric), ["host"], STEP, LOOKBACK)


def totals(V):
    return A.instant_vector(V("v_scrapes").filter("metric = 'blob_fetch_bytes'"), ["host"], STEP, LOOKBACK)


@query("pq_instant", f"WITH {GAUGES} SELECT host, metric, t_ms, value, age_ms FROM ig")
def _(V):
    """Every gauge at steps of 30 s: its latest sample, none if that is five minutes old"""
    return A.instant_vector(V("v_gauges"), BY_METRIC, STEP, LOOKBACK)


@query("pq06", f"WITH {GAUGES} SELECT host, t_ms, value FROM ig WHERE metric = 'cache_bytes' AND regexp_full_match(host, 'node[0-9]*[0-4]')")
def _(V):
    """cache_bytes{node=~pattern}"""
    return gauge(V, "cache_bytes").filter(F.col("host").rlike("^(?:node[0-9]*[0-4])$")).select("host", "t_ms", "value")


@query("j_asof_gauge", """WITH g AS (SELECT host, epoch_ms, max(value) AS held FROM v_gauges WHERE metric = 'cache_bytes' GROUP BY ALL)
  SELECT s.line_no, s.host, s.epoch_ms, CASE WHEN s.epoch_ms - g.epoch_ms <= 60000 THEN g.held END AS held FROM (SELECT * FROM v_gauges WHERE metric = 'members_alive') s ASOF LEFT JOIN g ON s.host = g.host AND s.epoch_ms >= g.epoch_ms""")
def _(V):
    """How full the cache was at each count of members, as far as it is known for the minute before"""
    full = V("v_gauges").filter("metric = 'cache_bytes'").select("host", "epoch_ms", F.col("value").alias("held"))
    return A.asof_join(V("v_gauges").filter("metric = 'members_alive'").select("line_no", "host", "epoch_ms"), full, ["host"], "epoch_ms", ["held"], 60_000)


@query("pq07", f"WITH {RATE} SELECT host, t_ms, round(per_s, 6) AS value FROM pr WHERE metric = 'evictions'")
def _(V):
    return rates(V).filter("metric = 'evictions'").select("host", "t_ms", F.round("per_s", 6).alias("value"))


@query("pq08", f"WITH {GAUGES} SELECT t_ms, min(value) AS value FROM ig WHERE metric = 'members_alive' GROUP BY t_ms")
def _(V):
    """min(members_alive)"""
    return gauge(V, "members_alive").groupBy("t_ms").agg(F.min("value").alias("value"))


@query("pq16", f"WITH {RATE} SELECT replace(metric, 'blob_status_', '') AS status, t_ms, round(sum(per_s), 6) AS value FROM pr WHERE starts_with(metric, 'blob_status_') GROUP BY ALL")
def _(V):
    r = rates(V).filter(F.startswith("metric", F.lit("blob_status_")))
    return r.groupBy(F.replace("metric", F.lit("blob_status_"), F.lit("")).alias("status"), "t_ms").agg(F.round(F.sum("per_s"), 6).alias("value"))


@query("pq21", f"WITH {TOTALS} SELECT t_ms, CAST(sum(value) AS BIGINT) AS value FROM it GROUP BY t_ms")
def _(V):
    """sum(blob_fetch_bytes)"""
    return totals(V).groupBy("t_ms").agg(F.sum("value").cast("bigint").alias("value"))


@query("pq22", f"WITH {TOTALS} SELECT host, t_ms, CAST(sum(value) AS BIGINT) AS value FROM it WHERE regexp_full_match(host, 'node[1-5]') GROUP BY host, t_ms")
def _(V):
    """sum by (node)(blob_fetch_bytes{node=~pattern})"""
    return totals(V).filter(F.col("host").rlike("^(?:node[1-5])$")).groupBy("host", "t_ms").agg(F.sum("value").cast("bigint").alias("value"))


@query("pq_vars", "SELECT DISTINCT host FROM v_counters WHERE metric = 'view'")
def _(V):
    return V("v_counters").filter("metric = 'view'").select("host").distinct()


BUCKET_RATE = range_sql("br", "v_buckets", "metric, host, le")


def quantile_sql(metric: str, by: str, q: float) -> str:
    """Linear interpolation over the rates by bound."""
    return f"""WITH {BUCKET_RATE}, su AS (SELECT {by}, le, sum(per_s) AS cum FROM br WHERE metric = '{metric}' GROUP BY {by}, le),
  ix AS (SELECT *, lag(le, 1, 0) OVER w AS lo, lag(cum, 1, 0) OVER w AS before, max(cum) OVER (PARTITION BY {by}) * CAST({q} AS DOUBLE) AS goal, row_number() OVER w AS k, count(*) OVER (PARTITION BY {by}) AS n FROM su WINDOW w AS (PARTITION BY {by} ORDER BY le))
  SELECT {by}, round(max(CASE WHEN goal > 0 AND cum >= goal AND before < goal THEN CASE WHEN k = n THEN lo ELSE lo + (le - lo) * (goal - before) / (cum - before) END END), 4) AS value FROM ix GROUP BY {by}"""


def bucket_quantile(V, metric: str, by: list[str], q: float):
    r = T.bucket_rates(V("v_bucket_counts").filter(F.col("metric") == metric), ["host"], VIEW_BOUNDS, RANGE, STEP)
    return T.quantile_interpolated(r.groupBy(*by, "le").agg(F.sum("per_s").alias("cum")), by, {"value": q}, 4)


for _name, _q in (("pq12", 0.5), ("pq13", 0.99)):

    @query(_name, quantile_sql("fuse_read_seconds", "t_ms", _q))
    def _(V, q=_q):
        """histogram_quantile(q, sum by (le)(rate(fuse_read_seconds_bucket[1m])))"""
        return bucket_quantile(V, "fuse_read_seconds", ["t_ms"], q)


for _name, _q in (("pq14", 0.5), ("pq15", 0.99)):

    @query(_name, quantile_sql("chunk_peer_fetch_seconds", "t_ms", _q))
    def _(V, q=_q):
        """histogram_quantile(q, sum by (le)(rate(chunk_peer_fetch_seconds_bucket[1m])))"""
        return bucket_quantile(V, "chunk_peer_fetch_seconds", ["t_ms"], q)


# Before and after


@query("j_counter_before_after", "SELECT pod, metric, a.value - coalesce(b.value, 0) AS delta FROM v_after a LEFT JOIN v_before b USING (pod, metric)")
def _(V):
    return T.before_after(V("v_before"), V("v_after"))


@query("j_prom_delta", "SELECT pod, metric, coalesce(a.value, 0) - coalesce(b.value, 0) AS delta FROM v_after a FULL JOIN v_before b USING (pod, metric) WHERE coalesce(a.value, 0) <> coalesce(b.value, 0)")
def _(V):
    return T.before_after(V("v_before"), V("v_after"), "full_outer")


@query("j_pod_files", "SELECT pod, metric, a.value - b.value AS delta FROM v_after a JOIN v_before b USING (pod, metric)")
def _(V):
    return T.before_after(V("v_before"), V("v_after"), "inner")


@query("j_host_intersect", "SELECT DISTINCT pod FROM v_after JOIN v_before USING (pod)")
def _(V):
    return V("v_after").join(V("v_before"), "pod", "left_semi").select("pod").distinct()


@query("set_host_intersect", "SELECT pod FROM v_after INTERSECT SELECT pod FROM v_before")
def _(V):
    return V("v_after").select("pod").intersect(V("v_before").select("pod"))


@query("agg_delta_cluster", "SELECT metric, CAST(sum(a.value - coalesce(b.value, 0)) AS BIGINT) AS delta FROM v_after a LEFT JOIN v_before b USING (pod, metric) GROUP BY metric")
def _(V):
    return T.before_after(V("v_before"), V("v_after")).groupBy("metric").agg(F.sum("delta").cast("bigint").alias("delta"))


METRICS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
COLS = ["urgent", "high", "medium", "none", "low"]


@query("agg_pivot_metrics", f"SELECT pod, {', '.join(f'CAST(coalesce(sum(d) FILTER (WHERE metric = {chr(39)}{m}{chr(39)}), 0) AS BIGINT) AS {c}' for m, c in zip(METRICS, COLS, strict=True))} FROM (SELECT pod, metric, a.value - coalesce(b.value, 0) AS d FROM v_after a LEFT JOIN v_before b USING (pod, metric)) GROUP BY pod")
def _(V):
    """One row a pod, one column a metric; its columns are given, so the pivot needs no pass of its own."""
    p = T.before_after(V("v_before"), V("v_after")).groupBy("pod").pivot("metric", METRICS).agg(F.sum("delta"))
    return p.select("pod", *[F.coalesce(F.col(f"`{m}`"), F.lit(0)).cast("bigint").alias(c) for m, c in zip(METRICS, COLS, strict=True)])


PS = "ps AS (SELECT pod, min(node) AS node, CAST(sum(coalesce(TRY_CAST(bytes_text AS BIGINT), 0)) AS BIGINT) AS bytes, max(wall_s) AS wall_s FROM v_pass GROUP BY pod)"


def passes(V):
    return V("v_pass").groupBy("pod").agg(F.min("node").alias("node"), F.sum(F.coalesce(F.col("bytes_text").try_cast("bigint"), F.lit(0))).cast("bigint").alias("bytes"), F.max("wall_s").alias("wall_s"))


@query("j_diag_summary", f"WITH {PS}, a AS (SELECT pod, CAST(sum(value) AS BIGINT) AS a FROM v_after GROUP BY pod), b AS (SELECT pod, CAST(sum(value) AS BIGINT) AS b FROM v_before GROUP BY pod) SELECT pod, node, coalesce(b, 0) AS before, coalesce(a, 0) AS after, coalesce(bytes, 0) AS bytes, wall_s FROM a FULL JOIN b USING (pod) FULL JOIN ps USING (pod)")
def _(V):
    s = lambda v, n: V(v).groupBy("pod").agg(F.sum("value").cast("bigint").alias(n))
    j = s("v_after", "after").join(s("v_before", "before"), "pod", "full_outer").join(passes(V), "pod", "full_outer")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return j.select("pod", "node", zero("before"), zero("after"), zero("bytes"), "wall_s")


@query("sort_wall_desc", f"WITH {PS} SELECT pod, node, wall_s FROM ps")
def _(V):
    return passes(V).select("pod", "node", "wall_s").orderBy(F.desc("wall_s"), "pod")


@query("j_wall_bytes", "SELECT pod, wall_s, coalesce(TRY_CAST(bytes_text AS BIGINT), 0) AS bytes FROM v_pass")
def _(V):
    return V("v_pass").select("pod", "wall_s", F.coalesce(F.col("bytes_text").try_cast("bigint"), F.lit(0)).cast("bigint").alias("bytes"))


WALL = "count(*) AS pods, count(*) FILTER (WHERE rc <> 0) AS failed, CAST(sum(coalesce(TRY_CAST(bytes_text AS BIGINT), 0)) AS BIGINT) AS bytes, max(wall_s) AS max_s, list_sort(list(wall_s))[count(*) // 2 + 1] AS p50_s"


@query("agg_wall_stats", f"SELECT node, pods, bytes, max_s, p50_s, round(bytes / max_s, 6) AS bytes_per_s FROM (SELECT node, {WALL} FROM v_pass GROUP BY node)")
def _(V):
    return T.wall_stats(V("v_pass"), ["node"]).drop("failed", "gbps")


@query("agg_azcp_matrix", f"SELECT n, pods, failed, bytes, max_s, round(bytes / max_s / 125000000.0, 9) AS gbps, round(round(bytes / max_s / 125000000.0, 9) / pods, 9) AS gbps_per_node FROM (SELECT n, {WALL} FROM v_pass GROUP BY n)")
def _(V):
    w = T.wall_stats(V("v_pass"), ["n"])
    return w.select("n", "pods", "failed", "bytes", "max_s", "gbps", F.round(F.col("gbps") / F.col("pods"), 9).alias("gbps_per_node"))


@query("agg_first_last", "SELECT host, metric, CAST(greatest(0, arg_max(value, line_no) - arg_min(value, line_no)) AS BIGINT) AS delta FROM v_counters GROUP BY host, metric HAVING count(*) >= 2")
def _(V):
    """In the file's order, whatever the times say."""
    return T.first_last(V("v_counters"), BY, "line_no")


AT = "struct_pack(e := epoch_ms, l := line_no)"
BRACKET = f"bk AS (SELECT host, CAST(greatest(0, max(epoch_ms) - min(epoch_ms)) AS BIGINT) AS ms, {', '.join(f'CAST(greatest(0, arg_max({c}, {AT}) - arg_min({c}, {AT})) AS BIGINT) AS {c}' for c in NAMES)} FROM v_sampler GROUP BY host), sl AS (SELECT *, greatest(0, fuse - peer - blob) AS local FROM bk)"


@query("agg_source_split", f"WITH {BRACKET} SELECT host, fuse AS total, CAST(local AS BIGINT) AS local, round(100.0 * local / CASE WHEN fuse = 0 THEN 1 ELSE fuse END, 6) AS local_pct, round(100.0 * peer / CASE WHEN fuse = 0 THEN 1 ELSE fuse END, 6) AS peer_pct, round(100.0 * blob / CASE WHEN fuse = 0 THEN 1 ELSE fuse END, 6) AS blob_pct FROM sl")
def _(V):
    """Each node's counters between its first and last sample, clamped one by one; local is what neither peers nor the origin served."""
    return T.brackets(V("v_sampler")).select("host", F.col("fuse").alias("total"), *[c.alias(n) for n, c in T.source_split(F.col("fuse"), F.col("peer"), F.col("blob")).items()])


@query("agg_comparison", f"WITH {BRACKET} SELECT host, CAST(fuse - blob AS BIGINT) AS egress_avoided, round(100.0 * (fuse - blob) / fuse, 6) AS avoided_pct FROM sl WHERE fuse > 0")
def _(V):
    s = T.brackets(V("v_sampler")).filter("fuse > 0")
    return s.select("host", (F.col("fuse") - F.col("blob")).cast("bigint").alias("egress_avoided"), F.round(F.lit(100.0) * (F.col("fuse") - F.col("blob")) / F.col("fuse"), 6).alias("avoided_pct"))


@query("agg_bracket_time", f"WITH {BRACKET}, b AS (SELECT avg(ms) / 1000 AS dt, CAST(sum(fuse) AS BIGINT) AS total, CAST(sum(reads) AS BIGINT) AS reads, count(*) AS hosts FROM bk) SELECT hosts, round(dt, 6) AS mean_s, total, round(total / dt, 6) AS per_s, round(reads / dt, 6) AS iops FROM b")
def _(V):
    """Bandwidth and reads over the mean of the nodes' brackets."""
    b = T.brackets(V("v_sampler")).agg((F.avg("ms") / 1000).alias("dt"), F.sum("fuse").cast("bigint").alias("total"), F.sum("reads").cast("bigint").alias("reads"), F.count(F.lit(1)).alias("hosts"))
    return b.select("hosts", F.round("dt", 6).alias("mean_s"), "total", F.round(F.col("total") / F.col("dt"), 6).alias("per_s"), F.round(F.col("reads") / F.col("dt"), 6).alias("iops"))


@query("agg_harness", "SELECT phase, count(*) AS samples, CAST(sum(got) AS BIGINT) AS bytes, max(t1 - t0) AS elapsed, round(count(*) / max(t1 - t0), 6) AS samples_s, round(CAST(sum(got) AS BIGINT) / 1000000.0 / max(t1 - t0), 6) AS mb_s, round(CAST(sum(got) AS BIGINT) * 8 / 1000000000.0 / max(t1 - t0), 9) AS gbps FROM v_tasks GROUP BY phase")
def _(V):
    g = V("v_tasks").groupBy("phase").agg(F.count(F.lit(1)).alias("samples"), F.sum("got").cast("bigint").alias("bytes"), F.max(F.col("t1") - F.col("t0")).alias("elapsed"))
    return g.withColumns({"samples_s": F.round(F.col("samples") / F.col("elapsed"), 6), "mb_s": F.round(F.col("bytes") / F.lit(1e6) / F.col("elapsed"), 6), "gbps": F.round(F.col("bytes") * 8 / F.lit(1e9) / F.col("elapsed"), 9)})


@query("f_fmt_latency", "SELECT event_id, CASE WHEN s IS NULL THEN 'n/a' WHEN s < 0.001 THEN format('{:.0f}us', s * 1000000.0) WHEN s < 1 THEN format('{:.1f}ms', s * 1000.0) ELSE format('{:.2f}s', s) END AS text FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN (event_id % 997 + 0.25) / 1000000.0 WHEN 2 THEN (event_id % 991 + 1.03) / 1000.0 ELSE event_id % 89 + 1.127 END AS s FROM events)")
def _(V):
    e = F.col("event_id")
    s = F.when(e % 4 == 1, (e % 997 + F.lit(0.25)) / F.lit(1e6)).when(e % 4 == 2, (e % 991 + F.lit(1.03)) / F.lit(1e3)).when(e % 4 == 3, e % 89 + F.lit(1.127))
    return V("events").select("event_id", P.format_latency(s).alias("text"))


@query("f_pct_round", "SELECT node, round_even(100.0 * sum(size) / (SELECT sum(size) FROM v_access), 1) AS pct FROM v_access GROUP BY node")
def _(V):
    g = V("v_access").groupBy("node").agg(F.sum("size").alias("s"))
    return g.select("node", P.percent(F.col("s"), F.sum("s").over(Window.partitionBy())).alias("pct"))


@query("f_units", "SELECT n_name, n_nationkey * 1073741824 AS gib_bytes, round(n_nationkey * 1073741824 / 1048576.0, 6) AS mib, round(n_nationkey * 1073741824 / 125000000.0, 6) AS gbit FROM (SELECT n_name, CAST(n_nationkey AS BIGINT) AS n_nationkey FROM v_names)")
def _(V):
    b = F.col("n_nationkey").cast("bigint") * F.lit(1073741824)
    return V("v_names").select("n_name", b.alias("gib_bytes"), F.round(b / F.lit(1048576.0), 6).alias("mib"), F.round(b / F.lit(125000000.0), 6).alias("gbit"))


# Reports done by hand


@query("rep_footprint", f"WITH {CH}, c AS (SELECT split_part(blob, '/', 1) AS part, len, (off // {BIG} + length(blob)) % 11 <> 3 AS held FROM ch), g AS (SELECT part, CAST(sum(len) * 2 AS BIGINT) AS expected, CAST(sum(CASE WHEN held THEN len * 2 ELSE len END) AS BIGINT) AS have FROM c GROUP BY part) SELECT part, have, expected, expected - have AS shortfall, CAST(ceil((expected - have) / {BIG}) AS BIGINT) AS missing_chunks FROM g")
def _(V):
    """What two replicas should hold against what the nodes' inventories add up to (here some chunks have one copy), in bytes and whole chunks."""
    c = C.enumerate_chunks(V("v_listing"), BIG)
    copies = F.when((F.floor(F.col("offset") / BIG) + F.length("blob")) % 11 != 3, 2).otherwise(1)
    g = c.groupBy(F.split_part("blob", F.lit("/"), F.lit(1)).alias("part")).agg((F.sum("len") * 2).cast("bigint").alias("expected"), F.sum(F.col("len") * copies).cast("bigint").alias("have"))
    short = F.col("expected") - F.col("have")
    return g.select("part", "have", "expected", short.alias("shortfall"), F.ceil(short / BIG).cast("bigint").alias("missing_chunks"))


FL = "fl AS (SELECT host, metric, CAST(greatest(0, arg_max(value, struct_pack(e := epoch_ms, l := line_no)) - arg_min(value, struct_pack(e := epoch_ms, l := line_no))) AS BIGINT) AS delta FROM v_scrapes GROUP BY host, metric HAVING count(*) >= 2)"


@query("rep_demand_breakdown", f"WITH {FL}, d AS (SELECT host, coalesce(sum(delta) FILTER (WHERE metric = 'cache_hits'), 0) AS hits, coalesce(sum(delta) FILTER (WHERE metric = 'cache_misses'), 0) AS misses, coalesce(sum(delta) FILTER (WHERE metric = 'peer_ok'), 0) AS peer_ok FROM fl GROUP BY host) SELECT host, CAST(hits + misses AS BIGINT) AS demand, round(100.0 * hits / nullif(hits + misses, 0), 6) AS lru_pct, round(100.0 * peer_ok / nullif(hits + misses, 0), 6) AS peer_pct, CAST(greatest(0, misses - peer_ok) AS BIGINT) AS coalesced FROM d")
def _(V):
    """Counters' gains: demand is hits and misses; what missed and no peer served was shared with another fetch."""
    s = T.first_last(V("v_scrapes").withColumn("pos", F.struct("epoch_ms", "line_no")), BY, "pos")
    gain = lambda m, n: F.coalesce(F.sum(F.when(F.col("metric") == m, F.col("delta"))), F.lit(0)).alias(n)
    s = s.groupBy("host").agg(gain("cache_hits", "hits"), gain("cache_misses", "misses"), gain("peer_ok", "peer_ok")).withColumn("demand", (F.col("hits") + F.col("misses")).cast("bigint"))
    pct = lambda c: F.round(F.lit(100.0) * F.col(c) / F.nullif(F.col("demand"), F.lit(0)), 6)
    return s.select("host", "demand", pct("hits").alias("lru_pct"), pct("peer_ok").alias("peer_pct"), F.greatest(F.lit(0), F.col("misses") - F.col("peer_ok")).cast("bigint").alias("coalesced"))


@query("rep_ab_delta", "SELECT pod, metric, a.value - b.value AS delta, round(100.0 * (a.value - b.value) / b.value, 6) AS pct FROM v_after a LEFT JOIN v_before b USING (pod, metric)")
def _(V):
    j = V("v_after").withColumnRenamed("value", "a").join(V("v_before").withColumnRenamed("value", "b"), ["pod", "metric"], "left")
    d = F.col("a") - F.col("b")
    return j.select("pod", "metric", d.alias("delta"), F.round(F.lit(100.0) * d / F.nullif(F.col("b"), F.lit(0)), 6).alias("pct"))


@query("rep_ab_config", "SELECT metric, count(*) AS n, round(100.0 * (avg(a.value) / avg(b.value) - 1), 6) AS pct FROM v_after a JOIN v_before b USING (pod, metric) GROUP BY metric")
def _(V):
    """Change of the means, not the mean of changes."""
    j = V("v_after").withColumnRenamed("value", "a").join(V("v_before").withColumnRenamed("value", "b"), ["pod", "metric"])
    return j.groupBy("metric").agg(F.count(F.lit(1)).alias("n"), F.round(F.lit(100.0) * (F.avg("a") / F.avg("b") - 1), 6).alias("pct"))


@query("rep_invariants", "SELECT peer, count(got) AS ok, count(*) - count(got) - count(error) AS unexplained FROM v_tasks GROUP BY peer HAVING count(*) <> count(got) + count(error)")
def _(V):
    g = V("v_tasks").groupBy("peer").agg(F.count(F.lit(1)).alias("n"), F.count("got").alias("ok"), F.count("error").alias("e"))
    return g.filter("n <> ok + e").select("peer", "ok", (F.col("n") - F.col("ok") - F.col("e")).alias("unexplained"))


@query("rep_semantic_equiv", "SELECT pod, metric, abs(coalesce(a.value, 0) - coalesce(b.value, 0)) <= 1 AS same FROM v_after a FULL JOIN v_before b USING (pod, metric)")
def _(V):
    j = V("v_after").withColumnRenamed("value", "a").join(V("v_before").withColumnRenamed("value", "b"), ["pod", "metric"], "full_outer")
    return j.select("pod", "metric", (F.abs(F.coalesce("a", F.lit(0)) - F.coalesce("b", F.lit(0))) <= 1).alias("same"))


@query("rep_loss_equal", "SELECT key, round(max(s) - min(s), 6) AS gap, max(s) - min(s) <= 0.0001 AS equal FROM (SELECT key, event_type, avg(size) AS s FROM v_access GROUP BY key, event_type) GROUP BY key")
def _(V):
    """Per step the spread between runs (here: mean size by key, over event types)."""
    s = V("v_access").groupBy("key", "event_type").agg(F.avg("size").alias("s"))
    return s.groupBy("key").agg(F.round(F.max("s") - F.min("s"), 6).alias("gap"), (F.max("s") - F.min("s") <= 1e-4).alias("equal"))
