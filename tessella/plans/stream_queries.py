"""Streams over the events table: the file source is read to its end, and the results equal the batch operators'."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_path
from ..streaming import expiring as X
from ..streaming import stateful as S
from .registry import register
from .replay_queries import CAP, FLUSH
from .views import VIEWS, oracle, spark_text


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).parquet(f"{sf_dir}/events.parquet*")


def _folder(spark: SparkSession, name: str) -> str:
    return shared_path(spark, name)


def _view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.sql(spark_text(VIEWS[name]).replace("FROM events", "FROM {events}"), events=_events(spark, sf_dir))


@register("stream_membership", oracle("WITH r AS (SELECT id, max(struct_pack(i := incarnation, l := last_seen, r := CASE state WHEN 'Alive' THEN 0 WHEN 'Suspect' THEN 1 ELSE 2 END, s := state)) AS w FROM v_gossip WHERE cluster_hash = 'h1' AND id <> 'n0' GROUP BY id) SELECT id, w.i AS incarnation, w.l AS last_seen, w.s AS state FROM r"))
def stream_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last change of every member."""
    out = S.drain(S.membership(_view(spark, sf_dir, "v_gossip"), "h1", "n0"), _folder(spark, "members"), "update")
    rank = F.when(F.col("state") == "Alive", 0).when(F.col("state") == "Suspect", 1).otherwise(2)
    top = out.groupBy("id").agg(F.max(F.struct("incarnation", "last_seen", rank.alias("r"), "state")).alias("w"))
    return top.select("id", "w.incarnation", "w.last_seen", "w.state")


SWEEP_MS = "CAST(floor(epoch(max(ts)) * 1000) AS BIGINT)"


@register("stream_sweep", oracle(f"WITH r AS (SELECT id, max(struct_pack(i := incarnation, l := last_seen, r := CASE state WHEN 'Alive' THEN 0 WHEN 'Suspect' THEN 1 ELSE 2 END, s := state)) AS w FROM v_gossip WHERE cluster_hash = 'h1' AND id <> 'n0' GROUP BY id), c AS (SELECT {SWEEP_MS} AS now FROM events) SELECT id, w.i AS incarnation, w.l AS last_seen, CASE WHEN now > w.l * 1000 + 7200000 THEN 'Dead' WHEN now > w.l * 1000 + 3600000 THEN 'Suspect' ELSE w.s END AS state FROM r, c"))
def stream_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last state of every member after gossip and timers (here an hour and two, for events are minutes apart)."""
    g = spark.sql(spark_text(VIEWS["v_gossip"]).replace(" FROM events", ", ts FROM {events}"), events=_events(spark, sf_dir)).withColumn("ts", F.expr("to_timestamp(cast(ts AS string))"))
    out = S.drain(S.swept_membership(g, "h1", "n0", 3600, 7200), _folder(spark, "sweep"))
    last = out.groupBy("id").agg(F.max_by(F.struct("incarnation", "last_seen", "state"), "n").alias("w"))
    return last.select("id", "w.incarnation", "w.last_seen", "w.state")


@register("stream_lru", oracle(f"WITH {FLUSH} SELECT node, count(*) FILTER (WHERE hit) AS hits, count(*) FILTER (WHERE NOT hit) AS misses FROM lr GROUP BY node"))
def stream_lru(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = S.drain(S.lru(_view(spark, sf_dir, "v_access").select("node", "seq", "key", "size"), CAP), _folder(spark, "lru"))
    return out.groupBy("node").agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"))


@register("stream_counter_delta", oracle("SELECT host, metric, CAST(sum(greatest(0, v - p)) AS BIGINT) AS increase FROM (SELECT 'node' || CAST(user_id % 6 AS STRING) AS host, event_type AS metric, event_id AS e, event_id * (event_id % 7) AS v, lag(event_id * (event_id % 7)) OVER (PARTITION BY user_id % 6, event_type ORDER BY event_id) AS p FROM events) WHERE p IS NOT NULL GROUP BY host, metric"))
def stream_counter_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    s = _events(spark, sf_dir).select(F.concat(F.lit("node"), (F.col("user_id") % 6).cast("string")).alias("host"), F.col("event_type").alias("metric"), e.alias("epoch_ms"), (e * (e % 7)).alias("value"))
    return S.drain(S.counter_deltas(s), _folder(spark, "deltas")).groupBy("host", "metric").agg(F.sum("delta").cast("bigint").alias("increase"))


@register("stream_windowed_increase", oracle("WITH w AS (SELECT 'node' || CAST(user_id % 6 AS STRING) AS host, EPOCH(ts) // 3600 AS h, CAST(round(value * 100) AS BIGINT) AS c FROM events) SELECT host, CAST(h AS BIGINT) AS h, count(*) AS n, CAST(sum(c) AS BIGINT) AS cents FROM w WHERE (h + 1) * 3600 <= (SELECT max(EPOCH(ts)) FROM events) - 600 GROUP BY host, h"))
def stream_windowed_increase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours closed by the watermark, ten minutes behind the latest event."""
    s = _events(spark, sf_dir).select(F.concat(F.lit("node"), (F.col("user_id") % 6).cast("string")).alias("host"), F.timestamp_seconds(F.expr("timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', ts)")).alias("ts"), F.round(F.col("value") * 100).cast("bigint").alias("cents"))
    out = S.drain(S.windowed_increase(s, "1 hour"), _folder(spark, "windows"))
    return out.select("host", F.floor(F.unix_seconds("start") / 3600).cast("bigint").alias("h"), "n", "cents")


LOADS = "SELECT 'f' || CAST(user_id % 50 AS STRING) AS folder, EPOCH(ts) AS t_s, event_id AS req FROM events"
TTL, KEEP, LATE, GRAIN = 1800, 7200, 3600, 600


@register("stream_listing_ttl", oracle(f"""WITH l AS (SELECT folder, list(t_s ORDER BY t_s, req) AS xs FROM ({LOADS}) GROUP BY folder),
  z AS (SELECT folder, len(xs) AS lookups, list_reduce(list_transform(xs, lambda x: [x]), lambda acc, x: CASE WHEN x[1] - acc[len(acc)] >= {TTL} THEN list_append(acc, x[1]) ELSE acc END) AS ys FROM l),
  c AS (SELECT max(t_s) - {LATE} AS now FROM ({LOADS}))
  SELECT folder, CAST(lookups - len(ys) AS BIGINT) AS fresh, CAST(len(ys) AS BIGINT) AS listed, ys[len(ys)] AS loaded, ys[len(ys)] + {TTL} < now AS expired FROM z, c"""))
def stream_listing_ttl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each folder's listing was still fresh, and whether its state has expired at the end."""
    l = spark.sql(spark_text(LOADS).replace("FROM events", "FROM {events}"), events=_events(spark, sf_dir))
    out = S.drain(X.listings(l, TTL, f"{LATE} seconds"), _folder(spark, "listings"))
    g = out.groupBy("folder").agg(F.count_if(F.col("action") == "fresh").alias("fresh"), F.count_if(F.col("action").isin("list", "relist")).alias("listed"), F.max(F.when(F.col("action").isin("list", "relist"), F.col("t_s"))).alias("loaded"), F.max(F.when(F.col("action") == "expired", F.col("t_s"))).alias("gone"))
    return g.select("folder", "fresh", "listed", "loaded", F.coalesce(F.col("gone") == F.col("loaded") + TTL, F.lit(False)).alias("expired"))


ENDED = "SELECT 'u' || CAST(user_id % 4 AS STRING) AS owner, event_id % 200 AS job, EPOCH(ts) AS t_s FROM events"


@register("stream_jobs_ttl", oracle(f"WITH j AS (SELECT owner, job, max(t_s) AS ended FROM ({ENDED}) GROUP BY owner, job) SELECT owner, count(*) AS jobs, count(*) FILTER (WHERE (ended + {KEEP} + {GRAIN} - 1) // {GRAIN} * {GRAIN} >= (SELECT max(t_s) - {LATE} FROM ({ENDED}))) AS held FROM j GROUP BY owner"))
def stream_jobs_ttl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of each owner's jobs are still remembered at the end: those that ended within two hours, forgotten every ten minutes."""
    e = spark.sql(spark_text(ENDED).replace("FROM events", "FROM {events}"), events=_events(spark, sf_dir))
    out = S.drain(X.jobs(e, KEEP, f"{LATE} seconds", GRAIN), _folder(spark, "jobs"))
    at = lambda forgotten: F.max(F.when((F.col("action") == "forgotten") == forgotten, F.col("t_s")))
    j = out.groupBy("owner", "job").agg(at(False).alias("ended"), at(True).alias("gone"))
    return j.groupBy("owner").agg(F.count(F.lit(1)).alias("jobs"), F.count_if(F.coalesce(F.col("gone") < F.col("ended") + KEEP, F.lit(True))).alias("held"))
