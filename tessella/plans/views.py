"""The engine's relations as views over the driver's tables, in SQL that Spark and DuckDB both read.

OCTETS(x) stands for the byte length and EPOCH(x) for unix seconds, which the engines name differently.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.scan import running

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
CHUNK = 256

VIEWS = {
    # blob listing of one mount
    "v_listing": "SELECT 'docs' AS mount, coalesce(lang, 'xx') || '/' || coalesce(source, 'none') || '/' || CAST(doc_id AS STRING) AS blob, CAST(coalesce(OCTETS(text), 0) * (CASE WHEN doc_id % 97 = 0 THEN 0 ELSE 1 END) AS BIGINT) AS content_length FROM documents",
    # what a listing says of each blob, before and after: some are rewritten in place, some touched, some gone, some new
    "v_props": "SELECT coalesce(lang, 'xx') || '/' || coalesce(source, 'none') || '/' || CAST(doc_id AS STRING) AS name, CAST(coalesce(OCTETS(text), 0) AS BIGINT) AS size, md5(coalesce(text, '')) AS etag, CAST(1700000000 + doc_id % 1000 AS BIGINT) AS mtime, doc_id FROM documents",
    # names with a number, in groups of five
    "v_names": "SELECT c_name AS n_name, c_custkey AS n_nationkey, CAST(floor(c_custkey / 5) AS BIGINT) AS n_regionkey FROM customer",
    # cluster members
    "v_nodes": """SELECT n_name AS node_id, n_nationkey AS num, n_regionkey AS rack, CASE n_nationkey % 9 WHEN 4 THEN 'Suspect' WHEN 7 THEN 'Dead' ELSE 'Alive' END AS state,
        CASE WHEN n_nationkey % 11 = 10 THEN 'h2' ELSE 'h1' END AS cluster_hash, CAST(n_nationkey % 5 AS BIGINT) AS bloom_version FROM nation""",
    # access trace: a key's size is constant
    "v_access": "SELECT user_id % 8 AS node, event_id AS seq, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS key, 1 + CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) % 7 AS size, ts, user_id, event_type, value FROM events WHERE props IS NOT NULL",
    # gossip records
    "v_gossip": """SELECT event_id AS rec, 'n' || CAST(user_id % 60 AS STRING) AS id, event_id % 7 AS incarnation, EPOCH(ts) AS last_seen,
        CASE event_type WHEN 'error' THEN 'Dead' WHEN 'view' THEN 'Suspect' ELSE 'Alive' END AS state, CASE WHEN event_id % 13 = 0 THEN 'h2' ELSE 'h1' END AS cluster_hash FROM events""",
    # cumulative counters in hundredths, with a reset after every 6 samples
    "v_counters": """SELECT host, metric, epoch_ms, event_id AS line_no, CAST(sum(c) OVER (PARTITION BY host, metric, life ORDER BY epoch_ms, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS value
        FROM (SELECT 'node' || CAST(user_id AS STRING) AS host, event_type AS metric, EPOCH(ts) * 1000 + event_id % 1000 AS epoch_ms, event_id, CAST(round(value * 100) AS BIGINT) AS c,
          floor((row_number() OVER (PARTITION BY user_id, event_type ORDER BY EPOCH(ts) * 1000 + event_id % 1000, event_id) - 1) / 6) AS life FROM events) AS t""",
    # scrapes of named counters in hundredths, about five a minute and series, with a reset after every 40 samples
    "v_scrapes": """SELECT host, metric, epoch_ms, event_id AS line_no, CAST(sum(c) OVER (PARTITION BY host, metric, life ORDER BY epoch_ms, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS value
        FROM (SELECT host, metric, epoch_ms, event_id, c, floor((row_number() OVER (PARTITION BY host, metric ORDER BY epoch_ms, event_id) - 1) / 40) AS life
          FROM (SELECT 'node' || CAST(user_id % 6 AS STRING) AS host, event_id, CAST(round(value * 100) AS BIGINT) AS c,
            CAST(1704067200000 + floor(((EPOCH(ts) - 1704067200) * 1000 + event_id % 1000) / 2000) AS BIGINT) AS epoch_ms,
            CASE event_type WHEN 'view' THEN CASE event_id % 3 WHEN 0 THEN 'fuse_read_bytes' WHEN 1 THEN 'cache_hits' ELSE 'peer_ok' END
              WHEN 'click' THEN CASE event_id % 3 WHEN 0 THEN 'peer_chunk_bytes_served' WHEN 1 THEN 'cache_misses' ELSE 'peer_miss' END
              WHEN 'purchase' THEN CASE event_id % 3 WHEN 0 THEN 'blob_fetch_bytes' WHEN 1 THEN 'blob_fetches' ELSE 'blob_status_200' END
              WHEN 'error' THEN CASE event_id % 3 WHEN 0 THEN 'peer_err' WHEN 1 THEN 'giveups' ELSE 'blob_status_500' END
              ELSE CASE event_id % 3 WHEN 0 THEN 'retry_sleep_s' WHEN 1 THEN 'evictions' ELSE 'blob_status_404' END END AS metric FROM events) AS a) AS t""",
    # scrapes of gauges, which may fall; each host is silent for 400 s in every 2400
    "v_gauges": """SELECT host, metric, epoch_ms, event_id AS line_no, CASE WHEN metric = 'cache_bytes' THEN v ELSE 20 + event_id % 7 END AS value
        FROM (SELECT 'node' || CAST(user_id AS STRING) AS host, user_id, event_id, CASE WHEN event_id % 2 = 0 THEN 'cache_bytes' ELSE 'members_alive' END AS metric, CAST(round(value * 100) AS BIGINT) AS v,
          CAST(1704067200000 + floor(((EPOCH(ts) - 1704067200) * 1000 + event_id % 1000) / 2000) AS BIGINT) AS epoch_ms FROM events) AS t WHERE floor((epoch_ms - 1704067200000) / 400000) % 6 <> user_id % 6""",
    # scrapes of two latency histograms: cumulative counts by bound
    "v_buckets": """SELECT metric, host, le, epoch_ms, event_id AS line_no, CAST(sum(CASE WHEN value <= le THEN 1 ELSE 0 END) OVER (PARTITION BY metric, host, le ORDER BY epoch_ms, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS value
        FROM (SELECT 'node' || CAST(user_id % 6 AS STRING) AS host, event_id, event_type, value, CAST(1704067200000 + floor(((EPOCH(ts) - 1704067200) * 1000 + event_id % 1000) / 2000) AS BIGINT) AS epoch_ms FROM events) AS e
        CROSS JOIN (SELECT 'fuse_read_seconds' AS metric UNION ALL SELECT 'chunk_peer_fetch_seconds') AS m
        CROSS JOIN (SELECT CAST(5 AS DOUBLE) AS le UNION ALL SELECT 10 UNION ALL SELECT 20 UNION ALL SELECT 40 UNION ALL SELECT 80 UNION ALL SELECT 160 UNION ALL SELECT 1000000) AS b
        WHERE metric = 'fuse_read_seconds' OR event_type = 'click'""",
    # sampler rows: a node's cumulative counters side by side, in the file's order; bytes from peers partly fetched twice, a restart after every 25 rows
    "v_sampler": """SELECT host, epoch_ms, event_id AS line_no, CAST(sum(c) OVER w AS BIGINT) AS fuse, CAST(sum(CASE WHEN event_type = 'click' THEN c * 4 ELSE 0 END) OVER w AS BIGINT) AS peer,
          CAST(sum(CASE WHEN event_type = 'purchase' THEN c ELSE 0 END) OVER w AS BIGINT) AS blob, CAST(count(*) OVER w AS BIGINT) AS reads
        FROM (SELECT 'node' || CAST(user_id AS STRING) AS host, event_type, EPOCH(ts) * 1000 + event_id % 1000 AS epoch_ms, event_id, CAST(round(value * 100) AS BIGINT) AS c,
          floor((row_number() OVER (PARTITION BY user_id ORDER BY EPOCH(ts) * 1000 + event_id % 1000, event_id) - 1) / 25) AS life FROM events) AS t
        WINDOW w AS (PARTITION BY host, life ORDER BY epoch_ms, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    # latency histogram: cumulative bucket counts by node before and after
    "v_hist": """SELECT phase, node, le, CAST(sum(CASE WHEN value <= le AND (phase = 'post' OR event_id % 3 = 0) THEN 1 ELSE 0 END) AS BIGINT) AS cum
        FROM (SELECT event_id, user_id % 6 AS node, value FROM events) AS e CROSS JOIN (SELECT 'pre' AS phase UNION ALL SELECT 'post') AS p
        CROSS JOIN (SELECT CAST(5 AS DOUBLE) AS le UNION ALL SELECT 10 UNION ALL SELECT 20 UNION ALL SELECT 40 UNION ALL SELECT 80 UNION ALL SELECT 160 UNION ALL SELECT 1000000) AS b GROUP BY phase, node, le""",
    # counter snapshots before and after, by pod and metric
    "v_before": "SELECT 'pod' || CAST(o_custkey % 40 AS STRING) AS pod, o_orderpriority AS metric, CAST(sum(round(o_totalprice)) AS BIGINT) AS value FROM orders WHERE o_orderkey % 4 = 0 AND o_custkey % 40 < 33 GROUP BY 1, 2",
    "v_after": "SELECT 'pod' || CAST(o_custkey % 40 AS STRING) AS pod, o_orderpriority AS metric, CAST(sum(round(o_totalprice)) AS BIGINT) AS value FROM orders WHERE o_orderkey % 2 = 0 AND o_custkey % 40 > 3 GROUP BY 1, 2",
    # pass results: pod, node, bytes as text (some unreadable), wall seconds
    "v_pass": "SELECT 'pod' || CAST(c_custkey % 40 AS STRING) AS pod, 'node' || CAST(c_nationkey AS STRING) AS node, CASE WHEN c_custkey % 17 = 3 THEN 'n/a' ELSE CAST(c_custkey * 4096 AS STRING) END AS bytes_text, CAST(10 + c_custkey % 90 AS DOUBLE) AS wall_s, c_custkey % 5 AS n, CASE WHEN c_custkey % 31 = 0 THEN 1 ELSE 0 END AS rc FROM customer",
    # ranged reads
    "v_requests": "SELECT l_orderkey * 10 + l_linenumber AS req_id, 'docs' AS mount, l_suppkey AS blob, (l_partkey * 37) % 5000 AS off, CAST(l_quantity AS BIGINT) * 16 - 16 AS len, CAST(4000 + l_suppkey % 50 AS BIGINT) AS file_size FROM lineitem",
    # sequential reads in order by blob
    "v_reads": "SELECT l_suppkey AS blob, CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_returnflag) AS BIGINT) AS seq, CAST(floor((l_orderkey % 60) + l_linenumber) AS BIGINT) * 256 AS off, CAST(256 AS BIGINT) AS len, l_returnflag AS flag FROM lineitem",
    # fetches with start and end
    "v_fetches": "SELECT event_id AS id, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS key, EPOCH(ts) AS t0, EPOCH(ts) + 30 + CAST(floor(value) AS BIGINT) AS t1, event_type <> 'error' AS ok FROM events",
    # hydrate results by task and peer
    "v_tasks": """SELECT l_orderkey * 10 + l_linenumber AS task, l_suppkey % 25 AS peer, CASE WHEN l_linenumber % 2 = 0 THEN 'broadcast' ELSE 'shard' END AS phase, CAST(l_quantity AS BIGINT) * 1024 AS len,
        CASE WHEN l_returnflag = 'R' AND l_linenumber = 3 THEN NULL ELSE CAST(l_quantity AS BIGINT) * 1024 END AS got, CASE WHEN l_returnflag = 'R' AND l_linenumber = 3 AND l_partkey % 2 = 0 THEN 'HTTP 403' END AS error,
        CAST(l_orderkey % 100 AS BIGINT) AS t0, CAST(l_orderkey % 100 + l_quantity AS BIGINT) AS t1 FROM lineitem""",
    # exposition text
    "v_prom": """SELECT snap, line_no, line FROM (
        SELECT user_id % 5 AS snap, event_id AS line_no, CASE WHEN event_id % 29 = 0 THEN '# HELP ' || event_type WHEN event_id % 31 = 0 THEN '' WHEN event_id % 37 = 0 THEN event_type || '_total bad'
          ELSE event_type || '_total' || chr(123) || 'node="n' || CAST(event_id % 4 AS STRING) || '"' || chr(125) || ' ' || CAST(CAST(round(value * 100) AS BIGINT) AS STRING) END AS line FROM events) AS t""",
}


def refs(sql: str) -> list[str]:
    return [v for v in VIEWS if re.search(rf"\b{v}\b", sql)]


def spark_text(sql: str) -> str:
    sql = re.sub(r"OCTETS\(", "octet_length(", sql)
    return re.sub(r"EPOCH\((\w+)\)", r"timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', \1)", sql)


def duck_text(sql: str) -> str:
    sql = re.sub(r"OCTETS\(", "strlen(", sql)
    sql = re.sub(r"EPOCH\((\w+)\)", r"CAST(floor(epoch(\1)) AS BIGINT)", sql)
    return sql.replace("AS STRING", "AS VARCHAR")


#: A segment's length for counts of buckets, milliseconds.
BUCKETS_MS = 30_000
BOUNDS = (5.0, 10.0, 20.0, 40.0, 80.0, 160.0, 1000000.0)


def bucket_counts(events: DataFrame) -> DataFrame:
    """v_buckets with a scrape's counts side by side, as many as BOUNDS: metric, host, epoch_ms, line_no, counts. They are found in segments of each host's
    events, all bounds in one pass, where the view's SQL has a window over every whole series."""
    scrapes = re.search(r"FROM \((.*?)\) AS e\b", VIEWS["v_buckets"], re.DOTALL)[1]
    e = events.sparkSession.sql(spark_text(scrapes).replace("FROM events", "FROM {events}"), events=events)
    # A struct: a series' key may be null.
    e = e.select(F.struct("host").alias("series"), "epoch_ms", F.col("event_id").alias("line_no"), "event_type", "value")

    def metric(name: str, rows: DataFrame) -> DataFrame:
        sums = {f"n{i}": F.when(F.col("value") <= le, 1).otherwise(0) for i, le in enumerate(BOUNDS)}
        counts = running(rows, ["series"], ["epoch_ms", "line_no"], BUCKETS_MS, sums=sums)
        return counts.select(F.lit(name).alias("metric"), "series.host", "epoch_ms", "line_no", F.array(*sums).alias("counts"))

    return metric("fuse_read_seconds", e).unionByName(metric("chunk_peer_fetch_seconds", e.filter("event_type = 'click'")))


def buckets(events: DataFrame) -> DataFrame:
    """v_buckets, a row for each bound."""
    each = F.explode(F.arrays_zip(F.array(*[F.lit(le) for le in BOUNDS]).alias("le"), F.col("counts").alias("value"))).alias("b")
    return bucket_counts(events).select("metric", "host", "epoch_ms", "line_no", each).select("metric", "host", F.col("b.le"), "epoch_ms", "line_no", F.col("b.value"))


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view or a table as a DataFrame."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if made := {"v_buckets": buckets, "v_bucket_counts": bucket_counts}.get(name):
        return made(spark.read.parquet(f"{sf_dir}/events.parquet"))
    return plain_view(spark, sf_dir, name)


def plain_view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view by its SQL."""
    sql = spark_text(VIEWS[name])
    used = [t for t in TABLES if re.search(rf"\b{t}\b", sql)]
    for t in used:
        sql = re.sub(rf"\b{t}\b", "{" + t + "}", sql)
    return spark.sql(sql, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used})


def oracle(sql: str) -> str:
    """DuckDB SQL with the views that it names in front."""
    ctes = [f"{v} AS ({duck_text(VIEWS[v])})" for v in refs(sql)]
    sql = duck_text(sql.strip())
    if not ctes:
        return sql
    if sql[:5].upper() == "WITH ":
        return f"WITH {', '.join(ctes)}, {sql[5:]}"
    return f"WITH {', '.join(ctes)} {sql}"
