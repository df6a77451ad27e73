"""Sources and sinks: text, JSON, XML, configuration, wire formats."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..session import shared_path
from ..sources import docs as S
from ..sources import exposition as E
from ..sources import text as X
from .common import query

PROM = "pp AS (SELECT snap, line_no, split_part(line, ' ', 1) AS key, TRY_CAST(list_last(string_split(line, ' ')) AS DOUBLE) AS v FROM v_prom WHERE line <> '' AND NOT starts_with(line, '#')), pk AS (SELECT snap, key, arg_max(v, line_no) AS value FROM pp WHERE v IS NOT NULL GROUP BY snap, key)"


def parsed(V):
    return X.parse_exposition(V("v_prom"), ["snap"])


@query("src_prom_text", f"WITH {PROM} SELECT snap, key, value FROM pk")
def _(V):
    return parsed(V)


@query("src_prom_files", f"WITH {PROM}, n AS (SELECT snap, line_no, split_part(key, '{{', 1) AS name, v FROM pp WHERE v IS NOT NULL) SELECT snap, name, count(*) AS samples, round(sum(v), 6) AS total, arg_max(v, line_no) AS last FROM n WHERE name IN ('view_total', 'click_total') GROUP BY ALL")
def _(V):
    """A file of lines for each snapshot, written as text and read as samples, of two metrics only; the last is the one that begins last in its file."""
    lines = V("v_prom")
    path = shared_path(lines.sparkSession, "scrapes")
    # A file's name is its snapshot's: one range of lines each, in order.
    lines.repartition(F.col("snap")).sortWithinPartitions("snap", "line_no").select("snap", F.col("line").alias("value")).write.partitionBy("snap").text(path)
    E.register(lines.sparkSession)
    read = lines.sparkSession.read.format("exposition").load(path).filter(F.col("name").isin("view_total", "click_total"))
    snap = F.regexp_extract("file", "snap=(\\d+)/", 1).cast("bigint")
    return read.groupBy(snap.alias("snap"), "name").agg(F.count(F.lit(1)).alias("samples"), F.round(F.sum("value"), 6).alias("total"), F.max_by("value", F.struct("file", "at")).alias("last"))


@query("src_prom_pick", f"WITH {PROM}, w AS (SELECT DISTINCT snap, k AS key FROM v_prom, (SELECT unnest(['view_total{{node=\"n1\"}}', 'absent_total']) AS k) AS u) SELECT snap, key, coalesce(value, 0.0) AS value FROM w LEFT JOIN pk USING (snap, key)")
def _(V):
    w = V("v_prom").select("snap").distinct().select("snap", F.explode(F.array(F.lit('view_total{node="n1"}'), F.lit("absent_total"))).alias("key"))
    return X.pick_metric(parsed(V), w, ["snap"])


@query("src_prom_labels", f"WITH {PROM} SELECT split_part(key, '{{', 1) AS metric, regexp_extract(key, 'node=\"([^\"]*)\"', 1) AS node, round(sum(value), 6) AS total FROM pk GROUP BY ALL")
def _(V):
    p = parsed(V)
    return p.groupBy(X.metric_name(F.col("key")).alias("metric"), X.label(F.col("key"), "node").alias("node")).agg(F.round(F.sum("value"), 6).alias("total"))


@query("src_snapshot_tsv", "SELECT 'pod' || CAST(event_id % 7 AS STRING) AS pod, 'n' || CAST(user_id AS STRING) AS node, event_type AS metric, CAST(event_id AS DOUBLE) AS value FROM events WHERE event_id % 19 <> 0 AND event_id % 23 <> 0")
def _(V):
    """Lines by tabs; every 19th is a comment, every 23rd lacks its value."""
    e = V("events")
    line = F.concat_ws("\t", F.concat(F.lit("pod"), (F.col("event_id") % 7).cast("string")), F.concat(F.lit("n"), F.col("user_id").cast("string")), F.concat(F.col("event_type"), F.lit(" "), F.when(F.col("event_id") % 23 == 0, "?").otherwise(F.col("event_id").cast("string"))))
    return X.parse_snapshot_tsv(e.select(F.when(F.col("event_id") % 19 == 0, F.concat(F.lit("# "), line)).otherwise(line).alias("line")))


def sampler_lines(V):
    e = F.col("event_id")
    return V("events").select(e.alias("line_no"), F.concat_ws(",", (e * 10).cast("string"), F.concat(F.lit("h"), (e % 5).cast("string")), F.when(e % 6 == 0, "").otherwise(F.concat((e * 3).cast("string"), F.lit(".7"))), F.when(e % 17 == 0, "bad").otherwise((e * 2).cast("string")), e.cast("string"), F.lit("0")).alias("line"))


SAMP = "sm AS (SELECT event_id AS line_no, event_id * 10 AS epoch_ms, 'h' || CAST(event_id % 5 AS STRING) AS host, CASE WHEN event_id % 6 = 0 THEN 0 ELSE event_id * 3 END AS fuse, event_id * 2 AS peer, event_id AS blob FROM events WHERE event_id % 17 <> 0)"


@query("src_sampler_csv", f"WITH {SAMP} SELECT epoch_ms, host, fuse, peer, blob FROM sm")
def _(V):
    return X.parse_sampler(sampler_lines(V))


@query("src_snapshot_csv", f"WITH {SAMP} SELECT host, max(fuse) FILTER (WHERE line_no = m) AS fuse, max(peer) FILTER (WHERE line_no = m) AS peer, max(blob) FILTER (WHERE line_no = m) AS blob FROM (SELECT *, max(line_no) OVER (PARTITION BY host) AS m FROM sm) GROUP BY host")
def _(V):
    return X.last_by_host(X.parse_sampler(sampler_lines(V)), "epoch_ms")


@query("src_markers", "SELECT 'marker' AS kind, upper(event_type) AS key, CAST(event_id + 1700000000 AS STRING) AS value FROM events WHERE event_id % 3 = 0 UNION ALL SELECT 'setting', 'K_' || CAST(user_id AS STRING), event_type FROM events WHERE event_id % 3 = 1")
def _(V):
    e = F.col("event_id")
    line = F.when(e % 3 == 0, F.concat((e + 1700000000).cast("string"), F.lit(" "), F.upper("event_type"))).when(e % 3 == 1, F.concat(F.lit("K_"), F.col("user_id").cast("string"), F.lit("="), F.col("event_type"))).otherwise(F.lit("  noise"))
    return X.parse_markers(V("events").select(line.alias("line")))


def logs(V):
    """A training log by user: phases on rank 0's lines, other ranks' noise, and marks in order of event, with colours; two marks a step."""
    e = V("events").withColumn("n", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    g, n = F.floor(F.col("n") / 2), F.col("n")
    mark = F.format_string("\x1b[32m 0: Epoch 0: %d/500 [%02d:%02d<10:00, %d.5s/it, loss=0.%03d, global_grad_norm=1.5, global_step=%d]\x1b[0m", n, F.floor(n * 7 / 60), n * 7 % 60, n % 9, n % 1000, g)
    body = e.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", mark.alias("m")))), lambda x: x["m"]), "\n").alias("b"))
    u = F.col("user_id")
    head = F.format_string("1: [2024-01-01 00:00:00] Loading checkpoint from /c\n 0: [2024-01-01 00:%02d:00] Loading checkpoint from /c\n0: [2024-01-01 00:%02d:10] hunyuan_vae\n", u % 7, u % 7)
    begin = F.when(u % 5 == 0, "").otherwise(F.format_string("0: [2024-01-01 00:%02d:%02d] Beginning epoch 0\n0: [2024-01-01 09:00:00] Beginning epoch 1\n", 10 + u % 3, u % 60))
    return body.select("user_id", F.concat(head, begin, F.col("b")).alias("text"))


MARKS = "ev AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events), mk AS (SELECT user_id, n, n // 2 AS step, n * 7 AS elapsed_s FROM ev)"


@query("src_train_log", f"WITH {MARKS} SELECT user_id, CAST(n - 1 AS INTEGER) AS pos, n AS step, CAST(500 AS BIGINT) AS total, CAST(elapsed_s AS BIGINT) AS elapsed_s, n % 9 + CAST(0.5 AS DOUBLE) AS s_it, CAST(n % 1000 AS DOUBLE) / 1000 AS loss, CAST(1.5 AS DOUBLE) AS grad_norm, CAST(step AS BIGINT) AS global_step FROM mk")
def _(V):
    return X.parse_steps(logs(V), ["user_id"])


@query("src_train_times", "SELECT user_id, ckpt_start, vae_start, steps_start, CAST(epoch(CAST(steps_start AS TIMESTAMP)) - epoch(CAST(ckpt_start AS TIMESTAMP)) AS BIGINT) AS ckpt_load_s FROM (SELECT DISTINCT user_id, format('2024-01-01 00:{:02d}:00', user_id % 7) AS ckpt_start, format('2024-01-01 00:{:02d}:10', user_id % 7) AS vae_start, CASE WHEN user_id % 5 <> 0 THEN format('2024-01-01 00:{:02d}:{:02d}', 10 + user_id % 3, user_id % 60) END AS steps_start FROM events)")
def _(V):
    return X.phase_times(logs(V), ["user_id"])


DUR = f"{MARKS}, ls AS (SELECT user_id, step, max(elapsed_s) AS e FROM mk GROUP BY user_id, step), du AS (SELECT user_id, CAST(step AS BIGINT) AS step, CAST(greatest(0, e - lag(e, 1, 0) OVER (PARTITION BY user_id ORDER BY step)) AS BIGINT) AS duration_s FROM ls)"


def durations(V):
    """Of a step's marks the one with the greatest time counts; its duration is what was added since the step before."""
    s = X.parse_steps(logs(V), ["user_id"]).filter("global_step IS NOT NULL").groupBy("user_id", F.col("global_step").alias("step")).agg(F.max("elapsed_s").alias("e"))
    w = Window.partitionBy("user_id").orderBy("step")
    return s.select("user_id", "step", F.greatest(F.lit(0), F.col("e") - F.lag("e", 1, 0).over(w)).cast("bigint").alias("duration_s"))


@query("win_step_duration", f"WITH {DUR} SELECT * FROM du")
def _(V):
    return durations(V)


@query("steady_steps", f"WITH {DUR} SELECT user_id, count(*) AS steps, round(avg(duration_s), 6) AS mean_s FROM du WHERE step >= 1 GROUP BY user_id")
def _(V):
    return durations(V).filter("step >= 1").groupBy("user_id").agg(F.count(F.lit(1)).alias("steps"), F.round(F.avg("duration_s"), 6).alias("mean_s"))


@query("src_pass_tsv", "SELECT c_custkey AS line_no, 'pod' || CAST(c_custkey AS STRING) AS pod, CASE WHEN c_custkey % 3 = 0 THEN 'node' || CAST(c_nationkey AS STRING) END AS node, c_custkey % 100 AS files, c_custkey * 4096 AS bytes, CAST(c_custkey % 90 AS DOUBLE) + 0.5 AS wall_s FROM customer WHERE c_custkey % 11 <> 5")
def _(V):
    """Three layouts, and every 11th line a message amid the data."""
    k = F.col("c_custkey")
    tail = F.format_string("files=%d%sbytes=%d%swall_s=%s", k % 100, F.when(k % 2 == 0, " ").otherwise("\t"), k * 4096, F.when(k % 2 == 0, " ").otherwise("\t"), (k % 90 + F.lit(0.5)).cast("string"))
    pod = F.concat(F.lit("pod"), k.cast("string"))
    line = F.when(k % 11 == 5, F.lit("E0428 error dialing backend: websocket closed")).when(k % 3 == 0, F.concat(pod, F.lit("\tnode"), F.col("c_nationkey").cast("string"), F.lit("\t"), tail)).when(k % 3 == 1, F.concat(pod, F.lit(" RESULT "), tail)).otherwise(F.concat(pod, F.lit(" "), tail))
    lines = V("customer").select(k.alias("line_no"), line.alias("line"))
    good, _ = X.parse_passes(lines)
    # "RESULT" may also stand where a node would
    return good.withColumn("node", F.when(F.col("node") != "RESULT", F.col("node")))


@query("src_pass_quarantine", "SELECT count(*) AS bad FROM customer WHERE c_custkey % 11 = 5")
def _(V):
    k = F.col("c_custkey")
    lines = V("customer").select(k.alias("line_no"), F.when(k % 11 == 5, F.lit("websocket error")).otherwise(F.concat(F.lit("pod files=1 bytes=2 wall_s=3"))).alias("line"))
    _, bad = X.parse_passes(lines)
    return bad.agg(F.count(F.lit(1)).alias("bad"))


def hydrate_docs(V):
    p = V("v_tasks").groupBy("peer").agg(F.count(F.lit(1)).alias("assigned"), F.count("got").alias("fetched"), F.coalesce(F.sum("got"), F.lit(0)).alias("bytes"), F.count("error").alias("e"))
    peer = F.struct(F.concat(F.lit("p"), F.col("peer").cast("string")).alias("node_id"), "assigned", "fetched", "bytes", F.expr("transform(sequence(1, cast(least(e, 2) as int)), i -> 'HTTP 403')").alias("errors"))
    return p.filter("e > 0").groupBy((F.col("peer") % 3).alias("run")).agg(F.to_json(F.struct(F.sum("assigned").alias("total_chunks"), F.sum("bytes").alias("total_bytes"), F.lit(1000).alias("elapsed_ms"), F.collect_list(peer).alias("peers"))).alias("doc"))


HY = "hy AS (SELECT peer, count(*) AS assigned, count(got) AS fetched, CAST(coalesce(sum(got), 0) AS BIGINT) AS bytes, count(error) AS e FROM v_tasks GROUP BY peer HAVING count(error) > 0)"


@query("src_hydrate_json", f"WITH {HY} SELECT peer % 3 AS run, 'p' || CAST(peer AS STRING) AS node_id, assigned, fetched, bytes, CAST(sum(assigned) OVER (PARTITION BY peer % 3) AS BIGINT) AS total_chunks, least(2, e) AS n_errors FROM hy")
def _(V):
    return S.parse_hydrate(hydrate_docs(V)).select("run", "node_id", "assigned", "fetched", "bytes", "total_chunks", F.size("errors").cast("bigint").alias("n_errors"))


@query("src_blob_list_xml", "SELECT n_regionkey AS page, 'blob' AS kind, n_name AS name, CASE WHEN n_nationkey % 4 = 0 THEN 0 ELSE n_nationkey * 100 END AS content_length FROM v_names UNION ALL SELECT DISTINCT n_regionkey, 'prefix', 'p' || CAST(n_regionkey AS STRING) || '/', 0 FROM v_names")
def _(V):
    """A page of the listing for each group, with a folder of its own."""
    one = F.format_string("<Blob><Name>%s</Name><Properties>%s</Properties></Blob>", "n_name", F.when(F.col("n_nationkey") % 4 == 0, "<Etag>x</Etag>").otherwise(F.format_string("<Content-Length>%d</Content-Length>", F.col("n_nationkey") * 100)))
    pages = V("v_names").groupBy(F.col("n_regionkey").alias("page")).agg(F.array_join(F.collect_list(one), "").alias("b"))
    xml = F.concat(F.lit("<EnumerationResults><Blobs>"), F.col("b"), F.format_string("<BlobPrefix><Name>p%d/</Name></BlobPrefix>", "page"), F.lit("</Blobs><NextMarker/></EnumerationResults>"))
    return S.parse_listing_xml(pages.select("page", xml.alias("xml"))).select("page", "kind", "name", "content_length")


@query("sink_prom_render", "SELECT metric, host, metric || '{node=\"' || host || '\"}' AS key, CAST(max(value) AS DOUBLE) AS value, (SELECT count(DISTINCT metric) FROM v_counters) AS types FROM v_counters GROUP BY metric, host")
def _(V):
    """Written as text files and read back by the parser."""
    c = V("v_counters").groupBy("metric", "host").agg(F.max("value").alias("value"))
    path = shared_path(c.sparkSession, "exposition")
    S.write_exposition(c, path)
    lines = X.read_lines(c.sparkSession, path)
    types = lines.filter(F.startswith("line", F.lit("# TYPE "))).agg(F.count(F.lit(1)).alias("types"))
    return X.parse_exposition(lines).select(X.metric_name(F.col("key")).alias("metric"), X.label(F.col("key"), "node").alias("host"), "key", "value").crossJoin(F.broadcast(types))


@query("sink_stats_json", "SELECT node_id, '{\"state\":\"' || state || '\",\"bloom_version\":' || CAST(bloom_version AS STRING) || '}' AS json FROM v_nodes")
def _(V):
    return S.stats_json(V("v_nodes").select("node_id", "state", "bloom_version"), "node_id")


def configs(V):
    k = F.col("n_nationkey").cast("bigint")
    m = F.struct(F.col("n_name").alias("name"), F.when(k % 5 == 0, "").otherwise("a").alias("account"), F.lit("c").alias("container"), F.lit("").alias("prefix"))
    return V("v_names").select(k.alias("cfg"), (k % 3 * 4096).alias("chunk_size"), F.when(k % 4 == 0, k * 1000).alias("block_size"), (k % 6).alias("pool"), F.lit(1).cast("bigint").alias("workers"), (k % 7).alias("main_threads"), F.when(k % 8 == 0, "ib").otherwise("tcp").alias("kind"), F.when(k % 9 == 0, F.array().cast("array<struct<name:string,account:string,container:string,prefix:string>>")).otherwise(F.array(m)).alias("mounts"))


@query("config_validate", """WITH c AS (SELECT k AS cfg, k % 3 * 4096 AS cs, CASE WHEN k % 4 = 0 THEN k * 1000 END AS bs, k FROM (SELECT CAST(n_nationkey AS BIGINT) AS k FROM v_names))
SELECT cfg, 'chunk_size' AS rule FROM c WHERE cs = 0 UNION ALL SELECT cfg, 'pool' FROM c WHERE k % 6 < 1 UNION ALL SELECT cfg, 'main_threads' FROM c WHERE k % 7 < 1
UNION ALL SELECT cfg, 'block_size' FROM c WHERE bs IS NOT NULL AND (bs < cs OR (cs > 0 AND bs % nullif(cs, 0) <> 0)) UNION ALL SELECT cfg, 'mounts' FROM c WHERE k % 9 = 0
UNION ALL SELECT cfg, 'mount_fields' FROM c WHERE k % 9 <> 0 AND k % 5 = 0 UNION ALL SELECT cfg, 'kind' FROM c WHERE k % 8 = 0""")
def _(V):
    return S.config_violations(configs(V), "cfg")


@query("src_toml_config", """SELECT n_nationkey AS cfg, n_nationkey % 16 <> 0 AS readable, CASE WHEN n_nationkey % 16 <> 0 THEN CASE WHEN n_nationkey % 3 = 0 THEN n_nationkey % 7 * 4096 ELSE 4194304 END END AS chunk_size, CASE WHEN n_nationkey % 16 <> 0 THEN CAST(CASE WHEN n_nationkey % 5 = 0 THEN 4 ELSE 16 END AS BIGINT) END AS prefetch_depth,
  CASE WHEN n_nationkey % 16 <> 0 THEN CASE WHEN n_nationkey % 2 = 0 THEN 'rdma' ELSE 'tcp' END END AS kind, CASE WHEN n_nationkey % 16 <> 0 THEN n_nationkey % 4 END AS mounts, CASE WHEN n_nationkey % 16 <> 0 AND n_nationkey % 4 > 0 THEN n_name END AS mount FROM v_names""")
def _(V):
    """A configuration for each name, written as TOML and read back with defaults where it says nothing; every 16th can't be read."""
    k = F.col("n_nationkey")
    part = lambda when, text: F.when(when, text).otherwise("")
    mount = F.format_string('[[mounts]]\nname = "%s"\naccount = "a"\ncontainer = "c"\n', "n_name")
    toml = F.concat(part(k % 3 == 0, F.format_string("[cache]\nchunk_size = %d\n", k % 7 * 4096)), F.lit("[transport]\n"), part(k % 5 == 0, F.lit("prefetch_depth = 4\n")), part(k % 2 == 0, F.lit('kind = "rdma"\n')), F.call_function("repeat", mount, (k % 4).cast("int")), part(k % 16 == 0, F.lit("= broken")))
    c = S.parse_configs(V("v_names").select(k.alias("cfg"), toml.alias("toml")))
    has = F.col("config").isNotNull()
    return c.select("cfg", has.alias("readable"), "config.chunk_size", "config.prefetch_depth", "config.kind", F.when(has, F.size("config.mounts")).cast("bigint").alias("mounts"), F.get("config.mounts", F.lit(0))["name"].alias("mount"))


@query("src_request_codec", "SELECT req_id, CASE WHEN req_id % 7 <> 0 THEN off END AS off, CASE WHEN req_id % 7 <> 0 THEN len END AS len, CASE WHEN req_id % 7 = 0 THEN 'trailing' END AS error FROM v_requests")
def _(V):
    """Requests as messages (built here from hex parts), read back; every 7th has a byte too many."""
    from ..functions.codec import MAGIC, decode_requests

    be = lambda c, n: F.lpad(F.hex(c), n, "0")
    text = lambda c: F.hex(F.encode(c, "UTF-8"))
    b = F.col("blob").cast("string")
    wire = F.concat(F.lit(f"{MAGIC:08X}"), F.lit("04"), text(F.lit("docs")), be(F.length(b), 4), text(b), be(F.col("off"), 16), be(F.col("len"), 8), F.lit("0002"), text(F.lit("n1")), F.lit("00000064000161"), F.when(F.col("req_id") % 7 == 0, "00").otherwise(""))
    r = decode_requests(V("v_requests").select("req_id", F.unhex(wire).alias("wire")))
    return r.select("req_id", "request.off", F.col("request.length").alias("len"), "request.error")


@query("src_response_codec", "SELECT req_id, CASE req_id % 4 WHEN 0 THEN 'ok' WHEN 1 THEN 'miss' WHEN 2 THEN 'error' END AS status, CASE WHEN req_id % 4 = 3 THEN 'unknown' WHEN req_id % 4 = 0 AND req_id % 5 = 0 THEN 'too_large' END AS error FROM v_requests")
def _(V):
    from ..functions.codec import response_fields

    k = F.col("req_id")
    wire = F.concat(F.lpad(F.hex(k % 4), 2, "0"), F.lit("000000"), F.lit("02000000AABB"))
    r = V("v_requests").select("req_id", response_fields(F.unhex(wire), F.when(k % 5 == 0, 1).otherwise(2)).alias("r"))
    return r.select("req_id", "r.status", "r.error")


@query("sink_cache_insert", "SELECT count(*) AS rows, CAST(sum(content_length) AS BIGINT) AS bytes FROM v_listing")
def _(V):
    """A committed write: rows go to a new folder, then are read back."""
    listing = V("v_listing")
    path = shared_path(listing.sparkSession, "insert")
    listing.write.parquet(path)
    return listing.sparkSession.read.parquet(path).agg(F.count(F.lit(1)).alias("rows"), F.sum("content_length").cast("bigint").alias("bytes"))
