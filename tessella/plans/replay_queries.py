"""Replays: LRU caches, sequential reads and prefetch, request sharing, routing."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import policy as P
from ..operators import replay as R
from .common import query
from .placement_queries import CH, DG, SCORE, SELF, alive, chunks, H

CAP = 120
# Identity: an access hits if the distinct keys since the key's last use, itself included, fit into the cap.
LRU = """ac AS (SELECT node, seq, key, size, lag(seq) OVER (PARTITION BY node, key ORDER BY seq) AS prev, lead(seq) OVER (PARTITION BY node, key ORDER BY seq) AS nxt FROM v_access {where}),
  lr AS (SELECT a.node, a.seq, a.key, a.size, a.prev IS NOT NULL AND coalesce((SELECT sum(b.size) FROM ac b WHERE b.node = a.node AND b.seq >= a.prev AND b.seq < a.seq AND (b.nxt IS NULL OR b.nxt >= a.seq)), 0) <= {cap} AS hit FROM ac a)"""
FLUSH = LRU.format(where="", cap=CAP)


@query("state_lru", f"WITH {FLUSH} SELECT node, seq, key, size, hit FROM lr")
def _(V):
    return R.replay_lru(V("v_access"), CAP)


HELD = f"ky AS (SELECT node, key, max(seq) AS last, max(size) AS size FROM v_access GROUP BY node, key), hd AS (SELECT * FROM (SELECT *, sum(size) OVER (PARTITION BY node ORDER BY last DESC) AS s FROM ky) WHERE s <= {CAP})"


@query("win_lru_order", f"WITH {HELD} SELECT node, key, row_number() OVER (PARTITION BY node ORDER BY last) AS evict_order FROM hd")
def _(V):
    """Order of eviction of what the caches hold: the least recently used first."""
    return R.lru_content(V("v_access"), CAP).select("node", "key", "evict_order")


@query("state_clear", f"WITH {HELD} SELECT node, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes, CAST(sum(key * 8 + size) AS BIGINT) AS digest FROM hd GROUP BY node")
def _(V):
    """What clearing each node's cache drops: what it holds at the end of the trace."""
    return R.lru_content(V("v_access"), CAP).groupBy("node").agg(F.count(F.lit(1)).alias("files"), F.sum("size").cast("bigint").alias("bytes"), F.sum(F.col("key") * 8 + F.col("size")).cast("bigint").alias("digest"))


@query("state_bloom_version", f"WITH {FLUSH}, rb AS (SELECT node, seq FROM v_access WHERE event_type = 'error' AND seq % 10 = 0), bo AS (SELECT node, seq, 1 AS i FROM lr WHERE NOT hit UNION ALL SELECT node, seq, 0 FROM rb), la AS (SELECT node, max(seq) AS last FROM rb GROUP BY node) SELECT node, count(*) AS version, CAST(sum(i) AS BIGINT) AS inserts, count(*) FILTER (WHERE i = 0) AS rebuilds, count(*) FILTER (WHERE i = 1 AND seq >= coalesce(last, -1)) AS pending FROM bo LEFT JOIN la USING (node) GROUP BY node")
def _(V):
    """Versions of the filters: each miss inserts a key, and some errors (here every tenth place) have the filter rebuilt."""
    a = V("v_access")
    return R.bloom_versions(R.replay_lru(a, CAP), a.filter("event_type = 'error' AND seq % 10 = 0").select("node", "seq"))


@query("state_hit_miss", f"WITH {FLUSH} SELECT node, count(*) FILTER (WHERE hit) AS hits, count(*) FILTER (WHERE NOT hit) AS misses, CAST(sum(CASE WHEN hit THEN 0 ELSE size END) AS BIGINT) AS bytes_inserted FROM lr GROUP BY node")
def _(V):
    return R.hit_miss(R.replay_lru(V("v_access"), CAP))


SMALL = LRU.format(where="WHERE size <= 5", cap=5)


@query("state_peer_lru", f"WITH {SMALL} SELECT node, seq, key, size, hit FROM lr UNION ALL SELECT node, seq, key, size, false FROM v_access WHERE size > 5")
def _(V):
    return R.replay_lru(V("v_access"), 5, "reject")


JUMP = "jp AS (SELECT *, off - coalesce(lag(off + len) OVER w, 0) AS gap FROM v_reads WINDOW w AS (PARTITION BY blob ORDER BY seq)), rn AS (SELECT *, sum(CASE WHEN gap >= 0 AND gap <= 256 THEN 0 ELSE 1 END) OVER (PARTITION BY blob ORDER BY seq) AS run FROM jp), sq AS (SELECT *, row_number() OVER (PARTITION BY blob, run ORDER BY seq) AS consecutive FROM rn)"


@query("win_seq_detect", f"WITH {JUMP} SELECT blob, seq, CAST(consecutive AS INTEGER) AS consecutive FROM sq")
def _(V):
    return R.detect_sequential(V("v_reads"), 256).select("blob", "seq", F.col("consecutive").cast("int").alias("consecutive"))


@query("win_blob_streak", "WITH p AS (SELECT *, CASE WHEN flag = 'A' THEN 1 ELSE 0 END AS peer FROM v_reads), r AS (SELECT *, sum(peer) OVER (PARTITION BY blob ORDER BY seq) AS run FROM p) SELECT blob, seq, CAST(sum(1 - peer) OVER (PARTITION BY blob, run ORDER BY seq) AS BIGINT) AS streak FROM r")
def _(V):
    return R.blob_streak(V("v_reads")).select("blob", "seq", "streak")


PF = f"{JUMP}, pf AS (SELECT blob, seq, off // 256 * 256 + k * 256 AS next FROM sq, (SELECT unnest(range(1, 17)) AS k) AS u WHERE consecutive >= 3 AND off // 256 * 256 + k * 256 < 16384)"


@query("win_prefetch_emit", f"WITH {PF} SELECT blob, seq, CAST(next AS BIGINT) AS next FROM pf")
def _(V):
    return R.prefetch_plan(V("v_reads"), 256, file_size=16384).select("blob", "seq", F.col("next").cast("bigint").alias("next"))


@query("j_prefetch_skip", f"WITH {PF} SELECT blob, seq, CAST(next AS BIGINT) AS next, CASE WHEN next % 768 = 0 THEN 'cached' WHEN next % 1280 = 0 THEN 'in_flight_write' WHEN next % 1792 = 0 THEN 'in_flight_fetch' ELSE 'issued' END AS outcome FROM pf")
def _(V):
    c = R.prefetch_plan(V("v_reads"), 256, file_size=16384).select("blob", "seq", F.col("next").cast("bigint").alias("next"))
    of = lambda m: c.filter(F.col("next") % m == 0)
    return R.prefetch_skips(c, of(768), of(1280), of(1792))


@query("state_singleflight", "WITH RECURSIVE_FREE AS (SELECT 1), f AS (SELECT * FROM v_fetches), l AS (SELECT key, list(struct_pack(t := t0, i := id, e := t1) ORDER BY t0, id) AS xs FROM f GROUP BY key), z AS (SELECT key, list_reduce(list_transform(xs, lambda x: [struct_pack(i := x.i, lead := x.i, until := x.e, t := x.t)]), lambda acc, x: list_append(acc, CASE WHEN x[1].t >= acc[len(acc)].until THEN x[1] ELSE struct_pack(i := x[1].i, lead := acc[len(acc)].lead, until := acc[len(acc)].until, t := x[1].t) END)) AS ys FROM l), u AS (SELECT key, unnest(ys) AS y FROM z) SELECT y.i AS id, key, CASE WHEN y.i = y.lead THEN 'leader' ELSE 'follower' END AS role, y.lead AS leader FROM u".replace("WITH RECURSIVE_FREE AS (SELECT 1), ", "WITH "))
def _(V):
    return R.singleflight(V("v_fetches"))


FLAGS = {"writing": 23, "peer_lru": 11, "disk": 3, "shared": 7, "yes": 5, "maybe": 13}


@query("state_route", "SELECT req_id, blob, CASE " + " ".join(f"WHEN req_id % {m} = 0 THEN '{n}'" for n, m in FLAGS.items()) + " WHEN len > 200 AND blob % 2 = 0 THEN 'stampede' ELSE 'origin' END AS source FROM v_requests")
def _(V):
    r = V("v_requests").withColumns({n: F.col("req_id") % m == 0 for n, m in FLAGS.items()}).withColumns({"wait_ms": F.when(F.col("len") > 200, 100).otherwise(0), "has_peers": F.col("blob") % 2 == 0})
    return R.route(r).select("req_id", "blob", "source")


@query("state_stampede", f"WITH {DG}, al AS (SELECT node_id FROM v_nodes WHERE state = 'Alive' AND cluster_hash = 'h1'), sc AS (SELECT blob, off, node_id, {SCORE} AS score FROM dg, al), o AS (SELECT blob, off, arg_max(node_id, score) AS owner FROM sc GROUP BY ALL) SELECT blob, off AS offset, CASE WHEN owner = '{SELF}' THEN 'leader' WHEN off // 1024 % 5 * 100 <= 250 THEN 'follower' ELSE 'timed_out' END AS role FROM o")
def _(V):
    o = H.hrw_owner(chunks(V), alive(V), SELF).withColumns({"leader_ms": F.floor(F.col("offset") / 1024) % 5 * 100, "wait_ms": F.lit(250)})
    return R.stampede_roles(o, SELF).select("blob", "offset", "role")


@query("state_reconcile", f"WITH {CH} SELECT blob, count(*) AS kept FROM ch WHERE off % 3072 <> 0 GROUP BY blob")
def _(V):
    """Entries whose file is still there, after those whose file vanished were dropped."""
    c = chunks(V)
    gone = c.filter(F.col("offset") % 3072 == 0).select("blob", "offset")
    return c.join(gone, ["blob", "offset"], "left_anti").groupBy("blob").agg(F.count(F.lit(1)).alias("kept"))


@query("state_jobs_ttl", "SELECT id FROM v_fetches WHERE t1 + 3600 > 1704075000")
def _(V):
    """Finished jobs are kept for an hour."""
    return V("v_fetches").filter(F.col("t1") + 3600 > 1704075000).select("id")


@query("state_token", "SELECT id, t1 <= 1704075000 + 300 OR NOT ok AS refresh FROM v_fetches")
def _(V):
    """A token is renewed when it ends within 300 s, or after a refusal."""
    return V("v_fetches").select("id", ((F.col("t1") <= 1704075000 + 300) | ~F.col("ok")).alias("refresh"))


# Scalars


@query("retryable_status", "SELECT id, id % 700 AS status, id % 700 IN (429, 500, 502, 503, 504) AS retry FROM v_fetches")
def _(V):
    s = F.col("id") % 700
    return V("v_fetches").select("id", s.alias("status"), P.retryable(s).alias("retry"))


@query("f_backoff_ms", "SELECT id, CAST(least(30000, 500 * pow(2, least(greatest(id % 14 - 1, 0), 10))) AS BIGINT) AS base, CAST(least(30000, 500 * pow(2, least(greatest(id % 14 - 1, 0), 10))) AS BIGINT) * 0.75 AS low, CAST(least(30000, 500 * pow(2, least(greatest(id % 14 - 1, 0), 10))) AS BIGINT) * 1.25 AS high FROM v_fetches".replace("* 0.75 AS", "* CAST(0.75 AS DOUBLE) AS").replace("* 1.25 AS", "* CAST(1.25 AS DOUBLE) AS"))
def _(V):
    b = P.backoff_ms(F.col("id") % 14)
    return V("v_fetches").select("id", b.alias("base"), (b * F.lit(0.75)).alias("low"), (b * F.lit(1.25)).alias("high"))


@query("f_retry_delay", "SELECT id, CASE WHEN id % 3 = 0 THEN least(id % 90 * 1000, 60000) ELSE CAST(least(30000, 500 * pow(2, least(greatest(id % 14 - 1, 0), 10))) AS BIGINT) END AS ms FROM v_fetches")
def _(V):
    after = F.when(F.col("id") % 3 == 0, F.col("id") % 90)
    return V("v_fetches").select("id", P.retry_delay_ms(F.col("id") % 14, after).alias("ms"))


@query("f_real_path", "SELECT page_id, CASE WHEN p = '' THEN url ELSE p || '/' || url END AS path FROM (SELECT page_id, url, CASE page_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'a' ELSE 'a/b' END AS p FROM pages)")
def _(V):
    k = F.col("page_id") % 3
    return V("pages").select("page_id", P.real_path(F.when(k == 0, "").when(k == 1, "a/").otherwise("a/b//"), F.col("url")).alias("path"))


@query("f_host_of", "SELECT page_id, split_part(regexp_replace(url, '^http://', ''), ':', 1) AS host FROM pages")
def _(V):
    return V("pages").select("page_id", P.host_of(F.col("url")).alias("host"))


@query("f_sas_append", "SELECT page_id, CASE WHEN contains(url, '?') THEN url || '&sv=1&sig=x' ELSE url || '?sv=1&sig=x' END AS signed FROM pages")
def _(V):
    return V("pages").select("page_id", P.append_sas(F.col("url"), F.lit("?sv=1&sig=x")).alias("signed"))


@query("f_peer_url", "SELECT req_id, '/v1/chunk/docs?blob=' || CAST(blob AS STRING) || '&offset=' || CAST(off AS STRING) || '&len=' || CAST(len AS STRING) || '&wait_ms=100' AS url, off AS parsed_offset, len AS parsed_len FROM v_requests")
def _(V):
    """A chunk's address at a peer, and what is read back from it."""
    u = F.format_string("/v1/chunk/docs?blob=%d&offset=%d&len=%d&wait_ms=100", "blob", "off", "len")
    part = lambda k: F.parse_url(F.concat(F.lit("http://peer"), F.col("url")), F.lit("QUERY"), F.lit(k)).cast("bigint")
    return V("v_requests").select("req_id", u.alias("url")).select("req_id", "url", part("offset").alias("parsed_offset"), part("len").alias("parsed_len"))


@query("f_urlenc", "SELECT doc_id, coalesce(list_aggregate(list_transform(regexp_extract_all(hex(encode(t)), '..'), lambda p: CASE WHEN regexp_full_match(p, '3[0-9]|[46][1-9A-F]|[57][0-9A]') THEN decode(unhex(p)) ELSE '%' || p END), 'string_agg', ''), '') AS enc FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)")
def _(V):
    from ..functions.codec import percent_encode

    return V("documents").select("doc_id", percent_encode(F.coalesce("text", F.lit(""))).alias("enc"))


@query("f_elapsed_to_s", "SELECT n_name, n_nationkey % 1100 * 3 + CASE WHEN n_nationkey % 2 = 0 THEN 0 ELSE 3600 END + 60 AS s FROM (SELECT n_name, CAST(n_nationkey AS BIGINT) AS n_nationkey FROM v_names)")
def _(V):
    k, m = F.col("n_nationkey"), F.col("n_nationkey") % 1100 * 3 + 60
    t = F.when(k % 2 == 0, F.format_string("%02d:%02d", F.floor(m / 60), m % 60)).otherwise(F.format_string("1:%02d:%02d", F.floor(m / 60), m % 60))
    return V("v_names").select("n_name", P.elapsed_seconds(t).alias("s"))


@query("rid_valid", "SELECT page_id, regexp_full_match(trim(r), '[A-Za-z0-9-]{1,128}') AS ok FROM (SELECT page_id, CASE page_id % 4 WHEN 0 THEN ' req-' || page_id || ' ' WHEN 1 THEN '' WHEN 2 THEN repeat('a', 129) ELSE url END AS r FROM pages)")
def _(V):
    k = F.col("page_id")
    r = F.when(k % 4 == 0, F.concat(F.lit(" req-"), k.cast("string"), F.lit(" "))).when(k % 4 == 1, "").when(k % 4 == 2, F.repeat(F.lit("a"), 129)).otherwise(F.col("url"))
    return V("pages").select("page_id", P.request_id_ok(r).alias("ok"))


SECRET, ACCOUNT, DATE = "c2VjcmV0", "acct", "Mon, 01 Jan 2024 00:00:00 GMT"
HMAC = "unhex(sha256(unhex('{outer}') || unhex(sha256(unhex('{inner}') || encode({text})))))"


def signed_sql() -> str:
    from ..functions.codec import key_pads

    inner, outer = (p.hex() for p in key_pads(SECRET))
    text = f"'GET' || chr(10) || chr(10) || chr(10) || CASE WHEN content_length > 0 THEN CAST(content_length AS STRING) ELSE '' END || repeat(chr(10), 9) || 'x-ms-date:{DATE}' || chr(10) || '/{ACCOUNT}/c/' || blob"
    return f"SELECT blob, 'SharedKey {ACCOUNT}:' || base64({HMAC.format(outer=outer, inner=inner, text=text)}) AS \"authorization\" FROM v_listing"


@query("f_shared_key", signed_sql())
def _(V):
    """Signatures by a keyed hash: two rounds of SHA-256 with the key's pads as constants."""
    from ..functions.codec import authorization_of

    text = F.concat(F.lit("GET\n\n\n"), F.when(F.col("content_length") > 0, F.col("content_length").cast("string")).otherwise(""), F.lit("\n" * 9), F.lit(f"x-ms-date:{DATE}\n/{ACCOUNT}/c/"), F.col("blob"))
    return V("v_listing").select("blob", authorization_of(ACCOUNT, SECRET, text).alias("authorization"))
