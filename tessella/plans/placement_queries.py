"""Digests, rendezvous placement, Bloom filters, membership and transfer plans."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import digest as D
from ..functions import policy as P
from ..operators import chunking as C
from ..operators import membership as M
from ..operators import placement as H
from ..operators import transfer as T
from .common import query

BIG = 1024  # chunk size that keeps chunks x nodes small
M_BITS = 1 << 16
SELF = "NATION_0"
CH = f"ch AS (SELECT mount, blob, o AS off, least({BIG}, content_length - o) AS len FROM (SELECT mount, blob, content_length, unnest(range(0, content_length, {BIG})) AS o FROM v_listing WHERE content_length > 0))"
LE8 = "unhex(regexp_replace(format('{:016x}', off), '(..)(..)(..)(..)(..)(..)(..)(..)', '\\8\\7\\6\\5\\4\\3\\2\\1'))"
DG = f"{CH}, dg AS (SELECT *, sha256(encode(mount) || '\\x00'::BLOB || encode(blob) || '\\x00'::BLOB || {LE8}) AS digest FROM ch)"
SWAP = "regexp_replace({0}, '(..)(..)(..)(..)(..)(..)(..)(..)', '\\8\\7\\6\\5\\4\\3\\2\\1')"
SCORE = SWAP.format("substr(sha256(encode(node_id) || unhex(digest)), 1, 16)")
ALIVE = f"al AS (SELECT node_id FROM v_nodes WHERE state = 'Alive' AND cluster_hash = 'h1')"
SC = f"{DG}, {ALIVE}, sc AS (SELECT mount, blob, off, digest, node_id, {SCORE} AS score FROM dg, al)"
HALF = lambda a, b: f"CAST(CAST('0x' || substr({SWAP.format(f'substr(digest, {a}, 16)')}, {b}, 8) AS UBIGINT) AS UHUGEINT)"
U = lambda a: f"({HALF(a, 1)} * 4294967296 + {HALF(a, 9)})"
BITS = f"bits AS (SELECT dg.*, CAST(((({U(1)} + {U(17)} * CAST(i AS UHUGEINT)) % 18446744073709551616) % {M_BITS}) AS BIGINT) AS bit, i FROM dg, (SELECT unnest(range(0, 4)) AS i) AS k)"


def chunks(V):
    return C.enumerate_chunks(V("v_listing"), BIG)


def alive(V):
    return V("v_nodes").filter("state = 'Alive' AND cluster_hash = 'h1'").select("node_id")


@query("f_chunk_digest", f"WITH {DG} SELECT blob, off AS offset, digest FROM dg")
def _(V):
    return H.with_digest(chunks(V)).select("blob", "offset", "digest")


@query("f_hrw_score", f"WITH {SC} SELECT blob, off AS offset, node_id, score FROM sc")
def _(V):
    return H.scored(chunks(V), alive(V)).select("blob", "offset", "node_id", "score")


@query("top_hrw_owner", f"WITH {SC} SELECT mount, blob, off AS offset, arg_max(node_id, score) AS owner FROM sc GROUP BY ALL")
def _(V):
    return H.hrw_owner(chunks(V), alive(V), SELF)


@query("win_hrw_rank", f"WITH {SC} SELECT mount, blob, off AS offset, node_id, score, CAST(row_number() OVER (PARTITION BY blob, off ORDER BY score DESC, node_id) AS INTEGER) AS rank FROM sc")
def _(V):
    return H.hrw_rank(chunks(V), alive(V))


@query("agg_hrw_distribution", f"WITH {SC}, o AS (SELECT blob, off, arg_max(node_id, score) AS owner FROM sc GROUP BY ALL) SELECT owner, count(*) AS keys FROM o GROUP BY owner")
def _(V):
    return H.hrw_owner(chunks(V), alive(V)).groupBy("owner").agg(F.count(F.lit(1)).alias("keys"))


@query("f_bloom_pos", f"WITH {DG}, {BITS} SELECT blob, off AS offset, CAST(i AS INTEGER) AS i, bit FROM bits")
def _(V):
    c = H.with_digest(chunks(V))
    return c.select("blob", "offset", F.posexplode(D.bloom_positions(F.col("digest"), M_BITS)).alias("i", "bit"))


def holders(V):
    return V("v_nodes").filter("num < 6").select("node_id", "num")


def inventory(V):
    """Which node holds which chunk: those that its number divides out of offset and id."""
    c = chunks(V).withColumn("k", (F.col("offset") / BIG + F.length("blob")).cast("bigint"))
    n = holders(V)
    return c.join(F.broadcast(n), F.col("k") % 6 == F.col("num")).select("node_id", "mount", "blob", "offset")


INV = f"inv AS (SELECT n.node_id, b.* FROM bits b JOIN (SELECT node_id, num FROM v_nodes WHERE num < 6) n ON CAST(b.off / {BIG} + length(b.blob) AS BIGINT) % 6 = n.num)"


@query("agg_bloom_build", f"WITH {DG}, {BITS}, {INV} SELECT DISTINCT node_id, bit FROM inv")
def _(V):
    return H.build_blooms(inventory(V), M_BITS)


PROBE = f"{DG}, {BITS}, {INV}, bl AS (SELECT DISTINCT node_id, bit FROM inv), need AS (SELECT blob, off, count(DISTINCT bit) AS need FROM bits GROUP BY ALL), hit AS (SELECT b.blob, b.off, bl.node_id, count(DISTINCT b.bit) AS got FROM bits b JOIN bl USING (bit) GROUP BY ALL), pos AS (SELECT blob, off, node_id FROM hit JOIN need USING (blob, off) WHERE got = need)"


@query("f_bloom_contains", f"WITH {PROBE} SELECT blob, off AS offset, node_id FROM pos")
def _(V):
    return H.probe_blooms(chunks(V), inventory(V), M_BITS, holders(V)).select("blob", "offset", "node_id")


@query("j_chunk_holder", f"WITH {PROBE} SELECT node_id, count(*) AS chunks FROM pos GROUP BY node_id")
def _(V):
    p = H.probe_blooms(chunks(V), inventory(V), M_BITS, holders(V))
    return p.groupBy("node_id").agg(F.count(F.lit(1)).alias("chunks"))


SMALL_BITS = 1 << 13
FULLER = PROBE.replace(f"% {M_BITS}", f"% {SMALL_BITS}")


@query("agg_fp_rate", f"WITH {FULLER}, h AS (SELECT DISTINCT node_id, blob, off FROM inv) SELECT count(*) AS probes_positive, count(*) FILTER (WHERE h.blob IS NULL) AS false_positive FROM pos LEFT JOIN h USING (node_id, blob, off)")
def _(V):
    inv = inventory(V)
    p = H.probe_blooms(chunks(V), inv, SMALL_BITS, holders(V))
    held = inv.select("node_id", "mount", "blob", "offset", F.lit(True).alias("held"))
    j = p.join(held, ["node_id", "mount", "blob", "offset"], "left")
    return j.agg(F.count(F.lit(1)).alias("probes_positive"), F.count_if(F.col("held").isNull()).alias("false_positive"))


@query("state_bloom_stale_drop", f"WITH {FULLER}, h AS (SELECT DISTINCT node_id, blob, off FROM inv) SELECT DISTINCT pos.node_id FROM pos LEFT JOIN h USING (node_id, blob, off) WHERE h.blob IS NULL")
def _(V):
    """Nodes whose filter promised a chunk that they don't hold: their filter is dropped."""
    inv = inventory(V)
    p = H.probe_blooms(chunks(V), inv, SMALL_BITS, holders(V))
    return p.join(inv, ["node_id", "mount", "blob", "offset"], "left_anti").select("node_id").distinct()


YES = f"{PROBE}, {ALIVE}, sc AS (SELECT blob, off, node_id, {SCORE} AS score FROM dg, al), c AS (SELECT sc.*, CASE WHEN pos.node_id IS NOT NULL THEN 'yes' WHEN sc.node_id NOT IN (SELECT node_id FROM bl) THEN 'maybe' END AS cls FROM sc LEFT JOIN pos USING (blob, off, node_id)), r AS (SELECT *, row_number() OVER (PARTITION BY blob, off, cls ORDER BY score DESC, node_id) AS r FROM c WHERE cls IS NOT NULL), k AS (SELECT * FROM r WHERE r <= CASE cls WHEN 'yes' THEN 2 ELSE 3 END)"


@query("top_yes_maybe", f"WITH {YES} SELECT 'docs' AS mount, blob, off AS offset, node_id, cls, CAST(row_number() OVER (PARTITION BY blob, off ORDER BY cls DESC, r) AS INTEGER) AS attempt FROM k")
def _(V):
    return H.rank_candidates(chunks(V), alive(V), inventory(V), M_BITS, 2, 3, holders(V))


@query("f_bloom_fp_theory", f"SELECT n_name, round(pow(1 - exp(-4.0 * (n_nationkey % 120 * 1000) / {M_BITS}.0), 4.0), 9) AS p FROM v_names")
def _(V):
    return V("v_names").select("n_name", F.round(D.bloom_fp_theory(F.col("n_nationkey") % 120 * 1000, M_BITS), 9).alias("p"))


@query("f_bloom_codec", "SELECT n_name, n_nationkey * 16 AS m_bits, CASE WHEN n_nationkey * 16 < 64 THEN 'too_small' WHEN (n_nationkey * 16 + 63) // 64 * 8 <> n_nationkey % 7 * 8 THEN 'wrong_size' ELSE 'ok' END AS verdict FROM v_names")
def _(V):
    """A filter on the wire: 8 bytes for the number of bits, then 64-bit words."""
    k = F.col("n_nationkey")
    n = V("v_names").select("n_name", (k * 16).alias("m_bits"), F.concat(D.le8((k * 16).cast("bigint")), F.unhex(F.expr("repeat('00', cast(n_nationkey % 7 as int) * 8)"))).alias("wire"))
    bits = F.conv(D.swap_hex(F.substring(F.hex("wire"), 1, 16)), 16, 10).cast("bigint")
    words = F.octet_length("wire") - 8
    verdict = F.when(F.octet_length("wire") < 8, "short").when(bits < 64, "too_small").when(F.floor((bits + 63) / 64) * 8 != words, "wrong_size").otherwise("ok")
    return n.select("n_name", "m_bits", verdict.alias("verdict"))


MOUNTS = "SELECT n_regionkey AS cfg, list(struct_pack(name := n_name, account := 'a' || n_nationkey, container := 'c', prefix := '') ORDER BY n_name) AS m FROM v_names GROUP BY 1"


@query("f_cluster_hash", f"SELECT CAST(cfg AS BIGINT) AS cfg, sha256(unhex('0000400000000000') || encode('tcp') || '\\x00'::BLOB || encode(list_reduce(list_transform(m, lambda x: x.name || chr(0) || x.account || chr(0) || x.container || chr(0) || x.prefix || chr(0)), lambda a, b: a || b))) AS hash FROM ({MOUNTS})")
def _(V):
    m = F.struct(F.col("n_name").alias("name"), F.concat(F.lit("a"), F.col("n_nationkey").cast("string")).alias("account"), F.lit("c").alias("container"), F.lit("").alias("prefix"))
    g = V("v_names").groupBy(F.col("n_regionkey").cast("bigint").alias("cfg")).agg(F.collect_list(m).alias("mounts"))
    return g.select("cfg", D.cluster_hash(F.lit(4194304).cast("bigint"), F.lit("tcp"), F.col("mounts")).alias("hash"))


@query("sort_mounts", "SELECT CAST(n_regionkey AS BIGINT) AS cfg, string_agg(n_name, ',' ORDER BY n_name) AS mounts FROM v_names GROUP BY 1")
def _(V):
    return V("v_names").groupBy(F.col("n_regionkey").cast("bigint").alias("cfg")).agg(F.array_join(F.array_sort(F.collect_list("n_name")), ",").alias("mounts"))


# Membership

RANK = "CASE state WHEN 'Alive' THEN 0 WHEN 'Suspect' THEN 1 ELSE 2 END"
MERGED = f"mg AS (SELECT id, max(struct_pack(i := incarnation, l := last_seen, r := {RANK}, s := state)) AS w, count(*) AS records FROM v_gossip WHERE cluster_hash = 'h1' AND id <> 'n0' GROUP BY id), mm AS (SELECT id, w.i AS incarnation, w.l AS last_seen, w.s AS state, records FROM mg)"
NOW = 1704153600


def merged(V):
    return M.merge_members(V("v_gossip"), "h1", "n0")


@query("state_swim_merge", f"WITH {MERGED} SELECT * FROM mm")
def _(V):
    return merged(V)


@query("set_member_union", "SELECT id, count(*) AS n FROM (SELECT id FROM v_gossip WHERE rec % 2 = 0 UNION ALL SELECT id FROM v_gossip WHERE rec % 2 = 1 AND state = 'Alive') GROUP BY id")
def _(V):
    g = V("v_gossip")
    both = g.filter("rec % 2 = 0").select("id").unionByName(g.filter("rec % 2 = 1 AND state = 'Alive'").select("id"))
    return both.groupBy("id").agg(F.count(F.lit(1)).alias("n"))


@query("f_state_rank", f"SELECT rec, {RANK} AS rank FROM v_gossip")
def _(V):
    return V("v_gossip").select("rec", P.state_rank(F.col("state")).alias("rank"))


SW = "CASE WHEN id = 'n3' THEN 'Alive' WHEN greatest(0, {now} - last_seen) > 60 THEN 'Dead' WHEN greatest(0, {now} - last_seen) > 30 THEN 'Suspect' ELSE 'Alive' END"


@query("state_sweep", f"WITH {MERGED}, s AS (SELECT *, {SW.format(now='(SELECT max(last_seen) + 20 FROM mm)')} AS new_state FROM mm) SELECT id, state, new_state, new_state = 'Dead' AND state <> 'Dead' AS failed FROM s")
def _(V):
    m = merged(V)
    now = (m.agg(F.max("last_seen")).first()[0] or 0) + 20
    return M.sweep(m, now, "n3").select("id", "state", "new_state", "failed")


@query("f_sweep_state", f"SELECT rec, {SW.format(now=1704067300)} AS new_state FROM v_gossip")
def _(V):
    return V("v_gossip").select("rec", P.sweep_state(F.col("last_seen"), F.lit(1704067300).cast("bigint"), F.col("id") == "n3").alias("new_state"))


@query("state_self_refute", "SELECT coalesce(greatest(max(incarnation) FILTER (WHERE incarnation > 3 OR (incarnation = 3 AND state <> 'Alive')), 3) + CASE WHEN count(*) FILTER (WHERE incarnation > 3 OR (incarnation = 3 AND state <> 'Alive')) > 0 THEN 1 ELSE 0 END, 3) AS incarnation, 'Alive' AS state FROM v_gossip WHERE id = 'n0'")
def _(V):
    return M.self_refute(V("v_gossip"), "n0", 3)


@query("state_touch", f"WITH {MERGED} SELECT id, incarnation, CASE WHEN id IN ('n1', 'n2', 'n5') THEN {NOW} ELSE last_seen END AS last_seen, CASE WHEN id IN ('n1', 'n2', 'n5') THEN 'Alive' ELSE state END AS state FROM mm")
def _(V):
    return M.touch(merged(V), V("v_gossip").filter(F.col("id").isin("n1", "n2", "n5")), NOW)


@query("agg_members_by_state", "SELECT count(*) FILTER (WHERE state = 'Alive') AS alive, count(*) FILTER (WHERE state = 'Suspect') AS suspect, count(*) FILTER (WHERE state = 'Dead') AS dead FROM v_nodes")
def _(V):
    return M.by_state(V("v_nodes")).drop("ready")


@query("agg_readyz", "SELECT count(*) FILTER (WHERE state = 'Alive') >= 1 AS ready FROM v_nodes")
def _(V):
    return M.by_state(V("v_nodes")).select("ready")


@query("alive_filter", f"SELECT node_id FROM v_nodes WHERE state = 'Alive' AND node_id <> '{SELF}' AND cluster_hash = 'h1'")
def _(V):
    return M.alive_peers(V("v_nodes"), SELF, "h1").select("node_id")


@query("state_foreign_drop", "SELECT count(*) FILTER (WHERE cluster_hash <> 'h1') AS dropped, count(*) AS records FROM v_gossip")
def _(V):
    return M.foreign_records(V("v_gossip"), "h1")


HAVE = "hv AS (SELECT node_id, CAST(num % 4 AS BIGINT) AS bloom_version FROM v_nodes WHERE num % 3 <> 0)"


def have(V):
    return V("v_nodes").filter("num % 3 <> 0").select("node_id", (F.col("num") % 4).cast("bigint").alias("bloom_version"))


@query("j_version_pull", f"WITH {HAVE} SELECT n.node_id, n.bloom_version, coalesce(h.bloom_version, 0) AS have FROM v_nodes n LEFT JOIN hv h USING (node_id) WHERE state = 'Alive' AND node_id <> '{SELF}' AND n.bloom_version <> 0 AND n.bloom_version > coalesce(h.bloom_version, 0)")
def _(V):
    return M.blooms_to_pull(V("v_nodes"), have(V), SELF)


@query("set_forget_peers", f"WITH {HAVE} SELECT node_id FROM hv WHERE node_id NOT IN (SELECT node_id FROM v_nodes WHERE state = 'Alive')")
def _(V):
    return have(V).join(V("v_nodes").filter("state = 'Alive'"), "node_id", "left_anti").select("node_id")


# Transfer plans

TG = f"tg AS (SELECT node_id, 0 AS grp FROM v_nodes WHERE node_id = '{SELF}' UNION ALL SELECT node_id, 1 FROM v_nodes WHERE state = 'Alive' AND node_id <> '{SELF}' AND cluster_hash = 'h1'), tn AS (SELECT node_id, row_number() OVER (ORDER BY grp, node_id) - 1 AS t, count(*) OVER () AS n FROM tg)"


def targets(V):
    return M.hydrate_targets(V("v_nodes"), SELF, "h1")


@query("hydrate_target_filter", f"WITH {TG} SELECT node_id, grp FROM tg")
def _(V):
    return targets(V)


@query("set_targets", f"WITH {TG} SELECT DISTINCT node_id FROM tg")
def _(V):
    return targets(V).select("node_id").distinct()


SHARD = f"{CH}, {TG}, ix AS (SELECT *, row_number() OVER (ORDER BY mount, blob, off) - 1 AS i FROM ch)"


@query("win_round_robin", f"WITH {SHARD} SELECT node_id, i, mount, blob, off AS offset, CAST(len AS BIGINT) AS len FROM ix JOIN tn ON i % n = t")
def _(V):
    return T.shard_plan(chunks(V), targets(V))


@query("state_hydrate_shard", f"WITH {SHARD} SELECT node_id, count(*) AS assigned, CAST(sum(len) AS BIGINT) AS bytes FROM ix JOIN tn ON i % n = t GROUP BY node_id")
def _(V):
    return T.shard_plan(chunks(V), targets(V)).groupBy("node_id").agg(F.count(F.lit(1)).alias("assigned"), F.sum("len").cast("bigint").alias("bytes"))


@query("j_broadcast_plan", f"WITH {TG} SELECT a.node_id AS receiver, b.node_id AS source FROM tg a JOIN tg b ON a.node_id <> b.node_id")
def _(V):
    return T.broadcast_plan(targets(V))


RING = f"{TG}, rk AS (SELECT node_id, row_number() OVER (ORDER BY node_id) - 1 AS r, count(*) OVER () AS n FROM tg), st AS (SELECT *, unnest(range(1, n)) AS step FROM rk)"


@query("j_ring_plan", f"WITH {RING} SELECT st.step, st.node_id AS receiver, p.node_id AS prev, s.node_id AS source FROM st JOIN rk p ON p.r = (st.r + st.n - 1) % st.n JOIN rk s ON s.r = (st.r + st.n - st.step) % st.n")
def _(V):
    return T.ring_plan(targets(V))


@query("win_ring_rank", f"WITH {RING} SELECT node_id, CAST(r AS INTEGER) AS r FROM rk")
def _(V):
    return targets(V).select("node_id", (F.row_number().over(Window.orderBy("node_id")) - 1).alias("r"))


RING_RUN = f"""{SHARD}, {RING.removeprefix(TG + ', ')}, sh AS (SELECT node_id, count(*) AS chunks, CAST(sum(len) AS BIGINT) AS bytes FROM ix JOIN tn ON i % n = t GROUP BY node_id),
  sp AS (SELECT st.step, st.node_id AS receiver, s.node_id AS source FROM st JOIN rk s ON s.r = (st.r + st.n - st.step) % st.n),
  mv AS (SELECT step, receiver, source, coalesce(chunks, 0) AS chunks, coalesce(bytes, 0) AS bytes, v.num % 7 <> 3 AS known FROM sp LEFT JOIN sh ON sh.node_id = source JOIN v_nodes v ON v.node_id = receiver),
  sm AS (SELECT step, count(*) AS receivers, count(*) FILTER (WHERE NOT known) AS unknown, CAST(sum(CASE WHEN known THEN chunks ELSE 0 END) AS BIGINT) AS chunks, CAST(sum(CASE WHEN known THEN bytes ELSE 0 END) AS BIGINT) AS bytes,
    max(CASE WHEN known THEN (bytes + 999) // 1000 ELSE 0 END) AS ms FROM mv GROUP BY step)"""


@query("state_hydrate_ring", f"WITH {RING_RUN} SELECT step, receivers, unknown, chunks, bytes, CAST(sum(ms) OVER (ORDER BY step) - ms AS BIGINT) AS starts_ms, CAST(sum(ms) OVER (ORDER BY step) AS BIGINT) AS ends_ms FROM sm")
def _(V):
    """The ring run step by step over links of 1000 bytes a millisecond; receivers that send no report (here every seventh) are unknown."""
    shards = T.shard_plan(chunks(V), targets(V)).groupBy("node_id").agg(F.count(F.lit(1)).alias("chunks"), F.sum("len").cast("bigint").alias("bytes"))
    return T.ring_run(T.ring_plan(targets(V)), shards, V("v_nodes").filter("num % 7 <> 3").select("node_id"), 1000)


@query("state_hydrate_broadcast", f"WITH {SHARD}, w AS (SELECT node_id, count(*) AS c FROM ix JOIN tn ON i % n = t GROUP BY node_id) SELECT a.node_id AS receiver, CAST(sum(w.c) AS BIGINT) AS chunks, max(greatest(1, 64 // (SELECT count(*) - 1 FROM tg))) AS permits FROM tg a JOIN w ON w.node_id <> a.node_id GROUP BY 1")
def _(V):
    """What each receiver fetches in phase B, and its permits per source (64 in all)."""
    per = T.shard_plan(chunks(V), targets(V)).groupBy(F.col("node_id").alias("source")).agg(F.count(F.lit(1)).alias("c"))
    n = targets(V).count() - 1
    return T.broadcast_plan(targets(V)).join(per, "source").groupBy("receiver").agg(F.sum("c").cast("bigint").alias("chunks"), F.lit(max(1, 64 // max(1, n))).cast("bigint").alias("permits"))


@query("win_rr_interleave", "WITH c AS (SELECT l_suppkey % 5 AS receiver, l_suppkey % 7 AS source, l_orderkey * 10 + l_linenumber AS chunk FROM lineitem), d AS (SELECT DISTINCT * FROM c), r AS (SELECT *, row_number() OVER (PARTITION BY receiver, source ORDER BY chunk) AS turn FROM d) SELECT receiver, source, chunk, row_number() OVER (PARTITION BY receiver ORDER BY turn, source) AS place FROM r")
def _(V):
    c = V("lineitem").select((F.col("l_suppkey") % 5).alias("receiver"), (F.col("l_suppkey") % 7).alias("source"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("chunk")).distinct()
    return T.interleave(c).select("receiver", "source", "chunk", "place")


REPORT = "rp AS (SELECT peer, count(*) AS assigned, count(got) AS fetched, CAST(coalesce(sum(got), 0) AS BIGINT) AS bytes, least(32, count(error)) AS n_errors FROM v_tasks GROUP BY peer)"


@query("agg_shard_report", f"WITH {REPORT} SELECT * FROM rp")
def _(V):
    return T.shard_report(V("v_tasks")).withColumn("n_errors", F.size("errors").cast("bigint")).drop("errors")


@query("limit_errors", "WITH e AS (SELECT peer, task, error, row_number() OVER (PARTITION BY peer ORDER BY task, error) AS r FROM v_tasks WHERE error IS NOT NULL) SELECT p.peer, coalesce(string_agg(CAST(task AS STRING) || ': ' || error, '; ' ORDER BY r), '') AS errors FROM (SELECT DISTINCT peer FROM v_tasks) p LEFT JOIN (SELECT * FROM e WHERE r <= 32) e USING (peer) GROUP BY p.peer")
def _(V):
    return T.shard_report(V("v_tasks")).select("peer", F.array_join("errors", "; ").alias("errors"))


@query("agg_silent_loss", f"WITH {REPORT}, a AS (SELECT *, greatest(0, assigned - fetched - n_errors) AS lost_worker FROM rp) SELECT peer, assigned, fetched, n_errors, lost_worker, greatest(0, assigned - fetched - n_errors - CASE WHEN lost_worker > 0 THEN 1 ELSE 0 END) AS lost_coordinator FROM a")
def _(V):
    return T.silent_loss(T.shard_report(V("v_tasks"))).withColumn("n_errors", F.col("n_errors").cast("bigint"))


@query("hydrate_unhealthy", f"WITH {REPORT} SELECT peer, assigned, fetched, n_errors FROM rp WHERE n_errors > 0 OR (assigned > 0 AND fetched <> assigned)")
def _(V):
    return T.unhealthy(T.shard_report(V("v_tasks")))


@query("agg_phase_stats", "SELECT phase, CAST(coalesce(sum(got), 0) AS BIGINT) AS bytes, count(error) AS errors, max(t1) - min(t0) AS ms, round(sum(got) / 1048576.0 / ((max(t1) - min(t0)) / 1000.0), 6) AS mib_s FROM v_tasks GROUP BY phase")
def _(V):
    return T.phase_stats(V("v_tasks"))


@query("agg_ring_steps", "SELECT task % 4 AS step, CAST(coalesce(sum(got), 0) AS BIGINT) AS bytes, min(t0) AS first, max(t1) AS last, count(error) AS errors FROM v_tasks GROUP BY 1")
def _(V):
    return T.ring_report(V("v_tasks")).drop("may_start")


@query("win_barrier", "SELECT step, lag(last) OVER (ORDER BY step) AS may_start FROM (SELECT task % 4 AS step, max(t1) AS last FROM v_tasks GROUP BY 1)")
def _(V):
    return T.ring_report(V("v_tasks")).select("step", "may_start")


@query("agg_clear_totals", "SELECT count(DISTINCT peer) AS peers, count(*) AS files, CAST(sum(len) AS BIGINT) AS bytes FROM v_tasks")
def _(V):
    per = V("v_tasks").groupBy("peer").agg(F.count(F.lit(1)).alias("files"), F.sum("len").alias("bytes"))
    return per.agg(F.count(F.lit(1)).alias("peers"), F.sum("files").cast("bigint").alias("files"), F.sum("bytes").cast("bigint").alias("bytes"))


@query("state_hydrate_mode", "SELECT n_name, CASE WHEN lower(e) IN ('broadcast', 'ring') THEN lower(e) ELSE coalesce(r, 'broadcast') END AS mode FROM (SELECT n_name, CASE n_nationkey % 4 WHEN 0 THEN 'RING' WHEN 1 THEN 'Broadcast' WHEN 2 THEN 'default' END AS e, CASE n_nationkey % 3 WHEN 0 THEN 'ring' WHEN 1 THEN 'broadcast' END AS r FROM v_names)")
def _(V):
    k = F.col("n_nationkey")
    n = V("v_names").select("n_name", F.when(k % 4 == 0, "RING").when(k % 4 == 1, "Broadcast").when(k % 4 == 2, "default").alias("e"), F.when(k % 3 == 0, "ring").when(k % 3 == 1, "broadcast").alias("r"))
    return n.select("n_name", P.hydrate_mode(F.col("e"), F.col("r")).alias("mode"))


@query("random_pick", f"WITH {ALIVE} SELECT node_id FROM al ORDER BY md5('7:' || node_id), node_id LIMIT 1")
def _(V):
    """One alive peer, drawn by a seeded hash: every peer is as likely over the seeds, and reruns agree."""
    return alive(V).orderBy(F.md5(F.concat(F.lit("7:"), F.col("node_id")).cast("binary")), "node_id").limit(1)
