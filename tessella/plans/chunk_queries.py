"""Chunking, ranged reads and namespace queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import policy as P
from ..operators import chunking as C
from ..operators import namespace as N
from ..operators import transfer as T
from ..operators.reconcile import reconcile
from .common import query
from .views import CHUNK

CHUNKS = f"chunks AS (SELECT mount, blob, o AS offset_b, least({CHUNK}, content_length - o) AS len FROM (SELECT mount, blob, content_length, unnest(range(0, content_length, {CHUNK})) AS o FROM v_listing WHERE content_length > 0))"


@query("chunk_enumerate", f"WITH {CHUNKS} SELECT mount, blob, offset_b AS offset, len FROM chunks")
def _(V):
    return C.enumerate_chunks(V("v_listing"), CHUNK)


@query("agg_hydrate_totals", f"WITH {CHUNKS} SELECT count(DISTINCT blob) AS files, count(*) AS chunks, CAST(sum(len) AS BIGINT) AS bytes, round(sum(len) / 1048576.0 / 2.5, 6) AS mib_s FROM chunks")
def _(V):
    return T.totals(C.enumerate_chunks(V("v_listing"), CHUNK), 2500)


ALIGN = """SELECT req_id, blob, off, len, file_size, least(off + len, file_size) AS stop,
  CASE WHEN len > 700 THEN 'too_long' WHEN len = 0 OR least(off + len, file_size) <= off THEN 'empty' ELSE 'ok' END AS verdict FROM v_requests"""


@query("chunk_align", f"WITH a AS ({ALIGN}) SELECT req_id, stop, verdict, CASE WHEN verdict = 'ok' THEN CAST(off // {CHUNK} * {CHUNK} AS BIGINT) END AS first_chunk, CASE WHEN verdict = 'ok' THEN CAST((stop - 1) // {CHUNK} * {CHUNK} AS BIGINT) END AS last_chunk FROM a")
def _(V):
    return C.align_reads(V("v_requests"), CHUNK, 700).select("req_id", "stop", "verdict", "first_chunk", "last_chunk")


SLICE = f"""WITH a AS ({ALIGN.replace('> 700', '> 67108864')}), c AS (SELECT *, unnest(range(off // {CHUNK} * {CHUNK}, stop, {CHUNK})) AS chunk_offset FROM a WHERE verdict = 'ok')
SELECT req_id, blob, CAST(chunk_offset AS BIGINT) AS chunk_offset, CAST(least({CHUNK}, file_size - chunk_offset) AS BIGINT) AS chunk_len, CAST(greatest(off, chunk_offset) - chunk_offset AS BIGINT) AS take_start,
  CAST(least(stop, chunk_offset + least({CHUNK}, file_size - chunk_offset)) - chunk_offset AS BIGINT) AS take_end FROM c"""


@query("chunk_slice", SLICE)
def _(V):
    return C.slice_reads(V("v_requests"), CHUNK)


@query("j_range_chunks", f"WITH s AS ({SLICE}) SELECT req_id, count(*) AS chunks, CAST(sum(take_end - take_start) AS BIGINT) AS bytes FROM s GROUP BY req_id")
def _(V):
    s = C.slice_reads(V("v_requests"), CHUNK)
    return s.groupBy("req_id").agg(F.count(F.lit(1)).alias("chunks"), F.sum(F.col("take_end") - F.col("take_start")).cast("bigint").alias("bytes"))


@query("src_range_get", "SELECT doc_id, hex(substr(encode(text), 11, 20)) AS data FROM (SELECT doc_id, CAST(text AS STRING) AS text FROM documents WHERE text IS NOT NULL)".replace("substr(encode(text), 11, 20)", "(encode(text))[11:30]"))
def _(V):
    return V("documents").filter("text IS NOT NULL").select("doc_id", F.hex(C.range_bytes(F.encode("text", "UTF-8"), F.lit(10), F.lit(20))).alias("data"))


@query("sort_chunks", "SELECT doc_id AS req_id, sha256(CAST(text AS STRING)) AS digest, CAST(strlen(text) AS BIGINT) AS n FROM documents WHERE length(text) > 0")
def _(V):
    """Documents cut into chunks, in no order, and joined again."""
    d = V("documents").filter("length(text) > 0").select(F.col("doc_id").alias("req_id"), F.encode("text", "UTF-8").alias("b"))
    cuts = F.explode(F.sequence(F.lit(0), F.octet_length("b") - 1, F.lit(CHUNK)))
    parts = d.select("req_id", "b", cuts.alias("chunk_offset")).select("req_id", "chunk_offset", F.substring(F.col("b"), F.col("chunk_offset") + 1, F.lit(CHUNK)).alias("data"))
    a = C.assemble(parts)
    return a.select("req_id", F.sha2("data", 256).alias("digest"), F.octet_length("data").cast("bigint").alias("n"))


@query("range_overrun_miss", "SELECT req_id, CASE WHEN len = 0 THEN 'empty_hit' WHEN off + len > file_size THEN 'miss' ELSE 'hit' END AS outcome FROM v_requests")
def _(V):
    r = V("v_requests").select("req_id", F.col("file_size").alias("entry_size"), F.col("off").alias("sub_off"), F.col("len").alias("sub_len"))
    return C.serve_sub_range(r).select("req_id", "outcome")


@query("len_validate", "SELECT peer, count(*) FILTER (WHERE got = len) AS good, count(*) FILTER (WHERE got <> len) AS wrong, count(*) FILTER (WHERE got IS NULL) AS missing FROM (SELECT peer, len, CASE WHEN task % 9 = 0 THEN got - 1 ELSE got END AS got FROM v_tasks) GROUP BY peer")
def _(V):
    t = V("v_tasks").withColumn("got", F.when(F.col("task") % 9 == 0, F.col("got") - 1).otherwise(F.col("got")))
    return t.groupBy("peer").agg(F.count_if(F.col("got") == F.col("len")).alias("good"), F.count_if(F.col("got") != F.col("len")).alias("wrong"), F.count_if(F.col("got").isNull()).alias("missing"))


@query("cache_len_evict", "SELECT task, peer FROM v_tasks WHERE (task, peer) NOT IN (SELECT (task, peer) FROM v_tasks WHERE (CASE WHEN task % 9 = 0 THEN got - 1 ELSE got END) = len)")
def _(V):
    """Chunks of which no copy has the expected length."""
    t = V("v_tasks").withColumn("got", F.when(F.col("task") % 9 == 0, F.col("got") - 1).otherwise(F.col("got")))
    return t.join(t.filter("got = len").select("task", "peer"), ["task", "peer"], "left_anti").select("task", "peer")


@query("src_blob_list", "SELECT split_part(blob, '/', 1) AS prefix, count(*) AS blobs, CAST(sum(content_length) AS BIGINT) AS bytes FROM v_listing WHERE starts_with(blob, 'e') GROUP BY 1")
def _(V):
    l = V("v_listing").filter(F.startswith("blob", F.lit("e")))
    return l.groupBy(F.split_part("blob", F.lit("/"), F.lit(1)).alias("prefix")).agg(F.count(F.lit(1)).alias("blobs"), F.sum("content_length").cast("bigint").alias("bytes"))


LISTED = """SELECT DISTINCT split_part(substr(blob, 4), '/', 1) AS name, 'dir' AS kind, CAST(NULL AS BIGINT) AS size FROM v_listing WHERE starts_with(blob, 'en/')"""


@query("agg_distinct_prefix", LISTED)
def _(V):
    return N.list_directory(V("v_listing"), "en/")


@query("listing_filter", "SELECT substr(blob, 9) AS name, 'file' AS kind, content_length AS size FROM v_listing WHERE starts_with(blob, 'en/src1/') AND substr(blob, 9) <> ''")
def _(V):
    return N.list_directory(V("v_listing"), "en/src1/")


@query("src_blob_head", "SELECT l.req, l.blob, v.content_length, v.blob IS NULL AS not_found FROM (SELECT doc_id AS req, 'en/src1/' || CAST(doc_id AS STRING) AS blob FROM documents) l LEFT JOIN v_listing v ON l.blob = v.blob")
def _(V):
    want = V("documents").select(F.col("doc_id").alias("req"), F.concat(F.lit("en/src1/"), F.col("doc_id").cast("string")).alias("blob"))
    have = V("v_listing").select("blob", "content_length", F.lit(True).alias("there"))
    return want.join(have, "blob", "left").select("req", "blob", "content_length", F.col("there").isNull().alias("not_found"))


FOLDERS = """bl AS (SELECT string_split(blob, '/') AS p, content_length FROM v_listing),
  up AS (SELECT array_to_string(p[1:d], '/') || CASE WHEN d > 0 THEN '/' ELSE '' END AS folder, d AS depth, d = len(p) - 1 AS own, content_length FROM bl, unnest(range(0, len(p))) AS u(d)),
  fo AS (SELECT folder, depth, count(*) FILTER (WHERE own) AS files, count(*) AS blobs, CAST(sum(content_length) AS BIGINT) AS bytes FROM up GROUP BY ALL)"""


@query("agg_folder_rollup", f"WITH {FOLDERS} SELECT folder, CAST(depth AS INTEGER) AS depth, files, (SELECT count(*) FROM fo c WHERE c.depth = fo.depth + 1 AND starts_with(c.folder, fo.folder)) AS dirs, blobs, bytes FROM fo")
def _(V):
    """Every folder with its direct children, and the blobs and bytes below it."""
    return N.folder_rollup(V("v_listing"))


@query("listing_children", f"WITH {FOLDERS} SELECT regexp_replace(blob, '[^/]*$', '') AS folder, regexp_extract(blob, '[^/]*$') AS name, 'file' AS kind, content_length AS size FROM v_listing UNION ALL SELECT regexp_replace(folder, '[^/]*/$', ''), regexp_extract(folder, '([^/]*)/$', 1), 'dir', NULL FROM fo WHERE depth > 0")
def _(V):
    """The direct children of all folders at once."""
    return N.children(V("v_listing"))


#: The listing as it was: some blobs rewritten in the same length, some touched, some not there yet; and one in 40 that is gone since.
OLD = """SELECT name || CASE WHEN doc_id % 40 = 7 THEN '.old' ELSE '' END AS name, 'file' AS kind, CASE WHEN doc_id % 11 = 3 THEN size + 1 ELSE size END AS size, CASE WHEN doc_id % 13 = 5 THEN reverse(etag) ELSE etag END AS etag,
  CASE WHEN doc_id % 17 = 2 THEN mtime - 60 ELSE mtime END AS mtime FROM v_props WHERE doc_id % 19 <> 4"""


def _old(V):
    d = F.col("doc_id")
    name = F.concat("name", F.when(d % 40 == 7, ".old").otherwise(""))
    size, etag, mtime = F.when(d % 11 == 3, F.col("size") + 1).otherwise(F.col("size")), F.when(d % 13 == 5, F.reverse("etag")).otherwise(F.col("etag")), F.when(d % 17 == 2, F.col("mtime") - 60).otherwise(F.col("mtime"))
    return V("v_props").filter(d % 19 != 4).select(name.alias("name"), F.lit("file").alias("kind"), size.alias("size"), etag.alias("etag"), mtime.alias("mtime"))


@query("j_upsert_properties", f"WITH t AS ({OLD}) SELECT coalesce(t.name, l.name) AS name, CASE WHEN t.kind IS NULL THEN 'insert' WHEN l.name IS NULL THEN 'delete' WHEN (t.size, t.etag, t.mtime) IS DISTINCT FROM (l.size, l.etag, l.mtime) THEN 'update' ELSE 'keep' END AS action FROM t FULL JOIN v_props l ON t.name = l.name")
def _(V):
    """A refresh that also sees blobs rewritten in the same length, by their etag, and touched ones, by their time."""
    return N.refresh(_old(V), V("v_props").withColumn("kind", F.lit("file")))


@query("j_inventory_diff", f"WITH t AS ({OLD}) SELECT coalesce(t.name, l.name) AS name, CASE WHEN t.kind IS NULL THEN 'insert' WHEN l.name IS NULL THEN 'delete' ELSE 'update' END AS action FROM t FULL JOIN v_props l ON t.name = l.name WHERE t.kind IS NULL OR l.name IS NULL OR (t.size, t.etag, t.mtime) IS DISTINCT FROM (l.size, l.etag, l.mtime)")
def _(V):
    """Only what differs between two inventories, found by digests of ever smaller buckets."""
    return reconcile(_old(V), V("v_props"), ["name"], ["size", "etag", "mtime"])


TRACKED = "SELECT substr(blob, 9) AS name, 'file' AS kind, content_length + CASE WHEN content_length % 3 = 0 THEN 1 ELSE 0 END AS size FROM v_listing WHERE starts_with(blob, 'en/src1/') AND content_length % 4 <> 1 UNION ALL SELECT 'gone' || CAST(r_regionkey AS STRING), 'file', CAST(1 AS BIGINT) FROM region UNION ALL SELECT name, 'dir', NULL FROM (SELECT substr(blob, 9) AS name FROM v_listing WHERE starts_with(blob, 'en/src1/') AND content_length % 4 = 1 AND content_length % 5 = 0)"


def _tracked(V):
    own = V("v_listing").filter(F.startswith("blob", F.lit("en/src1/"))).withColumn("name", F.expr("substr(blob, 9)"))
    odd = F.col("content_length") % 4 == 1
    a = own.filter(~odd).select("name", F.lit("file").alias("kind"), (F.col("content_length") + F.when(F.col("content_length") % 3 == 0, 1).otherwise(0)).alias("size"))
    b = V("region").select(F.concat(F.lit("gone"), F.col("r_regionkey").cast("string")).alias("name"), F.lit("file").alias("kind"), F.lit(1).cast("bigint").alias("size"))
    c = own.filter(odd & (F.col("content_length") % 5 == 0)).select("name", F.lit("dir").alias("kind"), F.lit(None).cast("bigint").alias("size"))
    return a.unionByName(b).unionByName(c)


LIST1 = "SELECT substr(blob, 9) AS name, content_length AS size FROM v_listing WHERE starts_with(blob, 'en/src1/')"


@query("j_upsert", f"WITH t AS ({TRACKED}), l AS ({LIST1}) SELECT coalesce(t.name, l.name) AS name, CASE WHEN t.kind IS NULL THEN 'insert' WHEN l.name IS NULL THEN 'delete' WHEN t.kind = 'dir' THEN 'keep' WHEN t.size IS DISTINCT FROM l.size THEN 'update' ELSE 'keep' END AS action FROM t FULL JOIN l ON t.name = l.name")
def _(V):
    return N.refresh(_tracked(V), N.list_directory(V("v_listing"), "en/src1/"))


@query("j_delta_delete", f"WITH t AS ({TRACKED}), l AS ({LIST1}) SELECT name FROM t WHERE name NOT IN (SELECT name FROM l)")
def _(V):
    return _tracked(V).join(N.list_directory(V("v_listing"), "en/src1/"), "name", "left_anti").select("name")


@query("set_stale_children", f"WITH t AS ({TRACKED}), l AS ({LIST1}) SELECT name FROM t EXCEPT SELECT name FROM l")
def _(V):
    return _tracked(V).select("name").exceptAll(N.list_directory(V("v_listing"), "en/src1/").select("name"))


@query("limit_children", f"WITH t AS ({TRACKED}), l AS ({LIST1}), k AS (SELECT DISTINCT name FROM t), n AS (SELECT name, row_number() OVER (ORDER BY name) AS r FROM l WHERE name NOT IN (SELECT name FROM k)) SELECT l.name, 'file' AS kind FROM l JOIN k USING (name) UNION ALL SELECT name, 'file' FROM n WHERE r <= greatest(0, (SELECT count(*) + 2 - count(*) FROM k))")
def _(V):
    t = _tracked(V)
    return N.capped_children(N.list_directory(V("v_listing"), "en/src1/"), t, t.select("name").distinct().count() + 2)


@query("limit_readdir", f"WITH l AS ({LIST1}), e AS (SELECT '.' AS name, 'dir' AS kind, 1 AS pos UNION ALL SELECT '..', 'dir', 2 UNION ALL SELECT name, 'file', 2 + row_number() OVER (ORDER BY name) FROM l) SELECT name, kind, CAST(pos AS BIGINT) AS pos FROM e WHERE pos > 1")
def _(V):
    return N.page(N.list_directory(V("v_listing"), "en/src1/"), 1)


@query("prefix_combine", "SELECT n_name, CASE WHEN p = '' THEN q WHEN q = '' THEN p ELSE regexp_replace(p, '/+$', '') || CASE WHEN starts_with(q, '/') THEN q ELSE '/' || q END END AS path FROM (SELECT n_name, CASE n_nationkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'data//' ELSE 'd/e' END AS p, CASE n_nationkey % 4 WHEN 0 THEN '' WHEN 1 THEN '/x' ELSE 'x/y' END AS q FROM v_names)")
def _(V):
    k = F.col("n_nationkey")
    n = V("v_names").select("n_name", F.when(k % 3 == 0, "").when(k % 3 == 1, "data//").otherwise("d/e").alias("p"), F.when(k % 4 == 0, "").when(k % 4 == 1, "/x").otherwise("x/y").alias("q"))
    return n.select("n_name", P.combine_prefix(F.col("p"), F.col("q")).alias("path"))


@query("prefix_strip", "SELECT blob, CASE WHEN starts_with(blob, 'en/src1') THEN regexp_replace(substr(blob, 8), '^/+', '') ELSE blob END AS path FROM v_listing")
def _(V):
    return V("v_listing").select("blob", P.strip_prefix(F.col("blob"), F.lit("en/src1")).alias("path"))


@query("src_rr_pool", "SELECT req_id, (row_number() OVER (ORDER BY req_id, off, len, blob) - 1) % 4 AS worker FROM v_requests")
def _(V):
    return T.numbered(V("v_requests"), ["req_id", "off", "len", "blob"]).select("req_id", (F.col("i") % 4).alias("worker"))


@query("j_mount_lookup", "SELECT r.req_id, CASE WHEN m.n_name IS NULL THEN 'unknown mount' END AS error, CASE WHEN m.n_name IS NULL THEN 0 ELSE r.len END AS fetched FROM v_requests r LEFT JOIN nation m ON 'NATION_' || CAST(r.blob % 30 AS STRING) = m.n_name")
def _(V):
    m = V("nation").select(F.col("n_name").alias("m"), F.lit(True).alias("known"))
    r = V("v_requests").withColumn("m", F.concat(F.lit("NATION_"), (F.col("blob") % 30).cast("string")))
    return r.join(m, "m", "left").select("req_id", F.when(F.col("known").isNull(), "unknown mount").alias("error"), F.when(F.col("known").isNull(), 0).otherwise(F.col("len")).cast("bigint").alias("fetched"))


@query("state_listing_ttl", "SELECT id, last_seen <= 1704067200 + 600 AND rec % 11 <> 0 OR rec % 11 = 0 AS relist, rec FROM v_gossip")
def _(V):
    """A folder never loaded (here every 11th) or loaded 30 s ago or more is listed again; now = 1704067830."""
    loaded = F.when(F.col("rec") % 11 != 0, F.col("last_seen"))
    return V("v_gossip").select("id", (loaded.isNull() | (F.lit(1704067830) - loaded >= 30)).alias("relist"), "rec")


@query("state_startup_purge", "SELECT count(*) AS files, CAST(sum(content_length) AS BIGINT) AS bytes FROM v_listing")
def _(V):
    return V("v_listing").agg(F.count(F.lit(1)).alias("files"), F.sum("content_length").cast("bigint").alias("bytes"))


@query("j_reconcile", "SELECT count(*) AS dropped, CAST(coalesce(sum(content_length), 0) AS BIGINT) AS bytes FROM v_listing l WHERE NOT EXISTS (SELECT 1 FROM labels WHERE l.blob LIKE '%/' || CAST(doc_id AS STRING))")
def _(V):
    l = V("v_listing").withColumn("id", F.element_at(F.split("blob", "/"), -1).cast("bigint"))
    return l.join(V("labels").select(F.col("doc_id").alias("id")), "id", "left_anti").agg(F.count(F.lit(1)).alias("dropped"), F.coalesce(F.sum("content_length"), F.lit(0)).cast("bigint").alias("bytes"))
