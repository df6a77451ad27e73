"""Chunks of blobs and ranged reads over them. Offsets and lengths are bytes; nothing here shuffles but read assembly."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_READ = 64 << 20


def enumerate_chunks(listing: DataFrame, chunk_size: int) -> DataFrame:
    """mount, blob, content_length -> mount, blob, offset, len; the last chunk may be short, empty blobs have none."""
    some = listing.filter(F.col("content_length") > 0)
    offsets = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("content_length") - 1, F.lit(chunk_size).cast("bigint")))
    out = some.select("mount", "blob", "content_length", offsets.alias("offset"))
    return out.select("mount", "blob", "offset", F.least(F.lit(chunk_size).cast("bigint"), F.col("content_length") - F.col("offset")).alias("len"))


def align_reads(requests: DataFrame, chunk_size: int, most: int = MOST_READ) -> DataFrame:
    """requests with `stop`, `first_chunk`, `last_chunk`; verdict ok, empty or too_long."""
    stop = F.least(F.col("off") + F.col("len"), F.col("file_size"))
    at = requests.withColumn("stop", stop)
    verdict = F.when(F.col("len") > most, "too_long").when((F.col("len") == 0) | (F.col("stop") <= F.col("off")), "empty").otherwise("ok")
    grid = lambda x: F.floor(x / chunk_size) * chunk_size
    at = at.withColumn("verdict", verdict)
    ok = F.col("verdict") == "ok"
    return at.withColumns({"first_chunk": F.when(ok, grid(F.col("off"))), "last_chunk": F.when(ok, grid(F.col("stop") - 1))})


def slice_reads(requests: DataFrame, chunk_size: int) -> DataFrame:
    """One row per request and chunk it touches: chunk_offset, chunk_len, take_start and take_end within the chunk."""
    ok = align_reads(requests, chunk_size).filter("verdict = 'ok'")
    each = ok.select("req_id", "blob", "off", "stop", "file_size", F.explode(F.sequence("first_chunk", "last_chunk", F.lit(chunk_size).cast("bigint"))).alias("chunk_offset"))
    length = F.least(F.lit(chunk_size).cast("bigint"), F.col("file_size") - F.col("chunk_offset"))
    return each.select(
        "req_id",
        "blob",
        "chunk_offset",
        length.alias("chunk_len"),
        (F.greatest("off", "chunk_offset") - F.col("chunk_offset")).alias("take_start"),
        (F.least(F.col("stop"), F.col("chunk_offset") + length) - F.col("chunk_offset")).alias("take_end"),
    )


def range_bytes(content, offset, length):
    """Bytes of a BINARY column from a zero-based offset."""
    return F.substring(content, offset + 1, length)


def assemble(parts: DataFrame) -> DataFrame:
    """req_id, chunk_offset, data (BINARY) -> req_id, data: parts joined in order of offset."""
    ordered = F.array_sort(F.collect_list(F.struct("chunk_offset", F.hex("data").alias("h"))))
    return parts.groupBy("req_id").agg(F.unhex(F.array_join(F.transform(ordered, lambda x: x["h"]), "")).alias("data"))


def serve_sub_range(entries: DataFrame) -> DataFrame:
    """entries: entry_size, sub_off, sub_len -> outcome: a range past the entry is a miss; an empty one a hit that isn't counted."""
    return entries.withColumn("outcome", F.when(F.col("sub_len") == 0, "empty_hit").when(F.col("sub_off") + F.col("sub_len") > F.col("entry_size"), "miss").otherwise("hit"))
