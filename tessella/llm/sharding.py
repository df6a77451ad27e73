"""Sharding by a permutation-filled lookup table.

Every shard has its own permutation of the slots of a prime-sized table (an offset and a step from a hash of its name). Shards take
turns, each claiming the next free slot in its order, until the table is full: shares differ by one slot at most, and adding or
removing a shard moves few slots. A row's shard is the entry at its key's hash modulo the table's size. The table has TABLE_SIZE
entries whatever the input, so it is broadcast, and placement is one lookup a row, with no shuffle.

A null key is a key like any other. Repeated keys share a shard; no row depends on another. Extra columns pass through.
write_shards() spreads each shard over `files` tasks, so a shard with a third of all rows is written by many.
"""

from __future__ import annotations

from hashlib import sha256

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents

TABLE_SIZE = 65537
SHARDS = tuple(f"shard-{i:02d}" for i in range(48))


def lookup_table(shards=SHARDS, size: int = TABLE_SIZE) -> list[int]:
    """For each slot the number of the shard that holds it."""
    if not 0 < len(shards) <= size:
        raise ValueError("between one shard and as many as slots are needed")
    at, step = [], []
    for name in shards:
        h = sha256(name.encode()).digest()
        at.append(int.from_bytes(h[:8], "big") % size)
        step.append(int.from_bytes(h[8:16], "big") % (size - 1) + 1)
    table, free, turn = [-1] * size, size, 0
    while free:
        slot = at[turn]
        while table[slot] >= 0:
            slot = (slot + step[turn]) % size
        table[slot] = turn
        at[turn] = (slot + step[turn]) % size
        free -= 1
        turn = (turn + 1) % len(shards)
    return table


def slot_of(key: Column, size: int = TABLE_SIZE) -> Column:
    return F.pmod(F.xxhash64(key.cast("string")), F.lit(size)).cast("int")


def table_frame(spark: SparkSession, shards=SHARDS, size: int = TABLE_SIZE) -> DataFrame:
    """slot, shard: `size` rows made from one literal."""
    entries = F.split(F.lit(",".join(map(str, lookup_table(shards, size)))), ",")
    return spark.range(1, numPartitions=1).select(F.posexplode(entries).alias("slot", "shard")).select("slot", F.col("shard").cast("int").alias("shard"))


def place(docs: DataFrame, key: Column, shards=SHARDS, size: int = TABLE_SIZE) -> DataFrame:
    """__row (docs' columns), slot, shard."""
    table = F.broadcast(table_frame(docs.sparkSession, shards, size))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), slot_of(key, size).alias("slot"))
    return rows.join(table, "slot").select("__row", "slot", "shard")


def write_shards(placed: DataFrame, path: str, files: int = 8) -> None:
    """A folder for each shard, of at most `files` files a shard; the documents are a column `row`."""
    salt = F.pmod(F.xxhash64("__row"), F.lit(files))
    rows = placed.withColumn("salt", salt).repartition("shard", "salt")
    rows.select(F.col("__row").alias("row"), "slot", "shard").write.partitionBy("shard").parquet(path)


def op5_shard_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, slot, shard for every document."""
    docs = documents(spark, sf_dir).select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"))
    return place(docs, F.col("doc_id")).select("__row.doc_id", "__row.n_bytes", "slot", "shard")


QUERIES = {"op5_shard_lookup": op5_shard_lookup}
ORACLES: dict[str, str] = {}
