"""Gossip membership: merging records is a maximum over (incarnation, last seen, state's rank), so its order doesn't matter."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.policy import state_rank, sweep_state


def merge_members(records: DataFrame, cluster_hash: str, self_id: str | None = None) -> DataFrame:
    """id, incarnation, last_seen, state, cluster_hash -> the winning row of each id of this cluster; oneself is not taken from gossip."""
    mine = records.filter(F.col("cluster_hash") == cluster_hash)
    if self_id:
        mine = mine.filter(F.col("id") != self_id)
    key = F.struct("incarnation", "last_seen", state_rank(F.col("state")).alias("rank"))
    return mine.groupBy("id").agg(F.max(F.struct(key.alias("k"), F.col("state"))).alias("w"), F.count(F.lit(1)).alias("records")).select("id", "w.k.incarnation", "w.k.last_seen", "w.state", "records")


def foreign_records(records: DataFrame, cluster_hash: str) -> DataFrame:
    return records.agg(F.count_if(F.col("cluster_hash") != cluster_hash).alias("dropped"), F.count(F.lit(1)).alias("records"))


def self_refute(records: DataFrame, self_id: str, incarnation: int) -> DataFrame:
    """The incarnation to announce: one above any record that outdates or doubts this node."""
    about = records.filter(F.col("id") == self_id)
    doubt = (F.col("incarnation") > incarnation) | ((F.col("incarnation") == incarnation) & (F.col("state") != "Alive"))
    top = F.max(F.when(doubt, F.col("incarnation")))
    return about.agg(F.coalesce(F.greatest(top, F.lit(incarnation)) + 1, F.lit(incarnation)).cast("bigint").alias("incarnation"), F.lit("Alive").alias("state"))


def touch(members: DataFrame, contacts: DataFrame, now: int) -> DataFrame:
    """Members in direct contact are alive as of now."""
    met = contacts.select("id").distinct().withColumn("met", F.lit(True))
    m = members.join(met, "id", "left")
    return m.select("id", "incarnation", F.when(F.col("met"), F.lit(now)).otherwise(F.col("last_seen")).cast("bigint").alias("last_seen"), F.when(F.col("met"), "Alive").otherwise(F.col("state")).alias("state"))


def sweep(members: DataFrame, now: int, self_id: str | None = None) -> DataFrame:
    new = sweep_state(F.col("last_seen"), F.lit(now).cast("bigint"), F.col("id") == F.lit(self_id) if self_id else F.lit(False))
    return members.withColumn("new_state", new).withColumn("failed", (F.col("new_state") == "Dead") & (F.col("state") != "Dead"))


def alive_peers(nodes: DataFrame, self_id: str, cluster_hash: str) -> DataFrame:
    return nodes.filter((F.col("state") == "Alive") & (F.col("node_id") != self_id) & (F.col("cluster_hash") == cluster_hash))


def by_state(nodes: DataFrame) -> DataFrame:
    return nodes.agg(*[F.count_if(F.col("state") == s).alias(s.lower()) for s in ("Alive", "Suspect", "Dead")], (F.count_if(F.col("state") == "Alive") >= 1).alias("ready"))


def blooms_to_pull(nodes: DataFrame, have: DataFrame, self_id: str) -> DataFrame:
    """Alive others whose filter is newer than ours."""
    h = have.select("node_id", F.col("bloom_version").alias("have"))
    j = nodes.filter((F.col("state") == "Alive") & (F.col("node_id") != self_id) & (F.col("bloom_version") != 0)).join(h, "node_id", "left")
    return j.filter(F.col("bloom_version") > F.coalesce("have", F.lit(0))).select("node_id", "bloom_version", F.coalesce("have", F.lit(0)).cast("bigint").alias("have"))


def hydrate_targets(nodes: DataFrame, self_id: str, cluster_hash: str) -> DataFrame:
    """Oneself first, then the alive others by id."""
    me = nodes.filter(F.col("node_id") == self_id).select("node_id", F.lit(0).alias("grp"))
    rest = alive_peers(nodes, self_id, cluster_hash).select("node_id", F.lit(1).alias("grp"))
    return me.unionByName(rest)
