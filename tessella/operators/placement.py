"""Rendezvous placement, Bloom advertisements and candidate ranking.

Every chunk meets every node, so nodes stand beside each chunk as one array (a single broadcast row), and what is asked of them is decided inside
the row: owners and candidates need no shuffle. More than MOST_NODES nodes make several arrays, whose answers meet by the chunk's key.

Filters are asked through a bit-sliced index: for each bit position the nodes whose filter has it set, as a bitmap over the nodes' numbers. A chunk looks
up the slices of its K bits by equality and ANDs them, whatever the number of nodes; what is left set are the nodes that may hold it. While all slices together
stay within MOST_FILTER_BYTES they are broadcast, beyond that chunks and slices meet by a shuffle on the bit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.digest import bloom_positions, chunk_digest, hrw_score
from ..session import shared_path

MOST_NODES = 10_000
MOST_FILTER_BYTES = 256 << 20
#: Bits of a chunk in a filter.
K = 4
KEY = ("mount", "blob", "offset")


def small(nodes: DataFrame, most: int = MOST_NODES) -> DataFrame:
    """nodes with a broadcast hint if there are at most `most`."""
    return F.broadcast(nodes) if nodes.limit(most + 1).count() <= most else nodes


def with_digest(chunks: DataFrame) -> DataFrame:
    return chunks.withColumn("digest", chunk_digest(F.col("mount"), F.col("blob"), F.col("offset")))


def blocks(nodes: DataFrame) -> int:
    """How many arrays the nodes make."""
    return -(-nodes.count() // MOST_NODES) or 1


def beside(chunks: DataFrame, nodes: DataFrame, *columns: str, parts: int = 1) -> DataFrame:
    """chunks with nodes as arrays of structs (`nodes`), by id; a row for each of the parts."""
    block = F.pmod(F.xxhash64("node_id"), F.lit(parts))
    arrays = nodes.groupBy(block.alias("block")).agg(F.array_sort(F.collect_list(F.struct("node_id", *columns))).alias("nodes")).drop("block")
    return chunks.crossJoin(F.broadcast(arrays))


def ranked(scores: Column) -> Column:
    """Structs of node_id and score, the highest score first; on equal scores the lesser id."""
    first = lambda a, b: (a["score"] > b["score"]) | ((a["score"] == b["score"]) & (a["node_id"] < b["node_id"]))
    return F.array_sort(scores, lambda a, b: F.when(first(a, b), -1).when(first(b, a), 1).otherwise(0))


def scored(chunks: DataFrame, nodes: DataFrame) -> DataFrame:
    """A row for each chunk and node."""
    c = beside(with_digest(chunks), nodes, parts=blocks(nodes))
    return c.select(*[x for x in c.columns if x != "nodes"], F.explode("nodes").alias("n")).select("*", "n.node_id").drop("n").withColumn("score", hrw_score(F.col("node_id"), F.col("digest")))


def hrw_owner(chunks: DataFrame, nodes: DataFrame, self_id: str | None = None) -> DataFrame:
    """chunk key -> owner: the highest score; on equal scores oneself, then the lesser id. One projection."""
    parts = blocks(nodes)
    c = beside(with_digest(chunks.select(*KEY)), nodes, parts=parts)
    mine = lambda n: F.when(n["node_id"] == F.lit(self_id), 1).otherwise(0) if self_id else F.lit(0)
    keys = F.transform("nodes", lambda n: F.struct(hrw_score(n["node_id"], F.col("digest")).alias("score"), mine(n).alias("mine")))
    # The first of equal keys: nodes stand by id.
    best = F.array_max("keys")
    c = c.withColumn("keys", keys).select(*KEY, best.alias("best"), F.get("nodes", F.array_position("keys", best).cast("int") - 1)["node_id"].alias("owner"))
    if parts == 1:
        return c.select(*KEY, "owner")
    first = F.max("best").alias("best")
    tops = c.groupBy(*KEY).agg(first).withColumnRenamed("best", "top")
    return c.join(tops, [*KEY]).filter("best = top").groupBy(*KEY).agg(F.min("owner").alias("owner"))


def hrw_rank(chunks: DataFrame, nodes: DataFrame) -> DataFrame:
    if blocks(nodes) > 1:
        w = Window.partitionBy(*KEY).orderBy(F.desc("score"), "node_id")
        return scored(chunks, nodes).withColumn("rank", F.row_number().over(w)).select(*KEY, "node_id", "score", "rank")
    c = beside(with_digest(chunks.select(*KEY)), nodes)
    every = ranked(F.transform("nodes", lambda n: F.struct(n["node_id"].alias("node_id"), hrw_score(n["node_id"], F.col("digest")).alias("score"))))
    return c.select(*KEY, F.posexplode(every).alias("rank", "n")).select(*KEY, "n.node_id", "n.score", (F.col("rank") + 1).alias("rank"))


def build_blooms(inventory: DataFrame, m_bits: int) -> DataFrame:
    """node_id and chunk key -> node_id, bit: the set bits of each node's filter."""
    return with_digest(inventory).select("node_id", F.explode(bloom_positions(F.col("digest"), m_bits)).alias("bit")).distinct()


def build_filters(inventory: DataFrame, m_bits: int) -> DataFrame:
    """node_id and chunk key -> node_id, words: its filter, 64 bits a word. Bits are joined into words before the shuffle."""
    bits = with_digest(inventory).select("node_id", F.explode(bloom_positions(F.col("digest"), m_bits)).alias("bit"))
    word = F.shiftright("bit", 6).cast("int").alias("word")
    words = bits.groupBy("node_id", word).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("bits"))
    full = words.groupBy("node_id").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("m"))
    return full.select("node_id", F.transform(F.sequence(F.lit(0), F.lit((m_bits + 63) // 64 - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0).cast("bigint"))).alias("words"))


def node_numbers(nodes: DataFrame) -> DataFrame:
    """node_id, num: nodes by id, from 0."""
    return nodes.select("node_id").distinct().select("node_id", (F.row_number().over(Window.orderBy("node_id")) - 1).alias("num"))


def build_slices(inventory: DataFrame, m_bits: int, numbers: DataFrame, words: int) -> DataFrame:
    """bit, nodes: for each position that any filter has set, the nodes that have it, 64 to a word. Bits are joined into words before the shuffle."""
    held = inventory.join(F.broadcast(numbers), "node_id")
    bits = with_digest(held).select("num", F.explode(bloom_positions(F.col("digest"), m_bits, K)).alias("bit"))
    one = F.expr("shiftleft(1L, cast(num & 63 as int))")
    parts = bits.groupBy("bit", F.shiftright("num", 6).cast("int").alias("word")).agg(F.bit_or(one).alias("set"))
    if words == 1:
        return parts.select("bit", F.array("set").alias("nodes"))
    full = parts.groupBy("bit").agg(F.map_from_entries(F.collect_list(F.struct("word", "set"))).alias("m"))
    return full.select("bit", F.transform(F.sequence(F.lit(0), F.lit(words - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0).cast("bigint"))).alias("nodes"))


def with_holders(chunks: DataFrame, inventory: DataFrame, m_bits: int, numbers: DataFrame, count: int, how: str = "inner") -> DataFrame:
    """chunks with digest and `hit`: the bitmap of nodes whose filter has all of the chunk's bits; null where some bit is nobody's."""
    # The index is written once, for four lookups; so is its plan made once.
    path = shared_path(chunks.sparkSession, "slices")
    made = build_slices(inventory, m_bits, numbers, -(-count // 64) or 1)
    made.write.parquet(path)
    slices = chunks.sparkSession.read.schema(made.schema).parquet(path)
    c = with_bits(chunks, m_bits)
    hint = F.broadcast if count * m_bits // 8 <= MOST_FILTER_BYTES else lambda x: x
    # Never null, so that no filter on them is pushed below what computes them.
    c = c.select(*c.columns, *[F.coalesce(F.get("bits", F.lit(i)), F.lit(-1).cast("bigint")).alias(f"__b{i}") for i in range(K)])
    for i in range(K):
        c = c.join(hint(slices.select(F.col("bit").alias(f"__b{i}"), F.col("nodes").alias(f"__s{i}"))), f"__b{i}", how)
    every = lambda x, j: x.bitwiseAND(F.get("__s1", j)).bitwiseAND(F.get("__s2", j)).bitwiseAND(F.get("__s3", j))
    if count <= 64:
        word = every(F.get("__s0", F.lit(0)), F.lit(0))
        return c.select(*chunks.columns, "digest", F.when(word.isNotNull(), F.array(word)).alias("hit"))
    return c.select(*chunks.columns, "digest", F.transform("__s0", every).alias("hit"))


def has(hit: Column, num: Column) -> Column:
    """Whether a bitmap has a node's number."""
    word = F.coalesce(F.get(hit, F.shiftright(num, 6).cast("int")), F.lit(0).cast("bigint"))
    return F.call_function("shiftright", word, num.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1).cast("bigint")) == 1


def numbers_in(hit: Column, count: int) -> Column:
    """The numbers, below count, that a bitmap has; words without any are passed over."""
    if count <= 64:
        word = F.get(hit, F.lit(0))
        one = lambda i: F.when(word.bitwiseAND(F.lit((1 << i) - (1 << 64 if i == 63 else 0))) != 0, F.lit(i))
        return F.array_compact(F.array(*[one(i) for i in range(count)]))
    bits = F.sequence(F.lit(0), F.lit(63))
    of_word = lambda w, j: F.filter(F.transform(bits, lambda i: j * 64 + i), lambda n: F.call_function("shiftright", w, n.bitwiseAND(F.lit(63))).bitwiseAND(F.lit(1).cast("bigint")) == 1)
    return F.flatten(F.transform(hit, lambda w, j: F.when(w == 0, F.array().cast("array<int>")).otherwise(of_word(w, j))))


def with_bits(chunks: DataFrame, m_bits: int) -> DataFrame:
    return with_digest(chunks).withColumn("bits", bloom_positions(F.col("digest"), m_bits))


def probe_blooms(chunks: DataFrame, inventory: DataFrame, m_bits: int, holders: DataFrame | None = None) -> DataFrame:
    """chunk key, node_id of the filters of `inventory` that hold a chunk. holders: the nodes that it names, if they are known."""
    numbers = node_numbers(inventory if holders is None else holders)
    count = numbers.count()
    c = with_holders(chunks.select(*KEY), inventory, m_bits, numbers, count)
    found = c.select(*KEY, F.explode(numbers_in(F.col("hit"), count)).alias("num"))
    return found.join(F.broadcast(numbers), "num").select(*KEY, "node_id")


def rank_candidates(chunks: DataFrame, alive: DataFrame, inventory: DataFrame, m_bits: int, max_yes: int, max_maybe: int, holders: DataFrame | None = None) -> DataFrame:
    """Each chunk's peers to try: those whose filter holds it (yes), then those that advertise none (maybe), by score, within either budget."""
    numbers = node_numbers(inventory if holders is None else holders)
    if blocks(alive) > 1:
        return _rank_by_join(chunks, alive, probe_blooms(chunks, inventory, m_bits, holders), numbers, max_yes, max_maybe)
    c = with_holders(chunks.select(*KEY), inventory, m_bits, numbers, numbers.count(), "left")
    c = beside(c, alive.select("node_id").join(numbers, "node_id", "left"), "num")
    cls = lambda n: F.when(n["num"].isNull(), "maybe").when(has(F.col("hit"), n["num"]), "yes")
    # Scores are for those that may be tried only.
    asked = F.filter(F.transform("nodes", lambda n: F.struct(n["node_id"].alias("node_id"), cls(n).alias("cls"))), lambda n: n["cls"].isNotNull())
    tried = F.transform(asked, lambda n: F.struct(n["node_id"].alias("node_id"), n["cls"].alias("cls"), hrw_score(n["node_id"], F.col("digest")).alias("score")))
    c = c.select(*KEY, tried.alias("tried"))
    best = lambda name, most: F.slice(ranked(F.filter("tried", lambda n: n["cls"] == name)), 1, most)
    return c.select(*KEY, F.posexplode(F.concat(best("yes", max_yes), best("maybe", max_maybe))).alias("attempt", "n")).select(*KEY, "n.node_id", "n.cls", (F.col("attempt") + 1).alias("attempt"))


def _rank_by_join(chunks: DataFrame, alive: DataFrame, positive: DataFrame, holders: DataFrame, max_yes: int, max_maybe: int) -> DataFrame:
    known = holders.select("node_id").withColumn("known", F.lit(True))
    hold = positive.select(*KEY, "node_id").withColumn("hold", F.lit(True))
    p = scored(chunks.select(*KEY), alive).join(hold, [*KEY, "node_id"], "left").join(known, "node_id", "left")
    p = p.withColumn("cls", F.when(F.col("hold"), "yes").when(F.col("known").isNull(), "maybe")).filter("cls IS NOT NULL")
    w = Window.partitionBy(*KEY, "cls").orderBy(F.desc("score"), "node_id")
    p = p.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= F.when(F.col("cls") == "yes", max_yes).otherwise(max_maybe))
    order = Window.partitionBy(*KEY).orderBy(F.desc("cls"), "r")
    return p.withColumn("attempt", F.row_number().over(order)).select(*KEY, "node_id", "cls", "attempt")
