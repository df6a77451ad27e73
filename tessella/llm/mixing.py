"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

1. Targets. Every source has a weight; the sources share a budget of words by weight, but none takes more than MOST times its size:
   the excess goes to the others by weight until none is above (water filling, solved over the sorted table of sources).
2. Line. Each source's documents lie in a permuted order (a hash of the id and the seed) on a line of its words, which repeats until
   the target is reached: complete passes take every document once more, the last pass takes the line's beginning. The line is cut into
   blocks of equal length; as many as the target holds are the source's quota.
   Positions come from two-level prefix sums: sums by (source, slice of the permutation), then within each slice; no task holds a source.
3. Tree. A binary tree over the output shards splits the quotas: at every node half of its blocks go left, how many of each source being
   drawn without replacement, and so multivariate-hypergeometric. The leaves hold each shard's exact quota of every source.
4. Draw. Each source's blocks are permuted, and each shard takes as many of them as its quota says, none of them twice: a shard's size
   is exact to a block, and its mixture follows the whole one. Within a shard rows are shuffled by hash.

A document is cut where a block ends (cut="exact": targets are met to the word, and a long document is dealt to several shards) or goes whole
with the block that it begins in (cut="whole": the one that the target's end meets is taken if its middle is). The tables of blocks have at
most MOST_BLOCKS rows plus one for each source, whatever the input; sources are a table that one task orders.

Null text counts as no words; a null source is a source of its own, after the others. Documents without words are returned and never
taken. Rows that repeat an id are documents of their own, ordered by their text's hash; equal rows are interchangeable. All is a
function of ids, texts, sources and the seed: reruns agree. Extra columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Stored, documents, word_count, word_list

WEIGHTS = (5, 2, 1)
MOST = 3
SHARDS = 16
MOST_BLOCKS = 8192
#: Words that a block has at least.
LEAST_BLOCK = 512
#: Blocks broadcast at most; there are more only with very many sources.
MOST_BROADCAST = 200_000
#: Hex digits of the permutation that name a slice, for up to 2 ** 30 documents; one more for every sixteenfold.
SLICE_DIGITS = 3


def _permuted(seed: str, *parts: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(seed), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]).cast("binary"))


def _key(source: Column) -> Column:
    """A source as text that is never null, so that joins and windows by it are alike."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = 1.0, most: int = MOST) -> DataFrame:
    """sizes: source, source_size -> with weight and target. The table has one row per source; its windows see nothing else."""
    order = Window.orderBy(F.col("source").isNull(), "source")
    w = sizes.withColumn("__r", F.row_number().over(order) - 1)
    weight = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("__r") % len(weights) + 1).cast("int"))
    w = w.withColumn("weight", weight).withColumn("__cap", F.col("source_size") * most)
    fill = Window.orderBy(F.col("__cap") / F.col("weight"), "__r")
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    w = w.withColumns(
        {
            "__budget": F.sum("source_size").over(every) * F.lit(share),
            "__capped": F.coalesce(F.sum("__cap").over(before), F.lit(0)),
            "__rest": F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
        }
    )
    w = w.withColumn("__level", (F.col("__budget") - F.col("__capped")) / F.col("__rest"))
    level = F.min(F.when(F.col("__level") <= F.col("__cap") / F.col("weight"), F.struct((F.col("__cap") / F.col("weight")).alias("k"), F.col("__r").alias("r"), F.col("__level").alias("v")))).over(every)["v"]
    return w.withColumn("__fill", level).select(
        "source", "source_size", "weight", F.least(F.col("__cap").cast("double"), F.coalesce(F.col("__fill") * F.col("weight"), F.col("__cap").cast("double"))).alias("target")
    )


def splitting_tree(quotas: DataFrame, shards: int = SHARDS, seed: str = "mix") -> DataFrame:
    """quotas: source, n_blocks -> source, shard, n_blocks. Each level sends half of every node's blocks left, drawn without replacement."""
    levels = max(0, (shards - 1).bit_length())
    if 1 << levels != shards:
        raise ValueError("shards must be a power of two")
    t = quotas.filter("n_blocks > 0").select("source", F.lit(0).alias("shard"), F.col("n_blocks").cast("long").alias("n_blocks"))
    for level in range(levels):
        urn = t.select("source", "shard", "n_blocks", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n_blocks"))).alias("i"))
        node = Window.partitionBy("shard")
        drawn = node.orderBy(_permuted(f"{seed}/{level}", F.col("shard"), F.col("source"), F.col("i")), F.col("source").isNull(), "source", "i")
        urn = urn.withColumns({"__n": F.count(F.lit(1)).over(node), "__k": F.row_number().over(drawn)})
        # An odd block falls to either side, by the node's number.
        half = F.floor((F.col("__n") + (F.col("shard") + level) % 2) / 2)
        split = urn.groupBy("source", "shard", "n_blocks").agg(F.count_if(F.col("__k") <= half).alias("left"))
        sides = F.array(F.struct((F.col("shard") * 2).alias("shard"), F.col("left").alias("n_blocks")), F.struct((F.col("shard") * 2 + 1).alias("shard"), (F.col("n_blocks") - F.col("left")).alias("n_blocks")))
        t = split.select("source", F.explode(sides).alias("s")).select("source", "s.shard", "s.n_blocks").filter("n_blocks > 0")
    return t


def draw_blocks(tree: DataFrame, seed: str = "mix") -> DataFrame:
    """tree: source, shard, n_blocks -> source, block, shard: the source's blocks, permuted, as many for each shard as it is due."""
    within = Window.partitionBy("source")
    due = tree.withColumn("__end", F.sum("n_blocks").over(within.orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)))
    places = due.select("source", "shard", F.explode(F.sequence(F.col("__end") - F.col("n_blocks") + 1, F.col("__end"))).alias("place"))
    blocks = tree.groupBy("source").agg(F.sum("n_blocks").alias("n")).select("source", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("block"))
    blocks = blocks.withColumn("place", F.row_number().over(within.orderBy(_permuted(f"{seed}/block", F.col("source"), F.col("block")), "block")).cast("long"))
    p = places.withColumnsRenamed({"source": "__ds", "place": "__dp"})
    return blocks.join(p, F.col("source").eqNullSafe(F.col("__ds")) & (F.col("place") == F.col("__dp"))).select("source", "block", "shard")


def mix(docs: DataFrame, text: str = "text", source: str = "source", id_column: str = "doc_id", weights=WEIGHTS, share: float = 1.0, most: int = MOST, shards: int = SHARDS, seed: str = "mix", cut: str = "exact", keep: list[str] | None = None) -> DataFrame:
    """One row for each piece drawn, and one with copy null for a document not taken: __row (docs' columns, or those to keep), key (which
    document, as struct), size, source_size, target, copies (how many it has), copy (from 0), skip (words of the copy before the piece), words
    (taken in it), block, shard, shuffle_key."""
    digits = SLICE_DIGITS + max(0, -(-(docs.count().bit_length() - 30) // 4))
    base = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in keep or docs.columns]).alias("__row"),
        F.col(f"`{source}`").alias("source"),
        word_count(F.col(f"`{text}`")).alias("size"),
        _permuted(seed, F.col(f"`{id_column}`")).alias("perm"),
        F.xxhash64(F.col(f"`{text}`"), F.col(f"`{id_column}`")).alias("tie"),
    ).withColumns({"slice": F.substring("perm", 1, digits), "of": _key(F.col("source"))})
    stored = Stored(docs.sparkSession, "mix")
    slices = stored.put(base.groupBy("of", "slice").agg(F.sum("size").alias("slice_size")))
    ahead = Window.partitionBy("of").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    name = F.when(F.col("of") != "", F.expr("substring(of, 2)")).cast(docs.schema[source].dataType)
    sums = slices.groupBy("of").agg(F.sum("slice_size").alias("source_size")).select(name.alias("source"), "source_size")
    targets = source_targets(sums, weights, share, most).withColumn("take", F.round("target").cast("long"))
    block_words = F.greatest(F.lit(LEAST_BLOCK), F.ceil(F.sum("take").over(Window.partitionBy()) / F.lit(MOST_BLOCKS))).cast("long")
    targets = targets.withColumn("block_words", block_words)
    plan = slices.withColumn("slice_start", F.coalesce(F.sum("slice_size").over(ahead), F.lit(0))).drop("slice_size")
    plan = plan.join(targets.withColumn("of", _key(F.col("source"))).drop("source"), "of")
    # The join and the window share one shuffle of the documents.
    here = base.join(plan, ["of", "slice"])
    within = Window.partitionBy("of", "slice").orderBy("perm", "tie", "size")
    here = here.withColumns({"n": F.row_number().over(within), "start": F.col("slice_start") + F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")})
    # Copy c of a document lies at c * source_size + start on the source's line, of which the first `take` words are taken.
    first = lambda c: c * F.col("source_size") + F.col("start")
    words = lambda c: F.least(F.col("size"), F.col("take") - first(c))
    block = lambda at: F.floor(at / F.col("block_words")).cast("long")
    passes = F.when((F.col("size") > 0) & (F.col("take") > F.col("start")), F.floor((F.col("take") - F.col("start") - 1) / F.col("source_size")).cast("int"))
    copies = F.when(passes.isNull(), F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), passes))
    if cut == "whole":
        copies = F.filter(copies, lambda c: words(c) * 2 >= F.col("size"))
        piece = lambda c, b: F.struct(c.alias("copy"), b.alias("block"), F.lit(0).cast("long").alias("skip"), F.col("size").alias("words"))
        pieces = lambda c: F.array(piece(c, block(first(c))))
    else:
        end = lambda c: first(c) + words(c)
        begin = lambda c, b: F.greatest(first(c), b * F.col("block_words"))
        piece = lambda c, b: F.struct(c.alias("copy"), b.alias("block"), (begin(c, b) - first(c)).alias("skip"), (F.least(end(c), (b + 1) * F.col("block_words")) - begin(c, b)).alias("words"))
        pieces = lambda c: F.transform(F.sequence(block(first(c)), block(end(c) - 1)), lambda b: piece(c, b))
    here = here.withColumn("__c", copies)
    out = here.select("*", F.size("__c").alias("copies"), F.explode_outer(F.flatten(F.transform("__c", pieces))).alias("__p")).select("*", "__p.*").drop("__c", "__p")
    quotas = targets.select("source", F.ceil(F.col("take") / F.col("block_words")).alias("n_blocks"))
    drawn = stored.put(draw_blocks(splitting_tree(quotas, shards, seed), seed).select(_key(F.col("source")).alias("of"), "block", "shard"))
    if drawn.count() <= MOST_BROADCAST:
        drawn = F.broadcast(drawn)
    out = out.join(drawn, ["of", "block"], "left")
    return out.select(
        "__row",
        F.struct("source", "slice", "n").alias("key"),
        *["size", "source_size", "target", "copies", "copy", "skip", "words", "block", "shard"],
        _permuted(f"{seed}/order", F.col("perm"), F.col("copy"), F.col("skip")).alias("shuffle_key"),
    )


def piece_text(text: Column, skip: Column, words: Column) -> Column:
    """A piece's words, by single spaces."""
    return F.array_join(F.slice(word_list(text), skip.cast("int") + 1, words.cast("int")), " ")


def shuffled(mixed: DataFrame) -> DataFrame:
    """The pieces drawn, shard by shard, each in its shuffled order, over as many partitions as the session has."""
    return mixed.filter("copy IS NOT NULL").repartitionByRange("shard", "shuffle_key").sortWithinPartitions("shard", "shuffle_key")


def write_mix(mixed: DataFrame, path: str) -> None:
    """The pieces drawn as one folder for each shard, in the shard's shuffled order: row (the document's columns) and piece (copy, skip, words)."""
    shuffled(mixed).select("shard", F.col("__row").alias("row"), F.struct("copy", "skip", "words").alias("piece")).write.partitionBy("shard").parquet(path)


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies, shards (words taken by shard, as "3:120 7:40"), for every document."""
    m = mix(documents(spark, sf_dir).select("doc_id", "source", "text"), keep=["doc_id"])
    row = ["size", "source_size", "target", "copies"]
    by_shard = m.groupBy("key", "shard").agg(F.first("__row.doc_id").alias("doc_id"), *[F.first(c).alias(c) for c in row], F.sum("words").alias("words"))
    one = by_shard.groupBy("key").agg(
        F.first("doc_id").alias("doc_id"),
        *[F.first(c).alias(c) for c in row],
        F.coalesce(F.sum("words"), F.lit(0)).cast("long").alias("taken"),
        F.array_sort(F.collect_list(F.when(F.col("shard").isNotNull(), F.struct("shard", "words")))).alias("s"),
    )
    shards = F.array_join(F.transform("s", lambda x: F.concat_ws(":", x["shard"].cast("string"), x["words"].cast("string"))), " ")
    return one.select("doc_id", "size", "source_size", "target", "taken", F.col("copies").cast("long").alias("copies"), shards.alias("shards"))


def _tree_sql(shards: int = SHARDS, seed: str = "mix") -> str:
    """The tree's levels and the draw, over q(source, n)."""
    name = "coalesce(CAST(source AS VARCHAR), '')"
    out = "t0 AS (SELECT source, CAST(0 AS BIGINT) AS shard, n FROM q WHERE n > 0)"
    for level in range((shards - 1).bit_length()):
        out += f""",
u{level} AS (SELECT source, shard, n, row_number() OVER (PARTITION BY shard ORDER BY md5('{seed}/{level}:' || shard || ':' || {name} || ':' || i), source IS NULL, source, i) AS k,
       count(*) OVER (PARTITION BY shard) AS cnt FROM t{level}, unnest(range(1, n + 1)) AS r(i)),
l{level} AS (SELECT source, shard, n, count(*) FILTER (k <= (cnt + (shard + {level}) % 2) // 2) AS l FROM u{level} GROUP BY source, shard, n),
t{level + 1} AS (SELECT * FROM (SELECT source, shard * 2 AS shard, l AS n FROM l{level} UNION ALL SELECT source, shard * 2 + 1, n - l FROM l{level}) WHERE n > 0)"""
    last = f"t{(shards - 1).bit_length()}"
    return out + f""",
due AS (SELECT source, shard, n, sum(n) OVER (PARTITION BY source ORDER BY shard) AS e FROM {last}),
places AS (SELECT source, shard, place FROM due, unnest(range(CAST(e - n + 1 AS BIGINT), CAST(e + 1 AS BIGINT))) AS r(place)),
blocks AS (SELECT source, block, row_number() OVER (PARTITION BY source ORDER BY md5('{seed}/block:' || {name} || ':' || block), block) AS place
       FROM (SELECT source, CAST(sum(n) AS BIGINT) AS n FROM {last} GROUP BY source), unnest(range(0, n)) AS r(block)),
drawn AS (SELECT b.source, b.block, p.shard FROM blocks b JOIN places p ON b.source IS NOT DISTINCT FROM p.source AND b.place = p.place)"""


_SQL = f"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
        md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS perm FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CAST([5, 2, 1][1 + (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3] AS DOUBLE) AS weight, {MOST} * source_size AS cap FROM s),
f AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level
      FROM w WINDOW b AS (ORDER BY cap / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
v AS (SELECT level AS fill FROM f WHERE level <= cap / weight ORDER BY cap / weight, source IS NULL, source LIMIT 1),
t AS (SELECT source, source_size, least(CAST(cap AS DOUBLE), coalesce((SELECT fill FROM v) * weight, CAST(cap AS DOUBLE))) AS target FROM w),
k AS (SELECT *, CAST(round(target) AS BIGINT) AS take FROM t),
bw AS (SELECT CAST(greatest({LEAST_BLOCK}, ceil(sum(take) / {MOST_BLOCKS})) AS BIGINT) AS b FROM k),
q AS (SELECT source, CAST(ceil(take / b) AS BIGINT) AS n FROM k, bw),
{_tree_sql()},
x AS (SELECT d.*, k.source_size, k.target, take, row_number() OVER () AS rid,
        CAST(sum(size) OVER (PARTITION BY d.source ORDER BY perm, d.doc_id) AS BIGINT) - size AS start
      FROM d JOIN k ON d.source IS NOT DISTINCT FROM k.source),
y AS (SELECT rid, source, c, c * source_size + start AS a, least(c * source_size + start + size, take) AS e FROM x, (VALUES (0), (1), (2)) AS z(c)
      WHERE size > 0 AND take > c * source_size + start),
p AS (SELECT rid, c, source, block, least(e, (block + 1) * b) - greatest(a, block * b) AS words FROM y, bw, unnest(range(a // b, (e - 1) // b + 1)) AS r(block)),
g AS (SELECT rid, shard, CAST(sum(words) AS BIGINT) AS words FROM p JOIN drawn ON p.source IS NOT DISTINCT FROM drawn.source AND p.block = drawn.block GROUP BY rid, shard),
o AS (SELECT rid, CAST(sum(words) AS BIGINT) AS taken, string_agg(shard || ':' || words, ' ' ORDER BY shard) AS shards FROM g GROUP BY rid),
n AS (SELECT rid, count(*) AS copies FROM y GROUP BY rid)
SELECT doc_id, size, source_size, target, coalesce(taken, 0) AS taken, coalesce(copies, 0) AS copies, coalesce(shards, '') AS shards
FROM x LEFT JOIN o USING (rid) LEFT JOIN n USING (rid)
"""

QUERIES = {"op9_mix_sources": op9_mix_sources}
ORACLES = {"op9_mix_sources": _SQL}
