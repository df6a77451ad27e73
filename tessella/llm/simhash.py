"""SimHash near-dedup with sharded BK-trees.

Fingerprints: 64 bits by majority over the XXH64 (seed 42) of a text's word shingles, A-Z in lower case. Two fingerprints link at
RADIUS or fewer differing bits; components of links are groups of near copies.

Linking works on distinct fingerprints. The 64 bits are cut into `blocks` parts; two fingerprints within RADIUS agree on at least
blocks - RADIUS of them, so every choice of that many parts and the bits they hold names a shard, and each link lies within one shard
at least. Each shard's fingerprints make a BK-tree, searched along edges within the radius only. A shard of more than TREE_SIZE
fingerprints is cut by more of its bits in the same way; what still holds more is split into trees of about that size, and its fingerprints are
sent to all of them as queries, so no tree outgrows a task. Trees are sent to their shard's queries by a shuffle rather than from the
driver, for together they hold every fingerprint.
A tree returns each of its nodes with a representative, never all pairs, and components are then found on tables.

Null, empty or blank text has fingerprint zero and links like any other. Fewer words than a shingle: the whole sequence is the one
shingle. Rows that repeat an id keep a row each; a null id counts in no component's smallest id unless all are null. Extra columns
pass through keep_one() untouched.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bktree import BKTree, Groups
from .common import Stored, arrow_batches, documents
from .components import connected_components
from .similar import BANDS, Similar, bands, set_key, shingles, tokens_of

RADIUS = 3
WORDS = 3
SEED = 42
TREE_SIZE = 4096
#: Keys of rows that go or repeat, broadcast at most.
MOST_ODD = 200_000


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """The unsigned fingerprint of one text."""
    return fingerprint_of(tokens_of(text), words)


def fingerprint_of(tokens: list[bytes], words: int = WORDS) -> int:
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    n = len(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, n) + 1)
    starts = (ends - np.fromiter(map(len, tokens), np.int64, n) - 1).tolist()
    ends = (ends - 1).tolist()
    k = min(words, n)
    digest = xxhash.xxh64_digest
    raw = b"".join([digest(joined[s:e], SEED) for s, e in zip(starts[: n - k + 1], ends[k - 1 :], strict=True)])
    total = n - k + 1
    ones = np.zeros(64, np.int64)
    # In stretches, so that a very long text's bits never lie in memory at once; 255 rows of bits sum in a byte.
    step = 255 * 64
    every = np.frombuffer(raw, np.uint8).reshape(total, 8)
    for at in range(0, total, step):
        bits = np.unpackbits(every[at : at + step], axis=1)
        full = len(bits) // 255 * 255
        if full:
            ones += bits[:full].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        if full < len(bits):
            ones += bits[full:].sum(axis=0, dtype=np.uint8)
    return int.from_bytes(np.packbits(ones * 2 > total).tobytes(), "big")


def fingerprints(docs: DataFrame, text: str = "text", words: int = WORDS) -> DataFrame:
    """docs with the text replaced by __fp, the fingerprint as a signed bigint."""
    arrow_batches(docs.sparkSession)
    others = [c for c in docs.columns if c != text]
    schema = docs.select(*[f"`{c}`" for c in others]).withColumn("__fp", F.lit(0).cast("bigint")).schema
    body = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(t, words) for t in batch.column(body).to_pylist()), np.uint64, batch.num_rows).view(np.int64)
            columns = [batch.column(i) for i in range(batch.num_columns) if i != body]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(fps)], names=[*others, "__fp"])

    return docs.mapInArrow(run, schema)


def parts_for(count: int, radius: int = RADIUS) -> int:
    """How many parts the bits are cut into: enough that a shard of evenly spread fingerprints stays in the hundreds."""
    parts = radius + 1
    while count > 256 << (64 * (parts - radius) // parts) and parts < radius + 4:
        parts += 1
    return parts


def shard_masks(parts: int, radius: int = RADIUS) -> list[int]:
    """The bits that each choice of parts - radius parts holds, as signed 64-bit masks."""
    cuts = [round(64 * i / parts) for i in range(parts + 1)]
    blocks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in pairwise(cuts)]
    masks = [sum(c) for c in combinations(blocks, parts - radius)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def tree_links(radius: int):
    """A mapInArrow function over rows (mask, bits, tree, role, fp) sorted so: nodes of a tree (role 0), then its queries (1) -> a, b."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out_a: list[int] = []
        out_b: list[int] = []
        tree, groups, key = BKTree(), Groups(), None
        unsigned = (1 << 64) - 1

        def close() -> None:
            for i, v in enumerate(tree.values):
                r = groups.root(i)
                if r != i:
                    out_a.append(v)
                    out_b.append(tree.values[r])

        for batch in batches:
            masks, bits, trees, roles, fps = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(5))
            n = len(fps)
            if not n:
                continue
            same = (masks[1:] == masks[:-1]) & (bits[1:] == bits[:-1]) & (trees[1:] == trees[:-1])
            starts = np.concatenate([[0], np.flatnonzero(~same) + 1, [n]]).tolist()
            for s, e in pairwise(starts):
                here = (masks[s], bits[s], trees[s])
                if here != key:
                    if len(tree.values) > 1:
                        close()
                    tree, groups, key = BKTree(), Groups(), here
                for value, role in zip(fps[s:e].tolist(), roles[s:e].tolist(), strict=True):
                    value &= unsigned
                    found = tree.within(value, radius) if tree.values else []
                    if role == 0:
                        me = tree.add(value)
                        groups.add()
                        for x in found:
                            groups.join(me, x)
                    elif found:
                        for x in found[1:]:
                            groups.join(found[0], x)
                        out_a.append(value)
                        out_b.append(tree.values[found[0]])
            if len(out_a) > 50_000:
                yield made(out_a, out_b)
                out_a, out_b = [], []
        if len(tree.values) > 1:
            close()
        yield made(out_a, out_b)

    def made(a: list[int], b: list[int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.array(x, np.uint64).view(np.int64)) for x in (a, b)], names=["a", "b"])

    return run


def finer_masks(mask: int, radius: int = RADIUS) -> list[int]:
    """Masks that hold more bits than `mask`, such that fingerprints within the radius that agree on it agree on one of them too."""
    free = [b for b in range(64) if not mask >> b & 1]
    parts = radius + 3
    blocks = [sum(1 << b for b in free[round(len(free) * i / parts) : round(len(free) * (i + 1) / parts)]) for i in range(parts)]
    masks = [(mask & (1 << 64) - 1) | sum(c) for c in combinations(blocks, parts - radius)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def sharded(keyed: DataFrame, stored: Stored) -> tuple[DataFrame, DataFrame]:
    """keyed: mask, bits, __fp -> the rows of shards with two at least, and those shards' counts."""
    keyed = stored.put(keyed)
    return keyed, stored.put(keyed.groupBy("mask", "bits").count().filter("count > 1"))


def links(distinct: DataFrame, masks: list[int], stored: Stored, radius: int = RADIUS, tree_size: int = TREE_SIZE) -> DataFrame:
    """distinct: __fp, each once -> a, b: links enough that their components are those of all links within a shard."""
    cells = lambda ms: F.explode(F.array(*[F.struct(F.lit(m).alias("mask"), F.col("__fp").bitwiseAND(F.lit(m)).alias("bits")) for m in ms]))
    keyed, counts = sharded(distinct.select("__fp", cells(masks).alias("c")).select("c.mask", "c.bits", "__fp"), stored)
    parts = [(keyed, counts)]
    if not counts.filter(F.col("count") > tree_size).isEmpty():
        # Shards that outgrow a tree are cut by more bits first; only what is still too large is split into several trees.
        large = keyed.join(counts.filter(F.col("count") > tree_size).select("mask", "bits"), ["mask", "bits"])
        more = large.filter(F.lit(False)).select("mask", "bits", "__fp")
        for m in masks:
            more = more.unionByName(large.filter(F.col("mask") == m).select("__fp", cells(finer_masks(m, radius)).alias("c")).select("c.mask", "c.bits", "__fp"))
        parts = [(keyed, counts.filter(F.col("count") <= tree_size)), sharded(more.distinct(), stored)]
    rows = None
    for keyed, counts in parts:
        some = keyed.join(counts.withColumn("trees", F.ceil(F.col("count") / tree_size).cast("int")).drop("count"), ["mask", "bits"])
        rows = some if rows is None else rows.unionByName(some)
    own = F.pmod(F.xxhash64("__fp"), F.col("trees")).cast("int")
    each = F.transform(F.sequence(F.lit(0), F.col("trees") - 1), lambda t: F.struct(t.alias("tree"), F.when(t == own, 0).otherwise(1).alias("role")))
    rows = rows.select("mask", "bits", F.explode(each).alias("t"), "__fp").select("mask", "bits", "t.tree", "t.role", "__fp")
    rows = rows.repartition("mask", "bits", "tree").sortWithinPartitions("mask", "bits", "tree", "role", "__fp")
    return rows.mapInArrow(tree_links(radius), "a bigint, b bigint")


def near_roots(distinct: DataFrame, stored: Stored, radius: int = RADIUS, tree_size: int = TREE_SIZE, components=connected_components) -> DataFrame:
    """distinct: __fp, each once -> node, root of the components, for every fingerprint that is linked to another."""
    found = links(distinct, shard_masks(parts_for(distinct.count(), radius), radius), stored, radius, tree_size)
    return components(found, stored)


def near_components(fps: DataFrame, stored: Stored, id_column: str = "doc_id", radius: int = RADIUS, tree_size: int = TREE_SIZE) -> DataFrame:
    """fps: id and __fp -> __fp, component_id (the smallest id reachable) for every distinct fingerprint."""
    classes = stored.put(fps.groupBy("__fp").agg(F.min(F.col(f"`{id_column}`")).alias("least")))
    roots = near_roots(classes.select("__fp"), stored, radius, tree_size)
    placed = classes.join(roots, classes["__fp"] == roots["node"], "left").select("__fp", "least", F.coalesce("root", "__fp").alias("root"))
    least = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    return placed.join(least, "root").select("__fp", "component_id")


def simhash_components(docs: DataFrame, text: str = "text", id_column: str = "doc_id", words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """id, fingerprint (16 hex digits), component_id for every row."""
    stored = Stored(docs.sparkSession, "simhash")
    fps = stored.put(fingerprints(docs.select(f"`{id_column}`", f"`{text}`"), text, words))
    comp = near_components(fps, stored, id_column, radius)
    return fps.join(comp, "__fp").select(id_column, F.lower(F.lpad(F.hex("__fp"), 16, "0")).alias("fingerprint"), "component_id")


def described(boxed: DataFrame, words: int, similar_words: int) -> DataFrame:
    """boxed: __id, __th, __text -> __id, __th, __fp, sk, n and bands (of the set of shingles), in one pass over the texts."""
    arrow_batches(boxed.sparkSession)
    schema = boxed.select("__id", "__th", *[F.lit(0).cast(t).alias(c) for c, t in (("__fp", "bigint"), ("sk", "bigint"), ("n", "int"))], F.array(F.lit(0).cast("bigint")).alias("bands")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, keys, sizes, each = [], [], [], []
            for text in batch.column(2).to_pylist():
                tokens = tokens_of(text)
                s = shingles(tokens, similar_words)
                fps.append(fingerprint_of(tokens, words))
                keys.append(set_key(s))
                sizes.append(len(s))
                each.append(bands(s))
            listed = pa.ListArray.from_arrays(pa.array(np.arange(0, len(each) * BANDS + 1, BANDS, dtype=np.int32)), pa.array(np.concatenate(each) if each else np.zeros(0, np.int64), pa.int64()))
            made = [pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(keys, pa.int64()), pa.array(sizes, pa.int32()), listed]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], names=["__id", "__th", "__fp", "sk", "n", "bands"])

    return boxed.mapInArrow(run, schema)


def keep_one(docs: DataFrame, text: str = "text", id_column: str = "doc_id", words: int = WORDS, radius: int = RADIUS, similar_words: int = 5, similarity: float | None = 0.8) -> DataFrame:
    """The row of each component with the smallest id (null last; of rows that repeat it, the one whose text hashes lowest), all columns kept.

    Beside the links of fingerprints, texts are linked whose sets of similar_words-word shingles have the similarity or more (see similar.py).
    Rows that repeat an id but aren't linked stay both; of rows that repeat id and text the one stays whose columns, written as JSON, come first."""
    stored = Stored(docs.sparkSession, "simhash")
    keyed = [F.col(f"`{id_column}`").alias("__id"), F.xxhash64(f"`{text}`").alias("__th")]
    boxed = docs.select(*keyed, F.col(f"`{text}`").alias("__text"))
    rows = stored.put(described(boxed, words, similar_words))
    of = lambda found, stored: Similar(boxed, rows, stored, similar_words, similarity).components(found)
    distinct = stored.put(rows.select("__fp").distinct())
    roots = near_roots(distinct, stored, radius, components=of if similarity else connected_components)
    placed = rows.join(roots, rows["__fp"] == roots["node"], "left").select("__id", "__th", F.coalesce("root", "__fp").alias("root"))
    key = F.struct(F.isnull("__id").alias("z"), F.col("__id").alias("i"), F.col("__th").alias("t"))
    placed = stored.put(placed.select("root", key.alias("__key")))
    picks = placed.groupBy("root").agg(F.min("__key").alias("pick"))
    # Keys whose rows go, and keys that several rows repeat: if they are few, the rows of all others stay where they are.
    marked = placed.join(picks, "root").groupBy("__key").agg(F.first(F.col("__key") == F.col("pick")).alias("stays"), F.count(F.lit(1)).alias("rows"))
    odd = stored.put(marked.filter("NOT stays OR rows > 1").select("__key", "stays"))
    least = F.min_by("__row", F.to_json("__row")).alias("__row")
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), F.struct(F.isnull(f"`{id_column}`").alias("z"), F.col(f"`{id_column}`").alias("i"), F.xxhash64(f"`{text}`").alias("t")).alias("__key"))
    if odd.count() <= MOST_ODD:
        plain = whole.join(F.broadcast(odd), "__key", "left_anti").select("__row.*")
        twins = whole.join(F.broadcast(odd.filter("stays").select("__key")), "__key").groupBy("__key").agg(least).select("__row.*")
        return plain.unionByName(twins)
    return whole.join(picks.select(F.col("pick").alias("__key")), "__key").groupBy("__key").agg(least).select("__row.*")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(documents(spark, sf_dir).select("doc_id", "text"))


QUERIES = {"op1_simhash": op1_simhash}
ORACLES: dict[str, str] = {}
