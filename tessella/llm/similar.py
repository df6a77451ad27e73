"""Links between texts whose sets of word shingles have a Jaccard similarity or more.

Candidates share one of BANDS bands, each the minima of a set under ROWS hash functions: sets of similarity 0.8 share one with a
probability of 1 - (1 - 0.8 ** ROWS) ** BANDS, all but 7 in a million, more similar ones all the surer, however many rows there are. Whether
they are similar is then decided on the whole sets, before anything joins a group.

Links enough for the components are found without all pairs: each set is compared with the most central one that it shares a band with, the one
whose bands hold most sets, as the original of many copies does; where those links leave a band in several components, each is
compared with a set of another component there, the most central one first, then others. Of what is still apart after ROUNDS of that, or when
nothing new is found, all pairs are compared that share one of the first hashes of their sets, ordered from the rarest among these sets to the most
frequent: sets of n hashes that have the similarity share one of their first n - ceil(similarity * n) + 1 hashes, whatever the order, so
no such pair is missed, while sets that differ in more than that share none. Compared sets meet by salted joins, so a set that a third of all are compared with is no task's alone.

A text's shingles are hashed by differences of one polynomial over its words, A-Z in lower case and joined by single spaces; of
fewer words than a shingle the whole sequence is the one shingle. Texts without words are linked to nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Stored
from .components import connected_components

BANDS, ROWS = 30, 5
ROUNDS = 3
#: Keys broadcast at most.
MOST_BROADCAST = 200_000
#: Sets compared with one set in a task.
TOGETHER = 512
#: Bytes of a text worked on at once.
STRETCH = 1 << 20

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_rng = np.random.default_rng(20)
_TIMES = _rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the polynomial's base and of its inverse, modulo 2 ** 64."""
    if len(_powers[0]) < n:
        size = max(n, 2 * len(_powers[0]), 1 << 14)
        for i, base in enumerate((_BASE, _INVERSE)):
            each = np.full(size, base, np.uint64)
            each[0] = 1
            _powers[i] = np.multiply.accumulate(each)
    return _powers[0][:n], _powers[1][:n]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def shingles(tokens: list[bytes], words: int) -> np.ndarray:
    """Distinct hashes of a text's shingles, sorted."""
    n = len(tokens)
    if not n:
        return np.zeros(0, np.uint64)
    k = min(words, n)
    sizes = np.fromiter(map(len, tokens), np.int64, n) + 1
    ends = np.cumsum(sizes) - 1
    starts = ends + 1 - sizes
    out, first = [], 0
    while first + k <= n:
        # The shingles that begin within a stretch, and one at least.
        last = max(first + 1, min(n - k + 1, int(np.searchsorted(ends, starts[first] + STRETCH))))
        some = np.frombuffer(b" ".join(tokens[first : last + k - 1]), np.uint8)
        up, down = powers(len(some) + 1)
        sums = np.zeros(len(some) + 1, np.uint64)
        np.cumsum((some.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
        a, b = starts[first:last] - starts[first], ends[first + k - 1 : last + k - 1] - starts[first]
        out.append(mixed((sums[b] - sums[a]) * down[a]))
        first = last
    return np.unique(np.concatenate(out))


def bands(s: np.ndarray) -> np.ndarray:
    """One number for each band of a set."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(s), 512):
        np.minimum(least, (s[at : at + 512, None] * _TIMES + _PLUS).min(axis=0), out=least)
    out = np.arange(1, BANDS + 1, dtype=np.uint64)
    for row in least.reshape(BANDS, ROWS).T:
        out = mixed(out * np.uint64(_BASE) ^ row)
    return out.view(np.int64)


def tokens_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def set_key(s: np.ndarray) -> int:
    return np.uint64(xxhash.xxh64_intdigest(s.tobytes())).view(np.int64).item()


def sets_of(docs: DataFrame, words: int) -> DataFrame:
    """docs: sk, __text -> sk, s: the hashes of the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            each = [shingles(tokens_of(t), words).view(np.int64) for t in batch.column(1).to_pylist()]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in each])]).astype(np.int32)
            flat = pa.array(np.concatenate(each) if each else np.zeros(0, np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), flat)], names=["sk", "s"])

    return docs.mapInArrow(run, "sk bigint, s array<bigint>")


class Similar:
    """boxed: __id, __th (hash of the text), __text; rows: __id, __th, __fp, sk (hash of the set), n (its size), bands."""

    def __init__(self, boxed: DataFrame, rows: DataFrame, stored: Stored, words: int, similarity: float):
        self.boxed, self.stored, self.words, self.similarity = boxed, stored, words, similarity
        some = rows.filter("n > 0")
        key = F.struct(F.col("__id").alias("i"), F.col("__th").alias("t"))
        texts = some.groupBy("sk").agg(F.min(key).alias("key"), F.min("__fp").alias("fp"), F.max("__fp").alias("most"), F.first("n").alias("n"), F.first("bands").alias("bands"))
        self.texts = stored.put(texts)
        several = self.texts.filter("fp < most").select("sk", "fp")
        self.equal = stored.put(some.select("sk", "__fp").join(several, "sk").select(F.col("__fp").alias("a"), F.col("fp").alias("b")).distinct())
        met = self.texts.select("sk", "fp", "n", F.explode("bands").alias("h"))
        shared = met.groupBy("h").agg(F.count(F.lit(1)).alias("sets")).filter("sets > 1")
        met = stored.put(met.join(shared, "h"))
        # How central a set is: how many sets its bands hold.
        central = met.groupBy("sk").agg(F.sum("sets").alias("w"))
        self.met = stored.put(met.drop("sets").join(central, "sk"))
        stored.drop(met)
        # The sets that any comparison may need, from the texts in one pass.
        self.held = self.sets(self.met.select("sk").distinct())
        self.tried: DataFrame | None = None

    def side(self, df: DataFrame, x: str) -> DataFrame:
        names = {"sk": "s", "fp": "f", "n": "n", "w": "w", "root": "r", "pos": "p"}
        return df.select("h", *[F.col(c).alias(f"{d}{x}") for c, d in names.items() if c in df.columns])

    def sized(self, pairs: DataFrame) -> DataFrame:
        """Pairs whose sizes allow the similarity."""
        return pairs.filter(F.least("na", "nb") >= F.lit(self.similarity) * F.greatest("na", "nb") - F.lit(1e-6))

    def one(self, pairs: DataFrame) -> DataFrame:
        """Of each set's pairs the one with the most central set."""
        return pairs.groupBy("sa", "fa").agg(F.max(F.struct("wb", "sb", "fb")).alias("o")).select("sa", "fa", "o.sb", "o.fb")

    def first(self) -> DataFrame:
        """Links of each set with the most central one that it shares a band with."""
        most = self.met.groupBy("h").agg(F.max(F.struct("w", "sk", "fp", "n")).alias("m")).select("h", "m.*")
        return self.checked(self.one(self.sized(self.side(self.met, "a").join(self.side(most, "b"), "h").filter("sa <> sb"))))

    def placed(self, roots: DataFrame) -> DataFrame:
        """met with each set's component, of the bands that have several."""
        met = self.met.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
        several = met.groupBy("h").agg(F.min("root").alias("x"), F.max("root").alias("y")).filter("x < y").select("h")
        out = self.stored.put(met.join(several, "h").select("sk", "fp", "n", "w", "h", "root"))
        self.met = out.drop("root")
        return out

    def again(self, met: DataFrame, turn: int) -> DataFrame:
        """Links of each set with one of another component that its bands lead to: the most central at first, others at later turns."""
        if turn > 1:
            met = met.withColumn("w", F.xxhash64("sk", F.lit(turn)))
        of_root = met.groupBy("h", "root").agg(F.max(F.struct("w", "sk", "fp", "n")).alias("m"))
        top = of_root.groupBy("h").agg(F.max(F.struct("m", "root")).alias("t"))
        next_to = of_root.join(top, "h").filter(F.col("root") != F.col("t.root")).groupBy("h").agg(F.max(F.struct("m", "root")).alias("t"))
        ends = top.unionByName(next_to).select("h", "t.m.*", "t.root")
        return self.checked(self.one(self.sized(self.side(met, "a").join(self.side(ends, "b"), "h").filter("ra <> rb"))))

    def every(self, met: DataFrame) -> DataFrame:
        """Links of all these sets that are in different components and have the similarity, by the first hashes of each."""
        some = self.stored.put(met.groupBy("sk").agg(F.first("fp").alias("fp"), F.first("n").alias("n"), F.first("root").alias("root")))
        each = self.stored.put(self.held.join(some.select("sk"), "sk", "left_semi").select("sk", F.explode("s").alias("h")))
        often = each.groupBy("h").agg(F.count(F.lit(1)).alias("sets")).filter("sets > 1")
        of = Window.partitionBy("sk")
        # Hashes that one set alone has come first and meet nothing.
        heads = each.join(often, "h").withColumns({"shared": F.count(F.lit(1)).over(of), "pos": F.row_number().over(of.orderBy("sets", "h"))}).join(some, "sk")
        heads = heads.withColumn("pos", F.col("n") - F.col("shared") + F.col("pos")).filter(F.col("pos") <= F.col("n") - F.ceil(F.lit(self.similarity) * F.col("n") - F.lit(1e-9)) + 1)
        heads = self.stored.put(heads.select("h", "sk", "fp", "n", "root", "pos"))
        pairs = self.sized(self.side(heads, "a").join(self.side(heads, "b"), "h").filter("sa < sb AND ra <> rb"))
        # What two sets can share from their first common hash on.
        share = F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb")) + 1
        return self.checked(pairs.filter(share >= F.lit(self.similarity / (1 + self.similarity)) * (F.col("na") + F.col("nb")) - F.lit(1e-6)))

    def sets(self, keys: DataFrame) -> DataFrame:
        """keys: sk -> sk, s: the hashes of these sets, from the texts."""
        keys = self.stored.put(self.texts.join(keys, "sk").select("sk", F.col("key").alias("__key")))
        if keys.count() <= MOST_BROADCAST:
            keys = F.broadcast(keys)
        texts = self.boxed.select(F.struct(F.col("__id").alias("i"), F.col("__th").alias("t")).alias("__key"), "__text").join(keys, "__key").select("sk", "__text")
        # Rows that repeat id and text give the same set.
        return self.stored.put(sets_of(texts, self.words).groupBy("sk").agg(F.first("s").alias("s")))

    def checked(self, pairs: DataFrame) -> DataFrame:
        """a, b: the fingerprints of those pairs (sa, fa, sb, fb) whose sets have the similarity. A set met by many is salted."""
        turn = F.col("sa") < F.col("sb")
        pick = lambda c: [F.when(turn, F.col(f"{c}a")).otherwise(F.col(f"{c}b")).alias(f"{c}a"), F.when(turn, F.col(f"{c}b")).otherwise(F.col(f"{c}a")).alias(f"{c}b")]
        pairs = pairs.select(*pick("s"), *pick("f")).distinct()
        if self.tried is not None:
            pairs = pairs.join(self.tried, ["sa", "sb"], "left_anti")
        pairs = self.stored.put(pairs)
        done = pairs.select("sa", "sb")
        self.tried = done if self.tried is None else self.tried.unionByName(done)
        both = pairs
        for x, other, name in (("sb", "sa", "tb"), ("sa", "sb", "ta")):
            loads = pairs.groupBy(x).agg(F.ceil(F.count(F.lit(1)) / TOGETHER).cast("int").alias("salts"))
            sets = self.held.join(loads, F.col("sk") == F.col(x)).select(x, F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("s").alias(name))
            both = both.join(loads, x).withColumn("salt", F.pmod(F.xxhash64(other), F.col("salts")).cast("int")).drop("salts").join(sets, [x, "salt"]).drop("salt")
        shared = F.size(F.array_intersect("ta", "tb"))
        alike = shared >= F.lit(self.similarity) * (F.size("ta") + F.size("tb") - shared) - F.lit(1e-9)
        return self.stored.put(both.filter(alike).select(F.col("fa").alias("a"), F.col("fb").alias("b")))

    def components(self, found: DataFrame) -> DataFrame:
        """node, root of the components of `found` (a, b) and of all similar pairs."""
        found = self.stored.put(found.unionByName(self.equal).unionByName(self.first()))
        turn = 0
        while True:
            roots = connected_components(found, self.stored)
            met = self.placed(roots)
            if met.isEmpty():
                return roots
            turn += 1
            more = self.again(met, turn) if turn <= ROUNDS else self.every(met)
            if more.isEmpty() and turn <= ROUNDS:
                turn, more = ROUNDS + 1, self.every(met)
            if more.isEmpty():
                return roots
            found = roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more)
            if turn > ROUNDS:
                return connected_components(found, self.stored)
