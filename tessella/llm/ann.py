"""Approximate nearest neighbours by an adaptive scan of dimensions.

Vectors are scaled to length one, so that the largest cosine is the least distance, and rotated by a random orthogonal matrix, after
which the first few of D dimensions estimate a distance: after b of them the partial square times D / b. Vectors lie in inverted lists
around centroids, which are fitted to a bounded sample; every vector is in a list, and the lists grow in number with the vectors: beyond
FINE_FROM of them each centroid's list is cut by a second set of centroids, fitted to what the first leaves over, and a query looks below its nearest
centroids of the first level only, as many as the sample shows to be needed. A query probes the lists of its nearest
centroids, as many as brute force within the sample shows to hold TARGET of the neighbours; within a list the columns are read in blocks,
and after each a hypothesis test abandons a candidate whose estimate exceeds the fifth-best distance found by more than chance explains,
sqrt(estimate) > (1 + EPSILON / sqrt(b)) * sqrt(threshold). Survivors are ranked by the cosine of the original vectors in double
precision, each scaled by a power of two first, which changes no digit and keeps squares in range.

A list is cut into cells of CELL candidates, and its queries into groups of QUERIES_AT_ONCE, so a list with a third of all vectors is
many tasks' work. Vectors that are null, zero, or hold a null or non-finite component take no part. Vectors of different lengths have no cosine: each
length has an index of its own, sample and lists included; beyond MOST_LENGTHS lengths the vectors of the rarest are compared with all queries of theirs. A query is a row: rows that repeat an id are
queries and candidates each, and a query's own row alone is none of its candidates. Equal vectors rank by id, a null id last.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Stored

K = 5
EVERY = 50
EPSILON = 2.1
SAMPLE = 20_000
#: Lists of either level at most; vectors in a list, if there are many; lists from which on there are two levels.
MOST_LISTS = 1024
LIST_SIZE = 1000
FINE_FROM = 1000
#: Lengths of vectors that are indexed, the most frequent first; of others all are compared with all queries of their length.
MOST_LENGTHS = 32
#: Rows about lists that are broadcast at most.
MOST_CELLS = 1 << 20
#: Of a sampled query's neighbours within the sample, the share whose lists must be probed; lists are added until it is met.
TARGET = 0.985
CALIBRATION = 256
LEAST_PROBED = 8
CELL = 4096
QUERIES_AT_ONCE = 4096
BLOCKS = (0.125, 0.25, 0.5, 1.0)


def usable(vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """row, vec_id, v (array<double>) of those that take part."""
    v = vectors.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_column}`").cast("bigint").alias("vec_id"), F.col(f"`{column}`").cast("array<double>").alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return v.filter(F.col("v").isNotNull() & fine)


def scaled(v: np.ndarray) -> np.ndarray:
    """Each vector by the power of two that brings its largest component between a half and one."""
    return np.ldexp(v, -np.frexp(np.abs(v).max(axis=1, keepdims=True))[1])


def units(v: np.ndarray) -> np.ndarray:
    v = scaled(v)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def rotation(d: int, seed: int = 7) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def fit_centroids(sample: np.ndarray, lists: int, rounds: int = 12, seed: int = 11, spherical: bool = True) -> np.ndarray:
    """k-means; a centroid that loses all members keeps its place."""
    rng = np.random.default_rng(seed)
    c = sample[rng.choice(len(sample), lists, replace=False)].copy()
    for _ in range(rounds):
        half = 0.0 if spherical else (c * c).sum(axis=1) / 2
        near = np.concatenate([np.argmax(sample[i : i + 4096] @ c.T - half, axis=1) for i in range(0, len(sample), 4096)])
        sums = np.zeros_like(c)
        np.add.at(sums, near, sample)
        size = np.sqrt((sums * sums).sum(axis=1, keepdims=True)) if spherical else np.bincount(near, minlength=lists)[:, None].astype(float)
        c = np.where(size > 1e-12, sums / np.maximum(size, 1e-12), c)
    return c


class Lists:
    """Centroids of one or two levels; a list's number is the first level's times those of the second, and the second's."""

    def __init__(self, sample: np.ndarray, count: int):
        most = min(MOST_LISTS, max(1, len(sample) // 20))
        two = count > max(FINE_FROM, most)
        # Means, not directions, where a second level goes on from what the first leaves over.
        self.first = fit_centroids(sample, min(count, most), spherical=not two)
        self.second = np.zeros((1, sample.shape[1]))
        self.own = (self.first * self.first).sum(axis=1) / 2
        if two:
            rest = sample - self.first[np.argmax(sample @ self.first.T - self.own, axis=1)]
            self.second = fit_centroids(rest, min(-(-count // len(self.first)), most), spherical=False)
        # Half the square of a list's centre.
        self.half = self.first @ self.second.T + (self.second * self.second).sum(axis=1) / 2 + self.own[:, None]
        # How many centroids of the first level a query goes down from.
        self.coarse = len(self.first)

    def __len__(self) -> int:
        return len(self.first) * len(self.second)

    def home(self, v: np.ndarray) -> np.ndarray:
        out = []
        for i in range(0, len(v), 4096):
            x = v[i : i + 4096]
            a = np.argmax(x @ self.first.T - self.own, axis=1)
            out.append(a * len(self.second) + np.argmax(x @ self.second.T - self.half[a], axis=1))
        return np.concatenate(out) if out else np.zeros(0, np.int64)

    def descend(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The lists below the nearest centroids of the first level, and how near they are, the larger the nearer."""
        level = self.first @ q
        top = np.argpartition(-(level - self.own), self.coarse - 1)[: self.coarse] if self.coarse < len(level) else np.arange(len(level))
        near = level[top, None] + (self.second @ q)[None, :] - self.half[top]
        return (top[:, None] * len(self.second) + np.arange(len(self.second))[None, :]).ravel(), near.ravel()

    def nearest(self, q: np.ndarray, probes: int) -> np.ndarray:
        lists, near = self.descend(q)
        some = np.argpartition(-near, probes - 1)[:probes] if probes < len(near) else np.arange(len(near))
        return lists[some[np.lexsort((lists[some], -near[some]))]]

    def probes_for(self, sample: np.ndarray, k: int, target: float = TARGET, seed: int = 13) -> int:
        """How many lists to probe, measured by brute force among the sample; of two levels also how many of the first to go down from."""
        if len(self) <= LEAST_PROBED or len(sample) <= k:
            return len(self)
        some = np.random.default_rng(seed).choice(len(sample), min(CALIBRATION, len(sample)), replace=False)
        home, pairs = self.home(sample), []
        for i in some.tolist():
            sims = sample @ sample[i]
            sims[i] = -np.inf
            pairs += [(i, h) for h in home[np.argpartition(-sims, k - 1)[:k]].tolist()]
        most = lambda ranks, share: sorted(ranks)[min(len(ranks) - 1, int(np.ceil(share * len(ranks))) - 1)] + 1
        if len(self.second) > 1:
            # The first level alone may lose half of what may be lost.
            above = {i: self.first @ sample[i] - self.own for i, _ in pairs}
            self.coarse = min(len(self.first), max(LEAST_PROBED, most([int((above[i] > above[i][h // len(self.second)]).sum()) for i, h in pairs], (1 + target) / 2)))
        down = {i: self.descend(sample[i]) for i, _ in pairs}
        rank = lambda lists, near, h: int((near > near[lists == h][0]).sum()) if (lists == h).any() else len(lists)
        return min(len(self), max(LEAST_PROBED, most([rank(*down[i], h) for i, h in pairs], target)))


def matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def scan(cand: np.ndarray, query: np.ndarray, k: int, epsilon: float = EPSILON, blocks=BLOCKS) -> Iterator[np.ndarray]:
    """cand, query: rotated unit vectors. For each query the numbers of the candidates that no test abandoned."""
    d = cand.shape[1]
    stops = sorted({max(1, round(d * b)) for b in blocks} | {d})
    first = stops[0]
    square = lambda x, y: np.maximum((x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None, :] - 2 * x @ y.T, 0.0)
    for at in range(0, len(query), 256):
        start = square(query[at : at + 256, :first], cand[:, :first])
        for q, part in zip(query[at : at + 256], start, strict=True):
            if len(cand) <= 2 * k:
                yield np.arange(len(cand))
                continue
            seeds = np.argpartition(part, 2 * k - 1)[: 2 * k]
            exact = ((cand[seeds] - q) ** 2).sum(axis=1)
            limit = np.partition(exact, k - 1)[k - 1] * (1 + 1e-9) + 1e-12
            alive = np.flatnonzero(part * (d / first) <= limit * (1 + epsilon / np.sqrt(first)) ** 2)
            dist = part[alive]
            for a, b in zip(stops, stops[1:], strict=False):
                dist = dist + ((cand[alive, a:b] - q[a:b]) ** 2).sum(axis=1)
                slack = (1 + epsilon / np.sqrt(b)) ** 2 if b < d else 1.0
                stay = dist * (d / b) <= limit * slack
                alive, dist = alive[stay], dist[stay]
            yield np.union1d(alive, seeds)


def search(vectors: DataFrame, k: int = K, every: int = EVERY, target: float = TARGET, id_column: str = "vec_id", column: str = "embedding", lists: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score for the rows whose id is divisible by `every`; lists: their number, otherwise by the number of vectors."""
    spark = vectors.sparkSession
    stored = Stored(spark, "ann")
    v = stored.put(usable(vectors, id_column, column))
    empty = spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    found = v.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(MOST_LENGTHS).collect()
    if not found:
        return empty
    indexes, start = {}, 0
    for d, n in found:
        most = max(64, min(SAMPLE, (32 << 20) // (8 * d)))
        sample = units(matrix(v.filter(F.size("v") == d).orderBy(F.xxhash64("vec_id", "row"), "row").limit(most).select("v").toArrow().column(0).combine_chunks()))
        index = Lists(sample, lists or int(max(1, round(n**0.5), n // LIST_SIZE)))
        indexes[d] = (index, index.probes_for(sample, k, target), rotation(d), start)
        start += len(index)
    shared = spark.sparkContext.broadcast(indexes)

    def by_length(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Length, which vectors have it, and these as rows."""
        sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        for d in np.unique(sizes).tolist():
            same = np.flatnonzero(sizes == d)
            yield d, same, matrix(column.take(pa.array(same)))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            home = np.zeros(b.num_rows, np.int64)
            for d, same, m in by_length(b.column(2)):
                index, _, _, first = shared.value.get(d, (None, 0, None, 0))
                home[same] = first + index.home(units(m)) if index else -d
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(home)], names=[*b.schema.names, "list"])

    def wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists: list[np.ndarray] = [np.zeros(0, np.int64)] * b.num_rows
            for d, same, m in by_length(b.column(2)):
                index, probes, _, first = shared.value.get(d, (None, 0, None, 0))
                for i, q in zip(same.tolist(), units(m), strict=True):
                    lists[i] = first + index.nearest(q, probes) if index else np.array([-d])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lists, pa.list_(pa.int64()))], names=["qrow", "query_id", "q", "lists"])

    members = stored.put(v.mapInArrow(near, "row bigint, vec_id bigint, v array<double>, list bigint"))
    queries = stored.put(v.filter(F.col("vec_id") % every == 0).mapInArrow(wanted, "qrow bigint, query_id bigint, q array<double>, lists array<bigint>"))
    asked = queries.select("qrow", "query_id", "q", F.explode("lists").alias("list"))
    # How many cells and groups of queries each list has: as many rows as lists.
    sizes = members.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / CELL).cast("int").alias("cells"))
    loads = asked.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / QUERIES_AT_ONCE).cast("int").alias("groups"))
    cells = stored.put(sizes.join(loads, "list"))
    if cells.count() <= MOST_CELLS:
        cells = F.broadcast(cells)
    left = members.join(cells, "list").withColumn("cell", F.pmod(F.xxhash64("row"), F.col("cells")).cast("int"))
    left = left.select("list", "cell", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("group"), "row", "vec_id", "v")
    right = asked.join(cells, "list").withColumn("group", F.pmod(F.xxhash64("qrow"), F.col("groups")).cast("int"))
    right = right.select("list", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)).alias("cell"), "group", "qrow", "query_id", "q")

    def within(cand: pa.Table, asked: pa.Table) -> pa.Table:
        names = ["qrow", "query_id", "vec_id", "row", "score"]
        if not cand.num_rows or not asked.num_rows:
            return pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64())], names=names)
        rows, qrows, ids = cand.column("row").to_numpy(), asked.column("qrow").to_numpy(), cand.column("vec_id").combine_chunks()
        place = ids.fill_null(np.iinfo(np.int64).max).to_numpy()
        c, q = scaled(matrix(cand.column("v").combine_chunks())), scaled(matrix(asked.column("q").combine_chunks()))
        length, qlength = np.sqrt((c * c).sum(axis=1)), np.sqrt((q * q).sum(axis=1))
        if c.shape[1] in shared.value:
            turn = shared.value[c.shape[1]][2]
            # One more than asked for, for the query itself may be among them.
            kept = scan(units(c) @ turn, units(q) @ turn, k + 1)
        else:
            kept = (np.arange(len(c)) for _ in q)
        out_q, out_v, out_s = [], [], []
        for i, alive in enumerate(kept):
            alive = alive[rows[alive] != qrows[i]]
            score = (c[alive] * q[i]).sum(axis=1) / (length[alive] * qlength[i])
            top = np.lexsort((rows[alive], place[alive], -score))[:k]
            out_q.append(np.full(len(top), i))
            out_v.append(alive[top])
            out_s.append(score[top])
        at, of = pa.array(np.concatenate(out_q)), pa.array(np.concatenate(out_v))
        return pa.table([asked.column("qrow").take(at), asked.column("query_id").take(at), ids.take(of), cand.column("row").take(of), pa.array(np.concatenate(out_s))], names=names)

    found = left.groupBy("list", "cell", "group").cogroup(right.groupBy("list", "cell", "group")).applyInArrow(within, "qrow bigint, query_id bigint, vec_id bigint, row bigint, score double")
    best = Window.partitionBy("qrow").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES = {"op4_nearest": op4_nearest}
ORACLES: dict[str, str] = {}
