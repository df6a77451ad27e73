"""Language-model scoring by prediction by partial matching over bytes, beside a word-unigram base.

Training reads all documents outside the held-out fold, whole: words and byte sequences of ORDER + 1 bytes are counted in each task and
summed by a shuffle. The text that the byte model sees is the base's: A-Z in lower case, words joined by single spaces, a line feed as
end symbol and as the context before the first byte.

The trie is kept as tables, one for each order: a node is a byte sequence as a number, its parent the number without its last byte, its
suffix link the number without its first. Nothing is pruned, so what is learned grows with the corpus. A symbol is coded at the longest context
that holds it. For a context with T occurrences and q symbols, a symbol seen c times has (2c - 1) / 2T and the escape q / 2T (method D). After an
escape, the shorter context excludes the symbols of the longer. Last comes a uniform choice among the bytes never seen. The code length of a
symbol depends on nothing but itself and the ORDER bytes before it, so each distinct sequence, of the training documents or the others, is coded
once, by joins down the orders, and a text's score is the sum over its sequences: pretrained code lengths, not adapted within a text, so scores
do not depend on the order of rows.

The most frequent sequences, at most HEAVY_GRAMS by a count of counts, and so the words, are broadcast with their code lengths; the others, counted
by document, are joined by a shuffle, and none of them is hot. All are scored, by one way or the other.

Null and empty texts have one token, the end. Rows that repeat an id are scored each. A null id's fold is that of the empty text.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Stored, arrow_batches, documents, fold

ORDER = 5
#: Byte sequences and words broadcast at most.
HEAVY_GRAMS = 1 << 20
HEAVY = 200_000
FOLDS = 10
ALPHA = 0.1
END = b"\n"
#: Keys held in a task before they are passed on.
HELD = 400_000
CHUNK = 1 << 21
#: Symbols worked on at once.
STRETCH = 1 << 18


def tokens_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def stream(texts: list[list[bytes]], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts as one run of bytes, each between `order` line feeds; where each text's symbols start and stop (with its end)."""
    bodies = [b" ".join(t) for t in texts]
    pad = END * order
    data = np.frombuffer(pad + b"".join([b + pad for b in bodies]), np.uint8)
    sizes = np.fromiter(map(len, bodies), np.int64, len(bodies))
    starts = order + np.concatenate([[0], np.cumsum(sizes + order)[:-1]]) if len(bodies) else np.zeros(0, np.int64)
    return data, starts, starts + sizes + 1


def gram_codes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray, order: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Texts' numbers and, for each of their symbols, its context and itself, big end first; a stretch at a time, so no array outgrows STRETCH."""
    for a in range(order, len(data), STRETCH):
        b = min(len(data), a + STRETCH)
        code = np.zeros(b - a, np.int64)
        for k in range(order + 1):
            code = (code << 8) | data[a - order + k : b - order + k]
        i, j = int(np.searchsorted(stops, a, "right")), int(np.searchsorted(starts, b))
        x, y = np.maximum(starts[i:j], a) - a, np.minimum(stops[i:j], b) - a
        mark = np.zeros(b - a + 1, np.int8)
        np.add.at(mark, x, 1)
        np.add.at(mark, y, -1)
        yield np.repeat(np.arange(i, j), y - x), code[np.cumsum(mark[:-1]) > 0]


class Counted:
    """Numbers with their counts, kept sorted."""

    def __init__(self) -> None:
        self.keys, self.counts, self.waiting, self.held = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0

    def add(self, codes: np.ndarray) -> None:
        self.waiting.append(codes)
        self.held += len(codes)
        if self.held > CHUNK:
            self.merge()

    def merge(self) -> None:
        if self.waiting:
            k, c = np.unique(np.concatenate(self.waiting), return_counts=True)
            self.keys, at = np.unique(np.concatenate([self.keys, k]), return_inverse=True)
            self.counts = np.bincount(at, np.concatenate([self.counts, c])).astype(np.int64)
            self.waiting, self.held = [], 0


COUNTS = "word binary, gram bigint, c bigint, uses bigint"


def counted(order: int):
    """mapInArrow: held_out, text -> COUNTS: a word, or a byte sequence, its count in training documents and in all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter = Counter()
        grams = {False: Counted(), True: Counted()}

        def some_words() -> pa.RecordBatch:
            c = pa.array(list(words.values()), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(list(words), pa.binary()), pa.nulls(len(words), pa.int64()), c, c], names=["word", "gram", "c", "uses"])

        def some_grams(held: bool) -> pa.RecordBatch:
            g = grams[held]
            uses = pa.array(g.counts)
            c = pa.array(np.zeros_like(g.counts)) if held else uses
            out = pa.RecordBatch.from_arrays([pa.nulls(len(g.keys), pa.binary()), pa.array(g.keys), c, uses], names=["word", "gram", "c", "uses"])
            grams[held] = Counted()
            return out

        for batch in batches:
            both: dict[bool, list] = {False: [], True: []}
            for held, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                both[held].append(tokens_of(text))
            for t in both[False]:
                words.update(t)
            if both[False]:
                words[END] += len(both[False])
            if len(words) > HELD:
                yield some_words()
                words = Counter()
            for held, texts in both.items():
                for _, codes in gram_codes(*stream(texts, order), order):
                    grams[held].add(codes)
                    if len(grams[held].keys) > HELD:
                        yield some_grams(held)
        for held, g in grams.items():
            g.merge()
            if len(g.keys):
                yield some_grams(held)
        if words:
            yield some_words()

    return run


def _log(x):
    return F.log10(x.cast("double"))


def gram_costs(grams: DataFrame, order: int, stored: Stored) -> DataFrame:
    """grams: gram (order + 1 bytes as a number), c (count in training, 0 for none), uses -> gram, uses, cost (log10 of the probability of its last byte)."""
    grams = stored.put(grams)
    low = lambda key, k: key.bitwiseAND(F.lit((1 << 8 * k) - 1))  # noqa: E731  the last k bytes
    up = lambda key: F.shiftright(key, 8)  # noqa: E731  without the last byte
    #: nodes[k]: key (k + 1 bytes), c.
    nodes = [grams.filter("c > 0").select(F.col("gram").alias("key"), "c")]
    for k in range(order, 0, -1):
        nodes.insert(0, stored.put(nodes[0].groupBy(low(F.col("key"), k).alias("key")).agg(F.sum("c").alias("c"))))
    seen = F.col("c") > 0
    # What the training documents hold is coded at its own context of full order.
    total = nodes[order].groupBy(up(F.col("key")).alias("ctx")).agg(F.sum("c").alias("t"))
    direct = grams.filter(seen).withColumn("ctx", up(F.col("gram"))).join(total, "ctx").select("gram", "uses", (_log(2 * F.col("c") - 1) - _log(2 * F.col("t"))).alias("cost"))
    # The others go down the orders; `over` and `kinds`: occurrences and number of the symbols that the longer context excludes.
    todo = stored.put(grams.filter(~seen).select("gram", "uses", F.lit(0).cast("bigint").alias("over"), F.lit(0).cast("bigint").alias("kinds"), F.lit(0.0).alias("cost")))
    done = []
    for k in range(order, -1, -1):
        here = todo.withColumn("key", low(F.col("gram"), k + 1)).withColumn("ctx", up(F.col("key")))
        below = nodes[k].withColumn("ctx", up(F.col("key"))).join(here.select("ctx").distinct(), "ctx", "left_semi")
        if k:
            shorter = nodes[k - 1].select(F.col("key").alias("short"), F.col("c").alias("less"))
            below = below.join(shorter, low(F.col("key"), k) == F.col("short"))
        else:
            below = below.withColumn("less", F.lit(0).cast("bigint"))
        contexts = below.groupBy("ctx").agg(F.sum("c").alias("t"), F.count(F.lit(1)).alias("q"), F.sum("less").alias("less"))
        met = here.join(contexts, "ctx", "left").join(nodes[k].select("key", F.col("c").alias("hit")), "key", "left")
        left = F.coalesce("t", F.lit(0)) - F.col("over")
        hit = _log(2 * F.col("hit") - 1) - _log(2 * left)
        miss = F.when(left > 0, _log(F.col("q") - F.col("kinds")) - _log(2 * left)).otherwise(0.0)
        met = stored.put(met.select("gram", "uses", F.col("hit").isNotNull().alias("found"), F.coalesce("less", F.lit(0)).alias("over"), F.coalesce("q", F.lit(0)).alias("kinds"), (F.col("cost") + F.when(F.col("hit").isNotNull(), hit).otherwise(miss)).alias("cost")))
        done.append(met.filter("found").select("gram", "uses", "cost"))
        todo = met.filter("NOT found").drop("found")
    # At the end the bytes that no training document holds are equally likely; `kinds` counts the others.
    done.append(todo.select("gram", "uses", (F.col("cost") - _log(256 - F.col("kinds"))).alias("cost")))
    out = direct
    for part in done:
        out = out.unionByName(part)
    return stored.put(out)


def heaviest(counts: DataFrame, column: str, most: int) -> DataFrame:
    """The rows with the largest counts, `most` at most: those from the eighth of an octave on that the count of counts allows."""
    level = F.floor(F.log2(column) * 8)
    sizes = sorted(((r["l"], r["count"]) for r in counts.groupBy(level.alias("l")).count().collect()), reverse=True)
    total, least = 0, None
    for at, size in sizes:
        total += size
        if total > most:
            break
        least = at
    return counts.filter(F.lit(False) if least is None else level >= least)


class Codes:
    """Numbers with values, looked up many at a time: open addressing in a table of twice as many slots at least."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(2 * len(keys)).bit_length())
        size = 1 << self.bits
        self.keys, self.values = np.full(size, -1, np.int64), np.zeros(size)
        slot = self.slots(keys)
        while len(keys):
            free = np.flatnonzero(self.keys[slot] < 0)
            _, one = np.unique(slot[free], return_index=True)
            put = free[one]
            self.keys[slot[put]], self.values[slot[put]] = keys[put], values[put]
            rest = np.ones(len(keys), bool)
            rest[put] = False
            keys, values, slot = keys[rest], values[rest], (slot[rest] + 1) & (size - 1)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values (0 for what isn't there), and the places of what isn't there."""
        slot = self.slots(keys)
        at = self.keys[slot]
        out = np.where(at == keys, self.values[slot], 0.0)
        lost = [np.flatnonzero(at < 0)]
        todo = np.flatnonzero((at != keys) & (at >= 0))
        slot = slot[todo]
        while len(todo):
            slot = (slot + 1) & (len(self.keys) - 1)
            at = self.keys[slot]
            hit, gone = at == keys[todo], at < 0
            out[todo[hit]] = self.values[slot[hit]]
            lost.append(todo[gone])
            stay = ~(hit | gone)
            todo, slot = todo[stay], slot[stay]
        return out, np.sort(np.concatenate(lost))


class Heavy:
    """What is broadcast: the usual byte sequences with their costs, and words with their scores. A worker makes the table once, for all its tasks."""

    def __init__(self, keys: np.ndarray, costs: np.ndarray, words: dict[bytes, float]):
        self.keys, self.costs, self.words, self.made = keys, costs, words, None

    def codes(self) -> Codes:
        if self.made is None:
            self.made = Codes(self.keys, self.costs)
        return self.made


def tails(texts: np.ndarray, codes: np.ndarray, n: int) -> tuple[pa.Array, pa.Array]:
    """For each of n texts the codes, and how often each occurs there."""
    order = np.lexsort((codes, texts))
    texts, codes = texts[order], codes[order]
    new = np.ones(len(codes), bool)
    new[1:] = (codes[1:] != codes[:-1]) | (texts[1:] != texts[:-1])
    at = np.flatnonzero(new)
    times = np.diff(np.append(at, len(codes))).astype(np.int32)
    offsets = pa.array(np.searchsorted(texts[at], np.arange(n + 1)).astype(np.int32))
    return pa.ListArray.from_arrays(offsets, pa.array(codes[at], pa.int64())), pa.ListArray.from_arrays(offsets, pa.array(times))


SCORED = "rid bigint, doc_id bigint, held_out boolean, n_tokens bigint, known bigint, base double, model double, words array<binary>, word_times array<int>, grams array<bigint>, gram_times array<int>"


def scored(codes: Codes, heavy: dict[bytes, float], order: int):
    """mapInArrow: rid, doc_id, held_out, text -> SCORED: what the broadcast tables hold is summed, the rest is listed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = heavy.get
        for batch in batches:
            texts = [tokens_of(t) for t in batch.column(3).to_pylist()]
            known, base, rest, times = [], [], [], []
            for t in texts:
                tf = Counter(t)
                tf[END] += 1
                total, hits, tail, some = 0.0, 0, [], []
                for w, n in tf.items():
                    v = get(w)
                    if v is None:
                        tail.append(w)
                        some.append(n)
                    else:
                        total += n * v
                        hits += n
                known.append(hits)
                base.append(total)
                rest.append(tail)
                times.append(some)
            model, of, lost = np.zeros(len(texts)), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for text, code in gram_codes(*stream(texts, order), order):
                cost, gone = codes.get(code)
                model += np.bincount(text, cost, len(texts))
                of.append(text[gone])
                lost.append(code[gone])
            made = [
                *[batch.column(i) for i in range(3)],
                pa.array([len(t) + 1 for t in texts], pa.int64()),
                pa.array(known, pa.int64()),
                pa.array(base, pa.float64()),
                pa.array(model, pa.float64()),
                pa.array(rest, pa.list_(pa.binary())),
                pa.array(times, pa.list_(pa.int32())),
                *tails(np.concatenate(of), np.concatenate(lost), len(texts)),
            ]
            yield pa.RecordBatch.from_arrays(made, names=[c.split()[0] for c in SCORED.split(", ")])

    return run


def score_documents(docs: DataFrame, folds: int = FOLDS, order: int = ORDER, heavy_grams: int = HEAVY_GRAMS, heavy_words: int = HEAVY) -> DataFrame:
    """docs: doc_id, text -> one row each: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    arrow_batches(spark)
    stored = Stored(spark, "lm")
    marked = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), (fold("doc_id", folds) == 0).alias("held_out"), "text")
    counts = marked.select("held_out", "text").mapInArrow(counted(order), COUNTS).groupBy("word", "gram").agg(F.sum("c").alias("c"), F.sum("uses").alias("uses"))
    counts = stored.put(counts)
    words = counts.filter("word IS NOT NULL").select(F.col("word").alias("key"), "c")
    v, n = words.agg(F.count(F.lit(1)), F.coalesce(F.sum("c"), F.lit(0))).first()
    costs = gram_costs(counts.filter("gram IS NOT NULL").select("gram", "c", "uses"), order, stored)
    bottom = math.log10(n + ALPHA * (v + 1))
    often = heaviest(words, "c", heavy_words).toArrow()
    heavy = {k: math.log10(c + ALPHA) - bottom for k, c in zip(often.column(0).to_pylist(), often.column(1).to_pylist(), strict=True)}
    usual = heaviest(costs, "uses", heavy_grams).select("gram", "cost").toArrow()
    shared = spark.sparkContext.broadcast(Heavy(usual.column(0).to_numpy(), usual.column(1).to_numpy(), heavy))

    def run(batches):
        yield from scored(shared.value.codes(), shared.value.words, order)(batches)

    rows = stored.put(marked.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "held_out", "text").mapInArrow(run, SCORED))
    listed = lambda keys, times: rows.select("rid", F.explode(F.arrays_zip(F.col(keys).alias("key"), F.col(times).alias("times"))).alias("t")).select("rid", "t.*")
    c = F.coalesce("c", F.lit(0))
    by_word = listed("words", "word_times").join(words, "key", "left").groupBy("rid")
    by_word = by_word.agg(F.sum(F.col("times") * (F.log10(c + F.lit(ALPHA)) - F.lit(bottom))).alias("more_base"), F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("more_known"))
    by_gram = listed("grams", "gram_times").join(costs.select(F.col("gram").alias("key"), "cost"), "key").groupBy("rid").agg(F.sum(F.col("times") * F.col("cost")).alias("more_model"))
    zero = lambda x: F.coalesce(x, F.lit(0))
    return rows.drop("words", "word_times", "grams", "gram_times").join(by_word, "rid", "left").join(by_gram, "rid", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + zero("more_known")).cast("long").alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more_base", F.lit(0.0))).alias("base_score"),
        (F.col("model") + F.coalesce("more_model", F.lit(0.0))).alias("score"),
    )


def op8_ppm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(documents(spark, sf_dir).select("doc_id", "text"))


QUERIES = {"op8_ppm_score": op8_ppm_score}
ORACLES: dict[str, str] = {}
