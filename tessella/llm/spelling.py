"""Spelling variants: words one edit apart, grouped under the form that is written most.

Words are counted in tasks that hold at most MOST_WORDS counts each, then summed by word. Candidates come from a prefix filter: a word's positional
bigrams are ordered by how many words hold the bigram, rarest first, then by position. One edit changes at most two bigrams of either word, so
words one edit apart share one of the first three, at the same place counted from the start or from the end: what is not changed lies wholly on one
side of the edit. The join is therefore on the three rarest bigrams together with all that stands before them, or all behind, and on the length of the rest, which
may differ by one. (Of a bigram that a word holds several times the earliest come first; of those among the first three, at most as many are changed
as others are among them, so the argument holds with repeats.) What meets is verified by its edit distance, once a pair.

The bigrams' order is a table over at most 90 ** 2 bigrams, for the alphabet has 90 letters, and is all that is broadcast.

A word's form is its near word of largest count (ties: smallest in code-point order) if that is MORE times its own count or more. Forms are followed
by doubling, so the counts, which grow MORE-fold at each step, bound the rounds by the logarithm of a logarithm.

Null texts have no words; a null id is written as empty text in front of the colon. Rows that repeat count each time. Only id and text are read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Stored, arrow_batches, documents, id_text

RUN = "[A-Za-zÀ-ÿ]+"
#: One run in so many loses a letter.
MISSPELT = 199
LEAST_LETTERS, LEAST_TIMES, MORE = 6, 5, 5
RAREST = 3
#: Counts that a task holds before it writes them.
MOST_WORDS = 500_000


def typed(doc_id: str, run: str, misspelt: int = MISSPELT) -> str:
    """The word as counted: a run of one document, less a letter if its hash says so."""
    h = zlib.crc32(f"{doc_id}:{run}".encode())
    if h % misspelt:
        return run
    k = h % len(run)
    return run[:k] + run[k + 1 :]


def word_counts(docs: DataFrame, text: str = "text", id_column: str = "doc_id", least_letters: int = LEAST_LETTERS, misspelt: int = MISSPELT) -> DataFrame:
    """word, n over all documents, of words with so many letters."""
    arrow_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = re.compile(RUN).findall
        held: dict[str, int] = {}

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for doc_id, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not body:
                    continue
                # Bytes are lower-cased in A-Z only.
                own: dict[str, int] = {}
                for w in find(body.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")):
                    own[w] = own.get(w, 0) + 1
                for w, n in own.items():
                    if len(w) >= least_letters and len(w := typed(doc_id, w, misspelt)) >= least_letters:
                        held[w] = held.get(w, 0) + n
                if len(held) > MOST_WORDS:
                    yield made()
                    held.clear()
        yield made()

    found = docs.select(id_text(F.col(f"`{id_column}`")).alias("i"), F.col(f"`{text}`").alias("t")).mapInArrow(run, "word string, n bigint")
    return found.groupBy("word").agg(F.sum("n").alias("n"))


def bigrams(word: str) -> list[str]:
    return [word[i : i + 2] for i in range(len(word) - 1)]


def rare_halves(words: DataFrame, rarest: int = RAREST) -> DataFrame:
    """words: word, ... -> word, side, half, rest: what stands up to (side 0) or from (side 1) each of the rarest bigrams, and how many letters are left."""
    each = words.select(F.explode(F.array_distinct(F.expr("transform(sequence(1, length(word) - 1), i -> substr(word, i, 2))"))).alias("g"))
    held = each.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    order = {g: i for i, g in enumerate(held.orderBy("n", "g").toArrow().column("g").to_pylist())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for w in batch.column(0).to_pylist():
                grams = bigrams(w)
                for p in sorted(range(len(grams)), key=lambda p: (order[grams[p]], p))[:rarest]:
                    for side, half in ((0, w[: p + 2]), (1, w[p:])):
                        for column, x in zip(out, (w, side, half, len(w) - len(half)), strict=True):
                            column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.string(), pa.int32(), pa.string(), pa.int32()), strict=True)], names=["word", "side", "half", "rest"])

    return words.select("word").mapInArrow(run, "word string, side int, half string, rest int")


def near_pairs(words: DataFrame, stored: Stored, rarest: int = RAREST) -> DataFrame:
    """a, b: the words that one edit parts, each pair once, in either order of the two."""
    halves = stored.put(rare_halves(words, rarest))
    own = halves.select("side", "half", "rest", F.col("word").alias("a"))
    other = halves.select("side", "half", "rest", F.col("word").alias("b"))
    equal = own.join(other, ["side", "half", "rest"]).filter("a < b").select("a", "b")
    longer = own.withColumn("rest", F.col("rest") + 1).join(other, ["side", "half", "rest"]).select("a", "b")
    pairs = equal.unionByName(longer).filter(F.levenshtein("a", "b", 1) == 1).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return stored.put(pairs.distinct())


def follow(forms: DataFrame, stored: Stored) -> DataFrame:
    """forms: word, form, both given -> word, root: the last form that a word's forms lead to."""
    now = stored.put(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        then = stored.put(now.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if then.filter("moved").isEmpty():
            return then.drop("moved")
        now = then.drop("moved")


def spelling_groups(docs: DataFrame, text: str = "text", id_column: str = "doc_id", least_letters: int = LEAST_LETTERS, least_times: int = LEAST_TIMES, more: int = MORE, misspelt: int = MISSPELT) -> DataFrame:
    """word, form, root, n, n_near, form_n for every word with so many letters and occurrences."""
    stored = Stored(docs.sparkSession, "spelling")
    words = stored.put(word_counts(docs, text, id_column, least_letters, misspelt).filter(F.col("n") >= least_times))
    pairs = near_pairs(words, stored)
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = both.join(words.select(F.col("word").alias("b"), F.col("n").alias("m")), "b")
    best = near.groupBy("a").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "b")).alias("o"))
    best = best.select(F.col("a").alias("word"), "n_near", F.col("o.b").alias("form"), (-F.col("o.m")).alias("form_n"))
    placed = words.join(best, "word", "left")
    more_often = F.col("form_n") >= more * F.col("n")
    placed = stored.put(placed.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(more_often, F.col("form")).alias("form"), F.when(more_often, F.col("form_n")).alias("form_n")))
    roots = follow(placed.filter("form IS NOT NULL").select("word", "form"), stored)
    return placed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_groups(documents(spark, sf_dir).select("doc_id", "text"))


QUERIES = {"op12_spelling_groups": op12_spelling_groups}
#: DuckDB has no crc32: held against brute force in the tests.
ORACLES: dict[str, str] = {}
