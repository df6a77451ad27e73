"""Line dedup by overlapping windows of three consecutive lines.

A document's lines that hold a word are hashed in overlapping runs of three; a run found anywhere before (documents in order of id,
then of their text's hash; lines from the top) is a later occurrence, and the lines that later occurrences cover are removed, once each.
So that long passages on fewer lines are found, a run of one or two lines also counts as a window if it holds LONG_WORDS words or more.
The first occurrence of every line stays, whatever windows cover it: a window earlier than it holds that line earlier still.

Lines without a word belong to no window and stay. Null text stays null, with no lines. Rows that repeat both id and text are one
document and treated alike; a null id sorts first. Extra columns pass through untouched, whatever their names.

Windows are written once to the shared folder; repeats are counted with map-side partial aggregation, so a window that a third of all
documents share costs one row per task. The occurrences of such windows (a HOT_SHARE of all each, so their number is bounded) are marked by a
broadcast join, only the others by a shuffle, so no key must stay in one task. Documents that lose lines, if they are MOST_COVERED or
fewer, are broadcast to the texts; otherwise texts meet them by a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, WORD_PATTERN, Stored, documents, let

RUN = 3
LONG_WORDS = 50
#: A window is hot if one in so many is it.
HOT_SHARE = 5000
#: Documents that lose lines, and their lines, broadcast at most.
MOST_COVERED = 200_000
MOST_LINES = 2_000_000


def windows(docs: DataFrame, long_words: int = LONG_WORDS) -> DataFrame:
    """(__id, __th, idx: line numbers from 0, h1, h2) for each window; docs: __id, __text."""
    lines = docs.select("__id", F.xxhash64("__text").alias("__th"), F.split("__text", "\n").alias("__l"))
    # A line is its number, two 64-bit hashes and how many words it has: no window carries a text.
    bare = lambda x: F.btrim(x, F.lit(SPACES))
    line = lambda x, i: F.struct(i.alias("i"), F.xxhash64(bare(x)).alias("a"), F.xxhash64(F.lit("r"), bare(x)).alias("b"), F.regexp_count(x, F.lit(WORD_PATTERN)).alias("n"))
    held = lines.select("__id", "__th", F.filter(F.transform("__l", line), lambda s: s["n"] > 0).alias("__c"))
    runs = F.expr(
        f"""CASE WHEN size(__c) > 0 THEN flatten(transform(sequence(1, size(__c)), k -> filter(
          transform(array(1, 2, {RUN}), m -> slice(__c, k, m)),
          (s, j) -> size(s) = j + 1 AND (j = {RUN - 1} OR aggregate(s, 0, (a, x) -> a + x.n) >= {long_words})))) END"""
    )
    out = held.select("__id", "__th", F.explode(runs).alias("w"))
    return out.select("__id", "__th", F.expr("transform(w, x -> x.i)").alias("idx"), F.expr("xxhash64(transform(w, x -> x.a))").alias("h1"), F.expr("xxhash64(transform(w, x -> x.b))").alias("h2"))


def covered_lines(docs: DataFrame, stored: Stored, long_words: int = LONG_WORDS, hot_share: int = HOT_SHARE) -> DataFrame:
    """(__id, __th, covered: sorted line numbers) of documents that hold a later occurrence."""
    w = stored.put(windows(docs, long_words))
    place = F.struct("__id", "__th", "idx")
    first = stored.put(w.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first")).filter("n > 1"))
    least = max(1000, w.count() // hot_share)
    hot, cold = first.filter(F.col("n") >= least).drop("n"), first.filter(F.col("n") < least).drop("n")
    if hot.isEmpty():
        later = w.join(first.drop("n"), ["h1", "h2"])
    else:
        later = w.join(F.broadcast(hot), ["h1", "h2"]).unionByName(w.join(F.broadcast(hot), ["h1", "h2"], "left_anti").join(cold, ["h1", "h2"]))
    later = later.filter(~place.eqNullSafe(F.col("first")))
    return later.select("__id", "__th", F.explode("idx").alias("i")).groupBy("__id", "__th").agg(F.sort_array(F.collect_set("i")).alias("covered"))


def dedup_lines(docs: DataFrame, text: str = "text", id_column: str = "doc_id", long_words: int = LONG_WORDS) -> DataFrame:
    """docs with the text's repeated passages removed, and n_lines, n_removed (in a struct column `line_dedup`)."""
    stored = Stored(docs.sparkSession, "lines")
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), F.col(f"`{id_column}`").alias("__id"), F.col(f"`{text}`").alias("__text"))
    cov = stored.put(covered_lines(keyed.select("__id", "__text"), stored, long_words).select(F.col("__id").alias("__cid"), F.col("__th").alias("__cth"), "covered"))
    count, lines = cov.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("covered")), F.lit(0))).first()
    if count <= MOST_COVERED and lines <= MOST_LINES:
        cov = F.broadcast(cov)
    both = keyed.join(cov, F.col("__id").eqNullSafe(F.col("__cid")) & (F.xxhash64("__text") == F.col("__cth")), "left")
    n_lines = lambda x: F.when(x.isNull(), 0).otherwise(F.size(F.split(x, "\n"))).cast("long")
    return both.select(
        "__row",
        F.when(F.col("covered").isNull(), F.col("__text")).otherwise(without(F.col("__text"), F.col("covered"))).alias("kept_text"),
        F.struct(n_lines(F.col("__text")).alias("n_lines"), F.when(F.col("covered").isNull(), 0).otherwise(F.size("covered")).cast("long").alias("n_removed")).alias("line_dedup"),
    )


def without(text: Column, covered: Column) -> Column:
    """The text less its covered lines: the stretches between them, joined; linear in the lines."""

    def stretches(lines: Column) -> Column:
        def stretch(p: Column, k: Column) -> Column:
            start = F.when(k == 0, 0).otherwise(F.get(covered, k - 1) + 1)
            return F.slice(lines, start + 1, p - start)

        return F.array_join(F.flatten(F.transform(F.array_append(covered, F.size(lines)), stretch)), "\n")

    return let(F.split(text, "\n"), stretches)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text (what stays), n_lines, n_removed for every document."""
    out = dedup_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("__row.doc_id", F.col("kept_text").alias("text"), "line_dedup.n_lines", "line_dedup.n_removed")


#: The same without hashes; documents there have no repeated ids, so that the text's hash never decides.
_SQL = f"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, i - 1 AS i, trim(ls[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS x,
        len(regexp_extract_all(ls[i], '[^\\x20\\x09-\\x0D]+')) AS n FROM d, unnest(range(1, len(ls) + 1)) AS u(i)),
c AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM l WHERE n > 0),
w AS (SELECT doc_id, k, m, i AS first_i, lead(k, m - 1) OVER o AS last_k,
        CASE m WHEN 1 THEN [x] WHEN 2 THEN [x, lead(x, 1) OVER o] ELSE [x, lead(x, 1) OVER o, lead(x, 2) OVER o] END AS key,
        CASE m WHEN 1 THEN n WHEN 2 THEN n + lead(n, 1) OVER o ELSE {LONG_WORDS} END AS words
      FROM c, (VALUES (1), (2), ({RUN})) AS v(m) WINDOW o AS (PARTITION BY doc_id, m ORDER BY k)),
r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id, k) AS nth FROM w WHERE last_k IS NOT NULL AND words >= {LONG_WORDS}),
gone AS (SELECT DISTINCT r.doc_id, c.i FROM r JOIN c ON c.doc_id = r.doc_id AND c.k BETWEEN r.k AND r.last_k WHERE nth > 1),
g AS (SELECT doc_id, list(i) AS covered FROM gone GROUP BY doc_id)
SELECT d.doc_id,
  CASE WHEN covered IS NULL THEN text ELSE array_to_string(list_filter(ls, lambda x, i: NOT list_contains(covered, i - 1)), chr(10)) END AS text,
  CAST(coalesce(len(ls), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(covered), 0) AS BIGINT) AS n_removed
FROM d LEFT JOIN g ON d.doc_id = g.doc_id
"""

QUERIES = {"op7_line_dedup": op7_line_dedup}
ORACLES = {"op7_line_dedup": _SQL}
