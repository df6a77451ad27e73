"""Quality rules: a threshold table compiled into one projection.

Every measure and every rule is a built-in Spark expression over the row's own text, so the plan is scan -> project (or filter): no shuffle, no
user function, and nothing that grows but the row. Stop words are of languages in Latin letters; the ratio counts as met (one) in texts of
three bytes or more for two characters, so mostly in other letters, which it can't judge. Null text counts as a text without words. Repeated rows are judged alike; columns
other than the text are neither read nor touched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE_CLASS, WORD_PATTERN, documents, let, word_list

WINDOW = 8

#: Common function words of languages in Latin letters (fixed values).
STOP_WORDS = (
    "the of and to in a is that it on was for with as be by are this at from or an "
    "der die das und ist nicht mit von zu den dem ein eine für auf im sich des als auch "
    "le la les de et est que qui un une du pour dans en sur au il elle pas "
    "el los las por con para del se no su es lo al como "
    "il che di non per sono gli della nel "
    "os da do em um uma não com "
    "het een van niet zijn voor "
    "och att det som på inte är "
    "og af til ikke er "
    "ja on ei että oli "
    "na nie się jest że "
    "je že ve jsou "
    "și la nu cu este "
    "ve bir bu için ile "
    "és az hogy nem egy "
    "yang dan di untuk dengan "
    "và của là có không"
).split()

#: (measure, lowest, highest) of a text that passes, either bound None. Ratios are by word, or by line for *_lines.
THRESHOLDS = (
    ("n_words", 20, None),
    ("repeat_ratio", None, 0.30),
    ("mean_word_chars", 1.5, 25.0),
    ("symbol_ratio", None, 0.25),
    ("shout_ratio", None, 0.30),
    ("stop_ratio", 0.01, None),
    ("dup_line_ratio", None, 0.50),
    ("bullet_line_ratio", None, 0.90),
    ("ellipsis_line_ratio", None, 0.30),
)


NO_HASHES = "array<bigint>"


def _repeats(h: Column) -> Column:
    """Words covered by windows whose hash occurs again; only texts with one pay for the sort that finds where."""

    def covered(s: Column) -> Column:
        twin = lambda x, k: F.coalesce((F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"]), F.get(s, k - 1)["h"] == x["h"], F.get(s, k + 1)["h"] == x["h"], F.lit(False))
        starts = F.array_sort(F.transform(F.filter(s, twin), lambda x: x["i"]))
        return F.aggregate(
            starts,
            F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("total")),
            lambda acc, p: F.struct(p.alias("last"), (acc["total"] + F.least(F.lit(WINDOW), p - acc["last"])).cast("long").alias("total")),
            lambda acc: acc["total"],
        )

    placed = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    return F.when((F.size(h) < 2) | (F.size(F.array_distinct(h)) == F.size(h)), F.lit(0).cast("long")).otherwise(let(placed, covered))


def counts(text: Column) -> Column:
    """A struct of all counts that the rules use, each part of the text taken apart once."""
    has_word = lambda line: line.rlike(WORD_PATTERN)
    n = lambda x: F.size(x).cast("long")

    def of(t: Column, w: Column, lines: Column, h: Column) -> Column:
        return F.struct(
            n(w).alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            F.regexp_count(t, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
            (n(lines) - n(F.array_distinct(lines))).alias("n_dup_lines"),
            _repeats(h).alias("n_repeat_words"),
            n(lines).alias("n_lines"),
            F.regexp_count(t, F.lit("!!")).cast("long").alias("n_shouts"),
            n(F.filter(w, lambda x: F.lower(x).isin(list(dict.fromkeys(STOP_WORDS))))).alias("n_stop_words"),
            F.length(t).cast("long").alias("n_chars"),
            F.octet_length(t).cast("long").alias("n_bytes"),
            n(F.filter(lines, lambda x: x.rlike("^" + SPACE_CLASS + "*[-*•]"))).alias("n_bullet_lines"),
            n(F.filter(lines, lambda x: x.rlike("(\\.\\.\\.|…)" + SPACE_CLASS + "*$"))).alias("n_ellipsis_lines"),
        )

    def hashes(w: Column) -> Column:
        each = F.transform(F.sequence(F.lit(1), F.size(w) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(w, i, F.lit(WINDOW))))
        return F.when(F.size(w) > WINDOW, each).otherwise(F.array().cast(NO_HASHES))

    return let(F.coalesce(text, F.lit("")), lambda t: let(word_list(t), lambda w: let(F.filter(F.split(t, "\n"), has_word), lambda lines: let(hashes(w), lambda h: of(t, w, lines, h)))))


def _ratios(m: Column) -> dict[str, Column]:
    by = lambda top, of: m[top] / F.greatest(m[of], F.lit(1))
    return {
        "n_words": m["n_words"],
        "repeat_ratio": by("n_repeat_words", "n_words"),
        "mean_word_chars": by("word_chars", "n_words"),
        "symbol_ratio": by("n_symbols", "n_words"),
        "shout_ratio": by("n_shouts", "n_words"),
        "stop_ratio": F.when(m["n_bytes"] * 2 >= m["n_chars"] * 3, F.lit(1.0)).otherwise(by("n_stop_words", "n_words")),
        "dup_line_ratio": by("n_dup_lines", "n_lines"),
        "bullet_line_ratio": by("n_bullet_lines", "n_lines"),
        "ellipsis_line_ratio": by("n_ellipsis_lines", "n_lines"),
    }


def verdict(m: Column, thresholds=THRESHOLDS) -> Column:
    """The table as one boolean expression over counts()."""
    ratios, out = _ratios(m), F.lit(True)
    for name, low, high in thresholds:
        if low is not None:
            out = out & (ratios[name] >= F.lit(low))
        if high is not None:
            out = out & (ratios[name] <= F.lit(high))
    return out


def base_failed(m: Column) -> Column:
    return (m["n_words"] < 20) | (F.lit(100) * m["n_repeat_words"] > F.lit(30) * m["n_words"])


def quality_rules(docs: DataFrame, text: str = "text", id_column: str = "doc_id", thresholds=THRESHOLDS) -> DataFrame:
    """One row per document: its counts, base_failed, and kept (false where base_failed, else the table's verdict)."""
    m = docs.select(id_column, counts(F.col(f"`{text}`")).alias("__m"))
    failed = base_failed(F.col("__m"))
    return m.select(id_column, "__m.*", failed.alias("base_failed"), (~failed & verdict(F.col("__m"), thresholds)).alias("kept"))


def passing(docs: DataFrame, text: str = "text", thresholds=THRESHOLDS) -> DataFrame:
    """The documents that pass, with all their columns: one filter, in which the counts are bound once."""
    return docs.filter(let(counts(F.col(f"`{text}`")), lambda m: ~base_failed(m) & verdict(m, thresholds)))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = quality_rules(documents(spark, sf_dir).select("doc_id", "text"))
    return q.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _sql() -> str:
    stops = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
    ratio = {
        "n_words": "n_words",
        "repeat_ratio": "n_repeat_words / greatest(n_words, 1)",
        "mean_word_chars": "word_chars / greatest(n_words, 1)",
        "symbol_ratio": "n_symbols / greatest(n_words, 1)",
        "shout_ratio": "n_shouts / greatest(n_words, 1)",
        "stop_ratio": "CASE WHEN n_bytes * 2 >= n_chars * 3 THEN 1.0 ELSE n_stop_words / greatest(n_words, 1) END",
        "dup_line_ratio": "n_dup_lines / greatest(n_lines, 1)",
        "bullet_line_ratio": "n_bullet_lines / greatest(n_lines, 1)",
        "ellipsis_line_ratio": "n_ellipsis_lines / greatest(n_lines, 1)",
    }
    rules = " AND ".join(f"({ratio[n]}) {op} CAST({v} AS DOUBLE)" for n, low, high in THRESHOLDS for op, v in ((">=", low), ("<=", high)) if v is not None)
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS ws,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d),
win AS (SELECT rid, i, array_to_string(ws[i:i + 7], ' ') AS k FROM w, unnest(range(1, len(ws) - 6)) AS u(i) WHERE len(ws) >= 8),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, k) AS c FROM win) WHERE c > 1),
cov AS (SELECT rid, CAST(sum(least(8, i - p)) AS BIGINT) AS n FROM (SELECT rid, i, lag(i, 1, -100) OVER (PARTITION BY rid ORDER BY i) AS p FROM twice) GROUP BY rid),
m AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
        CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
        CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words, len(ls) AS n_lines,
        len(regexp_extract_all(t, '!!')) AS n_shouts,
        len(list_filter(ws, lambda x: lower(x) IN ({stops}))) AS n_stop_words,
        length(t) AS n_chars, strlen(t) AS n_bytes,
        len(list_filter(ls, lambda x: regexp_matches(x, '^[\\x20\\x09-\\x0D]*[-*•]'))) AS n_bullet_lines,
        len(list_filter(ls, lambda x: regexp_matches(x, '(\\.\\.\\.|…)[\\x20\\x09-\\x0D]*$'))) AS n_ellipsis_lines
      FROM w LEFT JOIN cov USING (rid)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {rules} AS kept FROM b
"""


QUERIES = {"op10_quality_rules": op10_quality_rules}
ORACLES = {"op10_quality_rules": _sql()}
