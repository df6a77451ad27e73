"""Language identification by multilingual mixture inference.

A text is a bag of letter trigrams drawn from a mixture of languages. Each language's trigram distribution (over BUCKETS hashed
trigrams, add-HALF smoothed) is learned from labelled documents: of each language a sample of about PER_LANGUAGE documents by a hash of
the id, whole texts; that bound makes the model's cost independent of the corpus. The model is broadcast and has at most MOST_MODEL bytes: of
more languages than BUCKETS allow at that size, trigrams share fewer buckets. For every document expectation-maximisation estimates the
proportions of all languages (ROUNDS rounds, or until none moves by CLOSE); the set of languages grows from the best single one, by the
proportions of the mixture over all, as long as the gain in log-likelihood exceeds a penalty for each language added: neighbouring trigrams
share letters, so a third of the n trigrams and a third of the gain count as independent, and gain / 3 must exceed half the logarithm of n / 3.
Every language is tried, however small its proportion, until even all together would not pay for one more.
The prediction is the set's most probable language, its score the proportion.

Text alone is read for a prediction. Null texts, texts without letters, and all texts where nothing could be learned, are `und` with score 0.
Documents with null language aren't learned from. Ties go to the lesser name. Rows that repeat an id are predicted each. Very long
texts are first counted by trigram, which changes no likelihood, so their mixture is estimated over BUCKETS rows at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_batches, documents, fold

BUCKETS = 1 << 15
PER_LANGUAGE = 4000
FOLDS = 5
HALF = 0.5
ROUNDS = 12
CLOSE = 1e-3
#: Log-likelihood that the mixture over all languages may still gain after its rounds.
SLACK = 3.0
#: Bytes of the model that is broadcast, at most.
MOST_MODEL = 64 << 20
#: Texts of more trigrams are counted first.
COUNT_FROM = 8192
#: The table of languages is broadcast up to so many rows.
MOST_BROADCAST = 10_000

_LETTER: np.ndarray | None = None


def _letters() -> np.ndarray:
    global _LETTER
    if _LETTER is None:
        _LETTER = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _LETTER


def buckets_for(languages: int) -> int:
    """As many buckets, a power of two, as keep the model within its bound."""
    return min(BUCKETS, 1 << max(1, (MOST_MODEL // (4 * max(1, languages))).bit_length() - 1))


def trigrams(text: str) -> np.ndarray:
    """Bucket of each trigram that holds a letter; what is no letter counts as a space."""
    cp = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[cp]
    if not letter.any():
        return np.zeros(0, np.int64)
    cp = np.where(letter, cp, np.uint32(32))
    cp = np.concatenate([np.full(1, 32, np.uint32), cp, np.full(1, 32, np.uint32)])
    some = np.concatenate([[False], letter, [False]])
    a, b, c = cp[:-2], cp[1:-1], cp[2:]
    h = a * np.uint32(0x9E3779B1) ^ (b * np.uint32(0x85EBCA77) + (c * np.uint32(0xC2B2AE3D) >> np.uint32(7)))
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x27D4EB2F)
    return (h >> np.uint32(17)).astype(np.int64)[some[:-2] | some[1:-1] | some[2:]]


def _counted(buckets: int):
    """mapInArrow: lang, text -> lang, bucket, c; one dense row of counts for each language of the task, as many at once as the model's bound allows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for lang, c in sums.items():
                at = np.flatnonzero(c)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at.astype(np.int32)), pa.array(c[at])], names=["lang", "bucket", "c"])
            sums.clear()

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                t = trigrams(text or "") & (buckets - 1)
                if len(t):
                    if lang not in sums:
                        if (len(sums) + 1) * buckets * 8 > MOST_MODEL:
                            yield from out()
                        sums[lang] = np.zeros(buckets, np.int64)
                    sums[lang] += np.bincount(t, minlength=buckets)
        yield from out()

    return run


def learn(docs: DataFrame, per_language: int = PER_LANGUAGE) -> tuple[list[str], np.ndarray]:
    """docs: doc_id, lang, text -> languages in order of name, and log probabilities [bucket, language]."""
    arrow_batches(docs.sparkSession)
    named = docs.filter(F.col("lang").isNotNull())
    rates = named.groupBy("lang").agg(F.least(F.lit(1.0), F.lit(float(per_language)) / F.count(F.lit(1))).alias("rate")).withColumnRenamed("lang", "__lang")
    # A hash of the id, evenly spread over [0, 1); a language takes the ids below its rate.
    draw = F.pmod(F.xxhash64("doc_id", F.lit("langid")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    languages = rates.count()
    buckets = buckets_for(languages)
    if languages <= MOST_BROADCAST:
        rates = F.broadcast(rates)
    sample = named.join(rates, F.col("lang") == F.col("__lang")).filter(draw < F.col("rate")).select("lang", "text")
    got = sample.mapInArrow(_counted(buckets), "lang string, bucket int, c bigint").groupBy("lang", "bucket").agg(F.sum("c").alias("c")).toArrow()
    lang = got.column("lang").combine_chunks().dictionary_encode()
    found = lang.dictionary.to_pylist()
    names = sorted(found)
    index = {n: i for i, n in enumerate(names)}
    counts = np.zeros((buckets, len(names)), np.float32)
    if names:
        counts[got.column("bucket").to_numpy(), np.array([index[x] for x in found])[lang.indices.to_numpy()]] = got.column("c").to_numpy()
    return names, np.log((counts + HALF) / (counts.sum(axis=0, dtype=np.float64) + HALF * buckets)).astype(np.float32)


def mixture(p: np.ndarray, weight: np.ndarray | None, start: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """Proportions and log-likelihood after some rounds of expectation-maximisation; p[i, k]: probability of observation i in language k."""
    pi = start.astype(p.dtype)
    n = p.shape[0] if weight is None else weight.sum()
    for _ in range(rounds):
        r = 1.0 / (p @ pi) if weight is None else weight / (p @ pi)
        new = pi * (r @ p) / n
        if np.abs(new - pi).max() < CLOSE:
            pi = new
            break
        pi = new
    mix = np.log(p @ pi)
    return pi / pi.sum(), float(mix.sum() if weight is None else mix @ weight)


def infer(text: str | None, logp: np.ndarray) -> tuple[np.ndarray | None, list[int]]:
    """Proportions of all languages (None: undetermined) and the set selected."""
    ids = trigrams(text) & (len(logp) - 1) if text else np.zeros(0, np.int64)
    if not len(ids) or not logp.shape[1]:
        return None, []
    weight = None
    if len(ids) > COUNT_FROM:
        counts = np.bincount(ids, minlength=len(logp))
        ids = np.flatnonzero(counts)
        weight = counts[ids].astype(np.float32)
    lp = logp[ids]
    single = lp.sum(axis=0, dtype=np.float64) if weight is None else (weight.astype(np.float64) @ lp)
    # Scaled by the row's largest, which changes likelihoods by a constant and keeps floats in range.
    top = lp.max(axis=1)
    shift = float(top.sum(dtype=np.float64) if weight is None else weight @ top)
    p = np.exp(lp - top[:, None])
    n = len(lp) if weight is None else float(weight.sum())
    # gain / 3 > log(n / 3) / 2
    penalty = 1.5 * np.log(max(n / 3, 2.0))
    best = int(np.argmax(single))
    chosen, now, pi = [best], float(single[best]) - shift, np.ones(1)
    if p.shape[1] > 1:
        whole, most = mixture(p, weight, np.full(p.shape[1], 1.0 / p.shape[1]))
        for k in np.argsort(-whole, kind="stable").tolist():
            # No set is likelier than all languages together, so nothing more can pay for itself.
            if most + SLACK - now <= penalty:
                break
            if k in chosen:
                continue
            trial = sorted([*chosen, k])
            start = np.maximum(whole[trial], 0.01)
            share, ll = mixture(np.ascontiguousarray(p[:, trial]), weight, start / start.sum())
            if ll - now > penalty:
                chosen, now, pi = trial, ll, share
    out = np.zeros(logp.shape[1])
    out[chosen] = pi
    return out, chosen


def predict(docs: DataFrame, names: list[str], logp: np.ndarray) -> DataFrame:
    """docs: doc_id, held_out, text -> doc_id, held_out, lang_pred, score, languages (the set with its proportions, most first)."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((names, logp))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, logp = shared.value
        for batch in batches:
            pred, score, sets = [], [], []
            for text in batch.column(2).to_pylist():
                pi, chosen = infer(text, logp)
                if pi is None:
                    pred.append("und")
                    score.append(0.0)
                    sets.append("")
                    continue
                k = int(np.argmax(pi))
                pred.append(names[k])
                score.append(min(1.0, max(0.0, float(pi[k]))))
                sets.append(" ".join(f"{names[c]}:{pi[c]:.3f}" for c in sorted(chosen, key=lambda c: -pi[c])))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(sets, pa.string())], names=["doc_id", "held_out", "lang_pred", "score", "languages"])

    return docs.select("doc_id", "held_out", "text").mapInArrow(run, "doc_id bigint, held_out boolean, lang_pred string, score double, languages string")


def identify(docs: DataFrame, folds: int = FOLDS, per_language: int = PER_LANGUAGE) -> DataFrame:
    """docs: doc_id, lang, text. Learns outside the held-out fold, predicts every document."""
    arrow_batches(docs.sparkSession)
    marked = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "lang", "text", (fold("doc_id", folds) == 0).alias("held_out"))
    return predict(marked, *learn(marked.filter(~F.col("held_out")), per_language))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(documents(spark, sf_dir).select("doc_id", "lang", "text"))


QUERIES = {"op2_language_id": op2_language_id}
ORACLES: dict[str, str] = {}
