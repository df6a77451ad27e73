"""Substring dedup, spelling variants and open sales: brute force, then odd cases."""

import datetime as dt
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from compare import SF
from conftest import prose
from pyspark.sql import functions as F

from tessella.llm import concurrency, spelling, substrings
from tessella.llm.common import Stored, documents

WORD = re.compile("[^\x20\x09-\x0d]+")

# Substring dedup


def brute_substrings(rows, window):
    """[(id, text)] -> [(n_words, n_removed, kept text)]; null ids come last and remove nothing."""
    each = [WORD.findall(t or "") for _, t in rows]
    first = {}
    for (i, _), w in zip(rows, each, strict=True):
        for k in range(len(w) - window + 1 if i is not None else 0):
            key = tuple(w[k : k + window])
            first[key] = min(first.get(key, i), i)
    out = []
    for (i, _), w in zip(rows, each, strict=True):
        gone = set()
        for k in range(len(w) - window + 1):
            f = first.get(tuple(w[k : k + window]))
            if f is not None and (i is None or f < i):
                gone |= set(range(k, k + window))
        out.append((len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


def check_substrings(make_docs, rows, window=50, **sizes):
    got = substrings.dedup_substrings(make_docs(rows), window=window, anchor=window // 2, **sizes).collect()
    want = [(r[0], r[1], *x) for r, x in zip(rows, brute_substrings([r[:2] for r in rows], window), strict=True)]
    mine = [(r["__row"].doc_id, r["__row"].text, r.n_words, r.n_removed, r.kept_text) for r in got]
    assert sorted(mine, key=str) == sorted(want, key=str)
    for r in got:
        words = WORD.findall(r["__row"].text or "")
        spans = [(s.s, s.e) for s in r.spans]
        assert spans == sorted(spans) and sum(e - s for s, e in spans) == r.n_removed
        assert " ".join(x for k, x in enumerate(words) if not any(s <= k < e for s, e in spans)) == r.kept_text
    return got


def test_substring_query(spark):
    docs = [(r.doc_id, r.text) for r in documents(spark, SF).collect()]
    want = {d: (n, m, hashlib.sha256(k.encode()).hexdigest()) for (d, _), (n, m, k) in zip(docs, brute_substrings(docs, 50), strict=True)}
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substrings.op11_substring_dedup(spark, SF).collect()}
    assert got == want and sum(m for _, m, _ in got.values()) > 1000


def test_substring_odd_rows(make_docs, odd_rows):
    got = check_substrings(make_docs, [*odd_rows, (10, " ".join(["a"] * 120)), (11, "\n".join(["a"] * 51)), (12, " ".join(["a"] * 49)), (13, prose(30_000, 3).replace(" ", "\t"))])
    assert len(got) == len(odd_rows) + 4
    assert substrings.dedup_substrings(make_docs([])).count() == 0
    assert substrings.dedup_substrings(make_docs([(1, None), (2, "")])).select(F.sum("n_words")).first()[0] == 0


def test_substring_passages_across_documents(make_docs):
    """Passages of just a window, one word less, overlapping ones, periodic texts, and few distinct words."""
    rng, rows = random.Random(7), []
    shared = [prose(n, 300 + n) for n in (49, 50, 51, 80, 200)]
    for i in range(60):
        parts = [prose(rng.randrange(1, 90), 400 + i), *rng.sample(shared, 2), prose(20, 500 + i), " ".join(rng.choices("ab", k=rng.randrange(0, 80)))]
        rng.shuffle(parts)
        rows.append((i // 2 if i % 7 else None, " ".join(parts)))
    check_substrings(make_docs, rows)
    check_substrings(make_docs, [(i, " ".join(rng.choices("ab", k=rng.randrange(0, 60)))) for i in range(80)], window=8)


def test_substring_sketch_sizes_change_nothing(make_docs, monkeypatch):
    """A full sketch, windows that count as hot, texts met by a shuffle, stretches of a few bytes: the same rows."""
    passage, rng = prose(70, 600), random.Random(8)
    rows = [(i, f"{prose(rng.randrange(0, 60), 700 + i % 30)} {passage if i % 3 else 'x'} {prose(60, 800 + i % 5)}") for i in range(150)]
    check_substrings(make_docs, rows)
    check_substrings(make_docs, rows, most_bits=16, hot_least=2, hot_share=10**9)
    monkeypatch.setattr(substrings, "MOST_COVERED", 3)
    monkeypatch.setattr(substrings, "STRETCH", 100)
    monkeypatch.setattr(substrings, "MOST_ANCHORS", 10)
    check_substrings(make_docs, rows, hot_least=40)


@pytest.mark.parametrize("most", [1 << 19, 40])
def test_hot_windows_are_counted_before_they_are_sent(spark, make_docs, monkeypatch, most):
    """A task's copies of a window are one row, with their number and smallest id: rows grow with different windows and tasks, not with copies."""
    monkeypatch.setattr(substrings, "MOST_HOT", most)
    rows = [(None if i % 9 == 0 else 500 - i, prose(80, 900 + i % 3)) for i in range(400)]
    keyed = make_docs(rows).repartition(2).select(F.col("doc_id").alias("__id"), F.col("text").alias("__text")).localCheckpoint()

    class All:
        value = substrings.Sketch(np.full(1 << 14, 255, np.uint8), np.arange(1 << 17), 16)

    got = substrings.hot_counts(keyed, All, 50, 25).collect()
    each = Counter((r.h1, r.h2) for r in got)
    assert len(each) == 3 * 31 and sum(r.n for r in got) == 400 * 31
    assert most < 1000 or max(each.values()) <= 2
    table = substrings.hot_windows(keyed, All, 134, 50, 25).to_pylist()
    want = [(sum(i % 3 == k for i in range(400)), min(r[0] for i, r in enumerate(rows) if i % 3 == k and r[0] is not None)) for k in range(3)]
    assert sorted(r["first"] for r in table) == sorted(f for n, f in want if n >= 134 for _ in range(31))


def test_sketch_never_underestimates(make_docs):
    rows = [(i, prose(200, i % 40)) for i in range(120)]
    w = [substrings.Windows(*next(iter(substrings.stretches(__import__("pyarrow").array([t]))))[1:], 50, 25) for _, t in rows]
    anchors = np.concatenate([x.anchors for x in w])
    n = Counter(anchors.tolist())
    parts = substrings.partition_sketches(make_docs(rows), "text", 50, 25)
    for bits in (16, 20):
        sketch = substrings.Sketch(*substrings.merged_sketch(parts, bits, 5), bits)
        each = np.array(list(n), np.uint64)
        often = np.array(list(n.values()))
        assert sketch.repeated(each)[often >= 2].all() and sketch.hot(each)[often >= 5].all()
        assert sketch.repeated(each)[often < 2].mean() < 0.5 if (often < 2).any() else True


def test_window_hashes_are_of_words():
    """Equal windows have equal hashes wherever they stand; others don't, and the last window of a text is one."""
    import pyarrow as pa

    texts = ["x " + prose(60, 1), prose(60, 1).replace(" ", "\n\n") + "\t", None, "", prose(49, 1), prose(50, 1), "é日本 " * 50]
    ((_, data, offsets),) = substrings.stretches(pa.array(texts))
    w = substrings.Windows(data, offsets, 50, 25)
    h1, h2 = w.hashes(np.arange(len(w.least)))
    words = [WORD.findall(t or "") for t in texts]
    want = [(d, k) for d, x in enumerate(words) for k in range(len(x) - 49)]
    assert list(zip(w.of.tolist(), w.at.tolist(), strict=True)) == want
    groups = defaultdict(set)
    for (d, k), a, b in zip(want, h1.tolist(), h2.tolist(), strict=True):
        groups[a, b].add(tuple(words[d][k : k + 50]))
    assert all(len(g) == 1 for g in groups.values()) and len(groups) == len({tuple(words[d][k : k + 50]) for d, k in want})


# Spelling variants


def brute_spelling(rows, least_letters=6, least_times=5, more=5):
    count = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 199 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            count[w] += 1
    words = {w: n for w, n in count.items() if len(w) >= least_letters and n >= least_times}
    # Words one edit apart are equal, or one less a letter, less the letter at one place.
    by = defaultdict(set)
    for w in words:
        for k in range(len(w)):
            by[w[:k] + w[k + 1 :], k].add(w)
    near = defaultdict(set)
    for (short, _), ws in by.items():
        for w in ws:
            near[w] |= ws - {w}
            if short in words and short != w:
                near[w].add(short)
                near[short].add(w)
    out, form = {}, {}
    for w, n in words.items():
        if near[w]:
            best = min(near[w], key=lambda x: (-words[x], x))
            if words[best] >= more * n:
                form[w] = best
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out[w] = (form.get(w), root, n, len(near[w]), words[form[w]] if w in form else None)
    return out


def spelled(df):
    rows = df.collect()
    out = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}
    assert len(out) == len(rows)
    return out


@pytest.mark.parametrize("sf", [SF, SF.replace("0.001", "0.01")])
def test_spelling_query(spark, sf):
    rows = [(r.doc_id, r.text) for r in documents(spark, sf).collect()]
    got = spelled(spelling.op12_spelling_groups(spark, sf))
    assert got == brute_spelling(rows) and sum(x[3] > 0 for x in got.values()) > 100


def test_spelling_odd_rows(make_docs, odd_rows):
    words = ["colour", "coloured", "éclairs", "Éclairs", "aaaaaa", "aaaaaaa", "ababab", "bababa", "abcdef×÷", "straße", "ÀÁÂÃÄÅ"]
    rows = [*odd_rows, (20, None), (21, " ".join(w for w in words for _ in range(6))), (None, "colours " * 5 + "x" * 9000), (22, "Colour COLOUR cölour " * 40), (22, "Colour COLOUR cölour " * 40)]
    assert spelled(spelling.spelling_groups(make_docs(rows))) == brute_spelling([r[:2] for r in rows])
    assert spelling.spelling_groups(make_docs([])).count() == 0


def test_spelling_of_edited_words(spark, make_docs, monkeypatch):
    """Random edits of words over a small alphabet, repeated letters, edits at either end: no near word is lost."""
    rng, words = random.Random(9), []
    for alphabet in ("ab", "abcde", "éàabcdefghij"):
        for _ in range(60):
            w = "".join(rng.choices(alphabet, k=rng.randrange(6, 13)))
            for _ in range(6):
                k, c = rng.randrange(len(w) + 1), rng.choice(alphabet)
                words.append(rng.choice([w, w[:k] + c + w[k:], w[:k] + w[k + 1 :], w[:k] + c + w[k + 1 :]]))
    rows = [(i, " ".join([w] * rng.choice([5, 6, 30, 200]))) for i, w in enumerate(words)]
    monkeypatch.setattr(spelling, "MOST_WORDS", 20)
    assert spelled(spelling.spelling_groups(make_docs(rows))) == brute_spelling(rows)


def test_forms_are_followed_to_the_last(spark):
    chain = [(f"w{i}", f"w{i + 1}") for i in range(11)] + [("a", "w3"), ("b", "c")]
    got = {r.word: r.root for r in spelling.follow(spark.createDataFrame(chain, "word string, form string"), Stored(spark, "t")).collect()}
    assert got == {**{f"w{i}": "w11" for i in range(11)}, "a": "w11", "b": "c"}


# Open sales


def brute_sweep(steps):
    """[(nation, slot, dn, dc)] -> rows of the sweep."""
    by, out = defaultdict(Counter), []
    for nation, slot, n, c in steps:
        for x in (nation, concurrency.EVERY):
            by[x][slot, 0] += n
            by[x][slot, 1] += c
    for nation, counts in by.items():
        slots = sorted({s for s, _ in counts if counts[s, 0] or counts[s, 1]})
        n = c = 0
        rows = []
        for k, s in enumerate(slots):
            n, c = n + counts[s, 0], c + counts[s, 1]
            rows.append((nation, s * 900, slots[k + 1] * 900 if k + 1 < len(slots) else None, n, c))
        for k, r in enumerate(rows):
            out.append((*r, max(x[3] for x in rows[: k + 1]), r[3] == max(x[3] for x in rows)))
    return out


@pytest.mark.parametrize("parts, span, fan", [(1, 1024, 64), (7, 4, 2), (16, 3, 3)])
def test_sweep(spark, parts, span, fan, monkeypatch):
    monkeypatch.setattr(concurrency, "MOST_STEPS", 40)
    rng, steps = random.Random(parts), []
    for _ in range(400):
        nation, start = rng.choice([1, 1, 1, 2, 3, -1]), rng.randrange(-30, 60)
        steps.append((nation, start, 1, cents := rng.randrange(0, 3)))
        if rng.random() < 0.8:
            steps.append((nation, start + rng.randrange(1, 40), -1, -cents))
    df = spark.createDataFrame(steps, "nation int, slot bigint, dn bigint, dc bigint").repartition(parts)
    got = concurrency.sweep(df, Stored(spark, "t"), span=span, fan=fan).collect()
    assert sorted(map(tuple, got), key=str) == sorted(brute_sweep(steps), key=str)
    assert concurrency.sweep(df.filter("false"), Stored(spark, "t"), span=span, fan=fan).count() == 0


SALES = "sale_id bigint, client_id bigint, total double, sold_at timestamp_ntz, nation int, `end` string, slot string, salt string"
LINES = "sale_id bigint, shipped_at timestamp_ntz, n string, block string"
CLIENTS = "client_id bigint, nation_id int, salt string, nation string"


def brute_steps(sales, lines, clients):
    at = lambda t: (t - dt.datetime(1970, 1, 1)) // dt.timedelta(seconds=900)
    steps = []
    for sale, client, total, sold, *_ in sales:
        if sold is None:
            continue
        ends = [s for i, s, *_ in lines if i == sale and i is not None and s is not None]
        nations = [n for i, n, *_ in clients if i == client and i is not None and n is not None]
        nation = min(nations, default=concurrency.NONE)
        cents = 0 if total is None or not abs(total) < 2.0**53 / 100 else math.floor(total * 100 + 0.5)
        if ends and at(max(ends)) <= at(sold):
            continue
        steps.append((nation, at(sold), 1, cents))
        if ends:
            steps.append((nation, at(max(ends)), -1, -cents))
    return steps


def test_open_sales_odd_rows(spark):
    t = lambda d, h=0, m=0, s=0: dt.datetime(2024, 1, d, h, m, s)
    sales = [(1, 1, 10.005, t(1), 0), (2, 1, None, t(1, 0, 14, 59), 0), (3, 9, -3.335, t(2), 0), (4, None, math.nan, t(2), 0), (5, 2, math.inf, t(2), 0), (6, 2, 1e300, None, 0), (None, 2, 5.0, t(3), 0), (7, 3, 0.0, t(3), 0), (7, 3, 0.0, t(3), 0), (8, 4, 2.5, dt.datetime(1969, 12, 31, 23, 59, 59), 0), (9, 1, 4.0, t(5), 0), (10, 1, 4.0, t(5), 0)]
    lines = [(1, t(1, 0, 15)), (1, t(1, 2)), (1, None), (2, t(1, 0, 0, 1)), (3, t(1)), (None, t(9)), (7, t(4)), (7, t(4)), (8, dt.datetime(1970, 1, 1)), (99, t(9)), (9, t(5, 1)), (10, t(5))]
    clients = [(1, 5), (1, 3), (2, None), (3, -2), (None, 8), (4, 7), (4, 7)]
    frame = lambda rows, schema: spark.createDataFrame([(*r, *["x"] * (schema.count(",") + 1 - len(r))) for r in rows], schema)
    sales = [(*r[:4], 0) for r in sales]
    got = concurrency.open_sales(frame(sales, SALES), frame(lines, LINES), frame(clients, CLIENTS)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(brute_sweep(brute_steps(sales, lines, clients)), key=str)
    empty = lambda schema: spark.createDataFrame([], schema)
    assert concurrency.open_sales(empty(SALES), empty(LINES), empty(CLIENTS)).count() == 0
    assert concurrency.open_sales(frame(sales, SALES), empty(LINES), empty(CLIENTS)).count() > 0


def test_times_with_and_without_a_zone(spark):
    rows = [(dt.datetime(2024, 3, 10, 2, 44, 59, 999),), (dt.datetime(1969, 12, 31, 23, 59, 59),), (dt.datetime(1, 1, 1),), (None,)]
    plain = spark.createDataFrame(rows, "t timestamp_ntz")
    want = [None if t is None else (t - dt.datetime(1970, 1, 1)) // dt.timedelta(seconds=900) for (t,) in rows]
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        assert [r[0] for r in plain.select(concurrency.slot_of(plain, "t")).collect()] == want
        zoned = spark.sql("SELECT timestamp_seconds(1710038699) AS t")
        assert zoned.select(concurrency.slot_of(zoned, "t")).first()[0] == 1710038699 // 900
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
