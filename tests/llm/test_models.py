"""SimHash, language ID, nearest neighbours, packing and language models: brute force on small tables, then odd cases."""

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
import xxhash
from compare import SF
from hypothesis import given, settings
from hypothesis import strategies as st

from tessella.llm import ann, bktree, common, components, langid, lm, packing, simhash
from tessella.llm.common import Stored


@pytest.fixture(scope="module")
def docs():
    return pq.read_table(f"{SF}/documents.parquet").to_pylist()


def words(t):
    return (t or "").encode().lower().split()


# SimHash


def brute_fingerprint(t):
    w = words(t)
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps):
    """[(id, fp)] -> id -> smallest id reachable."""
    up = list(range(len(fps)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, (_, a) in enumerate(fps):
        for j in range(i):
            if (a ^ fps[j][1]).bit_count() <= 3:
                x, y = root(i), root(j)
                up[max(x, y)] = min(x, y)
    least = {}
    for i, (d, _) in enumerate(fps):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return [(d, f"{f:016x}", least.get(root(i))) for i, (d, f) in enumerate(fps)]


def test_simhash(spark, docs):
    got = sorted((r.doc_id, r.fingerprint, r.component_id) for r in simhash.op1_simhash(spark, SF).collect())
    assert got == sorted(brute_components([(d["doc_id"], brute_fingerprint(d["text"])) for d in docs]))


def test_simhash_odd_rows(make_docs, odd_rows):
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash.simhash_components(make_docs(odd_rows)).collect()), key=str)
    assert got == sorted(brute_components([(r[0], brute_fingerprint(r[1])) for r in odd_rows]), key=str)
    kept = simhash.keep_one(make_docs(odd_rows)).collect()
    assert len(kept) == len({c for _, _, c in got}) and {r.doc_id for r in kept} == {c for _, _, c in got}
    assert simhash.simhash_components(make_docs([])).count() == 0 and simhash.keep_one(make_docs([])).count() == 0


def flips(rng, base, n):
    return base ^ sum(1 << int(b) for b in rng.choice(64, n, replace=False))


@pytest.mark.parametrize("tree_size", [4096, 8])
def test_links_of_clusters(spark, tree_size):
    """A chain, a dense ball and strangers; with tiny trees, so a shard's queries visit many."""
    rng = np.random.default_rng(5)
    values, x = set(), int(rng.integers(1 << 62))
    for _ in range(40):
        values.add(x)
        x = flips(rng, x, 3)
    ball = int(rng.integers(1 << 62))
    values |= {flips(rng, ball, int(rng.integers(1, 3))) for _ in range(120)} | {int(v) for v in rng.integers(0, 1 << 62, 100)}
    fps = [(i, v) for i, v in enumerate(sorted(values))]
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    df = spark.createDataFrame([(i, signed(v)) for i, v in fps], "doc_id bigint, __fp bigint")
    comp = {r["__fp"]: r.component_id for r in simhash.near_components(df, Stored(spark, "t"), tree_size=tree_size).collect()}
    assert [(d, comp[signed(int(f, 16))]) for d, f, _ in brute_components(fps)] == [(d, c) for d, _, c in brute_components(fps)]


def test_masks_cover_every_link():
    for parts in (4, 5, 6):
        masks = simhash.shard_masks(parts)
        rng = np.random.default_rng(parts)
        for _ in range(200):
            d = flips(rng, 0, 3)
            assert any(d & m & ((1 << 64) - 1) == 0 for m in masks)
    assert simhash.parts_for(1000) == 4 < simhash.parts_for(1 << 26) < simhash.parts_for(1 << 34)


@given(st.lists(st.integers(0, 2**12), max_size=80, unique=True), st.integers(0, 2**12), st.integers(0, 4))
@settings(max_examples=80, deadline=None)
def test_bktree(values, query, radius):
    t = bktree.BKTree()
    for v in values:
        t.add(v)
    assert {t.values[i] for i in t.within(query, radius)} == {v for v in values if (v ^ query).bit_count() <= radius}


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, k) for k in range(101, 140)] + [(7, 7), (200, 201), (201, 200)]
    got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(edges, "a bigint, b bigint"), Stored(spark, "t")).collect()}
    assert got == {**{i: 0 for i in range(1, 31)}, **{k: 100 for k in range(101, 140)}, 201: 200}


def test_stored_tables_can_be_removed(spark):
    import os

    stored = Stored(spark, "gone")
    assert stored.put(spark.range(5)).count() == 5 and os.path.isdir(stored.base.removeprefix("file://"))
    common.remove_stored(spark)
    assert not os.path.exists(stored.base.removeprefix("file://"))


# Language ID


def test_language_accuracy(spark, docs):
    got = {r.doc_id: r for r in langid.op2_language_id(spark, SF).collect()}
    assert len(got) == len(docs)
    held = [d for d in docs if zlib.crc32(str(d["doc_id"]).encode()) % 5 == 0]
    assert {d["doc_id"] for d in held} == {i for i, r in got.items() if r.held_out}
    assert sum(got[d["doc_id"]].lang_pred == d["lang"] for d in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in got.values())


def test_mixture_finds_both_languages(docs):
    by = {}
    for d in docs:
        by.setdefault(d["lang"], []).append(d["text"])
    names = sorted(by)
    counts = np.stack([np.bincount(langid.trigrams(" ".join(by[n])), minlength=langid.BUCKETS) for n in names], axis=1)
    logp = np.log((counts + 0.5) / (counts.sum(axis=0) + 0.5 * langid.BUCKETS)).astype(np.float32)
    mixed = by["de"][0][:1500] + " " + by["fr"][1][:700]
    pi, chosen = langid.infer(mixed, logp)
    assert {names[k] for k in chosen} == {"de", "fr"} and names[int(np.argmax(pi))] == "de"
    long, _ = langid.infer(mixed * 60, logp)
    assert np.allclose(long, pi, atol=0.05)


def brute_mixture(p, start):
    """p[i][k]: probability of trigram i in language k -> proportions, log-likelihood; by the book, one trigram at a time."""
    pi = list(start)
    for _ in range(langid.ROUNDS):
        new = [0.0] * len(pi)
        for row in p:
            total = sum(a * b for a, b in zip(row, pi, strict=True))
            for k, x in enumerate(row):
                new[k] += pi[k] * x / total / len(p)
        moved = max(abs(a - b) for a, b in zip(new, pi, strict=True))
        pi = new
        if moved < langid.CLOSE:
            break
    return pi, sum(math.log(sum(a * b for a, b in zip(row, pi, strict=True))) for row in p)


def brute_languages(text, logp):
    """Proportions by language of the set that the penalty leaves."""
    p = [[math.exp(x) for x in logp[t].tolist()] for t in langid.trigrams(text)]
    n, kinds = len(p), range(logp.shape[1])
    single = [sum(math.log(row[k]) for row in p) for k in kinds]
    best = max(kinds, key=lambda k: single[k])
    chosen, now, pi = [best], single[best], [1.0]
    whole, _ = brute_mixture(p, [1 / len(kinds)] * len(kinds))
    for k in sorted(kinds, key=lambda k: -whole[k]):
        if k == best:
            continue
        trial = sorted([*chosen, k])
        start = [max(whole[x], 0.01) for x in trial]
        share, ll = brute_mixture([[row[x] for x in trial] for row in p], [x / sum(start) for x in start])
        if ll - now > 1.5 * math.log(max(n / 3, 2)):
            chosen, now, pi = trial, ll, share
    return {k: x / sum(pi) for k, x in zip(chosen, pi, strict=True)}


def languages(count, seed=2, half=0.5):
    """Models of that many invented languages: letter trigrams of their own mixture of syllables."""
    rng = np.random.default_rng(seed)
    texts = []
    for _ in range(count):
        syllables = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 2)) for _ in range(30)]
        texts.append(" ".join("".join(rng.choice(syllables, rng.integers(1, 4))) for _ in range(1500)))
    counts = np.stack([np.bincount(langid.trigrams(t), minlength=langid.BUCKETS) for t in texts], axis=1)
    return texts, np.log((counts + half) / (counts.sum(axis=0) + half * langid.BUCKETS)).astype(np.float32)


def test_mixture_equals_brute_force():
    texts, logp = languages(6)
    for text in (texts[1][:400], texts[2][:300] + " " + texts[4][:150], texts[0][:200] + " " + texts[3][:200] + " " + texts[5][:200], "ab", texts[1][:90] + texts[2][:8]):
        pi, chosen = langid.infer(text, logp)
        want = brute_languages(text, logp)
        assert set(chosen) == set(want) and all(pi[k] == pytest.approx(x, abs=2e-3) for k, x in want.items())


def test_a_language_below_a_hundredth_is_found():
    """90 letters among 20000, by models learned from much: far more than chance explains, so it enters; as many letters of the main language don't."""
    texts, logp = languages(6, half=1e-4)
    body = " ".join([texts[1]] * 3)[:20_000]
    pi, chosen = langid.infer(body + " " + texts[4][:90], logp)
    assert set(chosen) == {1, 4} and 0 < pi[4] < 0.01
    assert langid.infer(body + " " + texts[1][:90], logp)[1] == [1]


def test_mixture_of_many_languages(make_docs):
    """However many there are, each may enter a mixture, and the model keeps its bound."""
    texts, logp = languages(60)
    mixed = " ".join(texts[k][:600] for k in range(0, 60, 2))
    _, chosen = langid.infer(mixed, logp)
    assert len(chosen) >= 28 and all(k % 2 == 0 for k in chosen)
    assert langid.buckets_for(4) == langid.BUCKETS and all(langid.buckets_for(n) * n * 4 <= langid.MOST_MODEL for n in (1, 511, 513, 10_000, 1_000_000))
    rows = [(i, texts[i % 60][:1500], f"l{i % 60:02d}") for i in range(600)]
    got = langid.identify(make_docs(rows)).collect()
    assert sum(r.lang_pred == f"l{r.doc_id % 60:02d}" for r in got if r.held_out) >= 0.95 * sum(r.held_out for r in got)


def test_language_odd_rows(make_docs, odd_rows):
    got = langid.identify(make_docs(odd_rows)).collect()
    assert len(got) == len(odd_rows)
    by = {r.doc_id: r for r in got}
    assert by[3].lang_pred == by[4].lang_pred == by[5].lang_pred == "und" and by[3].score == 0
    assert langid.identify(make_docs([])).count() == 0
    assert {r.lang_pred for r in langid.identify(make_docs([(1, "abc"), (2, "def")])).collect()} == {"und"}


# Nearest neighbours


def brute_neighbours(rows, k=5):
    """[(id, vector)] -> for each query row its id and neighbours, by length, in exact fractions of scaled vectors."""
    fine = lambda v: v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)
    ok = [(i, np.array(v) / max(map(abs, v))) for i, v in rows if fine(v)]
    out = []
    for n, (q, a) in enumerate(ok):
        if q is not None and q % 50 == 0:
            s = [(round(-(a @ b) / (np.linalg.norm(a) * np.linalg.norm(b)), 9), i is None, i or 0) for m, (i, b) in enumerate(ok) if m != n and len(a) == len(b)]
            out.append((q, [(x, None if z else i) for x, z, i in sorted(s)[:k]]))
    return sorted(out, key=str)


def found_neighbours(df):
    out = []
    for r in df.collect():
        if r["rank"] == 1:
            out.append((r.query_id, []))
        out[-1][1].append((round(-r.score, 9), r.vec_id))
        assert len(out[-1][1]) == r["rank"]
    return sorted(out, key=str)


def test_neighbours_odd_rows(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in rng.standard_normal(4)]) for i in range(120)]
    rows += [(i, [1.0, 2.0, 3.0, 4.0]) for i in range(200, 230)] + [(250, [2.0, 4.0, 6.0, 8.0]), (300, None), (350, [0.0] * 4), (400, [1.0, None, 0.0, 0.0]), (450, [float("nan"), 1.0, 0.0, 0.0]), (500, [float("inf"), 1.0, 0.0, 0.0]), (None, [1.0, 1.0, 1.0, 1.0])]
    # Repeated ids, equal rows, components whose squares leave a double's range, and other lengths.
    rows += [(0, [1.0, 0.0, 0.0, 0.0]), (0, [1.0, 0.0, 0.0, 0.0]), (600, [1e200, 1e200, 0.0, 1e199]), (650, [1e-200, 2e-200, 0.0, 3e-200]), (601, [1e-300, 1e-300, 0.0, 1e-301])]
    rows += [(550, [1.0, 2.0]), (551, [2.0, 4.5]), (552, [-1.0, 0.0]), (700, [3.0])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id bigint, embedding array<double>, score string")
    want, got = brute_neighbours(rows), found_neighbours(ann.search(df))
    assert [q for q, _ in got] == [q for q, _ in want if q != 700] and sum(q == 0 for q, _ in got) == 3
    assert [x for q, x in got if q in (200, 250, 550, 600, 650)] == [x for q, x in want if q in (200, 250, 550, 600, 650)]
    hits = sum(len(set(a) & set(b)) for (_, a), (_, b) in zip(got, [w for w in want if w[0] != 700], strict=True))
    assert hits >= 0.9 * sum(len(x) for _, x in want)
    assert ann.search(df.limit(0)).count() == 0
    few = ann.search(df.filter("vec_id < 3"))
    assert [len(x) for q, x in found_neighbours(few) if q == 0] == [4, 4, 4]


@pytest.mark.parametrize("lists", [None, 1500])
def test_recall(spark, monkeypatch, lists):
    """Of one level of lists, and of two."""
    if lists:
        monkeypatch.setattr(ann, "FINE_FROM", 1)
        monkeypatch.setattr(ann, "MOST_LISTS", 8)
    t = pq.read_table(f"{SF}/embeddings.parquet")
    ids, m = t["vec_id"].to_numpy(), ann.units(ann.matrix(t["embedding"].combine_chunks()))
    if lists:
        index = ann.Lists(m, lists)
        assert len(index) == 64 and set(index.home(m).tolist()) <= set(range(64)) and len(set(index.home(m).tolist())) > 8
        lists_of = [index.descend(v) for v in m[:50]]
        assert [int(index.nearest(v, 1)[0]) for v in m[:50]] == [int(x[np.argmax(near)]) for x, near in lists_of]
        assert sorted(lists_of[0][0].tolist()) == list(range(64))
        # The nearest of those below the first level's nearest three.
        index.coarse = 3
        for v in m[:50]:
            top = set(np.argsort(-(index.first @ v - index.own), kind="stable")[:3].tolist())
            assert {x // 8 for x in index.descend(v)[0].tolist()} == top and index.nearest(v, 5)[0] // 8 in top
    got = {}
    for r in ann.search(spark.read.parquet(f"{SF}/embeddings.parquet"), lists=lists).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = total = 0
    for q in np.flatnonzero(ids % 50 == 0):
        s = m @ m[q]
        s[q] = -9
        hits += len(got[ids[q]] & set(ids[np.lexsort((ids, -s))[:5]].tolist()))
        total += 5
    assert hits >= 0.9 * total


def test_two_lengths_in_equal_parts(spark):
    """Each length has lists of its own, searched alike; recall of both; beyond MOST_LENGTHS all are compared."""
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.standard_normal(12 if i // 50 % 2 else 16)]) for i in range(3000)] + [(3000 + i, [1.0, float(i)]) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    want = dict(brute_neighbours(rows))
    for most in (ann.MOST_LENGTHS, 1):
        kept, ann.MOST_LENGTHS = ann.MOST_LENGTHS, most
        got = dict(found_neighbours(ann.search(df)))
        ann.MOST_LENGTHS = kept
        assert got.keys() == want.keys()
        for size in (12, 16, 2):
            ids = [q for q in got if len(rows[q][1]) == size]
            assert not ids or sum(len(set(got[q]) & set(want[q])) for q in ids) >= 0.9 * sum(len(want[q]) for q in ids)
    plan = ann.search(df)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan


def test_scan_keeps_the_nearest():
    rng = np.random.default_rng(3)
    c, q = ann.units(rng.standard_normal((3000, 64))), ann.units(rng.standard_normal((20, 64)))
    turn = ann.rotation(64)
    alive = list(ann.scan(c @ turn, q @ turn, 5))
    near = np.argsort(-(q @ c.T), axis=1)[:, :5]
    assert np.mean([len(set(a) & set(n)) / 5 for a, n in zip(alive, near, strict=True)]) > 0.95
    assert np.mean([len(a) for a in alive]) < 1500


# Packing


def check_pieces(rows, tok, expect):
    fill = Counter()
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == fill[r.sequence_id] and r.length > 0
        fill[r.sequence_id] += r.length
    assert max(fill.values(), default=0) <= 4096
    by = {}
    for r in rows:
        by.setdefault((r.doc_id, r.doc_tokens), []).append(r)
    assert sum(r.length for r in rows) == sum(len(ids) for _, ids in expect)
    for d, ids in expect:
        got = sorted({(r.start, r.length, r.ids_crc32) for r in by[(d, len(ids))]})
        if len(got) == 1 or got[0][0] == 0:
            assert any(zlib.crc32(np.array(ids[s : s + n], "<u4").tobytes()) == c for s, n, c in got)
    return fill


def true_ids(tok, t):
    return [*tok.encode(t or "", add_special_tokens=False).ids, 2]


def test_packing(spark, docs):
    tok = packing._tokenizer(packing.default_tokenizer()).lib
    rows = packing.op6_pack(spark, SF).collect()
    fill = check_pieces(rows, tok, [(d["doc_id"], true_ids(tok, d["text"])) for d in docs])
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    for d in docs:
        ids, at = true_ids(tok, d["text"]), 0
        for r in sorted(by[d["doc_id"]], key=lambda r: r.start):
            assert r.start == at and r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    padding = sum(0 if n & (n - 1) == 0 else 4096 - n for n in fill.values())
    assert padding < 0.03 * sum(fill.values())


def test_packing_odd_rows(make_docs, odd_rows):
    tok = packing._tokenizer(packing.default_tokenizer()).lib
    rows = packing.pack(make_docs(odd_rows)).collect()
    check_pieces(rows, tok, [(r[0], true_ids(tok, r[1])) for r in odd_rows])
    assert packing.pack(make_docs([])).count() == 0


@given(st.lists(st.sampled_from(["abc", "É", "İ", "don't", "''s", "12", "²½", "日本", " ", "\n", "\xa0", "<|endoftext|>", "x́", "...", "_"]), max_size=12))
@settings(max_examples=100, deadline=None)
def test_tokenizer_equals_the_library(parts):
    t = packing._tokenizer(packing.default_tokenizer())
    s = "".join(parts)
    assert t.encode([s], b"")[0] == np.array(t.lib.encode(s, add_special_tokens=False).ids, "<u4").tobytes()


@given(st.lists(st.one_of(st.integers(1, 4095), st.sampled_from([2049, 3000, 4000])), max_size=120))
@settings(max_examples=25, deadline=None)
def test_plan_places_every_piece(lengths):
    hist = np.bincount(lengths, minlength=4096) if lengths else np.zeros(4096, np.int64)
    plan = packing.plan_packing(hist)
    n = np.repeat(np.arange(4096), hist)
    ranks = np.concatenate([np.arange(h) for h in hist if h] or [np.zeros(0, np.int64)])
    seq = packing.assign(plan, n, ranks) if lengths else ranks
    fill = np.bincount(seq, n, minlength=plan.sequences).astype(int)
    told = np.zeros_like(fill)
    for base, count, ids in plan.fills(hist):
        told[base : base + count] += ids
    assert (told == fill).all() and fill.max(initial=0) <= 4096
    # Donors' pieces, in their order within the sequence, fill the others.
    offsets, donor = Counter(), plan.donor_of(seq)
    used = [set() for _ in range(plan.sequences)]
    for k in np.lexsort((ranks, -n, seq)).tolist():
        at, offsets[seq[k]] = offsets[seq[k]], offsets[seq[k]] + n[k]
        spans = plan.cuts(int(donor[k]), int(seq[k]), int(at), int(n[k])) if donor[k] >= 0 else [(0, int(n[k]), int(seq[k]), int(at))]
        assert sum(c for _, c, _, _ in spans) == n[k]
        for _, c, s, o in spans:
            assert o + c <= 4096 and not used[s] & {o, o + c - 1}
            used[s] |= set(range(o, o + c))
    ids = [len(u) for u in used]
    assert sum(ids) == sum(lengths) and all(u == set(range(len(u))) for u in used)
    assert all(x & (x - 1) == 0 or 4096 - x < packing.LEAST_ROOM for x in ids)


def test_nnls():
    rng = np.random.default_rng(2)
    a = rng.random((20, 12))
    x = np.maximum(rng.standard_normal(12), 0)
    assert np.allclose(packing.nnls(a, a @ x), x, atol=1e-6)
    y = packing.nnls(a, -np.ones(20))
    assert (y == 0).all()


# Language models


def test_base_and_model(spark, docs):
    got = {r.doc_id: r for r in lm.op8_ppm_score(spark, SF).collect()}
    held = {d["doc_id"]: zlib.crc32(str(d["doc_id"]).encode()) % 10 == 0 for d in docs}
    c = Counter()
    for d in docs:
        if not held[d["doc_id"]]:
            c.update([*words(d["text"]), lm.END])
    n, v = sum(c.values()), len(c)
    for d in docs:
        w, r = [*words(d["text"]), lm.END], got[d["doc_id"]]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[d["doc_id"]], len(w), sum(x in c for x in w), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w))
        assert math.isfinite(r.score) and r.score < 0


def followers(texts, order):
    """Context of each order -> counts of the bytes after it."""
    follow = {}
    for x in texts:
        s = b"\n" * order + b" ".join(x) + b"\n"
        for i in range(order, len(s)):
            for k in range(order + 1):
                follow.setdefault(s[i - k : i], Counter())[s[i]] += 1
    return follow


def brute_ppm(follow, order, t):
    """Escapes by method D with exclusion, straight from counts."""
    s, out = b"\n" * order + b" ".join(t) + b"\n", 0.0
    for i in range(order, len(s)):
        gone = set()
        for k in range(order, -1, -1):
            c = {b: n for b, n in follow.get(s[i - k : i], {}).items() if b not in gone}
            total = sum(c.values())
            if not total:
                continue
            if s[i] in c:
                out += math.log10((2 * c[s[i]] - 1) / (2 * total))
                break
            out += math.log10(len(c) / (2 * total))
            gone |= set(c)
        else:
            out += math.log10(1 / (256 - len(follow.get(b"", {}))))
    return out


def test_scores_equal_brute_force(spark, docs):
    """Every document of the query, by the whole unpruned model."""
    follow = followers([words(d["text"]) for d in docs if zlib.crc32(str(d["doc_id"]).encode()) % 10], lm.ORDER)
    got = {r.doc_id: r.score for r in lm.op8_ppm_score(spark, SF).collect()}
    some = [d for d in docs if zlib.crc32(str(d["doc_id"]).encode()) % 10 == 0 or d["doc_id"] % 4 == 0]
    assert [got[d["doc_id"]] for d in some] == pytest.approx([brute_ppm(follow, lm.ORDER, words(d["text"])) for d in some])


@pytest.mark.parametrize("heavy", [0, 30, 1 << 20])
def test_what_is_broadcast_changes_nothing(make_docs, monkeypatch, heavy):
    texts = ["the cat the hat", "that cat sat", None, "", "on the mat", "abracadabra cadabra", "é日本 x", "zebra", "x" * 50, "that mat sat on abra", "The  CAT"] * 3
    rows = [(i, t) for i, t in enumerate(texts)]
    held = [zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows]
    follow = followers([words(t) for (_, t), h in zip(rows, held, strict=True) if not h], 2)
    got = {r.doc_id: r for r in lm.score_documents(make_docs(rows), order=2, heavy_grams=heavy, heavy_words=heavy).collect()}
    assert any(held) and [got[i].held_out for i, _ in rows] == held
    assert [got[i].score for i, _ in rows] == pytest.approx([brute_ppm(follow, 2, words(t)) for _, t in rows])
    base = Counter(w for (_, t), h in zip(rows, held, strict=True) if not h for w in [*words(t), lm.END])
    assert [got[i].n_known for i, _ in rows] == [sum(w in base for w in [*words(t), lm.END]) for _, t in rows]


def test_codes():
    rng = np.random.default_rng(4)
    keys = np.unique(rng.integers(0, 1 << 48, 5000))
    table = lm.Codes(keys, np.arange(len(keys), dtype=float))
    asked = np.concatenate([keys[::3], rng.integers(0, 1 << 48, 3000)])
    values, lost = table.get(asked)
    want = {k: i for i, k in enumerate(keys.tolist())}
    assert [want.get(k, 0) for k in asked.tolist()] == values.tolist() and [i for i, k in enumerate(asked.tolist()) if k not in want] == lost.tolist()
    none, all_lost = lm.Codes(keys[:0], np.zeros(0)).get(asked)
    assert not none.any() and len(all_lost) == len(asked)


def test_stretches(monkeypatch):
    texts = [words(t) for t in ("the cat the hat", "", "that cat sat", "a")]
    whole = [np.concatenate(x).tolist() for x in zip(*lm.gram_codes(*lm.stream(texts, 3), 3), strict=True)]
    monkeypatch.setattr(lm, "STRETCH", 7)
    assert [np.concatenate(x).tolist() for x in zip(*lm.gram_codes(*lm.stream(texts, 3), 3), strict=True)] == whole
    assert len(whole[0]) == sum(len(b" ".join(t)) + 1 for t in texts)


def test_lm_odd_rows(make_docs, odd_rows):
    got = lm.score_documents(make_docs(odd_rows)).collect()
    assert len(got) == len(odd_rows) and all(math.isfinite(r.score) and math.isfinite(r.base_score) for r in got)
    assert all(r.n_tokens == 1 for r in got if r.doc_id in (3, 4, 5))
    assert lm.score_documents(make_docs([])).count() == 0
    alone = lm.score_documents(make_docs([(21, "abc def")])).first()
    assert math.isfinite(alone.score)


def test_similar_texts_link(make_docs):
    """Of texts that share four fifths of their five-word shingles one stays; strangers all stay."""
    from conftest import prose

    base = prose(300, 50).split()
    rows = [(1, " ".join(base))]
    for k in range(2, 12):
        edited = list(base)
        for j in range(3):
            edited[(k * 29 + j * 97) % 300] = f"edit{k}x{j}"
        rows.append((k, " ".join(edited)))
    rows += [(100 + i, prose(200, 60 + i)) for i in range(15)]
    kept = {r.doc_id for r in simhash.keep_one(make_docs(rows)).collect()}
    assert kept == {1} | {100 + i for i in range(15)}
    loose = simhash.keep_one(make_docs(rows), similarity=None).count()
    assert loose >= len(kept)
