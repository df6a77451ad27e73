"""The pipeline's stages against brute force, and its decisions as a whole."""

import random

import corpus_pipeline as cp
import numpy as np
import pytest
from compare import SF
from conftest import prose
from pyspark.sql import functions as F
from test_models import brute_components, brute_fingerprint
from test_native import brute_lines

from tessella.llm import packing, quality, simhash, similar
from tessella.llm.common import Stored, documents


@pytest.fixture(scope="module")
def steps(spark):
    stored, docs, out = Stored(spark, "t"), documents(spark, SF), []
    for _, stage in cp.STAGES:
        docs = stored.put(stage(spark, docs, SF))
        out.append(docs)
    return out


def test_columns(spark, steps):
    names = documents(spark, SF).columns
    assert all(s.columns == names for s in steps[:-1]) and {"doc_id", "sequence_id", "offset"} <= set(steps[-1].columns)


def test_lines_stage(steps):
    before = sorted((r.doc_id, r.text) for r in steps[0].collect())
    want = {d: t for (d, _), t in zip(before, brute_lines(before), strict=True)}
    got = {r.doc_id: r.text for r in steps[1].collect()}
    assert got == {d: t for d, t in want.items() if t.strip()}


def brute_quality_fails(t):
    """As the quality operator says of this text alone."""
    from pyspark.sql import SparkSession

    one = SparkSession.getActiveSession().createDataFrame([(1, t, None, None, 0)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    return not quality.passing(one).count()


def shingles(t):
    w = (t or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def test_simhash_stage(steps):
    rows = [(r.doc_id, r.text) for r in steps[1].collect()]
    fps = [(d, brute_fingerprint(t)) for d, t in rows]
    kept = {r.doc_id for r in steps[2].collect()}
    assert kept <= {c for _, _, c in brute_components(fps)}
    # Of texts that are alike one stays; whatever went was linked to something.
    sets, gone = dict((d, shingles(t)) for d, t in rows), {d for d, _ in rows} - kept
    alike = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    ids = [d for d, _ in rows]
    pairs = [(a, b) for i, a in enumerate(ids) for b in ids[:i] if alike(a, b)]
    assert pairs and not [p for p in pairs if p[0] in kept and p[1] in kept]
    near = {x for p in pairs for x in p}
    f = dict(fps)
    assert all(d in near or any((f[d] ^ f[x]).bit_count() <= 3 for x in ids if x != d) for d in gone)


def test_similar_texts_of_graded_copies(spark, make_docs):
    """Components are those of all pairs at 3 bits or at the similarity, also where a text's nearest fingerprint isn't similar."""
    rng, rows = random.Random(5), []
    for g in range(2):
        base = prose(200, 40 + g).split()
        for _ in range(80):
            words = list(base)
            for at in rng.sample(range(200), rng.randint(1, 14)):
                words[at] = f"new{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(words)))
    sets, fps = [shingles(t) for _, t in rows], [brute_fingerprint(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3 or len(sets[i] & sets[j]) * 5 >= len(sets[i] | sets[j]) * 4:
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    assert {r.doc_id for r in simhash.keep_one(make_docs(rows)).collect()} == {root(i) for i in range(len(rows))}


def test_similar_texts_far_apart_in_bits(make_docs):
    """Texts are linked by their sets of shingles however many bits of their fingerprints differ."""
    rows = [(i, prose(120, 70) + f" one {w} two" * 150) for i, w in enumerate(("x", "y"))] + [(9, prose(120, 71))]
    (a, b), (f, g) = [shingles(t) for _, t in rows[:2]], [brute_fingerprint(t) for _, t in rows[:2]]
    assert len(a & b) >= 0.8 * len(a | b) and (f ^ g).bit_count() > 12
    assert {r.doc_id for r in simhash.keep_one(make_docs(rows)).collect()} == {0, 9}


def test_shingles_and_bands():
    rng = random.Random(3)
    for n in (0, 1, 4, 5, 6, 300):
        words = [b"w%d" % rng.randrange(40) for _ in range(n)]
        want = {tuple(words[i : i + 5]) for i in range(max(1, n - 4))} if n else set()
        got = similar.shingles(words, 5)
        assert len(got) == len(want) == len(set(got.tolist()))
    # A long text is hashed in stretches, to the same.
    words = [b"w%d" % rng.randrange(3000) for _ in range(2000)]
    whole, kept = similar.shingles(words, 5), similar.STRETCH
    similar.STRETCH = 100
    assert similar.shingles(words, 5).tolist() == whole.tolist()
    similar.STRETCH = kept
    # Of pairs at a similarity of 0.8 practically all share a band, as the number of bands and rows says.
    draw, missed = np.random.default_rng(1), 0
    for _ in range(2000):
        a = draw.integers(0, 1 << 63, 180, dtype=np.uint64)
        b = np.concatenate([a[:160], draw.integers(0, 1 << 63, 20, dtype=np.uint64)])
        missed += not set(similar.bands(a).tolist()) & set(similar.bands(b).tolist())
    assert missed <= 1


def test_unrelated_rows_that_repeat_an_id_stay(make_docs):
    rows = [(1, prose(60, 80)), (1, prose(60, 81)), (1, prose(60, 81)), (2, prose(60, 82)), (None, prose(60, 83)), (None, prose(60, 82))]
    assert sorted((str(r.doc_id), r.text) for r in simhash.keep_one(make_docs(rows)).collect()) == sorted((str(i), t) for i, t in {rows[0], rows[1], rows[3], rows[4]})


def test_mix_stage(steps):
    texts = {r.doc_id: r.text for r in steps[2].collect()}
    drawn = steps[3].collect()
    assert drawn and all(texts[r.doc_id] == r.text for r in drawn)
    assert max(r["count"] for r in steps[3].groupBy("doc_id").count().collect()) <= 3


def test_pack_stage(steps):
    tok = packing._tokenizer(packing.default_tokenizer()).lib
    total = sum(len(tok.encode(r.text, add_special_tokens=False).ids) + 1 for r in steps[3].collect())
    assert steps[4].agg(F.sum("length")).first()[0] == total


def test_run_equals_stages(spark, steps):
    cols = sorted(steps[-1].columns)
    assert sorted(map(tuple, cp.run(spark, SF).select(cols).collect())) == sorted(map(tuple, steps[-1].select(cols).collect()))


def test_survivors_of_ties_are_the_same_however_rows_lie(spark):
    """40 rows that repeat id and text, and differ in another column: the one that comes first as JSON stays."""
    rows = [(1, prose(80, 90), f"s{i:02d}", i) for i in range(40)] + [(2, prose(80, 91), "x", None), (2, prose(80, 91), None, 3), (3, prose(80, 90), "a", 0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, n_chars bigint")
    want = {(1, "s00", 0), (2, None, 3)}
    for parts in (1, 3, 7, 20):
        for order in (docs, docs.orderBy(F.desc("source"))):
            got = simhash.keep_one(order.repartition(parts, F.rand(parts)))
            assert {(r.doc_id, r.source, r.n_chars) for r in got.collect()} == want


def test_odd_rows(spark, make_docs, odd_rows):
    """Each stage on odd rows, against what it must keep; the order and partitions of the rows change nothing."""
    docs = make_docs([])
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0
    clean = [" ".join(f"the word{i}{k} of and thing{i * 7}{k}" for i in range(30)) + "." for k in range(4)]
    odd_rows = [*odd_rows, (30, clean[0], "en", "s1"), (30, clean[0], "en", "s1"), (31, clean[1], None, None), (None, clean[2], "en", "s2"), (32, clean[2], "en", "s2"), (33, clean[3] + "\n" + clean[1], "en", "s3"), (34, clean[3].replace("word5", "other"), "en", "s3")]
    marked = [(*r, *[None] * (4 - len(r))) for r in odd_rows]
    kept = [(r[0], r[1]) for r in marked if r[1] and not brute_quality_fails(r[1])]
    runs = []
    for rows in (odd_rows, odd_rows[::-1]):
        docs, out = make_docs(rows).repartition(3, F.rand(5)), []
        for _, stage in cp.STAGES:
            docs = Stored(spark, "odd").put(stage(spark, docs, SF))
            out.append(sorted(map(str, docs.collect())))
        runs.append(out)
        first = Stored(spark, "odd").put(cp.stage_quality(spark, make_docs(rows), SF))
        assert sorted(map(str, ((r.doc_id, r.text) for r in first.collect()))) == sorted(map(str, kept))
        lines = cp.stage_lines(spark, first, SF).collect()
        left = sorted(kept, key=lambda r: (r[0] is not None, r[0] or 0))
        firsts = {}
        for (i, _), t in zip(left, brute_lines(left), strict=True):
            firsts.setdefault(i, set()).add(t)
        assert all(r.text in firsts[r.doc_id] and r.text.strip() for r in lines)
        assert len({r.text for r in lines}) == len({t for ts in firsts.values() for t in ts if t.strip()})
    # What is drawn and packed may differ in order only.
    assert runs[0][:3] == runs[1][:3] and len(runs[0][-1]) == len(runs[1][-1]) and runs[0][2]
