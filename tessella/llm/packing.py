"""Packing token sequences by non-negative least squares over length combinations.

A document's ids are cut into pieces where that needs no plan: whole windows of WINDOW ids and one remainder. The remainders' length
histogram (at most WINDOW - 1 classes, whatever the input) is all that reaches the driver. There
 1. lengths are put in BINS bins, rounded up, and every combination of at most DEPTH bins that fills a window is enumerated;
 2. non-negative least squares finds how often to repeat each, to meet the histogram;
 3. repeats are rounded down to what is there, and what is left is packed greedily: longest class first, into the open sequences with
    the least room, as many alike at once as there are;
 4. sequences that would still be padded by LEAST_ROOM ids or more are evened out: the emptiest are taken apart, just enough of them, and their
    pieces cut to fill the others; what remains is cut to powers of two, which need no padding. Only these documents are tokenised again.
The plan says for every class which ranks go to which sequences; pieces get their rank within their class by two-level prefix counts,
so a class with a third of all pieces is no one task's, and find their sequence in the broadcast plan, whose size depends on WINDOW alone.

Null text is empty: one piece with the end id. Rows that repeat an id are packed each; equal pieces are interchangeable, and reruns
agree. Long texts are tokenised whole. Word pieces are remembered, up to WORDS_HELD in a process.
"""

from __future__ import annotations

import bisect
import os
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Stored, arrow_batches, documents

WINDOW = 4096
BINS = 128
DEPTH = 3
END_ID = 2
WORDS_HELD = 1_000_000
#: Slices of a length class at least, and pieces in a slice.
SLICES = 512
SLICE_SIZE = 1 << 16
#: Less room than this stays padding rather than cutting a document for it.
LEAST_ROOM = 64
MOST_BROADCAST = 50_000

#: Letters and numbers up to U+024F, and what the tokenizer's file splits text by, for texts of such characters (fixed values).
LETTERS, NUMBERS = "a-zA-Zªµºß-öø-ɏÀ-ÖØ-Þ", "0-9²³¹¼-¾"
PIECE = re.compile(f"[{LETTERS}]+|'(?:s|t|re|ve|m|ll|d)|[{NUMBERS}]|[^\\s{LETTERS}{NUMBERS}]+")
#: Beyond these characters normalisation isn't plain lower case, and the library does it all.
ODD = re.compile("[^\t\n\r\\x20-\\x7e\\xa1-\u012f\u0131-\u024f]|<[|]")
PLAIN = bytes(i for i in range(256) if i in (9, 10, 13) or 32 <= i < 127 or i > 160)
END_OF_WORD = "</w>"


def strange(text: str) -> bool:
    """Whether the library must see the whole text."""
    if "<|" in text:
        return True
    try:
        return bool(text.encode("latin-1").translate(None, PLAIN))
    except UnicodeEncodeError:
        return ODD.search(text) is not None


class WordTokenizer:
    """The library's ids, a remembered word at a time: its pre-tokens depend on nothing around them."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.lib = Tokenizer.from_file(path)
        # For words that are normal and cut already: the same model behind a split at spaces.
        self.lean = Tokenizer.from_file(path)
        self.lean.normalizer = normalizers.Sequence([])
        self.lean.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.known: dict[str, bytes] = {}
        size = self.lib.get_vocab_size()
        self.last = np.array([(self.lib.id_to_token(i) or "").endswith(END_OF_WORD) for i in range(size)], bool)

    def _learn(self, words: list[str]) -> None:
        ids = np.array(self.lean.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
        stops = np.flatnonzero(self.last[ids]) + 1
        if len(stops) != len(words):
            for w in words:
                self.known[w] = np.array(self.lib.encode(w, add_special_tokens=False).ids, "<u4").tobytes()
            return
        raw, at = ids.tobytes(), 0
        for w, stop in zip(words, (stops * 4).tolist(), strict=True):
            self.known[w] = raw[at:stop]
            at = stop

    def encode(self, texts: list[str | None], tail: bytes) -> list[bytes]:
        """Each text's ids as little-endian 32-bit words, and the tail."""
        if len(self.known) > WORDS_HELD:
            self.known.clear()
        known, split, encode = self.known, PIECE.findall, self.lib.encode
        whole = [bool(t) and strange(t) for t in texts]
        pieces = [split(t.lower()) if t and not x else [] for t, x in zip(texts, whole, strict=True)]
        missing = list(set(chain.from_iterable(pieces)).difference(known))
        for at in range(0, len(missing), 5000):
            self._learn(missing[at : at + 5000])
        get = known.__getitem__
        out = [b"".join(map(get, p)) + tail for p in pieces]
        for i, t in enumerate(texts):
            if whole[i]:
                out[i] = np.array(encode(t, add_special_tokens=False).ids, "<u4").tobytes() + tail
        return out


_TOKENIZERS: dict[str, WordTokenizer] = {}


def _tokenizer(path: str) -> WordTokenizer:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordTokenizer(path)
    return _TOKENIZERS[path]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pieces_of(docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """docs: doc_id, text -> doc_id, th (the text's hash), start, length, ids_crc32, doc_tokens (and ids)."""
    arrow_batches(docs.sparkSession)
    tail = int(end_id).to_bytes(4, "little")
    fields = "doc_id bigint, th bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint" + ", ids binary" * keep_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = _tokenizer(tokenizer)
        for batch in batches:
            ids, hashes, texts = (batch.column(i).to_pylist() for i in range(3))
            out: list[tuple] = []
            for at in range(0, len(texts), 200):
                for doc_id, th, raw in zip(ids[at : at + 200], hashes[at : at + 200], tok.encode(texts[at : at + 200], tail), strict=True):
                    n = len(raw) // 4
                    for start in range(0, n, window):
                        cut = raw[4 * start : 4 * (start + window)]
                        out.append((doc_id, th, start, len(cut) // 4, zlib.crc32(cut), n, *([cut] if keep_ids else [])))
            yield _batch(out, fields)

    return keyed(docs).mapInArrow(run, fields)


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("th"), "text")


def _batch(rows: list[tuple], fields: str) -> pa.RecordBatch:
    names, kinds = zip(*[f.split() for f in fields.split(", ")], strict=True)
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64() if k == "bigint" else pa.binary()) for c, k in zip(columns, kinds, strict=True)], names=list(names))


def recut(donated: DataFrame, docs: DataFrame, plan, tokenizer: str, end_id: int, keep_ids: bool) -> DataFrame:
    """The donors' pieces (with sequence_id, offset) cut to where their ids go; their texts are read and tokenised once more."""
    tail = int(end_id).to_bytes(4, "little")
    fields = "doc_id bigint, th bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint" + ", ids binary" * keep_ids + ", sequence_id bigint, offset bigint"
    key = F.struct("doc_id", "th").alias("k")  # equal structs may hold nulls
    per_doc = donated.groupBy(key).agg(F.collect_list(F.struct("start", "length", "doc_tokens", "sequence_id", "offset")).alias("pieces"))
    # Few documents are cut: their keys are broadcast after a count, beyond MOST_BROADCAST the join shuffles.
    wanted = per_doc.select("k")
    if donated.count() <= MOST_BROADCAST:
        wanted = F.broadcast(wanted)
    texts = keyed(docs).select(key, "text").join(wanted, "k", "left_semi").groupBy("k").agg(F.first("text").alias("text"))
    both = per_doc.join(texts, "k").select("k.doc_id", "k.th", "text", *[F.col(f"pieces.{f}").alias(f) for f in ("start", "length", "doc_tokens", "sequence_id", "offset")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, at = _tokenizer(tokenizer), plan.value
        for batch in batches:
            ids, hashes, texts, starts, lengths, tokens, sequences, offsets = (c.to_pylist() for c in batch.columns)
            out = []
            for j, raw in enumerate(tok.encode(texts, tail)):
                for s, n, t, q, o, d in zip(starts[j], lengths[j], tokens[j], sequences[j], offsets[j], at.donor_of(np.array(sequences[j])).tolist(), strict=True):
                    for before, count, seq, off in at.cuts(d, q, o, n):
                        cut = raw[4 * (s + before) : 4 * (s + before + count)]
                        out.append((ids[j], hashes[j], s + before, count, zlib.crc32(cut), t, *([cut] if keep_ids else []), seq, off))
            yield _batch(out, fields)

    return both.mapInArrow(run, fields)


def combinations(bins: int = BINS, depth: int = DEPTH) -> list[tuple[int, ...]]:
    """Every non-increasing tuple of at most depth positive integers that sum to bins."""
    out: list[tuple[int, ...]] = []

    def grow(prefix: tuple[int, ...], left: int, most: int) -> None:
        if left == 0:
            out.append(prefix)
        elif len(prefix) < depth:
            slots = depth - len(prefix)
            for b in range(min(left, most), -(-left // slots) - 1, -1):
                grow((*prefix, b), left - b, b)

    grow((), bins, bins - 1)
    return out


def nnls(a: np.ndarray, b: np.ndarray, most: int = 400) -> np.ndarray:
    """Non-negative least squares by the active-set method of Lawson and Hanson."""
    n = a.shape[1]
    x, passive = np.zeros(n), np.zeros(n, bool)
    gram, ab = a.T @ a, a.T @ b
    ridge = 1e-10 * max(1.0, gram.diagonal().max(initial=0.0))
    w = ab.copy()
    tol = 1e-9 * max(1.0, np.abs(w).max(initial=0.0))
    for _ in range(most):
        free = np.where(passive, -np.inf, w)
        j = int(np.argmax(free))
        if free[j] <= tol:
            break
        passive[j] = True
        while True:
            s = np.zeros(n)
            normal = gram[np.ix_(passive, passive)]
            s[passive] = np.linalg.solve(normal + ridge * np.eye(len(normal)), ab[passive])
            if s[passive].min(initial=1.0) > 0:
                break
            bad = passive & (s <= 0)
            step = np.min(x[bad] / np.maximum(x[bad] - s[bad], 1e-300))
            x += step * (s - x)
            passive &= x > 1e-12
            x[~passive] = 0.0
        x = s
        w = ab - gram @ x
    return x


class Plan:
    """For each length: ranks from `since` on go to sequence `base + (rank - since + phase) // per`."""

    def __init__(self) -> None:
        self.rows: list[tuple[int, int, int, int, int]] = []  # length, since, base, phase, per
        self.sequences = 0
        #: Sequences taken apart, and the rooms that their ids fill: base, count, ids each, place on the tape; rooms also where they begin.
        self.donors = np.zeros((0, 4), np.int64)
        self.rooms = np.zeros((0, 5), np.int64)

    def arrays(self) -> tuple[np.ndarray, ...]:
        rows = np.array(sorted(self.rows), np.int64).reshape(-1, 5)
        return tuple(rows[:, i] for i in range(5))

    def fills(self, hist: np.ndarray) -> list[tuple[int, int, int]]:
        """(base, count, ids in each) for stretches of sequences that are filled alike: as many as the plan has rows, times a constant."""
        change: dict[int, int] = {}

        def put(a: int, b: int, ids: int) -> None:
            if b > a:
                change[a] = change.get(a, 0) + ids
                change[b] = change.get(b, 0) - ids

        rows = sorted(self.rows)
        if not rows:
            return []
        for (length, since, base, phase, per), after in zip(rows, [*rows[1:], (0, 0)], strict=True):
            n = (after[1] if after[0] == length else int(hist[length])) - since
            head = min(n, (per - phase) % per)
            if head:
                put(base, base + 1, head * length)
                base += 1
            whole, tail = divmod(n - head, per)
            put(base, base + whole, per * length)
            put(base + whole, base + whole + 1, tail * length)
        out, ids, at = [], 0, 0
        for edge in sorted(change):
            if ids and edge > at:
                out.append((at, edge - at, ids))
            ids, at = ids + change[edge], edge
        return out

    def even_out(self, hist: np.ndarray, window: int, least_room: int) -> None:
        """Chooses the donors: a donor gives its ids and takes its room off, together a window, so the rooms' sum says how many there are."""
        loose = sorted((ids, base, count) for base, count, ids in self.fills(hist) if window - ids >= least_room)
        need = -(-sum((window - ids) * count for ids, _, count in loose) // window)
        donors, rooms, tape, space = [], [], 0, 0
        for ids, base, count in loose:
            k = min(need, count)
            need -= k
            if k:
                donors.append((base, k, ids, tape))
                tape += k * ids
            if count > k:
                rooms.append((base + k, count - k, window - ids, space, ids))
                space += (count - k) * (window - ids)
        for size in (1 << i for i in range(window.bit_length() - 1, -1, -1)):
            if tape - space >= size:
                rooms.append((self.sequences, 1, size, space, 0))
                self.sequences += 1
                space += size
        self.donors = np.array(sorted(donors), np.int64).reshape(-1, 4)
        self.rooms = np.array(rooms, np.int64).reshape(-1, 5)

    def donor_of(self, sequence: np.ndarray) -> np.ndarray:
        """The donors' row that holds each sequence, or -1."""
        if not len(self.donors):
            return np.full(len(sequence), -1)
        at = np.searchsorted(self.donors[:, 0], sequence, side="right") - 1
        return np.where((at >= 0) & (sequence < self.donors[at, 0] + self.donors[at, 1]), at, -1)

    def cuts(self, donor: int, sequence: int, offset: int, length: int) -> list[tuple[int, int, int, int]]:
        """Where a piece of a donor goes: (ids before, ids, sequence, offset)."""
        base, _, ids, tape = self.donors[donor].tolist()
        at, done, out = tape + (sequence - base) * ids + offset, 0, []
        while done < length:
            g = int(np.searchsorted(self.rooms[:, 3], at, side="right")) - 1
            rbase, _, room, start, begin = self.rooms[g].tolist()
            i, within = divmod(at - start, room)
            n = min(length - done, room - within)
            out.append((done, n, rbase + i, begin + within))
            at, done = at + n, done + n
        return out


def plan_packing(hist: np.ndarray, window: int = WINDOW, bins: int = BINS, depth: int = DEPTH, least_room: int = LEAST_ROOM) -> Plan:
    """hist[l]: pieces of l ids, l < window."""
    plan = Plan()
    grain = window // bins
    used = np.zeros(window, np.int64)  # ranks given, by length
    of_bin = -(-np.arange(window) // grain)
    have = np.bincount(of_bin, hist, minlength=bins + 1)[: bins + 1].astype(np.int64)
    combos = combinations(bins, depth)
    if have[1:].sum():
        a = np.zeros((bins, len(combos)))
        for j, c in enumerate(combos):
            for b in c:
                a[b - 1, j] += 1
        scale = max(1.0, float(have.max()))
        repeats = np.floor(nnls(a, have[1:] / scale) * scale + 1e-6).astype(np.int64)
    else:
        repeats = np.zeros(len(combos), np.int64)
    lengths_of = [[] for _ in range(bins + 1)]  # longest first
    for length in range(window - 1, 0, -1):
        lengths_of[of_bin[length]].append(length)
    left = have.copy()
    for j in np.argsort(-repeats, kind="stable"):
        need: dict[int, int] = {}
        for b in combos[j]:
            need[b] = need.get(b, 0) + 1
        times = min([int(repeats[j]), *(int(left[b]) // m for b, m in need.items())])
        if times <= 0:
            continue
        base = plan.sequences
        plan.sequences += times
        for b, m in need.items():
            given, total = 0, m * times
            left[b] -= total
            for length in lengths_of[b]:
                n = min(int(hist[length] - used[length]), total - given)
                if n > 0:
                    plan.rows.append((length, int(used[length]), base + given // m, given % m, m))
                    used[length] += n
                    given += n
                if given == total:
                    break
    # Best fit, longest class first; rooms[room] holds (base, count) of sequences that are alike in room only.
    rooms: dict[int, list[tuple[int, int]]] = {}
    order: list[int] = []
    for length in range(window - 1, 0, -1):
        n = int(hist[length] - used[length])
        while n:
            i = bisect.bisect_left(order, length)
            if i < len(order):
                room = order[i]
                base, there = rooms[room].pop()
                if not rooms[room]:
                    del rooms[room]
                    order.pop(i)
            else:
                room, base, there = window, plan.sequences, max(1, n // (window // length))
                plan.sequences += there
            per = room // length
            take, count = (per, min(there, n // per)) if n >= per else (n, 1)
            plan.rows.append((length, int(used[length]), base, 0, take))
            used[length] += take * count
            n -= take * count
            if there > count:
                _open(rooms, order, room, base + count, there - count)
            if room > take * length:
                _open(rooms, order, room - take * length, base, count)
    plan.even_out(hist, window, least_room)
    return plan


def _open(rooms: dict, order: list[int], room: int, base: int, count: int) -> None:
    if room not in rooms:
        bisect.insort(order, room)
        rooms[room] = []
    rooms[room].append((base, count))


def assign(plan: Plan, lengths: np.ndarray, ranks: np.ndarray, window: int = WINDOW) -> np.ndarray:
    length, since, base, phase, per = plan.arrays()
    wide = 1 << 40
    at = np.searchsorted(length * wide + since, lengths * wide + ranks, side="right") - 1
    return base[at] + (ranks - since[at] + phase[at]) // per[at]


def ranked(pieces: DataFrame, count: int) -> DataFrame:
    """pieces, `count` of them, with `rank` (from 0) within their length; by (length, slice) counts and offsets, then within each slice."""
    cell = F.pmod(F.xxhash64("doc_id", "th", "start"), F.lit(max(SLICES, 1 << (count // SLICE_SIZE).bit_length()))).cast("int")
    p = pieces.withColumn("slice", cell)
    counts = p.groupBy("length", "slice").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("length", "slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    within = Window.partitionBy("length", "slice").orderBy("doc_id", "th", "start")
    return p.withColumn("nth", F.row_number().over(within)).join(offsets, ["length", "slice"]).withColumn("rank", F.col("ahead") + F.col("nth") - 1).drop("slice", "nth", "ahead")


def pack(docs: DataFrame, tokenizer: str | None = None, window: int = WINDOW, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """docs: doc_id, text -> one row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids)."""
    spark = docs.sparkSession
    stored = Stored(spark, "pack")
    tokenizer = tokenizer or default_tokenizer()
    pieces = stored.put(pieces_of(docs, tokenizer, window, end_id, keep_ids))
    hist = np.zeros(window, np.int64)
    total = 0
    for length, n in pieces.groupBy("length").count().collect():
        total += n
        if length < window:
            hist[length] = n
    plan = plan_packing(hist, window)
    plan.rows.append((window, 0, plan.sequences, 0, 1))
    shared = spark.sparkContext.broadcast(plan)
    r = ranked(pieces, total)
    at_length, at_rank = r.columns.index("length"), r.columns.index("rank")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lengths, ranks = (b.column(i).to_numpy(zero_copy_only=False) for i in (at_length, at_rank))
            seq = assign(shared.value, lengths, ranks, window)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(seq), pa.array(shared.value.donor_of(seq) >= 0)], names=[*b.schema.names, "sequence_id", "given"])

    placed = r.mapInArrow(run, r.withColumn("sequence_id", F.lit(0).cast("bigint")).withColumn("given", F.lit(True)).schema)
    inside = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "rank")
    offset = F.sum("length").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("length")
    placed = placed.withColumn("offset", offset).drop("rank")
    if not len(plan.donors):
        return placed.drop("th", "given")
    placed = stored.put(placed)
    cut = recut(placed.filter("given").drop("given"), docs, shared, tokenizer, end_id, keep_ids)
    return placed.filter("NOT given").drop("given").unionByName(cut).drop("th")


def op6_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir).select("doc_id", "text"))


QUERIES = {"op6_pack": op6_pack}
ORACLES: dict[str, str] = {}
