"""Substring dedup: every word goes that a window of WINDOW words covers whose like starts in a document with a smaller id.

First a count-min sketch. Each partition counts its windows in cells of SKETCH_ROWS rows; the partitions' sketches are added cell by cell, each block of cells in a task
of its own. A window is counted by its anchor, the run of ANCHOR words in it that hashes lowest: windows that are alike have the same anchor, while
about 13 consecutive windows share one, so the sketch has a cell to fill for 13 windows and a window's count is still never underestimated. The sketch
has CELLS_EACH cells for each anchor in a row, 2 ** MOST_BITS at most, and is broadcast as one bit a cell (64 MB a row at most): estimated twice or more.

Then an exact pass. Only windows whose anchor is estimated repeated are sent, by a hash of 128 bits, to where the smallest id of each is found. Beyond the
sketch's largest size it lets more windows through, and nothing is lost or found in excess.

Windows estimated to occur as often as one in HOT_SHARE of all (or HOT_LEAST times, if that is more) never meet in one task: each task counts those of its own documents, these
counts are summed exactly, and those that do occur so often, at most HOT_SHARE, are broadcast with their smallest ids, so that tasks decide them where they are.

Windows are judged on the input, not on what is left. Null text has no words. Rows with the same id never remove each other's words; null ids come after all others
and remove none. Rows that repeat id and text are treated alike. Extra columns pass through untouched, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Stored, arrow_batches, documents, let, word_list
from .similar import mixed

WINDOW, ANCHOR = 50, 25
SKETCH_ROWS = 2
CELLS_EACH = 4
LEAST_BITS, MOST_BITS, BLOCK_BITS = 16, 29, 21
HOT_SHARE, HOT_LEAST = 200_000, 500
#: Bytes of texts hashed at once, where a single text isn't longer; anchors that a task counts before it writes its sketch; windows estimated hot
#: that a task holds before it sends their counts.
STRETCH, MOST_ANCHORS, MOST_HOT = 1 << 20, 1 << 22, 1 << 19
#: Documents that lose words, and their spans, broadcast at most.
MOST_COVERED, MOST_SPANS = 200_000, 2_000_000

_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xFF51AFD7ED558CCD, 0xD6E8FEB86659FD93)
_CELL = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB], np.uint64)
_powers: dict[int, list[np.ndarray]] = {}


def powers(base: int, n: int) -> list[np.ndarray]:
    """The first n powers of a base and of its inverse, modulo 2 ** 64."""
    held = _powers.get(base)
    if held is None or len(held[0]) < n:
        size, both = max(n, 1 << 16), []
        for b in (base, pow(base, -1, 1 << 64)):
            each = np.full(size, b, np.uint64)
            each[0] = 1
            both.append(np.multiply.accumulate(each))
        _powers[base] = held = both
    return [x[:n] for x in held]


def stretches(column: pa.Array, most: int = STRETCH) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first document, bytes, offsets of documents in them) for consecutive documents of a batch."""
    if pa.types.is_large_string(column.type):
        column = column.cast(pa.string())
    column = pc.fill_null(column, "")
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    body = column.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        yield first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every word, and how many words each document has."""
    starts_of, ends_of = offsets[:-1], offsets[1:]
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(starts_of), np.int64)
    inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
    begin, final = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    final[:-1] &= ~inside[1:]
    some = ends_of > starts_of
    begin[starts_of[some]] = inside[starts_of[some]]
    final[ends_of[some] - 1] = inside[ends_of[some] - 1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(final) + 1
    up, down = powers(_BASES[0], len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
    hashes = mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    return hashes, np.searchsorted(starts, ends_of) - np.searchsorted(starts, starts_of)


def runs(words: np.ndarray, size: int, base: int) -> np.ndarray:
    """The hash of every run of so many words."""
    n = len(words) - size + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    up, down = powers(base, len(words) + 1)
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * up[:-1], out=sums[1:])
    return mixed((sums[size:] - sums[:n]) * down[:n])


class Windows:
    """The windows of consecutive documents: at (number of the first word in its document), of (document), anchors, and where anchors change."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, window: int, anchor: int):
        self.words, counts = word_hashes(data, offsets)
        of = np.repeat(np.arange(len(counts)), counts)
        n = max(0, len(self.words) - window + 1)
        self.starts = np.flatnonzero(of[:n] == of[window - 1 :][:n])
        self.of, self.window = of[self.starts], window
        self.at = self.starts - (np.cumsum(counts) - counts)[self.of]
        least = runs(self.words, anchor, _BASES[1])
        # The least of window - anchor + 1 consecutive runs, by doubling.
        width, reach = window - anchor + 1, 1
        while reach < width:
            step = min(reach, width - reach)
            least = np.minimum(least[:-step], least[step:]) if len(least) > step else least[:0]
            reach += step
        self.least = least[self.starts] if len(self.starts) else np.zeros(0, np.uint64)
        changes = (self.least[1:] != self.least[:-1]) | (self.of[1:] != self.of[:-1])
        self.heads = np.flatnonzero(np.concatenate([np.ones(min(1, len(self.least)), bool), changes]))
        self.anchors = self.least[self.heads]

    def spread(self, marks: np.ndarray) -> np.ndarray:
        """Marks of anchors, for each window."""
        return np.repeat(marks, np.diff(np.append(self.heads, len(self.least))))

    def hashes(self, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = self.starts[some]
        return runs(self.words, self.window, _BASES[2])[at].view(np.int64), runs(mixed(self.words), self.window, _BASES[3])[at].view(np.int64)


def cells(anchors: np.ndarray, row: int, bits: int) -> np.ndarray:
    return (mixed(anchors * _CELL[row]) * _CELL[1 - row] >> np.uint64(64 - bits)).astype(np.int64)


def partition_sketches(docs: DataFrame, text: str, window: int, anchor: int) -> DataFrame:
    """block, cell (numbers within the block), n (their counts), windows, anchors: a sketch of each partition, of its cells that aren't zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        windows = anchors = 0

        def made() -> pa.RecordBatch:
            every = np.concatenate(held) if held else np.zeros(0, np.uint64)
            each = [cells(every, row, MOST_BITS) + (row << MOST_BITS) for row in range(SKETCH_ROWS)]
            where, counts = np.unique(np.concatenate(each), return_counts=True)
            blocks = where >> BLOCK_BITS
            heads = np.flatnonzero(np.concatenate([np.ones(min(1, len(where)), bool), blocks[1:] != blocks[:-1]]))
            offsets = pa.array(np.append(heads, len(where)).astype(np.int32))
            listed = lambda x: pa.ListArray.from_arrays(offsets, pa.array(x, pa.int32()))
            once = lambda x: pa.array([x] + [0] * (len(heads) - 1) if len(heads) else [], pa.int64())
            columns = [pa.array(blocks[heads], pa.int32()), listed(where & (1 << BLOCK_BITS) - 1), listed(counts), once(windows), once(anchors)]
            return pa.RecordBatch.from_arrays(columns, names=["block", "cell", "n", "windows", "anchors"])

        for batch in batches:
            for _, data, offsets in stretches(batch.column(0)):
                w = Windows(data, offsets, window, anchor)
                held.append(w.anchors)
                windows += len(w.least)
                anchors += len(w.anchors)
                if anchors > MOST_ANCHORS:
                    yield made()
                    held, windows, anchors = [], 0, 0
        yield made()

    return docs.select(f"`{text}`").mapInArrow(run, "block int, cell array<int>, n array<int>, windows bigint, anchors bigint")


def merged_sketch(parts: DataFrame, bits: int, hot: int) -> tuple[np.ndarray, np.ndarray]:
    """Bits of the cells that are estimated twice or more, row by row, and the numbers of those estimated hot."""
    fold = MOST_BITS - bits
    size = 1 << BLOCK_BITS - fold

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, counts = None, np.zeros(size, np.int64)

        def made() -> pa.RecordBatch:
            often = pa.array([np.flatnonzero(counts >= hot).tolist()], pa.list_(pa.int32()))
            return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([np.packbits(counts >= 2, bitorder="little").tobytes()]), often], names=["block", "twice", "often"])

        for batch in batches:
            blocks, cell, n = batch.column(0).to_pylist(), batch.column(1), batch.column(2)
            cuts, where, times = cell.offsets.to_numpy(), cell.values.to_numpy() >> fold, n.values.to_numpy()
            for i, b in enumerate(blocks):
                if b != block:
                    if block is not None:
                        yield made()
                    block, counts = b, np.zeros(size, np.int64)
                counts += np.bincount(where[cuts[i] : cuts[i + 1]], times[cuts[i] : cuts[i + 1]], size).astype(np.int64)
        if block is not None:
            yield made()

    merged = parts.select("block", "cell", "n").repartition("block").sortWithinPartitions("block").mapInArrow(run, "block int, twice binary, often array<int>").toArrow()
    twice = np.zeros(SKETCH_ROWS << bits - 3, np.uint8)
    often = [np.zeros(0, np.int64)]
    for b, x, o in zip(*[merged.column(i).to_pylist() for i in range(3)], strict=True):
        twice[b * size >> 3 : (b + 1) * size >> 3] = np.frombuffer(x, np.uint8)
        often.append(np.array(o, np.int64) + b * size)
    return twice, np.sort(np.concatenate(often))


class Sketch:
    def __init__(self, twice: np.ndarray, often: np.ndarray, bits: int):
        self.twice, self.often, self.bits = twice, often, bits

    def where(self, anchors: np.ndarray) -> list[np.ndarray]:
        return [cells(anchors, row, self.bits) + (row << self.bits) for row in range(SKETCH_ROWS)]

    def repeated(self, anchors: np.ndarray) -> np.ndarray:
        out = np.ones(len(anchors), bool)
        for x in self.where(anchors):
            out &= (self.twice[x >> 3] >> (x & 7).astype(np.uint8) & 1).astype(bool)
        return out

    def hot(self, anchors: np.ndarray) -> np.ndarray:
        out = np.ones(len(anchors), bool)
        for x in self.where(anchors):
            out &= np.isin(x, self.often)
        return out


def window_counts(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    """Rows __id, h1, h2, n -> a row for each window: its smallest id (null if all are) and the sum of its counts."""
    rows = pa.Table.from_batches(parts).combine_chunks()
    ids, (h1, h2, n) = rows.column(0), (rows.column(i).to_numpy() for i in (1, 2, 3))
    rank = np.empty(len(rows), np.int64)
    rank[pc.sort_indices(ids, null_placement="at_end").to_numpy()] = np.arange(len(rows))
    order = np.lexsort((rank, h2, h1))
    h1, h2 = h1[order], h2[order]
    heads = np.flatnonzero(np.concatenate([np.ones(min(1, len(order)), bool), (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])]))
    sums = np.add.reduceat(n[order], heads) if len(heads) else n
    columns = [ids.take(pa.array(order[heads])).combine_chunks(), pa.array(h1[heads]), pa.array(h2[heads]), pa.array(sums)]
    return pa.RecordBatch.from_arrays(columns, names=["__id", "h1", "h2", "n"])


def hot_counts(keyed: DataFrame, sketch, window: int, anchor: int) -> DataFrame:
    """__id, h1, h2, n: windows that are estimated hot, with how often and in which smallest id a task has them. A task sends a window once, however
    many of its documents hold it, unless it meets more than MOST_HOT different ones."""
    schema = keyed.select("__id").withColumns({c: F.lit(0).cast("bigint") for c in ("h1", "h2", "n")}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        count = 0
        for batch in batches:
            for first, data, offsets in stretches(batch.column(1)):
                w = Windows(data, offsets, window, anchor)
                some = np.flatnonzero(w.spread(sketch.value.hot(w.anchors)))
                if not len(some):
                    continue
                h1, h2 = w.hashes(some)
                columns = [batch.column(0).take(pa.array(first + w.of[some])), pa.array(h1), pa.array(h2), pa.array(np.ones(len(some), np.int64))]
                held.append(pa.RecordBatch.from_arrays(columns, names=["__id", "h1", "h2", "n"]))
                count += len(some)
                if count > 2 * MOST_HOT:
                    held = [window_counts(held)]
                    count = len(held[0])
                    if count > MOST_HOT:
                        yield held[0]
                        held, count = [], 0
        if held:
            yield window_counts(held)

    return keyed.select("__id", "__text").mapInArrow(run, schema)


def hot_windows(keyed: DataFrame, sketch, hot: int, window: int, anchor: int) -> pa.Table:
    """h1, h2, first (smallest id) of windows that occur so often; there are at most as many as all windows divided by that."""
    found = hot_counts(keyed, sketch, window, anchor).groupBy("h1", "h2").agg(F.sum("n").alias("n"), F.min("__id").alias("first"))
    return found.filter(F.col("n") >= hot).select("h1", "h2", "first").orderBy("h1", "h2").toArrow()


def differs(ids: pa.Array, first: pa.Array) -> np.ndarray:
    """Which ids aren't the first, null ids being last."""
    return pc.fill_null(pc.not_equal(ids, first), True).to_numpy(zero_copy_only=False) & pc.is_valid(first).to_numpy(zero_copy_only=False)


def window_rows(keyed: DataFrame, sketch, hot, window: int, anchor: int) -> DataFrame:
    """__id, __th, at, n, h1, h2: windows that must meet (n = 0), and runs of n consecutive windows already known to be later than others."""
    schema = keyed.select("__id", "__th", *[F.lit(0).cast(t).alias(c) for c, t in (("at", "int"), ("n", "int"), ("h1", "bigint"), ("h2", "bigint"))]).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = hot.value
        hot1, hot2 = (table.column(i).to_numpy() for i in (0, 1))
        firsts = table.column(2).combine_chunks()
        for batch in batches:
            for first, data, offsets in stretches(batch.column(2)):
                w = Windows(data, offsets, window, anchor)
                some = np.flatnonzero(w.spread(sketch.value.repeated(w.anchors)))
                h1, h2 = w.hashes(some)
                at, of, n = w.at[some], first + w.of[some], np.zeros(len(some), np.int64)
                if len(hot1) and len(some):
                    place = np.minimum(np.searchsorted(hot1, h1), len(hot1) - 1)
                    known = (hot1[place] == h1) & (hot2[place] == h2)
                    i = np.flatnonzero(known)
                    later = i[differs(batch.column(0).take(pa.array(of[i])), firsts.take(pa.array(place[i])))]
                    heads = np.flatnonzero(np.concatenate([np.ones(min(1, len(later)), bool), (np.diff(at[later]) != 1) | (np.diff(of[later]) != 0)]))
                    n[later[heads]] = np.diff(np.append(heads, len(later)))
                    keep = np.flatnonzero(~known | (n > 0))
                    at, of, n, h1, h2 = (x[keep] for x in (at, of, n, h1, h2))
                    # Known ones are dealt by their place: they have nothing to meet.
                    h1, h2 = np.where(n > 0, mixed((at + (of << 32)).astype(np.uint64)).view(np.int64), h1), np.where(n > 0, -1 - at, h2)
                docs = pa.array(of)
                columns = [batch.column(0).take(docs), batch.column(1).take(docs), pa.array(at, pa.int32()), pa.array(n, pa.int32()), pa.array(h1), pa.array(h2)]
                yield pa.RecordBatch.from_arrays(columns, names=["__id", "__th", "at", "n", "h1", "h2"])

    return keyed.select("__id", "__th", "__text").mapInArrow(run, schema)


def covered_spans(later: DataFrame, window: int) -> DataFrame:
    """__id, __th, at, n of later windows -> __id, __th, spans: the stretches of words that they cover, in order, none touching another."""
    packed = later.select("__id", "__th", (F.shiftleft(F.col("at").cast("long"), 32) + F.greatest("n", F.lit(1))).alias("p"))
    lists = packed.groupBy("__id", "__th").agg(F.collect_list("p").alias("p"))
    schema = lists.select("__id", "__th").withColumn("spans", F.array(F.struct(F.lit(0).alias("s"), F.lit(0).alias("e")))).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, starts, ends, counts = batch.column(2), [], [], [0]
            cuts, values = column.offsets.to_numpy(), column.values.to_numpy()
            for i in range(batch.num_rows):
                p = np.sort(values[cuts[i] : cuts[i + 1]])
                s = p >> 32
                e = np.maximum.accumulate(s + (p & 0xFFFFFFFF) - 1 + window)
                heads = np.flatnonzero(np.concatenate([[True], s[1:] > e[:-1]]))
                starts.append(s[heads])
                ends.append(e[np.append(heads[1:], len(e)) - 1])
                counts.append(len(heads))
            flat = [pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int32()) for x in (starts, ends)]
            spans = pa.ListArray.from_arrays(pa.array(np.cumsum(counts).astype(np.int32)), pa.StructArray.from_arrays(flat, ["s", "e"]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), spans], names=["__id", "__th", "spans"])

    return lists.mapInArrow(run, schema)


def repeated_spans(keyed: DataFrame, stored: Stored, window: int = WINDOW, anchor: int = ANCHOR, hot_share: int = HOT_SHARE, hot_least: int = HOT_LEAST, most_bits: int = MOST_BITS) -> DataFrame:
    """keyed: __id, __th (hash of the text), __text -> __id, __th, spans of documents that lose words."""
    sc = keyed.sparkSession.sparkContext
    parts = stored.put(partition_sketches(keyed, "__text", window, anchor))
    total, anchors = parts.agg(F.coalesce(F.sum("windows"), F.lit(0)), F.coalesce(F.sum("anchors"), F.lit(0))).first()
    bits = min(max(LEAST_BITS, (CELLS_EACH * anchors).bit_length()), most_bits)
    least = max(hot_least, total // hot_share)
    sketch = Sketch(*merged_sketch(parts, bits, least), bits)
    stored.drop(parts)
    shared = sc.broadcast(sketch)
    if len(sketch.often):
        hot = hot_windows(keyed, shared, least, window, anchor)
    else:
        hot = pa.table({"h1": pa.array([], pa.int64()), "h2": pa.array([], pa.int64()), "first": pa.array([], pa.int64())})
    rows = window_rows(keyed, shared, sc.broadcast(hot), window, anchor)
    rows = rows.withColumn("first", F.expr("min(__id) OVER (PARTITION BY h1, h2)"))
    later = rows.filter((F.col("n") > 0) | (F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("__id"))))
    return covered_spans(later.select("__id", "__th", "at", "n"), window)


def without_spans(words: Column, spans: Column) -> Column:
    """The words less those in spans: the stretches between them, linear in the words."""

    def stretch(p: Column, k: Column) -> Column:
        start = F.when(k == 0, 0).otherwise(F.get(spans, k - 1)["e"])
        return F.slice(words, start + 1, p["s"] - start)

    end = F.struct(F.size(words).alias("s"), F.size(words).alias("e"))
    return F.flatten(F.transform(F.array_append(spans, end), stretch))


def dedup_substrings(docs: DataFrame, text: str = "text", id_column: str = "doc_id", window: int = WINDOW, anchor: int = ANCHOR, **sizes: int) -> DataFrame:
    """__row (all columns), kept_text (the words that stay, joined by single spaces), n_words, n_removed, spans (of words removed)."""
    arrow_batches(docs.sparkSession)
    stored = Stored(docs.sparkSession, "substrings")
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), F.col(f"`{id_column}`").alias("__id"), F.col(f"`{text}`").alias("__text"))
    boxed = keyed.select("__id", F.xxhash64("__text").alias("__th"), "__text")
    spans = stored.put(repeated_spans(boxed, stored, window, anchor, **sizes)).select(F.col("__id").alias("__cid"), F.col("__th").alias("__cth"), "spans")
    count, n = spans.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("spans")), F.lit(0))).first()
    if count <= MOST_COVERED and n <= MOST_SPANS:
        spans = F.broadcast(spans)
    both = keyed.join(spans, F.col("__id").eqNullSafe(F.col("__cid")) & (F.xxhash64("__text") == F.col("__cth")), "left")

    def result(words: Column) -> Column:
        kept = F.when(F.col("spans").isNull(), words).otherwise(without_spans(words, F.col("spans")))
        return F.struct(F.size(words).cast("long").alias("n_words"), F.array_join(kept, " ").alias("kept_text"))

    out = both.select("__row", let(word_list(F.col("__text")), result).alias("__r"), "spans")
    removed = F.coalesce(F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["e"] - s["s"]), F.lit(0).cast("long"))
    return out.select("__row", "__r.kept_text", "__r.n_words", removed.alias("n_removed"), F.coalesce("spans", F.array().cast("array<struct<s:int,e:int>>")).alias("spans"))


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_substrings(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("__row.doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


#: Windows as texts, without hashes.
_SQL = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
w AS (SELECT doc_id, i, array_to_string(ws[i:i + {WINDOW - 1}], ' ') AS x FROM d, unnest(range(1, len(ws) - {WINDOW - 2})) AS u(i)),
f AS (SELECT x, min(doc_id) AS first FROM w GROUP BY x HAVING min(doc_id) < max(doc_id)),
g AS (SELECT doc_id, list(DISTINCT i + k) AS gone FROM w JOIN f ON f.x = w.x AND f.first < w.doc_id, unnest(range(0, {WINDOW})) AS v(k) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
  sha256(array_to_string(CASE WHEN gone IS NULL THEN ws ELSE list_filter(ws, lambda x, i: NOT list_contains(gone, i)) END, ' ')) AS kept_sha256
FROM d LEFT JOIN g ON g.doc_id = d.doc_id
"""

QUERIES = {"op11_substring_dedup": op11_substring_dedup}
ORACLES = {"op11_substring_dedup": _SQL}
