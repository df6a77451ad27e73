"""How many intervals are open at a time, by group: step functions added in a tree.

Every start and end is a step of one group's function, counted in slots of SLOT seconds. What a partition of intervals holds is reduced to compact
step functions, one for each group and range of SPAN slots, and one more for EVERY, which adds up all groups. Functions of the same group and range
are added in pairs, up a tree over the partitions, FAN of them to a task; none has more than SPAN steps, however many intervals it stands for. A
scan over the ranges' sums, a few numbers each, then carries what is open from one range into the next, and each range writes its own rows.

Nothing that grows with the intervals goes through one task: a function's size is bounded by its range, its copies by FAN, and the scan by the
number of ranges in time. Starts and ends are summed by client and slot before they meet their client's nation, so a client that has a third of all
sales is at most as many rows as there are slots, and these are dealt over SALTS tasks by their range.

Sales with null start, or an end not after the start, take no part; null sale ids match no lines, null or unknown clients have nation NONE; of repeated clients
the smallest nation counts; repeated sales each count. Totals that are null, not finite or beyond 2 ** 53 cents count as 0. Groups that are themselves
numbered EVERY or NONE are added to those. Only the named columns are read, so others may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampType

from .common import Stored

SLOT = 900
#: Slots in a range.
SPAN = 1 << 10
#: Functions of a group and range added in one task.
FAN = 64
SALTS = 4
EVERY, NONE = -2, -1
#: Steps held by a task before it writes its functions and begins anew.
MOST_STEPS = 1 << 20

FUNCTION = "nation int, range bigint, block bigint, at array<int>, dn array<bigint>, dc array<bigint>, n bigint, c bigint, top bigint"


def slot_of(df: DataFrame, column: str, slot: int = SLOT) -> Column:
    """UTC seconds since 1970 of a time, with or without a zone, in whole slots; the slot divides a day."""
    at = F.col(f"`{column}`")
    if isinstance(df.schema[column].dataType, TimestampType):
        return F.floor(F.unix_seconds(at) / slot)
    day = F.unix_date(at.cast("date")).cast("long") * (86400 // slot)
    return day + F.floor((F.hour(at) * 3600 + F.minute(at) * 60 + F.floor(F.second(at))) / slot)


def sale_steps(sales: DataFrame, lines: DataFrame, clients: DataFrame, slot: int = SLOT) -> DataFrame:
    """(nation, slot, dn, dc): what starts and ends together change, once for each client and slot at most."""
    ends = lines.select("sale_id", slot_of(lines, "shipped_at", slot).alias("end")).dropna().groupBy("sale_id").agg(F.max("end").alias("end"))
    cents = F.floor(F.col("total") * 100 + 0.5)
    cents = F.when(F.abs(F.col("total")) < float(1 << 53) / 100, cents).otherwise(0).cast("long")
    spans = sales.select("sale_id", "client_id", slot_of(sales, "sold_at", slot).alias("start"), cents.alias("cents")).filter("start IS NOT NULL")
    spans = spans.join(ends, "sale_id", "left").filter("end IS NULL OR end > start")
    step = lambda at, sign: F.struct(F.col(at).alias("slot"), F.lit(sign).cast("long").alias("dn"), (F.col("cents") * sign).alias("dc"))
    steps = spans.select("client_id", F.explode(F.array(step("start", 1), step("end", -1))).alias("s")).select("client_id", "s.*").filter("slot IS NOT NULL")
    steps = steps.groupBy("client_id", "slot").agg(F.sum("dn").alias("dn"), F.sum("dc").alias("dc")).filter("dn <> 0 OR dc <> 0")
    nations = clients.groupBy("client_id").agg(F.min("nation_id").alias("nation")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = steps.withColumn("salt", F.pmod(F.floor(F.col("slot") / SPAN), F.lit(SALTS)).cast("int"))
    return salted.join(nations, ["client_id", "salt"], "left").select(F.coalesce("nation", F.lit(NONE)).cast("int").alias("nation"), "slot", "dn", "dc")


def added(nation: np.ndarray, slot: np.ndarray, dn: np.ndarray, dc: np.ndarray) -> list[np.ndarray]:
    """Steps in order, those of one nation and slot added up; without those that change nothing."""
    order = np.lexsort((slot, nation))
    nation, slot, dn, dc = nation[order], slot[order], dn[order], dc[order]
    if len(nation):
        heads = np.flatnonzero(np.concatenate([[True], (nation[1:] != nation[:-1]) | (slot[1:] != slot[:-1])]))
        nation, slot, dn, dc = nation[heads], slot[heads], np.add.reduceat(dn, heads), np.add.reduceat(dc, heads)
    some = (dn != 0) | (dc != 0)
    return [x[some] for x in (nation, slot, dn, dc)]


def functions(steps: list[np.ndarray], block: int, span: int) -> pa.RecordBatch:
    """Steps in order as one row for each nation and range."""
    nation, slot, dn, dc = steps
    spans = slot // span
    heads = np.flatnonzero(np.concatenate([np.ones(min(1, len(slot)), bool), (nation[1:] != nation[:-1]) | (spans[1:] != spans[:-1])]))
    offsets = pa.array(np.append(heads, len(slot)).astype(np.int32))
    listed = lambda x, kind: pa.ListArray.from_arrays(offsets, pa.array(x, kind))
    if len(heads):
        sums, cents = np.add.reduceat(dn, heads), np.add.reduceat(dc, heads)
        runs = np.cumsum(dn)
        top = np.maximum.reduceat(runs, heads) - (runs[heads] - dn[heads])
    else:
        sums = cents = top = np.zeros(0, np.int64)
    columns = [pa.array(nation[heads], pa.int32()), pa.array(spans[heads], pa.int64()), pa.array(np.full(len(heads), block, np.int64))]
    columns += [listed(slot - spans * span, pa.int32()), listed(dn, pa.int64()), listed(dc, pa.int64()), *[pa.array(x, pa.int64()) for x in (sums, cents, top)]]
    return pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in FUNCTION.split(", ")])


def partition_functions(steps: DataFrame, span: int = SPAN, every: bool = True) -> DataFrame:
    """Each partition's steps as compact functions, those of EVERY included; block numbers the partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block = TaskContext.get().partitionId()
        held = [np.zeros(0, np.int64)] * 4
        for batch in batches:
            new = [batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(4)]
            if every:
                new = [np.concatenate(x) for x in ((new[0], np.full(len(new[0]), EVERY, np.int64)), *[(x, x) for x in new[1:]])]
            held = added(*[np.concatenate(x) for x in zip(held, new, strict=True)])
            if len(held[0]) > MOST_STEPS:
                yield functions(held, block, span)
                held = [np.zeros(0, np.int64)] * 4
        yield functions(held, block, span)

    return steps.select("nation", "slot", "dn", "dc").mapInArrow(run, FUNCTION)


def add_pairs(span: int):
    """A mapInArrow function over functions sorted by nation, range and block: those of one key are added in pairs, each sum with one of as many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, tree = None, []

        def put(leaf: list[np.ndarray]) -> None:
            weight = 1
            while tree and tree[-1][0] == weight:
                leaf = added(*[np.concatenate(x) for x in zip(tree.pop()[1], leaf, strict=True)])
                weight *= 2
            tree.append((weight, leaf))

        def close() -> pa.RecordBatch:
            whole = tree.pop()[1]
            while tree:
                whole = added(*[np.concatenate(x) for x in zip(tree.pop()[1], whole, strict=True)])
            return functions(whole, key[2], span)

        for batch in batches:
            nation, ranges, block = (batch.column(i).to_numpy() for i in range(3))
            at, dn, dc = (batch.column(i) for i in (3, 4, 5))
            cuts = at.offsets.to_numpy()
            flat = [x.values.to_numpy(zero_copy_only=False) for x in (at, dn, dc)]
            for i in range(batch.num_rows):
                here = (int(nation[i]), int(ranges[i]), int(block[i]))
                if here != key:
                    if tree:
                        yield close()
                    key = here
                a, b = cuts[i], cuts[i + 1]
                put([np.full(b - a, here[0], np.int64), flat[0][a:b].astype(np.int64) + here[1] * span, flat[1][a:b], flat[2][a:b]])
        if tree:
            yield close()

    return run


def tree_merge(parts: DataFrame, stored: Stored, span: int = SPAN, fan: int = FAN) -> DataFrame:
    """One function for each nation and range, added up a tree over the blocks."""
    now = stored.put(parts)
    while True:
        last = now.agg(F.max("block")).first()[0]
        step = now.withColumn("block", F.floor(F.col("block") / fan)).repartition("nation", "range", "block").sortWithinPartitions("nation", "range", "block")
        then = stored.put(step.mapInArrow(add_pairs(span), FUNCTION).filter(F.size("at") > 0))
        stored.drop(now)
        if last is None or last < fan:
            return then
        now = then


def sweep(steps: DataFrame, stored: Stored, slot: int = SLOT, span: int = SPAN, fan: int = FAN, every: bool = True) -> DataFrame:
    """steps: nation, slot, dn, dc -> nation_id, from_s, to_s, n_open, open_cents, high_open, is_peak for every slot that changes something."""
    whole = tree_merge(partition_functions(steps, span, every), stored, span, fan)
    over = Window.partitionBy("nation").orderBy("range")
    before = over.rowsBetween(Window.unboundedPreceding, -1)
    carry = whole.select("nation", "range", "n", "c", "top", (F.col("range") * span + F.element_at("at", 1)).alias("first"))
    carry = carry.withColumns({"n0": F.coalesce(F.sum("n").over(before), F.lit(0)), "c0": F.coalesce(F.sum("c").over(before), F.lit(0)), "next": F.lead("first").over(over)})
    carry = carry.withColumn("top", F.col("n0") + F.col("top"))
    carry = carry.withColumns({"high": F.max("top").over(before), "peak": F.max("top").over(Window.partitionBy("nation"))})
    rows = whole.select("nation", "range", "at", "dn", "dc").join(carry.select("nation", "range", "n0", "c0", "next", "high", "peak"), ["nation", "range"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                start = (np.array(r["at"], np.int64) + r["range"] * span) * slot
                n, c = r["n0"] + np.cumsum(np.array(r["dn"], np.int64)), r["c0"] + np.cumsum(np.array(r["dc"], np.int64))
                high = np.maximum.accumulate(n)
                if r["high"] is not None:
                    high = np.maximum(high, r["high"])
                ends = pa.array([*start[1:].tolist(), None if r["next"] is None else r["next"] * slot], pa.int64())
                columns = [pa.array(np.full(len(n), r["nation"], np.int32)), pa.array(start), ends, pa.array(n), pa.array(c), pa.array(high), pa.array(n == r["peak"])]
                yield pa.RecordBatch.from_arrays(columns, names=["nation_id", "from_s", "to_s", "n_open", "open_cents", "high_open", "is_peak"])

    return rows.mapInArrow(run, "nation_id int, from_s bigint, to_s bigint, n_open bigint, open_cents bigint, high_open bigint, is_peak boolean")


def open_sales(sales: DataFrame, lines: DataFrame, clients: DataFrame, slot: int = SLOT) -> DataFrame:
    """How many sales are open, and for how much, by nation and over all."""
    return sweep(sale_steps(sales, lines, clients, slot), Stored(sales.sparkSession, "open"), slot)


def op13_peak_concurrency(spark: SparkSession, sf_dir: str) -> DataFrame:
    sales, lines, clients = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("sales", "sale_lines", "clients"))
    return open_sales(sales, lines, clients)


_SQL = f"""
WITH e AS (SELECT sale_id, max(shipped_at) AS shipped FROM sale_lines GROUP BY sale_id),
s AS (SELECT coalesce(c.nation_id, {NONE}) AS nation_id, CAST(floor(epoch(sold_at) / {SLOT}) AS BIGINT) * {SLOT} AS a, CAST(floor(epoch(shipped) / {SLOT}) AS BIGINT) * {SLOT} AS b,
        coalesce(CAST(floor(100 * total + 0.5) AS BIGINT), 0) AS cents
      FROM sales LEFT JOIN e ON e.sale_id = sales.sale_id LEFT JOIN clients c ON c.client_id = sales.client_id WHERE sold_at IS NOT NULL),
k AS (SELECT * FROM s WHERE b IS NULL OR b > a UNION ALL SELECT {EVERY}, a, b, cents FROM s WHERE b IS NULL OR b > a),
v AS (SELECT nation_id, a AS t, 1 AS n, cents AS c FROM k UNION ALL SELECT nation_id, b, -1, -cents FROM k WHERE b IS NOT NULL),
m AS (SELECT nation_id, t, sum(n) AS n, sum(c) AS c FROM v GROUP BY nation_id, t HAVING sum(n) <> 0 OR sum(c) <> 0),
o AS (SELECT nation_id, t, lead(t) OVER w AS to_s, CAST(sum(n) OVER w AS BIGINT) AS n_open, CAST(sum(c) OVER w AS BIGINT) AS open_cents FROM m WINDOW w AS (PARTITION BY nation_id ORDER BY t))
SELECT nation_id, t AS from_s, to_s, n_open, open_cents, max(n_open) OVER (PARTITION BY nation_id ORDER BY t) AS high_open, n_open = max(n_open) OVER (PARTITION BY nation_id) AS is_peak FROM o
"""

QUERIES = {"op13_peak_concurrency": op13_peak_concurrency}
ORACLES = {"op13_peak_concurrency": _SQL}
