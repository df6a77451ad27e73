"""Text inputs: exposition text, tables by tab or comma, markers, training logs, pass results. Rows that can't be read are kept apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SAMPLER_FIELDS = ("epoch_ms", "host", "fuse", "peer", "blob", "net_rx", "net_tx", "cpu", "mem", "disk_r", "disk_w")
PASS_PATTERN = r"^(\S+)\s+(?:(\S+)\s+)?(?:RESULT\s+)?files=(\d+)\s+bytes=(\d+)\s+wall_s=([0-9.]+)\s*$"
#: A progress mark: place, total, time so far, and what follows the pace up to the closing bracket.
STEP_PATTERN = r"(\d+)/(\d+)\s*\[(\d+(?::\d+)+)<[^,\]]*(?:,([^\]]*))?\]"
#: What a log says when a phase begins (fixed values).
PHASES = {"ckpt_start": "Loading checkpoint from", "vae_start": "hunyuan_vae", "steps_start": "Beginning epoch"}


def whole_number(c: Column) -> Column:
    """A number as text, cut to its whole part; null if it is none."""
    return c.try_cast("double").cast("bigint")


def parse_exposition(lines: DataFrame, by: list[str] | None = None) -> DataFrame:
    """line_no, line -> key, value: comments, blanks and unreadable values are left out; of a key's lines the last counts."""
    by = by or []
    text = F.trim("line")
    p = lines.filter((text != "") & ~F.startswith(text, F.lit("#"))).select(*by, "line_no", F.split(text, r"\s+").alias("t"))
    p = p.select(*by, "line_no", F.get("t", F.lit(0)).alias("key"), F.element_at("t", -1).try_cast("double").alias("v")).filter("v IS NOT NULL")
    return p.groupBy(*by, "key").agg(F.max_by("v", "line_no").alias("value"))


def pick_metric(parsed: DataFrame, wanted: DataFrame, by: list[str]) -> DataFrame:
    """wanted: by, key -> value, 0 if absent."""
    return wanted.join(parsed, [*by, "key"], "left").select(*by, "key", F.coalesce("value", F.lit(0.0)).alias("value"))


def metric_name(key: Column) -> Column:
    return F.split_part(key, F.lit("{"), F.lit(1))


def label(key: Column, name: str) -> Column:
    return F.regexp_extract(key, name + '="([^"]*)"', 1)


def parse_snapshot_tsv(lines: DataFrame) -> DataFrame:
    """pod, node and 'metric value' by tabs; '#' lines left out."""
    t = lines.filter(~F.startswith("line", F.lit("#"))).select(F.split("line", "\t").alias("t")).filter(F.size("t") == 3)
    mv = F.split(F.get("t", F.lit(2)), " ")
    return t.select(F.get("t", F.lit(0)).alias("pod"), F.get("t", F.lit(1)).alias("node"), F.get(mv, F.lit(0)).alias("metric"), F.get(mv, F.lit(1)).try_cast("double").alias("value")).filter("value IS NOT NULL")


def parse_sampler(lines: DataFrame) -> DataFrame:
    """Comma rows epoch_ms, host, fuse, peer, blob: rows with an unreadable number are skipped, a blank fuse column is 0."""
    t = lines.select(F.split("line", ",").alias("t")).filter(F.size("t") >= 5)
    blank = F.when(F.trim(F.get("t", F.lit(2))) == "", F.lit(0).cast("bigint")).otherwise(whole_number(F.get("t", F.lit(2))))
    p = t.select(whole_number(F.get("t", F.lit(0))).alias("epoch_ms"), F.get("t", F.lit(1)).alias("host"), blank.alias("fuse"), whole_number(F.get("t", F.lit(3))).alias("peer"), whole_number(F.get("t", F.lit(4))).alias("blob"))
    return p.dropna()


def last_by_host(rows: DataFrame, order: str) -> DataFrame:
    """Of a host's rows the last one counts."""
    others = [c for c in rows.columns if c not in ("host", order)]
    g = rows.groupBy("host").agg(F.max_by(F.struct(*others), order).alias("r"))
    return g.select("host", *[F.col(f"r.{c}").alias(c) for c in others])


def parse_markers(lines: DataFrame) -> DataFrame:
    """'epoch NAME' or 'K=V' lines -> kind, key, value."""
    at = F.regexp_extract("line", r"^(\d+)\s+(\S+)$", 1)
    named = lines.filter(at != "").select(F.lit("marker").alias("kind"), F.regexp_extract("line", r"^(\d+)\s+(\S+)$", 2).alias("key"), at.alias("value"))
    pair = F.regexp_extract("line", r"^([A-Za-z_]\w*)=(.*)$", 1)
    pairs = lines.filter(pair != "").select(F.lit("setting").alias("kind"), pair.alias("key"), F.regexp_extract("line", r"^([A-Za-z_]\w*)=(.*)$", 2).alias("value"))
    return named.unionByName(pairs)


def strip_ansi(c: Column) -> Column:
    return F.regexp_replace(c, "\x1b\\[[0-9;]*[A-Za-z]", "")


def parse_steps(logs: DataFrame, by: list[str]) -> DataFrame:
    """by, text -> step, total, elapsed_s, s_it, loss, grad_norm, global_step for each progress mark in the text, in order (pos)."""
    from ..functions.policy import elapsed_seconds

    body = logs.select(*by, strip_ansi(F.col("text")).alias("t"))
    marks = lambda g: F.regexp_extract_all("t", F.lit(STEP_PATTERN), g)
    rows = body.select(*by, F.posexplode(F.arrays_zip(*[marks(i + 1).alias(c) for i, c in enumerate(("step", "total", "elapsed", "rest"))])).alias("pos", "m"))
    said = lambda name, kind: F.regexp_extract("m.rest", rf"(?:^|[ ,]){name}=([0-9.eE+-]+)", 1).try_cast(kind)
    return rows.select(
        *by,
        "pos",
        F.col("m.step").cast("bigint").alias("step"),
        F.col("m.total").cast("bigint").alias("total"),
        elapsed_seconds(F.col("m.elapsed")).alias("elapsed_s"),
        F.regexp_extract("m.rest", r"([0-9.]+)s/it", 1).try_cast("double").alias("s_it"),
        said("loss", "double").alias("loss"),
        said("global_grad_norm", "double").alias("grad_norm"),
        said("global_step", "bigint").alias("global_step"),
    )


def phase_times(logs: DataFrame, by: list[str]) -> DataFrame:
    """by, text -> when each phase begins: the time in brackets on the first line of rank 0 ('0:' in front) that names it; and how long the
    checkpoint took to load, null unless both its ends are there."""
    lines = F.filter(F.split(strip_ansi(F.col("text")), "\n"), lambda x: x.rlike(r"^\s*0:"))
    first = lambda says: F.regexp_extract(F.get(F.filter(lines, lambda x: F.contains(x, F.lit(says))), F.lit(0)), r"\[(\d{4}-\d\d-\d\d \d\d:\d\d:\d\d)\]", 1)
    t = logs.select(*by, *[F.nullif(first(says), F.lit("")).alias(c) for c, says in PHASES.items()])
    at = lambda c: F.unix_timestamp(F.col(c), "yyyy-MM-dd HH:mm:ss")
    return t.withColumn("ckpt_load_s", (at("steps_start") - at("ckpt_start")).cast("bigint"))


def parse_passes(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Result lines in any of their layouts -> (pod, node, files, bytes, wall_s) and the lines that aren't results."""
    ok = F.col("line").rlike(PASS_PATTERN)
    g = lambda i: F.regexp_extract("line", PASS_PATTERN, i)
    good = lines.filter(ok).select("line_no", g(1).alias("pod"), F.nullif(g(2), F.lit("")).alias("node"), g(3).cast("bigint").alias("files"), g(4).cast("bigint").alias("bytes"), g(5).cast("double").alias("wall_s"))
    return good, lines.filter(~ok)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """line_no (in the file's order), line, file."""
    t = spark.read.text(path).select(F.col("value").alias("line"), F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("line_no"))
    return t
