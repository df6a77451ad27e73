"""The exposition source: stretches of files, pushed filters, order within a file, streams with offsets."""

import math
import uuid

import pytest
from pyspark.sql import functions as F
from test_plans import plan

from tessella.session import shared_dir
from tessella.sources import exposition

LINES = ['# HELP x y', 'x 1', '', 'x{a="b"} 2.5', '  y{n="1"} +Inf  ', 'y nope', 'z_total{a="é"} 3e2', 'x 1_0', 'w NaN', 'x 7 ', 'x']


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    exposition.register(spark)
    base = tmp_path_factory.mktemp("scrapes")
    for i in range(6):
        (base / f"t{i:03d}.prom").write_text("\n".join(LINES * (i + 1)) + ("\n" if i % 2 else ""), encoding="utf-8")
    (base / "_hidden").write_text("x 1\n")
    (base / "more").mkdir()
    (base / "more" / "a.prom").write_text("x 5\n")
    return base


def brute(folder):
    out = []
    for path in sorted(folder.rglob("*.prom")):
        at = 0
        for line in path.read_bytes().split(b"\n"):
            words = line.decode().split()
            if words and words[0][0] != "#" and words[-1] not in ("nope", "1_0", "x"):
                out.append((str(path.relative_to(folder)), at, words[0], words[0].split("{")[0], float(words[-1])))
            at += len(line) + 1
    return out


def same(got, want):
    plain = lambda rows: sorted((*r[:4], "nan" if math.isnan(r[4]) else r[4]) for r in rows)
    return plain(got) == plain(want)


@pytest.mark.parametrize("stretch", [1, 7, 50, 1 << 20])
def test_batch(spark, folder, stretch):
    df = spark.read.format("exposition").option("stretch", stretch).load(f"file://{folder}")
    assert same(map(tuple, df.collect()), brute(folder))
    assert stretch > 50 or df.rdd.getNumPartitions() > 6


def test_pushed_filters(spark, folder):
    df = spark.read.format("exposition").load(str(folder))
    want = brute(folder)
    for condition, keep in (
        (F.col("name") == "x", lambda r: r[3] == "x"),
        (F.col("name").isin("x", "w"), lambda r: r[3] in "xw"),
        (F.col("name").startswith("z"), lambda r: r[3][0] == "z"),
        ((F.col("file") == "t002.prom") & (F.col("name") == "y") & (F.col("at") > 60), lambda r: r[0] == "t002.prom" and r[3] == "y" and r[1] > 60),
        ((F.col("name") == "x") & (F.col("name") == "w"), lambda r: False),
        (F.col("value") > 2, lambda r: r[4] > 2 or math.isnan(r[4])),
    ):
        assert same(map(tuple, df.filter(condition).collect()), [r for r in want if keep(r)])
    # What is pushed isn't tested again.
    assert "name" not in "".join(x for x in plan(df.filter(F.col("name") == "x")).split("\n") if x.startswith("Condition"))


def test_stream_takes_up_where_it_stopped(spark, folder):
    path = f"{shared_dir(spark)}/expo-{uuid.uuid4().hex}"

    def drained():
        src = spark.readStream.format("exposition").load(f"file://{folder}/")
        q = src.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
        q.awaitTermination()
        assert not q.exception()
        return [tuple(r) for r in spark.read.schema(exposition.SCHEMA).parquet(f"{path}/out").collect()], q.recentProgress

    first, _ = drained()
    assert same(first, brute(folder))
    again, _ = drained()
    assert len(again) == len(first)
    (folder / "t100.prom").write_text("late 1\nlate 2\n")
    third, _ = drained()
    assert same(third, brute(folder)) and len(third) == len(first) + 2
    (folder / "t100.prom").unlink()
