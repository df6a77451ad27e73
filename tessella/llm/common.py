"""Pieces that the training-data operators share."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What separates words: space and U+0009 to U+000D.
SPACES = " \t\n\x0b\x0c\r"
SPACE_CLASS = "[\\x20\\x09-\\x0D]"
WORD_PATTERN = "[^\\x20\\x09-\\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where it is unset, a new local folder, on one machine only."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="tessella-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


_written: set[str] = set()


def _remove(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def remove_stored(spark: SparkSession) -> None:
    """Removes the tables that this process has stored; results that read them must have been written before."""
    while _written:
        _remove(spark, _written.pop())


class Stored:
    """Tables written to the shared folder, which cut lineage and survive lost executors; drop() removes one early, remove_stored() all."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.base = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.count = 0
        _written.add(self.base)

    def put(self, df: DataFrame) -> DataFrame:
        self.count += 1
        path = f"{self.base}/{self.count}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._stored_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        path = getattr(df, "_stored_path", None)
        if path:
            _remove(self.spark, path)


def arrow_batches(spark: SparkSession, rows: int = 1000, size: int = 16 << 20) -> None:
    """Arrow batches of few enough rows and bytes for long texts; a session that has smaller ones keeps them."""
    for key, most, read in (("maxRecordsPerBatch", rows, int), ("maxBytesPerBatch", size, lambda x: int(x.rstrip("b")) if x.rstrip("b").lstrip("-").isdigit() else 0)):
        name = f"spark.sql.execution.arrow.{key}"
        if not 0 < read(spark.conf.get(name)) <= most:
            spark.conf.set(name, str(most))


def id_text(doc_id: Column | str) -> Column:
    """The id as text; empty for a null id."""
    return F.coalesce(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string"), F.lit(""))


def fold(doc_id: Column | str, parts: int) -> Column:
    """crc32 of the id as text, modulo parts."""
    return F.crc32(id_text(doc_id).cast("binary")) % F.lit(parts)


def let(value: Column, body) -> Column:
    """body(value) with the value computed once, however often the body, or a lambda within it, refers to it."""
    return F.transform(F.array(value), body)[0]


def word_list(text: Column) -> Column:
    """The words of a text (none for null)."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE_CLASS + "+"))


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD_PATTERN)).cast("long")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
