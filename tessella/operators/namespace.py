"""Directory views over a flat listing: virtual folders, one or all of them, refresh by difference, capped and paged children."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.policy import strip_prefix
from .transfer import numbered


def list_directory(listing: DataFrame, prefix: str, recursive: bool = False) -> DataFrame:
    """name, kind, size: what lies under a prefix; without `recursive`, what lies deeper is one folder by its first segment."""
    under = listing.filter(F.startswith("blob", F.lit(prefix))).select(strip_prefix(F.col("blob"), F.lit(prefix)).alias("rel"), "content_length").filter("rel <> ''")
    if recursive:
        return under.select(F.col("rel").alias("name"), F.lit("file").alias("kind"), F.col("content_length").alias("size"))
    deep = F.contains("rel", F.lit("/"))
    dirs = under.filter(deep).select(F.split_part("rel", F.lit("/"), F.lit(1)).alias("name")).distinct().select("name", F.lit("dir").alias("kind"), F.lit(None).cast("bigint").alias("size"))
    files = under.filter(~deep).select(F.col("rel").alias("name"), F.lit("file").alias("kind"), F.col("content_length").alias("size"))
    return dirs.unionByName(files)


def folder_rollup(listing: DataFrame) -> DataFrame:
    """folder ('' is the root, others end in '/'), depth, files and dirs (its direct children), blobs and bytes below it, for every folder that a listing implies.

    Blobs are summed by their own folder first, so what is exploded to ancestors, and sums again before its shuffle, are folders. The root is
    one row a task. A blob whose name ends in '/' is a marker of its folder: the folder counts, no file."""
    folder = F.regexp_extract("blob", "^(.*/)?", 0)
    own = listing.groupBy(folder.alias("folder")).agg(
        F.count_if(~F.endswith("blob", F.lit("/"))).alias("files"),
        F.sum(F.when(~F.endswith("blob", F.lit("/")), F.col("content_length")).otherwise(0)).cast("bigint").alias("bytes"),
    )
    parts = F.split("folder", "/")
    depth = F.size(parts) - 1
    ups = own.select("files", "bytes", parts.alias("p"), F.explode(F.sequence(F.lit(0), depth)).alias("depth"), depth.alias("own"))
    name = F.when(F.col("depth") == 0, "").otherwise(F.concat(F.array_join(F.slice("p", 1, F.col("depth")), "/"), F.lit("/")))
    every = ups.groupBy(name.alias("folder"), "depth").agg(
        F.sum(F.when(F.col("depth") == F.col("own"), F.col("files")).otherwise(0)).cast("bigint").alias("files"),
        F.sum("files").cast("bigint").alias("blobs"),
        F.sum("bytes").cast("bigint").alias("bytes"),
    )
    parent = F.regexp_replace("folder", "[^/]*/$", "")
    dirs = every.filter("depth > 0").groupBy(parent.alias("folder")).agg(F.count(F.lit(1)).alias("dirs"))
    return every.join(dirs, "folder", "left").select("folder", "depth", "files", F.coalesce("dirs", F.lit(0)).cast("bigint").alias("dirs"), "blobs", "bytes")


def children(listing: DataFrame) -> DataFrame:
    """folder, name, kind, size: the direct children of every folder at once; a folder's size is null."""
    files = listing.filter(~F.endswith("blob", F.lit("/"))).select(F.regexp_extract("blob", "^(.*/)?", 0).alias("folder"), F.regexp_extract("blob", "[^/]*$", 0).alias("name"), F.lit("file").alias("kind"), F.col("content_length").alias("size"))
    dirs = folder_rollup(listing).filter("depth > 0").select(F.regexp_replace("folder", "[^/]*/$", "").alias("folder"), F.regexp_extract("folder", "([^/]*)/$", 1).alias("name"), F.lit("dir").alias("kind"), F.lit(None).cast("bigint").alias("size"))
    return files.unionByName(dirs)


#: What a listing may say of a blob besides its name: any that differs makes an update.
PROPERTIES = ("size", "etag", "mtime")


def refresh(tracked: DataFrame, listed: DataFrame) -> DataFrame:
    """name -> action: insert, update (size, etag or mtime differs, of those that both sides have), keep, delete; a tracked folder stays a folder."""
    compared = [p for p in PROPERTIES if p in tracked.columns and p in listed.columns]
    side = lambda df, of: df.select("name", *[F.col(c).alias(f"{of}_{c}") for c in ("kind", *compared)])
    j = side(tracked, "old").join(side(listed, "new"), "name", "full_outer")
    differs = F.lit(False)
    for p in compared:
        differs = differs | ~F.col(f"old_{p}").eqNullSafe(F.col(f"new_{p}"))
    action = F.when(F.col("old_kind").isNull(), "insert").when(F.col("new_kind").isNull(), "delete").when(F.col("old_kind") == "dir", "keep").when(differs, "update").otherwise("keep")
    return j.select("name", action.alias("action"))


def capped_children(listed: DataFrame, known: DataFrame, cap: int) -> DataFrame:
    """Names already known stay; new ones, folders first, fill what is left of the cap."""
    k = known.select("name").distinct().withColumn("known", F.lit(True))
    room = cap - known.select("name").distinct().count()
    new = listed.join(k, "name", "left_anti").orderBy(F.when(F.col("kind") == "dir", 0).otherwise(1), "name").limit(max(0, room))
    stay = listed.join(k.select("name"), "name", "left_semi")
    return stay.select("name", "kind").unionByName(new.select("name", "kind"))


def page(children: DataFrame, skip: int) -> DataFrame:
    """Directory entries after the first `skip`: '.' and '..' come first, then children by name."""
    spark = children.sparkSession
    dots = spark.range(2).select(F.when(F.col("id") == 0, ".").otherwise("..").alias("name"), F.lit("dir").alias("kind"), (F.col("id") + 1).alias("pos"))
    rest = numbered(children.select("name", "kind"), ["name"]).select("name", "kind", (F.col("i") + 3).cast("bigint").alias("pos"))
    return dots.unionByName(rest).filter(F.col("pos") > skip)
