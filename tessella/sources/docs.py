"""Structured inputs and outputs: hydrate responses (JSON), listings (XML), configuration (TOML), exposition text and JSON reports."""

from __future__ import annotations

import json
import tomllib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HYDRATE_SCHEMA = (
    "job_id STRING, total_files BIGINT, total_chunks BIGINT, total_bytes BIGINT, elapsed_ms BIGINT, throughput_mib_s DOUBLE, "
    "peers ARRAY<STRUCT<node_id: STRING, assigned: BIGINT, fetched: BIGINT, bytes: BIGINT, errors: ARRAY<STRING>>>"
)
LISTING_SCHEMA = (
    "Blobs STRUCT<Blob: ARRAY<STRUCT<Name: STRING, Properties: STRUCT<`Content-Length`: BIGINT, Etag: STRING, `Last-Modified`: STRING>>>, BlobPrefix: ARRAY<STRUCT<Name: STRING>>>, NextMarker STRING"
)
KINDS = ("tcp", "rdma")


def parse_hydrate(docs: DataFrame, column: str = "doc") -> DataFrame:
    """One row a peer, with the response's totals."""
    d = docs.select(*[c for c in docs.columns if c != column], F.from_json(column, HYDRATE_SCHEMA).alias("d"))
    return d.select(*[c for c in docs.columns if c != column], "d.total_files", "d.total_chunks", "d.total_bytes", "d.elapsed_ms", F.explode_outer("d.peers").alias("p")).select("*", "p.*").drop("p")


def parse_listing_xml(pages: DataFrame, column: str = "xml") -> DataFrame:
    """kind (blob or prefix), name, content_length (0 if absent), etag, last_modified."""
    d = pages.select(*[c for c in pages.columns if c != column], F.from_xml(F.col(column), LISTING_SCHEMA).alias("d"))
    keep = [c for c in pages.columns if c != column]
    blobs = d.select(*keep, F.explode("d.Blobs.Blob").alias("b")).select(*keep, F.lit("blob").alias("kind"), F.col("b.Name").alias("name"), F.coalesce(F.col("b.Properties.`Content-Length`"), F.lit(0)).alias("content_length"), F.col("b.Properties.Etag").alias("etag"), F.col("b.Properties.`Last-Modified`").alias("last_modified"))
    none = F.lit(None).cast("string")
    prefixes = d.select(*keep, F.explode("d.Blobs.BlobPrefix").alias("b")).select(*keep, F.lit("prefix").alias("kind"), F.col("b.Name").alias("name"), F.lit(0).cast("bigint").alias("content_length"), none.alias("etag"), none.alias("last_modified"))
    return blobs.unionByName(prefixes)


def exposition_lines(samples: DataFrame) -> DataFrame:
    """metric, host, value -> metric, host, line: one line a sample."""
    return samples.select("metric", "host", F.format_string('%s{node="%s"} %d', "metric", "host", "value").alias("line"))


def write_exposition(samples: DataFrame, path: str) -> None:
    """Text files in order of metric and host over as many tasks as the session has, each metric's type before its first sample."""
    typed = samples.select("metric").distinct().select("metric", F.lit("").alias("host"), F.format_string("# TYPE %s counter", "metric").alias("line"))
    exposition_lines(samples).unionByName(typed).orderBy("metric", "host").select("line").write.text(path)


def stats_json(rows: DataFrame, by: str) -> DataFrame:
    return rows.select(by, F.to_json(F.struct(*[c for c in rows.columns if c != by])).alias("json"))


DEFAULTS = {"cache": {"chunk_size": 4194304, "max_bytes": 0}, "azure": {"pool": 1, "workers": 1, "block_size": None}, "transport": {"kind": "tcp", "prefetch_depth": 16, "prefetch_threshold": 3}, "runtime": {"main_threads": 8}}
CONFIG_SCHEMA = (
    "chunk_size BIGINT, block_size BIGINT, pool BIGINT, workers BIGINT, main_threads BIGINT, kind STRING, prefetch_depth BIGINT, prefetch_threshold BIGINT, "
    "mounts ARRAY<STRUCT<name: STRING, account: STRING, container: STRING, prefix: STRING>>"
)


def config_row(text: str) -> dict:
    """A TOML document's settings, with defaults where it says nothing."""
    raw = tomllib.loads(text)
    get = lambda part, key: raw.get(part, {}).get(key, DEFAULTS[part][key])
    mounts = [{f: m.get(f, "") for f in ("name", "account", "container", "prefix")} for m in raw.get("mounts", [])]
    parts = {"chunk_size": "cache", "block_size": "azure", "pool": "azure", "workers": "azure", "main_threads": "runtime", "kind": "transport", "prefetch_depth": "transport", "prefetch_threshold": "transport"}
    return {k: get(part, k) for k, part in parts.items()} | {"mounts": mounts}


def load_config(spark: SparkSession, text: str) -> DataFrame:
    """A TOML document as one row."""
    return spark.createDataFrame([config_row(text)], CONFIG_SCHEMA)


def parse_configs(texts: DataFrame) -> DataFrame:
    """cfg, toml -> cfg, config: a struct of the settings, null if the text can't be read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                try:
                    out.append(json.dumps(config_row(text or "")))
                except (tomllib.TOMLDecodeError, AttributeError):
                    out.append(None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["cfg", "json"])

    read = texts.select("cfg", "toml").mapInArrow(run, f"cfg {dict(texts.dtypes)['cfg']}, json string")
    return read.select("cfg", F.from_json("json", CONFIG_SCHEMA).alias("config"))


def config_rules() -> dict[str, Column]:
    """Rule -> true where a configuration breaks it."""
    c = F.col
    return {
        "chunk_size": (c("chunk_size") == 0) | (c("chunk_size") % 4096 != 0),
        "pool": c("pool") < 1,
        "workers": c("workers") < 1,
        "main_threads": c("main_threads") < 1,
        "block_size": c("block_size").isNotNull() & ((c("block_size") < c("chunk_size")) | (c("block_size") % F.nullif(c("chunk_size"), F.lit(0)) != 0)),
        "mounts": F.size("mounts") < 1,
        "mount_fields": F.exists("mounts", lambda m: (m["name"] == "") | (m["account"] == "") | (m["container"] == "")),
        "kind": ~c("kind").isin(*KINDS),
    }


def config_violations(configs: DataFrame, by: str) -> DataFrame:
    broken = F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in config_rules().items()]))
    return configs.select(by, F.explode(broken).alias("rule"))
