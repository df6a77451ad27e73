"""A training corpus from `documents`, in five stages.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next one's docs. All but the last return the columns of documents:

    quality   documents that the quality rules reject go
    lines     later occurrences of repeated passages go; documents that lose their last word with them go too
    simhash   one document of each component of near copies stays, the one with the smallest id; linked are fingerprints within 3 bits, and
              texts whose sets of five-word shingles have a similarity of 0.8
    mix       sources are mixed to their target weights: documents are dropped or repeated, always whole, and stand shard by shard in shuffled order
    pack      texts are tokenised and packed into sequences: one row a piece

Null texts fail the quality rules. Rows that repeat an id are documents of their own, of which simhash keeps one if they are linked; after
mix, a document drawn twice is two rows, and packed twice. SQL can't express components or packing, so ORACLE_SQL is None.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import linededup, mixing, packing, quality, simhash
from tessella.llm.common import WORD_PATTERN, Stored, documents

ORACLE_SQL = None


def stage_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.passing(docs)


def stage_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = linededup.dedup_lines(docs).filter((F.col("line_dedup.n_removed") == 0) | F.col("kept_text").rlike(WORD_PATTERN))
    new = {"text": F.col("kept_text"), "n_chars": F.when(F.col("line_dedup.n_removed") > 0, F.length("kept_text").cast("long")).otherwise(F.col("__row.n_chars"))}
    return out.select(*[new[c].alias(c) if c in new else F.col(f"__row.`{c}`") for c in docs.columns])


def stage_simhash(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def stage_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.shuffled(mixing.mix(docs, cut="whole")).select("__row.*")


def stage_pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs.select("doc_id", "text"))


STAGES = [
    ("quality rules", stage_quality),
    ("line dedup", stage_lines),
    ("SimHash near-dedup", stage_simhash),
    ("mixing sources to target weights", stage_mix),
    ("packing", stage_pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each but the last written to the shared folder."""
    stored = Stored(spark, "pipeline")
    docs = documents(spark, sf_dir)
    for i, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i + 1 == len(STAGES):
            return out
        docs = stored.put(out)
    return docs
