"""From raw documents to packed training sequences: five stages, each written as Parquet and reread.

1. quality: rejected documents go; the others stay whole.
2. near_duplicates: one document of each near-duplicate class stays, the one with the smallest doc_id.
3. secrets: found secrets are replaced by a mark in the text; no document goes.
4. mixing: the rows get the order of a stream that holds the target weights of the sources; none goes. Their
   places are the added columns mix_slot and mix_offset.
5. packing: the texts become pieces of at most 2048 tokens. Each window of WINDOW_SLOTS slots of the stream is packed
   in as few sequences as possible; sequences are numbered along the stream.

All stages but the last return the columns of their input, extra columns included; mixing adds its two. Null doc_ids stay null,
repeated rows of one id and text count as copies, and an empty table passes through as an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labspark.llm import mixing, neardup, packing, quality, secrets
from labspark.llm.shared import table, written

#: Slots of the stream that are packed together: some four cycles of the weights of twenty sources.
WINDOW_SLOTS = 128


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.kept_documents(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.one_of_each(docs)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redacted(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs, with_places=True)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    parts = packing.pieces(docs, public_tokenizers.path("byte_bpe_50k.json"), keep=("mix_slot", "mix_offset"))
    windows = parts.withColumn("_window", F.floor(F.col("mix_slot") / WINDOW_SLOTS))
    return packing.pack_in_order(windows, ["mix_slot", "mix_offset"], "_window")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("secrets", secret_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]
#: Tokenizing and weighted MinHash have no SQL form; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents, with a written table between them."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
