"""A corpus pipeline of text operators: each stage's result is written and read again.

Low quality goes, then lines that earlier documents have, then near copies, then
documents that hold benchmark text; what is left is encoded. Rows without ``doc_id``
can't be told apart by it and pass the stages that compare documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.llm import bpe, quality
from fleetlens.llm.bloom import without_keys
from fleetlens.llm.common import part_of, table, written
from fleetlens.llm.decontaminate import decontaminate
from fleetlens.llm.line_dedup import without_repeats
from fleetlens.llm.simhash import near_dedup

LEAST_QUALITY = 0.7


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject; fitted on three quarters of the labels."""
    network = quality.fitted(docs, table(spark, sf_dir, "labels"), part_of("doc_id", 4) == 2)
    return quality.keep_good(docs, network, LEAST_QUALITY)


def fresh_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the blocks that earlier ones have; ``n_chars`` is what is left."""
    return without_repeats(docs).withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one of the smallest id, of each group of near copies."""
    copies = near_dedup(docs).where("doc_id <> component_id").select("doc_id")
    return without_keys(docs, written(copies, "near-copies"), "doc_id")


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated by the benchmark."""
    found = decontaminate(docs, table(spark, sf_dir, "benchmark")).where("contaminated").select("doc_id")
    return without_keys(docs, written(found, "contaminated"), "doc_id")


def coded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of each document's ids and of what they decode to."""
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


STAGES = [
    ("quality", good_quality),
    ("line dedup", fresh_lines),
    ("near dedup", one_of_each),
    ("decontamination", no_benchmark),
    ("bpe", coded),
]

# SQL can't express the classifier or the alignment.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the last one's rows."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
