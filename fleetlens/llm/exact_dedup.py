"""Exact dedup: a two-pass Bloom filter keeps rows that cannot be repeated out of the shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.bloom import mark_repeated
from fleetlens.llm.common import ways, written


def normalised(text: Column) -> Column:
    """Each run of blanks as one space; a null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``(id_col, keep_id, group_size, kept, text_sha256)``.

    Texts are equal if they are identical once each run of ASCII blanks is one space;
    of equal ones the row with the smallest id is kept. Equality is that of the texts'
    SHA-256. Pass 1 marks in a blocked Bloom filter the places that two or more rows
    set; only slim numbers are counted for it. Pass 2 tests each row: one with an
    unmarked place has no equal and passes straight through, and only the others
    shuffle by hash. A filter too full for its size lets more rows shuffle, but never
    changes the result.

    A null text is the empty text. Rows repeated with the same id count in
    ``group_size`` and all say ``kept`` if theirs is the smallest id. A null id is never
    the smallest unless a group has no other. Other columns are not looked at.
    """
    spark = docs.sparkSession
    rows = written(
        docs.select(F.col(id_col).alias("id"), F.unhex(F.sha2(normalised(F.col(text_col)), 256)).alias("h")),
        "exact-hashes",
    )
    tested = mark_repeated(rows, "h")
    alone = tested.where("not maybe").select(
        "id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), "h"
    )
    maybe = tested.where("maybe").withColumn("way", F.pmod(F.xxhash64("id"), F.lit(ways(spark))))
    groups = (
        maybe.groupBy("h", "way")
        .agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("n"))
        .groupBy("h")
        .agg(F.min("low").alias("keep_id"), F.sum("n").alias("group_size"), F.collect_list("way").alias("in_ways"))
        .select("h", "keep_id", "group_size", F.explode("in_ways").alias("way"))
    )
    found = maybe.join(groups, ["h", "way"]).select("id", "keep_id", "group_size", "h")
    return alone.unionByName(found).select(
        F.col("id").alias(id_col),
        "keep_id",
        "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("h")).alias("text_sha256"),
    )
