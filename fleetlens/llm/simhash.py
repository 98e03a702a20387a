"""SimHash near-dedup: fingerprints, a multi-index search for close ones, and their components."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import BATCH_BYTES, Texts, blank_slices, map_texts, record, slim, written
from fleetlens.llm.components import components

SEED = 42
SHINGLE_BLOCK = 1 << 16  # shingles whose bits are counted at once

# A segment value held by more fingerprints than this is linked through shared
# neighbours instead of pairs. Both ways find the same links.
PAIRED = 64


def _shingle_hashes(text: bytes, width: int) -> np.ndarray:
    """XXH64 of each run of ``width`` words; of all words if they are fewer."""
    return _hashes_of(text.lower().split(), width)  # bytes: only A-Z, and only ASCII blanks


def _hashes_of(words: list[bytes], width: int) -> np.ndarray:
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    if len(words) >= width:
        starts, ends = starts[: len(words) - width + 1], ends[width - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    h = xxhash.xxh64_intdigest
    return np.array([h(line[a:b], SEED) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], np.uint64)


def _majority(hashes: np.ndarray) -> int:
    """A bit is 1 where over half the hashes have it."""
    return _most(_bit_counts(hashes), len(hashes))


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), SHINGLE_BLOCK):
        block = hashes[at : at + SHINGLE_BLOCK].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return counts


def _most(counts: np.ndarray, n: int) -> int:
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def _of_slices(data: np.ndarray, width: int, limit: int = BATCH_BYTES) -> int:
    """The fingerprint of one long text, of which only a slice's words are held at a time."""
    counts, n, held = np.zeros(64, np.int64), 0, []
    for part in blank_slices(data, limit):
        held += part.lower().split()
        if len(held) >= width:
            hashes = _hashes_of(held, width)
            counts, n, held = counts + _bit_counts(hashes), n + len(hashes), held[len(held) - width + 1 :]
    return _most(counts, n) if n else _majority(_hashes_of(held, width))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """``(id, fp)``: the 64-bit SimHash of each text's ``width``-word shingles, as a signed long.

    A text without words, an empty or a null one has fingerprint zero.
    """

    def work(texts: Texts) -> pa.RecordBatch:
        if len(texts) == 1 and len(texts.data) > BATCH_BYTES:
            return record(id=texts.ids, fp=np.array([_of_slices(texts.data, width)], np.uint64).astype(np.int64))
        made = np.fromiter((_majority(_shingle_hashes(t, width)) for t in texts.each()), np.uint64, len(texts))
        return record(id=texts.ids, fp=made.astype(np.int64))

    frame = slim(docs, id_col, text_col)
    return map_texts(frame, f"id {frame.schema['id'].dataType.simpleString()}, fp long", work)


def _high(fp: Column) -> Column:
    return F.shiftrightunsigned(fp, 32)


def _low(fp: Column) -> Column:
    return fp.bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))


def _flips(bits: int) -> Column:
    """Zero, and each single bit below ``bits``."""
    return F.array(F.lit(0).cast("long"), *[F.lit((1 << k) - (1 << 64) * (k == 63)).cast("long") for k in range(bits)])


def close_links(prints: DataFrame) -> DataFrame:
    """Links ``(a, b)``, a < b, that join all distinct ``fp`` within two bits of each other.

    Multi-index hashing with two 32-bit segments: if two fingerprints differ in at most
    two bits, their low segments are equal or their high segments differ in at most one
    bit. So the low segment itself and the ball of radius one around the high segment
    are looked up in the two segment tables, and the whole distance of each match is
    verified.

    A segment value that more than ``PAIRED`` fingerprints hold would give the square of
    their number. All fingerprints that hold it or look it up are linked by the exact
    other way: two fingerprints are within two bits of each other just when the balls of
    radius one around them have a point in common, so each is linked to the smallest
    that has the point. That links no two that aren't within two bits.
    """
    fps = prints.select("fp")
    held = fps.select("fp", F.explode(F.array(_key(0, _low(F.col("fp"))), _key(1, _high(F.col("fp"))))).alias("key"))
    asked = fps.select(
        "fp",
        F.explode(
            F.concat(
                F.array(_key(0, _low(F.col("fp")))),
                F.transform(_flips(32), lambda x: _key(1, _high(F.col("fp")).bitwiseXOR(x))),
            )
        ).alias("key"),
    )
    busy = written(held.groupBy("key").count().where(F.col("count") > PAIRED).select("key"), "simhash-busy")
    table = held.join(busy, "key", "left_anti").select("key", F.col("fp").alias("other"))
    pairs = (
        asked.join(table, "key")
        .where(F.col("fp") != F.col("other"))
        .where(F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= 2)
        .select(F.least("fp", "other").alias("a"), F.greatest("fp", "other").alias("b"))
    )
    if busy.isEmpty():
        return pairs.distinct()
    crowd = written(asked.join(busy, "key").select("fp").distinct(), "simhash-crowd")
    points = crowd.select("fp", F.explode(F.transform(_flips(64), lambda x: F.col("fp").bitwiseXOR(x))).alias("point"))
    first = written(
        points.groupBy("point").agg(F.min("fp").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1").select("point", "a"),
        "simhash-points",
    )
    through = points.join(first, "point").where("a <> fp").select("a", F.col("fp").alias("b"))
    return pairs.unionByName(through).distinct()


def _key(segment: int, value: Column) -> Column:
    """The segment's number and value in one long."""
    return value.bitwiseOR(F.lit(segment << 32).cast("long"))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """One row per document: ``(id_col, fingerprint, component_id)``.

    Documents are linked if their fingerprints differ in at most two bits, and
    ``component_id`` is the smallest id that can be reached over links. Copies share one
    fingerprint, which is searched once. Rows repeated with one id stay as they are; null
    ids are never the smallest unless there is no other. Texts without words have
    fingerprint zero and are linked like any other.
    """
    prints = written(fingerprints(docs, id_col, text_col, width), "simhash-prints")
    low = written(prints.groupBy("fp").agg(F.min("id").alias("low")), "simhash-distinct")
    joined = components(close_links(low))  # (node, root) of fingerprints that have links
    named = written(
        low.join(joined, low.fp == joined.node, "left").select("fp", "low", F.coalesce("root", "fp").alias("root")),
        "simhash-roots",
    )
    smallest = written(named.groupBy("root").agg(F.min("low").alias("component_id")), "simhash-smallest")
    per_print = written(named.join(smallest, "root").select("fp", "component_id"), "simhash-components")
    return prints.join(per_print, "fp").select(
        F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )
