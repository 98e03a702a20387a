"""A Bloom filter of repeated keys as a small table of bitmaps, made and read by SQL functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK_BITS = 32_768  # one block of the filter: 4 KB
ROW_BITS = 16  # bits of the filter per row ...
MOST_BLOCKS = 32_768  # ... up to 128 MB, the most that is ever sent to every task


def bit(bits: Column, place: Column) -> Column:
    """Whether bit ``place`` of a bitmap is set (bit 0 is the lowest of the first byte)."""
    byte = F.conv(F.hex(F.substring(bits, (F.shiftright(place, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return byte.bitwiseAND(F.pow(F.lit(2), place % 8).cast("int")) != 0


def _places(keys: list[str], rows: int, hashes: int) -> tuple[Column, list[Column]]:
    """A key's block and its places in it, for a filter of so many rows."""
    blocks = max(1, min(MOST_BLOCKS, rows * ROW_BITS // BLOCK_BITS + 1))
    places = [F.pmod(F.xxhash64(*keys, F.lit(n + 1)), F.lit(BLOCK_BITS)) for n in range(hashes)]
    return F.pmod(F.xxhash64(*keys), F.lit(blocks)), places


def _slots(rows: DataFrame, block: Column, places: list[Column]) -> DataFrame:
    return rows.select(F.explode(F.array_distinct(F.array(*[block * BLOCK_BITS + p for p in places]))).alias("slot"))


def _looked_up(rows: DataFrame, slots: DataFrame, block: Column, places: list[Column]) -> DataFrame:
    """``rows`` with ``maybe``: all their places are among the slots."""
    bitmaps = slots.groupBy(F.expr(f"slot div {BLOCK_BITS}").alias("_block")).agg(
        F.bitmap_construct_agg(F.col("slot") % BLOCK_BITS).alias("_bits")
    )
    found = rows.withColumn("_block", block).join(F.broadcast(bitmaps), "_block", "left")  # at most MOST_BLOCKS of 4 KB
    hit = F.col("_bits").isNotNull()
    for place in places:
        hit = hit & bit(F.col("_bits"), place)
    return found.withColumn("_maybe", hit).drop("_block", "_bits")


def mark_repeated(rows: DataFrame, key: str, hashes: int = 2) -> DataFrame:
    """``rows`` with a column ``maybe``, which is true wherever another row has the same key.

    It is also true for a few others. ``rows`` should be a written table, as it is read
    three times. First rows are counted per place of a blocked filter, with ``hashes``
    places in one block for each key; places of two or more rows are set. Then each row
    looks its places up. Only numbers of places are shuffled.
    """
    block, places = _places([key], rows.count(), hashes)
    repeated = _slots(rows, block, places).groupBy("slot").count().where("count > 1")
    return _looked_up(rows, repeated, block, places).withColumnRenamed("_maybe", "maybe")


def split_by_filter(rows: DataFrame, keyed: DataFrame, *keys: str) -> tuple[DataFrame, DataFrame]:
    """The ``rows`` whose keys may be among those of ``keyed``, a written table, and all others.

    For wide rows of which only the first are to be joined, and so shuffled. A filter of
    bounded size is sent to every task. Where there are more keys than it can tell apart
    it would only cost time: then all rows are in the first part, and the join is Spark's
    own. Both parts read ``rows``; other columns may have any names.
    """
    n = keyed.count()
    if n * ROW_BITS > MOST_BLOCKS * BLOCK_BITS:
        return rows, rows.where("false")
    block, places = _places(list(keys), n, 2)
    slots = _slots(keyed, block, places).distinct()
    names = [f"key{i}" for i in range(len(keys))]
    packed = rows.select(F.struct("*").alias("row"), *[F.col(k).alias(name) for k, name in zip(keys, names, strict=True)])
    tested = _looked_up(packed, slots, *_places(names, n, 2))
    return tested.where("_maybe").select("row.*"), tested.where("not _maybe").select("row.*")


def without_keys(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """The ``rows`` whose ``key`` is not in ``gone``, a written table of keys; null keys stay.

    What a filter of the keys doesn't hold passes straight through; only the rest, the
    rows that go and a few more, are shuffled.
    """
    some, others = split_by_filter(rows, gone, key)
    return others.unionByName(some.join(gone.select(key), key, "left_anti").select(*rows.columns))
