"""Joins and top rows that hold up when a few keys have most of the rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Up to this many rows per key Spark itself cuts to the top rows before the
# shuffle (spark.sql.optimizer.windowGroupLimitThreshold).
SMALL_TOP = 1000


def spread_join(big: DataFrame, per_key: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """``big`` joined to ``per_key`` (few rows per key) so that busy keys can be shared out.

    Adaptive execution splits a busy key only between two shuffles made for the join. An
    aggregate is already dealt out by its keys and would be joined as it lies, all of a
    key in one task. So both sides are joined on the keys as one value, which makes Spark
    shuffle both for the join, or broadcast ``per_key`` by its own check of size. Nothing
    runs before the query does. A stream is joined as it is. As in any join, a null key
    meets nothing; ``how`` is inner or left.
    """
    if big.isStreaming:
        return big.join(per_key, list(keys), how)
    known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    side = per_key.where(known).withColumn("_key", F.struct(*keys)).drop(*keys)
    joined = big.withColumn("_key", F.struct(*keys)).join(side, "_key", how)
    rest = [c for c in [*big.columns, *side.columns] if c not in keys and c != "_key"]
    return joined.select(*keys, *rest)


def top_rows(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int, descending: bool = True
) -> DataFrame:
    """The first ``n`` rows per key with their number ``_rn``; ``order`` should be unique.

    Each map task keeps only ``n`` rows per key before the shuffle. Where Spark
    does not do that by itself, for a large ``n``, keys are ranked in parts first.
    """
    by = [F.desc(c) if descending else F.asc(c) for c in order]
    if n > SMALL_TOP:
        hashed = [c for c, kind in df.dtypes if "map<" not in kind]
        ways = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        parted = df.withColumn("_way", F.pmod(F.xxhash64(*hashed), F.lit(ways)))
        part = Window.partitionBy(*keys, "_way").orderBy(*by)
        df = parted.withColumn("_rn", F.row_number().over(part)).where(F.col("_rn") <= n).drop("_way", "_rn")
    whole = Window.partitionBy(*keys).orderBy(*by)
    return df.withColumn("_rn", F.row_number().over(whole)).where(F.col("_rn") <= n)
