"""Connected components by contraction: hook to the smallest neighbour, jump, contract, again."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import written


def components(links: DataFrame) -> DataFrame:
    """``(node, root)`` for each node of ``links (a, b)``; root is the same for all that are connected.

    Each round hooks every node to its smallest neighbour if that is smaller, follows
    these pointers to their ends by doubling, and replaces nodes by the ends. Nodes with
    a smaller neighbour disappear, so links shrink to nothing in about log(n) rounds.
    Tables of each round are written to the shared folder; only their counts come back.
    """
    links = written(links.where("a <> b"), "links")
    tables = []
    while not links.isEmpty():
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("goal")).select(F.col("a").alias("node"), "goal")
        to = _ends(written(to, "hooks"))
        tables.append(to)
        ends = to.select(F.col("node").alias("_n"), F.col("goal").alias("_t"))
        moved = (
            links.join(ends, links.a == ends._n)
            .select(F.col("_t").alias("a"), "b")
            .join(ends.withColumnsRenamed({"_n": "_m", "_t": "_u"}), F.col("b") == F.col("_m"))
            .select(F.least("a", "_u").alias("a"), F.greatest("a", "_u").alias("b"))
            .where("a <> b")
            .distinct()
        )
        links = written(moved, "links")
    if not tables:
        return links.select(F.col("a").alias("node"), F.col("b").alias("root"))

    def then(first: DataFrame, second: DataFrame) -> DataFrame:
        second = second.select(F.col("node").alias("_n"), F.col("goal").alias("_t"))
        return first.join(second, first.goal == second._n, "left").select("node", F.coalesce("_t", "goal").alias("goal"))

    return reduce(then, tables).withColumnRenamed("goal", "root")


def _ends(to: DataFrame) -> DataFrame:
    """Follow ``node -> goal`` until nothing changes, twice as far each time."""
    while True:
        next_ = to.select(F.col("node").alias("_n"), F.col("goal").alias("_t"))
        far = written(
            to.join(next_, to.goal == next_._n).select("node", F.col("_t").alias("goal"), (F.col("_t") != F.col("goal")).alias("moved")),
            "hooks",
        )
        still = not far.where("moved").isEmpty()
        to = far.drop("moved")
        if not still:
            return to
