"""A Merkle manifest of a dataset: a tree per group, one over the groups, and a witness per row."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.llm.common import record, written

BLOCK_LEVELS = 12  # a task's subtrees have two to this power leaves
ROWS = 4096  # rows of an Arrow batch that a task gives out

# How a node goes into the one above: after its sibling, before it, or alone.
AFTER, BEFORE, ALONE = "L", "R", "-"


def joined(*digests: str) -> str:
    return hashlib.sha256("".join(digests).encode()).hexdigest()


class Witness:
    """What stands beside a node on its way up: a side for each level, a digest unless it is alone."""

    __slots__ = ("sides", "siblings")

    def __init__(self):
        self.sides, self.siblings = [], []


class Appender:
    """A tree that leaves are appended to, one after the other.

    Open subtrees have falling heights, like the digits of a counter in base two. Each
    holds the witnesses of its leaves as far as its own root. When a subtree's sibling is
    complete, the two become one, and all their witnesses grow by the other's root. So
    nothing is ever looked up again, and what is held is what is still open. A leaf may
    itself be the root of a block that was built elsewhere.
    """

    def __init__(self, witnesses: bool = True):
        self.open: list[tuple[int, str, list[Witness]]] = []
        self.witnesses = witnesses

    def append(self, digest: str) -> Witness | None:
        witness = Witness() if self.witnesses else None
        self.open.append((0, digest, [witness] if witness else []))
        while len(self.open) > 1 and self.open[-2][0] == self.open[-1][0]:
            self._complete()
        return witness

    def _complete(self) -> None:
        height, right, later = self.open.pop()
        _, left, earlier = self.open.pop()
        for w in earlier:
            w.sides.append(BEFORE)
            w.siblings.append(right)
        for w in later:
            w.sides.append(AFTER)
            w.siblings.append(left)
        self.open.append((height + 1, joined(left, right), earlier + later))

    def finish(self, levels: int | None = None) -> str:
        """The root, once no more leaves come; at height ``levels`` if that is given. What has
        no sibling at a level goes up alone."""
        while len(self.open) > 1 or (levels is not None and self.open[-1][0] < levels):
            if len(self.open) > 1 and self.open[-2][0] == self.open[-1][0]:
                self._complete()
                continue
            height, digest, leaves = self.open.pop()
            for w in leaves:
                w.sides.append(ALONE)
            self.open.append((height + 1, joined(digest), leaves))
        return self.open[0][1]


def folded(leaf: str, sides: str, siblings: bytes) -> str:
    """The root that a leaf and its witness lead to."""
    at = 0
    for side in sides:
        if side == ALONE:
            leaf = joined(leaf)
            continue
        other = siblings[at : at + 32].hex()
        at += 32
        leaf = joined(other, leaf) if side == AFTER else joined(leaf, other)
    return leaf


def leaf_digest(columns: Sequence[Column]) -> Column:
    """SHA-256, in hex, of values as text, each with its length in bytes before it; nulls are ``-``."""
    texts = [c.cast("string") for c in columns]
    parts = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with ``pos``, their place in their ``tree`` by ``order``, and ``n``, the tree's rows.

    Rows are dealt by ranges of tree, order and a row number, so that no tree and no
    repeated row is too large; each range numbers its own, and how many come before it is
    summed over the ranges of the tree.
    """
    by = ["tree", *order, "nr"]
    known = written(rows.withColumn("nr", F.monotonically_increasing_id()), "leaves")
    dealt = known.repartitionByRange(*by).sortWithinPartitions(*by).drop("nr")
    kept = written(dealt.withColumn("at", F.monotonically_increasing_id()), "leaves-in-order")
    kept = kept.withColumn("part", F.shiftright("at", 33))
    ranges = kept.groupBy("tree", "part").agg(F.count(F.lit(1)).alias("size"), F.min("at").alias("first"))
    tree = Window.partitionBy("tree")
    before = F.coalesce(F.sum("size").over(tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = ranges.select("tree", "part", (before - F.col("first")).alias("shift"), F.sum("size").over(tree).alias("n"))
    return kept.join(ranges, ["tree", "part"]).withColumn("pos", F.col("at") + F.col("shift")).drop("at", "part", "shift")


def _by_block(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of one block at a time, of rows in the order of tree and block."""
    held: list[pa.RecordBatch] = []
    current = None
    for batch in batches:
        keys = list(zip(batch.column("tree").to_pylist(), batch.column("block").to_pylist(), strict=True))
        begin = 0
        for i, key in enumerate(keys):
            if key != current:
                if i > begin:
                    held.append(batch.slice(begin, i - begin))
                if held:
                    yield pa.Table.from_batches(held)
                held, begin, current = [], i, key
        held.append(batch.slice(begin))
    if held:
        yield pa.Table.from_batches(held)


def _grown(rows: pa.Table, levels: int, witnesses: bool) -> tuple[list[Witness | None], str, int, int]:
    """A block's leaves appended in order: their witnesses, its root, its number and the tree's leaves."""
    block, n = rows["block"][0].as_py(), rows["n"][0].as_py()
    if rows.num_rows != min(1 << levels, n - (block << levels)):
        raise ValueError(f"block {block} of {rows['tree'][0]} isn't whole")
    tree = Appender(witnesses)
    grown = [tree.append(d) for d in rows["digest"].to_pylist()]
    return grown, tree.finish(levels if n > 1 << levels else None), block, n


def _dealt(rows: DataFrame, *order: str) -> DataFrame:
    return rows.repartition("tree", "block").sortWithinPartitions("tree", "block", *order)


def block_roots(nodes: DataFrame, levels: int) -> DataFrame:
    """The nodes ``(tree, pos, n, digest)`` that are ``levels`` above ``nodes``; a lower tree's root."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = []
        for rows in _by_block(batches):
            _, digest, block, n = _grown(rows, levels, False)
            done.append((rows["tree"][0].as_py(), block, -(-n >> levels), digest))
            if len(done) == ROWS:
                yield batch(done)
                done = []
        yield batch(done)

    def batch(done: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*done, strict=True)) or [()] * 4
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string()]
        return record(**{c: pa.array(v, k) for c, v, k in zip(("tree", "pos", "n", "digest"), columns, kinds, strict=True)})

    blocks = nodes.select("tree", F.shiftright("pos", levels).alias("block"), "pos", "n", "digest")
    return _dealt(blocks, "pos").mapInArrow(run, "tree string, pos long, n long, digest string")


def _levels_of(nodes: DataFrame, levels: int) -> list[DataFrame]:
    """``nodes``, the roots of their blocks, the roots of these and so on, up to one node per tree."""
    found = [nodes]
    while (found[-1].agg(F.max("n")).first()[0] or 1) > 1:
        found.append(written(block_roots(found[-1], levels), "merkle-blocks"))
    return found


def _extended(nodes: DataFrame, upper: DataFrame, levels: int) -> DataFrame:
    """``nodes (tree, pos, n, digest, row)`` with ``sides``, ``siblings``, ``subroot`` and ``root``.

    ``upper`` has these four of the nodes above by ``(tree, pos)``. A node's witness is
    what it gets within its block and then its block's own.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by_block(batches):
            if rows["kind"][0].as_py() or not rows["kind"][min(1, rows.num_rows - 1)].as_py():
                raise ValueError("a block doesn't have one witness of its own")
            above = {c: rows[c][0].as_py() for c in ("sides", "siblings", "subroot", "root")}
            grown = _grown(rows.slice(1), levels, True)[0]
            leaves = rows.slice(1).combine_chunks()
            for at in range(0, len(grown), ROWS):
                some = grown[at : at + ROWS]
                part = leaves.slice(at, len(some))
                yield pa.RecordBatch.from_arrays(
                    [
                        *(part[c].combine_chunks() for c in ("tree", "pos", "digest", "row")),
                        pa.array(["".join(w.sides) + above["sides"] for w in some], pa.string()),
                        pa.array([bytes.fromhex("".join(w.siblings)) + above["siblings"] for w in some], pa.binary()),
                        pa.array([above["subroot"]] * len(some), pa.string()),
                        pa.array([above["root"]] * len(some), pa.string()),
                    ],
                    names=[*out.names],
                )

    out = T.StructType([nodes.schema[c] for c in ("tree", "pos", "digest", "row")])
    out = out.add("sides", "string").add("siblings", "binary").add("subroot", "string").add("root", "string")
    mine = nodes.withColumns({"block": F.shiftright("pos", levels), "kind": F.lit(1)})
    theirs = upper.select("tree", F.col("pos").alias("block"), F.lit(0).alias("kind"), "sides", "siblings", "subroot", "root")
    return _dealt(mine.unionByName(theirs, allowMissingColumns=True), "kind", "pos").mapInArrow(run, out)


def _down(found: list[DataFrame], upper: DataFrame, levels: int) -> DataFrame:
    """Witnesses of the lowest of some levels of nodes, given those of the uppermost."""
    for nodes in found[-2:0:-1]:
        bare = nodes.withColumn("row", F.lit(None).cast("struct<none:int>"))
        upper = written(_extended(bare, upper, levels).drop("digest", "row"), "merkle-witnesses")
    return _extended(found[0], upper, levels) if len(found) > 1 else found[0].join(upper, ["tree", "pos"]).drop("n")


def manifest(
    docs: DataFrame, columns: Sequence[str], group_col: str = "lang", id_col: str = "doc_id",
    more: dict[str, Column] | None = None, levels: int = BLOCK_LEVELS,
) -> DataFrame:
    """``(id_col, leaf, *more, subroot, root, sides, siblings)`` of each row.

    ``leaf`` is the digest of the row's ``columns``. In each group leaves stand by id,
    null ids first, rows that share an id by digest; every two nodes in a row, or the last
    alone, become the one above, up to ``subroot``. Subroots, by the group's name in UTF-8
    bytes with the null group first, become ``root`` in the same way. ``sides`` and
    ``siblings`` are the witness: for each level from leaf to root how the node goes up, and
    the raw digests beside it. Repeated rows are leaves of their own. No rows give none.
    Other columns are not looked at, and ``more`` are any further ones to keep.

    Only digests and ids are shuffled, never what they are of. Blocks of two to the
    ``levels`` leaves are built in tasks; their roots are appended in the next round, so
    there are as many rounds as the logarithm of the largest group to that base.
    """
    more = more or {}
    leaves = docs.select(
        F.coalesce(F.concat(F.lit("="), F.col(group_col).cast("string")), F.lit("")).alias("tree"),
        F.col(id_col).alias("id"),
        leaf_digest([F.col(c) for c in columns]).alias("digest"),
        F.struct(F.col(id_col).alias("id"), *[c.alias(name) for name, c in more.items()]).alias("row"),
    )
    nodes = written(numbered(leaves, ["id", "digest"]).drop("id"), "merkle-leaves")
    found = _levels_of(nodes, levels)
    last = found[-1] if len(found) > 1 else nodes.drop("row")
    subroots = last.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest", F.struct("tree").alias("row"))
    above = _levels_of(written(numbered(subroots, ["name"]).drop("name"), "merkle-groups"), levels)
    nothing = {"sides": F.lit(""), "siblings": F.lit(b""), "subroot": F.lit(None).cast("string"), "root": F.col("digest")}
    top = above[-1].select("tree", "pos", *[c.alias(name) for name, c in nothing.items()])
    groups = _down(above, top, levels).select(
        F.col("row.tree").alias("tree"), F.lit(0).cast("long").alias("pos"), "sides", "siblings", F.col("digest").alias("subroot"), "root"
    )
    whole = _down(found, written(groups, "merkle-witnesses"), levels)
    kept = [F.col(f"row.`{name}`").alias(name) for name in more]
    return whole.select(F.col("row.id").alias(id_col), F.col("digest").alias("leaf"), *kept, "subroot", "root", "sides", "siblings")


def verified(proofs: DataFrame, id_col: str = "doc_id", candidate_col: str = "leaf") -> DataFrame:
    """``(id_col, leaf, subroot, root, proof_sha256, folded_root, verified)`` of a manifest's rows.

    The root is computed again from the leaf in ``candidate_col`` and the row's witness.
    ``proof_sha256`` is of the witness's digests as hex text, from leaf to root.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            siblings = batch.column("siblings").to_pylist()
            roots = batch.column("root").to_pylist()
            ways = zip(batch.column("candidate").to_pylist(), batch.column("sides").to_pylist(), siblings, strict=True)
            found = [folded(*way) for way in ways]
            yield record(
                **{c: batch.column(c) for c in ("id", "leaf", "subroot", "root")},
                proof_sha256=pa.array([joined(s.hex()) for s in siblings], pa.string()),
                folded_root=pa.array(found, pa.string()),
                verified=pa.array([a == b for a, b in zip(found, roots, strict=True)], pa.bool_()),
            )

    frame = proofs.select(
        F.col(id_col).alias("id"), "leaf", "subroot", "root", F.col(candidate_col).alias("candidate"), "sides", "siblings"
    )
    kind = frame.schema["id"].dataType.simpleString()
    schema = f"id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return frame.mapInArrow(run, schema).withColumnRenamed("id", id_col)
