"""Merkle manifest: appended trees, distributed blocks and witnesses against the plain rule."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from fleetlens.llm import merkle
from fleetlens.llm.merkle import Appender, folded, manifest, verified


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain(leaves):
    """Root of some leaves, and of each leaf the others of its run on every level with their sides."""
    proofs, level, owners = [[] for _ in leaves], list(leaves), [[i] for i in range(len(leaves))]
    while len(level) > 1:
        runs = [list(range(i, min(i + 2, len(level)))) for i in range(0, len(level), 2)]
        for run in runs:
            for i in run:
                others = [j for j in run if j != i]
                for leaf in owners[i]:
                    proofs[leaf].append(("L" if others[0] < i else "R", level[others[0]]) if others else ("-", ""))
        level, owners = [H(*[level[i] for i in r]) for r in runs], [[x for i in r for x in owners[i]] for r in runs]
    return level[0], proofs


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 6, 7, 8, 9, 13, 16, 17, 31, 33, 100])
def test_appended_trees(n):
    leaves = [H(str(i)) for i in range(n)]
    tree = Appender()
    grown = [tree.append(d) for d in leaves]
    root, proofs = plain(leaves)
    assert tree.finish() == root
    for leaf, w, proof in zip(leaves, grown, proofs, strict=True):
        assert "".join(w.sides) == "".join(s for s, _ in proof) and w.siblings == [d for _, d in proof if d]
        sides, siblings = "".join(w.sides), bytes.fromhex("".join(w.siblings))
        assert folded(leaf, sides, siblings) == root
        assert folded(H("x"), sides, siblings) != root


def test_witnesses_grow_only_when_a_sibling_is_complete():
    tree = Appender()
    first = tree.append(H("0"))
    lengths = []
    for i in range(1, 9):
        tree.append(H(str(i)))
        lengths.append(len(first.sides))
    assert lengths == [1, 1, 2, 2, 2, 2, 3, 3]
    assert [h for h, _, _ in tree.open] == [3, 0]


def value(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


@pytest.mark.parametrize("levels", [1, 2, 12])
def test_manifest_against_the_plain_rule(spark, levels):
    draw = random.Random(levels)
    langs = [None, "", "de", "en", "z", "é", "漢"]
    rows = [(i * 5, draw.choice(["", "text é", None, "a b"]), draw.choice(langs[:6] + ["en"] * 12), draw.choice([None, 3, 40])) for i in range(90)]
    rows += [rows[3]] * 9 + [(rows[7][0], "another", rows[7][2], 1), (None, "no id", "en", 2), (None, "no id", None, 2), (7, "x", "漢", 1)]
    draw.shuffle(rows)
    docs = spark.createDataFrame([(*r, "t", 0) for r in rows], "doc_id long, text string, lang string, n_chars int, tree string, pos int")
    again = F.when(F.col("doc_id") % 2 == 0, merkle.leaf_digest([F.col("doc_id"), F.col("lang"), F.col("n_chars") + 1, F.col("text")]))
    columns = ["doc_id", "lang", "n_chars", "text"]
    proofs = manifest(docs.repartition(3), columns, more={"other": again}, levels=levels)
    got = verified(proofs.withColumn("leaf2", F.coalesce("other", "leaf")), candidate_col="leaf2").collect()

    def leaf(r, more=0):
        return H(*[value(x) for x in (r[0], r[2], None if r[3] is None else r[3] + more, r[1])])

    by_lang = {}
    for r in rows:
        by_lang.setdefault(r[2], []).append(r)
    names = sorted(by_lang, key=lambda x: b"" if x is None else b"=" + x.encode())
    subs, parts = [], []
    for name in names:
        own = sorted(by_lang[name], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        root, proofs_ = plain([leaf(r) for r in own])
        subs.append(root)
        parts.append(list(zip(own, proofs_, strict=True)))
    root, above = plain(subs)
    want = []
    for sub, up, own in zip(subs, above, parts, strict=True):
        for r, proof in own:
            way = proof + up
            sides, siblings = "".join(s for s, _ in way), bytes.fromhex("".join(d for _, d in way))
            even = r[0] is not None and r[0] % 2 == 0
            end = folded(leaf(r, 1 if even else 0), sides, siblings)
            want.append((r[0], leaf(r), sub, root, H(*[d for _, d in way]), end, end == root))
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, want))
    assert any(w[-1] for w in want) and not all(w[-1] for w in want)


@pytest.mark.parametrize("n", [0, 1])
def test_few_rows(spark, n):
    docs = spark.createDataFrame([("k", "g", "text")][:n], "key string, part string, body string")
    got = verified(manifest(docs, ["key", "body"], "part", "key"), "key").collect()
    assert len(got) == n
    for r in got:
        assert r.leaf == H("1:k", "4:text") == r.subroot == r.root == r.folded_root and r.verified and r.proof_sha256 == H()
