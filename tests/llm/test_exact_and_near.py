"""Exact dedup and SimHash against plain versions over all pairs."""

import hashlib
import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from fleetlens.llm import simhash
from fleetlens.llm.bloom import mark_repeated, without_keys
from fleetlens.llm.exact_dedup import exact_dedup

SCHEMA = "doc_id long, text string, h string, keep_id long"


def rows_of(texts):
    return [(i, t, "x", 0) for i, t in enumerate(texts)]


def test_exact_groups(spark):
    texts = ["a  b", "a b", "a\tb", None, "", " ", "é" * 3000, "é" * 3000, "a b ", "c"] + ["hot"] * 50
    rows = [*rows_of(texts), (1, "a b", "x", 0)]
    got = exact_dedup(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    groups = {}
    for i, t, *_ in rows:
        digest = hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", t or "").encode()).hexdigest()
        groups.setdefault(digest, []).append(i)
    for r in got:
        group = groups[r.text_sha256]
        assert r.doc_id in group
        assert (r.keep_id, r.group_size, r.kept) == (min(group), len(group), r.doc_id == min(group))
    assert exact_dedup(spark.createDataFrame([], SCHEMA)).count() == 0


def test_null_ids(spark):
    got = exact_dedup(spark.createDataFrame([(None, "a"), (7, "a"), (None, "b")], "doc_id long, text string")).collect()
    assert {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in got} == {
        (None, 7, 2, False), (7, 7, 2, True), (None, None, 1, True)}


def test_bloom_filter_misses_no_repeat(spark):
    rows = spark.range(3000).select(F.when(F.col("id") % 10 == 0, F.lit(5)).otherwise(F.col("id")).alias("key"))
    for hashes in (1, 2):
        marked = mark_repeated(rows, "key", hashes).groupBy("maybe").agg(F.count("*").alias("n"), F.count_if(F.col("key") == 5).alias("five")).collect()
        by = {r.maybe: r for r in marked}
        assert by[True].five == 301 and by[False].five == 0 and by[False].n > 2400


def test_keys_that_go(spark):
    rows = spark.createDataFrame([(i if i % 7 else None, f"t{i}", i) for i in range(500)], "k long, t string, slot int")
    gone = spark.createDataFrame([(i,) for i in range(0, 500, 3)] + [(None,), (9,)], "k long")
    got = without_keys(rows, gone, "k")
    assert got.columns == rows.columns
    want = [(k, t, n) for k, t, n in rows.collect() if k is None or k % 3]
    assert sorted(tuple(r)[2] for r in got.collect()) == sorted(n for *_, n in want)
    assert without_keys(rows, gone.limit(0), "k").count() == 500


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    """Smallest reachable index of each, over all pairs within two bits."""
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def test_fingerprints_are_those_of_shingles(spark):
    texts = ["The  cat\tsat on THE mat", "one", "two words", "", None, "É é Ça", "w " * 3000, " a b c"]
    got = simhash.fingerprints(spark.createDataFrame(rows_of(texts), SCHEMA)).orderBy("id").collect()
    assert [r.fp & (2**64 - 1) for r in got] == [plain_fingerprint(t) for t in texts]


@pytest.mark.parametrize("paired", [64, 2])
def test_links_join_what_is_within_two_bits(spark, monkeypatch, paired):
    monkeypatch.setattr(simhash, "PAIRED", paired)
    draw = random.Random(paired)
    prints = [0, (1 << 64) - 1]
    for _ in range(12):
        base = draw.getrandbits(64)
        prints.append(base)
        for _ in range(draw.randrange(9)):
            base ^= sum(1 << draw.randrange(64) for _ in range(draw.randrange(1, 5))) & (2**64 - 1)
            prints.append(base)
    prints = list(dict.fromkeys(prints))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    frame = spark.createDataFrame([(p,) for p in signed], "fp long")
    links = [(signed.index(r.a), signed.index(r.b)) for r in simhash.close_links(frame).collect()]
    for i, j in links:
        assert (prints[i] ^ prints[j]).bit_count() <= 2
    root = list(range(len(prints)))
    for _ in prints:
        for i, j in links:
            root[i] = root[j] = min(root[i], root[j])
    assert root == plain_components(prints)


def test_near_copies(spark):
    draw = random.Random(9)
    base = [draw.choice(["ab", "cd", "efg", "hi", "jkl", "mn"]) + str(draw.randrange(50)) for _ in range(400)]
    texts = [" ".join(base), None, "", "other words here"]
    for i in range(12):
        near = list(base)
        near[i * 30] = "changed"
        texts.append(" ".join(near))
    texts.append(texts[0])
    got = simhash.near_dedup(spark.createDataFrame(rows_of(texts), SCHEMA)).orderBy("doc_id").collect()
    prints = [plain_fingerprint(t) for t in texts]
    assert [r.fingerprint for r in got] == [f"{p:016x}" for p in prints]
    assert [r.component_id for r in got] == plain_components(prints)
    assert simhash.near_dedup(spark.createDataFrame([], SCHEMA)).count() == 0
