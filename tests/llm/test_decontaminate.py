"""Decontamination against every window of every text, short items included."""

import hashlib
import random
import re

import duckdb
import pytest

from fleetlens.llm.catalog import ORACLES
from fleetlens.llm.decontaminate import SPAN, WORD, decontaminate

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(WORD, (text or "").translate(LOWER))


def plain(text, items):
    doc, hit, found = words(text), set(), set()
    for item, body in items:
        own = words(body)
        n = min(SPAN, len(own))
        if item is None or not n:
            continue
        windows = {tuple(own[i : i + n]) for i in range(len(own) - n + 1)}
        for s in range(len(doc) - n + 1):
            if tuple(doc[s : s + n]) in windows:
                hit.update(range(s, s + n))
                found.add(str(item))
    digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
    return len(doc), len(hit), len(found), digest, bool(hit) and 20 * len(hit) >= len(doc)


def prose(draw, n):
    return " ".join(draw.choice(["Alpha", "be", "çà", "dog", "e1", "fox", "gnu", "hat", "É"]) + draw.choice("xyz123") for _ in range(n))


@pytest.mark.parametrize("short", [False, True])
def test_hits(spark, short):
    draw = random.Random(2)
    items = [(i, prose(draw, draw.randint(13, 60)), "n") for i in range(12)]
    items += [(12, items[3][1], "n"), (13, None, "n"), (14, "", "n"), (None, prose(draw, 20), "n")]
    if short:
        items += [(20, "Two words!", "n"), (21, prose(draw, 9), "n"), (22, prose(draw, 12), "n"), (23, "one", "n")]
    bodies = [(i, b) for i, b, _ in items]
    texts = [None, "", "...", prose(draw, 300), "one two words one", items[0][1], items[3][1].upper().replace(" ", " -- ")]
    for item, body, _ in items[:12] + items[16:]:
        own = body.split()
        cut = draw.randint(0, max(0, len(own) - 13))
        texts.append(f"{prose(draw, 40)} {' '.join(own[cut : cut + 13])} {prose(draw, 10)}")
        texts.append(f"{prose(draw, 20)} {' '.join(own[:12])}. {prose(draw, 20)}")
        texts.append(f"{prose(draw, 500)} {body} {body}")
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)]
    rows += [(5, texts[5], "x", 1), (None, texts[6], "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id string, n int")
    bench = spark.createDataFrame(items, "item_id long, text string, n string")
    got = decontaminate(docs, bench).collect()
    assert len(got) == len(rows)
    want = {i: plain(t, bodies) for i, t, *_ in rows}
    assert sum(w[4] for w in want.values()) > 12
    for r in got:
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == want[r.doc_id], r.doc_id


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "some words here")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "x")], "item_id long, text string")
    assert [r.n_hit for r in decontaminate(docs, bench.limit(0)).collect()] == [0]
    assert decontaminate(docs.limit(0), bench).count() == 0


def test_no_python_runs(spark):
    docs = spark.createDataFrame([(1, "some words here")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "x y z " * 9)], "item_id long, text string")
    plan = decontaminate(docs, bench)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Cartesian|NestedLoop", plan)


def test_items_without_an_id_hit_as_the_sql_says(spark):
    draw = random.Random(8)
    named, unnamed, other = (prose(draw, 20) for _ in range(3))
    texts = [f"{prose(draw, 9)} {unnamed}", f"{named} {unnamed} {other}", named, prose(draw, 30), f"{unnamed} {unnamed}"]
    docs = list(enumerate(texts))
    items = [(None, unnamed), (7, named), (None, other), (8, unnamed[:60])]
    db = duckdb.connect()
    db.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    db.execute("CREATE TABLE benchmark (item_id BIGINT, text VARCHAR)")
    db.executemany("INSERT INTO documents VALUES (?, ?)", docs)
    db.executemany("INSERT INTO benchmark VALUES (?, ?)", items)
    want = sorted(db.execute(ORACLES["op2_decontaminate"]).fetchall())
    got = decontaminate(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    )
    assert sorted(map(tuple, got.collect())) == want
    assert sum(w[-1] for w in want) == 4
