"""Fill-in-middle: against plain string code, with frames so small that cuts fall everywhere."""

import hashlib
import random
import re

import numpy as np
import pytest
import zstandard

from fleetlens.llm import infill
from fleetlens.llm.infill import Framed, Framing, framed, rebuilt, transformed

UNIT = re.compile("[A-Za-z]+|[^A-Za-z]")
TEXTS = [
    "", "a", "abc", "é", "漢字 kana 😀x", "one two\nthree", "<P", "x<S>y", "a <M> b", "<P>", "q" * 900, " " * 300,
    "word " * 200, "<S<P<M", "é" * 50 + "Z" * 70 + "漢" * 40, "\0\t nul\0",
]


def plain(text, doc):
    """The contract, with strings."""
    units, digest = UNIT.findall(text), hashlib.sha256(f"1:{doc}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted(x % (n + 1) for x in h[:2])
    prefix, middle, suffix = ("".join(units[i:j]) for i, j in ((0, a), (a, b), (b, n)))
    if h[3] % 100 < 20:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def raw(text):
    return np.frombuffer(text.encode(), np.uint8)


@pytest.mark.parametrize("size", [4, 7, 64, 1 << 16])
def test_frames_and_their_counts(size, monkeypatch):
    monkeypatch.setattr(Framing.__init__, "__defaults__", (size,))
    draw = random.Random(size)
    for text in TEXTS:
        made = framed(raw(text), size)
        stored = made.stored()
        again = Framed.read(stored)
        assert b"".join(again.pieces()).decode() == text
        assert again.units[-1] == len(UNIT.findall(text)) and again.points[-1] == len(text)
        assert again.marked == any(m in text for m in ("<P>", "<S>", "<M>"))
        assert size < 100 or zstandard.ZstdDecompressor().stream_reader(stored, read_across_frames=True).read() == text.encode()
        starts = [m.start() for m in UNIT.finditer(text)]
        for k in draw.sample(range(len(starts)), min(20, len(starts))):
            i, _, points = again.at_unit(k)
            assert again.points[i] + points == starts[k]
        for _ in range(30):
            draws = tuple(draw.randrange(1 << 32) for _ in range(4))
            output, told = transformed(again, draws, 90, 20)
            output = Framed.read(output.stored())
            whole = b"".join(output.pieces()).decode()
            assert output.units[-1] == len(UNIT.findall(whole)) and output.points[-1] == len(whole)
            back = Framed.read(rebuilt(output, told["form"]).stored())
            assert b"".join(back.pieces()).decode() == text and back.units == sorted(back.units)
            assert back.units[-1] == again.units[-1]


def test_whole_frames_are_not_opened(monkeypatch):
    text = framed(raw("some words here " * 10_000), 1024)
    opened = []
    monkeypatch.setattr(Framed, "frame", lambda self, i, f=Framed.frame: opened.append(i) or f(self, i))
    transformed(text, (50_000, 12_345, 0, 99), 90, 20)
    assert len(text.blobs) > 150 and len(set(opened)) <= 2


@pytest.mark.parametrize("size", [16, 1 << 16])
def test_against_plain_code(spark, size):
    draw = random.Random(3)
    texts = TEXTS + ["".join(draw.choices("ab Z<PSM>é漢\n1", k=draw.randrange(120))) for _ in range(150)] + [None]
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)] + [(3, texts[3], "y", 2), (None, "a b c", "z", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, form string, n int").repartition(3)
    packed = infill.pack(docs, frame_bytes=size)
    coded = infill.transform(packed)
    assert coded.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    outputs = {r.doc_id: r.text for r in infill.unpack(coded, frames_col="output").collect()}
    restored = {r.doc_id: r.text for r in infill.unpack(infill.restore(coded)).collect()}
    got = infill.with_digests(coded).collect()
    assert len(got) == len(rows)
    by_id = {i: (t or "") for i, t, *_ in rows}
    forms = set()
    for r in got:
        want = plain(by_id[r.doc_id], "" if r.doc_id is None else r.doc_id)
        assert (r.n, r.form, r.prefix_chars, r.middle_chars) == want[:4]
        assert outputs[r.doc_id] == want[4] and restored[r.doc_id] == by_id[r.doc_id]
        assert r.output_sha256 == hashlib.sha256(want[4].encode()).hexdigest()
        assert r.restored_sha256 == hashlib.sha256(by_id[r.doc_id].encode()).hexdigest()
        forms.add(r.form)
    assert forms == {"plain", "psm", "spm"}


def test_an_empty_table_and_text_ids(spark):
    none = spark.createDataFrame([], "key string, body string")
    assert infill.with_digests(infill.transform(infill.pack(none, "key", "body"), "key"), "key").collect() == []
    some = spark.createDataFrame([("k1", "alpha beta gamma")], "key string, body string")
    (row,) = infill.transform(infill.pack(some, "key", "body"), "key").collect()
    assert (row.n, row.form, row.prefix_chars, row.middle_chars) == plain("alpha beta gamma", "k1")[:4]


def test_not_an_output():
    with pytest.raises(ValueError, match="psm"):
        rebuilt(framed(raw("<P>a<S>b")), "psm")
