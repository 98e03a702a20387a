"""Token records: the library's ids, the format's checksums, and reading back in any order."""

import random
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from fleetlens.llm import token_records
from fleetlens.llm.checksums import crc32c, masked
from fleetlens.llm.token_records import Words, framed, parsed, read_records, read_shuffled, serialized, stored, unframed, write_records

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def bit_by_bit(data):
    crc = 0xFFFFFFFF
    for b in data:
        crc ^= b
        for _ in range(8):
            crc = crc >> 1 ^ (0x82F63B78 if crc & 1 else 0)
    return crc ^ 0xFFFFFFFF


def checksums(parts):
    starts = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
    return crc32c(np.frombuffer(b"".join(parts), np.uint8), starts).tolist()


def test_checksums():
    assert checksums([b"123456789"]) == [0xE3069283]
    assert checksums([bytes(32)]) == [0x8A9136AA]
    assert checksums([]) == []
    draw = random.Random(2)
    parts = [draw.randbytes(n) for n in (0, 1, 63, 64, 65, 0, 127, 128, 129, 1000, 4096, 7, 10_001, 0)]
    assert checksums(parts) == [bit_by_bit(p) for p in parts]
    crc = 0x12345678
    assert masked(np.array([crc], np.uint32))[0] == ((crc >> 15 | crc << 17 & 0xFFFFFFFF) + 0xA282EAD8) & 0xFFFFFFFF


def test_records_are_read_as_written_or_not_at_all():
    ids = [np.arange(n, dtype="<u4") for n in (0, 5, 300)]
    sequences = [serialized(d, x, w) for d, x, w in zip(["é", None, ""], ids, [2, 4, 2], strict=True)]
    records = framed(sequences)
    length, head = struct.unpack("<QI", records[1][:12])
    assert length == len(sequences[1]) and records[1][12:-4] == sequences[1]
    assert head == masked(np.array([bit_by_bit(records[1][:8])], np.uint32))[0]
    sizes = np.array([len(r) for r in records], np.int64)
    whole = b"".join(records)
    back = [parsed(x) for x in unframed(whole, sizes, "f")]
    assert [d for d, _ in back] == ["é", None, ""] and all((x == y).all() for (_, x), y in zip(back, ids, strict=True))
    for place in (0, 9, 20, len(whole) - 1, len(records[0]) + 30):
        broken = bytearray(whole)
        broken[place] ^= 4
        with pytest.raises(ValueError, match="f:"):
            unframed(bytes(broken), sizes, "f")


TEXTS = [
    "", "Hello, World!", "don't  you'll\tgo\nnow", "é ́x Å", "<|endoftext|> a<|startoftext|>b <|endof text|>",
    "漢字かな 😀👍 İstanbul ΣΑΣ", "a b c\u0085d\x1ce\x0bf", "x" * 200 + " 12345", "'s 's't", "\0 ‍ ﻿q",
]


def test_words_are_the_librarys(library):
    known = Words(PATH)
    draw = random.Random(5)
    texts = TEXTS + ["".join(draw.choices("aé'sT漢 ́<|endoftext|>\n9", k=200)) for _ in range(200)]
    texts += ["".join(draw.choices("abcXYZ019.,;-_|>\"#~éÀÞßøıſŉĿİ×÷ĳ  ", k=300)) for _ in range(200)]
    texts += [" ".join(chr(c) + "A" + chr(c) for c in range(0x21, 0x180))]
    for text in texts:
        assert known.encode(np.frombuffer(text.encode(), np.uint8)).tolist() == library.encode(text, add_special_tokens=False).ids


def test_slices_of_long_texts(library, monkeypatch):
    monkeypatch.setattr(token_records, "SLICE_BYTES", 16)
    monkeypatch.setattr(token_records, "CACHE_ENTRIES", 3)
    text = "some words of a long text, " * 40 + "y" * 100 + "\n\n tail"
    assert Words(PATH).encode(np.frombuffer(text.encode(), np.uint8)).tolist() == library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("file_bytes", [200, 4000, 1 << 20])
def test_written_and_read(spark, library, file_bytes):
    draw = random.Random(7)
    texts = TEXTS + [" ".join(draw.choices(["alpha", "Beta", "gamma's", "x1y2"], k=draw.randrange(60))) for _ in range(120)] + [None]
    rows = [(i * 3 - 50, t, 1, "s") for i, t in enumerate(texts)] + [(10, TEXTS[1], 2, "s")] * 2 + [(None, "of no id", 3, "s")]
    docs = spark.createDataFrame(draw.sample(rows, len(rows)), "doc_id long, text string, start int, ids string").repartition(4)
    ids = {(d, t): [*library.encode(t or "", add_special_tokens=False).ids, 2] for d, t, *_ in rows}
    path = f"{token_records.work_folder(spark, 'records-test')}"
    files = write_records(docs, path, PATH, 2, file_bytes=file_bytes)
    assert files.count() > 1 or file_bytes > 4000
    got = read_records(files, "bigint", split_bytes=500).collect()
    unpacked = [(r.doc_id, r.start, np.frombuffer(bytes(r.ids), "<u4").tolist()) for r in got]
    unpacked.sort(key=lambda r: r[1])
    keys = [r[0] for r in unpacked]
    assert keys[0] is None and keys[1:] == sorted(keys[1:])
    at = 0
    for _, start, found in unpacked:
        assert start == at
        at += len(found)
    want = sorted((str(d), ids[d, t]) for d, t, *_ in rows)
    assert sorted((str(d), x) for d, _, x in unpacked) == want
    mixed = [(r.doc_id, r.start, bytes(r.ids)) for r in read_shuffled(files, 4, "bigint").collect()]
    assert sorted(m[1] for m in mixed) == [u[1] for u in unpacked] != [m[1] for m in mixed]
    assert {(m[1], m[0], m[2]) for m in mixed} == {(r.start, r.doc_id, bytes(r.ids)) for r in got}
    again = write_records(docs, path, PATH, 2, file_bytes=file_bytes)  # the same names and bytes
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, files.collect()))


def test_empty_tables_and_text_ids(spark):
    none = spark.createDataFrame([], "key string, body string")
    assert stored(none, PATH, 2, "key", "body").collect() == []
    some = spark.createDataFrame([("b", None), ("a", "x")], "key string, body string")
    rows = {r.key: (r.start, len(r.ids) // 4) for r in stored(some, PATH, 2, "key", "body").collect()}
    assert rows == {"a": (0, 2), "b": (2, 1)}


def test_query_against_the_library(spark, small, library):
    from fleetlens.llm.catalog import TEXT_QUERIES
    from fleetlens.llm.common import table

    texts = {r.doc_id: r.text or "" for r in table(spark, small, "documents").collect()}
    start = 0
    rows = {r.doc_id: r for r in TEXT_QUERIES["op13_token_records"](spark, small).collect()}
    assert set(rows) == set(texts)
    for doc in sorted(texts):
        ids = [*library.encode(texts[doc], add_special_tokens=False).ids, 2]
        crc = zlib.crc32(np.array(ids, "<u4").tobytes())
        assert (rows[doc].start, rows[doc].n_tokens, rows[doc].ids_crc32) == (start, len(ids), crc)
        start += len(ids)
