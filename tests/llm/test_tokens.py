"""Token counts and BPE against the public libraries."""

import base64
import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
import public_tokenizers
import regex
import tiktoken
from tokenizers import Tokenizer

from fleetlens.llm import bpe, catalog, simhash, splitter, token_counts
from fleetlens.llm.common import small_batches
from fleetlens.llm.splitter import piece_starts, slices, valid

JSON = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PARTS = ["a", "b", "s", "t", "re", "ve", "'", "'", "ll", "d", "e", " ", " ", "\n", "\t", "é", "中", "1", "²", ".", "!", "　", "😀", "the", "ing", "<|endoftext|>"]


def texts(seed=3, n=400):
    draw = random.Random(seed)
    made = ["".join(draw.choices(PARTS, k=draw.randint(0, 60))) for _ in range(n)]
    long = "".join(draw.choices("ab", k=5000))
    return [*made, None, "", " " * 700, "'", "it's'", "\x00", "aab" * 2000, long, "don't'll 's 'S", "<|endoftext|>"]


def batch(rows):
    made = pa.RecordBatch.from_arrays([pa.array(range(len(rows))), pa.array(rows, pa.string())], names=["id", "text"])
    return list(small_batches([made]))


def test_pieces_are_the_matches_of_the_pattern():
    pattern = regex.compile(public_tokenizers.PATTERN)
    for some in batch(texts()):
        data, starts, text = splitter.valid(some)
        want = []
        for start, raw in zip(starts.tolist(), some.each()):
            here = raw.decode()
            want += [start + len(here[: m.start()].encode()) for m in pattern.finditer(here)]
        assert splitter.piece_starts(data, starts, text).tolist() == want


@pytest.mark.parametrize("chunk", [512, 7])
def test_counts(monkeypatch, chunk):
    monkeypatch.setattr(token_counts, "CHUNK", chunk)
    known = Tokenizer.from_file(JSON)
    known.encode_special_tokens = True
    made = token_counts.CountingTransducer(JSON)
    for some in batch(texts(chunk)):
        want = [len(e.ids) for e in known.encode_batch([t.decode() for t in some.each()], add_special_tokens=False)]
        assert made.count(some).tolist() == want


def test_forgetting_states_changes_nothing(monkeypatch):
    made = token_counts.CountingTransducer(JSON)
    some = batch(texts(5))[0]
    first = made.count(some)
    monkeypatch.setattr(token_counts, "MOST_STATES", 10)
    monkeypatch.setattr(token_counts, "MOST_PAIRS", 10)
    assert made.count(some).tolist() == first.tolist()


def test_count_query(spark):
    rows = [(i, t, 1) for i, t in enumerate(texts(6, 60))]
    got = token_counts.token_counts(spark.createDataFrame(rows, "doc_id long, text string, n_bytes int"), JSON, 20).collect()
    known = Tokenizer.from_file(JSON)
    known.encode_special_tokens = True
    for r in got:
        text = rows[r.doc_id][1] or ""
        n = len(known.encode(text, add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text.encode()), n, n > 20)


@pytest.fixture(scope="module")
def library():
    with open(RANKS, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_rank_queue():
    draw, queue, held = random.Random(1), bpe.RankQueue(70_000), {}
    for _ in range(3000):
        if draw.random() < 0.6:
            rank, place = draw.choice([draw.randrange(70_000), draw.randrange(70), 63, 4096]), draw.randrange(99)
            queue.push(rank, place)
            held.setdefault(rank, []).append(place)
        elif held:
            lowest = min(held)
            assert queue.pop_lowest() == (lowest, held.pop(lowest))
        else:
            assert queue.pop_lowest() is None


def test_bpe(spark, library):
    rows = [(i, t, "x") for i, t in enumerate(texts(8, 150))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    coded = bpe.encode(docs, RANKS)
    ids = {r.doc_id: r.ids for r in coded.collect()}
    back = {r.doc_id: bytes(r.bytes) for r in bpe.decode(coded, RANKS).collect()}
    trip = {r.doc_id: r for r in bpe.round_trip(docs, RANKS).collect()}
    for i, text, _ in rows:
        want = library.encode_ordinary(text or "")
        assert ids[i] == want and back[i].decode() == (text or "")
        r = trip[i]
        assert r.n_tokens == len(want)
        assert r.ids_sha256 == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    assert bpe.round_trip(docs.limit(0), RANKS).count() == 0


def test_added_tokens_are_one_token_by_default_of_the_library(spark, tmp_path):
    rows = [(i, t) for i, t in enumerate([*texts(9, 200), "end of one <|endoftext|> next", "<|endoftext|><|endoftext|> a", "<|endoftext|"])]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    known = Tokenizer.from_file(JSON)
    got = catalog.op1_token_counts(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    for r in got:
        text = rows[r.doc_id][1] or ""
        n = len(known.encode(text, add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text.encode()), n, n > 512), text


@pytest.mark.parametrize("size", [3, 40, 300])
def test_slices_keep_pieces_whole(size):
    draw = random.Random(size)
    for _ in range(30):
        text = "".join(draw.choices(["a", "Bc", " ", "  ", "\u00a0", "\u3000", "é", "9", "'s", "!", "\n", "漢", " x"], k=120))
        whole = batch([text])[0]
        parts = list(slices(whole, size))
        assert b"".join(p.data.tobytes() for p in parts).decode() == text
        found, at = [], 0
        for part in parts:
            found += (at + piece_starts(*valid(part))).tolist()
            at += len(part.data)
        assert found == piece_starts(*valid(whole)).tolist()
    assert len(list(slices(batch(["some words " * 300])[0], 100))) > 20 and len(list(slices(batch(["x" * 300])[0], 100))) == 1


def test_long_texts_in_slices(monkeypatch):
    """Counts, ids and fingerprints of one text are those of its slices together."""
    draw = random.Random(4)
    text = " ".join("".join(draw.choices("abcdeé '9", k=draw.randint(1, 9))) for _ in range(4000))
    one = batch([text])[0]
    made = token_counts.CountingTransducer(JSON)
    assert sum(made.count(p) for p in slices(one, 500)).tolist() == made.count(one).tolist()
    known = bpe.encoder(RANKS)
    assert np.concatenate([known.encode(p)[0] for p in slices(one, 500)]).tolist() == known.encode(one)[0].tolist()
    for width in (1, 3, 5):
        assert simhash._of_slices(one.data, width, 64) == simhash._majority(simhash._shingle_hashes(text.encode(), width))
    assert simhash._of_slices(np.frombuffer(b"a b", np.uint8), 3, 1) == simhash._majority(simhash._shingle_hashes(b"a b", 3))
    assert simhash._of_slices(np.frombuffer(b" \n ", np.uint8), 3, 1) == 0


def merged_one_by_one(piece, ranks):
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while True:
        pairs = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in ranks]
        if not pairs:
            return [ranks[p] for p in parts]
        _, i = min(pairs)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


@pytest.mark.parametrize("seed", range(6))
def test_many_pre_tokens_in_one_queue(seed):
    """Each has the ids it would have alone, also where a merge makes a pair of lower rank."""
    draw = random.Random(seed)
    longer = list({bytes(draw.choices(b"abc", k=draw.randint(2, 5))) for _ in range(90)})
    tokens = [*(bytes([b]) for b in range(256)), *longer]
    order = list(range(len(tokens)))
    draw.shuffle(order)
    ranks = dict(zip(tokens, order, strict=True))
    known = bpe.Vocabulary(ranks)
    pieces = [bytes(draw.choices(b"abcd", k=draw.randint(1, 40))) for _ in range(400)]
    for _ in range(2):
        got = known.encode_pieces(pieces)
        assert [np.frombuffer(ids, "<u4").tolist() for ids in got] == [merged_one_by_one(p, ranks) for p in pieces]


def test_what_a_worker_remembers_changes_no_ids(monkeypatch, library):
    some = batch(texts(11))
    for name, value in (("CACHE_ENTRIES", 3), ("LOOKED_UP", 5), ("QUEUED_BYTES", 7)):
        monkeypatch.setattr(bpe, name, value)
    made = bpe.Encoder(bpe.Vocabulary.read(RANKS))
    for _ in range(2):
        ids = np.concatenate([made.encode(part)[0] for part in some]).tolist()
        assert ids == [i for part in some for t in part.each() for i in library.encode_ordinary(t.decode())]
    assert len(made) <= 3 and len(made.older) <= 3
