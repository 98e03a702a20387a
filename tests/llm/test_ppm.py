"""PPM scores against a plain version that keeps dictionaries and excludes symbol by symbol."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from fleetlens.llm import ppm
from fleetlens.llm.common import part_of


def symbols_of(text):
    return [*text.encode(), ppm.END]


def contexts(symbols, i):
    before = [symbols[j] if j >= 0 else ppm.BEFORE for j in range(i - 1, i - 1 - ppm.ORDER, -1)]
    return [tuple(before[:k]) for k in range(ppm.ORDER + 1)]


def plain_model(texts):
    seen = defaultdict(Counter)
    for text in texts:
        symbols = symbols_of(text)
        for i, s in enumerate(symbols):
            for context in contexts(symbols, i):
                seen[context][s] += 1
    return seen


def plain_score(seen, text):
    symbols, total = symbols_of(text), 0.0
    for i, s in enumerate(symbols):
        ruled_out = set()
        for context in reversed(contexts(symbols, i)):
            counts = seen.get(context)
            if not counts:
                continue
            open_ = {x: n for x, n in counts.items() if x not in ruled_out}
            if not open_:
                continue
            share = sum(open_.values()) + len(open_)
            if s in open_:
                total += math.log10(open_[s] / share)
                break
            total += math.log10(len(open_) / share)
            ruled_out |= set(open_)
        else:
            total -= math.log10(ppm.SYMBOLS - len(ruled_out))
    return total


def plain_base(train, text):
    counts = Counter(w for t in train for w in [*t.encode().lower().split(), None])
    n, v = sum(counts.values()), len(counts)
    words = [*text.encode().lower().split(), None]
    return len(words), sum(counts[w] > 0 for w in words), n, sum(
        math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words)


TEXTS = ["the cat sat on the mat", "The dog sat\ton the log", "", None, "ééé çà", "xyz " * 50, "the cat", "qqqq zebra", "the cat"]


@pytest.mark.parametrize("frequent", [1 << 20, 3])
def test_scores(spark, monkeypatch, frequent):
    monkeypatch.setattr(ppm, "FREQUENT", frequent)
    rows = [(i, t, "x", 1.0) for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, word string, n double")
    got = {r.doc_id: r for r in ppm.score(docs, part_of("doc_id", 5) == 1).collect()}
    assert len(got) == len(rows)
    held = {i for i, *_ in rows if zlib.crc32(str(i).encode()) % 5 == 1}
    assert 0 < len(held) < len(rows)
    train = [t or "" for i, t, *_ in rows if i not in held]
    model = plain_model(train)
    for i, text, *_ in rows:
        n, known, total, base = plain_base(train, text or "")
        row = got[i]
        assert (row.held_out, row.n_tokens, row.n_known, row.train_tokens) == (i in held, n, known, total)
        assert row.base_score == pytest.approx(base)
        assert row.score == pytest.approx(plain_score(model, text or ""), rel=1e-4, abs=1e-4)


def test_shares_of_all_symbols_add_up_to_one():
    texts = [t for t in TEXTS if t]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    starts = np.cumsum([0, *(len(t.encode()) for t in texts)])
    grams, counts = np.unique(ppm._grams(*ppm._symbols(data, starts)), return_counts=True)
    orders = []
    for k in range(ppm.ORDER + 1):
        own = ((grams >> 9) & ((1 << 8 * k) - 1)) * 512 + (grams & 511)
        keys, at = np.unique(own, return_inverse=True)
        orders.append((keys, np.bincount(at, counts).astype(np.int64)))
    trie = ppm.Trie(orders)
    for context in [0, int.from_bytes(b" eht"), int.from_bytes(b"ht q"), int.from_bytes(b"\xff\xfe\xfd\xfc")]:
        shares = trie.log10_shares(context * 512 + np.arange(ppm.SYMBOLS))
        assert (10**shares).sum() == pytest.approx(1, abs=1e-4)


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "ab"), (2, None)], "doc_id long, text string")
    rows = ppm.score(docs, part_of("doc_id", 5) >= 0).orderBy("doc_id").collect()
    assert [round(r.score, 3) for r in rows] == [round(-n * math.log10(257), 3) for n in (3, 1)]
    assert [r.train_tokens for r in rows] == [0, 0]
    assert ppm.score(docs.limit(0), part_of("doc_id", 5) == 1).count() == 0


@pytest.mark.parametrize("kept", [3, 60])
def test_scores_when_most_grams_are_joined(spark, monkeypatch, kept):
    monkeypatch.setattr(ppm, "KEPT", kept)
    test_scores(spark, monkeypatch, 3)
