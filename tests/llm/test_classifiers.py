"""Both networks: slopes against differences, held-out accuracy, and what they do without labels."""

import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetlens.llm import quality, toxicity
from fleetlens.llm.common import part_of
from fleetlens.llm.training import Sample, sigmoid


def corpus(n=500):
    draw = random.Random(1)
    rows = []
    for i in range(n):
        words = ["".join(draw.choices("abcdefgh", k=draw.randint(2, 7))) for _ in range(draw.randint(5, 120))]
        bad, toxic = i % 4 == 0, i % 5 == 0
        if toxic:
            words.insert(draw.randrange(len(words)), draw.choice(["vilest", "vilely", "vilenesses"]))
        text = " ".join(words).capitalize() + "."
        rows.append((i, text.upper().replace(" ", "!! ") if bad else text, "en", int(not bad), int(toxic)))
    return rows


def joined(texts):
    return np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])


def test_chunks_cover_every_byte():
    draw = np.random.default_rng(1)
    texts = [draw.integers(32, 90, n).astype(np.uint8).tobytes() for n in (0, 1, 511, 512, 513, 960, 961, 5000)]
    rows, first = quality.chunks(*joined(texts))
    ends = [*first[1:], len(rows)]
    for text, a, b in zip(texts, first, ends, strict=True):
        back = bytearray(len(text))
        for k, row in enumerate(rows[a:b]):
            part = row[: max(0, len(text) - k * quality.STEP)] & 255
            back[k * quality.STEP : k * quality.STEP + len(part)] = part.astype(np.uint8).tobytes()
        assert bytes(back) == text


def test_repeats_are_marked_within_a_text_only():
    text = b"word " * 20
    marks = quality.symbols(*joined([text, text[:10], b"abcdefghijklmnopqrstuvwxyz"])) >= 256
    assert marks[20:100].all() and not marks[:12].any() and not marks[100:].any()
    alone = quality.symbols(*joined([text])) >= 256
    after = quality.symbols(*joined([text, text])) >= 256
    assert (after[100:] == alone).all()  # whatever text comes before


@pytest.mark.parametrize("name", ["filters", "mix", "bytes"])
def test_slopes_of_the_byte_network(name):
    net = quality.ByteNetwork()
    rows, first = quality.chunks(*joined([b"some text that is here " * 40, b"OTHER!! TEXT!!", b""]))
    labels = np.array([1.0, 0.0, 1.0], np.float32)

    def loss():
        features, _ = net._features(net._pooled(rows, False)[0], first)
        p = sigmoid((features @ net.weights["mix"] + net.weights["bias"][0]).astype(np.float64))
        return -(labels * np.log(p) + (1 - labels) * np.log(1 - p)).mean() + 0.5e-4 * (net.weights["mix"] ** 2).sum()

    slope = net.slopes(rows, first, labels)[name]
    at = np.unravel_index(np.abs(slope).argmax(), slope.shape)
    weight, step = net.weights[name], 2e-3
    weight[at] += step
    up = loss()
    weight[at] -= 2 * step
    assert (up - loss()) / (2 * step) == pytest.approx(slope[at], rel=0.2)


@pytest.mark.parametrize("module,label,least", [(quality, "quality", 0.7), (toxicity, "toxic", 0.3)])
def test_held_out_accuracy(spark, module, label, least):
    rows = corpus()
    docs = spark.createDataFrame([(*r[:3], 0.5) for r in rows] + [(900, None, "en", 0.0), (901, "", None, 0.0)], "doc_id long, text string, lang string, score double")
    labels = spark.createDataFrame([(r[0], r[3], r[4]) for r in rows], "doc_id long, quality int, toxic int")
    held = part_of("doc_id", 4) == 2
    got = {r.doc_id: r for r in module.judged(docs, labels, held, least).collect()}
    assert len(got) == len(rows) + 2 and all(0 <= r.score <= 1 for r in got.values())
    truth = {r[0]: r[3] if label == "quality" else r[4] for r in rows}
    apart = [i for i in truth if got[i].held_out]
    assert len(apart) > 80
    assert sum(got[i].predicted == truth[i] for i in apart) / len(apart) > 0.93
    # Labels that are held out change nothing.
    flipped = labels.withColumn(label, F.when(held, 1 - F.col(label)).otherwise(F.col(label)))
    again = {r.doc_id: r.score for r in module.judged(docs, flipped, held, least).collect()}
    assert again == pytest.approx({i: r.score for i, r in got.items()})


def test_thresholds_by_language(spark):
    rows = corpus(300)
    sample = Sample([r[1].encode() for r in rows], np.array([r[4] for r in rows]), ["en" if r[0] % 3 else None for r in rows], -1.4)
    net = toxicity.WordNetwork().fit(sample)
    assert set(net.thresholds) == {"en", None} and all(0 < t < 1 for t in net.thresholds.values())
    frame = spark.createDataFrame([("en", 1.0), ("en", 0.0), (None, 1.0), ("zz", 0.6)], "lang string, score double")
    marked = frame.select(toxicity.by_language(frame, net, F.col("lang")).alias("toxic")).collect()
    assert [r.toxic for r in marked] == [True, False, True, True]


@pytest.mark.parametrize("module", [quality, toxicity])
def test_without_labels(spark, module):
    docs = spark.createDataFrame([(1, "a b c", "en")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    [row] = module.judged(docs, labels, part_of("doc_id", 4) == 2, 0.7).collect()
    assert row.score == pytest.approx(0.5)
    assert module.judged(docs.limit(0), labels, part_of("doc_id", 4) == 2, 0.7).count() == 0


def test_words_are_those_between_blanks_and_marks():
    assert toxicity.WORDS.findall("Ça va-t-il 3x!".encode().lower()) == [m.encode() for m in re.findall(r"[0-9a-z\u0080-￿]+", "Ça va-t-il 3x!".lower().replace("ç", "Ç"))]


def test_judged_goes_by_language(spark, monkeypatch):
    net = toxicity.WordNetwork()
    net.thresholds = {"en": 0.0, "de": 1.1}
    monkeypatch.setattr(toxicity, "fitted", lambda *_: net)
    rows = [(1, "some words", "en"), (2, "some words", "de"), (2, "some words", "en"), (3, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = toxicity.judged(docs, docs, part_of("doc_id", 4) == 2, 0.3).collect()
    assert sorted((r.doc_id, r.toxic_by_language) for r in got if r.doc_id < 3) == [(1, 1), (2, 0), (2, 1)]
    assert [r.toxic_by_language == (r.score >= 0.5) for r in got if r.doc_id == 3] == [True]


def odd_texts():
    draw = random.Random(12)
    long = " ".join("".join(draw.choices("abcdeXYZ\u00e9", k=draw.randint(1, 9))) for _ in range(700))
    return [t.encode() for t in ("", "a", "word " * 30, "abcabcabcabcabcabcabc" * 40, long, long[:513], "x" * 2000)]


def plain_byte_logit(net, text):
    """The byte network by its definition, one byte, filter and chunk at a time."""
    w = net.weights
    kinds = []
    for i in range(len(text)):
        found = any(i - lag - quality.RUN + 1 >= 0 and text[i - quality.RUN + 1 : i + 1] == text[i - lag - quality.RUN + 1 : i - lag + 1] for lag in quality.LAGS)
        kinds.append(text[i] + 256 * found)
    starts = [0]
    while starts[-1] + quality.CHUNK < len(text):
        starts.append(starts[-1] + quality.STEP)
    pooled = []
    for a in starts:
        row = (kinds[a : a + quality.CHUNK] + [quality.PAD] * quality.CHUNK)[: quality.CHUNK]
        most = [-math.inf] * quality.FILTERS
        for p in range(0, quality.CHUNK - quality.WIDTH + 1, quality.STRIDE):
            seen = np.concatenate([w["bytes"][k] for k in row[p : p + quality.WIDTH]]).astype(np.float64)
            most = np.maximum(most, [seen @ w["filters"][:, f].astype(np.float64) for f in range(quality.FILTERS)])
        pooled.append(np.tanh(most + w["offsets"]))
    features = np.concatenate([np.max(pooled, 0), np.mean(pooled, 0)])
    return float(features @ w["mix"] + w["bias"][0] + net.shift)


@pytest.mark.parametrize("slices", [3, 2048])
def test_byte_network_by_its_definition(slices, monkeypatch):
    monkeypatch.setattr(quality, "SLICE_CHUNKS", slices)
    net = quality.ByteNetwork()
    net.shift = 0.3
    texts = odd_texts()
    want = [plain_byte_logit(net, t) for t in texts]
    assert net.logits(*joined(texts)) == pytest.approx(want, abs=2e-4)
    alone = [net.logits(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0] for t in texts]
    assert alone == pytest.approx(want, abs=2e-4)


def plain_word_logit(net, text):
    """The word network by its definition: each filter at each place of the padded words."""
    w, pad = net.weights, np.zeros(toxicity.EMBEDDED)
    vectors = []
    for word in re.findall(rb"[0-9a-z\x80-\xff]+", text.lower()):
        own, stem = (1 + zlib.crc32(x, seed) % (toxicity.BUCKETS - 1) for x, seed in ((word, 0), (word[: toxicity.STEM], 1)))
        vectors.append(w["words"][own].astype(np.float64) + w["words"][stem])
    vectors += [pad + 2 * w["words"][0]] * max(toxicity.WIDTHS)
    features = []
    for width in toxicity.WIDTHS:
        filters = w[f"filters{width}"].astype(np.float64)
        for f in range(toxicity.FILTERS):
            places = range(len(vectors) - width + 1)
            features.append(math.tanh(max(sum(vectors[p + i] @ filters[i, :, f] for i in range(width)) for p in places)))
    return float(np.array(features) @ w["mix"] + w["bias"][0] + net.shift)


@pytest.mark.parametrize("size", [40, 1 << 20])
def test_word_network_by_its_definition(size, monkeypatch):
    monkeypatch.setattr(toxicity, "SLICE_BYTES", size)
    net = toxicity.WordNetwork()
    net.weights["words"][0] = 0
    texts = [*odd_texts(), b" a b  c ", b"!" * 200, b"one-two " * 9 + b"z" * 100]
    want = [plain_word_logit(net, t) for t in texts]
    tables = net.tables()
    assert net.logits([toxicity.hashed(t) for t in texts], tables) == pytest.approx(want, abs=1e-4)
    assert [float(net.long_logit(t, tables)[0]) for t in texts if t] == pytest.approx([x for t, x in zip(texts, want, strict=True) if t], abs=1e-4)


def test_slopes_of_the_word_network():
    net = toxicity.WordNetwork()
    net.learned[:] = True
    texts = [toxicity.hashed(t) for t in (b"some words that are here", b"other WORDS", b"one")]
    labels = np.array([1.0, 0.0, 1.0], np.float32)

    def loss():
        p = sigmoid(net.logits(texts, net.tables()).astype(np.float64))
        return -(labels * np.log(p) + (1 - labels) * np.log(1 - p)).mean() + 0.5e-5 * (net.weights["words"].astype(np.float64) ** 2).sum()

    slopes = net._slopes(texts, labels)
    for name in ("words", "filters1", "filters3", "mix"):
        slope, weight, step = slopes[name], net.weights[name], 2e-3
        at = np.unravel_index(np.abs(slope).argmax(), slope.shape)
        weight[at] += step
        up = loss()
        weight[at] -= 2 * step
        down = loss()
        weight[at] += step
        assert (up - down) / (2 * step) == pytest.approx(slope[at], rel=0.1)


@pytest.mark.parametrize("module", [quality, toxicity])
def test_rows_without_id_are_not_held_out(spark, module):
    docs = spark.createDataFrame([(None, "a b c", "en"), (None, None, None), (2, "a", "en")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(None, 1, 1), (2, None, None)], "doc_id long, quality int, toxic int")
    got = module.judged(docs, labels, part_of("doc_id", 4) == 2, 0.7).collect()
    assert len(got) == 3 and all(isinstance(r.held_out, bool) for r in got) and not any(r.held_out for r in got if r.doc_id is None)


def test_every_labelled_document_is_learned_from(spark, monkeypatch):
    """All rows count, whatever their number, and each is learned from once a round or sets thresholds."""
    n, seen, taught, start = 12_000, [], [], toxicity.WordNetwork.start
    monkeypatch.setattr(toxicity.WordNetwork, "start", lambda net, found: seen.append(found) or start(net, found))
    monkeypatch.setattr(toxicity, "_taught", lambda rows, net, *_: taught.append(rows.count()) or net.flat())
    docs = spark.range(n).selectExpr("id AS doc_id", "concat('word', id % 97, ' t', id % 2) AS text", "'en' AS lang")
    labels = docs.selectExpr("cast(doc_id AS int) AS doc_id", "cast(doc_id % 2 AS int) AS toxic").where("doc_id % 100 > 0")
    held = part_of("doc_id", 4) == 2
    net = toxicity.fitted(docs, labels, held)
    apart = F.pmod(F.xxhash64(F.col("doc_id").cast("long"), F.lit(1)), F.lit(toxicity.CALIBRATION)) == 0
    counts = {(r.toxic, r.apart): r["count"] for r in labels.where(~held).groupBy("toxic", apart.alias("apart")).count().collect()}
    assert sum(counts.values()) > 2 * 2500 + 3000
    assert seen[0][:, 0].tolist() == [counts[0, False], counts[1, False]]
    assert taught == [counts[0, False] + counts[1, False]] * toxicity.ROUNDS
    assert 0 < net.thresholds["en"] < 1


def test_tasks_are_averaged_by_their_rows(spark):
    rows = corpus(300)
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string")
    usable = spark.createDataFrame([(r[0], r[4]) for r in rows], "id long, label int")
    words = toxicity._labelled_words(docs, usable, "doc_id", "text", "lang").select("label", "words").cache()
    assert words.count() == len(rows) and toxicity._counted(words)[:, 0].tolist() == [240, 60]
    net, parts = toxicity.WordNetwork(), words.rdd.glom().filter(len).collect()
    assert net.start(toxicity._counted(words)) and len(parts) > 1
    want = 0
    for part in parts:
        own = toxicity.WordNetwork()
        own.load(net.flat())
        own.learned = net.learned
        own.learn([([np.frombuffer(r.words, "<u2").reshape(-1, 2) for r in part], np.array([r.label for r in part], np.float32))], 0, 1)
        want = want + own.flat().astype(np.float64) * len(part) / len(rows)
    assert toxicity._taught(words, net, 0, 99, 1) == pytest.approx(want, abs=1e-5)


def test_pieces_of_long_texts_give_the_same_most(monkeypatch):
    net = toxicity.WordNetwork()
    texts = [toxicity.hashed(t) for t in (*odd_texts(), b"a b c d e f g h i", b"x y z")]
    most, places = net._best(texts)
    for size in (1, 2, 7, 100):
        monkeypatch.setattr(toxicity, "PIECE_WORDS", size)
        again, there = net._best(texts)
        assert again == pytest.approx(most, abs=1e-6)
        assert all((a == b).mean() > 0.99 for a, b in zip(there, places, strict=True))
    features = np.concatenate([net.pooled(t, np.zeros(1, np.int64), net.tables()) for t in texts])
    assert np.tanh(most) == pytest.approx(features, abs=1e-5)
