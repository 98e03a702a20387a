"""Toxicity: a convolutional network over hashed words in numpy, thresholds by language."""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.llm.common import Texts, map_texts, record, slim, written
from fleetlens.llm.training import Adam, Sample, labelled_texts, prior_shift, sigmoid, usable_labels

BUCKETS = 1 << 15  # of hashed words; bucket 0 is the padding
EMBEDDED = 8
WIDTHS = (1, 2, 3)  # words that a filter sees
FILTERS = 8  # of each width
STEM = 5  # bytes: words with the same beginning share a part of their embedding
SEEN = 8  # texts that a bucket must be in to be learned about
WORDS = re.compile(rb"[0-9a-z\x80-\xff]+")
BETWEEN = re.compile(rb"[^0-9A-Za-z\x80-\xff]")
SLICE_BYTES = 1 << 20  # of a long text, handled at once

ROUNDS = 4  # of the fit: all labelled documents are learned from in each, and what tasks learned is averaged
DOCS_A_SHARD = 5120  # that one task learns from between two averages, or more
STEPS = 640  # of each shard's fit, at least, however few documents there are
DOCS_A_STEP = 32
RATE = 0.02
BLOCK_WORDS = 1 << 21  # that a task holds at once
PIECE_WORDS = 1 << 16  # that filters run over at once
CALIBRATION = 4  # one in so many labelled documents sets the thresholds instead
BINS = 1 << 16  # of scores, among which a threshold is looked for
ACROSS = 8  # weights in a row of a table of weights


def hashed(text: bytes, last: bool = True) -> np.ndarray:
    """Two buckets for each word, its own and its stem's; padded so that every filter has a place."""
    words = WORDS.findall(text.lower())
    crc = zlib.crc32
    whole = [1 + crc(w) % (BUCKETS - 1) for w in words]
    stems = [1 + crc(w[:STEM], 1) % (BUCKETS - 1) for w in words]
    pad = [0] * max(WIDTHS) if last else []
    return np.array([[*whole, *pad], [*stems, *pad]], np.int64).T


def _parts(text: bytes) -> Iterator[tuple[bytes, bool]]:
    """A text in slices, and whether each is the last one.

    A slice ends between words, or where a word is longer than ``SLICE_BYTES`` after the word.
    """
    at, end = 0, -1
    while end < len(text):
        end = min(len(text), at + SLICE_BYTES)
        if end < len(text):
            rest = BETWEEN.search(text, end)
            end = rest.start() if rest else len(text)
        yield text[at:end], end == len(text)
        at = end


def sliced(text: bytes) -> Iterator[np.ndarray]:
    """``hashed`` of a text in slices, each with the words before it that a filter may reach."""
    before, reach = np.zeros((0, 2), np.int64), max(WIDTHS) - 1
    for part, last in _parts(text):
        found = np.concatenate([before, hashed(part, last)])
        if not last and len(found) < max(WIDTHS):
            before = found
            continue
        yield found
        before = found[len(found) - reach :]


class WordNetwork:
    """Embedded words, filters of several widths, the most of each filter in the text, to one logit."""

    def __init__(self, seed: int = 5):
        draw = np.random.default_rng(seed)
        self.weights = {"words": draw.normal(0, 0.05, (BUCKETS, EMBEDDED)).astype(np.float32)}
        for width in WIDTHS:
            self.weights[f"filters{width}"] = draw.normal(0, 0.1, (width, EMBEDDED, FILTERS)).astype(np.float32)
            self.weights[f"filters{width}"][:, 0] += 1 / width  # start from the words' odds
        self.weights["mix"] = np.full(len(WIDTHS) * FILTERS, 0.2, np.float32)
        self.weights["bias"] = np.zeros(1, np.float32)
        self.learned = np.zeros(BUCKETS, bool)
        self.shift = 0.0
        self.thresholds: dict[str | None, float] = {}

    def tables(self) -> dict[int, np.ndarray]:
        """What each bucket adds to each filter at each of its places: (bucket, place, filter)."""
        w = self.weights
        return {k: np.einsum("be,pef->bpf", w["words"], w[f"filters{k}"]) for k in WIDTHS}

    def pooled(self, buckets: np.ndarray, first: np.ndarray, tables: dict[int, np.ndarray]) -> np.ndarray:
        """Each filter's most over each text, of the places where it lies wholly in the text."""
        out, ends = [], np.append(first[1:], len(buckets))
        for width, table in tables.items():
            each = table[buckets[:, 0]] + table[buckets[:, 1]]
            seen = each[:, 0]
            for place in range(1, width):
                seen[:-place] += each[place:, place]
            for place in range(1, width):
                seen[ends - place] = -np.inf
            out.append(np.maximum.reduceat(seen, first))
        return np.tanh(np.hstack(out))

    def long_logit(self, text: bytes, tables: dict[int, np.ndarray]) -> np.ndarray:
        """The logit of one long text, of which only a slice's words are held at a time."""
        first = np.zeros(1, np.int64)
        pooled = np.maximum.reduce([self.pooled(part, first, tables) for part in sliced(text)])
        return pooled @ self.weights["mix"] + self.weights["bias"][0] + self.shift

    def logits(self, texts: list[np.ndarray], tables: dict[int, np.ndarray]) -> np.ndarray:
        first = np.cumsum([0, *map(len, texts[:-1])])
        pooled = self.pooled(np.concatenate(texts), first, tables)
        return pooled @ self.weights["mix"] + self.weights["bias"][0] + self.shift

    def _best(self, texts: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
        """Each filter's most over each text, and for each width the buckets it saw there: (text, filter, 2, place)."""
        reach = max(WIDTHS) - 1
        pieces, owner = [], []
        for i, t in enumerate(texts):
            cut = [t] if len(t) <= PIECE_WORDS else [t[a : a + PIECE_WORDS + reach] for a in range(0, len(t) - reach, PIECE_WORDS)]
            pieces += cut
            owner += [i] * len(cut)
        groups = np.cumsum([0, *map(len, pieces)])[:-1] // PIECE_WORDS
        edges = [0, *(np.flatnonzero(np.diff(groups)) + 1).tolist(), len(pieces)]
        found = [self._best_of_pieces(pieces[a:b]) for a, b in zip(edges, edges[1:], strict=False)]
        most, places = np.concatenate([m for m, _ in found]), [np.concatenate(p) for p in zip(*(p for _, p in found), strict=True)]
        if len(pieces) == len(texts):
            return most, places
        first = np.searchsorted(owner, np.arange(len(texts)))
        chosen = np.array([a + most[a:b].argmax(0) for a, b in zip(first, [*first[1:], len(pieces)], strict=True)])  # (text, filter)
        each = np.split(chosen, len(WIDTHS), axis=1)
        return most[chosen, np.arange(most.shape[1])], [p[c, np.arange(FILTERS)] for p, c in zip(places, each, strict=True)]

    def _best_of_pieces(self, pieces: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
        w, buckets = self.weights, np.concatenate(pieces)
        sizes = np.array([len(p) for p in pieces])
        ends = np.cumsum(sizes)
        first, of = ends - sizes, np.repeat(np.arange(len(pieces)), sizes)
        inner = w["words"][buckets[:, 0]] + w["words"][buckets[:, 1]]
        most, places = [], []
        for width in WIDTHS:
            filters = w[f"filters{width}"]
            seen = inner @ filters[0]
            for p in range(1, width):
                seen[:-p] += (inner @ filters[p])[p:]
            for p in range(1, width):
                seen[ends - p] = -np.inf
            top = np.maximum.reduceat(seen, first)
            row, which = np.nonzero(seen == top[of])
            at = np.empty((len(pieces), FILTERS), np.int64)
            at[of[row[::-1]], which[::-1]] = row[::-1]  # the first of equal ones
            most.append(top)
            places.append(buckets[at[:, :, None] + np.arange(width)].swapaxes(2, 3))
        return np.hstack(most), places

    def _slopes(self, texts: list[np.ndarray], labels: np.ndarray) -> dict[str, np.ndarray]:
        w = self.weights
        most, places = self._best(texts)
        features = np.tanh(most)
        error = (sigmoid(features @ w["mix"] + w["bias"][0]) - labels).astype(np.float32) / len(labels)
        back = error[:, None] * w["mix"][None] * (1 - features**2)
        slopes = {"mix": features.T @ error, "bias": error.sum(keepdims=True), "words": 1e-5 * w["words"]}
        for n, width in enumerate(WIDTHS):
            g = back[:, n * FILTERS : (n + 1) * FILTERS]
            slopes[f"filters{width}"] = np.einsum("tf,tfpe->pef", g, w["words"][places[n]].sum(2))
            to_words = np.einsum("tf,pef->tfpe", g, w[f"filters{width}"])
            for part in (0, 1):
                np.add.at(slopes["words"], places[n][:, :, part].reshape(-1), to_words.reshape(-1, EMBEDDED))
        slopes["words"][~self.learned] = 0
        return slopes

    def start(self, in_class: np.ndarray) -> bool:
        """Begin from the number of texts of either class that each bucket is in; every text is in bucket 0.

        The first number of each bucket starts as the log odds that a text with it is toxic, over
        those of any text, less two standard errors; buckets in few texts stay as they start.
        False if a class has no text: then there is nothing to learn.
        """
        if not in_class[:, 0].all():
            self.weights["mix"][:] = 0
            return False
        any_text = math.log(in_class[1, 0] / in_class[0, 0])
        toxic, clean = in_class[1] + 0.5, in_class[0] + 0.5
        odds = np.log(toxic / clean) - any_text - 2 * np.sqrt(1 / toxic + 1 / clean)
        self.learned = in_class.sum(0) >= SEEN
        self.learned[0] = False
        self.weights["words"][:] *= self.learned[:, None]
        self.weights["words"][:, 0] = np.maximum(odds, 0)
        self.weights["bias"][0] = any_text
        return True

    def learn(self, blocks: Iterable[tuple[list[np.ndarray], np.ndarray]], turn: int, epochs: int) -> int:
        """Go over each block of texts and labels ``epochs`` times; how many texts there were."""
        step, draw, n = Adam(self.weights, RATE * (1 - turn / ROUNDS)), np.random.default_rng(3 + turn), 0
        for texts, labels in blocks:
            n += len(texts)
            for _ in range(epochs):
                order = draw.permutation(len(texts))
                for at in range(0, len(order), DOCS_A_STEP):
                    some = order[at : at + DOCS_A_STEP]
                    step.step(self._slopes([texts[i] for i in some], labels[some]))
        return n

    def probabilities(self, texts: list[np.ndarray]) -> np.ndarray:
        w = self.weights
        return sigmoid((np.tanh(self._best(texts)[0]) @ w["mix"] + w["bias"][0] + self.shift).astype(np.float64))

    def flat(self) -> np.ndarray:
        """All weights as a table of ``ACROSS`` columns."""
        whole = np.concatenate([self.weights[k].ravel() for k in sorted(self.weights)])
        return np.append(whole, np.zeros(-len(whole) % ACROSS, np.float32)).reshape(-1, ACROSS)

    def load(self, flat: np.ndarray) -> None:
        at, whole = 0, flat.ravel().astype(np.float32)
        for k in sorted(self.weights):
            w = self.weights[k]
            w[...] = whole[at : at + w.size].reshape(w.shape)
            at += w.size

    def fit(self, sample: Sample) -> WordNetwork:
        """``fitted`` for texts at hand: learn from most, then set each language's threshold on the rest.

        With one class only, every score is the odds of the labels.
        """
        labels, texts = sample.labels.astype(np.float32), [hashed(t) for t in sample.texts]
        rest = np.arange(len(texts)) % CALIBRATION == 0
        learn, held = np.flatnonzero(~rest), np.flatnonzero(rest)
        if not self.start(_in_class([texts[i] for i in learn], sample.labels[learn])):
            self.shift = sample.log_odds
            return self
        for turn in range(ROUNDS):
            self.learn([([texts[i] for i in learn], labels[learn])], turn, _epochs(len(learn)))
        self.shift = prior_shift(sample)
        scores = self.probabilities([texts[i] for i in held])
        for lang in {sample.langs[i] for i in held}:
            own = np.array([sample.langs[i] == lang for i in held])
            self.thresholds[lang] = _best_threshold(scores[own], sample.labels[held][own])
        return self


def _in_class(texts: Iterable[np.ndarray], labels: Iterable[int]) -> np.ndarray:
    """The number of texts of either class that each bucket is in."""
    found = np.zeros((2, BUCKETS), np.int64)
    for text, label in zip(texts, labels, strict=True):
        seen = np.zeros(BUCKETS, bool)
        seen[text.ravel()] = True
        found[label] += seen
    return found


def _epochs(docs: float) -> int:
    """How often a shard of so many texts is gone over in a round."""
    return max(1, round(STEPS * DOCS_A_STEP / ROUNDS / max(1, docs)))


def _best_threshold(scores: np.ndarray, labels: np.ndarray) -> float:
    """The threshold of the highest F1; 0.5 where there is no toxic text to go by."""
    if not labels.any() or labels.all():
        return 0.5
    order = np.argsort(-scores)
    hits = np.cumsum(labels[order])
    f1 = 2 * hits / (np.arange(1, len(order) + 1) + labels.sum())
    best = int(f1.argmax())
    below = scores[order[best + 1]] if best + 1 < len(order) else 0.0
    return float((scores[order[best]] + below) / 2)


def _labelled_words(docs: DataFrame, usable: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """``(lang, label, apart, words)`` of every labelled document, in an order that says nothing of them."""

    def work(texts: Texts) -> pa.RecordBatch:
        words = pa.array([b"".join(hashed(*p).astype("<u2").tobytes() for p in _parts(t)) for t in texts.each()], pa.binary())
        return record(id=texts.ids, lang=texts.rows.column("lang"), words=words)

    texts = slim(docs, id_col, text_col, lang=F.col(lang_col).cast("string"))
    labelled = labelled_texts(texts, usable, lambda rows: map_texts(rows, f"id {texts.schema['id'].dataType.simpleString()}, lang string, words binary", work))
    apart = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(CALIBRATION)) == 0
    return labelled.sortWithinPartitions(F.xxhash64("id"), "id", "label", "words").select("lang", "label", apart.alias("apart"), "words")


def _read(batch: pa.RecordBatch) -> tuple[list[np.ndarray], np.ndarray]:
    words = [np.frombuffer(w.as_buffer(), "<u2").reshape(-1, 2) for w in batch.column("words")]
    return words, batch.column("label").to_numpy()


def _blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """Texts and labels of so many words as a task may hold, or of one longer text."""
    texts, labels, size = [], [], 0
    for batch in batches:
        for text, label in zip(*_read(batch), strict=True):
            if texts and size + len(text) > BLOCK_WORDS:
                yield texts, np.array(labels, np.float32)
                texts, labels, size = [], [], 0
            texts.append(text)
            labels.append(label)
            size += len(text)
    if texts:
        yield texts, np.array(labels, np.float32)


def _counted(rows: DataFrame) -> np.ndarray:
    """``_in_class`` of all rows."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            found += _in_class(*_read(batch))
        some = np.flatnonzero(found.any(0))
        yield record(bucket=some, clean=found[0, some], toxic=found[1, some])

    counts = rows.select("label", "words").mapInArrow(run, "bucket long, clean long, toxic long")
    table = counts.groupBy("bucket").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).toArrow()  # a row for each bucket
    found = np.zeros((2, BUCKETS), np.int64)
    found[:, table.column("bucket").to_numpy()] = [table.column("clean").to_numpy(), table.column("toxic").to_numpy()]
    return found


def _taught(rows: DataFrame, network: WordNetwork, turn: int, shards: int, epochs: int) -> np.ndarray:
    """The weights after each task has learned from all its rows, averaged by numbers of rows."""
    sent = rows.sparkSession.sparkContext.broadcast(network)  # of fixed size
    columns = [f"v{i}" for i in range(ACROSS)]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = WordNetwork()
        own.load(sent.value.flat())
        own.learned = sent.value.learned
        if n := own.learn(_blocks(batches), turn, epochs):
            flat = own.flat().astype(np.float64) * n
            yield record(at=np.arange(len(flat)), n=np.full(len(flat), float(n)), **{c: flat[:, i].copy() for i, c in enumerate(columns)})

    made = rows.select("label", "words").coalesce(shards).mapInArrow(run, "at long, n double, " + ", ".join(f"{c} double" for c in columns))
    mean = made.groupBy("at").agg(*[(F.sum(c) / F.sum("n")).alias(c) for c in columns]).orderBy("at").toArrow()  # as many rows as weights
    return np.stack([mean.column(c).to_numpy() for c in columns], 1)


def _thresholds(rows: DataFrame, network: WordNetwork) -> dict[str | None, float]:
    """The threshold of the highest F1 over all rows of each language that has both classes."""
    sent = rows.sparkSession.sparkContext.broadcast(network)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = sent.value.probabilities(_read(batch)[0]) if batch.num_rows else np.zeros(0)
            bins = np.minimum(scores * BINS, BINS - 1).astype(np.int64)
            yield record(lang=batch.column("lang"), label=batch.column("label"), bin=bins)

    scored = rows.select("lang", "label", "words").mapInArrow(run, "lang string, label int, bin long")
    bins = scored.groupBy("lang", "bin").agg(F.sum("label").alias("toxic"), F.count(F.lit(1)).alias("n"))
    of_lang = Window.partitionBy("lang")
    down = of_lang.orderBy(F.desc("bin"))  # over at most BINS rows
    f1 = 2 * F.sum("toxic").over(down) / (F.sum("n").over(down) + F.sum("toxic").over(of_lang))
    least = (F.col("bin") + F.coalesce(F.lead("bin").over(down) + 1, F.lit(0))) / (2 * BINS)
    both = (F.sum("toxic").over(of_lang) > 0) & (F.sum("toxic").over(of_lang) < F.sum("n").over(of_lang))
    best = bins.select("lang", "bin", f1.alias("f1"), least.alias("least"), both.alias("both")).where("both")
    return {r.lang: r.least for r in best.groupBy("lang").agg(F.max_by("least", F.struct("f1", "bin")).alias("least")).collect()}


def fitted(
    docs: DataFrame, labels: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text",
    label: str = "toxic", lang_col: str = "lang",
) -> WordNetwork:
    """A network fitted on every labelled document, of which one in ``CALIBRATION`` sets the thresholds.

    Rows of ``labels`` for which ``held_out`` is true are never looked at. The language
    only sets thresholds; no score depends on it. Buckets are counted over all documents first.
    Then tasks go over their own documents and their weights are averaged, ``ROUNDS`` times, so the
    weights depend a little on how Spark deals the documents to tasks.
    With one class only, every score is the odds of the labels.
    """
    usable = written(usable_labels(labels, label, held_out, id_col, docs.schema[id_col].dataType), "labels")
    rows = written(_labelled_words(docs, usable, id_col, text_col, lang_col), "labelled-words")
    learned, network = rows.where("not apart"), WordNetwork()
    in_class = _counted(learned)
    if not network.start(in_class):
        counts = {r.label: r.n for r in usable.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
        network.shift = math.log((counts.get(1, 0) + 1) / (counts.get(0, 0) + 1))
        return network
    n = int(in_class[:, 0].sum())
    shards = -(-n // DOCS_A_SHARD)
    for turn in range(ROUNDS):
        network.load(_taught(learned, network, turn, shards, _epochs(n / shards)))
    network.thresholds = _thresholds(rows.where("apart"), network)
    return network


def score(
    docs: DataFrame, network: WordNetwork, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = None
) -> DataFrame:
    """``(id_col, score)``: the probability that each whole text is toxic; with ``lang_col`` also ``lang``.

    Null and empty texts are one padding and get its score. Rows are handled one by one;
    only the id and the text are looked at.
    """
    sent = docs.sparkSession.sparkContext.broadcast(network)  # of fixed size
    cache: list[dict[int, np.ndarray]] = []

    def work(texts: Texts) -> pa.RecordBatch:
        if not cache:
            cache.append(sent.value.tables())
        if len(texts) == 1 and len(texts.data) > SLICE_BYTES:
            logits = sent.value.long_logit(texts.data.tobytes(), cache[0])
        else:
            logits = sent.value.logits([hashed(t) for t in texts.each()], cache[0])
        more = {"lang": texts.rows.column("lang")} if lang_col else {}
        return record(id=texts.ids, score=sigmoid(logits.astype(np.float64)), **more)

    frame = slim(docs, id_col, text_col, **({"lang": F.col(lang_col).cast("string")} if lang_col else {}))
    kind = frame.schema["id"].dataType.simpleString()
    return map_texts(frame, f"id {kind}, score double" + ", lang string" * bool(lang_col), work).withColumnRenamed("id", id_col)


def by_language(scored: DataFrame, network: WordNetwork, lang: Column) -> Column:
    """Whether ``score`` reaches the threshold of the row's language (0.5 for one not met)."""
    least = F.lit(0.5)
    for name, threshold in network.thresholds.items():
        least = F.when(lang.eqNullSafe(F.lit(name)), F.lit(threshold)).otherwise(least)
    return F.col("score") >= least


def judged(docs: DataFrame, labels: DataFrame, held_out: Column, least: float) -> DataFrame:
    """``(doc_id, held_out, score, predicted, toxic_by_language)`` with a network fitted on the labels not held out.

    ``predicted`` goes by ``least``, ``toxic_by_language`` by the threshold of the document's language.
    Each row is judged by its own text: repeated ids come out as often as they are there, and
    null and empty texts have the score of padding. A row whose id is null is not held
    out. A score of the threshold itself counts as toxic.
    """
    network = fitted(docs, labels, held_out)
    scored = score(docs, network, lang_col="lang")
    return scored.select(
        "doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"),
        by_language(scored, network, F.col("lang")).cast("int").alias("toxic_by_language"),
    )
