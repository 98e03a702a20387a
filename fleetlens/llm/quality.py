"""Quality classifier: a byte-level convolutional network in numpy."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import Texts, map_texts, record, slim, small_batches
from fleetlens.llm.training import Adam, Sample, labelled_sample, prior_shift, sigmoid

CHUNK = 512  # bytes of a chunk ...
STEP = 448  # ... and from one chunk to the next, so that they overlap
WIDTH = 8  # bytes that a filter sees
STRIDE = 2
FILTERS = 24
EMBEDDED = 8
PLACES = (CHUNK - WIDTH) // STRIDE + 1

# A byte counts as a repeat if it ends a run of RUN bytes equal to those a few bytes earlier.
LAGS = range(2, 25)
RUN = 12
PAD = 0
KINDS = 512  # 256 bytes, and the same as repeats

PER_CLASS = 1200  # most labelled documents of either class that are learned from
SLICE_CHUNKS = 2048  # chunks of one long text that are held at a time
STEPS = 500  # of the fit, at least, however few documents there are
EPOCHS = 6
DOCS_A_STEP = 24
RATE = 0.004


def symbols(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The bytes, 256 higher where they repeat what is shortly before in the same text."""
    repeats = np.zeros(len(data), bool)
    place = np.arange(len(data), dtype=np.int32) - np.repeat(starts[:-1], np.diff(starts)).astype(np.int32)
    for lag in LAGS:
        if len(data) <= lag + RUN:
            break
        same = data[lag:] == data[:-lag]
        run = same[1:] & same[:-1]  # 2 in a row
        run = run[2:] & run[:-2]  # 4
        wide = run[4:] & run[:-4]  # 8
        run = wide[4:] & run[: len(wide) - 4]  # 12
        back = lag + RUN - 1  # as far as the earlier run begins
        repeats[back:] |= run & (place[back:] >= back)
    return data + 256 * repeats.astype(np.int16)


def chunks(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chunks that cover each whole text, padded, and the first chunk of each text."""
    sizes = np.diff(starts)
    counts = np.maximum(1, -(-(sizes - CHUNK) // STEP) + 1)
    first = np.cumsum(counts) - counts
    number = np.arange(counts.sum()) - np.repeat(first, counts)
    begin = np.repeat(starts[:-1], counts) + number * STEP
    padded = np.append(symbols(data, starts), np.full(CHUNK, PAD, np.int16))
    found = padded[begin[:, None] + np.arange(CHUNK)]
    found[np.arange(CHUNK) >= (np.repeat(starts[1:], counts) - begin)[:, None]] = PAD
    return found, first


class ByteNetwork:
    """Embedded bytes, filters over all places of each chunk, the most of each filter in a
    chunk, then the most and the mean of these over the document's chunks, to one logit."""

    def __init__(self, seed: int = 7):
        draw = np.random.default_rng(seed)
        self.weights = {
            "bytes": draw.normal(0, 0.5, (KINDS, EMBEDDED)).astype(np.float32),
            "filters": draw.normal(0, (WIDTH * EMBEDDED) ** -0.5, (WIDTH * EMBEDDED, FILTERS)).astype(np.float32),
            "offsets": np.zeros(FILTERS, np.float32),
            "mix": draw.normal(0, 0.1, 2 * FILTERS).astype(np.float32),
            "bias": np.zeros(1, np.float32),
        }
        self.shift = 0.0

    def _pooled(self, rows: np.ndarray, where: bool) -> tuple[np.ndarray, np.ndarray | None]:
        """Each filter's most in each chunk, and its place there."""
        w = self.weights
        most = np.empty((len(rows), FILTERS), np.float32)
        place = np.empty((len(rows), FILTERS), np.int64) if where else None
        for at in range(0, len(rows), 128):
            part = w["bytes"][rows[at : at + 128]]
            view = np.lib.stride_tricks.sliding_window_view(part.reshape(len(part), -1), WIDTH * EMBEDDED, axis=1)
            seen = view[:, :: STRIDE * EMBEDDED].reshape(-1, WIDTH * EMBEDDED) @ w["filters"]
            seen = seen.reshape(len(part), PLACES, FILTERS)
            most[at : at + 128] = seen.max(axis=1)
            if where:
                place[at : at + 128] = seen.argmax(axis=1)
        return np.tanh(most + w["offsets"]), place

    def _features(self, pooled: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        counts = np.diff(np.append(first, len(pooled)))[:, None]
        return np.hstack([np.maximum.reduceat(pooled, first), np.add.reduceat(pooled, first) / counts]), counts

    def logits(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        if len(starts) == 2 and len(data) > SLICE_CHUNKS * STEP + CHUNK:
            features = self._sliced(data)
        else:
            rows, first = chunks(data, starts)
            features, _ = self._features(self._pooled(rows, False)[0], first)
        return features @ self.weights["mix"] + self.weights["bias"][0] + self.shift

    def _sliced(self, data: np.ndarray) -> np.ndarray:
        """The features of one long text, of which only some chunks are held at a time.

        Each slice comes with as many bytes before it as repeats are looked for in.
        """
        most, total, count = np.full(FILTERS, -np.inf, np.float32), np.zeros(FILTERS, np.float64), 0
        reach = -(-(max(LAGS) + RUN) // STEP)
        chunks_in_all = -(-(len(data) - CHUNK) // STEP) + 1
        for at in range(0, chunks_in_all, SLICE_CHUNKS):
            begin, end = max(0, at - reach), min(chunks_in_all, at + SLICE_CHUNKS)
            part = data[begin * STEP : (end - 1) * STEP + CHUNK]
            rows = chunks(part, np.array([0, len(part)]))[0][at - begin : end - begin]
            pooled = self._pooled(rows, False)[0]
            most = np.maximum(most, pooled.max(0))
            total += pooled.sum(0, dtype=np.float64)
            count += len(rows)
        return np.hstack([most, (total / count).astype(np.float32)])[None]

    def slopes(self, rows: np.ndarray, first: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
        w = self.weights
        pooled, place = self._pooled(rows, True)
        features, counts = self._features(pooled, first)
        error = (sigmoid(features @ w["mix"] + w["bias"][0]) - labels).astype(np.float32) / len(labels)
        text_of = np.repeat(np.arange(len(first)), counts[:, 0])
        back = error[:, None] * w["mix"][None, :]
        is_most = pooled == features[text_of, :FILTERS]
        to_chunk = is_most * back[text_of, :FILTERS] + (back[:, FILTERS:] / counts)[text_of]
        to_chunk = (to_chunk * (1 - pooled**2)).astype(np.float32)
        # Only the window that gave a filter's most gets its slope.
        seen = rows[np.arange(len(rows))[:, None, None], place[:, :, None] * STRIDE + np.arange(WIDTH)]
        windows = w["bytes"][seen].reshape(len(rows), FILTERS, -1)
        to_bytes = (to_chunk[:, :, None] * w["filters"].T[None]).reshape(-1, EMBEDDED)
        flat = seen.reshape(-1)
        bytes_ = np.stack([np.bincount(flat, to_bytes[:, d], KINDS) for d in range(EMBEDDED)], 1)
        return {
            "bytes": bytes_,
            "filters": np.einsum("cf,cfk->kf", to_chunk, windows),
            "offsets": to_chunk.sum(0),
            "mix": features.T @ error + 1e-4 * w["mix"],
            "bias": error.sum(keepdims=True),
        }

    def fit(self, sample: Sample, seed: int = 11) -> ByteNetwork:
        """Learn from the sample; with one class only, every score is the odds of the labels."""
        labels = sample.labels.astype(np.float32)
        if len(set(sample.labels.tolist())) < 2:
            self.weights["mix"][:] = 0
            self.shift = sample.log_odds
            return self
        each = [chunks(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0] for t in sample.texts]
        weight, draw = Adam(self.weights, RATE), np.random.default_rng(seed)
        epochs = max(EPOCHS, STEPS * DOCS_A_STEP // len(each))
        for epoch in range(epochs):
            weight.rate = RATE * (1 - epoch / epochs)
            order = draw.permutation(len(each))
            for at in range(0, len(order), DOCS_A_STEP):
                some = order[at : at + DOCS_A_STEP]
                first = np.cumsum([0, *(len(each[i]) for i in some[:-1])])
                weight.step(self.slopes(np.concatenate([each[i] for i in some]), first, labels[some]))
        self.shift = prior_shift(sample)
        return self


def fitted(
    docs: DataFrame, labels: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text",
    label: str = "quality", per_class: int = PER_CLASS,
) -> ByteNetwork:
    """A network fitted on at most ``per_class`` labelled documents of each class.

    Rows of ``labels`` for which ``held_out`` is true are never looked at.
    """
    return ByteNetwork().fit(labelled_sample(docs, labels, label, held_out, id_col, text_col, None, per_class))


def score(docs: DataFrame, network: ByteNetwork, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, score)``: the probability that each whole text is of good quality.

    Null and empty texts are one empty chunk and get its score. Rows are handled one by
    one; only the id and the text are looked at.
    """
    sent = docs.sparkSession.sparkContext.broadcast(network)  # of fixed size

    def work(texts: Texts) -> pa.RecordBatch:
        return record(id=texts.ids, score=sigmoid(sent.value.logits(texts.data, texts.starts).astype(np.float64)))

    frame = slim(docs, id_col, text_col)
    kind = frame.schema["id"].dataType.simpleString()
    return map_texts(frame, f"id {kind}, score double", work).withColumnRenamed("id", id_col)


def keep_good(
    docs: DataFrame, network: ByteNetwork, least: float, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The rows of ``docs`` whose text scores ``least`` or more, with all their columns."""
    sent = docs.sparkSession.sparkContext.broadcast(network)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts in small_batches(batches, id_col=id_col, text_col=text_col):
            scores = sigmoid(sent.value.logits(texts.data, texts.starts).astype(np.float64))
            yield texts.rows.filter(pa.array(scores >= least))

    return docs.mapInArrow(run, docs.schema)


def judged(docs: DataFrame, labels: DataFrame, held_out: Column, least: float) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` with a network fitted on the labels not held out.

    Each row is judged by its own text: repeated ids come out as often as they are there, and
    null and empty texts have the score of an empty chunk. A row whose id is null is not
    held out. A score of ``least`` itself is predicted 1.
    """
    scored = score(docs, fitted(docs, labels, held_out))
    return scored.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))
