"""What the text classifiers share: labelled texts, all or a bounded sample, Adam, and prior correction."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from fleetlens.llm.bloom import split_by_filter


@dataclass
class Sample:
    texts: list[bytes]
    labels: np.ndarray  # 0 or 1
    langs: list[str | None]
    log_odds: float  # of label 1 among all labelled rows that may be learned from


def usable_labels(labels: DataFrame, label: str, held_out: Column, id_col: str, kind: DataType) -> DataFrame:
    """``(id, label)`` of the rows that may be learned from: with an id, not held out, and of either class."""
    return labels.where(~F.coalesce(held_out, F.lit(True))).where(F.col(label).isin(0, 1)).select(
        F.col(id_col).cast(kind).alias("id"), F.col(label).cast("int").alias("label")
    ).where("id IS NOT NULL")


def labelled_texts(texts: DataFrame, usable: DataFrame, slimmed: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Every row of ``slimmed(texts)`` that has a label, with it; ``usable`` is a written table.

    A filter of ids leaves out most others before texts are slimmed, and so before they are shuffled.
    """
    return slimmed(split_by_filter(texts, usable, "id")[0]).join(usable, "id")


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, held_out: Column, id_col: str, text_col: str,
    lang_col: str | None, per_class: int,
) -> Sample:
    """At most ``per_class`` labelled documents of each class, whole, the same ones each time.

    They are those whose hashed ids are smallest. The counts for the odds cover all labels.
    Rows without id or label, and rows for which ``held_out`` is true, are left out.
    """
    usable = labels.where(~F.coalesce(held_out, F.lit(True))).where(F.col(label).isin(0, 1)).select(
        F.col(id_col).alias("id"), F.col(label).cast("int").alias("label")
    )
    counts = {r.label: r.n for r in usable.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    # Each task keeps its first per_class rows of a class before any are sent.
    first = [usable.where(F.col("label") == k).orderBy(F.xxhash64("id"), "id").limit(per_class) for k in (0, 1)]
    chosen = first[0].unionByName(first[1])
    lang = F.col(lang_col) if lang_col else F.lit(None).cast("string")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), lang.alias("lang"))
    # At most twice per_class slim rows.
    rows = texts.join(F.broadcast(chosen), "id").orderBy(F.xxhash64("id"), "id", "text").limit(2 * per_class)
    table = rows.toArrow()
    return Sample(
        [(t or "").encode() for t in table.column("text").to_pylist()],
        table.column("label").to_numpy(),
        table.column("lang").to_pylist(),
        math.log((counts.get(1, 0) + 1) / (counts.get(0, 0) + 1)),
    )


def prior_shift(sample: Sample) -> float:
    """What a model fitted on the sample adds to its logit to hold for all labelled rows."""
    ones = int(sample.labels.sum())
    return sample.log_odds - math.log((ones + 1) / (len(sample.labels) - ones + 1))


class Adam:
    def __init__(self, weights: dict[str, np.ndarray], rate: float):
        self.weights, self.rate, self.steps = weights, rate, 0
        self.mean = {k: np.zeros_like(w) for k, w in weights.items()}
        self.square = {k: np.zeros_like(w) for k, w in weights.items()}

    def step(self, slopes: dict[str, np.ndarray]) -> None:
        self.steps += 1
        for k, g in slopes.items():
            self.mean[k] += 0.1 * (g - self.mean[k])
            self.square[k] += 0.01 * (g * g - self.square[k])
            scale = math.sqrt(1 - 0.99**self.steps) / (1 - 0.9**self.steps)
            self.weights[k] -= (self.rate * scale * self.mean[k] / (np.sqrt(self.square[k]) + 1e-6)).astype(np.float32)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))
