"""Labelled samples for the classifiers of this subpackage, and what they share."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

def fold(modulus: int) -> Column:
    """crc32 of doc_id as text, modulo a number."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus


def sample(docs: DataFrame, labels: DataFrame, label: str, allowed: Column, rows: tuple[int, int], chars: int) -> tuple[list[str], np.ndarray]:
    """Texts and labels (0 or 1) of at most ``rows`` allowed documents of label 1 and of label 0, in an order given by hashes of doc_id.

    Repeated labels of a doc_id count once, and not at all if they differ; of repeated rows of a doc_id the smallest hash of a text counts. A text of
    more than ``chars`` characters is left out, so the sample may be smaller; both limits bound what the driver holds.
    """
    known = labels.where(allowed & F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.min(label).alias("label"), F.max(label).alias("_other")).where("label = _other")
    ordered = known.select("doc_id", "label").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = ordered.where("label = 1").limit(rows[0]).unionByName(ordered.where("label = 0").limit(rows[1]))
    # the chosen ids are a bounded table: at most sum(rows)
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id").where(F.length("text") <= chars)
    # one text a document, before anything reaches the driver
    found = found.groupBy("doc_id", "label").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("least"))
    got = sorted((r[0], r[1], r[2]) for r in found.select("doc_id", "label", "least.text").collect())
    return [t for _, _, t in got], np.array([y for _, y, _ in got], np.float64)


class Adam:
    def __init__(self, rate: float):
        self.rate, self.step, self.state = rate, 0, {}

    def update(self, **pairs: tuple[np.ndarray, np.ndarray]) -> None:
        self.step += 1
        for name, (value, slope) in pairs.items():
            m, v = self.state.setdefault(name, (np.zeros_like(value), np.zeros_like(value)))
            m += 0.1 * (slope - m)
            v += 0.001 * (slope * slope - v)
            value -= self.rate * (m / (1 - 0.9**self.step)) / (np.sqrt(v / (1 - 0.999**self.step)) + 1e-8)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))
