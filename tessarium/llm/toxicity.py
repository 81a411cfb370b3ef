"""Toxicity by averaged subword embeddings under a linear softmax, trained jointly in numpy.

A word is the bag of its whole form and its character 3- to 5-grams, hashed into buckets, so misspellings share most vectors with the words
they come from. A document is the average of its bags; embeddings and softmax are fitted together. Buckets never seen in training stay at
zero. The model is fitted on a bounded sample (1,500 toxic and 4,500 other rows at most) and every row is scored by its whole text.

Scores are the chances of label 1 if both labels were equally frequent: the log odds of the sample's share, which its two limits shape, are taken off
the bias. Null and empty texts score by the bias alone. If a class is missing from the sample, all rows score that share (0 for no
labels). Repeated rows score alike; repeated labels of a doc_id count once, differing ones not at all. Only the text is scored; other columns don't matter.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessarium.llm.common import map_arrow, rows, texts
from tessarium.llm.training import Adam, sample, sigmoid

BUCKETS, DIMENSIONS, STEPS, RATE = 1 << 18, 4, 80, 0.05
#: Averages are scaled up before the softmax; a penalty on squares, and words of fewer documents left out, keep rare words from being learnt by heart.
SCALE, PENALTY, LEAST_DOCUMENTS = 100.0, 1e-4, 4
#: Words whose sums a worker remembers, bytes of a word up to which it is remembered, and n-grams of a longer word hashed at a time.
REMEMBERED, WORD_CHARS, GRAMS = 300_000, 64, 1 << 16
#: The table of CRC-32, as zlib has it.
CRC = np.array([zlib.crc32(bytes([255 - i])) ^ 0xFF000000 for i in range(256)], np.uint32)


def plain(word: bytes) -> bytes:
    """Lower case, without punctuation at the ends."""
    return word.lower().strip(b".,;:!?\"'()[]|*%&$#")


def bag_size(word: bytes) -> int:
    return 1 + sum(max(0, len(word) + 3 - n) for n in (3, 4, 5))


def long_subwords(word: bytes) -> Iterator[np.ndarray]:
    """subwords() of a long word, some at a time: the CRC of all n-grams at once, byte by byte."""
    w = b"<" + word + b">"
    yield np.array([zlib.crc32(w + b"*") & (BUCKETS - 1)])
    raw = np.frombuffer(w, np.uint8)
    for a in range(0, len(raw), GRAMS):
        crc = np.full(min(GRAMS, len(raw) - a), 0xFFFFFFFF, np.uint32)
        for k in range(5):
            crc = crc[: len(raw) - a - k]
            crc = CRC[(crc ^ raw[a + k : a + k + len(crc)]) & 255] ^ (crc >> np.uint32(8))
            if k >= 2:
                yield (~crc & np.uint32(BUCKETS - 1)).astype(np.int64)


def subwords(word: bytes) -> list[int] | np.ndarray:
    """Buckets of a plain word's bag: the word and its n-grams, ends marked."""
    if len(word) > WORD_CHARS:
        return np.concatenate(list(long_subwords(word)))
    w = b"<" + word + b">"
    grams = [w + b"*", *(w[i : i + n] for n in (3, 4, 5) for i in range(len(w) - n + 1))]
    return [zlib.crc32(g) & (BUCKETS - 1) for g in grams]


class Sums:
    """Weighted sums of rows of one table into rows of another, and back, as runs of sorted places."""

    def __init__(self, to: np.ndarray, source: np.ndarray, value: np.ndarray, n_to: int, n_source: int):
        self.ways = []
        for at, other, n in ((to, source, n_to), (source, to, n_source)):
            order = np.argsort(at, kind="stable")
            places, starts = np.unique(at[order], return_index=True)
            self.ways.append((other[order], value[order][:, None], places, starts, n))

    def __call__(self, table: np.ndarray, back: bool = False) -> np.ndarray:
        other, value, places, starts, n = self.ways[back]
        out = np.zeros((n, table.shape[1]))
        if len(starts):
            terms = table[other]
            terms *= value
            out[places] = np.add.reduceat(terms, starts)
        return out


def counted(documents: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, dict[bytes, int]]:
    """Document, word and count of each distinct plain word of a document, in arrays that keep the driver's memory small, and the words' numbers."""
    ids: dict[bytes, int] = {}
    words, times = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
    for text in documents:
        found, n = np.unique(np.array([ids.setdefault(plain(w), len(ids)) for w in text.encode().split()], np.int32), return_counts=True)
        words.append(found)
        times.append(n.astype(np.int32))
    doc = np.repeat(np.arange(len(documents), dtype=np.int32), [len(w) for w in words[1:]])
    return doc, np.concatenate(words), np.concatenate(times), ids


def fit(documents: list[str], labels: np.ndarray) -> tuple[np.ndarray, float]:
    """A weight for each bucket (its embedding times the difference of the softmax rows), and the bias at equal odds of the labels."""
    weights = np.zeros(BUCKETS)
    share = labels.mean() if len(labels) else 0.0
    if not 0 < share < 1:
        return weights, float(np.log(max(share, 1e-9) / max(1 - share, 1e-9)))
    doc, word, times, ids = counted(documents)
    sizes = np.array([bag_size(w) for w in ids], np.int64)
    # words outside the vocabulary only lengthen the average
    total = np.bincount(doc, times * sizes[word], len(documents)) + 1e-9
    seen = np.bincount(word, minlength=len(ids))
    vocabulary = sorted(w for w, i in ids.items() if seen[i] >= LEAST_DOCUMENTS)
    place = np.full(len(ids), -1, np.int32)
    place[[ids[w] for w in vocabulary]] = np.arange(len(vocabulary))
    del ids
    known = place[word] >= 0
    doc, word, times = doc[known], place[word[known]], times[known]
    bags = [np.array(subwords(w), np.int32) for w in vocabulary]
    used, local = np.unique(np.concatenate(bags) if bags else np.zeros(0, np.int32), return_inverse=True)
    to_word = Sums(np.repeat(np.arange(len(bags), dtype=np.int32), [len(b) for b in bags]), local.astype(np.int32), np.ones(len(local)), len(bags), len(used))
    to_doc = Sums(doc, word, SCALE * times / total[doc], len(documents), len(bags))
    rng = np.random.default_rng(0)
    E, W, b = np.zeros((len(used), DIMENSIONS)), rng.normal(0, 1, (DIMENSIONS, 2)), np.array([0.0, np.log(share / (1 - share))])
    adam = Adam(RATE)
    for _ in range(STEPS):
        X = to_doc(to_word(E))
        Z = X @ W + b
        slope = (sigmoid(Z[:, 1] - Z[:, 0]) - labels) / len(labels)
        slope = np.stack([-slope, slope], 1)
        back = to_word(to_doc(slope @ W.T, back=True), back=True)
        adam.update(E=(E, back + PENALTY * E), W=(W, X.T @ slope + PENALTY * W), b=(b, slope.sum(0)))
    weights[used] = SCALE * E @ (W[:, 1] - W[:, 0])
    return weights, float(b[1] - b[0] - np.log(share / (1 - share)))


def scored(docs: DataFrame, labels: DataFrame, allowed: Column, label: str = "toxic", sample_rows: tuple[int, int] = (1500, 4500), sample_chars: int = 100_000) -> DataFrame:
    """doc_id, score: the chance of label 1 at equal odds of the labels; fitted on rows of labels that are allowed.

    sample_rows: documents of label 1 and of label 0 that it is fitted on at most. sample_chars: longer texts are not among them (all are scored).
    """
    weights, bias = fit(*sample(docs, labels, label, allowed, sample_rows, sample_chars))
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        class Words(dict):
            def __missing__(self, word: bytes) -> complex:
                if len(self) >= REMEMBERED:
                    self.clear()
                if len(short := plain(word)) > WORD_CHARS:
                    return complex(sum(weights[bag].sum() for bag in long_subwords(short)), bag_size(short))
                bag = subwords(short)
                found = complex(weights[bag].sum(), len(bag))
                if len(word) <= WORD_CHARS:
                    self[word] = found
                return found

        words = Words()
        for batch in batches:
            sums = np.array([sum(map(words.__getitem__, t.encode().split()), 0j) for t in texts(batch)], np.complex128)
            yield rows(schema, batch.column("doc_id"), sigmoid(sums.real / np.maximum(sums.imag, 1) + bias))

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, score double")
