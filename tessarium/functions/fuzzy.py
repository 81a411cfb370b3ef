"""Indel similarity of names, in Arrow batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType


def places_of(a: str) -> dict[str, int]:
    """Where each character stands, as bits."""
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    return places


def common_subsequence(a: str, b: str, places: dict[str, int] | None = None) -> int:
    """Length of the longest common subsequence, one machine word operation a character; places are those of a."""
    places = places_of(a) if places is None else places
    full = (1 << len(a)) - 1
    free = full
    for c in b:
        hit = free & places.get(c, 0)
        free = (free + hit | free - hit) & full
    return len(a) - free.bit_count()


def common_subsequences(left: np.ndarray, right: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """common_subsequence of left[p] and right[q] for arrays of places p, q: names of up to 63 characters a step for all pairs, longer ones by themselves."""
    out = np.zeros(len(p), np.int64)
    if not len(p):
        return out
    n, m = (np.array([len(x) for x in names], np.int64) for names in (left, right))
    short = (n <= 63)[p]
    for i in np.flatnonzero(~short).tolist():
        out[i] = common_subsequence(left[p[i]], right[q[i]])
    known = {c: i for i, c in enumerate(sorted(set().union(*left[np.unique(p)])))}
    # where each character stands in the left names, and the right names' characters; the last number stands for all others
    places = np.zeros((len(left), len(known) + 1), np.uint64)
    for i in np.unique(p[short]).tolist():
        for c, bits in places_of(left[i]).items():
            places[i, known[c]] = bits
    codes = np.full((len(right), int(m.max())), len(known), np.int64)
    for j in np.unique(q).tolist():
        codes[j, : m[j]] = [known.get(c, len(known)) for c in right[j]]
    flat, width = places.ravel(), len(known) + 1
    todo = np.flatnonzero(short)
    for at in range(0, len(todo), 1 << 15):
        part = todo[at : at + (1 << 15)]
        base, mine = p[part] * width, codes[q[part]]
        full = (np.uint64(1) << n[p[part]].astype(np.uint64)) - np.uint64(1)
        free = full.copy()
        for k in range(int(m[q[part]].max())):
            hit = free & flat[base + mine[:, k]]
            free = (free + hit | free - hit) & full
        out[part] = n[p[part]] - np.bitwise_count(free)
    return out


def similarity(a: str, b: str, places: dict[str, int] | None = None) -> float:
    return 200.0 * common_subsequence(a, b, places) / (len(a) + len(b)) if a or b else 100.0


@F.pandas_udf(DoubleType())
def token_sort_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """0 to 100: Indel similarity of names whose white-space tokens are sorted; null if a name is."""
    known: dict[tuple[str, str], float] = {}
    out = []
    for pair in zip(a, b):
        if pair[0] is None or pair[1] is None:
            out.append(None)
            continue
        if pair not in known:
            known[pair] = similarity(*(" ".join(sorted(x.split())) for x in pair))
        out.append(known[pair])
    return pd.Series(out, dtype="float64")


@F.pandas_udf(IntegerType())
def best_ratio(left: pd.Series, right: pd.Series) -> pd.Series:
    """The best Indel similarity over two lists of names, without regard to case, as a whole number."""

    def one(a, b) -> int:
        return max((int(similarity(x.lower(), y.lower()) + 1e-9) for x in (a if a is not None else ()) for y in (b if b is not None else ())), default=0)

    return pd.Series([one(a, b) for a, b in zip(left, right)], dtype="int32")
