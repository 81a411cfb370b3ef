"""Hashes of words and of word windows, made in whole arrays."""

from __future__ import annotations

import numpy as np
import xxhash

BASE = 0x9E3779B97F4A7C15
#: Bytes hashed at a time; words of more bytes than LONG are hashed by XXH3, as sums modulo a power of two are weak for long patterns.
CHUNK, LONG = 1 << 20, 256
SPACE = np.zeros(256, bool)
SPACE[list(b" \t\n\v\f\r")] = True
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE to the 0th .. nth and to the minus 0th .. minus nth, modulo 2 to the 64th."""
    if len(_powers[0]) <= n:
        size = max(2 * len(_powers[0]), n + 1)
        for i, b in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            steps = np.full(size, b, np.uint64)
            steps[0] = 1
            _powers[i] = np.cumprod(steps)
    return _powers[0], _powers[1]


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads bits."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


class Spans:
    """64-bit hashes of any spans of a word sequence, from sums of prefixes."""

    def __init__(self, hashes: np.ndarray):
        n = len(hashes)
        up, self.down = powers(n)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(hashes * up[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.down[start])

    def windows(self, length: int) -> np.ndarray:
        n = len(self.sums) - length
        return mixed((self.sums[length:] - self.sums[:n]) * self.down[:n])


def first_smallest(values: np.ndarray, width: int) -> np.ndarray:
    """For each window of some values, the place of its smallest one, the leftmost of equals."""
    at = np.arange(len(values))
    done = 1
    while done < width:
        step = min(done, width - done)
        left, right = at[:-step], at[step:]
        at = np.where(values[left] <= values[right], left, right)
        done += step
    return at


def word_hashes(text: bytes) -> np.ndarray:
    """A hash of each word of a text, from sums of prefixes over its bytes: no object is made for a word."""
    raw = np.frombuffer(text, np.uint8)
    space = np.ones(len(raw) + 2, bool)
    space[1:-1] = SPACE[raw]
    edges = np.flatnonzero(space[1:] != space[:-1])
    starts, ends = edges[::2], edges[1::2]
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + CHUNK, "right")))
        if ends[j - 1] - starts[i] <= CHUNK:
            # as 1 to 256, so that every byte counts
            spans = Spans(raw[starts[i] : ends[j - 1]].astype(np.uint64) + np.uint64(1))
            out[i:j] = spans.of(starts[i:j] - starts[i], ends[i:j] - starts[i])
        i = j
    for i in np.flatnonzero(ends - starts > LONG).tolist():
        out[i] = xxhash.xxh3_64_intdigest(text[starts[i] : ends[i]])
    return out
