"""The names most similar to each of some texts, by an index of their lengths and letter counts.

Names whose words are sorted become counts of letter classes. The L1 distance of two counts is at most the names' Indel distance, and obeys the
triangle inequality, so names stand in cells around pivots (see cells). Each text first visits the block of its nearest pivot; the k-th best score there
raises the threshold, and with it the text visits only blocks that can hold a better name. Within a block the bound from letter counts orders
the names, and the exact similarity is computed from the best bound down until no bound reaches the k-th best score, for many names at once. Names are
few bytes and much work, so tasks are dealt by number rather than by size. To place a name takes as long as to compare it with some hundred texts, so
fewer texts are sent to all tasks and meet the names in one pass, where they stand.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessarium.functions.fuzzy import places_of, similarity
from tessarium.lineage import checkpointed
from tessarium.operators import cells

#: Letters, digits, space and hyphen count by themselves, all other characters in classes by code point.
OWN = {c: i for i, c in enumerate("abcdefghijklmnopqrstuvwxyz0123456789 -")}
CLASSES = 48
#: Characters of a name of usual length, names that a text is first compared with, and texts that visit a block in one task.
SHORT, FIRST, VISITORS = 128, 64, 512
#: Texts up to which names aren't placed in cells.
SCANNED = 256
#: Classes of characters below this code point, in a table.
KNOWN = np.array([OWN.get(chr(c), len(OWN) + c % (CLASSES - len(OWN))) for c in range(128)])


def words_sorted(text: str) -> str:
    return " ".join(sorted(text.split()))


def letters(texts: list) -> np.ndarray:
    """Counts of letter classes."""
    return counted(*flat([words_sorted(text) for text in texts]), len(texts))


def flat(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, and whose they are."""
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    return points, np.repeat(np.arange(len(texts)), np.fromiter(map(len, texts), np.int64, len(texts)))


def counted(points: np.ndarray, whose: np.ndarray, n: int) -> np.ndarray:
    kind = np.where(points < len(KNOWN), KNOWN[np.minimum(points, len(KNOWN) - 1)], len(OWN) + points % (CLASSES - len(OWN)))
    return np.bincount(whose * CLASSES + kind, minlength=n * CLASSES).reshape(n, CLASSES).astype(np.float64)


def apart(A: np.ndarray, B: np.ndarray) -> np.ndarray:
    """L1 distances, in slices that stay small."""
    out = np.empty((len(A), len(B)))
    for i in range(0, len(A), 64):
        out[i : i + 64] = np.abs(A[i : i + 64, None, :] - B[None, :, :]).sum(2)
    return out


SPACE = cells.Space(letters, apart, lambda X: X.sum(1))


class Held:
    """Names of a block, sorted, with what all texts that visit need: letter counts a class, and codes of the characters of names whose words are sorted."""

    def __init__(self, names: list[str]):
        self.names, self.by_word = names, [words_sorted(b) for b in names]
        points, whose = flat(self.by_word)
        counts = counted(points, whose, len(names))
        self.lengths = counts.sum(1).astype(np.int64)
        self.counts = np.ascontiguousarray(counts.T.astype(np.int32))
        different, codes = np.unique(points, return_inverse=True)
        self.codes = {chr(c): i for i, c in enumerate(different.tolist())}
        # names of usual length have a row of codes, ended by that of no character
        self.short = self.lengths <= SHORT
        self.chars = np.full((int(self.lengths[self.short].max(initial=0)), len(names)), len(self.codes), np.int32)
        place = np.arange(len(points)) - (np.cumsum(self.lengths) - self.lengths)[whose]
        some = self.short[whose]
        self.chars[place[some], whose[some]] = codes[some]

    def scores(self, mine: str, places: dict[str, int], at: np.ndarray) -> np.ndarray:
        """Whole scores of the names at some places with a text whose words are sorted."""
        if len(mine) > 63 or not len(at):
            return np.array([int(similarity(mine, self.by_word[i], places) + 1e-9) for i in at.tolist()], np.int64)
        out = np.zeros(len(at), np.int64)
        usual = self.short[at]
        out[~usual] = [int(similarity(mine, self.by_word[i], places) + 1e-9) for i in at[~usual].tolist()]
        some = at[usual]
        if len(some):
            table = np.zeros(len(self.codes) + 1, np.uint64)
            for c, bits in places.items():
                if c in self.codes:
                    table[self.codes[c]] = bits
            full = np.uint64((1 << len(mine)) - 1)
            free = np.full(len(some), full)
            for chars in self.chars[: int(self.lengths[some].max())]:
                hit = free & table[chars[some]]
                free = (free + hit | free - hit) & full
            total = len(mine) + self.lengths[some]
            out[usual] = np.where(total > 0, 200 * (len(mine) - np.bitwise_count(free).astype(np.int64)) // np.maximum(total, 1), 100)
        return out


def best_of(text: str, counts: np.ndarray, held: Held, k: int, least: float) -> tuple[list[tuple[int, int]], int]:
    """(score, place) of the k best names from a whole score on, ties to the smaller name, which stands first; how many were compared exactly. The bound from
    letter counts orders the names; what may still be among the best is compared at once, more of them at each step."""
    n = int(counts.sum())
    shared = np.zeros(len(held.names), np.int64)
    for c in np.flatnonzero(counts).tolist():
        shared += np.minimum(held.counts[c], int(counts[c]))
    total = n + held.lengths
    mine = words_sorted(text)
    places = places_of(mine)
    left = np.flatnonzero(200 * shared >= least * total)
    bound = np.where(total[left] > 0, 200 * shared[left] // np.maximum(total[left], 1), 100)
    found, at, tried, step = np.zeros(0, np.int64), np.zeros(0, np.int64), 0, max(FIRST, 2 * k)
    while len(left):
        if len(left) > step:
            now = np.argpartition(-bound, step - 1)[:step]
            rest = np.ones(len(left), bool)
            rest[now] = False
        else:
            now, rest = slice(None), np.zeros(len(left), bool)
        some = left[now]
        tried += len(some)
        score = held.scores(mine, places, some)
        ok = score >= least
        found, at = np.concatenate([found, score[ok]]), np.concatenate([at, some[ok]])
        order = np.lexsort((at, -found))[:k]
        found, at = found[order], at[order]
        left, bound, step = left[rest], bound[rest], step * 8
        if len(found) >= k:
            # as good a bound as the k-th score helps a smaller name only
            may = (bound > found[-1]) | (bound == found[-1]) & (left < at[-1])
            left, bound = left[may], bound[may]
    return list(zip(found.tolist(), at.tolist())), tried


def nearest_names(texts: DataFrame, names: DataFrame, k: int, least: float, report: dict | None = None) -> DataFrame:
    """a, b, score: of distinct texts (a) the k most similar distinct names (b) from a whole score on, by Indel similarity of their sorted words; ties to the
    smaller name. Null and empty texts and names match nothing. A report gets the pairs that were compared exactly, and all pairs."""
    spark = texts.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    asked = checkpointed(texts.select("a").where("a <> ''").repartition(tasks, "a").distinct())
    known = names.select("b").where("b <> ''").repartition(tasks, "b").distinct()
    schema = "a string, b string, score int, tried int"
    few = asked.limit(SCANNED + 1).collect()
    if len(few) <= SCANNED:
        both = _scanned([r.a for r in few], known, k, least, schema)
        return _best(both, asked, known, k, report)
    known = checkpointed(known)
    placed, of = cells.celled(known, "b", SPACE, F.xxhash64("b"))
    if of is None:
        return spark.createDataFrame([], schema).drop("tried")
    home = checkpointed(placed.withColumn("_block", cells.own_block(of, F.xxhash64("b"))).select("b", "_block"))

    @F.pandas_udf("array<int>")
    def nearest(a: pd.Series) -> pd.Series:
        """All blocks of the cell whose pivot is nearest."""
        if not len(a):
            return pd.Series([], dtype=object)
        d = np.where(of.size > 0, apart(letters(list(a)), of.pivots), np.inf)
        return pd.Series([b.tolist() for b in of.visits(d == d.min(1, keepdims=True))], dtype=object)

    @F.pandas_udf("array<int>")
    def others(a: pd.Series, bar: pd.Series, seen: pd.Series) -> pd.Series:
        """Blocks that can hold a name of a score from the bar on."""
        if not len(a):
            return pd.Series([], dtype=object)
        X, bar = letters(list(a)), np.maximum(bar.to_numpy(np.float64), 1.0)[:, None]
        n = X.sum(1)[:, None]
        # a partner is not longer than this, nor than the cell's longest
        longest = np.minimum(of.longest[None, :], n * (200 - bar) / bar)
        near = of.within(apart(X, of.pivots), (1 - bar / 100) * (n + longest) + 1e-6)
        return pd.Series([b[~np.isin(b, list(s))].tolist() for b, s in zip(of.visits(near), seen)], dtype=object)

    def solve(x: pd.DataFrame, y: pd.DataFrame, first: bool) -> pd.DataFrame:
        rows: list[tuple] = []
        if len(x) and len(y):
            held = Held(sorted(x["b"]))
            for text, counts, bar in zip(y["a"], letters(list(y["a"])), y["bar"]):
                best, tried = best_of(text, counts, held, k, max(bar, least))
                rows += [(text, held.names[at], score, tried if i == 0 else 0) for i, (score, at) in enumerate(best)] or [(text, None, None, tried)]
        return pd.DataFrame(rows, columns=["a", "b", "score", "tried"]).astype({"score": "Int32", "tried": "Int32"})

    salt = F.xxhash64("a")
    seen = checkpointed(asked.withColumn("seen", nearest("a")))
    start = cells.met(home, seen.select("a", F.explode("seen").alias("_block"), F.lit(float(least)).alias("bar")), solve, schema, salt, visitors_at_once=VISITORS)
    start = checkpointed(start)
    ranked = start.where("b IS NOT NULL").selectExpr("*", "row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS n").where(F.col("n") <= k)
    bars = ranked.where(F.col("n") == k).select("a", F.col("score").cast("double").alias("bar"))
    raised = seen.join(bars, "a", "left").withColumn("bar", F.coalesce("bar", F.lit(float(least)))).repartition(tasks, "a")
    raised = checkpointed(raised.select("a", "bar", others("a", "bar", "seen").alias("_blocks")))
    more = cells.met(home, raised.select("a", "bar", F.explode("_blocks").alias("_block")), solve, schema, salt, visitors_at_once=VISITORS)
    return _best(start.unionByName(more), asked, known, k, report)


def _scanned(asked: list[str], known: DataFrame, k: int, least: float, schema: str) -> DataFrame:
    """Of some texts the k best names of each task, whose k-th score is what later names have to reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, best, tried = letters(asked), [[] for _ in asked], [0] * len(asked)
        for batch in batches:
            held = Held(sorted(batch.column(0).to_pylist()))
            for i, text in enumerate(asked if held.names else ()):
                found, n = best_of(text, counts[i], held, k, max(least, -best[i][-1][0]) if len(best[i]) >= k else least)
                best[i] = sorted([*best[i], *((-score, held.names[at]) for score, at in found)])[:k]
                tried[i] += n
        rows = [(text, *x) for text, found, n in zip(asked, best, tried) for x in [(None, None, n), *((b, -s, 0) for s, b in found)]]
        yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows), (pa.string(), pa.string(), pa.int32(), pa.int32()))] if rows else [pa.array([], kind) for kind in (pa.string(), pa.string(), pa.int32(), pa.int32())], names=["a", "b", "score", "tried"])

    return known.mapInArrow(run, schema)


def _best(both: DataFrame, asked: DataFrame, known: DataFrame, k: int, report: dict | None) -> DataFrame:
    if report is not None:
        both = checkpointed(both)
        report["tried"] = both.agg(F.sum("tried")).first()[0] or 0
        report["all"] = asked.count() * known.count()
    return both.where("b IS NOT NULL").selectExpr("a", "b", "score", "row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS n").where(F.col("n") <= k).drop("n")
