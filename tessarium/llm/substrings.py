"""Removal of word windows that start earlier in the corpus, by level-wise doubling.

Level 1 looks at windows of a quarter of the full length. Of each full window only one of them is used, the one of smallest hash in it; equal
windows agree on it, so none is missed, and far fewer hashes are shuffled. Full windows whose quarter occurs once drop out.
Level 2 extends the survivors to twice the length: again one half-length window stands for each surviving full window. Neighbouring
full windows with the same half form a run; a run whose words equal an earlier document's run is repeated as a whole, and a
half that occurs in one run alone drops out. Level 3 extends what survives in several different runs to the full length: these
windows are hashed (128 bits) and counted one by one. Longer levels can't change which words full windows cover, so the doubling ends there.

Counting is pre-aggregated by key before the shuffle, and the flags come back by joins that Spark can split when a key is hot.
A document's own repeats are found locally, so each key appears once per document, and only the smallest doc_id is gathered.

Null and empty texts have no words. Rows with the same doc_id count as one document each: they do not remove each other's words.
A null doc_id orders after all others. Documents shorter than a window stay whole. Other columns don't matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessarium.llm.common import map_arrow, rows, same, stored
from tessarium.llm.hashing import Spans, first_smallest, mixed, word_hashes

QUARTERS = pa.schema([("doc_id", pa.int64()), ("quarter", pa.int64()), ("n", pa.int32())])
RUNS = pa.schema([("doc_id", pa.int64()), ("version", pa.int32()), ("span", pa.int64()), ("half", pa.int64()), ("run", pa.int64())])
WINDOWS = pa.schema([("doc_id", pa.int64()), ("version", pa.int32()), ("first", pa.int32()), ("a", pa.int64()), ("b", pa.int64())])


def smallest(spans: Spans, window: int, part: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of a part's length, and for each full window the place of its smallest one."""
    hashes = spans.windows(part)
    return hashes, first_smallest(hashes, window - part + 1)


def shortened(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(16)).view(np.int64)


def quarters_of(words: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Level 1: of a text's hashed words, distinct hashes that stand for full windows, and 1 or 2 if one stands at several places."""
    if len(words) < window:
        return np.zeros(0, np.int64), np.zeros(0, np.int32)
    hashes, at = smallest(Spans(words), window, max(1, window // 4))
    # 48 bits: collisions only let a window go on to the next level, and shorter keys make smaller shuffles
    found, n = np.unique(shortened(hashes[np.unique(at)]), return_counts=True)
    return found, np.minimum(n, 2).astype(np.int32)


def runs_of(words: np.ndarray, window: int, repeated: np.ndarray) -> tuple[np.ndarray, ...]:
    """Level 2: of windows whose quarter is repeated, first and last window of each run, its half window's hash, its words' hash."""
    if len(words) < window or not len(repeated):
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    spans = Spans(words)
    quarters, at = smallest(spans, window, max(1, window // 4))
    alive = np.isin(shortened(quarters)[at], repeated)
    halves, at = smallest(spans, window, max(1, window // 2))
    first = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (alive[1:] != alive[:-1]))))
    last = np.append(first[1:], len(at)) - 1
    first, last = first[alive[first]], last[alive[first]]
    where = at[first]
    run = mixed(spans.of(first, last + window) + (where - first).astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D) + (last - first).astype(np.uint64))
    return first, last, halves[where].view(np.int64), run.view(np.int64)


def new_ones(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Places of the first of each distinct pair, in order."""
    order = np.lexsort((b, a))  # stable: of equal pairs the first comes first
    x, y = a[order], b[order]
    new = np.ones(len(order), bool)
    new[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
    return np.sort(order[new])


def windows_of(words: np.ndarray, starts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    a, b = (Spans(x).of(starts, starts + window) for x in (words, mixed(words + np.uint64(0x632BE59BD9B4E019))))
    return a.view(np.int64), b.view(np.int64)


def ranges(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """All the numbers of some ranges, sorted and distinct."""
    if not len(first):
        return np.zeros(0, np.int64)
    return np.unique(np.concatenate([np.arange(a, b + 1) for a, b in zip(first, last)]))


def cut(docs: DataFrame, window: int = 20, texts: bool = False, carried: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for each row; with texts=True also kept_text.

    kept_text is the text itself if nothing goes, else the kept words joined by single spaces (null stays null). Carried columns, all
    strings, stay beside their row.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.hash("text").alias("version"), "text", *carried)

    def joined(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
        # the right side has one small row a document; hashed, it spares sorting the texts
        right = right.withColumnRenamed("doc_id", "doc_id_").hint("shuffle_hash")
        return left.join(right, same(left["doc_id"], right["doc_id_"]), how).drop("doc_id_")

    def quarters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [quarters_of(word_hashes((t or "").encode()), window) for t in batch.column("text").to_pylist()]
            if found:
                doc = batch.column("doc_id").take(pa.array(np.repeat(np.arange(len(found)), [len(f[0]) for f in found])))
                yield rows(QUARTERS, doc, np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]))

    level1 = stored(map_arrow(docs, quarters, "doc_id long, quarter long, n int"))
    per_quarter = level1.groupBy("quarter").agg(F.sum("n").alias("total")).where("total > 1").select("quarter")
    survivors = level1.select("doc_id", "quarter").join(per_quarter, "quarter").groupBy("doc_id").agg(F.collect_list("quarter").alias("quarters"))
    docs = joined(docs, survivors, "left")

    def of(batch: pa.RecordBatch, name: str, i: int) -> np.ndarray:
        value = batch.column(name)[i].values
        return value.to_numpy() if value is not None else np.zeros(0, np.int64)

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, counts = [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                first, last, h, r = runs_of(word_hashes((text or "").encode()), window, of(batch, "quarters", i))
                new = new_ones(h, r)
                # first and last in one number make shorter rows
                found.append((first[new] | (last[new] - first[new]) << 32, h[new], r[new]))
                counts.append(len(new))
            if counts:
                keys = [batch.column(c).take(pa.array(np.repeat(np.arange(len(counts)), counts))) for c in ("doc_id", "version")]
                yield rows(RUNS, *keys, *(pa.array(np.concatenate(x), f.type) for x, f in zip(zip(*found), list(RUNS)[2:])))

    level2 = map_arrow(docs.where("quarters IS NOT NULL"), runs, "doc_id long, version int, span long, half long, run long")
    # never null; said here, so that Spark infers no other filters below the joins and shuffles per_run once for both of its uses
    level2 = level2.where("half IS NOT NULL AND run IS NOT NULL")
    per_run = level2.groupBy("half", "run").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n"))
    # uses all columns of per_run, so that Spark shuffles it once for both
    several = per_run.groupBy("half").agg(F.count(F.lit(1)).alias("n_runs"), F.max("n").alias("most"), F.max(F.coalesce("least", F.lit(0))).alias("lowest"))
    several = several.where(f"n_runs > 1 AND most > 0 AND lowest + 0 >= {-(1 << 63) + 1}").select("half", "n_runs")
    per_run = per_run.join(several, "half", "left").where("n > 1 OR n_runs IS NOT NULL").select("half", "run", "least", F.col("n_runs").isNotNull().alias("several"))
    later = F.coalesce(F.col("doc_id") > F.col("least"), F.col("least").isNotNull())
    flagged = level2.join(per_run, ["half", "run"]).select("doc_id", "version", "span", later.alias("repeated"), "several").where("repeated OR several")
    flagged = flagged.groupBy("doc_id").agg(F.collect_list(F.struct("version", "span", "repeated")).alias("runs"))

    def candidates(batch: pa.RecordBatch, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Of row i: first and last of its repeated runs, and the windows that level 3 has to look at."""
        spans = batch.column("runs")[i].values
        if spans is None or not len(spans):
            return np.zeros((0, 2), np.int64), np.zeros(0, np.int64)
        mine = spans.field("version").to_numpy() == batch.column("version")[i].as_py()
        span = spans.field("span").to_numpy()
        first = span & 0xFFFFFFFF
        both = np.stack([first, first + (span >> 32)], 1)
        again = spans.field("repeated").to_numpy(zero_copy_only=False)
        repeated, open_ = both[mine & again].astype(np.int64), both[mine & ~again].astype(np.int64)
        return repeated, ranges(open_[:, 0], open_[:, 1])

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [], [], []
            counts = []
            for i, text in enumerate(batch.column("text").to_pylist()):
                starts = candidates(batch, i)[1]
                if len(starts):
                    a, b = windows_of(word_hashes(text.encode()), starts, window)
                    new = new_ones(a, b)
                    for x, y in zip(out, (starts[new], a[new], b[new])):
                        x.append(y)
                    counts.append(len(new))
                else:
                    counts.append(0)
            if any(counts):
                keys = [batch.column(c).take(pa.array(np.repeat(np.arange(len(counts)), counts))) for c in ("doc_id", "version")]
                yield rows(WINDOWS, *keys, *(pa.array(np.concatenate(x), f.type) for x, f in zip(out, list(WINDOWS)[2:])))

    open_runs = flagged.where(F.exists("runs", lambda r: ~r["repeated"]))
    level3 = map_arrow(joined(docs, open_runs, "inner"), windows, "doc_id long, version int, first int, a long, b long")
    per_window = level3.groupBy("a", "b").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    again = level3.join(per_window, ["a", "b"]).where(later).groupBy("doc_id").agg(F.collect_list(F.struct("version", "first")).alias("windows"))

    fields = [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())] + [("kept_text", pa.string())] * texts + [(c, pa.string()) for c in carried]
    schema = pa.schema(fields)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, gone, digest, left = [], [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                raw = (text or "").encode()
                words, quarters = raw.split(), of(batch, "quarters", i)
                hashed = word_hashes(raw) if len(quarters) else np.zeros(0, np.uint64)
                first, last, h, r = runs_of(hashed, window, quarters)
                removed = 0
                if len(first):
                    steps = np.zeros(len(words) + 1, np.int64)
                    old = np.ones(len(first), bool)
                    old[new_ones(h, r)] = False
                    repeated, starts = candidates(batch, i)
                    own = starts[:0]
                    if len(starts):
                        inside = np.ones(len(starts), bool)
                        inside[new_ones(*windows_of(hashed, starts, window))] = False
                        own = starts[inside]
                    listed = batch.column("windows")[i].values
                    if listed is None:
                        single = own
                    else:
                        mine = listed.field("version").to_numpy() == batch.column("version")[i].as_py()
                        single = np.concatenate((own, listed.field("first").to_numpy()[mine].astype(np.int64)))
                    for a, b in ((first[old], last[old]), (repeated[:, 0], repeated[:, 1]), (single, single)):
                        np.add.at(steps, a, 1)
                        np.add.at(steps, b + window, -1)
                    stay = np.cumsum(steps[:-1]) == 0
                    removed = len(words) - int(stay.sum())
                rest = b" ".join(compress(words, stay.tolist()) if removed else words)
                n.append(len(words))
                gone.append(removed)
                digest.append(hashlib.sha256(rest).hexdigest())
                left.append(rest.decode() if removed else text)
            yield rows(schema, batch.column("doc_id"), n, gone, digest, *([left] if texts else []), *(batch.column(c) for c in carried))

    return map_arrow(joined(joined(docs, flagged, "left"), again, "left"), kept, "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * texts + "".join(f", {c} string" for c in carried))
