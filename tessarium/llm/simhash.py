"""Near-duplicates by 64-bit SimHash fingerprints and multi-index hashing.

Fingerprints are cut into two to four segments, fewer the more of them there are, so that buckets stay small at any size. If two of four
segments' fingerprints differ in at most 4 bits, they differ in at most 1 bit of the first segment or in none of another; so each fingerprint
enumerates the Hamming balls of these radii, looks them up in the tables of segments, and complete distances verify what is
found. Other limits and numbers of segments get radii by the same rule.

Equal fingerprints are collapsed before the search. Each bucket is searched by streaming its probes past blocks of its table; only links
that join parts not yet joined in that bucket are emitted, so a bucket of g fingerprints gives at most g links, not all pairs. Table
buckets of more than BLOCK entries are split into blocks for several tasks.

A text without words has fingerprint zero, and fewer words than a shingle's make one shingle. Null texts are empty. Repeated rows link to
themselves and change nothing. A null doc_id takes part but is never a component's id, unless all its ids are null. Other columns
don't matter.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessarium.llm.common import checkpointed, map_arrow, rows, stored, with_hot
from tessarium.llm.components import components

#: Entries of a bucket's table compared by one task, and shingles turned into bits at a time.
BLOCK, CHUNK = 4096, 65536


def fingerprint(text: str, words: int) -> int:
    """Bits set in over half of the shingles' hashes, as a signed 64-bit number."""
    parts = text.encode().lower().split()
    if not parts:
        return 0
    whole = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(parts) - words + 1)
    digest = xxhash.xxh64_intdigest
    ends = ends[words - 1 :] if len(parts) > words else ends[-1:]
    hashes = np.array([digest(whole[a:b], 42) for a, b in zip(starts[:n].tolist(), ends.tolist())], np.uint64)
    counts = sum(np.unpackbits(hashes[i : i + CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, np.int64) for i in range(0, n, CHUNK))
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """doc_id, fp (signed)."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield rows(schema, batch.column("doc_id"), [fingerprint(t or "", words) for t in batch.column("text").to_pylist()])

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, fp long")


def segments(limit: int, n: int) -> list[tuple[int, int, int]]:
    """Shift, bits and radius of each segment, for n fingerprints.

    The radii, each plus one, add up to limit + 1, so two fingerprints within the limit always have a segment within its radius. More segments need
    smaller balls but have fuller buckets; of two to four segments those are taken that cost least in probes and comparisons.
    """
    ways = []
    for m in (2, 3, 4):
        bits = [64 // m + (i >= m - 64 % m) for i in range(m)]
        # a radius of -1: not needed
        radii = [(limit - i) // m for i in range(m)]
        out = [(sum(bits[:i]), bits[i], r) for i, r in enumerate(radii) if r >= 0]
        # a comparison takes about a sixty-fourth of the time of a probe's row
        cost = sum(ball_size(bits, radius) * (1 + n / (1 << bits) / 64) for _, bits, radius in out)
        ways.append((cost, out))
    return min(ways)[1]


def ball_size(bits: int, radius: int) -> int:
    return sum(math.comb(bits, r) for r in range(radius + 1))


def balls(bits: int, radius: int) -> list[int]:
    """Differences within a radius."""
    out = {0}
    for _ in range(radius):
        out |= {x ^ (1 << b) for x in out for b in range(bits)}
    return sorted(out)


def probe(key: Column, tag: Column) -> Callable[[Column], Column]:
    return lambda x: F.struct(key.bitwiseXOR(x.cast("long")).bitwiseOR(tag).alias("k"), F.lit(1).alias("role"))


def links(distinct: DataFrame, limit: int, cut: list[tuple[int, int, int]] | None = None) -> DataFrame:
    """Links (a, b) that connect the distinct fingerprints ``fp`` just as all pairs within the limit do."""
    table, probes = [], []
    for i, (shift, bits, radius) in enumerate(cut or segments(limit, distinct.count())):
        key = F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit((1 << bits) - 1))
        tag = F.lit(i << 56)
        table.append(F.struct(key.bitwiseOR(tag).alias("k"), F.lit(0).alias("role")))
        ball = F.array(*(F.lit(x) for x in balls(bits, radius) if x)) if radius else F.array().cast("array<int>")
        probes.append(F.transform(ball, probe(key, tag)))
    entries = distinct.select("fp", F.inline(F.concat(F.array(*table), *probes)))
    sizes = distinct.select(F.inline(F.array(*table))).groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    # entries of buckets with one table entry and no probes go no further than the first shuffle
    sizes = sizes.select("k", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    entries = entries.join(sizes, "k")
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    # a table entry is in its own block's table and probes the blocks after it
    entries = entries.select("fp", "k", "role", own.alias("own"), F.explode(F.sequence(F.when(F.col("role") == 0, own).otherwise(F.lit(0)), F.col("blocks") - 1)).alias("block"))
    entries = entries.select("fp", "k", "block", F.when((F.col("role") == 0) & (F.col("own") == F.col("block")), 0).otherwise(1).cast("byte").alias("role"))
    dealt = entries.repartition("k", "block").sortWithinPartitions("k", "block", "role")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = {"key": None, "table": np.zeros(0, np.uint64), "label": np.zeros(0, np.int64)}

        def bucket(fps: np.ndarray, n_table: int, out: list) -> None:
            """The first n_table extend the current bucket's table; all are compared with the table."""
            state["table"] = np.concatenate((state["table"], fps[:n_table]))
            state["label"] = np.concatenate((state["label"], np.arange(len(state["label"]), len(state["label"]) + n_table)))
            table, label = state["table"], state["label"]
            if not len(table) or len(table) == 1 and len(fps) == n_table:
                return
            for i in range(0, len(fps), 256):
                near = np.bitwise_count(fps[i : i + 256, None] ^ table[None, :]) <= limit
                for j in np.flatnonzero(near.sum(1) > (np.arange(i, i + len(near)) < n_table)):
                    hit = np.flatnonzero(near[j])
                    hit = hit[table[hit] != fps[i + j]]
                    groups, at = np.unique(label[hit], return_index=True)
                    own = label[len(table) - n_table + i + j] if i + j < n_table else -1
                    for g, h in zip(groups, hit[at]):
                        if g != own:
                            out.append((fps[i + j], table[h]))
                    if len(groups):
                        label[np.isin(label, groups if own < 0 else np.append(groups, own))] = groups[0]

        for batch in batches:
            key = np.rec.fromarrays([batch.column("k").to_numpy(), batch.column("block").to_numpy()])
            fps, role = batch.column("fp").to_numpy().view(np.uint64), batch.column("role").to_numpy()
            cuts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)] if len(key) else []
            out: list = []
            for a, b in zip(cuts, cuts[1:]):
                if state["key"] != (k := tuple(key[a])):
                    state |= {"key": k, "table": np.zeros(0, np.uint64), "label": np.zeros(0, np.int64)}
                if b - a > 1 or len(state["table"]):
                    bucket(fps[a:b], int((role[a:b] == 0).sum()), out)
                elif role[a] == 0:
                    state |= {"table": fps[a:b], "label": np.zeros(1, np.int64)}
            pairs = np.array(out, np.uint64).reshape(-1, 2).view(np.int64)
            yield rows(schema, pa.array(pairs[:, 0]), pa.array(pairs[:, 1]))

    return map_arrow(dealt, search, "a long, b long")


def near_duplicates(docs: DataFrame, words: int = 4, limit: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable over links)."""
    fps = checkpointed(fingerprints(docs, words))
    distinct = checkpointed(fps.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")))
    found = components(links(distinct, limit))
    members = distinct.join(found.withColumnRenamed("node", "fp"), "fp")
    roots = members.groupBy("root").agg(F.min("least").alias("component_id"))
    named = members.join(roots, "root").select("fp", "component_id")
    named = distinct.join(named, "fp", "left").select("fp", "n", F.coalesce("component_id", "least").alias("component_id"))
    return with_hot(fps, stored(named), "fp", "n", ("component_id",)).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
