"""Near copies by the Jaccard similarity of their sets of word shingles: SimHash and MinHash find groups of candidates, exact comparison the links.

Each text gets a SimHash fingerprint, searched as op4's are, and texts whose fingerprints differ in few bits are candidates. That limit is too narrow for
most pairs near the similarity, so each text also gets BANDS keys of DEPTH minhashes, and texts that share a key are candidates too. All pairs within a
group of candidates are then compared by their whole sets, in blocks, so only links at or above the similarity count, and a group's leader need not be near
its members. A pair at a similarity of s shares no key with a chance of (1 - s^DEPTH)^BANDS: 6 in 100,000 at 0.8, less above.

Texts of equal sets are one node. Of the links of a block pair only a spanning forest is emitted, so a group of g texts gives few links. Words
are split and lower-cased as for SimHash; fewer words than a shingle's make one shingle, texts without words are equal, null texts are empty.

Sets and rows are told apart by hashes of 128 bits, so that no two unrelated texts pass for one. Rows go by a hash of their columns, not by doc_id: rows of equal or null doc_id each belong to their own text's group. Of a group
the row of smallest doc_id stays (null after all others, then by hash); rows equal in all columns are one row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessarium.llm import simhash
from tessarium.llm.common import checkpointed, map_arrow, rows, stored
from tessarium.llm.components import components
from tessarium.llm.hashing import Spans, mixed, word_hashes

BANDS, DEPTH = 32, 6
#: Texts of a block, shingles of a matrix of texts by shingles, and shingles hashed at a time.
BLOCK, WIDTH, CHUNK = 512, 4096, 2048
#: Sets the second sum of a node's hash apart from the first.
TURN = np.uint64(0xA0761D6478BD642F)
_seeds = np.random.default_rng(42).integers(0, 1 << 63, (3, BANDS * DEPTH, 1), np.int64).view(np.uint64)
FLIP, ODD, MIX = _seeds[0], _seeds[1] << np.uint64(1) | np.uint64(1), _seeds[2, :, 0] << np.uint64(1) | np.uint64(1)


def shingles(text: str, words: int) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles."""
    hashes = word_hashes(text.encode().lower())
    if not len(hashes):
        return hashes
    spans = Spans(hashes)
    return np.unique(spans.windows(words) if len(hashes) > words else spans.of(np.array([0]), np.array([len(hashes)])))


def node_of(found: np.ndarray) -> bytes:
    """A hash of a whole set, of 128 bits: two sums over its members, mixed in two ways."""
    n = np.array([len(found)], np.uint64)
    sums = (mixed(found).sum(dtype=np.uint64, keepdims=True), mixed(found ^ TURN).sum(dtype=np.uint64, keepdims=True))
    return b"".join(mixed(mixed(x) * np.uint64(0x9E3779B97F4A7C15) + n).tobytes() for x in sums)


def band_keys(found: np.ndarray) -> np.ndarray:
    least = np.full(BANDS * DEPTH, np.iinfo(np.uint64).max)
    for i in range(0, len(found), CHUNK):
        np.minimum(least, ((found[None, i : i + CHUNK] ^ FLIP) * ODD).min(1), out=least)
    # MIX differs from band to band, so their keys do too
    return mixed((mixed(least) * MIX).reshape(BANDS, DEPTH).sum(1, dtype=np.uint64)).view(np.int64)


def forest(sets: list[np.ndarray], left: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Places of sets, linked just as all similar pairs link them; with both sides present only pairs across them count."""
    sizes = np.array([len(s) for s in sets], np.int64)
    token, at = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    common = np.bincount(at, minlength=len(token)) > 1
    number = np.cumsum(common) - 1
    shared = common[at]
    at, owner = number[at[shared]], owner[shared]
    order = np.argsort(at, kind="stable")
    at, owner = at[order], owner[order]
    both = np.zeros((len(sets), len(sets)), np.float64)
    for a in range(0, int(common.sum()), WIDTH):
        i, j = np.searchsorted(at, (a, a + WIDTH))
        matrix = np.zeros((len(sets), WIDTH), np.float32)
        matrix[owner[i:j], at[i:j] - a] = 1
        both += matrix @ matrix.T
    near = both >= similarity * (sizes[:, None] + sizes[None, :] - both) - 1e-9
    if not left.all():
        near &= left[:, None] != left[None, :]
    out, seen = [], np.zeros(len(sets), bool)
    for i in range(len(sets)):
        if not seen[i]:
            seen[i], todo = True, [i]
            while todo:
                j = todo.pop()
                new = np.flatnonzero(near[j] & ~seen)
                seen[new] = True
                out += [(j, k) for k in new.tolist()]
                todo += new.tolist()
    return out


def candidates(nodes: DataFrame) -> DataFrame:
    """Links (a, b) from the first node of each key to its others."""
    dealt = nodes.select("node", F.explode("keys").alias("key")).repartition("key").sortWithinPartitions("key", "node")
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, first = None, b""
        for batch in batches:
            if not batch.num_rows:
                continue
            key, node = batch.column("key").to_numpy(), batch.column("node").to_numpy(zero_copy_only=False)
            starts = np.concatenate(([True], key[1:] != key[:-1]))
            leader = node[np.maximum.accumulate(np.where(starts, np.arange(len(key)), 0))].copy()
            if last == key[0]:
                leader[: np.searchsorted(key, key[0], "right")] = first
            last, first = key[-1], leader[-1]
            other = leader != node
            yield rows(schema, pa.array(leader[other], pa.binary()), pa.array(node[other], pa.binary()))

    return map_arrow(dealt, run, "a binary, b binary")


def fingerprint_candidates(nodes: DataFrame, limit: int) -> DataFrame:
    """Links (a, b) that connect nodes (node, fp) just as all pairs of fingerprints within the limit do."""
    firsts = checkpointed(nodes.groupBy("fp").agg(F.min("node").alias("first")))
    equal = nodes.join(firsts, "fp").where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    near = simhash.links(firsts.select("fp"), limit)
    for side in "ab":
        near = near.join(firsts.select(F.col("fp").alias(side), F.col("first").alias(f"node_{side}")), side)
    return equal.unionByName(near.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")))


def links(members: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) of nodes (root, node, found) that connect them as all similar pairs of one root do."""
    blocks = members.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    dealt = members.join(blocks, "root").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("x", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("root", F.least("own", "x").alias("i"), F.greatest("own", "x").alias("j"), (F.col("own") <= F.col("x")).alias("left"), "node", "found")
    dealt = dealt.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j")
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, nodes, left, sets = None, [], [], []

        def solved() -> pa.RecordBatch:
            pairs = forest(sets, np.array(left), similarity) if len(sets) > 1 else []
            return rows(schema, [nodes[i] for i, _ in pairs], [nodes[j] for _, j in pairs])

        for batch in batches:
            keys = zip(*(batch.column(c).to_pylist() for c in ("root", "i", "j", "node", "left")))
            for k, (root, i, j, node, side) in enumerate(keys):
                if group != (root, i, j):
                    if len(sets) > 1:
                        yield solved()
                    group, nodes, left, sets = (root, i, j), [], [], []
                nodes.append(node)
                left.append(side)
                sets.append(np.frombuffer(batch.column("found")[k].as_py(), np.uint64))
        if len(sets) > 1:
            yield solved()

    return map_arrow(dealt, run, "a binary, b binary")


def first_rows(docs: DataFrame, words: int = 5, similarity: float = 0.8, limit: int = 4) -> DataFrame:
    """Of each group of near copies one row, unchanged; limit: bits in which candidates' fingerprints differ at most."""
    half = lambda *more: F.lpad(F.hex(F.xxhash64(*more, *docs.columns)), 16, "0")
    docs = docs.withColumn("_row", F.unhex(F.concat(half(), half(F.lit(1)))))
    signed = pa.schema([("doc_id", pa.int64()), ("row", pa.binary()), ("node", pa.binary()), ("fp", pa.int64()), ("keys", pa.list_(pa.int64()))])

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, fps, keys = [], [], []
            for text in batch.column("text").to_pylist():
                found = shingles(text or "", words)
                nodes.append(node_of(found))
                fps.append(simhash.fingerprint(text or "", words))
                keys.append(band_keys(found))
            yield rows(signed, batch.column("doc_id"), batch.column("_row"), nodes, pa.array(fps, pa.int64()), pa.array(keys, signed.field("keys").type))

    fps = stored(map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "_row", "text"), sign, "doc_id long, row binary, node binary, fp long, keys array<long>"))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "row")).alias("least")
    nodes = checkpointed(fps.groupBy("node").agg(least))
    met = candidates(fps.select("node", "keys").dropDuplicates(["node"])).unionByName(fingerprint_candidates(fps.select("node", "fp").distinct(), limit))
    groups = components(met)
    chosen = groups.join(nodes, "node").select(F.col("least.row").alias("_chosen"), "node", "root")
    held = pa.schema([("root", pa.binary()), ("node", pa.binary()), ("found", pa.binary())])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield rows(held, batch.column("root"), batch.column("node"), [shingles(t or "", words).tobytes() for t in batch.column("text").to_pylist()])

    # the right sides have short rows; hashed, they spare sorting the texts
    texts = docs.select("_row", "text").join(chosen.hint("shuffle_hash"), F.col("_row") == F.col("_chosen")).select("root", "node", "text")
    members = stored(map_arrow(texts, sets, "root binary, node binary, found binary").dropDuplicates(["node"]))
    found = components(links(members, similarity))
    stay = nodes.join(found, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("least").alias("least")).select(F.col("least.row").alias("_chosen"))
    return docs.join(stay.hint("shuffle_hash"), F.col("_row") == F.col("_chosen"), "left_semi").dropDuplicates(["_row"]).drop("_row")
