"""Hard negatives of anchors and their positives, from score tiles of a two-dimensional block matrix product.

Vectors become whole numbers. Anchors and rows are dealt to blocks, and each block is cut into chunks of DIMS dimensions. A panel, a block's
chunk, goes to every tile of its row or column, where it's multiplied with the panel that meets it there; the partial tiles of all
chunks are added in the shuffle. Two such products run, so that no tile is stored: the first meets only blocks that share labels and keeps each
anchor's best rows of its own label, its positives; the second meets all blocks and keeps, within the window of scores that each positive opens, the
best rows of other labels. Each tile keeps the k best alone, and these are ranked over all tiles.

Blocks hold about ANCHORS anchors or ROWS rows, whatever the sizes of labels: labels share a number of buckets, and a bucket has as many blocks
as its rows need. The driver sees two numbers a bucket.

Rows with a null id, label or vector, or with null or non-finite components, take no part. A vector shorter than the longest counts as followed by zeros.
Rows that repeat an id are candidates each, but one anchor, with the smallest label and then the smallest vector in byte order; an anchor never meets
rows of its own id. Ties go to the smaller id. Scores must stay below 2 to the 56th; products are made in floating point only while these
are exact. A window of a negative score is empty. An empty table, or one without anchors, gives no rows. Other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessarium.llm.common import map_arrow, rows, stored
from tessarium.llm.voronoi import usable

#: Anchors and rows of a block, dimensions of a chunk, and the most buckets of labels.
ANCHORS, ROWS, DIMS, BUCKETS = 256, 4096, 32, 1024
#: Tiles that a task of a shuffle has, about.
TILES = 4
LEAST = np.iinfo(np.int64).min
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def numbers(vectors: DataFrame, scale: int, dims: int) -> DataFrame:
    """id, label, block and v, little-endian 64-bit integers of floor(scale * x), filled up with zeros."""
    schema = pa.schema([("id", pa.int64()), ("label", pa.int64()), ("block", pa.int64()), ("v", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("embedding")
            size = np.diff(column.offsets.to_numpy())
            out = np.zeros((len(size), dims), np.int64)
            out[np.arange(dims)[None, :] < size[:, None]] = np.floor(scale * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)).astype(np.int64)
            yield rows(schema, batch.column("id"), batch.column("label"), batch.column("block"), [r.tobytes() for r in out])

    return map_arrow(vectors.select("id", "label", "block", "embedding"), run, "id long, label long, block long, v binary")


def panels(members: DataFrame, dims: int) -> DataFrame:
    """block, chunk, ids, labels and the panel's numbers; one row a block and chunk, its rows in order of id."""

    def gather(found: pd.DataFrame) -> pd.DataFrame:
        found = found.sort_values(["id", "label", "v"])
        whole = np.frombuffer(b"".join(found["v"]), np.int64).reshape(len(found), dims)
        chunks = range(0, dims, DIMS)
        ids, labels = (found[c].to_numpy(np.int64).tobytes() for c in ("id", "label"))
        return pd.DataFrame({"block": int(found["block"].iloc[0]), "chunk": list(range(len(chunks))), "ids": [ids] * len(chunks), "labels": [labels] * len(chunks), "numbers": [whole[:, a : a + DIMS].tobytes() for a in chunks]})

    return members.groupBy("block").applyInPandas(gather, "block long, chunk int, ids binary, labels binary, numbers binary")


def unpacked(row) -> tuple:
    """(block, chunk), (ids, labels, matrix)."""
    ids, labels = (np.frombuffer(bytes(x), np.int64) for x in row[2:4])
    return (row[0], row[1]), (ids, labels, np.frombuffer(bytes(row[4]), np.int64).reshape(len(ids), -1))


def multiplied(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Exact product of whole numbers, by floating point where that is exact."""
    most = float(np.abs(left).max(initial=0)) * float(np.abs(right).max(initial=0)) * left.shape[1]
    return (left.astype(np.float64) @ right.astype(np.float64).T).astype(np.int64) if most < 2.0**53 else left @ right.T


def tiles(left: RDD, right: RDD, across: dict[int, tuple[int, int]] | tuple[int, int], down: dict[int, tuple[int, int]] | tuple[int, int], n: int) -> RDD:
    """(left block, right block), [scores, what the left panel carries, ids and labels of the right block].

    across: the range of right blocks that a left block meets, one for all or by block; down: the range of left blocks that a right block meets.
    """

    def ranged(blocks, block: int) -> range:
        return range(*(blocks[block] if isinstance(blocks, dict) else blocks))

    rowwise = left.flatMap(lambda x: [((x[0][0], j, x[0][1]), x[1]) for j in ranged(across, x[0][0])])
    columnwise = right.flatMap(lambda x: [((i, x[0][0], x[0][1]), x[1]) for i in ranged(down, x[0][0])])

    def product(x: tuple) -> tuple:
        (i, j, chunk), (a, b) = x
        # what belongs to a whole block goes with its first chunk
        return (i, j), (multiplied(a[2], b[2]), (a, b[:2]) if chunk == 0 else None)

    def added(x: tuple, y: tuple) -> tuple:
        return x[0] + y[0], x[1] or y[1]

    return rowwise.join(columnwise, n).map(product).reduceByKey(added, n).mapValues(lambda x: (x[0], x[1][0], x[1][1]))


def best(scores: np.ndarray, allowed: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the k highest allowed scores of each row, ties to the smaller id; columns are in order of id."""
    held = np.where(allowed, scores, LEAST)
    bar = np.partition(held, -k, 1)[:, -k] if held.shape[1] > k else np.full(len(held), LEAST)
    i, j = np.nonzero((held >= bar[:, None]) & allowed)
    order = np.lexsort((ids[j], -held[i, j], i))
    i, j = i[order], j[order]
    keep = np.arange(len(i)) - np.searchsorted(i, i) < k
    return i[keep], j[keep]


def mine(vectors: DataFrame, anchor: Column, positives: int = 5, negatives: int = 10, window: tuple[int, int] = (30, 90), scale: int = 256) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    vectors: vec_id, label (whole numbers) and embedding. anchor: a condition on these. window: percent of the positive's score that a negative's reaches at
    least and at most.
    """
    spark = vectors.sparkSession
    known = usable(vectors).where(F.col("label").isNotNull())
    known = known.select(F.col("vec_id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), "embedding", F.coalesce(anchor, F.lit(False)).alias("anchor"))
    total, asked, dims = known.agg(F.count(F.lit(1)), F.count_if("anchor"), F.max(F.size("embedding"))).first()
    if not asked:
        return spark.createDataFrame([], RESULT)
    dims = max(dims, 1)
    n_buckets = min(max(asked // ANCHORS, 1), BUCKETS)
    bucket = F.pmod(F.xxhash64("label"), F.lit(n_buckets)).cast("int")
    counts = {r[0]: r[1:] for r in known.groupBy(bucket.alias("b")).agg(F.count(F.lit(1)), F.count_if("anchor")).collect()}
    sizes = np.array([counts.get(b, (0, 0)) for b in range(n_buckets)]).T
    n_right, n_left = -(-sizes[0] // ROWS), -(-sizes[1] // ANCHORS)
    right_at, left_at = (np.concatenate(([0], np.cumsum(n))) for n in (n_right, n_left))

    def dealt(found: DataFrame, at: np.ndarray, n: np.ndarray, salt: Column) -> DataFrame:
        starts, parts = F.lit(at[:-1].tolist()), F.lit(np.maximum(n, 1).tolist())
        return found.withColumn("b", bucket).withColumn("block", F.element_at(starts, F.col("b") + 1) + F.pmod(salt, F.element_at(parts, F.col("b") + 1)))

    one = known.where("anchor").groupBy("id").agg(F.min(F.struct("label", "embedding")).alias("a")).select("id", "a.label", "a.embedding")
    # by the row's number too, so that many rows of one id are spread as well
    right = stored(panels(numbers(dealt(known, right_at, n_right, F.xxhash64("id", F.monotonically_increasing_id())), scale, dims), dims)).rdd.map(unpacked)
    left = stored(panels(numbers(dealt(one, left_at, n_left, F.xxhash64("id")), scale, dims), dims)).rdd.map(unpacked)

    def shared(own: np.ndarray, other: np.ndarray) -> dict[int, tuple[int, int]]:
        """By block, the blocks of its bucket on the other side."""
        return {i: (int(other[b]), int(other[b + 1])) for b in range(n_buckets) for i in range(int(own[b]), int(own[b + 1]))}

    tasks = max(1, -(-int((n_left * n_right).sum()) // TILES))

    def first(tile: tuple) -> Iterator[tuple]:
        (i, _), (scores, (ids, labels, _), (other, other_labels)) = tile
        allowed = (labels[:, None] == other_labels[None, :]) & (ids[:, None] != other[None, :])
        r, c = best(scores, allowed, other, positives)
        yield from zip([i] * len(r), ids[r].tolist(), other[c].tolist(), scores[r, c].tolist())

    found = spark.createDataFrame(tiles(left, right, shared(left_at, right_at), shared(right_at, left_at), tasks).flatMap(first), "block long, anchor_id long, positive_id long, score long", verifySchema=False)
    found = found.selectExpr("*", "row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, positive_id) AS place").where(F.col("place") <= positives)
    # at most as many rows a block as its anchors have positives
    windows = stored(found.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("anchor_id", "place", "positive_id", "score"))).alias("of"))).rdd.map(lambda r: ((r[0], 0), [tuple(x) for x in r[1]]))
    low, high = window

    def opened(x: tuple) -> tuple:
        """A left panel with its block's windows: row, place, positive's id and score."""
        (block, chunk), ((ids, labels, matrix), of) = x
        at = {a: k for k, a in enumerate(ids.tolist())}
        return (block, chunk), (ids, labels, matrix, np.array([(at[a], place, p, s) for a, place, p, s in of or ()], np.int64).reshape(-1, 4))

    with_windows = left.leftOuterJoin(windows, max(1, -(-int(n_left.sum()) // TILES))).map(opened)
    tasks = max(1, -(-int(n_left.sum()) * int(n_right.sum()) // TILES))

    def second(tile: tuple) -> Iterator[tuple]:
        _, (scores, (ids, labels, _, of), (other, other_labels)) = tile
        for place in range(1, positives + 1):
            at, _, positive, own = of[of[:, 1] == place].T
            s = scores[at]
            allowed = (labels[at][:, None] != other_labels[None, :]) & (ids[at][:, None] != other[None, :]) & (100 * s >= low * own[:, None]) & (100 * s <= high * own[:, None])
            r, c = best(s, allowed, other, negatives)
            yield from zip(ids[at[r]].tolist(), [place] * len(r), positive[r].tolist(), own[r].tolist(), other[c].tolist(), s[r, c].tolist())

    mined = tiles(with_windows, right, (0, int(n_right.sum())), (0, int(n_left.sum())), tasks).flatMap(second)
    mined = spark.createDataFrame(mined, "anchor_id long, place int, positive_id long, positive_score long, negative_id long, negative_score long", verifySchema=False)
    ranked = mined.selectExpr("*", "row_number() OVER (PARTITION BY anchor_id, place ORDER BY negative_score DESC, negative_id) AS rank").where(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
