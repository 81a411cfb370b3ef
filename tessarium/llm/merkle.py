"""A Merkle manifest of documents, built and verified by supersteps over a table of vertices.

Leaves are digests of whole rows. Each source has a tree in which every ARITY consecutive nodes become one, and the sources' roots form another one above
them. Vertices are dealt out in blocks of consecutive nodes, as many as stand below one node some levels further up. In a superstep upward each node
sends its digest to its block; parents whose children are complete hash them and forward the digest, within the block until one node is left, which
then sends it to the next block. A block that is its whole tree ends at the tree's root. Supersteps downward send each block the siblings on
its top node's way to the root, and each node in it puts its own siblings before them. Leaves fold their path, so that a changed row shows without any
other row being read.

Rows are numbered within their source by a sort over ranges, so that a source which holds most rows is spread over tasks; the driver sees one summary of
constant size a task. Every superstep upward is written below the checkpoint folder, and downward all but the last.

Null fields are "-", which no other value gives. Null sources come first, and so do null ids within a source; rows of equal source and id are ordered
by their digest, and rows equal in all fields are leaves each. An empty table gives no rows. Other columns don't matter. No row is changed where its
id is null.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

from pyspark import RDD
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessarium.llm.common import checkpointed, shared_folder, stored

ARITY, SIZE = 3, 32
#: Levels that a superstep climbs.
HEIGHT = 4
#: Nodes that a task of a superstep has, about.
NODES = 16384
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
RESULT = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def digest(fields: list[Column]) -> Column:
    """SHA-256 over fields, each with its length in bytes; binary."""
    parts = [F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-")) for s in (f.cast("string") for f in fields)]
    return F.unhex(F.sha2(F.concat(*parts), 256))


def hashed(digests: bytes) -> bytes:
    """Digest of digests, which count as hexadecimal text."""
    return hashlib.sha256(digests.hex().encode()).digest()


def supersteps(nodes: int, block: int) -> int:
    n = 1
    while nodes >= block:
        nodes, n = -(-nodes // block), n + 1
    return n


def tasks(nodes: int, block: int, step: int) -> int:
    return max(1, -(-nodes // block**step // NODES))


def kept(rdd: RDD, spark: SparkSession) -> RDD:
    """Written below the shared folder and read again."""
    path = f"{shared_folder(spark)}/merkle-{uuid.uuid4().hex}"
    rdd.saveAsPickleFile(path, 256)
    return spark.sparkContext.pickleFile(path)


def numbered(ordered: DataFrame) -> tuple[RDD, int, int, int]:
    """((tree, number), (id, leaf, other)) of the rows of an ordered and checkpointed table (key, id, leaf, other); trees, rows of the largest tree, rows.

    As the table is ordered by tree, only the first tree of a task can have begun in another one.
    """

    def summary(task: int, found: Iterator) -> Iterator[tuple]:
        first = last = None
        trees = n_first = n_last = most = total = 0
        for total, row in enumerate(found, 1):
            if not trees or row[0] != last:
                if trees == 1:
                    n_first = n_last
                most, n_last = max(most, n_last), 0
                first, last, trees = (row[0], row[0], 1) if not trees else (first, row[0], trees + 1)
            n_last += 1
        if trees:
            yield task, trees, first, n_first if trees > 1 else n_last, last, n_last, most, total

    starts: dict[int, tuple[int, int]] = {}
    tree, key, size, largest, total = -1, None, 0, 0, 0
    rows = ordered.rdd
    for task, trees, first, n_first, last, n_last, most, n in sorted(rows.mapPartitionsWithIndex(summary).collect()):
        starts[task] = (tree, size) if tree >= 0 and first == key else (tree + 1, 0)
        n_first += starts[task][1]
        tree, key, size = starts[task][0] + trees - 1, last, n_first if trees == 1 else n_last
        largest, total = max(largest, most, n_first, n_last), total + n

    def number(task: int, found: Iterator) -> Iterator[tuple]:
        tree, at = starts.get(task, (0, 0))
        last, begun = None, False
        for k, i, leaf, other in found:
            if begun and k != last:
                tree, at = tree + 1, 0
            last, begun = k, True
            yield (tree, at), (i, bytes(leaf), bytes(other))
            at += 1

    return rows.mapPartitionsWithIndex(number), tree + 1, largest, total


def whole(number: int, digests: bytes, height: int) -> bool:
    """Whether a block of some nodes is its whole tree: only a last block isn't full."""
    return number == 0 and len(digests) < SIZE * ARITY**height


def climbed(number: int, digests: bytes, height: int) -> list[bytes]:
    """The levels of a block, from its nodes to its top node."""
    out, all_ = [digests], whole(number, digests, height)
    while len(out[-1]) > SIZE if all_ else len(out) <= height:
        out.append(b"".join(hashed(out[-1][i : i + ARITY * SIZE]) for i in range(0, len(out[-1]), ARITY * SIZE)))
    return out


def rise(nodes: RDD, largest: int, total: int, height: int, spark: SparkSession) -> tuple[list[RDD], RDD]:
    """The blocks ((tree, number), digests) of each superstep, and the roots (tree, (superstep, digest)), of nodes ((tree, number), digest)."""
    block, blocks, roots = ARITY**height, [], []
    for step in range(supersteps(largest, block)):
        messages = nodes.map(lambda x: ((x[0][0], x[0][1] // block), (x[0][1] % block, x[1])))
        blocks.append(kept(messages.groupByKey(tasks(total, block, step)).mapValues(lambda got: b"".join(d for _, d in sorted(got))), spark))
        roots.append(blocks[-1].filter(lambda x: whole(x[0][1], x[1], height)).map(lambda x, step=step: (x[0][0], (step, climbed(x[0][1], x[1], height)[-1]))))
        nodes = blocks[-1].filter(lambda x: not whole(x[0][1], x[1], height)).map(lambda x: (x[0], climbed(x[0][1], x[1], height)[-1]))
    return blocks, spark.sparkContext.union(roots)


def step_of(place: int, run: bytes) -> bytes:
    """One level of a path: the place and the number of nodes in one byte, then the other nodes' digests."""
    return bytes([place * (ARITY + 1) + len(run) // SIZE]) + run[: SIZE * place] + run[SIZE * place + SIZE :]


def path_within(levels: list[bytes], place: int) -> bytes:
    """The way of one of a block's nodes to its top node."""
    out = []
    for level in levels[:-1]:
        run = place // ARITY * ARITY * SIZE
        out.append(step_of(place % ARITY, level[run : run + ARITY * SIZE]))
        place //= ARITY
    return b"".join(out)


def below(height: int) -> Callable[[tuple], Iterator[tuple]]:
    """Messages of one block to the nodes in it: ((tree, number), (root, path))."""

    def sent(block: tuple) -> Iterator[tuple]:
        (tree, number), (nodes, came) = block
        for digests in nodes:
            levels = climbed(number, digests, height)
            for root, path in came:
                for place in range(len(digests) // SIZE):
                    yield (tree, ARITY**height * number + place), (root, path_within(levels, place) + path)

    return sent


def descend(blocks: list[RDD], starts: RDD, total: int, height: int, spark: SparkSession) -> RDD:
    """((tree, block's number), (root, path)) for the blocks of leaves; starts (tree, (superstep, root, path)) are the trees' roots with the path above them."""
    came = None
    for step in reversed(range(len(blocks))):
        begun = starts.filter(lambda x, step=step: x[1][0] == step).map(lambda x: ((x[0], 0), x[1][1:]))
        came = begun if came is None else came.union(begun)
        if step:
            came = blocks[step].cogroup(came, tasks(total, ARITY**height, step)).flatMap(below(height))
            came = kept(came, spark) if step > 1 else came
    return came


def fold(leaf: bytes, path: bytes) -> bytes:
    at = 0
    while at < len(path):
        place, nodes = divmod(path[at], ARITY + 1)
        end = at + 1 + SIZE * (nodes - 1)
        left = at + 1 + SIZE * place
        leaf, at = hashed(path[at + 1 : left] + leaf + path[left:end]), end
    return leaf


def siblings(path: bytes) -> bytes:
    out, at = [], 0
    while at < len(path):
        end = at + 1 + SIZE * (path[at] % (ARITY + 1) - 1)
        out.append(path[at + 1 : end])
        at = end
    return b"".join(out)


def manifest(docs: DataFrame, changed: Column, height: int = HEIGHT) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256 of every row as it is, folded_root and verified of the row with another text.

    changed: the text that a row has when it's verified.
    """
    spark, block = docs.sparkSession, ARITY**height
    fields = [F.col(f) for f in FIELDS]
    leaf = digest(fields)
    other = F.when(F.col("text").eqNullSafe(changed), leaf).otherwise(digest([*fields[:-1], changed]))
    leaves = stored(docs.select("source", F.col("doc_id").cast("long").alias("doc_id"), leaf.alias("leaf"), other.alias("other")))
    # the number spreads rows that are equal in all fields
    order, tie = ("source", "doc_id", "leaf"), F.xxhash64(F.monotonically_increasing_id())
    ordered = leaves.repartitionByRange(*order, tie).sortWithinPartitions(*order)
    key = F.coalesce(F.sha2("source", 256), F.lit(""))
    vertices, trees, largest, total = numbered(checkpointed(ordered.select(key.alias("key"), "doc_id", "leaf", "other")))
    if not total:
        return spark.createDataFrame([], RESULT)
    blocks, subroots = rise(vertices.mapValues(lambda x: x[1]), largest, total, height, spark)
    subroots = kept(subroots, spark)
    top, above = rise(subroots.map(lambda x: ((0, x[0]), x[1][1])), trees, trees, height, spark)
    ((_, (last, root)),) = above.collect()
    came = descend(top, spark.sparkContext.parallelize([(0, (last, b"", b""))], 1), trees, height, spark)
    paths = top[0].cogroup(came, tasks(trees, block, 0)).flatMap(below(height)).map(lambda x: (x[0][1], x[1][1]))
    starts = kept(subroots.join(paths, tasks(trees, block, 0)).mapValues(lambda x: (*x[0], x[1])), spark)
    came = descend(blocks, starts, total, height, spark)

    def proved(found: tuple) -> Iterator[tuple]:
        (_, number), (leaves, came) = found
        leaves = sorted(leaves, key=lambda x: x[0])
        levels = climbed(number, b"".join(x[2] for x in leaves), height)
        for subroot, path in came:
            for place, doc, leaf, other in leaves:
                own = path_within(levels, place) + path
                folded = fold(other, own)
                yield doc, leaf.hex(), subroot.hex(), root.hex(), hashed(siblings(own)).hex(), folded.hex(), folded == root

    by_block = vertices.map(lambda x: ((x[0][0], x[0][1] // block), (x[0][1] % block, *x[1])))
    return spark.createDataFrame(by_block.cogroup(came, tasks(total, block, 0)).flatMap(proved), RESULT, verifySchema=False)
