"""Exact top-k inner-product search by a Voronoi join.

Vectors become whole numbers. A bounded sample, which grows with the root of the rows, gives pivots; queries and data are grouped by their
nearest pivot into cells. Each data cell is summarized by its size, radius and longest vector. By Cauchy and Schwarz the scores of a query q in
a cell lie within |q| times the radius of q's score with the pivot, and don't exceed |q| times the cell's longest. Each query's k-th best
score is bounded from below by the pivots, which are data themselves, and by the cells' lower bounds; cells whose upper bound doesn't reach it
can't hold a result. Neighbouring query cells then form groups, and each data row goes only to groups of which a query needs its cell. How
coarse the groups are is chosen by the rows this sends. Large cells and groups are split, so that one task meets at most QUERIES
queries and about ROWS rows, which it solves as a matrix product.

Vectors that are null, or hold null or non-finite components, take no part. A vector shorter than the longest counts as followed by zeros.
Ties go to the smaller vec_id. Rows that repeat a vec_id are candidates each, but one query, with the smallest vector in byte
order; a query never meets rows of its own vec_id. An empty table gives no rows. Other columns don't matter. Sums of products must stay
below 2 to the 53rd.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessarium.llm.common import checkpointed, map_arrow, rows

#: Data rows and queries that one task meets, and the least and most pivots: bounds of what a task or the driver holds.
ROWS, QUERIES, PIVOTS = 16384, 16384, (32, 1024)
#: Queries of a group, one of which is chosen by cost.
GRAINS = (QUERIES, 4096, 1024, 256, 64, 16)
#: Pairs that are compared in the time that sending a row takes.
PAIRS_A_ROW = 256


def whole_numbers(vectors: DataFrame, scale: int, dims: int) -> DataFrame:
    """vec_id and v, little-endian 64-bit floats of floor(scale * x), filled up with zeros."""
    schema = pa.schema([("vec_id", pa.int64()), ("v", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("x")
            size = np.diff(column.offsets.to_numpy())
            flat = np.floor(scale * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
            out = np.zeros((len(size), dims))
            out[np.arange(dims)[None, :] < size[:, None]] = flat
            yield rows(schema, batch.column("vec_id"), [r.tobytes() for r in out])

    return map_arrow(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("x")), run, "vec_id long, v binary")


def usable(vectors: DataFrame) -> DataFrame:
    def finite(x: Column) -> Column:
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) != float("inf"))

    return vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(F.forall("embedding", finite))


@dataclass
class Plan:
    """Where queries and data of each cell go; all arrays are bounded by the number of pivots."""

    #: The group of each query cell, and the parts that it's split into.
    group: np.ndarray
    parts: np.ndarray
    #: Groups of whose queries one needs the cell, by data cell.
    sends: list[np.ndarray]
    #: Slices of the data that a group meets.
    slices: np.ndarray
    #: Data rows sent, and pairs of a query and a row of data that meet.
    sent: int
    met: int


def chain(P: np.ndarray) -> np.ndarray:
    """An order of pivots in which each is followed by the nearest one left."""
    norms, left, at, out = (P * P).sum(1), np.ones(len(P), bool), 0, []
    for _ in range(len(P)):
        left[at] = False
        out.append(at)
        at = int(np.where(left, norms - 2 * P @ P[at], np.inf).argmin())
    return np.array(out)


def planned(P: np.ndarray, size: np.ndarray, asked: np.ndarray, needs: np.ndarray) -> Plan:
    """size and asked: data rows and queries by cell; needs[i, j]: a query of cell i needs data cell j."""
    best, order = None, chain(P)
    for grain in GRAINS:
        group, held, number = np.zeros(len(P), np.int64), 0, 0
        for c in order:
            if held and held + asked[c] > grain:
                number, held = number + 1, 0
            group[c] = number
            held += asked[c]
        n = np.bincount(group, asked, number + 1).astype(np.int64)
        parts = np.maximum(1, -(-n // QUERIES))
        wanted = np.zeros((number + 1, len(P)), bool)
        np.logical_or.at(wanted, group[asked > 0], needs[asked > 0])
        met = wanted @ size
        slices = np.maximum(1, -(-met // ROWS))
        sent = int((met * parts).sum())
        pairs = int((n * met).sum())
        cost = sent + int((n * slices).sum()) + pairs / PAIRS_A_ROW
        if best is None or cost < best[0]:
            best = cost, Plan(group, parts, [np.flatnonzero(w) for w in wanted.T], slices, sent, pairs)
    return best[1]


def top_k(vectors: DataFrame, query: Column, k: int = 5, scale: int = 256, pivots: tuple[int, int] = PIVOTS, report: dict | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best. A report gets the plan."""
    out = "query_id long, rank int, vec_id long, score long"
    spark = vectors.sparkSession
    vectors = usable(vectors)
    count, dims = vectors.agg(F.count(F.lit(1)), F.max(F.size("embedding"))).first()
    if not count:
        return spark.createDataFrame([], out)
    dims = max(dims, 1)
    whole = whole_numbers(vectors.select("vec_id", "embedding"), scale, dims)

    def matrix(column) -> np.ndarray:
        return np.frombuffer(b"".join(column), np.float64).reshape(-1, dims)

    n_pivots = min(max(int(count**0.5), pivots[0]), pivots[1])
    chosen = vectors.select("vec_id", "embedding").orderBy(F.xxhash64("vec_id"), "vec_id").limit(n_pivots)
    sample = whole_numbers(chosen, scale, dims).collect()
    P, first = np.unique(matrix([r[1] for r in sample]), axis=0, return_index=True)
    ids, norms = np.array([sample[i][0] for i in first], np.int64), (P * P).sum(1)
    cells_schema = pa.schema([("vec_id", pa.int64()), ("v", pa.binary()), ("cell", pa.int32()), ("far", pa.float64()), ("long", pa.float64())])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                V = matrix(batch.column("v").to_pylist())
                d = (V * V).sum(1)[:, None] - 2 * V @ P.T + norms
                at = d.argmin(1)
                far = np.sqrt(np.maximum(d[np.arange(len(V)), at], 0))
                yield rows(cells_schema, batch.column("vec_id"), batch.column("v"), at.astype(np.int32), far, np.sqrt((V * V).sum(1)))

    cells = checkpointed(map_arrow(whole, assign, "vec_id long, v binary, cell int, far double, long double"))
    # at most as many rows as pivots; a little more for rounding
    summary = {r[0]: r[1:] for r in cells.groupBy("cell").agg(F.count(F.lit(1)), F.max("far"), F.max("long")).collect()}
    size, radius, longest = (np.array([summary.get(c, (0, 0.0, 0.0))[i] for c in range(len(P))]) for i in range(3))
    radius, longest = radius + 1e-6, longest * (1 + 1e-12) + 1e-6
    # with the number of rows of its own vec_id, none of which is a candidate
    own = cells.groupBy("vec_id").agg(F.count(F.lit(1)).alias("own")).where("own > 1")
    queries = cells.where(query).groupBy("vec_id").agg(F.min(F.struct("v", "cell")).alias("q"))
    queries = queries.join(own, "vec_id", "left").select("vec_id", "q.v", "q.cell", F.coalesce("own", F.lit(1)).alias("own"))
    bounded = pa.schema([("query_id", pa.int64()), ("v", pa.binary()), ("cell", pa.int32()), ("least", pa.float64()), ("needs", pa.list_(pa.int64()))])

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            q_ids = batch.column("vec_id").to_numpy()
            Q = matrix(batch.column("v").to_pylist())
            dots, length = Q @ P.T, np.sqrt((Q * Q).sum(1))[:, None]
            slack = length * radius
            # k-th best of the pivots, of which one may be the query itself, and of the cells' lower bounds
            others = np.where(ids[None, :] == q_ids[:, None], -np.inf, dots)
            least = np.sort(others, 1)[:, -k] if len(P) >= k else np.full(len(Q), -np.inf)
            low, order = dots - slack, np.argsort(slack - dots, 1)
            needed = k + batch.column("own").to_numpy()
            enough = (np.cumsum(size[order], 1) >= needed[:, None]).argmax(1)
            reached = np.where(size.sum() >= needed, np.take_along_axis(low, np.take_along_axis(order, enough[:, None], 1), 1)[:, 0], -np.inf)
            least = np.maximum(least, reached) - 1e-6
            need = (np.minimum(dots + slack, length * longest) >= least[:, None]) & (size > 0)
            bits = np.zeros((len(Q), -(-len(P) // 64) * 64), bool)
            bits[:, : len(P)] = need
            words = np.packbits(bits, axis=1, bitorder="little").view(np.int64)
            yield rows(bounded, batch.column("vec_id"), batch.column("v"), batch.column("cell"), least, words.tolist())

    asked = checkpointed(map_arrow(queries, bound, "query_id long, v binary, cell int, least double, needs array<long>"))
    # at most pivots x pivots bits, and as many counts as pivots; combined before the shuffle
    words = [F.bit_or(F.col("needs")[i]).alias(f"w{i}") for i in range(-(-len(P) // 64))]
    needs, n_asked = np.zeros((len(P), len(P)), bool), np.zeros(len(P), np.int64)
    for cell, n, *found in asked.groupBy("cell").agg(F.count(F.lit(1)), *words).collect():
        needs[cell] = np.unpackbits(np.array(found, np.int64).view(np.uint8), count=len(P), bitorder="little").astype(bool)
        n_asked[cell] = n
    plan = planned(P, size.astype(np.int64), n_asked, needs)
    if report is not None:
        report["plan"] = plan
    dealt = pa.schema([("group", pa.int32()), ("part", pa.int32()), ("slice", pa.int32()), ("id", pa.int64()), ("v", pa.binary()), ("least", pa.float64())])
    dealt_sql = "group int, part int, slice int, id long, v binary, least double"

    def spread(x: np.ndarray) -> np.ndarray:
        x = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return ((x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(33)).astype(np.int64)

    def repeated(times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places, each as often as it counts, and the number of each repeat."""
        at = np.repeat(np.arange(len(times)), times)
        return at, np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)

    def deal_queries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q_ids, raw = batch.column("query_id").to_numpy(), batch.column("v").to_pylist()
            group = plan.group[batch.column("cell").to_numpy()]
            at, part_slice = repeated(plan.slices[group])
            part = spread(q_ids)[at] % plan.parts[group[at]]
            yield rows(dealt, group[at].astype(np.int32), part.astype(np.int32), part_slice.astype(np.int32), q_ids[at], [raw[i] for i in at], batch.column("least").to_numpy()[at])

    def deal_data(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        copies = [np.repeat(g, plan.parts[g]) for g in plan.sends]
        parts = [np.concatenate([np.arange(plan.parts[x]) for x in g]) if len(g) else g for g in plan.sends]
        for number, batch in enumerate(batches):
            cell, raw = batch.column("cell").to_numpy(), batch.column("v").to_pylist()
            at, _ = repeated(np.array([len(copies[c]) for c in cell], np.int64))
            group = np.concatenate([copies[c] for c in cell]) if len(cell) else at
            part = np.concatenate([parts[c] for c in cell]) if len(cell) else at
            # by the row's hash, so that many rows of one vec_id are spread as well
            salt = batch.column("salt").to_numpy()
            yield rows(dealt, group.astype(np.int32), part.astype(np.int32), (salt[at] % plan.slices[group]).astype(np.int32), batch.column("vec_id").to_numpy()[at], [raw[i] for i in at], np.zeros(len(at)))

    left = map_arrow(asked, deal_queries, dealt_sql)
    salt = F.pmod(F.xxhash64("vec_id", "v", F.monotonically_increasing_id()), F.lit(1 << 40)).alias("salt")
    right = map_arrow(cells.select("vec_id", "v", "cell", salt), deal_data, dealt_sql)

    def solve(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype(np.int64)
        right = right.sort_values("id")
        V, v_ids = matrix(right["v"]), right["id"].to_numpy()
        found = []
        for a in range(0, len(left), 256):
            q_ids, least = left["id"].to_numpy()[a : a + 256], left["least"].to_numpy()[a : a + 256]
            scores = matrix(left["v"][a : a + 256]) @ V.T
            scores[q_ids[:, None] == v_ids[None, :]] = -np.inf
            # the k-th best of this slice, all its ties, and of the ties those of smallest id
            bar = np.maximum(np.partition(scores, -k, 1)[:, -k] if len(v_ids) > k else -np.inf, least)
            i, j = np.nonzero((scores >= bar[:, None]) & (scores > -np.inf))
            s = scores[i, j]
            order = np.lexsort((j, -s, i))
            i, j, s = i[order], j[order], s[order]
            rank = np.arange(len(i)) - np.searchsorted(i, i)
            keep = rank < k
            found.append((q_ids[i[keep]], v_ids[j[keep]], s[keep].astype(np.int64)))
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), map(np.concatenate, zip(*found)))))

    keys = ["group", "part", "slice"]
    best = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(solve, "query_id long, vec_id long, score long")
    # pre-aggregated by Spark: at most k rows of a query leave a task
    ranked = best.selectExpr("*", "row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank").where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
