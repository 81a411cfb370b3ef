"""Joins of points that lie near each other in a metric space, by cells around pivots.

A bounded sample of points gives pivots, and each point belongs to a cell of its nearest one: the inner one, or the outer one if it is unusually
far from it, so that a few stray points don't widen a cell. By the triangle inequality a point x has no partner within a distance in a cell
all of whose points are nearer to, or farther from, the pivot than x by more than that distance. Neighbouring cells form blocks of
about BLOCK points, which stay at home; a point visits the blocks in which a partner can lie. A block that many visit is given to
several tasks. The driver holds pivots, and a few numbers a cell and a block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessarium.lineage import checkpointed

#: Points of a block, its visitors in one task, the least and most pivots, and points sampled for each.
BLOCK, VISITORS, PIVOTS, SAMPLED = 4096, 4096, (16, 1024), 4
#: Partitions that blocks and parts of their visitors are dealt over at most.
TASKS = 1000
#: Times the usual distance from a pivot beyond which a point is in the outer cell.
STRAY = 1.5


@dataclass
class Cells:
    """Pivots in coordinates, and of each cell its size, its points' least and greatest distance, and greatest length; blocks: a cell's first block and their number, a block's cells."""

    pivots: np.ndarray
    size: np.ndarray
    least: np.ndarray
    radius: np.ndarray
    longest: np.ndarray
    first: np.ndarray = field(default=None)
    parts: np.ndarray = field(default=None)
    n_blocks: int = 0

    def __post_init__(self):
        """Neighbouring cells share a block, as long as they fit; a larger cell has blocks of its own."""
        self.first, self.parts = np.zeros(len(self.size), np.int64), np.ones(len(self.size), np.int64)
        held, block = 0, 0
        for c in self.order():
            n = int(self.size[c])
            if held and held + n > BLOCK:
                block, held = block + 1, 0
            self.first[c], self.parts[c] = block, max(1, -(-n // BLOCK))
            held += n
            if self.parts[c] > 1:
                block, held = block + int(self.parts[c]), 0
        self.n_blocks = block + (held > 0)

    def order(self) -> list[int]:
        """Inner cells, each followed by that of the nearest pivot left, then outer ones in the same order."""
        n = len(self.size) // 2
        left, at, out = np.ones(n, bool), 0, []
        for _ in range(n):
            left[at] = False
            out.append(at)
            d = np.abs(self.pivots[:n] - self.pivots[at]).sum(1)
            at = int(np.where(left, d, np.inf).argmin())
        return out + [c + n for c in out]

    def within(self, distance: np.ndarray, wide) -> np.ndarray:
        """Which cells can hold a partner within some distance, by rows of distances to pivots."""
        return (distance <= wide + self.radius) & (self.least <= wide + distance)

    def visits(self, near: np.ndarray) -> list[np.ndarray]:
        """Blocks of each row of a matrix that tells which cells can hold a partner."""
        near = near & (self.size > 0)
        return [np.unique(np.concatenate([np.arange(self.first[c], self.first[c] + self.parts[c]) for c in cells])) if len(cells) else cells for cells in (np.flatnonzero(r) for r in near)]


@dataclass(frozen=True)
class Space:
    """How values become coordinates, and how far apart rows of two matrices of coordinates lie."""

    coordinates: Callable[[list], np.ndarray]
    distance: Callable[[np.ndarray, np.ndarray], np.ndarray]
    length: Callable[[np.ndarray], np.ndarray] = lambda x: np.zeros(len(x))


def spread(X: np.ndarray, n: int, space: Space) -> np.ndarray:
    """Of some points at most n, each the farthest from those before it, so that no dense place goes without."""
    chosen, least = [0], space.distance(X, X[:1])[:, 0]
    while len(chosen) < n and least.max() > 0:
        chosen.append(int(least.argmax()))
        least = np.minimum(least, space.distance(X, X[chosen[-1:]])[:, 0])
    return X[chosen]


def celled(points: DataFrame, value: str, space: Space, sample: Column) -> tuple[DataFrame, Cells | None]:
    """Points with _cell, written once, and the cells; sample orders points, of whose first ones pivots are chosen. None for no points."""
    n = points.count()
    if not n:
        return points.withColumn("_cell", F.lit(0)), None
    wanted = min(max(int(n**0.5), PIVOTS[0]), PIVOTS[1])
    chosen = points.orderBy(sample, value).limit(SAMPLED * wanted).select(value).collect()
    sampled = space.coordinates([r[0] for r in chosen])
    pivots = spread(sampled, wanted, space)
    away = space.distance(sampled, pivots).min(1)
    cut = STRAY * float(np.median(away[away > 0])) if (away > 0).any() else np.inf

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            X = space.coordinates(batch.column(value).to_pylist()) if batch.num_rows else np.zeros((0, pivots.shape[1]))
            d = space.distance(X, pivots)
            at = d.argmin(1) if len(d) else np.zeros(0, np.int64)
            far = d[np.arange(len(at)), at]
            more = [pa.array(at + len(pivots) * (far > cut), pa.int32()), pa.array(far, pa.float64()), pa.array(space.length(X), pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, "_cell", "_far", "_long"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in points.schema.fields)
    placed = checkpointed(points.mapInArrow(run, f"{kinds}, _cell int, _far double, _long double"))
    # at most twice as many rows as pivots
    found = {r[0]: r[1:] for r in placed.groupBy("_cell").agg(F.count(F.lit(1)), F.min("_far"), F.max("_far"), F.max("_long")).collect()}
    size, least, radius, longest = (np.array([found.get(c, (0, 0.0, 0.0, 0.0))[i] for c in range(2 * len(pivots))], np.float64) for i in range(4))
    return placed, Cells(np.concatenate([pivots, pivots]), size, least - 1e-9, radius + 1e-9, longest)


def own_block(cells: Cells, salt: Column) -> Column:
    """A placed point's block."""
    first, parts = F.lit(cells.first.tolist()), F.lit(cells.parts.tolist())
    return (F.element_at(first, F.col("_cell") + 1) + F.pmod(salt, F.element_at(parts, F.col("_cell") + 1))).cast("int")


def met(home: DataFrame, visitors: DataFrame, solve: Callable, schema: str | StructType, salt: Column, report: dict | None = None, visitors_at_once: int | None = None, streamed: bool = False) -> DataFrame:
    """solve(home, visitors, first) for each block of home (_block and other columns) with some of its visitors (_block and other columns); first: whether it's the
    block's first task, which may compare the block with itself. A report gets the pairs that meet. The number of partitions is given, as rows that
    are few bytes would else be put into one task, whatever their work. If streamed, both sides have the same columns and come as Arrow tables, and batches go
    out as solve() yields them, so that no task holds all pairs of two blocks."""
    # a row a block
    came = {r[0]: r[1] for r in visitors.groupBy("_block").agg(F.count(F.lit(1))).collect()}
    if report is not None:
        here = {r[0]: r[1] for r in home.groupBy("_block").agg(F.count(F.lit(1))).collect()}
        report["met"] = sum(n * here.get(b, 0) for b, n in came.items())
        report["at_home"] = sum(n * (n - 1) // 2 for n in here.values())
    at_once = min(visitors_at_once or VISITORS, VISITORS)
    parts = [max(1, -(-came.get(b, 0) // at_once)) for b in range(max(came, default=0) + 1)]
    tasks = max(int(home.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(sum(parts), TASKS))
    some = F.coalesce(F.get(F.lit(parts), F.col("_block")), F.lit(1)) if max(parts) > 1 else F.lit(1)
    home = home.withColumn("_part", F.explode(F.sequence(F.lit(0), some - 1)))
    visitors = visitors.withColumn("_part", F.pmod(salt, some).cast("int"))
    if streamed:
        both = home.withColumn("_home", F.lit(True)).unionByName(visitors.withColumn("_home", F.lit(False)))
        columns = [c for c in home.columns if c not in ("_block", "_part")]

        def pour(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(batches)
            yield from solve(*(table.filter(side).select(columns).combine_chunks() for side in (table["_home"], pc.invert(table["_home"]))), key[1].as_py() == 0)

        return both.repartition(tasks, "_block", "_part").groupBy("_block", "_part").applyInArrow(pour, schema)
    home = home.repartition(tasks, "_block", "_part")
    columns = [*visitors.columns]
    # columns of new names: visitors may come from the same table as home, and what both sides share would be pruned on one of them
    visitors = visitors.select(*(F.col(c).alias(f"{c}_") for c in columns)).repartition(tasks, "_block_", "_part_")

    def run(key: tuple, x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        return solve(x, y.rename(columns={f"{c}_": c for c in columns}), int(key[1]) == 0)

    return home.groupBy("_block", "_part").cogroup(visitors.groupBy("_block_", "_part_")).applyInPandas(run, schema)
