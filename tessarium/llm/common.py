"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space; everything else belongs to words. ``bytes.split()`` splits at exactly these.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows handed to Python at a time: whole texts can be long, so few rows keep a batch small.
BATCH_ROWS = 1024
#: Keys that a broadcast table of the most frequent ones holds.
HOT = 1000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def map_arrow(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` with batches of at most BATCH_ROWS rows; the session's own setting is put back."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = conf.get(key)
    conf.set(key, str(BATCH_ROWS))
    try:
        return df.mapInArrow(function, schema)
    finally:
        conf.set(key, before)


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, or the one that setCheckpointDir() made; a temporary folder of our own only if neither is set and
    all runs on this machine (tests). On a cluster without one, executors would write to their own disks, so that is an error."""
    context = spark.sparkContext
    if path := context.getConf().get("spark.checkpoint.dir"):
        return path.rstrip("/")
    if (made := context._jsc.sc().getCheckpointDir()).isDefined():
        return made.get().rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoint"))
    return shared_folder(spark)


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage in the shared folder."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """Like checkpointed(), as a Parquet table below the same folder: far smaller where there are many short rows."""
    path = f"{shared_folder(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def with_hot(big: DataFrame, keyed: DataFrame, key: str, n: str, values: tuple[str, ...]) -> DataFrame:
    """big left-joined to keyed (key, n, values), in which key is unique. Rows of the HOT keys with most rows meet a broadcast table of at most HOT
    rows; the shuffle then deals them by a hash of their own, so that no key, however frequent, meets in one task. Both keys are long."""
    hot = keyed.orderBy(F.desc(n), key).limit(HOT).select(F.col(key).alias("_hot"), *(F.col(v).alias(f"_hot_{v}") for v in values))
    out = big.join(F.broadcast(hot), F.col(key) == F.col("_hot"), "left")
    # negative hashes of a row can't be told from keys, so the match is checked by a second column
    dealt = out.withColumn("_cold", F.col("_hot").isNull()).withColumn("_key", F.when(F.col("_cold"), F.col(key)).otherwise(F.xxhash64(F.monotonically_increasing_id())))
    rest = keyed.select(F.col(key).alias("_key_"), F.lit(True).alias("_is"), *(F.col(v).alias(f"_cold_{v}") for v in values))
    joined = dealt.join(rest, (F.col("_key") == F.col("_key_")) & (F.col("_cold") == F.col("_is")), "left")
    return joined.select(*big.columns, *(F.when(F.col("_cold"), F.col(f"_cold_{v}")).otherwise(F.col(f"_hot_{v}")).alias(v) for v in values))


def same(left: Column, right: Column) -> Column:
    return left.eqNullSafe(right)


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """Texts of a batch, null as empty."""
    return [x or "" for x in batch.column(name).to_pylist()]


def rows(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def count_of(text: Column, characters: str) -> Column:
    """How many of some ASCII characters a string holds, by length differences: one fast scan a character."""
    total = F.lit(0)
    for c in characters:
        total = total + (F.octet_length(text) - F.octet_length(F.replace(text, F.lit(c), F.lit(""))))
    return total.cast("long")
