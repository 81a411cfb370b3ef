"""Streams of sources and events."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessarium.sources.versions import Collection, Table

def event_stream(spark: SparkSession, folder: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def daily_totals(events: DataFrame, late: str = "2 days") -> DataFrame:
    """Events and cost by day and type; rows later than the watermark are dropped."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("cost")).select(F.col("w.start").alias("day"), "event_type", "n", "cost")


def month_alarm(events: DataFrame, budget: float) -> DataFrame:
    """month, cost of months that cost more than a budget, whenever they change; the state is one row a month."""
    months = events.groupBy(F.date_trunc("month", F.col("ts").cast("timestamp")).alias("month")).agg(F.sum("value").alias("cost"))
    return months.where(F.col("cost") > budget)


def distinct_sources(documents: DataFrame, moment: str | None = None, late: str = "7 days") -> DataFrame:
    """Each content once; with a time column once within the watermark, so that the state stays bounded. For once ever see new_sources_to()."""
    hashed = documents.withColumn("content_hash", F.sha2("text", 256))
    return hashed.dropDuplicates(["content_hash"]) if moment is None else hashed.withWatermark(moment, late).dropDuplicatesWithinWatermark(["content_hash"])


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _overwrite(rows: DataFrame, target: str, by: str) -> None:
    """Replaces the partitions that rows has; rows may come from the target itself, so they're written beside it first."""
    beside = f"{target.rstrip('/')}.staged-{uuid.uuid4().hex}"
    rows.write.parquet(beside)
    staged = rows.sparkSession.read.schema(rows.schema).parquet(beside)
    staged.write.partitionBy(by).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(target)
    p = rows.sparkSession._jvm.org.apache.hadoop.fs.Path(beside)
    p.getFileSystem(rows.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def sync_to(stream: DataFrame, target: str, key: str, checkpoint: str, order: str | None = None) -> StreamingQuery:
    """Each micro-batch changes its keys' rows in a versions.Table; of a key's rows, in whatever batches they came, the last by order counts, and without an
    order those of the last batch. Read it with Table(spark, target, key).rows(). A repeated batch, or a new checkpoint over an old table, gives the same
    rows again; a batch that fails on its way leaves the old state."""

    def merge(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            table = Table(batch.sparkSession, target, key)
            # without an order the number of the state that a batch meets: a later batch meets a later one, whatever its checkpoint
            table.upsert(batch, F.col(order) if order else F.lit(table.state()["number"]).cast("long"))

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def sync_collection(stream: DataFrame, root: str, checkpoint: str, order: str, gone: str | None = None) -> StreamingQuery:
    """Changed pages of a stream into a versions.Collection, with all that follows from them."""

    def merge(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            Collection(batch.sparkSession, root).sync(batch, F.col(order), F.col(gone) if gone else None)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def new_sources_to(stream: DataFrame, target: str, checkpoint: str, name: str = "") -> StreamingQuery:
    """Appends sources (text) whose content the table lacks, each once, ever: the table, not the stream's state, remembers them. A repeated batch replaces its
    own rows; name tells streams with different checkpoints apart."""

    def add(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        mine = f"{name}-{number}"
        fresh = batch.withColumn("content_hash", F.sha2("text", 256)).dropDuplicates(["content_hash"]).withColumn("_batch", F.lit(mine))
        if exists(spark, target):
            known = spark.read.schema(fresh.schema).parquet(target).where(F.col("_batch") != mine)
            fresh = fresh.join(known.select("content_hash"), "content_hash", "left_anti").select(*fresh.columns)
        if not fresh.isEmpty():
            _overwrite(fresh, target, "_batch")

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def history_ring(questions: DataFrame, n: int) -> DataFrame:
    """owner, ring: the ids of each owner's newest n questions (owner, ts, query_id), the newest first, whenever they change; the state is n entries an owner."""

    def keep(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        ring = json.loads(state.get[0]) if state.exists else []
        for pdf in batches:
            ring += [[str(t), str(q)] for t, q in zip(pdf["ts"], pdf["query_id"])]
        ring = sorted({tuple(x) for x in ring}, reverse=True)[:n]
        state.update((json.dumps(ring),))
        yield pd.DataFrame({"owner": [key[0]], "ring": [[q for _, q in ring]]})

    kind = questions.schema["owner"].dataType.simpleString()
    return questions.groupBy("owner").applyInPandasWithState(keep, f"owner {kind}, ring array<string>", "ring string", "update", "NoTimeout")


class Progress:
    """Rows and batches of a stream so far; add it with spark.streams.addListener(progress.listener())."""

    def __init__(self):
        self.rows = self.batches = 0

    def listener(self):
        from pyspark.sql.streaming import StreamingQueryListener

        mine = self

        class Listener(StreamingQueryListener):
            def onQueryStarted(self, event): ...

            def onQueryProgress(self, event):
                mine.rows += event.progress.numInputRows
                mine.batches += 1

            def onQueryIdle(self, event): ...

            def onQueryTerminated(self, event): ...

        return Listener()
