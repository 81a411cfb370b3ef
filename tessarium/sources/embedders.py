"""Embedders by name, and vectors that are stored with what made them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessarium.operators.retrieval import Fingerprint, checked
from tessarium.sources import sinks


@dataclass(frozen=True)
class Embedder:
    """make gives a function from texts to vectors, once a worker."""

    fingerprint: Fingerprint
    make: Callable[[], Callable[[list[str]], list[list[float]]]]


class Registry:
    """Embedders by name. A name that is taken may only be given again to the same provider, model and length."""

    def __init__(self):
        self.known: dict[str, Embedder] = {}

    def add(self, name: str, provider: str, model: str, dimensions: int, make: Callable) -> None:
        new = Embedder(Fingerprint(provider, model, dimensions), make)
        if name in self.known and self.known[name].fingerprint != new.fingerprint:
            raise ValueError(f"{name} is {self.known[name].fingerprint} already")
        self.known[name] = new

    def __getitem__(self, name: str) -> Embedder:
        if name not in self.known:
            raise KeyError(f"no embedder {name}; known are {', '.join(sorted(self.known)) or 'none'}")
        return self.known[name]


def store(rows: DataFrame, embedder: Embedder, path: str, text: str = "text") -> None:
    """Rows with vectors v of their texts, and the embedder's fingerprint beside them, in a new folder. Vectors of another length than it says are an error."""
    spark = rows.sparkSession
    n = embedder.fingerprint.dimensions
    made = sinks.embedded(rows, embedder.make, text)
    wrong = F.raise_error(F.lit(f"a vector isn't of {n} components"))
    made.withColumn("v", F.when(F.col("v").isNull() | (F.size("v") == n), F.col("v")).otherwise(wrong.cast("array<float>"))).write.parquet(f"{path}/vectors")
    sinks.fingerprint(spark, *embedder.fingerprint).coalesce(1).write.parquet(f"{path}/fingerprint")


def stored(spark: SparkSession, path: str, active: Embedder) -> DataFrame:
    """Stored rows, if the active embedder is the one that made their vectors; ValueError otherwise, or where a store was never finished."""
    try:
        found = spark.read.parquet(f"{path}/fingerprint").first()
    except Exception as error:
        raise ValueError(f"{path} has no fingerprint") from error
    checked(Fingerprint(*found), active.fingerprint)
    return spark.read.parquet(f"{path}/vectors")
