"""Embedders by name, and what is refused."""

import pytest
from pyspark.sql import functions as F

from tessarium.functions import vectors
from tessarium.sources import embedders


def lengths(n: int):
    def make():
        def run(texts: list[str]) -> list[list[float]]:
            if any("bad" in t for t in texts):
                raise RuntimeError("the provider failed")
            return [[float(len(t))] * n for t in texts]

        return run

    return make


def test_registry():
    known = embedders.Registry()
    known.add("a", "p", "m", 2, lengths(2))
    known.add("a", "p", "m", 2, lengths(2))
    with pytest.raises(ValueError, match="already"):
        known.add("a", "p", "other", 2, lengths(2))
    with pytest.raises(KeyError, match="known are a"):
        known["b"]


def test_vectors_are_read_only_by_what_made_them(spark, tmp_path):
    known = embedders.Registry()
    for name, model, n in (("one", "m", 2), ("other", "x", 2), ("longer", "m", 3)):
        known.add(name, "p", model, n, lengths(n))
    rows = spark.createDataFrame([(1, "ab"), (2, "bad"), (3, None)], "id int, text string")
    embedders.store(rows, known["one"], f"{tmp_path}/v")
    got = {r.id: r.v for r in embedders.stored(spark, f"{tmp_path}/v", known["one"]).collect()}
    assert got == {1: [2.0, 2.0], 2: None, 3: [0.0, 0.0]}
    with pytest.raises(ValueError, match="made by"):
        embedders.stored(spark, f"{tmp_path}/v", known["other"])
    with pytest.raises(ValueError, match="components"):
        embedders.stored(spark, f"{tmp_path}/v", known["longer"])
    with pytest.raises(ValueError, match="no fingerprint"):
        embedders.stored(spark, f"{tmp_path}/none", known["one"])
    wrong = embedders.Embedder(known["longer"].fingerprint, lengths(2))
    with pytest.raises(Exception, match="isn't of 3 components"):
        embedders.store(rows, wrong, f"{tmp_path}/w")


def test_bytes(spark):
    rows = spark.createDataFrame([(1, [1.5, -2.0]), (2, []), (3, None)], "id int, v array<double>")
    raw = rows.select("id", vectors.to_bytes("v").alias("raw"))
    assert {r.id: r.raw for r in raw.collect()} == {1: bytearray(b"\x00\x00\xc0?\x00\x00\x00\xc0"), 2: bytearray(b""), 3: None}
    back = raw.unionByName(raw.where("id = 1").select(F.lit(4).alias("id"), F.expr("substr(raw, 1, 7)").alias("raw")))
    assert {r.id: r.v for r in back.select("id", vectors.from_bytes("raw").alias("v")).collect()} == {1: [1.5, -2.0], 2: [], 3: None, 4: None}
