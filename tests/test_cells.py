"""Joins by cells against all pairs: similar vectors, and names most similar to texts."""

import random
import tracemalloc

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark import TaskContext
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessarium.functions.fuzzy import similarity
from tessarium.operators import cells, linking, name_index, search


def clustered(n: int, seed: int, spread: float = 0.08) -> list[tuple[int, list[float]]]:
    r = np.random.default_rng(seed)
    centres = r.normal(size=(12, 16))
    return [(i, (centres[i % 12] + spread * r.normal(size=16)).tolist()) for i in range(n)]


def pairs_of(rows: list, threshold: float) -> dict:
    out = {}
    for x, (i, v) in enumerate(rows):
        for j, w in rows[x + 1 :]:
            n = max(len(v), len(w))
            a, b = (np.pad(np.array(u, float), (0, n - len(u))) for u in (v, w))
            s = a @ b / (np.linalg.norm(a) * np.linalg.norm(b))
            if s >= threshold and i != j:
                out[min(i, j), max(i, j)] = round(float(s), 6)
    return out


@pytest.mark.parametrize(("block", "visitors"), [(cells.BLOCK, cells.VISITORS), (40, 30)])
@pytest.mark.parametrize("threshold", [0.9, 0.2, -0.5])
def test_similar_pairs(spark, monkeypatch, block, visitors, threshold):
    monkeypatch.setattr(cells, "BLOCK", block)
    monkeypatch.setattr(cells, "VISITORS", visitors)
    rows = clustered(240, 3) + [(1000 + i, [1.0, 2.0, 3.0]) for i in range(90)]
    odd = [(2000, None), (2001, [0.0, 0.0]), (2002, [1.0, None]), (2003, [float("nan"), 1.0]), (2004, [float("inf"), 1.0]), (2005, []), (None, [1.0, 2.0, 3.0])]
    report: dict = {}
    found = search.similar_pairs(spark.createDataFrame(rows + odd, "id long, v array<double>"), threshold, report=report)
    got = [(r.a, r.b, round(r.score, 6)) for r in found.collect()]
    assert len(got) == len(set(got)) and {(a, b): s for a, b, s in got} == pytest.approx(pairs_of(rows, threshold), abs=2e-6)
    assert report["met"] + report["at_home"] <= report["all"] * 1.0001


def test_clustered_vectors_meet_few(spark, monkeypatch):
    monkeypatch.setattr(cells, "BLOCK", 100)
    report: dict = {}
    search.similar_pairs(spark.createDataFrame(clustered(1200, 5), "id long, v array<double>"), 0.85, report=report).count()
    assert (report["met"] + report["at_home"]) / report["all"] < 0.5


def test_similar_pairs_of_names_with_keys_and_of_nothing(spark):
    rows = [("b", [1.0, 0.0], 1), ("a", [1.0, 0.1], 1), ("c", [1.0, 0.0], 2), ("d", [1.0, 0.0], None), ("e", [1.0, 0.0], None), ("a", [1.0, 0.0], 1)]
    frame = spark.createDataFrame(rows, "id string, v array<double>, g int")
    assert {(r.a, r.b) for r in search.similar_pairs(frame, 0.9, "g").collect()} == {("a", "b")}
    assert {(r.a, r.b) for r in search.similar_pairs(frame, 0.9).collect()} == {(x, y) for x in "abcde" for y in "abcde" if x < y}
    assert search.similar_pairs(frame.where("false"), 0.9).collect() == []


def test_nearest_takes_odd_vectors(spark):
    data = spark.createDataFrame([("x", [1.0, 0.0, 0.0]), ("y", [1.0, 0.1]), ("n", [float("nan"), 1.0]), ("z", None)], "id string, v array<double>")
    got = search.nearest(data, data, 2).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.doc) for r in got] == [("x", "y"), ("y", "x")]


def names_made(n: int, seed: int) -> list[str]:
    r = random.Random(seed)
    parts = ["red", "blue", "bolt", "gear", "é", "plate", "of", "ring", "kit", "anvil", "12", "x-1", "straße"]
    return list({" ".join(r.choice(parts) for _ in range(r.randrange(1, 5))) + r.choice(["", "s", "-kit", str(r.randrange(99))]) for _ in range(n)})


@pytest.mark.parametrize("block", [cells.BLOCK, 25])
@pytest.mark.parametrize(("k", "least"), [(3, 60.0), (1, 0.0), (30, 85.0)])
def test_nearest_names(spark, monkeypatch, block, k, least):
    monkeypatch.setattr(cells, "BLOCK", block)
    known = names_made(300, 1)
    asked = names_made(40, 2) + ["gera bleu", "zzz", "", None, "x" * 400, known[0]]
    report: dict = {}
    found = name_index.nearest_names(spark.createDataFrame([(a,) for a in asked], "a string"), spark.createDataFrame([(b,) for b in [*known, "", None, known[1]]], "b string"), k, least, report)
    got: dict = {}
    for r in found.collect():
        got.setdefault(r.a, []).append((-r.score, r.b))
    want = {}
    for a in {a for a in asked if a}:
        scores = sorted((-int(similarity(name_index.words_sorted(a), name_index.words_sorted(b)) + 1e-9), b) for b in known)
        if best := [x for x in scores if -x[0] >= least][:k]:
            want[a] = best
    assert {a: sorted(x) for a, x in got.items()} == want
    assert 0 < report["tried"] <= report["all"]


def test_nearest_names_of_nothing(spark):
    none, some = spark.createDataFrame([], "a string"), spark.createDataFrame([("x",)], "a string")
    assert not name_index.nearest_names(none, some.withColumnRenamed("a", "b"), 3, 60.0).collect()
    assert not name_index.nearest_names(some, none.withColumnRenamed("a", "b"), 3, 60.0).collect()


def test_shortlist_keeps_the_best_alias_of_a_page(spark):
    aliases = spark.createDataFrame([("red bolt", 1), ("red bolts", 1), ("red bolp", 2), ("blue", 3)], "alias string, page_id long")
    got = linking.shortlist(spark.createDataFrame([(" Red BOLT ",)], "text string"), aliases).orderBy("rank").collect()
    assert [(r.text, r.page_id, r.score, r["rank"]) for r in got] == [("red bolt", 1, 100, 1), ("red bolt", 2, 87, 2)]


def test_blocks_of_few_bytes_are_dealt_over_tasks(spark):
    """Blocks and parts of their visitors are much work, however few bytes they have."""
    home = spark.range(400).selectExpr("id", "cast(id % 40 as int) AS _block")
    solve = lambda x, y, first: pd.DataFrame({"task": [TaskContext.get().partitionId()], "pairs": [len(x) * len(y)]})
    found = cells.met(home, home, solve, "task long, pairs long", F.xxhash64("id"), visitors_at_once=5).collect()
    assert sum(r.pairs for r in found) == 400 * 10 and len({r.task for r in found}) > 1


def test_best_names_of_long_and_odd_texts():
    """Names beyond a machine word and beyond the usual length, and equal scores on the k-th place."""
    r = random.Random(4)
    known = sorted({"".join(r.choice("abé 1") for _ in range(n)).strip() or "x" for n in [*range(1, 90)] * 4} | {"ab " * 100, "b" * 200})
    held = name_index.Held(known)
    for text in ["ab1", "aé b", "a" * 63, "ab " * 30, "zz", known[7]]:
        scores = sorted((-int(similarity(name_index.words_sorted(text), b) + 1e-9), i) for i, b in enumerate(held.by_word))
        for k, least in ((1, 0), (5, 40), (300, 0)):
            best, tried = name_index.best_of(text, name_index.letters([text])[0], held, k, least)
            assert [(-s, i) for s, i in best] == [x for x in scores if -x[0] >= least][:k] and tried <= len(known)


@pytest.mark.parametrize("metric", ["cosine", "l2"])
@pytest.mark.parametrize(("block", "tile"), [(4096, 1 << 20), (40, 300)])
def test_nearest_in_slices(spark, monkeypatch, metric, block, tile):
    """Copies tie by id whatever rounding does to their scores, linked pairs are left out, and scores are held a slice at a time."""
    monkeypatch.setattr(search, "BLOCK", block)
    monkeypatch.setattr(search, "TILE", tile)
    r = np.random.default_rng(8)
    bases = r.normal(size=(20, 7)) * 1000
    rows = [(int(i), bases[(i * 7) % 20].tolist()) for i in range(160)]
    links = [(q, d) for q in range(0, 160, 2) for d in range(160) if (q * 3 + d) % 9 == 0]
    data = spark.createDataFrame(rows, "id long, v array<double>")
    got = search.nearest(data, data.where("id % 2 = 0"), 6, metric, without=spark.createDataFrame(links, "query_id long, doc long"))
    V, gone = np.array([v for _, v in rows]), set(links)
    norm = np.linalg.norm(V, axis=1)
    want = set()
    for q in range(0, 160, 2):
        s = np.sqrt(((V - V[q]) ** 2).sum(1)) if metric == "l2" else -(V @ V[q]) / (norm * norm[q] + 1e-12)
        best = sorted((round(float(s[d]), 9), d) for d in range(160) if d != q and (q, d) not in gone)[:6]
        want |= {(q, n, d) for n, (_, d) in enumerate(best, 1)}
    assert {(x.query_id, x["rank"], x.doc) for x in got.collect()} == want


@pytest.mark.parametrize("metric", ["cosine", "l2"])
def test_scores_are_held_a_slice_at_a_time(metric):
    """A block of queries against a block of vectors never holds all of its scores, nor differences of all components."""
    r = np.random.default_rng(9)
    A, B_ = r.normal(size=(3000, 16)), r.normal(size=(3000, 16))
    none = lambda start, end: (np.zeros(0, np.int64), np.zeros(0, np.int64))
    tracemalloc.start()
    found = [len(i) for i, _, _ in search.best_pairs(A, B_, 5, metric, none, None)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(found) == 15000 and peak < 3000 * 3000 * 8


@pytest.mark.parametrize(("k", "least"), [(3, 60.0), (1, 0.0), (30, 85.0)])
def test_few_texts_meet_names_in_one_pass(spark, monkeypatch, k, least):
    """Names aren't placed in cells for a few texts, and the rows are those of cells; so many batches that bars rise."""
    known, asked = names_made(300, 1), names_made(40, 2) + ["gera bleu", "zzz", "x" * 400, "\u00e9 \U0001f600", "B 1"]
    sides = spark.createDataFrame([(a,) for a in asked], "a string"), spark.createDataFrame([(b,) for b in [*known, "", None, known[1]]], "b string")
    rows = lambda: {tuple(r) for r in name_index.nearest_names(*sides, k, least).collect()}
    monkeypatch.setattr(name_index, "SCANNED", 0)
    by_cells = rows()
    monkeypatch.setattr(name_index, "SCANNED", 256)
    monkeypatch.setattr(cells, "celled", lambda *_: pytest.fail("placed"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 20)
    try:
        assert rows() == by_cells != set()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_pairs_of_two_blocks_leave_in_small_batches(spark, monkeypatch, tmp_path):
    """Equal vectors are all pairs of their block, which no task may hold at once."""
    monkeypatch.setattr(search, "PAIRS", 100)
    seen = tmp_path / "seen"
    seen.mkdir()
    rows = spark.createDataFrame([(i, [1.0, 2.0], "x") for i in range(120)], "id long, v array<double>, title string")

    def found(rows, i, j, score):
        (seen / f"{len(i)}").touch()
        yield pa.RecordBatch.from_arrays([rows["title"].combine_chunks().take(pa.array(i)), pa.array(score)], names=["title", "score"])

    got = search.similar_pairs(rows, 0.9, found=found, schema=StructType.fromDDL("title string, score double"))
    assert got.count() == 120 * 119 // 2 and max(int(x.name) for x in seen.iterdir()) == 100


def test_cosines_at_the_threshold_are_told_alike_in_any_block():
    r = np.random.default_rng(1)
    A = r.normal(size=(40, 7))
    exact = search.cosine_matrix(A[:1], A[1:2])[0, 0]
    whole = search.reaching(search.cosine_matrix(A, A), A, A, exact)
    for i in range(40):
        for j in range(40):
            wide = [np.pad(A[k : k + 1], ((0, 0), (0, 5))) for k in (i, j)]
            assert search.reaching(search.cosine_matrix(*wide), *wide, exact)[0, 0] == whole[i, j]
