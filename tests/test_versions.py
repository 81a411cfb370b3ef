"""States of a collection: late rows, writers that end on their way, two writers, streams."""

import pytest
from pyspark.sql import functions as F

from tessarium.operators import linking, links, search
from tessarium.sources import versions
from tessarium.streaming import incremental

PAGE = "page_id string, title string, aliases array<string>, status string, pos int, summary string, body string, ts long, gone boolean"


def page(i: int, ts: int, body: str | None = None, title: str = "", gone: bool = False) -> tuple:
    return (f"concepts/p{i}", title or f"Page {i}", [f"alias {i}"], "active", i, "sum", body if body is not None else f"Links to [[concepts/p{i + 1}]].", ts, gone)


def content(held: versions.Collection, state: dict | None = None) -> dict:
    state = state or held.state()
    out = {"pages": {(r.page_id, r.title, r.body) for r in held.rows(state).collect()}}
    for name in ("names", "edges", "postings"):
        out[name] = {tuple(map(str, r)) for r in held.read(name, state).drop("linked_at").collect()}
    return out


def follows(spark, held: versions.Collection) -> None:
    """All tables are what follows from the pages."""
    pages = held.rows()
    assert {tuple(r) for r in held.aliases().collect()} == {tuple(r) for r in linking.alias_table(pages).collect()}
    assert {(r.src, r.dst) for r in held.read("edges").collect()} == {(r.src, r.dst) for r in links.edges_of(pages.select("page_id", "body")).collect()}
    want = search.postings(pages.select("page_id", F.col("page_id").alias("name"), "title", "summary", "body"), "page_id", ("name", "title", "summary", "body"), True)
    assert {tuple(map(str, r)) for r in held.read("postings").collect()} == {tuple(map(str, r)) for r in want.collect()}


def synced(spark, held: versions.Collection, rows: list[tuple]) -> dict:
    return held.sync(spark.createDataFrame(rows, PAGE), F.col("ts"), F.col("gone"))


def test_late_rows_lose_in_whatever_batch_they_come(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(versions, "ROWS", 3)
    held = versions.Collection(spark, str(tmp_path))
    synced(spark, held, [page(i, 10) for i in range(8)])
    assert held.state()["tables"]["pages"]["buckets"] == 3
    synced(spark, held, [page(1, 5, "[[old]]"), page(2, 20, "new [[a]]"), page(2, 15, "[[b]]"), page(3, 20, gone=True), page(9, 1, "")])
    synced(spark, held, [page(3, 12, "back"), page(2, 20, "same order, later batch"), (None, "x", None, "active", 1, "", "", 99, False)])
    got = {r.page_id[-2:]: r.body for r in held.rows().collect()}
    assert got == {"p0": "Links to [[concepts/p1]].", "p1": "Links to [[concepts/p2]].", "p2": "same order, later batch", **{f"p{i}": f"Links to [[concepts/p{i + 1}]]." for i in (4, 5, 6, 7)}, "p9": ""}
    follows(spark, held)
    synced(spark, held, [page(3, 30, "now")])
    assert held.rows().where("page_id = 'concepts/p3'").first().body == "now"
    follows(spark, held)


def test_a_writer_that_ends_on_its_way_leaves_the_old_state(spark, tmp_path, monkeypatch):
    held = versions.Collection(spark, str(tmp_path))
    synced(spark, held, [page(i, 1) for i in range(4)])
    before = content(held)
    whole = {name: getattr(versions.Versions, name) for name in ("written", "commit")}
    for steps in range(5):
        done = []

        def ends(self, *args, name, steps=steps, done=done):
            if len(done) == steps:
                raise RuntimeError("killed")
            done.append(name)
            return whole[name](self, *args)

        for name in whole:
            monkeypatch.setattr(versions.Versions, name, lambda self, *args, name=name: ends(self, *args, name=name))
        with pytest.raises(RuntimeError, match="killed"):
            synced(spark, held, [page(1, 2, "changed [[x]]"), page(7, 2)])
        for name, f in whole.items():
            monkeypatch.setattr(versions.Versions, name, f)
        assert content(held) == before and held.state()["number"] == 1, steps
    # a state file that was not written to its end
    (tmp_path / "states" / f"{2:020d}.json").write_text('{"number": 2, "tab')
    assert content(held) == before
    synced(spark, held, [page(1, 2, "changed [[x]]")])
    assert held.state()["number"] == 3 and held.rows().where("page_id = 'concepts/p1'").first().body == "changed [[x]]"
    follows(spark, held)


def test_two_writers_and_old_states(spark, tmp_path):
    held = versions.Collection(spark, str(tmp_path))
    first = held.rebuild(spark.createDataFrame([page(i, 1) for i in range(3)], PAGE), F.col("ts"))
    synced(spark, held, [page(0, 2, "second")])
    with pytest.raises(versions.Conflict):
        held.commit(first, {})
    assert {b for _, _, b in content(held, held.state(1))["pages"]} >= {"Links to [[concepts/p1]]."}
    synced(spark, held, [page(0, 3, "third")])
    before = content(held)
    held.vacuum(keep=1)
    assert content(held) == before and len(list((tmp_path / "states").glob("*.json"))) == 1
    used = {f.split("/")[1] for t in held.state()["tables"].values() for f in t["folders"].values()}
    assert {p.name for p in (tmp_path / "data").iterdir()} == used
    held.rebuild(spark.createDataFrame([page(5, 0)], PAGE), F.col("ts"))
    assert [r.page_id for r in held.rows().collect()] == ["concepts/p5"]
    follows(spark, held)


def test_only_touched_buckets_are_written(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(versions, "ROWS", 10)
    table = versions.Table(spark, str(tmp_path), "k")
    table.upsert(spark.range(200).selectExpr("id AS k", "'a' AS v"), F.lit(1))
    before = table.state()["tables"]["rows"]["folders"]
    table.upsert(spark.createDataFrame([(7, "b")], "k long, v string"), F.lit(2))
    after = table.state()["tables"]["rows"]["folders"]
    assert len(before) == 20 and sum(before[b] != after[b] for b in before) == 1
    assert table.rows().where("v = 'b'").count() == 1 and table.rows().count() == 200


def test_streams_of_pages(spark, tmp_path):
    schema = spark.createDataFrame([], PAGE).schema
    for i, rows in enumerate(([page(1, 10), page(2, 10)], [page(1, 5, "late"), page(2, 11, "", gone=True)], [page(1, 12, "newest")])):
        spark.createDataFrame(rows, PAGE).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        # the last one begins anew over the same files
        incremental.sync_collection(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/ck{i // 2}", "ts", "gone").awaitTermination(120)
    held = versions.Collection(spark, f"{tmp_path}/out")
    assert [(r.page_id, r.body) for r in held.rows().collect()] == [("concepts/p1", "newest")]
    follows(spark, held)


def test_streams_without_an_order(spark, tmp_path):
    for i, rows in enumerate(([(1, "a"), (2, "b")], [(2, "c")])):
        spark.createDataFrame(rows, "k long, v string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in{i}")
        incremental.sync_to(spark.readStream.schema("k long, v string").parquet(f"{tmp_path}/in{i}"), f"{tmp_path}/out", "k", f"{tmp_path}/ck{i}").awaitTermination(60)
    assert sorted(map(tuple, versions.Table(spark, f"{tmp_path}/out", "k").rows().collect())) == [(1, "a"), (2, "c")]
