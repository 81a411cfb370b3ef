"""Names in texts, and spans resolved to pages, against plain scans."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tessarium.functions import names
from tessarium.functions import text as tx
from tessarium.operators import linking

WORDS = ["red", "Bolt", "kit", "é", "o'brien", "blue-gear", "gear", "C++", ".net", "İzmir", "the", "élan", "vital"]


def scanned(body: str, aliases: list[tuple[str, str]]) -> set:
    """Every place of every name, from word to word; then the longest of those that overlap."""
    text, found = names.folded(body), []
    inside = {i for m in re.finditer(r"\w+(?:[-'’]\w+)*", text) for i in range(m.start() + 1, m.end())}
    for name, label in aliases:
        key = names.folded(name)
        for s in range(len(text) - len(key) + 1):
            e = s + len(key)
            sign = lambda c: not (c.isalnum() or c == "_")
            if text[s:e] == key and (sign(text[s]) or s not in inside) and (sign(text[e - 1]) or e not in inside):
                found.append((s, e, label))
    out = []
    for s, e, label in sorted(found, key=lambda x: (x[0] - x[1], x[0], x[2])):
        if all(e <= a or b <= s for a, b, _ in out):
            out.append((s, e, label))
    return set(out)


def made(n: int, seed: int) -> tuple[list, list]:
    r = random.Random(seed)
    aliases = {}
    for _ in range(40):
        aliases[names.folded(" ".join(r.choice(WORDS) for _ in range(r.randrange(1, 8))))] = r.choice(["ORG", "CONCEPT"])
    bodies = ["".join(r.choice(WORDS) + r.choice([" ", " ", " ", ", ", "\n", "-"]) for _ in range(r.randrange(60))) for _ in range(n)]
    return list(aliases.items()), [*bodies, "", None, "x" * 10_000, " ".join(next(iter(aliases)) for _ in range(300))]


@pytest.mark.parametrize("characters", [linking.AUTOMATON, 60])
def test_mentions_equal_a_plain_scan(spark, characters):
    aliases, bodies = made(40, 1)
    pages = spark.createDataFrame([(f"p{i}", b, i) for i, b in enumerate(bodies)], "page_id string, body string, label int")
    known = spark.createDataFrame([*aliases, ("", "ORG"), (None, "ORG")], "alias string, label string")
    got: dict = {}
    for r in linking.mentions(pages, known, characters, groups=3).collect():
        body = bodies[int(r.page_id[1:])]
        assert r.text == body[r.start : r.end]
        got.setdefault(r.page_id, set()).add((r.start, r.end, r.label))
    assert got == {f"p{i}": found for i, b in enumerate(bodies) if b and (found := scanned(b, aliases))}


def test_mentions_without_names_or_pages(spark):
    pages = spark.createDataFrame([("p", "a b")], "page_id string, body string")
    none = spark.createDataFrame([], "alias string, label string")
    assert not linking.mentions(pages, none).collect()
    assert not linking.mentions(pages.where("false"), spark.createDataFrame([("a", "ORG")], none.schema), characters=0).collect()


def test_mentions_read_bodies_once_and_explode_no_word_sequences(spark):
    aliases, bodies = made(5, 2)
    pages = spark.createDataFrame([(f"p{i}", b) for i, b in enumerate(bodies)], "page_id string, body string")
    plan = linking.mentions(pages, spark.createDataFrame(aliases, "alias string, label string"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Exchange" not in plan and "Join" not in plan


def test_proper_names(spark):
    found = lambda b: [b[s:e] for s, e in names.proper_runs(b)]
    assert found("The Red Bolt beats Big Ring. Then Paris, and Ann. Rome wasn't.\nBerlin is\n- Ulm Minster") == ["The Red Bolt", "Big Ring", "Then Paris", "Ulm Minster"]
    assert found("we met Élan  Vital at Jean-Luc's") == ["Élan", "Vital", "Jean-Luc's"]
    assert found("") == found("Paris") == found("no names here") == []


def test_links_without_prepared_spans(spark):
    pages = spark.createDataFrame(
        [("concepts/red-bolt", "Red Bolt", ["the Bolt"], "active", "concept", 0, "Nothing."), ("entities/acme", "Acme Works", [], "active", "entity", 1, "They sell a red bolt and the bolt, and Acme Works too."), ("entities/new", "New", [], "stub", "entity", 2, "A red bolt.")],
        "page_id string, title string, aliases array<string>, status string, type string, pos int, body string",
    )
    bag = lambda c: tx.char_bag(c)
    vectors = pages.select("page_id", bag(F.col("body")).alias("v"))
    linked, found = linking.link_all(pages, None, linking.alias_table(pages), vectors, bag)
    bodies = {r.page_id: r.body for r in linked.collect()}
    assert bodies["entities/acme"] == "They sell a [[concepts/red-bolt|red bolt]] and the bolt, and Acme Works too."
    assert bodies["entities/new"] == "A red bolt."
    assert {(r.text, r.action) for r in found.collect() if r.page_id == "entities/acme"} >= {("red bolt", "link"), ("the bolt", "again"), ("Acme Works", "self")}


def test_plan_of_resolution(spark, tmp_path):
    """On stored inputs, from spans to decisions."""
    pages = spark.createDataFrame([("a", "Red Bolt", ["bolt"], "active", "concept", 0, "x")], "page_id string, title string, aliases array<string>, status string, type string, pos int, body string")
    pages.write.parquet(f"{tmp_path}/pages")
    pages = spark.read.parquet(f"{tmp_path}/pages")
    spark.createDataFrame([("a", "red bolt", "ORG", 0, 3, 0, "red bolt"), ("a", "red bult", "ORG", 9, 12, 0, "red bolt")], "page_id string, text string, label string, start int, end int, pos int, context string").write.parquet(f"{tmp_path}/spans")
    linking.alias_table(pages).write.parquet(f"{tmp_path}/aliases")
    spans, aliases = (spark.read.parquet(f"{tmp_path}/{x}") for x in ("spans", "aliases"))
    found = linking.decided(linking.resolved(spans, aliases, pages.select("page_id", tx.char_bag(F.col("body")).alias("v")), tx.char_bag))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"\bExchange ", plan)) < 15 and len(re.findall(r"Scan parquet", plan)) < 12


def test_automata_are_not_made_for_every_task_of_every_part(spark):
    """Parts of names times groups of bodies stay about as many as tasks."""
    aliases, bodies = made(40, 2)
    pages = spark.createDataFrame([(f"p{i}", b) for i, b in enumerate(bodies)], "page_id string, body string")
    plan = linking.mentions(pages, spark.createDataFrame(aliases, "alias string, label string"), 60)._jdf.queryExecution().executedPlan().toString()
    dealt = [int(n) for n in re.findall(r"hashpartitioning\(part#\d+, group#\d+, (\d+)\)", plan)]
    total = sum(len(a) for a, _ in aliases)
    assert dealt and max(dealt) <= -(-total // 60) + int(spark.conf.get("spark.sql.shuffle.partitions"))


@pytest.mark.parametrize("frequent", [256, 2])
def test_spans_of_a_frequent_text_are_not_put_into_one_task(spark, monkeypatch, frequent):
    """All texts, or the two most frequent ones, are sent to their spans, whatever joins are usual."""
    pages = spark.createDataFrame([(f"p{i}", f"Red Bolt {i}", ["bolt"], "active", "concept", i, "ab" * i) for i in range(5)], "page_id string, title string, aliases array<string>, status string, type string, pos int, body string")
    texts = ["red bult 1"] * 20 + ["bolt"] * 10 + ["red balt 2", "nothing alike", "Red Bolt 3"]
    spans = spark.createDataFrame([(f"p{i % 5}", x, "ORG", i, i + len(x), 0, "abcd"[: i % 5]) for i, x in enumerate(texts)], "page_id string, text string, label string, start int, end int, pos int, context string")
    find = lambda: linking.resolved(spans, linking.alias_table(pages), pages.select("page_id", tx.char_bag(F.col("body")).alias("v")), tx.char_bag)
    want = sorted(find().collect(), key=repr)
    monkeypatch.setattr(linking, "FREQUENT", frequent)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        found = find()
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and (frequent == 2 or "hashpartitioning(k" not in plan)
        assert sorted(found.collect(), key=repr) == want and len(want) == len(texts)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_bags_of_odd_texts(spark):
    texts = ["", "abc ABC", "\u00e9t\u00e9 \U0001f600", "\x00\x01a", "012345678\n\t", "\u0130"]
    plain = lambda x: [sum(ord(c) % 8 == d for c in x) for d in range(8)]
    rows = spark.createDataFrame([(x,) for x in texts], "x string").select(F.lower("x").alias("x"), tx.char_bag(F.col("x")).alias("v")).collect()
    for x, v in rows:
        n = sum(c * c for c in plain(x)) ** 0.5 or 1.0
        assert v == pytest.approx([c / n for c in plain(x)])


def test_stubs_take_each_slugs_first_place(spark):
    rows = [("b", "New Thing", "ORG", 5, 0, "open"), ("a", "new thing", "CONCEPT", 9, 0, "open"), ("a", "New  Thing", "ORG", 9, 1, "open"), ("a", "x", "ORG", 1, 0, "open"), ("a", "New Thing", "ORG", 1, 0, "link"), ("c", "!", "ORG", 1, 0, "open")]
    found = spark.createDataFrame(rows, "page_id string, text string, label string, start int, pos int, action string")
    stubs = linking.stubs(found, spark.createDataFrame([("entities/x",)], "page_id string"), F.lit("2024-01-01").cast("timestamp"))
    assert [(r.page_id, r.title, r.type) for r in stubs.collect()] == [("concepts/new-thing", "new thing", "concept")]
    assert "Window" not in stubs._jdf.queryExecution().executedPlan().toString()
