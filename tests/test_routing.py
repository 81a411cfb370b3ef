"""Proposals routed to existing pages and to earlier ones, against a fold of all of them in order; shortest paths against a plain search."""

import random

import pytest

from tessarium.functions.fuzzy import similarity
from tessarium.operators import lifecycle, links

FOLDERS = {"concept": "concepts", "entity": "entities", "synthesis": "syntheses", "source": "sources"}


def folded(rows: list, known: list[str], threshold: float) -> dict:
    """In order, each against all pages there are by then."""
    score = lambda a, b: similarity(" ".join(sorted(a.split())), " ".join(sorted(b.split())))
    made: list[str] = []
    seen, out = set(), {}
    for pos, kind, slug, _ in sorted(rows, key=lambda r: (r[3], r[0])):
        if (kind, slug) in seen:
            continue
        seen.add((kind, slug))
        folder, hit = FOLDERS.get(kind), None
        if folder and slug:
            id_ = f"{folder}/{slug}"
            found = sorted((-s, p) for p in known if p.split("/")[0] == folder and (s := score(id_, p)) >= threshold)
            best, at = (-found[0][0], found[0][1]) if found else (0.0, None)
            for other in made:
                if other.split("/")[0] == folder and (s := score(id_, other)) >= threshold and s > best:
                    best, at = s, other
            hit = at if at != id_ else None
            if hit is None:
                made.append(id_)
        out[pos] = hit
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_routing_equals_a_fold_in_order(spark, seed):
    r = random.Random(seed)
    stems = ["account-closure-procedure", "payment-terminal-setup", "refund-policy-overview", "x"]

    def slug() -> str:
        x = list(r.choice(stems))
        for _ in range(r.randrange(3)):
            x.insert(r.randrange(len(x) + 1), r.choice("s-e1"))
        return "".join(x)

    rows = [(i, r.choice([*FOLDERS, "nothing"]), r.choice([slug(), slug(), slug(), ""]), r.randrange(20)) for i in range(150)]
    known = list({f"{r.choice(list(FOLDERS.values()))}/{slug()}" for _ in range(25)})
    proposals = spark.createDataFrame(rows, "pos long, type string, slug string, chunk_index int")
    pages = spark.createDataFrame([(k,) for k in known], "page_id string")
    got = lifecycle.routed(proposals, pages)
    assert {x.pos: x.redirect for x in got.collect()} == folded(rows, known, lifecycle.COLLISION)
    assert got.columns == ["pos", "type", "slug", "chunk_index", "redirect"]


def test_routing_of_nothing(spark):
    proposals = spark.createDataFrame([], "pos long, type string, slug string, chunk_index int")
    assert lifecycle.routed(proposals, spark.createDataFrame([], "page_id string")).collect() == []


@pytest.mark.parametrize("depth", [2, 32])
def test_paths_of_many_pairs(spark, depth):
    r = random.Random(5)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(70)] + [(100, 100 + i) for i in range(1, 40)] + [(200, 200)]
    near: dict[int, set] = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    pairs = [(r.randrange(64), r.randrange(64)) for _ in range(150)] + [(101, 139), (100, 3), (5, 5), (200, 200), (999, 999), (1, None), (None, None)]

    def hops(a, b):
        seen, front, n = {a}, {a}, 0
        if a not in near or b not in near:
            return None
        while front and n <= depth:
            if b in front:
                return n
            front = {y for x in front for y in near[x]} - seen
            seen |= front
            n += 1
        return None

    got = links.path_lengths_many(spark.createDataFrame(edges, "src long, dst long"), spark.createDataFrame(pairs * 2, "a long, b long"), depth).collect()
    assert {(x.a, x.b): x.hops for x in got} == {(a, b): hops(a, b) for a, b in pairs} and len(got) == len(set(pairs))


@pytest.mark.parametrize(("hubs", "starts"), [(60, 1024), (2, 3), (0, 5)])
def test_paths_of_groups(spark, monkeypatch, hubs, starts):
    """All pairs of groups, by way of hubs and without them, each once, though a pair stands in several groups; no exchange follows the pairs."""
    monkeypatch.setattr(links, "HUBS", hubs)
    monkeypatch.setattr(links, "STARTS", starts)
    r, depth = random.Random(6), 5
    edges = [(r.randrange(70), r.randrange(70)) for _ in range(75)] + [(100, i) for i in range(0, 40, 2)] + [(101, i) for i in range(30, 60, 3)] + [(200, 200)]
    near: dict[int, set] = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)

    def hops(a):
        seen, front = {a: 0} if a in near else {}, [a] if a in near else []
        for n in range(1, depth + 1):
            front = [y for y in {y for x in front for y in near[x]} if y not in seen]
            seen |= dict.fromkeys(front, n)
        return seen

    sides = [[(r.choice([*range(70), 100, 101, 200, 999, None]), r.choice(["p", "q", "s", None])) for _ in range(90)] + [(200, "p"), (5, "p"), (5, "q")] for _ in "ab"]
    found = links.path_lengths_of_groups(spark.createDataFrame(edges, "src long, dst long"), spark.createDataFrame(sides[0], "a long, group string"), spark.createDataFrame(sides[1], "b long, group string"), depth)
    want = {(a, b): hops(a).get(b) for a, g in sides[0] for b, h in sides[1] if g is not None and g == h}
    got = found.collect()
    assert {(x.a, x.b): x.hops for x in got} == want and len(got) == len(want)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString().split("SortMergeJoin")[0]
