"""Merkle manifest, licence scan and hard negatives against brute force, with nulls, empty and long texts, ties, repeated rows, empty tables and other columns."""

import hashlib
import random
import re
import zlib
from collections import Counter
from itertools import groupby

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessarium.llm import hard_negatives, licenses, merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, leaf string, key string, score double"


def sha(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(value) -> str:
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def tampered(doc, text):
    return text.replace("\n", "") if text is not None and doc is not None and zlib.crc32(str(doc).encode()) % 2 == 0 else text


def expected(rows) -> list[tuple]:
    """By whole levels in lists."""
    leaves = []
    for doc, source, lang, n, text, *_ in rows:
        head = field(doc) + field(source) + field(lang) + field(n)
        leaves.append((source, doc, sha(head, field(text)), sha(head, field(tampered(doc, text)))))
    leaves.sort(key=lambda x: (x[0] is not None, (x[0] or "").encode(), x[1] is not None, x[1] or 0, x[2]))

    def tree(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([sha(*out[-1][i : i + 3]) for i in range(0, len(out[-1]), 3)])
        return out

    def runs(levels, i):
        for level in levels[:-1]:
            yield i % 3, level[i // 3 * 3 : i // 3 * 3 + 3]
            i //= 3

    groups = [list(g) for _, g in groupby(leaves, key=lambda x: x[0])]
    trees = [tree([x[2] for x in g]) for g in groups]
    top = tree([t[-1][0] for t in trees])
    out = []
    for s, (group, own) in enumerate(zip(groups, trees)):
        for i, (_, doc, leaf, other) in enumerate(group):
            path = [*runs(own, i), *runs(top, s)]
            folded = other
            for c, run in path:
                folded = sha(*run[:c], folded, *run[c + 1 :])
            out.append((doc, leaf, own[-1][0], top[-1][0], sha(*(d for c, run in path for j, d in enumerate(run) if j != c)), folded, folded == top[-1][0]))
    return out


def manifest(spark, rows, height=merkle.HEIGHT) -> Counter:
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    found = merkle.manifest(docs, F.when(hit, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text")), height)
    assert found.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return Counter(map(tuple, found.collect()))


def rows_of(n: int, seed: int) -> list[tuple]:
    r = random.Random(seed)
    sources = [None, "", "b", "é", "a" * 300, "hot", "hot", "hot"]
    texts = [None, "", "one\nline", "\n\n", "plain", "x" * 50_000 + "\n"]
    return [(r.choice([None, i, i, i]), r.choice(sources), r.choice([None, "en"]), r.choice([None, i, -1]), r.choice(texts), "l", "k", 0.5) for i in range(n)]


@pytest.mark.parametrize(("nodes", "height"), [(merkle.NODES, merkle.HEIGHT), (4, 1), (4, 2)])
def test_manifest_equals_whole_levels(spark, monkeypatch, nodes, height):
    monkeypatch.setattr(merkle, "NODES", nodes)
    rows = rows_of(120, 3)
    rows += rows[:40] + [rows[0]] * 30
    assert manifest(spark, rows, height) == Counter(expected(rows))


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 28, 81, 82])
def test_manifest_of_small_trees(spark, n):
    one = [(i, "s", "en", 1, f"t\n{i}", "", "", 0.0) for i in range(n)]
    assert manifest(spark, one) == Counter(expected(one))


def test_manifest_of_as_many_sources_as_rows_and_of_none(spark):
    rows = [(i, f"s{i:02}", "en", 1, f"t\n{i}", "", "", 0.0) for i in range(11)]
    assert manifest(spark, rows) == manifest(spark, rows, 1) == Counter(expected(rows))
    assert not manifest(spark, [])


def test_proofs_fold_to_the_root_only_unchanged():
    run = b"".join(hashlib.sha256(bytes([i])).digest() for i in range(3))
    for place in range(3):
        own, path = run[32 * place : 32 * place + 32], merkle.step_of(place, run)
        assert merkle.fold(own, path) == merkle.hashed(run) != merkle.fold(bytes(32), path)
        assert len(merkle.siblings(path)) == 64
    assert merkle.fold(run[:32], merkle.step_of(0, run[:32])) == merkle.hashed(run[:32])


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
NOTICES = {
    "Released under the MIT License.": "mit",
    "Licensed under the Apache License, Version 2.0": "apache-2.0",
    "This work is licensed under the GNU General Public License, version 3.": "gpl,gpl-3.0",
    "Licensed under CC BY-NC 4.0.": "cc-by,cc-by-nc-4.0",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction": "mit",
    "SPDX-License-Identifier: Apache-2.0": "apache-2.0",
    "All rights reserved.": "reserved",
}


def license_rows() -> list:
    r = random.Random(8)
    prose = lambda n: " ".join(r.choice(["under", "the", "license", "version", "2", "public", "all", "é字", "İx", "foo-bar", "cc", "by", "mit", "rights"]) for _ in range(n))
    plain = lambda n: " ".join(r.choice(["alpha", "beta", "Gamma,", "é字"]) for _ in range(n))
    texts = [None, "", " ", "...", "CC BY cc-by Cc\nBy ALL RIGHTS reserved", "K all rights reserved İ", "ccby cc bye xall rights reserved", "general public license " * 500, plain(200_000) + "\nReleased under the MIT License."]
    texts += [plain(40) + "\n" + n + "\n" + plain(r.randrange(50)) for n in NOTICES] + [n.upper() for n in NOTICES] + [prose(300) for _ in range(20)]
    return texts + texts[-1:] * 3


def test_licences_against_plain_lists(spark, monkeypatch):
    monkeypatch.setattr(licenses, "CHUNK", 512)
    texts = license_rows()
    rows = [(None if i == 3 else i, "s", "en", 0, t, "x", "k", 0.5) for i, t in enumerate(texts)]
    found = licenses.scan(spark.createDataFrame(rows, SCHEMA)).collect()
    want = Counter()
    for doc, _, _, _, text, *_ in rows:
        words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        places = {p: [i for i in range(len(words)) if words[i : i + len(p.split())] == p.split()] for p in licenses.PHRASES}
        at = [x for ps in places.values() for x in ps]
        want[doc, len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(licenses.PHRASES[p] for p in places if places[p]))] += 1
    assert Counter(tuple(x)[:6] for x in found) == want
    assert all(0 <= x["score"] <= 1 and set(x["base_labels"].split(",")) - {""} <= set(x["labels"].split(",")) for x in found)


def test_notices_are_found_wherever_they_stand(spark):
    texts = license_rows()
    rows = [(i, "s", "en", 0, t, "x", "k", 0.5) for i, t in enumerate(texts)]
    got = {x["doc_id"]: x for x in licenses.scan(spark.createDataFrame(rows, SCHEMA), spans=True).collect()}
    assert got[8]["labels"] == "mit" and got[8]["notices"][0]["first_word"] == 200_000
    for i, label in enumerate(list(NOTICES.values()) * 2, 9):
        assert got[i]["labels"] == label, texts[i]
    assert not licenses.scan(spark.createDataFrame([], SCHEMA)).collect()


def test_alignments_equal_a_search_of_all_offsets():
    """The index against every offset of every template."""
    r = random.Random(4)
    index = licenses.Index(licenses.TEMPLATES, licenses.PHRASES).weigh(0, {})
    for _ in range(60):
        words = []
        for _ in range(r.randrange(1, 5)):
            notice = list(r.choice(index.lists))
            if r.random() < 0.5:
                notice[r.randrange(len(notice))] = b"changed"
            words += [b"w"] * r.randrange(4, 9) + notice
        _, places, ids = index.scan(b" ".join(words))
        got = {x[0] for x in index.notices(places, ids, 0.7)}
        want = set()
        for t, own in zip(licenses.TEMPLATES, index.lists):
            weight = np.array([index.weight[index.number[w]] for w in own])
            rare = np.isin([index.number[w] for w in own], sorted({index.number[w] for w in own}, key=lambda i: (-index.weight[i], i))[: licenses.ANCHORS])
            for at in range(-len(own), len(words)):
                same = np.array([0 <= at + q < len(words) and words[at + q] == w for q, w in enumerate(own)])
                window = b" " + b" ".join(words[max(at, 0) : at + len(own)]) + b" "
                if weight[same].sum() >= 0.7 * weight.sum() and weight[same & rare].sum() >= 0.7 * weight[rare].sum() and all(f" {p} ".encode() in window for p in t.phrases):
                    want.add(t.label)
        assert want <= got


def negatives(rows, modulus=10) -> list[tuple]:
    whole = [(i, label, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, label, v, *_ in rows if i is not None and label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    score = lambda a, b: sum(x * y for x, y in zip(a, b))
    anchors = {}
    for i, label, v in whole:
        if i % modulus == 0:
            anchors[i] = min(anchors.get(i, (label, v)), (label, v))
    out = []
    for a, (label, v) in anchors.items():
        others = sorted((-score(v, w), i, own) for i, own, w in whole if i != a)
        for s, p, _ in [x for x in others if x[2] == label][:5]:
            held = [x for x in others if x[2] != label and 30 * -s <= 100 * -x[0] <= 90 * -s][:10]
            out += [(a, p, k, x[1], -s, -x[0]) for k, x in enumerate(held, 1)]
    return out


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>, id long, block int, anchor string")


@pytest.mark.parametrize("shape", [(256, 4096, 32), (7, 23, 3)])
def test_hard_negatives(spark, monkeypatch, shape):
    for name, x in zip(("ANCHORS", "ROWS", "DIMS"), shape):
        monkeypatch.setattr(hard_negatives, name, x)
    r = np.random.default_rng(2)
    centres = r.normal(size=(4, 8))
    rows = []
    for i in range(400):
        label = int(r.integers(4)) if i % 3 else 1
        rows.append((i, label, (centres[int(r.integers(4))] + 0.4 * r.normal(size=8)).astype(np.float32).tolist(), 1, 2, "x"))
    rows += [(1000 + i, i % 4, rows[5][2], 1, 2, "x") for i in range(60)]
    rows += [(None, 1, rows[0][2], 1, 2, "x"), (2001, None, rows[0][2], 1, 2, "x"), (2010, 1, None, 1, 2, "x"), (2020, 1, [1.0, None], 1, 2, "x"), (2030, 1, [float("nan")], 1, 2, "x"), (2040, 1, [float("inf")], 1, 2, "x"), (2050, 1, [0.5, 0.25], 1, 2, "x"), (2060, 1, [], 1, 2, "x"), (2070, 9, rows[3][2], 1, 2, "x")]
    got = hard_negatives.mine(vectors(spark, rows), F.col("vec_id") % 10 == 0)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert Counter(map(tuple, got.collect())) == Counter(negatives(rows))


def test_hard_negatives_of_repeated_ids_and_without_anchors(spark):
    r = np.random.default_rng(3)
    rows = [(i // 2, i % 3, r.normal(size=4).astype(np.float32).tolist(), 1, 2, "x") for i in range(80)]
    got = hard_negatives.mine(vectors(spark, rows), F.col("vec_id") % 10 == 0).collect()
    assert Counter(map(tuple, got)) == Counter(negatives(rows))
    assert not hard_negatives.mine(vectors(spark, rows), F.col("vec_id") < 0).collect()
    assert not hard_negatives.mine(vectors(spark, []), F.col("vec_id") % 10 == 0).collect()


def test_products_stay_exact_beyond_floating_point():
    left, right = np.array([[(1 << 30) + 1, 3]]), np.array([[(1 << 25) + 1, 7]])
    assert hard_negatives.multiplied(left, right)[0, 0] == ((1 << 30) + 1) * ((1 << 25) + 1) + 21
