import random

import corpus_pipeline
from tessarium.llm import near_copies, quality_rules, secret_scan, simhash

TABLE = "/root/testdata/sf0.001"


def test_stages_and_run(spark):
    docs = spark.read.parquet(f"{TABLE}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "simhash near-dedup", "substring dedup", "secret scan", "best-fit packing"]
    seen = [docs]
    for _, stage in corpus_pipeline.STAGES:
        seen.append(stage(spark, seen[-1], TABLE).cache())
    assert all(s.columns == docs.columns for s in seen[:-1])
    kept = {r.doc_id for r in quality_rules.judged(docs).collect() if r._kept}
    assert {r.doc_id for r in seen[1].collect()} == kept
    ids = [{r.doc_id for r in s.select("doc_id").collect()} for s in seen]
    assert all(b <= a for a, b in zip(ids, ids[1:])) and ids[3] == ids[4] == ids[5]
    assert not any(secret_scan.base_spans(r.text) for r in seen[4].collect())
    assert corpus_pipeline.run(spark, TABLE).count() == seen[-1].count()


def near_copies_by_hand(texts: list) -> set:
    """Places of the first text of each component of pairs of similarity 0.8."""
    sets = []
    for text in texts:
        words = (text or "").encode().lower().split()
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    label = list(range(len(sets)))
    for _ in sets:
        for i, a in enumerate(sets):
            label[i] = min(label[j] for j, b in enumerate(sets) if a == b or len(a & b) >= 0.8 * len(a | b))
            label[i] = label[label[i]]
    return {i for i, x in enumerate(label) if i == x}


def test_near_dedup_joins_all_pairs_of_similarity_08(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "BLOCK", 8)
    r = random.Random(8)
    texts = [None, "", "one", "One", "a b c d"]
    for _ in range(8):
        base = [f"w{r.randrange(9999)}" for _ in range(r.choice([40, 120, 300]))]
        texts.append(" ".join(base))
        for _ in range(14):
            copy = list(base)
            for at in r.sample(range(len(copy)), max(1, len(copy) * r.randrange(1, 5) // 100)):
                copy[at] = f"x{r.randrange(9999)}"
            texts.append(" ".join(copy))
    r.shuffle(texts)
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    want = near_copies_by_hand(texts)
    assert {x.doc_id for x in corpus_pipeline.near_dedup(spark, docs, TABLE).collect()} == want
    # op4's fingerprints within 4 bits join fewer of them
    assert simhash.near_duplicates(docs).where("doc_id = component_id").count() > len(want)


def test_rows_of_equal_or_null_doc_id_stay_apart(spark):
    r = random.Random(11)
    prose = lambda: " ".join(f"w{r.randrange(9999)}" for _ in range(60))
    copied, named = prose(), [prose() for _ in range(3)]
    nameless = [prose() for _ in range(4)]
    rows = [(5, named[0], "en", "a"), (5, named[1], "fr", "b"), (5, named[1], "fr", "b"), (2, copied, "en", "c"), (5, copied + " more", "de", "d"), (9, named[2], "en", "e")]
    rows += [(None, t, "en", f"n{i}") for i, t in enumerate(nameless)] + [(None, nameless[0] + " more", "en", "n9"), (None, None, "en", "f"), (None, named[2], "en", "g")]
    docs = spark.createDataFrame([(*x, len(x[1] or "")) for x in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.near_dedup(spark, docs, TABLE).cache()
    found = [(x.doc_id, x.text) for x in kept.collect()]
    texts = [t for i, t in found if i is None]
    assert sorted(((i, t) for i, t in found if i is not None)) == sorted([(5, named[0]), (5, named[1]), (2, copied), (9, named[2])])
    assert len(texts) == 5 and None in texts and set(nameless[1:]) < set(texts) and len({nameless[0], nameless[0] + " more"} & set(texts)) == 1
    # the stages after it give each row its own text, language and source, once
    key = lambda t: sorted(map(repr, t.select("doc_id", "text", "lang", "source", "n_chars").collect()))
    rest = key(kept.where("text IS NOT NULL"))
    assert key(corpus_pipeline.substring_dedup(spark, kept, TABLE)) == rest and key(corpus_pipeline.secrets(spark, kept.where("text IS NOT NULL"), TABLE)) == rest


def test_stages_of_empty_tables_and_of_other_columns(spark, tmp_path):
    """Empty tables stay empty; columns of other names, some of which the operators use within, change nothing."""
    import corpus_pipeline

    schema = "doc_id long, text string, lang string, source string, n_chars long"
    words = " ".join(f"the w{i}" for i in range(40))
    rows = [(1, f"the and of to {words}.", "en", "s", 9), (2, None, None, None, None), (None, f"the and of to in {words} end.", "en", None, 9), (3, "", "en", "s", 0), (4, "x " * 400, "en", "s", 800)]
    plain = spark.createDataFrame(rows, schema)
    other = plain.selectExpr("*", "'a' AS node", "1 AS row", "array(1) AS keys", "2 AS _row", "'z' AS _kept", "3 AS spans", "4 AS score")
    for _, stage in corpus_pipeline.STAGES:
        assert not stage(spark, plain.where("false"), "").collect()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        a, b = (sorted(map(tuple, stage(spark, d, "").collect()), key=repr) for d in (plain, other))
        assert a == b and stage(spark, other, "").columns == list(corpus_pipeline.COLUMNS), name


def test_near_dedup_takes_candidates_from_fingerprints(spark, monkeypatch):
    r = random.Random(5)
    base = [f"w{r.randrange(9999)}" for _ in range(900)]
    texts = [" ".join(base), " ".join([*base[:-1], "other"]), " ".join(f"w{r.randrange(9999)}" for _ in range(900)), "", None]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    assert (simhash.fingerprint(texts[0], 5) ^ simhash.fingerprint(texts[1], 5)).bit_count() <= 4
    # without MinHash keys the fingerprints alone find the copy
    monkeypatch.setattr(near_copies, "candidates", lambda nodes: spark.createDataFrame([], "a binary, b binary"))
    assert {x.doc_id for x in corpus_pipeline.near_dedup(spark, docs, TABLE).collect()} == {0, 2, 3}
