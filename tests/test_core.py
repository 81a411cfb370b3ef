"""Operators of the page collection on small tables, and all registered queries against their SQL."""

import random
import sqlite3

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessarium import registry
from tessarium.functions import fuzzy
from tessarium.functions import text as tx
from tessarium.functions import markdown
from tessarium.operators import chunks, duplicates, events, lifecycle, linking, links, retrieval, search
from tessarium.plans import tables
from tessarium.sources import readers, sinks, versions
from tessarium.streaming import incremental

TABLE = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{TABLE}/{t}.parquet'")
    return con


def plain(pdf):
    pdf = pdf[sorted(pdf.columns)]
    value = lambda v: None if v is None or pd.isna(v) else round(v, 5) if isinstance(v, float) else float(v) if isinstance(v, int) and not isinstance(v, bool) else str(v)
    return sorted((tuple(value(v.item() if hasattr(v, "item") else v) for v in r) for r in pdf.itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    found = registry.QUERIES[name](spark, TABLE).toPandas()
    if name in registry.SQL:
        want = duck.sql(registry.SQL[name]).df()
        assert sorted(found.columns) == sorted(want.columns) and plain(found) == plain(want)


def test_similar_pairs_of_all_labels(spark):
    one, all_ = ({(r.a, r.b) for r in registry.QUERIES[name](spark, TABLE.replace("0.001", "0.01")).collect()} for name in ("dup_pairs_cosine", "dup_pairs_cosine_all"))
    assert one < all_ and len(all_) > 5 * len(one)


def test_shortlist_takes_whole_names(spark):
    aliases = spark.createDataFrame([("new zealand", 7), ("new york", 8)], "alias string, page_id int")
    found = {r.page_id: r.score for r in linking.shortlist(spark.createDataFrame([("NEW ZEALAND",)], "text string"), aliases, 5, 40.0).collect()}
    assert found[7] == 100 and found.get(8, 0) < 100


@pytest.mark.parametrize("threshold", [40.0, 60.0, 80.0, 95.0, 100.0])
def test_near_texts_lose_no_similar_pair(spark, threshold):
    r = random.Random(2)
    names = sorted({"".join(r.choice("abcde-") for _ in range(r.randrange(1, 14))) for _ in range(120)} | {"red-bolt", "red-bolts", "red-steel-bolt", "ed-bolt", "x"})
    table = spark.createDataFrame([(n,) for n in names], "a string")
    found = {tuple(x) for x in duplicates.near_texts(table, table.withColumnRenamed("a", "b"), threshold).collect()}
    assert {(a, b) for a in names for b in names if fuzzy.similarity(a, b) >= threshold} <= found
    with pytest.raises(ValueError):
        duplicates.near_texts(table, table, 0.0)


def test_stemmed_search_equals_a_full_text_index(spark):
    """Four fields, stems and a phrase, against SQLite's own index."""
    r = random.Random(4)
    words = "account accounts accounting running runs ran policy policies étre Étre hopeful hope relational jp morgan conflated the of nation national".split()
    text = lambda n: " ".join(r.choice(words) + r.choice(["", "", ",", "."]) for _ in range(n))
    rows = [(i, f"concepts/{r.choice(words)}-{i}", text(3), text(6), text(r.randrange(2, 60)) + " jp-morgan " * (i % 5 == 0)) for i in range(80)] + [(99, None, None, "", None)]
    asked = [(1, "What about running accounts?"), (2, "jp-morgan policies"), (3, "étre relational relational"), (4, "the of"), (5, "  "), (6, "concepts national")]
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE f USING fts5(a, b, c, d, tokenize='porter ascii')")
    con.executemany("INSERT INTO f(rowid, a, b, c, d) VALUES (?, ?, ?, ?, ?)", rows)
    match = {1: '"running" OR "accounts"', 2: '"jp-morgan" OR "policies"', 3: '"étre" OR "relational" OR "relational"', 6: '"concepts" OR "national"'}
    # "about" is no stop word
    match[1] = '"about" OR ' + match[1]
    want = {(q, i): -s for q, m in match.items() for i, s in con.execute("SELECT rowid, rank FROM f WHERE f MATCH ?", (m,))}
    docs = spark.createDataFrame(rows, "id int, a string, b string, c string, d string")
    queries = spark.createDataFrame(asked, "query_id int, question string")
    for more in ({}, {"index": search.postings(docs, "id", ("a", "b", "c", "d"), True)}):
        found = {(x.query_id, x.doc): x.score for x in search.bm25(docs, queries, 200, doc="id", fields=("a", "b", "c", "d"), stem=True, **more).collect()}
        assert found.keys() == want.keys() and all(abs(found[k] - want[k]) < 1e-9 for k in want)


def test_similarity_is_by_common_subsequences():
    def slow(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
            row = new
        return row[-1]

    r = random.Random(0)
    for _ in range(300):
        a, b = ("".join(r.choice("abc-") for _ in range(r.randrange(12))) for _ in range(2))
        assert fuzzy.common_subsequence(a, b) == slow(a, b)


def test_text_functions(spark):
    row = spark.range(1).select(
        tx.slug(F.lit("  Élan  Vital_x! ")).alias("slug"), tx.wikilinks(F.lit("[[a|b]] and [[c d]]")).alias("links"), tx.strip_link(F.lit("see [[a|B]] [[a]]"), F.lit("a")).alias("stripped"),
        tx.retarget_links(F.lit("[[old|x]] [[old]] [[older]]"), F.lit("old"), F.lit("new")).alias("moved"), tx.first_heading(F.lit("text\n## Head ##\n")).alias("heading"),
        tx.is_plural(F.lit("city"), F.lit("cities")).alias("plural"), tx.drops_token(F.lit("a-b"), F.lit("a-x-b")).alias("drops"), tx.unfenced(F.lit("```json\n{}\n```")).alias("json"),
    ).first()
    assert (row.slug, row.links, row.stripped, row.moved, row.heading) == ("élan-vital-x", ["a", "c d"], "see B a", "[[new|x]] [[new]] [[older]]", "Head")
    assert row.plural and row.drops and row.json == "{}"


def test_ranges_and_links(spark):
    ranges = spark.createDataFrame([([(5, 9), (0, 3), (2, 4)],)], "r array<struct<s:int,e:int>>").select(linking.merged_ranges(F.col("r")).alias("m"))
    row = ranges.select("m", linking.free_ranges(F.col("m"), F.lit(12)).alias("free")).first()
    assert [tuple(x) for x in row.m] == [(0, 4), (5, 9)] and [tuple(x) for x in row.free] == [(4, 5), (9, 12)]
    body = spark.createDataFrame([("abc def", [(0, 3, "x"), (4, 7, "y")])], "body string, s array<struct<start:int,end:int,target:string>>")
    assert body.select(linking.insert_links(F.col("body"), F.col("s"))).first()[0] == "[[x|abc]] [[y|def]]"


PAGE = "page_id string, title string, body string, status string, aliases array<string>, source_count int"


def test_merge_moves_links_and_retires_the_loser(spark):
    rows = [("a", "A", "one\n", "active", ["x"], 1), ("b", "B", "two", "active", ["X", "y"], 2), ("c", "C", "see [[b]] and [[b|it]]", "active", [], 0), ("d", "D", "  ", "active", None, None), ("e", "E", "[[b]]", "deprecated", [], 0)]
    pages = spark.createDataFrame(rows, PAGE).withColumn("superseded_by", F.when(F.col("page_id") == "e", "a"))
    pairs = spark.createDataFrame([("a", "b"), ("b", "d")], "winner string, loser string")
    found = {r.page_id: r for r in lifecycle.merge(pages, pairs).collect()}
    assert found["a"].body == 'one\n\n<!-- merged from page: B -->\n## Merged content from "B"\n\ntwo\n' and found["a"].aliases == ["x", "y", "B", "D"] and found["a"].source_count == 3
    assert found["b"].status == found["d"].status == "deprecated" and found["b"].superseded_by == found["d"].superseded_by == "a"
    assert found["c"].body == "see [[a]] and [[a|it]]" and found["e"].body == "[[b]]" and found["e"].superseded_by == "a"


@pytest.mark.parametrize("pairs", [[("a", "a")], [("z", "a")], [("a", "z")], [("a", "e")], [("a", "b"), ("c", "b")], [("a", "b"), ("b", "a")], [("a", "b"), ("b", "c"), ("c", "a")]])
def test_merges_that_are_refused(spark, pairs):
    pages = spark.createDataFrame([(p, p, p, "deprecated" if p == "e" else "active", [], 0) for p in "abcde"], PAGE)
    with pytest.raises(ValueError):
        lifecycle.merge(pages, spark.createDataFrame(pairs, "winner string, loser string"))


def test_page_writes_with_force_keep_the_human_region(spark):
    schema = "page_id string, title string, type string, status string, summary string, body string, confidence string, created timestamp, modified timestamp, promoted boolean"
    pages = spark.createDataFrame([("concepts/a", "A", "concept", "dormant", "s", f"mine\n\n{tx.AUTO_MARKER}\n\nold\n", "low", None, None, False)], schema)
    asked = [(1, "create", "concept", "a", "New", None, "fresh"), (2, "create", "concept", "b", "B", None, "# h\n\nfirst"), (3, "create", "concept", "b", "B2", None, "second"), (4, "update", None, None, None, "concepts/a.md", "more"), (5, "update", None, None, None, "concepts/b", "even"), (6, "update", None, None, None, "missing-page", "one"), (7, "update", None, None, None, "/wiki/missing-page.md", "two"), (8, "create", "odd", "c", "C", None, "x")]
    proposals = spark.createDataFrame([(*x, "high") for x in asked], "pos int, intent string, type string, slug string, title string, path string, body string, confidence string")
    now, m = F.lit("2024-01-01").cast("timestamp"), tx.AUTO_MARKER
    plain_ = {r.page_id: r for r in lifecycle.write_pages(pages, proposals, now).collect()}
    assert plain_["concepts/a"].body == f"mine\n\n{m}\n\nold\n\nmore" and plain_["concepts/a"].status == "active" and plain_["concepts/a"].outcome == "updated"
    assert plain_["concepts/b"].body == f"\n\n{m}\n\n# h\n\nfirst\n\neven" and plain_["concepts/b"].summary == "first" and plain_["concepts/b"].outcome == "created"
    assert plain_["concepts/missing-page"].title == "Missing Page" and plain_["concepts/missing-page"].promoted and plain_["concepts/missing-page"].body == f"\n\n{m}\n\none\n\ntwo" and len(plain_) == 3
    forced = {r.page_id: r for r in lifecycle.write_pages(pages, proposals, now, force=True).collect()}
    assert forced["concepts/a"].body == f"mine\n\n{m}\n\nfresh\n\nmore" and forced["concepts/a"].title == "New" and forced["concepts/b"].title == "B2" and forced["concepts/b"].body.endswith("second\n\neven")


def test_safe_ranges_of_all_kinds():
    kinds = ["```\ncode\n```", "~~~\ncode\n~~~", "`code`", "[[a|b]]", "[x](http://y)", "[x][y]", "[x]: http://y z", "https://a.b/c", "<!-- c -->", "<PRE class=a>x</pre>", "## head"]
    for kind in kinds:
        body = f"before\n{kind}\nafter"
        assert "".join(body[a:b] for a, b in markdown.safe_of(body)) == "before\n\nafter", kind
    assert markdown.safe_of("") == [] and markdown.links_of("`[[a]]` é [[ b ]] [[c|d]] [[self]]", "self") == [("b", "é"), ("c", "é [[ b ]]")]


def test_mentions_take_the_longest_name(spark):
    pages = spark.createDataFrame([("p", "A Red Bolt kit, the red\nbolt; élan vital.")], "page_id string, body string")
    aliases = spark.createDataFrame([("red bolt", "CONCEPT"), ("red bolt kit", "ORG"), ("Élan Vital", "CONCEPT"), ("bolt", "CONCEPT")], "alias string, label string")
    assert [(r.text, r.label) for r in linking.mentions(pages, aliases).orderBy("start").collect()] == [("Red Bolt kit", "ORG"), ("bolt", "CONCEPT"), ("élan vital", "CONCEPT")]


def test_blank_questions_and_empty_scopes_find_nothing(spark):
    docs = spark.createDataFrame([(1, "alpha beta", 3, 7, "s", "h", [1.0, 0.0]), (2, None, None, 7, None, None, None), (3, "beta", 1, 8, None, None, [0.0, 0.0])], "chunk_id long, text string, tokens int, page_id long, source_path string, heading string, v array<double>")
    asked = spark.createDataFrame([(1, "beta"), (2, " \u00a0"), (3, "the of")], "query_id long, question string")
    vectors = spark.createDataFrame([(1, [0.5, 0.5]), (2, [1.0, 0.0])], "id long, v array<double>")
    bridge = docs.select("chunk_id", "page_id")
    assert {r.query_id for r in retrieval.search_chunks(docs, asked, vectors, 5).collect()} == {1}
    assert retrieval.search_chunks(docs, asked, vectors, 0).count() == 0
    assert retrieval.search_chunks(docs, asked, vectors, 5, bridge.select("page_id").limit(0), bridge).count() == 0
    scoped = retrieval.search_chunks(docs, asked, vectors, 5, bridge.where("page_id = 8").select("page_id"), bridge)
    assert [(r.query_id, r.chunk_id) for r in scoped.collect()] == [(1, 3)]
    with pytest.raises(ValueError):
        retrieval.checked(retrieval.Fingerprint("a", "m", 3), retrieval.Fingerprint("a", "n", 3))
    with pytest.raises(ValueError):
        retrieval.checked(retrieval.Fingerprint("a", "m", 3), retrieval.Fingerprint("a", "m", 4))


def test_tools(spark):
    sf = TABLE
    tools = retrieval.Tools(tables.routes(spark, sf).withColumn("body", F.lit("b")), tables.chunks(spark, sf), tables.bridge(spark, sf), tables.edges(spark, sf), stem=False)
    vectors = tables.read(spark, sf, "embeddings").where("vec_id < 3").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    asked = tables.read(spark, sf, "benchmark").where("item_id < 3").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    assert tools.search_pages(vectors).groupBy("query_id").count().agg(F.max("count")).first()[0] == 5 and tools.search_chunks(asked, vectors).agg(F.max("rank")).first()[0] <= 10
    pages, found = tools.get_context(asked, vectors, 50)
    assert pages.count() == 15 and found.where("rank > 1 AND run > 50").count() == 0 and found.count() >= 1
    assert [r.page_id for r in tools.get_pages([5, -1]).collect()] == [5] and [r.chunk_id for r in tools.get_chunks([7, -1]).collect()] == [7]
    node = tables.edges(spark, sf).first()
    assert tools.get_outbound_links(node.src).count() >= 1 and 1 <= tools.get_backlinks(node.dst, 2).count() <= 2


def test_paths(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (5, 3)], "src long, dst long")
    assert {tuple(r) for r in links.path_lengths(edges, 1, 3).collect()} == {(1, 0), (2, 1), (3, 2), (5, 3)}


def test_path_and_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (5, 3), (8, 9), (9, 8), (7, 6)], "src long, dst long")
    assert links.path(edges, 1, 5) == [1, 2, 3, 5] and links.path(edges, 1, 8) is None and links.path(edges, 8, 8) == [8] and links.path(edges, 4, 4) is None
    assert {tuple(r) for r in links.components(edges).collect()} == {(1, 1), (2, 1), (3, 1), (5, 1), (8, 8), (9, 8), (6, 6), (7, 6)}


def test_event_log(spark):
    lines = ["# Log", "", "## [2024-01-02T03:04:05Z] ingest | first | part", "- **Tokens used**: 1,234", "- **Cost**: $0.25", "- **Cost**: $0.50", "- plain", "", "## [2024-01-03T00:00:00Z] lint | second", "- **Created**: a, b"]
    found = events.parsed(spark.createDataFrame([("f", i, x) for i, x in enumerate(lines)], "file string, pos int, line string")).collect()
    assert [(r.event_type, r.description, r.tokens_used, r.cost, r.created) for r in found] == [("lint", "second", None, None, "a, b"), ("ingest", "first | part", 1234, 0.5, None)]


def test_chunks_by_sections_pages_and_paragraphs():
    assert chunks.split("short", None, 10, 2, "\n\n") == [("short", None)]
    text = "# One\n" + "a" * 80 + "\n## Two ##\n" + "b" * 80
    assert [h for _, h in chunks.split(text, None, 30, 2, "\n\n")] == ["One", "Two"]
    assert [t for t, _ in chunks.split("x" * 400, ["p" * 40, "q" * 40, "r" * 40], 20, 2, "\n\n")] == ["p" * 40 + "\n\n" + "q" * 40, "q" * 40 + "\n\n" + "r" * 40]
    r = random.Random(3)
    for _ in range(200):
        sizes, budget, overlap = [r.randrange(1, 9) for _ in range(r.randrange(1, 40))], r.randrange(4, 20), r.randrange(0, 10)
        groups = chunks.grouped(["x" * 4 * n for n in sizes], budget, overlap)
        assert all(sum(len(b) // 4 for b in g) <= budget or len(g) == 1 or sum(len(b) // 4 for b in g[:-1]) <= overlap for g in groups)
        assert sum(map(len, groups)) >= len(sizes)


def test_readers(spark, tmp_path):
    (tmp_path / "concepts").mkdir()
    (tmp_path / "concepts/a.md").write_text("---\ntitle: 'A'\ntags: [x, y]\n---\nBody [[b]]\n")
    (tmp_path / "index.md").write_text("index")
    (tmp_path / "x.py").write_text("print(1)")
    (tmp_path / "x.html").write_text("<h1>T</h1><script>no</script><p>Text</p>")
    pages = readers.front_matter(readers.page_files(spark, str(tmp_path)))
    row = pages.select("page_id", readers.header_field(F.col("header"), "title").alias("title"), readers.header_list(F.col("header"), "tags").alias("tags"), "body").first()
    assert tuple(row) == ("concepts/a", "A", ["x", "y"], "Body [[b]]\n")
    texts = {r.path.rsplit("/", 1)[-1]: r.text for r in readers.extract(readers.files(spark, str(tmp_path))).collect()}
    assert texts["x.py"].startswith("[File: x.py | Language: Python]") and "no" not in texts["x.html"].split() and "Text" in texts["x.html"]


def test_web_pages_keep_tables_and_links():
    html = "<nav>no</nav><h2>T</h2><p>A <a href='/x'>link</a> and <b>bold</b>.</p><!-- no --><table><tr><th>a</th><th>b|c</th></tr><tr><td>1</td><td>2</td></tr></table>"
    assert readers.web_text(html) == "## T\n\nA [link](/x) and **bold**.\n\n| a | b\\|c |\n|---|---|\n| 1 | 2 |"


def test_stored_files(spark, tmp_path):
    (tmp_path / "links.json").write_text('{"updated_at": "u", "links": {"a": {"outbound": [{"to": "b", "context": "c"}, {"to": "b"}, {"to": ""}, {"context": "x"}]}}}')
    assert [tuple(r) for r in readers.edge_file(spark, str(tmp_path / "links.json")).collect()] == [("a", "b", "c", "u")]
    (tmp_path / "p1.json").write_text('[{"source_page": "a", "score": 3}]')
    (tmp_path / "p2.json").write_text('{"pending": [{"source_page": "b", "cosine_score": 0.5, "odd": 1}]}')
    (tmp_path / "p3.json").write_text("nothing")
    assert [[r.source_page for r in readers.pending(spark, str(tmp_path / f"p{i}.json")).collect()] for i in (1, 2, 3)] == [["a"], ["b"], []]
    (tmp_path / "h.json").write_text('{"entries": [{"query_id": "q1", "question": "x", "odd": 1}, {"query_id": "q2"}]}')
    (tmp_path / "old.json").write_text('{"question": "x", "timestamp": "t"}')
    assert [r.query_id for r in readers.history(spark, str(tmp_path / "h.json")).collect()] == ["q1", "q2"] and len(readers.history(spark, str(tmp_path / "old.json")).first().query_id) == 10
    (tmp_path / "s.json").write_text('{"sources": {"h1": {"name": "n", "pages_produced": ["p"]}}}')
    assert readers.catalog(spark, str(tmp_path / "s.json")).first().ingest_count == 1
    (tmp_path / "batch").mkdir()
    for name in ("b.md", "a.md", ".hidden"):
        (tmp_path / "batch" / name).write_text("x")
    assert [r.path.rsplit("/", 1)[-1] for r in readers.batch_folder(spark, str(tmp_path / "batch")).collect()] == ["a.md", "b.md"]
    (tmp_path / "list.txt").write_text("# no\n\n a \nb\n")
    assert [r.source for r in readers.batch_list(spark, str(tmp_path / "list.txt")).collect()] == ["a", "b"]


def test_pages_written_and_read_again(spark, tmp_path):
    rows = [("concepts/a", "A: \"quoted\"", "active", ["x", "ý"], "Body\n---\nmore", 2), ("entities/b", "B", "stub", [], "", 0)]
    pages = spark.createDataFrame(rows, "page_id string, title string, status string, aliases array<string>, body string, source_count int")
    assert len(sinks.write_pages(pages, str(tmp_path / "w"))) == 2
    found = {r.page_id: r for r in readers.read_headers(readers.page_files(spark, str(tmp_path / "w"))).collect()}
    assert {p: (r.header.title, r.header.status, r.header.aliases, r.body, r.header.source_count) for p, r in found.items()} == {r[0]: r[1:] for r in rows}
    assert readers.parsed_header("---\n- a\n---\nx")[0] is None and readers.parsed_header("no header") == (None, "no header")
    indexed = pages.withColumns({"summary": F.lit("s|t"), "modified": F.lit("2024-01-02").cast("timestamp"), "inbound": F.lit(1)})
    assert len(sinks.write_indexes(indexed, str(tmp_path / "w"))) == 3 and "| [B](b.md) | s\\|t | 2024-01-02 | 0 | 1 |" in (tmp_path / "w/entities/index.md").read_text()
    assert "## Entities (1 pages)" in (tmp_path / "w/index.md").read_text()


def test_tables_are_replaced_whole(spark, tmp_path):
    for n in (3, 2):
        sinks.replace_table(spark.range(n), str(tmp_path / "t"))
        assert spark.read.parquet(str(tmp_path / "t")).count() == n
    assert [p.name for p in tmp_path.iterdir()] == ["t"]
    sinks.export_json(spark.range(3), "id", str(tmp_path / "j"))
    parts = sorted((tmp_path / "j").glob("part-*"))
    assert "".join(p.read_text() for p in parts).split() == [f'{{"id":{i}}}' for i in range(3)]


def test_failing_embedders_leave_null_vectors(spark):
    def make():
        def embed(texts):
            if any("bad" in x for x in texts):
                raise RuntimeError
            return [[float(len(x))] for x in texts]

        return embed

    rows = spark.createDataFrame([(i, "bad" if i == 5 else "x" * i) for i in range(70)], "id int, text string")
    found = {r.id: r.v for r in sinks.embedded(rows, make).collect()}
    assert found[5] is None and all(found[i] == [float(i)] for i in range(70) if i != 5)


def test_postings_are_refreshed_by_document(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "b c"), (3, "c d")], "doc_id long, text string")
    changed, gone = spark.createDataFrame([(2, "z z")], "doc_id long, text string"), spark.createDataFrame([(3,)], "doc long")
    found = sinks.refreshed_postings(search.postings(docs, stem=True), changed, gone)
    want = search.postings(spark.createDataFrame([(1, "a b"), (2, "z z")], "doc_id long, text string"), stem=True)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))


def test_history_is_found_by_beginning_or_place(spark):
    rows = spark.createDataFrame([("abc1", 1), ("abd2", 2), ("xyz3", 3)], "query_id string, ts long")
    found = {a: [r.query_id for r in lifecycle.history_entry(rows, a).collect()] for a in ("1", "3", "9", "abc", "ab", "x")}
    assert found == {"1": ["xyz3"], "3": ["abc1"], "9": [], "abc": ["abc1"], "ab": [], "x": ["xyz3"]}


def test_streams(spark, tmp_path):
    schema = "k long, v string, n long"
    for i, rows in enumerate(([(1, "a", 1), (2, "b", 1), (2, "late", 0)], [(2, "c", 2), (3, "d", 2)], [])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        # the last one has a new checkpoint: the table stays
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        incremental.sync_to(stream, str(tmp_path / "out"), "k", str(tmp_path / f"ck{i // 2}"), order="n").awaitTermination(60)
    assert sorted((r.k, r.v) for r in versions.Table(spark, str(tmp_path / "out"), "k").rows().collect()) == [(1, "a"), (2, "c"), (3, "d")]


def test_streams_of_sources_spending_and_history(spark, tmp_path):
    for rows in ([("a",), ("b",), ("a",)], [("b",), ("c",)]):
        spark.createDataFrame(rows, "text string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        incremental.new_sources_to(spark.readStream.schema("text string").parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(60)
    assert sorted(r.text for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b", "c"]
    batch = spark.read.parquet(f"{TABLE}/events.parquet")
    batch.repartition(2).write.parquet(str(tmp_path / "events"))
    stream = incremental.event_stream(spark, str(tmp_path / "events"), batch.schema)
    for name, frame, mode in (("daily", incremental.daily_totals(stream), "complete"), ("alarm", incremental.month_alarm(stream, 100.0), "update")):
        frame.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination(60)
    assert spark.table("daily").agg(F.sum("n")).first()[0] == batch.count()
    assert abs(spark.table("alarm").first().cost - batch.agg(F.sum("value")).first()[0]) < 1e-6
    asked = spark.createDataFrame([(1, i, f"q{i}") for i in range(6)] + [(2, 1, "z")], "owner long, ts long, query_id string")
    asked.coalesce(1).write.parquet(str(tmp_path / "asked"))
    ring = incremental.history_ring(spark.readStream.schema(asked.schema).parquet(str(tmp_path / "asked")), 3)
    ring.writeStream.format("memory").queryName("ring").outputMode("update").option("checkpointLocation", str(tmp_path / "ring")).trigger(availableNow=True).start().awaitTermination(60)
    assert {r.owner: r.ring for r in spark.table("ring").collect()} == {1: ["q5", "q4", "q3"], 2: ["z"]}


def test_events_of_the_same_moment_are_logged_once(spark, tmp_path):
    for i in range(3):
        spark.read.parquet(f"{TABLE}/events.parquet").where("event_id < 40").withColumn("event_id", F.col("event_id") + 70 * i).write.mode("append").parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    for name in ("event_log_parse", "event_entries"):
        found = registry.QUERIES[name](spark, str(tmp_path)).toPandas()
        assert len(found) == 120 and plain(found) == plain(con.sql(registry.SQL[name]).df())


@pytest.mark.parametrize("threshold", [40.0, 80.0, 100.0])
def test_similar_texts_are_those_of_all_pairs(spark, monkeypatch, threshold):
    monkeypatch.setattr(duplicates, "BLOCK", 16)
    r = random.Random(4)
    names = sorted({"".join(r.choice("abc-12é 漢") for _ in range(r.randrange(1, 12))) for _ in range(90)} | {f"red-bolt-{i}" for i in range(20)} | {"z" * 70 + "a", "z" * 70 + "b", "a b", "b a"})
    left, right = names[::2] + names[:9], names[5:]
    found = duplicates.similar_texts(spark.createDataFrame([(x,) for x in [*left, "", None]], "a string"), spark.createDataFrame([(x,) for x in [*right, ""]], "b string"), threshold).collect()
    score = lambda a, b: fuzzy.similarity(*(" ".join(sorted(x.split())) for x in (a, b)))
    assert sorted((x.a, x.b, round(x.score, 6)) for x in found) == sorted((a, b, round(score(a, b), 6)) for a in set(left) for b in set(right) if score(a, b) >= threshold)


def test_scopes_by_query_need_no_postings(spark, monkeypatch):
    """Documents are scored as for scopes of all questions, and only those in a question's scope are ranked for it."""
    r = random.Random(7)
    docs = spark.createDataFrame([(i, " ".join(r.choice("red blue bolt gear ring well-known kit".split()) for _ in range(r.randrange(12)))) for i in range(120)], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "red bolt"), (2, "well-known gear kit"), (3, "zzz"), (4, ""), (9, "ring")], "query_id long, question string")
    pairs = [(q, d) for q in (1, 2, 3, 4, 7) for d in range(130) if r.random() < 0.3] * 2
    scope = spark.createDataFrame(pairs, "query_id long, doc long").distinct()
    rows = lambda: {(x.query_id, x.doc): (round(x.score, 9), x["rank"]) for x in search.bm25(docs, asked, 5, scope=scope).collect()}
    with monkeypatch.context() as m:
        m.setattr(search, "SENT", 0)
        want = rows()
    monkeypatch.setattr(search, "postings", lambda *_: pytest.fail("postings"))
    assert rows() == want and {q for q, _ in want} == {1, 2} and set(want) <= set(pairs)


def test_texts_of_contexts_are_read_apart(spark):
    """Words are looked for in texts, not in what chunks hold."""
    chunks = spark.createDataFrame([(i, None, 1, 5, "s", "h", [1.0, float(i)]) for i in range(4)], "chunk_id long, text string, tokens int, page_id long, source_path string, heading string, v array<double>")
    texts = spark.createDataFrame([(i, "red bolt" if i == 2 else "gear") for i in range(4)], "chunk_id long, text string")
    pages = spark.createDataFrame([(5, "t", "concept", "active", "s", [1.0, 0.0])], "page_id long, title string, type string, status string, summary string, v array<double>")
    bridge = chunks.select("chunk_id", "page_id")
    asked, vectors = spark.createDataFrame([(1, "red bolt")], "query_id long, question string"), spark.createDataFrame([(1, [1.0, 0.0])], "id long, v array<double>")
    first = lambda **more: retrieval.get_context(pages, chunks, bridge, asked, vectors, k=1, stem=False, **more)[1].first().chunk_id
    assert first() == 0 and first(texts=texts) == 2
