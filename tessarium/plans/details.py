"""Queries of smaller operators over the collection and the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessarium.functions import text as tx
from tessarium.functions import vectors
from tessarium.lineage import folder
from tessarium.operators import duplicates, lifecycle, reports, retrieval
from tessarium.plans import tables as t
from tessarium.plans.collection import _PAIRS, WE, W, _bag, _edges, _with_inbound
from tessarium.plans.queries import query
from tessarium.plans.tables import read
from tessarium.sources import embedders, readers, sinks



def _sources():
    """Sources of pages, with chunk ids among which are empty, null and repeated ones."""
    k = lambda text: F.expr(text)
    source = lambda h, *ids: F.struct(h.alias("hash"), F.concat(F.lit("n "), h).alias("name"), F.lit(None).cast("string").alias("raw_path"), F.lit(None).cast("string").alias("url"), F.array(*ids).alias("chunk_ids"))
    h = k("concat('h', k % 7)")
    two = F.array(source(h, k("concat('c', k)"), k("concat('c', k % 5)"), F.lit("")), source(F.lit("x"), k("concat('c', k % 5)"), k("concat('d', k)")))
    one = F.array(source(h, k("concat('c', k)"), F.lit(None).cast("string")))
    return F.when(F.col("k") % 3 == 0, two).when(F.col("k") % 3 == 1, one).otherwise(F.slice(one, 1, 0))


@query(f"{W} SELECT page_id, CASE k % 3 WHEN 0 THEN 'c' || k || CASE WHEN k % 5 <> k THEN ',c' || k % 5 ELSE '' END || ',d' || k WHEN 1 THEN 'c' || k ELSE '' END AS chunk_ids FROM wiki_")
def page_chunk_ids(spark, sf_dir):
    """Chunk ids of a page's sources, each once and in order."""
    return t.wiki(spark, sf_dir).select("page_id", F.array_join(tx.all_chunk_ids(_sources()), ",").alias("chunk_ids"))


@query(f"{W} SELECT page_id, CASE k % 3 WHEN 2 THEN 'h1:new' WHEN 1 THEN CASE WHEN k % 7 = 1 THEN 'h1:c' || k || '+new' ELSE 'h' || k % 7 || ':c' || k || ' h1:new' END ELSE CASE WHEN k % 7 = 1 THEN 'h1:c' || k || CASE WHEN k % 5 <> k THEN '+c' || k % 5 ELSE '' END || '+new x:c' || k % 5 || '+d' || k ELSE 'h' || k % 7 || ':c' || k || CASE WHEN k % 5 <> k THEN '+c' || k % 5 ELSE '' END || ' x:c' || k % 5 || '+d' || k || ' h1:new' END END AS sources FROM wiki_")
def page_sources_appended(spark, sf_dir):
    """One more source for every page: its chunks join those of the same content, or it stands last."""
    new = F.struct(F.lit("h1").alias("hash"), F.lit("new").alias("name"), F.lit(None).cast("string").alias("raw_path"), F.lit(None).cast("string").alias("url"), F.array(F.lit("new")).alias("chunk_ids"))
    found = lifecycle.appended_source(_sources(), new, F.array(F.lit("new")))
    plain = lambda x: F.array_distinct(F.filter(x, lambda c: c.isNotNull() & (c != "")))
    return t.wiki(spark, sf_dir).select("page_id", F.array_join(F.transform(found, lambda s: F.concat(s["hash"], F.lit(":"), F.array_join(plain(s["chunk_ids"]), "+"))), " ").alias("sources"))


@query(f"{W} SELECT page_id, n_contradictions + CASE WHEN n_contradictions >= 1 THEN 0 ELSE 1 END + 1 AS n FROM wiki_")
def contradictions_added(spark, sf_dir):
    """Equal contradictions count once: of two new ones the first is known to some pages."""
    claim = lambda existing: F.struct(F.lit(existing).alias("existing"), F.lit("new").alias("new"), F.lit("s").alias("source"))
    return t.wiki(spark, sf_dir).select("page_id", F.size(lifecycle.added_contradictions(F.col("contradictions"), F.array(claim("old 1"), claim("other"), claim("other")))).cast("long").alias("n"))


@query("WITH e AS (SELECT user_id AS page_id, event_id AS pos, unnest([event_type, 'c' || event_id % 3, '']) AS c, unnest([0, 1, 2]) AS i FROM events), f AS (SELECT page_id, c, min(pos * 10 + i) AS place FROM e WHERE c <> '' GROUP BY ALL) SELECT page_id, string_agg(c, ',' ORDER BY place) AS chunk_ids FROM f GROUP BY page_id")
def fed_chunk_ids(spark, sf_dir):
    """All chunks that writes feed to a page, in the order in which they came."""
    writes = read(spark, sf_dir, "events").select(F.col("user_id").alias("page_id"), F.col("event_id").alias("pos"), F.array("event_type", F.concat(F.lit("c"), (F.col("event_id") % 3).cast("string")), F.lit("")).alias("chunk_ids"))
    return lifecycle.fed_chunks(writes).select("page_id", F.array_join("chunk_ids", ",").alias("chunk_ids"))


@query("SELECT l_orderkey AS hash, string_agg(DISTINCT p, ',' ORDER BY p) AS paths FROM (SELECT l_orderkey, 'p' || l_partkey AS p FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 25)) GROUP BY 1")
def commit_paths(spark, sf_dir):
    """Of each commit the paths that are still wanted."""
    commits = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("hash")).agg(F.collect_list(F.concat(F.lit("p"), F.col("l_partkey").cast("string"))).alias("paths"))
    wanted = read(spark, sf_dir, "part").where("p_size > 25").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("path"))
    return lifecycle.touched(commits, wanted).select("hash", F.array_join("paths", ",").alias("paths"))


@query("SELECT o_orderkey, CASE WHEN a + b + c = 0 THEN '' ELSE ' [' || array_to_string(list_filter([CASE WHEN a > 0 THEN '+' || a || CASE WHEN a = 1 THEN ' page' ELSE ' pages' END END, CASE WHEN b > 0 THEN '~' || b || CASE WHEN b = 1 THEN ' page' ELSE ' pages' END END, CASE WHEN c > 0 THEN c || CASE WHEN c = 1 THEN ' link' ELSE ' links' END END], lambda x: x IS NOT NULL), ', ') || ']' END AS subject FROM (SELECT o_orderkey, o_orderkey % 3 AS a, o_orderkey % 4 AS b, o_orderkey % 5 AS c FROM orders)")
def ingest_subjects(spark, sf_dir):
    """What commit subjects say of ingests."""
    k = F.col("o_orderkey")
    return read(spark, sf_dir, "orders").select("o_orderkey", tx.ingest_stats(k % 3, k % 4, k % 5).alias("subject"))


@query(f"{W} SELECT page_id, 3 + (k % 2) AS n, '# ' || title || ',## Part A,# Part' || CASE WHEN k % 2 = 1 THEN ',## Last' ELSE '' END AS heads FROM wiki_")
def heading_sections(spark, sf_dir):
    """Parts that begin with a heading of level one or two; deeper headings and such within a line begin none."""
    text = F.concat(F.lit("  \n# "), "title", F.lit("\n\nIntro # no\n## Part A\na\n### Deep\nb\n\n# Part\tB\n"), F.when(F.col("k") % 2 == 1, "## Last").otherwise(""))
    parts = F.transform(tx.sections(text), lambda p: F.regexp_extract(p, r"^(#+ (?:Part A|Part|Last|.*))", 1))
    return t.wiki(spark, sf_dir).select("page_id", F.size(parts).cast("long").alias("n"), F.array_join(F.transform(parts, lambda p: F.regexp_replace(p, "\t.*", "")), ",").alias("heads"))


@query(f"{WE} SELECT src, dst FROM wiki_edges_ WHERE dst = 'concepts/red-bolt' ORDER BY src LIMIT 10")
def tool_backlinks(spark, sf_dir):
    """An agent's look at a page's backlinks, with the default limit."""
    pages = t.wiki(spark, sf_dir)
    return retrieval.Tools(pages, t.chunks(spark, sf_dir), t.bridge(spark, sf_dir), _edges(spark, sf_dir)).get_backlinks("concepts/red-bolt")


@query(f"{WE}, {_PAIRS} SELECT ka, kb, round(combined, 5) AS combined, row_number() OVER (ORDER BY round(combined, 9) DESC, ka, kb)::INT AS rank FROM pair_ QUALIFY rank <= 50")
def dup_pairs_ranked(spark, sf_dir):
    """The fifty pairs that are most alike."""
    found = duplicates.ranked(duplicates.find(_with_inbound(spark, sf_dir), facts=()), 50).select("ka", "kb", "combined")
    return found.selectExpr("ka", "kb", "round(combined, 5) AS combined", "row_number() OVER (ORDER BY round(combined, 9) DESC, ka, kb) AS rank")


@query(f"{WE} SELECT count(*) AS pages, (SELECT count(*) FROM documents) AS chunks, (SELECT count(DISTINCT source) FROM documents) AS sources FROM wiki_")
def status_with_chunks(spark, sf_dir):
    """The status report's counts of chunks and sources."""
    chunks = t.chunks(spark, sf_dir)
    found = reports.statistics(t.wiki(spark, sf_dir), _edges(spark, sf_dir), chunks, chunks.where("source_path IS NOT NULL").select(F.col("source_path").alias("source_hash")))
    return found.select("pages", "chunks", "sources")


@query("SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 6) AS total, 4 * len(embedding) AS bytes FROM embeddings")
def vectors_as_bytes(spark, sf_dir):
    """To bytes, as other stores keep vectors, and back."""
    raw = read(spark, sf_dir, "embeddings").select("vec_id", vectors.to_bytes("embedding").alias("raw"))
    total = F.aggregate(vectors.from_bytes("raw"), F.lit(0.0), lambda a, x: a + x.cast("double"))
    return raw.select("vec_id", F.round(total, 6).alias("total"), F.octet_length("raw").cast("long").alias("bytes"))


def _letters():
    """A test embedder: counts of characters by code modulo 8, scaled to length one."""

    def run(texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            counts = [0.0] * 8
            for c in text.lower():
                counts[ord(c) % 8] += 1
            size = sum(x * x for x in counts) ** 0.5 or 1.0
            out.append([x / size for x in counts])
        return out

    return run


@query(f"{W}, b_ AS (SELECT k, {_bag('body')} AS v FROM wiki_) SELECT a.k, round(list_cosine_similarity(a.v, b.v), 4) AS similarity FROM b_ a JOIN b_ b ON b.k = (SELECT min(k) FROM wiki_)")
def stored_vectors(spark, sf_dir):
    """Vectors by a registered embedder, stored with its fingerprint, which is checked when they are read."""
    known = embedders.Registry()
    known.add("letters", "test", "letters", 8, _letters)
    embedders.store(t.wiki(spark, sf_dir).select("k", "body"), known["letters"], path := folder(spark, "vectors"), "body")
    held = embedders.stored(spark, path, known["letters"])
    # one row
    first = held.where("v IS NOT NULL").orderBy("k").limit(1).select(F.col("v").alias("w"))
    return held.join(F.broadcast(first)).select("k", F.round(tx.cosine(F.col("v"), F.col("w")), 4).alias("similarity"))


@query("SELECT doc_id, chunk_index FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS chunk_index FROM documents) WHERE source = 'src3'")
def chunks_of_source(spark, sf_dir):
    """One source's chunks in order."""
    rows = read(spark, sf_dir, "documents").selectExpr("doc_id", "source AS source_hash", "cast(row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS bigint) AS chunk_index")
    return readers.chunks_of(rows, "src3").select("doc_id", "chunk_index")


@query("SELECT doc_id, source FROM documents WHERE source <> 'src3' UNION ALL SELECT doc_id + 1000000, source FROM documents WHERE source = 'src3' AND doc_id % 40 = 3")
def rechunked_source(spark, sf_dir):
    """A source chunked again: all of its old chunks go; the embedder is the one that made the others' vectors."""
    old = read(spark, sf_dir, "documents").where("source IS NOT NULL").select("doc_id", F.col("source").alias("source_hash"))
    new = old.where("source_hash = 'src3' AND doc_id % 40 = 3").withColumn("doc_id", F.col("doc_id") + 1000000)
    maker = retrieval.Fingerprint("test", "letters", 8)
    return sinks.replaced_chunks(old, new, maker, maker).select("doc_id", F.col("source_hash").alias("source"))


@query("SELECT conv_id, turn FROM (SELECT DISTINCT conv_id, turn FROM conversations ORDER BY turn DESC, conv_id::VARCHAR LIMIT 7) ORDER BY turn, conv_id::VARCHAR DESC LIMIT 1")
def history_by_place(spark, sf_dir):
    """The seventh newest entry."""
    rows = read(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("query_id"), F.col("turn").alias("ts"), "conv_id").distinct()
    return lifecycle.history_entry(rows, "7").select("conv_id", F.col("ts").alias("turn"))
