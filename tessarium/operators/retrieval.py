"""Composed retrieval: chunks within pages, contexts for questions, candidates for chunks, and the agent's seven tools.

Batches of questions go in (query_id, question) with their vectors (id = query_id, v); an embedder is whatever made these. Pages have page_id, title,
type, status, summary, body, modified and v, chunks have chunk_id, text, tokens, page_id, source_path, heading and v; bridge (chunk_id,
page_id) tells which pages a chunk feeds. Ids are numbers; blank questions, k <= 0 and an empty scope give no rows.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessarium.functions import text as tx
from tessarium.lineage import checkpointed
from tessarium.operators import search

#: Pages routed to, chunks ranked within them, tokens of a context (fixed values of the tools).
TOP_PAGES, TOP_CHUNKS, BUDGET = 5, 20, 2000
#: Pages of an answer's context, linked pages, and characters of their bodies (fixed values).
PRIMARY, LINKED, PRIMARY_CHARS, LINKED_CHARS = 5, 5, 20000, 5000
#: Types that are no context for an answer (fixed values).
NO_CONTEXT = ("source", "index")


class Fingerprint(NamedTuple):
    """What made an index's vectors."""

    provider: str
    model: str
    dimensions: int


def checked(stored: Fingerprint, active: Fingerprint) -> None:
    """Vectors of different makers or lengths must not be compared."""
    if stored.dimensions != active.dimensions:
        raise ValueError(f"the index has vectors of {stored.dimensions} components, the query of {active.dimensions}: embed the index again")
    if active.provider and active.model and stored[:2] != active[:2]:
        raise ValueError(f"the index was made by {stored[:2]}, the query by {active[:2]}: embed the index again")


def _vectors(rows: DataFrame, key: str) -> DataFrame:
    return rows.select(F.col(key).alias("id"), "v")


def asked(questions: DataFrame) -> DataFrame:
    """Questions that aren't blank."""
    return questions.where(F.col("question").rlike(r"(?U)\S"))


def scoped_nearest(chunks: DataFrame, vectors: DataFrame, scope: DataFrame, k: int) -> DataFrame:
    """query_id, doc, score, rank: each question's nearest chunks by cosine among those in its scope (query_id, doc)."""
    mine = scope.join(search.usable(chunks.select(F.col("chunk_id").alias("doc"), "v")), "doc").join(search.usable(vectors.select(F.col("id").alias("query_id"), "v")).withColumnRenamed("v", "q"), "query_id")
    cosine = tx.dot(F.col("v"), F.col("q")) / (tx.norm(F.col("v")) * tx.norm(F.col("q")) + 1e-12)
    return search.top(mine.select("query_id", "doc", cosine.alias("score")), k)


def cited(ranked: DataFrame, chunks: DataFrame) -> DataFrame:
    """Ranked chunks with where they come from and a snippet; chunks that are gone drop out."""
    about = chunks.select(F.col("chunk_id").alias("doc"), "page_id", "source_path", "heading", tx.snippet(F.coalesce("text", F.lit(""))).alias("snippet"), "tokens")
    return ranked.join(about, "doc").select("query_id", F.col("doc").alias("chunk_id"), "page_id", "source_path", "heading", "snippet", "score", "tokens", "rank")


def search_chunks(chunks: DataFrame, questions: DataFrame, vectors: DataFrame | None = None, k: int = 10, scope: DataFrame | None = None, bridge: DataFrame | None = None, least: float | None = None, stem: bool = True, texts: DataFrame | None = None) -> DataFrame:
    """The k best chunks of each question by words and vectors, with provenance. scope (page_id, or query_id and page_id) limits both lanes to chunks
    that feed a page of it; least is a floor of the fused score. Without vectors words alone rank. texts (chunk_id, text) are read for words where
    chunks are a join that would move all texts."""
    questions, lane = asked(questions), k * search.OVERSHOOT
    mine = data = None
    if scope is not None:
        mine = bridge.join(scope, "page_id").select(*(["query_id"] if "query_id" in scope.columns else []), F.col("chunk_id").alias("doc")).distinct()
        data = chunks.join(mine.select(F.col("doc").alias("chunk_id")).distinct(), "chunk_id", "left_semi")
    words = search.bm25(chunks if texts is None else texts, questions, lane, scope=mine, doc="chunk_id", stem=stem)
    if vectors is None:
        near = words.limit(0)
    else:
        vectors = vectors.join(questions.select(F.col("query_id").alias("id")), "id", "left_semi")
        if scope is None:
            near = search.nearest(_vectors(chunks, "chunk_id"), vectors, lane, "l2", itself=True)
        else:
            near = scoped_nearest(data, vectors, mine, lane) if "query_id" in scope.columns else search.nearest(_vectors(data, "chunk_id"), vectors, lane, itself=True)
    return cited(search.fused(words, near, k, least), chunks)


def search_pages(pages: DataFrame, vectors: DataFrame, k: int = 5, excluded: tuple[str, ...] = ("deprecated",)) -> DataFrame:
    """The k pages most similar to each question, with short summaries."""
    live = pages.where(~F.coalesce("status", F.lit("active")).isin(*excluded)) if excluded else pages
    found = search.nearest(_vectors(live, "page_id"), vectors, k, itself=True)
    about = pages.select("page_id", "type", "title", tx.summary(F.coalesce("summary", F.lit(""))).alias("summary"))
    return found.join(about.withColumnRenamed("page_id", "doc"), "doc").select("query_id", F.col("doc").alias("page_id"), "type", "title", "summary", F.col("score").alias("similarity"), "rank")


def get_context(pages: DataFrame, chunks: DataFrame, bridge: DataFrame, questions: DataFrame, vectors: DataFrame, top_pages: int = TOP_PAGES, k: int = TOP_CHUNKS, budget: int | None = BUDGET, stem: bool = True, texts: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The pages that each question is routed to, and the chunks ranked within them, as far as the budget of tokens goes; texts as in search_chunks()."""
    vectors = vectors.join(asked(questions).select(F.col("query_id").alias("id")), "id", "left_semi")
    # a few rows a question, which both lanes need
    routed = checkpointed(search_pages(pages, vectors, top_pages))
    found = search_chunks(chunks, questions, vectors, k, routed.select("query_id", "page_id"), bridge, stem=stem, texts=texts)
    return routed, found if budget is None else search.within_budget(found, F.col("tokens"), budget)


def primary_pages(pages: DataFrame, questions: DataFrame, vectors: DataFrame | None, n: int = PRIMARY, stem: bool = True, fields: tuple[str, ...] = ("page_key", "title", "summary", "body")) -> DataFrame:
    """query_id, doc, lane, rank: pages found by words, topped up by the most similar ones to n."""
    questions = asked(questions)
    words = search.bm25(pages, questions, n, doc="page_id", fields=fields, stem=stem)
    if vectors is None:
        return words.select("query_id", "doc", F.lit(0).alias("lane"), "rank")
    vectors = vectors.join(questions.select(F.col("query_id").alias("id")), "id", "left_semi")
    return search.topped_up(words, search.nearest(_vectors(pages, "page_id"), vectors, 2 * n, itself=True), n)


def linked_pages(primary: DataFrame, edges: DataFrame, pages: DataFrame, n: int = LINKED) -> DataFrame:
    """query_id, doc, n_links, rank: pages that a question's primary pages (query_id, doc) link to, by how many do, then the newest; without retired
    pages and types that are no context."""
    targets = edges.join(primary.select("query_id", F.col("doc").alias("src")), "src").select("query_id", F.col("dst").alias("doc")).groupBy("query_id", "doc").agg(F.count(F.lit(1)).alias("n_links"))
    targets = targets.join(primary.select("query_id", "doc"), ["query_id", "doc"], "left_anti")
    live = pages.where(~F.coalesce("status", F.lit("")).isin("deprecated", "archived") & ~F.coalesce("type", F.lit("")).isin(*NO_CONTEXT)).select(F.col("page_id").alias("doc"), "modified")
    order = Window.partitionBy("query_id").orderBy(F.desc("n_links"), F.desc_nulls_last("modified"), "doc")
    return targets.join(live, "doc").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n).select("query_id", "doc", "n_links", "rank")


def capped(body: Column, chars: int) -> Column:
    return F.when(F.length(body) > chars, F.concat(F.substring(body, 1, chars), F.lit("\n\n[... truncated]"))).otherwise(body)


def retrieve_context(pages: DataFrame, edges: DataFrame, questions: DataFrame, vectors: DataFrame | None = None, n: int = PRIMARY, n_linked: int = LINKED, chars: tuple[int, int] = (PRIMARY_CHARS, LINKED_CHARS), stem: bool = True, fields: tuple[str, ...] = ("page_key", "title", "summary", "body")) -> DataFrame:
    """query_id, kind, rank, page_id, title, body: primary pages, then those that they link to, with capped bodies."""
    first = primary_pages(pages, questions, vectors, n, stem, fields).select("query_id", "doc", "rank")
    both = first.withColumn("kind", F.lit("primary"))
    if n_linked > 0:
        both = both.unionByName(linked_pages(first, edges, pages, n_linked).select("query_id", "doc", "rank", F.lit("secondary").alias("kind")))
    bodies = pages.select(F.col("page_id").alias("doc"), F.coalesce("title", F.col("page_id").cast("string")).alias("title"), "body")
    body = F.when(F.col("kind") == "primary", capped(F.col("body"), chars[0])).otherwise(capped(F.col("body"), chars[1]))
    return both.join(bodies, "doc").select("query_id", "kind", "rank", F.col("doc").alias("page_id"), "title", body.alias("body"))


def candidates(pages: DataFrame, chunks: DataFrame, k: int = 10, floor: float = 0.60) -> DataFrame:
    """Pages most similar to each chunk (id, v), from a floor on; deprecated ones aside, dormant ones among them."""
    live = pages.where(F.coalesce("status", F.lit("active")) != "deprecated")
    found = search.nearest(_vectors(live, "page_id"), chunks, k, floor=floor, itself=True)
    about = live.select(F.col("page_id").alias("doc"), "type", "title", "status", "summary")
    return found.join(about, "doc").select(F.col("query_id").alias("chunk_id"), F.col("doc").alias("page_id"), "type", "title", "status", "summary", F.col("score").alias("similarity"), "rank")


def candidate_row(row: Callable[[str], Column] = F.col) -> Column:
    """A candidate as a line of a Markdown table."""
    status = F.when(row("status") == "dormant", "[dormant]").otherwise("active")
    cells = [row("page_id").cast("string"), row("type"), F.replace(row("title"), F.lit("|"), F.lit("\\|")), status, tx.clipped(tx.escaped(F.coalesce(row("summary"), F.lit(""))), 100)]
    return F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))


def related(pages: DataFrame, edges: DataFrame, asked_pages: DataFrame, k: int = 5, floor: float = 0.60) -> DataFrame:
    """The k pages nearest to each of some pages (id, v) that aren't linked with it either way, from a floor on.

    Linked pages are left out in the block where they'd arise; retired pages may be among the rest.
    """
    both = edges.select(F.col("src").alias("query_id"), F.col("dst").alias("doc")).unionByName(edges.select(F.col("dst").alias("query_id"), F.col("src").alias("doc"))).distinct()
    both = both.join(asked_pages.select(F.col("id").alias("query_id")), "query_id", "left_semi")
    near = search.nearest(_vectors(pages, "page_id"), asked_pages, k, floor=floor, without=both)
    return near.select("query_id", F.col("doc").alias("page_id"), F.col("score").alias("similarity"), "rank")


class Tools:
    """What an agent asks of a collection: seven functions with fixed defaults, each giving a table."""

    def __init__(self, pages: DataFrame, chunks: DataFrame, bridge: DataFrame, edges: DataFrame, stem: bool = True):
        self.pages, self.chunks, self.bridge, self.edges, self.stem = pages, chunks, bridge, edges, stem

    def search_pages(self, vectors: DataFrame, k: int = 5) -> DataFrame:
        return search_pages(self.pages, vectors, k)

    def search_chunks(self, questions: DataFrame, vectors: DataFrame | None = None, k: int = 10) -> DataFrame:
        return search_chunks(self.chunks, questions, vectors, k, stem=self.stem)

    def get_pages(self, ids: list) -> DataFrame:
        """Whole pages; unknown ids are left out."""
        return self.pages.where(F.col("page_id").isin(*ids)).select("page_id", F.coalesce("title", F.col("page_id").cast("string")).alias("title"), "type", "status", F.coalesce("summary", F.lit("")).alias("summary"), "body")

    def get_chunks(self, ids: list) -> DataFrame:
        return self.chunks.where(F.col("chunk_id").isin(*ids)).select("chunk_id", "text", "tokens")

    def get_context(self, questions: DataFrame, vectors: DataFrame, budget: int = BUDGET) -> tuple[DataFrame, DataFrame]:
        return get_context(self.pages, self.chunks, self.bridge, questions, vectors, budget=budget, stem=self.stem)

    def get_outbound_links(self, page_id) -> DataFrame:
        return self.edges.where(F.col("src") == page_id).select("src", "dst")

    def get_backlinks(self, page_id, limit: int = 10) -> DataFrame:
        return self.edges.where(F.col("dst") == page_id).select("src", "dst").orderBy("src").limit(limit)
