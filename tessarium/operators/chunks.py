"""Chunking of texts, within each row."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

from tessarium.functions import text as tx

HEADING = re.compile(r"^\s{0,3}#{1,6}\s+(.+?)\s*#*\s*$")
SECTION = re.compile(r"(?=^#{1,2}\s+)", re.M)


def tokens(text: str) -> int:
    return max(1, len(text) // 4)


def borders(sizes: list[int], budget: int, back: Callable[[list[int], int], int]) -> list[tuple[int, int]]:
    """Ranges of neighbouring blocks within a budget, from running sums of their sizes; after a range that ends before block i the next begins at
    back(sums, i), but never before it. A block over the budget stays whole."""
    sums, first, out = [0, *accumulate(sizes)], 0, []
    for i in range(1, len(sizes)):
        if first < i and sums[i + 1] - sums[first] > budget:
            out.append((first, i))
            first = max(first, back(sums, i))
    return [*out, (first, len(sizes))] if sizes else out


def grouped(blocks: list[str], budget: int, overlap: int) -> list[list[str]]:
    """Neighbouring blocks; each group after the first begins with the last one's tail within the overlap."""
    return [blocks[a:b] for a, b in borders([*map(tokens, blocks)], budget, lambda sums, i: bisect_left(sums, sums[i] - overlap, 0, i + 1))]


def grouped_pages(pages: list[str], budget: int) -> list[list[str]]:
    """Neighbouring pages; each group after the first begins with the last one's last page."""
    return [pages[a:b] for a, b in borders([*map(tokens, pages)], budget, lambda sums, i: i - 1)]


def heading(text: str) -> str | None:
    return next((m[1].strip() for line in text.splitlines() if (m := HEADING.match(line))), None)


def split(text: str, pages: list[str] | None, budget: int, overlap: int, delimiter: str) -> list[tuple[str, str | None]]:
    """Chunks and their first headings: the text whole, without heading, if it fits; its sections if all of several fit; its pages; its paragraphs."""
    if tokens(text) <= budget:
        return [(text, None)]
    sections = [x.strip() for x in SECTION.split(text) if x.strip()]
    if len(sections) > 1 and all(tokens(x) <= budget for x in sections):
        parts = sections
    elif pages:
        parts = ["\n\n".join(g) for g in grouped_pages(pages, budget)]
    else:
        parts = [delimiter.join(g) for g in grouped(text.split(delimiter), budget, overlap)]
    return [(x, heading(x)) for x in parts]


def chunked(docs: DataFrame, budget: int, overlap: int = 200, delimiter: str = "\n\n") -> DataFrame:
    """doc_id, chunk_index, chunk_total, chunk_id, text, tokens, heading of docs (doc_id, text, and where there are some pages, an array of a document's pages)."""

    @F.pandas_udf(ArrayType(StructType().add("text", StringType()).add("heading", StringType())))
    def parts(text: pd.Series, pages: pd.Series) -> pd.Series:
        return pd.Series([[{"text": t, "heading": h} for t, h in split(x, None if p is None else list(p), budget, overlap, delimiter)] if x is not None else None for x, p in zip(text, pages)], dtype=object)

    pages = F.col("pages") if "pages" in docs.columns else F.lit(None).cast("array<string>")
    rows = docs.select("doc_id", F.sha2("text", 256).alias("h"), parts("text", pages).alias("c")).select("doc_id", "h", F.size("c").alias("chunk_total"), F.posexplode("c").alias("chunk_index", "x"))
    return rows.select("doc_id", "chunk_index", "chunk_total", tx.chunk_id(F.col("h"), F.col("chunk_index")).alias("chunk_id"), F.col("x.text").alias("text"), tx.token_estimate(F.col("x.text")).alias("tokens"), F.col("x.heading").alias("heading"))
