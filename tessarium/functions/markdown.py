"""Markdown in Arrow batches: code, links with their contexts, ranges where links may stand."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType

from tessarium.functions.text import LINK_CONTEXT

#: Links and code (fixed values).
LINK = re.compile(r"\[\[([^\]|\n]+)(?:\|([^\]\n]+))?\]\]")
CODE = tuple(re.compile(p, re.S) for p in (r"```.*?```", r"~~~.*?~~~", r"`[^`\n]+`"))
#: Kinds of places that never hold links: fences, code, links of three forms, addresses, comments, HTML blocks, headings (fixed values).
UNSAFE = (
    re.compile(r"```.*?```", re.S),
    re.compile(r"~~~.*?~~~", re.S),
    re.compile(r"`[^`\n]+`"),
    re.compile(r"\[\[[^\]]+\]\]"),
    re.compile(r"\[[^\]]*\]\([^)]+\)"),
    re.compile(r"\[[^\]]*\]\[[^\]]*\]"),
    re.compile(r"^\[[^\]]+\]:\s*\S+.*$", re.M),
    re.compile(r"https?://\S+"),
    re.compile(r"<!--.*?-->", re.S),
    re.compile(r"<(pre|code|script|style)[^>]*>.*?</\1>", re.S | re.I),
    re.compile(r"^#{1,6}.*$", re.M),
)


def without_code(body: str) -> str:
    """Code gives way to as many spaces, so that places stay."""
    for pattern in CODE:
        body = pattern.sub(lambda m: " " * len(m[0]), body)
    return body


def links_of(body: str | None, page: str | None) -> list[tuple[str, str]]:
    """Targets and contexts of a page's links outside code, none to itself: at most some characters before the link, on its line."""
    text, found = without_code(body or ""), []
    for m in LINK.finditer(text):
        target = m[1].strip()
        if target and target != page:
            start = max(text.rfind("\n", 0, m.start()) + 1, m.start() - LINK_CONTEXT)
            found.append((target, " ".join(text[start : m.start()].split())))
    return found


def safe_of(body: str | None) -> list[tuple[int, int]]:
    """Ranges of a body in which links may be put, as code points."""
    text, at, out = body or "", 0, []
    for start, end in sorted(m.span() for pattern in UNSAFE for m in pattern.finditer(text)):
        if at < start:
            out.append((at, start))
        at = max(at, end)
    return out + [(at, len(text))] * (at < len(text))


@F.pandas_udf(StringType())
def blanked(body: pd.Series) -> pd.Series:
    return body.map(lambda x: None if x is None else without_code(x))


@F.pandas_udf(ArrayType(StructType().add("dst", StringType()).add("context", StringType())))
def links(body: pd.Series, page: pd.Series) -> pd.Series:
    return pd.Series([[{"dst": d, "context": c} for d, c in links_of(b, p)] for b, p in zip(body, page)])


@F.pandas_udf(ArrayType(StructType().add("s", IntegerType()).add("e", IntegerType())))
def safe_ranges(body: pd.Series) -> pd.Series:
    return body.map(lambda x: [{"s": s, "e": e} for s, e in safe_of(x)])
