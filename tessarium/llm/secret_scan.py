"""Secrets in texts: three patterns, and a token-efficiency test for random strings.

The test looks at runs of 20 or more characters of encoded data. Known digests and identifiers are excluded: hexadecimal strings of a digest's
length, UUIDs and plain numbers. What remains is tokenized with a byte-pair vocabulary; words, also joined to names, give long tokens, random
strings give short ones, so a low number of characters per token marks a secret, whatever its alphabet.

Null and empty texts have no secrets. Offsets are code points, the end exclusive. Each row is scanned by itself, in time linear in its text, so
ties, repeated rows, a null doc_id and other columns don't matter. An empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessarium.llm.common import map_arrow, rows, texts

ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
HEX_LONG = re.compile(r"[0-9a-f]{24}[0-9a-f]*")
ENCODED = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}")
#: Digests (MD5, SHA-1, SHA-2) by length; UUIDs and plain numbers, perhaps with separators, as identifiers. Both patterns match in linear time.
DIGEST_LENGTHS = (32, 40, 56, 64, 96, 128)
IDENTIFIER = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}|[0-9_=+/-]+")
KINDS = ("assign", "access", "hex", "random")


@lru_cache(maxsize=2)
def vocabulary(path: str, pattern: str) -> tiktoken.Encoding:
    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("scan", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """Start, kind's place in KINDS, end."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX_LONG.finditer(text)]
    return sorted(found)


def excluded(run: str) -> bool:
    """Known digests and identifiers."""
    return HEX.fullmatch(run.lower()) is not None and len(run) in DIGEST_LENGTHS or IDENTIFIER.fullmatch(run) is not None


def random_spans(text: str, tokens: tiktoken.Encoding, ratio: float) -> list[tuple[int, int, int]]:
    return [(m.start(), 3, m.end()) for m in ENCODED.finditer(text) if not excluded(m[0]) and len(m[0]) < ratio * len(tokens.encode_ordinary(m[0]))]


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def redacted(text: str, spans: list[tuple[int, int, int]], mark: str) -> str:
    out, at = [], 0
    for a, _, b in spans:
        if b > at:
            if a >= at:
                out += [text[at:a], mark]
            at = b
    return "".join([*out, text[at:]])


def scan(docs: DataFrame, path: str, pattern: str, ratio: float = 2.2, mark: str | None = None, carried: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans; with a mark also clean_text, in which the mark replaces each secret.

    ratio: characters per token under which a string counts as random. Carried columns, all strings, stay beside their row.
    """
    fields = [("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS[:3]), ("base_sha256", pa.string()), ("spans", pa.string())]
    schema = pa.schema(fields + [("clean_text", pa.string())] * (mark is not None) + [(c, pa.string()) for c in carried])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = vocabulary(path, pattern)
        for batch in batches:
            out: list[list] = [[] for _ in fields[1:]]
            clean = []
            for raw, text in zip(batch.column("text").to_pylist(), texts(batch)):
                base = base_spans(text)
                spans = sorted(base + random_spans(text, tokens, ratio))
                counts = [sum(s[1] == k for s in base) for k in range(3)]
                for column, x in zip(out, (*counts, hashlib.sha256(written(base).encode()).hexdigest(), written(spans))):
                    column.append(x)
                if mark is not None:
                    clean.append(redacted(text, spans, mark) if spans else raw)
            yield rows(schema, batch.column("doc_id"), *out, *([clean] if mark is not None else []), *(batch.column(c) for c in carried))

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *carried), run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string" + ", clean_text string" * (mark is not None) + "".join(f", {c} string" for c in carried))
