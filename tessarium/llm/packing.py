"""Packing of documents into sequences by the sum-of-squares rule.

Texts are tokenized where they are read; only pieces' lengths and checksums go on. Pieces are dealt into blocks of about BLOCK, and each
block is packed by one task: the next piece (the longest first) goes where the sum of the squared numbers of open sequences per residual
gap becomes smallest, which steers open sequences towards gaps that pieces fill exactly. A block's memory is bounded, and its
unfilled rest is a few sequences.

Null and empty texts give one piece, the end mark alone. Longer documents are cut into full pieces; the first piece may be shorter. Rows that
share a doc_id are packed one by one. Of equal choices the smallest gap is taken. An empty table gives no pieces.
"""

from __future__ import annotations

import json
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessarium.llm.common import checkpointed, map_arrow, rows, texts

BLOCK = 50_000
#: Stands for gaps that no open sequence has.
NEVER = np.iinfo(np.int64).max
#: How byte-level tokenizers of this kind split texts into words.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_of() -> dict[str, int]:
    """Bytes by the visible characters that stand for them in byte-level vocabularies: printable ones for themselves, others from U+0100 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Encoder:
    """Little-endian 32-bit ids of texts, by a byte-level tokenizer's file.

    Where the file's merges stand in the order of their ids, tiktoken gives the same ids several times faster. Texts with the string of a
    special token, and files of other kinds, are left to the tokenizers library itself."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            said = json.load(file)
        self.special = [t["content"] for t in said.get("added_tokens", [])]
        model, split = said["model"], said.get("pre_tokenizer") or {}
        merged = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        plain = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space") and not said.get("normalizer") and not model.get("ignore_merges")
        self.fast = None
        if plain and all(x < y for x, y in pairwise(merged)):
            of = byte_of()
            ranks = {bytes(of[c] for c in t): i for t, i in model["vocab"].items() if t not in self.special}
            self.fast = tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if self.fast is None or any(x in text for x in self.special):
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        return self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False).tobytes()


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def pieces(docs: DataFrame, path: str, size: int = 2048, end: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32."""
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
    mark = array("I", [end]).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for doc, text in zip(batch.column("doc_id").to_pylist(), texts(batch)):
                ids = encode(text) + mark
                n = len(ids) // 4
                cuts = [0, *range(n % size or size, n + 1, size)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    for column, x in zip(out, (doc, k, a, b - a, zlib.crc32(ids[4 * a : 4 * b]))):
                        column.append(x)
            yield rows(schema, *out)

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def placed(lengths: list[int], size: int) -> tuple[list[int], list[int]]:
    """Sequence number and offset for each length, in the order given; a full sequence is closed and no longer counts."""
    counts = np.zeros(size + 1, np.int64)  # of open sequences by gap
    open_: list[list[int]] = [[] for _ in range(size + 1)]
    sequence, offset, made = [], [], 0
    for s in lengths:
        # growth of the sum of squares if a gap h becomes h - s: one sequence less at h, one more at h - s; a closed one has no gap
        grown = 2 * (1 - counts[s:size])
        grown[1:] += 2 * counts[1 : size - s]
        if len(grown):
            grown[0] -= 1
            grown[counts[s:size] == 0] = NEVER
        new = 2 * counts[size - s] + 1 if s < size else 0
        best = int(grown.argmin()) if len(grown) else -1
        if best >= 0 and grown[best] <= new:
            gap = s + best
            number = open_[gap].pop()
            counts[gap] -= 1
        else:
            gap, number = size, made
            made += 1
        sequence.append(number)
        offset.append(size - gap)
        if gap > s:
            counts[gap - s] += 1
            open_[gap - s].append(number)
    return sequence, offset


def pack(docs: DataFrame, path: str, size: int = 2048, block: int = BLOCK) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for each piece."""
    found = checkpointed(pieces(docs, path, size))
    n_blocks = max(1, -(-found.count() // block))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True])
        sequence, offset = placed(pdf["length"].tolist(), size)
        pdf["sequence_id"] = (pdf["block"] * (1 << 32)) + np.array(sequence, np.int64)
        pdf["offset"] = np.array(offset, np.int64)
        return pdf.drop(columns="block")

    # a row's number in the checkpoint is the same whenever it's read again
    dealt = found.withColumn("block", F.pmod(F.monotonically_increasing_id(), F.lit(n_blocks)))
    return dealt.groupBy("block").applyInPandas(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
