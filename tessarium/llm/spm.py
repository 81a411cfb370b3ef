"""Exact encoding with merge-type SentencePiece models by backtracking, and decoding.

A token sequence is the encoding of a text exactly if every two neighbours are compatible, that is, if merging their joined
characters anew gives the same two tokens. So tokens are taken greedily, longest match first (Aho-Corasick), each checked against
its left neighbour; where no match fits, the encoder steps back, and a bitfield keeps positions from which no continuation exists.
The text is cut where no piece spans the place (a space marker after another character, the ends of words), so units are
encoded independently and remembered in a bounded table.

Null and empty texts have no tokens. Characters without a piece become their UTF-8 bytes' pieces. Repeated rows give repeated
results; other columns don't matter.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from tessarium.llm.common import map_arrow, rows, texts

SPACE = "▁"
UNIT = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
LETTERS = "A-Za-z\u00c0-\u024f"
#: Units that also end between Latin letters and other characters, for models without pieces over such a place.
FINE = re.compile(f"{SPACE}*[{LETTERS}]+|{SPACE}*[^{SPACE}{LETTERS}]+|{SPACE}+")
#: Units and pairs remembered by a worker.
REMEMBERED = 300_000


class Units(dict):
    """Ids of units and the same as text, made when first asked for; emptied when full, as the tail of rare words has no end."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, unit: str) -> tuple[tuple[int, ...], str]:
        if len(self) >= REMEMBERED:
            self.clear()
        ids = self.make(unit)
        found = ids, ",".join(map(str, ids))
        if len(unit) <= 64:
            self[unit] = found
        return found


class Encoder:
    """Encodes as the library does for a model of merge type without a normalization table."""

    def __init__(self, model_path: str):
        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        kinds = (sp.is_control, sp.is_unknown, sp.is_byte, sp.is_unused)
        self.ids = {sp.id_to_piece(i): i for i in range(sp.get_piece_size()) if not any(kind(i) for kind in kinds)}
        self.scores = {p: sp.get_score(i) for p, i in self.ids.items()}
        self.bytes = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.automaton = ahocorasick.Automaton()
        for p in self.ids:
            self.automaton.add_word(p, len(p))
        self.automaton.make_automaton()
        self.pattern = UNIT if any(len(FINE.findall(p)) > 1 for p in self.ids) else FINE
        self.fits: dict[tuple[str, str], bool] = {}
        self.prefix: dict[str, str] = {}
        self.splits: dict[str, tuple[str, str] | None] = {}
        singles = {p for p in self.ids if len(p) == 1}
        if max(self.scores.values()) >= 1 or {c for p in self.ids for c in p} - singles or sp.encode("ﬁ  x") != self.encode_plain("ﬁ  x") or [p for p in self.ids if SPACE in p.lstrip(SPACE)]:
            raise ValueError("not a merge-type model over plain characters with leading space markers")
        self.known = singles
        #: Pieces with a part that scores no better: their merges can't be told apart by scores alone.
        self.late = {p for p in self.ids if len(p) > 1 and (SPACE * 2 in p or any(len(x) > 1 and self.scores[x] <= self.scores[p] for x in self.split(p) or ()))}
        self.units = Units(self.unit)

    def encode_plain(self, text: str) -> list[int]:
        """Merging step by step, without backtracking; slow, for checks."""
        return list(chain.from_iterable([self.ids[p]] if p in self.ids else [self.bytes[b] for b in p.encode()] for p in self.merge(list(SPACE + text.replace(" ", SPACE))))) if text else []

    def merge(self, parts: list[str]) -> list[str]:
        """Join the best-scored neighbours, the leftmost of equals, until none can be joined."""
        scores = self.scores
        while True:
            best = max(((scores[a + b], -i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in scores), default=None)
            if best is None:
                return parts
            i = -best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    def split(self, token: str) -> tuple[str, str] | None:
        """The last merge that makes a piece from its characters; None if merging never gives the piece whole."""
        if token not in self.splits:
            parts = ((token[:k], token[k:]) for k in range(1, len(token)))
            self.splits[token] = next((p for p in parts if self.whole(p[0]) and self.whole(p[1]) and self.undo(*p, self.scores[token])), None)
        return self.splits[token]

    def whole(self, token: str) -> bool:
        return token in self.ids and (len(token) == 1 or self.split(token) is not None)

    def undo(self, left: str, right: str, before: float) -> bool:
        """Whether no merge over the boundary of two tokens comes first: merges are undone, the latest first, and at each step
        the pieces that then meet at the boundary are tried. A joint piece scoring above the merge undone last would have been made
        before it; of equal scores the left one is made first."""
        scores, tie = self.scores, False
        while True:
            joint = scores.get(left + right)
            if joint is not None and (joint > before or tie and joint == before):
                return False
            a, b = (scores[left] if len(left) > 1 else 1.0), (scores[right] if len(right) > 1 else 1.0)
            if a == b == 1.0:
                return True
            if a < b:
                before, tie, left = a, False, self.split(left)[1]
            else:
                before, tie, right = b, True, self.split(right)[0]

    def compatible(self, left: str, right: str) -> bool:
        """Whether two tokens (the left one may be empty) stay as they are when their characters are merged anew."""
        found = self.fits.get((left, right))
        if found is None:
            if len(self.fits) >= REMEMBERED:
                self.fits.clear()
            if self.late & {left, right}:
                found = self.merge(list(left + right)) == [left, right][not left :]
            else:
                found = self.whole(right) and (not left or self.undo(left, right, float("-inf")))
            self.fits[left, right] = found
        return found

    def shorter(self, token: str) -> str:
        """The longest piece that is a proper prefix of a piece; empty for a single character."""
        found = self.prefix.get(token)
        if found is None:
            found = self.prefix[token] = next((token[:k] for k in range(len(token) - 1, 0, -1) if token[:k] in self.ids), "")
        return found

    def run(self, text: str) -> list[str]:
        """Tokens of a text of known characters."""
        if text in self.ids and self.compatible("", text):
            return [text]
        longest = [1] * len(text)
        for end, n in self.automaton.iter(text):
            if n > longest[end - n + 1]:
                longest[end - n + 1] = n
        failed, fits, size = None, self.fits.get, len(text)
        tokens: list[str] = []
        at, token, left = 0, text[: longest[0]], ""
        while True:
            while token:
                end = at + len(token)
                if failed is None or not failed[end >> 3] >> (end & 7) & 1:
                    fit = fits((left, token))
                    if self.compatible(left, token) if fit is None else fit:
                        break
                token = self.shorter(token)
            if token:
                tokens.append(token)
                if end == size:
                    return tokens
                at, left = end, token
                token = text[at : at + longest[at]]
            else:
                if failed is None:
                    failed = bytearray((size >> 3) + 1)
                failed[at >> 3] |= 1 << (at & 7)
                token = tokens.pop()
                at -= len(token)
                token = self.shorter(token)
                left = tokens[-1] if tokens else ""

    def unit(self, unit: str) -> tuple[int, ...]:
        ids, known, start = [], self.known, 0
        for i, c in enumerate(unit):
            if c not in known:
                if start < i:
                    ids += [self.ids[t] for t in self.run(unit[start:i])]
                ids += [self.bytes[b] for b in c.encode()]
                start = i + 1
        if start < len(unit):
            ids += [self.ids[t] for t in self.run(unit[start:])]
        return tuple(ids)

    def encode_both(self, text: str) -> tuple[list[int], str]:
        """Ids, and the ids as decimal numbers joined by commas."""
        if not text:
            return [], ""
        ids, written = zip(*map(self.units.__getitem__, self.pattern.findall(SPACE + text.replace(" ", SPACE))))
        return list(chain.from_iterable(ids)), ",".join(written)

    def encode(self, text: str) -> list[int]:
        return self.encode_both(text)[0]


@lru_cache(maxsize=2)
def encoder(model_path: str) -> Encoder:
    return Encoder(model_path)


def round_trip(docs: DataFrame, model_path: str, ids: bool = False) -> DataFrame:
    """Encode every text and decode it again: doc_id, n_tokens, ids_sha256, decoded_sha256; with ids=True also ids and decoded.

    One pass over the scan without a shuffle; a lost task is simply run again.
    """
    fields = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    fields += [("ids", pa.list_(pa.int32())), ("decoded", pa.string())] if ids else []
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(model_path)
        decode, sha = e.library.decode, hashlib.sha256
        for batch in batches:
            n, a, b, all_ids, all_texts = [], [], [], [], []
            for text in texts(batch):
                found, written = e.encode_both(text)
                back = decode(found) if found else ""
                n.append(len(found))
                a.append(sha(written.encode()).hexdigest())
                b.append(sha(back.encode()).hexdigest())
                if ids:
                    all_ids.append(found)
                    all_texts.append(back)
            yield rows(schema, batch.column("doc_id"), n, a, b, *([all_ids, all_texts] if ids else []))

    return map_arrow(docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text")), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * ids)
