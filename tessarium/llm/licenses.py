"""Licence notices in texts, found by a positional index of their rarest words.

A template is the words of a notice, and an index holds where each template has each of its ANCHORS rarest words; how rare a word is, is counted over all
texts. A text looks up those of its words that the index holds, its rarest licence words. Each place of such a word, less a place of the word in a template,
tells where the template would begin; where anchors of a template agree on this (up to SLACK words more or less between them) and weigh enough, the
whole template is compared there, and its mandatory phrases must stand within it. Every place of every word is looked up, so a text may hold any
number of notices, and a notice may stand anywhere in it.

Words are runs of ASCII letters and digits and of all characters beyond ASCII; A-Z count as a-z. Null and empty texts have no words. Each row is scanned by
itself in pieces of about CHUNK bytes, of which only licence words are kept, so ties, repeated rows, a null doc_id and other columns don't matter.
An empty table gives no rows; then, and where no text has a licence word, all words are equally rare.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessarium.llm.common import map_arrow, rows, texts

#: Words are found in UTF-8, whose bytes from 0x80 all belong to characters beyond ASCII.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
GAP = re.compile(rb"[^0-9a-z\x80-\xff]")
CHUNK = 1 << 20
ANCHORS, SLACK = 8, 3
#: Phrases whose places are reported as they are, and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    #: Each of them must stand in the notice.
    phrases: tuple[str, ...]


#: Wording of public licences' notices and references; fixed values.
TEMPLATES = (
    Template("mit", "released under the mit license", ("mit license",)),
    Template("mit", "licensed under the mit license", ("mit license",)),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction", ("permission is hereby granted free of charge", "without restriction")),
    Template("mit", "spdx license identifier mit", ("spdx license identifier mit",)),
    Template("apache-2.0", "licensed under the apache license version 2 0", ("apache license", "version 2 0")),
    Template("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", ("apache org licenses license 2 0",)),
    Template("apache-2.0", "spdx license identifier apache 2 0", ("spdx license identifier apache 2 0",)),
    Template("gpl-3.0", "licensed under the gnu general public license version 3", ("gnu general public license", "version 3")),
    Template("gpl-2.0", "licensed under the gnu general public license version 2", ("gnu general public license", "version 2")),
    Template("gpl-3.0", "under the terms of the gnu general public license as published by the free software foundation either version 3 of the license", ("gnu general public license", "version 3")),
    Template("gpl-2.0", "under the terms of the gnu general public license as published by the free software foundation either version 2 of the license", ("gnu general public license", "version 2")),
    Template("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation", ("lesser general public license",)),
    Template("agpl-3.0", "under the terms of the gnu affero general public license as published by the free software foundation", ("affero general public license",)),
    Template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license", "2 0")),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use", "provided that the following conditions")),
    Template("bsd", "licensed under the bsd 3 clause license", ("bsd", "clause license")),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("permission to use copy modify", "is hereby granted")),
    Template("cc-by-4.0", "licensed under cc by 4 0", ("cc by 4 0",)),
    Template("cc-by-sa-4.0", "licensed under cc by sa 4 0", ("cc by sa 4 0",)),
    Template("cc-by-nc-4.0", "licensed under cc by nc 4 0", ("cc by nc 4 0",)),
    Template("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license", ("creative commons attribution 4 0",)),
    Template("cc0-1.0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", ("waived all copyright",)),
    Template("unlicense", "this is free and unencumbered software released into the public domain", ("unencumbered software", "public domain")),
)


def words_of(text: str) -> list[bytes]:
    return WORD.findall(text.encode().lower())


class Index:
    """Licence words, their weights, and postings of templates' rarest ones."""

    def __init__(self, templates: tuple[Template, ...], phrases: dict[str, str]):
        self.templates = templates
        self.lists = [words_of(t.text) for t in templates]
        wanted = [(p, words_of(p)) for p in phrases] + [(p, words_of(p)) for t in templates for p in t.phrases]
        self.number = {w: i for i, w in enumerate(sorted({w for ws in [*self.lists, *(ws for _, ws in wanted)] for w in ws}))}
        self.phrases = {p: np.array([self.number[w] for w in ws]) for p, ws in wanted}
        self.base = dict(phrases)

    def weigh(self, total: int, found: dict[int, int]) -> Index:
        """Weights by the number of texts, and of those that hold each word."""
        self.weight = np.array([1 + math.log((1 + total) / (1 + found.get(i, 0))) for i in range(len(self.number))])
        postings = defaultdict(list)
        self.template_weights, self.anchor_weight = [], []
        for t, ws in enumerate(self.lists):
            ids = [self.number[w] for w in ws]
            rarest = sorted(set(ids), key=lambda i: (-self.weight[i], i))[:ANCHORS]
            self.template_weights.append(self.weight[ids])
            self.anchor_weight.append(sum(self.weight[i] for i in ids if i in rarest))
            for q, i in enumerate(ids):
                if i in rarest:
                    postings[i].append((t, q))
        self.postings = {i: np.array(p) for i, p in postings.items()}
        self.places = [{i: np.flatnonzero(np.array([self.number[w] for w in ws]) == i) for i in {self.number[w] for w in ws}} for ws in self.lists]
        return self

    def scan(self, text: bytes) -> tuple[int, np.ndarray, np.ndarray]:
        """Words of a lower-case text, places of its licence words, and which these are."""
        n = at = 0
        places, ids, number = [], [], self.number
        while at < len(text):
            gap = GAP.search(text, at + CHUNK)
            end = gap.start() if gap else len(text)
            words = WORD.findall(text, at, end)
            if not number.keys().isdisjoint(words):
                for i, w in enumerate(words, n):
                    if w in number:
                        places.append(i)
                        ids.append(number[w])
            n, at = n + len(words), end
        return n, np.array(places, np.int64), np.array(ids, np.int64)

    def starts(self, phrase: str, places: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Where a phrase's words stand consecutively."""
        words = self.phrases[phrase]
        at = np.flatnonzero(ids == words[0])
        for k, w in enumerate(words[1:], 1):
            at = at[at + k < len(ids)]
            at = at[(ids[at + k] == w) & (places[at + k] == places[at] + k)]
        return places[at]

    def notices(self, places: np.ndarray, ids: np.ndarray, share: float) -> list[tuple[str, int, int, float]]:
        """(label, first place, end, share of the template's weight found there) of each notice."""
        at = [(p, self.postings[i]) for p, i in zip(places.tolist(), ids.tolist()) if i in self.postings]
        if not at:
            return []
        sizes = np.array([len(x) for _, x in at])
        p, both = np.repeat([p for p, _ in at], sizes), np.concatenate([x for _, x in at])
        t, q = both[:, 0], both[:, 1]
        order = np.lexsort((q, p - q, t))
        t, q, begin = t[order], q[order], (p - q)[order]
        new = np.concatenate(([True], (t[1:] != t[:-1]) | (begin[1:] - begin[:-1] > SLACK)))
        edges = np.append(np.flatnonzero(new), len(t))
        out, found = [], {}
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
            template = int(t[a])
            weights = self.template_weights[template]
            if weights[np.unique(q[a:b])].sum() < share * self.anchor_weight[template] - 1e-9:
                continue
            low, high = int(begin[a]), int(begin[b - 1])
            end = high + len(weights)
            ok = True
            for phrase in self.templates[template].phrases:
                if phrase not in found:
                    found[phrase] = self.starts(phrase, places, ids)
                first = np.searchsorted(found[phrase], low)
                ok = ok and first < len(found[phrase]) and found[phrase][first] + len(self.phrases[phrase]) <= end
            if ok:
                i, j = np.searchsorted(places, (low, end))
                hit = np.zeros(len(weights), bool)
                for place, word in zip(places[i:j].tolist(), ids[i:j].tolist()):
                    if (own := self.places[template].get(word)) is not None:
                        hit[own[(place - own >= low) & (place - own <= high)]] = True
                if (score := float(weights[hit].sum() / weights.sum())) >= share:
                    out.append((self.templates[template].label, max(low, 0), end, score))
        return out


def counted(docs: DataFrame, index: Index) -> Index:
    """Weights from how many of all texts hold each licence word; the driver gets a number a word."""
    schema = pa.schema([("word", pa.int32()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, found = 0, np.zeros(len(index.number), np.int64)
        for batch in batches:
            for text in texts(batch):
                found[np.unique(index.scan(text.encode().lower())[2])] += 1
            total += batch.num_rows
        yield rows(schema, [-1, *range(len(found))], [total, *found.tolist()])

    sums = map_arrow(docs.select("text"), run, "word int, n long").groupBy("word").agg(F.sum("n").alias("n"))
    got = {r[0]: r[1] for r in sums.collect()}
    return index.weigh(got.get(-1, 0), got)


def scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, share: float = 0.7, spans: bool = False) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score; with spans also notices (label, first word, end, score).

    share: least share of a template's weight, of its anchors and of all its words, that must be found. score is the greatest such share, 0 without a notice.
    """
    index = counted(docs, Index(templates, PHRASES))
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64())])
    if spans:
        schema = schema.append(pa.field("notices", pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("end_word", pa.int64()), ("score", pa.float64())]))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in texts(batch):
                n, places, ids = index.scan(text.encode().lower())
                starts = {p: index.starts(p, places, ids) for p in index.base} if len(ids) else {}
                at = np.concatenate([*starts.values(), np.array([], np.int64)])
                own = {index.base[p] for p, s in starts.items() if len(s)}
                notices = index.notices(places, ids, share) if len(ids) else []
                labels = sorted(own | {x[0] for x in notices})
                found = (n, len(at), int(at.min()) if len(at) else None, int(at.max()) if len(at) else None, ",".join(sorted(own)), ",".join(labels), max((x[3] for x in notices), default=0.0))
                out.append(found + ([dict(zip(("label", "first_word", "end_word", "score"), x)) for x in notices],) * spans)
            yield rows(schema, batch.column("doc_id"), *(zip(*out) if out else [[] for _ in schema.names[1:]]))

    ddl = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double" + ", notices array<struct<label: string, first_word: long, end_word: long, score: double>>" * spans
    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, ddl)
