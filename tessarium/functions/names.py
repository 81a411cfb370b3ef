"""Names in texts: an Aho-Corasick automaton finds all of them in one pass, whatever their number of words."""

from __future__ import annotations

import re
import zlib

import ahocorasick

WORD = re.compile(r"\w+")
#: Signs that join two words to one.
JOINS = "-'’"
#: A word that begins with a capital, and runs of such words with one space between them.
PROPER = re.compile(r"\w+(?:[-'’]\w+)*")
SENTENCE = re.compile(r"(?:^|[.!?:]\s+|\n\s*|^\W+|\n\W+)$")


def folded(text: str) -> str:
    """Lower case, character by character, so that places stay."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def inside_word(text: str, at: int) -> bool:
    """Whether a place between two characters lies within a word, joined ones included."""
    if not 0 < at < len(text):
        return False
    before, after = text[at - 1], text[at]
    word = lambda c: c.isalnum() or c == "_"
    if word(before) and word(after):
        return True
    if word(before) and after in JOINS:
        return at + 1 < len(text) and word(text[at + 1])
    return before in JOINS and word(after) and at > 1 and word(text[at - 2])


def first_word(name: str) -> str:
    """The word by which a name is looked up; empty if it has none."""
    found = WORD.search(name)
    return found[0] if found else ""


def part_of(word: str, parts: int) -> int:
    return zlib.crc32(word.encode()) % parts


def parts_of(body: str, parts: int) -> list[int]:
    """Parts whose names can stand in a text; names without words are in that of the empty word."""
    return sorted({part_of(w, parts) for w in {"", *WORD.findall(folded(body))}})


class Names:
    """An automaton of names, with their labels."""

    def __init__(self, rows: list[tuple[str, str]]):
        self.automaton = ahocorasick.Automaton()
        labels: dict[str, str] = {}
        for name, label in rows:
            key = folded(name)
            labels[key] = max(labels.get(key, label), label, key=lambda x: (x != "CONCEPT", x))
        for key, label in labels.items():
            if key:
                self.automaton.add_word(key, (len(key), label))
        self.empty = not len(self.automaton)
        if not self.empty:
            self.automaton.make_automaton()

    def find(self, body: str) -> list[tuple[int, int, str, str]]:
        """Start, end, label and text of all names that begin and end where words do."""
        if self.empty or not body:
            return []
        text, out = folded(body), []
        for last, (size, label) in self.automaton.iter(text):
            start, end = last + 1 - size, last + 1
            # a name may begin or end with a sign: then what stands beside it doesn't matter
            if not ((text[start].isalnum() or text[start] == "_") and inside_word(text, start) or (text[last].isalnum() or text[last] == "_") and inside_word(text, end)):
                out.append((start, end, label, body[start:end]))
        return out


def apart(spans: list[tuple]) -> list[tuple]:
    """Of overlapping spans the longest, of equally long ones the first; in order."""
    out: list[tuple] = []
    taken: set[int] = set()
    for span in sorted(spans, key=lambda x: (x[0] - x[1], x[0], x[2])):
        # what is longer is there already, so a shorter span overlaps only if one of its ends is taken
        if span[0] not in taken and span[1] - 1 not in taken:
            taken.update(range(span[0], span[1]))
            out.append(span)
    return sorted(out)


def proper_runs(body: str) -> list[tuple[int, int]]:
    """Runs of capitalised words with a space between them, of more than three characters; a single word at the beginning of a sentence is none."""
    out: list[tuple[int, int]] = []
    run: list[tuple[int, int]] = []

    def done() -> None:
        if run and run[-1][1] - run[0][0] > 3 and (len(run) > 1 or not SENTENCE.search(body, max(0, run[0][0] - 200), run[0][0])):
            out.append((run[0][0], run[-1][1]))
        run.clear()

    for m in PROPER.finditer(body):
        if not body[m.start()].isupper():
            done()
            continue
        if run and body[run[-1][1] : m.start()] != " ":
            done()
        run.append(m.span())
    done()
    return out


_held: dict[str, Names] = {}


def built(token: str, rows: list[tuple[str, str]]) -> Names:
    """The automaton of some rows, made once a worker; the token tells them apart."""
    if token not in _held:
        _held.clear()
        _held[token] = Names(rows)
    return _held[token]
