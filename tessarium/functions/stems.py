"""Porter's stems (An algorithm for suffix stripping, 1980), for words in lower case; other characters than ASCII letters count as consonants."""

from __future__ import annotations

from functools import lru_cache

#: Endings and what becomes of them, by step; the first that fits decides, by the measure of what stands before it (fixed values of the paper).
STEP_2 = "ational ate tional tion enci ence anci ance izer ize bli ble alli al entli ent eli e ousli ous ization ize ation ate ator ate alism al iveness ive fulness ful ousness ous aliti al iviti ive biliti ble logi log".split()
STEP_3 = ("icate ic ative - alize al iciti ic ical ic ful - ness -").split()
STEP_4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()


def consonant(w: str, i: int) -> bool:
    return w[i] not in "aeiou" and not (w[i] == "y" and i > 0 and consonant(w, i - 1))


def measure(w: str) -> int:
    """How often a vowel is followed by a consonant."""
    kinds = [consonant(w, i) for i in range(len(w))]
    return sum(b and not a for a, b in zip(kinds, kinds[1:]))


def has_vowel(w: str) -> bool:
    return any(not consonant(w, i) for i in range(len(w)))


def doubled(w: str) -> bool:
    return len(w) > 1 and w[-1] == w[-2] and consonant(w, len(w) - 1)


def short(w: str) -> bool:
    """Ends in consonant, vowel, consonant, the last not w, x or y."""
    n = len(w)
    return n > 2 and consonant(w, n - 3) and not consonant(w, n - 2) and consonant(w, n - 1) and w[-1] not in "wxy"


def replaced(w: str, rules: list[str]) -> str:
    pairs = sorted(zip(rules[::2], rules[1::2]), key=lambda p: -len(p[0]))
    for ending, new in pairs:
        if w.endswith(ending):
            stem = w[: -len(ending)]
            return stem + new.replace("-", "") if measure(stem) > 0 else w
    return w


@lru_cache(maxsize=1 << 18)
def stem(w: str) -> str:
    if not 3 <= len(w) <= 64:
        return w
    if w.endswith("s"):
        w = w[:-2] if w.endswith(("sses", "ies")) else w if w.endswith("ss") else w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if measure(w[:-3]) > 0 else w
    else:
        for ending in ("ed", "ing"):
            if w.endswith(ending) and has_vowel(rest := w[: -len(ending)]):
                if rest.endswith(("at", "bl", "iz")):
                    w = rest + "e"
                elif doubled(rest) and rest[-1] not in "lsz":
                    w = rest[:-1]
                else:
                    w = rest + "e" if measure(rest) == 1 and short(rest) else rest
                break
    if w.endswith("y") and has_vowel(w[:-1]):
        w = w[:-1] + "i"
    w = replaced(replaced(w, STEP_2), STEP_3)
    for ending in sorted(STEP_4, key=lambda e: -len(e)):
        if w.endswith(ending):
            rest = w[: -len(ending)]
            if measure(rest) > 1 and (ending != "ion" or rest[-1:] in ("s", "t")):
                w = rest
            break
    if w.endswith("e") and (measure(w[:-1]) > 1 or measure(w[:-1]) == 1 and not short(w[:-1])):
        w = w[:-1]
    return w[:-1] if w.endswith("ll") and measure(w[:-1]) > 1 else w
