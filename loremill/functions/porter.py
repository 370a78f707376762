"""The Porter stemmer (M. F. Porter, An algorithm for suffix stripping, 1980)."""

from __future__ import annotations

from functools import lru_cache

#: The algorithm's suffix tables, in its order.
STEP2 = (("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("logi", "log"), ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"))
STEP3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _consonant(w: str, i: int) -> bool:
    c = w[i]
    if c in "aeiou":
        return False
    return c != "y" or i == 0 or not _consonant(w, i - 1)


def _measure(stem: str) -> int:
    kinds = [_consonant(stem, i) for i in range(len(stem))]
    return sum(1 for a, b in zip(kinds, kinds[1:]) if not a and b)


def _vowel(stem: str) -> bool:
    return any(not _consonant(stem, i) for i in range(len(stem)))


def _double(w: str) -> bool:
    return len(w) > 1 and w[-1] == w[-2] and _consonant(w, len(w) - 1)


def _cvc(w: str) -> bool:
    return len(w) > 2 and _consonant(w, len(w) - 3) and not _consonant(w, len(w) - 2) and _consonant(w, len(w) - 1) and w[-1] not in "wxy"


def _longest(w: str, table, least: int) -> str:
    hits = [(s, r) for s, r in table if w.endswith(s)]
    if hits:
        s, r = max(hits, key=lambda x: len(x[0]))
        if _measure(w[: -len(s)]) >= least:
            return w[: -len(s)] + r
    return w


@lru_cache(maxsize=200_000)
def stem(w: str) -> str:
    """The stem of a lower-case word; words of under three or over 64 bytes, or with other letters than a to z in front, stay."""
    if not 3 <= len(w.encode()) <= 64:
        return w
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        if _measure(w[:-3]) > 0:
            w = w[:-1]
    else:
        cut = 2 if w.endswith("ed") and _vowel(w[:-2]) else 3 if w.endswith("ing") and _vowel(w[:-3]) else 0
        if cut:
            w = w[:-cut]
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif _double(w) and w[-1] not in "lsz":
                w = w[:-1]
            elif _measure(w) == 1 and _cvc(w):
                w += "e"
    if w.endswith("y") and _vowel(w[:-1]):
        w = w[:-1] + "i"
    w = _longest(w, STEP2, 1)
    w = _longest(w, STEP3, 1)
    hits = [s for s in STEP4 if w.endswith(s)]
    if hits:
        s = max(hits, key=len)
        rest = w[: -len(s)]
        if _measure(rest) > 1 and (s != "ion" or rest[-1:] in ("s", "t")):
            w = rest
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or m == 1 and not _cvc(w[:-1]):
            w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w
