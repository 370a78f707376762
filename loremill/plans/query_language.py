"""The search language: from what a user types to a tree of phrases.

Adjacent phrases are ANDed and bind tightest, then NOT (left to right), then AND, then OR. A word with a trailing star
is a prefix. Everything here runs on the driver; a query is short.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass, field


class QueryError(ValueError):
    """The query does not parse."""


@dataclass(frozen=True)
class Phrase:
    words: tuple[str, ...]
    prefix: bool = False


@dataclass(frozen=True)
class Op:
    kind: str  # and, or, not
    left: object
    right: object


@dataclass
class Query:
    """``tree`` is None when nothing can match; ``phrases`` in query order, repeats included."""

    tree: object | None
    phrases: list[Phrase] = field(default_factory=list)


def sanitise(raw: str) -> str:
    """What is typed, with every word quoted but for bare AND, OR, NOT; wholly quoted input passes as it is."""
    text = raw.strip()
    if not text:
        return '""'
    if text.startswith('"') and text.endswith('"'):
        return text
    out = []
    for word in text.split():
        if word in ("AND", "OR", "NOT"):
            out.append(word)
        elif word.endswith("*"):
            out.append('"' + word[:-1].replace('"', "") + '" *')
        else:
            out.append('"' + word.replace('"', "") + '"')
    return " ".join(out)


def fold_words(text: str) -> tuple[str, ...]:
    plain = "".join(c for c in unicodedata.normalize("NFD", text.lower()) if not unicodedata.combining(c))
    return tuple(re.findall(r"[^\W_]+", unicodedata.normalize("NFC", plain)))


def _lex(text: str) -> list[tuple[str, str]]:
    out, i = [], 0
    while i < len(text):
        c = text[i]
        if c.isspace():
            i += 1
        elif c == '"':
            j, buf = i + 1, ""
            while True:
                if j >= len(text):
                    raise QueryError("unterminated string")
                if text[j] == '"':
                    if text[j + 1 : j + 2] == '"':
                        buf += '"'
                        j += 2
                        continue
                    break
                buf += text[j]
                j += 1
            out.append(("phrase", buf))
            i = j + 1
        elif c == "*":
            out.append(("star", c))
            i += 1
        else:
            m = re.match(r"[^\s\"*]+", text[i:])
            word = m.group()
            out.append((word if word in ("AND", "OR", "NOT") else "phrase", word))
            i += len(word)
    return out


def parse(text: str) -> Query:
    """Parse a sanitised query."""
    toks = _lex(text)
    at = 0
    found: list[Phrase] = []

    def peek() -> str | None:
        return toks[at][0] if at < len(toks) else None

    def phrase():
        nonlocal at
        if peek() != "phrase":
            raise QueryError("a phrase is missing")
        words = fold_words(toks[at][1])
        at += 1
        prefix = peek() == "star"
        if prefix:
            at += 1
        p = Phrase(words, prefix and bool(words))
        if words:
            found.append(p)
        return p

    def adjacent():
        left = phrase()
        while peek() == "phrase":
            right = phrase()
            left = right if not left_words(left) else left if not right.words else Op("and", left, right)
        return left

    def left_words(x) -> bool:
        return isinstance(x, Op) or bool(x.words)

    def level(kind: str, below):
        nonlocal at
        left = below()
        while peek() == kind.upper():
            at += 1
            left = Op(kind, left, below())
        return left

    def nots():
        return level("not", adjacent)

    def ands():
        return level("and", nots)

    tree = level("or", ands)
    if at < len(toks):
        raise QueryError("something follows the query")
    return Query(tree, found)
