"""Personal data by fixed patterns and a skip-chain conditional random field.

The base patterns (e-mail, IP, card, phone) give spans as their contract says. The field labels every token of a
text that holds a digit or an at sign anywhere; a text with neither holds none of the kinds. A base span is one
observed node, and so is each further word, number or run of digit groups a node with a label to be found, from its shape
and the word before it. A chain ties each node to the next, and skip edges tie the nodes with equal or similar keys
(a number's digits, a lower-cased name) wherever they are in the text; all skip edges share one potential, so that what is
clearly a phone number once is one elsewhere too, however it is written there. Loopy belief propagation (sum-product,
flooding) runs over the whole text; a node whose best label is a kind, with a probability of at least
``MIN_PROBABILITY``, adds its span unless it overlaps a base span. Base spans are observed in inference and always stay.

Weights are learned here, the skip potential among them: a bounded sample of texts (``max_train``) is labelled by the
base patterns, and the evidence of the full pattern is hidden from half of the entities; behind each text its entities and as many of
its other numbers are mentioned once more, written so that no pattern takes them. The label of such a
mention can only be told from its twin, which is what the skip potential learns. Pseudo-likelihood, by Adam.
Everything else reads every text whole.

Memory is bounded by one text's nodes: the occurrences of a key are tied to one of them, one that the patterns
found if there is any, so a key that occurs n times adds n - 1 edges, never all pairs. A run of digit groups with more
digits than any kind has (19) is not one node but one for each of its words. Time grows in proportion to the text.

Edge cases: a null text counts as empty and has no spans; repeated rows each come back; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

import ast
import dataclasses
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import require, text_or_empty

KINDS = ("email", "ip", "card", "phone")
#: The base patterns.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_COMPILED = {k: re.compile(p) for k, p in PATTERNS.items()}
MAX_TRAIN = 2000
MIN_PROBABILITY = 0.9
ROUNDS = 8
#: The skip potential where there is nothing to learn it from.
SKIP_PRIOR = 9.0
MOST_DIGITS = 19
_HINT = re.compile(r"[0-9@]")
_TOKEN = re.compile(r"[^\s,;:!?\"'<>|=&*#$]+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
#: A run of digits is tried once, at its start: a later start would fail in the same way.
_IP = re.compile("(?<![0-9])" + PATTERNS["ip"])

Span = tuple[int, int, str]


def luhn(digits: str) -> bool:
    total = 0
    for i, ch in enumerate(reversed(digits)):
        d = ord(ch) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(ch for ch in s if "0" <= ch <= "9")


def _valid(kind: str, s: str) -> bool:
    if kind == "email":
        return True
    if kind == "ip":
        return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in s.split("."))
    d = _digits(s)
    return 12 <= len(d) <= 19 and luhn(d) if kind == "card" else 9 <= len(d) <= 15


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of the e-mail pattern, found from their at signs, so that a long run without one costs nothing."""
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(done, at + 1))


def _matches(kind: str, text: str) -> Iterator[tuple[int, int]]:
    if kind == "email":
        return _emails(text)
    return (m.span() for m in (_IP if kind == "ip" else _COMPILED[kind]).finditer(text))


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each kind that pass its test, by start, then kind as listed."""
    if not text or not _HINT.search(text):
        return []
    out = []
    for n, kind in enumerate(KINDS):
        for a, b in _matches(kind, text):
            if _valid(kind, text[a:b]):
                out.append((a, n, b, kind))
    out.sort()
    return [(s, e, k) for s, _, e, k in out]


def encode_spans(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


# --- nodes ---------------------------------------------------------------------------------------


@dataclass(slots=True)
class Node:
    start: int
    end: int
    key: str  # empty: tied to no other node
    label: int  # 0 outside, else 1 + kind, by the base patterns
    observed: bool
    alone: int = 0  # 1 + kind if the token by itself is a whole match of that kind


def _key(s: str) -> str:
    """Equal for tokens that say the same: a number's digits (without a leading country 1 or zeros), else the lower-cased text."""
    d = _digits(s)
    if "@" in s or any(ch.isalpha() for ch in s):
        return s.strip(".-_()").lower()
    if s.count(".") == 3:
        return s.strip(".-()")
    return d.lstrip("0")[-10:] if len(d) >= 10 else d


#: Groups of digits that stand together with spaces, brackets, dots or hyphens between them.
_GROUPED = re.compile(r"\+?\(?[0-9][0-9().\x20-]*[0-9]")


def nodes(text: str, spans: list[Span]) -> list[Node]:
    """Base spans, and between them every word and run of digit groups; a key only where there is a digit, an at sign or a capital."""
    out = [Node(s, e, _key(text[s:e]), 1 + KINDS.index(k), True) for s, e, k in spans]
    taken: list[list[int]] = []
    for s, e, _ in sorted(spans):
        if taken and s < taken[-1][1]:
            taken[-1][1] = max(e, taken[-1][1])
        else:
            taken.append([s, e])
    i = done = run_end = 0
    for m in _TOKEN.finditer(text):
        s, e = m.span()
        if s < done:
            continue
        if s >= run_end and (text[s] in "+(" or "0" <= text[s] <= "9"):
            g = _GROUPED.match(text, s)
            if g and g.end() > e:
                if len(_digits(g.group())) <= MOST_DIGITS:
                    e = g.end()
                else:  # each of its words for itself; the run is not tried again
                    run_end = g.end()
        done = e
        while e > s and text[e - 1] in ".-_(":
            e -= 1
        while i < len(taken) and taken[i][1] <= s:
            i += 1
        if e == s or (i < len(taken) and taken[i][0] < e):
            continue
        if _HINT.search(text, s, e):
            alone = next((1 + n for n, k in enumerate(KINDS) if (m := _COMPILED[k].fullmatch(text, s, e)) and _valid(k, m.group())), 0)
            out.append(Node(s, e, _key(text[s:e]), alone, False, alone))
        else:
            out.append(Node(s, e, text[s:e].lower() if text[s].isupper() else "", 0, False))
    out.sort(key=lambda c: (c.start, c.end))
    return out


def _similar(key: str) -> str | None:
    """A coarser key that similar tokens share: the user of an address, the first three parts of an IP, a number's last seven digits."""
    if "@" in key:
        return "@" + key.split("@")[0]
    if key.count(".") == 3 and key.replace(".", "").isdigit():
        return key[: key.rindex(".") + 1]
    if key.isdigit() and len(key) >= 7:
        return "#" + key[-7:]
    return None


FEATURES = 64
#: Words that announce a kind.
_ANNOUNCE = {w: n for n, words in enumerate((("email", "e-mail", "mail", "contact"), ("ip", "host", "address", "server"), ("card", "visa", "credit"), ("phone", "tel", "call", "mobile", "fax"))) for w in words}


def features(text: str, cs: list[Node], n: int, hide: bool) -> tuple[int, ...]:
    """Numbers under ``FEATURES`` of what is true of a node; with ``hide`` its full pattern is not told."""
    c = cs[n]
    s = text[c.start : c.end]
    out = [0]
    d = len(_digits(s)) if _HINT.search(s) else 0
    out.append(1 + min(d, 20))  # 1-21
    out.append(22 + ("@" in s))
    out.append(24 + (s.isalpha() or any(ch.isalpha() for ch in s)))
    out.append(26 + min(s.count("."), 4))
    if not d and s[0] != "+" and "-" not in s and "(" not in s:
        out.append(47 + s[0].isupper())
    else:
        out.append(31 + (s[0] == "+"))
        out.append(33 + ("-" in s or " " in s))
        out.append(35 + ("(" in s))
    if n and c.start - cs[n - 1].end <= 3:
        kind = _ANNOUNCE.get(text[cs[n - 1].start : cs[n - 1].end].lower().strip("()."))
        if kind is not None:
            out.append(37 + kind)
    if not hide and (c.observed or c.alone):
        out.append(41 + c.label)  # 42-45: the pattern's own evidence
    elif not hide:
        out.append(46)
    return tuple(out)


@dataclass
class Field:
    """Weights: a row of features for each of the five labels, and the two edges' label-by-label tables."""

    unary: np.ndarray
    chain: np.ndarray
    skip: np.ndarray
    seen: dict = dataclasses.field(default_factory=dict, repr=False)

    def potential(self, numbers: tuple[int, ...]) -> np.ndarray:
        """The five labels' log potentials of a node with these features."""
        out = self.seen.get(numbers)
        if out is None:
            out = self.seen[numbers] = self.unary[:, list(numbers)].sum(1)
        return out


def edges(text: str, cs: list[Node]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of nodes (i, j) and for each whether it is a skip edge: neighbours that touch, and equal or similar keys."""
    pairs, kinds = [], []
    for i in range(len(cs) - 1):
        a, b = cs[i].end, cs[i + 1].start
        if b - a <= 3 and not text[a:b].strip():
            pairs.append((i, i + 1))
    kinds = [0] * len(pairs)
    hub: dict[str, int] = {}
    keyed = [i for i, c in enumerate(cs) if c.key]
    for i in sorted(keyed, key=lambda i: not cs[i].observed):  # what the patterns found comes first
        c = cs[i]
        near = _similar(c.key)
        j = hub.setdefault(c.key, i)
        if j == i and near:
            j = hub.get(near, i)
        if near:
            hub.setdefault(near, i)
        if j != i:
            pairs.append((j, i))
            kinds.append(1)
    return np.array(pairs, dtype=np.int64).reshape(-1, 2), np.array(kinds, dtype=np.int64)


def infer(field: Field, unary: np.ndarray, pairs: np.ndarray, kinds: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Marginals by loopy sum-product message passing; ``unary`` has log potentials, a row a node."""
    n, k = unary.shape
    if not len(pairs):
        p = np.exp(unary - unary.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)
    table = np.where(kinds[:, None, None] == 1, field.skip[None], field.chain[None])
    src = np.concatenate([pairs[:, 0], pairs[:, 1]])
    dst = np.concatenate([pairs[:, 1], pairs[:, 0]])
    pot = np.concatenate([table, table.transpose(0, 2, 1)])
    back = np.concatenate([np.arange(len(pairs)) + len(pairs), np.arange(len(pairs))])
    msg = np.zeros((len(src), k))
    for _ in range(rounds):
        into = np.zeros((n, k))
        np.add.at(into, dst, msg)
        hold = (unary + into)[src] - msg[back]
        x = hold[:, :, None] + pot
        top = x.max(1)
        new = top + np.log(np.exp(x - top[:, None, :]).sum(1))
        new -= new.max(1, keepdims=True)
        if np.abs(new - msg).max() < 1e-4:
            msg = new
            break
        msg = 0.5 * msg + 0.5 * new
    into = np.zeros((n, k))
    np.add.at(into, dst, msg)
    b = unary + into
    p = np.exp(b - b.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def added_spans(field: Field, text: str, spans: list[Span]) -> list[Span]:
    """What the field adds to the base spans of a text."""
    if not _HINT.search(text):
        return []
    cs = nodes(text, spans)
    if all(c.observed for c in cs):
        return []
    unary = np.empty((len(cs), 5))
    for i, c in enumerate(cs):
        if c.observed:
            unary[i] = -50.0
            unary[i, c.label] = 0.0
        else:
            unary[i] = field.potential(features(text, cs, i, False))
    p = infer(field, unary, *edges(text, cs))
    best = p.argmax(1)
    out = []
    for i in np.flatnonzero((best > 0) & (p.max(1) >= MIN_PROBABILITY)).tolist():
        if not cs[i].observed:
            out.append((cs[i].start, cs[i].end, KINDS[best[i] - 1]))
    return out


def all_spans(field: Field, text: str, spans: list[Span]) -> list[Span]:
    return sorted([*spans, *added_spans(field, text, spans)], key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


# --- learning ------------------------------------------------------------------------------------


def _masked(kind: str, s: str) -> str:
    """An entity written so that no base pattern takes it, under a key that is equal or similar."""
    d = _digits(s)
    if kind == "email":
        return s.split("@")[0] + "@host"
    if kind == "ip":
        return s[: s.rindex(".")] + ".***"
    parts = [d[-10:-7], d[-7:-4], d[-4:]] if kind == "phone" else [d[-10:-7], d[-7:]]
    return "-. "[int(d[-1]) % 3].join(x for x in parts if x)


Row = tuple[tuple[int, ...], int, tuple[int, ...], tuple[int, ...]]


def _training_rows(text: str) -> list[Row]:
    """(features, label, neighbours of each label over chain edges, and over skip edges) of each node of a text and of the mentions put behind it.

    Patterns are hidden from every other node that has one.
    """
    base = base_spans(text)
    cs = nodes(text, base)
    told = {k for c in cs if c.observed for k in (c.key, _similar(c.key)) if k}
    # what the patterns left of an entity's repetitions is neither known to be outside nor to be one: it is no example
    cs = [c for c in cs if c.observed or c.label or not c.key or not {c.key, _similar(c.key)} & told]
    plain = [c for c in cs if not c.observed and c.label == 0 and c.key and _HINT.search(c.key)][: max(1, len(base))]
    for label, s in [(1 + KINDS.index(k), _masked(k, text[s:e])) for s, e, k in base] + [(0, text[c.start : c.end]) for c in plain]:
        text += "\n; " + s
        cs.append(Node(len(text) - len(s), len(text), _key(s.replace(".***", ".0")), label, False))
    pairs, kinds = edges(text, cs)
    near = np.zeros((2, len(cs), 5), dtype=np.int64)
    labels = np.array([c.label for c in cs], dtype=np.int64)
    for a, b in ((0, 1), (1, 0)):
        np.add.at(near, (kinds, pairs[:, a], labels[pairs[:, b]]), 1)
    return [(features(text, cs, n, n % 2 == 0 and c.label > 0 and (c.observed or c.alone > 0)), c.label, tuple(near[0, n].tolist()), tuple(near[1, n].tolist())) for n, c in enumerate(cs)]


def fit(rows: list[Row], steps: int = 1500, rate: float = 0.05, decay: float = 3e-4, counts: list[int] | None = None) -> Field:
    """Maximise the pseudo-likelihood: each label given its features and its neighbours' labels; ``counts`` says how often each row occurs."""
    same = np.eye(5)
    field = Field(np.zeros((5, FEATURES)), np.zeros((5, 5)), SKIP_PRIOR * same)
    field.unary[0, 0] = 1.0
    # the pattern's own evidence, and its absence, as a prior that learning moves
    for label in range(1, 5):
        field.unary[label, 41 + label] = 2.0
    if not rows:
        return field
    n = len(rows)
    share = np.ones(n) if counts is None else np.array(counts, dtype=np.float64)
    share = (share / share.sum())[:, None]
    x = np.zeros((n, FEATURES))
    x[np.repeat(np.arange(n), [len(r[0]) for r in rows]), np.concatenate([r[0] for r in rows])] = 1
    target = same[[r[1] for r in rows]]
    by_chain, by_skip = (np.array([r[k] for r in rows], dtype=np.float64) for k in (2, 3))
    values = {"unary": field.unary, "chain": field.chain, "skip": np.array([1.0])}
    first, second = ({k: np.zeros_like(v) for k, v in values.items()} for _ in range(2))
    for step in range(1, steps + 1):
        z = x @ values["unary"].T + by_chain @ values["chain"] + by_skip * values["skip"]
        p = np.exp(z - z.max(1, keepdims=True))
        g = (target - p / p.sum(1, keepdims=True)) * share
        pull = by_chain.T @ g
        grad = {"unary": g.T @ x, "chain": pull + pull.T, "skip": np.array([(by_skip * g).sum()])}
        for k, v in values.items():
            d = grad[k] - (decay * v if k != "skip" else 0)  # one number that all edges share needs no pull to zero
            first[k] = 0.9 * first[k] + 0.1 * d
            second[k] = 0.99 * second[k] + 0.01 * d * d
            values[k] = v + rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-9)
    # one shared potential: how much equal labels are favoured
    return Field(values["unary"], values["chain"], values["skip"][0] * same)


def train_field(docs: DataFrame, max_train: int = MAX_TRAIN) -> Field:
    """Fit on at most ``max_train`` texts that hold a digit or an at sign, those with the smallest hash."""
    require(docs, "doc_id", "text")
    some = docs.select(F.xxhash64("doc_id", "text").alias("h"), text_or_empty(docs).alias("t")).where(F.col("t").rlike("[0-9@]"))
    least = some.select("h").orderBy("h").limit(max_train).agg(F.max("h")).first()[0]  # only hashes are put in order
    if least is None:
        return fit([])
    texts = some.where(F.col("h") <= least).select("t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for b in batches:
            for t in b.column(0):
                seen.update(_training_rows(t.as_py()))
        yield pa.RecordBatch.from_arrays([pa.array([repr(k) for k in seen], pa.string()), pa.array(list(seen.values()), pa.int64())], ["row", "n"])

    counted = texts.mapInArrow(run, "row string, n long").groupBy("row").agg(F.sum("n").alias("n")).collect()
    counted.sort(key=lambda r: r["row"])
    return fit([ast.literal_eval(r["row"]) for r in counted], counts=[r["n"] for r in counted])


def pii_rows(docs: DataFrame, field: Field) -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256 and all spans of every row."""
    require(docs, "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        names = ["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans"]
        for b in batches:
            counts: list[list[int]] = [[] for _ in KINDS]
            digest, listed = [], []
            for t in b.column(1):
                text = t.as_py()
                base = base_spans(text)
                for n, k in enumerate(KINDS):
                    counts[n].append(sum(s[2] == k for s in base))
                digest.append(hashlib.sha256(encode_spans(base).encode()).hexdigest())
                listed.append(encode_spans(all_spans(field, text, base)))
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, pa.int64()) for c in counts], pa.array(digest, pa.string()), pa.array(listed, pa.string())], names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty(docs).alias("t"))
    return rows.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redact(text: str, spans: list[Span]) -> str:
    """``text`` with each span replaced by its kind; overlapping spans become one."""
    out, at = [], 0
    for s, e, k in sorted(spans):
        if s >= at:
            out.append(text[at:s] + f"[{k}]")
            at = e
        else:
            at = max(at, e)
    return "".join(out) + text[at:]
