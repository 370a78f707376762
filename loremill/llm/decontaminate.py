"""Benchmark decontamination: pigeonhole edit matching.

A test item of normalised length m has an error budget k = floor(m * ``max_error``). It is split into k + 1
pieces; a text that holds the item with at most k edits holds at least one piece unchanged. One automaton
over the pieces of a block of items finds the exact piece hits in each whole text; every hit marks where
the item would have to lie, and Myers' bit-parallel algorithm verifies the least edit distance there. A hit is first
verified on ever longer stretches around its piece: of two halves with j and l pieces that together have at most j + l - 1
edits, one has at most j - 1 or the other at most l - 1, so a match always has a piece all whose stretches of n pieces pass with n - 1.

Normalising lower-cases and makes each run of white space one space, so a passage that was re-wrapped still
matches. The test items are the stated query set: they are read in blocks of at most ``BLOCK_BYTES`` bytes, each
block going once over all documents, so what is sent to the executors has a proven bound whatever
the size of the benchmark.

Edge cases: items without text match nothing; a null text counts as empty and matches nothing; items with
the same text each match; repeated documents each come back; an empty table gives no rows; other columns are not
read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep_rows, require, text_or_empty

MAX_ERROR = 0.1
BLOCK_BYTES = 4 << 20


def normalise(text: str) -> str:
    return " ".join(text.lower().split())


def budget(length: int, max_error: float = MAX_ERROR) -> int:
    return int(length * max_error)


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    """``k + 1`` consecutive pieces that cover ``item``, with their offsets."""
    n = len(item)
    cuts = [n * i // (k + 1) for i in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def masks(pattern: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, ch in enumerate(pattern):
        out[ch] = out.get(ch, 0) | (1 << i)
    return out


def myers(peq: dict[str, int], m: int, text: str) -> tuple[int, int]:
    """Least edit distance of a pattern to any substring of ``text``, and where the first such substring ends."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, end = full, 0, m, m, 0
    get = peq.get
    for j, ch in enumerate(text):
        eq = get(ch, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (~(xh | pv) & full)
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = (ph << 1) & full  # a match may start anywhere: no cost carried in
        mh = (mh << 1) & full
        pv = mh | (~(xv | ph) & full)
        mv = ph & xv
        if score < best:
            best, end = score, j + 1
    return best, end


def stretches(i: int, n: int) -> list[tuple[int, int]]:
    """The ranges of pieces around piece ``i`` of ``n`` by repeated halving, shortest first, without the piece and the whole."""
    out, low, high = [], 0, n
    while high - low > 1:
        out.append((low, high))
        mid = (low + high) // 2
        low, high = (low, mid) if i < mid else (mid, high)
    return out[:0:-1]


class Matcher:
    """Finds a block of items in texts. Pickles as the items; the automaton is built where it is used."""

    def __init__(self, items: list[tuple[int, str]], max_error: float = MAX_ERROR):
        self.items = [(i, n) for i, t in items if (n := normalise(t or ""))]
        self.max_error = max_error
        self.machine = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"machine": None}

    def _build(self) -> None:
        import ahocorasick

        self.machine = ahocorasick.Automaton()
        self.info, where = [], {}
        for x, (_, norm) in enumerate(self.items):
            k = budget(len(norm), self.max_error)
            self.info.append((k, masks(norm)))
            for i, (_, p) in enumerate(pieces(norm, k)):
                where.setdefault(p, []).append((x, i))
        for p, v in where.items():
            self.machine.add_word(p, (len(p), v))
        if where:
            self.machine.make_automaton()

    def _holds(self, x: int, i: int, start: int, norm: str) -> bool:
        """Whether every stretch around piece ``i`` is there with fewer edits than it has pieces; ``start`` is where the item would begin."""
        pattern, n = self.items[x][1], self.info[x][0] + 1
        m = len(pattern)
        for low, high in stretches(i, n):
            a, b, e = m * low // n, m * high // n, high - low - 1
            if myers(masks(pattern[a:b]), b - a, norm[max(0, start + a - e) : max(0, start + b + e)])[0] > e:
                return False
        return True

    def find(self, text: str) -> list[tuple[int, int, int, int]]:
        """``(item_id, distance, end, length)`` of every item within its budget; ``end`` and ``length`` in normalised text."""
        if self.machine is None:
            self._build()
        norm = normalise(text)
        if not norm or not len(self.machine):
            return []
        spots: dict[int, list[int]] = {}
        for end, (size, v) in self.machine.iter(norm):
            for x, i in v:
                start = end - size + 1 - len(self.items[x][1]) * i // (self.info[x][0] + 1)
                if self._holds(x, i, start, norm):
                    spots.setdefault(x, []).append(start)
        out = []
        for x, starts in spots.items():
            (item_id, pattern), (k, peq) = self.items[x], self.info[x]
            m, best = len(pattern), None
            starts.sort()
            i = 0
            while i < len(starts):  # hits whose windows touch are verified as one window
                low = high = starts[i]
                while i < len(starts) and starts[i] <= high + m:
                    high = starts[i]
                    i += 1
                a, b = max(0, low - k), min(len(norm), high + m + k)
                d, e = myers(peq, m, norm[a:b])
                if d <= k and (best is None or d < best[0]):
                    best = (d, a + e)
                    if d == 0:
                        break
            if best:
                out.append((item_id, *best, m))
        return out


def item_blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple[int, str]]]:
    """The test items in blocks of bounded size, read one partition at a time."""
    block, size = [], 0
    for r in benchmark.where(F.length(F.trim("text")) > 0).select(F.col("item_id").cast("long").alias("item_id"), "text").toLocalIterator():
        if block and size + len(r["text"]) > block_bytes:
            yield block
            block, size = [], 0
        block.append((r["item_id"], r["text"]))
        size += len(r["text"])
    yield block


def benchmark_matches(docs: DataFrame, benchmark: DataFrame, max_error: float = MAX_ERROR, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``(doc_id, item_id, distance, item_length, match_end)`` for every item a document holds within its budget."""
    require(docs, "doc_id", "text")
    require(benchmark, "item_id", "text")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty(docs).alias("t"))
    schema = "doc_id long, item_id long, distance int, item_length int, match_end int"
    out = None
    for block in item_blocks(benchmark, block_bytes):
        matcher = Matcher(block, max_error)

        def run(batches: Iterator[pa.RecordBatch], matcher: Matcher = matcher) -> Iterator[pa.RecordBatch]:
            for b in batches:
                found = [(d, i, e, m, end) for d, t in zip(b.column(0).to_pylist(), b.column(1)) for i, e, end, m in matcher.find(t.as_py())]
                cols = list(zip(*found)) or [[]] * 5
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["doc_id", "item_id", "distance", "item_length", "match_end"])

        part = rows.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, max_error: float = MAX_ERROR, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` that hold no test item, with the columns of ``docs``."""
    require(docs, "text")
    for block in item_blocks(benchmark, block_bytes):
        docs = keep_rows(docs, "text", _without(Matcher(block, max_error)))
    return docs


def _without(matcher: Matcher):
    return lambda texts: [not matcher.find(t) for t in texts.to_pylist()]
