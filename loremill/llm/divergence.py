"""Source divergence audit: how far apart the word use of a language's sources is, by two-dimensional tiles of groups.

A group is a (lang, source). Words are counted in the map tasks, so what is shuffled are counts, not words. A language keeps the
terms that ``least_docs`` of its documents have; its kept terms, sorted, are cut into vocabulary chunks of ``CHUNK`` terms, and a group's
counts in a chunk are packed into one row (places and counts as bytes). A language's groups, sorted, are cut into blocks
of ``BLOCK``; each packed row is replicated to the tiles of its block with every block of the language, and a tile (block by block,
for ``SPAN`` successive chunks) is one task's stream: chunk after chunk it adds to the matrix of differences of its pairs, so
it holds one chunk's vectors and one matrix, whatever the vocabulary. Spans of a pair are added up by Spark.

Shares are integers, p = 1 + floor(1e9 (count + 5) / (N + 5 V)), computed in three steps of a thousand, so no product passes
64 bits below 9e15 words of a group (decimals where Spark computes them).

Edge cases: null text, lang and source are empty; a group without kept terms has shares of zero counts, a language without kept terms
differences of 0; an empty table gives no rows; repeated rows count as documents of their own; a text of any length is counted in
slices; other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import require, spread_join, stored

LEAST_DOCS, PRIOR, SCALE, TOP = 30, 5, 1_000_000_000, 50
CHUNK, BLOCK, SPAN = 4096, 32, 16
#: Distinct (lang, source, term) that a task counts before it hands them on.
HELD = 300_000
_SLICE = 1 << 22
#: ASCII letters, lower-cased, and all bytes of other characters stand; everything else parts terms.
_FOLD = bytes(b | 0x20 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_COUNTED = "lang string, source string, term string, n long, docs long"


def _slices(raw: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, some megabytes at a time; no cut goes through a term."""
    carry = b""
    for at in range(0, len(raw), _SLICE):
        folded = carry + raw[at : at + _SLICE].translate(_FOLD)
        last = folded.rfind(b" ") if at + _SLICE < len(raw) else len(folded)
        yield folded[: max(last, 0)].split()
        carry = folded[max(last, 0) :]


def term_counts(docs: DataFrame) -> DataFrame:
    """``(lang, source, term, n, docs)``, added up within each map task only; a group has a row with a null term too."""
    require(docs, "text", "lang", "source")
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")], F.coalesce("text", F.lit("")).cast("binary").alias("t"))
    types = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()]
    schema = pa.schema([pa.field(n, t) for n, t in zip(("lang", "source", "term", "n", "docs"), types)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        groups: set[tuple[str, str]] = set()

        def handed() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, df) in held.items():
                keys = list(n)
                for i in range(0, len(keys), 50_000):
                    some = keys[i : i + 50_000]
                    cols = [pa.array([lang] * len(some)), pa.array([source] * len(some)), pa.array(some, pa.binary()).cast(pa.string()), pa.array([n[k] for k in some], pa.int64()), pa.array([df[k] for k in some], pa.int64())]
                    yield pa.RecordBatch.from_arrays(cols, schema=schema)
            fresh = [g for g in held if g not in groups]
            groups.update(fresh)
            if len(groups) > HELD:
                groups.clear()
            if fresh:
                yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in fresh]), pa.array([g[1] for g in fresh]), pa.nulls(len(fresh), pa.string()), pa.array([0] * len(fresh), pa.int64()), pa.array([0] * len(fresh), pa.int64())], schema=schema)
            held.clear()

        size = 0
        for b in batches:
            for lang, source, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                n, df = held.setdefault((lang, source), (Counter(), Counter()))
                before, raw, parts = len(n), t.as_py(), 0
                mine: set[bytes] = set()
                for words in _slices(raw):
                    n.update(words)
                    mine.update(words)
                    parts += 1
                df.update(mine)
                size += len(n) - before + 1
                if size > HELD:
                    yield from handed()
                    size = 0
        yield from handed()

    return rows.mapInArrow(run, _COUNTED)


def _numbered(rows: DataFrame, *by: str) -> DataFrame:
    """``rows`` with ``place``, a number from 0 in the order of ``by``: sorted by range, numbered by the partitions' row counts."""
    placed = stored(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("at", F.monotonically_increasing_id()), "terms")
    part = F.shiftright("at", 33)
    # one row a partition
    counts = placed.groupBy(part.alias("part")).agg(F.count("*").alias("c"))
    starts = counts.select("part", F.coalesce(F.sum("c").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    j = placed.withColumn("part", part).join(F.broadcast(starts), "part")
    return j.withColumn("place", F.col("start") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).drop("part", "at", "start")


def share(count: str, total: str, terms: str) -> Column:
    """p of a count among ``total`` of ``terms`` kept terms, exactly."""
    return F.expr(f"(cast({count} + {PRIOR} as decimal(19, 0)) * cast({SCALE} as decimal(10, 0))) div cast({total} + {PRIOR} * {terms} as decimal(19, 0)) + 1")


def shares(counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """The same over integer arrays; ``totals`` are N + 5 V. Three digits at a time, so that nothing passes 64 bits."""
    rest, out = counts + PRIOR, np.zeros_like(counts)
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // totals
        rest = rest % totals
    return out + 1


class _Tile:
    """Differences of the groups of one block from those of another, over the chunks of a span."""

    def __init__(self, key: tuple[str, int, int, int], block: int, chunk: int, span: int):
        self.key, self.block, self.size, self.last = key, block, chunk, (key[3] + 1) * span
        self.names: tuple[list[str], list[str]] = ([], [])
        self.totals: tuple[list[int], list[int]] = ([], [])
        self.at: dict[int, int] = {}
        self.terms, self.chunk, self.matrix = 0, key[3] * span, None
        self.packed: list[tuple[int, np.ndarray, np.ndarray]] = []

    def group(self, gid: int, source: str, total: int, terms: int) -> None:
        self.terms = terms
        for side in (0, 1):
            if gid // self.block == self.key[1 + side]:
                self.at[gid] = len(self.names[side])
                self.names[side].append(source)
                self.totals[side].append(total)

    def counts(self, chunk: int, gid: int, places: np.ndarray, n: np.ndarray) -> None:
        while self.chunk < chunk:
            self.add_chunk()
        self.packed.append((gid, places, n))

    def add_chunk(self) -> None:
        """The chunk's part of the matrix; groups without a row have zero counts."""
        if self.matrix is None:
            self.matrix = np.zeros((len(self.names[0]), len(self.names[1])), np.int64)
        size = min(self.size, self.terms - self.chunk * self.size)
        if size > 0 and self.matrix.size:
            sides = []
            for side in (0, 1) if self.key[1] != self.key[2] else (0,):
                totals = np.array(self.totals[side], np.int64)
                p = np.repeat(shares(np.zeros(len(totals), np.int64), totals)[:, None], size, axis=1)
                for gid, places, n in self.packed:
                    if gid // self.block == self.key[1 + side]:
                        k = self.at[gid]
                        p[k, places] = shares(n, totals[k])
                sides.append(p)
            for k, row in enumerate(sides[0]):
                self.matrix[k] += np.abs(sides[-1] - row).sum(axis=1)
        self.packed, self.chunk = [], self.chunk + 1

    def end(self) -> list[tuple[str, str, str, int]]:
        while self.chunk < min(self.last, -(-self.terms // self.size)) or self.matrix is None:
            self.add_chunk()
        same = self.key[1] == self.key[2]
        return [(self.key[0], a, b, int(self.matrix[x, y])) for x, a in enumerate(self.names[0]) for y, b in enumerate(self.names[1]) if not same or x < y]


def _tiled(rows: DataFrame, block: int, chunk_size: int, span_size: int) -> DataFrame:
    """``(lang, a, b, value)`` of each tile and span; ``rows`` are sorted by tile and chunk, the groups' heads first."""
    schema = pa.schema([("lang", pa.string()), ("a", pa.string()), ("b", pa.string()), ("value", pa.int64())])

    def out(found: list[tuple[str, str, str, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), schema.types)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile: _Tile | None = None
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                b = whole.slice(start, 256)
                plain = [b.column(b.schema.get_field_index(c)).to_pylist() for c in ("lang", "i", "j", "span", "chunk", "gid", "source", "total", "terms")]
                cells = b.column(b.schema.get_field_index("cells"))
                for k, (lang, i, j, span, chunk, gid, source, total, terms) in enumerate(zip(*plain)):
                    if tile is None or tile.key != (lang, i, j, span):
                        if tile is not None and (found := tile.end()):
                            yield out(found)
                        tile = _Tile((lang, i, j, span), block, chunk_size, span_size)
                    if chunk < 0:
                        tile.group(gid, source, total, terms)
                    else:
                        values = cells[k].values
                        tile.counts(chunk, gid, values.field(0).to_numpy(), values.field(1).to_numpy())
        if tile is not None and (found := tile.end()):
            yield out(found)

    return rows.mapInArrow(run, "lang string, a string, b string, value long")


def _dealt(rows: DataFrame) -> DataFrame:
    """``rows`` (with block and blocks) to each tile that their block is part of."""
    each = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return each.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")}).drop("block", "blocks", "other")


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP, block: int = BLOCK, chunk: int = CHUNK, span: int = SPAN) -> DataFrame:
    """lang, source, part, item, value and rank: each group's distance to every other source of its language (``pair``) and
    its ``top`` terms above the language's share (``term``)."""
    counted = stored(term_counts(docs).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "counts")
    words = counted.where("term is not null")
    terms = words.groupBy("lang", "term").agg(F.sum("docs").alias("df"), F.sum("n").alias("everywhere"), F.count("*").alias("n")).where(F.col("df") >= least_docs)
    numbered = stored(_numbered(terms.select("lang", "term", "everywhere", "n"), "lang", "term"), "vocabulary")
    cells = stored(spread_join(words.select("lang", "source", "term", F.col("n").alias("count")), numbered, ["lang", "term"]), "cells")
    # all there is to know of a group, a row each
    langs = numbered.groupBy("lang").agg(F.count("*").alias("terms"), F.min("place").alias("start"), F.sum("everywhere").alias("lang_total"))
    totals = cells.groupBy("lang", "source").agg(F.sum("count").alias("total"), F.count("*").alias("n"))
    ordered = stored(_numbered(counted.where("term is null").select("lang", "source"), "lang", "source"), "groups")
    spans = ordered.groupBy("lang").agg(F.min("place").alias("first"), F.count("*").alias("groups"))
    zero = lambda *cs: {c: F.coalesce(c, F.lit(0)).cast("long") for c in cs}
    # groups of a language are few beside its terms; its two figures go to them by its name
    lang = spans.join(langs, "lang", "left").withColumns(zero("terms", "start", "lang_total"))
    groups = spread_join(ordered, lang.withColumn("n", F.col("groups")), ["lang"]).join(totals, ["lang", "source"], "left").withColumns(zero("total", "n"))
    groups = stored(groups.withColumn("gid", F.col("place") - F.col("first")).drop("place", "first"), "group_totals")
    full = spread_join(cells, groups.where("n > 0"), ["lang", "source"])
    # packed count vectors, a row a group and chunk
    placed = full.withColumn("k", F.col("place") - F.col("start"))
    packed = placed.groupBy("lang", "source", "gid", "groups", F.expr(f"k div {chunk}").alias("chunk")).agg(F.collect_list(F.struct((F.col("k") % chunk).cast("int").alias("k"), F.col("count").alias("n"))).alias("cells"))
    blocks = {"block": F.expr(f"gid div {block}"), "blocks": F.ceil(F.col("groups") / F.lit(block)).cast("long")}
    vectors = packed.withColumns(blocks | {"span": F.expr(f"chunk div {span}")})
    heads = groups.withColumns(blocks | {"span": F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0), F.ceil(F.col("terms") / F.lit(chunk * span)) - 1).cast("long")))})
    heads = heads.select("lang", "source", "gid", F.lit(-1).cast("long").alias("chunk"), "block", "blocks", "span", (F.col("total") + PRIOR * F.col("terms")).alias("total"), "terms")
    none = {"total": F.lit(0).cast("long"), "terms": F.lit(0).cast("long")}
    rows = _dealt(vectors.select("lang", "source", "gid", "chunk", "block", "blocks", "span", "cells").withColumns(none)).unionByName(_dealt(heads.withColumn("cells", F.lit(None).cast("array<struct<k:int,n:bigint>>"))))
    tile = ["lang", "i", "j", "span"]
    sums = _tiled(rows.repartition(*tile).sortWithinPartitions(*tile, "chunk", "gid"), block, chunk, span).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    both = sums.select("lang", F.inline(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item"), "value"), F.struct(F.col("b").alias("source"), F.col("a").alias("item"), "value"))))
    above = full.select("lang", "source", F.col("term").alias("item"), (share("count", "total", "terms") - share("everywhere", "lang_total", "terms")).alias("value")).where("value > 0")
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    pair = both.withColumn("rank", rank).select("lang", "source", F.lit("pair").alias("part"), "item", "value", "rank")
    term = above.withColumn("rank", rank).where(F.col("rank") <= top).select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")
    return pair.unionByName(term)
