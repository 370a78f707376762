"""Sharding along a Hilbert curve, DataFrame functions only.

Four metadata dimensions are quantised to four bits each (source and lang by the share of rows
before them in sort order, size by its power of two, doc_id by its range), the cell gets its index
on the Hilbert curve, rows are put in curve order and cut into runs of equal row counts. A shard is
thus a box-like region of the four dimensions, so file statistics prune on any of them.

The global place of a row needs no global sort: counts of (cell, run) are summed along the curve
(at most 65,536 cells), a run being a hashed slice of its cell that holds about ``run_rows`` rows,
so a cell that holds a third of all rows is cut into as many runs as it needs. Within a run the
place is a row_number. Only metadata (about 40 bytes a row) is shuffled, never the text.

The law is ``rows``: shard counts are at most one apart. Edge cases: a null text has size 16 and
CRC 0, null source or lang sorts as the empty string, a null doc_id as the smallest; repeated rows get
places of their own; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, require, stored

BITS = 4
SHARDS = 40
RUN_ROWS = 20_000
OVERHEAD = 16


def hilbert_index(dims: list[Column], bits: int = BITS) -> Column:
    """Index on the Hilbert curve of a point with ``bits`` bits a dimension (Skilling's transform)."""
    n = len(dims)
    # inverse undo: from the highest bit down, exchange or invert the low bits of the first axis
    steps = F.array(*[F.struct(F.lit(1 << b).alias("q"), F.lit(i).alias("i")) for b in range(bits - 1, 0, -1) for i in range(n)])

    def undo(x: Column, s: Column) -> Column:
        p = s["q"] - 1
        head, own = F.get(x, F.lit(0)), F.get(x, s["i"])
        bit = own.bitwiseAND(s["q"]) != 0
        swap = head.bitwiseXOR(own).bitwiseAND(p)
        first = F.when(bit, head.bitwiseXOR(p)).otherwise(head.bitwiseXOR(swap))
        return F.transform(x, lambda v, j: F.when(j == 0, first).when((j == s["i"]) & ~bit, v.bitwiseXOR(swap)).otherwise(v))

    x = F.aggregate(steps, F.array(*[d.cast("int") for d in dims]), undo)
    # Gray encode: each axis takes the one before it, and all take the parity of the last
    gray = F.aggregate(F.sequence(F.lit(1), F.lit(n - 1)), x, lambda a, i: F.transform(a, lambda v, j: F.when(j == i, v.bitwiseXOR(F.get(a, i - 1))).otherwise(v)))

    def parity(last: Column) -> Column:
        t = F.lit(0)
        for b in range(bits - 1, 0, -1):
            t = t.bitwiseXOR(F.when(last.bitwiseAND(F.lit(1 << b)) != 0, F.lit((1 << b) - 1)).otherwise(F.lit(0)))
        return t

    last = F.transform(F.array(gray), lambda g: F.transform(g, lambda v: v.bitwiseXOR(parity(F.get(g, F.lit(n - 1))))))[0]
    # interleave, highest bit of the first axis first
    places = F.array(*[F.struct(F.lit(b).alias("b"), F.lit(i).alias("i")) for b in range(bits - 1, -1, -1) for i in range(n)])
    bit = lambda g, s: F.expr("0") + F.call_function("getbit", F.get(g, s["i"]), s["b"]).cast("int")
    return F.transform(F.array(last), lambda g: F.aggregate(places, F.lit(0), lambda a, s: a * 2 + bit(g, s)))[0]


def _cuts(df: DataFrame, column: str, parts: int) -> list[str]:
    """At most ``parts - 1`` values of a string column that split its rows, in order, into near-equal shares.

    Values are sorted by range and counted on by partition, so no task orders them all.
    """
    per = stored(df.groupBy(column).agg(F.count("*").alias("c")).repartitionByRange(column).withColumn("part", F.spark_partition_id()), "values")
    before = lambda w: F.coalesce(F.sum("c").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # one row a partition
    sums = per.groupBy("part").agg(F.sum("c").alias("c"))
    starts = sums.select("part", before(Window.orderBy("part")).alias("start"), F.sum("c").over(Window.partitionBy()).alias("total"))
    upto = per.withColumn("within", before(Window.partitionBy("part").orderBy(column))).join(F.broadcast(starts), "part")
    code = upto.select(column, F.floor((F.col("start") + F.col("within")) * parts / F.col("total")).alias("code"))
    return [r[0] for r in code.where("code > 0").groupBy("code").agg(F.min(column)).orderBy("code").select(f"min({column})").collect()]


def _code(column: Column, cuts: list[str]) -> Column:
    out = F.lit(0)
    for c in cuts:
        out = out + (column >= F.lit(c)).cast("int")
    return out


def hilbert_places(docs: DataFrame, shards: int = SHARDS, run_rows: int = RUN_ROWS) -> DataFrame:
    """doc_id, size, text_crc32, cell's curve index ``h``, global ``place``, ``shard`` and ``slot`` of every row."""
    require(docs, "doc_id", "text", "lang", "source")
    body = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    meta = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.length(body) + OVERHEAD).cast("long").alias("size"),
        F.crc32(body).alias("text_crc32"),
        F.coalesce("source", F.lit("")).alias("source"),
        F.coalesce("lang", F.lit("")).alias("lang"),
    )
    meta = stored(meta, "meta")
    low, high, n = meta.agg(F.min("doc_id"), F.max("doc_id"), F.count("*")).first()
    side = 1 << BITS
    span = F.lit((high or 0) - (low or 0) + 1).cast("decimal(20,0)")
    by_id = F.coalesce(F.floor((F.col("doc_id") - F.lit(low or 0)).cast("decimal(20,0)") * side / span), F.lit(0)).cast("int")
    by_size = F.least(F.lit(side - 1), F.greatest(F.lit(0), F.length(F.bin("size")) - 5))
    dims = [_code(F.col("source"), _cuts(meta, "source", side)), _code(F.col("lang"), _cuts(meta, "lang", side)), by_size, by_id]
    cell = F.lit(0)
    for d in dims:
        cell = cell * side + d
    runs = 1 << max(0, math.ceil(math.log2(max(1, (n or 0) / run_rows))))
    # a slice of its cell for each row, spread by doc_id and text, so neither copies nor a range of ids share one
    spread = F.shiftright(F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(1 << 32)) * 40503 + F.col("text_crc32"), 8)
    at = meta.select("doc_id", "size", "text_crc32", cell.cast("int").alias("cell"), F.pmod(spread, F.lit(runs)).cast("int").alias("run"))
    counts = stored(at.groupBy("cell", "run").agg(F.count("*").alias("c")), "counts")
    # cells: at most 2 ** 16, whatever the input
    axes = [F.expr(f"(cell >> {BITS * (3 - i)}) & {side - 1}") for i in range(4)]
    cells = counts.groupBy("cell").agg(F.sum("c").alias("c")).withColumn("h", hilbert_index(axes))
    cells = cells.withColumn("cell_from", F.coalesce(F.sum("c").over(Window.orderBy("h").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    in_cell = F.coalesce(F.sum("c").over(Window.partitionBy("cell").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("cell", "run", in_cell.alias("run_from")).join(F.broadcast(cells.select("cell", "h", "cell_from")), "cell")
    starts = starts.select("cell", "run", "h", (F.col("cell_from") + F.col("run_from")).alias("start"))
    nth = F.row_number().over(Window.partitionBy("cell", "run").orderBy("doc_id", "text_crc32", "size")) - 1
    out = at.join(starts, ["cell", "run"]).withColumn("place", F.col("start") + nth)
    shard = F.expr(f"cast(cast(place as decimal(20,0)) * {shards} div {max(n or 0, 1)} as int)")
    out = out.withColumn("shard", shard)
    first = F.expr(f"(cast(shard as decimal(20,0)) * {n or 0} + {shards - 1}) div {shards}").cast("long")
    return out.select("doc_id", "size", "text_crc32", "h", "place", "shard", (F.col("place") - first).cast("long").alias("slot"))


def shard_rows(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (null under the law ``rows``), and h."""
    return hilbert_places(docs, shards).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "h")


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, files: int = 4) -> None:
    """Write ``docs`` as one folder a shard, for readers that prune on file statistics: about ``files`` files each, every one a range of slots in their order.

    Rows find their places by doc_id, size and CRC; of rows alike in all three each takes a place of its own. Edge cases are
    those above; a column named ``shard`` or ``slot`` is refused, as the folders and files have these; other names may be any.
    """
    if taken := {"shard", "slot"} & {c.lower() for c in docs.columns}:
        raise ValueError(f"columns {sorted(taken)} are names of the shards' own")
    keys = fresh(docs.columns, "id", "crc", "size", "nth")
    i, crc, size, nth = keys
    body = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    number = F.row_number().over(Window.partitionBy(i, crc, size).orderBy(crc))
    least = F.lit(-(2**63))  # as a null doc_id sorts
    places = stored(hilbert_places(docs, shards).select(F.coalesce("doc_id", least).alias(i), F.col("text_crc32").alias(crc), F.col("size").alias(size), "shard", "slot").withColumn(nth, number), "places")
    rows = docs.withColumns({i: F.coalesce(F.col("doc_id").cast("long"), least), crc: F.crc32(body), size: (F.length(body) + OVERHEAD).cast("long")}).withColumn(nth, number)
    both = rows.join(places, keys).drop(*keys)
    both.repartitionByRange(shards * files, "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
