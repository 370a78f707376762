"""Exact dedup by deterministic block naming (Karp-Miller-Rosenberg style), DataFrame functions only.

Each text's UTF-8 bytes are cut into fixed-size blocks. The distinct blocks are sorted (by two 64-bit hashes
of the block, then by the block) and their place becomes an integer name, whatever the number of partitions; then adjacent
names of a text are paired and the distinct pairs, sorted, named in turn, until each text has one integer. Names are given to
contents, not to hashes, so two texts share an identity exactly when they are equal byte for byte.

The text is shuffled once, as distinct blocks (combined on the map side, so that a block which a
third of all texts share travels once a map task). Occurrences look their name up by the two
hashes of the block; the dictionary itself shows whether that key is unique among all distinct
blocks, and blocks whose keys collide are told apart by their sorted content. Rows of a heavy block, pair or group stay
where they are and get its name by a broadcast of the heavy keys (``spread_join``), so no task holds them all.

Edge cases: a null text counts as empty (one empty block); an empty table gives no rows; rows
repeated whole each count in ``group_size`` and each come back; of a group without any doc_id the
``keep_id`` is null; other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_stored, fresh, require, spread_join, stored, text_or_empty

BLOCK_BYTES = 8192
_NO_ID = -(2**63)


def _key(block: Column) -> list[Column]:
    return [F.xxhash64(block), F.xxhash64(F.lit(1), block)]


def _named(rows: DataFrame, by: list[str]) -> DataFrame:
    """``rows`` with ``name``, their place from 1 in the order of ``by``: sorted by range, numbered by the partitions' row counts."""
    placed = stored(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("at", F.monotonically_increasing_id()), "sorted")
    part = F.shiftright("at", 33)
    before = F.coalesce(F.sum("c").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # one row a partition
    starts = placed.groupBy(part.alias("part")).agg(F.count("*").alias("c")).select("part", before.alias("start"))
    named = placed.withColumn("part", part).join(F.broadcast(starts), "part")
    return named.withColumn("name", F.col("start") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("part", "at", "start")


def _blocks(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    raw = docs.select(F.coalesce(F.col(id_col), F.lit(_NO_ID)).cast("long").alias("k"), text_or_empty(docs, text_col).alias("t"))
    raw = raw.select("k", F.sha2("t", 256).alias("sha"), F.col("t").cast("binary").alias("b"))
    n = F.greatest(F.lit(1), F.ceil(F.length("b") / F.lit(size))).cast("int")
    cut = F.transform(F.sequence(F.lit(0), n - 1), lambda p: F.struct(p.alias("pos"), F.substring(F.col("b"), p * size + 1, F.lit(size)).alias("block")))
    return raw.select("k", "sha", n.alias("n"), F.inline(cut))


def _level_zero(occ: DataFrame, key: Callable[[Column], list[Column]]) -> tuple[DataFrame, list[DataFrame]]:
    keyed = [c.alias(f"h{i}") for i, c in enumerate(key(F.col("block")))]
    hs = [f"h{i}" for i in range(len(keyed))]
    # a row a distinct block; those with the same key are next to each other, so their names go by content whichever of them has which
    blocks = occ.groupBy("block").agg(F.count("*").alias("n")).select(*keyed, "n")
    names = stored(_named(blocks, hs), "names")
    keys = names.groupBy(*hs).agg(F.count("*").alias("c"), F.sum("n").alias("n"), F.min("name").alias("name"))
    at = stored(occ.select("k", "sha", F.col("n").alias("size"), "pos", *keyed), "occurrences")
    pick = lambda df: df.select("k", "sha", F.col("size").alias("n"), "pos", "name")
    if not keys.where("c > 1").head(1):
        return pick(spread_join(at, names, hs)), [names, at]
    twins = stored(keys.where("c > 1"), "twins")
    # keys that several distinct blocks share: their blocks are told apart by sorted content
    full = occ.select("k", "sha", F.col("n").alias("size"), "pos", "block", *keyed)
    few = full.join(twins.select(*hs, F.col("name").alias("least")), hs)
    # the place of a content among the distinct ones of its key: as many as collide
    order = few.select(*hs, "block", "least").distinct().withColumn("name", F.col("least") + F.row_number().over(Window.partitionBy(*hs).orderBy("block")) - 1)
    plain = spread_join(at.join(twins.select(*hs), hs, "left_anti"), keys.where("c = 1").drop("c"), hs)
    return pick(plain).unionByName(pick(few.join(order.select(*hs, "block", "name"), [*hs, "block"]))), [names, at]


def block_identities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, key: Callable[[Column], list[Column]] = _key) -> DataFrame:
    """``(k, sha, level, name)`` for every row of ``docs``: equal ``(level, name)`` means equal texts."""
    require(docs, id_col, text_col)
    occ = _blocks(docs, id_col, text_col, block_bytes)
    zero, names = _level_zero(occ, key)
    named = stored(zero, "level0")
    drop_stored(*names)
    done = named.where("n = 1").select("k", "sha", F.lit(0).alias("level"), "name")
    cur = named.where("n > 1").groupBy("k", "sha", "n", "pos").agg(F.max("name").alias("name"), F.count("*").alias("m"))
    most, level = named.agg(F.max("n")).first()[0] or 1, 0
    while most > 1:
        level += 1
        half = F.col("pos") % 2
        pairs = cur.groupBy("k", "sha", "n", F.expr("pos div 2").cast("int").alias("pos")).agg(
            F.max(F.when(half == 0, F.col("name"))).alias("l"), F.coalesce(F.max(F.when(half == 1, F.col("name"))), F.lit(0)).alias("r"), F.max("m").alias("m")
        )
        pairs = stored(pairs.withColumn("n", F.expr("(n + 1) div 2").cast("int")), "pairs")
        dictionary = stored(_named(pairs.groupBy("l", "r").agg(F.count("*").alias("rows")), ["l", "r"]), "pair_names")
        nxt = stored(spread_join(pairs, dictionary, ["l", "r"], "rows").select("k", "sha", "n", "pos", "name", "m"), "level")
        drop_stored(pairs, dictionary)
        whole = nxt.where("n = 1").select("k", "sha", F.lit(level).alias("level"), "name", "m")
        done = done.unionByName(whole.select("k", "sha", "level", "name", F.explode(F.sequence(F.lit(1), F.col("m").cast("int"))).alias("_i")).drop("_i"))
        cur = nxt.where("n > 1")
        most = (most + 1) // 2
    return done


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, key: Callable[[Column], list[Column]] = _key) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id (largest of the group), group_size, kept, text_sha256."""
    ids = block_identities(docs, id_col, text_col, block_bytes, key)
    groups = ids.groupBy("level", "name").agg(F.max("k").alias("keep"), F.count("*").alias("group_size"))
    out = spread_join(ids, stored(groups.withColumn("rows", F.col("group_size")), "groups"), ["level", "name"], "rows")
    back = lambda c: F.when(F.col(c) != _NO_ID, F.col(c))
    return out.select(back("k").alias("doc_id"), back("keep").alias("keep_id"), "group_size", (F.col("k") == F.col("keep")).alias("kept"), F.col("sha").alias("text_sha256"))


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` that stay: of equal texts the row with the largest doc_id, once; columns of any name are kept.

    Of rows that have both the same doc_id and text any one stays; of texts without any doc_id, too. The limit to
    one row is applied on the map side first, so a row repeated often does not gather in one task.
    """
    keep = exact_groups(docs, id_col, text_col).where("kept").select(F.coalesce("doc_id", F.lit(_NO_ID)).alias("k"), F.col("text_sha256").alias("sha")).distinct()
    k, sha, nth = fresh(docs.columns, "k", "sha", "nth")
    marked = docs.withColumns({k: F.coalesce(F.col(id_col), F.lit(_NO_ID)).cast("long"), sha: F.sha2(text_or_empty(docs, text_col), 256)})
    hit = marked.join(keep.toDF(k, sha), [k, sha], "left_semi")
    first = hit.withColumn(nth, F.row_number().over(Window.partitionBy(k, sha).orderBy(k))).where(F.col(nth) == 1)
    return first.select(*[F.col(f"`{c}`") for c in docs.columns])
