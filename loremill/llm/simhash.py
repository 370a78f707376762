"""SimHash near-dedup with a byte-position inverted index and count filtering.

A fingerprint has 8 bytes. Two fingerprints that differ in at most ``max_bits`` bits differ in at
most that many bytes. One byte alone has a 256th of all rows in its list, so the index posts every distinct
fingerprint under four positional bytes at a time, in 14 ways: the sets of four positions out of eight whose numbers
(0 to 7, as bits) have a XOR of zero. Any three positions are in exactly one of these sets, so two fingerprints
share 14, 7, 3, 1 or at most 1 of their 14 postings when 0, 1, 2, 3 or more of their bytes differ. The postings that
each pair shares are tallied over all lists; pairs under the guaranteed minimum (7 for one bit, 3 for two) go, and the
rest are verified on their differing bits.

Rows of one fingerprint are collapsed first, so copies cost nothing in the index. A list of up to
``list_cap`` fingerprints is paired inside its own row. A longer one would be quadratic; its members take
an exact linear way instead: each posts itself and its 64 one-bit neighbours, and two fingerprints are
within two bits of each other exactly when they share such a post. A pair with a long list in common is settled
there, any other pair has its whole tally in short lists: no link is lost, no pair is dropped.

Edge cases: a null text counts as empty; a text without words has fingerprint zero and is linked like
any other; repeated rows each come back; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache
from itertools import combinations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, fresh, require, spread_join, stored, text_or_empty

SEED = 42
LIST_CAP = 64
MAX_BITS = 2
NUMBER = 16
#: Near copies meet where the least values of BAND_ROWS hash functions over their shingles agree, in one of BANDS bands.
BANDS, BAND_ROWS = 20, 5
RUN = 2048
_NO_ID = -(2**63)


def shingle_hashes(text: str, words: int, seed: int = SEED) -> list[int]:
    """XXH64 of every shingle of ``words`` words, repeats included; A-Z lower-cased, split at ASCII white space."""
    import xxhash

    parts = text.encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return []
    h = xxhash.xxh64_intdigest
    if len(parts) <= words:
        return [h(b" ".join(parts), seed)]
    norm = b" ".join(parts)
    starts, at = [], 0
    for w in parts:
        starts.append(at)
        at += len(w) + 1
    ends = [*(s - 1 for s in starts[words:]), len(norm)]
    return [h(norm[s:e], seed) for s, e in zip(starts, ends)]


def _prints(hashes: list[int], extra: int) -> list[int]:
    """SimHashes of weighted features given as 64-bit hashes, repeats included; the extra ones mix the hashes with other constants."""
    import numpy as np

    if not hashes:
        return [0] * (1 + extra)
    base = np.array(hashes, dtype=np.uint64)
    h = np.empty((1 + extra, len(base)), dtype=">u8")
    h[0] = base
    if extra:  # splitmix64 finaliser over the hash and the number of the fingerprint
        steps = np.array([(r * 0x9E3779B97F4A7C15) & (2**64 - 1) for r in range(1, 1 + extra)], dtype=np.uint64)
        x = base[None, :] + steps[:, None]
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        h[1:] = x ^ (x >> np.uint64(31))
    ones = np.zeros((1 + extra, 64), dtype=np.int64)
    for at in range(0, len(base), 255):  # counts of up to 255 fit a byte
        part = np.ascontiguousarray(h[:, at : at + 255])
        bits = np.unpackbits(part.view(np.uint8)).reshape(1 + extra, -1, 64)
        ones += np.add.reduce(bits, axis=1, dtype=np.uint8)
    packed = np.packbits(ones * 2 > len(base), axis=1)
    return [int.from_bytes(row.tobytes(), "big", signed=True) for row in packed]


def fingerprints(text: str, words: int, extra: int = 0) -> list[int]:
    """The SimHash of ``text`` over its shingles, and ``extra`` more; signed 64 bit."""
    return _prints(shingle_hashes(text, words), extra)


def fingerprint_rows(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``k`` (the doc_id, nulls as the smallest long) and ``fps`` for every row of ``docs``."""
    require(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [fingerprints(t.as_py(), words) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.list_(pa.int64()))], ["k", "fps"])

    rows = docs.select(F.coalesce(F.col(id_col), F.lit(_NO_ID)).cast("long").alias("k"), text_or_empty(docs, text_col).alias("t"))
    return rows.mapInArrow(run, "k long, fps array<long>")


def position_sets() -> list[tuple[int, ...]]:
    """The 14 sets of four byte positions whose XOR is zero."""
    return [c for c in combinations(range(8), 4) if c[0] ^ c[1] ^ c[2] ^ c[3] == 0]


def _signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def least_shared(max_bits: int) -> int:
    """How many postings two fingerprints share at least if up to ``max_bits`` of their bytes differ."""
    return (14, 7, 3)[max_bits]


def postings(nodes: DataFrame) -> DataFrame:
    """``(part, bytes, fp, rep)``: each fingerprint under every set of four positional bytes, with the size ``n`` of its list; lists of one are left out."""
    masks = [sum(0xFF << (8 * i) for i in c) for c in position_sets()]
    keys = F.array(*[F.struct(F.lit(i).alias("part"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("bytes")) for i, m in enumerate(masks)])
    posts = stored(nodes.select("fp", "rep", F.inline(keys)), "posts")
    lists = posts.groupBy("part", "bytes").agg(F.count("*").alias("n")).where("n > 1")
    return stored(spread_join(posts, lists.withColumn("size", F.col("n")), ["part", "bytes"]).withColumnRenamed("size", "n"), "met")


def tallied(met: DataFrame, max_bits: int = MAX_BITS, list_cap: int = LIST_CAP) -> DataFrame:
    """``(x, y, shared)``: pairs of (fp, rep) of lists up to ``list_cap`` that share the guaranteed minimum of postings."""
    short = met.where(f"n <= {list_cap}").groupBy("part", "bytes").agg(F.sort_array(F.collect_list(F.struct("fp", "rep"))).alias("l"))
    pairs = short.selectExpr("inline(flatten(transform(l, (x, i) -> transform(slice(l, i + 2, size(l)), y -> struct(x as x, y as y)))))")
    return pairs.groupBy("x", "y").agg(F.count("*").alias("shared")).where(F.col("shared") >= least_shared(max_bits))


def links(nodes: DataFrame, max_bits: int = MAX_BITS, list_cap: int = LIST_CAP) -> DataFrame:
    """``(a, b)`` of nodes linked by fingerprints, some more than once; ``nodes`` has distinct ``fp`` with a long ``rep``.

    Links between members of long lists go through the smallest rep that shares a one-bit neighbour, so they connect
    the same components.
    """
    if not 0 <= max_bits <= 2:
        raise ValueError("the index guarantees shared postings for up to two differing bytes")
    met = postings(nodes)
    near = tallied(met, max_bits, list_cap).where(f"bit_count(x.fp ^ y.fp) <= {max_bits}").select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b"))
    if not met.where(f"n > {list_cap}").head(1):
        return near
    # the rest, exactly: two fingerprints within two bits share a one-bit neighbour (or one is it)
    long_ = met.where(f"n > {list_cap}").select("fp", "rep").distinct()
    flips = F.array(F.lit(0).cast("long"), *([F.lit(_signed(1 << i)) for i in range(64)] if max_bits else []))
    mids = long_.select("rep", F.col("fp").alias("own"), F.explode(flips).alias("x")).select("rep", F.col("own").bitwiseXOR(F.col("x")).alias("mid"), (F.col("x") != 0).alias("flip"))
    if max_bits < 2:  # one bit: a neighbour only meets the fingerprint itself
        hub = mids.where("not flip").select("mid", F.col("rep").alias("hub"))
    else:
        hub = mids.groupBy("mid").agg(F.min("rep").alias("hub"), F.count("*").alias("n")).where("n > 1").drop("n")
    star = mids.join(hub, "mid").select(F.col("rep").alias("a"), F.col("hub").alias("b"))
    return near.unionByName(star.where("a <> b"))


def simhash_components(docs: DataFrame, words: int = 3, max_bits: int = MAX_BITS, list_cap: int = LIST_CAP) -> DataFrame:
    """``k``, ``fps`` (one fingerprint) and ``root`` (the smallest k reachable) for every row of ``docs``."""
    rows = stored(fingerprint_rows(docs, words).withColumn("fp", F.col("fps")[0]), "fps")
    nodes = stored(rows.groupBy("fp").agg(F.min("k").alias("rep"), F.count("*").alias("n")), "nodes")
    found = components(links(nodes.select("fp", "rep"), max_bits, list_cap))
    named = nodes.join(found, nodes.rep == found.node, "left").select("fp", F.coalesce("root", "rep").alias("root"), "n")
    return spread_join(rows, stored(named, "named"), ["fp"]).select("k", "fps", "root")


def simhash_rows(docs: DataFrame, words: int = 3, max_bits: int = MAX_BITS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row."""
    found = simhash_components(docs, words, max_bits)
    back = lambda c: F.when(F.col(c) != _NO_ID, F.col(c))
    return found.select(back("k").alias("doc_id"), F.lpad(F.lower(F.hex(F.col("fps")[0])), 16, "0").alias("fingerprint"), back("root").alias("component_id"))


@cache
def _band_constants() -> tuple:
    import numpy as np

    draw = np.random.default_rng(SEED)
    return draw.integers(0, 2**31, BANDS * BAND_ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1), draw.integers(0, 2**32, BANDS * BAND_ROWS, dtype=np.uint32)


def band_keys(hashes: list[int]) -> list[int]:
    """``BANDS`` signed 64-bit keys, each of the least values of ``BAND_ROWS`` hash functions over the shingles; none without shingles.

    Two texts agree in one function with a chance of their shingles' Jaccard similarity, whatever kind of edit sets them apart.
    """
    import numpy as np
    import xxhash

    if not hashes:
        return []
    times, plus = _band_constants()
    base = (np.array(hashes, dtype=np.uint64) >> np.uint64(32)).astype(np.uint32)
    least = np.full(len(times), 2**32 - 1, dtype=np.uint32)
    for at in range(0, len(base), 2048):
        least = np.minimum(least, (times[:, None] * base[None, at : at + 2048] + plus[:, None]).min(axis=1))
    return [_signed(xxhash.xxh64_intdigest(row.tobytes(), SEED)) for row in least.reshape(BANDS, BAND_ROWS)]


def _apart(x: str, y: str):
    return F.expr(f"aggregate(zip_with({x}, {y}, (p, q) -> bit_count(p ^ q)), 0, (s, v) -> s + v)")


def tile_links(ids: list[int], sigs, left: list[bool], right: list[bool], most: int) -> list[tuple[int, int]]:
    """Links among the rows of a tile. Those only ``left`` are one group already and meet those ``right``; those ``right`` meet each other too if none is only left.

    A row that has its link needs no other one, so what was reached leaves the rest: every pair is compared or known to be in one group.
    """
    import numpy as np

    out: list[tuple[int, int]] = []
    hits = lambda i, rest: rest[np.bitwise_count(sigs[rest] ^ sigs[i]).sum(1, dtype=np.int64) <= most]
    rest = np.flatnonzero(np.array(right))
    hubs = np.flatnonzero(np.array(left) & ~np.array(right))
    if len(hubs):
        for i in hubs:
            if not len(rest):
                break
            near = hits(i, rest)
            out += [(ids[i], ids[j]) for j in near]
            rest = np.setdiff1d(rest, near, assume_unique=True)
        return out
    while len(rest):
        reached, rest = [rest[0]], rest[1:]
        while reached and len(rest):
            i = reached.pop()
            near = hits(i, rest)
            out += [(ids[i], ids[j]) for j in near]
            reached += near.tolist()
            rest = np.setdiff1d(rest, near, assume_unique=True)
    return out


def _long_lists(members: DataFrame, sig: DataFrame, most: int, doubtful: int) -> tuple[DataFrame, DataFrame]:
    """``(a, b)`` that connect what all pairs of each list would, and pairs with the hub up to ``doubtful`` bits apart; ``members`` has ``part``, ``key`` and ``rep``.

    A list's smallest rep is compared with all others first. Those it fails meet each other and those it passes, in tiles of two
    runs of about ``RUN`` each, so a list that is one group costs one comparison a member and no task holds a whole list.
    """
    import numpy as np

    on = ["part", "key"]
    hubs = members.groupBy(*on).agg(F.min("rep").alias("hub"))
    far = members.join(hubs, on).join(sig.withColumnRenamed("sig", "x"), F.col("rep") == F.col("k")).drop("k")
    far = far.join(sig.withColumnRenamed("sig", "y"), F.col("hub") == F.col("k")).drop("k").withColumn("d", _apart("x", "y")).withColumn("ok", F.col("d") <= most)
    first = stored(far.select(*on, "hub", "rep", "ok", "d", F.col("x").alias("sig")), "hubs")
    # a run is a hash class; failed members (right) also meet the passed ones (left)
    counts = first.groupBy(*on).agg(F.count_if(~F.col("ok")).alias("nr"), F.count_if("ok").alias("nl")).where("nr > 0")
    runs = lambda n: F.ceil(F.col(n) / F.lit(RUN)).cast("int")
    todo = first.join(counts.select(*on, runs("nr").alias("gr"), runs("nl").alias("gl")), on)
    mine = todo.withColumn("run", F.pmod(F.xxhash64("rep"), F.when(F.col("ok"), F.col("gl")).otherwise(F.col("gr"))).cast("int"))
    # tiles (i, j): i below 0 is a run of passed members
    passed = F.transform(F.sequence(F.lit(0), F.col("gr") - 1), lambda j: F.struct((-1 - F.col("run")).alias("i"), j.alias("j")))
    cross = F.transform(F.sequence(F.lit(0), F.col("gl") - 1), lambda i: F.struct((-1 - i).alias("i"), F.col("run").alias("j")))
    within = F.transform(F.sequence(F.lit(0), F.col("gr") - 1), lambda j: F.struct(F.least(j, "run").alias("i"), F.greatest(j, "run").alias("j")))
    tiles = mine.select(*on, "rep", "ok", "sig", F.inline(F.when(F.col("ok"), passed).otherwise(F.concat(cross, within))))

    def run(table: pa.Table) -> pa.Table:
        ids, ok = table.column("rep").to_pylist(), table.column("ok").to_pylist()
        sigs = np.array(table.column("sig").to_pylist(), dtype=np.int64).view(np.uint64).reshape(len(ids), -1)
        found = tile_links(ids, sigs, ok, [not x for x in ok], most)
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    rest = tiles.groupBy(*on, "i", "j").applyInArrow(run, "a long, b long")
    with_hub = lambda which: first.where(which).select(F.col("hub").alias("a"), F.col("rep").alias("b"))
    return with_hub("ok").unionByName(rest), with_hub((~F.col("ok")) & (F.col("d") <= doubtful))


def index_pairs(nodes: DataFrame, max_bits: int = MAX_BITS, list_cap: int = LIST_CAP) -> DataFrame:
    """``(a, b)``, a < b: nodes (rep and sig) that the index finds by their first fingerprints; of nodes with the same one each meets the smallest."""
    first = nodes.select("rep", F.col("sig")[0].alias("fp"))
    firsts = stored(first.groupBy("fp").agg(F.min("rep").alias("hub"), F.count("*").alias("n")), "first_prints")
    same = spread_join(first, firsts, ["fp"]).where("hub <> rep").select(F.col("hub").alias("a"), F.col("rep").alias("b"))
    found = links(firsts.select("fp", F.col("hub").alias("rep")), max_bits, list_cap)
    return same.unionByName(found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))


def near_rows(docs: DataFrame, words: int = 5, similarity: float = 0.8, number: int = NUMBER, list_cap: int = LIST_CAP) -> DataFrame:
    """``k`` (doc_id), ``h1`` and ``h2`` (hashes of the text) and ``grp`` for every row: one ``grp`` for each group of texts whose ``words``-word shingles are alike by ``similarity`` or more.

    Texts meet first in the byte-position index of their first fingerprints, its postings tallied (``index_pairs``): every pair within ``MAX_BITS`` bits, in lists
    longer than ``list_cap`` with their hub only. 64 bits of shingles differ more at a similarity of 0.8 than byte positions can find, so further texts meet where
    one of ``BANDS`` keys of least shingle hashes is the same: a chance of 1 - (1 - 0.8 ** 5) ** 20 = 0.9996 at 0.8 for
    any kind of edit. What meets is sieved by ``number`` SimHashes of its shingles, 64 bits each, whose differing bits
    together tell the angle and so the similarity to about 0.03: pairs four deviations below or above the threshold are decided by
    them, those between that no sure link joins by their exact sets of shingles. Every pair that meets is compared, or is in one group
    already; lists longer than ``list_cap`` are compared in tiles, there exactly with the list's hub only. Texts with the same fingerprints are one node, numbered
    on its own: rows are told apart by doc_id and text, so a doc_id that several texts have, or none, joins nothing.
    """
    require(docs, "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.int64())
        for b in batches:
            keys, sigs = [], []
            for t in b.column(3):  # one text's shingles at a time
                hashes = shingle_hashes(t.as_py(), words)
                keys.append(band_keys(hashes))
                sigs.append(_prints(hashes, number - 1))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(keys, kind), pa.array(sigs, kind)], ["k", "h1", "h2", "keys", "sig"])

    source = docs.select(*[c.alias(a) for c, a in zip(_row_key(docs), ("k", "h1", "h2"))], text_or_empty(docs).alias("t"))
    rows = stored(source.mapInArrow(run, "k long, h1 long, h2 long, keys array<long>, sig array<long>"), "fps")
    # a node is a distinct sig; its keys are those of all its texts
    nodes = stored(rows.groupBy("sig").agg(F.count("*").alias("n")).withColumn("rep", F.monotonically_increasing_id()), "nodes")
    named = stored(spread_join(rows, nodes, ["sig"]).select("k", "h1", "h2", "rep", "keys"), "named")
    sig = nodes.select(F.col("rep").alias("k"), "sig")
    on = ["part", "key"]
    posts = stored(named.select("rep", F.posexplode("keys").alias("part", "key")).distinct(), "posts")
    lists = posts.groupBy(*on).agg(F.count("*").alias("n")).where("n > 1")
    met = stored(spread_join(posts, lists.withColumn("size", F.col("n")), on).withColumnRenamed("size", "n"), "met")
    short = met.where(f"n <= {list_cap}").groupBy(*on).agg(F.sort_array(F.collect_list("rep")).alias("l"))
    banded = short.selectExpr("inline(flatten(transform(l, (x, i) -> transform(slice(l, i + 2, size(l)), y -> struct(x as a, y as b)))))")
    pairs = index_pairs(nodes, list_cap=list_cap).unionByName(banded).distinct()
    # the angle between shingle vectors of two texts of one length with that similarity, and how far signatures stray from it
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    most, stray = int(64 * number * share), 4 * math.sqrt(64 * number * share * (1 - share))
    ends = pairs.join(sig.select(F.col("k").alias("a"), F.col("sig").alias("x")), "a").join(sig.select(F.col("k").alias("b"), F.col("sig").alias("y")), "b")
    apart = stored(ends.select("a", "b", _apart("x", "y").alias("d")).where(F.col("d") <= most + stray), "apart")
    links_, doubt = apart.where(F.col("d") <= most - stray).select("a", "b"), apart.where(F.col("d") > most - stray).select("a", "b")
    if met.where(f"n > {list_cap}").head(1):
        of_long, in_doubt = _long_lists(met.where(f"n > {list_cap}").select(*on, "rep"), sig, most, int(most + stray))
        links_, doubt = links_.unionByName(of_long), doubt.unionByName(in_doubt)
    found = _joined(nodes, components(links_))
    # pairs of one group need no proof
    root = stored(found.select("rep", "grp"), "sure")
    across = doubt.join(root.select(F.col("rep").alias("a"), F.col("grp").alias("ga")), "a").join(root.select(F.col("rep").alias("b"), F.col("grp").alias("gb")), "b").where("ga <> gb")
    across = stored(across.distinct(), "doubt")
    if across.head(1):
        proven = _proven(docs, named, across, words, similarity)
        more = components(proven.select(F.col("ga").alias("a"), F.col("gb").alias("b")))
        found = found.join(more.select(F.col("node").alias("grp"), F.col("root")), "grp", "left").select("rep", F.coalesce("root", "grp").alias("grp"), "n")
    return spread_join(named.drop("keys"), stored(found, "groups"), ["rep"]).select("k", "h1", "h2", "grp")


def _joined(nodes: DataFrame, found: DataFrame) -> DataFrame:
    return nodes.join(found, nodes.rep == found.node, "left").select("rep", F.coalesce("root", "rep").alias("grp"), "n")


#: Texts to be compared exactly whose keys are broadcast at most.
MANY_KEYS = 200_000


def _proven(docs: DataFrame, named: DataFrame, pairs: DataFrame, words: int, similarity: float) -> DataFrame:
    """Those of ``pairs`` (a, b and more) whose texts' sets of shingle hashes are alike by ``similarity``: shared ones to all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [sorted({_signed(h) for h in shingle_hashes(t.as_py(), words)}) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.list_(pa.int64()))], ["rep", "set"])

    reps = pairs.select(F.col("a").alias("rep")).unionByName(pairs.select(F.col("b").alias("rep"))).distinct()
    # one row stands for a node, as its texts have the same signature
    keys = stored(named.join(reps, "rep", "left_semi").groupBy("rep").agg(F.min(F.struct("k", "h1", "h2")).alias("m")).select("rep", "m.*"), "doubtful")
    few = keys.limit(MANY_KEYS + 1).count() <= MANY_KEYS
    source = docs.select(*[c.alias(x) for c, x in zip(_row_key(docs), ("k", "h1", "h2"))], text_or_empty(docs).alias("t"))
    texts = source.join(F.broadcast(keys) if few else keys, ["k", "h1", "h2"]).select("rep", "t")
    sets = stored(texts.mapInArrow(run, "rep long, set array<long>").groupBy("rep").agg(F.first("set").alias("set")), "shingle_sets")
    side = lambda a, x: sets.select(F.col("rep").alias(a), F.col("set").alias(x))
    both = pairs.join(side("a", "x"), "a").join(side("b", "y"), "b").withColumn("shared", F.size(F.array_intersect("x", "y")))
    return both.where(F.col("shared") >= F.lit(similarity) * (F.size("x") + F.size("y") - F.col("shared"))).drop("x", "y", "shared")


def _row_key(docs: DataFrame) -> list:
    """What tells a row of ``docs``: its doc_id (nulls as the smallest long) and two hashes of its text."""
    text = text_or_empty(docs)
    return [F.coalesce(F.col("doc_id"), F.lit(_NO_ID)).cast("long"), F.xxhash64(text), F.xxhash64(F.lit(1), text)]


def near_groups(docs: DataFrame, words: int = 5, similarity: float = 0.8, number: int = NUMBER, list_cap: int = LIST_CAP) -> DataFrame:
    """``k`` and ``root``, the smallest doc_id of its group, for every row."""
    rows = stored(near_rows(docs, words, similarity, number, list_cap), "near")
    groups = stored(rows.groupBy("grp").agg(F.min("k").alias("root"), F.count("*").alias("n")), "roots")
    return spread_join(rows, groups, ["grp"]).select("k", "root")


def drop_near_duplicates(docs: DataFrame, words: int = 5, similarity: float = 0.8, number: int = NUMBER, list_cap: int = LIST_CAP) -> DataFrame:
    """Of each group of near copies one row stays, that with the smallest doc_id; the columns are those of ``docs``.

    Edge cases: a null text counts as empty, and all texts without words are one group; a null doc_id comes before all
    others; of several texts with the smallest doc_id one stays, by its hash, and of rows that have the same doc_id
    and text one; an unrelated text of a doc_id that goes stays; an empty table gives no rows; columns of any name are kept.
    """
    rows = stored(near_rows(docs, words, similarity, number, list_cap), "near")
    kept = rows.groupBy("grp").agg(F.min(F.struct("k", "h1", "h2")).alias("m")).select("m.*")
    names = fresh(docs.columns, "k", "h1", "h2")
    kept = stored(kept.toDF(*names), "kept")
    whole = docs.withColumns(dict(zip(names, _row_key(docs)))).join(kept, names, "left_semi")
    if rows.groupBy("k", "h1", "h2").agg(F.count("*").alias("n")).where("n > 1").join(kept.toDF("k", "h1", "h2"), ["k", "h1", "h2"], "left_semi").head(1):
        whole = whole.groupBy(*names).agg(F.first(F.struct(*[F.col(f"`{c}`") for c in docs.columns])).alias("row")).select("row.*")
    return whole.select(*[F.col(f"`{c}`") for c in docs.columns])
