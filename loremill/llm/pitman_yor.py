"""Language-model scoring with a hierarchical Pitman-Yor model over every observed context.

Each word follows a context, the word before it (or a text's start). Every context that occurs in training is a
restaurant; the tables of all of them are the customers of one parent restaurant, whose base is uniform over the
training words and one unknown word. Seating is by Gibbs: given everything else, the table count t of a dish with c
customers in a restaurant of discount d and strength s is drawn from

    p(t) ~ S_d(c, t) * (s + d T)(s + d T + d) ... (t factors) * P_parent(dish) ** t

with generalised Stirling numbers S_d, which sums over all Chinese-restaurant seatings with t tables; customers
beyond the first 64 of a dish are seated one run after another by the restaurant's own rule. After burn-in, the
predictive probabilities of ``SAMPLES`` seatings are averaged, and a text's score is the sum of their logarithms.

How it is spread. A task tokenises about ``CHUNK_TOKENS`` tokens at a time, sums equal (context, word) pairs, and deals
them to buckets as packed arrays: a context's pairs go to one bucket, so its customers and tables are counted there; a
context with a share of 1 / ``HEAVY`` of all tokens or more is split over all buckets by word, and its sums (at most
``HEAVY`` contexts) pass through the driver. A bucket draws its seatings and sends each word's tables to the word's own
bucket, where the parent's tables are drawn and sent back. Totals that several buckets share are brought up to
date twice, after burn-in and after the samples, as in approximate distributed Gibbs sampling; within a bucket they
move with every half sweep. Draws come from a hash of the pair and the sweep, so a task that runs again draws the same.

For scoring, pairs with a share of 1 / ``TOP_PAIRS`` or more and words with one of 1 / ``FREQUENT`` or more are sent to
all tasks (at most so many rows each, 6 and 17 MB); all other pairs of a text are dealt to their buckets, whose answers
are summed by text. A pair that was never seen, of a word that is not frequent, meets its word by a join. Groups are
of bounded size because pairs and words with a great share are never dealt row by row. Words are known by a 64-bit
hash of their bytes: at a billion distinct words a collision has a chance of 0.03.

Edge cases: a null text counts as empty and is its end token alone; a null doc_id is not held out; without
training rows every word is unknown; repeated rows each come back; an empty table gives no rows;
other columns are not read.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stored, require, stored, text_or_empty

FREQUENT = 524_288
TOP_PAIRS = 262_144
HEAVY = 4096
CHUNK_TOKENS = 500_000
CHUNK_BYTES = 2 << 20
#: Training tokens to a bucket, and the least number of buckets.
BUCKET_TOKENS, LEAST_BUCKETS = 1_500_000, 16
BURN_IN, SAMPLES = 3, 3
STRENGTH, ROOT_STRENGTH = 1.0, 1.0
#: Discounts until they are estimated from the counts of counts.
FIRST_D, FIRST_ROOT_D = 0.75, 0.5
EXACT = 64
SEED = 42
WORD_BYTES = 64
_PLACES = np.random.default_rng(SEED).integers(0, 2**64, WORD_BYTES * 256, dtype=np.uint64)
#: The end token, and the context of a text's first word.
END, START = (np.uint64(x) for x in np.random.default_rng(SEED + 1).integers(0, 2**64, 2, dtype=np.uint64))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def held_out(column: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 5 == 1, F.lit(False))


# --- tokens --------------------------------------------------------------------------------------


def word_hash(word: bytes) -> int:
    """The 64-bit hash of one lower-cased word: a random number for each of its bytes by place, summed."""
    if len(word) > WORD_BYTES:
        import xxhash

        return xxhash.xxh64_intdigest(word, SEED)
    raw = np.frombuffer(word, dtype=np.uint8)
    return int(_PLACES[np.arange(len(raw)) * 256 + raw].sum(dtype=np.uint64))


def token_hashes(data: bytes, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens of texts that lie end to end in ``data``, an end token after each, and tokens a text.

    A-Z is lower-cased; words are split at ASCII white space. ``offsets`` has one more entry than there are texts.
    """
    low = np.frombuffer(data.lower(), dtype=np.uint8)
    inside = ~_SPACE[low]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cuts = offsets[:-1][offsets[:-1] < len(low)]
    first[cuts] = inside[cuts]
    starts = np.flatnonzero(first)
    letters = np.flatnonzero(inside)
    at = np.flatnonzero(first[letters])
    sizes = np.diff(np.append(at, len(letters)))
    if len(starts):
        place = np.arange(len(letters)) - np.repeat(at, sizes)
        hashes = np.add.reduceat(_PLACES[(place & (WORD_BYTES - 1)) * 256 + low[letters]], at)
        for i in np.flatnonzero(sizes > WORD_BYTES):
            hashes[i] = word_hash(low[starts[i] : starts[i] + sizes[i]].tobytes())
    else:
        hashes = np.zeros(0, np.uint64)
    words = np.diff(np.searchsorted(starts, offsets))
    out = np.full(len(hashes) + len(words), END, dtype=np.uint64)
    out[np.arange(len(hashes)) + np.repeat(np.arange(len(words)), words)] = hashes
    return out, words + 1


def _slices(column: pa.Array) -> Iterator[tuple[int, int, bytes, np.ndarray]]:
    """Runs of texts of about ``CHUNK_BYTES``: from, to, their bytes and offsets."""
    col = column.cast(pa.large_binary())
    offsets = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset : col.offset + len(col) + 1]
    raw, at = col.buffers()[2], 0
    while at < len(col):
        to = min(len(col), max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK_BYTES))))
        low, high = int(offsets[at]), int(offsets[to])
        yield at, to, (raw[low:high].to_pybytes() if high > low else b""), offsets[at : to + 1] - low
        at = to


def word_counts(texts: DataFrame) -> DataFrame:
    """``(h, c)``, the tokens of the column ``t`` by hash: a sum for some million tokens, then one sum a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, counts, size = [], [], 0

        def summed() -> pa.RecordBatch:
            h, inverse = np.unique(np.concatenate(hashes), return_inverse=True)
            c = np.bincount(inverse, np.concatenate(counts), minlength=len(h)).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c)], ["h", "c"])

        for b in batches:
            for _, _, data, offsets in _slices(b.column(0)):
                h, c = np.unique(token_hashes(data, offsets)[0], return_counts=True)
                hashes.append(h)
                counts.append(c)
                size += len(h)
                if size > CHUNK_TOKENS:
                    yield summed()
                    hashes, counts, size = [], [], 0
        if size:
            yield summed()

    return texts.select("t").mapInArrow(run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


# --- packed arrays -------------------------------------------------------------------------------


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of non-negative integers or floats, integers in the least width, byte planes apart, compressed."""
    import zstandard

    parts = [struct.pack("<I", len(arrays))]
    for a in arrays:
        a = np.ascontiguousarray(a)
        if a.dtype.kind in "iu":
            top = int(a.max()) if len(a) else 0
            a = a.astype(next(t for t in ("<u1", "<u2", "<u4", "<u8") if top < 1 << (8 * int(t[2]))))
        parts.append(struct.pack("<cBQ", a.dtype.kind.encode(), a.dtype.itemsize, len(a)))
        parts.append(a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes())
    return zstandard.compress(b"".join(parts), 1)


def unpack(blob: bytes) -> list[np.ndarray]:
    """What ``pack`` packed; integers as int64, so hashes want ``astype(np.uint64)``."""
    import zstandard

    raw = zstandard.decompress(blob)
    (n,), at, out = struct.unpack_from("<I", raw), 4, []
    for _ in range(n):
        kind, size, length = struct.unpack_from("<cBQ", raw, at)
        at += struct.calcsize("<cBQ")
        planes = np.frombuffer(raw, dtype=np.uint8, count=size * length, offset=at).reshape(size, length)
        at += size * length
        a = np.ascontiguousarray(planes.T).reshape(-1).view(f"<{kind.decode()}{size}")
        out.append(a.astype(np.int64) if kind == b"u" else a.copy())
    return out


def word_order(h: np.ndarray, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of sorted hashes, the frequent ones first, and each one's place among the frequent (-1 for the others)."""
    if not len(frequent):
        return np.arange(len(h)), np.full(len(h), -1)
    place = np.minimum(np.searchsorted(frequent, h), len(frequent) - 1)
    place = np.where(frequent[place] == h, place, -1)
    return np.concatenate([np.flatnonzero(place >= 0), np.flatnonzero(place < 0)]), place


def pack_words(h: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words in ``word_order`` as two arrays: steps between the frequent ones' places, and the others' hashes."""
    known = place >= 0
    return np.diff(place[known], prepend=0), h[~known]


def unpack_words(steps: np.ndarray, others: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    return np.concatenate([frequent[np.cumsum(steps)], others.astype(np.uint64)]) if len(steps) else others.astype(np.uint64)


def _mix(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def pair_keys(u: np.ndarray, w: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return _mix(u * np.uint64(0x9E3779B97F4A7C15) + w)


def find(table: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Places of ``values`` in a sorted ``table``, -1 for those that are not there."""
    if not len(table):
        return np.full(len(values), -1)
    at = np.minimum(np.searchsorted(table, values), len(table) - 1)
    return np.where(table[at] == values, at, -1)


@dataclass
class Shared:
    """What every task gets: the frequent words, sorted by hash, with their counts, and the heavy contexts."""

    n: int
    v: int
    buckets: int
    frequent: np.ndarray
    counts: np.ndarray
    heavy: np.ndarray
    heavy_customers: np.ndarray
    d: float = FIRST_D
    root_d: float = FIRST_ROOT_D
    #: Totals of the parent restaurant and the heavy contexts' tables: a column for each sample, one before sampling.
    root_customers: np.ndarray = field(default_factory=lambda: np.zeros(1))
    root_tables: np.ndarray = field(default_factory=lambda: np.zeros(1))
    heavy_tables: np.ndarray = field(default_factory=lambda: np.zeros((0, 1)))

    def parent(self, k: np.ndarray, tau: np.ndarray, s: int = 0) -> np.ndarray:
        """The parent's predictive probability of dishes with ``k`` customers at ``tau`` tables, of sample ``s``."""
        back = (ROOT_STRENGTH + self.root_d * self.root_tables[s]) / (self.v + 1)
        return (np.maximum(k - self.root_d * tau, 0) + back) / (ROOT_STRENGTH + max(float(self.root_customers[s]), 1e-12))

    def dealt(self, u: np.ndarray, w: np.ndarray) -> np.ndarray:
        """The bucket of each pair."""
        key = np.where(find(self.heavy, u) >= 0, pair_keys(u, w), _mix(u))
        return (key % np.uint64(self.buckets)).astype(np.int64)

    def word_bucket(self, h: np.ndarray) -> np.ndarray:
        return (_mix(h ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(self.buckets)).astype(np.int64)


# --- seating -------------------------------------------------------------------------------------


def log_stirling(n: int, d: float) -> np.ndarray:
    """Logarithms of generalised Stirling numbers S_d(c, t) for 0 <= t <= c <= n."""
    s = np.full((n + 1, n + 1), -np.inf)
    s[0, 0] = 0.0
    for c in range(n):
        for t in range(1, c + 2):
            keep = s[c, t] + np.log(c - d * t) if t <= c and c - d * t > 0 else -np.inf
            s[c + 1, t] = np.logaddexp(s[c, t - 1], keep)
    return s


def _uniform(key: np.ndarray, salt: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = _mix(key + np.uint64((salt * 0x9E3779B97F4A7C15) & (2**64 - 1)))
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) / 2**53


def _poisson(mean: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Inverse-distribution Poisson draws; a normal draw's rounding where the mean is large."""
    out = np.zeros(len(mean))
    big = mean > 50
    if big.any():
        # a rational approximation of the normal quantile
        p = np.clip(u[big], 1e-12, 1 - 1e-12)
        t = np.sqrt(-2 * np.log(np.minimum(p, 1 - p)))
        z = t - (2.30753 + 0.27061 * t) / (1 + 0.99229 * t + 0.04481 * t * t)
        out[big] = np.maximum(0, np.round(mean[big] + np.sqrt(mean[big]) * np.where(p < 0.5, -z, z)))
    small = ~big
    term = np.exp(-mean[small])
    total, k, need = term.copy(), np.zeros(small.sum()), u[small]
    for i in range(1, 140):
        more = total < need
        if not more.any():
            break
        term = term * mean[small] / i
        k += more
        total += term
    out[small] = k
    return out


def seat(c: np.ndarray, base: np.ndarray, tables: np.ndarray, strength: float, d: float, stirling: np.ndarray, key: np.ndarray, salt: int) -> np.ndarray:
    """Draw table counts for dishes with ``c`` customers; ``tables`` are the restaurant's tables of other dishes."""
    out = np.ones(len(c), dtype=np.int64)
    u = _uniform(key, salt)
    for low, high in ((2, 2), (3, 4), (5, 8), (9, 16), (17, EXACT)):
        pick = np.flatnonzero((c >= low) & (c <= high if high < EXACT else True))
        for at in range(0, len(pick), 16_384):
            i = pick[at : at + 16_384]
            ci = np.minimum(c[i], EXACT)
            t = np.arange(1, high + 1)
            factors = np.log(strength + d * (tables[i, None] + np.arange(high)[None, :])) + np.log(base[i])[:, None]
            logw = stirling[ci][:, 1 : high + 1] + np.cumsum(factors, axis=1)
            w = np.exp(logw - logw.max(1, keepdims=True))
            cum = np.cumsum(w, axis=1)
            out[i] = t[np.minimum((cum < (u[i] * cum[:, -1])[:, None]).sum(1), high - 1)]
    big = np.flatnonzero(c > EXACT)
    if len(big):
        at, t, want = np.full(len(big), EXACT, dtype=np.float64), out[big].astype(np.float64), c[big].astype(np.float64)
        for r in range(1, 100_000):
            left = at < want
            if not left.any():
                break
            step = np.where(left, np.minimum(np.maximum(1, np.floor(at / 16)), want - at), 0)
            new = (strength + d * (tables[big] + t)) * base[big]
            p = new / (new + np.maximum(at - d * t, 1e-9))
            t += np.minimum(step, _poisson(step * p, _uniform(key[big], salt + 7919 * r)))
            at += step
        out[big] = np.minimum(t, want).astype(np.int64)
    return out


class Seatings:
    """The pairs of a bucket: contexts ``u``, words ``w``, places ``ui`` and ``wi`` in them, customers ``c``, tables ``t``."""

    def __init__(self, u: np.ndarray, w: np.ndarray, ui: np.ndarray, wi: np.ndarray, c: np.ndarray, shared: Shared):
        self.u, self.w, self.ui, self.wi, self.c, self.shared = u, w, ui, wi, c, shared
        self.t = np.ones(len(c), dtype=np.int64)
        self.heavy = find(shared.heavy, u)
        self.own_customers = np.bincount(ui, c, minlength=len(u))
        big = self.heavy >= 0
        self.customers = np.where(big, shared.heavy_customers[self.heavy] if len(shared.heavy) else 0, self.own_customers)
        self.key = pair_keys(u[ui], w[wi])
        more = np.flatnonzero(c > 1)
        first = _uniform(self.key[more], 1) < 0.5
        self.halves = (more[first], more[~first])

    def own_tables(self) -> np.ndarray:
        return np.bincount(self.ui, self.t, minlength=len(self.u))

    def word_tables(self) -> np.ndarray:
        return np.bincount(self.wi, self.t, minlength=len(self.w)).astype(np.int64)

    def sweep(self, tables: np.ndarray, scale: np.ndarray, parent, stirling: np.ndarray, d: float, salt: int, k: np.ndarray | None = None) -> None:
        """One Gibbs sweep, half of the pairs at a time; ``tables`` a context and ``k``, customers a word at the parent, follow it.

        ``parent(words, k)`` is the parent's probability; ``scale`` says how many buckets' tables each of a context's tables here stands for.
        """
        for turn, i in enumerate(self.halves):
            if not len(i):
                continue
            ui, wi, t = self.ui[i], self.wi[i], self.t[i]
            base = parent(wi, k[wi] - t if k is not None else None)
            new = seat(self.c[i], base, np.maximum(tables[ui] - t, 0), STRENGTH, d, stirling, self.key[i], salt * 8 + turn)
            tables += np.bincount(ui, new - t, minlength=len(tables)) * scale
            if k is not None:
                k += np.bincount(wi, new - t, minlength=len(k)).astype(np.int64)
            self.t[i] = new


# --- dealing -------------------------------------------------------------------------------------

#: A row of what passes between buckets; ``kind`` says what it is.
ROWS = "kind int, bucket int, src long, h long, w long, v array<double>, blob binary"
STATE, MESSAGE, TABLES, ANSWER, TOP, WORD, PAIRS, TEXTS, PART, FAR, NUMBERS = range(11)
_NAMES = ["kind", "bucket", "src", "h", "w", "v", "blob"]
_KINDS = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.float64()), pa.binary()]


def _rows(kind: int, n: int, bucket=None, src=None, h=None, w=None, v=None, blob=None) -> pa.Table:
    """``n`` rows of one kind; ``v`` is a matrix, ``h`` and ``w`` are unsigned hashes."""
    signed = lambda x: pa.array(np.asarray(x, dtype=np.uint64).view(np.int64)) if x is not None else pa.nulls(n, pa.int64())
    plain = lambda x, t: pa.array(x, t) if x is not None else pa.nulls(n, t)
    lists = pa.nulls(n, _KINDS[5])
    if v is not None:
        v = np.asarray(v, dtype=np.float64)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * v.shape[1], pa.int32()), pa.array(v.ravel()))
    return pa.Table.from_arrays([pa.array(np.full(n, kind), pa.int32()), plain(bucket, pa.int32()), plain(src, pa.int64()), signed(h), signed(w), lists, plain(blob, pa.binary())], names=_NAMES)


def _joined(parts: list[pa.Table]) -> pa.Table:
    return pa.concat_tables(parts) if parts else _rows(0, 0)


def _deal(words: np.ndarray, shared: Shared, kind: int, chunk: int, ui: np.ndarray, wi: np.ndarray, c: np.ndarray, docs: np.ndarray | None = None, entries: np.ndarray | None = None) -> Iterator[pa.Table]:
    """Pairs (``ui``, ``wi`` places in the chunk's sorted ``words``) as one packed row a bucket.

    ``c`` counts each pair, or with ``docs`` each entry: then ``entries`` says how many of them belong to each pair.
    """
    order, place = word_order(words, shared.frequent)
    rank = np.empty(len(words), dtype=np.int64)
    rank[order] = np.arange(len(words))
    words, place, ui, wi = words[order], place[order], rank[ui], rank[wi]
    bucket = shared.dealt(words[ui], words[wi])
    by = np.argsort(bucket * len(words) ** 2 + ui * len(words) + wi if shared.buckets * len(words) ** 2 < 2**62 else np.lexsort((wi, ui, bucket)).argsort(), kind="stable")
    there, starts = np.unique(bucket[by], return_index=True)
    if docs is not None:
        first = np.cumsum(entries) - entries
    for b, low, high in zip(there.tolist(), starts, [*starts[1:], len(by)]):
        i = by[low:high]
        us, per = np.unique(ui[i], return_counts=True)
        ws, wx = np.unique(wi[i], return_inverse=True)
        arrays = [*pack_words(words[us], place[us]), per, *pack_words(words[ws], place[ws]), wx]
        if docs is None:
            arrays.append(c[i])
        else:
            n = entries[i]
            e = np.repeat(first[i] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            arrays += [n, docs[e], c[e]]
        yield _rows(kind, 1, [b], [chunk], blob=[pack(*arrays)])


def _dealt(blob: bytes, frequent: np.ndarray) -> list[np.ndarray]:
    """Contexts, words, places of each pair in both, and what else a packed row has."""
    a, b, per, x, y, wx, *rest = unpack(blob)
    return [unpack_words(a, b, frequent), unpack_words(x, y, frequent), np.repeat(np.arange(len(per)), per), wx, *rest]


def _chunks(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[np.ndarray, np.ndarray, list[pa.RecordBatch]]]:
    """Token hashes, tokens a text and the rows of about ``CHUNK_TOKENS`` tokens at a time."""
    hashes, sizes, rows, size = [], [], [], 0
    for b in batches:
        for at, to, data, offsets in _slices(b.column(column)):
            h, n = token_hashes(data, offsets)
            hashes.append(h)
            sizes.append(n)
            rows.append(b.slice(at, to - at))
            size += len(h)
            if size > CHUNK_TOKENS:
                yield np.concatenate(hashes), np.concatenate(sizes), rows
                hashes, sizes, rows, size = [], [], [], 0
    if size:
        yield np.concatenate(hashes), np.concatenate(sizes), rows


def _places(h: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words of a chunk with START, sorted, and the places in them of each token's context and of the token."""
    words, wi = np.unique(np.append(h, START), return_inverse=True)
    wi = wi.astype(np.int32)
    start, wi = wi[-1], wi[:-1]
    ui = np.empty_like(wi)
    ui[1:] = wi[:-1]
    ui[np.cumsum(sizes) - sizes] = start
    return words, ui, wi


def _by_bucket(rows: DataFrame, buckets: int, run) -> DataFrame:
    """``run`` over all rows of each bucket; one partition a bucket, so small rows are not put together in few tasks."""
    return rows.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(run, ROWS)


def pair_rows(texts: DataFrame, shared) -> DataFrame:
    """The (context, word) pairs of the column ``t`` with their counts, dealt to buckets; ``shared`` is a broadcast."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, (h, sizes, _) in enumerate(_chunks(batches, 0)):
            words, ui, wi = _places(h, sizes)
            code, c = np.unique(ui.astype(np.int64) * len(words) + wi, return_counts=True)
            chunk = TaskContext.get().partitionId() << 32 | number
            for t in _deal(words, shared.value, PAIRS, chunk, code // len(words), code % len(words), c):
                yield from t.to_batches()

    return texts.select("t").mapInArrow(run, ROWS)


def _state(s: Seatings, kind: int, bucket: int, *tables: np.ndarray) -> pa.Table:
    order, place = word_order(s.w, s.shared.frequent)
    uorder, uplace = word_order(s.u, s.shared.frequent)
    rank, urank = np.empty(len(s.w), dtype=np.int64), np.empty(len(s.u), dtype=np.int64)
    rank[order], urank[uorder] = np.arange(len(s.w)), np.arange(len(s.u))
    ui, wi = urank[s.ui], rank[s.wi]
    by = np.lexsort((wi, ui))
    per = np.bincount(ui, minlength=len(s.u))
    step = np.diff(wi[by], prepend=0)  # within a context words go up; the first one of each is told as it is
    starts = np.cumsum(per) - per
    step[starts] = wi[by][starts]
    more = np.flatnonzero(s.c[by] > 1)
    arrays = [*pack_words(s.u[uorder], uplace[uorder]), per, *pack_words(s.w[order], place[order]), step, s.c[by], *[t[by][more] for t in tables]]
    return _rows(kind, 1, [bucket], blob=[pack(*arrays)])


def _read_state(blob: bytes, shared: Shared) -> tuple[Seatings, list[np.ndarray]]:
    a, b, per, x, y, step, c, *tables = unpack(blob)
    total, starts = np.cumsum(step), np.cumsum(per) - per
    wi = total - np.repeat(total[starts] - step[starts], per)
    s = Seatings(unpack_words(a, b, shared.frequent), unpack_words(x, y, shared.frequent), np.repeat(np.arange(len(per)), per), wi, c, shared)
    more, out = np.flatnonzero(c > 1), []
    for t in tables:
        whole = np.ones(len(c), dtype=np.int64)
        whole[more] = t
        out.append(whole)
    return s, out


def _messages(s: Seatings, bucket: int, c: np.ndarray, ks: list[np.ndarray]) -> Iterator[pa.Table]:
    """Each word's customers and tables here, to the word's own bucket; words in the order of the state row."""
    order, place = word_order(s.w, s.shared.frequent)
    to = s.shared.word_bucket(s.w[order])
    by = np.argsort(to, kind="stable")
    there, starts = np.unique(to[by], return_index=True)
    for b, low, high in zip(there.tolist(), starts, [*starts[1:], len(by)]):
        i = order[by[low:high]]
        yield _rows(MESSAGE, 1, [b], [bucket], blob=[pack(*pack_words(s.w[i], place[i]), c[i], *[k[i] for k in ks])])


def _answers(rows: dict, s: Seatings) -> list[np.ndarray]:
    """What the words' buckets sent back, put in the place of each word of a state that was just read."""
    to, out = s.shared.word_bucket(s.w), []
    for src, blob in rows:
        at = np.flatnonzero(to == src)
        for n, a in enumerate(unpack(blob)):
            if n == len(out):
                out.append(np.zeros(len(s.w), dtype=np.int64))
            out[n][at] = a
    return out


def _of(table: pa.Table, kind: int) -> list[dict]:
    import pyarrow.compute as pc

    return table.filter(pc.equal(table.column("kind"), kind)).select(["bucket", "src", "blob"]).to_pylist()


def _heavy_tables(s: Seatings, each: list[np.ndarray]) -> pa.Table:
    """The tables that this bucket adds to each heavy context, by sample."""
    big = np.flatnonzero(s.heavy >= 0)
    return _rows(TABLES, len(big), h=s.u[big], v=np.stack([t[big] for t in each], 1))


def first_seatings(rows: DataFrame, shared, burn_in: int = BURN_IN) -> DataFrame:
    """Sum the pairs of each bucket and seat them; the parent's probabilities are words' shares until they are known."""

    def run(table: pa.Table) -> pa.Table:
        sh: Shared = shared.value
        got = [_dealt(r["blob"], sh.frequent) for r in _of(table, PAIRS)]
        bucket = table.column("bucket")[0].as_py()
        u, w = np.unique(np.concatenate([g[0] for g in got])), np.unique(np.concatenate([g[1] for g in got]))
        code = np.concatenate([np.searchsorted(u, g[0])[g[2]] * len(w) + np.searchsorted(w, g[1])[g[3]] for g in got])
        count = np.concatenate([g[4] for g in got])
        del got
        code, inverse = np.unique(code, return_inverse=True)
        c = np.bincount(inverse, count).astype(np.int64)
        s = Seatings(u, w, code // len(w), code % len(w), c, sh)
        here = np.bincount(s.wi, c, minlength=len(w))
        at = find(sh.frequent, w)
        share = np.where(at >= 0, sh.counts[at] if len(sh.counts) else 0, here) / max(sh.n, 1)
        scale = s.customers / np.maximum(s.own_customers, 1)
        tables, stirling = s.own_tables() * scale, log_stirling(EXACT, FIRST_D)
        for r in range(burn_in):
            s.sweep(tables, scale, lambda words, _: share[words], stirling, FIRST_D, r + 1)
        numbers = _rows(NUMBERS, 1, v=[[len(c), (c == 1).sum(), (c == 2).sum(), s.t.sum()]])
        return _joined([numbers, _state(s, STATE, bucket, s.t), *_messages(s, bucket, here.astype(np.int64), [s.word_tables()]), _heavy_tables(s, [s.own_tables()])])

    return _by_bucket(rows, shared.value.buckets, run)


def parent_tables(messages: DataFrame, shared, samples: int, salt: int) -> DataFrame:
    """Words' customers at the parent summed over all buckets, their tables there drawn, and both sent back.

    The words themselves come along as rows: the frequent ones (their number is bounded) with ``bucket`` 1, the others with 0.
    """

    def run(table: pa.Table) -> pa.Table:
        sh: Shared = shared.value
        bucket = table.column("bucket")[0].as_py()
        got = [(r["src"], unpack(r["blob"])) for r in _of(table, MESSAGE)]
        lists = [unpack_words(g[0], g[1], sh.frequent) for _, g in got]
        h = np.unique(np.concatenate(lists))
        at = [np.searchsorted(h, x) for x in lists]
        everywhere = np.concatenate(at)
        c, *ks = (np.bincount(everywhere, np.concatenate([g[2 + n] for _, g in got]), minlength=len(h)).astype(np.int64) for n in range(1 + samples))
        stirling, flat, taus = log_stirling(EXACT, sh.root_d), np.full(len(h), 1.0 / (sh.v + 1)), []
        tau = np.ones(len(h), dtype=np.int64)
        for s, k in enumerate(ks):
            for r in range(2):  # the other words' tables: those here stand for those of every bucket
                tau = seat(k, flat, np.maximum(tau.sum() * float(sh.buckets) - tau, 0), ROOT_STRENGTH, sh.root_d, stirling, h, salt + 16 * s + r)
            taus.append(np.minimum(tau, k))
        k0 = ks[0]
        out = [_rows(NUMBERS, 1, v=[[len(h), (k0 == 1).sum(), (k0 == 2).sum(), *[k.sum() for k in ks], *[t.sum() for t in taus]]])]
        out += [_rows(ANSWER, 1, [src], [bucket], blob=[pack(c[i], *[k[i] for k in ks], *[t[i] for t in taus])]) for (src, _), i in zip(got, at)]
        common = (find(sh.frequent, h) >= 0).astype(np.int32)
        out.append(_rows(WORD, len(h), bucket=common, src=c, h=h, v=np.stack([*ks, *taus], 1)))
        return _joined(out)

    return _by_bucket(messages, shared.value.buckets, run)


def sample_seatings(rows: DataFrame, shared, samples: int = SAMPLES, first: int = BURN_IN) -> DataFrame:
    """``samples`` sweeps over each bucket's state with the parent's numbers of all buckets."""
    top_pairs = TOP_PAIRS

    def run(table: pa.Table) -> pa.Table:
        sh: Shared = shared.value
        bucket = table.column("bucket")[0].as_py()
        s, (s.t,) = _read_state(_of(table, STATE)[0]["blob"], sh)
        c, k, tau = _answers([(r["src"], r["blob"]) for r in _of(table, ANSWER)], s)
        tables, stirling = s.own_tables(), log_stirling(EXACT, sh.d)
        big = s.heavy >= 0
        tables[big] = sh.heavy_tables[s.heavy[big], 0]
        each, ks, own = [], [], []
        for r in range(samples):
            s.sweep(tables, np.ones(len(tables)), lambda words, k: sh.parent(k, np.minimum(tau[words], k)), stirling, sh.d, first + r + 1, k)
            each.append(s.t.copy())
            ks.append(s.word_tables())
            own.append(s.own_tables())
        top = np.flatnonzero(s.c * top_pairs >= sh.n)
        ui = s.ui[top]
        most = _rows(TOP, len(top), h=s.u[ui], w=s.w[s.wi[top]], v=np.stack([s.c[top], s.customers[ui], *[t[top] for t in each], *[t[ui] for t in own]], 1))
        here = np.bincount(s.wi, s.c, minlength=len(s.w)).astype(np.int64)
        return _joined([_state(s, STATE, bucket, *each), *_messages(s, bucket, here, ks), _heavy_tables(s, own), most])

    return _by_bucket(rows, shared.value.buckets, run)


def _discount(ones: float, twos: float) -> float:
    return float(min(0.95, max(0.05, ones / (ones + 2 * twos)))) if ones else 0.5


@dataclass
class Model:
    """A fitted model: ``rows`` has every bucket's seatings and the parent's answers, ``words`` every word that is not frequent.

    ``shared`` has the sums; ``parents`` the parent's probabilities of the frequent words, a column a sample; ``top``
    the keys of the most common pairs, sorted, and ``top_log`` their log10 probabilities.
    """

    rows: DataFrame
    words: DataFrame
    shared: Shared
    parents: np.ndarray
    top: np.ndarray
    top_log: np.ndarray
    samples: int


def _heavy_sums(rows: DataFrame, shared: Shared, samples: int) -> np.ndarray:
    """The heavy contexts' tables (at most HEAVY + 1 rows) by sample, summed over the buckets."""
    out = np.zeros((len(shared.heavy), samples))
    sums = rows.where(F.col("kind") == TABLES).groupBy("h").agg(*[F.sum(F.col("v")[s]).alias(f"s{s}") for s in range(samples)]).collect()
    if sums:
        out[find(shared.heavy, np.array([r["h"] for r in sums]).view(np.uint64))] = [[r[f"s{s}"] for s in range(samples)] for r in sums]
    return out


def _numbers(rows: DataFrame, n: int) -> list[float]:
    return [float(x) for x in rows.where(F.col("kind") == NUMBERS).agg(*[F.coalesce(F.sum(F.col("v")[i]), F.lit(0.0)) for i in range(n)]).first()]


def _hashes(table: pa.Table, column: str) -> np.ndarray:
    return table.column(column).to_numpy().view(np.uint64)


def _matrix(table: pa.Table, column: str) -> np.ndarray:
    return np.concatenate([x.flatten().to_numpy() for x in table.column(column).chunks]).reshape(len(table), -1)


def train(docs: DataFrame, burn_in: int = BURN_IN, samples: int = SAMPLES) -> Model:
    """Fit on the rows of ``docs`` whose crc32(doc_id as text) mod 5 is not 1, all of them."""
    require(docs, "doc_id", "text")
    spark = docs.sparkSession
    texts = docs.where(~held_out()).select(text_or_empty(docs).alias("t"))
    vocab = stored(word_counts(texts), "vocab")
    ends = F.sum(F.when(F.col("h") == int(END.view(np.int64)), F.col("c")))
    n, v, starts = vocab.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*"), F.coalesce(ends, F.lit(0))).first()
    some = vocab.where(F.col("c") * FREQUENT >= n).toArrow()
    drop_stored(vocab)
    h, c = _hashes(some, "h"), some.column("c").to_numpy()
    order = np.argsort(h)
    h, c = h[order], c[order]
    # a word is as often a context as it occurs; a text's start is as common as its end, and always heavy
    heavy = (c * HEAVY >= n) & (h != END)
    contexts, customers = np.append(h[heavy], START), np.append(c[heavy], starts)
    order = np.argsort(contexts)
    shared = Shared(n, v, max(LEAST_BUCKETS, math.ceil(n / BUCKET_TOKENS)), h, c, contexts[order], customers[order])
    said = spark.sparkContext.broadcast(shared)
    one = stored(first_seatings(pair_rows(texts, said), said, burn_in), "seatings")
    pairs = _numbers(one, 4)
    shared.d, shared.root_customers, shared.root_tables = _discount(*pairs[1:3]), np.array([pairs[3]]), np.array([float(v)])
    shared.heavy_tables = _heavy_sums(one, shared, 1)
    said = spark.sparkContext.broadcast(shared)
    first = stored(parent_tables(one.where(F.col("kind") == MESSAGE), said, 1, 1 << 20), "parent")
    numbers = _numbers(first, 5)
    shared.root_d, shared.root_customers, shared.root_tables = _discount(*numbers[1:3]), np.array(numbers[3:4]), np.array(numbers[4:5])
    said = spark.sparkContext.broadcast(shared)
    both = one.where(F.col("kind") == STATE).unionByName(first.where(F.col("kind") == ANSWER))
    two = stored(sample_seatings(both, said, samples, burn_in), "samples")
    drop_stored(one, first)
    second = stored(parent_tables(two.where(F.col("kind") == MESSAGE), said, samples, 1 << 21), "parents")
    numbers = _numbers(second, 3 + 2 * samples)
    shared.root_customers, shared.root_tables = np.array(numbers[3 : 3 + samples]), np.array(numbers[3 + samples :])
    shared.heavy_tables = _heavy_sums(two, shared, samples)
    # the frequent words' probabilities at the parent, and the most common pairs': tables of bounded size
    parents = np.zeros((len(h), samples))
    known = second.where((F.col("kind") == WORD) & (F.col("bucket") == 1)).select("h", "v").toArrow()
    if len(known):
        at, kt = find(h, _hashes(known, "h")), _matrix(known, "v")
        for s in range(samples):
            parents[at, s] = shared.parent(kt[:, s], kt[:, samples + s], s)
    most = two.where(F.col("kind") == TOP).select("h", "w", "v").toArrow()
    top, top_log = np.zeros(0, np.uint64), np.zeros(0)
    if len(most):
        u, w, x = _hashes(most, "h"), _hashes(most, "w"), _matrix(most, "v")
        big = find(shared.heavy, u)
        tables = np.where((big >= 0)[:, None], shared.heavy_tables[big], x[:, 2 + samples :])
        p = _probability(shared.d, x[:, 0], x[:, 1], x[:, 2 : 2 + samples], tables, parents[find(h, w)])
        key = pair_keys(u, w)
        order = np.argsort(key)
        top, top_log = key[order], np.log10(p[order])
    words = second.where((F.col("kind") == WORD) & (F.col("bucket") == 0)).select("h", F.col("src").alias("c"), "v")
    rows = two.where(F.col("kind") == STATE).unionByName(second.where(F.col("kind") == ANSWER))
    return Model(rows, words, shared, parents, top, top_log, samples)


def _probability(d: float, c: np.ndarray, customers: np.ndarray, t: np.ndarray, tables: np.ndarray, parent: np.ndarray) -> np.ndarray:
    """Predictive probabilities of pairs, averaged over the samples, which are the columns of ``t``, ``tables`` and ``parent``."""
    customers = np.asarray(customers, dtype=np.float64)[:, None]
    own = np.where(np.asarray(c)[:, None] > 0, np.maximum(np.asarray(c)[:, None] - d * t, 0), 0)
    return ((own + (STRENGTH + d * tables) * parent) / (STRENGTH + customers)).mean(1)


# --- scoring -------------------------------------------------------------------------------------


def text_rows(docs: DataFrame, model) -> DataFrame:
    """Each chunk's texts with what can be said at once, and its other pairs, dealt to buckets; ``model`` is a broadcast of the shared part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sh, top, top_log = model.value[:3]
        base = np.log10((sh.counts + 0.5) / (sh.n + 0.5 * (sh.v + 1)))
        for number, (h, sizes, rows) in enumerate(_chunks(batches, 2)):
            chunk = TaskContext.get().partitionId() << 32 | number
            words, ui, wi = _places(h, sizes)
            doc = np.repeat(np.arange(len(sizes)), sizes)
            at = find(sh.frequent, words)
            known = np.bincount(doc, (at >= 0)[wi], minlength=len(sizes)).astype(np.int64)
            based = np.bincount(doc, np.where(at >= 0, base[at] if len(base) else 0, 0)[wi], minlength=len(sizes))
            # (pair, text) entries and how often each occurs
            codes, pair = np.unique(ui.astype(np.int64) * len(words) + wi, return_inverse=True)
            del ui, wi, h
            entry, c = np.unique(pair * len(sizes) + doc, return_counts=True)
            pair, doc = entry // len(sizes), entry % len(sizes)
            del entry
            pu, pw = codes // len(words), codes % len(words)
            common = find(top, pair_keys(words[pu], words[pw]))
            here = common[pair] >= 0
            score = np.bincount(doc[here], top_log[common[pair[here]]] * c[here], minlength=len(sizes)) if here.any() else np.zeros(len(sizes))
            ids = pa.concat_arrays([b.column(0) for b in rows])
            held = np.concatenate([np.asarray(b.column(1).cast(pa.uint8())) for b in rows]).astype(np.int64)
            meta = pack(np.asarray(ids.fill_null(0)).astype(np.int64).view(np.uint64), np.asarray(ids.is_null()).astype(np.int64), held, sizes, known, based, score)
            yield from _rows(TEXTS, 1, [chunk % sh.buckets], [chunk], blob=[meta]).to_batches()
            left = common < 0
            entries = np.bincount(pair, minlength=len(codes))
            for t in _deal(words, sh, PAIRS, chunk, pu[left], pw[left], c[~here], doc[~here], entries[left]):
                yield from t.to_batches()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), text_or_empty(docs).alias("t"))
    return rows.mapInArrow(run, ROWS)


def _score_bucket(table: pa.Table, sh: Shared, parents: np.ndarray, samples: int) -> pa.Table:
    """Answer the dealt pairs of a bucket: parts of scores by text, and pairs whose word is not known here."""
    out = [_rows(TEXTS, 1, src=[r["src"]], blob=[r["blob"]]) for r in _of(table, TEXTS)]
    state = _of(table, STATE)
    empty = np.zeros(0, np.uint64)
    u, w, codes, cc, customers = empty, empty, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    ts = tables = parent = np.zeros((0, samples))
    words = np.zeros(0, np.int64)
    if state:
        s, each = _read_state(state[0]["blob"], sh)
        answers = _answers([(r["src"], r["blob"]) for r in _of(table, ANSWER)], s)
        uo, wo = np.argsort(s.u), np.argsort(s.w)
        u, w = s.u[uo], s.w[wo]
        ru, rw = np.empty(len(uo), dtype=np.int64), np.empty(len(wo), dtype=np.int64)
        ru[uo], rw[wo] = np.arange(len(uo)), np.arange(len(wo))
        codes = ru[s.ui] * len(w) + rw[s.wi]
        by = np.argsort(codes)
        codes, cc, ts = codes[by], s.c[by], np.stack([t[by] for t in each], 1)
        customers = s.customers[uo]
        tables = np.stack([np.bincount(s.ui, t, minlength=len(u)) for t in each], 1)[uo]
        words = answers[0][wo]
        parent = np.stack([sh.parent(answers[1 + n], answers[1 + samples + n], n) for n in range(samples)], 1)[wo]
    den = sh.n + 0.5 * (sh.v + 1)
    for r in _of(table, PAIRS):
        us, ws, ui, wi, n, doc, m = _dealt(r["blob"], sh.frequent)
        uat, wat, common, big = find(u, us), find(w, ws), find(sh.frequent, ws), find(sh.heavy, us)
        # a context's customers and tables: of a heavy one, of one that is seated here, or none
        cust = np.where(big >= 0, sh.heavy_customers[big], np.where(uat >= 0, customers[uat] if len(u) else 0, 0))
        tab = np.where((big >= 0)[:, None], sh.heavy_tables[big], np.where((uat >= 0)[:, None], tables[uat] if len(u) else 0.0, 0.0))
        par = np.where((common >= 0)[:, None], parents[common] if len(parents) else 0.0, np.where((wat >= 0)[:, None], parent[wat] if len(w) else 0.0, 0.0))
        told = ((common >= 0) | (wat >= 0))[wi]
        at = np.where((uat[ui] >= 0) & (wat[wi] >= 0), find(codes, uat[ui] * max(len(w), 1) + wat[wi]), -1)
        own, t = (np.where(at >= 0, cc[at], 0), np.where((at >= 0)[:, None], ts[at], 0)) if len(codes) else (np.zeros(len(ui), np.int64), np.zeros((len(ui), samples)))
        logp = np.zeros(len(ui))
        logp[told] = np.log10(_probability(sh.d, own[told], cust[ui[told]], t[told], tab[ui[told]], par[wi[told]]))
        # counts of words that are not frequent are known from here; the frequent ones' were counted with the text
        local = (common < 0) & (wat >= 0)
        based = np.where(local, np.log10((np.where(local, words[wat] if len(w) else 0, 0) + 0.5) / den), 0.0)
        pair = np.repeat(np.arange(len(ui)), n)
        docs, where = np.unique(doc, return_inverse=True)
        parts = [np.bincount(where, x[pair] * m, minlength=len(docs)) for x in (logp, based[wi], local[wi].astype(np.float64))]
        out.append(_rows(PART, 1, src=[r["src"]], blob=[pack(np.diff(docs, prepend=0), parts[0], parts[1], parts[2].astype(np.int64))]))
        far = np.flatnonzero(~told[pair])
        if len(far):
            p = pair[far]
            back = (STRENGTH + sh.d * tab[ui[p]]) / (STRENGTH + cust[ui[p]][:, None])
            out.append(_rows(FAR, len(far), src=np.full(len(far), r["src"]), h=doc[far].astype(np.uint64), w=ws[wi[p]], v=np.concatenate([m[far][:, None], back], 1)))
    return _joined(out)


SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def _whole(table: pa.Table) -> pa.Table:
    """The rows of one chunk's texts: what was said at once, the buckets' parts and the far words'."""
    (meta,) = _of(table, TEXTS)
    ids, null, held, sizes, known, based, score = unpack(meta["blob"])
    for r in _of(table, PART):
        step, s, b, k = unpack(r["blob"])
        at = np.cumsum(step)
        score[at] += s
        based[at] += b
        known[at] += k
    far = table.filter(pa.compute.equal(table.column("kind"), FAR))
    for h, v in zip(far.column("h").to_pylist(), far.column("v").to_pylist()):
        score[h] += v[0]
        based[h] += v[1]
        known[h] += int(v[2])
    return pa.Table.from_arrays([pa.array(ids, mask=null.astype(bool)), pa.array(held.astype(bool)), pa.array(sizes), pa.array(known), pa.array(based), pa.array(score)], names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row."""
    require(docs, "doc_id", "text")
    sh, samples = model.shared, model.samples
    said = docs.sparkSession.sparkContext.broadcast((sh, model.top, model.top_log, model.parents))
    rows = text_rows(docs, said).unionByName(model.rows)
    out = stored(_by_bucket(rows, sh.buckets, lambda t: _score_bucket(t, said.value[0], said.value[3], samples)), "scored")
    # pairs that were never seen, of words that are neither frequent nor in the context's bucket
    far = out.where(F.col("kind") == FAR).select("src", F.col("h").alias("doc"), F.col("w").alias("h"), F.col("v").alias("f"))
    met = far.join(model.words, "h", "left")
    den = sh.n + 0.5 * (sh.v + 1)
    p = F.lit(0.0)
    for s in range(samples):
        back = (ROOT_STRENGTH + sh.root_d * float(sh.root_tables[s])) / (sh.v + 1)
        k, tau = (F.coalesce(F.col("v")[i], F.lit(0.0)) for i in (s, samples + s))
        parent = (F.greatest(k - F.lit(sh.root_d) * tau, F.lit(0.0)) + F.lit(back)) / F.lit(ROOT_STRENGTH + max(float(sh.root_customers[s]), 1e-12))
        p = p + F.col("f")[1 + s] * parent
    n = F.col("f")[0]
    told = met.groupBy("src", "doc").agg(F.sum(n * F.log10(p / F.lit(float(samples)))).alias("score"), F.sum(n * F.log10((F.coalesce("c", F.lit(0)) + F.lit(0.5)) / F.lit(float(den)))).alias("base"), F.sum(F.when(F.col("c").isNotNull(), n).otherwise(F.lit(0.0))).alias("known"))
    null = lambda t: F.lit(None).cast(t)
    told = told.select(F.lit(FAR).alias("kind"), null("int").alias("bucket"), "src", F.col("doc").alias("h"), null("long").alias("w"), F.array("score", "base", "known").alias("v"), null("binary").alias("blob"))
    whole = out.where(F.col("kind") != FAR).unionByName(told).groupBy("src").applyInArrow(_whole, SCORED)
    return whole.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(sh.n).cast("long").alias("train_tokens"), "base_score", "score")


def perplexity(scored: DataFrame, column: str = "score") -> float:
    """Held-out perplexity a token; None without held-out rows."""
    r = scored.where("held_out").agg(F.sum(column), F.sum("n_tokens")).first()
    return float(10 ** (-r[0] / r[1])) if r[1] else None
