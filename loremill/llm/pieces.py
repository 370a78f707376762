"""SentencePiece encoding with seeded merge-dropout, and lossless decoding.

The vocabulary is a public SentencePiece BPE model whose path is a parameter; nothing is trained. Merges are
taken from an agenda in the model's order; with ``dropout`` > 0 each candidate that comes up is skipped when a
hash keyed by (seed, document, place in the text, place in the segment, merged piece) falls under it. Every occurrence of a
word thus has draws of its own: one text has as many segmentations as seeds allow, made of the model's own
merges, the same ones on every run. With dropout 0 the ids are those of the stock encoder.

No piece crosses a space, so a text is cut before runs of spaces and at line ends, and segments are encoded
on their own. What the agenda of a segment pops when nothing is skipped is kept in a cache of bounded size, with the
resulting ids; an occurrence none of whose draws along that way is a skip has these ids, and only the others work off
an agenda of their own, many side by side: each round takes the best candidate of every segment's agenda. A character
that the model lacks becomes its UTF-8 bytes, and so does the visible-space character U+2581 itself, which the stock
encoder would turn into a space; hence decoding gives back every text exactly.

Edge cases: a null text counts as empty and has no tokens; a null doc_id counts as document 0; repeated rows each
come back; an empty table gives no rows; other columns are kept by ``encode``, whatever their names, and not read by the query.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, require, text_or_empty

MODEL_PATH = os.path.join("/opt/tokenizers", "piece_bpe_32k.model")
DROPOUT, SEED = 0.1, 17
#: Segments in the cache, if one chunk has not more.
CACHE_SEGMENTS = 200_000
#: Occurrences whose draws are made at a time.
DRAWS = 1 << 18
CHUNK_CHARS = 1 << 20
#: Rows of a batch that are encoded before they are handed on.
OUT_ROWS, OUT_BYTES = 1000, 1 << 28
_SPACE = "▁"
_SEGMENT = re.compile(r" *[^ \n]+| +|\n")
#: Segments of up to so many letters are encoded side by side.
WIDTHS = (8, 16, 32)
_M64 = 2**64 - 1


def _mix_one(key: int, made: int, place: int) -> int:
    """16 bits from a segment's key, the merged piece and the place: what decides whether a candidate is skipped."""
    h = (key + made * 0x9E3779B97F4A7C15 + place * 0xC2B2AE3D27D4EB4F) & _M64
    h = ((h ^ (h >> 30)) * 0xBF58476D1CE4E5B9) & _M64
    return h >> 48


def _mix(keys: np.ndarray, made: np.ndarray, place: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = keys + made.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + place.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return h >> np.uint64(48)


class Pieces:
    """A BPE vocabulary with byte fallback, and its merges."""

    def __init__(self, model_path: str = MODEL_PATH):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        n = sp.vocab_size()
        text = [sp.id_to_piece(i) for i in range(n)]
        plain = [not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)) for i in range(n)]
        ids = {t: i for i, t in enumerate(text) if plain[i]}
        self.byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        # a space is the model's visible space; the visible space itself is no letter
        self.chars = {" " if t == _SPACE else t: i for t, i in ids.items() if len(t) == 1}
        # merges: every way to make a piece of two pieces; the better score first
        self.merges: dict[int, int] = {}
        self.ranks = [-sp.get_score(i) for i in range(n)]
        for t, i in ids.items():
            for cut in range(1, len(t)):
                a, b = ids.get(t[:cut]), ids.get(t[cut:])
                if a is not None and b is not None:
                    self.merges[a << 32 | b] = i
        order = sorted(self.merges)
        self.pair_keys = np.array(order, dtype=np.int64)
        self.pair_ranks = np.array([self.ranks[self.merges[k]] for k in order], dtype=np.float32)
        self.pair_made = np.array([self.merges[k] for k in order], dtype=np.int32)
        self.letters = np.full(0x110000, -1, dtype=np.int32)
        for t, i in self.chars.items():
            self.letters[ord(t)] = i
        self.raw = [b""] * n
        for t, i in ids.items():
            self.raw[i] = t.replace(_SPACE, " ").encode()
        for b, i in enumerate(self.byte_ids):
            self.raw[i] = bytes([b])

    def start(self, segment: str) -> list[int]:
        chars = self.chars
        try:  # most segments have only letters of the model
            return [chars[ch] for ch in segment]
        except KeyError:
            pass
        out: list[int] = []
        for ch in segment:
            i = chars.get(ch)
            if i is None:
                out.extend(self.byte_ids[b] for b in ch.encode())
            else:
                out.append(i)
        return out

    def segment(self, segment: str, dropout: float = 0.0, key: int = 0) -> list[int]:
        """Ids of one segment, by an agenda of candidate merges: the best score first, then the leftmost."""
        return self._long(self.start(segment), int(dropout * 65536), key)

    def segments(self, segments: list[str], dropout: float = 0.0, keys: np.ndarray | None = None, way: list | None = None) -> list[bytes]:
        """``segment`` for many non-empty ones at once, ids as little-endian int32: short ones of known letters as rows of arrays, the others one by one.

        ``way`` takes arrays (segment, merged piece, place) of all that the agendas popped, in order within a segment.
        """
        out: list[bytes | None] = [None] * len(segments)
        limit = int(dropout * 65536)
        sizes = np.fromiter(map(len, segments), dtype=np.int64, count=len(segments))
        codes = np.frombuffer("".join(segments).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        known = self.letters[codes]
        starts = np.concatenate([[0], np.cumsum(sizes)])
        strange = np.add.reduceat(known < 0, starts[:-1]) > 0 if len(codes) else np.zeros(0, bool)
        low = 0
        for high in WIDTHS:
            pick = np.flatnonzero((sizes > low) & (sizes <= high) & ~strange)
            low = high
            if len(pick):
                cols = starts[pick][:, None] + np.arange(high)[None, :]
                inside = np.arange(high)[None, :] < sizes[pick][:, None]
                rows = np.where(inside, known[np.minimum(cols, len(known) - 1)], -1)
                popped: list | None = [] if way is not None else None
                for i, ids in zip(pick.tolist(), self._rows(rows, limit, keys[pick] if limit else None, popped)):
                    out[i] = ids
                if way is not None:
                    way += [(pick[r], m, i) for r, m, i in popped]
        for i, ids in enumerate(out):
            if ids is None:
                popped = [] if way is not None else None
                out[i] = np.array(self._long(self.start(segments[i]), limit, int(keys[i]) if limit else 0, popped), dtype="<i4").tobytes()
                if popped:
                    m, at = zip(*popped)
                    way.append((np.full(len(m), i), np.array(m, dtype=np.int32), np.array(at)))
        return out

    def _find(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores and merged pieces of pairs; infinite and -1 where they don't merge."""
        key = a.astype(np.int64) << 32 | b
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        hit = (self.pair_keys[at] == key) & (a >= 0) & (b >= 0)
        return np.where(hit, self.pair_ranks[at], np.inf).astype(np.float32), np.where(hit, self.pair_made[at], -1)

    def _rows(self, ids: np.ndarray, limit: int, keys: np.ndarray | None, popped: list | None = None) -> list[bytes]:
        """Work off the agendas of many rows, one candidate of each a round; -1 fills a row's end.

        Symbols stay where they are and are linked; a merged right symbol becomes -1. The last column is a sentinel.
        """
        n, wide = ids.shape[0], ids.shape[1] + 1
        done: list[bytes] = [b""] * n
        ids = np.concatenate([ids, np.full((n, 1), -1, ids.dtype)], axis=1).astype(np.int32)
        ranks, made = np.full((n, wide), np.inf, np.float32), np.full((n, wide), -1, np.int32)
        ranks[:, :-1], made[:, :-1] = self._find(ids[:, :-1], ids[:, 1:])
        after = np.tile(np.minimum(np.arange(1, wide + 1), wide - 1).astype(np.int32), (n, 1))
        before = np.tile((np.arange(-1, wide - 1) % wide).astype(np.int32), (n, 1))  # in front of the first: the sentinel
        live, base = np.arange(n), np.arange(n) * wide
        while len(live):
            best = ranks.argmin(1)
            at = base[: len(live)] + best
            open_ = ranks.ravel()[at] < np.inf
            if np.count_nonzero(open_) < 0.7 * len(live):  # put away what is finished
                ended = ids[~open_]
                left = ended >= 0
                blob = ended[left].astype("<i4").tobytes()
                ends = np.cumsum(left.sum(1) * 4).tolist()
                for i, x, y in zip(live[~open_].tolist(), [0, *ends], ends):
                    done[i] = blob[x:y]
                live, ids, ranks, made, after, before, best = (x[open_] for x in (live, ids, ranks, made, after, before, best))
                keys = keys[open_] if keys is not None else None
                at = base[: len(live)] + best
                open_ = np.ones(len(live), dtype=bool)
            flat_ids, flat_ranks, flat_made, flat_after, flat_before = (x.ravel() for x in (ids, ranks, made, after, before))
            if limit:
                skip = (_mix(keys, flat_made[at], best) < limit) & open_
                flat_ranks[at[skip]] = np.inf
                open_ = open_ & ~skip
            row = base[: len(live)][open_]
            i, m = best[open_], flat_made[at[open_]]
            if popped is not None:
                popped.append((live[open_], m, i))
            i_at = row + i
            j_at = row + flat_after[i_at]
            k = flat_after[j_at]
            flat_ids[i_at], flat_ids[j_at], flat_ranks[j_at] = m, -1, np.inf
            flat_after[i_at] = k
            flat_before[row + k] = i
            flat_ranks[i_at], flat_made[i_at] = self._find(m, flat_ids[row + k])
            p_at = row + flat_before[i_at]
            flat_ranks[p_at], flat_made[p_at] = self._find(flat_ids[p_at], m)
        return done

    def _long(self, ids: list[int], limit: int, key: int, popped: list | None = None) -> list[int]:
        """The agenda as a heap over linked symbols, for segments of any length."""
        merges, ranks, n = self.merges, self.ranks, len(ids)
        agenda = []
        for i in range(n - 1):
            if m := merges.get(ids[i] << 32 | ids[i + 1]):
                agenda.append((ranks[m], i, ids[i], ids[i + 1], m))
        heapify(agenda)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while agenda:
            _, i, a, b, made = heappop(agenda)
            if ids[i] != a or (j := after[i]) >= n or ids[j] != b:
                continue
            if limit and _mix_one(key, made, i) < limit:
                continue
            if popped is not None:
                popped.append((made, i))
            ids[i], ids[j] = made, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if m := merges.get(made << 32 | ids[k]):
                    heappush(agenda, (ranks[m], i, made, ids[k], m))
            if (p := before[i]) >= 0 and (m := merges.get(ids[p] << 32 | made)):
                heappush(agenda, (ranks[m], p, ids[p], made, m))
        return [x for x in ids if x >= 0]

    def decode(self, ids: list[int]) -> str:
        """The text; the space that encoding puts in front goes."""
        return b"".join(map(self.raw.__getitem__, ids)).decode()[1:]


class _Ways:
    """What agendas without a skip pop, and the ids they end with, for up to ``CACHE_SEGMENTS`` segments or those of one chunk."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.blobs: list[bytes] = []
        self.first, self.count = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.made, self.place = np.zeros(0, np.int32), np.zeros(0, np.int32)

    def numbers(self, segments: list[str]) -> np.ndarray:
        """Each segment's number; new ones are learned first."""
        new = set(segments).difference(self.known)
        if new:
            if self.known and len(self.known) + len(new) > CACHE_SEGMENTS:
                self.clear()
                new = set(segments)
            self._learn(sorted(new))
        return np.fromiter(map(self.known.__getitem__, segments), dtype=np.int64, count=len(segments))

    def _learn(self, new: list[str]) -> None:
        way: list = []
        self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))
        self.blobs += self.pieces.segments(new, way=way)
        at, made, place = (np.concatenate(x) for x in zip(*way)) if way else (np.zeros(0, np.int64),) * 3
        by = np.argsort(at, kind="stable")
        count = np.bincount(at, minlength=len(new)).astype(np.int64)
        self.first = np.concatenate([self.first, len(self.made) + np.cumsum(count) - count])
        self.count = np.concatenate([self.count, count])
        self.made = np.concatenate([self.made, made[by].astype(np.int32)])
        self.place = np.concatenate([self.place, place[by].astype(np.int32)])

    def skipped(self, numbers: np.ndarray, keys: np.ndarray, limit: int) -> np.ndarray:
        """Which occurrences have a skip among the draws along their segment's way."""
        out = np.zeros(len(numbers), dtype=bool)
        for at in range(0, len(numbers), DRAWS):
            n, k = numbers[at : at + DRAWS], keys[at : at + DRAWS]
            count = self.count[n]
            whose = np.repeat(np.arange(len(n)), count)
            step = np.arange(len(whose)) - np.repeat(np.cumsum(count) - count - self.first[n], count)
            out[at + whose[_mix(k[whose], self.made[step], self.place[step]) < limit]] = True
        return out


class Encoder:
    """Encodes texts with a bounded cache of segments. Pickles without the vocabulary and the cache."""

    def __init__(self, model_path: str = MODEL_PATH, dropout: float = DROPOUT, seed: int = SEED):
        if not 0 <= dropout < 1:
            raise ValueError("dropout is in [0, 1)")
        self.model_path, self.dropout, self.seed = model_path, dropout, seed
        self.pieces: Pieces | None = None

    def __getstate__(self) -> dict:
        return {k: self.__dict__[k] for k in ("model_path", "dropout", "seed")} | {"pieces": None}

    def open(self) -> Pieces:
        if self.pieces is None:
            if self.model_path not in _OPEN:
                _OPEN.clear()
                _OPEN[self.model_path] = _Ways(Pieces(self.model_path))
            self.ways = _OPEN[self.model_path]
            self.pieces = self.ways.pieces
        return self.pieces

    def keys(self, document: int, n: int) -> np.ndarray:
        """The key of each of a document's first ``n`` segments."""
        start = xxhash.xxh64_intdigest((document & _M64).to_bytes(8, "little"), self.seed & _M64)
        with np.errstate(over="ignore"):
            h = np.uint64(start) + np.arange(n, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(32))

    def encode_many(self, texts: list[str], documents: list[int]) -> list[bytes]:
        """Ids of each text, as little-endian int32; ``documents`` are the numbers that their draws are keyed by."""
        pieces, limit = self.open(), int(self.dropout * 65536)
        cut = [_SEGMENT.findall(" " + t) if t else [] for t in texts]
        flat = list(chain.from_iterable(cut))
        numbers = self.ways.numbers(flat)
        found = list(map(self.ways.blobs.__getitem__, numbers.tolist()))
        if limit and flat:
            keys = np.concatenate([self.keys(d, len(c)) for d, c in zip(documents, cut)])
            own = np.flatnonzero(self.ways.skipped(numbers, keys, limit))
            for at in range(0, len(own), DRAWS):
                some = own[at : at + DRAWS].tolist()
                for i, ids in zip(some, pieces.segments([flat[i] for i in some], self.dropout, keys[some])):
                    found[i] = ids
        out, at = [], 0
        for c in cut:
            out.append(b"".join(found[at : at + len(c)]))
            at += len(c)
        return out

    def encode(self, text: str, document: int = 0) -> list[int]:
        return np.frombuffer(self.encode_many([text], [document])[0], dtype="<i4").tolist()

    def stream(self, texts, documents) -> Iterator[bytes]:
        """``encode_many`` over a batch, about ``CHUNK_CHARS`` characters at a time."""
        some, ids, size = [], [], 0
        for t, d in zip(texts, documents):
            some.append(t)
            ids.append(int(d or 0))
            size += len(t)
            if size > CHUNK_CHARS:
                yield from self.encode_many(some, ids)
                some, ids, size = [], [], 0
        yield from self.encode_many(some, ids)


#: What a worker keeps from task to task: the vocabulary and the cache.
_OPEN: dict[str, _Ways] = {}


def encode(docs: DataFrame, encoder: Encoder | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``token_ids`` (array of int), in place of a column of that name."""
    require(docs, id_col, text_col)
    encoder = encoder or Encoder()
    docs = docs.drop("token_ids")
    at = docs.columns.index(text_col)
    rows = docs.withColumn(fresh(docs.columns, "number")[0], F.coalesce(F.col(id_col), F.lit(0)).cast("long"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            # so few rows at a time that places in their ids fit 32 bits: there are no more ids than bytes, with the space in front
            sizes = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(whole.column(at)), 0), dtype=np.int64) + 1)
            start = 0
            while start < whole.num_rows:
                before = sizes[start - 1] if start else 0
                n = max(1, min(OUT_ROWS, int(np.searchsorted(sizes, before + OUT_BYTES)) - start))
                b = whole.slice(start, n)
                start += n
                raw = list(encoder.stream([t or "" for t in b.column(at).to_pylist()], b.column(b.num_columns - 1).to_pylist()))
                ends = np.cumsum([0, *(len(x) // 4 for x in raw)], dtype=np.int32)
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(raw), dtype="<i4")))
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], ids], [*b.schema.names[:-1], "token_ids"])

    return rows.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("token_ids", T.ArrayType(T.IntegerType()))]))


def decode(tokens: DataFrame, model_path: str = MODEL_PATH, column: str = "token_ids") -> DataFrame:
    """``tokens`` with ``decoded``, the text that its ids stand for; null ids stand for nothing."""
    encoder = Encoder(model_path)

    @F.pandas_udf("string")
    def run(ids: pd.Series) -> pd.Series:
        return pd.Series([encoder.open().decode(list(x)) if x is not None else "" for x in ids])

    return tokens.withColumn("decoded", run(F.col(column)))


def encoding_rows(docs: DataFrame, encoder: Encoder | None = None) -> DataFrame:
    """doc_id, n_tokens, n_bytes, tokens_sha256 (of the ids as little-endian int32) and lossless of every row."""
    require(docs, "doc_id", "text")
    encoder = encoder or Encoder()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, size, digest, same = [], [], [], []
            texts = b.column(1).to_pylist()
            for text, raw in zip(texts, encoder.stream(texts, b.column(0).to_pylist())):
                ids = np.frombuffer(raw, dtype="<i4").tolist()
                n.append(len(ids))
                size.append(len(text.encode()))
                digest.append(hashlib.sha256(raw).hexdigest())
                same.append(encoder.open().decode(ids) == text)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(size, pa.int64()), pa.array(digest, pa.string()), pa.array(same, pa.bool_())], ["doc_id", "n_tokens", "n_bytes", "tokens_sha256", "lossless"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty(docs).alias("t"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, n_bytes long, tokens_sha256 string, lossless boolean")
