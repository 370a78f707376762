"""Quality classifier: attention-based multiple-instance learning over passages.

A text is a bag of passages of ``PASSAGE_BYTES`` bytes, all of them, whatever its length. Each passage is
described by the frequencies of its byte-class pairs and encoded by a small learned layer; gated
attention (tanh times sigmoid) gives each passage a weight, learned from document labels alone; the
weighted mean of the encodings gives the document's score by a logistic layer.

Training reads a bounded sample of labelled rows (``max_train`` documents, those with the smallest hash of
the doc_id, and of each ``max_train_passages`` passages spread evenly); scoring reads every passage of every
text. Nothing but the text enters a score. Rows whose crc32(doc_id as text) mod 3 is 1 are held out.

Edge cases: a null or empty text is one empty passage and gets a score of its own; null labels are not
learned from; without labels of both kinds every score is the share of label 1 (0.5 without any);
repeated rows each come back; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep_rows, require, text_or_empty

PASSAGE_BYTES = 512
MAX_TRAIN = 3000
MAX_TRAIN_PASSAGES = 64
HIDDEN, ATTENTION = 32, 16

#: Byte classes, by what a byte is: control, white space, each common mark, digits, letters by case and kind.
_MARKS = "|!$%&*#.,;:?-_@'\"()/="


def _byte_classes() -> np.ndarray:
    c = np.zeros(256, dtype=np.int64)
    c[[9, 11, 12, 13, 32]] = 1
    c[10] = 2
    for i, m in enumerate(_MARKS):
        c[ord(m)] = 3 + i
    top = 3 + len(_MARKS)
    c[48:58] = top
    c[65:91] = top + 1
    c[97:123] = top + 2
    for v in b"aeiou":
        c[v] = top + 3
    c[0x80:0xC0] = top + 4
    c[0xC0:] = top + 5
    return c


CLASSES = _byte_classes()
N_CLASSES = int(CLASSES.max()) + 1
N_FEATURES = N_CLASSES * N_CLASSES


def passage_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Square roots of byte-class-pair shares of each passage, and the text that each passage belongs to.

    ``data`` holds the texts' bytes end to end, text i from ``offsets[i]`` to ``offsets[i + 1]``.
    """
    lengths = np.diff(offsets)
    per = np.maximum(1, -(-lengths // PASSAGE_BYTES))
    owner = np.repeat(np.arange(len(lengths)), per)
    first = np.concatenate([[0], np.cumsum(per)[:-1]])
    x = np.zeros((len(owner), N_FEATURES), dtype=np.float32)
    if len(data) > 1:
        text_of = np.repeat(np.arange(len(lengths)), lengths)
        passage = first[text_of] + (np.arange(len(data)) - offsets[text_of] + offsets[0]) // PASSAGE_BYTES
        cls = CLASSES[data]
        same = text_of[1:] == text_of[:-1]
        code = passage[:-1] * N_FEATURES + cls[:-1] * N_CLASSES + cls[1:]
        x = np.bincount(code[same], minlength=x.size).reshape(x.shape).astype(np.float32)
        total = x.sum(1, keepdims=True)
        x = np.sqrt(x / np.maximum(total, 1))
    return x, owner


def _segment_softmax(s: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    top = np.full(n, -np.inf, dtype=s.dtype)
    np.maximum.at(top, owner, s)
    e = np.exp(s - top[owner])
    return e / np.bincount(owner, e, minlength=n)[owner]


@dataclass
class AttentionModel:
    """Encoder (w, b), gated attention (v, u, a), output (o, c); all float arrays of fixed size."""

    w: np.ndarray
    b: np.ndarray
    v: np.ndarray
    u: np.ndarray
    a: np.ndarray
    o: np.ndarray
    c: np.ndarray
    constant: float | None = None

    def forward(self, x: np.ndarray, owner: np.ndarray, n: int) -> dict:
        h = np.tanh(x @ self.w + self.b)
        t, g = np.tanh(h @ self.v), 1 / (1 + np.exp(-(h @ self.u)))
        att = _segment_softmax((t * g) @ self.a, owner, n)
        z = np.zeros((n, h.shape[1]))
        np.add.at(z, owner, att[:, None] * h)
        p = 1 / (1 + np.exp(-np.clip(z @ self.o + self.c[0], -30, 30)))
        return {"h": h, "t": t, "g": g, "att": att, "z": z, "p": p}

    def score(self, x: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
        return np.full(n, self.constant) if self.constant is not None else self.forward(x, owner, n)["p"]


def fit(x: np.ndarray, owner: np.ndarray, y: np.ndarray, epochs: int = 60, batch: int = 64, seed: int = 7, decay: float = 1e-4) -> AttentionModel:
    """Adam on the cross-entropy of document labels; gradients by hand through the attention."""
    if len(y) == 0 or y.min() == y.max():
        z = np.zeros(0)
        return AttentionModel(z, z, z, z, z, z, z, constant=float(y.mean()) if len(y) else 0.5)
    rng = np.random.default_rng(seed)
    draw = lambda *s: rng.normal(0, 1 / np.sqrt(s[0]), s)
    m = AttentionModel(draw(x.shape[1], HIDDEN) * 4, np.zeros(HIDDEN), draw(HIDDEN, ATTENTION), draw(HIDDEN, ATTENTION), draw(ATTENTION), draw(HIDDEN), np.zeros(1))
    names = ["w", "b", "v", "u", "a", "o", "c"]
    first, second, step = {k: 0.0 for k in names}, {k: 0.0 for k in names}, 0
    ends = np.searchsorted(owner, np.arange(len(y) + 1))
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(y), batch):
            pick = order[at : at + batch]
            rows = np.concatenate([np.arange(ends[i], ends[i + 1]) for i in pick])
            own = np.repeat(np.arange(len(pick)), ends[pick + 1] - ends[pick])
            xb, yb = x[rows].astype(np.float64), y[pick]
            f = m.forward(xb, own, len(pick))
            d = (f["p"] - yb) / len(pick)
            grad = {"o": f["z"].T @ d, "c": np.array([d.sum()])}
            dz = d[:, None] * m.o
            dh = f["att"][:, None] * dz[own]
            da = (f["h"] * dz[own]).sum(1)
            ds = f["att"] * (da - np.bincount(own, f["att"] * da, minlength=len(pick))[own])
            grad["a"] = (f["t"] * f["g"]).T @ ds
            dt, dg = ds[:, None] * m.a * f["g"] * (1 - f["t"] ** 2), ds[:, None] * m.a * f["t"] * f["g"] * (1 - f["g"])
            grad["v"], grad["u"] = f["h"].T @ dt, f["h"].T @ dg
            dh += dt @ m.v.T + dg @ m.u.T
            pre = dh * (1 - f["h"] ** 2)
            grad["w"], grad["b"] = xb.T @ pre, pre.sum(0)
            step += 1
            for k in names:
                gk = grad[k] + decay * getattr(m, k)
                first[k] = 0.9 * first[k] + 0.1 * gk
                second[k] = 0.999 * second[k] + 0.001 * gk**2
                setattr(m, k, getattr(m, k) - 3e-3 * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8))
    for k in names:
        setattr(m, k, getattr(m, k).astype(np.float32))
    return m


def _buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    col = column.cast(pa.large_binary())
    offsets = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]] if col.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data, offsets


def score_texts(model: AttentionModel, column: pa.Array, chunk_bytes: int = 1 << 20) -> np.ndarray:
    """Scores of a batch of texts, about ``chunk_bytes`` at a time."""
    data, offsets = _buffer(column)
    out, at = np.zeros(len(column)), 0
    base = offsets[0] if len(offsets) else 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + chunk_bytes)))
        to = min(to, len(column))
        off = offsets[at : to + 1]
        x, owner = passage_features(data[off[0] - base : off[-1] - base], off)
        out[at:to] = model.score(x, owner, to - at)
        at = to
    return out


def _spread(x: np.ndarray, most: int) -> np.ndarray:
    return x if len(x) <= most else x[np.linspace(0, len(x) - 1, most).astype(int)]


def train_quality(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, label: str = "quality", held_mod: int = 3, held_rest: int = 1) -> AttentionModel:
    """Fit on at most ``max_train`` labelled documents that are not held out, encoded on the executors."""
    require(docs, "doc_id", "text")
    require(labels, "doc_id", label)
    hashed = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).select("doc_id", F.col(label).cast("int").alias("y")).groupBy("doc_id").agg(F.max("y").alias("y"))
    known = known.where(hashed % held_mod != held_rest)
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty(docs).alias("t")).join(F.broadcast(chosen), "doc_id")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for t in b.column("t"):
                raw = np.frombuffer(t.as_py().encode(), dtype=np.uint8)
                x, _ = passage_features(raw, np.array([0, len(raw)]))
                rows.append(_spread(x, MAX_TRAIN_PASSAGES).astype(np.float16).tobytes())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), pa.array(rows, pa.binary())], ["doc_id", "y", "x"])

    found = texts.select("doc_id", "y", "t").mapInArrow(encode, "doc_id long, y int, x binary").dropDuplicates(["doc_id"]).collect()
    found.sort(key=lambda r: r["doc_id"])
    bags = [np.frombuffer(r["x"], dtype=np.float16).reshape(-1, N_FEATURES) for r in found]
    owner = np.repeat(np.arange(len(bags)), [len(b) for b in bags]) if bags else np.zeros(0, int)
    return fit(np.concatenate(bags).astype(np.float32) if bags else np.zeros((0, N_FEATURES), np.float32), owner, np.array([r["y"] for r in found], dtype=np.float64))


def score_quality(docs: DataFrame, model: AttentionModel) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    require(docs, "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = score_texts(model, b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p, pa.float64())], ["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty(docs).alias("t")).mapInArrow(run, "doc_id long, score double")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_quality(docs: DataFrame, model: AttentionModel) -> DataFrame:
    """The rows of ``docs`` that score 0.5 or more, with the columns of ``docs``."""

    return keep_rows(docs, "text", lambda texts: score_texts(model, texts) >= 0.5)
