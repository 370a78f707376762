import math
import zlib
from collections import Counter

import numpy as np
import pytest

from loremill.llm import pitman_yor as P
from loremill.llm import quality as Q

from .helpers import ODD, docs, odd


def test_classifier_on_held_out_rows(spark, sf):
    table, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = Q.score_quality(table, Q.train_quality(table, labels)).join(labels, "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    assert sum(r["predicted"] == r["quality"] for r in held) / len(held) > 0.85


def test_classifier_odd_rows(spark):
    table = odd(spark)
    none = spark.createDataFrame([], "doc_id long, quality int")
    rows = Q.score_quality(table, Q.train_quality(table, none)).collect()
    assert len(rows) == len(ODD) and {r["score"] for r in rows} == {0.5}
    labels = spark.createDataFrame([(2, 1), (3, 0), (4, None), (5, 1)], "doc_id long, quality int")
    model = Q.train_quality(table, labels)
    rows = Q.score_quality(table, model).collect()
    assert len(rows) == len(ODD) and all(0 <= r["score"] <= 1 for r in rows)
    assert Q.score_quality(table.where("false"), model).count() == 0
    assert Q.keep_quality(table, model).columns == table.columns


def test_features_do_not_cross_texts():
    texts = [b"ab" * 400, b"", b"x!"]
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    off = np.cumsum([0, *map(len, texts)])
    x, owner = Q.passage_features(data, off)
    assert owner.tolist() == [0, 0, 1, 2]
    assert np.allclose(np.square(x).sum(1), [1, 1, 0, 1])
    alone, _ = Q.passage_features(np.frombuffer(texts[2], dtype=np.uint8), np.array([0, 2]))
    assert np.allclose(alone[0], x[3])


def test_attention_gradients():
    rng = np.random.default_rng(0)
    x, owner, y = rng.random((40, Q.N_FEATURES)).astype(np.float32), np.sort(rng.integers(0, 10, 40)), rng.integers(0, 2, 10).astype(float)
    owner[:10] = np.arange(10)
    owner.sort()
    m = Q.fit(x, owner, y, epochs=150)
    assert ((m.score(x, owner, 10) >= 0.5) == y).mean() >= 0.9


def tokens(text):
    return [*(text or "").encode().lower().split(), b""]


def is_training(i):
    return i is None or zlib.crc32(str(i).encode()) % 5 != 1


def brute_base(rows):
    train = Counter()
    for i, t in rows:
        if is_training(i):
            train.update(tokens(t))
    n, v = sum(train.values()), len(train)
    out = []
    for i, t in rows:
        ws = tokens(t)
        out.append((str(i), len(ws), sum(w in train for w in ws), n, round(sum(math.log10((train[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), 6)))
    return sorted(out)


def word_key(w):
    return int(P.END) if w == b"" else P.word_hash(w)


def test_token_hashes():
    texts = ["", " \n", "One two\tONE", "x" * 64 + " " + "x" * 65 + " " + "x" * 64 + "y", "\u00c9 \u00e9\x0b\x0c\r a\x1cb"]
    raw = [t.encode() for t in texts]
    got, n = P.token_hashes(b"".join(raw), np.cumsum([0, *map(len, raw)]))
    want = [word_key(w) for t in texts for w in tokens(t)]
    assert got.tolist() == want and n.tolist() == [len(tokens(t)) for t in texts]
    words = {w for t in texts for w in tokens(t)}
    assert len({word_key(w) for w in words}) == len(words)


def test_packed_arrays():
    rng = np.random.default_rng(3)
    arrays = [rng.integers(0, top, 50) for top in (2, 300, 70_000, 2**40)] + [np.zeros(0, np.int64), rng.random(7), rng.integers(0, 2**64, 5, dtype=np.uint64)]
    back = P.unpack(P.pack(*arrays))
    assert all(np.array_equal(a.astype(b.dtype) if a.dtype.kind != "f" else a, b) for a, b in zip(arrays, back))


def seatings(model):
    """(context, word) -> customers and tables by sample; words' customers, tables at the parent, by sample."""
    pairs, words = {}, {}
    for r in model.rows.where(f"kind = {P.STATE}").collect():
        s, each = P._read_state(r["blob"], model.shared)
        for n in range(len(s.c)):
            key = (int(s.u[s.ui[n]]), int(s.w[s.wi[n]]))
            assert key not in pairs
            pairs[key] = (int(s.c[n]), [int(t[n]) for t in each])
    for (_, w), (c, t) in pairs.items():
        c0, k = words.get(w, (0, [0] * len(t)))
        words[w] = (c0 + c, [a + b for a, b in zip(k, t)])
    return pairs, words


@pytest.mark.parametrize("frequent,top,heavy,buckets", [(P.FREQUENT, P.TOP_PAIRS, P.HEAVY, 16), (8, 8, 4, 3), (1, 1, 1, 1)])
def test_scores_against_brute_force(spark, sf, monkeypatch, frequent, top, heavy, buckets):
    for name, value in (("FREQUENT", frequent), ("TOP_PAIRS", top), ("HEAVY", heavy), ("LEAST_BUCKETS", buckets)):
        monkeypatch.setattr(P, name, value)
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").limit(60).collect()] + ODD
    d = docs(spark, rows)
    model = P.train(d)
    got = P.score(d, model).collect()
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == brute_base(rows)
    # every observed pair has its customers, and no other pair
    want = Counter()
    for i, t in rows:
        if is_training(i):
            ws = [word_key(w) for w in tokens(t)]
            want.update(zip([int(P.START), *ws[:-1]], ws))
    pairs, words = seatings(model)
    assert {k: c for k, (c, _) in pairs.items()} == dict(want)
    assert all(1 <= x <= c for c, t in pairs.values() for x in t)
    # scores from the seatings, one token at a time
    sh, samples = model.shared, model.samples
    tau = {r["h"] & (2**64 - 1): r["v"][samples:] for r in model.words.collect()}
    known = model.parents  # the frequent words' probabilities at the parent
    k_sum = [sum(k[s] for _, k in words.values()) for s in range(samples)]
    assert k_sum == sh.root_customers.tolist()
    at = {int(h): n for n, h in enumerate(sh.frequent)}
    tables, customers = {}, Counter()
    for (u, _), (c, t) in pairs.items():
        customers[u] += c
        tables[u] = [a + b for a, b in zip(tables.get(u, [0] * samples), t)]

    def parent(w, s):
        if w in at:
            return known[at[w], s]
        k, t = (words[w][1][s], tau[w][s]) if w in words else (0, 0)
        return (max(k - sh.root_d * t, 0) + (1 + sh.root_d * sh.root_tables[s]) / (sh.v + 1)) / (1 + k_sum[s])

    def probability(u, w):
        c, t = pairs.get((u, w), (0, [0] * samples))
        return sum((max(c - sh.d * t[s], 0) * (c > 0) + (1 + sh.d * tables.get(u, [0] * samples)[s]) * parent(w, s)) / (1 + customers[u]) for s in range(samples)) / samples

    brute = []
    for i, t in rows:
        ws = [word_key(w) for w in tokens(t)]
        brute.append((str(i), sum(math.log10(probability(u, w)) for u, w in zip([int(P.START), *ws[:-1]], ws))))
    assert [(str(r["doc_id"]), pytest.approx(r["score"], abs=1e-6)) for r in sorted(got, key=lambda r: (str(r["doc_id"]), r["score"]))] == sorted(brute)
    # in every context the probabilities of all words and the unknown one sum to one
    for u in [*list(tables)[:5], 12345]:
        assert sum(probability(u, w) for w in words) + probability(u, 7) == pytest.approx(1.0, abs=1e-9)


def test_seating_draws_follow_the_exact_distribution():
    d, s = 0.5, 1.0
    st = P.log_stirling(P.EXACT, d)
    n = 40_000
    keys = np.arange(n, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    got = np.bincount(P.seat(np.full(n, 3), np.full(n, 0.2), np.zeros(n, dtype=int), s, d, st, keys, 5), minlength=4)[1:] / n
    w = np.array([np.exp(st[3, t]) * 0.2**t * np.prod([s + d * j for j in range(t)]) for t in (1, 2, 3)])
    assert np.allclose(got, w / w.sum(), atol=0.01)
    big = P.seat(np.array([5000]), np.array([0.2]), np.array([0]), s, d, st, keys[:1], 5)
    assert 1 <= big[0] <= 5000


def test_contexts_help_on_held_out_rows(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    model = P.train(d)
    scored = P.score(d, model).cache()
    base, whole = P.perplexity(scored, "base_score"), P.perplexity(scored, "score")
    # the parent alone is a Pitman-Yor model of single words: the contexts take off a tenth or more
    sh, at, alone, n = model.shared, {int(h): i for i, h in enumerate(model.shared.frequent)}, 0.0, 0
    unknown = sh.parent(np.zeros(1), np.zeros(1), 0)[0]
    for r in d.collect():
        if not is_training(r["doc_id"]):
            ws = [word_key(w) for w in tokens(r["text"])]
            alone += sum(math.log10(model.parents[at[w], 0] if w in at else unknown) for w in ws)
            n += len(ws)
    assert len(at) == sh.v  # at this size every word is a frequent one
    assert whole < 0.9 * 10 ** (-alone / n) and whole < 0.5 * base


def test_no_training_rows(spark):
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1)
    d = docs(spark, [(held, "x y")])
    r = P.score(d, P.train(d)).first()
    assert r["train_tokens"] == 0 and r["n_known"] == 0 and math.isfinite(r["score"])
    assert P.score(d.where("false"), P.train(d)).count() == 0
