import random
import re

import numpy as np
import pytest
import sentencepiece
from hypothesis import given
from hypothesis import strategies as st

from loremill.llm.decontaminate import Matcher, benchmark_matches, budget, drop_contaminated, masks, myers, normalise, pieces
from loremill.llm.pieces import MODEL_PATH, Encoder, Pieces, decode, encode, encoding_rows

from .helpers import ODD, docs, odd

STOCK = sentencepiece.SentencePieceProcessor(model_file=MODEL_PATH)
PLAIN, DROPPED, MORE = Encoder(dropout=0.0), Encoder(dropout=0.1), Encoder(dropout=0.9)
VOCAB = Pieces()


@given(st.text(max_size=60))
def test_round_trip(text):
    for document in (0, 1, 7):
        ids = DROPPED.encode(text, document)
        assert (VOCAB.decode(ids) if ids else "") == text
    assert PLAIN.encode(text) == STOCK.encode(text) or "▁" in text


def _words(ids):
    """Where the ids of each word begin and end: a word's first piece starts with a space."""
    starts = [i for i, x in enumerate(ids) if VOCAB.raw[x].startswith(b" ")]
    return list(zip(starts, [*starts[1:], len(ids)]))


def test_ids_are_those_of_one_agenda_after_the_other():
    rng = random.Random(8)
    texts = [" ".join(rng.choices(["the", "everything", "überall", "x" * 40, "日本", "interesting", "a", "\n", "jumping over"], k=rng.randint(0, 60))) for _ in range(30)]
    for encoder in (PLAIN, DROPPED, MORE):
        got = encoder.encode_many(texts, list(range(30)))
        for n, t in enumerate(texts):
            segments = re.findall(r" *[^ \n]+| +|\n", " " + t) if t else []
            want = [i for s, k in zip(segments, encoder.keys(n, len(segments)).tolist()) for i in VOCAB.segment(s, encoder.dropout, k)]
            assert np.frombuffer(got[n], dtype="<i4").tolist() == want


def test_share_of_skipped_merges():
    # one merge makes a two-letter piece; it is skipped in a tenth of the occurrences
    ids = DROPPED.encode("\n".join(["a"] * 20_000), 3)
    pair = VOCAB.segment(" a")
    assert len(pair) == 1
    rows = DROPPED.encode(" a" * 20_000, 9)
    assert abs(sum(x != pair[0] for x in rows) / 2 / 20_000 - 0.1) < 0.01 and ids


def test_dropout_varies_and_repeats():
    text = "the quick brown foxes were jumping over everything again and again"
    seen = {tuple(DROPPED.encode(text, i)) for i in range(12)}
    assert len(seen) > 8
    # every occurrence draws for itself
    again = " ".join(["everything"] * 200)
    ids = DROPPED.encode(again, 5)
    forms = {tuple(ids[a:b]) for a, b in _words(ids)}
    assert len(forms) > 4
    assert DROPPED.encode(text, 3) == Encoder(dropout=0.1).encode(text, 3)
    assert Encoder(dropout=0.1, seed=18).encode(text, 3) != DROPPED.encode(text, 3)
    assert len(MORE.encode(text)) > len(DROPPED.encode(text)) > len(PLAIN.encode(text))


@given(st.lists(st.text("abcdefghij lmnoé▁日", min_size=1, max_size=40), min_size=1, max_size=6), st.sampled_from([0.0, 0.1, 0.5]))
def test_side_by_side_and_one_by_one_agree(segments, dropout):
    keys = np.array([hash((s, n)) & (2**64 - 1) for n, s in enumerate(segments)], dtype=np.uint64)
    got = [np.frombuffer(b, dtype="<i4").tolist() for b in VOCAB.segments(segments, dropout, keys)]
    assert got == [VOCAB.segment(s, dropout, k) for s, k in zip(segments, keys.tolist())]


def test_frames(spark):
    rows = encoding_rows(odd(spark)).collect()
    assert len(rows) == len(ODD) and all(r["lossless"] for r in rows)
    both = decode(encode(odd(spark).withColumnsRenamed({"lang": "number", "source": "_number"}))).collect()
    assert all((r["text"] or "") == r["decoded"] for r in both)
    assert encoding_rows(odd(spark).where("false")).count() == 0


def brute(pattern, text):
    prev = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        cur = [i]
        for j, t in enumerate(text, 1):
            cur.append(min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (p != t)))
        prev = cur
    return min(prev)


@given(st.text("abc", min_size=1, max_size=30), st.text("abc", max_size=50))
def test_myers(pattern, text):
    assert myers(masks(pattern), len(pattern), text)[0] == brute(pattern, text)


@given(st.text(max_size=100), st.integers(0, 6))
def test_pieces_cover(item, k):
    if len(item) > k:
        assert "".join(p for _, p in pieces(item, k)) == item and len(pieces(item, k)) == k + 1


def damaged(rng, text, edits):
    chars = list(text)
    for _ in range(edits):
        i = rng.randrange(len(chars))
        rng.choice([lambda: chars.pop(i), lambda: chars.insert(i, "z"), lambda: chars.__setitem__(i, "q")])()
    return "".join(chars)


def test_matches_against_brute_force(spark):
    rng = random.Random(3)
    text = lambda n: " ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 7))) for _ in range(n))
    items = [(i, text(rng.randint(8, 30))) for i in range(6)] + [(90, ""), (91, None)]
    rows = []
    for d in range(40):
        i, t = items[d % 6]  # ids from 100 on, apart from the odd rows
        k = budget(len(normalise(t)))
        rows.append((100 + d, f"{text(15)} {damaged(rng, t.upper(), rng.choice([0, k, k + 4, 3 * k]))}\n {text(9)}"))
    rows += ODD
    want = set()
    for d, t in rows:
        for i, item in items:
            if (n := normalise(item or "")) and (x := brute(n, normalise(t or ""))) <= budget(len(n)):
                want.add((d, i, x))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = benchmark_matches(docs(spark, rows), bench)
    assert {(r["doc_id"], r["item_id"], r["distance"]) for r in got.collect()} == want
    small = benchmark_matches(docs(spark, rows), bench, block_bytes=200)
    assert {(r["doc_id"], r["item_id"], r["distance"]) for r in small.collect()} == want
    kept = {r["doc_id"] for r in drop_contaminated(docs(spark, rows), bench).collect()}
    assert kept == {d for d, _ in rows} - {d for d, _, _ in want}
    assert benchmark_matches(odd(spark), bench.where("false")).count() == 0
    assert drop_contaminated(odd(spark), bench.where("false")).count() == len(ODD)


def test_a_tenth_of_an_item_may_differ(spark):
    rng = random.Random(29)
    text = lambda n: "".join(rng.choices("abcdefgh ijklmnop", k=n)).strip()
    items = [(i, text(n)) for i, n in enumerate([11, 22, 30, 60, 90, 150, 233] * 4)]
    rows, want = [], set()
    for d, (i, t) in enumerate(items):
        n = len(normalise(t))
        for at, edits in enumerate((n // 10 - 1, n // 10, n // 10, n // 10 + 2)):
            rows.append((1000 * at + d, f"{text(200)} {damaged(rng, normalise(t), edits)} {text(100)}"))
    for d, t in rows:
        for i, item in items:
            n = normalise(item)
            if (x := brute(n, normalise(t))) <= len(n) // 10:  # a tenth, on its own
                want.add((d, i, x))
    # edits beyond what pieces of 12 characters allow
    assert sum(x > max(0, len(normalise(items[i][1])) // 12 - 1) for _, i, x in want) > 30
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert {(r["doc_id"], r["item_id"], r["distance"]) for r in benchmark_matches(docs(spark, rows), bench).collect()} == want
    kept = {r["doc_id"] for r in drop_contaminated(docs(spark, rows), bench).collect()}
    assert kept == {d for d, _ in rows} - {d for d, _, _ in want}


def test_several_items_of_one_text():
    m = Matcher([(1, "alpha beta gamma delta"), (2, "alpha beta gamma delta")])
    assert {i for i, *_ in m.find("x ALPHA  beta\ngamma delta y")} == {1, 2}


def test_bad_arguments():
    with pytest.raises(ValueError):
        Encoder(dropout=1.0)


def test_items_of_one_number_have_lengths_of_their_own(spark):
    items = [(1, "the quick brown fox jumps over"), (1, "a wholly different passage of the benchmark"), (None, "an item without any number at all")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = spark.createDataFrame([(k, f"before it {t} after it") for k, (_, t) in enumerate(items)], "doc_id long, text string")
    got = {r["doc_id"]: (r["item_id"], r["item_length"], r["distance"]) for r in benchmark_matches(rows, bench).collect()}
    assert got == {k: (i, len(t), 0) for k, (i, t) in enumerate(items)}
