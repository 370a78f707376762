"""Search against SQLite's FTS5, and the query language."""

import sqlite3
from itertools import product

import pytest
from hypothesis import given
from hypothesis import strategies as st

from loremill.functions.porter import stem
from loremill.operators import search as S
from loremill.plans.query_language import QueryError, parse, sanitise

DOCS = [
    (1, "Alpha", "running fox runs over the lazy dog", '["animals"]'),
    (2, "Beta", "fox", "[]"),
    (3, "Gamma runner", "nothing here at all but foxes and foxes", '["fox"]'),
    (4, "Delta", "unrelated words only café", "[]"),
    (5, "E", "zzz", "[]"),
]


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.createDataFrame([(n, str(n), *r, None, "project", "memory") for n, *r in DOCS], "ingest_seq long, id string, title string, body string, tags_text string, project string, scope string, atom_type string").cache()


@pytest.fixture(scope="module")
def fts():
    c = sqlite3.connect(":memory:")
    try:
        c.execute("create virtual table t using fts5(title, body, tags, tokenize='porter unicode61')")
    except sqlite3.OperationalError:
        pytest.skip("no FTS5 here")
    c.executemany("insert into t(rowid, title, body, tags) values (?, ?, ?, ?)", DOCS)
    return c


@pytest.mark.parametrize("q", ['"fox"', '"run"', '"runner"', '"fox" "dog"', '"fox" OR "words"', '"fox" NOT "dog"', '"fo" *', '"cafe"', '"lazy-dog"', '"title:fox"', '""', '"fox" ""', '"fox" "fox"', '"FOX" AND "lazy"', '"the lazy"'])
def test_ranks(corpus, fts, q):
    want = fts.execute("select rowid, rank from t where t match ? order by rank, rowid", (q,)).fetchall()
    got = [(r["ingest_seq"], r["rank"]) for r in S.search(corpus, q, None, parsed=True).orderBy("rank", "ingest_seq").collect()]
    assert [g[0] for g in got] == [w[0] for w in want]
    assert [g[1] for g in got] == pytest.approx([w[1] for w in want], abs=2e-6)


@pytest.mark.parametrize("q", ["AND", '"fox" AND', 'NOT "fox"', '"'])
def test_errors(q):
    with pytest.raises(QueryError):
        parse(q)


def test_precedence(spark):
    subsets = [[w for w, on in zip(("aa", "bb", "cc", "dd"), bits) if on] for bits in product((0, 1), repeat=4)]
    rows = [(n, str(n), "t", " ".join(ws), "", None, "project", "memory") for n, ws in enumerate(subsets)]
    df = spark.createDataFrame(rows, "ingest_seq long, id string, title string, body string, tags_text string, project string, scope string, atom_type string")
    c = sqlite3.connect(":memory:")
    c.execute("create virtual table t using fts5(title, body, tags)")
    c.executemany("insert into t(rowid, title, body, tags) values (?, ?, ?, '')", [(r[0], r[2], r[3]) for r in rows])
    for q in ('"aa" NOT "bb" "cc"', '"aa" NOT "bb" AND "cc"', '"aa" OR "bb" "cc"', '"aa" NOT "bb" NOT "cc"', '"aa" OR "bb" AND "cc" NOT "dd"'):
        want = {r[0] for r in c.execute("select rowid from t where t match ?", (q,))}
        assert {r["ingest_seq"] for r in S.search(df, q, None, stem=False, parsed=True).collect()} == want, q


def test_sanitise():
    assert sanitise("  ") == '""'
    assert sanitise("fox* AND la\"zy or") == '"fox" * AND "lazy" "or"'
    assert sanitise('"lazy dog"') == '"lazy dog"'


@given(st.text(max_size=40))
def test_sanitised_input_parses_or_says_why(raw):
    try:
        parse(sanitise(raw))
    except QueryError:
        pass


def test_stem_like_fts5():
    words = "running runs ran foxes relational conditional rational hopping hoping happy sky agreed plastered motoring conflated troubled sized falling controlling generalizations oscillators adjustable activate effective bowdlerize probate rate cease roll university sensibiliti formaliti triplicate electrical hopeful goodness revival allowance inference airliner dependent adoption communism".split()
    c = sqlite3.connect(":memory:")
    c.execute("create virtual table t using fts5(x, tokenize='porter unicode61')")
    c.execute("create virtual table v using fts5vocab('t', 'row')")
    for w in words:
        c.execute("delete from t")
        c.execute("insert into t values (?)", (w,))
        assert [r[0] for r in c.execute("select term from v")] == [stem(w)], w


@pytest.mark.parametrize("at, first, last, lead, trail", [([5], 0, 39, False, True), ([150], 131, 170, True, True), ([195], 160, 199, True, False), ([60, 90], 56, 95, True, True), ([], 0, 39, False, True)])
def test_snippet(at, first, last, lead, trail):
    words = [f"w{i}" for i in range(200)]
    for i in at:
        words[i] = "hit"
    got = S.make_snippet(" ".join(words), [(("hit",), False)], False)
    plain = got.replace("<mark>", "").replace("</mark>", "")
    assert plain.startswith("...") == lead and plain.endswith("...") == trail
    kept = plain.strip(".").split()
    assert len(kept) == 40
    assert got.count("<mark>") == len(at)
    if at != [60, 90]:
        assert abs(words.index(kept[0]) - first) <= 1


def test_snippet_short_and_unmarked():
    assert S.make_snippet("a fox b", [(("fox",), False)], False) == "a <mark>fox</mark> b"
    assert S.make_snippet("lazy dog", [(("lazy", "dog"), False)], False) == "<mark>lazy dog</mark>"
    assert S.make_snippet("", [(("x",), False)], False) == ""


def test_index_keeps_few_segments_and_answers_like_the_texts(spark):
    import random

    from loremill.operators.index import SearchIndex, _tiers

    shape = "ingest_seq long, id string, title string, body string, tags_text string, project string, scope string, atom_type string"
    rnd = random.Random(5)
    row = lambda n, body: (n, f"i{n}", None if n % 4 else "fox", body, None, None, "project", "memory")
    text = lambda: rnd.choice(["fox", "dog fox fox", "", None, "the lazy dog " * 3])
    now = {n: text() for n in range(12)}
    table = lambda ns: spark.createDataFrame([row(n, now[n]) for n in ns], shape)
    index = SearchIndex.build(table(now))
    for step in range(3):
        gone = [2 * step]
        new = [1 + step, 20 + step]
        for n in gone:
            now.pop(n, None)
        now.update({n: text() for n in new})
        index = index.updated(table(new), spark.createDataFrame([(f"i{n}",) for n in gone], "id string"))
        assert len(index.segments) <= 3 and sum(s.alive for s in index.segments) == len(now)
    atoms = table(now)
    for i in (index, index.merged()):
        rows = lambda df: [(r["id"], round(r["rank"], 9)) for r in df.collect()]
        assert rows(i.search(atoms, "fox", 9)) == rows(S.search(atoms, "fox", 9))
    # only removals, down to nothing, and up again
    empty = index.updated(atoms.where("false"), atoms.select("id"))
    assert len(empty.segments) == 1 and empty.search(atoms.where("false"), "fox", 9).count() == 0
    # by sizes alone: fifty changes of one atom leave logarithmically many
    sizes: list[int] = [1000]
    for _ in range(50):
        sizes = _tiers([*sizes, 1], lambda n: n, lambda a, b: a + b)
        assert len(sizes) <= 10 and all(a > 2 * b for a, b in zip(sizes, sizes[1:]))
    assert sum(sizes) == 1050


def test_postings_of_blocks_against_counting(monkeypatch):
    import random

    import pyarrow as pa

    from loremill.operators import index as I

    monkeypatch.setattr(I, "BLOCK", 7)
    rnd = random.Random(2)
    atoms = [(f"i{n}", n, [[rnd.choice(["a", "b", "é", "ab"]) for _ in range(rnd.randrange(4))] for _ in range(3)]) for n in range(30)]
    rows = [(i, n, c, ws) for i, n, columns in atoms for c, ws in enumerate(columns)]
    shape = pa.schema([("id", pa.string()), ("ingest_seq", pa.int64()), ("n", pa.int32()), ("words", pa.list_(pa.string()))])
    batches = [pa.RecordBatch.from_pylist([dict(zip(shape.names, r)) for r in rows[at : at + 4]], shape) for at in range(0, len(rows), 4)]
    got = [r for b in I._postings(iter(batches)) for r in b.to_pylist()]
    want: dict = {}
    for i, n, c, ws in rows:
        for k, w in enumerate(ws):
            want.setdefault((w, i), []).append(c * I.OFFSET + k)
    assert {(r["term"], r["id"]): r["pos"] for r in got if r["term"] is not None} == want and len(got) == len(want) + len(atoms)
    size = {i: sum(map(len, columns)) for i, _, columns in atoms}
    assert all(r["dl"] == size[r["id"]] and r["ingest_seq"] == int(r["id"][1:]) for r in got)


def test_building_shuffles_no_postings_and_phrases_are_counted(spark):
    from loremill.operators.index import SearchIndex

    from .test_links import shuffled_rows

    words = ["of", "the", "sea", "one"]
    rows = [(n, f"i{n}", words[n % 4], " ".join(words[(n + k * (1 + n % 3)) % 4] for k in range(9)), None, "project", "memory", "[]") for n in range(600)]
    atoms = spark.createDataFrame(rows, "ingest_seq long, id string, title string, body string, project string, scope string, atom_type string, tags_text string")
    before = shuffled_rows(spark)
    index = SearchIndex.build(atoms)
    assert shuffled_rows(spark) - before < 200
    pairs = lambda df: sorted((r["id"], round(r["rank"], 9)) for r in df.collect())
    for raw in ('"of the"', '"the sea one"'):
        assert pairs(index.search(atoms, raw, None, stem=False)) == pairs(S.search(atoms, raw, None, stem=False))
