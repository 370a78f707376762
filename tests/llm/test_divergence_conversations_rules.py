import hashlib
import itertools
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loremill.llm import conversations as C
from loremill.llm import divergence as D
from loremill.llm import rules as R

from .helpers import DOCS, ODD, docs, odd, table

# --- conversations ---
TURNS = "conv_id long, turn long, role string, text string"
GRAMMAR = re.compile(r"(s?(ua)+)?")
WHITE = " \t\n\x0b\f\r"


def seen_faults(rows):
    """(initial, must go, truncated) of rows in order, and their counts."""
    known, out, counts = set(), [], Counter()
    for role, text in rows:
        body = text.strip(WHITE)
        kind = "blank" if not body else "duplicate" if (role, text) in known else "truncated" if body[-1] not in ".!?" else ""
        known.add((role, text))
        counts[kind] += 1
        out.append((role[:1], kind in ("blank", "duplicate"), kind == "truncated"))
    return out, counts


def cheapest(rows):
    """Every way to edit ``rows`` (role, text), two inserts at most at each place; the least (cost, audit) and what it leaves."""
    faults, _ = seen_faults(rows)
    best = None
    for gaps in itertools.product(range(3), repeat=len(rows) + 1):
        for edits in itertools.product("KRD", repeat=len(rows)):
            if any(e != "D" and go for e, (_, go, _) in zip(edits, faults)):
                continue
            audit = "I" * gaps[0] + "".join(e + "I" * g for e, g in zip(edits, gaps[1:]))
            cost = sum({"K": 0, "R": 2, "D": 3, "I": 2}[e] for e in audit) + sum(cut for e, (_, _, cut) in zip(edits, faults) if e != "D")
            if best and (cost, audit) >= best[:2]:
                continue
            left, at = [], 0
            for e in audit:
                said = sum(r[:1] != "s" for r, _ in left)
                turn = ("assistant" if said % 2 else "user")
                if e == "I":
                    left.append((turn, ""))
                    continue
                role, text = rows[at]
                at += 1
                if e != "D":
                    left.append((role if e == "K" else turn, text))
            if GRAMMAR.fullmatch("".join(r[:1] or "-" for r, _ in left)):
                best = (cost, audit, left)
    return best


def damage(rows):
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        some = lambda x: " " if x is None else str(x)
        kind = zlib.crc32(f"{some(conv)}:{some(turn)}".encode()) % 20
        role, text = some(role), some(text)
        out[conv] += [(turn, "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text)] * {0: 0, 3: 2}.get(kind, 1)
    return {c: sorted(r, key=lambda x: (x[0] is not None, x[0] or 0, *x[1:])) for c, r in out.items()}


def expected(conv, turns):
    rows = [r[1:] for r in turns]
    cost, audit, left = cheapest(rows)
    _, counts = seen_faults(rows)
    numbers = [t for t, *_ in turns if t is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    illegal = sum(a[:1] + b[:1] not in ("su", "ua", "au") for (a, _), (b, _) in zip(rows, rows[1:]))
    return (conv, gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in left).encode()).hexdigest())


ROWS = [
    (1, 0, "system", "be kind."), (1, 1, "user", "hi"), (1, 2, "assistant", "hello."), (1, 4, "assistant", "more?"),
    (2, None, "user", "x."), (2, None, "user", "x."), (2, 3, "tool", "data"), (2, 9, "assistant", None),
    (3, 0, None, " \n"), (4, 5, "assistant", "só é!"), (4, 5, "assistant", "só é!"), (4, 7, "system", "late."),
    (None, 1, "user", "a."), (None, 2, "assistant", "a."), (None, 3, "user", "a."), (5, 1, "", "z."), (5, 2, "user", "q?"), (5, 3, "user", "q?"),
]


def test_damage_and_repair_against_every_way(spark):
    more = [(c, t, r, x) for c in range(100, 160) for t, (r, x) in enumerate([("user", "u."), ("assistant", f"a{c % 3}."), ("user", "u."), ("assistant", "v")][: 2 + c % 3])]
    lost = next(c for c in range(1000, 2000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows = [*ROWS, *more, (lost, 0, "user", "gone.")]
    df = spark.createDataFrame(rows, TURNS).withColumns({"h": F.lit(1), "mark": F.lit("m"), "blank": F.lit(2), "place": F.lit(3)})
    got = sorted((tuple(r) for r in C.repair(C.damaged(df)).collect()), key=str)
    by = damage(rows)
    assert got == sorted((expected(c, t) for c, t in by.items()), key=str)
    assert by[lost] == []


@settings(max_examples=60)
@given(st.lists(st.tuples(st.sampled_from("sua-"), st.booleans(), st.booleans()), max_size=4))
def test_layers_are_the_cheapest_edits(kinds):
    layer = C.closed([(0, ""), C._NONE, C._NONE, C._NONE])
    rows = []
    for k, (initial, blank, cut) in enumerate(kinds):
        layer = C.advanced(layer, initial, blank, cut and not blank)
        rows.append((initial, "" if blank else f"{k}" + ("" if cut else ".")))
    assert min(layer[0], layer[3]) == cheapest(rows)[:2]


def test_a_long_conversation_settles_and_its_rows_are_its_digest(spark):
    long = [(7, t, ("user", "assistant", "user", "system", "tool")[t * 7 % 5], ["ok.", f"line {t}", "", f"same {t % 50}."][t % 4]) for t in range(4000)]
    df = spark.createDataFrame(long, TURNS)
    settled = C.repair(df).first()
    layer, faults = C.closed([(0, ""), C._NONE, C._NONE, C._NONE]), seen_faults([r[2:] for r in long])[0]
    for f in faults:
        layer = C.advanced(layer, *f)
    assert (settled["cost"], settled["audit"]) == min(layer[0], layer[3])
    left = C.repaired_turns(df).orderBy("place").collect()
    assert hashlib.sha256("\n".join(f"{r['role']}:{r['text']}" for r in left).encode()).hexdigest() == settled["repaired_sha256"]
    assert GRAMMAR.fullmatch("".join(r["role"][0] for r in left)) and [r["place"] for r in left] == list(range(len(left)))


def test_no_conversations(spark):
    none = spark.createDataFrame([], TURNS)
    assert C.repair(C.damaged(none)).count() == 0 and C.repaired_turns(none).count() == 0


# --- divergence ---
def brute_audit(rows, least, top):
    """rows: (lang, source, text)"""
    words = lambda t: re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t))
    df, by = Counter(), defaultdict(Counter)
    for lang, source, t in rows:
        ws = words(t)
        by[lang, source].update(ws)
        df.update((lang, w) for w in set(ws))
    out = []
    for lang in {g[0] for g in by}:
        kept = sorted(w for (x, w), n in df.items() if x == lang and n >= least)
        groups = sorted(s for x, s in by if x == lang)
        count = {s: [by[lang, s][w] for w in kept] for s in groups}
        p = lambda c: [1 + 10**9 * (x + 5) // (sum(c) + 5 * len(kept)) for x in c]
        whole = p([sum(count[s][k] for s in groups) for k in range(len(kept))])
        for s in groups:
            mine = p(count[s])
            pairs = sorted(((sum(abs(a - b) for a, b in zip(mine, p(count[o]))), o) for o in groups if o != s), key=lambda x: (-x[0], x[1].encode()))
            terms = sorted(((a - b, w) for a, b, w, n in zip(mine, whole, kept, count[s]) if n and a > b), key=lambda x: (-x[0], x[1].encode()))[:top]
            out += [(lang, s, part, item, v, k) for part, found in (("pair", pairs), ("term", terms)) for k, (v, item) in enumerate(found, 1)]
    return sorted(out)


def test_audit_against_a_loop(spark, sf):
    rows = [(lang or "", source or "", text or "") for _, text, lang, source, _ in table(sf, "documents")]
    df = spark.createDataFrame(rows, "lang string, source string, text string")
    want = brute_audit(rows, 5, 7)
    assert sorted(map(tuple, D.audit(df, 5, 7).collect())) == want
    # many small blocks, chunks and spans give the same
    assert sorted(map(tuple, D.audit(df.repartition(3), 5, 7, block=3, chunk=16, span=2).collect())) == want


def test_audit_of_odd_rows(spark):
    rows = [(None, None, None), ("en", "a", ""), ("en", "b", "x X x"), ("en", "b", "x X x"), ("de", "c", "é É-日本 z"), ("de", "c", "é"), ("de", None, "Zz"), ("en", "ä", "w" * 9000)]
    df = spark.createDataFrame(rows, "lang string, source string, text string").withColumns({"n": F.lit("n"), "term": F.lit(1), "place": F.lit(2)})
    for least in (1, 2, 30):
        assert sorted(map(tuple, D.audit(df, least, 50, block=2).collect())) == brute_audit([tuple(x or "" for x in r) for r in rows], least, 50)
    assert D.audit(df.limit(0)).count() == 0


def test_slices_and_shares(monkeypatch):
    raw = "Ab é, cd!日本 x".encode() * 50
    whole = raw.translate(D._FOLD).split()
    for size in (1, 3, 7, 10_000):
        monkeypatch.setattr(D, "_SLICE", size)
        assert [w for some in D._slices(raw) for w in some] == whole
    big = [0, 1, 10**12, 9 * 10**14]
    total = 9 * 10**15
    assert D.shares(np.array(big, np.int64), np.array([total] * 4, np.int64)).tolist() == [1 + 10**9 * (c + 5) // total for c in big]


def test_exact_share_column(spark):
    rows = [(10**15, 9 * 10**15, 1000), (0, 0, 1), (7, 9, 3)]
    got = [r[0] for r in spark.createDataFrame(rows, "c long, n long, v long").select(D.share("c", "n", "v")).collect()]
    assert got == [1 + 10**9 * (c + 5) // (n + 5 * v) for c, n, v in rows]


# --- rules ---
def base(text):
    t = text or ""
    ws = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(ws[i : i + 5]) for i in range(len(ws) - 4)]
    often = Counter(windows)
    repeated = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(5)}
    return (len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(repeated), len(ws) < 10 or 100 * len(repeated) > 20 * len(ws))


def test_base_counts(spark, sf):
    rows = ODD + [(100 + d[0], d[1]) for d in table(sf, "documents")] + [(50, "a b c d e a b c d e"), (51, "a b c d e f a b c d e"), (52, "a " * 40), (53, " lead\n\nlead\n lead\n#*|"), (54, "a b c d"), (55, "a b c d e")]
    df = docs(spark, rows).withColumns({"words": F.lit("w"), "lines": F.lit(1), "n_words": F.lit(0), "plain": F.lit("p")})
    out = R.apply_rules(df)
    assert sorted(map(str, ((r[0], *r[1:7]) for r in out.collect()))) == sorted(map(str, ((i, *base(t)) for i, t in rows)))
    assert R.apply_rules(df.limit(0)).count() == 0


def test_order_changes_no_verdict_and_hot_rules_come_first(spark):
    prose = " ".join(f"word{i}" for i in range(40))
    rows = [(i, " ".join(f"{w}{i}" for w in prose.split()) + (" #" * 8 if i % 2 else "")) for i in range(200)] + [(300, "WORD " + prose.upper()), (301, "\n".join(f"- item{i} yes" for i in range(20)))]
    df = docs(spark, rows)
    rules = {"never": lambda: F.length("t") < 0, **R.RULES}
    order = [n for n, _, _ in R.cascade_order(df, rules)]
    assert sorted(order) == sorted(rules) and order.index("symbols") < order.index("never")
    verdict = lambda names: sorted((r["doc_id"], r["kept"]) for r in R.apply_rules(df, names, rules).collect())
    assert verdict(order) == verdict(list(reversed(order)))
    why = {r["doc_id"]: r["rejected_by"] for r in R.rule_cascade(df).collect()}
    assert why[1] == "symbols" and why[0] is None and why[300] == "shouting" and why[301] == "list_items"


def test_a_rejected_row_pays_for_no_later_rule(spark):
    broken = {"first": lambda: F.lit(True), "second": lambda: F.raise_error(F.lit("evaluated")).cast("boolean")}
    rows = [(1, "short"), (2, " ".join(f"w{i}" for i in range(30)))]
    assert {r["doc_id"]: r["rejected_by"] for r in R.apply_rules(docs(spark, rows), None, broken).collect()} == {1: "base", 2: "first"}
    with pytest.raises(Exception, match="evaluated"):
        R.apply_rules(docs(spark, rows), ["second", "first"], broken).collect()


def test_native_plan_has_no_python(spark):
    plan = R.apply_rules(odd(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_cascade_of_nothing(spark):
    assert R.rule_cascade(spark.createDataFrame([], DOCS)).count() == 0
