import hashlib
import re

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from loremill.llm import licenses as Z
from loremill.llm import pii as I
from loremill.llm.token_counts import TokenRollup, count_tokens

from .helpers import ODD, docs, odd


def brute(text):
    out = []
    for n, k in enumerate(I.KINDS):
        for m in re.finditer(I.PATTERNS[k], text):
            if I._valid(k, m.group()):
                out.append((m.start(), n, m.end(), k))
    return [(s, e, k) for s, _, e, k in sorted(out)]


@given(st.text("0123456789.@+- ()aZ_%\n", max_size=60))
def test_base_spans(text):
    assert I.base_spans(text) == brute(text)


def test_luhn_and_ranges():
    assert [s[2] for s in I.base_spans("4316 5226-7852 5456; 10.0.0.255; +1 (743) 555-3824 a.b@c.de")] == ["card", "ip", "phone", "email"]
    assert I.base_spans("4316522678525457 10.0.0.256 +1234 a@b") == []


FIELD = I.fit([])


def test_repeated_values_share_labels():
    text = "Call +1 (743) 555-3824 now. " + "word " * 500 + "Later 743-555-3824; order 555-9999."
    spans = I.all_spans(FIELD, text, I.base_spans(text))
    assert [text[s:e] for s, e, _ in spans] == ["+1 (743) 555-3824", "743-555-3824"]
    assert I.redact("a +1 (743) 555-3824 b", I.base_spans("a +1 (743) 555-3824 b")) == "a [phone] b"


def test_clean_text_has_no_spans():
    for text in ("Version 2.0, 1999, 10 of 20", "token = 24be64439e3e49cf46b2d7c90f3602a3d0b907ff", "1234567890123456", "x" * 100_000 + "1"):
        assert I.all_spans(FIELD, text, I.base_spans(text)) == []


def _corpus(rng, n):
    """Texts with an entity, some words, and later the entity once more in a form that no pattern takes, among other numbers."""
    out = []
    word = lambda: "".join(rng.choice(list("abcdefgh"), 5))
    for i in range(n):
        area, mid, end = rng.integers(200, 999), rng.integers(200, 999), rng.integers(1000, 9999)
        whole, again = [(f"+1 ({area}) {mid}-{end}", f"{area}.{mid}.{end}"), (f"u{mid}x{end}@{word()}.com", f"u{mid}x{end}@{word()}")][i % 2]
        filler = [word() for _ in range(rng.integers(5, 60))]
        noise = f"order {rng.integers(200, 999)}.{rng.integers(200, 999)}.{rng.integers(1000, 9999)}, year {rng.integers(1900, 2030)}"
        out.append((" ".join(["reach", whole, "or", *filler, noise, *filler[:9], "later", again, "end"]), again))
    return out


def test_skip_edges_find_masked_repeats_on_held_out_texts():
    rng = np.random.default_rng(11)
    train, held = _corpus(rng, 120), _corpus(rng, 60)
    field = I.fit([r for t, _ in train for r in I._training_rows(t)])
    without = I.Field(field.unary, field.chain, 0 * field.skip)

    def found(f):
        hit = extra = 0
        for t, again in held:
            added = [t[s:e] for s, e, _ in I.added_spans(f, t, I.base_spans(t))]
            hit += again in added
            extra += len(set(added) - {again})
        return hit / len(held), extra

    assert found(field)[0] >= 0.9 and found(field)[1] <= 1
    assert found(without)[0] <= 0.1


def test_every_token_of_a_text_with_a_hint_is_a_node():
    text = "Ann wrote to a.b@c.de, then Ann called 415-555-2671 twice."
    cs = I.nodes(text, I.base_spans(text))
    assert [text[c.start : c.end] for c in cs] == ["Ann", "wrote", "to", "a.b@c.de", "then", "Ann", "called", "415-555-2671", "twice"]
    pairs, kinds = I.edges(text, cs)
    assert (0, 5) in [tuple(p) for p, k in zip(pairs.tolist(), kinds.tolist()) if k]


@pytest.mark.parametrize("unit", ["1 ", "1-", "+1", "a@", "1.", "(1) ", "x9"])
def test_time_grows_with_the_text_alone(unit):
    import time

    text = unit * (1_000_000 // len(unit))
    start = time.monotonic()
    base = I.base_spans(text)
    I.nodes(text, base)
    assert time.monotonic() - start < 20


def test_belief_propagation_is_exact_on_a_tree():
    import itertools

    import numpy as np

    rng = np.random.default_rng(2)
    f = I.Field(np.zeros((5, 1)), rng.normal(size=(5, 5)), 2 * np.eye(5))
    u = rng.normal(size=(3, 5))
    pairs, kinds = np.array([[0, 1], [0, 2]]), np.array([0, 1])
    p = I.infer(f, u, pairs, kinds, rounds=60)
    total = np.zeros((3, 5))
    for labs in itertools.product(range(5), repeat=3):
        w = np.exp(sum(u[i, x] for i, x in enumerate(labs)) + f.chain[labs[0], labs[1]] + f.skip[labs[0], labs[2]])
        for i, x in enumerate(labs):
            total[i, x] += w
    assert np.allclose(p, total / total.sum(1, keepdims=True), atol=1e-3)


def test_pii_rows(spark, sf):
    rows = {(r["doc_id"], r["spans"]): r for r in I.pii_rows(odd(spark), I.train_field(odd(spark))).collect()}
    assert sum(r["n_phone"] for r in rows.values()) == 1
    table = spark.read.parquet(f"{sf}/documents.parquet")
    got = I.pii_rows(table, I.train_field(table)).collect()
    texts = {r["doc_id"]: r["text"] for r in table.collect()}
    for r in got:
        base = brute(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(I.encode_spans(base).encode()).hexdigest()
        assert set(filter(None, I.encode_spans(base).split(","))) <= set(r["spans"].split(","))
    assert I.pii_rows(odd(spark).where("false"), FIELD).count() == 0
    assert I.train_field(odd(spark).where("false")).skip[1, 1] > 0


def test_licenses(spark):
    files = [
        (1, "a/LICENSE", "MIT License\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"), (2, "a/b/c/x.py", "code"), (3, "a/y.py", "# Licensed under the Apache License, Version 2.0."),
        (4, "a/b/LICENSE", "This work is licensed under the GNU General Public License, version 3."), (5, "z.py", None), (6, None, ""), (2, "a/b/c/x.py", "code"), (7, "q/r.py", "license to a word that no notice has anywhere near here"),
    ]
    df = spark.createDataFrame(files, "doc_id long, path string, text string")
    got = {r["doc_id"]: (r["license"], r["how"]) for r in Z.scan_licenses(df).collect()}
    assert got == {1: ("MIT", "own"), 2: ("GPL-3.0", "inherited"), 3: ("Apache-2.0", "own"), 4: ("GPL-3.0", "own"), 5: (None, "none"), 6: (None, "none"), 7: (None, "none")}
    assert Z.scan_licenses(df).count() == len(files)
    assert Z.scan_licenses(df.where("false")).count() == 0
    root = spark.createDataFrame([(1, "LICENSE", "Released under the MIT License."), (2, "a/b.py", "x")], "doc_id long, path string, text string")
    assert {r["doc_id"]: r["how"] for r in Z.scan_licenses(root).collect()} == {1: "own", 2: "inherited"}
    with pytest.raises(ValueError):
        Z.scan_licenses(df, {str(i): ("x",) for i in range(Z.MAX_TEMPLATES + 1)})


def test_notices_in_long_lines_and_over_lines(spark):
    rng = np.random.default_rng(4)
    prose = lambda n: " ".join("".join(rng.choice(list("abcdefgh"), 5)) for _ in range(n))
    files = [
        (1, "a.py", prose(300) + " No part may be reproduced without permission. " + prose(300)),
        (2, "b.py", "/* This work is licensed under\n * the GNU General\n * Public License, version 3. */\n" + prose(50)),
        (3, "c.py", prose(700)),
        (4, "d.py", prose(90) + "\n" + "You can redistribute it and/or modify it under the terms\nof the GNU General Public License as published by the Free Software\nFoundation, either version 3 of the License\n" + prose(9)),
    ]
    df = spark.createDataFrame(files, "doc_id long, path string, text string")
    assert {r["doc_id"]: r["license"] for r in Z.scan_licenses(df).collect()} == {1: "Proprietary", 2: "GPL-3.0", 3: None, 4: "GPL-3.0"}
    # a caller's own templates: a whole file, and one of words that no built-in template has
    whole = prose(200)
    mine = {"X-1": (whole,), "X-2": ("zwei drei vier",)}
    df = spark.createDataFrame([(1, "LICENSE", "intro\n" + whole.replace(" ", "\n") + " " + prose(20)), (2, "x/y", prose(30) + " zwei\ndrei vier " + prose(30)), (3, "x/z", whole[: len(whole) // 6])], "doc_id long, path string, text string")
    got = {r["doc_id"]: (r["license"], r["how"]) for r in Z.scan_licenses(df, mine).collect()}
    assert got == {1: ("X-1", "own"), 2: ("X-2", "own"), 3: ("X-1", "inherited")}


def test_exact_notices_are_found_however_common(spark):
    rng = np.random.default_rng(6)
    prose = lambda n: " ".join("".join(rng.choice(list("abcdefgh"), 5)) for _ in range(n))
    notices = [(lic, t) for lic, ts in Z.TEMPLATES.items() for t in ts]
    every = [(i, f"x/{i}.py", "SPDX-License-Identifier: MIT\n" + prose(80), "MIT") for i in range(300)]
    some = [(i, f"x/{i}.py", "Released under the MIT License.", "MIT") for i in range(300)] + [(300, "x/300.py", "Released under the MIT License. You may not use this file except", "MIT")]
    mixed = [(i, f"x/{i}.py", f"{prose(i % 7)}\n{t}\n{prose(30)}", lic) for i, (lic, t) in enumerate(notices * 4)] + [(1000 + i, f"x/{1000 + i}.py", prose(60), None) for i in range(900)]
    for files in (every, some, mixed):
        df = spark.createDataFrame([f[:3] for f in files], "doc_id long, path string, text string")
        got = {r["doc_id"]: r["license"] for r in Z.scan_licenses(df).collect()}
        assert got == {i: lic for i, _, _, lic in files}
    other = spark.createDataFrame([(i, f"{i}.c", "SPDX-License-Identifier: " + ("MIT" if i else "Zlib")) for i in range(50)], "doc_id long, path string, text string")
    assert [r["doc_id"] for r in Z.scan_licenses(other).where("license is null").collect()] == [0]


def test_scan_against_all_windows(spark, sf):
    import duckdb

    from loremill.llm import entry

    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf}/documents.parquet'")
    cols = ["doc_id", "path", "license", "how", "cosine", "license_path"]
    want = sorted(map(str, con.sql(f"select {', '.join(cols)} from ({entry.oracle_sql()['op4_license_scan']})").fetchall()))
    got = sorted(str(tuple(r)) for r in entry.op4_license_scan(spark, sf).select(*cols).collect())
    assert got == want and any("own" in r for r in got)


def test_document_paths_cover_all(spark, sf):
    table = spark.read.parquet(f"{sf}/documents.parquet")
    rows = Z.scan_licenses(Z.document_paths(table)).collect()
    assert len(rows) == table.count()
    text = {r["doc_id"]: r["text"] for r in table.collect()}
    for r in rows:
        if "Released under the MIT License." in text[r["doc_id"]]:
            assert r["license"] == "MIT"


def totals(r):
    return {(x["source"], x["lang"], x["version"]): (x["documents"], x["tokens"]) for x in r.totals().collect()}


C = "op string, doc_id long, source string, lang string, version string, n_tokens long, seq long"


def test_rollup(spark, tmp_path):
    r = TokenRollup(spark, str(tmp_path / "r"))
    assert r.totals().count() == 0
    first = spark.createDataFrame([("insert", 1, "a", "en", "v", 5, 0), ("insert", 2, "a", "en", "v", 7, 0), ("insert", 3, None, None, "v", 0, 0), ("insert", None, "b", "en", "v", 2, 0), ("insert", 1, "a", "en", "v", 5, 0)], C)
    assert r.apply("one", first)
    assert totals(r) == {("a", "en", "v"): (2, 12), (None, None, "v"): (1, 0), ("b", "en", "v"): (1, 2)}
    assert not r.apply("one", first)
    assert totals(r)["a", "en", "v"] == (2, 12)
    second = spark.createDataFrame([("delete", 1, None, None, "v", None, 1), ("revise", 2, "c", "en", "v", 9, 1), ("revise", 2, "c", "en", "v", 8, 2), ("delete", 99, None, None, "v", None, 1), ("insert", 4, "a", "en", "w", 1, 1)], C)
    assert r.apply("two", second)
    want = {("c", "en", "v"): (1, 8), (None, None, "v"): (1, 0), ("b", "en", "v"): (1, 2), ("a", "en", "w"): (1, 1)}
    assert totals(r) == want
    r.compact()
    assert totals(r) == want and not r.apply("two", second)
    assert r.apply("three", first.where("false")) and totals(r) == want
    assert r.apply("four", spark.createDataFrame([("delete", None, None, None, "v", None, 0), ("insert", 1, "a", "en", "v", 3, 0)], C))
    assert totals(r) == {k: v for k, v in want.items() if k[0] != "b"} | {("a", "en", "v"): (1, 3)}
    assert r.present().where("doc_id = 2").first()["n_tokens"] == 8


def test_rollup_ignores_files_of_a_failed_batch(spark, tmp_path, monkeypatch):
    r = TokenRollup(spark, str(tmp_path / "r"))
    rows = spark.createDataFrame([("insert", 1, "a", "en", "v", 5, 0)], C)
    monkeypatch.setattr(r, "_commit", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        r.apply("one", rows)
    assert r.totals().count() == 0
    monkeypatch.undo()
    assert r.apply("one", rows) and totals(r) == {("a", "en", "v"): (1, 5)}


def test_an_overtaken_writer_changes_nothing(spark, tmp_path):
    rows = spark.createDataFrame([("insert", 1, "a", "en", "v", 5, 0)], C)
    more = spark.createDataFrame([("insert", 2, "a", "en", "v", 6, 0)], C)
    r, late = TokenRollup(spark, str(tmp_path / "r")), TokenRollup(spark, str(tmp_path / "r"))
    before = late._manifest()
    assert r.apply("one", rows)
    late._manifest = lambda: before
    with pytest.raises(Exception, match="already exists"):
        late.apply("two", more)
    assert totals(r) == {("a", "en", "v"): (1, 5)}
    del late._manifest
    assert late.apply("two", more) and totals(r) == {("a", "en", "v"): (2, 11)}


def test_rollup_compacts_by_itself(spark, tmp_path):
    r = TokenRollup(spark, str(tmp_path / "r"), buckets=3, compact_every=2)
    for n in range(5):
        assert r.apply(f"b{n}", spark.createDataFrame([("insert", n % 3, "a", "en", "v", n, 0)], C))
    assert len(r._manifest()[1]["deltas"]) <= 2 and totals(r) == {("a", "en", "v"): (3, 3 + 4 + 2)}
    assert not any(r.apply(f"b{n}", spark.createDataFrame([("delete", 1, None, None, "v", None, 0)], C)) for n in range(5))


def test_rollup_query_against_a_recount(spark, sf):
    import base64
    import os

    import tiktoken

    from loremill.llm import entry
    from loremill.llm import token_counts as T

    encodings = {}
    for v, f in T.VERSIONS.items():
        with open(os.path.join(T.TOKENIZER_DIR, f), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        encodings[v] = tiktoken.Encoding(v, pat_str=T.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        n = {v: len(e.encode_ordinary(r["text"] or "")) for v, e in encodings.items()}
        for v in n:
            if v == "byte_bpe_multi_50k" or n["byte_bpe_multi_50k"] >= n["byte_bpe_50k"]:
                d, t = want.get((r["source"], r["lang"], v), (0, 0))
                want[r["source"], r["lang"], v] = (d + 1, t + n[v])
    got = {(r["source"], r["lang"], r["version"]): (r["documents"], r["tokens"]) for r in entry.op1_token_rollup(spark, sf).collect()}
    assert got == want


def test_counts(spark):
    import tiktoken  # noqa: F401

    rows = count_tokens(odd(spark)).collect()
    assert len(rows) == 2 * len(ODD)
    assert {r["n_tokens"] for r in rows if r["doc_id"] in (1, 2)} == {0}
    assert count_tokens(docs(spark, [(1, "x")]).where("false")).count() == 0


def test_similar_addresses_and_short_tokens_share_an_edge():
    def tied(a, b):
        cs = [I.Node(0, 1, a, 0, False, 0), I.Node(9, 10, b, 0, False, 0)]
        pairs, kinds = I.edges("x" * 20, cs)
        return [tuple(p) for p, k in zip(pairs.tolist(), kinds.tolist()) if k]

    assert tied("10.1.2.3", "10.1.2.44") == [(0, 1)] and tied("10.1.2.3", "10.1.22.3") == []
    assert tied("a12", "a12") == [(0, 1)] and tied("a12", "a13") == []


def test_training_rows_count_as_often_as_they_occur(spark):
    rows = [(i, "call 415-555-2671 now") for i in range(80)] + [(200 + i, "mail a1@example.org") for i in range(3)]
    got = I.train_field(docs(spark, rows))
    each = [r for _, t in rows for r in I._training_rows(t)]
    once = sorted(set(each), key=repr)
    want = I.fit(once, counts=[each.count(r) for r in once])
    assert np.allclose(got.unary, want.unary) and np.allclose(got.chain, want.chain) and np.allclose(got.skip, want.skip)
    few, many = I.fit(once, steps=3, counts=[each.count(r) for r in once]), I.fit(each, steps=3)
    assert np.allclose(few.unary, many.unary) and np.allclose(few.chain, many.chain) and np.allclose(few.skip, many.skip)
