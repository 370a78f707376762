import duckdb

import corpus_pipeline
from loremill.llm import entry

from .helpers import odd


def test_stages_keep_columns_and_only_drop_rows(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    cols, before = docs.columns, None
    for name, stage in corpus_pipeline.STAGES:
        ids = sorted(r["doc_id"] for r in docs.select("doc_id").collect())
        docs = stage(spark, docs, sf).cache()
        got = sorted(r["doc_id"] for r in docs.select("doc_id").collect())
        assert set(got) <= set(ids) and len(got) == len(set(got))
        before = len(got)
        if name != "sentencepiece":
            assert docs.columns == cols
    assert before and "token_ids" in docs.columns


def test_odd_rows_pass_every_stage(spark, sf):
    docs = odd(spark)
    for name, stage in corpus_pipeline.STAGES[1:]:
        docs = stage(spark, docs, sf).cache()
    assert docs.count() == 5  # the two texts without words are one group


def test_exact_groups_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf}/documents.parquet'")
    want = sorted(con.sql(entry.oracle_sql()["op9_exact_groups"]).fetchall())
    got = sorted(tuple(r) for r in entry.queries()["op9_exact_groups"](spark, sf).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect())
    assert got == want


def test_whole_pipeline_against_brute_force(spark, sf):
    import re

    import pyarrow as pa

    from loremill.llm import decontaminate as D
    from loremill.llm import quality as Q
    from loremill.llm.pieces import Pieces

    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, sf).collect()}
    table, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    texts = {r["doc_id"]: r["text"] for r in table.collect()}
    # 1: the classifier's own scores, one text at a time
    model = Q.train_quality(table, labels)
    left = {i: t for i, t in texts.items() if Q.score_texts(model, pa.array([t]))[0] >= 0.5}
    # 2: of equal texts the largest doc_id
    left = {i: t for i, t in left.items() if i == max(j for j, u in left.items() if u == t)}
    # 3: the true similarity of all pairs of sets of five-word shingles
    ids = sorted(left)

    def shingles(text):
        words = re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text).strip("\x20\x09\x0a\x0b\x0c\x0d"))
        return {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))}

    sets = {i: shingles(left[i]) for i in ids}
    alike = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x, a in enumerate(ids):
        for b in ids[:x]:
            if min(len(sets[a]), len(sets[b])) < 0.7 * max(len(sets[a]), len(sets[b])):
                continue
            near = alike(a, b)
            if near >= 0.8:
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    left = {i: t for i, t in left.items() if find(i) == i}
    # 4: every item over every whole text, without pieces
    items = [n for (t,) in duckdb.sql(f"select text from '{sf}/benchmark.parquet'").fetchall() if (n := D.normalise(t))]
    holds = lambda t: any(D.myers(D.masks(n), len(n), t)[0] <= len(n) // 10 for n in items)
    left = {i: t for i, t in left.items() if not holds(D.normalise(t))}
    assert set(got) == set(left)
    # 5: the ids say the text
    pieces = Pieces()
    assert all(pieces.decode(r["token_ids"]) == left[i] for i, r in got.items())
