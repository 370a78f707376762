import random
from itertools import combinations

import numpy as np
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loremill.operators import links as L


def test_tag_pairs_in_tiles_against_all_pairs(spark):
    rows = [(i, t) for i in range(120) for t in {"hot", f"a{i % 7}", f"b{i % 5}"} if (i * 31 + len(t)) % 11]
    tags = {i: {t for j, t in rows if j == i} for i in range(120)}
    want = sorted((a, b, len(tags[a] & tags[b])) for a, b in combinations(range(120), 2) if len(tags[a] & tags[b]) >= 2)
    table = spark.createDataFrame(rows, "seq long, tag string")
    for run in (1000, 9):
        assert sorted((r["a"], r["b"], r["shared"]) for r in L.tag_overlap(table, run=run).collect()) == want


def test_project_pairs_and_classes_against_all_pairs(spark):
    rows = [(i, None if i % 13 == 0 else "" if i % 17 == 0 else f"p{i % 3}", "plan" if i % 11 == 0 else "note", f"memory/{i // 4}.md" if i % 19 else "other.md") for i in range(90)]
    atoms = spark.createDataFrame(rows, "ingest_seq long, project string, atom_type string, source_path string")
    kept = [r for r in rows if r[1] and r[2] != "plan" and "memory" in r[3]]
    want = sorted((x[0], y[0]) for x, y in combinations(kept, 2) if x[1] == y[1] and x[3] != y[3])
    for run in (1000, 7):
        assert sorted((r["a"], r["b"]) for r in L.same_project(atoms, run).collect()) == want
    got = {r["project"]: (r["members"], r["files"], r["links"]) for r in L.project_classes(atoms).collect()}
    project = {r[0]: r[1] for r in kept}
    assert got == {p: (sum(r[1] == p for r in kept), len({r[3] for r in kept if r[1] == p}), sum(project[a] == p for a, _ in want)) for p in set(project.values())}
    assert L.project_classes(atoms.where("false")).count() == 0


def held(rows, least=9):
    """(a, b) by trying every title in every body."""
    return sorted((a, b) for a, t, _ in rows for b, _, x in rows if a < b and t is not None and x is not None and len(t) >= least and t.lower() in x.lower())


def test_titles_of_any_characters_are_found(spark):
    titles = ["----------", "abc ------- de", "a b c d e f", "ab cdefgh", "Über die Brücke", "x" * 9, "x" * 16, " " * 12, "under_score-mark", "日本語のタイトルです", "Alpha notes", "I am in it", None, "short", "tab\tand more", "ends here."]
    bodies = [f"{'' if k % 3 else 'zz'}{t}{'' if k % 2 else 'zz'}" for k, t in enumerate(titles)] + ["see ---------- here", "zzabc ------- dezz", "ÜBER DIE BRÜCKE!", None, "", "x" * 40, "alpha  notes", "malpha notes", "I am in it."]
    rows = [(k, t, None) for k, t in enumerate(titles)] + [(100 + k, "ten letters", x) for k, x in enumerate(bodies)] + [(50, "x" * 9, "ten letters and alpha notes")]
    df = spark.createDataFrame(rows, "seq long, title string, body string").withColumn("b", F.lit("clash"))
    assert sorted(map(tuple, L.title_mentions(df, df).collect())) == held(rows)
    assert sorted(map(tuple, L.title_mentions(df, df, 3).collect())) == held(rows, 3)
    assert L.title_mentions(df.limit(0), df).count() == 0 and L.title_mentions(df, df.limit(0)).count() == 0


def test_titles_at_random_against_contains(spark):
    rng = random.Random(3)
    text = lambda n: "".join(rng.choice("ab -A") for _ in range(n))
    rows = [(i, text(rng.randrange(7, 22)), text(400)) for i in range(150)]
    # titles that stand in some body for sure
    rows += [(1000 + i, rows[i][2][i : i + 9 + i % 12], None) for i in range(100)] + [(2000 + i, "", rows[i][2]) for i in range(100)]
    df = spark.createDataFrame(rows, "seq long, title string, body string")
    want = held(rows)
    assert len(want) > 50 and sorted(map(tuple, L.title_mentions(df, df).collect())) == want


@given(st.text("abc ", min_size=16, max_size=60), st.text("abc ", max_size=40), st.text("abc ", max_size=40))
def test_what_holds_a_text_has_its_anchors(t, before, after):
    mine, its = L.anchors(t, 9, 8), L.anchors(before + t + after, 9, 8)
    assert len(mine) and np.isin(mine, its).all()


def test_links_by_change_are_those_of_all(spark):
    rng = random.Random(5)

    def atom(i, v):
        r = random.Random(i * 1000 + v)
        tags = [f"t{r.randrange(6)}" for _ in range(r.randrange(5))] or None
        return (f"id{i}", f"title number {i % 9}" if r.random() < 0.7 else None, " ".join(f"title number {r.randrange(12)}" for _ in range(r.randrange(3))), tags, r.choice(["p", "q", None]), r.choice(["memory", "plan"]), f"memory/{i // 2}.md")

    schema = "id string, title string, body string, tags array<string>, project string, atom_type string, source_path string, ingest_seq long"
    frame = lambda state: spark.createDataFrame([(*atom(i, v), n) for n, (i, v) in enumerate(sorted(state.items()))], schema)
    rows = lambda df: sorted((r["source_id"], r["target_id"], r["link_type"], round(r["confidence"], 9)) for r in df.collect())
    state = {i: 0 for i in range(40)}
    old = frame(state)
    pairs = spark.createDataFrame(L.infer_pairs(old).collect(), "source_id string, target_id string, link_type string, confidence double")
    for step in (1, 2):
        for i in rng.sample(range(50), 9):
            if i in state and rng.random() < 0.4:
                del state[i]
            else:
                state[i] = step
        new = frame(state)
        pairs = spark.createDataFrame(L.infer_changed(pairs, new, L.unlike(old, new)).collect(), pairs.schema)
        assert rows(pairs) == rows(L.infer_pairs(new))
        old = new
    assert rows(L.infer_changed(pairs, old, L.unlike(old, old))) == rows(pairs)


def shuffled_rows(spark):
    gateway = spark.sparkContext._gateway
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def linked(rows):
    """Links of (seq, title, body, tags, project) by trying all pairs; files hold two atoms."""
    out = []
    for x, y in combinations(rows, 2):
        if x[0] // 2 == y[0] // 2:
            continue
        shared = len(set(x[3]) & set(y[3]))
        if shared >= 2:
            out.append((f"i{x[0]}", f"i{y[0]}", "related", round(min(0.9, 0.3 + 0.15 * shared), 6)))
        elif len(x[1]) >= 9 and x[1] in y[2]:
            out.append((f"i{y[0]}", f"i{x[0]}", "references", 0.6))
        elif x[4] and x[4] == y[4]:
            out.append((f"i{x[0]}", f"i{y[0]}", "related", 0.3))
    return sorted(out)


def test_pairs_of_hot_keys_are_not_shuffled(spark):
    n = 400
    rows = [(i, "one hot title" if i % 3 else f"title {i} here", f"this has one hot title{i}" if i % 5 else "none", ["t", "u"] if i % 4 == 0 else [f"v{i % 3}"], "p" if i % 7 else None) for i in range(n)]
    atoms = spark.createDataFrame([(s, f"i{s}", t, b, g, p, "note", f"memory/{s // 2}.md") for s, t, b, g, p in rows], "ingest_seq long, id string, title string, body string, tags array<string>, project string, atom_type string, source_path string")
    want = linked(rows)
    got = lambda df: sorted((r["source_id"], r["target_id"], r["link_type"], round(r["confidence"], 6)) for r in df.collect())
    for run in (1000, 70):
        before = shuffled_rows(spark)
        assert got(L.infer_pairs(atoms, run)) == want
        assert shuffled_rows(spark) - before < len(want) / 4
    tags = spark.createDataFrame([(s, t) for s, _, _, g, _ in rows for t in g], "seq long, tag string")
    before = shuffled_rows(spark)
    assert L.tag_overlap(tags).count() == 100 * 99 // 2 and shuffled_rows(spark) - before < 2000
    texts = atoms.select(F.col("ingest_seq").alias("seq"), "title", "body")
    assert sorted(map(tuple, L.title_mentions(texts, texts, run=50).collect())) == sorted((x[0], y[0]) for x, y in combinations(rows, 2) if x[1] in y[2])
    # a change of some, in short runs
    later = [(s, t if s % 11 else "one hot title", b, g if s % 13 else ["t", "u"], p if s % 17 else "p") for s, t, b, g, p in rows if s % 19]
    new = spark.createDataFrame([(s, f"i{s}", t, b, g, p, "note", f"memory/{s // 2}.md") for s, t, b, g, p in later], atoms.schema)
    assert got(L.infer_changed(L.infer_pairs(atoms, 70), new, L.unlike(atoms, new), 70)) == linked(later)


def test_project_pairs_are_small_in_files(spark, tmp_path):
    n = 3000
    atoms = spark.range(n).selectExpr("id * 7 as ingest_seq", "'p' as project", "'note' as atom_type", "concat('memory/', id) as source_path")
    L.same_project(atoms, 1000).write.parquet(f"{tmp_path}/pairs")
    got = spark.read.parquet(f"{tmp_path}/pairs")
    assert got.count() == got.distinct().count() == n * (n - 1) // 2 and got.where("a >= b").count() == 0
    # a stretch of the same others for one atom after another
    assert sum(p.stat().st_size for p in tmp_path.glob("pairs/*.parquet")) < 0.4 * n * n / 2


def test_runs_of_a_key_follow_each_other(spark):
    rows = spark.range(1000).selectExpr("id as seq", "case when id % 3 = 0 then null when id % 7 = 0 then 'b' else 'hot' end as k", "id * 2 as more")
    runs = L._runs(rows, "k", 50).orderBy("key", "run").collect()
    for k, want in (("hot", [i for i in range(1000) if i % 3 and i % 7]), ("b", [i for i in range(1000) if i % 3 and i % 7 == 0])):
        mine = [r for r in runs if r["key"] == k]
        assert [x["seq"] for r in mine for x in r["rows"]] == want and all(r["n"] == len(r["rows"]) <= 50 for r in mine)
    assert {r["key"] for r in runs} == {"hot", "b"}


def test_titles_of_common_words_meet_few_bodies(spark, monkeypatch):
    rng = random.Random(7)
    words = [f"{x}{y}ing the" for x in ("mend", "read", "hold", "walk", "call", "talk") for y in ("", "er", "ish")]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    titles = [text(6)[: rng.randrange(37, 48)] for _ in range(200)]
    rows = [(i, t, text(60) + (f" {titles[i - 1]}" if i % 10 == 1 else "")) for i, t in enumerate(titles)]
    df = spark.createDataFrame(rows, "seq long, title string, body string")
    tried, write = [], L.cut
    monkeypatch.setattr(L, "cut", lambda df, name: (lambda out: (name == "title_candidates" and tried.append(out.count())) or out)(write(df, name)))
    want = held(rows)
    assert sorted(map(tuple, L.title_mentions(df, df).collect())) == want and len(want) >= 20
    # bodies do not try titles of which they only hold a stretch that many have
    assert len(tried) == 1 and tried[0] <= 20 * len(want)


def test_titles_of_every_length_are_found(spark):
    rng = random.Random(11)
    text = lambda n: "".join(rng.choice("ab cé日") for _ in range(n))
    bodies = [text(150) for _ in range(60)]
    rows = [(n, bodies[n % 60][n : n + n], None) for n in range(1, 60)] + [(100 + i, "", x) for i, x in enumerate(bodies)]
    df = spark.createDataFrame(rows, "seq long, title string, body string")
    for least in (1, 4, 9, 12):
        want = held(rows, least)
        assert len(want) >= 45 and sorted(map(tuple, L.title_mentions(df, df, least).collect())) == want


def test_links_of_a_state_brought_up_to_date(spark):
    rng = random.Random(13)
    atom = lambda i, v: (i, f"i{i}", f"the title of {rng.randrange(9)}", " ".join(f"the title of {rng.randrange(12)}" for _ in range(2)), [f"t{rng.randrange(5)}" for _ in range(3)], rng.choice(["p", "q", None]), "note", f"memory/{i // 2}.md")
    was = {i: atom(i, 0) for i in range(80) if i % 7}
    now = {i: was[i] if i in was and i % 5 else atom(i, 1) for i in range(80) if i % 11}
    old, new = (spark.createDataFrame(list(x.values()), "ingest_seq long, id string, title string, body string, tags array<string>, project string, atom_type string, source_path string") for x in (was, now))
    got = lambda df: sorted((r["source_id"], r["target_id"], r["link_type"], r["confidence"]) for r in df.collect())
    want = linked([(r[0], *r[2:6]) for r in now.values()])
    assert got(L.infer_update(old, new, 9)) == want


def test_links_are_small_in_files(spark, tmp_path):
    n = 2500
    atoms = spark.range(n).selectExpr("id * 3 as ingest_seq", "left(sha2(string(id), 256), 16) as id", "'none' as title", "'x' as body", "array('t', concat('u', id % 2)) as tags", "if(id % 2 = 0, 'p', 'q') as project", "'note' as atom_type", "concat('memory/', id) as source_path")
    L.infer_pairs(atoms.where("id is not null")).write.parquet(f"{tmp_path}/links")
    got = spark.read.parquet(f"{tmp_path}/links")
    assert got.count() == 2 * (n // 2) * (n // 2 - 1) // 2 and got.select("link_type", "confidence").distinct().collect() == [("related", 0.6)]
    assert sum(p.stat().st_size for p in tmp_path.glob("links/*.parquet")) < 0.6 * got.count()
