"""The interface over a small folder, and stream against batch."""

import pytest
from pyspark.sql import functions as F

from loremill.api import BadRequest, Knowledge, NotFound, reindex
from loremill.operators import reindex as R
from loremill.sources.files import Roots
from loremill.streaming import jobs as J


@pytest.fixture(scope="module")
def hub(spark, tmp_path_factory):
    r = tmp_path_factory.mktemp("hub")
    for name, body in {"projects/p/memory/a.md": "---\nname: Alpha notes\n---\nfoxes run [b](b.md) [gone](no.md)", "projects/p/memory/b.md": "---\nname: B\n---\nsee alpha notes here", "projects/q/memory/c.md": "---\nname: C\n---\nalone", "plans/t.md": "---\ntype: task\nstatus: ready\npriority: 1\n---\ndo"}.items():
        (r / name).parent.mkdir(parents=True, exist_ok=True)
        (r / name).write_text(body)
    k = reindex(spark, Roots(str(r)))
    return Knowledge(k.atoms.cache(), k.links.cache(), diagnostics=k.diagnostics.cache())


def test_search_and_lists(hub):
    hits = hub.search("fox").collect()
    assert [h["title"] for h in hits] == ["Alpha notes"] and "<mark>foxes</mark>" in hits[0]["snippet"]
    with pytest.raises(BadRequest):
        hub.search(" ")
    assert hub.list_atoms(project="q").count() == 1
    assert Knowledge.merged(hub.project_context("q")).startswith("## C\n_Type: memory | Scope: project_")
    assert Knowledge.merged(hub.project_context("none")) is None
    with pytest.raises(NotFound):
        hub.atom("nope")


def test_links_and_diagnostics(hub):
    title = {r["id"]: r["title"] for r in hub.atoms.collect()}
    got = {(title[r["source_id"]], title[r["target_id"]], r["link_type"]) for r in hub.links.collect()}
    assert ("Alpha notes", "B", "references") in got and ("B", "Alpha notes", "references") in got
    kinds = {r["type"]: r["n"] for r in hub.stats()["diagnostics"].collect()}
    assert kinds == {"broken_reference": 1, "orphan": 2}
    a = next(i for i, t in title.items() if t == "B")
    assert hub.atom_links(a).count() == 2
    assert hub.without_atom(a).links.count() == 0


def test_tasks(hub, spark):
    t = hub.tasks().collect()
    assert len(t) == 1 and t[0]["effective_status"] == "ready" and t[0]["priority"] == 1
    assert {r["status"] for r in hub.update_task(t[0]["id"], "done", {"title": "Next one"}).collect()} == {"done", "ready"}
    with pytest.raises(BadRequest):
        hub.tasks(status="odd")
    with pytest.raises(BadRequest):
        hub.create_tasks(spark.createDataFrame([("x", "y", 5)], "title string, body string, priority int"))
    made = hub.remember(spark.createDataFrame([("Same", "1"), ("same!", "2")], "title string, body string"))
    assert {r["source_path"] for r in made.collect()} == {"memory/same.md", "memory/same_2.md"}


def test_upsert_keeps_and_drops(spark):
    s = "id string, title string, project string, source_path string, source_type string, content_hash string, created_at string"
    old = spark.createDataFrame([("1", "a", "p", "f", "t", "h", "c"), ("2", "b", "p", "f", "t", "h", "c")], s)
    new = spark.createDataFrame([("1", "A", "q", "g", "u", "i", "d"), ("3", "n", "q", "g", "u", "i", "d")], s)
    got = {r["id"]: (r["title"], r["project"], r["created_at"]) for r in R.reindex(old, new).collect()}
    assert got == {"1": ("A", "p", "c"), "3": ("n", "q", "d")}


def test_streams_equal_batches(spark, sf):
    batch = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    for shape in (J.tumbling, J.sliding, J.session_gaps):
        rows = lambda df: sorted(map(str, df.collect()))
        assert rows(J.stream_query(spark, sf, shape)) == rows(shape(batch))


def test_reindex_tells_edits_and_deletions(spark, tmp_path):
    folder = tmp_path / "projects/p/memory"
    folder.mkdir(parents=True)
    for name, body in {"a": "apple", "b": "pear", "c": "apple"}.items():
        (folder / f"{name}.md").write_text(f"---\nname: {name}\n---\n{body}")
    roots, numbers = Roots(str(tmp_path)), lambda k: {r["change"]: r["n"] for r in k.run.collect()}
    first = reindex(spark, roots, now="2024-01-01 00:00:00").indexed()
    assert numbers(first) == {"created": 3}
    assert {r["name"]: r["n"] for r in first.stats()["totals"].collect()}["atoms"] == 3
    a = first.atoms.where("title = 'a'").first()["id"]
    assert first.atom_raw(a).first()["raw"].endswith("apple")
    (folder / "a.md").write_text("---\nname: a\n---\nplum")
    (folder / "b.md").unlink()
    (folder / "d.md").write_text("---\nname: d\n---\ncherry pear")
    ticks = []
    from loremill.streaming.jobs import watch

    q = watch(spark, ticks.append, "0 seconds", str(tmp_path / "checkpoint"))
    while not ticks and q.isActive:
        pass
    q.stop()
    assert ticks
    second = reindex(spark, roots, first, now="2024-02-02 00:00:00")
    assert numbers(second) == {"created": 1, "updated": 1, "unchanged": 1, "removed": 1}
    assert {r["title"]: r["updated_at"][:7] for r in second.atoms.collect()} == {"a": "2024-02", "c": "2024-01", "d": "2024-02"}
    found = lambda q: sorted(r["title"] for r in second.search(q).collect())
    assert (found("apple"), found("pear"), found("plum")) == (["c"], ["d"], ["a"])
    plain = Knowledge(second.atoms, second.links)
    assert [round(r["score"], 9) for r in plain.search("pear").collect()] == [round(r["score"], 9) for r in second.search("pear").collect()]


def test_reindex_tells_exact_copies(spark, tmp_path):
    folder = tmp_path / "projects/p/memory"
    folder.mkdir(parents=True)
    for name in "xy":
        (folder / f"{name}.md").write_text("---\nname: same\n---\nthe same text")
    k = reindex(spark, Roots(str(tmp_path)))
    assert [r["source_path"][-4:] for r in k.diagnose("duplicate").collect()] == ["y.md"]


def test_sessions_outlive_three_readings(spark, tmp_path):
    import json

    folder, desk = tmp_path / "r/projects/p", tmp_path / "d/w/u/s9"
    folder.mkdir(parents=True)
    desk.mkdir(parents=True)
    line = lambda i, text: json.dumps({"type": "user", "sessionId": i, "timestamp": f"2024-01-01T00:00:0{len(text) % 9}Z", "gitBranch": "main", "slug": "sl", "message": {"content": text}})
    for i in ("s1", "s2"):
        (folder / f"{i}.jsonl").write_text(line(i, "please fix it"))
    # one session is known to the desktop app as well
    (desk / "audit.jsonl").write_text(json.dumps({"session_id": "s2", "_audit_timestamp": "t5", "type": "user", "message": {"content": "from the desk"}}))
    k = reindex(spark, Roots(str(tmp_path / "r")), desktop_root=str(tmp_path / "d"))
    first = {r["session_id"]: r for r in k.sessions.collect()}
    assert (first["s2"]["project"], first["s2"]["is_cowork"], first["s2"]["last_active"], first["s2"]["git_branch"]) == ("w", True, "t5", "main")
    k = Knowledge(k.atoms, k.links, k.renamed("s1", "My own name"))
    (folder / "s2.jsonl").unlink()
    (desk / "audit.jsonl").unlink()
    (folder / "s1.jsonl").write_text(line("s1", "please fix it") + "\n" + json.dumps({"type": "assistant", "timestamp": "2024-02-02T00:00:00Z"}))
    for _ in range(3):
        k = reindex(spark, Roots(str(tmp_path / "r")), k, desktop_root=str(tmp_path / "d"))
    last = {r["session_id"]: r for r in k.sessions.collect()}
    assert last["s2"] == first["s2"]
    was = first["s1"].asDict() | {"custom_title": "My own name", "title": "My own name", "message_count": 2, "last_active": "2024-02-02T00:00:00Z"}
    assert last["s1"].asDict() == was


def test_creation_sees_what_exists(hub, spark):
    new = lambda *ts: spark.createDataFrame([(t, "x") for t in ts], "title string, body string")
    k = hub
    names = []
    for titles in (("Same", "same!"), ("Same",), ("SAME", "other", "same")):
        made = k.remember(new(*titles)).cache()
        names.append(sorted(r["source_path"] for r in made.collect()))
        k = Knowledge(k.atoms.unionByName(made, allowMissingColumns=True), k.links)
    assert names == [["memory/same.md", "memory/same_2.md"], ["memory/same_3.md"], ["memory/other.md", "memory/same_4.md", "memory/same_5.md"]]
    assert k.atoms.where("source_path like 'memory/same%'").select("id").distinct().count() == 5
    # gaps are filled first
    taken = spark.createDataFrame([("a",), ("a_3",), ("a_4",), ("a_1",), ("a_x",), ("b_2",), (None,)], "file string")
    from loremill.operators import atoms as A

    rows = spark.createDataFrame([(i, t) for i, t in enumerate(["a", "a", "a", "b", "b", "c"])], "ingest_seq long, title string")
    got = [r["file"] for r in A.slug_collisions(rows, taken=taken).orderBy("ingest_seq").collect()]
    assert got == ["a_2", "a_5", "a_6", "b", "b_3", "c"]
