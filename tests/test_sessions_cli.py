"""Session tables, live refresh, the byte limit of tails, and the command line."""

import json

import pytest
from pyspark.sql import functions as F

from loremill import cli
from loremill.operators import sessions as SS
from loremill.sources.files import Roots
from loremill.sources.transcripts import desktop_sessions, project_sessions


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    r = tmp_path_factory.mktemp("root")
    d = r / "projects/p"
    (d / "subagents").mkdir(parents=True)
    (d / "memory").mkdir()
    (d / "memory/n.md").write_text("---\nname: Note one\n---\nfoxes everywhere")
    (d / "subagents/a.meta.json").write_text("{}")
    (d / "s1.jsonl").write_text(json.dumps({"type": "user", "sessionId": "s1", "timestamp": "2024-01-01T00:00:00Z", "gitBranch": "main", "message": {"content": "please fix the build. Then more"}}))
    (d / "x.jsonl").write_text(json.dumps({"type": "user", "message": {"content": "no id"}}))
    (d / "y.jsonl").write_text(json.dumps({"type": "user", "message": {"content": "no id again"}}) + "\n\n{}\n")
    return r


def test_project_sessions(spark, root):
    got = {r["session_id"]: r for r in project_sessions(spark, Roots(str(root))).collect()}
    assert set(got) == {"s1", "p"}
    assert (got["s1"]["title"], got["s1"]["git_branch"], got["s1"]["subagent_count"], got["s1"]["status"]) == ("Fix the build", "main", 1, "dead")
    assert got["p"]["message_count"] == 2
    assert project_sessions(spark, Roots(str(root / "none"))).count() == 0


def test_desktop_sessions(spark, tmp_path):
    for name, lines in {"w/u/s1": [{"session_id": "id1", "_audit_timestamp": "t0", "type": "user", "message": {"content": "hi there"}}, {"_audit_timestamp": "t9"}], "w/u/s2": [{"type": "user", "message": {"content": "second one"}}]}.items():
        (tmp_path / name).mkdir(parents=True)
        (tmp_path / name / "audit.jsonl").write_text("\n".join(map(json.dumps, lines)))
    (tmp_path / "w/u/s2.json").write_text(json.dumps({"title": "Own", "userSelectedFolders": ["C:\\work\\x"], "createdAt": 0, "lastActivityAt": 1500}))
    got = {r["session_id"]: r for r in desktop_sessions(spark, str(tmp_path)).collect()}
    assert (got["id1"]["project"], got["id1"]["title"], got["id1"]["last_active"], got["id1"]["is_cowork"]) == ("w", "There", "t9", True)
    assert (got["s2"]["project"], got["s2"]["title"], got["s2"]["started_at"], got["s2"]["last_active"]) == ("C--work-x", "Own", "1970-01-01T00:00:00.000Z", "1970-01-01T00:00:01.500Z")


def test_tail_bytes(spark):
    rows = [("t", 0, "a" * 5000), ("t", 1, "b" * 5000), ("t", 2, ""), ("t", 3, "c" * 100)]
    df = spark.createDataFrame(rows, "path string, line_no int, raw string")
    got = {r["line_no"]: len(r["raw"]) for r in SS.tail(df).collect()}
    # 100 bytes, the blank line's feed, 5000 and two feeds leave 3089 of the oldest line
    assert got == {3: 100, 1: 5000, 0: 8192 - 100 - 1 - 1 - 5000 - 1}
    assert SS.tail(df, most_bytes=50).first()["raw"] == "c" * 50


def test_refresh_and_titles(spark):
    s = spark.createDataFrame([("1", "a.jsonl", "idle", "old", "t", None), ("2", "gone.jsonl", "active", "keep", "u", "")], "session_id string, jsonl_path string, status string, summary string, last_active string, title string")
    st = spark.createDataFrame([("a.jsonl", "waiting_input", "asked", None)], "jsonl_path string, status string, pending_prompt string, last_timestamp string")
    got = {r["session_id"]: (r["status"], r["summary"], r["last_active"]) for r in SS.refresh(s, st).collect()}
    assert got == {"1": ("waiting_input", "asked", "t"), "2": ("dead", "keep", "u")}
    assert {r["title"] for r in SS.backfill_titles(s).collect()} == {"Old", "Keep"}
    call = spark.createDataFrame([('{"cmd": "' + "x" * 70 + '", "b": 1}',)], "i string").select(SS.tool_summary(F.col("i")).alias("t")).first()["t"]
    assert call == 'cmd="' + "x" * 60 + '..."'


def test_cli(spark, root):
    run = lambda *a: cli.main(["--root", str(root), *a], spark)
    assert run("index")[:3] == ["atoms 1", "links 0", "sessions 2"]
    assert run("search", "fox") == ["Note one [memory] p\n  *foxes* everywhere"]
    assert run("search", "zebra") == ["No results found."]
    assert run("list", "--project", "p") == ["p memory Note one"]
    assert run("health") == ["[orphan] No links: Note one"]
    assert run("sessions", "--status", "dead", "--limit", "1")[0] == "2 sessions"
    assert "by_type: memory 1" in run("stats")
    assert run("context", "fox")[0].startswith("## Note one")


def test_session_tail_keeps_long_lines_like_its_sql(spark, tmp_path):
    import duckdb

    from loremill import catalog

    rows = [(1, t, "user", "x" * 900) for t in range(20)] + [(2, t, "assistant", "é" * (9000 if t == 3 else 1)) for t in range(5)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.sql(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    want = sorted(con.sql(catalog.ORACLES["session_tail"]).fetchall())
    assert len(want) == 20 and sorted(map(tuple, catalog.QUERIES["session_tail"](spark, str(tmp_path)).collect())) == want
