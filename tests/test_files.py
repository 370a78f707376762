"""Markdown folders, sections, titles, links, transcripts and messages on fixtures."""

import hashlib
import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loremill.functions import text as X
from loremill.operators import links as L
from loremill.operators import sessions as SS
from loremill.sources.files import Roots, notes, parse_notes, split_sections, transcript_lines


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    r = tmp_path_factory.mktemp("tree")
    files = {
        "agents/helper.md": "---\nname: Helper\ntags: [One, two]\n---\n# H\n## Use\ntext\n",
        "skills/cut/SKILL.md": "no front\n## Part\nbody",
        "plans/next.md": "---\ntitle: Next\n---\nplan\n## Step\nx",
        "projects/p1/memory/MEMORY.md": "plain memory",
        "projects/p1/memory/feedback_style.md": "---\ntype: architecture\nkeywords: [K]\n---\nintro\n## First\none\n## Empty\n\n## Third\nthree [a](other.md) [b](http://x)\n",
        "projects/p1/memory/start.md": "## A\none\n## B\ntwo\n```\n## C\nthree\n```",
        "projects/p1/memory/crlf.md": "## A\r\none\r\n## B\r\ntwo\r\n",
        "projects/p1/memory/bad.md": "---\na: [1\nb: }\n---\nx",
    }
    for name, body in files.items():
        p = r / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(body.encode())
    return r


def test_parse(spark, tree):
    atoms, diags = parse_notes(notes(spark, Roots(str(tree))))
    got = {(r["source_path"].removeprefix(str(tree) + "/"), r["section_index"]): r for r in atoms.collect()}
    assert got["agents/helper.md", 0]["title"] == "Helper"
    assert got["agents/helper.md", 0]["tags"] == ["one", "two", "use"]
    assert got["agents/helper.md", 0]["atom_type"] == "agent" and got["agents/helper.md", 0]["scope"] == "global"
    assert got["skills/cut/SKILL.md", 0]["title"] == "SKILL"
    assert got["plans/next.md", 0]["title"] == "Next"
    fb = [got["projects/p1/memory/feedback_style.md", i] for i in range(3)]
    assert [f["title"] for f in fb][1:] == ["feedback_style: First", "feedback_style: Third"]
    assert fb[0]["atom_type"] == "feedback" and fb[0]["scope"] == "global" and fb[0]["tags"] == ["k"]
    assert fb[1]["content_hash"] == hashlib.sha256(fb[1]["body"].encode()).hexdigest()[:16]
    raw = (tree / "projects/p1/memory/feedback_style.md").read_bytes()
    assert fb[0]["content_hash"] == hashlib.sha256(raw).hexdigest()[:16]
    path = str(tree / "projects/p1/memory/feedback_style.md")
    assert fb[1]["id"] == hashlib.sha256(f"{path}:1".encode()).hexdigest()[:16]
    assert fb[1]["project"] == "p1"
    start = [got["projects/p1/memory/start.md", i]["title"] for i in range(3)]
    assert start == ["A", "start: B", "start: C"]
    assert ("projects/p1/memory/crlf.md", 1) not in got
    assert ("projects/p1/memory/bad.md", 0) not in got
    kinds = {(r["type"], r["source_path"].rpartition("/")[2]) for r in diags.collect()}
    assert kinds == {("stale", "bad.md"), ("missing_frontmatter", "start.md"), ("missing_frontmatter", "crlf.md")}


@settings(max_examples=15, deadline=None)
@given(parts=st.lists(st.tuples(st.text("abc", min_size=1, max_size=5), st.text("xyz ", min_size=1, max_size=6).filter(str.strip)), min_size=1, max_size=4))
def test_sections_round_trip(spark, parts):
    body = "\n".join(f"## {h}\n{b}" for h, b in parts)
    got = split_sections(spark.createDataFrame([("p", body)], "path string, body string")).orderBy("section_index").collect()
    assert [(r["heading"], r["body"]) for r in got] == [(h, b.strip()) for h, b in parts]


def test_titles(spark):
    cases = {
        "": "Untitled session", "hi there. more": "There", "please fix this": "Fix this", "x" * 70: "X" + "x" * 59 + "...", "word " * 20: "Word" + " word" * 11 + "...",
        "a" * 25 + " " + "b" * 60: "A" + "a" * 24 + "...", ".start": ".start", "Help me  now!": "Now", "hello": "Hello", "one\ntwo": "One", "a" * 81 + ". x": "A" + "a" * 59 + "...", "hey please do": "Please do",
    }
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, c string")
    got = [r["t"] for r in df.select("i", X.generate_title(F.col("c")).alias("t")).orderBy("i").collect()]
    assert got == list(cases.values())


def test_links_and_tags(spark):
    body = "[a](x.md) ![i](p.png) [h](http://a) [s](#a) [m](mailto:a@b) [t](d.md#s) [q](c.md \"T\") [p](a(b.md)\n## " + "h" * 40 + "\n### " + "k" * 41 + "\n#### no\n"
    r = spark.createDataFrame([(body,)], "b string").select(X.link_targets(F.col("b")).alias("l"), X.header_tags(F.col("b")).alias("t")).first()
    assert r["l"] == ["x.md", "p.png", "d.md#s", 'c.md "T"', "a(b.md"]
    assert r["t"] == ["h" * 40]


def test_inferred_links(spark):
    rows = [
        (1, "a", "Alpha title", "x", ["t1", "t2", "t3", "t4", "t5"], "p", "m/memory/1.md", "memory"),
        (2, "b", "B", "x", ["t1", "t2", "t3", "t4", "t5"], None, "m/2.md", "memory"),
        (3, "c", "C", "holds alpha TITLE here", ["t1"], None, "m/3.md", "memory"),
        (4, "d", "D", "alpha title", [], None, "m/4.md", "plan"),
        (5, "e", "E", "y", [], "p", "m/memory/5.md", "memory"),
        (6, "f", "F", "y", [], None, "m/7.md", "memory"),
        (7, "g", "G", "y", ["t1", "t2"], None, "m/7.md", "memory"),
    ]
    atoms = spark.createDataFrame(rows, "ingest_seq long, id string, title string, body string, tags array<string>, project string, source_path string, atom_type string")
    got = {(r["source_id"], r["target_id"]): (r["link_type"], round(r["confidence"], 2)) for r in L.infer(atoms).collect()}
    assert got == {("a", "b"): ("related", 0.9), ("c", "a"): ("references", 0.6), ("a", "e"): ("related", 0.3), ("f", "g"): ("extends", 0.95), ("a", "g"): ("related", 0.6), ("b", "g"): ("related", 0.6)}


def lines(spark, *raws, path="t"):
    return spark.createDataFrame([(path, i, r if isinstance(r, str) else json.dumps(r)) for i, r in enumerate(raws)], "path string, line_no int, raw string")


def test_head(spark, tmp_path):
    (tmp_path / "projects/p").mkdir(parents=True)
    rows = [{"type": "user", "message": {"content": [{"type": "image"}, {"type": "text", "text": "u" * 201}]}, "timestamp": "t1"}, "bad", "", {"sessionId": "s", "gitBranch": "g", "type": "user", "message": {"content": "second"}}]
    (tmp_path / "projects/p/x.jsonl").write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows) + "\n")
    r = SS.head(transcript_lines(spark, f"{tmp_path}/projects/*/*.jsonl")).first()
    assert (r["session_id"], r["git_branch"], r["started_at"], r["message_count"], r["last_active"]) == ("s", "g", "t1", 3, None)
    assert r["summary"] == "u" * 200


NOW = "2024-01-01 12:00:00+00:00"


@pytest.mark.parametrize(
    "raws, want",
    [
        ([{"type": "assistant", "timestamp": "2023-12-29T12:00:00Z", "message": {"content": [{"type": "tool_use"}]}}], ("processing", None)),
        ([{"type": "assistant", "timestamp": "2024-01-01T11:55:01Z", "message": {"content": "x"}}], ("waiting_input", None)),
        ([{"type": "assistant", "timestamp": "2024-01-01T11:55:00Z"}], ("idle", None)),
        ([{"type": "user", "timestamp": "2024-01-01T11:59:00Z"}], ("active", None)),
        ([{"type": "queue-operation", "operation": "enqueue", "content": "old"}, {"type": "queue-operation", "operation": "enqueue", "content": "new"}, {"type": "user", "timestamp": "2024-01-01T11:59:00Z"}], ("waiting_input", "old")),
        ([{"type": "user", "timestamp": "2024-01-01T11:01:00Z"}], ("idle", None)),
        ([{"type": "user", "timestamp": "2024-01-01T11:00:00Z"}], ("dead", None)),
        ([{"type": "user", "timestamp": "soon"}], ("dead", None)),
        ([{"type": "user"}], ("dead", None)),
        ([{"type": "assistant", "timestamp": "2024-01-01T11:59:00Z"}, "{no"], ("active", None)),
    ],
)
def test_status(spark, raws, want):
    r = SS.status(lines(spark, *raws), NOW).first()
    assert (r["status"], r["pending_prompt"]) == want


def test_messages(spark):
    content = [
        {"type": "text", "text": " "}, {"type": "text", "text": "hi"}, {"type": "thinking", "thinking": "hm"}, {"type": "image", "source": {"type": "base64", "data": "x"}}, {"type": "image", "source": {"type": "url"}},
        {"type": "tool_use", "input": {"a": 1}}, {"type": "tool_result", "tool_use_id": "t", "content": [{"type": "text", "text": "one"}, {"type": "text", "text": "two"}], "is_error": True}, {"type": "odd"},
    ]
    rows = SS.messages(lines(spark, {"type": "assistant", "message": {"content": content}}, {"type": "user", "message": {"content": " "}}, {"type": "user", "message": {"content": "plain"}}, {"type": "system", "message": {"content": "no"}})).orderBy("line_no").collect()
    got = [(b["type"], b["text"]) for b in rows[0]["blocks"]]
    assert got == [("text", "hi"), ("thinking", "hm"), ("image", "image/png"), ("tool_use", '{"a":1}'), ("tool_result", "one\ntwo")]
    assert rows[0]["blocks"][4]["is_error"] and rows[0]["blocks"][3]["id"] == ""
    assert [r["line_no"] for r in rows] == [0, 2]
