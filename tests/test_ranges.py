"""Byte ranges, tails, listings and what a re-index opens."""

import json
import os
import random
import sqlite3
import time

import pytest
from pyspark.sql import functions as F

from loremill.api import Knowledge, reindex
from loremill.operators import sessions as SS
from loremill.sources import ranges as R
from loremill.sources.files import Roots, file_changes, transcript_lines, transcript_tails
from loremill.sources.transcripts import session_metadata
from loremill.streaming import jobs as J


def test_each_line_is_in_one_range(spark, tmp_path):
    rnd = random.Random(3)
    texts = {"end": "a\n", "none": "abc", "blank": "\n\n\n", "accents é x": "é\nöö\n" * 9} | {f"r{i}": "".join(rnd.choice("ab\né") for _ in range(rnd.randrange(1, 200))) for i in range(12)}
    (tmp_path / "empty.jsonl").write_text("")
    for name, text in texts.items():
        (tmp_path / f"{name}.jsonl").write_bytes(text.encode())
    want = set()
    for name, text in texts.items():
        at = 0
        for line in text.encode().split(b"\n"):
            want.add((f"{tmp_path}/{name}.jsonl", at, line.decode()))
            at += len(line) + 1
    files = R.listing(spark, f"{tmp_path}/*.jsonl")
    for size in (1, 7, 1 << 20):
        got = [tuple(r) for r in R.lines(files, size).collect()]
        assert len(got) == len(want) and set(got) == want
    assert {(r["path"], r["raw"]) for r in R.whole(files).collect()} == {(f"{tmp_path}/{n}.jsonl", t) for n, t in texts.items()}
    assert R.lines(R.listing(spark, f"{tmp_path}/*.none")).count() == 0
    assert R.whole(spark.createDataFrame([(f"{tmp_path}/gone",), (None,)], "path string")).count() == 0


def test_tail_of_a_long_transcript_is_read_alone(spark, tmp_path):
    now = "2024-01-01 12:00:00+00:00"
    folder = tmp_path / "projects/p"
    folder.mkdir(parents=True)
    for n in (0, 1, 40, 900):
        rows = [json.dumps({"type": "user", "n": i, "pad": "y" * (i % 50), "message": {"content": "x"}}) for i in range(n)] + [json.dumps({"type": "assistant", "timestamp": "2024-01-01T11:59:00Z"})]
        (folder / f"{n}.jsonl").write_text("\n".join(rows) + "\n")
    # a gigabyte that takes no room on the disk, and one line after it
    with open(folder / "long.jsonl", "wb") as f:
        f.seek(1 << 30)
        f.write(b"\n" + json.dumps({"type": "user", "timestamp": "2024-01-01T11:59:00Z"}).encode())
    paths = R.listing(spark, f"{folder}/*.jsonl").select("path")
    assert transcript_tails(paths).where("path like '%/long.jsonl'").agg(F.sum(F.octet_length("raw"))).first()[0] <= 3 * 8192
    short = paths.where("path not like '%/long.jsonl'")
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert rows(SS.status(transcript_tails(short), now)) == rows(SS.status(transcript_lines(spark, f"{folder}/[0-9]*.jsonl", 1000), now))
    sessions = paths.select(F.col("path").alias("session_id"), F.col("path").alias("jsonl_path"), F.lit("dead").alias("status"), F.lit("s").alias("summary"), F.lit(None).cast("string").alias("last_active"))
    live = {r["session_id"].rpartition("/")[2]: r["status"] for r in Knowledge(None, None, sessions).live(None, now).collect()}
    assert live == {"0.jsonl": "waiting_input", "1.jsonl": "waiting_input", "40.jsonl": "waiting_input", "900.jsonl": "waiting_input", "long.jsonl": "active"}


def test_file_changes(spark):
    make = lambda *rows: spark.createDataFrame(rows, "path string, length long, seconds long").select("path", "length", F.timestamp_seconds("seconds").alias("modified"))
    soon = int(time.time()) + 1000
    old = make(("a", 1, 1), ("b", 1, 1), ("c", 1, 1), ("d", 1, 1), ("e", 1, 1))
    new = make(("a", 1, 1), ("b", 2, 1), ("c", 1, 2), ("e", 1, soon), ("f", 1, 1), ("g", 1, soon))
    seen = lambda df: {r["path"]: r["change"] for r in df.collect()}
    assert seen(file_changes(old, new)) == {"a": "same", "b": "changed", "c": "changed", "d": "gone", "e": "changed", "f": "added", "g": "added"}
    rested = file_changes(old, new, 500)
    assert seen(rested) == {"a": "same", "b": "changed", "c": "changed", "d": "gone", "e": "same", "f": "added"}
    # what was not at rest is found by the next listing
    assert seen(file_changes(rested.where("change <> 'gone'").drop("change"), new)) == {"a": "same", "b": "same", "c": "same", "e": "changed", "f": "same", "g": "added"}


@pytest.fixture
def folder(tmp_path):
    notes = tmp_path / "projects/p/memory"
    notes.mkdir(parents=True)
    for name, body in {"a": "apple [b](b.md)", "b": "pear", "c": "plum [gone](no.md)", "d": "## one\nfig\n## two\nnut"}.items():
        (notes / f"{name}.md").write_text(f"---\nname: {name}\n---\n{body}" if name != "d" else body)
    return notes


def test_reindex_opens_changed_files_only(spark, tmp_path, folder):
    roots = Roots(str(tmp_path))
    first = reindex(spark, roots).indexed()
    assert {r["change"]: r["count"] for r in first.read.groupBy("change").count().collect()} == {"added": 4}
    # other bytes under the same length and time: a file that is opened would show them
    at = os.stat(folder / "c.md")
    (folder / "c.md").write_text("---\nname: c\n---\nPLUM [gone](no.md)")
    os.utime(folder / "c.md", ns=(at.st_atime_ns, at.st_mtime_ns))
    (folder / "a.md").write_text("---\nname: a\n---\napple and quince [b](b.md)")
    (folder / "b.md").unlink()
    second = reindex(spark, roots, first)
    assert {r["path"].rpartition("/")[2]: r["change"] for r in second.read.collect()} == {"a.md": "changed", "b.md": "gone", "c.md": "same", "d.md": "same"}
    body = {r["title"]: r["body"] for r in second.atoms.collect()}
    assert body["c"].startswith("plum") and "quince" in body["a"] and len(body) == 4
    whole = reindex(spark, roots)
    kinds = lambda k: sorted((r["type"], r["source_path"] or "", r["message"]) for r in k.diagnostics.collect())
    assert kinds(second) == kinds(whole)
    assert {r["title"] for r in second.search("plum").collect()} == {"c"} and second.search("pear").count() == 0


def test_edits_outlive_readings_until_the_file_changes(spark, tmp_path, folder):
    roots = Roots(str(tmp_path))
    k = reindex(spark, roots).indexed()
    ids = {r["title"]: r["id"] for r in k.atoms.collect()}
    k = k.with_body(ids["c"], "my own damson").without_atom(ids["b"])
    assert {r["title"] for r in k.search("damson").collect()} == {"c"} and k.search("pear").count() == 0
    for _ in range(2):
        k = reindex(spark, roots, k)
        body = {r["title"]: r["body"] for r in k.atoms.collect()}
        assert body["c"] == "my own damson" and "b" not in body
        assert k.links.where(F.col("target_id") == ids["b"]).count() == 0
    (folder / "c.md").write_text("---\nname: c\n---\nfrom the file again")
    k = reindex(spark, roots, k)
    assert {r["title"]: r["body"] for r in k.atoms.collect()}["c"] == "from the file again"
    assert k.search("damson").count() == 0


def test_follow_tells_of_changes(spark, tmp_path, folder):
    roots, seen = Roots(str(tmp_path)), []
    q = J.follow(spark, roots, reindex(spark, roots), seen.append, "0 seconds", 300, str(tmp_path / "checkpoint"))
    (folder / "e.md").write_text("---\nname: e\n---\nelder")
    (folder / "a.md").unlink()
    until = time.time() + 240
    while time.time() < until and q.isActive and not (seen and seen[-1].files.count() == 4 and seen[-1].files.where("path like '%e.md'").count()):
        time.sleep(0.2)
    q.stop()
    assert {r["path"].rpartition("/")[2] for r in seen[-1].files.collect()} == {"b.md", "c.md", "d.md", "e.md"}
    assert "elder" in {r["body"] for r in seen[-1].atoms.collect()}


def test_titles_from_a_metadata_file(spark, tmp_path):
    path = str(tmp_path / "meta data.db")
    assert session_metadata(spark, path).count() == 0
    db = sqlite3.connect(path)
    db.execute("create table other (x)")
    db.commit()
    assert session_metadata(spark, path).count() == 0
    db.execute("create table session_metadata (session_id text primary key, first_user_message text, total_tokens integer, models_used text)")
    db.executemany("insert into session_metadata values (?, ?, ?, null)", [(f"s{i}", None if i % 3 == 0 else "" if i % 3 == 1 else f"please check item {i}", i if i % 2 else None) for i in range(50)])
    db.commit()
    db.close()
    got = {tuple(r) for r in session_metadata(spark, path).collect()}
    assert got == {(f"s{i}", f"please check item {i}", i if i % 2 else None) for i in range(2, 50, 3)}
    folder = tmp_path / "projects/p"
    folder.mkdir(parents=True)
    (folder / "s5.jsonl").write_text(json.dumps({"type": "system", "sessionId": "s5"}))
    k = reindex(spark, Roots(str(tmp_path)), metadata=path)
    assert [(r["title"], r["input_tokens"]) for r in k.sessions.collect()] == [("Check item 5", 5)]
