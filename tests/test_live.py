"""Live status as a stream: the batch rule at each time, restarts, and timers that need no new line."""

import datetime as dt
import json
import os
import time

from hypothesis import given
from hypothesis import strategies as st

from loremill.operators import sessions as SS
from loremill.streaming import live as L

LINES = "path string, line_no long, raw string"


def iso(now, ago):
    return (now - dt.timedelta(seconds=ago)).isoformat(timespec="milliseconds").replace("+00:00", "Z")


def said(kind, at=None, **more):
    return json.dumps({"type": kind, **({"timestamp": at} if at else {}), **more})


def batches(now):
    """Three batches of (path, line_no, raw); what a path says changes from one to the next."""
    use = {"message": {"content": [{"type": "tool_use", "name": "Read"}]}}
    ask = {"operation": "enqueue", "content": "next, please"}
    return [
        [("a", 0, said("user", iso(now, 7000))), ("b", 0, said("user", iso(now, 900))), ("c", 0, "no json"), ("d", 1, said("assistant", iso(now, 5))), ("d", 0, said("user", iso(now, 9))), ("e", 0, said("user"))],
        [("a", 1, said("user", iso(now, 20))), ("b", 1, said("assistant", iso(now, 800), **use)), ("c", 1, said("queue-operation", iso(now, 3), **ask)), ("d", 2, "x" * 9000), ("f", 0, said("queue-operation", iso(now, 1000), **ask))],
        [("a", 2, ""), ("a", 3, "   "), ("b", 2, said("user", iso(now, 700))), ("c", 2, said("assistant", iso(now, 2))), ("d", 3, said("user", iso(now, 4))), ("c", 0, "no json"), ("g", 0, None)],
    ]


def put(folder, name, rows):
    temporary = folder / f".{name}"
    temporary.write_text("\n".join(json.dumps({"path": p, "line_no": n, "raw": r}) for p, n, r in rows))
    os.rename(temporary, folder / f"{name}.json")


def test_stream_equals_batch_over_restarts_and_timers_fire(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")
    now = dt.datetime.now(dt.timezone.utc)
    stream = lambda: spark.readStream.schema(LINES).json(str(folder / "*.json"))
    states = lambda: {r["jsonl_path"]: tuple(r)[1:] for r in L.current(spark.read.schema(L.STATES).parquet(out)).collect()}
    seen = {}
    for n, rows in enumerate(batches(now)):
        put(folder, f"b{n}", rows)
        L.start_live_status(stream(), out, checkpoint, None).awaitTermination(60)
        seen |= {(p, i): r or "" for p, i, r in rows}
        lines = spark.createDataFrame([(p, i, r) for (p, i), r in seen.items()], LINES)
        at = dt.datetime.now(dt.timezone.utc).strftime("%Y-%m-%d %H:%M:%S")
        batch = {r["path"]: (r["status"], r["pending_prompt"], r["last_timestamp"]) for r in SS.status(lines, at).collect()}
        got = states()
        assert {p: got[p] for p in batch} == batch, n
        # a path of blank lines has no row in the batch and is dead in the stream
        assert set(got) - set(batch) <= {"g"}
    assert (got["c"][0], got["b"][0], got["g"][0]) == ("waiting_input", "idle", "dead")
    # no new line: with shorter limits a path that is active turns idle, then dead
    put(folder, "late", [("z", 0, said("user", iso(dt.datetime.now(dt.timezone.utc), 0)))])
    q = L.start_live_status(stream(), str(tmp_path / "out2"), str(tmp_path / "checkpoint2"), "1 second", fresh=12, alive=18)
    story, began = [], time.time()
    while time.time() - began < 90 and (not story or story[-1] != "dead"):
        time.sleep(1)
        if (tmp_path / "out2").exists():
            story = [r["status"] for r in spark.read.schema(L.STATES).parquet(str(tmp_path / "out2")).where("path = 'z'").orderBy("at").collect()]
    assert q.isActive
    q.stop()
    assert story[-2:] == ["idle", "dead"] and set(story) <= {"active", "idle", "dead"}


@given(st.lists(st.text("ab é\n", max_size=4000), max_size=6))
def test_tail_keeps_the_last_bytes(raws):
    raws = [r.replace("\n", " ") for r in raws]
    kept = L.kept_tail(list(enumerate(raws)))
    whole = "\n".join(raws).encode()
    last = "\n".join(r for _, r in kept)
    assert whole.decode().endswith(last.lstrip("�")) and len(last.encode()) >= min(len(whole), L.TAIL_BYTES) - 8
    assert L.kept_tail(kept) == kept or "�" in last
