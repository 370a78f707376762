"""Live session status as a stream: keyed state and processing-time timers.

New lines of transcripts come in as (path, line_no, raw); each path keeps its tail, at most 8,192 bytes, as state. A batch
with lines of a path, and a timer that fires for it, give a row (path, status, pending_prompt, last_timestamp, at) when the status
has changed, so a session turns idle and dead by itself, without a new line. Two timers a path are all that wait: when the last
time is ``fresh`` seconds old, and when it is ``alive`` seconds old. State and timers are in the state store under
the checkpoint, so a lost executor or a restarted query goes on from there.

Edge cases: lines that are no JSON take a place in the tail and say nothing; blank lines only take bytes; a path whose lines have no time
is dead; lines come again in any order within a batch and are sorted by number, and lines up to a known number are taken for repeats.
"""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..operators.sessions import TAIL, TAIL_BYTES

STATES = "path string, status string, pending_prompt string, last_timestamp string, at timestamp"
FRESH, ALIVE = 300, 3600
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def kept_tail(lines: list[tuple[int, str]]) -> list[tuple[int, str]]:
    """Of lines in order, those that reach into the last bytes; the first keeps its end only."""
    out, room = [], TAIL_BYTES
    for no, raw in reversed(lines):
        if room <= 0:
            break
        data = raw.encode()
        out.append((no, raw if len(data) <= room else data[-room:].decode(errors="replace")))
        room -= len(data) + 1
    return out[::-1]


def seconds(timestamp: str | None) -> float | None:
    """A JSON time in seconds since the epoch; None if it is none."""
    try:
        t = dt.datetime.fromisoformat(timestamp) if timestamp else None
    except ValueError:
        return None
    return None if t is None else (t if t.tzinfo else t.replace(tzinfo=dt.timezone.utc)).timestamp()


def observed(tail: list[tuple[int, str]]) -> dict:
    """What a tail says apart from the time of day: tool, enqueued, pending, last_timestamp and last_type."""
    out = {"tool": False, "enqueued": False, "pending": None, "last_timestamp": None, "last_type": None}
    said = [raw for _, raw in tail if raw.strip(" ")][-TAIL:]
    for back, raw in enumerate(said[::-1]):
        try:
            entry = json.loads(raw)
        except ValueError:
            continue
        if not isinstance(entry, dict):
            continue
        if back == 0:
            out["last_type"] = entry.get("type")
            content = (entry.get("message") or {}).get("content") if isinstance(entry.get("message"), dict) else None
            out["tool"] = entry.get("type") == "assistant" and isinstance(content, list) and any(isinstance(p, dict) and p.get("type") == "tool_use" for p in content)
        if entry.get("type") == "queue-operation" and entry.get("operation") == "enqueue":
            out["enqueued"] = True
            # the oldest of the tail holds
            if entry.get("content") is not None:
                content = entry["content"]
                out["pending"] = (content if isinstance(content, str) else json.dumps(content, separators=(",", ":")))[:200]
        if out["last_timestamp"] is None and isinstance(entry.get("timestamp"), str):
            out["last_timestamp"] = entry["timestamp"]
    return out


def status_at(seen: dict, now: float, fresh: float = FRESH, alive: float = ALIVE) -> tuple[str, str | None]:
    """Status and pending prompt ``now``, in seconds."""
    if seen["tool"]:
        return "processing", None
    at = seconds(seen["last_timestamp"])
    if at is None or now - at >= alive:
        return "dead", None
    if now - at >= fresh:
        return "idle", None
    if seen["enqueued"]:
        return "waiting_input", seen["pending"]
    return ("waiting_input" if seen["last_type"] == "assistant" else "active"), None


class LiveStatus(StatefulProcessor):
    """A path's tail and its last given status."""

    def __init__(self, fresh: float = FRESH, alive: float = ALIVE):
        self.fresh, self.alive = fresh, alive

    def init(self, handle) -> None:
        self.handle = handle
        self.tail = handle.getListState("tail", "line_no long, raw string")
        self.given = handle.getValueState("given", "status string, pending string, last_timestamp string, upto long")

    def _given(self, key, tail: list[tuple[int, str]], now_ms: int, upto: int) -> Iterator[Row]:
        seen = observed(tail)
        status, pending = status_at(seen, now_ms / 1000, self.fresh, self.alive)
        was = self.given.get() if self.given.exists() else None
        self.given.update((status, pending, seen["last_timestamp"], upto))
        if was is None or (was[0], was[1], was[2]) != (status, pending, seen["last_timestamp"]):
            yield Row(path=key[0], status=status, pending_prompt=pending, last_timestamp=seen["last_timestamp"], at=dt.datetime.fromtimestamp(now_ms / 1000, dt.timezone.utc))

    def _set_timers(self, tail: list[tuple[int, str]], now_ms: int) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t if isinstance(t, int) else t[0])
        at = seconds(observed(tail)["last_timestamp"])
        for age in (self.fresh, self.alive):
            if at is not None and (due := int((at + age) * 1000)) > now_ms:
                self.handle.registerTimer(due)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        now = timerValues.getCurrentProcessingTimeInMs()
        upto = self.given.get()[3] if self.given.exists() else -1
        new = sorted((r["line_no"], r["raw"] or "") for r in rows if r["line_no"] > upto)
        old = [(r[0], r[1]) for r in self.tail.get()]
        tail = kept_tail([*old, *new])
        if tail != old:
            self.tail.put(tail)
        self._set_timers(tail, now)
        yield from self._given(key, tail, now, max([upto, *(n for n, _ in new)]))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        tail = [(r[0], r[1]) for r in self.tail.get()]
        upto = self.given.get()[3] if self.given.exists() else -1
        yield from self._given(key, tail, max(timerValues.getCurrentProcessingTimeInMs(), expiredTimerInfo.getExpiryTimeInMs()), upto)

    def close(self) -> None:
        pass


def live_status(lines: DataFrame, fresh: float = FRESH, alive: float = ALIVE) -> DataFrame:
    """Changes of status as a stream of ``STATES``, from a stream of (path, line_no, raw)."""
    rows = lines.select("path", F.col("line_no").cast("long").alias("line_no"), "raw")
    return rows.groupBy("path").transformWithState(LiveStatus(fresh, alive), STATES, "append", "processingtime")


def start_live_status(lines: DataFrame, states: str, checkpoint: str, every: str | None = "10 seconds", fresh: float = FRESH, alive: float = ALIVE):
    """Start the stream; its changes are appended as Parquet to the folder ``states``. The state store is one with timers.

    ``checkpoint`` and ``states`` lie in a folder that all executors share. Without ``every`` it takes what is there in one
    batch and ends (timers would keep an ``availableNow`` query going).
    """
    spark = lines.sparkSession
    spark.conf.set(*STORE)
    writer = live_status(lines, fresh, alive).writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).option("path", states)
    return (writer.trigger(processingTime=every) if every else writer.trigger(once=True)).start()


def current(states: DataFrame) -> DataFrame:
    """The last state of each path, as ``operators.sessions.refresh`` takes it."""
    last = states.groupBy("path").agg(F.max_by(F.struct("status", "pending_prompt", "last_timestamp"), "at").alias("s"))
    return last.select(F.col("path").alias("jsonl_path"), "s.*")
