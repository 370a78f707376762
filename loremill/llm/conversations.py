"""Conversation structure repair: the cheapest edits that make a conversation ``(s?(ua)+)?``, by a forward Viterbi pass.

A conversation's rows, in the order of their turns, are the observations; the four grammar states are: nothing said yet, system
prompt said, user has spoken, assistant has answered. Each state carries its least ``(cost, audit)``: the edits' initials so
far (Keep, Rerole, Delete, Insert). A row's layer is closed by inserts, of which two rounds are enough: a third would come back to
the state it left, for more. An audit tells every edit, because the grammar leaves one role for each Rerole and Insert, so
the repaired rows follow from it.

Rows are dealt by conversation and sorted by turn; a task streams through them. What all living states' audits have in common is
settled, its rows are handed on and forgotten, and a state that can't win any more ends, so a task holds a few rows of a conversation
however long it is. (A conversation stays in one stream, because its digest is one hash over its rows in order.) Whether
a row's role and text were seen earlier is found beforehand on hashes, with a hot text split (``spread_join``), and comes to the stream as
a mark before the rows of its turn; so no set of what was seen grows with a conversation.

Rows of the same turn stand in the order of role and text. Edge cases: null roles and texts count as one space, null turns come
first and count in no gap; null conversation ids are one conversation; a conversation without rows gets an empty audit; an empty
table gives no rows; rows repeated whole are duplicates of each other; other columns are not read, whatever their names; a text of
any length passes once.
"""

from __future__ import annotations

import hashlib
import os.path
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import require, spread_join, stored

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: Rows after which a task looks for what is settled.
SETTLE = 256
_WHITE = " \t\n\x0b\f\r"
REPORT = "{conv} {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_NONE = (10**18, "")

State = tuple[int, str]


def damaged(rows: DataFrame) -> DataFrame:
    """``rows`` (conv_id, turn, role, text) with seeded faults by CRC-32 of ``conv_id:turn`` modulo 20, and ``copies``.

    0 drops the row (``copies`` 0), 1 empties its text, 2 removes its ``. ! ?``, 3 repeats it (``copies`` 2), 4 sets its role to user.
    """
    require(rows, "conv_id", "turn", "role", "text")
    some = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(some("conv_id"), F.lit(":"), some("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(some("text"), r"[.!?]", "")).otherwise(some("text"))
    copies = F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1)
    return rows.select("conv_id", F.col("turn").cast("long").alias("turn"), F.when(kind == 4, "user").otherwise(some("role")).alias("role"), text.alias("text"), copies.alias("copies"))


def _observed(rows: DataFrame) -> DataFrame:
    """Rows in stream order with their faults, each turn's marks of what was seen at an earlier turn before its rows."""
    some = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    copies = F.col("copies").cast("int") if "copies" in rows.columns else F.lit(1)
    r = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), some("role").alias("role"), some("text").alias("text"), copies.alias("copies"))
    conv = F.coalesce(F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.lit("n"))
    r = r.withColumn("h", F.unhex(F.sha2(F.concat_ws("\u0001", conv, F.length("role").cast("string"), "role", "text"), 256)))
    r = r.withColumn("blank", ~F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    # texts that stand at more than one place of a conversation; a null turn is the first
    place = F.struct(F.col("turn").isNotNull().alias("some"), F.coalesce("turn", F.lit(0)).alias("turn"))
    narrow = r.where("copies > 0 and not blank").select("h", place.alias("place"))
    seen = narrow.groupBy("h").agg(F.min("place").alias("first"), F.max("place").alias("last"), F.count("*").alias("n"))
    twins = stored(seen.where("first < last").select("h", "first", "n"), "twins")
    marks = None
    if twins.head(1):
        with_id = r.where("copies > 0 and not blank").select("conv_id", "turn", "h", place.alias("place"))
        marks = spread_join(with_id, twins, ["h"]).where("first < place").groupBy("conv_id", "turn", "h").agg(F.lit(0).alias("copies"))
    end = F.right(F.rtrim(F.col("text"), F.lit(_WHITE)), F.lit(1))
    cols = ["conv_id", "turn", "mark", "role", "text", "h", "copies", "blank", "cut"]
    out = r.withColumns({"mark": F.lit(False), "cut": ~end.isin(".", "!", "?")}).select(*cols)
    if marks is not None:
        empty = {"mark": F.lit(True), "role": F.lit(""), "text": F.lit(""), "blank": F.lit(False), "cut": F.lit(False)}
        out = out.unionByName(marks.withColumns(empty).select(*cols))
    order = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), F.desc("mark"), "role", "text"]
    return out.repartition("conv_id").sortWithinPartitions(*order)


def _moved(s: State, cost: int, edit: str) -> State:
    return s[0] + cost, s[1] + edit


def closed(layer: list[State]) -> list[State]:
    """A layer after inserts: two rounds of them reach every state that inserts can reach without coming back."""
    none, system, user, answer = layer
    for _ in range(2):
        user, answer = min(user, *(_moved(s, INSERT, "I") for s in (none, system, answer))), min(answer, _moved(user, INSERT, "I"))
    return [none, system, user, answer]


def advanced(layer: list[State], initial: str, must_go: bool, cut: bool) -> list[State]:
    """The closed layer after one more row, whose role begins with ``initial``."""
    none, system, user, answer = layer
    new = [_moved(s, DELETE, "D") for s in layer]
    if not must_go:
        extra = TRUNCATED if cut else 0
        speak, reply = min(none, system, answer), user
        if initial == "s":
            new[1] = min(new[1], _moved(none, KEEP + extra, "K"))
        new[2] = min(new[2], _moved(speak, REROLE + extra, "R"), *([_moved(speak, KEEP + extra, "K")] if initial == "u" else []))
        new[3] = min(new[3], _moved(reply, REROLE + extra, "R"), *([_moved(reply, KEEP + extra, "K")] if initial == "a" else []))
    return closed(new)


class _Walk:
    """One conversation's pass: layers, counts, and the rows that are not settled yet."""

    def __init__(self, conv: object, emit_rows: bool):
        self.conv, self.emit_rows = conv, emit_rows
        self.layer = closed([(0, ""), _NONE, _NONE, _NONE])
        self.turns: list[int | None] = [None, None]
        self.distinct = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.last_initial: str | None = None
        self.turn: object = ()
        self.marked: set[bytes] = set()
        self.last_h: bytes | None = None
        self.counted = False
        self.waiting: deque[tuple[str, str, int | None]] = deque()
        self.look = SETTLE
        self.audit: list[str] = []
        self.digest, self.n_out, self.reply = hashlib.sha256(), 0, False
        self.repaired: list[tuple] = []

    def see(self, turn: int | None, mark: bool, role: str, text: str, h: bytes, copies: int, blank: bool, cut: bool) -> None:
        if not mark and not copies:
            return
        if (turn,) != self.turn:
            self.turn, self.marked, self.last_h, self.counted = (turn,), set(), None, False
        if mark:
            self.marked.add(h)
            return
        if turn is not None and not self.counted:
            self.counted = True
            self.distinct += 1
            self.turns = [turn if self.turns[0] is None else self.turns[0], turn]
        for _ in range(copies):
            # equal rows of a turn are neighbours
            repeat = not blank and (h == self.last_h or h in self.marked)
            self.last_h = h
            cut_off = not blank and not repeat and cut
            self.blank, self.duplicate, self.truncated = self.blank + blank, self.duplicate + repeat, self.truncated + cut_off
            initial = role[:1]
            if self.last_initial is not None and self.last_initial + initial not in ("su", "ua", "au"):
                self.illegal += 1
            self.last_initial = initial
            self.waiting.append((role, text, turn))
            self.layer = advanced(self.layer, initial, blank or repeat, cut_off)
        if len(self.waiting) >= self.look:
            self.settle()

    def settle(self) -> None:
        none, system, user, answer = self.layer
        # the assistant's state can do what the others can, but for a system prompt, which it would delete
        if none[0] > answer[0] + DELETE:
            none = _NONE
        if system[0] > answer[0]:
            system = _NONE
        self.layer = [none, system, user, answer]
        alive = [s for s in self.layer if s[0] < _NONE[0]]
        same = os.path.commonprefix([s[1] for s in alive])
        self.hand_on(same)
        self.layer = [(c, a[len(same):]) if c < _NONE[0] else _NONE for c, a in self.layer]
        self.look = max(SETTLE, 2 * len(self.waiting))

    def hand_on(self, edits: str) -> None:
        self.audit.append(edits)
        for e in edits:
            if e == "I":
                role, text, turn = "assistant" if self.reply else "user", "", None
            else:
                role, text, turn = self.waiting.popleft()
                if e == "D":
                    continue
                if e == "R":
                    role = "assistant" if self.reply else "user"
            self.reply = not self.reply and role[:1] != "s"
            self.digest.update((("\n" if self.n_out else "") + f"{role}:{text}").encode("utf-8", "surrogatepass"))
            if self.emit_rows:
                self.repaired.append((self.conv, self.n_out, turn, e, role, text))
            self.n_out += 1

    def end(self) -> tuple:
        cost, rest = min(self.layer[0], self.layer[3])
        self.hand_on(rest)
        gaps = 0 if self.turns[0] is None else self.turns[1] - self.turns[0] + 1 - self.distinct
        return (self.conv, gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, "".join(self.audit), self.digest.hexdigest())


_COLUMNS = ("turn", "mark", "role", "text", "h", "copies", "blank", "cut")


def _walked(batches: Iterator[pa.RecordBatch], emit_rows: bool) -> Iterator[tuple[list[tuple], tuple | None]]:
    """Repaired rows as they settle, and each conversation's report when it ends."""
    walk: _Walk | None = None
    for batch in batches:
        for start in range(0, batch.num_rows, 1000):
            b = batch.slice(start, 1000)
            convs = b.column(0).to_pylist()
            for conv, *row in zip(convs, *(b.column(b.schema.get_field_index(c)).to_pylist() for c in _COLUMNS)):
                if walk is None or conv != walk.conv:
                    if walk is not None:
                        report = walk.end()
                        yield walk.repaired, report
                    walk = _Walk(conv, emit_rows)
                walk.see(*row)
                if len(walk.repaired) >= 1000:
                    yield walk.repaired, None
                    walk.repaired = []
    if walk is not None:
        report = walk.end()
        yield walk.repaired, report


def _batched(rows: Iterator[list[tuple]], schema: pa.Schema, most: int = 1000) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for some in rows:
        held += some
        if len(held) >= most:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)


def repair(rows: DataFrame) -> DataFrame:
    """A row a conversation: gaps, counts of faults, illegal neighbours, cost, audit and the digest of its repaired rows.

    ``rows`` has conv_id, turn, role, text and may have ``copies``, how often each row stands (0: not at all). A
    conversation whose rows all have 0 copies comes back, empty.
    """
    require(rows, "conv_id", "turn", "role", "text")
    spark = rows.sparkSession
    stream = _observed(rows)
    kind = rows.schema["conv_id"].dataType.simpleString()
    schema = REPORT.format(conv="conv_id", kind=kind)
    arrow = _arrow(spark, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batched(([report] for _, report in _walked(batches, False) if report), arrow)

    return stream.mapInArrow(run, schema)


def repaired_turns(rows: DataFrame) -> DataFrame:
    """The repaired conversations: conv_id, place (from 0), turn (null for inserted rows), edit (K, R or I), role and text."""
    require(rows, "conv_id", "turn", "role", "text")
    spark = rows.sparkSession
    stream = _observed(rows)
    schema = f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, place long, turn long, edit string, role string, text string"
    arrow = _arrow(spark, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batched((done for done, _ in _walked(batches, True)), arrow)

    return stream.mapInArrow(run, schema)


def _arrow(spark, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(spark.createDataFrame([], schema).schema)
