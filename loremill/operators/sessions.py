"""Transcripts to sessions: head and tail reads, titles, messages, live status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HEAD, TAIL, TAIL_BYTES = 20, 15, 8192


#: Where a transcript line has its session's id and time.
FIELDS = {"session_id": "$.sessionId", "timestamp": "$.timestamp"}


def head(lines: DataFrame, key: str = "path", fields: dict[str, str] = FIELDS) -> DataFrame:
    """A session a transcript, from ``lines`` (key, line_no, raw): fields of the first 20 non-blank lines, the number of
    non-blank lines, and the last one's time. Lines that are no JSON are skipped but counted."""
    real = lines.where(F.trim("raw") != "")
    nth = F.row_number().over(Window.partitionBy(key).orderBy("line_no"))
    j = real.withColumn("nth", nth).withColumn("v", F.try_parse_json("raw"))
    field = lambda p: F.try_variant_get("v", p, "string")
    content = F.try_variant_get("v", "$.message.content", "variant")
    parts = F.from_json(F.get_json_object("raw", "$.message.content"), "array<struct<type:string,text:string>>")
    first_part = F.get(F.filter(parts, lambda p: p["type"] == "text"), F.lit(0))["text"]
    text = F.when(F.schema_of_variant(content) == "STRING", field("$.message.content")).otherwise(first_part)
    in_head = F.col("nth") <= HEAD
    first = lambda c: F.min_by(c, F.when(in_head & c.isNotNull(), F.col("line_no")))
    user = F.when(field("$.type") == "user", F.left(text, F.lit(200)))
    return j.groupBy(key).agg(
        first(field(fields["session_id"])).alias("session_id"), first(field(fields["timestamp"])).alias("started_at"), first(field("$.gitBranch")).alias("git_branch"), first(field("$.slug")).alias("slug"),
        first(user).alias("summary"), F.count("*").alias("message_count"), F.max_by(field(fields["timestamp"]), F.col("line_no")).alias("last_active"),
    )


def tail(lines: DataFrame, key: str = "path", last: int = TAIL, most_bytes: int | None = TAIL_BYTES) -> DataFrame:
    """The last 15 non-blank lines in the last 8,192 bytes of a transcript, ``back`` = 1 for the newest.

    A line that the byte limit cuts keeps its end only (and so no longer parses). Lines are taken as joined by
    line feeds, the last one without. Without ``most_bytes`` the last 15 lines are whole, however long they are.
    """
    newest = Window.partitionBy(key).orderBy(F.desc("line_no"))
    if most_bytes is None:
        return lines.where(F.trim("raw") != "").withColumn("back", F.row_number().over(newest)).where(F.col("back") <= last)
    size = F.octet_length("raw") + 1
    seen = lines.withColumn("_upto", F.sum(size).over(newest.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    over = F.col("_upto") - most_bytes
    seen = seen.where(over < size - 1)
    raw = F.when(over > 0, F.decode(F.substring(F.encode("raw", "UTF-8"), over.cast("int") + 1, F.lit(1 << 30)), "UTF-8")).otherwise(F.col("raw"))
    kept = seen.withColumn("raw", raw).drop("_upto").where(F.trim("raw") != "")
    return kept.withColumn("back", F.row_number().over(newest)).where(F.col("back") <= last)


def recency(age_seconds: Column, enqueued: Column, last_type: Column, fresh: float = 300, alive: float = 3600) -> Column:
    """Status by age: under five minutes waiting or active, under an hour idle, else dead; no time is dead."""
    spoken = F.when(enqueued | (last_type == "assistant"), "waiting_input").otherwise("active")
    return F.when(age_seconds < fresh, spoken).when(age_seconds < alive, "idle").otherwise("dead")


def status(lines: DataFrame, now: str, key: str = "path", fresh: float = 300, alive: float = 3600) -> DataFrame:
    """Live status, pending prompt and last time of each transcript; ``now`` is an ISO time."""
    t = tail(lines, key).withColumn("v", F.try_parse_json("raw"))
    field = lambda p: F.try_variant_get("v", p, "string")
    parts = F.from_json(F.get_json_object("raw", "$.message.content"), "array<struct<type:string>>")
    uses_tool = (F.col("back") == 1) & (field("$.type") == "assistant") & F.exists(F.coalesce(parts, F.array().cast("array<struct<type:string>>")), lambda p: p["type"] == "tool_use")
    enqueue = (field("$.type") == "queue-operation") & (field("$.operation") == "enqueue")
    prompt = F.when(enqueue, F.left(F.coalesce(field("$.content"), F.get_json_object("raw", "$.content")), F.lit(200)))
    per = t.groupBy(key).agg(
        F.coalesce(F.bool_or(uses_tool), F.lit(False)).alias("tool"), F.coalesce(F.bool_or(enqueue), F.lit(False)).alias("enqueued"),
        F.max_by(prompt, F.when(prompt.isNotNull(), F.col("back"))).alias("pending"), F.min_by(field("$.timestamp"), F.when(field("$.timestamp").isNotNull(), F.col("back"))).alias("last_timestamp"),
        F.max(F.when(F.col("back") == 1, field("$.type"))).alias("last_type"),
    )
    at = F.try_to_timestamp("last_timestamp")
    age = F.unix_micros(F.lit(now).cast("timestamp")) / 1e6 - F.unix_micros(at) / 1e6
    st = F.when(F.col("tool"), "processing").otherwise(F.coalesce(recency(age, F.col("enqueued"), F.coalesce("last_type", F.lit("")), fresh, alive), F.lit("dead")))
    pending = F.when((st == "waiting_input") & F.col("enqueued"), F.col("pending"))
    return per.select(key, st.alias("status"), pending.alias("pending_prompt"), "last_timestamp")


def refresh(sessions: DataFrame, states: DataFrame) -> DataFrame:
    """Sessions under their live states (jsonl_path, status, pending_prompt, last_timestamp); without a transcript dead."""
    st = states.select("jsonl_path", F.col("status").alias("_status"), "pending_prompt", "last_timestamp")
    j = sessions.join(st, "jsonl_path", "left")
    new = {"status": F.coalesce("_status", F.lit("dead")), "summary": F.coalesce("pending_prompt", "summary"), "last_active": F.coalesce("last_timestamp", "last_active")}
    return j.withColumns(new).select(*sessions.columns)


def backfill_titles(sessions: DataFrame) -> DataFrame:
    """Sessions without a title get one from their summary."""
    from ..functions.text import generate_title

    empty = F.coalesce("title", F.lit("")) == ""
    has = F.coalesce("summary", F.lit("")) != ""
    return sessions.withColumn("title", F.when(empty & has, generate_title(F.col("summary"))).otherwise(F.col("title")))


def tool_summary(tool_input: Column, most: int = 60) -> Column:
    """A tool call's first argument as ``key="value"``, the value shortened."""
    first = F.get(F.map_entries(F.from_json(tool_input, "map<string,string>")), F.lit(0))
    value = F.when(F.length(first["value"]) > most, F.concat(F.left(first["value"], F.lit(most)), F.lit("..."))).otherwise(first["value"])
    return F.concat(first["key"], F.lit('="'), value, F.lit('"'))


def short_status(s: Column) -> Column:
    """Five statuses to the three that are shown."""
    return F.when(s.isin("active", "processing"), "active").when(s == "waiting_input", "waiting").otherwise("idle")


def display(sessions: DataFrame) -> DataFrame:
    """session_id, title, project, last_activity, shown status."""
    some = lambda c: F.nullif(F.col(c), F.lit(""))
    return sessions.select("session_id", F.coalesce(some("custom_title"), some("title"), F.col("project")).alias("title"), "project", F.coalesce("last_active", "started_at", F.lit("")).alias("last_activity"), short_status(F.col("status")).alias("status"), "message_count")


def list_sessions(sessions: DataFrame, project: str | None = None, status: str | None = None) -> DataFrame:
    if project:
        sessions = sessions.where(F.col("project") == project)
    if status:
        sessions = sessions.where(F.col("status") == status)
    return sessions.orderBy(F.desc_nulls_last("last_active"))


#: What a re-read of a known session's transcript replaces; a desktop session's own fields are replaced too, but for its subagents.
REPLACED = ("last_active", "status", "message_count", "subagent_count")
DESKTOP = ("project", "is_cowork", "workspace_id", "participant_id")


def upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """Re-indexed sessions over known ones, with all columns of both.

    A known session keeps its project, branch, slug, path, start, custom title and whatever else it has; its activity, status and counts
    are replaced, a summary only by another one, and a title by the custom title, else by a new one. Rows of ``new`` with
    ``is_cowork`` also replace project, workspace and participant, but not the count of subagents. Sessions that ``new`` does not have
    stay as they are. A null session_id meets nothing and stays a row of its own.
    """
    o = old.select(F.col("session_id"), F.lit(True).alias("_was"), F.struct(*old.columns).alias("_o"))
    n = new.select(F.col("session_id"), F.lit(True).alias("_is"), F.struct(*new.columns).alias("_n"))
    j = o.join(n, "session_id", "full_outer")
    both = F.col("_was").isNotNull() & F.col("_is").isNotNull()
    desktop = both & F.coalesce(F.col("_n.is_cowork"), F.lit(False)) if "is_cowork" in new.columns else F.lit(False)

    def value(c: str) -> Column:
        if c not in new.columns:
            return F.col(f"_o.{c}")
        if c not in old.columns:
            return F.col(f"_n.{c}")
        mine, its = F.col(f"_o.{c}"), F.col(f"_n.{c}")
        kept = F.when(F.col("_was").isNull(), its).otherwise(mine)
        if c == "summary":
            return F.coalesce(its, mine)
        if c == "title":
            custom = F.col("_o.custom_title") if "custom_title" in old.columns else F.lit(None)
            return F.when(F.col("_is").isNull(), mine).otherwise(F.coalesce(custom, its, mine))
        if c in REPLACED:
            return F.when(both & (~desktop if c == "subagent_count" else F.lit(True)), its).otherwise(kept)
        return F.when(desktop, its).otherwise(kept) if c in DESKTOP else kept

    names = [c for c in [*old.columns, *(c for c in new.columns if c not in old.columns)] if c != "session_id"]
    return j.select("session_id", *[value(c).alias(c) for c in names])


def import_titles(sessions: DataFrame, meta: DataFrame) -> DataFrame:
    """Sessions without a title take one from outside metadata (session_id, first_user_message, total_tokens) that has a message, and its tokens if they have none.

    Sessions with a title stay as they are, tokens included. Of several rows of metadata for a session the one with the smallest message holds.
    """
    from ..functions.text import generate_title

    some = meta.where(F.coalesce("first_user_message", F.lit("")) != "").groupBy("session_id").agg(F.min(F.struct("first_user_message", "total_tokens")).alias("_meta"))
    j = sessions.join(some, "session_id", "left")
    fill = (F.coalesce("title", F.lit("")) == "") & F.col("_meta").isNotNull()
    tokens = F.coalesce(F.nullif("input_tokens", F.lit(0)), F.col("_meta.total_tokens"))
    return j.withColumns({"title": F.when(fill, generate_title(F.col("_meta.first_user_message"))).otherwise(F.col("title")), "input_tokens": F.when(fill, tokens).otherwise(F.col("input_tokens"))}).drop("_meta")


#: The shape of a content block, all kinds in one.
BLOCK = "struct<type:string,text:string,thinking:string,id:string,name:string,input:string,tool_use_id:string,is_error:boolean,content:string,source:struct<type:string,media_type:string,data:string>>"


def blocks(content: Column) -> Column:
    """Parsed blocks of a message's content (JSON text of a string or of an array); unknown and blank ones go."""
    arr = F.from_json(content, f"array<{BLOCK}>")
    some = lambda c: F.length(F.trim(F.coalesce(c, F.lit("")))) > 0
    keep = F.filter(
        arr,
        lambda b: F.coalesce((b["type"] == "text") & some(b["text"]), F.lit(False))
        | F.coalesce((b["type"] == "thinking") & some(b["thinking"]), F.lit(False))
        | F.coalesce((b["type"] == "image") & (b["source"]["type"] == "base64"), F.lit(False))
        | F.coalesce(b["type"].isin("tool_use", "tool_result"), F.lit(False)),
    )
    joined = lambda c: F.coalesce(F.array_join(F.transform(F.filter(F.from_json(c, "array<struct<type:string,text:string>>"), lambda p: p["type"] == "text"), lambda p: F.coalesce(p["text"], F.lit(""))), "\n"), c, F.lit(""))
    body = lambda b: (
        F.when(b["type"] == "text", b["text"])
        .when(b["type"] == "thinking", b["thinking"])
        .when(b["type"] == "image", F.coalesce(b["source"]["media_type"], F.lit("image/png")))
        .when(b["type"] == "tool_use", F.coalesce(b["input"], F.lit("{}")))
        .otherwise(joined(b["content"]))
    )
    shaped = F.transform(keep, lambda b: F.struct(b["type"].alias("type"), body(b).alias("text"), F.coalesce(b["id"], b["tool_use_id"], F.lit("")).alias("id"), F.coalesce(b["name"], F.lit("")).alias("name"), F.coalesce(b["is_error"], F.lit(False)).alias("is_error")))
    return shaped


def messages(lines: DataFrame, key: str = "path") -> DataFrame:
    """User and assistant messages with at least one block, in line order."""
    kind = F.get_json_object("raw", "$.type")
    content = F.get_json_object("raw", "$.message.content")
    is_array = content.startswith("[")
    plain = F.array(F.struct(F.lit("text").alias("type"), content.alias("text"), F.lit("").alias("id"), F.lit("").alias("name"), F.lit(False).alias("is_error")))
    bs = F.when(is_array, blocks(content)).when(F.length(F.trim(content)) > 0, plain)
    out = lines.where(kind.isin("user", "assistant")).select(key, "line_no", kind.alias("role"), F.get_json_object("raw", "$.uuid").alias("uuid"), F.get_json_object("raw", "$.timestamp").alias("timestamp"), bs.alias("blocks"))
    return out.where(F.size("blocks") > 0)
