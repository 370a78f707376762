"""Session tables from transcript folders: command-line transcripts and desktop-app audits."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import generate_title, path_slug
from ..model import SESSIONS
from ..operators.sessions import head
from .files import Roots, transcript_lines
from .ranges import found, listing, whole


def _none(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SESSIONS)


def _shaped(df: DataFrame) -> DataFrame:
    """All session columns in order, those that are not there as nulls or zeros."""
    zero = {"input_tokens", "output_tokens", "subagent_count", "estimated_cost"}
    cols = []
    for field in SESSIONS.replace("\n", " ").split(", "):
        name, kind = field.split()
        cols.append((F.col(name) if name in df.columns else F.lit(0 if name in zero else None)).cast(kind).alias(name))
    return df.select(*cols)


def project_sessions(spark: SparkSession, roots: Roots) -> DataFrame:
    """A session a transcript; transcripts of a folder without session ids become one row named after the folder.

    Its subagents are the folder's ``subagents/*.meta.json`` files, the same number for each of its sessions.
    """
    if not found(spark, roots.transcripts()):
        return _none(spark)
    lines = transcript_lines(spark, roots.transcripts())
    h = head(lines).withColumn("project", F.regexp_extract("path", r"([^/]+)/[^/]+$", 1))
    agents = listing(spark, f"{roots.root.rstrip('/')}/projects/*/subagents/*.meta.json")
    agents = agents.groupBy(F.element_at(F.split("path", "/"), -3).alias("project")).agg(F.count("*").alias("subagent_count"))
    h = h.join(agents, "project", "left").withColumn("subagent_count", F.coalesce("subagent_count", F.lit(0)))
    h = h.withColumn("session_id", F.coalesce("session_id", "project")).withColumnRenamed("path", "jsonl_path")
    # the last transcript of an id holds, but where the session began stays as in the first
    first, last = F.struct("started_at", "git_branch", "slug", "jsonl_path"), F.struct("last_active", "message_count", "subagent_count")
    one = h.groupBy("session_id").agg(F.min_by("project", "jsonl_path").alias("project"), F.min_by(first, "jsonl_path").alias("f"), F.max_by(last, "jsonl_path").alias("l"), F.max_by("summary", F.when(F.col("summary").isNotNull(), F.col("jsonl_path"))).alias("summary"))
    one = one.select("session_id", "project", "f.*", "l.*", "summary")
    return _shaped(one.withColumns({"status": F.lit("dead"), "title": F.when(F.col("summary").isNotNull(), generate_title(F.col("summary")))}))


def desktop_sessions(spark: SparkSession, root: str) -> DataFrame:
    """Sessions of ``<workspace>/<participant>/<session>/audit.jsonl`` with the sibling ``<session>.json``.

    Its title, times and first chosen folder fill what the audit lacks; the folder, else the workspace, is the project.
    """
    base = root.rstrip("/")
    if not found(spark, f"{base}/*/*/*/audit.jsonl"):
        return _none(spark)
    lines = transcript_lines(spark, f"{base}/*/*/*/audit.jsonl")
    h = head(lines, fields={"session_id": "$.session_id", "timestamp": "$._audit_timestamp"})
    part = lambda n: F.element_at(F.split("path", "/"), n)
    h = h.withColumns({"workspace_id": part(-4), "participant_id": part(-3), "folder": part(-2)})
    meta = whole(listing(spark, f"{base}/*/*/*.json")).withColumnRenamed("raw", "value")
    field = lambda p: F.try_variant_get(F.try_parse_json("value"), p, "string")
    iso = lambda p: F.date_format(F.timestamp_millis(F.try_variant_get(F.try_parse_json("value"), p, "bigint")), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    meta = meta.select(part(-3).alias("workspace_id"), part(-2).alias("participant_id"), F.regexp_replace(part(-1), r"\.json$", "").alias("folder"), field("$.title").alias("meta_title"), field("$.userSelectedFolders[0]").alias("chosen"), iso("$.createdAt").alias("created"), iso("$.lastActivityAt").alias("active"))
    j = h.join(meta, ["workspace_id", "participant_id", "folder"], "left")
    some = lambda c: F.nullif(F.col(c), F.lit(""))
    j = j.select(
        F.coalesce("session_id", "folder").alias("session_id"), F.coalesce(path_slug(some("chosen")), F.col("workspace_id")).alias("project"), F.col("path").alias("jsonl_path"), F.coalesce("started_at", "created").alias("started_at"), F.coalesce("last_active", "active").alias("last_active"),
        "message_count", "summary", F.coalesce(some("meta_title"), F.when(F.col("summary").isNotNull(), generate_title(F.col("summary")))).alias("title"), F.lit(True).alias("is_cowork"), "workspace_id", "participant_id", F.lit("dead").alias("status"),
    )
    return _shaped(j)


METADATA = "session_id string, first_user_message string, total_tokens long"


def session_metadata(spark: SparkSession, path: str, parts: int = 4) -> DataFrame:
    """``METADATA`` of the sessions with a first message in an SQLite file's table ``session_metadata``, for ``import_titles``.

    Each of ``parts`` tasks reads a range of row numbers, and the file answers the condition itself. The file must be under a path that all
    executors have; it is opened read-only. Without the file or the table there are no rows.
    """
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os
        import sqlite3
        from contextlib import closing

        for b in batches:
            for n in b.column(0).to_pylist():
                if not os.path.exists(path):
                    continue
                with closing(sqlite3.connect(f"file:{path}?mode=ro", uri=True)) as db:
                    if not db.execute("select 1 from sqlite_master where type = 'table' and name = 'session_metadata'").fetchone():
                        continue
                    low, high = db.execute("select coalesce(min(rowid), 0), coalesce(max(rowid), -1) from session_metadata").fetchone()
                    step = (high - low) // parts + 1
                    rows = db.execute("select session_id, first_user_message, total_tokens from session_metadata where rowid >= ? and rowid < ? and first_user_message <> ''", (low + n * step, low + (n + 1) * step))
                    while some := rows.fetchmany(1000):
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some), (pa.string(), pa.string(), pa.int64()))], names=["session_id", "first_user_message", "total_tokens"])

    return spark.range(0, parts, 1, parts).mapInArrow(read, METADATA)
