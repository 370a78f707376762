"""Types of the knowledge model: enumerations, schemas and their checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The model's enumerations.
ATOM_TYPES = ("memory", "agent", "skill", "plan", "feedback", "reference", "project_note", "architecture", "task")
SCOPES = ("global", "shared", "project")
SOURCE_TYPES = ("memory_file", "agent_def", "skill_def", "plan_file", "native")
LINK_TYPES = ("references", "extends", "refines", "contradicts", "supports", "duplicates", "related")
SESSION_STATUSES = ("active", "waiting_input", "processing", "idle", "dead")
DIAGNOSTIC_TYPES = ("broken_reference", "missing_frontmatter", "duplicate", "orphan", "stale")
TASK_STATUSES = ("ready", "in_progress", "blocked", "done")

ATOMS = """id string, title string, body string, atom_type string, scope string, source_path string, source_type string,
project string, tags array<string>, content_hash string, frontmatter string, created_at string, updated_at string, status string,
priority bigint, blocks array<string>, blocked_by array<string>, discovered_from string, section_index int, ingest_seq bigint"""
LINKS = "source_id string, target_id string, link_type string, confidence double"
SESSIONS = """session_id string, project string, git_branch string, slug string, jsonl_path string, started_at string, last_active string,
status string, input_tokens bigint, output_tokens bigint, estimated_cost double, subagent_count bigint, summary string, message_count bigint,
title string, custom_title string, is_cowork boolean, workspace_id string, participant_id string"""
DIAGNOSTICS = "type string, atom_id string, source_path string, message string, details string"

_REQUIRED = {"atoms": ("id", "title", "body", "atom_type", "scope", "source_path", "source_type", "content_hash"), "links": ("source_id", "target_id", "link_type")}
_ENUMS = {"atoms": {"atom_type": ATOM_TYPES, "scope": SCOPES, "source_type": SOURCE_TYPES}, "links": {"link_type": LINK_TYPES}, "sessions": {"status": SESSION_STATUSES}, "diagnostics": {"type": DIAGNOSTIC_TYPES}}


def atom_id(path: Column, section: Column) -> Column:
    """First 16 hex digits of sha256 over path and section number."""
    return F.left(F.sha2(F.concat_ws(":", path, section.cast("string")), 256), F.lit(16))


def content_hash(raw: Column) -> Column:
    return F.left(F.sha2(raw, 256), F.lit(16))


def valid(df: DataFrame, table: str) -> Column:
    """True where a row meets the table's NOT NULL and enumeration rules."""
    ok = F.lit(True)
    for c in _REQUIRED.get(table, ()):
        if c in df.columns:
            ok = ok & F.col(c).isNotNull()
    for c, allowed in _ENUMS.get(table, {}).items():
        if c in df.columns:
            ok = ok & F.coalesce(F.col(c).isin(*allowed), F.lit(False))
    return ok


def split_valid(df: DataFrame, table: str) -> tuple[DataFrame, DataFrame]:
    """Rows that meet the rules, and the quarantine of those that don't."""
    ok = valid(df, table)
    return df.where(ok), df.where(~ok)
