"""Notes and transcripts from folders: agents, skills, plans, project memories, session lines."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..model import atom_id, content_hash
from ..operators.sessions import TAIL_BYTES
from .ranges import RANGE_BYTES, lines, listing, tails, whole


@dataclass(frozen=True)
class Roots:
    """Where things lie under a root folder."""

    root: str

    def globs(self) -> dict[str, str]:
        r = self.root.rstrip("/")
        return {"agent_def": f"{r}/agents/*.md", "skill_def": f"{r}/skills/*/SKILL.md", "plan_file": f"{r}/plans/*.md", "memory_file": f"{r}/projects/*/memory/*.md"}

    def transcripts(self) -> str:
        return f"{self.root.rstrip('/')}/projects/*/*.jsonl"

    def desktop_sessions(self) -> str:
        return f"{self.root.rstrip('/')}/*/*/*/audit.jsonl"

    def watched(self) -> list[str]:
        return [*self.globs().values(), self.transcripts()]


def note_files(spark: SparkSession, roots: Roots) -> DataFrame:
    """``(path, length, modified, source_type)`` of every markdown source that is there; none is opened."""
    kinds = [listing(spark, glob).withColumn("source_type", F.lit(kind)) for kind, glob in roots.globs().items()]
    return reduce(DataFrame.unionByName, kinds)


def read_notes(files: DataFrame) -> DataFrame:
    """``(path, source_type, raw)`` of the files of a listing; those that are gone by now give no row."""
    return whole(files).join(files.select("path", "source_type"), "path").select("path", "source_type", "raw")


def notes(spark: SparkSession, roots: Roots) -> DataFrame:
    """``(path, source_type, raw)`` of every markdown source that is there."""
    return read_notes(note_files(spark, roots))


def file_changes(old: DataFrame, new: DataFrame, quiet_ms: int = 0) -> DataFrame:
    """Two listings side by side: the columns of a listing and ``change`` (added, changed, same or gone).

    A file whose length or time differs has changed. With ``quiet_ms`` a file that was written less than so long ago may
    still be written to: it keeps its old row as ``same``, so a later listing finds it changed, and is not there yet if it is
    new. A file that is edited within the resolution of the file system's times, to the same length, is not seen.
    """
    o = old.select("path", F.struct(*old.columns).alias("_o"))
    n = new.select("path", F.struct(*new.columns).alias("_n"))
    j = o.join(n, "path", "full_outer")
    same = (F.col("_o.length") == F.col("_n.length")) & (F.col("_o.modified") == F.col("_n.modified"))
    restless = F.coalesce(F.unix_millis("_n.modified") > F.unix_millis(F.current_timestamp()) - quiet_ms, F.lit(False)) if quiet_ms else F.lit(False)
    change = F.when(F.col("_n").isNull(), "gone").when(F.col("_o").isNull(), F.when(~restless, "added")).when(same | restless, "same").otherwise("changed")
    row = F.when(F.col("change").isin("same", "gone"), F.col("_o")).otherwise(F.col("_n"))
    return j.withColumn("change", change).where("change is not null").withColumn("_r", row).select("_r.*", "change")


def transcript_lines(spark: SparkSession, glob: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``(path, project, line_no, raw)``; ``line_no`` is the byte where a line begins, and a carriage return at its end stays."""
    return _transcript(lines(listing(spark, glob), range_bytes))


def transcript_tails(paths: DataFrame, most_bytes: int = TAIL_BYTES) -> DataFrame:
    """The same of the last bytes of the transcripts that ``paths`` (path) names, for all that reads tails only."""
    return _transcript(tails(paths, most_bytes))


def _transcript(rows: DataFrame) -> DataFrame:
    return rows.select("path", F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("project"), F.col("at").alias("line_no"), "raw")


_TEXT, _TEXTS = T.StringType(), T.ArrayType(T.StringType())
FRONT = {"ok": T.BooleanType(), "name": _TEXT, "title": _TEXT, "atom_type": _TEXT, "tags": _TEXTS, "keywords": _TEXTS, "status": _TEXT, "priority": T.LongType(), "blocks": _TEXTS, "blocked_by": _TEXTS, "discovered_from": _TEXT, "json": _TEXT}
FRONT_TYPE = T.StructType([T.StructField(k, v) for k, v in FRONT.items()])


@F.pandas_udf(FRONT_TYPE)
def frontmatter(blocks: pd.Series) -> pd.DataFrame:
    """Parse YAML frontmatter; ``ok`` is false where it does not parse."""
    import json

    try:
        import yaml
    except ImportError:
        yaml = None

    def simple(b: str) -> dict:
        out = {}
        for line in b.splitlines():
            k, _, v = line.partition(":")
            v = v.strip()
            if v.startswith("["):
                out[k.strip()] = [x.strip().strip("\"'") for x in v.strip("[]").split(",") if x.strip()]
            elif k.strip():
                out[k.strip()] = v.strip("\"'")
        return out

    def one(b: object) -> tuple:
        if not isinstance(b, str):
            return (True, *[None] * 11)
        try:
            d = (yaml.safe_load(b) if yaml else simple(b)) or {}
            if not isinstance(d, dict):
                raise ValueError
        except Exception:
            return (False, *[None] * 11)
        text = lambda k: None if d.get(k) is None else str(d[k])
        many = lambda k: [str(x) for x in d[k]] if isinstance(d.get(k), list) else None
        try:
            priority = int(d["priority"]) if d.get("priority") is not None else None
        except (TypeError, ValueError):
            priority = None
        return (True, text("name"), text("title"), text("atom_type") or text("type"), many("tags"), many("keywords"), text("status"), priority, many("blocks"), many("blocked_by"), text("discovered_from"), json.dumps(d, default=str))

    return pd.DataFrame([one(b) for b in blocks], columns=list(FRONT)).astype({"priority": "Int64"})


def split_sections(notes: DataFrame, key: str = "path", body: str = "body") -> DataFrame:
    """``(key, section_index, heading, body)``: cut before each second-level heading; empty sections go before numbering.

    A heading line that ends in a carriage return is none. Cutting is one regular expression inside the JVM: no
    window, no shuffle.
    """
    marked = F.regexp_replace(F.col(body), r"(^|\n)(## *[^\r\n#][^\r\n]*)(?=\n|\z)", "$1\u0001$2")
    parts = F.split(marked, "\u0001")
    is_head = lambda p: p.rlike(r"^##[ \t]+[^\r\n]+(\n|\z)")
    shaped = F.transform(parts, lambda p: F.struct(F.when(is_head(p), F.trim(F.regexp_extract(p, r"^##[ \t]+([^\r\n]+)", 1))).alias("heading"), F.regexp_replace(F.when(is_head(p), F.regexp_replace(p, r"^[^\n]*\n?", "")).otherwise(p), r"^\s+|\s+$", "").alias("body")))
    kept = F.filter(shaped, lambda s: s["body"] != "")
    return notes.select(key, F.posexplode(kept).alias("section_index", "s")).select(key, "section_index", "s.heading", "s.body")


def parse_notes(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Atoms and diagnostics of markdown sources (path, source_type, raw)."""
    rows = raw.withColumns({"front": frontmatter(X.frontmatter_block(F.col("raw"))), "text": X.strip_frontmatter(F.col("raw")), "filename": F.regexp_extract("path", r"([^/]+)$", 1)})
    is_memory = F.col("source_type") == "memory_file"
    rows = rows.withColumn("has_front", X.frontmatter_block(F.col("raw")).isNotNull())
    diags = rows.where(~F.col("front.ok")).select(F.lit("stale").alias("type"), F.lit(None).cast("string").alias("atom_id"), F.col("path").alias("source_path"), F.lit("Failed to parse").alias("message"), F.lit(None).cast("string").alias("details"))
    missing = rows.where(is_memory & ~F.col("has_front") & (F.col("filename") != "MEMORY.md"))
    diags = diags.unionByName(missing.select(F.lit("missing_frontmatter").alias("type"), atom_id(F.col("path"), F.lit(0)).alias("atom_id"), F.col("path").alias("source_path"), F.lit("No frontmatter").alias("message"), F.lit(None).cast("string").alias("details")))
    good = rows.where("front.ok")
    whole = good.where(~is_memory).select("path", F.lit(0).alias("section_index"), F.lit(None).cast("string").alias("heading"), F.col("text").alias("body"))
    parts = whole.unionByName(split_sections(good.where(is_memory).select("path", F.col("text").alias("body"))))
    j = parts.join(good.drop("text"), "path")
    stem = F.regexp_replace("filename", r"\.md$", "")
    first = F.col("section_index") == 0
    kind = X.infer_type(F.col("front.atom_type"), F.col("source_type"), F.col("filename"))
    atoms = j.select(
        atom_id(F.col("path"), F.col("section_index")).alias("id"),
        X.derive_title(F.col("heading"), F.col("front.name"), F.col("front.title"), F.col("body"), stem, F.col("section_index")).alias("title"),
        "body", kind.alias("atom_type"), X.infer_scope(kind, F.col("source_type")).alias("scope"), F.col("path").alias("source_path"), "source_type", X.path_project(F.col("path")).alias("project"),
        X.tags(F.when(first, F.col("front.tags")), F.when(first, F.col("front.keywords")), F.col("body")).alias("tags"),
        F.when(first, content_hash(F.col("raw"))).otherwise(content_hash(F.col("body"))).alias("content_hash"),
        F.when(first, F.col("front.json")).alias("frontmatter"), F.when(first, F.col("front.status")).alias("status"), F.when(first, F.col("front.priority")).alias("priority"),
        F.when(first, F.col("front.blocks")).alias("blocks"), F.when(first, F.col("front.blocked_by")).alias("blocked_by"), F.when(first, F.col("front.discovered_from")).alias("discovered_from"), "section_index",
    )
    return atoms, diags


@F.pandas_udf(T.StringType())
def resolve_path(base: pd.Series, target: pd.Series) -> pd.Series:
    """A link's target from the folder of the file that holds it."""
    import posixpath

    return pd.Series([posixpath.normpath(posixpath.join(posixpath.dirname(b), t)) for b, t in zip(base, target)])
