"""The functions a user calls, over tables of atoms, links, sessions and diagnostics."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .model import TASK_STATUSES, atom_id
from .operators import atoms as A
from .operators import links as L
from .operators import reindex as R
from .operators import search as S
from .operators import sessions as SS
from .operators import tasks as T
from .operators.index import SearchIndex
from .storage import cut
from .sources.files import Roots, file_changes, note_files, parse_notes, read_notes, resolve_path, transcript_lines, transcript_tails
from .sources.transcripts import desktop_sessions, project_sessions, session_metadata


class BadRequest(ValueError):
    """An argument that the interface does not take."""


class NotFound(LookupError):
    """No row with that id."""


@dataclass
class Knowledge:
    """The hub's tables and what can be asked of them; methods return DataFrames, nothing on disk is changed."""

    atoms: DataFrame
    links: DataFrame
    sessions: DataFrame | None = None
    diagnostics: DataFrame | None = None
    #: A stored index of ``atoms``; without one each search reads the texts.
    index: SearchIndex | None = None
    #: What the last ``reindex`` did: change (created, updated, unchanged, removed) and n.
    run: DataFrame | None = None
    #: The inferred links between atoms, by which the next ``reindex`` decides only those of changed atoms.
    pairs: DataFrame | None = None
    #: The listing of the files that ``atoms`` come from, by which the next ``reindex`` opens only those that changed.
    files: DataFrame | None = None
    #: path and change (added, changed, same, gone) of the files that the last ``reindex`` met.
    read: DataFrame | None = None

    def indexed(self) -> Knowledge:
        """The same with a stored search index."""
        return replace(self, index=SearchIndex.build(self.atoms))

    # --- search and context ---
    def search(self, q: str, project: str | None = None, type: str | None = None, scope: str | None = None, limit: int = 20) -> DataFrame:
        if not q or not q.strip():
            raise BadRequest("q is missing")
        search = self.index.search if self.index else S.search
        found = search(self.atoms, q, limit, atom_type=type, scope=scope, project=project)
        out = S.with_snippets(found, q)
        return out.select("id", F.col("source_path").alias("path"), F.coalesce("project", F.lit("global")).alias("project"), "title", F.col("atom_type").alias("type"), "snippet", F.col("rank").alias("score")).orderBy("score")

    def context(self, topics: list[str], project: str | None = None) -> DataFrame:
        return self.index.context(self.atoms, topics, project) if self.index else S.context(self.atoms, topics, project)

    def shared_knowledge(self) -> DataFrame:
        return A.shared_knowledge(self.atoms)

    def project_context(self, project: str) -> DataFrame:
        return A.project_context(self.atoms, project)

    @staticmethod
    def merged(parts: DataFrame) -> str | None:
        """The markdown of a bounded answer, read part by part; None without any."""
        texts = [r["part"] for r in parts.select("part").toLocalIterator()]
        return "\n\n---\n\n".join(texts) or None

    # --- atoms and links ---
    def list_atoms(self, type: str | None = None, scope: str | None = None, project: str | None = None) -> DataFrame:
        return A.shown(A.list_atoms(self.atoms, type, scope, project))

    def atom(self, id: str) -> DataFrame:
        found = self.atoms.where(F.col("id") == id)
        if not found.head(1):
            raise NotFound(id)
        return found

    def atom_raw(self, id: str) -> DataFrame:
        """The whole file that an atom comes from, as it is on disk: id and raw."""
        path = self.atom(id).select("source_path").first()[0]
        return self.atoms.sparkSession.read.text(path, wholetext=True).select(F.lit(id).alias("id"), F.col("value").alias("raw"))

    def atom_links(self, id: str) -> DataFrame:
        mine = self.links.where((F.col("source_id") == id) | (F.col("target_id") == id))
        return L.touching(mine, self.atoms.select("id", "title")).where(F.col("id") == id).orderBy("link_type", F.desc("confidence"))

    def projects(self) -> DataFrame:
        return A.projects(self.atoms)

    def without_project(self, project: str) -> Knowledge:
        keep = lambda df: df.where(~F.coalesce(F.col("project") == project, F.lit(False)))
        gone = self.atoms.where(F.col("project") == project).select("id")
        left = self._without(gone, keep(self.atoms), self.diagnostics)
        return replace(left, sessions=keep(self.sessions) if self.sessions is not None else None)

    def without_path(self, path: str) -> Knowledge:
        """Without the atoms of a file that is gone, and all that points at them."""
        gone = self.atoms.where(F.col("source_path") == path).select("id")
        diags = self.diagnostics.where(~F.coalesce(F.col("source_path") == path, F.lit(False))) if self.diagnostics is not None else None
        return self._without(gone, self.atoms.where(~F.coalesce(F.col("source_path") == path, F.lit(False))), diags)

    def without_atom(self, id: str) -> Knowledge:
        gone = self.atom(id).select("id")
        return self._without(gone, self.atoms.where(F.col("id") != id), self.diagnostics)

    def _without(self, gone: DataFrame, atoms: DataFrame, diagnostics: DataFrame | None) -> Knowledge:
        """``atoms`` are those that stay; links, pairs, diagnostics and the index lose ``gone`` (id)."""
        linked = lambda df: None if df is None else R.cascade_delete(df, gone, "source_id", "target_id")
        index = self.index.updated(self.atoms.where(F.lit(False)), gone) if self.index else None
        return replace(self, atoms=atoms, links=linked(self.links), pairs=linked(self.pairs), diagnostics=self._diagnosed(diagnostics, gone), index=index)

    @staticmethod
    def _diagnosed(diagnostics: DataFrame | None, gone: DataFrame) -> DataFrame | None:
        """``diagnostics`` without those of gone atoms."""
        return None if diagnostics is None else diagnostics.join(gone.select(F.col("id").alias("atom_id")), "atom_id", "left_anti").select(*diagnostics.columns)

    def with_body(self, id: str, body: str) -> Knowledge:
        """With another body of an atom; ``reindex`` keeps it until the atom's file changes. The index takes it in."""
        if body is None:
            raise BadRequest("body is missing")
        self.atom(id)
        atoms = self.atoms.withColumn("body", F.when(F.col("id") == id, F.lit(body)).otherwise(F.col("body")))
        index = self.index.updated(atoms.where(F.col("id") == id), self.atoms.where(F.lit(False)).select("id")) if self.index else None
        return replace(self, atoms=atoms, index=index, pairs=None)

    def remember(self, rows: DataFrame, folder: str = "memory") -> DataFrame:
        """New memory atoms from rows of title, body, scope and project; file names get a number when taken, by atoms that are there too."""
        there = F.regexp_extract("source_path", f"^{re.escape(folder)}/([^/]*)\\.md$", 1)
        taken = self.atoms.select(F.nullif(there, F.lit("")).alias("file")).where("file is not null")
        named = A.slug_collisions(rows.withColumn("_n", F.monotonically_increasing_id()), order="_n", taken=taken)
        path = F.concat(F.lit(folder + "/"), "file", F.lit(".md"))
        return named.withColumn("source_path", path).withColumns({"id": atom_id(F.col("source_path"), F.lit(0)), "content_hash": F.left(F.sha2("body", 256), F.lit(16)), "atom_type": F.lit("memory"), "source_type": F.lit("native")}).drop("_n", "nth", "slug", "file")

    # --- tasks ---
    def _tasks(self) -> DataFrame:
        return self.atoms.where("atom_type = 'task'")

    def tasks(self, project: str | None = None, status: str | None = None, priority: int | None = None, include_done: bool = False) -> DataFrame:
        if status and status not in TASK_STATUSES:
            raise BadRequest(f"no such status: {status}")
        out = T.list_tasks(self._tasks(), project, status, priority, include_done)
        return out.withColumns({"project": F.coalesce("project", F.lit("")), "summary": F.left("body", F.lit(120))})

    def create_tasks(self, rows: DataFrame, folder: str = "tasks") -> DataFrame:
        """Task atoms from rows of title, body and optional project, priority, blocked_by; priority 1 to 3."""
        if not rows.head(1):
            raise BadRequest("at least one task is needed")
        if "priority" in rows.columns and rows.where("priority not between 1 and 3").head(1):
            raise BadRequest("priority is 1 to 3")
        out = self.remember(rows, folder).withColumn("atom_type", F.lit("task")).withColumn("status", F.lit("ready"))
        return out if "priority" in out.columns else out.withColumn("priority", F.lit(2).cast("long"))

    def update_task(self, id: str, status: str, child: dict | None = None) -> DataFrame:
        if status not in TASK_STATUSES:
            raise BadRequest(f"no such status: {status}")
        if not self._tasks().where(F.col("id") == id).head(1):
            raise NotFound(id)
        spark = self.atoms.sparkSession
        kids = None
        if child:
            if not child.get("title"):
                raise BadRequest("title is missing")
            made = self.create_tasks(spark.createDataFrame([(child["title"], child.get("body", ""))], "title string, body string"))
            kids = made.select("id", "title", "body", "atom_type", "source_path", "status", F.lit(id).alias("discovered_from"))
        return T.update(self._tasks(), spark.createDataFrame([(id, status)], "id string, new_status string"), kids)

    # --- sessions ---
    def list_sessions(self, project: str | None = None, status: str | None = None) -> DataFrame:
        return SS.list_sessions(self.sessions, project, status)

    def session(self, id: str) -> DataFrame:
        found = self.sessions.where(F.col("session_id") == id)
        if not found.head(1):
            raise NotFound(id)
        return SS.display(found)

    def renamed(self, id: str, title: str) -> DataFrame:
        if not title:
            raise BadRequest("title is missing")
        self.session(id)
        return self.sessions.withColumn("custom_title", F.when(F.col("session_id") == id, F.lit(title)).otherwise(F.col("custom_title")))

    def live(self, lines: DataFrame | None, now: str) -> DataFrame:
        """Sessions with the status that their transcripts' tails show at ``now``; ``lines``: path, line_no, raw.

        Without ``lines`` the last bytes of each session's transcript are read, and nothing before them.
        """
        if lines is None:
            lines = transcript_tails(self.sessions.where("jsonl_path is not null").select(F.col("jsonl_path").alias("path")).distinct())
        return SS.refresh(self.sessions, SS.status(lines, now).withColumnRenamed("path", "jsonl_path"))

    def without_session(self, id: str) -> DataFrame:
        return self.sessions.where(F.col("session_id") != id)

    def session_references(self, id: str) -> DataFrame:
        return self.atoms.where(F.try_variant_get(F.try_parse_json("frontmatter"), "$.source_session_id", "string") == id)

    def messages(self, transcript: str) -> DataFrame:
        return SS.messages(transcript_lines(self.atoms.sparkSession, transcript)).orderBy("line_no")

    # --- health and numbers ---
    def diagnose(self, type: str | None = None) -> DataFrame:
        d = self.diagnostics
        return d.where(F.col("type") == type) if type else d.orderBy("type")

    def stats(self) -> dict[str, DataFrame]:
        d = {"by_type": A.counts(self.atoms, "atom_type"), "by_scope": A.counts(self.atoms, "scope"), "by_project": A.by_project(self.atoms)}
        tables = {"atoms": self.atoms, "links": self.links, "sessions": self.sessions, "diagnostics": self.diagnostics}
        d["totals"] = A.total_rows(**{name: df for name, df in tables.items() if df is not None})
        return d | ({"diagnostics": A.counts(self.diagnostics, "type")} if self.diagnostics is not None else {})

    def dashboard(self) -> DataFrame:
        return A.dashboard(self.sessions, self.atoms)


def reindex(spark, roots: Roots, old: Knowledge | None = None, now: str = "1970-01-01 00:00:00", desktop_root: str | None = None, metadata: DataFrame | str | None = None, quiet_ms: int = 0) -> Knowledge:
    """Bring atoms, links, diagnostics and sessions up to date with all sources; ``run`` tells what changed.

    Of the notes only files are opened that differ from the listing of ``old`` (``file_changes``; ``quiet_ms`` leaves files alone that
    were written just now); atoms of the others stay as they are in ``old``, edited and deleted ones too. New
    atoms are created at ``now``, changed ones updated at ``now``; atoms of the same content keep their times, and those
    that are gone go with their links. A stored index of ``old`` gets a segment for the changes only. ``desktop_root`` has
    desktop-app sessions, ``metadata`` titles for sessions without one: rows (session_id, first_user_message, total_tokens) or
    the path of a file for ``session_metadata``.
    """
    from .functions.text import link_targets

    files = note_files(spark, roots)
    known = old.files if old is not None and old.files is not None else None
    read = cut(file_changes(known if known is not None else files.where(F.lit(False)), files, quiet_ms), "files")
    files = read.where("change <> 'gone'").drop("change")
    raw = cut(read_notes(read.where("change in ('added', 'changed')")), "raw")
    atoms, diags = parse_notes(raw)
    if known is not None:
        same = read.where("change = 'same'").select(F.col("path").alias("source_path"))
        atoms = atoms.unionByName(old.atoms.select(*atoms.columns).join(same, "source_path", "left_semi"))
        if old.diagnostics is not None:
            diags = diags.unionByName(old.diagnostics.where("type in ('stale', 'missing_frontmatter')").join(same, "source_path", "left_semi").select(*diags.columns))
    # increasing in path order without bringing all rows to one task: range-sorted, then numbered by partition and place
    atoms = atoms.orderBy("source_path", "section_index").withColumn("ingest_seq", F.monotonically_increasing_id())
    atoms = atoms.withColumns({"created_at": F.lit(now), "updated_at": F.lit(now)})
    if old is not None:
        before = old.atoms.select("id", F.col("content_hash").alias("_was"), F.col("updated_at").alias("_at"))
        atoms = atoms.join(before, "id", "left").withColumn("updated_at", F.when(F.col("_was") == F.col("content_hash"), F.col("_at")).otherwise(F.col("updated_at"))).drop("_was", "_at")
        atoms = R.upsert(old.atoms.select(*atoms.columns).join(atoms.select("id"), "id", "left_semi"), atoms)
    atoms, diags = cut(atoms, "atoms"), cut(diags, "diagnostics")
    changes = cut(R.classify(old.atoms if old is not None else atoms.where(F.lit(False)), atoms), "changes")
    targets = atoms.select(F.col("id").alias("source_id"), "source_path", F.explode(link_targets(F.col("body"))).alias("t")).select("source_id", resolve_path("source_path", "t").alias("path"))
    targets = cut(targets, "targets")
    explicit = L.resolve(targets, atoms)
    gone = L.broken(targets, files.select("path"))
    orphan = L.orphans(atoms, explicit)
    diags = diags.unionByName(gone.select(F.lit("broken_reference").alias("type"), F.col("source_id").alias("atom_id"), F.lit(None).cast("string").alias("source_path"), F.concat(F.lit("Missing: "), "path").alias("message"), F.lit(None).cast("string").alias("details")))
    diags = diags.unionByName(orphan.select(F.lit("orphan").alias("type"), F.col("id").alias("atom_id"), "source_path", F.concat(F.lit("No links: "), "title").alias("message"), F.lit(None).cast("string").alias("details")))
    diags = diags.unionByName(A.duplicates(atoms).withColumn("details", F.lit(None).cast("string")))
    if old is not None and old.pairs is not None:
        pairs = L.infer_changed(old.pairs, atoms, cut(L.unlike(old.atoms, atoms), "unlike"))
    else:
        pairs = L.infer_pairs(atoms)
    pairs = cut(pairs, "pairs")
    inferred = L.extends_chain(atoms).unionByName(pairs)
    both = explicit.withColumn("prio", F.lit(0)).unionByName(inferred.withColumn("prio", F.lit(1)))
    sessions = project_sessions(spark, roots)
    if old is not None and old.sessions is not None:
        sessions = SS.upsert(R.evolve(old.sessions, sessions), sessions)
    if desktop_root:
        sessions = SS.upsert(sessions, desktop_sessions(spark, desktop_root))
    if isinstance(metadata, str):
        metadata = session_metadata(spark, metadata)
    if metadata is not None:
        sessions = SS.import_titles(sessions, metadata)
    sessions = SS.backfill_titles(sessions)
    index = None
    if old is not None and old.index is not None:
        changed = atoms.join(changes.where("change in ('created', 'updated')"), "id", "left_semi")
        index = old.index.updated(changed, changes.where("change = 'removed'").select("id"))
    links = L.insert_or_ignore(both, "prio").select("source_id", "target_id", "link_type", "confidence")
    return Knowledge(atoms, links, cut(sessions, "sessions"), diags, index, A.counts(changes, "change"), pairs, files, read)
