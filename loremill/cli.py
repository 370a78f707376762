"""The command line: ``python -m loremill.cli --root FOLDER COMMAND``."""

from __future__ import annotations

import argparse
import re
from collections.abc import Sequence

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .api import Knowledge, reindex
from .sources.files import Roots
from .streaming.jobs import follow


def arguments() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="loremill")
    p.add_argument("--root", required=True)
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("index")
    s = sub.add_parser("search")
    s.add_argument("query")
    s.add_argument("--project")
    s.add_argument("--type")
    s.add_argument("--scope")
    s.add_argument("--limit", type=int, default=10)
    c = sub.add_parser("context")
    c.add_argument("topics", nargs="+")
    c.add_argument("--project")
    li = sub.add_parser("list")
    li.add_argument("--type")
    li.add_argument("--scope")
    li.add_argument("--project")
    h = sub.add_parser("health")
    h.add_argument("--type")
    sub.add_parser("stats")
    se = sub.add_parser("sessions")
    se.add_argument("--project")
    se.add_argument("--status")
    se.add_argument("--limit", type=int, default=20)
    w = sub.add_parser("watch")
    w.add_argument("--every", default="60 seconds")
    return p


def marked(text: str) -> str:
    """A snippet's marks as asterisks."""
    return re.sub(r"</?mark>", "*", text or "")


def lines(k: Knowledge, a: argparse.Namespace) -> list[str]:
    """What a command prints; answers here are limited or a row a group."""
    if a.command == "index":
        return [f"atoms {k.atoms.count()}", f"links {k.links.count()}", f"sessions {k.sessions.count()}", *(f"{r['type']} {r['n']}" for r in k.stats()["diagnostics"].collect())]
    if a.command == "search":
        return [f"{r['title']} [{r['type']}] {r['project']}\n  {marked(r['snippet'])}" for r in k.search(a.query, a.project, a.type, a.scope, a.limit).collect()] or ["No results found."]
    if a.command == "context":
        return [Knowledge.merged(k.context(a.topics, a.project)) or "No results found."]
    if a.command == "list":
        return [f"{r['project']} {r['atom_type']} {r['title']}" for r in k.list_atoms(a.type, a.scope, a.project).toLocalIterator()]
    if a.command == "health":
        return [f"[{r['type']}] {r['message']}" for r in k.diagnose(a.type).toLocalIterator()]
    if a.command == "stats":
        return [f"{name}: {r[0]} {r['n']}" for name, df in k.stats().items() for r in df.orderBy(F.desc("n")).collect()]
    found = k.list_sessions(a.project, a.status)
    return [f"{found.count()} sessions", *(f"[{r['status']}] {r['project']} {(r['last_active'] or 'unknown')[:10]} {r['title'] or ''}" for r in found.limit(a.limit).collect())]


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> list[str]:
    a = arguments().parse_args(argv)
    spark = spark or SparkSession.builder.appName("loremill").getOrCreate()
    if a.command == "watch":
        shown = lambda k: print(*(f"{r['change']} {r['n']}" for r in k.run.orderBy("change").collect()))
        known = reindex(spark, Roots(a.root))
        shown(known)
        q = follow(spark, Roots(a.root), known, shown, a.every)
        q.awaitTermination()
        return []
    out = lines(reindex(spark, Roots(a.root)), a)
    print(*out, sep="\n")
    return out


if __name__ == "__main__":
    main()
