"""Ranked full-text search over atoms: boolean trees of phrases and prefixes, BM25, snippets.

A query's phrases are counted in each atom by array functions over its tokens, in the same pass that filters, so
nothing but the matching atoms is ever shuffled; three sums (documents, tokens, documents a phrase) make a one-row
table that every task gets. Top-k is a bounded heap a task. With ``stem`` the tokens pass a cached Porter
stemmer in an Arrow function. This is the way without an index, one pass a search; ``operators.index`` answers the same from stored postings.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.porter import stem as porter_stem
from ..functions.text import let, tokens
from ..plans.query_language import Op, Phrase, Query, parse, sanitise

K1, B = 1.2, 0.75
LEAST_IDF = 1e-6
COLUMNS = ("title", "body", "tags_text")


@F.pandas_udf(T.ArrayType(T.StringType()))
def stem_tokens(words: pd.Series) -> pd.Series:
    return words.map(lambda ws: [porter_stem(w) for w in ws])


def tokenised(atoms: DataFrame, stem: bool = False) -> DataFrame:
    """``atoms`` with a token array ``tok_<column>`` for each indexed column and ``dl``, their total length."""
    if "tags_text" not in atoms.columns:
        atoms = atoms.withColumn("tags_text", F.to_json("tags") if "tags" in atoms.columns else F.lit(""))
    for c in COLUMNS:
        t = tokens(F.col(c))
        atoms = atoms.withColumn(f"tok_{c}", stem_tokens(t) if stem else t)
    return atoms.withColumn("dl", sum((F.size(f"tok_{c}") for c in COLUMNS), F.lit(0)))


def _hits(tok: Column, p: Phrase) -> Column:
    """How often a phrase stands in a token array."""
    n = len(p.words)
    last = p.words[-1]
    if n == 1:
        return F.size(F.filter(tok, lambda t: t.startswith(last) if p.prefix else t == last))

    def count(words: Column) -> Column:
        def here(i: Column) -> Column:
            ok = F.lit(True)
            for k, w in enumerate(p.words):
                t = F.get(words, i + k)
                ok = ok & (t.startswith(w) if p.prefix and k == n - 1 else t == w)
            return ok

        return F.when(F.size(words) >= n, F.size(F.filter(F.sequence(F.lit(0), F.size(words) - n), here))).otherwise(F.lit(0))

    return let(tok, count)


def _truth(tree: object, at: dict[Phrase, Column]) -> Column:
    if isinstance(tree, Phrase):
        return at[tree] if tree.words else F.lit(False)
    a, b = _truth(tree.left, at), _truth(tree.right, at)
    return {"and": lambda: a & b, "or": lambda: a | b, "not": lambda: a & ~b}[tree.kind]()


def _used(tree: object) -> list[Phrase]:
    """Phrases that can add to a rank, in query order, repeats kept: those under the right of NOT are left out."""
    if isinstance(tree, Phrase):
        return [tree] if tree.words else []
    return _used(tree.left) + ([] if tree.kind == "not" else _used(tree.right))


def _stemmed(q: Query) -> Query:
    def go(t: object) -> object:
        if isinstance(t, Phrase):
            return Phrase(tuple(porter_stem(w) for w in t.words), t.prefix)
        return Op(t.kind, go(t.left), go(t.right))

    return Query(go(q.tree), [go(p) for p in q.phrases])


def search(atoms: DataFrame, raw: str, limit: int | None = 20, atom_type: str | None = None, scope: str | None = None, project: str | None = None, stem: bool = True, order: str = "ingest_seq", parsed: bool = False) -> DataFrame:
    """Atoms that match, best (most negative) ``rank`` first, ties by ``order``.

    Statistics cover all atoms; the filters only choose among the matches. ``parsed`` takes ``raw`` as already sanitised.
    """
    q = parse(raw if parsed else sanitise(raw))
    if stem:
        q = _stemmed(q)
    docs = tokenised(atoms, stem)
    used = _used(q.tree)
    if not used:
        return atoms.where(F.lit(False)).withColumn("rank", F.lit(0.0))
    distinct = list(dict.fromkeys(q.phrases))
    name = {p: f"tf{i}" for i, p in enumerate(distinct)}
    keep = [c for c in docs.columns if not c.startswith("tok_")]
    counted = docs.select(*keep, *[sum((_hits(F.col(f"tok_{c}"), p) for c in COLUMNS), F.lit(0)).alias(name[p]) for p in distinct])
    stats = counted.agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avg_dl"), *[F.count_if(F.col(name[p]) > 0).alias(f"n_{name[p]}") for p in distinct])
    hit = counted.where(_truth(q.tree, {p: F.col(name[p]) > 0 for p in distinct}))
    for value, column in ((atom_type, "atom_type"), (scope, "scope"), (project, "project")):
        if value:
            hit = hit.where(F.col(column) == value)
    joined = hit.crossJoin(F.broadcast(stats))  # one row
    rank = F.lit(0.0)
    for p in used:
        n = F.col(f"n_{name[p]}")
        idf = F.log((F.col("n_docs") - n + 0.5) / (n + 0.5))
        idf = F.when(idf <= 0, F.lit(LEAST_IDF)).otherwise(idf)
        tf = F.col(name[p])
        rank = rank - idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / F.col("avg_dl")))
    out = joined.withColumn("rank", rank).drop(*[name[p] for p in distinct], *[f"n_{name[p]}" for p in distinct], "n_docs", "avg_dl", "dl")
    return out if limit is None else out.orderBy("rank", order).limit(limit)


def merged_parts(atoms: DataFrame, found: list[DataFrame]) -> DataFrame:
    """Answers to several topics as one: each atom once, under its first topic, best rank first, with its markdown part."""
    rows = None
    for r in found:
        rows = r if rows is None else rows.unionByName(r)
    if rows is None:
        rows = atoms.where(F.lit(False)).withColumns({"rank": F.lit(0.0), "topic_no": F.lit(0)})
    first = rows.groupBy("id").agg(F.min_by(F.struct(*[c for c in rows.columns if c != "id"]), "topic_no").alias("r")).select("id", "r.*")
    badge = F.when(F.col("scope") == "global", "[GLOBAL]").when(F.col("scope") == "shared", "[SHARED]").otherwise("")
    part = F.concat(F.lit("## "), "title", F.lit(" "), badge, F.lit("\n_Source: "), F.coalesce("project", F.lit("global")), F.lit(" | "), "atom_type", F.lit("_\n\n"), "body")
    return first.withColumn("part", part).orderBy("rank", "ingest_seq")


def context(atoms: DataFrame, topics: list[str], project: str | None = None, per_topic: int = 5, stem: bool = True, order: str = "ingest_seq") -> DataFrame:
    """The best atoms of each topic without an index."""
    return merged_parts(atoms, [search(atoms, t, per_topic, project=project, stem=stem, order=order).withColumn("topic_no", F.lit(i)) for i, t in enumerate(topics)])


def term_statistics(atoms: DataFrame) -> DataFrame:
    """``(term, df, cf)`` over all columns: documents and occurrences."""
    docs = tokenised(atoms)
    every = F.concat(*[F.col(f"tok_{c}") for c in COLUMNS])
    each = docs.select("id", F.explode(every).alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf"))
    return each.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def make_snippet(body: str, words: list[tuple[tuple[str, ...], bool]], stem: bool, size: int = 40, marks: tuple[str, str] = ("<mark>", "</mark>"), more: str = "...") -> str:
    """A window of ``size`` tokens of ``body`` with its phrases marked.

    Windows are scored by distinct phrases first (1000 each), then a start at the body's or a sentence's begin (120 and
    100), then repeats (1 each); the first best one is shown.
    """
    import re

    from ..plans.query_language import fold_words

    spans, folded = [], []
    for m in re.finditer(r"[^\W_]+", body or ""):
        w = "".join(fold_words(m.group())) or m.group().lower()
        spans.append(m.span())
        folded.append(porter_stem(w) if stem else w)
    n = len(folded)
    if not n:
        return body or ""
    hits = []
    for x, (ws, prefix) in enumerate(words):
        for i in range(n - len(ws) + 1):
            got = folded[i : i + len(ws)]
            if list(ws[:-1]) == got[:-1] and (got[-1].startswith(ws[-1]) if prefix else got[-1] == ws[-1]):
                hits.append((i, i + len(ws), x))
    hits.sort()
    starts = {0: 120}
    for i in range(1, n):
        gap = body[spans[i - 1][1] : spans[i][0]]
        if re.search(r"[.:]\s", gap):
            starts[i] = 100
    options = {0}
    for i, j, _ in hits:
        for end in {j, max(y for x, y, _ in hits if x >= i and y <= max(j, i + size))}:  # the hit alone, and all that fit with it
            options.add(max(0, min(n - size, i - (size - (end - i)) // 2)) if n > size else 0)
        options.update(s for s in starts if s <= i and j <= s + size)
    best, at = None, 0
    for s in sorted(options):
        inside = [x for i, j, x in hits if s <= i and j <= s + size]
        score = 1000 * len(set(inside)) + starts.get(s, 0) + len(inside) - len(set(inside))
        if best is None or score > best:
            best, at = score, s
    end = min(n, at + size)
    out, pos = (more if at > 0 else ""), (0 if at == 0 else spans[at][0])
    done = at
    for i, j, _ in hits:
        if i < done or j > end:
            continue
        out += body[pos : spans[i][0]] + marks[0] + body[spans[i][0] : spans[j - 1][1]] + marks[1]
        pos, done = spans[j - 1][1], j
    return out + (body[pos:] if end == n else body[pos : spans[end - 1][1]] + more)


def with_snippets(found: DataFrame, raw: str, stem: bool = True, size: int = 40) -> DataFrame:
    """``found`` with a ``snippet`` of its body; only the rows that are shown pass through Python."""
    q = parse(sanitise(raw))
    q = _stemmed(q) if stem else q
    words = [(p.words, p.prefix) for p in dict.fromkeys(q.phrases)]

    @F.pandas_udf("string")
    def run(bodies: pd.Series) -> pd.Series:
        return bodies.map(lambda b: make_snippet(b, words, stem, size))

    return found.withColumn("snippet", run("body"))
