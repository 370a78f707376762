"""A stored inverted index: each file's postings are sorted by term, so a search reads the pages of its own words and no text.

``postings`` has a row a (term, atom) with the places of the term; places of the three columns are kept apart by a large
offset, so a phrase never runs from one into the next. ``terms`` has each distinct word once, with its stem and its
document frequency: a stemmed search asks it for the words of a stem, so stems are made of distinct words only. ``docs``
has each atom's length.

An index is a list of segments; a change of atoms adds a segment for those that are new or changed, and a list of ids that
no longer count to each segment that has them. Segments of like size are merged, and one of which half is dead is written anew, so
each segment counts more than twice the atoms of the next smaller one; lists of dead ids are kept so as well. After any number of
changes a search thus reads logarithmically many segments, and a posting is rewritten logarithmically often. Tables are written once
and never changed, so a lost task writes them again and readers of the old list are not disturbed. ``merged`` makes one segment of all.

Postings stay in the files of their atoms, a file a task, as search engines keep shards by document: building and merging shuffle no
posting but those that a long list of dead ids must meet, and a term that a third of all atoms have is in as many files as they are. Edge cases: null titles, bodies and tags have no words; an empty table gives an empty index; atoms must have distinct ids.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.porter import stem as porter_stem
from ..functions.text import tokens
from ..plans.query_language import Phrase, parse, sanitise
from ..storage import cut
from .search import COLUMNS, B, K1, LEAST_IDF, _stemmed, _truth, _used

OFFSET = 1 << 40
#: Words of one sorted block of postings, and dead ids that are broadcast at most.
BLOCK, MANY_DEAD = 1 << 21, 500_000


@F.pandas_udf(T.StringType())
def _stems(words: pd.Series) -> pd.Series:
    return words.map(porter_stem)


@dataclass
class Segment:
    """Written tables of ``n`` atoms; ``dead`` has (ids, how many) of those that later segments replace or that are gone, each once."""

    postings: DataFrame
    terms: DataFrame
    docs: DataFrame
    n: int
    dead: list[tuple[DataFrame, int]] = field(default_factory=list)

    @property
    def alive(self) -> int:
        return self.n - sum(n for _, n in self.dead)

    def live(self, rows: DataFrame) -> DataFrame:
        few = sum(n for _, n in self.dead) <= MANY_DEAD
        return reduce(lambda df, gone: df.join(F.broadcast(gone[0]) if few else gone[0], "id", "left_anti"), self.dead, rows)

    def without(self, gone: DataFrame) -> Segment:
        """The same with those of ``gone`` (id) that it has among the dead; without any it stays as it is."""
        mine = cut(self.live(self.docs.select("id")).join(gone, "id", "left_semi"), "dead")
        if not (n := mine.count()):
            return self
        both = lambda a, b: (cut(a[0].unionByName(b[0]), "dead"), a[1] + b[1])
        return replace(self, dead=_tiers([*self.dead, (mine, n)], lambda d: d[1], both))


def _tiers(items: list, size, merge) -> list:
    """Items from the largest on, merged until each is more than twice as large as the next."""
    items = sorted(items, key=size, reverse=True)
    for i in range(len(items) - 1, 0, -1):
        if size(items[i - 1]) <= 2 * size(items[i]):
            return _tiers([*items[: i - 1], merge(items[i - 1], items[i]), *items[i + 1 :]], size, merge)
    return items


def _segment(atoms: DataFrame) -> Segment:
    # one row an atom and column, so that its words are made once
    of = [F.struct(F.lit(n).alias("n"), F.coalesce(F.col(c), F.lit("")).alias("text")) for n, c in enumerate(COLUMNS)]
    if "tags_text" not in atoms.columns:
        atoms = atoms.withColumn("tags_text", F.to_json("tags") if "tags" in atoms.columns else F.lit(""))
    rows = atoms.select("id", F.col("ingest_seq").cast("long").alias("ingest_seq"), F.explode(F.array(*of)).alias("c"))
    docs = rows.select("id", "ingest_seq", F.col("c.n").alias("n"), tokens(F.col("c.text")).alias("words"))
    posts = cut(docs.mapInArrow(_postings, "term string, id string, ingest_seq long, dl int, pos array<long>"), "postings")
    # a row without a term tells an atom's length
    return _written(posts.where("term is not null"), posts.where("term is null").select("id", "dl"))


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings of whole atoms, in blocks of about ``BLOCK`` words sorted by term; an atom's rows (one a column) follow each other."""
    held: list[pa.Table] = []
    words = 0
    for b in batches:
        held.append(pa.Table.from_batches([b]))
        words += len(b.column(3).flatten())
        if words >= BLOCK:
            whole = pa.concat_tables(held)
            last = whole.num_rows - whole.num_rows % len(COLUMNS)
            yield from _block(whole.slice(0, last))
            held = [whole.slice(last)] if last < whole.num_rows else []
            words = 0
    if held:
        yield from _block(pa.concat_tables(held))


def _block(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    rows = rows.combine_chunks()
    if not rows.num_rows:
        return
    lists = rows.column("words").chunk(0)
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    atom = np.arange(rows.num_rows) // len(COLUMNS)
    ids, seqs = rows.column("id").chunk(0), rows.column("ingest_seq").chunk(0)
    firsts = pa.array(np.arange(0, rows.num_rows, len(COLUMNS)))
    length = np.add.reduceat(sizes, np.arange(0, rows.num_rows, len(COLUMNS))).astype(np.int32)
    names = ["term", "id", "ingest_seq", "dl", "pos"]
    yield pa.RecordBatch.from_arrays([pa.nulls(len(firsts), pa.string()), ids.take(firsts), seqs.take(firsts), pa.array(length), pa.nulls(len(firsts), pa.list_(pa.int64()))], names)
    found = lists.flatten().dictionary_encode()
    if not len(found):
        return
    order = pc.sort_indices(found.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    code = rank[found.indices.to_numpy(zero_copy_only=False)]
    place = np.arange(len(code)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(rows.column("n").to_numpy().astype(np.int64) * OFFSET, sizes)
    owner = np.repeat(atom, sizes)
    by = np.argsort(code, kind="stable")  # atoms and places stay in order
    code, place, owner = code[by], place[by], owner[by]
    new = np.flatnonzero(np.r_[True, (code[1:] != code[:-1]) | (owner[1:] != owner[:-1])])
    ends = np.r_[new, len(code)]
    terms = found.dictionary.take(pa.array(order))
    for at in range(0, len(new), 1 << 16):
        some = new[at : at + (1 << 16)]
        to = ends[at + len(some)]
        first = pa.array(owner[some] * len(COLUMNS))
        pos = pa.ListArray.from_arrays(pa.array(np.r_[some, to] - some[0], pa.int32()), pa.array(place[some[0] : to]))
        yield pa.RecordBatch.from_arrays([terms.take(pa.array(code[some])), ids.take(first), seqs.take(first), pa.array(length[owner[some]]), pos], names)


def _written(postings: DataFrame, docs: DataFrame) -> Segment:
    """A segment of postings that are in files already, or of a merge."""
    terms = postings.groupBy("term").agg(F.count("*").alias("df"), F.sum(F.size("pos")).alias("cf"))
    terms = cut(terms.withColumn("stem", _stems("term")).repartitionByRange("stem").sortWithinPartitions("stem"), "terms")
    lengths = cut(docs, "lengths")
    return Segment(postings, terms, lengths, lengths.count())


def _merge(*segments: Segment) -> Segment:
    """One segment of the atoms that count in ``segments``."""
    all_of = lambda name: reduce(DataFrame.unionByName, [s.live(getattr(s, name)) for s in segments])
    return _written(cut(all_of("postings").sortWithinPartitions("term"), "postings"), all_of("docs"))


@dataclass
class SearchIndex:
    """What ``search`` reads; ``columns`` of an atom come from the atoms' own table."""

    segments: list[Segment]
    #: Whether atoms may have other numbers by now than their postings tell.
    renumbered: bool = False

    @staticmethod
    def build(atoms: DataFrame) -> SearchIndex:
        return SearchIndex([_segment(atoms)])

    def updated(self, changed: DataFrame, gone: DataFrame) -> SearchIndex:
        """The index after ``changed`` atoms came in and those of ``gone`` (id) went."""
        dead = cut(changed.select("id").unionByName(gone.select("id")).distinct(), "dead")
        segments = [s.without(dead) for s in self.segments]
        segments = [s if 2 * s.alive >= s.n or not s.alive else _merge(s) for s in segments]
        new = _segment(changed)
        kept = [s for s in [*segments, new] if s.alive] or [new]
        return SearchIndex(_tiers(kept, lambda s: s.alive, _merge), True)

    def merged(self) -> SearchIndex:
        """One segment of all."""
        return SearchIndex([_merge(*self.segments)], self.renumbered)

    def _all(self, name: str, where: Column | None = None) -> DataFrame:
        parts = []
        for s in self.segments:
            rows = getattr(s, name)
            parts.append(s.live(rows if where is None else rows.where(where)))
        return reduce(DataFrame.unionByName, parts)

    def postings(self, where: Column | None = None) -> DataFrame:
        return self._all("postings", where)

    def docs(self) -> DataFrame:
        return self._all("docs")

    def terms(self) -> DataFrame:
        """``(term, df, cf)`` of the atoms that count."""
        if len(self.segments) == 1 and not self.segments[0].dead:
            return self.segments[0].terms.select("term", "df", "cf")
        return self.postings().groupBy("term").agg(F.count("*").alias("df"), F.sum(F.size("pos")).alias("cf"))

    def forms(self, stem: str) -> list[str]:
        """The words of one stem, in any segment."""
        return sorted({r["term"] for s in self.segments for r in s.terms.where(F.col("stem") == stem).select("term").collect()})

    def _word_filters(self, words: list[tuple[str, bool]], stem: bool) -> list[Column]:
        """For each (word, is it a prefix) what its postings are; only exact words of a stem are listed."""
        out = []
        for w, prefix in words:
            if prefix and stem:
                some = {r["term"] for s in self.segments for r in s.terms.where(F.col("stem").startswith(w)).select("term").collect()}
                out.append(F.col("term").isin(sorted(some)))
            elif prefix:
                out.append(F.col("term").startswith(w))
            else:
                out.append(F.col("term").isin(self.forms(w)) if stem else F.col("term") == w)
        return out

    def matches(self, raw: str, stem: bool = True, parsed: bool = False) -> DataFrame:
        """``(id, ingest_seq, rank)`` of every atom that matches."""
        q = parse(raw if parsed else sanitise(raw))
        if stem:
            q = _stemmed(q)
        used = _used(q.tree)
        spark: SparkSession = self.segments[0].docs.sparkSession
        if not used:
            return spark.createDataFrame([], "id string, ingest_seq long, rank double")
        distinct = list(dict.fromkeys(q.phrases))
        words = list(dict.fromkeys((w, p.prefix and i == len(p.words) - 1) for p in distinct for i, w in enumerate(p.words)))
        filters = self._word_filters(words, stem)
        hit = self.postings(reduce(lambda a, b: a | b, filters))
        places = [F.flatten(F.collect_list(F.when(f, F.col("pos")))).alias(f"p{n}") for n, f in enumerate(filters)]
        per = hit.groupBy("id").agg(F.first("ingest_seq").alias("ingest_seq"), F.first("dl").alias("dl"), *places)
        at = {w: F.col(f"p{n}") for n, w in enumerate(words)}
        name = {p: f"tf{i}" for i, p in enumerate(distinct)}
        counted = cut(per.select("id", "ingest_seq", "dl", *[_phrase_count(p, at).alias(name[p]) for p in distinct]), "hits")
        n_docs, sum_dl = self.docs().agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0))).first()
        seen = counted.agg(*[F.count_if(F.col(name[p]) > 0).alias(name[p]) for p in distinct]).first()
        rank, average = F.lit(0.0), sum_dl / n_docs if n_docs else 0.0
        for p in used:
            n, tf = seen[name[p]], F.col(name[p])
            idf = F.log((F.lit(n_docs) - F.lit(n) + F.lit(0.5)) / (F.lit(n) + F.lit(0.5)))
            idf = F.when(idf <= 0, F.lit(LEAST_IDF)).otherwise(idf)
            rank = rank - idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / F.lit(average)))
        return counted.where(_truth(q.tree, {p: F.col(name[p]) > 0 for p in distinct})).select("id", "ingest_seq", rank.alias("rank"))

    def search(self, atoms: DataFrame, raw: str, limit: int | None = 20, atom_type: str | None = None, scope: str | None = None, project: str | None = None, stem: bool = True, parsed: bool = False) -> DataFrame:
        """Rows of ``atoms`` that match, best (most negative) ``rank`` first, ties in ingest order.

        Statistics cover all atoms; the filters only choose among the matches. With a limit only so many rows meet the atoms.
        """
        found = self.matches(raw, stem, parsed)
        if self.renumbered:
            found = found.drop("ingest_seq").join(atoms.select("id", "ingest_seq"), "id")
        kept = atoms
        for value, column in ((atom_type, "atom_type"), (scope, "scope"), (project, "project")):
            if value:
                kept = kept.where(F.col(column) == value)
        if kept is not atoms:
            found = found.join(kept.select("id"), "id", "left_semi")
        if limit is None:
            return atoms.join(found.select("id", "rank"), "id")
        top = found.orderBy("rank", "ingest_seq").limit(limit).select("id", "rank")
        return atoms.join(F.broadcast(top), "id").orderBy("rank", "ingest_seq")

    def context(self, atoms: DataFrame, topics: list[str], project: str | None = None, per_topic: int = 5, stem: bool = True) -> DataFrame:
        """The best atoms of each topic, each once (its first topic's), best rank first, with their markdown part."""
        from .search import merged_parts

        rows = [self.search(atoms, t, per_topic, project=project, stem=stem).withColumn("topic_no", F.lit(i)) for i, t in enumerate(topics)]
        return merged_parts(atoms, rows)


def _phrase_count(p: Phrase, at: dict[tuple[str, bool], Column]) -> Column:
    """How often a phrase stands in an atom: its first word's places that the other words follow."""
    last = len(p.words) - 1
    columns = [at[w, p.prefix and i == last] for i, w in enumerate(p.words)]
    if not last:
        return F.size(columns[0])

    # places are distinct, so those that all words share, moved back to the first, are as many as the phrases
    back = lambda i: lambda x: x - F.lit(i)
    return F.size(reduce(F.array_intersect, [F.transform(c, back(i)) for i, c in enumerate(columns)]))
