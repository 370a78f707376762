"""Atom lists, shared and project knowledge, projects, statistics and text reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import slug


def list_atoms(atoms: DataFrame, atom_type: str | None = None, scope: str | None = None, project: str | None = None) -> DataFrame:
    """Atoms by optional equality filters (an empty one is none), by project (nulls first), type and title."""
    for value, column in ((atom_type, "atom_type"), (scope, "scope"), (project, "project")):
        if value:
            atoms = atoms.where(F.col(column) == value)
    return atoms.orderBy(F.asc_nulls_first("project"), "atom_type", "title")


def shown(atoms: DataFrame) -> DataFrame:
    """As answers show atoms: a null project reads global."""
    return atoms.withColumn("project", F.coalesce("project", F.lit("global")))


def badge(scope: Column) -> Column:
    return F.when(scope == "global", "[GLOBAL]").when(scope == "shared", "[SHARED]").otherwise("")


def shared_knowledge(atoms: DataFrame) -> DataFrame:
    """Global and shared atoms with their markdown part, by scope, type and title; parts are joined by the reader."""
    part = F.concat(F.lit("## "), "title", F.lit(" "), badge(F.col("scope")), F.lit("\n_Type: "), "atom_type", F.lit("_\n\n"), "body")
    return atoms.where(F.col("scope").isin("global", "shared")).withColumn("part", part).orderBy("scope", "atom_type", "title")


def project_context(atoms: DataFrame, project: str) -> DataFrame:
    """A project's atoms with their markdown part, by type and title."""
    part = F.concat(F.lit("## "), "title", F.lit("\n_Type: "), "atom_type", F.lit(" | Scope: "), "scope", F.lit("_\n\n"), "body")
    return atoms.where(F.col("project") == project).withColumn("part", part).orderBy("atom_type", "title")


def projects(atoms: DataFrame) -> DataFrame:
    return atoms.select(F.coalesce("project", F.lit("global")).alias("name")).distinct().orderBy("name")


def counts(df: DataFrame, column: str, name: str | None = None) -> DataFrame:
    """Rows a value of ``column``."""
    return df.groupBy(F.col(column).alias(name or column)).agg(F.count("*").alias("n"))


def by_project(atoms: DataFrame) -> DataFrame:
    """Atoms a project; the raw column is grouped, so null and a project named global stay apart."""
    return atoms.groupBy("project").agg(F.count("*").alias("n")).select(F.coalesce("project", F.lit("global")).alias("project"), "n")


def totals(**tables: DataFrame) -> DataFrame:
    """One row with the number of rows of each table."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias(name))
        out = one if out is None else out.crossJoin(one)  # one row each
    return out


def total_rows(**tables: DataFrame) -> DataFrame:
    """A row a table with its number of rows."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.lit(name).alias("name"), F.count("*").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


def group_by_project(atoms: DataFrame) -> DataFrame:
    """Atoms and their types a project."""
    return atoms.groupBy(F.coalesce("project", F.lit("global")).alias("project")).agg(F.count("*").alias("n"), F.count_distinct("atom_type").alias("types"), F.min("title").alias("first_title"))


def dashboard(sessions: DataFrame, atoms: DataFrame) -> DataFrame:
    """Projects that have sessions: their number, last activity, and the project's atoms (0 without any)."""
    s = sessions.groupBy("project").agg(F.count("*").alias("sessions"), F.max("last_active").alias("last_active"))
    m = atoms.groupBy("project").agg(F.count("*").alias("memories"))
    return s.join(m, "project", "left").select("project", "sessions", F.coalesce("last_active", F.lit("")).alias("last_active"), F.coalesce("memories", F.lit(0)).alias("memories"))


def stats_report(atoms: DataFrame) -> DataFrame:
    """One text: total, then counts by type and by scope, most first."""

    def listed(column: str) -> DataFrame:
        per = counts(atoms, column, "v")
        item = F.struct((-F.col("n")).alias("o"), F.col("v"), F.concat("v", F.lit("("), "n", F.lit(")")).alias("s"))
        return per.agg(F.array_join(F.transform(F.sort_array(F.collect_list(item)), lambda x: x["s"]), ", ").alias(column))  # a row an enumeration value

    one = atoms.agg(F.count("*").alias("n")).crossJoin(listed("atom_type")).crossJoin(listed("scope"))
    return one.select(F.concat(F.lit("Total Atoms: "), "n", F.lit("\nBy Type: "), "atom_type", F.lit("\nBy Scope: "), "scope").alias("report"))


def duplicates(atoms: DataFrame) -> DataFrame:
    """Diagnostics for atoms with the same content: all but the first of each hash, naming the first."""
    groups = atoms.groupBy("content_hash").agg(F.min("ingest_seq").alias("first_seq"), F.count("*").alias("copies")).where("copies > 1")
    return atoms.join(groups, "content_hash").where("ingest_seq <> first_seq").select(F.lit("duplicate").alias("type"), F.col("id").alias("atom_id"), "source_path", F.concat(F.lit("Same content as "), F.col("first_seq").cast("string")).alias("message"))


def slug_collisions(rows: DataFrame, title: str = "title", order: str = "ingest_seq", within: tuple[str, ...] = (), taken: DataFrame | None = None) -> DataFrame:
    """File names for titles: the first of a slug takes it, later ones add _2, _3 and so on, past the names of ``taken`` (file).

    The k-th new name of a slug gets the k-th number that is free: k and as many more as there are taken numbers below, which is
    how many of the taken numbers, less their own place among them, are not above k. Nulls have no name.
    """
    from pyspark.sql import Window

    s = rows.withColumn("slug", slug(F.col(title)))
    nth = F.row_number().over(Window.partitionBy(*within, "slug").orderBy(order))
    s = s.withColumn("nth", nth)
    if taken is not None:
        part = lambda n: F.regexp_extract("file", r"^(.*)_([2-9]|[1-9][0-9]{1,8})$", n)
        # a name is number 1 of itself, and a_3 is number 3 of a
        names = F.array(F.struct(F.col("file").alias("slug"), F.lit(1).alias("no")), F.struct(part(1).alias("slug"), F.try_to_number(part(2), F.lit("999999999")).cast("int").alias("no")))
        known = taken.select(F.inline(names)).where("no is not null").join(s.select("slug").distinct(), "slug", "left_semi").distinct()
        gaps = known.groupBy("slug").agg(F.sort_array(F.collect_list("no")).alias("t")).select("slug", F.transform("t", lambda x, i: x - i).alias("gaps"))
        s = s.join(gaps, "slug", "left").withColumn("nth", F.col("nth") + F.coalesce(F.size(F.filter("gaps", lambda g: g <= F.col("nth"))), F.lit(0))).drop("gaps")
    return s.withColumn("file", F.when(F.col("nth") == 1, F.col("slug")).otherwise(F.concat_ws("_", "slug", F.col("nth").cast("string"))))
