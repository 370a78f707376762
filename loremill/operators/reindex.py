"""Incremental re-indexing: classify changes by hash, upsert, drop what vanished, cascade."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What an update of an atom that is there leaves as it was.
KEPT = ("project", "source_path", "source_type", "created_at")


def classify(old: DataFrame, new: DataFrame) -> DataFrame:
    """id and change of every atom: created, updated, unchanged or removed."""
    o, n = old.select("id", F.col("content_hash").alias("was")), new.select("id", F.col("content_hash").alias("now"))
    change = F.when(F.col("was").isNull(), "created").when(F.col("now").isNull(), "removed").when(F.col("was") == F.col("now"), "unchanged").otherwise("updated")
    return o.join(n, "id", "full_outer").select("id", change.alias("change"))


def upsert(old: DataFrame, new: DataFrame, key: str = "id", kept: tuple[str, ...] = KEPT) -> DataFrame:
    """New rows, with the kept columns of rows that were there; old rows without a new one stay."""
    o = old.select(key, *[F.col(c).alias(f"_o_{c}") for c in old.columns if c != key], F.lit(True).alias("_was"))
    both = o.join(new.withColumn("_is", F.lit(True)), key, "full_outer")
    pick = lambda c: F.when(F.col("_was") & F.lit(c in kept), F.col(f"_o_{c}")).when(F.col("_is"), F.col(c)).otherwise(F.col(f"_o_{c}"))
    return both.select(key, *[pick(c).alias(c) for c in old.columns if c != key])


def stale_sections(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old atoms of re-read files that the new read does not have."""
    touched = new.select("source_path").distinct()
    return old.join(touched, "source_path", "left_semi").join(new.select("id"), "id", "left_anti")


def cascade_delete(rows: DataFrame, gone: DataFrame, *ends: str) -> DataFrame:
    """``rows`` without those that point at a gone atom by any of ``ends``."""
    for e in ends:
        rows = rows.join(gone.select(F.col("id").alias(e)), e, "left_anti")
    return rows


def reindex(old_atoms: DataFrame, new_atoms: DataFrame) -> DataFrame:
    """The atoms after a full read: changed and new ones upserted, vanished ones gone."""
    return upsert(old_atoms.join(new_atoms.select("id"), "id", "left_semi"), new_atoms)


def evolve(rows: DataFrame, schema_rows: DataFrame) -> DataFrame:
    """Rows of an older schema under a newer one: missing columns are null."""
    return schema_rows.where(F.lit(False)).unionByName(rows, allowMissingColumns=True)
