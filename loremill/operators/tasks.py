"""Tasks: effective status by dependencies, lists, boards and updates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def effective(tasks: DataFrame, among: DataFrame | None = None) -> DataFrame:
    """``tasks`` with ``effective_status``: done and in_progress stay; any blocker that is not done, or not among the
    given tasks, blocks; else the stored status, or ready. One level only. ``blocked_by`` is an array of ids."""
    pool = (tasks if among is None else among).select(F.col("id").alias("dep"), F.col("status").alias("dep_status"), F.lit(True).alias("there"))
    open_ = tasks.where(~F.coalesce(F.col("status").isin("done", "in_progress"), F.lit(False)))
    deps = open_.select("id", F.explode("blocked_by").alias("dep"))
    blocked = deps.join(pool, "dep", "left").where(F.col("there").isNull() | F.coalesce(F.col("dep_status") != "done", F.lit(True))).select("id").distinct().withColumn("is_blocked", F.lit(True))
    return tasks.join(blocked, "id", "left").withColumn("effective_status", F.when(F.col("is_blocked"), "blocked").otherwise(F.coalesce("status", F.lit("ready")))).drop("is_blocked")


def list_tasks(tasks: DataFrame, project: str | None = None, status: str | None = None, priority: int | None = None, include_done: bool = False) -> DataFrame:
    """Filtered first, then resolved among what is left; by priority (none counts as 2), then age."""
    if project:
        tasks = tasks.where(F.col("project") == project)
    if priority:
        tasks = tasks.where(F.col("priority") == priority)
    out = effective(tasks)
    if not include_done:
        out = out.where("effective_status <> 'done'")
    if status:
        out = out.where(F.col("effective_status") == status)
    return out.withColumn("priority", F.coalesce("priority", F.lit(2).cast("long"))).orderBy("priority", "created_at")


def board(tasks: DataFrame, include_done: bool = True) -> DataFrame:
    """Tasks a column of the board."""
    out = effective(tasks)
    if not include_done:
        out = out.where("effective_status <> 'done'")
    return out.groupBy("effective_status").agg(F.count("*").alias("n"), F.min("created_at").alias("oldest"))


def cards(tasks: DataFrame, most_tags: int = 3, include_done: bool = True) -> DataFrame:
    """The cards of the board: each task under its column, with its first tags."""
    out = effective(tasks)
    if not include_done:
        out = out.where("effective_status <> 'done'")
    return out.select("effective_status", "id", "title", F.coalesce("priority", F.lit(2).cast("long")).alias("priority"), F.slice(F.coalesce("tags", F.array().cast("array<string>")), 1, most_tags).alias("tags")).orderBy("effective_status", "priority", "id")


def update(tasks: DataFrame, changes: DataFrame, children: DataFrame | None = None) -> DataFrame:
    """Override statuses by ``changes`` (id, new_status); ``children`` are tasks found on the way, added as ready."""
    out = tasks.join(changes, "id", "left").withColumn("status", F.coalesce("new_status", "status")).drop("new_status")
    return out if children is None else out.unionByName(children, allowMissingColumns=True)
