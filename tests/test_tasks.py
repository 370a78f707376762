"""The thirteen cases of task resolution, and what a filter does to it."""

import pytest

from loremill.operators import tasks as T

SCHEMA = "id string, status string, blocked_by array<string>, project string, priority bigint, created_at string"


def rows(spark, *tasks):
    full = [(*t, "p", 2, f"2024-01-0{n + 1} 00:00:00") for n, t in enumerate(tasks)]
    return spark.createDataFrame(full, SCHEMA)


@pytest.mark.parametrize(
    "tasks, want",
    [
        ([("A", "ready", [])], {"A": "ready"}),
        ([("d1", "done", []), ("d2", "done", []), ("A", "ready", ["d1", "d2"])], {"A": "ready"}),
        ([("d1", "done", []), ("d2", "in_progress", []), ("A", "ready", ["d1", "d2"])], {"A": "blocked"}),
        ([("d1", "ready", []), ("d2", "blocked", []), ("A", "ready", ["d1", "d2"])], {"A": "blocked"}),
        ([("A", "ready", ["unknown-dep"])], {"A": "blocked"}),
        ([("d1", "ready", []), ("A", "in_progress", ["d1"])], {"A": "in_progress"}),
        ([("d1", "ready", []), ("A", "done", ["d1"])], {"A": "done"}),
        ([("C", "done", []), ("B", "ready", ["C"]), ("A", "ready", ["B"])], {"A": "blocked", "B": "ready"}),
        ([("A", "ready", [])], {"A": "ready"}),
        ([("d1", "done", []), ("A", "blocked", ["d1"])], {"A": "blocked"}),
        ([("A", "ready", []), ("B", "ready", ["A"]), ("C", "done", [])], {"A": "ready", "B": "blocked", "C": "done"}),
        ([("A", "done", []), ("B", "ready", ["A"])], {"B": "ready"}),
        ([("A", "ready", []), ("B", "ready", []), ("C", "in_progress", [])], {"A": "ready", "B": "ready", "C": "in_progress"}),
        ([("A", None, None)], {"A": "ready"}),
        ([("A", "odd", ["A2"]), ("A2", "odd", [])], {"A": "blocked", "A2": "odd"}),
    ],
)
def test_effective(spark, tasks, want):
    got = {r["id"]: r["effective_status"] for r in T.effective(rows(spark, *tasks)).collect()}
    assert {k: got[k] for k in want} == want


def test_list_resolves_after_filtering(spark):
    t = spark.createDataFrame([("A", "ready", ["B"], "p", 1, "2024-01-01"), ("B", "done", [], "q", 1, "2024-01-01"), ("C", "ready", [], "p", None, "2024-01-02"), ("D", "done", [], "p", 3, "2024-01-03")], SCHEMA)
    got = [(r["id"], r["effective_status"], r["priority"]) for r in T.list_tasks(t, project="p").collect()]
    assert got == [("A", "blocked", 1), ("C", "ready", 2)]
    assert T.list_tasks(t, status="done").count() == 0
    assert [r["id"] for r in T.list_tasks(t, project="p", include_done=True, status="done").collect()] == ["D"]
    assert [r["id"] for r in T.list_tasks(t, priority=2).collect()] == []
