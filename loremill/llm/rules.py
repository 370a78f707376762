"""Quality rules as a short-circuit cascade, DataFrame functions only.

A text's words and base counts are found once, in two projections without a shuffle. Then come the rules: each is a Boolean column
that rejects. On a bounded sample every rule's cost is timed and its rejections are recorded, and the cascade is laid out
greedily: next comes the rule that rejects most of the sampled rows left per second of its cost. The cascade is one CASE
expression, whose branches Spark evaluates in order and only until one holds, so a row pays for rules up to its first
rejection, and rows that fail the base tests pay for none. Order changes cost and which rule is named, never the verdict.

Repeated words: each five-word window is hashed to 64 bits (two different windows of a text of a million words take one hash with
a chance below one in ten million); a text whose windows are all distinct is done. Otherwise the windows are sorted by hash, those beside an equal
one are kept, and the words that they cover are counted from the distances of their places. All are array functions of one row:
linear, but for the sort, and about a hundred bytes a word at the most.

Edge cases: a null text has no words and fails the base test; an empty table gives no rows; repeated rows each come back; columns that
are not asked for are not read, whatever their names.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let
from .common import drop_stored, require, stored, text_or_empty

WINDOW, LEAST_WORDS, MOST_REPEATED = 5, 10, 20
#: Rows, about, on which rules are timed.
MAX_SAMPLE = 2000
_WHITE = " \t\n\x0b\f\r"
_BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

#: Rules by name: each column is true where it rejects; they may use t, words, lines and the base counts.
RULES: dict[str, Callable[[], Column]] = {
    # more than one of the symbols to ten words
    "symbols": lambda: F.col("n_symbols") * 10 > F.col("n_words"),
    # words of less than two or more than twenty characters on average
    "word_length": lambda: (F.col("word_chars") < 2 * F.col("n_words")) | (F.col("word_chars") > 20 * F.col("n_words")),
    # three lines or more with words are repeated, and more than three in ten
    "repeated_lines": lambda: (F.col("n_dup_lines") >= 3) & (F.col("n_dup_lines") * 10 > 3 * F.size("lines")),
    # more than half of the words have no letter
    "few_letters": lambda: F.size(F.filter("words", lambda w: w.rlike(r"\p{L}"))) * 2 < F.col("n_words"),
    # more than half of the letters are capitals
    "shouting": lambda: F.length(F.regexp_replace("t", r"\P{Lu}", "")) * 2 > F.length(F.regexp_replace("t", r"\P{L}", "")),
    # more than nine in ten lines are items of a list
    "list_items": lambda: F.size(F.filter("lines", lambda x: x.rlike(r"^\s*[-*•·]"))) * 10 > 9 * F.size("lines"),
    # more than three in ten lines break off in dots
    "broken_off": lambda: F.size(F.filter("lines", lambda x: x.rlike(r"(\.\.\.|…)\s*$"))) * 10 > 3 * F.size("lines"),
}


def _repeated(words: Column) -> Column:
    """How many words stand in windows of five words that the array ``words`` has twice or more."""
    last = F.size(words) - WINDOW
    windows = lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)]))
    beside = lambda s: F.transform(F.filter(s, lambda x, k: (x["h"] == F.get(s, k - 1)["h"]) | (x["h"] == F.get(s, k + 1)["h"])), lambda x: x["i"])
    covered = lambda p: F.aggregate(F.transform(p, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - x, F.lit(WINDOW)))), F.lit(0), lambda a, x: a + x)
    sort = lambda w: F.sort_array(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    count = lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(let(sort(w), lambda s: let(F.sort_array(beside(s)), covered)))
    return F.when(last < 1, F.lit(0)).otherwise(let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: let(windows(h), count)))


def measured(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, t, words, lines (those with a word), the base counts and base_failed."""
    require(docs, id_col, text_col)
    t = F.regexp_replace(F.btrim(F.col("t"), F.lit(_WHITE)), r"[\x20\x09-\x0D]+", " ")
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(docs, text_col).alias("t"))
    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    rows = rows.select("doc_id", "t", t.alias("plain"), lines.alias("lines"))
    rows = rows.select("doc_id", "t", "plain", "lines", F.when(F.col("plain") == "", F.array().cast("array<string>")).otherwise(F.split("plain", " ")).alias("words"))
    rows = rows.select(
        "doc_id", "t", "lines", "words", F.size("words").cast("long").alias("n_words"), (F.length("plain") - F.greatest(F.size("words") - 1, F.lit(0))).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("t", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), _repeated(F.col("words")).cast("long").alias("n_repeat_words"),
    )
    return rows.withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MOST_REPEATED))


def _timed(rows: DataFrame, what: Column, runs: int = 2) -> float:
    took = []
    for _ in range(runs):
        began = time.perf_counter()
        rows.agg(F.count_if(what)).first()
        took.append(time.perf_counter() - began)
    return min(took)


def cascade_order(docs: DataFrame, rules: dict[str, Callable[[], Column]] | None = None, max_sample: int = MAX_SAMPLE, text_col: str = "text", id_col: str = "doc_id") -> list[tuple[str, float, int]]:
    """(rule, seconds on the sample, rejections of what is left) in the order of the cascade; rules that reject nothing of the sample come last, cheapest first."""
    rules = RULES if rules is None else rules
    n = docs.count()
    if not n or not rules:
        return [(name, 0.0, 0) for name in rules]
    some = docs.select(id_col, text_col).sample(min(1.0, max_sample / n), seed=42)
    sample = stored(measured(some, text_col, id_col).where("not base_failed"), "rule_sample")
    idle = _timed(sample, F.lit(True))
    cost = {name: max(1e-4, _timed(sample, F.coalesce(rule(), F.lit(False))) - idle) for name, rule in rules.items()}
    # which rules reject a row, as bits: as many rows as there are kinds of rejected rows in the sample
    bits = F.lit(0).cast("long")
    for k, rule in enumerate(rules.values()):
        bits = bits.bitwiseOR(F.when(rule(), F.lit(1 << k)).otherwise(F.lit(0)).cast("long"))
    kinds = {r["bits"]: r["n"] for r in sample.groupBy(bits.alias("bits")).agg(F.count("*").alias("n")).collect()}
    drop_stored(sample)
    left, out = dict(enumerate(rules)), []
    while left:
        hits = {k: sum(n for b, n in kinds.items() if b >> k & 1) for k in left}
        best = min(left, key=lambda k: (-hits[k] / cost[left[k]], cost[left[k]], k))
        name = left.pop(best)
        out.append((name, cost[name], hits[best]))
        kinds = {b: n for b, n in kinds.items() if not b >> best & 1}
    return out


def apply_rules(docs: DataFrame, order: list[str] | None = None, rules: dict[str, Callable[[], Column]] | None = None, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, the base counts, base_failed, kept and rejected_by (``base``, or the first rule of ``order`` that rejects)."""
    rules = RULES if rules is None else rules
    order = list(rules) if order is None else order
    first = F.when(F.col("base_failed"), F.lit("base"))
    for name in order:
        first = first.when(rules[name](), F.lit(name))
    out = measured(docs, text_col, id_col).select("doc_id", *_BASE, "base_failed", first.alias("rejected_by"))
    return out.select("doc_id", *_BASE, "base_failed", F.col("rejected_by").isNull().alias("kept"), "rejected_by")


def rule_cascade(docs: DataFrame, rules: dict[str, Callable[[], Column]] | None = None, max_sample: int = MAX_SAMPLE, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``apply_rules`` in the order that a sample of ``docs`` suggests."""
    order = [name for name, _, _ in cascade_order(docs, rules, max_sample, text_col, id_col)]
    return apply_rules(docs, order, rules, text_col, id_col)
