import hashlib
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from loremill.llm.exact_dedup import block_identities, drop_exact_duplicates, exact_groups
from loremill.llm.sharding import _cuts, hilbert_index, shard_rows, write_shards

from .helpers import ODD, docs, odd


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    keep = {t: max((i for i in g if i is not None), default=None) for t, g in groups.items()}
    return sorted((str(i), str(keep[t or ""]), len(groups[t or ""]), i == keep[t or ""], hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows)


def got(df):
    return sorted((str(r["doc_id"]), str(r["keep_id"]), r["group_size"], r["kept"], r["text_sha256"]) for r in df.collect())


def test_groups(spark):
    assert got(exact_groups(odd(spark))) == brute(ODD)
    assert got(exact_groups(odd(spark), block_bytes=1000)) == brute(ODD)


def test_colliding_keys_are_told_apart(spark):
    rows = [(i, w * n) for i, (w, n) in enumerate([("a", 3), ("b", 3), ("a", 3), ("ab", 40), ("ba", 40), ("ab", 40), ("c", 50)])]
    weak = lambda b: [F.length(b)]
    assert got(exact_groups(docs(spark, rows), block_bytes=16, key=weak)) == brute(rows)


def test_names_are_the_sorted_place_whatever_the_partitions(spark):
    rows = docs(spark, [(i, f"{i % 7}" * (40 + i % 5 * 30)) for i in range(300)])
    named = lambda n: sorted((r["k"], r["level"], r["name"]) for r in block_identities(rows.repartition(n), block_bytes=16).collect())
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        first = named(1)
        spark.conf.set("spark.sql.shuffle.partitions", "3")
        assert named(5) == first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    zero = {n for _, level, n in first if level == 0}
    assert not zero or max(zero) <= 300


def test_heavy_blocks_and_groups(spark):
    many = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("same text " * 50)).otherwise(F.concat(F.lit("head " * 40), F.col("id") % 900)).alias("text"))
    rows = [(r["doc_id"], r["text"]) for r in many.collect()]
    assert got(exact_groups(many, block_bytes=64)) == brute(rows)


def test_drop_keeps_columns_of_any_name(spark):
    names = ["_keep", "_sha", "_nth", "k", "sha", "nth", "a.b"]
    rows = odd(spark).drop("k", "name").withColumns({n: F.concat(F.lit(n), F.coalesce("doc_id", F.lit(0))) for n in names})
    kept = drop_exact_duplicates(rows)
    assert kept.columns == rows.columns
    assert all(r[n] == f"{n}{r['doc_id'] or 0}" for r in kept.collect() for n in names)


def test_empty_table_and_drop(spark):
    assert exact_groups(docs(spark, [(1, "x")]).where("false")).count() == 0
    kept = drop_exact_duplicates(odd(spark))
    assert kept.columns == odd(spark).columns
    assert sorted((r["doc_id"], r["text"]) for r in kept.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).collect()) == sorted({4: "a b c", 2: "", 6: "x" * 30_000 + " tail", 7: "x" * 30_000 + " tale", 8: " \n\t", 9: ODD[-1][1]}.items())


def test_curve_visits_each_cell_by_neighbours(spark):
    cells = spark.range(4**3).select(F.expr("id div 16").alias("a"), F.expr("(id div 4) % 4").alias("b"), F.expr("id % 4").alias("c"))
    rows = cells.select("a", "b", "c", hilbert_index([F.col("a"), F.col("b"), F.col("c")], 2).alias("h")).orderBy("h").collect()
    assert [r["h"] for r in rows] == list(range(64))
    for x, y in zip(rows, rows[1:]):
        assert abs(x["a"] - y["a"]) + abs(x["b"] - y["b"]) + abs(x["c"] - y["c"]) == 1


def check_shards(rows, texts, shards=40):
    n = len(rows)
    counts = defaultdict(list)
    for r in rows:
        counts[r["shard"]].append(r["slot"])
        assert r["law"] == "rows" and r["grown_shard"] is None
    sizes = [len(counts.get(s, [])) for s in range(shards)]
    assert sum(sizes) == n and max(sizes) - min(sizes) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in counts.values())
    got = sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in rows)
    assert got == sorted((str(i), len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in texts)


def test_shards(spark, sf):
    check_shards(shard_rows(odd(spark)).collect(), ODD)
    assert shard_rows(odd(spark).where("false")).count() == 0
    table = spark.read.parquet(f"{sf}/documents.parquet")
    rows = shard_rows(table).collect()
    check_shards(rows, [(r["doc_id"], r["text"]) for r in table.collect()])
    by = sorted(rows, key=lambda r: (r["shard"], r["slot"]))
    assert [r["h"] for r in by] == sorted(r["h"] for r in by)


def test_written_shards(spark, sf, tmp_path):
    table = spark.read.parquet(f"{sf}/documents.parquet")
    write_shards(table, str(tmp_path / "s"), 5)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == table.count()
    assert {r["count"] for r in back.groupBy("shard").count().collect()} == {40}


def test_written_shards_hold_repeated_rows_and_clashing_ids(spark, tmp_path):
    rows = odd(spark).unionByName(odd(spark))
    write_shards(rows, str(tmp_path / "s"), 3)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert Counter((r["doc_id"], r["text"]) for r in back.collect()) == Counter(ODD * 2)
    slots = defaultdict(list)
    for r in back.collect():
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    with pytest.raises(ValueError):
        write_shards(rows.withColumn("slot", F.lit(1)), str(tmp_path / "t"), 3)


def test_cuts_against_one_sorted_list(spark):
    rows = [f"v{i * i % 97:02}" for i in range(500)] + ["v13"] * 400
    per, n, cuts = sorted(Counter(rows).items()), len(rows), {}
    upto = 0
    for v, c in per:
        if code := upto * 16 // n:
            cuts.setdefault(code, v)
        upto += c
    assert _cuts(spark.createDataFrame([(v,) for v in rows], "v string"), "v", 16) == [cuts[k] for k in sorted(cuts)]
