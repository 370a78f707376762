"""What the corpus operators share: shared-folder tables, connected components, checks of columns."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key with more than one row in so many of its table is heavy, and so is none with fewer rows than HEAVY_ROWS.
HEAVY_SHARE, HEAVY_ROWS = 50_000, 1000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, read from the session.

    Where it is unset and all tasks run in the driver's own process, a folder of this machine takes its place; a
    cluster without it is refused.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not (spark.sparkContext.master + "[").startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"{tempfile.gettempdir()}/loremill-checkpoints"


def _fs_path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; it goes when the driver ends."""
    path = f"{shared_dir(spark)}/loremill-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    fs, p = _fs_path(spark, path)
    fs.deleteOnExit(p)
    return path


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs_path(spark, path)
    return fs.exists(p)


def remove(spark: SparkSession, *paths: str) -> None:
    for path in paths:
        fs, p = _fs_path(spark, path)
        fs.delete(p, True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet to the shared folder and read it back.

    What a lost executor held is read again from there, and both sides of a later
    self-join see the same rows.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._loremill_path = path
    return out


def drop_stored(*dfs: DataFrame) -> None:
    for df in dfs:
        if path := getattr(df, "_loremill_path", None):
            remove(df.sparkSession, path)


def text_or_empty(df: DataFrame, column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))


def keep_rows(docs: DataFrame, column: str, keep: Callable[[pa.Array], Sequence[bool]], rows: int = 1000) -> DataFrame:
    """The rows of ``docs`` for which ``keep`` says so, from ``column`` (nulls as empty texts), ``rows`` at a time."""
    at = docs.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, rows):
                b = whole.slice(start, rows)
                yield b.filter(pa.array(keep(b.column(at).fill_null("")), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def fresh(columns: Sequence[str], *names: str) -> list[str]:
    """``names``, each with as many underscores behind it as it takes to clash with none of ``columns``."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def spread_join(left: DataFrame, right: DataFrame, on: list[str], n: str = "n") -> DataFrame:
    """``left`` joined to ``right``, whose keys are distinct and not null and whose ``n`` says how many rows ``left`` has for each.

    Rows of a heavy key (more than one in ``HEAVY_SHARE`` of all) stay where they are and get their match from a
    broadcast of the heavy keys, of which there are fewer than ``HEAVY_SHARE``; all other rows are dealt by key, so no
    task holds more than ``HEAVY_ROWS`` rows of one key, or one in ``HEAVY_SHARE`` of all. ``left`` is read twice if there is a heavy key.
    """
    total, most = right.agg(F.coalesce(F.sum(n), F.lit(0)), F.coalesce(F.max(n), F.lit(0))).first()
    limit = max(HEAVY_ROWS, total // HEAVY_SHARE)
    if most <= limit:
        return left.join(right.drop(n), on)
    heavy = right.where(F.col(n) > limit).drop(n)
    near = left.join(F.broadcast(heavy), on)
    far = left.join(F.broadcast(heavy.select(*on)), on, "left_anti").join(right.where(F.col(n) <= limit).drop(n), on)
    return near.unionByName(far)


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of an undirected graph by alternating large-star and small-star rounds.

    ``edges`` has long columns ``a`` and ``b``. Returns ``(node, root)`` for every node that
    has an edge to another one; ``root`` is the smallest node reachable. A round is three
    aggregations with map-side combine and two joins that split the rows of a star's centre, written to the shared
    folder; only a few numbers a round reach the driver. Rounds grow with the logarithm
    of the longest path. A graph without edges gives no rows.
    """
    cur = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    for _ in range(max_rounds):
        both = cur.select("u", "v").unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = stored(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count_if(F.col("v") < F.col("u")).alias("less"), F.count_if(F.col("v") > F.col("u")).alias("more")), "low")
        # settled when only stars are left: a node has one smaller neighbour and no larger one, or no smaller one
        if not low.where("less > 1 or (less = 1 and more > 0)").head(1):
            drop_stored(cur)
            return low.select(F.col("u").alias("node"), F.col("m").alias("root"))
        large = stored(spread_join(both, low.select("u", "m", (F.col("less") + F.col("more")).alias("n")), ["u"]).where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")), "large")
        least = stored(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "least")
        small = spread_join(large, least, ["u"])
        nxt = stored(small.select(F.col("u"), F.col("m").alias("v")).unionByName(small.select(F.col("v").alias("u"), F.col("m").alias("v"))).where("u <> v").distinct(), "small")
        drop_stored(low, large, least, cur)
        cur = nxt
    raise RuntimeError("components did not settle")


def require(df: DataFrame, *names: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; there are {df.columns}")
