"""Streaming jobs: event windows with watermarks, live sessions, and incremental re-indexing of files.

A file source never emits a changed file again and tells nothing of one that is gone, so ``watch`` only keeps time: at each
trigger ``follow`` compares the listing of the sources with the last one, which finds new, edited and deleted files and opens no other.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..api import Knowledge, reindex
from ..sources.files import Roots, file_changes, note_files
from ..storage import new_path

WATERMARK = "10 minutes"


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream; its times become zoned so that watermarks take them."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    # a path glob in the folder, for a single file; a folder of part files is read as it is
    rows = spark.readStream.schema(schema).parquet(f"{sf_dir}/events*.parquet")
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, size: str = "1 day") -> DataFrame:
    g = events.groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return g.select(F.col("window.start").alias("window_start"), "event_type", "n", "total")


def sliding(events: DataFrame, size: str = "2 days", slide: str = "1 day") -> DataFrame:
    g = events.groupBy(F.window("ts", size, slide), "event_type").agg(F.count("*").alias("n"))
    return g.select(F.col("window.start").alias("window_start"), "event_type", "n")


def session_gaps(events: DataFrame, gap: str = "5 minutes") -> DataFrame:
    g = events.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return g.select(F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "user_id", "n")


def drain(stream: DataFrame, mode: str, checkpoint: str | None = None) -> DataFrame:
    """Run a stream over what is there and return its rows, for comparing with a batch: in complete mode those of the last state.

    Each micro-batch writes its rows as Parquet under a folder of its number in the shared folder, so a batch that runs again
    replaces what it wrote, and no row passes the driver. Without a ``checkpoint`` a new one is made there too.
    """
    spark = stream.sparkSession
    path, done = new_path(spark, "stream"), []

    def write(rows: DataFrame, n: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/rows/batch={n}")
        done.append(n)

    writer = stream.writeStream.foreachBatch(write).outputMode(mode).trigger(availableNow=True)
    writer.option("checkpointLocation", checkpoint or f"{path}/checkpoint").start().awaitTermination()
    wanted = [f"{path}/rows/batch={n}" for n in (done[-1:] if mode == "complete" else done)]
    return spark.read.schema(stream.schema).parquet(*wanted) if wanted else spark.createDataFrame([], stream.schema)


def stream_query(spark: SparkSession, sf_dir: str, shape: Callable[[DataFrame], DataFrame], mode: str = "complete") -> DataFrame:
    return drain(shape(event_stream(spark, sf_dir).withWatermark("ts", WATERMARK)), mode)


def watch(spark: SparkSession, on_tick: Callable[[int], None], every: str = "60 seconds", checkpoint: str | None = None):
    """Start a query that calls ``on_tick`` with a number at each trigger; it has no state but that number."""
    ticks = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 1).load()
    writer = ticks.writeStream.foreachBatch(lambda _, n: on_tick(n)).trigger(processingTime=every)
    return writer.option("checkpointLocation", checkpoint or f"{new_path(spark, 'watch')}/checkpoint").start()


def follow(spark: SparkSession, roots: Roots, known: Knowledge, on_change: Callable[[Knowledge], None], every: str = "1 second", quiet_ms: int = 500, checkpoint: str | None = None):
    """Start a query that calls ``on_change`` with what is known after files came, changed or went, once they rested ``quiet_ms``."""
    last = [known]

    def tick(_: int) -> None:
        new = file_changes(last[0].files, note_files(spark, roots), quiet_ms)
        if new.where("change <> 'same'").head(1):
            now = spark.range(1).select(F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss")).first()[0]
            last[0] = reindex(spark, roots, last[0], now, quiet_ms=quiet_ms)
            on_change(last[0])

    return watch(spark, tick, every, checkpoint)
