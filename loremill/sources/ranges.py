"""Files by byte ranges: listings without content, lines of ranges, tails, and whole files of chosen paths.

A listing has a row a file (path, length, modified) and opens none. Reading takes rows of paths or ranges, deals them over
tasks and opens the files there, so a long file is many tasks' work, a tail costs its own bytes only, and which files
are read is a question of which rows are kept. A row that is dealt again after a lost executor reads the same bytes.

Edge cases: no file under a glob gives no rows; a file that is gone by the time it is read gives none; bytes that are no
UTF-8 become replacement characters; an empty file is in no listing. A line is one row, however long.
"""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RANGE_BYTES = 64 << 20
LISTING = "path string, length long, modified timestamp"
#: Lines are given on in batches of about so many bytes.
BATCH_BYTES = 4 << 20


def found(spark: SparkSession, glob: str) -> bool:
    """Whether a glob meets anything."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(glob)
    some = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p)
    return some is not None and len(some) > 0


def plain(path: Column) -> Column:
    return F.regexp_replace(path, r"^file:/*", "/")


def listing(spark: SparkSession, glob: str) -> DataFrame:
    """``(path, length, modified)`` of the files of a glob; contents are not read."""
    if not found(spark, glob):
        return spark.createDataFrame([], LISTING)
    rows = spark.read.format("binaryFile").load(glob)
    return rows.select(plain(F.col("path")).alias("path"), "length", F.col("modificationTime").alias("modified"))


def _opened(path: str):
    """A file of any file system that the path's scheme names; None if it is not there."""
    from pyarrow import fs

    scheme, colon, rest = path.partition("://")
    where = f"{'s3' if scheme == 's3a' else scheme}://{quote(rest)}" if colon else path
    system, inner = fs.FileSystem.from_uri(where)
    try:
        return system.open_input_file(inner)
    except FileNotFoundError:
        return None


def _dealt(rows: DataFrame, parts: int | None) -> DataFrame:
    """Rows over so many tasks; a given number, as rows of paths are too small for adaptive execution to keep them apart."""
    return rows.repartition(parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def whole(paths: DataFrame, parts: int | None = None) -> DataFrame:
    """``(path, raw)`` of the files that ``paths`` (path) names, each a row."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                f = row["path"] and _opened(row["path"])
                if f:
                    with f:
                        yield pa.RecordBatch.from_pylist([{"path": row["path"], "raw": f.read().decode(errors="replace")}], schema=pa.schema([("path", pa.string()), ("raw", pa.string())]))

    return _dealt(paths.select("path"), parts).mapInArrow(read, "path string, raw string")


def lines(files: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``(path, at, raw)``: the lines of ``files`` (path, length), ``at`` the byte where a line begins.

    A range has the lines that begin in it, so each line is in one. A line feed at the end is followed by an empty line.
    """
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("length") - 1, F.lit(0)).cast("long"), F.lit(range_bytes).cast("long"))
    ranges = files.select("path", "length", F.explode(starts).alias("start"))
    end = F.when(F.col("start") + range_bytes >= F.col("length"), F.col("length") + 1).otherwise(F.col("start") + range_bytes)
    total = files.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    return _dealt(ranges.select("path", "start", end.alias("end")), total // RANGE_BYTES + 1).mapInArrow(_lines, "path string, at long, raw string")


def tails(paths: DataFrame, most_bytes: int, parts: int | None = None) -> DataFrame:
    """``(path, at, raw)``: the lines in the last ``most_bytes`` bytes of each file; the first may be the end of a line."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                f = row["path"] and _opened(row["path"])
                if f:
                    with f:
                        start = max(0, f.size() - most_bytes)
                        f.seek(start)
                        yield from _batches(row["path"], start, f.read(most_bytes).split(b"\n"))

    return _dealt(paths.select("path"), parts).mapInArrow(read, "path string, at long, raw string")


def _batches(path: str, at: int, parts: list[bytes]) -> Iterator[pa.RecordBatch]:
    starts = []
    for p in parts:
        starts.append(at)
        at += len(p) + 1
    texts = [p.decode(errors="replace") for p in parts]
    yield pa.RecordBatch.from_arrays([pa.array([path] * len(parts), pa.string()), pa.array(starts, pa.int64()), pa.array(texts, pa.string())], names=["path", "at", "raw"])


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for row in b.to_pylist():
            f = _opened(row["path"])
            if f:
                with f:
                    yield from _lines_of(f, row["path"], row["start"], row["end"])


def _lines_of(f, path: str, start: int, end: int) -> Iterator[pa.RecordBatch]:
    """The lines that begin in [start, end): what is read is cut at line feeds, and an unended line waits for more."""
    at, skip = start, start > 0
    # a line begins at ``start`` if the byte before it is a line feed
    f.seek(start - skip)
    at -= skip
    held: list[bytes] = []
    while True:
        piece = f.read(BATCH_BYTES)
        cut = piece.rfind(b"\n")
        if piece and cut < 0:
            held.append(piece)
            continue
        whole_lines = (b"".join(held) + (piece[:cut] if piece else b"")).split(b"\n")
        held = [piece[cut + 1 :]] if piece else []
        if skip:
            at += len(whole_lines.pop(0)) + 1
            skip = False
        kept, size = [], at
        for p in whole_lines:
            if size >= end:
                break
            kept.append(p)
            size += len(p) + 1
        if kept:
            yield from _batches(path, at, kept)
        at = size
        if not piece or at >= end:
            return
