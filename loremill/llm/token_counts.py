"""Token counts as delta-maintained rollups by source, language and tokenizer version.

A batch of changes inserts, deletes or revises counted documents. Each change becomes signed rows: what the
document counted before leaves with a minus, what it counts now comes with a plus; the totals of a group are the
sum of all signed rows, never a recount. A ledger of the documents' present counts tells what to take back, so
deletes need no text. The ledger is dealt to ``buckets`` folders by a hash of doc_id: a batch reads only the folders
of the documents that it changes, and joins its own rows to what is there by key.

A batch is committed by one manifest file, written under another name and renamed to the next number, which fails if
that number is there: before that nothing of the batch is visible, afterwards the batch's id is known and
applying it again does nothing. Every attempt writes to folders of its own, so neither a failed attempt nor a writer that was
overtaken touches what is committed. Once ``COMPACT_EVERY`` batches have come together, their deltas and ledgers are folded into
one of each and their ids go from the manifest to a table; ``compact`` does so at any time.

Several changes of one document in a batch: the one with the largest ``seq`` holds. An insert of a document that is
there revises it; a delete or revision of one that is not is a no-op or an insert. Edge cases: a null text counts
no tokens; null source or lang are groups of their own; a null doc_id is one document of its own; rows repeated
whole change nothing; an empty batch commits and adds nothing; other columns are not read.
"""

from __future__ import annotations

import base64
import json
import os
import uuid
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import _fs_path, exists, require, text_or_empty

TOKENIZER_DIR = "/opt/tokenizers"
#: Fixed value: the public pattern that cuts a text before the merges of these rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Version names and the rank files they stand for.
VERSIONS = {"byte_bpe_50k": "byte_bpe_50k.tiktoken", "byte_bpe_multi_50k": "byte_bpe_multi_50k.tiktoken"}
KEY = ["doc_id", "version"]
#: Folders of the ledger, and batches between two compactions.
BUCKETS, COMPACT_EVERY = 32, 16
COUNTED = "doc_id long, source string, lang string, version string, n_tokens long"


class Counter:
    """Counts tokens of texts with a rank file; pickles as its path."""

    def __init__(self, path: str):
        self.path, self.encoding = path, None

    def __getstate__(self) -> dict:
        return {"path": self.path, "encoding": None}

    def __call__(self, text: str) -> int:
        if self.encoding is None:
            import tiktoken

            with open(self.path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        return len(self.encoding.encode_ordinary(text))


def count_tokens(docs: DataFrame, versions: dict[str, str] | None = None, tokenizer_dir: str = TOKENIZER_DIR) -> DataFrame:
    """doc_id, source, lang, version and n_tokens: a row a document and tokenizer version, in one pass."""
    require(docs, "doc_id", "source", "lang", "text")
    counters = {v: Counter(os.path.join(tokenizer_dir, f)) for v, f in (versions or VERSIONS).items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "source", "lang", "version", "n_tokens"]
        for b in batches:
            texts = b.column(3).to_pylist()
            for v, count in counters.items():
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array([v] * len(texts), pa.string()), pa.array([count(t) for t in texts], pa.int64())], names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), text_or_empty(docs).alias("t"))
    return rows.mapInArrow(run, COUNTED)


class TokenRollup:
    """Totals in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS, compact_every: int = COMPACT_EVERY):
        self.spark, self.path, self.buckets, self.compact_every = spark, path.rstrip("/"), buckets, compact_every

    def _manifests(self) -> list[int]:
        folder = f"{self.path}/manifests"
        if not exists(self.spark, folder):
            return []
        fs, p = _fs_path(self.spark, folder)
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0].isdigit())

    def _manifest(self) -> tuple[int, dict]:
        numbers = self._manifests()
        if not numbers:
            return 0, {"buckets": self.buckets, "batches": [], "known": [], "deltas": [], "ledgers": []}
        fs, p = _fs_path(self.spark, f"{self.path}/manifests/{numbers[-1]:010d}.json")
        stream = fs.open(p)
        try:
            return numbers[-1], json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _commit(self, number: int, manifest: dict) -> None:
        """Write the manifest whole, then give it the next number; fails if another writer was first."""
        fs, temp = _fs_path(self.spark, f"{self.path}/manifests/attempt-{uuid.uuid4().hex}")
        out = fs.create(temp, False)
        out.write(json.dumps(manifest).encode())
        out.close()
        sc = self.spark.sparkContext
        files = sc._jvm.org.apache.hadoop.fs
        plain = sc._gateway.new_array(getattr(files, "Options$Rename"), 1)
        plain[0] = getattr(files, "Options$Rename").NONE
        final = files.Path(f"{self.path}/manifests/{number:010d}.json")
        files.FileContext.getFileContext(fs.getUri(), sc._jsc.hadoopConfiguration()).rename(fs.makeQualified(temp), fs.makeQualified(final), plain)

    def _new(self, kind: str, number: int) -> str:
        return f"{self.path}/{kind}/{number:010d}-{uuid.uuid4().hex}"

    def _read(self, paths: list[str], schema: str) -> DataFrame:
        """Rows of all ``paths``, of which there are at most ``compact_every`` or so; each may have folders by ``part``."""
        return reduce(DataFrame.unionByName, [self.spark.read.schema(schema).parquet(p) for p in paths] or [self.spark.createDataFrame([], schema)])

    LEDGER = f"{COUNTED}, live boolean, batch_no int, part int"
    DELTA = "source string, lang string, version string, documents long, tokens long"

    def _write_ledger(self, rows: DataFrame, path: str, buckets: int) -> None:
        """``rows`` dealt to folders by the hash of doc_id."""
        part = F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int")
        rows.select(*[c.split()[0] for c in COUNTED.split(", ")], "live", "batch_no", part.alias("part")).repartition("part").write.partitionBy("part").parquet(path)

    def present(self) -> DataFrame:
        """The ledger: what each document counts now, by tokenizer version."""
        _, m = self._manifest()
        return self._present(self._read(m["ledgers"], self.LEDGER))

    @staticmethod
    def _present(rows: DataFrame) -> DataFrame:
        last = rows.groupBy(*KEY).agg(F.max(F.struct("batch_no", "live", "source", "lang", "n_tokens")).alias("x"))
        return last.where("x.live").select("doc_id", F.col("x.source").alias("source"), F.col("x.lang").alias("lang"), "version", F.col("x.n_tokens").alias("n_tokens"))

    def totals(self) -> DataFrame:
        """source, lang, version, documents and tokens of every group that has documents."""
        _, m = self._manifest()
        return self._totals(m)

    def _totals(self, m: dict) -> DataFrame:
        rows = self._read(m["deltas"], self.DELTA).groupBy("source", "lang", "version")
        return rows.agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens")).where("documents <> 0 or tokens <> 0")

    def _committed(self, m: dict, batch_id: str) -> bool:
        return batch_id in m["batches"] or bool(m["known"] and self._read(m["known"], "batch string").where(F.col("batch") == batch_id).head(1))

    def apply(self, batch_id: str, changes: DataFrame) -> bool:
        """Commit a batch once. ``changes``: op (insert, delete, revise), doc_id, version, and source, lang, n_tokens unless deleted; ``seq`` orders them.

        False when the batch was committed before.
        """
        require(changes, "op", "doc_id", "version", "source", "lang", "n_tokens")
        number, m = self._manifest()
        if self._committed(m, batch_id):
            return False
        seq = F.col("seq").cast("long") if "seq" in changes.columns else F.lit(0).cast("long")
        rows = changes.where(F.col("op").isin("insert", "delete", "revise")).select(F.col("doc_id").cast("long").alias("doc_id"), "version", seq.alias("seq"), (F.col("op") != "delete").alias("live"), "source", "lang", F.coalesce(F.col("n_tokens"), F.lit(0)).cast("long").alias("n_tokens"))
        last = rows.groupBy(*KEY).agg(F.max(F.struct("seq", "live", "source", "lang", "n_tokens")).alias("x"))
        new = last.select(*KEY, F.col("x.live").alias("live"), F.col("x.source").alias("source"), F.col("x.lang").alias("lang"), F.col("x.n_tokens").alias("n_tokens"))
        ledger = self._new("ledger", number + 1)
        self._write_ledger(new.withColumn("batch_no", F.lit(number + 1)), ledger, m["buckets"])
        new = self._read([ledger], self.LEDGER)
        group = ["source", "lang", "version"]
        signed = new.where("live").select(*group, F.lit(1).alias("d"), F.col("n_tokens").alias("t"))
        parts = [r["part"] for r in new.select("part").distinct().collect()]  # at most as many as there are folders
        if m["ledgers"] and parts:
            old, n = self._read(m["ledgers"], self.LEDGER).where(F.col("part").isin(parts)).alias("o"), new.select(*KEY).alias("n").hint("merge")
            same = (F.col("o.doc_id").eqNullSafe(F.col("n.doc_id"))) & (F.col("o.version").eqNullSafe(F.col("n.version")))
            gone = self._present(old.join(n, same, "left_semi"))
            signed = signed.unionByName(gone.select(*group, F.lit(-1).alias("d"), (-F.col("n_tokens")).alias("t")))
        delta = self._new("deltas", number + 1)
        signed.groupBy(*group).agg(F.sum("d").cast("long").alias("documents"), F.sum("t").alias("tokens")).write.parquet(delta)
        self._commit(number + 1, m | {"batches": [*m["batches"], batch_id], "deltas": [*m["deltas"], delta], "ledgers": [*m["ledgers"], ledger]})
        if len(m["batches"]) + 1 >= self.compact_every:
            self.compact()
        return True

    def compact(self) -> None:
        """Fold all deltas into one and all ledgers into one; batch ids move to a table, so they stay known."""
        number, m = self._manifest()
        delta, ledger, known = (self._new(kind, number + 1) for kind in ("deltas", "ledger", "known"))
        self._totals(m).write.parquet(delta)
        self._write_ledger(self._present(self._read(m["ledgers"], self.LEDGER)).withColumns({"live": F.lit(True), "batch_no": F.lit(number + 1)}), ledger, m["buckets"])
        self.spark.createDataFrame([(b,) for b in m["batches"]], "batch string").unionByName(self._read(m["known"], "batch string")).write.parquet(known)
        self._commit(number + 1, {"buckets": m["buckets"], "batches": [], "known": [known], "deltas": [delta], "ledgers": [ledger]})
