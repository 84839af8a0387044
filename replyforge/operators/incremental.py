"""A corpus profile that grows file by file.

Each input file leaves one small row per column (rows, NULLs, an HLL sketch of
the distinct values) and its id counts.  New files are profiled alone and
merged by adding up; files that the state knows are never read again.

Layout below the state folder::

    ids/batch=<id>/bucket=<n>/   (key, n): rows per id, hash-partitioned by bucket
    files/batch=<id>/            (file, column, n_rows, n_null, sketch)
    merged/batch=<id>/           (old): the batches that a compacted one stands for

``files`` is written last, for a compacted batch ``merged``: a batch without it
did not finish and does not count, so a job that died is simply run again.
"""

from __future__ import annotations

import uuid
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from replyforge.functions.numbers import percent

BUCKETS = 64
LG_K = 14  # 2**14 registers: a standard error of 0.8 %

_FILES = "file string, column string, n_rows long, n_null long, sketch binary, batch string"
_MERGED = "old string, batch string"
_COMPACT = "c-"  # begins the names of compacted batches


class ProfileState:
    """Mergeable profile of a message table, kept in a folder."""

    def __init__(self, spark: SparkSession, folder: str, key: str = "tweet_id"):
        self.spark, self.folder, self.key = spark, folder.rstrip("/"), key

    # -- adding ---------------------------------------------------------------

    def add(self, *paths: str) -> list[str]:
        """Profile the Parquet files below ``paths`` that are not known yet; returns them."""
        known = {_plain(r["file"]) for r in self._files().select("file").distinct().collect()}
        listed = self.spark.read.parquet(*paths).inputFiles()
        new = sorted(f for f in listed if _plain(f) not in known)
        if new:
            self._add_files(self.spark.read.parquet(*new))
        return new

    def _add_files(self, rows: DataFrame) -> None:
        batch = uuid.uuid4().hex
        key = F.col(self.key)
        # One key is one row per task before the exchange, however often it occurs.
        counts = rows.where(key.isNotNull()).groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("n"))
        self._write_ids(counts, batch)
        figures = [
            F.struct(
                F.lit(c).alias("column"),
                F.count_if(F.col(c).isNull()).alias("n_null"),
                F.hll_sketch_agg(F.col(c).cast("string"), LG_K).alias("sketch"),
            )
            for c in rows.columns
        ]
        partial = rows.groupBy(F.col("_metadata.file_path").alias("file")).agg(
            F.count(F.lit(1)).alias("n_rows"), F.array(*figures).alias("figures")
        )
        partial.select("file", "n_rows", F.inline("figures")).select(
            "file", "column", "n_rows", "n_null", "sketch"
        ).write.parquet(f"{self.folder}/files/batch={batch}")

    def _write_ids(self, counts: DataFrame, batch: str) -> None:
        bucket = F.pmod(F.xxhash64("key"), F.lit(BUCKETS)).cast("int")
        counts.withColumn("bucket", bucket).repartition("bucket").write.partitionBy("bucket").parquet(
            f"{self.folder}/ids/batch={batch}"
        )

    def compact(self) -> None:
        """Merge all batches into one, so that reading does not slow down with their number.

        The old ones stay in the folder, uncounted, for the cluster's retention rule.
        """
        old = sorted(self._live())
        if len(old) < 2:
            return
        batch = _COMPACT + uuid.uuid4().hex
        self._write_ids(self._ids(), batch)
        self._files().drop("batch").write.parquet(f"{self.folder}/files/batch={batch}")
        self.spark.createDataFrame([(b,) for b in old], "old string").coalesce(1).write.parquet(
            f"{self.folder}/merged/batch={batch}"
        )

    # -- reading --------------------------------------------------------------

    def _read(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}")
        except AnalysisException:  # nothing there yet
            return self.spark.createDataFrame([], schema)

    def _live(self) -> set[str]:
        """Names of the batches that count: finished, and not merged into another one."""
        merged = [tuple(r) for r in self._read("merged", _MERGED).select("batch", "old").collect()]
        stands, gone = {b for b, _ in merged}, {old for _, old in merged}
        finished = {r["batch"] for r in self._read("files", _FILES).select("batch").distinct().collect()}
        return {b for b in finished if not b.startswith(_COMPACT) or b in stands} - gone

    def _files(self) -> DataFrame:
        return self._read("files", _FILES).where(F.col("batch").isin(self._live()))

    def _ids(self) -> DataFrame:
        """(key, n) over all batches that count; the key's type is the table's own."""
        try:
            ids = self.spark.read.parquet(f"{self.folder}/ids")
        except AnalysisException:
            return self.spark.createDataFrame([], "key string, n long")
        return ids.where(F.col("batch").isin(self._live())).groupBy("key").agg(F.sum("n").alias("n"))

    def null_profile(self) -> DataFrame:
        """(column, n_rows, n_null, null_pct), as ``profiling.null_profile`` has it."""
        return self._files().groupBy("column").agg(
            F.sum("n_rows").alias("n_rows"), F.sum("n_null").alias("n_null")
        ).withColumn("null_pct", F.round(percent(F.col("n_null"), F.col("n_rows")), 6))

    def duplicate_ids(self) -> DataFrame:
        """One row (unique_ids, duplicated_ids, extra_rows), as ``profiling.duplicate_ids``."""
        return self._ids().agg(
            F.count(F.lit(1)).alias("unique_ids"),
            F.count_if(F.col("n") > 1).alias("duplicated_ids"),
            F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("extra_rows"),
        )

    def distinct_estimates(self) -> DataFrame:
        """(column, estimate): distinct values from the united sketches."""
        return self._files().groupBy("column").agg(
            F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("estimate")
        )


def _plain(path: str) -> str:
    """A file's address in one spelling (listings and metadata differ in escapes)."""
    return unquote(path).replace("file:///", "file:/")
