"""Corpus pipeline: raw documents to token digests, one operator per stage.

Each stage takes (spark, docs, sf_dir) and works on every row its predecessor
kept; all but the last return the columns of ``documents``.  ``run`` writes
each stage's result as Parquet to the shared folder and reads it back, so a
lost executor costs one stage's tasks and no plan grows over several stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from replyforge.llm import bpe, decontaminate, line_dedup, near_dedup, quality
from replyforge.llm.queries import BYTE_BPE, import_here, table
from replyforge.sources.stages import cut


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that importance resampling draws."""
    import_here(spark)
    return quality.resample(docs, table(spark, sf_dir, "labels"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shortens texts by their repeated lines; n_chars follows the text."""
    import_here(spark)
    columns = docs.columns
    kept = line_dedup.drop_repeated_lines(docs).select(*columns)
    if "n_chars" in columns:
        n_chars = F.length("text").cast(docs.schema["n_chars"].dataType)
        kept = kept.withColumn("n_chars", n_chars)
    return kept


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each group of near copies."""
    import_here(spark)
    return near_dedup.keep_one(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes documents that hold a window of a benchmark item."""
    import_here(spark)
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes what is left: (doc_id, n_tokens, ids_sha256, decoded_sha256)."""
    import_here(spark)
    return bpe.encode_documents(docs, BYTE_BPE)


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("near-duplicates", near_stage),
    ("benchmark decontamination", benchmark_stage),
    ("token ids", token_stage),
]

# Sampling noise, signatures and merges have no SQL twin; see the tests.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
