"""The registered queries of this folder, one for each operator."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from replyforge.llm import (
    bpe, chat, decontaminate, filter_audit, fingerprints, group_join, kd_shards, line_dedup,
    near_dedup, quality, token_files, toxicity, whitening,
)
from replyforge.llm.oracle import SQL

__all__ = ["QUERIES", "SQL"]

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


REPOSITORY = str(Path(__file__).resolve().parents[2])


def import_here(spark: SparkSession) -> None:
    """Lets Python workers import this package from where the driver has it."""
    known = spark.sparkContext.environment.get("PYTHONPATH", "").split(":")
    if REPOSITORY not in known:
        spark.sparkContext.environment["PYTHONPATH"] = ":".join(filter(None, [*known, REPOSITORY]))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    import_here(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without lines that three documents share."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.drop_repeated_lines(docs).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256")
    )


def op2_quality_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with log weight, sampling key and decision."""
    return quality.Resampler(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    ).decisions()


def op3_reply_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -1, formatted and read back."""
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame(
        [(-1, 0, "user", probe), (-1, 1, "assistant", probe)],
        "conv_id long, turn long, role string, text string",
    )
    out = chat.format_trees(chat.thread_messages(given.unionByName(extra)), branches=1)
    turns = F.array_join(
        F.transform(
            chat.read_turns(F.col("formatted")),
            lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")),
        ),
        "",
    )
    loss = chat.read_loss(F.col("formatted"), F.col("loss_spans"))
    return out.withColumn("loss", loss).select(
        F.col("tree").alias("conv_id"),
        F.size(chat.read_turns(F.col("formatted"))).cast("long").alias("n_turns"),
        F.sha2(turns, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op4_bag_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every document."""
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op5_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents and their edited texts as one-permutation MinHash fingerprints."""
    return fingerprints.fingerprint_next(table(spark, sf_dir, "documents"))


def op6_pair_index_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded and decoded by the byte-level vocabulary."""
    return bpe.encode_documents(table(spark, sf_dir, "documents"), BYTE_BPE)


def op7_suffix_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents searched for windows of all benchmark items."""
    found = decontaminate.find_matches(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    )
    n_hit = decontaminate.hit_words()
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def op8_toxic_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents scored by a CRF trained on the labelled rows not held out."""
    docs = table(spark, sf_dir, "documents")
    tagger = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score_documents(docs, tagger).select(
        "doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
        F.size("spans").cast("long").alias("n_spans"),
    )


def op9_context_mixing_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as word-tokenizer ids, written to range-coded files and read back."""
    folder = token_files.write_token_files(table(spark, sf_dir, "documents"), WORD_BPE, end_id=2)
    return token_files.read_token_files(spark, folder)


def op10_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards of nearly equal bytes."""
    out = kd_shards.shard_documents(table(spark, sf_dir, "documents"), shards=16)
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op11_grouped_prefix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their component of the shingle-set similarity join."""
    return group_join.linked(table(spark, sf_dir, "documents"))


def op12_filter_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every step of all 120 orders of five filters over all documents, by language."""
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_qd_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings, whitened along four components."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_quality_resampling": op2_quality_resampling,
    "op3_reply_trees": op3_reply_trees,
    "op4_bag_minhash": op4_bag_minhash,
    "op5_document_fingerprints": op5_document_fingerprints,
    "op6_pair_index_bpe": op6_pair_index_bpe,
    "op7_suffix_arrays": op7_suffix_arrays,
    "op8_toxic_crf": op8_toxic_crf,
    "op9_context_mixing_files": op9_context_mixing_files,
    "op10_kd_shards": op10_kd_shards,
    "op11_grouped_prefix_join": op11_grouped_prefix_join,
    "op12_filter_orders": op12_filter_orders,
    "op13_qd_whitening": op13_qd_whitening,
}
