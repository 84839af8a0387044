"""The hand-labelled golden set: draw, validate, queue for review, apply review."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from replyforge.functions import packs
from replyforge.functions.ordering import seeded_hash
from replyforge.functions.text import normalised
from replyforge.operators.sampling import length_bins, stratified_pick
from replyforge.sources.stages import cut

GOLDEN_SIZE = 250


def golden_sample(clean: DataFrame, n: int = GOLDEN_SIZE, seed: int = 42) -> DataFrame:
    """``n`` first-turn messages, stratified by text length, shuffled and numbered."""
    # Edges, histograms and picks read this table several times, lengths mostly.
    first = cut(
        clean.where("turn_index = 1").select(
            "customer_tweet_id", "customer_text", "conversation_id",
            F.length("customer_text").cast("long").alias("text_len"),
        ), "first-turns",
    )
    binned = length_bins(first, "text_len")
    picked = stratified_pick(binned, "customer_tweet_id", "len_bin", n, 3, seed)
    # Numbering sorts the n picked rows only.
    shuffled = Window.orderBy(
        seeded_hash(F.col("customer_tweet_id"), f"{seed}:shuffle"), "customer_tweet_id"
    )
    return picked.withColumn("_at", F.row_number().over(shuffled)).select(
        F.format_string("GS-%03d", "_at").alias("example_id"),
        "customer_tweet_id",
        "customer_text",
        F.lit(packs.UNLABELED).alias("intent"),
        F.lit("").alias("labeling_notes"),
        F.col("conversation_id").alias("source_conversation_id"),
        F.lit("").alias("difficulty"),
        "text_len",
        "len_bin",
    )


def validate_golden(
    golden: DataFrame, taxonomy: DataFrame, low: int = 150, high: int = 250
) -> DataFrame:
    """(check_no, check_name, ok, bad) rows; ``bad`` counts what the check found wrong.

    A missing intent is an invalid one.
    """
    allowed = taxonomy.select(F.col("name").alias("_name"))
    invalid = (
        golden.where(~F.col("intent").eqNullSafe(F.lit(packs.UNLABELED)))
        .groupBy("intent").agg(F.count(F.lit(1)).alias("n"))
        .join(F.broadcast(allowed), F.col("intent") == F.col("_name"), "left_anti")
        .agg(F.count(F.lit(1)))
        .scalar()
    )
    repeated = (
        golden.groupBy("example_id").agg(F.count(F.lit(1)).alias("n"))
        .agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)))
        .scalar()
    )
    totals = golden.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col("customer_text").isNull()).alias("missing"),
        F.count_if(F.col("intent") == packs.UNLABELED).alias("unlabeled"),
    ).withColumn("repeated", repeated).withColumn("invalid", invalid)
    check = lambda no, name, ok, bad: F.struct(
        F.lit(no).cast("long").alias("check_no"),
        F.lit(name).alias("check_name"),
        ok.alias("ok"),
        bad.cast("long").alias("bad"),
    )
    in_range = F.col("n_rows").between(low, high)
    return totals.select(
        F.inline(
            F.array(
                check(1, "row_count", in_range, F.when(in_range, 0).otherwise(F.col("n_rows"))),
                check(2, "duplicate_ids", F.col("repeated") == 0, F.col("repeated")),
                check(3, "missing_text", F.col("missing") == 0, F.col("missing")),
                check(4, "invalid_intents", F.col("invalid") == 0, F.col("invalid")),
                check(5, "all_labeled", F.col("unlabeled") == 0, F.col("unlabeled")),
            )
        )
    )


def intent_distribution(df: DataFrame, intent: str = "intent") -> DataFrame:
    """(intent, n, pct) of labelled rows."""
    counts = (
        df.where((F.col(intent) != packs.UNLABELED)).groupBy(F.col(intent).alias("intent"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    total = counts.agg(F.sum("n")).scalar()
    return counts.withColumn("pct", F.round(F.col("n") / total * 100, 6))


def difficulty_distribution(golden: DataFrame) -> DataFrame:
    """Blank difficulty counts as missing."""
    return (
        golden.where("difficulty is not null and difficulty != ''")
        .groupBy("difficulty").agg(F.count(F.lit(1)).alias("n"))
    )


def review_queue(golden: DataFrame, flagged: DataFrame) -> DataFrame:
    """Golden rows flagged for review, with the suggestion and blank verdicts.

    ``flagged`` (example_id, suggested_intent, reason_for_review) is an input
    table; a row without a reason is not flagged.  Spark sizes the join.
    """
    reasons = flagged.where(normalised(F.col("reason_for_review")) != "")
    return golden.join(reasons, "example_id").select(
        "example_id",
        "customer_text",
        F.col("intent").alias("current_intent"),
        "suggested_intent",
        "reason_for_review",
        F.lit("").alias("human_decision"),
        F.lit("").alias("final_intent"),
    )


def review_gate(queue: DataFrame) -> DataFrame:
    """One row: is every decision and final intent filled in?"""
    blank = lambda c: F.col(c).isNull() | (F.col(c) == "")
    open_rows = F.count_if(blank("human_decision") | blank("final_intent"))
    return queue.agg(open_rows.alias("open_rows")).withColumn("ok", F.col("open_rows") == 0)


def row_count_gate(df: DataFrame, expected: int = GOLDEN_SIZE) -> DataFrame:
    """One row: does the table have exactly the expected number of rows?"""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("ok", F.col("n_rows") == expected)


def require(gate: DataFrame, message: str) -> None:
    """Raise when a one-row gate is not ok."""
    if not gate.first()["ok"]:
        raise ValueError(message)


def apply_review(golden: DataFrame, queue: DataFrame) -> DataFrame:
    """Golden set with accepted decisions merged in; other ids are ignored.

    Of several accepted decisions for one id the last by final intent holds.
    """
    accepted = queue.where(normalised(F.col("human_decision")) == "accept").groupBy(
        "example_id"
    ).agg(F.max("final_intent").alias("_new"), F.lit(True).alias("_accepted"))
    hit = F.col("_accepted").isNotNull()
    return (
        golden.join(accepted, "example_id", "left")
        .withColumn("intent", F.when(hit, F.col("_new")).otherwise(F.col("intent")))
        .withColumn("difficulty", F.when(hit, "medium").otherwise(F.col("difficulty")))
        .withColumn(
            "labeling_notes",
            F.when(hit, packs.NOTE_REVIEWED).otherwise(F.col("labeling_notes")),
        )
        .withColumn("corrected", hit)
        .drop("_new", "_accepted")
    )
