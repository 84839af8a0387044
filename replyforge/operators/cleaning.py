"""Cleaning (customer, support) pairs and accounting for what was removed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from replyforge.functions import packs
from replyforge.functions.numbers import percent
from replyforge.functions.text import is_blank, strip
from replyforge.operators.ranking import HOT_ROWS, keep_first, number_within, top_n
from replyforge.sources.stages import cut

MIN_SUPPORT_LEN = 10
LONG_SUPPORT_LEN = 560
PAIR = ["customer_tweet_id", "support_tweet_id"]


def failed_step(min_len: int = MIN_SUPPORT_LEN) -> Column:
    """Name of the first row-level step that removes a pair; NULL if none."""
    customer, support = F.col("customer_text"), F.col("support_text")
    return (
        F.when(customer.isNull() | support.isNull(), packs.CLEAN_STEPS[0][0])
        .when(is_blank(customer) | is_blank(support), packs.CLEAN_STEPS[1][0])
        .when(F.length(strip(support)) < min_len, packs.CLEAN_STEPS[2][0])
    )


def flag_long(df: DataFrame, limit: int = LONG_SUPPORT_LEN) -> DataFrame:
    return df.withColumn(
        "support_text_len", F.length("support_text").cast("long")
    ).withColumn("is_long_response", F.col("support_text_len") > limit)


def deduplicated(pairs: DataFrame) -> DataFrame:
    """One row per (customer, support) pair; copies settled by turn, then text."""
    order = [c for c in ("turn_index",) if c in pairs.columns]
    return keep_first(pairs, PAIR, [*order, "customer_text", "support_text"])


def clean_pairs(
    pairs: DataFrame,
    min_len: int = MIN_SUPPORT_LEN,
    long_len: int = LONG_SUPPORT_LEN,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Usable pairs, long replies flagged, turns numbered anew."""
    usable = pairs.where(failed_step(min_len).isNull())
    flagged = flag_long(deduplicated(usable), long_len)
    kept = cut(flagged.drop("turn_index", "conversation_turns"), "clean")
    # A reply can answer several messages: rows are unique by the pair.
    order = ["support_tweet_id", "customer_tweet_id"]
    return number_within(kept, ["conversation_id"], order, hot_rows=hot_rows)


def clean_ledger(pairs: DataFrame, min_len: int = MIN_SUPPORT_LEN) -> DataFrame:
    """Rows removed by each step, in step order, from one pass over the pairs.

    Pairs are counted per key first, so copies of one pair are added up inside
    each task; a duplicate is a surviving copy beyond the first.
    """
    steps = [name for name, _ in packs.CLEAN_STEPS]
    per_pair = (
        pairs.withColumn("_step", failed_step(min_len))
        .groupBy(*PAIR)
        .agg(
            F.count(F.lit(1)).alias("rows"),
            *[F.count_if(F.col("_step") == s).alias(s) for s in steps[:3]],
            F.count_if(F.col("_step").isNull()).alias("usable"),
        )
        .withColumn(steps[3], F.greatest(F.col("usable") - 1, F.lit(0)))
    )
    totals = per_pair.agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"),
        *[F.coalesce(F.sum(s), F.lit(0)).alias(s) for s in steps],
    )
    lines = F.array(
        *[
            F.struct(
                F.lit(i).cast("long").alias("step_no"),
                F.lit(name).alias("step"),
                F.col(name).alias("removed"),
                F.lit(reason.format(min_len=min_len)).alias("reason"),
                F.round(percent(F.col(name), F.col("rows")), 6).alias("removed_pct"),
            )
            for i, (name, reason) in enumerate(packs.CLEAN_STEPS, 1)
        ]
    )
    return totals.select(F.inline(lines))


def short_reply_topk(
    pairs: DataFrame, k: int = 10, min_len: int = MIN_SUPPORT_LEN
) -> DataFrame:
    """Most frequent support texts among those removed as too short."""
    short = pairs.where(failed_step(min_len) == packs.CLEAN_STEPS[2][0])
    counts = short.groupBy("support_text").agg(F.count(F.lit(1)).alias("n"))
    return top_n(counts, [F.desc("n"), "support_text"], k)
