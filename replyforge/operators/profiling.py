"""Corpus and conversation profiles: counts, shares, ranges, top lists.

All figures are ordinary aggregates with a partial step, so a hot key is
reduced inside each task.  Exact medians use ``percentile`` on lengths and turn
counts, whose state is one counter per distinct value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from replyforge.functions import packs
from replyforge.functions.numbers import parse_flag, parse_time, percent
from replyforge.functions.text import alpha_tokens, flatten_lines
from replyforge.operators.ranking import top_n
from replyforge.operators.sampling import uniform_sample
from replyforge.schemas import MESSAGE_COLUMNS


def schema_rows(df: DataFrame) -> DataFrame:
    """(position, column, type) of a table."""
    rows = [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema, 1)]
    return df.sparkSession.createDataFrame(rows, "position long, column string, type string")


def missing_columns(df: DataFrame, expected=MESSAGE_COLUMNS) -> DataFrame:
    """Expected columns the table lacks, one per row."""
    spark = df.sparkSession
    want = spark.createDataFrame([(c,) for c in expected], "column string")
    have = spark.createDataFrame([(c,) for c in df.columns], "column string")
    return want.exceptAll(have)


def null_profile(df: DataFrame) -> DataFrame:
    """(column, type, n_rows, n_null, null_pct) from one pass."""
    totals = df.agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns],
    )
    lines = F.array(
        *[
            F.struct(
                F.lit(f.name).alias("column"),
                F.lit(f.dataType.simpleString()).alias("type"),
                F.col("_rows").alias("n_rows"),
                F.col(f.name).alias("n_null"),
                F.round(percent(F.col(f.name), F.col("_rows")), 6).alias("null_pct"),
            )
            for f in df.schema
        ]
    )
    return totals.select(F.inline(lines))


def missing_values(df: DataFrame, label: str = "intent") -> DataFrame:
    """Columns with missing values, and whether a label column exists."""
    return null_profile(df).where("n_null > 0").select(
        "column", "n_rows", "n_null", F.lit(label in df.columns).alias("has_label")
    )


def direction_counts(messages: DataFrame) -> DataFrame:
    """Inbound / outbound / unknown direction with shares of all rows."""
    raw = F.col("inbound")
    flag = parse_flag(raw)
    totals = messages.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(flag).alias("inbound"),
        F.count_if(~flag).alias("outbound"),
        F.count_if(raw.isNull()).alias("unknown"),
    )
    return totals.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(name).alias("direction"),
                        F.col(name).alias("n"),
                        F.round(percent(F.col(name), F.col("n_rows")), 6).alias("pct"),
                    )
                    for name in ("inbound", "outbound", "unknown")
                ]
            )
        )
    )


def duplicate_ids(messages: DataFrame, key: str = "tweet_id") -> DataFrame:
    """Distinct ids, ids seen more than once, and the extra rows they make."""
    per_id = messages.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return per_id.agg(
        F.count(F.lit(1)).alias("unique_ids"),
        F.count_if(F.col("n") > 1).alias("duplicated_ids"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("extra_rows"),
    )


def author_counts(messages: DataFrame) -> DataFrame:
    """All and outbound messages of each author, one aggregation."""
    return messages.where("author_id is not null").groupBy("author_id").agg(
        F.count_if(~parse_flag(F.col("inbound"))).alias("outbound_messages"),
        F.count(F.lit(1)).alias("total_author_msgs"),
    )


def brand_summary(messages: DataFrame) -> DataFrame:
    """Authors that sent outbound messages."""
    return author_counts(messages).where("outbound_messages > 0")


def top_brands(messages: DataFrame, k: int = 15) -> DataFrame:
    """Top ``k`` brands with rank and share of all messages (ties by name)."""
    rows = messages.agg(F.count(F.lit(1)).alias("n")).scalar()
    best = top_n(brand_summary(messages), [F.desc("outbound_messages"), "author_id"], k, "rank")
    return best.select(
        "rank", "author_id", "outbound_messages",
        F.round(percent(F.col("outbound_messages"), rows), 6).alias("pct_of_rows"),
    )


def brand_recommendation(messages: DataFrame) -> DataFrame:
    """One row: the largest brand, the runner-up, and their size ratio."""
    top = top_brands(messages, 2).agg(
        F.max(F.when(F.col("rank") == 1, F.col("author_id"))).alias("best"),
        F.max(F.when(F.col("rank") == 1, F.col("outbound_messages"))).alias("best_outbound"),
        F.max(F.when(F.col("rank") == 2, F.col("author_id"))).alias("runner_up"),
        F.max(F.when(F.col("rank") == 2, F.col("outbound_messages"))).alias("runner_up_outbound"),
    )
    rows = messages.agg(F.count(F.lit(1)).alias("n")).scalar()
    return top.withColumn("best_pct", F.round(percent(F.col("best_outbound"), rows), 6))


def reply_fill_counts(messages: DataFrame) -> DataFrame:
    """Rows that are replies, and rows that got a reply."""
    return messages.agg(
        F.count("in_response_to_tweet_id").alias("are_replies"),
        F.count("response_tweet_id").alias("got_reply"),
    )


def quality_flags(messages: DataFrame, sparse_pct: float = 50.0) -> DataFrame:
    """(flag, value) for every quality rule that fires."""
    unknown = direction_counts(messages).where("direction = 'unknown' and n > 0").select(
        F.lit("direction_unknown").alias("flag"), F.col("n").cast("double").alias("value")
    )
    copies = duplicate_ids(messages).where("extra_rows > 0").select(
        F.lit("duplicate_id_rows").alias("flag"), F.col("extra_rows").cast("double").alias("value")
    )
    sparse = null_profile(messages).where(F.col("null_pct") > sparse_pct).select(
        F.concat(F.lit("sparse_column:"), "column").alias("flag"), F.col("null_pct").alias("value")
    )
    return unknown.unionByName(copies).unionByName(sparse)


def extraction_ledger(
    extract: DataFrame, pairs: DataFrame, clean: DataFrame, brand: str, approximate: bool = False
) -> DataFrame:
    """One row: extracted, paired and kept rows and conversations.

    With ``approximate`` conversations are counted by sketches (about two percent
    off), so that no distinct ids are exchanged.
    """
    distinct = F.approx_count_distinct if approximate else F.countDistinct
    extracted = extract.agg(
        F.count(F.lit(1)).alias("extracted"),
        F.count_if(F.col("author_id") == brand).alias("outbound"),
    )
    before = pairs.agg(
        F.struct(F.count(F.lit(1)).alias("n"), distinct("conversation_id").alias("c"))
    ).scalar()
    after = clean.agg(
        F.struct(F.count(F.lit(1)).alias("n"), distinct("conversation_id").alias("c"))
    ).scalar()
    return (
        extracted.withColumn("before", before)
        .withColumn("after", after)
        .select(
            "extracted",
            "outbound",
            (F.col("extracted") - F.col("outbound")).alias("customer"),
            F.col("before.n").alias("pairs_before"),
            F.col("after.n").alias("pairs_after"),
            F.col("before.c").alias("conversations_before"),
            F.col("after.c").alias("conversations_after"),
            (F.col("before.n") - F.col("after.n")).alias("pairs_removed"),
            F.round(
                percent(F.col("before.n") - F.col("after.n"), F.col("before.n")), 6
            ).alias("removed_pct"),
        )
    )


def conversation_lengths(clean: DataFrame) -> DataFrame:
    """(conversation_id, turns)."""
    return clean.groupBy("conversation_id").agg(F.max("conversation_turns").alias("turns"))


def turn_stats(clean: DataFrame) -> DataFrame:
    turns = F.col("turns")
    lengths = conversation_lengths(clean)
    stats = lengths.agg(
        F.count(F.lit(1)).alias("conversations"),
        F.round(F.avg(turns), 6).alias("avg_turns"),
        F.percentile(turns, F.lit(0.5)).alias("median_turns"),
        F.min(turns).alias("min_turns"),
        F.max(turns).alias("max_turns"),
        F.count_if(turns == 1).alias("single_turn"),
        F.count_if(turns >= 2).alias("multi_turn"),
    )
    whole = F.col("conversations")
    return stats.withColumn(
        "single_pct", F.round(percent(F.col("single_turn"), whole), 6)
    ).withColumn("multi_pct", F.round(percent(F.col("multi_turn"), whole), 6))


def turn_histogram(clean: DataFrame) -> DataFrame:
    """(turns, conversations, pct), from per-conversation counts.

    The total is the sum over the histogram, one row per distinct length.
    """
    bins = conversation_lengths(clean).groupBy("turns").agg(
        F.count(F.lit(1)).alias("conversations")
    )
    total = bins.agg(F.sum("conversations")).scalar()
    return bins.withColumn("pct", F.round(percent(F.col("conversations"), total), 6))


def length_stats(clean: DataFrame) -> DataFrame:
    """Mean / median / max characters, one row per side."""
    sides = ("customer", "support")
    figures = clean.agg(
        *[
            stat.alias(f"{side}_{name}")
            for side in sides
            for name, stat in _length_figures(F.length(f"{side}_text"))
        ]
    )
    return figures.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(side).alias("side"),
                        *[F.col(f"{side}_{n}").alias(f"{n}_len") for n in ("mean", "median", "max")],
                    )
                    for side in sides
                ]
            )
        )
    )


def _length_figures(length: Column):
    return (
        ("mean", F.round(F.avg(length), 6)),
        ("median", F.percentile(length, F.lit(0.5))),
        ("max", F.max(length).cast("long")),
    )


def date_range(df: DataFrame, column: str) -> DataFrame:
    """Earliest and latest parsed time, and how many values did not parse."""
    time = parse_time(F.col(column))
    return df.agg(
        F.min(time).alias("earliest"),
        F.max(time).alias("latest"),
        F.count_if(time.isNull()).alias("unparsed"),
    )


def conversation_stats(clean: DataFrame) -> DataFrame:
    """One row per conversation; 'first' texts are the first non-null ones."""
    def first(text):
        return F.min_by(text, F.when(F.col(text).isNotNull(), F.col("turn_index")))

    return clean.groupBy("conversation_id").agg(
        F.max("turn_index").alias("n_turns"),
        first("customer_text").alias("first_customer_text"),
        first("support_text").alias("first_support_text"),
        F.sum(F.length("customer_text")).alias("total_customer_chars"),
        F.sum(F.length("support_text")).alias("total_support_chars"),
    )


def dq_counts(clean: DataFrame, long_turns: int = 10, short_chars: int = 5) -> DataFrame:
    """Long conversations, very short customer texts, null shares."""
    long_convs = conversation_lengths(clean).agg(F.count_if(F.col("turns") >= long_turns)).scalar()
    nulls = lambda c: F.coalesce(
        F.round(F.avg(F.col(c).isNull().cast("int")) * 100, 6), F.lit(0.0)
    )
    return clean.agg(
        F.count_if(F.length("customer_text") < short_chars).alias("short_customer_texts"),
        nulls("customer_text").alias("customer_null_pct"),
        nulls("support_text").alias("support_null_pct"),
    ).withColumn("long_conversations", long_convs)


def longest_conversations(clean: DataFrame, k: int = 5, at_least: int = 10) -> DataFrame:
    long_ones = conversation_lengths(clean).where(F.col("turns") >= at_least)
    return top_n(long_ones, [F.desc("turns"), "conversation_id"], k)


def sample_conversations(clean: DataFrame, k: int = 2, width: int = 300) -> DataFrame:
    """All turns of the first ``k`` single-turn and multi-turn conversations."""
    lengths = conversation_lengths(clean)
    first = lambda cond, kind: (
        lengths.where(cond).orderBy("conversation_id").limit(k)
        .select("conversation_id", F.lit(kind).alias("kind"))
    )
    chosen = first("turns = 1", "single").unionByName(first("turns >= 2", "multi"))
    return clean.join(F.broadcast(chosen), "conversation_id").select(
        "kind", "conversation_id", "turn_index",
        flatten_lines(F.col("customer_text"), width, stripped=True).alias("customer_text"),
        flatten_lines(F.col("support_text"), width, stripped=True).alias("support_text"),
    )


def word_topk(
    df: DataFrame,
    text: str,
    key: str,
    k: int = 25,
    sample: int | None = None,
    stop_words=packs.REPORT_STOP_WORDS,
    seed: int = 42,
) -> DataFrame:
    """Most frequent a-z words of three or more letters, stop words left out.

    Counts the whole table; a ``sample`` size counts that many rows only.
    """
    texts = df.where(F.col(text).isNotNull())
    if sample is not None:
        texts = uniform_sample(texts, key, sample, seed)
    counts = (
        texts.select(F.explode(alpha_tokens(F.col(text))).alias("word"))
        .where((F.length("word") > 2) & ~F.col("word").isin(*stop_words))
        .groupBy("word")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return top_n(counts, [F.desc("n"), "word"], k)
