"""Stand-in views: the generic test tables seen as support-message tables.

The reference data set is not available, so the queries read ``conversations``,
``documents`` and ``events`` through these views.  Every view keeps all rows and
whole texts; the modulo terms only decide which rows get a defect (a missing
parent, a blank text, a copy), never which rows are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from replyforge.functions import packs
from replyforge.operators import features
from replyforge.operators.model import IntentModel
from replyforge.operators.routing import decide
from replyforge.operators.rules import auto_label, expected_escalation, weak_label
from replyforge.sources.readers import read_table, spread
from replyforge.sources.stages import cut

BRAND = "brand1"

# Phrases appended to texts so that every rule has something to find.
PHRASES = (
    "where is my order", "tracking number please", "it has not shipped",
    "package was stolen", "delivered but nothing here", "the courier lost it",
    "i want a refund", "refund for my broken product", "charged twice",
    "password locked", "cancel prime", "prime video app keeps crash",
    "wrong item and missing part", "stopped working", "talk to a real person",
    "human please my login is locked", "supervisor now, money back",
    "access my account", "late delivery, tracking says delayed",
    "refund, never arrived", "when will it ship", "thank you",
    "the robot took it", "",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, dealt over all cores for work on their texts."""
    return spread(table(spark, sf_dir, "documents"))


def _message_columns():
    conv, turn, role = F.col("conv_id"), F.col("turn"), F.col("role")
    tweet_id = conv * 1000 + turn + 1
    minute = F.expr(
        "cast(timestamp_ntz'2017-10-01 00:00:00'"
        " + make_dt_interval(0, cast(conv_id as int), cast(turn * 7 as int), 0) as string)"
    )
    return [
        "conv_id",
        "turn",
        "role",
        tweet_id.alias("tweet_id"),
        F.when(role == "assistant", F.concat(F.lit("brand"), (conv % 5).cast("string")))
        .when(role == "user", F.concat(F.lit("user"), conv.cast("string")))
        .otherwise("system")
        .alias("author_id"),
        (role != "assistant").alias("inbound"),
        F.when((conv % 29 == 0) & (turn == 0), "bad").otherwise(minute).alias("created_at"),
        "text",
        F.when(turn == 0, F.lit(None).cast("bigint"))
        .when((turn == 1) & (conv % 17 == 0), F.lit(None).cast("bigint"))
        .when((turn == 3) & (conv % 13 == 0), tweet_id + 900_000_000)
        .otherwise(tweet_id - 1)
        .alias("in_response_to_tweet_id"),
    ]


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(*_message_columns())


def messages_with_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages plus ``response_tweet_id``: the next turn's id, where there is one."""
    base = messages(spark, sf_dir)
    following = base.where("turn > 0").select((F.col("tweet_id") - 1).alias("_before"))
    return base.join(following, F.col("tweet_id") == F.col("_before"), "left").select(
        "tweet_id", "author_id", "inbound", "created_at", "text",
        (F.col("_before") + 1).cast("string").alias("response_tweet_id"),
        "in_response_to_tweet_id",
    )


def dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages with missing, blank, short, very long and repeated rows."""
    conv, turn = F.col("conv_id"), F.col("turn")
    text = (
        F.when((conv % 23 == 0) & (turn == 5), F.lit(None).cast("string"))
        .when((conv % 11 == 3) & (turn == 3), "   ")
        .when((conv % 11 == 5) & (turn == 1), "DM us")
        .when((conv % 7 == 0) & (turn == 1), F.repeat("text", F.lit(12)))
        .otherwise(F.col("text"))
    )
    copies = F.when(conv % 19 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return messages(spark, sf_dir).withColumn("text", text).withColumn(
        "copy", F.explode(copies)
    )


def dirty_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(message, reply) pairs of all brands over the dirty messages."""
    rows = dirty(spark, sf_dir)
    reply = rows.where("role = 'assistant' and in_response_to_tweet_id is not null").select(
        "copy",
        F.col("conv_id").alias("conversation_id"),
        F.col("in_response_to_tweet_id").alias("customer_tweet_id"),
        F.col("tweet_id").alias("support_tweet_id"),
        F.col("text").alias("support_text"),
        F.col("created_at").alias("support_created_at"),
    )
    parent = rows.select(
        "copy",
        F.col("tweet_id").alias("customer_tweet_id"),
        F.col("author_id").alias("customer_author_id"),
        F.col("text").alias("customer_text"),
        F.col("created_at").alias("customer_created_at"),
    )
    return reply.join(parent, ["copy", "customer_tweet_id"]).drop("copy")


def spike(conversations: DataFrame) -> DataFrame:
    """All messages as customer texts with one rule phrase appended."""
    phrase = F.element_at(
        F.array(*[F.lit(p) for p in PHRASES]),
        ((F.col("conv_id") * 7 + F.col("turn")) % len(PHRASES) + 1).cast("int"),
    )
    return conversations.select(*_message_columns()).select(
        "conv_id",
        "turn",
        F.col("tweet_id").alias("customer_tweet_id"),
        F.concat(F.lit("M"), F.col("tweet_id").cast("string")).alias("example_id"),
        F.concat("text", F.lit(" "), phrase).alias("customer_text"),
    )


def spiked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spike(spread(table(spark, sf_dir, "conversations")))


def with_model_stand_in(df: DataFrame) -> DataFrame:
    """``model_intent`` from the weak rules, ``confidence`` in steps of half a
    percent from the ids, so that every routing branch occurs."""
    confidence = ((F.col("conv_id") * 7 + F.col("turn") * 13) % 200) / F.lit(200.0)
    return (
        weak_label(df)
        .withColumnRenamed("intent", "model_intent")
        .drop("labeling_method")
        .withColumn("confidence", confidence)
    )


def routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decide(with_model_stand_in(spiked(spark, sf_dir)))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Truth from the auto labeller, prediction from the routed path."""
    truth = auto_label(spiked(spark, sf_dir)).withColumnRenamed("intent", "true_intent")
    decided = decide(with_model_stand_in(truth.drop("difficulty", "labeling_notes")))
    return decided.select(
        "example_id",
        "customer_tweet_id",
        "customer_text",
        "true_intent",
        F.col("intent").alias("predicted_intent"),
        "confidence",
        (F.col("true_intent") == F.col("intent")).alias("correct"),
        expected_escalation(F.col("true_intent"), F.col("customer_text")).alias(
            "expected_escalation"
        ),
        F.col("needs_escalation").cast("int").alias("predicted_escalation"),
    )


def patchy_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions of which some are missing, as are some truths, sometimes both."""
    key = F.col("customer_tweet_id")
    rows = predictions(spark, sf_dir).withColumns({
        "predicted_intent": F.when(key % 7 != 3, F.col("predicted_intent")),
        "true_intent": F.when(key % 11 != 5, F.col("true_intent")),
        "predicted_escalation": F.when(key % 7 != 3, F.col("predicted_escalation")),
    })
    same = F.col("true_intent").eqNullSafe(F.col("predicted_intent"))
    return rows.withColumn("correct", same)


def weak_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weak_label(spiked(spark, sf_dir))


def golden(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every message auto-labelled, as a golden set awaiting review."""
    return auto_label(spiked(spark, sf_dir))


def review_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Review table of all messages: which were flagged and what the reviewer said."""
    slot = (F.col("conv_id") * 5 + F.col("turn")) % 12
    return spiked(spark, sf_dir).select(
        "example_id",
        F.element_at(
            F.array(*[F.lit(i) for i in packs.INTENTS]), (F.col("conv_id") % 7 + 1).cast("int")
        ).alias("suggested_intent"),
        F.when(slot == 0, "wrong phrase").when(slot < 3, "wrong product").otherwise("").alias(
            "reason_for_review"
        ),
        F.when(slot == 0, "accept").when(slot == 1, " Accept\t").when(slot == 2, "reject")
        .otherwise("").alias("human_decision"),
    ).withColumn("final_intent", F.col("suggested_intent"))


def event_chain(spark: SparkSession, sf_dir: str, cycles: bool = False) -> DataFrame:
    """Events as one deep reply forest: each event answers an earlier one, a
    few ids back.  With ``cycles`` every 50th event answers a later one."""
    event, back = F.col("event_id"), F.col("event_id") - 1 - F.col("user_id") % 3
    parent = F.when((event % 50 == 0) & F.lit(cycles), event + 3).otherwise(
        F.when(back >= 0, back)
    )
    return table(spark, sf_dir, "events").select(
        event.alias("tweet_id"), parent.alias("in_response_to_tweet_id")
    )


def document_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as first-turn customer messages."""
    return documents(spark, sf_dir).select(
        F.col("doc_id").alias("customer_tweet_id"),
        F.col("doc_id").alias("conversation_id"),
        F.lit(1).cast("long").alias("turn_index"),
        F.col("text").alias("customer_text"),
    )


def human_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stand-in ratings 1..5 by id; every sixth is still missing."""
    score = (F.col("conv_id") + F.col("turn") * 3) % 6
    return spiked(spark, sf_dir).select(
        "example_id", F.when(score > 0, score).alias("human_overall_score")
    )


# Fixed values of the given model: vocabulary size, biases, steps per unit.
GIVEN_FEATURES = 2000
GIVEN_STEPS = 250.0
GIVEN_BIASES = [0.3, -0.1, 0.2, 0.0, -0.2, 0.1, 0.4, -0.3]


def given_model(spark: SparkSession, sf_dir: str) -> IntentModel:
    """A model over all messages whose coefficients any engine can work out.

    Its terms are the words and pairs of at least two messages, the most
    frequent ones, with their idf; a coefficient is a hash of term and intent in
    steps from -4 to 4.
    """
    words = cut(
        spiked(spark, sf_dir).select(
            "customer_tweet_id", features.training_words(F.col("customer_text")).alias("words")
        ), "given-words",
    )
    grams = features.gram_lists(words, "customer_tweet_id", F.col("words"), (1, 2))
    vocab = features.with_idf(features.vocabulary(grams, 2, GIVEN_FEATURES), words)
    labels = list(packs.ALL_INTENTS)
    digest = lambda name: F.md5(F.concat("term", F.lit(f":{name}")))
    coefficients = F.array(*[
        (F.conv(F.substring(digest(name), 1, 6), 16, 10).cast("long") % 2001 - 1000) / F.lit(GIVEN_STEPS)
        for name in labels
    ])
    terms = cut(vocab.withColumn("coefficients", coefficients), "given-terms")
    return IntentModel(terms, GIVEN_BIASES, labels)
