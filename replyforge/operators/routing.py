"""Routing one message: overrides, escalation, dimension lookup, reply record."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from replyforge.functions import packs
from replyforge.functions.numbers import whole_percent_text
from replyforge.functions.text import contains_any, is_blank, normalised


def dimension(spark: SparkSession) -> DataFrame:
    """Eight fixed rows: what each intent maps to."""
    rows = [
        (name, *packs.DIMENSION[name], packs.EVIDENCE[name], packs.REPLIES[name])
        for name in packs.ALL_INTENTS
    ]
    return spark.createDataFrame(
        rows,
        "intent string, label string, priority string, department string, action string, "
        "evidence string, reply string",
    )


def override(text: Column, model_intent: Column) -> Column:
    """struct(intent, reason): phrase overrides on top of the model's intent."""
    low = normalised(text)
    case = lambda intent, reason: F.struct(
        intent.alias("intent"), F.lit(reason).alias("reason")
    )
    return (
        F.when(contains_any(low, packs.LOSS_WORDS), case(F.lit("delivery_issue"), ""))
        .when(contains_any(low, packs.HUMAN_WORDS), case(F.lit(packs.ESCALATION), packs.REASON_HUMAN))
        .when(
            contains_any(low, packs.ACCOUNT_WORDS),
            case(F.lit("account_billing"), packs.REASON_ACCOUNT),
        )
        .when(low.isin(*packs.GREETINGS), case(F.lit(packs.OTHER), ""))
        .otherwise(case(model_intent, ""))
    )


def escalation(
    intent: Column,
    confidence: Column,
    reason: Column,
    floor: float = packs.CONFIDENCE_FLOOR,
    text: Column | None = None,
) -> Column:
    """struct(needs, reason) of the escalation decision.

    ``confidence`` stays the model's own, also for an overridden intent.  Pass
    ``text`` to also escalate every message with a loss word.
    """
    case = lambda needs, why: F.struct(
        F.lit(needs).alias("needs"), why.alias("reason")
    )
    decision = (
        F.when(confidence < floor, case(True, F.concat(F.lit(packs.REASON_LOW), whole_percent_text(confidence))))
        .when(
            intent == packs.ESCALATION,
            case(True, F.when(reason != "", reason).otherwise(packs.REASON_ESCALATION)),
        )
        .when(intent == packs.OTHER, case(True, F.lit(packs.REASON_OTHER)))
        .when(reason.contains("Sensitive"), case(True, reason))
    )
    if text is not None:
        decision = decision.when(
            contains_any(normalised(text), packs.LOSS_WORDS),
            case(True, F.lit("High-risk delivery phrase.")),
        )
    return decision.otherwise(case(False, F.lit(packs.REASON_NONE)))


def decide(
    df: DataFrame,
    text: str = "customer_text",
    intent: str = "model_intent",
    confidence: str = "confidence",
    escalate_high_risk: bool = False,
) -> DataFrame:
    """Add ``intent``, ``override_reason``, ``needs_escalation``, ``escalation_reason``."""
    df = df.withColumn("_over", override(F.col(text), F.col(intent)))
    verdict = escalation(
        F.col("_over.intent"),
        F.col(confidence),
        F.col("_over.reason"),
        text=F.col(text) if escalate_high_risk else None,
    )
    return (
        df.withColumn("_esc", verdict)
        .withColumn("intent", F.col("_over.intent"))
        .withColumn("override_reason", F.col("_over.reason"))
        .withColumn("needs_escalation", F.col("_esc.needs"))
        .withColumn("escalation_reason", F.col("_esc.reason"))
        .drop("_over", "_esc")
    )


def confidence_flags(df: DataFrame, confidence: str = "confidence", floor=packs.CONFIDENCE_FLOOR):
    return df.withColumn(
        "confidence_flag", F.when(F.col(confidence) < floor, "low").otherwise("ok")
    )


def with_dimension(df: DataFrame, intent: str = "intent") -> DataFrame:
    """Dimension columns of the intent, those of the fallback intent otherwise.

    The dimension is eight fixed rows, so broadcasting it is safe at any scale.
    """
    known = F.when(F.col(intent).isin(*packs.ALL_INTENTS), F.col(intent)).otherwise(packs.OTHER)
    dim = dimension(df.sparkSession).withColumnRenamed("intent", "_dim_intent")
    return (
        df.withColumn("_known", known)
        .join(F.broadcast(dim), F.col("_known") == F.col("_dim_intent"), "left")
        .drop("_known", "_dim_intent")
    )


def fill(template: str, **values: Column) -> Column:
    """A text template with ``{name}`` slots as one concat; NULL prints as ''."""
    parts = []
    for i, piece in enumerate(re.split(r"(?<!\{)\{(\w+)\}(?!\})", template)):
        if i % 2:
            parts.append(F.coalesce(values[piece].cast("string"), F.lit("")))
        elif piece:
            parts.append(F.lit(piece.replace("{{", "{").replace("}}", "}")))
    return F.concat(*parts)


def reply_prompt(message: Column, evidence: Column) -> Column:
    return fill(packs.REPLY_PROMPT, message=message, evidence=evidence)


def split_blank(df: DataFrame, text: str = "customer_text") -> tuple[DataFrame, DataFrame]:
    """(usable, rejected): NULL and blank messages are not scored."""
    blank = F.coalesce(is_blank(F.col(text)), F.lit(True))
    return df.where(~blank), df.where(blank)


def blank_default(df: DataFrame, text: str = "customer_text") -> DataFrame:
    """The other convention for blanks: fallback intent with confidence 1."""
    blank = F.coalesce(is_blank(F.col(text)), F.lit(True))
    return df.withColumn(
        "model_intent", F.when(blank, packs.OTHER).otherwise(F.col("model_intent"))
    ).withColumn("confidence", F.when(blank, 1.0).otherwise(F.round("confidence", 4)))


def respond(df: DataFrame, text: str = "customer_text", keep=()) -> DataFrame:
    """Nested response per message, from ``model_intent`` and ``confidence``."""
    full = with_dimension(decide(df, text))
    return full.select(*keep, response(text).alias("response"))


def response(text: str = "customer_text") -> Column:
    return F.struct(
        F.col(text).alias("customer_message"),
        F.struct(
            F.col("intent"),
            F.col("confidence"),
            F.col("priority"),
            F.col("needs_escalation").alias("needs_human_escalation"),
            F.col("escalation_reason"),
        ).alias("predictions"),
        F.struct(F.col("department").alias("assigned_department")).alias("routing"),
        F.col("action").alias("suggested_action"),
        F.struct(
            F.col("reply").alias("draft_reply"),
            F.lit(packs.REPLY_MODE).alias("generation_mode"),
            F.col("evidence").alias("evidence_used"),
        ).alias("reply_generation"),
    )
