"""Reply quality: heuristic judge, its summary, and agreement with people."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from replyforge.functions import packs
from replyforge.operators.metrics import pearson
from replyforge.operators.routing import fill, with_dimension
from replyforge.operators.sampling import uniform_sample

SCORES = (
    "judge_intent_score", "judge_relevance_score", "judge_grounding_score",
    "judge_helpfulness_score", "judge_safety_score", "judge_overall_score",
)


def judge_scores(df: DataFrame, reply: str, pred: str, true: str) -> DataFrame:
    """Add the six heuristic scores and the judge's reason."""
    long_enough = F.length(reply) > 20
    grounded = F.col(reply).contains("Template fallback") | long_enough
    score = lambda cond, yes, no: F.when(cond, yes).otherwise(no).cast("long")
    scored = (
        df.withColumn(SCORES[0], score(F.col(pred) == F.col(true), 5, 2))
        .withColumn(SCORES[1], score(long_enough, 4, 2))
        .withColumn(SCORES[2], score(grounded, 5, 3))
        .withColumn(SCORES[3], score(long_enough, 4, 2))
        .withColumn(SCORES[4], F.lit(5).cast("long"))
    )
    total = F.col(SCORES[0])
    for name in SCORES[1:5]:
        total = total + F.col(name)
    return scored.withColumn(SCORES[5], F.floor(total / 5)).withColumn(
        "judge_reason", F.lit(packs.JUDGE_REASON)
    )


def judge_sample(preds: DataFrame, key: str = "example_id", n: int = 25, seed: int = 42):
    """``n`` predictions with evidence, template reply and heuristic scores."""
    sample = uniform_sample(preds, key, n, seed)
    replied = with_dimension(sample, "predicted_intent")
    scored = judge_scores(replied, "reply", "predicted_intent", "true_intent")
    return scored.select(
        key,
        F.col("customer_text").alias("customer_message"),
        F.col("true_intent").alias("expected_intent"),
        "predicted_intent",
        "confidence",
        F.col("evidence").alias("retrieved_evidence"),
        F.col("reply").alias("generated_reply"),
        F.lit(packs.REPLY_MODE).alias("reply_mode"),
        *SCORES,
        "judge_reason",
    )


def human_template(judged: DataFrame, key: str = "example_id") -> DataFrame:
    """Blank rating sheet for the judged replies."""
    blanks = ("human_overall_score", "human_grounding_score", "human_helpfulness_score",
              "human_safety_score", "human_comments")
    return judged.select(
        key, "customer_message", "generated_reply", *[F.lit("").alias(c) for c in blanks]
    )


def judge_summary(judged: DataFrame) -> DataFrame:
    return judged.agg(
        F.count(F.lit(1)).alias("examples"),
        *[F.round(F.avg(c), 6).alias("avg_" + c.removeprefix("judge_")) for c in SCORES],
    )


def judge_prompt(message: Column, predicted: Column, expected: Column, evidence: Column, reply: Column):
    return fill(
        packs.JUDGE_PROMPT, message=message, predicted=predicted, expected=expected,
        evidence=evidence, reply=reply,
    )


def parse_judge_reply(answer: Column) -> Column:
    """struct of scores and reason from a judge's JSON text; missing scores are 0."""
    names = ("intent_correctness", "relevance", "grounding", "helpfulness", "safety", "overall_quality")
    parsed = F.from_json(
        answer,
        "struct<scores:struct<" + ",".join(f"{n}:int" for n in names) + ">,reason:string>",
    )
    return F.struct(
        *[
            F.coalesce(parsed["scores"][n], F.lit(0)).alias(out)
            for n, out in zip(names, SCORES)
        ],
        F.coalesce(parsed["reason"], F.lit("")).alias("judge_reason"),
    )


def ratings_pending(human: DataFrame) -> DataFrame:
    """One row: has nobody rated anything yet?"""
    return human.agg(
        F.count("human_overall_score").alias("rated"),
        (F.count("human_overall_score") == 0).alias("pending"),
    )


def rater_agreement(judged: DataFrame, human: DataFrame, key: str = "example_id") -> DataFrame:
    """Exact and within-one agreement, mean absolute difference, Pearson r."""
    rated = human.where("human_overall_score is not null").select(
        key, F.col("human_overall_score").cast("double").alias("h")
    )
    both = judged.select(key, F.col("judge_overall_score").cast("double").alias("j")).join(rated, key)
    gap = F.abs(F.col("j") - F.col("h"))
    return both.agg(
        F.count(F.lit(1)).alias("rated"),
        F.round(F.avg((gap == 0).cast("int")) * 100, 6).alias("exact_pct"),
        F.round(F.avg((gap <= 1).cast("int")) * 100, 6).alias("within_one_pct"),
        F.round(F.avg(gap), 6).alias("mean_abs_diff"),
        F.round(pearson(F.col("j"), F.col("h")), 6).alias("pearson"),
    )
