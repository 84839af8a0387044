"""Whole jobs, as a user of the message pipeline calls them.

Each job takes tables and returns tables; write the results with
``sources.writers`` and hand them to the next job as Parquet.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from replyforge.operators import (
    cleaning, features, golden as golden_ops, judging, metrics, model as ml, profiling, routing,
    rules, sampling, threads,
)
from replyforge.sources.stages import cut
from replyforge.functions import packs
from replyforge.functions.text import clean_message, normalised


def inspect(messages: DataFrame, top: int = 15) -> dict[str, DataFrame]:
    """Corpus profile."""
    return {
        "schema": profiling.schema_rows(messages),
        "missing_columns": profiling.missing_columns(messages),
        "nulls": profiling.null_profile(messages),
        "direction": profiling.direction_counts(messages),
        "duplicates": profiling.duplicate_ids(messages),
        "reply_fields": profiling.reply_fill_counts(messages),
        "brands": profiling.brand_summary(messages),
        "top_brands": profiling.top_brands(messages, top),
        "recommendation": profiling.brand_recommendation(messages),
        "flags": profiling.quality_flags(messages),
    }


def extract(messages: DataFrame, brand: str) -> DataFrame:
    """One brand's messages and the messages it answered, as a stage table."""
    return cut(threads.extract_brand(messages, brand), "extract")


def reconstruct(extracted: DataFrame, brand: str, max_depth: int = threads.MAX_DEPTH) -> DataFrame:
    return threads.reconstruct(extracted, brand, max_depth)


def clean(pairs: DataFrame, min_len: int = 10, long_len: int = 560) -> tuple[DataFrame, DataFrame]:
    """(clean pairs, removal ledger)."""
    return cleaning.clean_pairs(pairs, min_len, long_len), cleaning.clean_ledger(pairs, min_len)


def analyze(
    extracted: DataFrame, pairs: DataFrame, cleaned: DataFrame, brand: str,
    sample: int | None = None,
) -> dict[str, DataFrame]:
    """Figures of the conversation report."""
    return {
        "ledger": profiling.extraction_ledger(extracted, pairs, cleaned, brand),
        "turns": profiling.turn_stats(cleaned),
        "turn_histogram": profiling.turn_histogram(cleaned),
        "text_lengths": profiling.length_stats(cleaned),
        "dates": profiling.date_range(cleaned, "customer_created_at"),
        "words": profiling.word_topk(cleaned, "customer_text", "support_tweet_id", sample=sample),
        "skipped": threads.skip_accounting(extracted, brand),
        "orphans": threads.orphan_replies(extracted, brand),
        "quality": profiling.dq_counts(cleaned),
        "longest": profiling.longest_conversations(cleaned),
        "samples": profiling.sample_conversations(cleaned),
        "conversations": profiling.conversation_stats(cleaned),
    }


def discover(
    cleaned: DataFrame, sample: int | None = None, k: int = 10
) -> dict[str, DataFrame]:
    """n-grams and topic clusters of customer texts."""
    key, text = "support_tweet_id", "customer_text"
    corpus = cleaned if sample is None else sampling.uniform_sample(cleaned, key, sample)
    corpus = corpus.where(clean_message(F.col(text)) != "")
    clustered, centres = ml.topic_clusters(corpus, key, text, sample=None, k=k)
    return {
        "bigrams": features.ngram_topk(corpus, text, 2),
        "trigrams": features.ngram_topk(corpus, text, 3),
        "clusters": clustered,
        "profile": ml.cluster_profile(clustered, centres, key, text),
    }


def golden_sample(cleaned: DataFrame, n: int = golden_ops.GOLDEN_SIZE) -> DataFrame:
    return golden_ops.golden_sample(cleaned, n)


def validate(golden: DataFrame, taxonomy: DataFrame) -> dict[str, DataFrame]:
    return {
        "checks": golden_ops.validate_golden(golden, taxonomy),
        "intents": golden_ops.intent_distribution(golden),
        "difficulty": golden_ops.difficulty_distribution(golden),
    }


def weak_label(cleaned: DataFrame) -> DataFrame:
    """Training labels; keeps the message id for the leakage check."""
    return rules.weak_label(cleaned).select(
        "customer_tweet_id", "support_tweet_id", "customer_text", "support_text",
        "intent", "labeling_method", "confidence",
    )


def auto_label(golden: DataFrame) -> DataFrame:
    return rules.auto_label(golden)


def apply_review(
    golden: DataFrame, queue: DataFrame, expected_rows: int | None = golden_ops.GOLDEN_SIZE
) -> DataFrame:
    """Merge a finished review; refuses an unfinished one or a wrong row count."""
    golden_ops.require(golden_ops.review_gate(queue), "review queue has blank decisions")
    merged = golden_ops.apply_review(golden, queue)
    if expected_rows is not None:
        golden_ops.require(
            golden_ops.row_count_gate(merged, expected_rows), "unexpected golden row count"
        )
    return merged


def prepare_training(
    weak: DataFrame,
    golden: DataFrame | None = None,
    floor: float = 0.5,
    share: float = 0.1,
    key: str = "support_tweet_id",
    seed: int = 42,
) -> tuple[DataFrame, DataFrame]:
    """(rows with ``split``, summary): golden rows out, majority cut, split.

    ``key`` has to be unique; one message can occur in several pairs.
    """
    usable = weak.dropna(subset=["customer_text"]).where(F.col("confidence") >= floor)
    if golden is not None:
        usable = sampling.without_golden(usable, golden, "customer_tweet_id")
    # Labels are read several times below; compute them once.
    usable = cut(usable, "usable")
    balanced = cut(sampling.undersample(usable, key, "intent", packs.OTHER, seed), "balanced")
    total = weak.agg(F.count(F.lit(1))).scalar()
    summary = balanced.agg(F.count(F.lit(1)).alias("retained")).select(
        total.alias("total"), "retained", (total - F.col("retained")).alias("removed")
    )
    return sampling.train_val_split(balanced, key, "intent", share, seed), summary


def leakage(train: DataFrame, golden: DataFrame, key: str = "customer_tweet_id") -> DataFrame:
    """Training rows that repeat a golden row by id or by normalised text."""
    return sampling.leaked_rows(train, golden, normalised(F.col("customer_text")), key)


def train(rows: DataFrame) -> ml.IntentModel:
    return ml.train_classifier(rows)


def evaluate(preds: DataFrame) -> dict[str, DataFrame]:
    report = metrics.class_report(preds)
    return {
        "accuracy": metrics.accuracy(preds),
        "report": report,
        "averages": metrics.averages(report),
        "escalation": metrics.binary_metrics(preds),
        "confusion": metrics.confusion_matrix(preds),
        "confusion_pairs": metrics.confusion_pairs(preds),
        "error_marginals": metrics.error_marginals(preds),
        "display": metrics.report_table(report),
        "record": metrics.metrics_record(preds),
    }


def failures(preds: DataFrame) -> dict[str, DataFrame]:
    return {"rows": metrics.failure_rows(preds), "samples": metrics.error_samples(preds)}


def baselines(train_rows: DataFrame, preds: DataFrame) -> DataFrame:
    """One comparison row each: majority class, keyword rules, the routed model."""
    named = rules.with_majority(preds, train_rows, "intent", "majority").withColumn(
        "keyword", rules.keyword_label(F.col("customer_text"))
    )
    return metrics.model_comparison(
        [
            metrics.model_row(named, packs.MODEL_NAMES[0], pred="majority"),
            metrics.model_row(named, packs.MODEL_NAMES[1], pred="keyword"),
            metrics.model_row(preds, packs.MODEL_NAMES[2]),
        ]
    )


def judge(preds: DataFrame, n: int = 25) -> dict[str, DataFrame]:
    judged = judging.judge_sample(preds, n=n)
    return {
        "judged": judged,
        "summary": judging.judge_summary(judged),
        "human_template": judging.human_template(judged),
    }


def agreement(judged: DataFrame, human: DataFrame) -> DataFrame:
    """Agreement figures; while nobody has rated, one row saying so."""
    if judging.ratings_pending(human).first()["pending"]:
        return judging.ratings_pending(human)
    return judging.rater_agreement(judged, human)


def route(
    messages: DataFrame, model: ml.IntentModel, text: str = "customer_text", keep=(),
    digits: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(nested responses, rejected blank messages); confidence rounded to ``digits``."""
    usable, rejected = routing.split_blank(messages, text)
    return routing.respond(ml.score(usable, model, text, digits), text, keep), rejected
