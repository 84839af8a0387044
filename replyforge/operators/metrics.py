"""Classification, escalation, error and comparison metrics.

Everything starts from ``confusion_counts``: one partial aggregation turns the
prediction table into at most labels x labels rows, and all metrics are small
arithmetic over those.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from replyforge.functions import packs
from replyforge.functions.numbers import ratio

TRUE, PRED = "true_intent", "predicted_intent"


def confusion_counts(preds: DataFrame, true: str = TRUE, pred: str = PRED) -> DataFrame:
    return preds.groupBy(F.col(true).alias("t"), F.col(pred).alias("p")).agg(
        F.count(F.lit(1)).alias("n")
    )


def accuracy(preds: DataFrame, true: str = TRUE, pred: str = PRED) -> DataFrame:
    n = F.count(F.lit(1))
    right = F.count_if(F.col(true) == F.col(pred))
    return preds.agg(n.alias("n"), right.alias("correct")).withColumn(
        "accuracy", ratio(F.col("correct"), F.col("n"))
    )


def _scores(counts: DataFrame) -> DataFrame:
    """(label, tp, predicted, support, precision, recall, f1) per label."""
    sides = counts.select(
        F.explode(
            F.array(
                F.struct(F.col("t").alias("label"), F.lit(1).alias("is_true"), F.lit(0).alias("is_pred")),
                F.struct(F.col("p").alias("label"), F.lit(0).alias("is_true"), F.lit(1).alias("is_pred")),
            )
        ).alias("side"),
        F.col("n"),
        (F.col("t") == F.col("p")).cast("int").alias("same"),
    )
    per_label = sides.groupBy(F.col("side.label").alias("label")).agg(
        F.sum(F.col("n") * F.col("same") * F.col("side.is_true")).alias("tp"),
        F.sum(F.col("n") * F.col("side.is_pred")).alias("predicted"),
        F.sum(F.col("n") * F.col("side.is_true")).alias("support"),
    )
    precision = ratio(F.col("tp"), F.col("predicted"))
    recall = ratio(F.col("tp"), F.col("support"))
    return per_label.withColumn("precision", precision).withColumn("recall", recall).withColumn(
        "f1",
        ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")),
    )


def class_report(preds: DataFrame, true: str = TRUE, pred: str = PRED) -> DataFrame:
    """(label, precision, recall, f1, support) over the union of both label sets."""
    return _scores(confusion_counts(preds, true, pred)).select(
        "label", "precision", "recall", "f1", "support"
    )


def averages(report: DataFrame) -> DataFrame:
    """(average, precision, recall, f1): macro and support-weighted."""
    names = ("precision", "recall", "f1")
    weighted = lambda c: ratio(F.sum(F.col(c) * F.col("support")), F.sum("support"))
    row = report.agg(
        *[F.avg(c).alias(f"macro_{c}") for c in names],
        *[weighted(c).alias(f"weighted_{c}") for c in names],
    )
    return row.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(kind).alias("average"), *[F.col(f"{kind}_{c}").alias(c) for c in names]
                    )
                    for kind in ("macro", "weighted")
                ]
            )
        )
    )


def binary_metrics(
    preds: DataFrame, true: str = "expected_escalation", pred: str = "predicted_escalation"
) -> DataFrame:
    """Counts and scores of the positive class (1); a missing flag is not positive."""
    t, p = F.col(true).eqNullSafe(F.lit(1)), F.col(pred).eqNullSafe(F.lit(1))
    counts = preds.agg(
        F.count_if(t & p).alias("tp"),
        F.count_if(~t & p).alias("fp"),
        F.count_if(t & ~p).alias("fn"),
        F.count_if(~t & ~p).alias("tn"),
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return counts.select(
        "tp", "fp", "fn", "tn",
        ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"),
        ratio(tp, tp + fp).alias("precision"),
        ratio(tp, tp + fn).alias("recall"),
        ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
    )


def escalation_totals(df: DataFrame, flag: str = "expected_escalation") -> DataFrame:
    return df.groupBy(flag).agg(F.count(F.lit(1)).alias("n"))


def confusion_matrix(
    preds: DataFrame, labels=packs.ALL_INTENTS, true: str = TRUE, pred: str = PRED
) -> DataFrame:
    """Dense long matrix (true_intent, predicted_intent, n) over the given labels.

    Each label supplies one zero row per other label from a literal array, so
    the dense grid needs no join.
    """
    spark = preds.sparkSession
    names = F.array(*[F.lit(x) for x in sorted(labels)])
    grid = (
        spark.range(1)
        .select(F.explode(names).alias("t"))
        .select("t", F.explode(names).alias("p"), F.lit(0).cast("long").alias("n"))
    )
    counted = confusion_counts(preds, true, pred)
    return grid.unionByName(counted).groupBy(
        F.col("t").alias("true_intent"), F.col("p").alias("predicted_intent")
    ).agg(F.sum("n").alias("n"))


def wide_confusion_matrix(
    preds: DataFrame, labels=packs.ALL_INTENTS, true: str = TRUE, pred: str = PRED
) -> DataFrame:
    """One row per true label, one column per predicted label."""
    return preds.groupBy(true).pivot(pred, sorted(labels)).count().na.fill(0)


def errors(preds: DataFrame, true: str = TRUE, pred: str = PRED) -> DataFrame:
    """Wrong predictions; a missing prediction of a known class is wrong too."""
    return preds.where(~F.col(true).eqNullSafe(F.col(pred)))


def confusion_pairs(preds: DataFrame, k: int = 10, true: str = TRUE, pred: str = PRED) -> DataFrame:
    """Most frequent (true, predicted) errors."""
    counts = errors(preds, true, pred).groupBy(
        F.col(true).alias("true_intent"), F.col(pred).alias("predicted_intent")
    ).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), "true_intent", "predicted_intent").limit(k)


def error_marginals(preds: DataFrame, true: str = TRUE, pred: str = PRED) -> DataFrame:
    """(side, intent, n): errors by true and by predicted label, in one pass.

    The error pairs are counted first; each pair then adds to both margins.
    """
    pairs = confusion_counts(errors(preds, true, pred), true, pred)
    side = lambda name, c: F.struct(F.lit(name).alias("side"), F.col(c).alias("intent"))
    return (
        pairs.select("n", F.explode(F.array(side("true", "t"), side("predicted", "p"))).alias("s"))
        .groupBy("s.side", "s.intent")
        .agg(F.sum("n").alias("n"))
    )


def failure_rows(preds: DataFrame, key: str = "example_id") -> DataFrame:
    """Every wrong prediction with category, likely reason and suggestion."""
    fell_back = F.col(PRED) == packs.OTHER
    unsure = ~fell_back & (F.col("confidence") < packs.CONFIDENCE_FLOOR)
    return errors(preds).select(
        key,
        F.col("customer_text").alias("input_ticket"),
        F.col(TRUE).alias("expected_output"),
        F.col(PRED).alias("actual_output"),
        F.when(unsure, packs.FAILURE_LOW).otherwise(packs.FAILURE_WRONG).alias("failure_category"),
        F.when(fell_back, packs.FAILURE_REASON_OTHER)
        .otherwise(packs.FAILURE_REASON)
        .alias("possible_reason"),
        F.when(fell_back, packs.FAILURE_FIX_OTHER)
        .otherwise(packs.FAILURE_FIX)
        .alias("suggested_improvement"),
    )


def error_samples(preds: DataFrame, k: int = 15, key: str = "example_id") -> DataFrame:
    """First ``k`` wrong predictions by key."""
    return (
        errors(preds).orderBy(key).limit(k)
        .select(key, "customer_text", TRUE, PRED, "confidence")
    )


def model_row(preds: DataFrame, name: str, true: str = TRUE, pred: str = PRED) -> DataFrame:
    """(model, accuracy, macro_f1, weighted_f1) of one prediction column.

    Accuracy comes from the same label counts, so the table is read once.
    """
    scores = _scores(confusion_counts(preds, true, pred))
    return scores.agg(
        ratio(F.sum("tp"), F.sum("support")).alias("accuracy"),
        F.avg("f1").alias("macro_f1"),
        ratio(F.sum(F.col("f1") * F.col("support")), F.sum("support")).alias("weighted_f1"),
    ).select(F.lit(name).alias("model"), "accuracy", "macro_f1", "weighted_f1")


def model_comparison(rows: list[DataFrame]) -> DataFrame:
    table = rows[0]
    for row in rows[1:]:
        table = table.unionByName(row)
    return table


def metrics_record(preds: DataFrame) -> DataFrame:
    """One row, one JSON text: accuracy, averages and the per-class report.

    The report has one entry per label, so gathering it is bounded by the
    taxonomy.
    """
    scores = _scores(confusion_counts(preds))
    r6 = lambda c: F.round(c, 6)
    weighted = lambda c: ratio(F.sum(F.col(c) * F.col("support")), F.sum("support"))
    entry = F.struct(
        F.col("label"),
        r6(F.col("precision")).alias("precision"),
        r6(F.col("recall")).alias("recall"),
        r6(F.col("f1")).alias("f1-score"),
        F.col("support"),
    )
    triple = lambda agg: F.struct(
        *[r6(agg(c)).alias(n) for c, n in (("precision", "precision"), ("recall", "recall"), ("f1", "f1-score"))]
    )
    body = F.struct(
        r6(ratio(F.sum("tp"), F.sum("support"))).alias("accuracy"),
        triple(F.avg).alias("macro_avg"),
        triple(weighted).alias("weighted_avg"),
        F.sort_array(F.collect_list(entry)).alias("classification_report"),
    )
    return scores.agg(F.to_json(body).alias("metrics"))


def report_table(report: DataFrame, digits: int = 2) -> DataFrame:
    """Per-class rows of a stored report, rounded for display; summary rows left out."""
    summary = ("accuracy", "macro avg", "weighted avg")
    return report.where(~F.col("label").isin(*summary)).select(
        "label", *[F.round(c, digits).alias(c) for c in ("precision", "recall", "f1")], "support"
    )


def predictions_table(scored: DataFrame, key: str = "example_id") -> DataFrame:
    """The evaluation table: truth, prediction, confidence, escalation flags."""
    return scored.select(
        key,
        "customer_text",
        TRUE,
        F.col("intent").alias(PRED),
        "confidence",
        F.col(TRUE).eqNullSafe(F.col("intent")).alias("correct"),
        "expected_escalation",
        F.col("needs_escalation").cast("int").alias("predicted_escalation"),
    )


def pearson(a: Column, b: Column) -> Column:
    """Pearson r as an aggregate; NaN when a side is constant."""
    spread = F.stddev_pop(a) * F.stddev_pop(b)
    flat = (F.stddev_pop(a) == 0) | (F.stddev_pop(b) == 0)
    return F.when(flat, F.lit(float("nan"))).otherwise(F.try_divide(F.covar_pop(a, b), spread))
