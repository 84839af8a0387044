import math

import pytest
from pyspark.sql import functions as F

from conftest import rows
from replyforge.operators import golden, judging, metrics


def _preds(spark, pairs):
    return spark.createDataFrame(pairs, "true_intent string, predicted_intent string")


SMALL = [("a", "a"), ("a", "b"), ("b", "b"), ("c", "a")]


def test_class_report(spark):
    got = {r[0]: r[1:] for r in rows(metrics.class_report(_preds(spark, SMALL)))}
    assert got["a"] == (0.5, 0.5, 0.5, 2)
    assert got["b"][:2] == (0.5, 1.0) and got["b"][2] == pytest.approx(2 / 3)
    assert got["c"] == (0.0, 0.0, 0.0, 1)


def test_averages(spark):
    report = metrics.class_report(_preds(spark, SMALL))
    got = {r.average: r.f1 for r in metrics.averages(report).collect()}
    assert got["macro"] == pytest.approx(7 / 18) and got["weighted"] == pytest.approx(5 / 12)
    assert metrics.accuracy(_preds(spark, SMALL)).first()["accuracy"] == 0.5


def test_published_escalation_figures(spark):
    cells = [(1, 1, 190), (0, 1, 42), (1, 0, 5), (0, 0, 13)]
    data = [(t, p) for t, p, n in cells for _ in range(n)]
    row = metrics.binary_metrics(
        spark.createDataFrame(data, "expected_escalation int, predicted_escalation int")
    ).first()
    assert row.accuracy == pytest.approx(0.812)
    assert row.precision == pytest.approx(0.8189655172413793)
    assert row.recall == pytest.approx(0.9743589743589743)
    assert row.f1 == pytest.approx(0.8899297423887588)


def test_published_majority_figures(spark):
    sizes = {"other_unknown": 187, "delivery_issue": 25, "refund_return": 9,
             "order_status_tracking": 9, "product_defect": 7, "account_billing": 6,
             "customer_service_escalation": 5, "prime_membership": 2}
    data = [(k, "other_unknown") for k, n in sizes.items() for _ in range(n)]
    row = metrics.model_row(_preds(spark, data), "m").first()
    assert row.accuracy == pytest.approx(0.748)
    assert row.macro_f1 == pytest.approx(0.10697940503432495)
    assert row.weighted_f1 == pytest.approx(0.6401647597254004)


def test_confusion_matrix_is_dense(spark):
    got = rows(metrics.confusion_matrix(_preds(spark, SMALL), labels=("a", "b", "c")))
    assert len(got) == 9 and ("c", "a", 1) in got and ("c", "c", 0) in got


def test_error_marginals_and_pairs(spark):
    preds = _preds(spark, SMALL)
    assert rows(metrics.error_marginals(preds)) == [
        ("predicted", "a", 1), ("predicted", "b", 1), ("true", "a", 1), ("true", "c", 1)
    ]
    assert rows(metrics.confusion_pairs(preds, 1)) == [("a", "b", 1)]


def test_failure_categories(spark):
    data = [
        ("1", "t", "refund_return", "other_unknown", 0.4),
        ("2", "t", "refund_return", "delivery_issue", 0.4),
        ("3", "t", "refund_return", "delivery_issue", 0.9),
        ("4", "t", "refund_return", "refund_return", 0.9),
    ]
    df = spark.createDataFrame(
        data, "example_id string, customer_text string, true_intent string, "
        "predicted_intent string, confidence double"
    )
    got = rows(metrics.failure_rows(df), "example_id", "failure_category")
    assert got == [("1", "Wrong Classification"), ("2", "Low Confidence Misclassification"),
                   ("3", "Wrong Classification")]


def test_heuristic_judge(spark):
    data = [("x" * 21, "a", "a"), ("x" * 21, "a", "b"), ("x" * 20, "a", "a")]
    df = spark.createDataFrame(data, "reply string, p string, t string")
    got = [tuple(r) for r in judging.judge_scores(df, "reply", "p", "t").select(*judging.SCORES).collect()]
    assert got == [(5, 4, 5, 4, 5, 4), (2, 4, 5, 4, 5, 4), (5, 2, 3, 2, 5, 3)]


def _agreement(spark, judge, human):
    j = spark.createDataFrame(
        [(str(i), x) for i, x in enumerate(judge)], "example_id string, judge_overall_score int"
    )
    h = spark.createDataFrame(
        [(str(i), x) for i, x in enumerate(human)], "example_id string, human_overall_score int"
    )
    return judging.rater_agreement(j, h).first()


def test_agreement_with_a_constant_rater(spark):
    row = _agreement(spark, [4, 4, 4], [4, 5, 1])
    assert row.exact_pct == pytest.approx(33.333333)
    assert row.within_one_pct == pytest.approx(66.666667)
    assert row.mean_abs_diff == pytest.approx(4 / 3, abs=1e-6)
    assert math.isnan(row.pearson)


def test_agreement_skips_unrated(spark):
    row = _agreement(spark, [1, 2, 3, 5], [2, 3, 4, None])
    assert row.rated == 3 and row.pearson == pytest.approx(1.0)


def test_pending_ratings(spark):
    df = spark.createDataFrame([(None,), (None,)], "human_overall_score int")
    assert judging.ratings_pending(df).first()["pending"] is True


def test_judge_reply_defaults(spark):
    df = spark.createDataFrame(
        [('{"scores":{"safety":5},"reason":"ok"}',), ("broken",)], "a string"
    )
    got = [r[0] for r in df.select(judging.parse_judge_reply(F.col("a"))).collect()]
    assert tuple(got[0]) == (0, 0, 0, 0, 5, 0, "ok") and tuple(got[1]) == (0,) * 6 + ("",)


def test_golden_validation(spark):
    data = [("GS-1", "a", "refund_return", ""), ("GS-1", None, "bogus", "easy"),
            ("GS-2", "b", "UNLABELED", None)]
    df = spark.createDataFrame(
        data, "example_id string, customer_text string, intent string, difficulty string"
    )
    taxonomy = spark.createDataFrame([("refund_return",)], "name string")
    got = rows(golden.validate_golden(df, taxonomy), "check_name", "ok", "bad")
    assert got == [("all_labeled", False, 1), ("duplicate_ids", False, 1),
                   ("invalid_intents", False, 1), ("missing_text", False, 1),
                   ("row_count", False, 3)]
    assert rows(golden.difficulty_distribution(df)) == [("easy", 1)]


def test_apply_review_needs_a_finished_queue(spark):
    from replyforge.plans import jobs

    gold = spark.createDataFrame(
        [("GS-1", "x", "easy", "n"), ("GS-2", "y", "easy", "n")],
        "example_id string, intent string, difficulty string, labeling_notes string",
    )
    cols = "example_id string, human_decision string, final_intent string"
    open_queue = spark.createDataFrame([("GS-1", "", "z")], cols)
    with pytest.raises(ValueError):
        jobs.apply_review(gold, open_queue, 2)
    queue = spark.createDataFrame([("GS-1", " Accept ", "z"), ("GS-9", "accept", "z")], cols)
    with pytest.raises(ValueError):
        jobs.apply_review(gold, queue, 250)
    merged = jobs.apply_review(gold, queue, 2)
    assert rows(merged, "example_id", "intent", "difficulty", "corrected") == [
        ("GS-1", "z", "medium", True), ("GS-2", "y", "easy", False)
    ]


def test_missing_predictions_are_errors(spark):
    preds = spark.createDataFrame(
        [("1", "a", None, 0.9), ("2", "a", "b", 0.9), ("3", "a", "a", 0.9), ("4", None, None, 0.9)],
        "example_id string, true_intent string, predicted_intent string, confidence double",
    ).withColumn("customer_text", F.lit("t"))
    assert rows(metrics.failure_rows(preds), "example_id") == [("1",), ("2",)]
    assert rows(metrics.confusion_pairs(preds)) == sorted([("a", "b", 1), ("a", None, 1)], key=repr)
    assert metrics.error_samples(preds).count() == 2
    flags = spark.createDataFrame([(1, 1), (1, None), (None, 1), (0, None)], "e int, p int")
    got = metrics.binary_metrics(flags, "e", "p").first()
    assert (got["tp"], got["fp"], got["fn"], got["tn"]) == (1, 1, 1, 1)


def test_repeated_review_and_missing_intents(spark):
    df = spark.createDataFrame(
        [("1", "x", "t", "", ""), ("2", None, "t", "", "")],
        "example_id string, intent string, customer_text string, difficulty string, "
        "labeling_notes string")
    queue = spark.createDataFrame(
        [("1", "accept", "a"), ("1", "Accept ", "b"), ("2", "reject", "c")],
        "example_id string, human_decision string, final_intent string")
    assert rows(golden.apply_review(df, queue), "example_id", "intent") == [("1", "b"), ("2", None)]
    taxonomy = spark.createDataFrame([("x",)], "name string")
    checks = {r.check_name: r.bad for r in golden.validate_golden(df, taxonomy).collect()}
    assert checks["invalid_intents"] == 1
