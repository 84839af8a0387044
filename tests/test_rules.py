import re

import pytest
from pyspark.sql import functions as F

from conftest import rows
from replyforge.functions import packs
from replyforge.operators import routing, rules

CASES = [
    ("Where is my order?", "order_status_tracking", 0.9, "order_status_tracking", "easy", "order_status_tracking"),
    ("I want a refund for my broken product.", "refund_return", 0.6, "product_defect", "medium", "refund_return"),
    ("My package was stolen.", "delivery_issue", 0.9, "delivery_issue", "easy", "delivery_issue"),
    ("I received the wrong item.", "product_defect", 0.9, "product_defect", "easy", "product_defect"),
    ("Cancel my prime membership.", "prime_membership", 0.9, "other_unknown", "hard", "refund_return"),
    ("I cannot access my account.", "other_unknown", 0.8, "other_unknown", "hard", "account_billing"),
    ("Talk to a real person.", "customer_service_escalation", 0.9, "customer_service_escalation", "easy", "customer_service_escalation"),
    ("Thank you.", "other_unknown", 0.8, "other_unknown", "hard", "other_unknown"),
    ("I cannot log into my account.", "other_unknown", 0.8, "account_billing", "easy", "account_billing"),
    ("I was charged twice", "account_billing", 0.9, "account_billing", "easy", "account_billing"),
    ("tracking says the courier has it", "other_unknown", 0.8, "delivery_issue", "medium", "order_status_tracking"),
    ("human please, my password fails", "other_unknown", 0.8, "account_billing", "medium", "account_billing"),
    ("account locked and prime video down", "account_billing", 0.6, "account_billing", "hard", "account_billing"),
    ("the robot took it", "other_unknown", 0.8, "customer_service_escalation", "easy", "other_unknown"),
    (None, "other_unknown", 0.8, "other_unknown", "hard", "other_unknown"),
]


@pytest.fixture(scope="module")
def texts(spark):
    data = [(i, c[0]) for i, c in enumerate(CASES)]
    return spark.createDataFrame(data, "i int, customer_text string")


def test_weak_labels(texts):
    got = rows(rules.weak_label(texts).orderBy("i"), "i", "intent", "confidence")
    assert sorted(got) == [(i, c[1], c[2]) for i, c in enumerate(CASES)]


def test_auto_labels(texts):
    got = rows(rules.auto_label(texts), "i", "intent", "difficulty")
    assert sorted(got) == [(i, c[3], c[4]) for i, c in enumerate(CASES)]


def test_auto_label_notes(texts):
    notes = {r.i: r.labeling_notes for r in rules.auto_label(texts).collect()}
    assert notes[12] == (
        "Multiple overlapping matches (account_billing, prime_membership). Chose first match."
    )
    assert notes[11] == "Matched account_billing and escalation. Prioritizing actionable issue."
    assert notes[2] == "Matched single rule for delivery_issue."


def test_keyword_labels(texts):
    got = rows(texts.select("i", rules.keyword_label(F.col("customer_text"))))
    assert sorted(got) == [(i, c[5]) for i, c in enumerate(CASES)]


def test_compiled_packs_equal_plain_regexes(spark):
    """Substring tests and regexes give what re.search gives, newlines included."""
    pieces = [p for pack in (packs.WEAK_RULES, packs.GOLDEN_RULES) for ps in pack.values() for p in ps]
    texts = [p.replace(".*", gap) for p in pieces for gap in ("", " x ", "\n", "\r")]
    texts = [t.lower() for t in texts]
    texts += [a + " " + b for a, b in zip(texts, texts[7:])]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for pack in (packs.WEAK_RULES, packs.GOLDEN_RULES):
        for row in rules.with_hits(df, "t", pack).collect():
            for name, patterns in pack.items():
                want = any(re.search(p, row.t) for p in patterns)
                assert row[f"_hit_{name}"] == want, (row.t, name)


def test_expected_escalation(spark):
    data = [
        ("refund_return", "fine"), ("other_unknown", "fine"), ("customer_service_escalation", "x"),
        ("refund_return", " it was STOLEN "), ("refund_return", "the agents"), ("refund_return", None),
    ]
    df = spark.createDataFrame(data, "i string, t string")
    got = [r[0] for r in df.select(rules.expected_escalation(F.col("i"), F.col("t"))).collect()]
    assert got == [0, 1, 1, 1, 1, 0]


def test_majority_tie_takes_smallest(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), ("c",)], "intent string")
    assert rows(rules.majority_class(df)) == [("a", 2)]


ROUTES = [
    ("My package was stolen.", "refund_return", 0.80, "delivery_issue", False, "No escalation required."),
    ("My package was stolen.", "refund_return", 0.585, "delivery_issue", True, "Low intent confidence: 58%"),
    ("Talk to a human", "prime_membership", 0.70, "customer_service_escalation", True, "Customer explicitly requested a human."),
    ("call supervisor", "customer_service_escalation", 0.90, "customer_service_escalation", True, "Escalation intent predicted."),
    ("I cannot access my account.", "prime_membership", 0.90, "account_billing", True, "Sensitive account/billing issue."),
    ("Thanks", "refund_return", 0.90, "other_unknown", True, "Unsupported or ambiguous customer request."),
    ("hi there", "prime_membership", 0.60, "prime_membership", False, "No escalation required."),
    ("lost, need a human", "prime_membership", 0.90, "delivery_issue", False, "No escalation required."),
]


def _routes(spark):
    data = [(i, r[0], r[1], r[2]) for i, r in enumerate(ROUTES)]
    return spark.createDataFrame(
        data, "i int, customer_text string, model_intent string, confidence double"
    )


def test_routing(spark):
    got = rows(routing.decide(_routes(spark)), "i", "intent", "needs_escalation", "escalation_reason")
    assert sorted(got) == [(i, *r[3:]) for i, r in enumerate(ROUTES)]


def test_high_risk_flag(spark):
    routed = routing.decide(_routes(spark), escalate_high_risk=True)
    assert routed.where("i = 0").first()["needs_escalation"] is True


def test_half_even_percent(spark):
    df = spark.createDataFrame([(x,) for x in (0.585, 0.595, 0.005, 0.0, 0.333)], "c double")
    got = [r[0] for r in df.select(routing.whole_percent_text(F.col("c"))).collect()]
    assert got == [f"{c * 100:.0f}%" for c in (0.585, 0.595, 0.005, 0.0, 0.333)]


def test_unknown_intent_takes_default_row(spark):
    df = spark.createDataFrame([("nonsense",), (None,), ("delivery_issue",)], "intent string")
    got = rows(routing.with_dimension(df), "intent", "priority")
    assert got == [("delivery_issue", "High"), ("nonsense", "Low"), (None, "Low")]


def test_blank_messages(spark):
    df = spark.createDataFrame([("a",), (" \t",), ("",), (None,)], "customer_text string")
    usable, rejected = routing.split_blank(df)
    assert usable.count() == 1 and rejected.count() == 3
    scored = df.withColumn("model_intent", F.lit("x")).withColumn("confidence", F.lit(0.123456))
    got = rows(routing.blank_default(scored), "model_intent", "confidence")
    assert got == [("other_unknown", 1.0)] * 3 + [("x", 0.1235)]


def test_response_record(spark):
    response = routing.respond(_routes(spark)).first()["response"]
    assert response.predictions.priority == "High"
    assert response.routing.assigned_department == "Logistics Escalations"
    assert response.reply_generation.draft_reply.startswith("I'm sorry to hear")


def test_expected_escalation_has_its_own_words(spark, monkeypatch):
    """The evaluation truth does not follow the routing words."""
    cases = [
        ("my parcel was stolen", "delivery_issue", 1), ("an AGENT please", "refund_return", 1),
        ("I cannot access my account", "account_billing", 1), ("where is it", "delivery_issue", 0),
        ("anything", "other_unknown", 1), ("anything", "customer_service_escalation", 1),
        ("the item is missing a part", "product_defect", 1), ("call a real person", "refund_return", 1),
        (None, "refund_return", 0),
    ]
    for name in ("LOSS_WORDS", "HUMAN_WORDS", "ACCOUNT_WORDS"):
        monkeypatch.setattr(packs, name, ["changed"])
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, t string, intent string, want int")
    got = df.select("i", rules.expected_escalation(F.col("intent"), F.col("t")).alias("e"))
    assert sorted(rows(got)) == [(i, c[2]) for i, c in enumerate(cases)]
