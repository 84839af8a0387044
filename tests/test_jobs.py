"""The jobs chained end to end on the smallest test tables."""

import pytest
from pyspark.sql import functions as F

from replyforge.functions import packs
from replyforge.operators import judging
from replyforge.plans import jobs, views
from replyforge.sources.stages import cut

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    spiked = views.spiked(spark, SF).select(
        F.col("customer_tweet_id").alias("tweet_id"), F.col("customer_text").alias("text")
    )
    messages = views.messages(spark, SF).drop("text").join(spiked, "tweet_id").withColumn(
        "author_id", F.when(F.col("inbound"), F.col("author_id")).otherwise("shop")
    )
    extracted = jobs.extract(messages, "shop")
    pairs = cut(jobs.reconstruct(extracted, "shop"), "pairs")
    cleaned, ledger = jobs.clean(pairs)
    return extracted, pairs, cut(cleaned, "cleaned"), ledger


def test_turns_are_gapless_and_ledger_adds_up(stages):
    _, pairs, cleaned, ledger = stages
    per = cleaned.groupBy("conversation_id").agg(
        F.min("turn_index").alias("lo"), F.max("turn_index").alias("hi"),
        F.countDistinct("turn_index").alias("n"), F.max("conversation_turns").alias("total"),
    )
    assert per.where("lo != 1 or hi != n or n != total").count() == 0
    removed = ledger.agg(F.sum("removed")).first()[0]
    assert removed + cleaned.count() == pairs.count()


def test_analyze(stages):
    extracted, pairs, cleaned, _ = stages
    report = jobs.analyze(extracted, pairs, cleaned, "shop")
    figures = report["ledger"].first()
    assert figures.pairs_before == pairs.count() and figures.pairs_after == cleaned.count()
    histogram = report["turn_histogram"].collect()
    assert sum(r.conversations for r in histogram) == report["turns"].first().conversations
    assert sum(r.pct for r in histogram) == pytest.approx(100, abs=1e-4)
    assert report["conversations"].count() == figures.conversations_after
    for name in ("text_lengths", "dates", "words", "skipped", "quality", "samples"):
        assert report[name].count() > 0, name
    assert report["skipped"].first().parent_missing == report["orphans"].count()


def test_discover(stages):
    found = jobs.discover(stages[2], k=2)
    assert found["profile"].agg(F.sum("size")).first()[0] == found["clusters"].count()
    assert found["bigrams"].count() == 20


def test_label_train_route(spark, stages):
    cleaned = stages[2]
    weak = cut(jobs.weak_label(cleaned), "weak")
    golden = cut(jobs.auto_label(jobs.golden_sample(cleaned, 9)), "golden")
    assert golden.count() == 9
    rows, summary = jobs.prepare_training(weak, golden)
    rows = cut(rows, "rows")
    totals = summary.first()
    assert totals.retained == rows.count() and totals.total == weak.count()
    assert jobs.leakage(rows, golden).where(
        F.col("customer_tweet_id").isin([r.customer_tweet_id for r in golden.collect()])
    ).count() == 0
    sizes = {r.intent: r["count"] for r in rows.groupBy("intent").count().collect()}
    other = sizes.pop(packs.OTHER, 0)
    assert other <= sum(sizes.values())
    model = jobs.train(rows.where("split = 'train'"))
    routed, blank = jobs.route(cleaned, model, keep=("support_tweet_id",))
    assert routed.count() + blank.count() == cleaned.count()
    departments = {r[0] for r in routed.select("response.routing.assigned_department").distinct().collect()}
    assert departments <= {row[2] for row in packs.DIMENSION.values()}


def test_evaluate_and_judge(spark):
    preds = cut(views.predictions(spark, SF), "preds")
    report = jobs.evaluate(preds)
    wrong = preds.where("not correct").count()
    assert report["error_marginals"].where("side = 'true'").agg(F.sum("n")).first()[0] == wrong
    assert report["confusion"].agg(F.sum("n")).first()[0] == preds.count()
    assert jobs.failures(preds)["rows"].count() == wrong
    models = jobs.baselines(views.weak_labels(spark, SF), preds).collect()
    assert [m.model for m in models] == list(packs.MODEL_NAMES)
    judged = jobs.judge(preds)
    assert judged["judged"].count() == 25
    human = judged["human_template"].withColumn("human_overall_score", F.lit(None).cast("int"))
    assert jobs.agreement(judged["judged"], human).first()["pending"] is True
    rated = human.withColumn("human_overall_score", F.lit(4))
    assert jobs.agreement(judged["judged"], rated).first()["rated"] == 25
    assert judged["judged"].columns[-1] == "judge_reason" and len(judging.SCORES) == 6
