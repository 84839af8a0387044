import hashlib
import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from conftest import rows
from replyforge.operators import sampling


def order(keys, seed=42):
    return sorted(keys, key=lambda k: (hashlib.md5(f"{seed}:{k}".encode()).hexdigest(), k))


@pytest.fixture(scope="module")
def table(spark):
    return spark.range(3000).select(
        F.col("id"), F.when(F.col("id") % 3 == 0, "big").otherwise(
            F.concat(F.lit("c"), (F.col("id") % 4).cast("string"))).alias("label")
    )


@pytest.mark.parametrize("n", [0, 1, 7, 1000, 1001, 2999, 3000, 5000])
def test_uniform_sample_is_exact(table, n):
    got = {r.id for r in sampling.uniform_sample(table, "id", n).collect()}
    assert got == set(order(range(3000))[:n])


@pytest.mark.parametrize("digits", [1, 2, 5])
def test_histogram_path_for_every_prefix_width(table, spark, monkeypatch, digits):
    monkeypatch.setattr(sampling, "PREFIX_DIGITS", digits)
    for n in (0, 1, 16, 500, 2999, 3000):
        quota = spark.createDataFrame([(n,)], "quota long")
        got = {r.id for r in sampling.take_quota(table, "id", quota).collect()}
        assert got == set(order(range(3000))[:n]), n


def test_quota_per_group(table, spark):
    quota = spark.createDataFrame(
        [("big", 10), ("c0", 0), ("c1", 10_000), ("c2", 3)], "label string, quota long"
    )
    got = Counter(r.label for r in sampling.take_quota(table, "id", quota, "label").collect())
    sizes = Counter(r.label for r in table.collect())
    assert got == {"big": 10, "c1": sizes["c1"], "c2": 3, "c3": sizes["c3"]}


def test_small_per_group(table):
    got = sampling.small_per_group(table, "id", "label", 5).groupBy("label").count()
    assert {r["count"] for r in got.collect()} == {5}


@pytest.mark.parametrize("n", [1, 999, 1000, 1001, 2999, 3000])
def test_sample_size_is_exact_on_repeated_keys(spark, n):
    df = spark.range(3000).selectExpr("id % 1500 as k", "id div 1500 as copy")
    assert sampling.uniform_sample(df, "k", n).count() == n
    same = df.select("k", F.lit(1).alias("x"))
    assert sampling.uniform_sample(same, "k", n).count() == n


def test_missing_labels_and_bins(spark):
    df = spark.createDataFrame(
        [(k, "big", "a") for k in range(50)] + [(k, None, None) for k in range(50, 60)]
        + [(k, "c1", "b") for k in range(60, 65)], "id long, label string, bin string")
    cut = sampling.undersample(df, "id", "label", "big")
    assert rows(cut.groupBy("label").count()) == sorted(
        [("big", 15), (None, 10), ("c1", 5)], key=repr)
    picked = sampling.stratified_pick(df, "id", "bin", 20, 2)
    assert picked.count() == 20 and picked.where("bin is null").count() == 0


def test_undersample_and_split(table):
    balanced = sampling.undersample(table, "id", "label", "big").cache()
    assert balanced.count() == 3000  # the majority is not larger than the rest
    cut = sampling.undersample(table.where("label in ('big', 'c1')"), "id", "label", "big")
    sizes = Counter(r.label for r in cut.collect())
    assert sizes["big"] == sizes["c1"]
    split = Counter(r.split for r in sampling.train_val_split(balanced, "id", "label").collect())
    assert split == {"train": 2700, "val": 300}


def test_split_total_is_exact(spark):
    sizes = {"o": 12324, "r": 6753, "p": 1842, "b": 1087, "d": 848, "e": 726, "t": 707, "f": 361}
    df = spark.createDataFrame([(k,) for k, n in sizes.items() for _ in range(n)], "label string")
    got = {r.label: r.quota for r in sampling.split_sizes(df, "label").collect()}
    assert sum(got.values()) == 2465  # the published validation size
    assert all(abs(got[k] - n / 10) < 1 for k, n in sizes.items())


def test_length_bins(spark):
    df = spark.createDataFrame([(i,) for i in range(1, 8)], "n int")
    assert sampling.length_edges(df, "n").first()["edges"] == [3.0, 5.0]
    got = {r.n: r.len_bin for r in sampling.length_bins(df, "n").collect()}
    assert [got[i] for i in range(1, 8)] == ["short"] * 3 + ["medium"] * 2 + ["long"] * 2


def test_equal_edges_are_refused(spark):
    df = spark.createDataFrame([(1,)] * 9 + [(2,)], "n int")
    with pytest.raises(Exception, match="unique"):
        sampling.length_bins(df, "n").collect()


def test_stratified_pick(spark):
    df = spark.range(900).select("id", F.concat(F.lit("b"), F.col("id") % 3).alias("bin"))
    picked = sampling.stratified_pick(df, "id", "bin", 250, 3).collect()
    assert len({r.id for r in picked}) == 250
    assert sorted(Counter(r.bin for r in picked).values()) == [83, 83, 84]


def test_class_weights(spark):
    df = spark.createDataFrame([("a",)] * 3 + [("b",)], "intent string")
    got = {r.intent: r.weight for r in sampling.class_weights(df, "intent").collect()}
    assert got == {"a": 4 / (2 * 3), "b": 2.0}


def test_leakage(spark):
    schema = "k long, t string"
    train = spark.createDataFrame([(1, "A "), (2, "b"), (3, "c"), (3, "c")], schema)
    gold = spark.createDataFrame([(3, "zzz"), (9, "a")], schema)
    leaked = sampling.leaked_rows(train, gold, F.lower(F.trim("t")), "k")
    assert rows(leaked, "k") == [(1,), (3,), (3,)]
    assert rows(sampling.without_golden(train, gold, "k"), "k") == [(1,), (2,)]


def test_quotas_of_groups_move_no_whole_rows(table, spark):
    """Moved by group, all rows of the largest group went to one task."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        wide = table.withColumn("payload", F.concat(F.lit("text "), F.col("id")))
        plan = sampling.small_per_group(wide, "id", "label", 5)._jdf.queryExecution().executedPlan()
        assert "BroadcastHashJoin [label#" in plan.toString()
        split = sampling.train_val_split(table, "id", "label")._jdf.queryExecution().executedPlan()
        assert "BroadcastHashJoin [label#" in split.toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
