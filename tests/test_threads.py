import pytest
from pyspark.sql import functions as F

from conftest import rows
from replyforge.operators import ranking, threads
from replyforge.plans import jobs

EDGES = [(2, 1), (3, 2), (4, 3), (10, 999), (20, 21), (21, 22), (22, 20), (23, 20), (30, 30)]
EDGES += [(i, i - 1) for i in range(101, 145)] + [(1, None), (100, None)]


def walk(edges, start, cap):
    """Brute force: follow parents, stop at unknown, visited, or the cap."""
    parent, cur, seen, depth = dict(edges), start, set(), 0
    while depth < cap and cur not in seen:
        seen.add(cur)
        if parent.get(cur) not in parent:
            break
        cur, depth = parent[cur], depth + 1
    return cur


def roots_of(spark, edges, cap):
    df = spark.createDataFrame(edges, "tweet_id long, in_response_to_tweet_id long")
    return {r.node: r.root for r in threads.find_roots(df, cap).collect()}


def test_root_walk_known_values(spark):
    roots = roots_of(spark, EDGES, 20)
    expected = {4: 1, 2: 1, 20: 20, 21: 21, 22: 22, 23: 20, 30: 30, 110: 100, 120: 100,
                121: 101, 144: 124}
    assert {k: roots[k] for k in expected} == expected
    assert 10 not in roots and 1 not in roots  # no known parent: their own root


@pytest.mark.parametrize("cap", [1, 2, 3, 5, 7, 20])
def test_root_walk_matches_brute_force(spark, cap):
    tangled = EDGES + [(200 + i, 200 + (i * 7 + 3) % 40) for i in range(40)]
    roots = roots_of(spark, tangled, cap)
    parent = dict(tangled)
    for node in (n for n, p in tangled if p in parent):
        assert roots[node] == walk(tangled, node, cap), (node, cap)


def _messages(spark):
    data = [
        (1, "u1", True, "t1", "hello", None),
        (2, "shop", False, "t2", "how can we help", 1),
        (3, "u1", True, "t3", "where is it", 2),
        (4, "shop", False, "t4", "on its way", 3),
        (5, "shop", False, "t5", "also see this", 4),
        (6, "other", False, "t6", "not ours", 1),
        (7, "shop", False, "t7", "no parent", None),
        (8, "shop", False, "t8", "lost parent", 888),
        (9, "u2", True, "t9", "alone", None),
    ]
    return spark.createDataFrame(
        data,
        "tweet_id long, author_id string, inbound boolean, created_at string, text string, "
        "in_response_to_tweet_id long",
    )


def test_extract_keeps_brand_and_answered_once(spark):
    got = rows(threads.extract_brand(_messages(spark), "shop"), "tweet_id")
    # 4 is the brand's own and also answered by the brand: one row.
    assert got == [(1,), (2,), (3,), (4,), (5,), (7,), (8,)]


@pytest.mark.parametrize("hot_rows", [1_000_000, 1])
def test_reconstruct(spark, hot_rows):
    extracted = jobs.extract(_messages(spark), "shop")
    turns = threads.reconstruct(extracted, "shop", hot_rows=hot_rows)
    got = rows(
        turns, "conversation_id", "turn_index", "conversation_turns", "customer_tweet_id",
        "support_tweet_id",
    )
    assert got == [(1, 1, 3, 1, 2), (1, 2, 3, 3, 4), (1, 3, 3, 4, 5)]


def test_skip_accounting_and_orphans(spark):
    messages = _messages(spark)
    assert rows(threads.skip_accounting(messages, "shop")) == [(5, 3, 1, 1)]
    assert rows(threads.orphan_replies(messages, "shop"), "tweet_id") == [(8,)]


def test_hot_groups_are_numbered_like_cold_ones(spark):
    df = spark.range(5000).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).alias("g"),
        (F.col("id") * 7919 % 5000).alias("v"),
    )
    number = lambda limit: rows(
        ranking.number_within(df, ["g"], ["v"], "i", "n", hot_rows=limit), "g", "v", "i", "n"
    )
    plain = number(10**9)
    assert number(200) == plain and number(1) == plain
    for group in {r[0] for r in plain}:
        numbers = [r[2] for r in sorted(plain) if r[0] == group]
        assert numbers == list(range(1, len(numbers) + 1))


def test_repeated_replies_do_not_multiply(spark):
    chain = [(k, k - 1 if k > 1 else None) for k in range(1, 31)]
    df = spark.createDataFrame(
        chain + chain[1:], "tweet_id long, in_response_to_tweet_id long")
    got = threads.find_roots(df)
    assert got.count() == 29 and dict(rows(got)) == {k: 1 for k in range(2, 31)}
    capped = dict(rows(threads.find_roots(df, 20)))
    assert capped[30] == 10 and capped[5] == 1


def test_deep_threads_and_cycles(spark):
    links = [(k, k - 1) for k in range(2, 200)] + [(1, None), (500, 501), (501, 500), (502, 500)]
    df = spark.createDataFrame(links, "tweet_id long, in_response_to_tweet_id long")
    got = dict(rows(threads.find_roots(df)))
    assert {got[k] for k in range(2, 200)} == {1}
    assert set(got) == {*range(2, 200), 500, 501, 502}
