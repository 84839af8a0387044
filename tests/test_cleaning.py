from conftest import rows
from replyforge.operators import cleaning

DATA = [
    (1, "a", None), (2, "  ", "long enough reply"), (3, "hi", "DM us now"),
    (4, "hi", " 123456789 "), (5, "hi", "0123456789"), (5, "hi", "0123456789"),
    (6, "x", "b" * 561), (7, "y", "c" * 560), (8, " \x1c", "long enough reply"),
]


def _pairs(spark):
    data = [(1, i, 100 + i, c, s) for i, c, s in DATA]
    return spark.createDataFrame(
        data,
        "conversation_id long, customer_tweet_id long, support_tweet_id long, "
        "customer_text string, support_text string",
    )


def test_clean_pairs(spark):
    kept = cleaning.clean_pairs(_pairs(spark))
    assert rows(kept, "customer_tweet_id", "is_long_response", "turn_index", "conversation_turns") == [
        (5, False, 1, 3), (6, True, 2, 3), (7, False, 3, 3)
    ]


def test_ledger_adds_up(spark):
    ledger = rows(cleaning.clean_ledger(_pairs(spark)), "step_no", "step", "removed")
    assert ledger == [
        (1, "null_text", 1), (2, "whitespace", 2), (3, "too_short_support", 2),
        (4, "duplicate_pairs", 1),
    ]
    assert sum(r[2] for r in ledger) + cleaning.clean_pairs(_pairs(spark)).count() == len(DATA)


def test_short_replies(spark):
    assert rows(cleaning.short_reply_topk(_pairs(spark))) == [(" 123456789 ", 1), ("DM us now", 1)]
