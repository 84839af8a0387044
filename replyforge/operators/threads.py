"""Extracting one brand's traffic and rebuilding reply threads.

``messages`` has one row per message: ``tweet_id``, ``author_id``, ``inbound``,
``created_at``, ``text``, ``in_response_to_tweet_id`` (nullable parent id).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from replyforge.operators.ranking import HOT_ROWS, keep_first, number_within
from replyforge.sources.stages import cut

MAX_DEPTH = 20


def brand_outbound(messages: DataFrame, brand: str) -> DataFrame:
    """Messages the brand sent; the filter reaches the Parquet scan."""
    return messages.where((F.col("author_id") == brand) & (F.col("inbound") == False))  # noqa: E712


def extract_brand(messages: DataFrame, brand: str) -> DataFrame:
    """The brand's own messages plus every message it replied to.

    Parents are made distinct before the semi join, so a message answered many
    times is one join row.  A message found both ways is kept once, as the
    brand's own; copies of an id are settled by time, then text.
    """
    own = brand_outbound(messages, brand)
    parents = own.select(F.col("in_response_to_tweet_id").alias("_parent")).where(
        "_parent is not null"
    ).distinct()
    answered = messages.join(parents, F.col("tweet_id") == F.col("_parent"), "left_semi")
    both = own.withColumn("_pass", F.lit(1)).unionByName(answered.withColumn("_pass", F.lit(2)))
    return keep_first(both, ["tweet_id"], ["_pass", "created_at", "text"]).drop("_pass")


def reply_edges(messages: DataFrame) -> DataFrame:
    """(node, anc, top): each message and its parent, where the parent exists.

    One edge per message: of several known parents of a repeated id the
    smallest.  ``top`` marks parents that answer nothing, so that the root of a
    huge thread is known before any jump is chained and never joined again.
    """
    edges = messages.where("in_response_to_tweet_id is not null").select(
        F.col("tweet_id").alias("node"), F.col("in_response_to_tweet_id").alias("anc")
    )
    known = messages.groupBy(F.col("tweet_id").alias("_id")).agg(
        (F.count("in_response_to_tweet_id") == 0).alias("_top")
    )
    found = edges.join(known, F.col("anc") == F.col("_id")).groupBy("node").agg(
        F.min(F.struct("anc", F.col("_top").alias("top"))).alias("edge")
    )
    return found.select("node", "edge.anc", "edge.top")


def find_roots(messages: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(node, root) for every message that has a known parent.

    The walk stops where the parent is unknown or already visited, and after
    ``max_depth`` parents if that is given.  Instead of one join per step, jumps
    are doubled (1, 2, 4, 8, 16 parents) until every thread is at its top, or
    the jumps that add up to ``max_depth`` are chained: five joins for depth 20.

    ``back`` marks a jump that crossed an edge to an equal or larger id.  A
    cycle must contain one, so unmarked rows need no visited list; marked rows
    that did not reach a top are walked step by step.
    """
    edges = reply_edges(messages)
    step = edges.select("node", "anc", (F.col("anc") >= F.col("node")).alias("back"), "top")
    jump = cut(step, "jump-1")
    reached = _to_the_top(jump) if max_depth is None else None
    for bit in range((max_depth or 0).bit_length()):
        if max_depth >> bit & 1:
            reached = jump if reached is None else cut(_chain(reached, jump), "reached")
        if max_depth >> (bit + 1):
            if jump.where("not top").isEmpty():
                reached = jump
                break
            jump = cut(_chain(jump, jump), f"jump-{2 ** (bit + 1)}")
    suspects = reached.where("back and not top").select("node")
    plain = reached.where("not (back and not top)").select("node", F.col("anc").alias("root"))
    if suspects.isEmpty():
        return plain
    return plain.unionByName(_walk(suspects, jump_edges(messages), max_depth))


def _to_the_top(jump: DataFrame) -> DataFrame:
    """Doubles jumps until all end at a top, but for those that lead into a cycle.

    Messages at every depth up to the deepest exist, so a doubling that brings
    no message to a top leaves only cycles.
    """
    steps, still = 1, jump.where("not top").count()
    while still:
        steps *= 2
        jump = cut(_chain(jump, jump), f"jump-{steps}")
        before, still = still, jump.where("not top").count()
        if still == before:
            break
    return jump


def jump_edges(messages: DataFrame) -> DataFrame:
    return reply_edges(messages).select(
        F.col("node").alias("child"), F.col("anc").alias("parent")
    )


def _chain(left: DataFrame, right: DataFrame) -> DataFrame:
    """Jump ``left`` and then ``right``; a jump ends early at a thread's top.

    Rows already at a top skip the join, which also keeps the one root that a
    third of all messages may share out of it.  ``right`` has one row per node.
    """
    done = left.where("top")
    onward = right.select(
        F.col("node").alias("anc"),
        F.col("anc").alias("next"),
        F.col("back").alias("next_back"),
        F.col("top").alias("next_top"),
    )
    moved = left.where("not top").join(onward, "anc", "left").select(
        "node",
        F.coalesce("next", "anc").alias("anc"),
        (F.col("back") | F.coalesce("next_back", F.lit(False))).alias("back"),
        F.coalesce("next_top", F.lit(True)).alias("top"),
    )
    return done.unionByName(moved)


def _walk(starts: DataFrame, edges: DataFrame, max_depth: int | None) -> DataFrame:
    """Step-by-step walk with a visited list of the path so far.

    Rows that have stopped are written once; only open ones go on.
    """
    edges = cut(edges, "edges")
    front = starts.select(
        "node",
        F.col("node").alias("cur"),
        F.array().cast("array<bigint>").alias("seen"),
    )
    ended = None
    depth = 0
    while depth != max_depth:
        moved = front.join(edges, F.col("cur") == F.col("child"), "left").select(
            "node",
            F.coalesce("parent", "cur").alias("cur"),
            F.array_append("seen", F.col("cur")).alias("seen"),
            F.col("parent").isNull().alias("stop"),
        )
        stop = F.col("stop") | F.array_contains("seen", F.col("cur"))
        moved = cut(moved.withColumn("stop", stop), f"walk-{depth}")
        stopped = moved.where("stop").select("node", "cur")
        ended = stopped if ended is None else ended.unionByName(stopped)
        front = moved.where("not stop").drop("stop")
        depth += 1
        if front.isEmpty():
            break
    rest = front.select("node", "cur")
    return (rest if ended is None else ended.unionByName(rest)).select(
        "node", F.col("cur").alias("root")
    )


def pair_replies(messages: DataFrame, brand: str | None = None) -> DataFrame:
    """(message, reply) pairs of one brand, or of every non-customer author.

    The parent's author is not checked: a brand may answer itself.
    """
    if brand is None:
        replies = messages.where("inbound = false")
    else:
        replies = messages.where(F.col("author_id") == brand)
    return _pair(replies, messages)


def _pair(replies, parents):
    reply = replies.where("in_response_to_tweet_id is not null").select(
        F.col("in_response_to_tweet_id").alias("customer_tweet_id"),
        F.col("tweet_id").alias("support_tweet_id"),
        F.col("text").alias("support_text"),
        F.col("created_at").alias("support_created_at"),
    )
    extra = [c for c in parents.columns if c == "conversation_id"]
    parent = parents.select(
        *extra,
        F.col("tweet_id").alias("customer_tweet_id"),
        F.col("author_id").alias("customer_author_id"),
        F.col("text").alias("customer_text"),
        F.col("created_at").alias("customer_created_at"),
    )
    return reply.join(parent, "customer_tweet_id").select(
        *extra,
        "customer_tweet_id",
        "customer_author_id",
        "customer_text",
        "customer_created_at",
        "support_tweet_id",
        "support_text",
        "support_created_at",
    )


def reconstruct(
    messages: DataFrame,
    brand: str,
    max_depth: int = MAX_DEPTH,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Numbered (customer, support) turns per conversation.

    ``messages`` is an extract with unique ``tweet_id``.  Roots are attached to
    the parents first (one row per id on both sides); the one join where many
    replies may share a parent comes last, where AQE may split it.
    """
    roots = find_roots(messages, max_depth)
    rooted = messages.join(roots, F.col("tweet_id") == F.col("node"), "left").select(
        "tweet_id", "author_id", "text", "created_at",
        F.coalesce("root", "tweet_id").alias("conversation_id"),
    )
    pairs = cut(_pair(messages.where(F.col("author_id") == brand), rooted), "pairs")
    return number_within(
        pairs, ["conversation_id"], ["support_tweet_id"], hot_rows=hot_rows
    ).select(
        "conversation_id", "turn_index", "conversation_turns",
        "customer_tweet_id", "customer_author_id", "customer_text", "customer_created_at",
        "support_tweet_id", "support_text", "support_created_at",
    )


def skip_accounting(messages: DataFrame, brand: str | None = None) -> DataFrame:
    """One row: replies paired, without parent id, and with an unknown parent.

    Replies are counted per parent before the join, so the (possibly huge)
    NULL group and any much-answered parent are single rows.
    """
    replies = messages.where(
        F.col("author_id") == brand if brand is not None else F.expr("inbound = false")
    )
    per_parent = replies.groupBy("in_response_to_tweet_id").agg(F.count(F.lit(1)).alias("n"))
    known = messages.select(F.col("tweet_id").alias("_id")).distinct()
    has_parent = F.col("in_response_to_tweet_id").isNotNull()
    found = F.col("_id").isNotNull()
    total = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))
    return per_parent.join(
        known, F.col("in_response_to_tweet_id") == F.col("_id"), "left"
    ).agg(
        total(F.lit(True)).alias("replies"),
        total(has_parent & found).alias("paired"),
        total(~has_parent).alias("no_parent"),
        total(has_parent & ~found).alias("parent_missing"),
    )


def orphan_replies(messages: DataFrame, brand: str | None = None) -> DataFrame:
    """Replies whose parent id is not among the messages."""
    replies = messages.where(
        F.col("author_id") == brand if brand is not None else F.expr("inbound = false")
    ).where("in_response_to_tweet_id is not null")
    known = messages.select(F.col("tweet_id").alias("_id"))
    return replies.join(known, F.col("in_response_to_tweet_id") == F.col("_id"), "left_anti")
