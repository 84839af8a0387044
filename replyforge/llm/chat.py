"""Reply trees to training conversations.

A message names its parent within its tree.  Ancestors are found by joining
the table of jumps with itself, each round doubling the jump, so a thread of
depth d takes log2(d) rounds.  Leaves are ranked per tree by the score of
their branch; only the chosen branches are expanded, again by the jump tables,
into root-to-leaf paths, and each path is formatted as one conversation.

Every round is written to the shared folder.  A root with very many replies is
one row on the other side of each join, which Spark splits by itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from replyforge.sources.stages import cut

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
# Strings with a meaning in this or a common other template; broken inside texts.
CONTROL = (
    TURN, TEXT, END, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>",
    "<|im_start|>", "<|im_end|>", "<|startoftext|>", "<|endoftext|>",
)
_ANY_CONTROL = "(?s)(?=" + "|".join(rf"\Q{c}\E" for c in CONTROL) + ")(.)"


def escape(text: Column) -> Column:
    """No control string is left; ``unescape`` gives the text back.

    Backslashes are doubled, then one is put after the first character of every
    control string.
    """
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, _ANY_CONTROL, "$1\\\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _same(left: DataFrame, right: DataFrame, a: str, b: str) -> Column:
    return left["tree"].eqNullSafe(right["tree"]) & (left[a] == right[b])


def jump_tables(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Tables (tree, node, up) of 1, 2, 4, ... steps, and (tree, node, depth, gain).

    ``gain`` is the sum of scores from the root down.  A parent that is not in
    the tree makes its child a root.  Messages on or below a cycle reach no
    root: they are in neither result's last round and belong to no path.
    """
    parents = nodes.select("tree", F.col("node").alias("up")).distinct()
    base = nodes.select("tree", "node", F.col("parent").alias("up"), "score")
    found = base.join(parents, _same(base, parents, "up", "up"), "left").select(
        base["tree"], "node", parents["up"], "score"
    )
    reach = cut(found.select("tree", "node", "up", F.lit(1).cast("long").alias("depth"),
                             F.col("score").alias("gain")), "jump")
    rounds: list[DataFrame] = []
    last_open = None
    while True:
        n_open = reach.where("up is not null").count()
        # Trees have messages at every depth: a round in which none reaches its
        # root leaves only cycles.
        if n_open in (0, last_open):
            return rounds, reach.where("up is null").drop("up")
        last_open = n_open
        rounds.append(reach.where("up is not null").select("tree", "node", "up"))
        ahead = reach.select(
            F.col("tree").alias("t"), F.col("node").alias("n"), F.col("up").alias("next"),
            F.col("depth").alias("more"), F.col("gain").alias("plus"),
        )
        far = reach.where("up is not null").join(
            ahead, F.col("tree").eqNullSafe(F.col("t")) & (F.col("up") == F.col("n"))
        )
        reach = cut(
            reach.where("up is null").unionByName(
                far.select(
                    "tree", "node", F.col("next").alias("up"),
                    (F.col("depth") + F.col("more")).alias("depth"),
                    (F.col("gain") + F.col("plus")).alias("gain"),
                )
            ),
            "jump",
        )


def chosen_leaves(nodes: DataFrame, reach: DataFrame, branches: int | None) -> DataFrame:
    """(tree, leaf, rank, branch_score): best mean score, then depth, then smaller leaf."""
    inner = nodes.where("parent is not null").select("tree", F.col("parent").alias("p")).distinct()
    leaves = reach.join(
        inner, reach["tree"].eqNullSafe(inner["tree"]) & (reach["node"] == inner["p"]), "left_anti"
    )
    scored = leaves.select(
        "tree", F.col("node").alias("leaf"), "depth",
        (F.col("gain") / F.col("depth")).alias("branch_score"),
    )
    best = Window.partitionBy("tree").orderBy(
        F.desc("branch_score"), F.desc("depth"), F.asc("leaf")
    )
    ranked = scored.withColumn("rank", F.row_number().over(best))
    return (ranked.where(F.col("rank") <= branches) if branches else ranked).drop("depth")


def expand(leaves: DataFrame, rounds: list[DataFrame]) -> DataFrame:
    """(tree, leaf, node, back): every message of the leaves' paths, once."""
    steps = leaves.select("tree", "leaf", F.col("leaf").alias("node"), F.lit(0).alias("back"))
    for k in reversed(range(len(rounds))):
        jump = rounds[k].select(
            F.col("tree").alias("t"), F.col("node").alias("n"), F.col("up").alias("up")
        )
        ahead = steps.join(jump, F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("n")))
        steps = cut(
            steps.unionByName(
                ahead.select("tree", "leaf", F.col("up").alias("node"),
                             (F.col("back") + (1 << k)).alias("back"))
            ),
            "path",
        )
    return steps


def format_paths(messages: DataFrame) -> DataFrame:
    """(tree, leaf, n_turns, formatted, loss_spans) from (tree, leaf, back, role, text).

    ``loss_spans`` holds (start, length) in code points of ``formatted``: what a
    trainer takes the loss of, which is each assistant text.
    """
    own = Window.partitionBy("tree", "leaf").orderBy(F.desc("back"))
    head = F.concat(F.lit(TURN), escape(F.col("role")), F.lit(TEXT))
    pieces = messages.select(
        "tree", "leaf", "back", "role", head.alias("head"), escape(F.col("text")).alias("body")
    ).withColumn("piece", F.concat("head", "body", F.lit(END)))
    before = F.coalesce(
        F.sum(F.length("piece")).over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    placed = pieces.select(
        "tree", "leaf", F.col("back"), "piece", (F.col("role") == "assistant").alias("loss"),
        (before + F.length("head")).alias("start"), F.length("body").cast("long").alias("length"),
    )
    turns = F.sort_array(
        F.collect_list(F.struct((-F.col("back")).alias("at"), "piece", "loss", "start", "length"))
    )
    return placed.groupBy("tree", "leaf").agg(turns.alias("turns")).select(
        "tree", "leaf", F.size("turns").cast("long").alias("n_turns"),
        F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("formatted"),
        F.transform(
            F.filter("turns", lambda t: t["loss"]),
            lambda t: F.struct(t["start"].alias("start"), t["length"].alias("length")),
        ).alias("loss_spans"),
    )


def _named(messages: DataFrame) -> DataFrame:
    """Messages with plain values, a node for each, and its row's own ``given`` node.

    A message without a node gets a number below all others, so it is a message
    of its own, which may answer a parent but has no replies.
    """
    clean = cut(messages.select(
        "tree", F.col("node").cast("long").alias("given"), F.col("parent").cast("long").alias("parent"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"),
        F.monotonically_increasing_id().alias("at"),
    ), "messages")
    least = clean.agg(F.least(F.min("given"), F.lit(0))).first()[0]
    return clean.withColumn("node", F.coalesce("given", F.lit(least or 0) - 1 - F.col("at"))).drop("at")


def place_trees(messages: DataFrame, branches: int | None = 1) -> tuple[DataFrame, DataFrame]:
    """(conversations, messages that are in no tree).

    Conversations: the best ``branches`` paths of each tree (all if None), as
    ``format_paths`` has them, with rank and branch_score.  ``messages`` has
    tree, node, parent, role, text, score.  NULL role or text reads as empty,
    NULL score as 0; a NULL tree is a tree of its own.  A message without a node
    is one of its own; rows that repeat a message are one.  Trees that are empty
    give no row; further columns are not looked at.

    Not placed (tree, node, parent, role, text, score, reason): where rows of one
    node differ, all but the least by parent, role, text and score ("another
    message has this node"), and messages on or below a cycle ("no root").
    """
    clean = _named(messages)
    values = F.struct("parent", "role", "text", "score", "given")
    # Repeated rows go before the exchange; what is left of a node are its different messages.
    different = clean.select("tree", "node", values.alias("m")).distinct()
    first = different.groupBy("tree", "node").agg(F.min("m").alias("m"))
    nodes = cut(first.select("tree", "node", "m.*"), "nodes")
    rounds, reach = jump_tables(nodes)
    leaves = cut(chosen_leaves(nodes, reach, branches), "leaves")
    steps = expand(leaves, rounds)
    texts = nodes.select(
        F.col("tree").alias("t"), F.col("node").alias("n"), "role", "text"
    )
    path = steps.join(texts, F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("n")))
    done = format_paths(path.select("tree", "leaf", "back", "role", "text"))
    ranks = leaves.select(
        F.col("tree").alias("t"), F.col("leaf").alias("l"), "rank", "branch_score"
    )
    conversations = done.join(
        ranks, F.col("tree").eqNullSafe(F.col("t")) & (F.col("leaf") == F.col("l"))
    ).drop("t", "l")

    kept = nodes.select(F.col("tree").alias("t"), F.col("node").alias("n"), values.alias("kept"))
    others = different.join(
        kept, F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("n"))
    ).where(~F.col("m").eqNullSafe(F.col("kept"))).select(
        "tree", "m.*", F.lit("another message has this node").alias("reason")
    )
    rooted = reach.select(F.col("tree").alias("t"), F.col("node").alias("n"))
    adrift = nodes.join(
        rooted, F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("n")), "left_anti"
    ).select("tree", "parent", "role", "text", "score", "given", F.lit("no root").alias("reason"))
    unplaced = others.unionByName(adrift).select(
        "tree", F.col("given").alias("node"), "parent", "role", "text", "score", "reason"
    )
    return conversations, unplaced


def format_trees(messages: DataFrame, branches: int | None = 1) -> DataFrame:
    """The conversations of ``place_trees``."""
    return place_trees(messages, branches)[0]


def thread_messages(conversations: DataFrame) -> DataFrame:
    """Linear conversations as trees: each turn answers the one before."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    at = F.row_number().over(order)
    return conversations.select(
        F.col("conv_id").alias("tree"), at.cast("long").alias("node"),
        F.when(at > 1, at - 1).cast("long").alias("parent"), "role", "text",
        F.lit(0.0).alias("score"),
    )


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>> out of a formatted conversation."""
    parts = F.slice(F.split(formatted, r"\Q<|turn|>\E"), 2, F.lit(1 << 30))
    return F.transform(
        parts,
        lambda p: F.struct(
            unescape(F.substring_index(p, TEXT, 1)).alias("role"),
            unescape(
                F.substring_index(F.substring_index(p, TEXT, -1), END, 1)
            ).alias("text"),
        ),
    )


def read_loss(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    return F.array_join(
        F.transform(
            spans,
            lambda s: unescape(
                F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int"))
            ),
        ),
        "",
    )
