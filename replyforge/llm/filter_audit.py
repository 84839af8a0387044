"""What each filter of a set removes, in every order in which they can be applied.

A document is reduced to the set of filters it fails.  Filters applied so far
are a state of the subset lattice, applying one more is an edge.  Going forward
through the lattice counts the orders that reach each state, going backward the
orders that lead on from it; an edge lies on forward(start) * backward(end)
orders, which weights its removals for the Shapley value.  The steps of an
order are read from the same edges.

Texts are read once and leave as numbers and a digest; everything after that
moves counts.  Equal texts fail the same text filters, so a group of copies is
one row per part and label: a text that a third of all rows share travels as
partial counts.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, functions as F

from replyforge.sources.stages import cut

# The five filters, in the order of their bits.
FILTERS = "ABCDE"
MIN_WORDS = 100
DISTINCT_OF_WORDS = 80  # per cent
CAPITALS_OF_CHARACTERS = 10  # per cent
SYMBOLS = "[#$%&*|]"
BLANK = "[\\x20\\x09-\\x0D]+"
COPY = 1 << FILTERS.index("E")


def _of_text(text: Column) -> Column:
    """Bits of the filters A to D that a text fails."""
    words = F.filter(F.split(text, BLANK), lambda w: w != "")
    n = F.size(words)
    failed = (
        n < MIN_WORDS,
        F.size(F.array_distinct(words)) * 100 < n * DISTINCT_OF_WORDS,
        F.length(F.regexp_replace(text, "[^A-Z]+", "")) * 100
        > F.length(text) * CAPITALS_OF_CHARACTERS,
        text.rlike(SYMBOLS),
    )
    bits = F.lit(0)
    for k, fails in enumerate(failed):
        bits = bits + F.when(fails, 1 << k).otherwise(0)
    return bits


def _flags(labels: DataFrame) -> DataFrame:
    """(doc_id, good, toxic), one row per id: whether any label says so."""
    return (
        labels.where(F.col("doc_id").isNotNull())
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(
            F.max(F.coalesce(F.col("quality") == 1, F.lit(False)).cast("int")).alias("good"),
            F.max(F.coalesce(F.col("toxic") == 1, F.lit(False)).cast("int")).alias("toxic"),
        )
    )


def failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, failed, n, n_good, n_toxic): documents by the set of filters they fail."""
    text = F.coalesce("text", F.lit(""))
    read = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce("lang", F.lit("")).alias("part"),
        F.unhex(F.sha2(text, 256)).alias("digest"),
        _of_text(text).alias("failed"),
    )
    # The digest is among the keys, so no id, NULL or repeated, is a hot key here.
    rows = cut(
        read.groupBy("doc_id", "part", "digest", "failed").agg(F.count("*").alias("n")), "failures"
    )
    named = rows.where("doc_id is not null").join(_flags(labels), "doc_id", "left").fillna(
        0, ["good", "toxic"]
    )
    nameless = rows.where("doc_id is null").withColumns({"good": F.lit(0), "toxic": F.lit(0)})
    # Of each group of copies: how many rows, and how many have the smallest id.
    # A NULL id is larger than all others.
    copies = named.unionByName(nameless).groupBy("digest", "failed", "part", "good", "toxic").agg(
        F.sum("n").alias("n"),
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "n")).alias("first"),
    )
    copies = cut(
        copies.select(
            "digest", "failed", "part", "good", "toxic", "n", "first.none", "first.doc_id",
            F.col("first.n").alias("n_first"),
        ), "copies",
    )
    smallest = copies.groupBy("digest").agg(
        F.min("doc_id").alias("smallest"), F.min("none").alias("all_none"), F.count("*").alias("parts")
    )
    # Most texts have one group, which then holds the smallest id.
    shared = copies.join(smallest.where("parts > 1"), "digest", "left")
    holds = F.coalesce(
        F.when(F.col("parts").isNull(), True)
        .when(F.col("all_none"), True)
        .otherwise(F.col("doc_id") == F.col("smallest")),
        F.lit(False),
    )
    first = F.when(holds, F.col("n_first")).otherwise(0)
    each = F.explode(F.array(
        F.struct(F.col("failed"), first.alias("n")),
        F.struct((F.col("failed") + COPY).alias("failed"), (F.col("n") - first).alias("n")),
    ))
    return (
        shared.select("part", "good", "toxic", each.alias("e"))
        .where("e.n > 0")
        .groupBy("part", F.col("e.failed").alias("failed"))
        .agg(
            F.sum("e.n").alias("n"),
            F.sum(F.col("e.n") * F.col("good")).alias("n_good"),
            F.sum(F.col("e.n") * F.col("toxic")).alias("n_toxic"),
        )
    )


def lattice(n: int) -> list[tuple[int, int, int]]:
    """(state, filter, orders) of every edge: how many of the n! orders pass it."""
    full = (1 << n) - 1
    edges = [(s, f) for s in range(full + 1) for f in range(n) if not s >> f & 1]
    forward, backward = [0] * (full + 1), [0] * (full + 1)
    forward[0] = backward[full] = 1
    for s, f in edges:  # a state's number is below those it leads to
        forward[s | 1 << f] += forward[s]
    for s, f in reversed(edges):
        backward[s] += backward[s | 1 << f]
    return [(s, f, forward[s] * backward[s | 1 << f]) for s, f in edges]


def edge_counts(counted: DataFrame, n: int) -> DataFrame:
    """One row per part and edge, from documents by set of failed filters.

    A part has at most 2**n such sets, so each is turned into its share of all
    n * 2**(n - 1) edges before the exchange, and sums travel.
    """
    edges = F.array(*(F.struct(
        F.lit(s).alias("state"), F.lit(f).alias("filter"), F.lit(1 << f).alias("bit"),
        F.lit(w).cast("long").alias("orders"),
    ) for s, f, w in lattice(n)))
    rows = counted.select("*", F.explode(edges).alias("edge")).select("*", "edge.*")
    fails = F.col("failed").bitwiseAND(F.col("bit")) != 0
    reached = F.col("failed").bitwiseAND(F.col("state")) == 0

    def total(condition, column="n"):
        return F.sum(F.when(condition, F.col(column)).otherwise(0))

    return rows.groupBy("part", "state", "filter", "orders").agg(
        total(reached & ~fails).alias("kept"),
        total(reached & fails).alias("removed"),
        total(~reached & fails).alias("redundant"),
        total(F.col("failed") == F.col("bit")).alias("unique_fails"),
        total(reached & fails, "n_good").alias("good_lost"),
        total(reached & fails, "n_toxic").alias("toxic_lost"),
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Counts of every step of every order of the filters, for each part.

    Parts are the values of ``lang`` (NULL: the empty string); an empty table
    has none.  (part, filter_order, step, kept, removed, redundant,
    unique_fails, good_lost, toxic_lost, shapley): 600 rows per part.  A NULL
    text is an empty one.  A text equal to that of a smaller doc_id is a copy;
    NULL ids come after all others, and rows with one id and one text are not
    copies of each other.  Rows that repeat count as often as they come; an id
    with several labels has each mark that any of them gives.  Other columns
    are not looked at.
    """
    n = len(FILTERS)
    counts = cut(edge_counts(failures(docs, labels), n), "edges")
    shapley = counts.groupBy("part", "filter").agg(
        F.sum(F.col("removed") * F.col("orders")).alias("shapley")
    )
    # Every edge lists the places it has in the orders: 120 orders of 5 steps.
    places = []
    for order in permutations(range(n)):
        state = 0
        for step, f in enumerate(order, 1):
            places.append((state, f, "".join(FILTERS[x] for x in order), step))
            state |= 1 << f
    assert len(places) == n * factorial(n)
    spark = docs.sparkSession
    table = spark.createDataFrame(places, "state int, filter int, filter_order string, step int")
    measures = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
    return counts.join(shapley, ["part", "filter"]).join(
        F.broadcast(table), ["state", "filter"]
    ).select("part", "filter_order", "step", *measures, "shapley")
