"""Rule-based labelling: packs compiled to column expressions.

A pack maps intents, in order, to patterns.  Plain words become substring
tests; only patterns with metacharacters become regexes.  Nothing is joined and
no Python runs per row.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from replyforge.functions import packs
from replyforge.functions.text import contains_any, normalised


def hits(text: Column, patterns) -> Column:
    """True when any pattern is found.  ``(?d)`` keeps ``.`` from stopping at
    anything but a newline."""
    plain = [p for p in patterns if re.escape(p).replace("\\ ", " ") == p]
    regexes = [p for p in patterns if p not in plain]
    found = [contains_any(text, plain)] if plain else []
    if regexes:
        found.append(text.rlike("(?d)" + "|".join(f"(?:{p})" for p in regexes)))
    return found[0] if len(found) == 1 else found[0] | found[1]


def with_hits(df: DataFrame, text: str, pack: dict) -> DataFrame:
    """Add one boolean column per intent of the pack, ``_hit_<intent>``.

    The lower-cased text is projected once, and flags (rather than an array of
    names) keep all of it inside generated code.  NULL text hits nothing.
    """
    flags = [
        F.coalesce(hits(F.col("_low"), patterns), F.lit(False)).alias(f"_hit_{name}")
        for name, patterns in pack.items()
    ]
    return df.withColumn("_low", F.lower(text)).select(*df.columns, *flags)


def _hit(name: str) -> Column:
    return F.col(f"_hit_{name}")


def _first(names) -> Column:
    """First intent that hit, in the given order."""
    return F.coalesce(*[F.when(_hit(n), n) for n in names])


def weak_label(df: DataFrame, text: str = "customer_text", pack=packs.WEAK_RULES) -> DataFrame:
    """Add ``intent``, ``confidence`` and ``labeling_method``.

    A NULL text hits no rule and gets the fallback label.
    """
    found = sum((_hit(n).cast("int") for n in pack), F.lit(0))
    pick = lambda i: (
        F.when(F.col("_found") == 1, packs.WEAK_SINGLE[i])
        .when(F.col("_found") > 1, packs.WEAK_CONFLICT[i])
        .otherwise(packs.WEAK_NONE[i])
    )
    return with_hits(df, text, pack).withColumn("_found", found).select(
        *df.columns,
        F.coalesce(_first(pack), F.lit(packs.OTHER)).alias("intent"),
        pick(0).alias("confidence"),
        pick(1).alias("labeling_method"),
    )


def auto_label(df: DataFrame, text: str = "customer_text", pack=packs.GOLDEN_RULES) -> DataFrame:
    """Set ``intent``, ``difficulty`` and ``labeling_notes``.

    Precedence among several hits: delivery over refund, defect over refund,
    delivery over tracking, anything over escalation, else first in pack order.
    """
    found = sum((_hit(n).cast("int") for n in pack), F.lit(0))
    names = F.concat_ws(", ", *[F.when(_hit(n), n) for n in pack])
    first = _first(pack)
    actionable = _first([n for n in pack if n != packs.ESCALATION])
    delivery, refund = _hit("delivery_issue"), _hit("refund_return")
    defect, tracking = _hit("product_defect"), _hit("order_status_tracking")
    case = lambda intent, difficulty, note: F.struct(
        intent.alias("intent"), F.lit(difficulty).alias("difficulty"), note.alias("note")
    )
    fixed = lambda intent, difficulty, note: case(
        F.lit(intent), difficulty, F.lit(note)
    )
    decision = (
        F.when(F.col("_found") == 0, fixed(packs.OTHER, "hard", packs.NOTE_NONE))
        .when(
            F.col("_found") == 1,
            case(first, "easy", F.concat(F.lit("Matched single rule for "), first, F.lit("."))),
        )
        .when(delivery & refund, fixed("delivery_issue", "medium", packs.NOTE_DELIVERY_REFUND))
        .when(refund & defect, fixed("product_defect", "medium", packs.NOTE_DEFECT_REFUND))
        .when(tracking & delivery, fixed("delivery_issue", "medium", packs.NOTE_TRACKING_DELIVERY))
        .when(
            _hit(packs.ESCALATION),
            case(
                actionable,
                "medium",
                F.concat(
                    F.lit("Matched "),
                    actionable,
                    F.lit(" and escalation. Prioritizing actionable issue."),
                ),
            ),
        )
        .otherwise(
            case(
                first,
                "hard",
                F.concat(
                    F.lit("Multiple overlapping matches ("), names, F.lit("). Chose first match.")
                ),
            )
        )
    )
    kept = [c for c in df.columns if c not in ("intent", "difficulty", "labeling_notes")]
    return (
        with_hits(df, text, pack)
        .withColumn("_found", found)
        .withColumn("_case", decision)
        .select(
            *kept,
            F.col("_case.intent").alias("intent"),
            F.col("_case.difficulty").alias("difficulty"),
            F.col("_case.note").alias("labeling_notes"),
        )
    )


def keyword_label(text: Column, pack=packs.KEYWORD_RULES) -> Column:
    """First keyword group that hits, else the fallback intent."""
    low = F.lower(text)
    label = None
    for name, words in pack.items():
        test = contains_any(low, words)
        label = F.when(test, name) if label is None else label.when(test, name)
    return label.otherwise(packs.OTHER)


def majority_class(labels: DataFrame, label: str = "intent") -> DataFrame:
    """One row: the most frequent label, the smallest on a tie."""
    return (
        labels.where(F.col(label).isNotNull())
        .groupBy(label)
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), label)
        .limit(1)
        .select(F.col(label).alias("majority_class"), "n")
    )


def with_majority(df: DataFrame, labels: DataFrame, label: str = "intent", out: str = "predicted"):
    """Constant majority prediction on every row."""
    return df.withColumn(out, majority_class(labels, label).select("majority_class").scalar())


def expected_escalation(intent: Column, text: Column) -> Column:
    """1 when the true intent or the text calls for a person, else 0."""
    return (
        F.when(intent.isin(packs.ESCALATION, packs.OTHER), 1)
        .when(contains_any(normalised(text), packs.EXPECTED_WORDS), 1)
        .otherwise(0)
    )
