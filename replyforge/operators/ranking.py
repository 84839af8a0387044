"""Numbering rows inside groups when one group may hold a third of the table.

A plain window puts each group into one task.  Here groups above ``hot_rows``
are taken out, range-partitioned by (group, order) so that many tasks share
them, numbered slice by slice, and shifted by the sizes of the slices before.
Every row keeps the number a single sort would have given it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from replyforge.sources.stages import cut

HOT_ROWS = 1_000_000


def number_within(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    index: str = "turn_index",
    total: str = "conversation_turns",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Add ``index`` (1..n inside each group) and ``total`` (n) to every row.

    ``df`` is read more than once, so pass a stage table, not a long plan.
    ``order`` has to be unique inside a group for the numbers to be fixed.
    """
    hot = df.groupBy(*keys).agg(F.count(F.lit(1)).alias(total)).where(F.col(total) > hot_rows)
    group = Window.partitionBy(*keys)
    if hot.isEmpty():
        return _number_in_window(df, group, order, index, total)
    # At most rows / hot_rows groups can be hot; the frame is written so that
    # both branches below see the same groups.
    hot = cut(hot, "hot-groups")
    cold = df.join(hot.select(*keys), list(keys), "left_anti")
    numbered = _number_in_window(cold, group, order, index, total)
    return numbered.unionByName(_number_in_slices(df.join(hot, list(keys)), keys, order, index))


def _number_in_window(df, group, order, index, total):
    return df.withColumn(
        index, F.row_number().over(group.orderBy(*order)).cast("long")
    ).withColumn(total, F.count(F.lit(1)).over(group))


def _number_in_slices(df, keys, order, index):
    slices = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # The slice number is frozen by the cut: range bounds come from sampling,
    # and a second evaluation could place them elsewhere.
    sliced = cut(
        df.repartitionByRange(slices, *keys, *order).withColumn(
            "_slice", F.spark_partition_id()
        ),
        "slices",
    )
    # One row per (group, slice): slices x hot groups rows in all.
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = (
        sliced.groupBy(*keys, "_slice")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .drop("_n")
    )
    inside = Window.partitionBy(*keys, "_slice").orderBy(*order)
    return (
        sliced.withColumn("_at", F.row_number().over(inside))
        .join(offsets, [*keys, "_slice"])
        .withColumn(index, (F.col("_at") + F.col("_before")).cast("long"))
        .drop("_slice", "_at", "_before")
    )


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence) -> DataFrame:
    """First row of each key.  Spark limits each task to one row per key before
    the shuffle (window group limit), so copies of a hot key do not travel."""
    first = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_nth", F.row_number().over(first)).where("_nth = 1").drop("_nth")


def top_n(df: DataFrame, order: Sequence, n: int, rank: str | None = None) -> DataFrame:
    """The first ``n`` rows of an order (``TakeOrderedAndProject``), optionally
    with their rank.  The rank window sees ``n`` rows only."""
    best = df.orderBy(*order).limit(n)
    if rank is None:
        return best
    return best.withColumn(rank, F.row_number().over(Window.orderBy(*order)).cast("long"))


def nth_text(df: DataFrame, column: str, n: int, most: int = 1000) -> str:
    """The ``n``-th value of a text column in the order of its UTF-8 bytes.

    Histograms over two more bytes each find the prefix that holds it, until at
    most ``most`` rows share the prefix; only those are sorted.  ``df`` is read
    a few times, so pass a stage table, with at least ``n`` rows and no NULLs.
    """
    key, prefix = F.hex(F.col(column).cast("binary")), ""
    running = Window.orderBy("prefix").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    while True:
        width = len(prefix) + 4
        found = (
            df.where(key.startswith(prefix)).groupBy(F.substring(key, 1, width).alias("prefix"))
            .agg(F.count(F.lit(1)).alias("n"))
            .withColumn("upto", F.sum("n").over(running))
            .where(F.col("upto") >= n)
            .agg(F.min_by(F.struct("prefix", "n", "upto"), "prefix").alias("f"))
            .first()["f"]
        )
        n -= found["upto"] - found["n"]
        prefix = found["prefix"]
        if len(prefix) < width:  # a whole value, shorter than the prefix asked for
            return bytes.fromhex(prefix).decode()
        if found["n"] <= most:
            rest = df.where(key.startswith(prefix)).orderBy(column).limit(n)
            return rest.agg(F.max(column)).first()[0]
