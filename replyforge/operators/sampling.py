"""Exact-size reproducible samples, bins and splits.

A sample is "the first n rows in seeded hash order", ties by key and then by a
hash of the whole row.  The table is never ranked: a histogram over hash
prefixes finds the prefix where the n-th row lies, rows of smaller prefixes are
a plain filter, and only the rows of that one prefix (about one in a million,
if keys are unique) are ranked, so the size is exact on repeated keys too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from replyforge.functions.ordering import seeded_hash

# Hex digits of the histogram prefix: at most 16**5 = 1,048,576 rows per group.
PREFIX_DIGITS = 5


def uniform_sample(df: DataFrame, key: str, n: int, seed: int | str = 42) -> DataFrame:
    """Exactly ``min(n, rows)`` rows without replacement."""
    quota = df.sparkSession.range(1).select(F.lit(n).cast("long").alias("quota"))
    return take_quota(df, key, quota, seed=seed)


def take_quota(
    df: DataFrame,
    key: str,
    quota: DataFrame,
    by: str | None = None,
    seed: int | str = 42,
) -> DataFrame:
    """First ``quota`` rows in seeded order: of the table, or of each ``by`` group.

    ``quota`` has one row (``quota``), or one row per group (``by``, ``quota``)
    for a small fixed set of groups such as intents or length bins.
    """
    group = [by] if by else []
    names = list(df.columns)
    hashed = df.withColumn("_h", seeded_hash(F.col(key), seed)).withColumn(
        "_prefix", F.substring("_h", 1, PREFIX_DIGITS)
    )
    counted = hashed.select(*group, F.col("_prefix").alias("prefix"))
    cuts = _cut_prefixes(counted, quota, group).select(
        *group, F.struct("cut_prefix", "wanted").alias("_cut")
    )
    if by:  # one row per group goes to all tasks; moved by group, one task got a group's rows
        placed = hashed.join(F.broadcast(cuts), by, "left")
    else:
        placed = hashed.withColumn("_cut", cuts.select("_cut").scalar())
    inside = placed.where("_cut is null or _prefix < _cut.cut_prefix")
    nth = F.row_number().over(
        Window.partitionBy(*group, "_prefix").orderBy("_h", key, F.xxhash64(*names))
    )
    edge = placed.where("_prefix = _cut.cut_prefix").withColumn("_nth", nth).where(
        "_nth <= _cut.wanted"
    )
    return inside.select(*names).unionByName(edge.select(*names))


def _cut_prefixes(prefixes: DataFrame, quota: DataFrame, group: list[str]) -> DataFrame:
    """(group, cut_prefix, wanted): the prefix in which a quota ends, and how many
    of its rows are still wanted; no row for a group that fits its quota."""
    running = Window.partitionBy(*group).orderBy("prefix").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    histogram = (
        prefixes.groupBy(*group, "prefix")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("upto", F.sum("n").over(running))
    )
    if group:
        histogram = histogram.join(quota, group)
    else:
        histogram = histogram.withColumn("quota", quota.select("quota").scalar())
    reached = F.col("upto") >= F.col("quota")
    cutoffs = histogram.groupBy(*group).agg(
        F.min(F.when(reached, F.struct("prefix", "upto", "n", "quota"))).alias("c"),
        F.max("upto").alias("rows"),
    )
    return cutoffs.where("rows > c.quota").select(
        *group,
        F.col("c.prefix").alias("cut_prefix"),
        (F.col("c.quota") - (F.col("c.upto") - F.col("c.n"))).alias("wanted"),
    )


def last_taken(df, key, quota, by=None, seed=42) -> DataFrame:
    """(hash, key) of the last row inside the quota; NULL where all rows fit.

    Groups with a quota below 1 get a bound below every row.
    """
    group = [by] if by else []
    hashed = df.select(*group, F.col(key).alias("k"), seeded_hash(F.col(key), seed).alias("h"))
    hashed = hashed.withColumn("prefix", F.substring("h", 1, PREFIX_DIGITS))
    cutoffs = _cut_prefixes(hashed.select(*group, "prefix"), quota, group)
    if by:
        edge = hashed.join(F.broadcast(cutoffs), by).where("prefix = cut_prefix")
    else:
        one = cutoffs.select(F.struct("cut_prefix", "wanted")).scalar()
        edge = hashed.withColumn("c", one).where("prefix = c.cut_prefix")
        edge = edge.withColumn("wanted", F.col("c.wanted"))
    nth = F.row_number().over(Window.partitionBy(*group, "prefix").orderBy("h", "k"))
    none = F.struct(F.lit("").alias("h"), F.lit(None).cast(df.schema[key].dataType).alias("k"))
    taken = F.max(F.when(F.col("nth") <= F.col("wanted"), F.struct("h", "k")))
    # A cut prefix always has rows; if none of them is wanted the bound is
    # below every row.
    bound = F.when(F.count(F.lit(1)) > 0, F.coalesce(taken, none))
    return edge.withColumn("nth", nth).groupBy(*group).agg(bound.alias("last"))


def small_per_group(df: DataFrame, key: str, by: str, n: int, seed: int | str = 42) -> DataFrame:
    """First ``n`` rows of every group."""
    quota = df.select(by).distinct().withColumn("quota", F.lit(n).cast("long"))
    return take_quota(df, key, quota, by, seed)


def length_edges(lengths: DataFrame, column: str, bins: int = 3) -> DataFrame:
    """Inner edges of equal-frequency bins by linear interpolation, 9 decimals.

    The aggregate keeps one counter per distinct length, so its state is
    bounded by the longest text, not by the row count.  Equal edges are refused.
    """
    shares = F.array(*[F.lit(i / bins) for i in range(bins + 1)])
    edges = F.transform(F.percentile(column, shares), lambda e: F.round(e, 9)).alias("edges")
    distinct = F.size(F.array_distinct("edges")) == bins + 1
    return lengths.agg(edges).select(
        F.when(distinct, F.slice("edges", 2, bins - 1))
        .otherwise(F.raise_error(F.lit("length bin edges must be unique")))
        .alias("edges")
    )


def length_bins(
    df: DataFrame, column: str, labels=("short", "medium", "long"), out: str = "len_bin"
) -> DataFrame:
    """Right-closed equal-frequency bins of ``column``."""
    edges = length_edges(df.select(column), column, len(labels)).scalar()
    value = F.col(column)
    bin_of = F.when(value.isNull(), F.lit(None).cast("string"))
    for i, label in enumerate(labels[:-1]):
        bin_of = bin_of.when(value <= F.element_at(edges, i + 1), label)
    return df.withColumn(out, bin_of.otherwise(labels[-1]))


def stratified_pick(
    df: DataFrame, key: str, by: str, n: int, groups: int, seed: int | str = 42
) -> DataFrame:
    """``n // groups`` rows of every group, topped up to ``n`` from the rest.

    ``n`` is a hand-labelling budget, so the picked rows are few by design.
    Rows that belong to no group (NULL) are not picked.
    """
    per_group = n // groups
    df = df.where(F.col(by).isNotNull())
    picked = small_per_group(df, key, by, per_group, seed).withColumn("_tier", F.lit(0))
    # The rest only has to supply n rows: take the first n + picked candidates
    # in seeded order, then drop those already picked.
    spare = uniform_sample(df, key, n + per_group * groups, seed)
    rest = spare.join(picked.select(key), key, "left_anti").withColumn("_tier", F.lit(1))
    both = picked.unionByName(rest)
    return both.orderBy("_tier", seeded_hash(F.col(key), seed), key).limit(n).drop("_tier")


def undersample(
    df: DataFrame, key: str, label: str, majority: str, seed: int | str = 42
) -> DataFrame:
    """Cut the majority class to the size of all other classes together.

    Rows without a label are not of the majority class, so they stay.
    """
    known = ~F.col(label).eqNullSafe(F.lit(majority))
    quota = df.agg(F.count_if(known).cast("long").alias("quota"))
    return df.where(known).unionByName(
        take_quota(df.where(F.col(label) == majority), key, quota, seed=seed)
    )


def split_sizes(df: DataFrame, label: str, share: float = 0.1) -> DataFrame:
    """(label, rows, quota): validation rows per class.

    The total is ``ceil(share * rows)``; training seats go to classes in
    proportion, remainders first (ties by label).  One row per class.
    """
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy())
    keep = F.col("rows") - F.ceil(F.round(F.col("rows") * share, 9))
    exact = F.col("n").cast("double") * F.col("train_rows") / F.col("rows")
    sized = (
        counts.withColumn("rows", total)
        .withColumn("train_rows", keep)
        .withColumn("base", F.floor(exact))
        .withColumn("part", F.round(exact - F.floor(exact), 9))
    )
    seat = F.row_number().over(Window.orderBy(F.desc("part"), label))
    short = F.col("train_rows") - F.sum("base").over(Window.partitionBy())
    train = F.col("base") + F.when(F.col("seat") <= F.col("short"), 1).otherwise(0)
    return (
        sized.withColumn("seat", seat)
        .withColumn("short", short)
        .select(label, "n", (F.col("n") - train).cast("long").alias("quota"))
    )


def train_val_split(
    df: DataFrame, key: str, label: str, share: float = 0.1, seed: int | str = 42
) -> DataFrame:
    """Add ``split`` ('train' / 'val'), stratified by ``label``."""
    sizes = split_sizes(df, label, share)
    last = last_taken(df, key, sizes.select(label, "quota"), label, seed)
    here = F.struct(seeded_hash(F.col(key), seed).alias("h"), F.col(key).alias("k"))
    is_val = F.col("last").isNull() | (here <= F.col("last"))
    return (
        df.join(F.broadcast(last), label, "left")
        .withColumn("split", F.when(is_val, "val").otherwise("train"))
        .drop("last")
    )


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """'Balanced' weights ``n / (k * n_c)``; one row per class."""
    whole = Window.partitionBy()
    return (
        df.groupBy(label)
        .agg(F.count(F.lit(1)).alias("support"))
        .withColumn(
            "weight",
            F.sum("support").over(whole).cast("double")
            / (F.count(F.lit(1)).over(whole) * F.col("support")),
        )
    )


def leaked_rows(train: DataFrame, golden: DataFrame, text: Column, key: str) -> DataFrame:
    """Training rows whose key or normalised text also sits in the golden set."""
    gold_text = golden.select(text.alias("_gold_text")).where("_gold_text is not null").distinct()
    gold_key = golden.select(F.col(key).alias("_gold_key")).distinct()
    return (
        train.withColumn("_text", text)
        .join(gold_key, F.col(key) == F.col("_gold_key"), "left")
        .join(gold_text, F.col("_text") == F.col("_gold_text"), "left")
        .where("_gold_key is not null or _gold_text is not null")
        .select(*train.columns)
    )


def without_golden(train: DataFrame, golden: DataFrame, key: str) -> DataFrame:
    """Training rows that are not golden rows."""
    return train.join(golden.select(key).distinct(), key, "left_anti")
