"""Sharding by a k-d tree over text metadata, split at weighted medians.

A text is a point; its coordinates are numbers computed from the text alone
(UTF-8 bytes, code points, lines, bytes outside ASCII), so equal texts are one
point and always share a shard, and no join is needed to place a row.  A node
that is to become s shards is cut along its widest dimension (spread divided
by the spread of the whole table) where floor(s/2)/s of its bytes lie below.
Ties on the dimension are ordered by a 64-bit hash of the text, so a cut is
as even as whole groups of equal texts allow.

The medians are distributed: every round is one aggregate that adds bytes into
``BINS`` bins of all open nodes at once, and the next round looks only into the
bin that holds the cut.  The driver sees bins x nodes sums, never rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, functions as F

from replyforge.sources.stages import cut

BINS = 1024
TOLERANCE = 1e-4
DIMENSIONS = ("size", "chars", "lines", "wide")
SLOT_ROWS = 100_000  # rows numbered together, on average
_HASH = "tie"


@dataclass
class Node:
    """Part of the table: ``shards`` leaves from ``first`` on; a cut if more than one."""

    first: int
    shards: int
    dim: str | None = None
    value: int = 0
    tie: int = 0
    left: Node | None = None
    right: Node | None = None
    spreads: dict = field(default_factory=dict)
    weight: int = 0
    empty: bool = False


def text_points(docs: DataFrame, text: str = "text") -> DataFrame:
    """Rows with size (UTF-8 bytes plus 1), text_crc32 and coordinates; no text.

    A NULL text has no bytes: size 1, crc32 of nothing, and stands with empty texts.
    """
    raw = F.coalesce(F.col(text), F.lit(""))
    return docs.select(
        *[c for c in docs.columns if c != text],
        (F.octet_length(raw) + 1).cast("long").alias("size"),
        F.crc32(raw.cast("binary")).alias("text_crc32"),
        F.length(raw).cast("long").alias("chars"),
        (F.length(raw) - F.length(F.replace(raw, F.lit("\n"))) + 1).cast("long").alias("lines"),
        (F.octet_length(raw) - F.length(raw)).cast("long").alias("wide"),
        # 62 bits: the span between two of them fits into a long.
        F.shiftrightunsigned(F.xxhash64(raw), 2).alias(_HASH),
    )


def _below(node: Node) -> Column:
    dim = F.col(node.dim)
    return (dim < node.value) | ((dim == node.value) & (F.col(_HASH) <= node.tie))


def shard_column(node: Node) -> Column:
    """The tree as one expression over the coordinates."""
    if node.left is None:
        return F.lit(node.first)
    return F.when(_below(node), shard_column(node.left)).otherwise(shard_column(node.right))


def _leaves(node: Node) -> list[Node]:
    return [node] if node.left is None else _leaves(node.left) + _leaves(node.right)


def _spread(points: DataFrame, nodes: list[Node]) -> None:
    at = points.groupBy("node").agg(
        F.sum("size").alias("weight"),
        *[F.min(d).alias(f"lo_{d}") for d in (*DIMENSIONS, _HASH)],
        *[F.max(d).alias(f"hi_{d}") for d in (*DIMENSIONS, _HASH)],
    )
    found = {r["node"]: r for r in at.collect()}  # one row per node
    for node in nodes:
        if row := found.get(node.first):
            node.weight = row["weight"]
            node.spreads = {d: (row[f"lo_{d}"], row[f"hi_{d}"]) for d in (*DIMENSIONS, _HASH)}


@dataclass
class _Search:
    """Where the cut of a node may still lie."""

    column: str  # the dimension, or the tie hash within one value of it
    low: int
    high: int
    under: int  # bytes known to lie below
    goal: float
    value: int | None = None

    @property
    def step(self) -> int:
        return -(-(self.high - self.low + 1) // BINS)


def _cut_nodes(points: DataFrame, nodes: list[Node], scale: dict[str, int]) -> None:
    """Sets dim, value and tie of ``nodes``: several rounds of one aggregate each."""
    searches = {}
    for node in nodes:
        node.dim = max(
            DIMENSIONS,
            key=lambda d: ((node.spreads[d][1] - node.spreads[d][0]) / max(scale[d], 1),
                           -DIMENSIONS.index(d)),
        )
        goal = node.weight * (node.shards // 2) / node.shards
        searches[node.first] = _Search(node.dim, *node.spreads[node.dim], 0, goal)
    open_nodes = list(nodes)
    while open_nodes:
        place = seen = F.lit(None).cast("long")
        for node in open_nodes:
            s = searches[node.first]
            here = (F.col("node") == node.first) & F.col(s.column).between(s.low, s.high)
            if s.value is not None:
                here &= F.col(node.dim) == s.value
            place = F.when(here, F.expr(f"({s.column} - {s.low}) div {s.step}")).otherwise(place)
            seen = F.when(here, F.col(s.column)).otherwise(seen)
        sums = points.groupBy("node", place.alias("bin")).agg(
            F.sum("size").alias("bytes"), F.min(seen).alias("low"), F.max(seen).alias("high")
        )
        bins: dict[int, list] = {}
        for r in sums.where("bin is not null").collect():  # BINS rows per open node at most
            bins.setdefault(r["node"], []).append(
                (r["low"], r["high"], r["bytes"])
            )
        still = []
        for node in open_nodes:
            s = searches[node.first]
            for low, high, weight in sorted(bins[node.first]):
                if s.under + weight >= s.goal:
                    break
                s.under += weight
            over = s.under + weight
            close = node.weight * TOLERANCE
            if s.column != _HASH and low == high and over - s.goal > close:
                # One value of the dimension straddles the cut: order it by hash.
                searches[node.first] = _Search(
                    _HASH, *node.spreads[_HASH], s.under, s.goal, low
                )
                still.append(node)
            elif low == high or min(over - s.goal, s.goal - s.under) <= close:
                edge = high if over - s.goal <= s.goal - s.under else low - 1
                if s.column == _HASH:
                    node.value, node.tie = s.value, edge
                else:
                    node.value, node.tie = edge, (1 << 63) - 1
            else:
                s.low, s.high = low, high
                still.append(node)
        open_nodes = still


def place_points(points: DataFrame, shards: int) -> tuple[DataFrame, Node]:
    """Points with their ``node`` (the leaf's number), and the tree.

    The table is written again after each level, with the node it has reached.
    A node without rows stays whole, and its shards stay empty.
    """
    tree = Node(0, shards)
    points = points.withColumn("node", F.lit(0))
    scale: dict[str, int] = {}
    while nodes := [n for n in _leaves(tree) if n.shards > 1 and not n.empty]:
        _spread(points, nodes)
        for n in nodes:
            n.empty = not n.spreads
        if not scale and not tree.empty:
            scale = {d: hi - lo for d, (lo, hi) in tree.spreads.items()}
        nodes = [n for n in nodes if not n.empty]
        _cut_nodes(points, nodes, scale)
        below = F.col("node")
        for n in nodes:
            half = n.shards // 2
            n.left, n.right = Node(n.first, half), Node(n.first + half, n.shards - half)
            below = F.when(
                F.col("node") == n.first,
                F.when(_below(n), n.first).otherwise(n.first + half),
            ).otherwise(below)
        if nodes:
            points = cut(points.withColumn("node", below), "nodes")
    return points, tree


def numbered(placed: DataFrame, shard: str, order: list[str], total: int, shards: int) -> DataFrame:
    """Adds ``slot``: 0, 1, 2, ... within each shard, without one task per shard.

    A shard's rows are numbered in hash buckets of about SLOT_ROWS rows and
    shifted by the rows of the buckets before.
    """
    buckets = max(1, total // (shards * SLOT_ROWS))
    bucketed = placed.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    sizes = bucketed.groupBy(F.col(shard).alias("_s"), F.col("_bucket").alias("_b")).agg(
        F.count("*").alias("_n")
    )
    before = Window.partitionBy("_s").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    shift = sizes.select("_s", "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    own = Window.partitionBy(shard, "_bucket").orderBy(*order)
    return (
        bucketed.withColumn("_row", F.row_number().over(own))
        .join(shift, (F.col(shard) == F.col("_s")) & (F.col("_bucket") == F.col("_b")), "left")
        .withColumn("slot", (F.col("_shift") + F.col("_row") - 1).cast("long"))
        .drop("_s", "_b", "_shift", "_row", "_bucket")
    )


def shard_documents(
    docs: DataFrame, shards: int | None = None, target_bytes: int | None = None,
    id_column: str = "doc_id",
) -> DataFrame:
    """(id, size, text_crc32, shard, slot), one row per row of ``docs``.

    Give the number of shards, or target_bytes: then as many leaves as the
    table's bytes need.  Repeated rows and equal texts share a shard; a group
    of equal texts larger than a shard is not cut.  NULL ids are allowed.
    Other columns, whatever their names, are not looked at.
    """
    points = cut(
        text_points(docs.select(F.col(id_column).alias("doc_id"), "text")), "points"
    )
    total = points.agg(F.sum("size").alias("w"), F.count("*").alias("n")).first()
    if shards is None:
        shards = max(1, -(-(total["w"] or 0) // target_bytes))
    points, _ = place_points(points, shards)
    placed = points.withColumn("shard", F.col("node").cast("int"))
    out = numbered(placed, "shard", ["doc_id", "text_crc32", "size"], total["n"], shards)
    return out.select(F.col("doc_id").alias(id_column), "size", "text_crc32", "shard", "slot")
