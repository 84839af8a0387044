"""MinHash near-dedup of word-shingle multisets (BagMinHash, bands, verification).

The weight of a shingle is how often the text has it.  The weight axis is cut
into the intervals [0,1), [1,2), [2,4), [4,8), ...; each (shingle, interval) is
a Poisson process in time whose rate is the interval's length.  A point lies in
a uniformly drawn unit cell of its interval and counts for a text if the text's
weight covers that cell, so heavy shingles cost a logarithm, not their weight.
Each point hits one signature component, which keeps its earliest point: two
texts agree in a component with probability equal to their weighted Jaccard
similarity.  Points are only made up to a time by which all components are
expected to be hit; texts left incomplete get twice the time.

Search, without ever forming all pairs of a bucket:
1. texts with equal multisets are one node, with a number of its own; ids of
   documents only name classes, they never tell texts apart or bring them together;
2. in every band bucket each node is paired with the bucket's smallest node;
3. pairs whose signatures are far below the threshold go, the others are
   verified on the multisets themselves; links give connected components;
4. buckets that still hold several components are compared across components,
   in groups of bounded size: by signature first, then on the multisets, and
   only one link is kept for each two components that it joins.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from replyforge.llm.words import chunks, find_words, mix, salt, shingles
from replyforge.sources.stages import cut

BANDS, ROWS = 24, 5
SIZE = BANDS * ROWS
SIMILARITY = (4, 5)  # links reach 4/5
# Components of 4 bits that agree at similarity 0.8: 0.8125 * 120 = 97.5, deviation 4.3.
# One pair in 15,000 at exactly 0.8 lies below MIN_AGREE; bands miss as many.
MIN_AGREE = 81
GROUP = 2048  # members of a bucket compared at once, half of a group at most
_LONGS = -(-SIZE // 16)


def multisets(chunk, words=None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shingles, counts, rows), sorted by row, of the texts of a chunk."""
    hashes, bounds = shingles(chunk, words or find_words(chunk))
    row = np.repeat(np.arange(chunk.n), np.diff(bounds))
    order = np.lexsort((hashes, row))
    hashes, row = hashes[order], row[order]
    new = np.ones(len(hashes), dtype=bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(new)
    return hashes[at], np.diff(np.append(at, len(hashes))), row[at]


def _exponential(keys: np.ndarray) -> np.ndarray:
    return -np.log(((keys >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53))


def bag_minhash(
    hashes: np.ndarray, counts: np.ndarray, rows: np.ndarray, n: int, size: int = SIZE
) -> np.ndarray:
    """(n, size) signatures, uint32; every row needs at least one shingle."""
    signature = np.zeros(n * size, dtype=np.uint32)
    weight = np.bincount(rows, weights=counts, minlength=n)
    limit = size * (np.log(size) + 3.0) / weight
    todo = np.ones(n, dtype=bool)
    while todo.any():
        best = np.full(n * size, np.inf)
        chosen = todo[rows]
        h, w, r = hashes[chosen], counts[chosen], rows[chosen]
        level = 0
        while len(h):
            low = 0 if level == 0 else 1 << (level - 1)
            length = max(low, 1)
            _one_interval(h, w, r, level, low, length, limit, best, signature, size)
            level += 1
            deeper = w > (1 << (level - 1))
            h, w, r = h[deeper], w[deeper], r[deeper]
        done = np.isfinite(best.reshape(n, size)).all(axis=1)
        todo &= ~done
        limit[todo] *= 2
    return signature.reshape(n, size)


def _one_interval(h, w, r, level, low, length, limit, best, signature, size) -> None:
    """Adds the points of the processes of one weight interval to ``best``."""
    base = mix(h + salt(61 + level))
    time = np.zeros(len(h))
    made, many = 0, 1
    while len(base):
        steps = np.arange(made, made + many, dtype=np.uint64) * salt(3)
        keys = mix(base[:, None] + steps[None, :])
        times = time[:, None] + np.cumsum(_exponential(keys) / length, axis=1)
        inside = times < limit[r][:, None]
        element, step = np.nonzero(inside)
        key = keys[element, step]
        if level > 1:
            drawn = (mix(key ^ salt(4)) >> np.uint64(11)).astype(np.float64) / float(1 << 53)
            covered = low + np.floor(drawn * length) < w[element]
            element, step, key = element[covered], step[covered], key[covered]
        place = r[element] * size + (mix(key ^ salt(5)) % np.uint64(size)).astype(np.int64)
        when = times[element, step]
        np.minimum.at(best, place, when)
        won = best[place] == when
        signature[place[won]] = (mix(key[won] ^ salt(6)) >> np.uint64(32)).astype(np.uint32)
        alive = inside[:, -1]
        base, time, w, r = base[alive], times[alive, -1], w[alive], r[alive]
        made += many
        many = min(2 * many, 64)


def _bands(signature: np.ndarray) -> np.ndarray:
    """(n, BANDS) bucket keys."""
    parts = signature.astype(np.uint64).reshape(len(signature), BANDS, ROWS)
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64) * salt(7), parts.shape[:2]).copy()
    for k in range(ROWS):
        key = mix(key + parts[:, :, k])
    return key.view(np.int64)


def _nibbles(signature: np.ndarray) -> np.ndarray:
    """(n, _LONGS): the low four bits of each component, sixteen to a long."""
    low = np.zeros((len(signature), _LONGS * 16), dtype=np.uint64)
    low[:, :SIZE] = signature & np.uint32(15)
    shifts = np.arange(16, dtype=np.uint64) * np.uint64(4)
    return (low.reshape(-1, _LONGS, 16) << shifts).sum(axis=2, dtype=np.uint64).view(np.int64)


def _agreement(a: str, b: str) -> Column:
    """Components on which two sketches agree, in generated code."""
    differ = F.lit(0)
    for k in range(_LONGS):
        x = F.col(a)[k].bitwiseXOR(F.col(b)[k])
        for s in (1, 2):
            x = x.bitwiseOR(F.shiftrightunsigned(x, s))
        differ = differ + F.bit_count(x.bitwiseAND(F.lit(0x1111111111111111)))
    return F.lit(SIZE) - differ


_SIGNED = (
    "doc_id long, text_hash binary, high long, low long, bands array<long>, sketch array<long>"
)


def signatures(docs: DataFrame) -> DataFrame:
    """Multiset digest (high, low) and signature of every row of (doc_id, text_hash, text)."""

    def run(batches):
        for batch in batches:
            for chunk in chunks(batch.column(2)):
                hashes, counts, rows = multisets(chunk)
                weight = counts.astype(np.uint64)
                digest = []
                for n in (8, 9):
                    part = mix(hashes ^ salt(n)) * mix(weight + salt(n + 90))
                    ends = np.searchsorted(rows, np.arange(chunk.n + 1))
                    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(part, dtype=np.uint64)])
                    digest.append((sums[ends[1:]] - sums[ends[:-1]]).view(np.int64))
                signature = bag_minhash(hashes, counts, rows, chunk.n)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(chunk.first, chunk.n),
                    batch.column(1).slice(chunk.first, chunk.n),
                    pa.array(digest[0]), pa.array(digest[1]),
                    _lists(_bands(signature)), _lists(_nibbles(signature)),
                ], names=["doc_id", "text_hash", "high", "low", "bands", "sketch"])

    return docs.mapInArrow(run, _SIGNED)


def _lists(table: np.ndarray) -> pa.Array:
    ends = np.arange(0, table.size + 1, table.shape[1], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.ascontiguousarray(table).ravel()))


def bags(texts: DataFrame) -> DataFrame:
    """(id, bag) of (id, text): the multiset as sorted 64-bit keys.

    The n-th occurrence of a shingle has a key of its own, so what two
    multisets share is what their keys have in common.
    """

    def run(batches):
        for batch in batches:
            for chunk in chunks(batch.column(1)):
                hashes, counts, rows = multisets(chunk)
                every, row = np.repeat(hashes, counts), np.repeat(rows, counts)
                turn = np.arange(len(every)) - np.repeat(np.cumsum(counts) - counts, counts)
                keys = mix(every + turn.astype(np.uint64) * salt(10))
                keys = keys[np.lexsort((keys, row))]
                ends = np.searchsorted(row, np.arange(chunk.n + 1))
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(chunk.first, chunk.n),
                    pa.array([keys[x:y].tobytes() for x, y in zip(ends[:-1], ends[1:])], pa.binary()),
                ], names=["id", "bag"])

    return texts.select("id", "text").mapInArrow(run, "id long, bag binary")


def _keys_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(keys of all bags, bounds) without copying the column."""
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32, len(column) + 1 + column.offset)[column.offset:]
    return np.frombuffer(data, np.uint64, at[-1] // 8), at.astype(np.int64) // 8


def _alike(mine: np.ndarray, theirs: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Which of the bags in ``theirs`` reach the similarity with ``mine``."""
    least, most = SIMILARITY
    at = np.minimum(np.searchsorted(mine, theirs), len(mine) - 1)
    shared = np.add.reduceat((mine[at] == theirs).astype(np.int64), bounds[:-1])
    return most * shared >= least * (len(mine) + np.diff(bounds) - shared)


def verified(pairs: DataFrame, held: DataFrame) -> DataFrame:
    """Pairs (a, b) whose multisets reach the similarity; held: (id, bag)."""
    left = held.select(F.col("id").alias("a"), F.col("bag").alias("bag_a"))
    right = held.select(F.col("id").alias("b"), F.col("bag").alias("bag_b"))
    both = pairs.join(right, "b").join(left, "a").select("a", "b", "bag_a", "bag_b")

    def check(batches):
        for batch in batches:
            if not len(batch):
                continue
            own, own_at = _keys_of(batch.column(2))
            other, other_at = _keys_of(batch.column(3))
            a = batch.column(0).to_numpy()
            # Runs of one a: its bag is looked at once.
            edges = [0, *(np.flatnonzero(a[1:] != a[:-1]) + 1).tolist(), len(a)]
            good = np.zeros(len(a), dtype=bool)
            for start, stop in zip(edges[:-1], edges[1:]):
                low, high = other_at[start], other_at[stop]
                good[start:stop] = _alike(
                    own[own_at[start]:own_at[start + 1]], other[low:high],
                    other_at[start:stop + 1] - low,
                )
            yield batch.select(["a", "b"]).filter(pa.array(good))

    return both.mapInArrow(check, "a long, b long")


# -- buckets that hold several components -------------------------------------

_PLACE = "bucket long, i int, j int, side int, id long, root long, sketch array<long>"


def _groups(batches, width: int = 3):
    """Tables of consecutive rows that agree in the first ``width`` columns."""
    held, current = [], None
    for batch in batches:
        if not len(batch):
            continue
        columns = [batch.column(k).to_numpy() for k in range(width)]
        change = np.zeros(len(batch), dtype=bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        edges = [0, *np.flatnonzero(change).tolist(), len(batch)]
        for start, stop in zip(edges[:-1], edges[1:]):
            key = tuple(c[start] for c in columns)
            if key != current and held:
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            current = key
            held.append(batch.slice(start, stop - start))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _across(group: pa.Table):
    """(first row, matrix) blocks: which pairs of a group are likely and apart."""
    n = len(group)
    root, side = group["root"].to_numpy(), group["side"].to_numpy()
    sketch = group["sketch"].combine_chunks().flatten().to_numpy().view(np.uint64).reshape(n, _LONGS)
    between = group["i"][0].as_py() != group["j"][0].as_py()
    for start in range(0, n, 128):
        x = sketch[start:start + 128, None, :] ^ sketch[None]
        x |= x >> np.uint64(1)
        x |= x >> np.uint64(2)
        x &= np.uint64(0x1111111111111111)
        agree = SIZE - np.bitwise_count(x).sum(axis=2, dtype=np.int64)
        pairs = (agree >= MIN_AGREE) & (root[start:start + 128, None] != root[None])
        if between:
            pairs &= side[start:start + 128, None] != side[None]
        yield start, pairs


def _dealt(rows: DataFrame) -> DataFrame:
    return rows.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "id")


def across_components(open_rows: DataFrame, given: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links (a, b) that join components within a bucket.

    ``open_rows``: bucket, id, root, n (rows of the bucket), sketch.  A bucket is
    dealt in blocks of GROUP rows; every pair of blocks is a group of bounded
    size.  A first pass over sketches leaves the rows with a likely partner in
    another component; a second one brings their multisets together and keeps
    one verified link for each two components that it joins.
    """
    blocks = F.ceil(F.col("n") / GROUP).cast("int")
    dealt = (
        open_rows.withColumn("side", F.pmod(F.xxhash64("id"), blocks).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        .select(
            "bucket", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"),
            "side", "id", "root", "sketch",
        )
    )

    def likely(batches):
        for group in _groups(batches):
            keep = np.zeros(len(group), dtype=bool)
            for start, pairs in _across(group):
                keep[start:start + len(pairs)] = pairs.any(axis=1)
            if keep.any():
                yield from group.filter(pa.array(keep)).to_batches()

    rows = cut(_dealt(dealt).mapInArrow(likely, _PLACE), "likely-rows")
    held = bags(_texts_of(given, nodes, rows.select("id").distinct()))
    full = rows.join(held, "id").select("bucket", "i", "j", "side", "id", "root", "sketch", "bag")

    def join(batches):
        for group in _groups(batches):
            ids = group["id"].to_numpy()
            label = np.unique(group["root"].to_numpy(), return_inverse=True)[1]
            keys, at = _keys_of(group["bag"].combine_chunks())
            a, b = [], []
            for start, pairs in _across(group):
                for k in range(len(pairs)):
                    x = start + k
                    partners = np.flatnonzero(pairs[k])
                    partners = partners[(partners > x) & (label[partners] != label[x])]
                    if not len(partners):
                        continue
                    theirs = [keys[at[y]:at[y + 1]] for y in partners]
                    bounds = np.concatenate([[0], np.cumsum([len(t) for t in theirs])])
                    good = _alike(keys[at[x]:at[x + 1]], np.concatenate(theirs), bounds)
                    for y in partners[good]:
                        if label[y] != label[x]:
                            a.append(ids[x])
                            b.append(ids[y])
                            label[label == label[y]] = label[x]
            yield pa.RecordBatch.from_pydict(
                {"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())}
            )

    return _dealt(full).mapInArrow(join, "a long, b long")


def _texts_of(given: DataFrame, nodes: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, text), one row for each node in ``ids``; always a shuffle, at any size.

    A node's first row is found by its id and text.  Rows that repeat both hold
    one text, of which one copy is left.
    """
    wanted = nodes.join(ids, "id", "left_semi").select("id", *_FIRST)
    keyed = given.select(*_row_key("doc_id", "text_hash"), "text")
    return keyed.join(wanted.hint("merge"), _FIRST).select("id", "text").dropDuplicates(["id"])


def components(links: DataFrame) -> DataFrame:
    """(id, root) of every node with a link; root is its component's smallest id.

    Large-star and small-star rounds: every edge moves towards the smallest
    neighbour until all edges are stars.  Only minima are gathered per node.
    """
    edges = cut(
        links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .where("u <> v").distinct(), "edges",
    )
    while not _all_stars(edges):
        # Large star: of each node, the larger neighbours link to its smallest one.
        ways = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = ways.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = ways.join(least, "u").where("v > u").select(
            F.col("v").alias("u"), F.col("m").alias("v")
        ).where("u <> v").distinct()
        # Small star: the smaller neighbours and the node itself link to the smallest.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut(
            small.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct(),
            "stars",
        )
    return edges.select(F.col("u").alias("id"), F.col("v").alias("root"))


def _all_stars(edges: DataFrame) -> bool:
    """Whether every node that links to a smaller one links once and is no centre."""
    ends = edges.select(F.col("u").alias("id"), F.lit(1).alias("child"), F.lit(0).alias("centre"))
    ends = ends.unionByName(
        edges.select(F.col("v").alias("id"), F.lit(0).alias("child"), F.lit(1).alias("centre"))
    )
    sums = ends.groupBy("id").agg(F.sum("child").alias("child"), F.max("centre").alias("centre"))
    return sums.where("child > 1 or (child = 1 and centre = 1)").isEmpty()


def _likely(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """Pairs whose sketches do not rule the similarity out."""
    a = sketches.select(F.col("id").alias("a"), F.col("sketch").alias("sketch_a"))
    b = sketches.select(F.col("id").alias("b"), F.col("sketch").alias("sketch_b"))
    return pairs.join(b, "b").join(a, "a").where(
        _agreement("sketch_a", "sketch_b") >= MIN_AGREE
    ).select("a", "b")


_FIRST = ["first_none", "first_id", "first_hash"]


def _row_key(doc_id: str, text_hash: str) -> list[Column]:
    """Three columns, never NULL, that tell rows apart; their order puts NULL ids last."""
    return [
        F.col(doc_id).isNull().alias("first_none"),
        F.coalesce(doc_id, F.lit(0).cast("long")).alias("first_id"),
        F.col(text_hash).alias("first_hash"),
    ]


def _first_id(row: str) -> Column:
    """The doc_id of a row key."""
    return F.when(~F.col(f"{row}.first_none"), F.col(f"{row}.first_id"))


def _text_hash(text: Column) -> Column:
    """128 bits of a text; NULL reads as empty."""
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def _classified(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(signatures of all rows, nodes with their ``root``): what near copies are linked to.

    Nodes: id, high, low, root and the key of their first row.
    """
    given = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        _text_hash(F.col("text")).alias("text_hash"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    signed = cut(signatures(given), "signatures")
    # Numbers differ in any run of a task; they hold once the table is written.
    nodes = cut(
        signed.groupBy("high", "low", "bands", "sketch").agg(
            F.min(F.struct(*_row_key("doc_id", "text_hash"))).alias("first")
        ).select(
            F.monotonically_increasing_id().alias("id"), "high", "low", "bands", "sketch", "first.*"
        ), "nodes",
    )
    sketches = nodes.select("id", "sketch")
    rows = nodes.select("id", F.explode("bands").alias("bucket"))
    leaders = rows.groupBy("bucket").agg(
        F.min("id").alias("leader"), F.count("*").alias("n")
    ).where("n > 1")
    members = cut(rows.join(leaders, "bucket").select("bucket", "id", "leader", "n"), "members")
    stars = members.where("id <> leader").select(
        F.col("leader").alias("a"), F.col("id").alias("b")
    ).distinct()
    first = cut(_likely(stars, sketches), "candidates")
    ids = first.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    held = cut(bags(_texts_of(given, nodes, ids)), "bags")
    links = cut(verified(first, held), "links")
    joined = components(links)

    # Pairs of two members that are not the leader, in buckets of several components.
    placed = members.where("id <> leader and n > 2").join(joined, "id", "left").select(
        "bucket", "id", F.coalesce("root", "id").alias("root"), "n"
    )
    mixed = placed.groupBy("bucket").agg(
        F.min("root").alias("lo"), F.max("root").alias("hi")
    ).where("lo <> hi").select("bucket")
    open_rows = placed.join(mixed, "bucket").join(sketches, "id")
    more = cut(across_components(open_rows, given, nodes), "links")
    if not more.isEmpty():
        joined = components(links.unionByName(more))
    return signed, nodes.join(joined, "id", "left").select(
        "high", "low", F.coalesce("root", "id").alias("root"), F.struct(*_FIRST).alias("first")
    )


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, class_id, rep_id), one row per row of ``docs``.

    class_id is the smallest doc_id of the group of texts linked, over any
    number of links, by weighted Jaccard similarity of 0.8 or more between
    their multisets of five-word shingles; rep_id is the smallest doc_id with
    the same multiset.  A text of one to four words is one shingle; a text
    without words is alike only to equal texts (NULL reads as empty).  Only
    texts decide on classes: rows that repeat a doc_id, or have none, with
    different texts are different documents.  A NULL doc_id comes after all
    others, so class_id is NULL only where the whole class has no id.  Other
    columns are not looked at.
    """
    signed, nodes = _classified(docs)
    smallest = nodes.groupBy("root").agg(F.min("first").alias("smallest"))
    classes = nodes.join(smallest, "root").select(
        "high", "low", _first_id("smallest").alias("class_id"), _first_id("first").alias("rep_id")
    )
    own = signed.select("doc_id", "high", "low").join(classes, ["high", "low"])
    return own.select("doc_id", "class_id", "rep_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each near-duplicate class, its smallest doc_id.

    Classes are those of ``near_duplicates``; where rows repeat the smallest
    doc_id with different texts, the text with the smallest hash stays.  Of
    rows with one id and one text, a hash of the other columns picks one, so
    the choice is the same in any run.  All columns pass as they are.
    """
    _, nodes = _classified(docs)
    kept = nodes.groupBy("root").agg(F.min("first").alias("first")).select("first.*")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    ordered = [F.col(f"`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString()]
    # Copies go before the exchange; many rows of one id and text are no hot key.
    rows = docs.select(
        F.struct(*columns).alias("_row"), F.xxhash64(*ordered).alias("_order"),
        F.col("doc_id").cast("long").alias("_id"), _text_hash(F.col("text")).alias("_hash"),
    ).groupBy(*_row_key("_id", "_hash")).agg(F.min_by("_row", "_order").alias("_row"))
    return rows.join(kept, _FIRST, "left_semi").select("_row.*")
