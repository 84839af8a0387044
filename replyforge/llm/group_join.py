"""Set-similarity join of documents on five-word shingles (grouped prefix join).

Two sets that reach the similarity t share one of their first
|x| - ceil(t |x|) + 1 shingles in any order that is the same for all documents.
The order used here puts frequent shingles last, so a passage that many
documents share is in few prefixes.  Documents with the same prefix and the
same set size form a group; only groups enter the index:

1. equal sets are one node; nodes with one prefix and size are one group;
2. every prefix shingle is a bucket of groups.  Each group is paired with the
   bucket's first group, each node with the first node of its group; the pairs
   are verified on whole sets, and links give connected components;
3. in buckets that still hold several components, group pairs pass the size and
   position filters in blocks of bounded size; what is left is expanded to its
   members and verified, one link being kept for each two components joined.

So a family of near copies costs about a pair per member and bucket, and no
list of pairs grows with the square of a group, yet every pair of different
texts that can be linked has been looked at or is in one component already.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from replyforge.llm.near_dedup import (
    _FIRST, _alike, _first_id, _groups, _row_key, _text_hash, components,
)
from replyforge.llm.words import LOWER, NOT_BLANK, chunks, find_words, mix, salt, shingles
from replyforge.sources.stages import cut

LEAST, MOST = 4, 5  # linked from similarity 4/5 (that of near_dedup, whose check is used)
BLOCK = 1 << 22  # shingles among which a task looks for repeated ones
FREQUENT = 16  # documents from which a shingle is ranked by its count
RANKED = 1 << 20  # ranked shingles at most: nine bytes each are broadcast
GROUP = 1024  # rows of one side when a bucket is compared
SLOT = 1024  # pairs of one node that are verified together
FILTER_WORDS = 1 << 20  # of the filter of wanted texts: 8 MB, whatever the corpus
SEEN = 100_000  # groups whose prefix a task remembers to have sent

_RECORD = (
    "doc_id long, text_hash binary, high long, low long, size long, group_high long, "
    "group_low long, prefix array<long>"
)
_SET = ["high", "low", "size"]
_KEY = ["group_high", "group_low", "size"]


def shingle_sets(chunk) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingles, rows), sorted by row and shingle; none for wordless texts."""
    words = find_words(chunk, NOT_BLANK, LOWER)
    hashes, bounds = shingles(chunk, words)
    row = np.repeat(np.arange(chunk.n), np.diff(bounds))
    some = words.counts()[row] > 0
    hashes, row = hashes[some], row[some]
    order = np.lexsort((hashes, row))
    hashes, row = hashes[order], row[order]
    new = np.ones(len(hashes), dtype=bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])
    return hashes[new], row[new]


def prefix_length(size):
    """|x| - ceil(t |x|) + 1."""
    return size - -(-LEAST * size // MOST) + 1


class Order:
    """A rank for each of the most frequent shingles; all others come before them."""

    def __init__(self, tokens: np.ndarray, ranks: np.ndarray):
        at = np.argsort(tokens)
        self.tokens, self.ranks = tokens[at], ranks[at]

    def of(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.tokens):
            return np.zeros(len(hashes), np.uint8)
        at = np.minimum(np.searchsorted(self.tokens, hashes), len(self.tokens) - 1)
        return np.where(self.tokens[at] == hashes, self.ranks[at], np.uint8(0))


def frequency_order(texts: DataFrame) -> Order:
    """The order of shingles by document count, over all rows of (text).

    A task reports what it meets twice or more in a block, so a shingle is
    undercounted by the number of blocks at most.  The RANKED most frequent ones
    are ranked, by quarters of powers of two; the order decides on cost, never
    on results.
    """

    def repeated(held):
        tokens, n = np.unique(np.concatenate(held), return_counts=True)
        often = n > 1
        return pa.RecordBatch.from_pydict(
            {"token": tokens[often].view(np.int64), "n": n[often].astype(np.int64)}
        )

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for chunk in chunks(batch.column(0)):
                held.append(shingle_sets(chunk)[0])
                size += len(held[-1])
                if size >= BLOCK:
                    yield repeated(held)
                    held, size = [], 0
        if size:
            yield repeated(held)

    counted = cut(
        texts.mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
        .where(F.col("n") >= FREQUENT)
        .select("token", F.least(F.floor(F.log2("n") * 4), F.lit(255)).cast("int").alias("rank")),
        "frequent",
    )
    least, ranked = 256, 0
    for row in counted.groupBy("rank").count().orderBy(F.desc("rank")).collect():
        ranked += row["count"]
        if ranked > RANKED:
            break
        least = row["rank"]
    found = counted.where(F.col("rank") >= least).toArrow()
    return Order(
        found["token"].to_numpy().view(np.uint64), found["rank"].to_numpy().astype(np.uint8)
    )


def _digests(values: np.ndarray, ends: np.ndarray, first: int) -> list[np.ndarray]:
    """Two 64-bit digests of each run of values, whatever their order."""
    out = []
    for n in (first, first + 1):
        sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(mix(values ^ salt(n)), out=sums[1:])
        out.append((sums[ends[1:]] - sums[ends[:-1]]).view(np.int64))
    return out


def records(given: DataFrame, order: Order) -> DataFrame:
    """One record for each row of (doc_id, text_hash, text); see _RECORD.

    A task sends the prefix of a group once; later records of the group, such as
    copies, have an empty one.
    """
    shared = given.sparkSession.sparkContext.broadcast((order.tokens, order.ranks))

    def run(batches):
        order = Order(*shared.value)
        seen: set = set()
        for batch in batches:
            for chunk in chunks(batch.column(2)):
                hashes, row = shingle_sets(chunk)
                ends = np.searchsorted(row, np.arange(chunk.n + 1))
                size = np.diff(ends)
                high, low = _digests(hashes, ends, 20)
                hashes = hashes[np.lexsort((hashes, order.of(hashes), row))]
                place = np.arange(len(row)) - ends[row]
                first = place < prefix_length(size)[row]
                prefix, row = hashes[first], row[first]
                at = np.searchsorted(row, np.arange(chunk.n + 1))
                group = _digests(prefix, at, 22)
                send = np.zeros(chunk.n, bool)
                for k, key in enumerate(zip(group[0].tolist(), group[1].tolist(), size.tolist())):
                    if key not in seen:
                        send[k] = True
                        if len(seen) >= SEEN:
                            seen.clear()
                        seen.add(key)
                sent = send[row]
                lengths = np.where(send, np.diff(at), 0)
                lists = pa.ListArray.from_arrays(
                    pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)),
                    pa.array(prefix[sent].view(np.int64)),
                )
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(chunk.first, chunk.n),
                    batch.column(1).slice(chunk.first, chunk.n),
                    pa.array(high), pa.array(low), pa.array(size.astype(np.int64)),
                    pa.array(group[0]), pa.array(group[1]), lists,
                ], names=[f.split()[0] for f in _RECORD.split(", ")])

    return given.mapInArrow(run, _RECORD)


# -- whole sets ----------------------------------------------------------------


def pack(hashes: np.ndarray) -> bytes:
    """A set as sorted 48-bit keys.  Two sets of 20,000 shingles share a key by
    chance once in a million pairs."""
    keys = np.unique(hashes & np.uint64((1 << 48) - 1))
    return np.ascontiguousarray(keys.view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def unpack(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(keys of all sets of a binary column, bounds)."""
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32, len(column) + 1 + column.offset)[column.offset:]
    wide = np.zeros(((at[-1] - at[0]) // 6, 8), np.uint8)
    if len(wide):
        wide[:, :6] = np.frombuffer(data, np.uint8)[at[0]:at[-1]].reshape(-1, 6)
    return wide.view(np.uint64).ravel(), (at.astype(np.int64) - at[0]) // 6


def _bits(hashes: pa.Array) -> np.ndarray:
    """(rows, 4): places of 16-byte text hashes in the filter of FILTER_WORDS words."""
    own = np.frombuffer(b"".join(hashes.to_pylist()), np.uint32).reshape(-1, 4)
    return (own & np.uint32(64 * FILTER_WORDS - 1)).astype(np.int64)


def _maybe_wanted(given: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of ``given`` whose text hash may be wanted, by a Bloom filter of fixed size.

    It only spares the exchange texts that nobody asks for; a corpus with more
    wanted texts than it can tell apart sends more of them, with the same result.
    """

    def mark(batches):
        words = np.zeros(FILTER_WORDS, np.uint64)
        for batch in batches:
            at = _bits(batch.column(0)).ravel()
            np.bitwise_or.at(words, at >> 6, np.uint64(1) << (at & 63).astype(np.uint64))
        seen = np.flatnonzero(words)
        yield pa.RecordBatch.from_pydict({"word": seen, "bits": words[seen].view(np.int64)})

    marked = wanted.select("first_hash").mapInArrow(mark, "word long, bits long").groupBy("word").agg(
        F.bit_or("bits").alias("bits")
    ).toArrow()  # FILTER_WORDS rows at most
    words = np.zeros(FILTER_WORDS, np.uint64)
    words[marked["word"].to_numpy()] = marked["bits"].to_numpy().view(np.uint64)
    shared = given.sparkSession.sparkContext.broadcast(words)

    def run(batches):
        words = shared.value
        for batch in batches:
            at = _bits(batch.column(1))
            inside = (words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)
            yield batch.filter(pa.array(inside.all(axis=1)))

    return given.mapInArrow(run, given.schema)


def sets_at(given: DataFrame, nodes: DataFrame, places: DataFrame) -> DataFrame:
    """``places`` (id, ...) with the set of each id as ``bag``.

    A text travels once, to its node's key; its set is made there and sent
    straight to all its places.
    """
    others = [c for c in places.columns if c != "id"]
    # A node has a place per prefix shingle, or per SLOT of its pairs, at most.
    to = places.groupBy("id").agg(F.collect_list(F.struct(*others)).alias("to"))
    wanted = cut(nodes.select("id", *_FIRST).join(to, "id"), "wanted")
    few = _maybe_wanted(given, wanted).select(*_row_key("doc_id", "text_hash"), "text")
    # Rows that repeat id and text give one set.
    texts = few.join(wanted, _FIRST).dropDuplicates(_FIRST).select("id", "to", "text")

    def run(batches):
        for batch in batches:
            for chunk in chunks(batch.column(2)):
                hashes, row = shingle_sets(chunk)
                ends = np.searchsorted(row, np.arange(chunk.n + 1))
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(chunk.first, chunk.n),
                    batch.column(1).slice(chunk.first, chunk.n),
                    pa.array([pack(hashes[x:y]) for x, y in zip(ends[:-1], ends[1:])], pa.binary()),
                ], names=["id", "to", "bag"])

    schema = texts.select("id", "to").schema.add("bag", "binary")
    sent = texts.mapInArrow(run, schema).select("id", F.explode("to").alias("to"), "bag")
    return sent.select("id", "to.*", "bag")


def verified(pairs: DataFrame, given: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) whose sets reach the similarity.

    The set of ``a`` travels once for every SLOT of its pairs, not with each.
    """
    many = cut(
        pairs.groupBy("a").count().where(F.col("count") > SLOT).select(
            "a", F.ceil(F.col("count") / SLOT).cast("int").alias("slots")
        ), "slots",
    )
    slots = F.coalesce("slots", F.lit(1))
    dealt = pairs.join(many, "a", "left").select(
        "a", "b", F.pmod(F.xxhash64("b"), slots).cast("int").alias("slot")
    )
    leads = dealt.select(F.col("a").alias("id"), "a", "slot", F.lit(True).alias("leads")).distinct()
    rest = dealt.select(F.col("b").alias("id"), "a", "slot", F.lit(False).alias("leads"))
    rows = sets_at(given, nodes, leads.unionByName(rest)).select("a", "id", "leads", "bag", "slot")
    rows = rows.repartition("a", "slot").sortWithinPartitions("a", "slot", F.desc("leads"), "id")

    def check(batches):
        mine = None
        for batch in batches:
            if not len(batch):
                continue
            keys, at = unpack(batch.column(3))
            leads = np.flatnonzero(batch.column(2).to_numpy(zero_copy_only=False))
            good = np.zeros(len(batch), dtype=bool)
            for start, stop in zip([0, *(leads + 1).tolist()], [*leads.tolist(), len(batch)]):
                if start:
                    mine = keys[at[start - 1]:at[start]].copy()
                if stop > start:
                    good[start:stop] = _alike(
                        mine, keys[at[start]:at[stop]], at[start:stop + 1] - at[start]
                    )
            found = batch.select(["a", "id"]).filter(pa.array(good))
            yield found.rename_columns(["a", "b"])

    return rows.mapInArrow(check, "a long, b long")


# -- buckets that hold several components -------------------------------------


def _in_blocks(rows: DataFrame, member: str) -> DataFrame:
    """``rows`` (token, n, ...), once for each pair of blocks (i, j) of their bucket."""
    blocks = F.ceil(F.col("n") / GROUP).cast("int")
    return (
        rows.withColumn("side", F.pmod(F.xxhash64(member), blocks).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        .withColumns({"i": F.least("side", "other"), "j": F.greatest("side", "other")})
        .drop("n", "other")
    )


def _dealt(rows: DataFrame, member: str) -> DataFrame:
    first = [F.col(c) for c in ("token", "i", "j")]
    rest = [F.col(c) for c in rows.columns if c not in ("token", "i", "j")]
    return rows.select(*first, *rest).repartition("token", "i", "j").sortWithinPartitions(
        "token", "i", "j", member
    )


def _possible(group: pa.Table):
    """(first row, matrix): pairs that size and position leave possible.

    A pair meets in the bucket of its first common shingle; what follows that in
    both sets bounds the overlap, which has to reach t / (1 + t) of both sizes.
    """
    size, rest = group["size"].to_numpy(), group["size"].to_numpy() - group["pos"].to_numpy()
    side = group["side"].to_numpy()
    between = group["i"][0].as_py() != group["j"][0].as_py()
    for start in range(0, len(group), 256):
        of = slice(start, start + 256)
        bound = np.minimum(rest[of, None], rest[None])
        pairs = (LEAST + MOST) * bound >= LEAST * (size[of, None] + size[None])
        if between:
            pairs &= side[of, None] != side[None]
        yield start, pairs


def possible_groups(placed: DataFrame) -> DataFrame:
    """(token, pos, head) of groups with a possible partner in another component.

    ``placed``: token, n, pos, head, size, and the group's smallest and largest
    component lo and hi.
    """

    def run(batches):
        for group in _groups(batches):
            lo, hi = group["lo"].to_numpy(), group["hi"].to_numpy()
            pos = group["pos"].to_numpy()
            keep = (lo != hi) & (pos == 0)  # several components within the group
            for start, pairs in _possible(group):
                of = slice(start, start + len(pairs))
                pairs &= (lo[of, None] != lo[None]) | (hi[of, None] != hi[None]) | (
                    lo[of, None] != hi[of, None])
                own = np.arange(start, start + len(pairs))
                pairs[own - start, own] = False
                keep[of] |= pairs.any(axis=1)
            if keep.any():
                kept = group.filter(pa.array(keep)).select(["token", "pos", "head"])
                yield from kept.to_batches()

    dealt = _dealt(_in_blocks(placed, "head"), "head")
    return dealt.mapInArrow(run, "token long, pos int, head long").distinct()


def links_across(rows: DataFrame, given: DataFrame, nodes: DataFrame) -> DataFrame:
    """Verified links (a, b) that join components; rows: token, n, pos, id, size, root."""
    full = sets_at(given, nodes, _in_blocks(rows, "id"))

    def run(batches):
        for group in _groups(batches):
            ids = group["id"].to_numpy()
            label = np.unique(group["root"].to_numpy(), return_inverse=True)[1]
            keys, at = unpack(group["bag"].combine_chunks())
            a, b = [], []
            for start, pairs in _possible(group):
                for k in range(len(pairs)):
                    x = start + k
                    partners = x + 1 + np.flatnonzero(pairs[k, x + 1:])
                    partners = partners[label[partners] != label[x]]
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

    return _dealt(full, "id").mapInArrow(run, "a long, b long")


def _rooted(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``nodes`` with the smallest node of their component as ``root``."""
    return cut(
        nodes.join(components(links), "id", "left").withColumn("root", F.coalesce("root", "id")),
        "rooted",
    )


def linked(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id), one row per row of ``docs``.

    Words are maximal runs without the six ASCII blanks, A-Z lower-cased; a
    document's set is its distinct five-word shingles, with fewer words the
    whole sequence; a NULL or wordless text has none and is linked with nothing.
    Documents link from Jaccard similarity 4/5 on, copies included;
    component_id is the smallest doc_id that links reach.  Only texts decide:
    rows that repeat a doc_id, or have none, with different texts are documents
    of their own, and NULL comes after all ids, so component_id is NULL only
    where the whole component has no id.  Other columns are not looked at.
    """
    given = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        _text_hash(F.col("text")).alias("text_hash"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    signed = cut(records(given, frequency_order(given.select("text"))), "records")
    worded = signed.where("size > 0")
    # Numbers differ in any run of a task; they hold once the table is written.
    nodes = cut(
        worded.groupBy(*_SET, "group_high", "group_low").agg(
            F.min(F.struct(*_row_key("doc_id", "text_hash"))).alias("first")
        ).select(F.monotonically_increasing_id().alias("id"), *_SET, *_KEY[:2], "first.*"), "nodes",
    )
    heads = nodes.groupBy(*_KEY).agg(F.min("id").alias("head"), F.count("*").alias("copies"))
    prefixes = worded.where(F.size("prefix") > 0).groupBy(*_KEY).agg(
        F.max("prefix").alias("prefix")
    )
    groups = cut(heads.join(prefixes, _KEY), "groups")
    nodes = cut(nodes.join(groups.select(*_KEY, "head"), _KEY).drop(*_KEY[:2]), "members")

    index = groups.select("head", "size", "copies", F.posexplode("prefix").alias("pos", "token"))
    buckets = cut(
        index.groupBy("token").agg(
            F.min("head").alias("leader"), F.sum("copies").alias("nodes"), F.count("*").alias("n"),
            F.bit_xor(F.xxhash64("head")).alias("same"),
        ).where("nodes > 1"), "buckets",
    )
    # Buckets of the same groups become one: two alike texts share many shingles.  Each
    # group keeps its first position in any of them, which can only admit more pairs.
    placed = cut(
        index.join(buckets, "token")
        .groupBy(F.xxhash64("same", "n").alias("token"), "head", "size", "leader", "nodes", "n")
        .agg(F.min("pos").alias("pos")), "placed",
    )

    # First the pairs with a bucket's first group, and with a group's first node.
    leads = placed.where("head = leader").select(
        "token", F.col("size").alias("size_a"), (F.col("size") - F.col("pos")).alias("rest_a")
    )
    bound = F.least(F.col("size") - F.col("pos"), "rest_a")  # as in _possible
    stars = (
        placed.where("head <> leader").join(leads, "token")
        .where((LEAST + MOST) * bound >= LEAST * (F.col("size") + F.col("size_a")))
        .select(F.col("leader").alias("a"), F.col("head").alias("b")).distinct()
    )
    inside = nodes.where("id <> head").select(F.col("head").alias("a"), F.col("id").alias("b"))
    pairs = cut(stars.unionByName(inside), "pairs")
    links = cut(verified(pairs, given, nodes), "links")
    rooted = _rooted(nodes, links)

    # Then the buckets that hold several components.  Where each group is one node, all
    # pairs with the leader have been looked at; two nodes are one pair in any case.
    spans = rooted.groupBy("head").agg(F.min("root").alias("lo"), F.max("root").alias("hi"))
    open_rows = placed.where("nodes > 2 and (head <> leader or nodes > n)")
    spanned = open_rows.select("token", "pos", "head", "size").join(spans, "head")
    mixed = spanned.groupBy("token").agg(
        F.min("lo").alias("least"), F.max("hi").alias("most"), F.count("*").alias("n")
    ).where("least <> most").select("token", "n")
    left = cut(possible_groups(spanned.join(mixed, "token")), "possible-groups")
    rows = left.join(rooted.select("head", "id", "size", "root"), "head").drop("head")
    rows = cut(rows, "possible-members")
    counts = rows.groupBy("token").agg(F.count("*").alias("n"))
    more = cut(links_across(rows.join(counts, "token"), given, nodes), "links")
    if not more.isEmpty():
        rooted = _rooted(nodes, links.unionByName(more))

    smallest = rooted.groupBy("root").agg(
        F.min(F.struct(*_FIRST)).alias("smallest")
    ).select("root", _first_id("smallest").alias("component_id"))
    classes = rooted.join(smallest, "root").select(*_SET, "component_id")
    own = worded.select("doc_id", *_SET).join(classes, _SET).select(
        "doc_id", F.col("size").alias("n_shingles"), "component_id"
    )
    return own.unionByName(signed.where("size = 0").select(
        "doc_id", F.col("size").alias("n_shingles"), F.col("doc_id").alias("component_id")
    ))
