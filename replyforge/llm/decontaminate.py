"""Benchmark decontamination with suffix arrays over the training documents.

A shard is a run of whole documents of about ``SHARD_BYTES``.  Its word suffix
array is built by prefix doubling (only groups still tied are sorted again),
deep enough for the longest window.  Every benchmark suffix that is long enough
for a window is looked up by binary search in every shard; the matching range
gives all places, and where a suffix begins to match, the match is followed to
its last word.  Suffixes that begin alike are looked up once.  Documents never
move: a shard lives and dies within one task.

Benchmark items are the stated query set.  They are read in blocks of at most
``BLOCK_BYTES`` of text, so what is sent to the executors at once is bounded;
with more blocks the documents are read once per block and hits are united.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from replyforge.llm.words import LOWER, Chunk, Words, chunks, find_words

WINDOW = 10
SHARD_BYTES = 1 << 21
BLOCK_BYTES = 8 << 20
PAIRS = 1 << 20  # pairs of a hit and an item's place that are followed at once

HITS = ("doc_id long, text_key binary, n_words long, spans array<struct<start:long,stop:long>>, "
        "items array<string>, longest long")

_HITS_ARROW = pa.schema([
    ("doc_id", pa.int64()), ("text_key", pa.binary()), ("n_words", pa.int64()),
    ("spans", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))),
    ("items", pa.list_(pa.string())), ("longest", pa.int64()),
])


@dataclass
class SuffixArray:
    """Suffixes of a shard's word sequence, sorted by their first ``depth`` words or more."""

    vocabulary: np.ndarray  # sorted word hashes
    sequence: np.ndarray  # 1 + place in the vocabulary; 0 ends a document
    order: np.ndarray

    @classmethod
    def build(cls, words: Words, depth: int) -> SuffixArray:
        vocabulary, place = np.unique(words.hashes, return_inverse=True)
        counts = words.counts()
        rows = np.repeat(np.arange(len(counts)), counts)
        sequence = np.zeros(len(place) + len(counts), dtype=np.int64)
        sequence[np.arange(len(place)) + rows] = place + 1
        n = len(sequence)
        order = np.argsort(sequence, kind="stable")
        rank = np.zeros(n + 1, dtype=np.int64)  # rank[n]: before everything

        def regroup(slots: np.ndarray, keys: np.ndarray) -> np.ndarray:
            """New ranks of suffixes lying in ``slots`` with sorted ``keys``; tie mask."""
            new = np.ones(len(keys), dtype=bool)
            new[1:] = keys[1:] != keys[:-1]
            group = np.cumsum(new) - 1
            rank[order[slots]] = slots[new][group] + 1
            size = np.diff(np.append(np.flatnonzero(new), len(keys)))
            return size[group] > 1

        slots = np.arange(n)
        tied = regroup(slots, sequence[order]) if n else np.zeros(0, bool)
        step = 1
        while step < depth and tied.any():
            slots = slots[tied]
            open_ = order[slots]
            key = rank[open_] * (n + 2) + rank[np.minimum(open_ + step, n)]
            by = np.argsort(key, kind="stable")
            order[slots] = open_[by]
            tied = regroup(slots, key[by])
            step *= 2
        return cls(vocabulary, sequence, order)

    def find(self, windows: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges of ``order`` whose suffixes begin with each window.

        ``windows`` holds word hashes, one row each, of which the first
        ``lengths`` count.
        """
        n = len(self.order)
        place = np.searchsorted(self.vocabulary, windows)
        known = self.vocabulary[np.minimum(place, len(self.vocabulary) - 1)] == windows \
            if len(self.vocabulary) else np.zeros(windows.shape, bool)
        used = np.arange(windows.shape[1]) < lengths[:, None]
        able = np.flatnonzero((known | ~used).all(axis=1))
        low = np.zeros(len(windows), dtype=np.int64)
        high = np.zeros(len(windows), dtype=np.int64)
        if len(able):
            wanted = place[able] + 1
            low[able] = self._bound(wanted, lengths[able], n, upper=False)
            high[able] = self._bound(wanted, lengths[able], n, upper=True)
        return low, high

    def _bound(self, wanted: np.ndarray, lengths: np.ndarray, n: int, upper: bool) -> np.ndarray:
        low = np.zeros(len(wanted), dtype=np.int64)
        high = np.full(len(wanted), n, dtype=np.int64)
        while (open_ := np.flatnonzero(low < high)).size:
            middle = (low[open_] + high[open_]) // 2
            suffix = self.order[middle]
            sign = np.zeros(len(open_), dtype=np.int64)
            equal = np.arange(len(open_))
            for k in range(wanted.shape[1]):
                equal = equal[(sign[equal] == 0) & (lengths[open_[equal]] > k)]
                if not len(equal):
                    break
                at = suffix[equal] + k
                have = np.where(at < n, self.sequence[np.minimum(at, n - 1)], 0)
                sign[equal] = np.sign(have - wanted[open_[equal], k])
            right = (sign < 0) | ((sign == 0) & upper)
            low[open_[right]] = middle[right] + 1
            high[open_[~right]] = middle[~right]
        return low


@dataclass
class Suffixes:
    """Suffixes of a block of items: distinct first windows, and where they lie.

    ``sequence`` holds the word hashes of all items, a 0 before and after each;
    window w begins there at ``places[first[w]:first[w + 1]]``.
    """

    windows: np.ndarray
    lengths: np.ndarray
    items_of: list[np.ndarray]
    sequence: np.ndarray
    places: np.ndarray
    first: np.ndarray
    item_ids: list[str]
    word_bytes: dict[int, bytes]

    @classmethod
    def of(cls, ids: list[str], texts: list[str], window: int) -> Suffixes:
        word_bytes: dict[int, bytes] = {}
        held: dict[tuple, tuple[set[int], list[int]]] = {}
        sequence: list[int] = [0]
        for item, text in enumerate(texts):
            for chunk in chunks(pa.array([text], pa.string()), 1 << 40):
                words = find_words(chunk)
                folded = LOWER[chunk.data]
                hashes = [int(h) for h in words.hashes]
                for h, a, b in zip(hashes, words.starts, words.ends):
                    if word_bytes.setdefault(h, folded[a:b].tobytes()) != folded[a:b].tobytes():
                        raise ValueError("two benchmark words share a 64-bit hash")
                size = min(window, len(hashes))
                for k in range(len(hashes) - size + 1 if size else 0):
                    items, places = held.setdefault(tuple(hashes[k:k + size]), (set(), []))
                    items.add(item)
                    places.append(len(sequence) + k)
                sequence += [*hashes, 0]
        table = np.zeros((len(held), window), dtype=np.uint64)
        lengths = np.zeros(len(held), dtype=np.int64)
        for row, key in enumerate(held):
            table[row, : len(key)] = key
            lengths[row] = len(key)
        places = [p for _, p in held.values()]
        return cls(
            table, lengths, [np.array(sorted(i)) for i, _ in held.values()],
            np.array(sequence, dtype=np.uint64), np.array(sum(places, []), dtype=np.int64),
            np.cumsum([0, *map(len, places)]), ids, word_bytes,
        )

    def longest(self, hashes: np.ndarray, which: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Words of the longest match that begins at each hit, 0 where one goes on from
        the word before: window which[k] lies at place at[k] of ``hashes``, which has a
        0 at both ends of every text."""
        best = np.zeros(len(at), dtype=np.int64)
        count = np.diff(self.first)[which]
        ends = np.cumsum(count)
        start = 0
        while start < len(at):
            # Hits and places of their windows in pairs, a bounded number at a time.
            stop = max(start + 1, int(np.searchsorted(ends, ends[start] + PAIRS, "right")))
            n = count[start:stop]
            hit = np.repeat(np.arange(start, stop), n)
            offset = np.arange(len(hit)) - np.repeat(np.cumsum(n) - n, n)
            mine = self.places[self.first[which[hit]] + offset]
            theirs = at[hit]
            begins = (self.sequence[mine - 1] != hashes[theirs - 1]) | (self.sequence[mine - 1] == 0)
            hit, mine, theirs = hit[begins], mine[begins], theirs[begins]
            size = self.lengths[which[hit]]
            going = np.arange(len(hit))
            while len(going):
                word = self.sequence[mine[going] + size[going]]
                going = going[(word != 0) & (word == hashes[theirs[going] + size[going]])]
                size[going] += 1
            np.maximum.at(best, hit, size)
            start = stop
        return best


def _search(chunk: Chunk, block: Suffixes, window: int):
    """Per document: (words, hit spans, ids of items, longest match in words)."""
    words = find_words(chunk)
    counts = words.counts()
    index = SuffixArray.build(words, window)
    low, high = index.find(block.windows, block.lengths)
    found = high - low
    which = np.repeat(np.arange(len(found)), found)
    offsets = np.arange(len(which)) - np.repeat(np.cumsum(found) - found, found)
    at = index.order[np.repeat(low, found) + offsets]  # place in the sequence
    # A document's words start after one mark per document before it.
    begins = words.bounds[:-1] + np.arange(len(counts))
    row = np.searchsorted(begins, at, "right") - 1
    word = at - row
    if len(word):
        # Hashes brought us here; the bytes decide.
        folded = LOWER[chunk.data]
        spots = np.unique(np.concatenate([
            word[block.lengths[which] > k] + k for k in range(window)
        ]))
        wrong = [
            s for s in spots
            if block.word_bytes.get(int(words.hashes[s]))
            != folded[words.starts[s]:words.ends[s]].tobytes()
        ]
        if wrong:
            bad = np.zeros(len(words.hashes) + 1, dtype=np.int64)
            bad[np.array(wrong) + 1] = 1
            bad = np.cumsum(bad)
            keep = bad[word + block.lengths[which]] == bad[word]
            which, row, word = which[keep], row[keep], word[keep]
    by_row = np.argsort(row, kind="stable")
    which, row, word = which[by_row], row[by_row], word[by_row]
    edges = np.searchsorted(row, np.arange(len(counts) + 1))
    # The words of the shard between marks, as the items have them.
    marked = np.zeros(len(words.hashes) + len(counts) + 1, dtype=np.uint64)
    marked[np.arange(len(words.hashes)) + words.rows() + 1] = words.hashes
    runs = block.longest(marked, which, word + row + 1)
    for r in range(len(counts)):
        a, b = edges[r], edges[r + 1]
        if a == b:
            yield int(counts[r]), [], [], 0
            continue
        first = word[a:b] - words.bounds[r]
        size = block.lengths[which[a:b]]
        items = {int(i) for w in np.unique(which[a:b]) for i in block.items_of[w]}
        spans = _united(sorted(zip(first.tolist(), (first + size).tolist())))
        ids = sorted({block.item_ids[i] for i in items})
        yield int(counts[r]), spans, ids, int(runs[a:b].max())


def _united(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for start, stop in spans:
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], stop)
        else:
            out.append([start, stop])
    return [tuple(s) for s in out]


def _blocks(benchmark: DataFrame, block_bytes: int) -> list[DataFrame]:
    items = benchmark.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    total = items.agg(F.sum(F.octet_length("text")).alias("b")).first()["b"] or 0
    n = max(1, -(-total // block_bytes))
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    return [items.where(part == k) if n > 1 else items for k in range(n)]


def find_matches(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """HITS columns, one row per row of ``docs``.

    ``spans`` are the hit words [start, stop), ``items`` the ids (as text) of
    items with a window in the document, ``longest`` the words of the longest
    verbatim match with any item (0 below a window).  An item shorter than the window is one window;
    NULL texts have no words; a NULL item id reads as ''.  Repeated rows are
    answered each.  Columns other than doc_id, item_id and text are not read.
    """
    spark: SparkSession = docs.sparkSession
    given = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")
    )
    passes = []
    for items in _blocks(benchmark, block_bytes):
        rows = items.collect()  # bounded by block_bytes
        block = spark.sparkContext.broadcast(
            Suffixes.of([r["item_id"] for r in rows], [r["text"] for r in rows], window)
        )

        def search(batches, block=block):
            for batch in batches:
                texts = batch.column(1)
                for chunk in chunks(texts, SHARD_BYTES):
                    keys, n_words, spans, ids, longest = [], [], [], [], []
                    raw = chunk.data.tobytes()
                    for k, (n, hit, own, run) in enumerate(_search(chunk, block.value, window)):
                        keys.append(hashlib.md5(raw[chunk.bounds[k]:chunk.bounds[k + 1]]).digest())
                        n_words.append(n)
                        spans.append([{"start": a, "stop": b} for a, b in hit])
                        ids.append(own)
                        longest.append(run)
                    columns = [keys, n_words, spans, ids, longest]
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).slice(chunk.first, chunk.n)]
                        + [pa.array(c, f.type) for c, f in zip(columns, list(_HITS_ARROW)[1:])],
                        schema=_HITS_ARROW,
                    )

        passes.append(given.mapInArrow(search, HITS))
    if len(passes) == 1:
        return passes[0]
    every = passes[0]
    for other in passes[1:]:
        every = every.unionByName(other)
    joined = every.groupBy("doc_id", "text_key", "n_words").agg(
        (F.count("*") / len(passes)).cast("int").alias("copies"),
        F.flatten(F.collect_list("spans")).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        F.max("longest").alias("longest"),
    )

    def unite(batches):
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                spans = _united(sorted((x["start"], x["stop"]) for x in r["spans"]))
                r["spans"] = [{"start": x, "stop": y} for x, y in spans]
                rows += [r] * r.pop("copies")
            yield pa.RecordBatch.from_pylist(rows, schema=_HITS_ARROW)

    return joined.mapInArrow(unite, HITS)


def hit_words(spans: str = "spans"):
    """Number of words inside any span."""
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Rows of ``docs`` without any benchmark window.

    Rows are told apart by doc_id and text, so a repeated doc_id is safe; a
    NULL doc_id is compared as a value.
    """
    dirty = find_matches(docs, benchmark, window).where("size(spans) > 0").select(
        F.col("doc_id").alias("_hit"), F.hex("text_key").alias("_key")
    ).distinct()
    key = F.upper(F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")))
    return docs.join(
        dirty, docs["doc_id"].cast("long").eqNullSafe(dirty["_hit"]) & (key == dirty["_key"]), "left_anti"
    )
