"""Document fingerprints: one-permutation MinHash with packed low-order bits.

Each five-word shingle is hashed once; the upper bits name one of BINS bins and
a bin keeps the smallest rest.  An empty bin takes the value of the first
filled bin in its own fixed random order of bins (optimal densification), the
lowest BITS bits of every bin are packed, and two fingerprints are compared by
the share of equal bins, corrected for bins that agree by chance.

``fingerprint_next`` also needs each document's successor in id order.  Rows
are dealt into id ranges, each range is sorted and streamed, and the first
document of a range is sent to the range before as well, so no range needs
another's rows.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from replyforge.llm.words import chunks, find_words, mix, salt, shingles

BINS = 512
BITS = 4
ROWS = 256  # texts fingerprinted together
PIECE_CHARS = 1 << 20
NO_ID = -(1 << 63)
_FEW = 16  # filled bins up to which donors are looked up by rank


@lru_cache(maxsize=2)
def _donor_orders(bins: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, rank): bin i asks order[i, 0], order[i, 1], ...; rank is the inverse."""
    keys = mix(np.arange(bins * bins, dtype=np.uint64) * salt(41) + salt(42)).reshape(bins, bins)
    order = np.argsort(keys, axis=1, kind="stable").astype(np.int32)
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.broadcast_to(np.arange(bins, dtype=np.int32), order.shape), 1)
    return order, rank


def _densify(values: np.ndarray, filled: np.ndarray) -> None:
    """Fills empty bins in place; every row has at least one filled bin."""
    bins = values.shape[1]
    order, rank = _donor_orders(bins)
    counts = filled.sum(axis=1)
    for row in np.flatnonzero(counts <= _FEW):
        own = np.flatnonzero(filled[row])
        donor = own[rank[:, own].argmin(axis=1)]
        values[row] = np.where(filled[row], values[row], values[row][donor])
    rows, places = np.nonzero(~filled & (counts > _FEW)[:, None])
    source = values.copy()
    step = 0
    while len(rows):
        donor = order[places, step]
        found = filled[rows, donor]
        values[rows[found], places[found]] = source[rows[found], donor[found]]
        rows, places = rows[~found], places[~found]
        step += 1


def low_bits(texts: pa.Array, bins: int = BINS, bits: int = BITS) -> np.ndarray:
    """One row of ``bins`` numbers below 2**bits for each text."""
    out = np.zeros((len(texts), bins), dtype=np.uint8)
    shift = np.uint64(64 - int(bins).bit_length() + 1)
    for chunk in chunks(texts):
        hashes, bounds = shingles(chunk, find_words(chunk))
        place = (hashes >> shift).astype(np.int64)
        rest = hashes & ((np.uint64(1) << shift) - np.uint64(1))
        for start in range(0, chunk.n, ROWS):
            stop = min(start + ROWS, chunk.n)
            a, b = bounds[start], bounds[stop]
            row = np.repeat(np.arange(stop - start), np.diff(bounds[start:stop + 1]))
            values = np.full((stop - start) * bins, np.uint64(2**64 - 1))
            np.minimum.at(values, row * bins + place[a:b], rest[a:b])
            values = values.reshape(stop - start, bins)
            _densify(values, values != np.uint64(2**64 - 1))
            # Mixed with the bin: copies of one donor must not agree by chance together.
            values = mix(values + np.arange(bins, dtype=np.uint64) * salt(43))
            out[chunk.first + start:chunk.first + stop] = values & np.uint64((1 << bits) - 1)
    return out


def packed(values: np.ndarray, bits: int = BITS) -> list[str]:
    """Base64 of the low-order bits of each row."""
    as_bits = np.unpackbits(values[:, :, None], axis=2, bitorder="little", count=bits)
    rows = np.packbits(as_bits.reshape(len(values), -1), axis=1)
    return [base64.b64encode(r.tobytes()).decode() for r in rows]


def unpacked(fingerprint: str, bins: int = BINS, bits: int = BITS) -> np.ndarray:
    raw = np.frombuffer(base64.b64decode(fingerprint), dtype=np.uint8)
    as_bits = np.unpackbits(raw)[: bins * bits].reshape(bins, bits)
    return np.packbits(as_bits, axis=1, bitorder="little")[:, 0]


def likeness(a: np.ndarray, b: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Estimated Jaccard similarity of rows: matching bins less those by chance."""
    chance = 1.0 / (1 << bits)
    return np.clip(((a == b).mean(axis=-1) - chance) / (1 - chance), 0.0, 1.0)


def fingerprint_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint): equal texts have equal fingerprints.

    A text of fewer than five words has one shingle, a text without words one
    of its bytes; NULL reads as empty.  Rows stay one to one.
    """

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column(0), "fingerprint": packed(low_bits(batch.column(1)))
            })

    given = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")
    )
    return given.mapInArrow(run, "doc_id long, fingerprint string")


RANGE_BYTES = 1 << 20  # of text in a range, about
SORTED = 256  # partitions in which places are sorted to find the limits
MOST_RANGES = 100_000  # limits that the driver holds; beyond 100 GB ranges grow


def _place(text: str = "text") -> Column:
    """A string that sorts as (id, first eight bytes of the text)."""
    number = F.lpad(F.hex(F.col("id").bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")
    return F.concat(number, F.hex(F.substring(F.col(text).cast("binary"), 1, 8)))


def _ranges(given: DataFrame, n_ranges: int | None) -> tuple[np.ndarray, dict[int, str]]:
    """Upper limits of the ranges, and the smallest place of each range with rows.

    Ranges hold about as many rows each; rows of one id, as of none, are parted
    by their texts, so they can lie in many ranges.
    """
    total = given.agg(F.sum(F.octet_length("text")).alias("bytes"), F.count("*").alias("n")).first()
    if n_ranges is None:
        n_ranges = min(MOST_RANGES, 1 + (total["bytes"] or 0) // RANGE_BYTES)
    step = max(1, total["n"] // n_ranges)
    places = given.select(_place().alias("place"))

    def every_step(batches):
        """Each step-th place of a sorted partition, and its last one."""
        seen, last = 0, None
        for batch in batches:
            if not len(batch):
                continue
            at = np.arange((step - 1 - seen) % step, len(batch), step)
            seen += len(batch)
            last = batch.slice(len(batch) - 1, 1)
            yield batch.take(pa.array(at))
        if last is not None:
            yield last

    # A few partitions for the order, whose bounds Spark samples; limits within them.
    tops = places.repartitionByRange(min(n_ranges, SORTED), "place").sortWithinPartitions("place")
    found = {r["place"] for r in tops.mapInArrow(every_step, "place string").collect()}
    limits = np.array(sorted(found)[:-1], dtype="U32")
    firsts = places.groupBy(_range_of(limits)("place").alias("r")).agg(F.min("place").alias("first"))
    return limits, {r["r"]: r["first"] for r in firsts.collect()}  # one row per range


def _range_of(limits: np.ndarray):
    @F.pandas_udf("long")
    def range_of(places: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(limits, places.to_numpy().astype("U32"), "left"))

    return range_of


_NEXT = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
         "edited_fingerprint string, near_edited double, near_next double")


def fingerprint_next(docs: DataFrame, n_ranges: int | None = None) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness.

    The edited text ends with the beginning of the next document's text (a
    quarter of the code points, or all the next has); the last document's next
    is the first.  Rows of one doc_id follow each other by text; NULL ids come
    first; NULL texts are empty.  One document is its own next.
    """
    spark = docs.sparkSession
    given = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    limits, firsts = _ranges(given, n_ranges)
    filled = sorted(firsts)
    before = {r: filled[k - 1] for k, r in enumerate(filled)}
    range_of = _range_of(limits)
    edges = spark.createDataFrame(
        [(firsts[r], before[r]) for r in filled], "place string, before long"
    )
    # The first row of each range closes the one before it; the first one's, the last.
    closing = (
        given.withColumn("place", _place()).join(F.broadcast(edges), "place")  # a row per range
        .groupBy("before").agg(F.min(F.struct("id", "text", "doc_id")).alias("x"))
        .select(F.col("before").alias("r"), F.lit(1).alias("extra"), "x.doc_id", "x.id", "x.text")
    )
    own = given.select(range_of(_place()).alias("r"), F.lit(0).alias("extra"), "doc_id", "id", "text")
    ordered = own.unionByName(closing).repartition("r").sortWithinPartitions(
        "r", "extra", "id", "text"
    ).select("r", "extra", "doc_id", "text")

    def finish(rows):
        """Result of all rows but the last, which only serves as a next one."""
        texts = pa.array([x[3] for x in rows], pa.string())
        own = low_bits(texts)
        here = [k for k in range(len(rows) - 1) if rows[k][1] == 0 and rows[k + 1][0] == rows[k][0]]
        edited = []
        for k in here:
            text = rows[k][3]
            tail = len(text) // 4
            edited.append(text[: len(text) - tail] + rows[k + 1][3][:tail])
        changed = low_bits(pa.array(edited, pa.string()))
        at = np.array(here, dtype=np.int64)
        names = packed(own)
        return pa.RecordBatch.from_pydict({
            "doc_id": pa.array([rows[k][2] for k in here], pa.int64()),
            "n_chars": pa.array([len(rows[k][3]) for k in here], pa.int64()),
            "edited_sha256": pa.array(
                [hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()
            ),
            "fingerprint": pa.array([names[k] for k in here], pa.string()),
            "edited_fingerprint": pa.array(packed(changed), pa.string()),
            "near_edited": likeness(own[at], changed),
            "near_next": likeness(own[at], own[at + 1]),
        })

    def stream(batches):
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                held.append(row)
                size += len(row[3])
                if size >= PIECE_CHARS and len(held) > 1:
                    yield finish(held)
                    held, size = [row], len(row[3])
        if len(held) > 1:
            yield finish(held)

    return ordered.mapInArrow(stream, _NEXT)
