"""Line dedup: documents probe a sharded perfect-hash index of repeated lines.

A line's key is its text without blanks at both ends, A-Z lower-cased; only its
128-bit hash travels.  Hashes found in ``min_docs`` documents are indexed in
shards: a minimal perfect hash numbers them, and the numbers lead into arrays
of 64-bit fingerprints, document counts and keepers (the largest doc_id).

Line references are dealt to the shards, and each task reads a shard's arrays
once and then streams the references past them.  A shard with many references
(a line that a third of all documents hold) is copied to several tasks.  Lines
are never joined with lines, and texts move once, with the list of their
dropped lines.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from replyforge.llm.perfect_hash import PerfectHash
from replyforge.llm.words import mix
from replyforge.sources.stages import cut

MIN_CHARS = 20
MIN_DOCS = 3
SHARD_KEYS = 16_000
SHARD_REFS = 64_000  # references streamed past one copy of a shard

# Fixed value: the blanks that do not count at the ends of a line.
BLANKS = b" \t\n\x0b\x0c\r"
NO_ID = -(1 << 63)  # stands for a NULL doc_id, below all others

_REFS = "id long, text_key long, line int, high long, low long, first boolean"


def _line_refs(docs: DataFrame, min_chars: int) -> DataFrame:
    """One row per line long enough; ``first`` on a key's first line in its document."""

    def read(batches):
        for batch in batches:
            ids, keys, texts = (c for c in batch.columns)
            texts = texts.cast(pa.binary())
            id_at, line_at, digests, firsts = [], [], [], []
            for row, raw in enumerate(texts.to_pylist()):
                seen = set()
                for k, line in enumerate(raw.split(b"\n")):
                    if len(line) < min_chars:
                        continue
                    key = line.strip(BLANKS).lower()
                    if len(key) < min_chars or (
                        not key.isascii() and len(key.decode()) < min_chars
                    ):
                        continue
                    digest = xxhash.xxh3_128_digest(key)
                    id_at.append(row)
                    line_at.append(k)
                    digests.append(digest)
                    firsts.append(digest not in seen)
                    seen.add(digest)
            both = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            rows = pa.array(id_at, pa.int64())
            yield pa.RecordBatch.from_pydict({
                "id": ids.take(rows), "text_key": keys.take(rows),
                "line": pa.array(line_at, pa.int32()),
                "high": pa.array(np.ascontiguousarray(both[:, 0])),
                "low": pa.array(np.ascontiguousarray(both[:, 1])),
                "first": pa.array(firsts, pa.bool_()),
            })

    return docs.mapInArrow(read, _REFS)


def _shard_of(n: int):
    """Shard by the upper hash, which spreads keys evenly."""
    return F.pmod(F.xxhash64("high"), F.lit(n)).cast("int")


_INDEX = "shard int, sizes binary, bits binary, prints binary, counts binary, keepers binary"


def build_index(frequent: DataFrame, shards: int) -> DataFrame:
    """Index rows of (high, low, n, keeper): one per shard, about SHARD_KEYS keys each."""

    def build(key, table):
        high, low = (table[c].to_numpy().view(np.uint64) for c in ("high", "low"))
        hashed = PerfectHash.build(high, low)
        at = hashed.find(high, low)
        prints = np.zeros(len(at), dtype=np.uint64)
        counts = np.zeros(len(at), dtype=np.uint32)
        keepers = np.zeros(len(at), dtype=np.int64)
        prints[at] = mix(low)
        counts[at] = np.minimum(table["n"].to_numpy(), 0xFFFFFFFF)
        keepers[at] = table["keeper"].to_numpy()
        sizes, bits = hashed.dump()
        return pa.table({
            "shard": pa.array([key[0].as_py()], pa.int32()), "sizes": [sizes], "bits": [bits],
            "prints": [prints.tobytes()], "counts": [counts.tobytes()],
            "keepers": [keepers.tobytes()],
        })

    return (
        frequent.withColumn("shard", _shard_of(shards)).groupBy("shard").applyInArrow(build, _INDEX)
    )


def _probe(refs: DataFrame, index: DataFrame, shards: int, min_docs: int) -> DataFrame:
    """(id, text_key, line) of the lines to drop."""
    placed = refs.withColumn("shard", _shard_of(shards))
    copies = placed.groupBy("shard").agg(
        F.ceil(F.count("*") / SHARD_REFS).cast("int").alias("copies")
    )
    copies = cut(copies, "shard-copies")  # one row per shard
    dealt = placed.join(F.broadcast(copies), "shard").withColumn(
        "copy", F.pmod(F.xxhash64("id", "text_key", "line"), F.col("copies")).cast("int")
    )
    arrays = [f.name for f in T._parse_datatype_string(_INDEX).fields if f.name != "shard"]
    ours = index.join(F.broadcast(copies), "shard").select(
        "shard", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"),
        F.lit(0).alias("kind"), *arrays,
        *[F.lit(None).cast(t).alias(n) for n, t in
          (("id", "long"), ("text_key", "long"), ("line", "int"), ("high", "long"), ("low", "long"))],
    )
    theirs = dealt.select(
        "shard", "copy", F.lit(1).alias("kind"),
        *[F.lit(None).cast("binary").alias(a) for a in arrays],
        "id", "text_key", "line", "high", "low",
    )
    mixed = ours.unionByName(theirs).repartition("shard", "copy").sortWithinPartitions(
        "shard", "copy", "kind"
    )

    def stream(batches):
        current, loaded = None, None
        for batch in batches:
            shard = batch["shard"].to_numpy()
            copy = batch["copy"].to_numpy()
            kind = batch["kind"].to_numpy()
            change = (shard[1:] != shard[:-1]) | (copy[1:] != copy[:-1]) | (kind[1:] != kind[:-1])
            edges = [0, *(np.flatnonzero(change) + 1).tolist(), len(shard)] if len(shard) else [0]
            for a, b in zip(edges[:-1], edges[1:]):
                run = batch.slice(a, b - a)
                place = (shard[a], copy[a])
                if kind[a] == 0:
                    one = {n: run[n][0].as_py() for n in arrays}
                    loaded = (
                        PerfectHash.load(one["sizes"], one["bits"]),
                        np.frombuffer(one["prints"], np.uint64),
                        np.frombuffer(one["counts"], np.uint32),
                        np.frombuffer(one["keepers"], np.int64),
                    )
                    current = place
                    continue
                if place != current:
                    continue  # no indexed line in this shard
                hashed, prints, counts, keepers = loaded
                high = run["high"].to_numpy().view(np.uint64)
                low = run["low"].to_numpy().view(np.uint64)
                at = hashed.find(high, low)
                at[at >= 0] = np.where(prints[at[at >= 0]] == mix(low[at >= 0]), at[at >= 0], -1)
                known = at >= 0
                drop = known.copy()
                drop[known] = (counts[at[known]] >= min_docs) & (
                    keepers[at[known]] != run["id"].to_numpy()[known]
                )
                yield run.select(["id", "text_key", "line"]).filter(pa.array(drop))

    return mixed.mapInArrow(stream, "id long, text_key long, line int")


def dropped_lines(
    docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS
) -> DataFrame:
    """(id, text_key, lines): numbers of the lines each document loses."""
    given = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"),
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    refs = cut(_line_refs(given, min_chars), "line-refs")
    frequent = cut(
        refs.where("first").groupBy("high", "low")
        .agg(F.count("*").alias("n"), F.max("id").alias("keeper")).where(F.col("n") >= min_docs),
        "repeated-lines",
    )
    shards = max(1, -(-frequent.count() // SHARD_KEYS))
    index = cut(build_index(frequent, shards), "line-index")
    hits = _probe(refs.drop("first"), index, shards, min_docs)
    return hits.groupBy("id", "text_key").agg(F.collect_set("line").alias("lines"))


def drop_repeated_lines(
    docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS
) -> DataFrame:
    """``docs`` with shortened texts, and n_lines, n_dropped.

    A key of ``min_chars`` code points or more in ``min_docs`` documents or more
    stays only in the document of the largest doc_id that holds it (in all its
    lines there).  Every row is a document of its own: repeated rows count and
    are answered each, and share the keeper's fate if they share its doc_id.  A
    NULL doc_id is smaller than all others.  NULL and empty texts are one empty
    line and come back as empty text.  Columns named n_lines or n_dropped are
    replaced; all others pass.
    """
    lost = dropped_lines(docs, min_chars, min_docs).select(
        F.col("id").alias("_lost_id"), F.col("text_key").alias("_lost_key"),
        F.col("lines").alias("_lost_lines"),
    )
    kept = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    whole = docs.select(*kept).withColumn("text", F.coalesce("text", F.lit("")))
    joined = whole.join(
        lost,
        (F.coalesce(whole["doc_id"].cast("long"), F.lit(NO_ID)) == lost["_lost_id"])
        & (F.xxhash64(whole["text"]) == lost["_lost_key"]),
        "left",
    ).select(*kept, "_lost_lines")
    schema = T.StructType([
        *whole.schema.fields, T.StructField("n_lines", T.LongType()),
        T.StructField("n_dropped", T.LongType()),
    ])
    place = kept.index("text")

    def shorten(batches):
        for batch in batches:
            texts = batch.column(place)
            lines = [t.count("\n") + 1 for t in texts.to_pylist()]
            lost_lines = batch.column(len(kept)).to_pylist()
            if any(lost_lines):
                new = []
                for text, lost_here in zip(texts.to_pylist(), lost_lines):
                    if lost_here:
                        out = set(lost_here)
                        text = "\n".join(
                            x for k, x in enumerate(text.split("\n")) if k not in out
                        )
                    new.append(text)
                texts = pa.array(new, texts.type)
            columns = [batch.column(k) for k in range(len(kept))]
            columns[place] = texts
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(lines, pa.int64()),
                 pa.array([len(x or ()) for x in lost_lines], pa.int64())],
                names=[*kept, "n_lines", "n_dropped"],
            )

    return joined.mapInArrow(shorten, schema)
