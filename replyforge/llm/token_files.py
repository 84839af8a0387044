"""Token ids in binary files: whole documents, coded in independent segments.

The files are a Parquet container in the shared folder.  One row is a segment
of whole documents with about SEGMENT_IDS ids: which file and place it has,
the documents' ids and token counts, and the segment's blocks (ids, bytes and
crc32 of each, payloads one after the other) as coded by ``range_coder``, with
one model for the blocks of a segment, none for other segments.  File
k holds the documents before those of file k + 1, in ascending doc_id order;
``read_token_files`` needs nothing but the files.

Texts are cut at single blanks and line feeds, which the word tokenizer drops
and no token crosses; each distinct cut is encoded once while a worker keeps it.
A tokenizer file with the usual rules (``_RULES``) lets texts be cut between letters
and other ASCII characters too, its ASCII letters be lower-cased before, and
cuts of lower-case letters alone go to its model at once.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from replyforge.llm.bpe import bounded, byte_alphabet, ragged
from replyforge.llm.range_coder import BLOCK, decode_blocks, encode_blocks
from replyforge.sources.stages import stage_path

SEGMENT_IDS = 1 << 17
LANES = 8192  # blocks coded in step
TOGETHER = 256  # segments read in step, at most; each has a model
CHUNK = 1 << 22  # characters encoded at once, about
SCAN = 1 << 18  # characters cut at once: what a processor's cache holds
KEEP_WORDS = 500_000  # in a worker's table; beyond, those that came up again are kept
NO_ID = -(1 << 63)

SEGMENT = ("part int, seq int, n_ids long, doc_ids binary, doc_tokens binary, "
           "block_ids binary, block_bytes binary, block_crcs binary, payload binary")


# Rules under which a match ends between a letter and another ASCII
# character, and between one but the apostrophe and a letter.
_RULES = (
    {"type": "Sequence", "normalizers": [
        {"type": "NFC"},
        {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "},
        {"type": "Lowercase"},
    ]},
    {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {
            "Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
        }, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ]},
)
# Lower-case letters that NFC and lower-casing leave alone: Latin 1, Greek, Cyrillic.
_LETTERS = re.compile("[a-zß-öø-ÿα-ωа-џ]+")
def _pieces(texts: list[str], fine: bool) -> tuple[pa.Array, np.ndarray]:
    """(cuts of all texts without blanks and empty ones, how many end before each text and the end)."""
    array = pa.array(texts, pa.large_string())
    offsets = np.frombuffer(array.buffers()[1], np.int64)[: len(texts) + 1]
    data = np.frombuffer(array.buffers()[2] or b"", np.uint8)[: offsets[-1]]
    full = (data != ord(" ")) & (data != ord("\n"))
    cut = np.zeros(len(data) + 1, dtype=bool)  # before each byte
    cut[offsets] = True
    cut[1:-1] |= ~full[:-1]
    if fine and len(data):
        letter = ((data | 32) - ord("a")) < 26  # bytes wrap around
        sign = (data < 128) & ~letter & full
        cut[1:-1] |= letter[:-1] & sign[1:]
        cut[1:-1] |= (sign & (data != ord("'")))[:-1] & letter[1:]
        # Two-byte letters (Latin, Cyrillic): all but the signs of multiplication and
        # division, and the dotted I, whose small form ends in a mark.
        lead = ((data - 0xC3) < 3) | ((data - 0xD0) < 2)
        wide = np.flatnonzero(lead[:-2] & sign[2:])
        pair = data[wide].astype(np.int32) << 8 | data[wide + 1]
        cut[wide[(pair != 0xC397) & (pair != 0xC3B7) & (pair != 0xC4B0)] + 2] = True
        # A mark may follow a letter before any but ASCII: such a letter is left as it is.
        upper = (data - ord("A")) < 26
        upper[:-1] &= data[1:] < 128
        data = data + (upper.view(np.uint8) << 5)
    begins = np.flatnonzero(cut[:-1] & full)
    cut[:-1] |= ~full
    ends = np.flatnonzero(cut[1:] & full) + 1
    bounds = np.concatenate([[0], np.cumsum(ends - begins)])
    pieces = pa.LargeStringArray.from_buffers(
        len(begins), pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data[full]))
    )
    return pieces, np.searchsorted(begins, offsets)


class WordEncoder:
    """The tokenizers library on distinct cuts of texts."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task has one core
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.model = self.library.model
        # Known cuts with their ids end to end, and which came up again since the last cleaning.
        self.words = pa.array([], pa.large_string())
        self.ids, self.lengths = np.zeros(0, np.int32), np.zeros(0, np.int64)
        self.late = np.zeros(0, dtype=bool)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        # Added tokens are found in whole texts: chunks that hold one are cut at blanks.
        self.added = [t["content"] for t in spec.get("added_tokens") or ()]
        self.fine = (
            (spec.get("normalizer"), spec.get("pre_tokenizer")) == _RULES
            and not spec.get("post_processor") and not spec["model"].get("dropout")
            # In other case, or put together from cuts, none may come up.
            and all(re.search("[A-Za-z][!-&(-@[-`{-~]", a) for a in self.added)
            and not any(
                t.get(f) for t in spec.get("added_tokens") or ()
                for f in ("normalized", "lstrip", "rstrip", "single_word")
            )
        )
        # Character of each byte in the vocabulary.
        self.bytes = {b: c for c, b in byte_alphabet().items()}

    def _encode(self, words: list[str]) -> list[list[int]]:
        """Ids of each word."""
        plain = [bool(self.fine and _LETTERS.fullmatch(w)) for w in words]
        rest = [w for w, p in zip(words, plain) if not p]
        others = iter(self.library.encode_batch(rest, add_special_tokens=False))
        tokenize, signs = self.model.tokenize, self.bytes
        return [
            [t.id for t in tokenize(
                w if w.isascii() else w.encode().decode("latin-1").translate(signs)
            )] if p else next(others).ids
            for w, p in zip(words, plain)
        ]

    def _ids_of(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all these words, ids per word)."""
        lengths = self.lengths[numbers]
        starts = np.cumsum(self.lengths) - self.lengths
        return self.ids[ragged(starts[numbers], lengths)], lengths

    def _clean(self) -> None:
        kept = np.flatnonzero(self.late)[-(KEEP_WORDS // 2):]
        self.ids, self.lengths = self._ids_of(kept)
        self.words = self.words.take(pa.array(kept))
        self.late = np.zeros(len(kept), dtype=bool)

    def _numbers(self, pieces: pa.Array) -> np.ndarray:
        """Place of each piece in the table; new ones are added."""
        if len(self.words) > KEEP_WORDS:
            self._clean()
        found = pc.index_in(pieces, value_set=self.words)
        numbers = found.fill_null(-1).to_numpy().astype(np.int64)
        missing = np.flatnonzero(numbers < 0)
        self.late[numbers[numbers >= 0]] = True
        new = pieces.take(pa.array(missing)).dictionary_encode()
        numbers[missing] = len(self.words) + new.indices.to_numpy().astype(np.int64)
        ids = self._encode(new.dictionary.to_numpy(zero_copy_only=False).tolist())
        self.words = pa.concat_arrays([self.words, new.dictionary])
        self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(ids), np.int32)])
        self.lengths = np.concatenate([self.lengths, np.fromiter(map(len, ids), np.int64)])
        self.late = np.concatenate([self.late, np.zeros(len(ids), dtype=bool)])
        return numbers

    def encode(self, texts: list[str], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each followed by ``end_id``; ids per text)."""
        fine = self.fine and not any(a in t for a in self.added for t in texts)
        parts, ends, n = [], [0], 0
        for a, b in bounded(texts, SCAN):
            pieces, at = _pieces(texts[a:b], fine)
            parts.append(pieces)
            ends += (at[1:] + n).tolist()
            n += len(pieces)
        numbers = self._numbers(pa.concat_arrays(parts))
        ids, sizes = self._ids_of(numbers)
        ends = np.concatenate([[0], np.cumsum(sizes)])[ends]
        return np.insert(ids, ends[1:], end_id), np.diff(ends) + 1


@lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def _segments(part: int, seq: int, ids: list, counts: list, runs: list) -> pa.RecordBatch:
    """Rows of finished segments; each is (doc ids, token counts, token ids)."""
    sizes, owner = [], []
    for k, run in enumerate(runs):
        n = len(run)
        sizes += [BLOCK] * (n // BLOCK) + ([n % BLOCK] if n % BLOCK else [])
        owner += [k] * (-(-n // BLOCK))
    sizes_array = np.array(sizes, dtype=np.int64)
    owner = np.array(owner)
    payloads, sums = encode_blocks(np.concatenate(runs), sizes_array, owner)
    columns: dict[str, list] = {n.split()[0]: [] for n in SEGMENT.split(", ")}
    for k, run in enumerate(runs):
        mine = np.flatnonzero(owner == k)
        own = [payloads[b] for b in mine]
        for name, value in (
            ("part", part), ("seq", seq + k), ("n_ids", len(run)),
            ("doc_ids", np.array(ids[k], dtype="<i8").tobytes()),
            ("doc_tokens", np.array(counts[k], dtype="<i8").tobytes()),
            ("block_ids", sizes_array[mine].astype("<i4").tobytes()),
            ("block_bytes", np.array([len(p) for p in own], dtype="<i8").tobytes()),
            ("block_crcs", sums[mine].astype("<u4").tobytes()),
            ("payload", b"".join(own)),
        ):
            columns[name].append(value)
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    return pa.RecordBatch.from_pydict({
        n.split()[0]: pa.array(columns[n.split()[0]], kinds[n.split()[1]])
        for n in SEGMENT.split(", ")
    })


def write_token_files(docs: DataFrame, path: str, end_id: int, folder: str | None = None) -> str:
    """Encodes every whole text and writes the files; returns their folder.

    Every document gets ``end_id`` at its end, so NULL and empty texts have one
    id.  Rows of one doc_id follow each other by text; NULL ids come first.
    Only doc_id and text are read.  Token ids have 16 bits: a vocabulary with
    larger ones is refused when one comes up.
    """
    folder = folder or stage_path(docs.sparkSession, "token-files")
    given = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    # Rows of one id, as of none, are parted by the beginnings of their texts.
    ordered = given.repartitionByRange("id", F.substring("text", 1, 32)).sortWithinPartitions(
        "id", "text"
    )

    def encode(batches):
        encoder, part, seq = word_encoder(path), TaskContext.get().partitionId(), 0
        done: list[tuple] = []
        ids: list[int] = []
        counts: list[int] = []
        runs: list[np.ndarray] = []

        def close() -> None:
            done.append((list(ids), list(counts), np.concatenate(runs)))
            ids.clear(), counts.clear(), runs.clear()

        for batch in batches:
            texts, keys = batch.column(1).to_pylist(), batch.column(0).to_pylist()
            for start, stop in bounded(texts, CHUNK):
                found, sizes = encoder.encode(texts[start:stop], end_id)
                ends = np.concatenate([[0], np.cumsum(sizes)])
                a, n = 0, len(sizes)
                while a < n:
                    # Documents up to the one with which the segment is full.
                    room = SEGMENT_IDS - sum(map(len, runs))
                    b = min(int(np.searchsorted(ends, ends[a] + room)), n)
                    ids += keys[start + a:start + b]
                    counts += sizes[a:b].tolist()
                    runs.append(found[ends[a]:ends[b]])
                    if ends[b] - ends[a] >= room:
                        close()
                    a = b
                if sum(-(-len(d[2]) // BLOCK) for d in done) >= LANES:
                    yield _segments(part, seq, *zip(*done))
                    seq += len(done)
                    done = []
        if runs:
            close()
        if done:
            yield _segments(part, seq, *zip(*done))

    ordered.mapInArrow(encode, SEGMENT).write.parquet(folder)
    return folder


_DOCUMENTS = "part int, seq int, place int, id long, before long, n_tokens long, ids_crc32 long"


def read_token_files(spark, folder: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) out of the files.

    ``start`` counts all ids of the documents before.  A block whose ids do not
    have its checksum stops the read.
    """
    files = spark.read.parquet(folder)
    # Ids before each file: one number per file reaches the driver.
    sizes = files.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect()
    total, offsets = 0, []
    for r in sizes:
        offsets.append((r["part"], total))
        total += r["n"]
    shift = spark.createDataFrame(offsets, "part int, shift long")
    # Ids before each segment of its file: small rows, one window per file.
    names = [n.split()[0] for n in SEGMENT.split(", ")]

    def decode(batches):
        for batch in batches:
            rows, blocks, held = [], 0, batch.to_pylist()
            for k, row in enumerate(held):
                rows.append(row)
                blocks += len(row["block_ids"]) // 4
                if blocks >= LANES or len(rows) >= TOGETHER or k == len(held) - 1:
                    yield _documents(rows, with_ids)
                    rows, blocks = [], 0

    schema = _DOCUMENTS + (", ids array<int>" if with_ids else "")
    documents = files.select(*names).mapInArrow(decode, schema)
    so_far = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    begins = files.select(
        "part", "seq", F.coalesce(F.sum("n_ids").over(so_far), F.lit(0)).alias("begin")
    ).join(F.broadcast(shift), "part").select(
        "part", "seq", (F.col("begin") + F.col("shift")).alias("begin")
    )
    return documents.join(begins, ["part", "seq"]).select(
        F.when(F.col("id") != NO_ID, F.col("id")).alias("doc_id"),
        (F.col("begin") + F.col("before")).alias("start"), "n_tokens", "ids_crc32",
        *(["ids"] if with_ids else []),
    )


def _documents(rows: list[dict], with_ids: bool) -> pa.RecordBatch:
    payloads, sizes, sums = [], [], []
    for row in rows:
        at = 0
        for n in np.frombuffer(row["block_bytes"], "<i8").tolist():
            payloads.append(row["payload"][at:at + n])
            at += n
        sizes.append(np.frombuffer(row["block_ids"], "<i4").astype(np.int64))
        sums.append(np.frombuffer(row["block_crcs"], "<u4").astype(np.int64))
    owner = np.repeat(np.arange(len(rows)), [len(n) for n in sizes])
    ids = decode_blocks(payloads, np.concatenate(sizes), np.concatenate(sums), owner)
    out: dict[str, list] = {n.split()[0]: [] for n in _DOCUMENTS.split(", ")}
    runs = []
    at = 0
    for row in rows:
        doc_ids = np.frombuffer(row["doc_ids"], "<i8")
        counts = np.frombuffer(row["doc_tokens"], "<i8")
        before = np.cumsum(counts) - counts
        wide = ids[at:at + row["n_ids"]].astype("<u4")
        out["part"] += [row["part"]] * len(counts)
        out["seq"] += [row["seq"]] * len(counts)
        out["place"] += range(len(counts))
        out["id"] += doc_ids.tolist()
        out["before"] += before.tolist()
        out["n_tokens"] += counts.tolist()
        out["ids_crc32"] += [
            zlib.crc32(wide[a:a + n].tobytes()) for a, n in zip(before.tolist(), counts.tolist())
        ]
        if with_ids:
            runs += [wide[a:a + n].astype(np.int32) for a, n in zip(before, counts)]
        at += row["n_ids"]
    kinds = {"int": pa.int32(), "long": pa.int64()}
    columns = {
        n.split()[0]: pa.array(out[n.split()[0]], kinds[n.split()[1]])
        for n in _DOCUMENTS.split(", ")
    }
    if with_ids:
        columns["ids"] = pa.array(runs, pa.list_(pa.int32()))
    return pa.RecordBatch.from_pydict(columns)
