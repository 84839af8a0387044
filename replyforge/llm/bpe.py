"""Byte-level BPE encoding and decoding with a pair occurrence index.

Texts are cut at blanks between two non-blank characters, where no pre-token
can cross.  The pieces of a batch are numbered by Arrow, each distinct one is
encoded once and kept in a table of bounded size for all tasks of the worker,
and ids, decimals and decoded bytes are gathered for whole batches.
New pre-tokens of a batch are merged together: every adjacent pair is listed
under its merge rank with all its positions, the active ranks are applied in
ascending order to all their positions, and each merge updates the lists of
the pairs it destroys and creates.

The tokenizer file is a parameter and must lie at the same path on every node.
Rules are those of the file: its merges, its byte alphabet, its special tokens
(which are found in texts, as the library does).
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, functions as F

KEEP_BYTES = 40 << 20  # of one generation of a worker's table, about
BATCH_CHARS = 1 << 21

# Fixed value: the pre-token rule of byte-level BPE files with use_regex.
PRE_TOKEN = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
)
_NEAR_BLANKS = re.compile(r"\s | \s|\s\Z")


def byte_alphabet() -> dict[str, int]:
    """Character of the vocabulary file -> byte.

    Printable bytes of Latin-1 stand for themselves, the others for the code
    points from 256 on, in order.
    """
    printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


def _refuse_other_rules(spec: dict, path: str) -> None:
    """Stops at a tokenizer file with rules that are not those of this module."""
    cut = spec.get("pre_tokenizer") or {}
    model = spec["model"]
    reasons = [
        name for name, there in (
            ("a normalizer", spec.get("normalizer")),
            ("another pre-tokenizer", cut.get("type") != "ByteLevel"),
            ("a prefix space", cut.get("add_prefix_space")),
            ("no pre-token rule", not cut.get("use_regex", True)),
            ("dropout", model.get("dropout")),
            ("byte fallback", model.get("byte_fallback")),
            ("merges that are ignored", model.get("ignore_merges")),
            ("added tokens that strip or need whole words", any(
                t.get(f) for t in spec["added_tokens"] for f in ("lstrip", "rstrip", "single_word")
            )),
        ) if there
    ]
    if reasons:
        raise ValueError(f"{path} has {', '.join(reasons)}")


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices starts[0], starts[0]+1, ... of all runs, one after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


class Table:
    """Encoded pieces: ids (and their decimals with a comma after each), end to end."""

    def __init__(self):
        self.entries: dict[str, int] = {}
        self.ids, self.lengths = np.zeros(0, np.int32), np.zeros(0, np.int64)
        self.digits, self.widths = np.zeros(0, np.uint8), np.zeros(0, np.int64)
        self.size = 0  # bytes, about

    def add(
        self, keys: list[str], ids: np.ndarray, lengths: np.ndarray, decimals: Decimals | None = None
    ) -> None:
        """Entries for new keys; ``ids`` holds theirs one after the other."""
        self.entries.update(zip(keys, range(len(self.lengths), len(self.lengths) + len(keys))))
        self.ids = np.concatenate([self.ids, ids.astype(np.int32)])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.size += 180 * len(keys) + 4 * sum(map(len, keys)) + 4 * len(ids)
        if decimals is not None:
            widths = decimals.width[ids]
            edges = np.concatenate([[0], np.cumsum(widths)])
            ends = np.concatenate([[0], np.cumsum(lengths)])
            digits = decimals.flat[ragged(decimals.start[ids], widths)]
            self.digits = np.concatenate([self.digits, digits])
            self.widths = np.concatenate([self.widths, np.diff(edges[ends])])
            self.size += len(digits)

    def ids_of(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all the entries, ids per entry)."""
        lengths = self.lengths[entries]
        starts = np.cumsum(self.lengths) - self.lengths
        return self.ids[ragged(starts[entries], lengths)], lengths


class Decimals:
    """Every id as decimal digits and a comma."""

    def __init__(self, size: int):
        written = [b"%d," % i for i in range(size)]
        self.flat = np.frombuffer(b"".join(written), np.uint8)
        self.width = np.array([len(w) for w in written], np.int64)
        self.start = np.cumsum(self.width) - self.width


class PairIndexBPE:
    """One tokenizer file: encoder, decoder and what a worker has seen so far."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        _refuse_other_rules(spec, path)
        vocabulary = spec["model"]["vocab"]
        alphabet = byte_alphabet()
        self.byte_ids = [0] * 256
        for ch, b in alphabet.items():
            self.byte_ids[b] = vocabulary[ch]
        self.merges: list[tuple[int, int, int]] = []
        self.rank: dict[int, int] = {}
        for r, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            left, right = vocabulary[a], vocabulary[b]
            self.merges.append((left, right, vocabulary[a + b]))
            self.rank[left << 32 | right] = r
        self.byte_symbols = np.array(self.byte_ids)
        self.byte_ranks = np.array([
            [self.rank.get(a << 32 | b, -1) for b in self.byte_ids] for a in self.byte_ids
        ])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_marks = {t[0] for t in self.special}
        longest_first = sorted(self.special, key=len, reverse=True)
        self.special_cut = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")") \
            if self.special else None
        content = {i: bytes(alphabet[c] for c in t) for t, i in vocabulary.items()}
        content |= {i: t.encode() for t, i in self.special.items()}
        size = max(content) + 1
        tokens = [content.get(i, b"") for i in range(size)]
        self.token_length = np.array([len(t) for t in tokens], dtype=np.int64)
        self.token_start = np.cumsum(self.token_length) - self.token_length
        self.token_bytes = np.frombuffer(b"".join(tokens), dtype=np.uint8)
        self.decimals = Decimals(size)
        self.table, self.before = Table(), Table()

    # -- merging -------------------------------------------------------------

    def merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces, ids per piece)."""
        flat = np.frombuffer(b"".join(pieces), dtype=np.uint8)
        bounds = np.concatenate([[0], np.cumsum([len(p) for p in pieces])]).astype(np.int64)
        n = len(flat)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        some = np.diff(bounds) > 0
        after[bounds[1:][some] - 1] = before[bounds[:-1][some]] = -1
        # All places of all byte pairs that merge, listed by rank.
        ranks = np.full(n, -1, dtype=np.int64)
        ranks[:-1] = self.byte_ranks[flat[:-1], flat[1:]]
        ranks[after < 0] = -1
        at = np.flatnonzero(ranks >= 0)
        at = at[np.argsort(ranks[at], kind="stable")]
        found, first_at = np.unique(ranks[at], return_index=True)
        listed = at.tolist()
        edges = [*first_at.tolist(), len(listed)]
        places = {r: listed[x:y] for r, x, y in zip(found.tolist(), edges[:-1], edges[1:])}
        symbols = self.byte_symbols[flat].tolist()
        left, right = before.tolist(), after.tolist()
        bounds = bounds.tolist()
        rank, merges = self.rank, self.merges
        active = list(places)  # in ascending order: a heap
        while active:
            r = heapq.heappop(active)
            todo = places.pop(r)
            first, second, merged = merges[r]
            if first == second:
                todo.sort()  # runs of one symbol pair up from the left
            for done, i in enumerate(todo, 1):
                j = right[i]
                if symbols[i] != first or j < 0 or symbols[j] != second:
                    continue  # an earlier merge took one of the two
                symbols[i], symbols[j] = merged, -1
                after, before = right[j], left[i]
                right[i] = after
                lowest = r
                if after >= 0:
                    left[after] = i
                    new = rank.get(merged << 32 | symbols[after])
                    if new is not None:
                        if new in places:
                            places[new].append(i)
                        else:
                            places[new] = [i]
                            heapq.heappush(active, new)
                        lowest = min(lowest, new)
                if before >= 0:
                    new = rank.get(symbols[before] << 32 | merged)
                    if new is not None:
                        if new in places:
                            places[new].append(before)
                        else:
                            places[new] = [before]
                            heapq.heappush(active, new)
                        lowest = min(lowest, new)
                if lowest < r:  # a lower rank came up: it goes first
                    if rest := todo[done:]:
                        places.setdefault(r, []).extend(rest)
                        heapq.heappush(active, r)
                    break
        merged = np.array(symbols, dtype=np.int64)
        left_over = np.concatenate([[0], np.cumsum(merged >= 0)])
        return merged[merged >= 0], np.diff(left_over[bounds])

    # -- texts ---------------------------------------------------------------

    def _segments(self, text: str) -> list[str]:
        """Pre-tokens and special tokens of a text."""
        if text.isascii() and text[1:].isalpha() and (text[0] == " " or text[0].isalpha()):
            return [text]  # an ASCII word, with or without a blank before it
        if not self.special_marks & set(text) or not self.special_cut.search(text):
            return PRE_TOKEN.findall(text)
        out = []
        for part in self.special_cut.split(text):
            out += [part] if part in self.special else PRE_TOKEN.findall(part)
        return out

    def _numbers(self, keys: list[str]) -> np.ndarray:
        """Entry of each key in the current table; new ones are encoded.

        When the table is full it becomes the one before, whose entries move to
        the new one when they are asked for; what is not asked for is forgotten.
        """
        if self.table.size > KEEP_BYTES:
            self.table, self.before = Table(), self.table
        entries, before = self.table.entries, self.before.entries
        missing = list(dict.fromkeys(k for k in keys if k not in entries))
        known = [k for k in missing if k in before]
        if known:
            self.table.add(known, *self.before.ids_of(np.array([before[k] for k in known])), self.decimals)
        unknown = [k for k in missing if k not in before]
        cut = [self._segments(k) for k in unknown]
        new = sorted({p for parts in cut for p in parts} - entries.keys())
        plain = [p for p in new if p not in self.special]
        self.table.add(plain, *self.merge([p.encode() for p in plain]), self.decimals)
        special = [p for p in new if p in self.special]
        ids = np.array([self.special[p] for p in special], dtype=np.int64)
        self.table.add(special, ids, np.ones(len(ids), np.int64), self.decimals)
        rest = [(k, parts) for k, parts in zip(unknown, cut) if k not in entries]
        flat = np.array([entries[p] for _, parts in rest for p in parts], dtype=np.int64)
        ids, lengths = self.table.ids_of(flat)
        ends = np.concatenate([[0], np.cumsum(lengths)])
        edges = np.concatenate([[0], np.cumsum([len(parts) for _, parts in rest])]).astype(np.int64)
        self.table.add([k for k, _ in rest], ids, np.diff(ends[edges]), self.decimals)
        return np.array([entries[k] for k in keys], dtype=np.int64)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """(ids of all texts, ids per text, decimal ids joined by commas per text)."""
        # Next to other blanks a blank does not always start a pre-token.
        easy = np.array([not _NEAR_BLANKS.search(t) for t in texts], dtype=bool)
        split = pc.split_pattern(pa.array([t for t, e in zip(texts, easy) if e], pa.string()), " ")
        at = split.offsets.to_numpy().astype(np.int64)
        coded = split.flatten().dictionary_encode()
        code, names = coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_pylist()
        led = np.ones(len(code), dtype=bool)
        led[at[:-1]] = False  # a text's first piece has no blank before it
        seen = np.zeros((2, len(names)), dtype=bool)
        seen[led.astype(np.int64), code] = True
        heads, tails = np.flatnonzero(seen[0]), np.flatnonzero(seen[1])
        hard = [self._segments(t) if t else [] for t, e in zip(texts, easy) if not e]
        rest = sorted({p for parts in hard for p in parts})
        keys = [names[c] for c in heads.tolist()] + [" " + names[c] for c in tails.tolist()]
        numbers = self._numbers(keys + rest)
        number = np.zeros((2, len(names)), dtype=np.int64)
        number[0, heads], number[1, tails] = np.split(numbers[:len(keys)], [len(heads)])
        found = dict(zip(rest, numbers[len(keys):].tolist()))
        others = [found[p] for parts in hard for p in parts]
        entries = np.concatenate([number[led.astype(np.int64), code], np.array(others, dtype=np.int64)])
        # Entries of each text: the easy texts come first, in their order.
        sizes = np.zeros(len(texts), dtype=np.int64)
        sizes[easy], sizes[~easy] = np.diff(at), [len(parts) for parts in hard]
        order = np.argsort(~easy, kind="stable")
        starts = np.zeros(len(texts), dtype=np.int64)
        starts[order] = np.cumsum(sizes[order]) - sizes[order]
        entries = entries[ragged(starts, sizes)]
        bounds = np.concatenate([[0], np.cumsum(sizes)])

        def gathered(flat, lengths):
            own = lengths[entries]
            values = flat[ragged((np.cumsum(lengths) - lengths)[entries], own)]
            return values, np.concatenate([[0], np.cumsum(own)])[bounds]

        table = self.table
        ids, ends = gathered(table.ids, table.lengths)
        digits, cuts = gathered(table.digits, table.widths)
        raw = digits.tobytes()  # every id is followed by a comma
        joined = [raw[a:max(a, b - 1)].decode() for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
        return ids.astype(np.int64), np.diff(ends), joined

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """Texts of runs of ids; bytes that are no UTF-8 become replacement marks."""
        return [b.decode("utf-8", "replace") for b in self.decoded_bytes(ids, counts)]

    def decoded_bytes(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """The tokens' bytes of runs of ids, whether they are UTF-8 or not."""
        lengths = self.token_length[ids]
        raw = self.token_bytes[ragged(self.token_start[ids], lengths)].tobytes()
        ends = np.concatenate([[0], np.cumsum(lengths)])[
            np.concatenate([[0], np.cumsum(counts)])
        ]
        return [raw[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]


def _as_text(raw: bytes) -> bytes:
    """UTF-8 of the text that the bytes decode to."""
    try:
        raw.decode()
    except UnicodeDecodeError:
        return raw.decode("utf-8", "replace").encode()
    return raw


@lru_cache(maxsize=4)
def tokenizer(path: str) -> PairIndexBPE:
    return PairIndexBPE(path)


def bounded(texts: list[str], limit: int = BATCH_CHARS) -> Iterator[tuple[int, int]]:
    """(start, stop) of runs of texts with about ``limit`` characters."""
    start = size = 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= limit:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def _encoded(model: PairIndexBPE, batch: pa.RecordBatch, ids: bool) -> Iterator[pa.RecordBatch]:
    texts = batch.column(1).to_pylist()
    for start, stop in bounded(texts):
        found, counts, joined = model.encode(texts[start:stop])
        back = model.decoded_bytes(found, counts)
        columns = {
            "doc_id": batch.column(0).slice(start, stop - start),
            "n_tokens": pa.array(counts),
            "ids_sha256": [hashlib.sha256(j.encode()).hexdigest() for j in joined],
            "decoded_sha256": [hashlib.sha256(_as_text(b)).hexdigest() for b in back],
        }
        if ids:
            ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            columns["ids"] = pa.ListArray.from_arrays(
                pa.array(ends), pa.array(found.astype(np.int32))
            )
        yield pa.RecordBatch.from_pydict(columns)


def encode_documents(docs: DataFrame, path: str, ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256[, ids]) of every whole text.

    NULL texts are read as empty: no ids.  Rows stay one to one, in any order;
    repeated rows and NULL ids are kept; other columns are not looked at.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"

    def encode(batches):
        model = tokenizer(path)
        for batch in batches:
            yield from _encoded(model, batch, ids)

    given = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")
    )
    return given.mapInArrow(encode, schema + (", ids array<int>" if ids else ""))


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) from (doc_id, ids); NULL ids give an empty text."""

    def decode(batches):
        model = tokenizer(path)
        for batch in batches:
            runs = batch.column(1).to_pylist()
            counts = np.array([len(r) for r in runs], dtype=np.int64)
            flat = np.array([i for r in runs for i in r], dtype=np.int64)
            yield pa.RecordBatch.from_pydict(
                {"doc_id": batch.column(0), "text": model.decode(flat, counts)}
            )

    given = encoded.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce("ids", F.array().cast("array<int>")).alias("ids"),
    )
    return given.mapInArrow(decode, "doc_id long, text string")
