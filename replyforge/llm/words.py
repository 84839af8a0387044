"""Words and word shingles of many texts at once, as 64-bit hashes in numpy.

Texts arrive as Arrow batches.  A chunk is a run of whole texts with about
``CHUNK_BYTES`` of UTF-8; all arrays below belong to one chunk, so a task's
memory is bounded by a chunk (or by its longest text), never by its partition.

A word is a maximal run of the bytes a class table allows.  The default class
is letters, digits and everything outside ASCII, with A-Z lower-cased.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
SHINGLE = 5

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
AS_IS = np.arange(256, dtype=np.uint8)


def _word_class() -> np.ndarray:
    """Bytes outside 00-2F, 3A-60 and 7B-7F, judged after lower-casing."""
    inside = np.zeros(256, dtype=bool)
    inside[0x30:0x3A] = inside[0x61:0x7B] = inside[0x80:] = True
    return inside


ALNUM = _word_class()
NOT_BLANK = ~np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])

_R = np.uint64(0x9E3779B97F4A7C15)
_R_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def _power(base: np.uint64, name: str, n: int) -> np.ndarray:
    """base**i for i below n (mod 2**64), kept for the next chunk."""
    have = _powers.get(name)
    if have is None or len(have) < n:
        steps = np.full(max(n, CHUNK_BYTES + CHUNK_BYTES // 4), base, dtype=np.uint64)
        steps[0] = 1
        have = _powers[name] = np.cumprod(steps, dtype=np.uint64)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def salt(n: int) -> np.uint64:
    """The n-th of a fixed series of odd 64-bit numbers."""
    return mix(np.array([n * 0x9E3779B97F4A7C15 % (1 << 64)], dtype=np.uint64))[0] | np.uint64(1)


@dataclass
class Chunk:
    """UTF-8 bytes of the texts in rows [first, first + n) of a batch."""

    first: int
    data: np.ndarray
    bounds: np.ndarray  # n + 1 byte offsets

    @property
    def n(self) -> int:
        return len(self.bounds) - 1


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Runs of whole texts of an Arrow string or binary array without nulls."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    kind = np.int64 if wide else np.int32
    at = np.frombuffer(offsets, dtype=kind, count=len(texts) + 1 + texts.offset)[texts.offset:]
    at = at.astype(np.int64)
    flat = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(texts):
        stop = max(row + 1, int(np.searchsorted(at, at[row] + limit, "right")) - 1)
        yield Chunk(row, flat[at[row]:at[stop]], at[row:stop + 1] - at[row])
        row = stop


@dataclass
class Words:
    """Words of a chunk: byte spans, hashes, and where each text's words begin."""

    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    bounds: np.ndarray  # n + 1 word numbers
    prefix_sums: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def rows(self) -> np.ndarray:
        """Row within the chunk of every word."""
        return np.repeat(np.arange(len(self.bounds) - 1), self.counts())


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of byte spans from the chunk's running polynomial sums."""
    inverse = _power(_R_INVERSE, "inverse", len(sums))
    return mix((sums[ends] - sums[starts]) * inverse[starts])


def find_words(chunk: Chunk, inside: np.ndarray = ALNUM, fold: np.ndarray = LOWER) -> Words:
    n = len(chunk.data)
    folded = fold[chunk.data]
    is_word = inside[folded]
    edge = np.zeros(n + 1, dtype=bool)
    edge[chunk.bounds] = True
    before = np.empty(n, dtype=bool)
    after = np.empty(n, dtype=bool)
    if n:
        before[0] = after[-1] = False
        before[1:] = is_word[:-1]
        after[:-1] = is_word[1:]
    starts = np.flatnonzero(is_word & (~before | edge[:n]))
    ends = np.flatnonzero(is_word & (~after | edge[1:])) + 1
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((folded.astype(np.uint64) + np.uint64(1)) * _power(_R, "power", n), out=sums[1:])
    return Words(
        starts, ends, span_hash(sums, starts, ends), np.searchsorted(starts, chunk.bounds), sums
    )


def text_hashes(chunk: Chunk) -> np.ndarray:
    """One 64-bit hash per text, of all its bytes as they are."""
    sums = np.zeros(len(chunk.data) + 1, dtype=np.uint64)
    np.cumsum(
        (chunk.data.astype(np.uint64) + np.uint64(1)) * _power(_R, "power", len(chunk.data)),
        out=sums[1:],
    )
    sizes = np.diff(chunk.bounds).astype(np.uint64)
    return mix(span_hash(sums, chunk.bounds[:-1], chunk.bounds[1:]) ^ (sizes * salt(77)))


def shingles(chunk: Chunk, words: Words, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds): hashes of runs of ``size`` words, text by text.

    A text of fewer words is one shingle of all of them.  A text without words
    is one shingle of its bytes, so that such texts are alike only if equal.
    """
    counts = words.counts()
    n_words = len(words.hashes)
    total = np.zeros(n_words, dtype=np.uint64)
    for k in range(size):
        part = words.hashes[k:] * salt(k + 1)
        total[: n_words - k] += part
    last = np.zeros(n_words, dtype=bool)
    # A run of ``size`` starts at every word but a text's last size - 1.
    room = words.bounds[1:].repeat(counts) - np.arange(n_words)
    last[room < size] = True
    short = np.flatnonzero((counts < size) & (counts > 0))
    for row in short:
        begin, end = words.bounds[row], words.bounds[row + 1]
        own = words.hashes[begin:end] * np.array([salt(k + 1) for k in range(end - begin)])
        own[0] ^= salt(100 + int(end - begin))
        total[begin] = own.sum(dtype=np.uint64)
        last[begin] = False
    keep = ~last
    kept = np.maximum(counts - size + 1, np.minimum(counts, 1))
    blank = np.flatnonzero(counts == 0)
    found = mix(total[keep])
    if len(blank):
        bounds = np.concatenate([[0], np.cumsum(kept)])
        found = np.insert(found, bounds[blank], text_hashes(chunk)[blank] ^ salt(99))
        kept[blank] = 1
    return found, np.concatenate([[0], np.cumsum(kept)])
