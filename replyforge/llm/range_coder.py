"""Adaptive context-mixing range coder for token ids, many blocks in step.

Segments of ids are coded by themselves: all models start anew, so segments can
be read in any order and a damaged one stays alone.  A segment's ids are dealt
into blocks, each a lane with a code and a checksum of its own; numpy codes one
id of every block of many segments per step, and the lanes of a segment learn
from each other's ids of the steps before.

An id's probability is the weighted sum of three predictions: the id that
followed the last two ids before (order 2), the id that followed the last one
(order 1), and adaptive frequencies of the segment's ids (order 0, upper byte
times lower byte given the upper one or its class).  An id that several orders
predict gets the sum of what each gives it, and is coded in one step from that
one distribution.  The weights adapt too, apart for each state of confidence in
the two predicted ids: they follow the share of ids that each order foretold.
Predicted ids change with every step.  Frequencies and weights come into force
after FIRST steps and then whenever their number has doubled, at the latest after
EVERY; what has been seen in between is counted then.

All frequencies add up to powers of two, so most of a step is 32-bit arithmetic.
The coder keeps 64 bits of low and range and emits 32 bits when the range gets
short; where a carry could still come, the range is cut so that it cannot.
"""

from __future__ import annotations

import zlib

import numpy as np

BLOCK = 1024
TABLE = 1 << 14  # contexts of orders 1 and 2 in a segment
STEP = 16  # weight of a new observation in byte frequencies
FULL = 1 << 16  # total above which byte frequencies are halved
FIRST, EVERY = 4, 64
CLASSES = 8  # tables of lower bytes: one for each upper byte below 7, one for the rest
BITS = 12
WHOLE = 1 << BITS  # what the frequencies in force of a table of bytes add up to
SHARES = 64  # the weights of the three orders add up to it
LEAST = 4  # of them for order 0
RATES = np.array([0.05, 0.3, 0.5, 0.7])  # hits expected at first, by confidence
PRIOR = 4  # ids that these count for
MAX_ID = 1 << 16

_U = np.uint64
_SHORT = _U(1 << 32)
_S32 = _U(32)
_EACH = np.arange(1, 257, dtype=np.int32)


class _Bytes:
    """Adaptive frequencies of one byte in many tables, some for each segment.

    ``spans`` has those in force, (frequency of all smaller bytes) << 16 | own one;
    ``inverse``, made when it is asked for, has the byte of each unit of them.
    """

    def __init__(self, tables: int):
        self.count = np.ones((tables, 256), dtype=np.int32)
        self.spans = np.empty((tables, 256), dtype=np.int32)
        self.spans[:] = (np.arange(256) * (WHOLE // 256) << 16) + WHOLE // 256
        self.flat_spans = self.spans.reshape(-1)
        self.inverse: np.ndarray | None = None

    def refresh(self, seen: np.ndarray) -> None:
        """With new observations, each table << 8 | byte."""
        np.add.at(self.count.reshape(-1), seen.reshape(-1), np.int32(STEP))
        for a in range(0, len(self.count), 256):
            count, spans = self.count[a:a + 256], self.spans[a:a + 256]
            sums = np.cumsum(count, axis=1, dtype=np.int32)
            full = np.flatnonzero(sums[:, -1] > FULL)
            if len(full):
                count[full] = (count[full] + 1) >> 1  # for later
            sums *= (WHOLE - 256 << 16) // sums[:, -1:]
            sums >>= 16
            sums += _EACH
            sums[:, -1] = WHOLE
            spans[:, 0] = sums[:, 0]
            np.multiply(sums[:, :-1], 65535, out=spans[:, 1:])
            spans[:, 1:] += sums[:, 1:]
        self.inverse = None

    def find(self, table: np.ndarray, goal: np.ndarray) -> np.ndarray:
        """Byte whose span holds ``goal``."""
        if self.inverse is None:
            each = np.tile(np.arange(256, dtype=np.uint8), len(self.spans))
            self.inverse = np.repeat(each, self.flat_spans & 0xFFFF)
        return self.inverse.take((table << BITS) + goal).astype(np.int32)


class _Models:
    """Predictions for all lanes; encoder and decoder update them alike."""

    def __init__(self, lanes: int, segment: np.ndarray | None = None):
        """segment: number of each lane's segment; by default every lane is one."""
        segment = self.segment = np.arange(lanes) if segment is None else segment
        n = int(segment.max(initial=-1)) + 1
        self.high, self.low = _Bytes(n), _Bytes(n * CLASSES)
        # Orders 1 and 2, all segments of one after the other: id << 2 | confidence.
        self.guess = np.zeros(2 * n * TABLE, dtype=np.int32)
        self.lane32, self.lane_high = segment * 32, segment * 256
        self.lane_low, self.lane_guess = self.lane_high * CLASSES, segment * TABLE
        # For each state of confidence (that in order 1, in order 2, whether both predict
        # the same id): ids seen, hits of orders 1 and 2.
        self.seen = np.full((n, 2, 4, 4), float(PRIOR))
        self.hits1, self.hits2 = self.seen * RATES, self.seen * RATES[:, None]
        self.hits1[:, 0] *= 1 - RATES[:, None]  # both cannot hit
        # Since the last refresh, a row per step: ids; state and hits (<< 5, << 6).
        self.ids = np.zeros((EVERY, lanes), dtype=np.uint16)
        self.marks = np.zeros((EVERY, lanes), dtype=np.uint8)
        self.kept = 0
        self.shares = np.zeros((n, 2, 4, 4), dtype=np.int32)  # of order 2 << 8 | of order 1
        self.flat_shares = self.shares.reshape(-1)
        self._weigh()
        self.totals = np.full(lanes, SHARES << 2 * BITS, dtype=np.int64)
        self.last = np.zeros(lanes, dtype=np.int64)
        self.before = np.zeros(lanes, dtype=np.int64)
        self.step, self.due = 0, FIRST

    def _weigh(self) -> None:
        """Weights of orders 1 and 2 in force from now on; order 0 has the rest."""
        unit = (SHARES - LEAST) / self.seen
        unit[:, 1] /= 2  # both orders foretell the one id
        share1, share2 = (self.hits1 * unit).astype(np.int32), (self.hits2 * unit).astype(np.int32)
        self.shares[:] = (share2 << 8) + share1

    def _refresh(self, k: int) -> None:
        segment, ids = self.segment[:k], self.ids[:self.kept, :k].astype(np.int64)
        high = ids >> 8
        self.high.refresh((segment << 8) + high)
        table = segment * CLASSES + np.minimum(high, CLASSES - 1)
        self.low.refresh((table << 8) + (ids & 255))
        marks = (segment << 7) + self.marks[:self.kept, :k]
        seen = np.bincount(marks.reshape(-1), minlength=len(self.seen) << 7)
        seen = seen.reshape(-1, 2, 2, 2, 4, 4)  # segment, hit 2, hit 1, state
        self.seen += seen.sum(axis=(1, 2))
        self.hits1 += seen[:, :, 1].sum(axis=1)
        self.hits2 += seen[:, 1].sum(axis=1)
        self._weigh()
        self.kept, self.due = 0, self.step + min(self.step, EVERY)

    def look(self, k: int) -> None:
        """The distribution of the first k lanes: predicted ids, weights, total."""
        if self.step == self.due:
            self._refresh(k)
        at = self.at = np.empty((2, k), dtype=np.int64)
        np.multiply(self.last[:k], 40503, out=at[0])
        np.add(at[0], self.before[:k] * 60493, out=at[1])
        at >>= 5
        at &= TABLE - 1
        at += self.lane_guess[:k]
        at[1] += len(self.guess) >> 1
        held = self.held = self.guess.take(at)
        self.p = held >> 2
        self.p1, self.p2 = self.p
        c1, c2 = held & 3
        self.state = ((self.p1 == self.p2).view(np.int8) << 4) + (c2 << 2) + c1
        shares = self.flat_shares.take(self.lane32[:k] + self.state)
        w1, w2 = shares & 255, shares >> 8
        self.w0 = SHARES - w1 - w2
        self.u1, self.u2 = w1 << 2 * BITS, w2 << 2 * BITS
        self.total = self.totals[:k]

    def order0(self, k: int, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(frequency of smaller ids, frequency of the id) by order 0 alone."""
        high = ids >> 8
        s1 = self.high.flat_spans.take(self.lane_high[:k] + high)
        # The table of the class, then the lower byte in it.
        s2 = self.low.flat_spans.take(
            self.lane_low[:k] + ((np.minimum(high, CLASSES - 1) << 8) + (ids & 255))
        )
        size1 = s1 & 0xFFFF
        return (s1 >> 16 << BITS) + size1 * (s2 >> 16), size1 * (s2 & 0xFFFF)

    def span(self, k: int, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cumulative frequency below the id, its frequency) in the mix."""
        below, size = self.order0(k, ids)
        self.hit = self.p == ids
        past1, past2 = self.p < ids
        below = self.w0 * below + self.u1 * past1 + self.u2 * past2
        return below, self.w0 * size + self.u1 * self.hit[0] + self.u2 * self.hit[1]

    def find(self, k: int, goal: np.ndarray) -> np.ndarray:
        """The id whose span holds ``goal``: a predicted one, or by order 0."""
        goal = goal.astype(np.int32)
        (below1, below2), (size1, size2) = self.order0(k, self.p)
        same = self.p1 == self.p2
        below1 = self.w0 * below1 + self.u2 * (self.p2 < self.p1)
        below2 = self.w0 * below2 + self.u1 * (self.p1 < self.p2)
        above1 = below1 + self.w0 * size1 + self.u1 + self.u2 * same
        above2 = below2 + self.w0 * size2 + self.u2 + self.u1 * same
        past1, past2 = goal >= above1, goal >= above2
        is1, is2 = (goal >= below1) & ~past1, (goal >= below2) & ~past2
        rest = (goal - self.u1 * past1 - self.u2 * past2) // self.w0
        # What lies in a predicted id's span may be out of bounds here; it is not used.
        rest = np.minimum(rest, (1 << 2 * BITS) - 1)
        segment = self.segment[:k]
        high = self.high.find(segment, rest >> BITS)
        s1 = self.high.flat_spans.take(self.lane_high[:k] + high)
        inner = (rest - (s1 >> 16 << BITS)) // (s1 & 0xFFFF)
        table = segment * CLASSES + np.minimum(high, CLASSES - 1)
        low = self.low.find(table, inner)
        return np.where(is1, self.p1, np.where(is2, self.p2, (high << 8) + low))

    def learn(self, k: int, ids: np.ndarray) -> None:
        """After ``span`` of the ids."""
        packed = (ids << 2).astype(np.int32)
        self.guess[self.at] = np.where(self.hit, np.minimum(self.held + 1, self.held | 3), packed)
        hit1, hit2 = self.hit.view(np.int8)
        self.marks[self.kept, :k] = self.state + (hit1 << 5) + (hit2 << 6)
        self.ids[self.kept, :k] = ids
        self.kept += 1
        self.before[:k] = self.last[:k]
        self.last[:k] = ids
        self.step += 1


def _cut(low: np.ndarray, width: np.ndarray) -> np.ndarray:
    """Ranges too short to go on, shortened where a carry could still reach the top."""
    carry = ((low ^ (low + (width - _U(1)))) >> _S32) != 0
    return np.where(carry, (~low + _U(1)) & (_SHORT - _U(1)), width)


class _Encoder:
    def __init__(self, lanes: int, capacity: int):
        self.low = np.zeros(lanes, dtype=_U)
        self.range = np.full(lanes, 2**64 - 1, dtype=_U)
        self.out = np.zeros((lanes, capacity), dtype=np.uint32)
        self.used = np.zeros(lanes, dtype=np.int64)

    def put(self, k: int, below: np.ndarray, size: np.ndarray, total: np.ndarray) -> None:
        """One id for each of the first k lanes."""
        unit = self.range[:k] // total.view(_U)
        self.low[:k] += below.astype(_U) * unit
        unit *= size.astype(_U)
        self.range[:k] = unit
        short = np.flatnonzero(unit < _SHORT)
        if not len(short):
            return
        low, used = self.low.take(short), self.used.take(short)
        if int(used.max()) >= self.out.shape[1]:
            self.out = np.concatenate([self.out, np.zeros_like(self.out)], axis=1)
        self.out[short, used] = low >> _S32
        self.used[short] = used + 1
        self.low[short] = low << _S32
        # A range is 1 at least, so once is enough.
        self.range[short] = _cut(low, unit.take(short)) << _S32

    def finish(self) -> list[bytes]:
        words = []
        for lane in range(len(self.low)):
            end = [int(self.low[lane]) >> s & 0xFFFFFFFF for s in (32, 0)]
            body = self.out[lane, : self.used[lane]].astype("<u4").tobytes()
            words.append(body + np.array(end, dtype="<u4").tobytes())
        return words


class _Decoder:
    def __init__(self, payloads: list[bytes]):
        sizes = np.array([len(p) // 4 for p in payloads], dtype=np.int64)
        self.words = np.frombuffer(b"".join(payloads) + b"\0\0\0\0", dtype="<u4")
        self.end = np.cumsum(sizes)
        self.at = self.end - sizes
        self.low = np.zeros(len(payloads), dtype=_U)
        self.range = np.full(len(payloads), 2**64 - 1, dtype=_U)
        self.over = np.zeros(len(payloads), dtype=_U)  # code less low
        for _ in range(2):
            self.over = (self.over << _S32) | self._next(np.arange(len(payloads)))

    def _next(self, lanes: np.ndarray) -> np.ndarray:
        at = self.at.take(lanes)
        self.at[lanes] = at + 1
        return np.where(at < self.end.take(lanes), self.words.take(at, mode="clip"), 0).astype(_U)

    def target(self, k: int, total: np.ndarray) -> np.ndarray:
        self.unit = self.range[:k] // total.view(_U)
        return np.minimum((self.over[:k] // self.unit).view(np.int64), total - 1)

    def take(self, k: int, below: np.ndarray, size: np.ndarray) -> None:
        shift = below.astype(_U) * self.unit
        self.low[:k] += shift
        self.over[:k] -= shift
        width = self.unit * size.astype(_U)
        self.range[:k] = width
        short = np.flatnonzero(width < _SHORT)
        if not len(short):
            return
        low = self.low.take(short)
        self.over[short] = (self.over.take(short) << _S32) | self._next(short)
        self.low[short] = low << _S32
        self.range[short] = _cut(low, width.take(short)) << _S32


def _in_step(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lanes by falling size, number of lanes still open at each step)."""
    order = np.argsort(-sizes, kind="stable")
    longest = int(sizes.max(initial=0))
    return order, np.searchsorted(-sizes[order], -np.arange(longest), "left")


def encode_blocks(
    ids: np.ndarray, sizes: np.ndarray, segment: np.ndarray | None = None
) -> tuple[list[bytes], np.ndarray]:
    """(payload, crc32 of the ids as 32-bit little-endian) of consecutive runs of ids.

    segment: number of each block's segment, from 0; by default every block is one.
    """
    if len(ids) and (ids.max() >= MAX_ID or ids.min() < 0):
        raise ValueError(f"ids must lie in 0 .. {MAX_ID - 1}")
    starts = np.cumsum(sizes) - sizes
    sums = np.array(
        [zlib.crc32(ids[a:a + n].astype("<u4").tobytes()) for a, n in zip(starts, sizes)],
        dtype=np.int64,
    )
    order, open_at = _in_step(sizes)
    rows = np.zeros((len(sizes), len(open_at)), dtype=np.uint16)
    for lane, block in enumerate(order):
        rows[lane, : sizes[block]] = ids[starts[block]:starts[block] + sizes[block]]
    table = np.ascontiguousarray(rows.T)  # one row per step
    del rows
    models = _Models(len(sizes), None if segment is None else segment[order])
    coder = _Encoder(len(sizes), len(open_at) // 2 + 64)
    for row, k in zip(table, open_at.tolist()):
        x = row[:k].astype(np.int64)
        models.look(k)
        coder.put(k, *models.span(k, x), models.total)
        models.learn(k, x)
    payloads = [b""] * len(sizes)
    for block, payload in zip(order, coder.finish()):
        payloads[block] = payload
    return payloads, sums


def decode_blocks(
    payloads: list[bytes], sizes: np.ndarray, sums: np.ndarray, segment: np.ndarray | None = None
) -> np.ndarray:
    """Ids of all blocks in order; raises ValueError where a checksum differs."""
    order, open_at = _in_step(sizes)
    table = np.zeros((len(open_at), len(sizes)), dtype=np.uint16)
    models = _Models(len(sizes), None if segment is None else segment[order])
    coder = _Decoder([payloads[block] for block in order])
    for row, k in zip(table, open_at.tolist()):
        models.look(k)
        x = models.find(k, coder.target(k, models.total))
        coder.take(k, *models.span(k, x))
        row[:k] = x
        models.learn(k, x)
    starts = np.cumsum(sizes) - sizes
    ids = np.zeros(int(sizes.sum()), dtype=np.uint16)
    table = np.ascontiguousarray(table.T)
    for lane, block in enumerate(order):
        ids[starts[block]:starts[block] + sizes[block]] = table[lane, : sizes[block]]
    for a, n, crc in zip(starts, sizes, sums):
        if zlib.crc32(ids[a:a + n].astype("<u4").tobytes()) != crc:
            raise ValueError("checksum of a block does not match its ids")
    return ids
