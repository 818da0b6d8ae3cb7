"""Adaptive context-mixing range coder for blocks of token ids.

A block's ids are cut into lanes of equal length that step together as numpy arrays; each lane has its own
range coder, and all lanes of a block share one model, which starts empty with the block. At each step three
predictors give the next id of every lane a probability: order 0 (adaptive counts of all ids), order 1 and order 2 (the
id that last followed the one or two ids before, with a confidence that grows with each hit). The mixture adds
them up: an id's share is its part of order 0's weight, and the weights of the orders 1 and 2 on top if it is the id
that they predict. In the range ids stand in their own order, so the share of an id begins at what order 0
gives the ids before it, and the weights of predictions that are smaller ids. Weights are learned in the block for each pair
of confidences, each order by its part in the shares of the ids that came. The coder narrows a
64-bit range by the id's share; the decoder repeats every step. All sums are of whole numbers, so both sides agree.

A block can be read without any other: header, lane sizes and words are covered by one CRC-32.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC, HEADER = b"MRC1", "<4sIIII"
LANES, STEPS, LAG = 8192, 256, 16  # lanes at most, ids of a lane at least, and steps from one update of order 0 to the next at most
TOTAL_BITS, LEAST_BITS, GAIN, SLOTS, SURE = 26, 23, 8, 2**18, 7
TOTAL, LEAST = 1 << TOTAL_BITS, 1 << LEAST_BITS
PART = 256  # of a share, in which the parts of orders are counted
_32 = np.uint64(32)
_LOW32 = np.uint64(2**32 - 1)


class Model:
    """What both sides know before each step."""

    def __init__(self, vocabulary: int):
        self.n = vocabulary
        self.count = np.ones(vocabulary, np.int64)
        self.waiting: list[np.ndarray] = []
        self.steps = 0
        self._scale()
        self.one, self.two = np.zeros(vocabulary, np.int64), np.zeros(SLOTS, np.int64)  # id * 8 + confidence
        self.earned = np.full((3, 2 * (SURE + 1) ** 2), PART, np.int64)  # by order 2, order 1 and order 0

    def _scale(self) -> None:
        """Shares of ids in TOTAL; each at least TOTAL / LEAST, so none vanishes under the least weight of order 0."""
        total = int(self.count.sum())
        while total > LEAST:
            self.count = np.maximum(1, self.count >> 1)
            total = int(self.count.sum())
        upto = np.zeros(self.n + 1, np.int64)
        np.cumsum(self.count, out=upto[1:])
        self.upto = ((upto << TOTAL_BITS) // total).astype(np.int32)

    def predict(self, last2: np.ndarray, last1: np.ndarray) -> None:
        self.slot = ((last2 * 40503 + last1) * 2654435761 >> 7) & (SLOTS - 1)
        self.last1 = last1
        one, two = self.one[last1], self.two[self.slot]
        self.p1, self.p2, self.k1, self.k2 = one >> 3, two >> 3, one & 7, two & 7
        self.group = (self.k2 * (SURE + 1) + self.k1) * 2 + (self.p1 == self.p2)
        share = (self.earned[:2] * (TOTAL - LEAST)) // self.earned.sum(axis=0)
        self.w2, self.w1 = share[0][self.group], share[1][self.group]
        self.w0 = TOTAL - self.w1 - self.w2

    def _before(self, ids: np.ndarray, w0: np.ndarray) -> np.ndarray:
        """What order 0 gives the ids before these."""
        return self.upto[ids] * w0 >> TOTAL_BITS

    def share(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids' shares begin, and their sizes."""
        self.hit2, self.hit1 = self.p2 == ids, self.p1 == ids
        start = self._before(ids, self.w0)
        self.part0 = self._before(ids + 1, self.w0) - start
        self.size = self.part0 + self.w2 * self.hit2 + self.w1 * self.hit1
        return start + self.w2 * (self.p2 < ids) + self.w1 * (self.p1 < ids), self.size

    def find(self, at: np.ndarray) -> np.ndarray:
        """The ids in whose shares the points lie."""
        ids = self.p2.copy()
        same = self.p1 == ids
        lo = self._before(ids, self.w0)
        start = lo + np.where(self.p1 < ids, self.w1, 0)
        end = start + self._before(ids + 1, self.w0) - lo + self.w2 + np.where(same, self.w1, 0)
        i = np.flatnonzero((at < start) | (at >= end))
        # Not order 2's id: is it order 1's?
        p1, w0, w1, at, w2 = self.p1[i], self.w0[i], self.w1[i], at[i], np.where(at[i] < start[i], 0, self.w2[i])
        lo = self._before(p1, w0)
        left = at - w2
        ids[i] = p1
        k = np.flatnonzero((left < lo) | (left >= self._before(p1 + 1, w0) + w1) | same[i])
        # Neither: what lies before the point in order 0, the weights of smaller ids left out, is looked up.
        i, w0 = i[k], w0[k]
        goal = left[k] - np.where(left[k] < lo[k], 0, w1[k])
        # The largest id with upto * w0 >> TOTAL_BITS <= goal; in order, as neighbours are looked up faster.
        top = ((((goal + 1) << TOTAL_BITS) - 1) // w0).astype(np.int32)
        order = np.argsort(top)
        ids[i[order]] = np.minimum(np.searchsorted(self.upto, top[order], side="right") - 1, self.n - 1)
        return ids

    def learn(self, ids: np.ndarray) -> None:
        hit1, hit2 = self.hit1, self.hit2
        part2, part1 = self.w2 * hit2 * PART // self.size, self.w1 * hit1 * PART // self.size
        for earned, part in zip(self.earned, (part2, part1, PART - part2 - part1), strict=True):
            earned += np.bincount(self.group, part, minlength=len(earned)).astype(np.int64)  # exact: far below 2**53
        for table, at, hit, old, sure in ((self.one, self.last1, hit1, self.p1, self.k1), (self.two, self.slot, hit2, self.p2, self.k2)):
            table[at] = np.where(hit | (sure == 0), ids, old) << 3 | np.where(hit, np.minimum(sure + 1, SURE), sure >> 1)
        self.waiting.append(ids)
        self.steps += 1
        if len(self.waiting) == min(LAG, self.steps // 2 + 1):
            self.count += GAIN * np.bincount(np.concatenate(self.waiting), minlength=self.n)
            self.waiting = []
            self._scale()


def _shape(n: int) -> tuple[int, int]:
    lanes = max(1, min(LANES, n // STEPS))
    return lanes, -(-n // lanes)


def _ready(low: np.ndarray, span: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lanes whose upper half is settled, or whose span is so small that it must be cut to settle it; and their spans."""
    open_ = (low ^ (low + span)) > _LOW32
    i = np.flatnonzero(~open_ | (span <= _LOW32))
    own = low[i]
    return i, np.where(open_[i], (~own + np.uint64(1)) & _LOW32, span[i])


def encode(ids: np.ndarray) -> bytes:
    """One block. Ids are whole numbers from 0 to 2**22."""
    n = len(ids)
    if not n:
        body = struct.pack(HEADER, MAGIC, 0, 0, 0, 0)
        return body + struct.pack("<I", zlib.crc32(body))
    lanes, steps = _shape(n)
    table = np.zeros(lanes * steps, np.int64)
    table[:n] = ids
    table = table.reshape(lanes, steps)
    model = Model(int(table.max()) + 1)
    low, span = np.zeros(lanes, np.uint64), np.full(lanes, 2**64 - 1, np.uint64)
    out, used, every = np.zeros((lanes, steps * 2 + 8), np.uint32), np.zeros(lanes, np.int64), np.arange(lanes)
    last2 = last1 = np.zeros(lanes, np.int64)
    for t in range(steps):
        own = np.ascontiguousarray(table[:, t])
        model.predict(last2, last1)
        start, size = model.share(own)
        unit = span >> np.uint64(TOTAL_BITS)
        low = low + unit * start.astype(np.uint64)
        span = unit * size.astype(np.uint64)
        i, left = _ready(low, span)
        while len(i):
            out[i, used[i]] = (low[i] >> _32).astype(np.uint32)
            used[i] += 1
            low[i], span[i] = low[i] << _32, left << _32
            k, left = _ready(low[i], span[i])
            i = i[k]
        model.learn(own)
        last2, last1 = last1, own
    for _ in range(2):
        out[every, used] = (low >> _32).astype(np.uint32)
        used += 1
        low = low << _32
    words = out[np.arange(out.shape[1])[None, :] < used[:, None]]
    body = struct.pack(HEADER, MAGIC, n, model.n, lanes, len(words)) + used.astype("<u4").tobytes() + words.astype("<u4").tobytes()
    return body + struct.pack("<I", zlib.crc32(body))


def decode(block: bytes) -> np.ndarray:
    """The ids of one block; ValueError if it was damaged."""
    body = block[:-4]
    if len(block) < struct.calcsize(HEADER) + 4 or struct.unpack("<I", block[-4:])[0] != zlib.crc32(body):
        raise ValueError("token block: wrong checksum")
    magic, n, vocabulary, lanes, size = struct.unpack_from(HEADER, body)
    if magic != MAGIC:
        raise ValueError("token block: unknown format")
    if not n:
        return np.zeros(0, np.int64)
    at = struct.calcsize(HEADER)
    used = np.frombuffer(body, "<u4", lanes, at).astype(np.int64)
    words = np.append(np.frombuffer(body, "<u4", size, at + 4 * lanes), [0, 0]).astype(np.uint64)
    read = np.cumsum(used) - used
    steps = -(-n // lanes)
    table = np.zeros((lanes, steps), np.int64)
    model = Model(vocabulary)
    low, span = np.zeros(lanes, np.uint64), np.full(lanes, 2**64 - 1, np.uint64)
    code = (words[read] << _32) | words[read + 1]
    read = read + 2
    last2 = last1 = np.zeros(lanes, np.int64)
    for t in range(steps):
        model.predict(last2, last1)
        unit = span >> np.uint64(TOTAL_BITS)
        own = model.find(np.minimum((code - low) // unit, np.uint64(TOTAL - 1)).astype(np.int64))
        start, size_ = model.share(own)
        low = low + unit * start.astype(np.uint64)
        span = unit * size_.astype(np.uint64)
        i, left = _ready(low, span)
        while len(i):
            code[i] = (code[i] << _32) | words[np.minimum(read[i], len(words) - 1)]
            read[i] += 1
            low[i], span[i] = low[i] << _32, left << _32
            k, left = _ready(low[i], span[i])
            i = i[k]
        table[:, t] = own
        model.learn(own)
        last2, last1 = last1, own
    return table.reshape(-1)[:n]
