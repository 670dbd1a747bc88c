"""Adaptive context-mixing range coder for token ids, vectorised over lanes.

A block of ids is cut into lanes of equal length; each lane is a range-coded stream of its own, and all
lanes take one step at a time with one shared model, so numpy works on whole steps. The model predicts
an id in three ways: order 0 by the counts of ids so far, order 1 by the id that last followed the
previous id, order 2 by the id that last followed the previous two. The last two name one id each; how
far they are trusted depends on how often such a prediction (by its run of hits) has come true. Their
odds are added to the order-0 counts, and the mixed frequencies drive the coder. All of it is integer
arithmetic, so any machine decodes alike. Every block starts from the empty model and has a checksum.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

#: Ids in a block, lanes at most, and steps that a lane should have at least.
BLOCK_IDS, MAX_LANES, MIN_STEPS = 1 << 21, 8192, 64
_HEAD = struct.Struct("<IIIII")  # ids, lanes, alphabet, crc32 of the ids as 32-bit numbers and of the body, bytes that follow
_TOP, _BOTTOM = np.uint64(1 << 48), np.uint64(1 << 32)
#: What a seen id adds to its count, lengths of runs told apart, most odds of a prediction, bits of an order-2 place.
_GAIN, _RUN_BITS, _MOST_ODDS, _HASH_BITS = 32, 3, 30, 18
_TRUST = 1 << _RUN_BITS
#: Ids that an alphabet may have: mixed frequencies of a full block then sum up to at most 2^32, the least span of a lane.
MAX_ALPHABET = (1 << 32) // (1 + 2 * _MOST_ODDS) - _GAIN * BLOCK_IDS
assert MAX_ALPHABET > 1 << 20
_U16, _U48 = np.uint64(16), np.uint64(48)


class CorruptBlock(ValueError):
    pass


class _Model:
    """Shared by all lanes of a block; encoder and decoder take the same steps.

    A context's entry is the id that it names and the length of its run of hits, in one number. Counts are
    taken over every few steps: `below` then holds their sums.
    """

    def __init__(self, alphabet: int, lanes: int):
        self.counts = np.ones(alphabet, np.int64)
        self.below = np.arange(alphabet + 1, dtype=np.int64)
        self.entries = [np.zeros(alphabet, np.int32), np.zeros(1 << _HASH_BITS, np.int32)]
        self.told = np.ones((2, 2, _TRUST), np.int64)  # by order: misses and hits of each length of a run
        self.told[:, 0] = 2
        self.last, self.place = np.zeros(lanes, np.uint32), np.zeros(lanes, np.uint32)
        self.step = 0
        self.pending: list[np.ndarray] = []

    def predict(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For the first n lanes: the order-1 and order-2 ids, and the frequencies that they add."""
        total = self.below[-1]
        odds = np.minimum(total * self.told[:, 1] // self.told[:, 0], total * _MOST_ODDS)
        self.at = [x[:n].astype(np.int64) for x in (self.last, self.place)]
        self.found = [t.take(at) for t, at in zip(self.entries, self.at, strict=True)]
        self.ids, self.run = [e >> _RUN_BITS for e in self.found], [e & _TRUST - 1 for e in self.found]
        return *self.ids, odds[0].take(self.run[0]), odds[1].take(self.run[1])

    def spans(self, x: np.ndarray, one: np.ndarray, two: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the mixed frequencies of the ids x start, and how large they are."""
        start, own = self.below.take(x), x.astype(np.int32)
        size = self.below.take(x + 1) - start
        return start + a * (one < own) + b * (two < own), size + a * (one == own) + b * (two == own)

    def update(self, x: np.ndarray) -> None:
        n, own = len(x), x.astype(np.int32)
        kinds = []
        for entries, at, found, ids, run in zip(self.entries, self.at, self.found, self.ids, self.run, strict=True):
            hit = ids == own
            kinds.append(run + (hit.astype(np.int32) << _RUN_BITS))
            # A trusted prediction loses half of its run at a miss; one without a run is replaced.
            lost = np.where(run == 0, own << _RUN_BITS, found - run + (run >> 1))
            entries[at] = np.where(hit, found + (run < _TRUST - 1), lost)
        both = np.bincount(kinds[0] + kinds[1] * (2 * _TRUST), minlength=4 * _TRUST * _TRUST).reshape(2 * _TRUST, 2 * _TRUST)
        self.told[0] += both.sum(axis=0).reshape(2, _TRUST)
        self.told[1] += both.sum(axis=1).reshape(2, _TRUST)
        now = own.view(np.uint32)
        self.place[:n] = self.last[:n] * np.uint32(0x9E3779B1) + now * np.uint32(0x85EBCA6B) >> np.uint32(32 - _HASH_BITS)
        self.last[:n] = now
        self.pending.append(x)
        self.step += 1
        if self.step < 8 or self.step % (4 if self.step < 64 else 8) == 0:
            self.counts += _GAIN * np.bincount(np.concatenate(self.pending), minlength=len(self.counts))
            np.cumsum(self.counts, out=self.below[1:])
            self.pending.clear()


def _shape(n: int) -> tuple[int, int]:
    steps = -(-n // max(1, min(MAX_LANES, n // MIN_STEPS)))
    return -(-n // steps), steps


def encode_block(ids: np.ndarray, alphabet: int) -> bytes:
    """One block of 1 to BLOCK_IDS ids, each below the alphabet's size."""
    n = len(ids)
    if not 0 < n <= BLOCK_IDS or not 0 < alphabet <= MAX_ALPHABET:
        raise ValueError(f"a block has 1 to {BLOCK_IDS} ids of at most {MAX_ALPHABET}")
    lanes, steps = _shape(n)
    grid = np.zeros(lanes * steps, np.int32)
    grid[:n] = ids
    grid = np.ascontiguousarray(grid.reshape(lanes, steps).T)
    model = _Model(alphabet, lanes)
    low, span = np.zeros(lanes, np.uint64), np.full(lanes, (1 << 64) - 1, np.uint64)
    width = 3 * steps + 2
    out, begin = np.zeros(lanes * width, np.uint16), np.arange(lanes) * width
    end = begin.copy()
    short = n - (lanes - 1) * steps  # ids of the last lane
    for s in range(steps):
        m = lanes if s < short else lanes - 1
        if not m:
            break
        x = grid[s, :m].astype(np.int64)
        one, two, a, b = model.predict(m)
        start, size = model.spans(x, one, two, a, b)
        unit = span[:m] // (model.below[-1] + a + b).astype(np.uint64)
        lo = low[:m] + unit * start.astype(np.uint64)
        sp = unit * size.astype(np.uint64)
        todo, l, r = None, lo, sp
        while True:
            same = (l ^ (l + r)) < _TOP
            narrow = r < _BOTTOM
            go = np.flatnonzero(same | narrow)
            if not len(go):
                break
            todo = go if todo is None else todo[go]
            l, same, r = l[go], same[go], r[go]
            if not same.all():
                r = np.where(same, r, (~l + np.uint64(1)) & (_BOTTOM - np.uint64(1)))
            at = end[todo]
            out[at] = (l >> _U48).astype(np.uint16)
            end[todo] = at + 1
            l, r = l << _U16, r << _U16
            lo[todo], sp[todo] = l, r
        low[:m], span[:m] = lo, sp
        model.update(x)
    last = (low + (_BOTTOM - np.uint64(1))) >> np.uint64(32)
    out[end], out[end + 1] = (last >> _U16 & np.uint64(0xFFFF)).astype(np.uint16), (last & np.uint64(0xFFFF)).astype(np.uint16)
    used = end + 2 - begin
    body = used.astype("<u2").tobytes() + out.reshape(lanes, width)[np.arange(width) < used[:, None]].astype("<u2").tobytes()
    return _HEAD.pack(n, lanes, alphabet, zlib.crc32(body, zlib.crc32(np.asarray(ids, "<u4").tobytes())), len(body)) + body


def decode_block(data: bytes, at: int = 0) -> tuple[np.ndarray, int]:
    """The ids of the block at `at`, and where the next one starts."""
    n, lanes, alphabet, check, size = _HEAD.unpack_from(data, at)
    at += _HEAD.size
    if not 0 < n <= BLOCK_IDS or not 0 < alphabet <= MAX_ALPHABET or lanes != _shape(n)[0] or at + size > len(data):
        raise CorruptBlock("the head of a block makes no sense")
    steps = _shape(n)[1]
    used = np.frombuffer(data, "<u2", lanes, at).astype(np.int64)
    words = np.frombuffer(data, "<u2", (size - 2 * lanes) // 2, at + 2 * lanes)
    if int(used.sum()) != len(words):
        raise CorruptBlock("the lanes of a block don't fit")
    # Zeros after each lane's end: the coder leaves them out.
    room = np.zeros((lanes, int(used.max()) + 8), np.uint64)
    room[np.arange(room.shape[1]) < used[:, None]] = words
    flat, width = room.ravel(), room.shape[1]
    last = np.arange(1, lanes + 1) * width - 1
    code = room[:, 0] << _U48 | room[:, 1] << np.uint64(32) | room[:, 2] << _U16 | room[:, 3]
    read = np.arange(lanes) * width + 4
    model = _Model(alphabet, lanes)
    low, span = np.zeros(lanes, np.uint64), np.full(lanes, (1 << 64) - 1, np.uint64)
    grid = np.zeros((steps, lanes), np.uint32)
    short = n - (lanes - 1) * steps
    for s in range(steps):
        m = lanes if s < short else lanes - 1
        if not m:
            break
        one, two, a, b = model.predict(m)
        below = model.below
        total = below[-1] + a + b
        unit = span[:m] // total.astype(np.uint64)
        value = np.minimum(((code[:m] - low[:m]) // unit).astype(np.int64), total - 1)
        # Take out the added frequencies, the lesser id's first: what falls into them falls on the id's last count.
        first, second = np.minimum(one, two), np.maximum(one, two)
        add = np.where(one <= two, a, b)
        value -= np.clip(value - (below[first + 1] - 1), 0, add)
        value -= np.clip(value - (below[second + 1] - 1), 0, a + b - add)
        order = np.argsort(value)  # neighbours in order are found by nearly the same path: three times as fast
        x = np.empty(m, np.int64)
        x[order] = np.searchsorted(below, value[order], "right") - 1
        start, freq = model.spans(x, one, two, a, b)
        lo = low[:m] + unit * start.astype(np.uint64)
        sp = unit * freq.astype(np.uint64)
        todo, l, r = None, lo, sp
        while True:
            same = (l ^ (l + r)) < _TOP
            narrow = r < _BOTTOM
            go = np.flatnonzero(same | narrow)
            if not len(go):
                break
            todo = go if todo is None else todo[go]
            l, same, r = l[go], same[go], r[go]
            if not same.all():
                r = np.where(same, r, (~l + np.uint64(1)) & (_BOTTOM - np.uint64(1)))
            here = read[todo]
            code[todo] = code[todo] << _U16 | flat.take(np.minimum(here, last[todo]))
            read[todo] = here + 1
            l, r = l << _U16, r << _U16
            lo[todo], sp[todo] = l, r
        low[:m], span[:m] = lo, sp
        grid[s, :m] = x
        model.update(x)
    ids = np.ascontiguousarray(grid.T).ravel()[:n]
    if zlib.crc32(data[at : at + size], zlib.crc32(ids.astype("<u4").tobytes())) != check:
        raise CorruptBlock("a block's checksum doesn't match")
    return ids, at + size


def encode(ids: np.ndarray, alphabet: int) -> bytes:
    return b"".join(encode_block(ids[i : i + BLOCK_IDS], alphabet) for i in range(0, len(ids), BLOCK_IDS))


def decode(data: bytes) -> np.ndarray:
    out, at = [], 0
    while at < len(data):
        ids, at = decode_block(data, at)
        out.append(ids)
    return np.concatenate(out) if out else np.zeros(0, np.uint32)
