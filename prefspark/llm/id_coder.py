"""Adaptive context-mixing range coder for token ids below 2**16.

Ids are cut into blocks that are coded each by itself: every block starts
from the same model and carries a checksum.  Within a block three models
predict the next id.  Order 2 and order 1 remember, for a hashed context of
two ids or one, the id seen last and how often it has held; order 0 counts
ids, and keeps the ids seen in a hashed cache.  A logistic mixer weighs the
three opinions on the order-2 candidate; the order-1 candidate is next, then
the ids of the order-0 cache, whose place is coded four bits at a time under
adaptive cumulative counts of a fixed total, then any id.  A range coder with
64-bit state turns the probabilities into 32-bit words.

All arithmetic is on integers, so any machine decodes the same ids.  Blocks
are coded side by side: one numpy operation does one step of all of them.
"""

from __future__ import annotations

import zlib

import numpy as np

BLOCK = 4096
_U = np.uint64
_BOTTOM, _LOW32, _LOW16, _ONE = _U(1 << 32), _U((1 << 32) - 1), _U((1 << 16) - 1), _U(1)
_W2, _W12, _W15, _W16, _W32, _W56 = _U(2), _U(12), _U(15), _U(16), _U(32), _U(56)
_BYTES = _U(0x0101010101010101)  # times a number of eight small bytes: their sum in the highest byte
_ONE32 = np.uint32(1)
_INT, _INT12 = np.int32(1), np.int32(12)
_SLOTS = 1024           # contexts of order 1 and of order 2
_CACHE = 1024           # ids of order 0
_CONF = 16
_NONE = 65535 << 8      # an entry is an id and, in the low byte, its count
_PLACES = 1 << 15       # total of the cumulative counts of four bits of a place
_ROW = np.dtype("V32")  # sixteen of them, moved at once
# cumulative counts towards which a symbol moves those of its row; every width stays at least 1
_TARGETS = (np.arange(16) + (np.arange(16) > np.arange(16)[:, None]) * (_PLACES - 16)).astype(np.int16)


# stretch(p) = ln(p / (1 - p)) in 1/256 units for 12-bit p; squash is its
# inverse.  Both come from one integer table, built without floating point.
_SQUASH_KNOTS = np.array([1, 2, 3, 6, 10, 16, 27, 45, 73, 120, 194, 310, 488, 747, 1101, 1546, 2047, 2549, 2994, 3348,
                          3607, 3785, 3901, 3975, 4022, 4050, 4068, 4079, 4085, 4089, 4092, 4093, 4094])


def _tables() -> tuple[np.ndarray, np.ndarray]:
    x = np.arange(4096)
    low, part = x // 128, x % 128
    squash = (_SQUASH_KNOTS[low] * (128 - part) + _SQUASH_KNOTS[low + 1] * part + 64) // 128
    stretch = np.searchsorted(squash, np.arange(4096)) - 2048
    return squash.astype(np.int32), np.clip(stretch, -2047, 2047).astype(np.int32)


_SQUASH, _STRETCH = _tables()


class _Model:
    """Models and mixer of a number of blocks, all at the same step.  Arrays
    of two or three rows hold order 2, order 1 and, in the third, order 0."""

    def __init__(self, lanes: int):
        lane = np.arange(lanes)
        self.at_slots = np.stack([lane * _SLOTS, (lanes + lane) * _SLOTS])
        self.entries = np.full(2 * lanes * _SLOTS, _NONE, np.int32)
        self.at_cache = lane * _CACHE
        self.cache = np.full(lanes * _CACHE, _NONE, np.int32)
        self.at_conf = np.stack([(i * lanes + lane) * _CONF for i in range(3)])
        self.p = np.tile((2048 * (np.arange(_CONF) * 2 + 1)).astype(np.int32), 3 * lanes)  # 16-bit probabilities
        self.weights = np.full((3, lanes), 1 << 11, np.int32)
        self.cached = np.full(lanes, 2048, np.int32)  # 12-bit probability that order 0 knows the rest
        self.at_places = lane * 17
        self.places = np.tile(np.arange(0, _PLACES, _PLACES // 16, dtype=np.int16), (lanes * 17, 1))
        self.last = np.zeros(lanes, np.int64)
        self.context = np.zeros((2, lanes), np.int64)
        self.k = np.empty((3, lanes), np.int64)

    def keep(self, n: int) -> None:
        """Go on with the first n blocks alone."""
        for name in ("at_slots", "at_cache", "at_conf", "weights", "cached", "at_places", "last", "context", "k"):
            setattr(self, name, np.ascontiguousarray(getattr(self, name)[..., :n]))

    def predict(self):
        """Bounds of the parts of 4096: order 2 below the first, order 1
        below the second, order 0 below the third."""
        np.add(self.last, 77, out=self.context[1])
        slots = self.context * 2654435761
        slots >>= 15
        slots &= _SLOTS - 1
        slots += self.at_slots
        self.slots = slots.ravel()
        self.found = self.entries.take(slots)
        self.c, self.f = self.found >> 8, self.found & 255
        popular = self.cache.take((self.c[0] & (_CACHE - 1)) + self.at_cache)
        k = self.k
        k[:2] = self.f
        np.multiply(popular >> 8 == self.c[0], np.minimum(popular & 255, _CONF - 1), out=k[2])
        k += self.at_conf
        self.old = self.p.take(k)
        high = self.old >> 4
        self.inputs = _STRETCH.take(high)
        self.same = self.c[0] == self.c[1]
        self.inputs[1] *= (self.same << 1) - _INT
        dot = self.weights * self.inputs
        dot = (dot[0] + dot[1] + dot[2]) >> 12
        self.mixed = _SQUASH.take(np.minimum(np.maximum(dot, -2047), 2047) + 2048)
        a = np.minimum(np.maximum(self.mixed, 16), 4000)
        b = a + ~self.same * np.maximum((4064 - a) * high[1] >> 12, 1)
        return a, b, b + 1 + ((4094 - b) * self.cached >> 12)

    def update(self, ids: np.ndarray, at: np.ndarray, held: np.ndarray, rest: np.ndarray, known: np.ndarray) -> None:
        """Learn the ids that came, whose places ``at`` in the cache now have
        ``held``; ``rest`` says where only order 0 was left, ``known`` where
        it held the id."""
        hit = self.c == ids
        self.weights += self.inputs * ((hit[0] << _INT12) - self.mixed) >> 14
        step = np.empty_like(self.old)
        np.multiply(hit, 65535, out=step[:2])
        step[2] = step[0]
        step -= self.old
        step >>= 5
        step += self.old
        self.p[self.k.ravel()] = step.ravel()
        self.cached += rest * ((known << _INT12) - self.cached >> 5)
        firm = self.f >= 2
        self.entries[self.slots] = np.where(hit, self.found + (self.f < _CONF - 1),
                                            np.where(firm, self.found - self.f + (self.f >> 1), ids << 8)).ravel()
        self.cache[at] = np.where(held >> 8 == ids, held + ((held & 255) < 255), (ids << 8) + 1)
        self.context[0] = self.last * 40503 + ids
        self.last[:] = ids

    def place(self, rows: np.ndarray):
        """Cumulative counts, out of ``_PLACES``, of four bits of a place."""
        return self.places.take(rows, axis=0)

    def learn_place(self, rows: np.ndarray, counts: np.ndarray, symbol: np.ndarray) -> None:
        counts += (_TARGETS.take(symbol, axis=0) - counts) >> 5
        self.places.view(_ROW).ravel()[rows] = counts.view(_ROW).ravel()


def _bounds(counts: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and width of a symbol of every row of cumulative counts."""
    at = np.arange(0, 16 * len(symbol), 16) + symbol
    flat = counts.ravel()
    start = flat.take(at)
    return start.astype(np.uint64), ((flat.take(at + 1, mode="wrap") - start) & (_PLACES - 1)).astype(np.uint64)


class _Encoder:
    """Range coder with carry: what overflows ``low`` goes into words that
    were already written."""

    def __init__(self, lanes: int, words: int):
        self.low, self.range = np.zeros(lanes, np.uint64), np.full(lanes, 0xFFFFFFFFFFFFFFFF, np.uint64)
        self.words = np.zeros((lanes, words), np.uint32)
        self.size = np.zeros(lanes, np.int64)

    def narrow(self, low, span, start, width, lanes: np.ndarray | None = None):
        """Low and range of blocks, the first or ``lanes``, after a symbol."""
        add = start * span
        low = low + add
        over = (low < add).nonzero()[0]
        if len(over):
            over = over if lanes is None else lanes[over]
            at = self.size[over] - 1
            while len(over):
                word = self.words[over, at] + _ONE32
                self.words[over, at] = word
                more = word == 0
                over, at = over[more], at[more] - 1
        return low, width * span

    def shift(self, low, span, lanes: np.ndarray | None = None) -> None:
        """Write a word of every block with a small range."""
        go = (span < _BOTTOM).nonzero()[0]
        if len(go):
            at = go if lanes is None else lanes[go]
            some = low[go]
            self.words[at, self.size[at]] = some >> _W32
            self.size[at] += 1
            low[go] = some << _W32
            span[go] <<= _W32

    def finish(self) -> list[bytes]:
        lane = np.arange(len(self.low))
        for word in (self.low >> _W32, self.low & _LOW32):
            self.words[lane, self.size] = word
            self.size += 1
        return [self.words[i, :n].astype("<u4").tobytes() for i, n in enumerate(self.size)]


class _Decoder:
    def __init__(self, blocks: list[bytes]):
        sizes = np.array([len(b) // 4 for b in blocks])
        self.words = np.zeros((len(blocks), int(sizes.max()) + 3), np.uint64)
        for i, b in enumerate(blocks):
            self.words[i, :sizes[i]] = np.frombuffer(b, "<u4", sizes[i])
        self.range = np.full(len(blocks), 0xFFFFFFFFFFFFFFFF, np.uint64)
        self.code = self.words[:, 0] << _W32 | self.words[:, 1]
        self.next = np.full(len(blocks), 2)

    def shift(self, code, span, lanes: np.ndarray | None = None) -> None:
        """Read a word into every block with a small range."""
        go = (span < _BOTTOM).nonzero()[0]
        if len(go):
            at = go if lanes is None else lanes[go]
            word = np.minimum(self.next[at], self.words.shape[1] - 1)
            code[go] = code[go] << _W32 | self.words[at, word]
            span[go] <<= _W32
            self.next[at] += 1


def _lengths(n_ids: int, block: int) -> list[int]:
    return [block] * (n_ids // block) + ([n_ids % block] if n_ids % block else [])


def encode(ids: np.ndarray, block: int = BLOCK) -> tuple[list[bytes], list[int]]:
    """(payload, CRC-32 of the ids as little-endian 32-bit integers) of each
    block of ``block`` ids, the last one shorter."""
    lengths = _lengths(len(ids), block)
    if not lengths:
        return [], []
    lanes = len(lengths)
    grid = np.zeros(lanes * block, np.uint16)
    grid[:len(ids)] = ids
    steps = np.ascontiguousarray(grid.reshape(lanes, block).T)  # one row per step
    model, coder = _Model(lanes), _Encoder(lanes, 2 * block + 8)
    n, low, span = lanes, coder.low, coder.range
    for step in range(max(lengths)):
        if step == lengths[-1]:
            n = lanes - 1
            model.keep(n)
            coder.low[:lanes], coder.range[:lanes] = low, span
            low, span = low[:n], span[:n]
        x = steps[step, :n].astype(np.int32)
        a, b, c = model.predict()
        two = model.c[0] == x
        rest = ~(two | (model.c[1] == x))
        at = (x & (_CACHE - 1)) + model.at_cache
        cached = model.cache.take(at)
        known = rest & (cached >> 8 == x)
        raw = rest ^ known
        start = np.where(rest, np.where(known, b, c), ~two * a)
        stop = np.where(rest, np.where(known, c, 4096), np.where(two, a, b))
        low, span = coder.narrow(low, span >> _W12, start.astype(np.uint64), (stop - start).astype(np.uint64))
        held = known.nonzero()[0]
        if len(held):
            place = x[held] & (_CACHE - 1)
            some_low, some_span = low[held], span[held]
            rows = model.at_places[held]
            for symbol in (place >> 6, place >> 2 & 15):
                counts = model.place(rows)
                some_low, some_span = coder.narrow(some_low, some_span >> _W15, *_bounds(counts, symbol), held)
                model.learn_place(rows, counts, symbol)
                coder.shift(some_low, some_span, held)
                rows = rows + 1 + symbol
            low[held], span[held] = coder.narrow(some_low, some_span >> _W2, (place & 3).astype(np.uint64), _ONE, held)
        new = raw.nonzero()[0]
        if len(new):
            low[new], span[new] = coder.narrow(low[new], span[new] >> _W16, x[new].astype(np.uint64), _ONE, new)
        coder.shift(low, span)
        model.update(x, at, cached, rest, known)
    coder.low[:n], coder.range[:n] = low, span
    crcs = [zlib.crc32(grid[i * block:i * block + n].astype("<u4").tobytes()) for i, n in enumerate(lengths)]
    return coder.finish(), crcs


def decode(blocks: list[bytes], crcs: list[int], n_ids: int, block: int = BLOCK) -> np.ndarray:
    """The ids of the blocks; raises when a checksum does not fit."""
    lengths = _lengths(n_ids, block)
    if len(lengths) != len(blocks):
        raise ValueError(f"{len(blocks)} blocks for {n_ids} ids")
    if not lengths:
        return np.empty(0, np.uint16)
    lanes = len(lengths)
    steps = np.zeros((block, lanes), np.uint16)
    model, coder = _Model(lanes), _Decoder(blocks)
    n, code, span = lanes, coder.code, coder.range
    for step in range(max(lengths)):
        if step == lengths[-1]:
            n = lanes - 1
            model.keep(n)
            code, span = code[:n].copy(), span[:n].copy()
        a, b, c = model.predict()
        span >>= _W12
        part = (code // span).astype(np.int32)
        two, rest, raw = part < a, part >= b, part >= c
        known = rest ^ raw
        start = np.where(rest, np.where(known, b, c), ~two * a)
        stop = np.where(rest, np.where(known, c, 4096), np.where(two, a, b))
        code -= start.astype(np.uint64) * span
        span *= (stop - start).astype(np.uint64)
        x = np.where(two, model.c[0], model.c[1])
        held = known.nonzero()[0]
        if len(held):
            some, some_span = code[held], span[held]
            rows = model.at_places[held]
            place = 0
            for _ in range(2):
                counts = model.place(rows)
                some_span >>= _W15
                below = (counts <= np.minimum(some // some_span, _PLACES - 1).astype(np.int16)[:, None]).view(np.uint64)
                symbol = ((below[:, 0] + below[:, 1]) * _BYTES >> _W56).astype(np.int64) - 1
                start, width = _bounds(counts, symbol)
                some -= start * some_span
                some_span *= width
                model.learn_place(rows, counts, symbol)
                coder.shift(some, some_span, held)
                rows = rows + 1 + symbol
                place = place << 4 | symbol
            some_span >>= _W2
            low = some // some_span & _U(3)
            some -= low * some_span
            code[held], span[held] = some, some_span
            x[held] = model.cache.take(model.at_cache[held] + (place << 2 | low.astype(np.int64))) >> 8
        new = raw.nonzero()[0]
        if len(new):
            some_span = span[new] >> _W16
            index = code[new] // some_span & _LOW16
            code[new] -= index * some_span
            span[new] = some_span
            x[new] = index
        coder.shift(code, span)
        steps[step, :n] = x
        at = (x & (_CACHE - 1)) + model.at_cache
        model.update(x, at, model.cache.take(at), rest, known)
    grid = np.ascontiguousarray(steps.T)
    for i, (n, crc) in enumerate(zip(lengths, crcs)):
        if zlib.crc32(grid[i, :n].astype("<u4").tobytes()) != crc:
            raise ValueError(f"checksum of block {i} does not fit")
    return grid.reshape(-1)[:n_ids]
