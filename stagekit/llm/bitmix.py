"""Logistic mixing of hashed-context bit predictors (numpy only).

A predictor is a table of zeros and ones seen in each slot. Symbols are read four bits at a time: a hash
of a context and of the bits before them finds a block of 16 slots, in which the bits already known of the
four find the slot. Predictions of all orders are mixed in the logistic domain with weights that a gate
selects (how many orders know the context, how often the highest of them has seen it, and how deep in the
symbol the bit is). The mixed chance is refined by an adaptive table of (gate, chance). Counts are exact
up to 31 and kept in eighths of a doubling beyond.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np

DEPTHS, SEEN, CELLS = 4, 4, 33
#: Slots of an order, as a power of two, at most and at least; slots of a chunk on its way.
MOST_BITS, LEAST_BITS, CHUNK_BITS = 22, 12, 12
#: Counts of a tally that are carried over.
CARRY = 1 << 15
#: Steps of the mixed value in the tables of a scorer, and its bound.
FINE, BOUND = 32, 12
#: Bits that a step of the fit stands for, and steps at most.
RUN, STEPS = 400_000, 100
_K = [np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]
_VALUE = np.where(np.arange(256) < 32, np.arange(256), 32 * 2.0 ** ((np.arange(256) - 32) / 8))


def pack(counts: np.ndarray) -> np.ndarray:
    """(slots, 2) counts of zeros and ones to one uint16 a slot."""
    n = counts.astype(np.int64)
    q = n.clip(0, 255).astype(np.uint16)
    large = np.nonzero(n >= 32)
    q[large] = np.minimum(32 + np.floor(8 * np.log2(n[large] / 32)), 255)
    return q[:, 0] << 8 | q[:, 1]


def _lists() -> tuple[np.ndarray, np.ndarray]:
    """By what is left out (nothing, a zero, a one) and packed counts: stretched chance, and times seen up to 3."""
    stretch, seen = [], []
    for zero, one in ((0, 0), (1, 0), (0, 1)):
        n0 = np.maximum(np.repeat(_VALUE, 256) - zero, 0)
        n1 = np.maximum(np.tile(_VALUE, 256) - one, 0)
        stretch.append(np.clip(np.log((n1 + 0.3) / (n0 + 0.3)), -9, 9).astype(np.float32))
        seen.append(np.minimum(n0 + n1, SEEN - 1).astype(np.int16))
    return np.concatenate(stretch), np.concatenate(seen)


_STRETCH, _SEEN = _lists()


def _levels(step: float) -> tuple[np.ndarray, np.ndarray]:
    """Levels of ``_STRETCH``, and the stretched chance of each: one for each pair of counts seen up to twice, then steps."""
    grid = np.rint(_STRETCH / step).astype(np.int64)
    rare = _SEEN < SEEN - 1
    # times seen (up to 3), then the chance itself or its step
    key = _SEEN.astype(np.int64) << 32 | np.where(rare, np.rint(_STRETCH * 1000).astype(np.int64), grid) + (1 << 16)
    names, first, level = np.unique(key, return_index=True, return_inverse=True)
    mid = np.where(rare[first], _STRETCH[first], grid[first] * step)
    return level.astype(np.int32), np.stack([mid, _SEEN[first]], axis=1)


#: Steps of the stretched chances that the weights are fitted on, by number of orders.
STEP_OF = {3: 0.5, 4: 1.0}
_LEVELS = {orders: _levels(step) for orders, step in STEP_OF.items()}


def table_bits(events: float) -> int:
    """Slots an order, as a power of two, for this many bit events: two thirds full at most, within the bounds."""
    return int(np.clip(np.ceil(np.log2(max(events, 1) * 1.5)), LEAST_BITS, MOST_BITS))


def blocks_of(ctx: np.ndarray, before: np.ndarray, bits: int) -> np.ndarray:
    """First slots of the blocks of (orders, n) context hashes behind the bits before; each order has its own part."""
    h = (ctx + before.astype(np.uint64) * _K[1]) * _K[0]
    h ^= h >> np.uint64(32)
    h *= _K[2]
    out = (h >> np.uint64(68 - bits)).astype(np.int32) << 4
    out += (np.arange(len(ctx), dtype=np.int32) << bits)[:, None]
    return out


def add(counts: np.ndarray, slots: np.ndarray, bit: np.ndarray) -> None:
    for each in slots:
        np.add.at(counts, each.astype(np.int64) * 2 + bit, np.uint32(1))


def _at(values: np.ndarray, places: np.ndarray) -> np.ndarray:
    """``values[places]``, of places that are all there, in a fraction of its time."""
    return values.take(places, mode="clip")


class Tally:
    """Zeros and ones seen in each slot, exactly: 15 bits each, and a list of what goes beyond them."""

    def __init__(self, slots: int):
        self.low, self.beyond = np.zeros(slots * 2, np.uint16), Counter()

    def add(self, slots: np.ndarray, bit: np.ndarray) -> None:
        for each in slots:
            places = each.astype(np.int64) * 2 + bit
            for at in range(0, len(places), CARRY):
                run = places[at : at + CARRY]
                np.add.at(self.low, run, np.uint16(1))
                full = _at(self.low, run) >= CARRY
                if full.any():
                    full = np.unique(run[full])
                    for place, n in zip(full.tolist(), self.low[full].tolist()):
                        self.beyond[place] += n
                    self.low[full] = 0

    def chunks(self):
        """Number and counts of each run of ``CHUNK_BITS`` slots that has any, in 16 bits, or in 64 where some need more."""
        beyond = defaultdict(list)
        for place, n in self.beyond.items():
            beyond[place >> CHUNK_BITS + 1].append((place & (2 << CHUNK_BITS) - 1, n))
        for i, chunk in enumerate(self.low.reshape(-1, 2 << CHUNK_BITS)):
            if i in beyond:
                chunk = chunk.astype(np.int64)
                for place, n in beyond[i]:
                    chunk[place] += n
            if chunk.any():
                yield i, chunk


class Mixer:
    """Packed counts of the predictors, weights a gate, and the adaptive refinement of the mixed chance."""

    def __init__(self, orders: int, table: np.ndarray, weights: np.ndarray | None = None, cells: np.ndarray | None = None):
        self.orders, self.table = orders, table
        seen = np.arange(SEEN**orders)[:, None] // SEEN ** np.arange(orders) % SEEN
        top = seen[np.arange(len(seen)), np.where(seen > 0, np.arange(orders), -1).max(axis=1)]
        #: Gate (less the depth) by how often each order has seen the context, as digits.
        self.gate_of = (((seen > 0).sum(axis=1) * SEEN + top) * DEPTHS).astype(np.int16)
        self.gates = (orders + 1) * SEEN * DEPTHS
        self.weights = np.full((self.gates, orders + 1), 0.4, np.float32) if weights is None else weights.astype(np.float32)
        self.cells = np.zeros((self.gates * CELLS, 2)) if cells is None else cells
        self.logs = None

    def _mixed(self, slots, depth):
        packed = [_at(self.table, s).astype(np.int64) for s in slots]
        digits = _at(_SEEN, packed[0])
        for k in range(1, self.orders):
            digits += _at(_SEEN, packed[k]) << (2 * k)
        gate = _at(self.gate_of, digits.astype(np.int64)).astype(np.int64)
        gate += depth
        columns = np.ascontiguousarray(self.weights.T)
        s = _at(columns[-1], gate)
        s *= np.float32(0.3)
        for i in range(self.orders):
            x = _at(_STRETCH, packed[i])
            x *= _at(columns[i], gate)
            s += x
        np.clip(s, -BOUND, BOUND, out=s)
        return gate, s

    @staticmethod
    def _cell(gate: np.ndarray, s: np.ndarray) -> np.ndarray:
        return gate.astype(np.int32) * CELLS + np.rint(np.clip(s, -8, 8) * 2).astype(np.int32) + 16

    @property
    def cases(self) -> int:
        """Number of cases that ``case_of`` tells apart."""
        return len(_LEVELS[self.orders][1]) ** self.orders * DEPTHS * 2

    def case_of(self, slots, depth, bit) -> np.ndarray:
        """All that the weights learn from a bit: the levels of its predictors without it, its depth and itself."""
        level, mids = _LEVELS[self.orders]
        left = (bit.astype(np.int64) + 1) << 16  # each event is left out of its own counts
        case = np.zeros(len(bit), np.int32)
        for s in slots:
            case *= len(mids)
            case += _at(level, _at(self.table, s) + left)
        case *= DEPTHS * 2
        case += bit
        case += 2 * depth
        return case

    def fit(self, cases: np.ndarray, times: np.ndarray) -> None:
        """Weights and refinement from how often each case occurs."""
        mids = _LEVELS[self.orders][1]
        rest, bit = np.divmod(cases.astype(np.int64), 2)
        rest, depth = np.divmod(rest, DEPTHS)
        x, digits = [np.full(len(rest), 0.3)], np.zeros(len(rest), np.int64)
        for k in reversed(range(self.orders)):
            rest, level = np.divmod(rest, len(mids))
            x.append(mids[level, 0])
            digits += mids[level, 1].astype(np.int64) << (2 * k)
        x = np.array(x[:0:-1] + x[:1])
        gate, times = self.gate_of[digits].astype(np.int64) + depth, times.astype(float)

        def mixed():
            return np.clip((self.weights[gate].T * x).sum(axis=0), -BOUND, BOUND)

        def sums(v):
            return np.bincount(gate, v, self.gates)

        # a step for each run of so many bits, as if the weights followed them one run after another
        steps = int(min(STEPS, np.ceil(times.sum() / RUN)))
        square = np.stack([sums(times * v * v) for v in x], axis=1) * 0.25 + 20
        for _ in range(steps):
            error = times * (bit - 1 / (1 + np.exp(-mixed())))
            self.weights += (0.3 * np.stack([sums(error * v) for v in x], axis=1) / square).astype(np.float32)
        s = mixed()
        cell = self._cell(gate, s) * 2 + bit
        self.cells = np.bincount(cell, times, self.gates * CELLS * 2).reshape(-1, 2)

    def _chances(self) -> np.ndarray:
        """Chance of a one by gate and mixed value, in steps of 1 / FINE: half the mixed one, half the refined."""
        s = np.arange(-BOUND * FINE, BOUND * FINE + 1) / FINE
        zero, one = self.cells.T
        prior = np.tile(1 / (1 + np.exp(-(np.arange(CELLS) - 16) / 2)), self.gates)
        refined = (one + 8 * prior) / (zero + one + 8)
        gate = np.repeat(np.arange(self.gates), len(s))
        mixed = np.tile(1 / (1 + np.exp(-s)), self.gates)
        return np.clip(0.5 * (mixed + refined[self._cell(gate, np.tile(s, self.gates))]), 1e-6, 1 - 1e-6)

    def log10(self, slots, depth, bit) -> np.ndarray:
        """log10 of the chance of each bit."""
        if self.logs is None:
            p = self._chances()
            self.logs = np.log10(np.stack([1 - p, p], axis=1)).astype(np.float32).ravel()
        gate, s = self._mixed(slots, depth)
        s += BOUND
        s *= FINE
        gate *= 2 * BOUND * FINE + 1
        gate += np.rint(s).astype(np.int32)
        gate *= 2
        gate += bit
        return _at(self.logs, gate)


#: Contexts of a token's code: none, the token before, and the two before.
TOKEN_ORDERS, BYTE_ORDERS = 3, 4


def code_walk(hashes: np.ndarray, place: np.ndarray, code: np.ndarray, size: np.ndarray, bits: int):
    """Bits of the codes of a run of tokens, level by level: which tokens, their slots, depth and bits.

    ``place`` is a token's place in its text: contexts do not reach over the beginning.
    """
    ctx = np.zeros((TOKEN_ORDERS, len(hashes)), np.uint64)
    h = np.zeros(len(hashes), np.uint64)
    for k in range(1, TOKEN_ORDERS):
        before = np.zeros(len(hashes), np.uint64)
        before[k:] = hashes[:-k]
        before[place < k] = 0
        h = (h + before + np.uint64(k)) * _K[k]
        h ^= h >> np.uint64(29)
        ctx[k] = h
    live, block, node = np.arange(len(hashes)), None, None
    for b in range(int(size.max()) if len(size) else 0):
        stay = size > b
        if not stay.all():
            stay = np.flatnonzero(stay)
            live, ctx, code, size = _at(live, stay), ctx.take(stay, axis=1, mode="clip"), _at(code, stay), _at(size, stay)
            if b % 4:
                block, node = block.take(stay, axis=1, mode="clip"), _at(node, stay)
        left = (size - b).astype(np.uint64)
        if b % 4 == 0:
            block, node = blocks_of(ctx, code >> left | np.uint64(1 << b), bits), np.ones(len(live), np.int32)
        bit = (code >> (left - np.uint64(1)) & np.uint64(1)).astype(np.int32)
        yield live, block + node, min(b // 4, DEPTHS - 1), bit
        node = node * 2 + bit


def flat_bytes(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All bytes with an end byte after each word, their places in the words, and where words begin."""
    data = np.frombuffer(b" ".join(words) + b" ", np.uint8)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 1
    first = np.cumsum(size) - size
    return data, np.arange(len(data)) - np.repeat(first, size), first


def byte_walk(data: np.ndarray, place: np.ndarray, bits: int):
    """Bits of spelled words: slots, depth, bits. Contexts are the last one to four bytes of the word, the first two with the place."""
    ctx = np.zeros((BYTE_ORDERS, len(data)), np.uint64)
    h = np.zeros(len(data), np.uint64)
    for k in range(1, BYTE_ORDERS + 1):
        before = np.zeros(len(data), np.uint64)
        before[k:] = data[:-k]
        before[place < k] = 0
        h = (h + before + np.uint64(1)) * _K[k - 1]
        h ^= h >> np.uint64(31)
        ctx[k - 1] = h + np.minimum(place, 3).astype(np.uint64) * _K[0] if k <= 2 else h
    for j in range(8):
        if j % 4 == 0:
            block, node = blocks_of(ctx, (data >> (8 - j)).astype(np.uint64) + np.uint64(j) if j else np.zeros(len(data), np.uint64), bits), np.ones(len(data), np.int32)
        bit = (data >> (7 - j) & 1).astype(np.int32)
        yield block + node, j // 2, bit
        node = node * 2 + bit
