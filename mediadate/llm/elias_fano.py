"""Elias-Fano coded monotone sequences in flat buffers, queried a whole array at a time."""

from __future__ import annotations

import numpy as np

BLOCK = 8  # words of high bits for which the ones before are stored
STEP = 32  # every so many values one is stored whole, if asked for
_ONE = np.uint64(1)


def _select_table() -> np.ndarray:
    """For a byte and r: the place of its r-th set bit (8 if it has fewer)."""
    table = np.full((256, 8), 8, np.uint8)
    for byte in range(256):
        places = [k for k in range(8) if byte >> k & 1]
        table[byte, : len(places)] = places
    return table


_TABLE = _select_table()


def _pack_bits(bits: np.ndarray) -> np.ndarray:
    packed = np.packbits(bits, bitorder="little")
    packed = np.pad(packed, (0, -len(packed) % 8)).view(np.uint64)
    return np.pad(packed, (0, -len(packed) % BLOCK))


def encode(values: np.ndarray, universe: int, sampled: bool = False) -> dict[str, np.ndarray]:
    """Parts of the code of ascending values below ``universe``: about 2 + log2(universe / n) bits each.

    ``sampled`` adds every ``STEP``-th value as it is, 2 bits each, for searches in long runs of equal high bits.
    """
    values = values.astype(np.uint64)
    n = len(values)
    low = max(0, (universe // max(1, n)).bit_length() - 1)
    packed = []
    for k in range(0, n, 1 << 16):  # a multiple of 64 values, so parts end at whole words
        bits = np.unpackbits(values[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        packed.append(np.packbits(bits[:, :low].reshape(-1), bitorder="little"))
    lows = np.concatenate(packed) if packed else np.zeros(0, np.uint8)
    high = (values >> np.uint64(low)).astype(np.int64)
    bits = np.zeros(n + (universe >> low) + 2, bool)
    bits[high + np.arange(n)] = True
    highs = _pack_bits(bits)
    counts = np.add.reduceat(np.bitwise_count(highs).astype(np.uint64), np.arange(0, len(highs), BLOCK))
    ones = np.cumsum(counts) - counts
    return {
        "head": np.array([n, low], np.uint64),
        "lows": np.pad(lows, (0, -len(lows) % 8 + 16)).view(np.uint64),
        "highs": highs,
        "ones": ones,
        "zeros": np.arange(len(ones), dtype=np.uint64) * np.uint64(64 * BLOCK) - ones,
    } | ({"samples": values[::STEP]} if sampled else {})


class EliasFano:
    """Reads the parts that ``encode`` makes, in place."""

    def __init__(self, parts: dict[str, np.ndarray]):
        self.n, self.low = map(int, parts["head"])
        self.lows, self.highs, self.zeros, self.ones = (parts[k] for k in ("lows", "highs", "zeros", "ones"))
        self.mask = np.uint64((1 << self.low) - 1)
        self.samples = parts.get("samples")

    def _low(self, index: np.ndarray) -> np.ndarray:
        if self.low == 0:
            return np.zeros(len(index), np.uint64)
        place = index.astype(np.uint64) * np.uint64(self.low)
        word, shift = (place >> np.uint64(6)).astype(np.int64), place & np.uint64(63)
        above = (self.lows[word + 1] << _ONE) << (np.uint64(63) - shift)
        return (self.lows[word] >> shift | above) & self.mask

    def _select(self, rank: np.ndarray, before: np.ndarray, flip: bool) -> np.ndarray:
        """Places of the rank-th one (or zero, if flipped) among the high bits."""
        block = np.searchsorted(before, rank.astype(np.uint64), "right") - 1
        rest = rank - before[block].astype(np.int64)
        word = block * BLOCK
        full = np.uint64(0xFFFFFFFFFFFFFFFF)
        bits = self.highs[word] ^ full if flip else self.highs[word]
        count = np.bitwise_count(bits).astype(np.int64)
        open_ = np.flatnonzero(rest >= count)
        while len(open_):  # BLOCK times at most
            rest[open_] -= count[open_]
            word[open_] += 1
            more = self.highs[word[open_]] ^ full if flip else self.highs[word[open_]]
            bits[open_] = more
            count[open_] = np.bitwise_count(more)
            open_ = open_[rest[open_] >= count[open_]]
        # inside the word: go to the upper half whenever the lower one has too few
        place = word << 6
        for half in (32, 16, 8):
            lower = np.bitwise_count(bits & np.uint64((1 << half) - 1)).astype(np.int64)
            up = rest >= lower
            rest -= lower * up
            bits >>= (up * half).astype(np.uint64)
            place += up * half
        return place + _TABLE[(bits & np.uint64(255)).astype(np.int64), rest]

    def get(self, index: np.ndarray) -> np.ndarray:
        """The values at these indices."""
        index = index.astype(np.int64)
        high = self._select(index.copy(), self.ones, False) - index
        return (high.astype(np.uint64) << np.uint64(self.low)) | self._low(index)

    def find(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the first value that is not below the wanted one, and whether it is equal.

        Wanted values share the values' universe. The values with equal high bits begin after a zero;
        most are found in a step or two, and long runs are bisected up to the next zero.
        """
        wanted = wanted.astype(np.uint64)
        high, low = (wanted >> np.uint64(self.low)).astype(np.int64), wanted & self.mask
        if self.samples is None:
            return self._find(high, low, np.zeros(len(wanted), np.int64), np.full(len(wanted), self.n))
        # the first value that is not below lies behind the last sample that is, up to the next sample
        block = np.searchsorted(self.samples, wanted)
        least, most = np.maximum((block - 1) * STEP + 1, 0), np.minimum(block * STEP, self.n)
        own = (self.samples >> np.uint64(self.low)).astype(np.int64)
        own = np.concatenate([[-1], own, [-1]])
        inside = (own[block] == high) & (own[block + 1] == high)
        start, equal = np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
        part = np.flatnonzero(inside)
        start[part], equal[part] = self._bisect(least[part], most[part], most[part] + 1, low[part])
        part = np.flatnonzero(~inside)
        start[part], equal[part] = self._find(high[part], low[part], least[part], most[part])
        return start, equal

    def _find(self, high: np.ndarray, low: np.ndarray, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``find`` by high and low bits, when the index is known to lie between ``least`` and ``most``."""
        place = np.zeros(len(high), np.int64)
        inner = np.flatnonzero(high > 0)
        place[inner] = self._select(high[inner] - 1, self.zeros, True) + 1
        place = np.maximum(place, least + high)
        equal = np.zeros(len(high), bool)
        active = np.arange(len(high))
        for _ in range(2):
            own = place[active]
            inside = (self.highs[own >> 6] >> (own & 63).astype(np.uint64)) & _ONE == 1
            active, own = active[inside], own[inside]
            found = self._low(own - high[active])
            equal[active] = found == low[active]
            active = active[found < low[active]]
            place[active] += 1
        start = place - high
        if len(active):
            end = self._select(high[active], self.zeros, True) - high[active]
            start[active], equal[active] = self._bisect(start[active], np.minimum(end, most[active]), end, low[active])
        return start, equal

    def _bisect(self, start: np.ndarray, stop: np.ndarray, end: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first index from ``start`` to ``stop`` whose low bits are not below; values of equal high bits go on to ``end``."""
        start, stop = start.copy(), stop.copy()
        active = np.flatnonzero(start < stop)
        while len(active):
            middle = (start[active] + stop[active]) >> 1
            below = self._low(middle) < low[active]
            start[active[below]] = middle[below] + 1
            stop[active[~below]] = middle[~below]
            active = active[start[active] < stop[active]]
        equal = np.zeros(len(start), bool)
        there = np.flatnonzero(start < end)
        equal[there] = self._low(start[there]) == low[there]
        return start, equal
