"""Elias-Fano coding of ascending integers: about 2 + log2(universe / n) bits each."""

from __future__ import annotations

import numpy as np

SAMPLE = 64  #: ones between two entries of the select table


class EliasFano:
    """n ascending integers in [0, universe]: low bits packed side by side, high bits as gaps in unary.

    select(i) finds the i-th one of the high bits from a sampled 32-bit table and a short scan, and
    returns the i-th value; values() returns all. Runs of equal values and n = 0 are fine.
    """

    def __init__(self, n: int, universe: int, low: bytes, high: bytes, samples: bytes):
        self.n, self.universe, self.low, self.high, self.samples = n, universe, low, high, samples
        self.width = low_width(n, universe)

    @classmethod
    def encode(cls, values: np.ndarray, universe: int) -> EliasFano:
        values = np.asarray(values, np.int64)
        n, w = len(values), low_width(len(values), universe)
        if n and (values[0] < 0 or values[-1] > universe or np.any(np.diff(values) < 0)):
            raise ValueError("values must ascend within the universe")
        bits = ((values[:, None] >> np.arange(w)) & 1).astype(np.uint8).ravel()
        ones = (values >> w) + np.arange(n)
        high = np.zeros(int(universe >> w) + n + 1, np.uint8)
        high[ones] = 1
        return cls(
            n, universe, np.packbits(bits, bitorder="little").tobytes(), np.packbits(high, bitorder="little").tobytes(),
            ones[::SAMPLE].astype("<u4").tobytes(),
        )

    def values(self) -> np.ndarray:
        ones = np.flatnonzero(np.unpackbits(np.frombuffer(self.high, np.uint8), bitorder="little"))[: self.n]
        out = (ones - np.arange(self.n)).astype(np.int64) << self.width
        if self.width and self.n:
            bits = np.unpackbits(np.frombuffer(self.low, np.uint8), bitorder="little")[: self.n * self.width]
            out |= bits.reshape(self.n, self.width).astype(np.int64) @ (1 << np.arange(self.width, dtype=np.int64))
        return out

    def select(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        at = int(np.frombuffer(self.samples, "<u4")[i // SAMPLE])
        left = i % SAMPLE
        byte = at >> 3
        word = self.high[byte] & (0xFF << (at & 7)) & 0xFF
        while (ones := word.bit_count()) <= left:
            left -= ones
            byte += 1
            word = self.high[byte]
        for _ in range(left):
            word &= word - 1
        at = (byte << 3) + (word & -word).bit_length() - 1
        low = 0
        if self.width:
            from_bit = i * self.width
            span = int.from_bytes(self.low[from_bit >> 3 : (from_bit + self.width + 7) >> 3], "little")
            low = (span >> (from_bit & 7)) & ((1 << self.width) - 1)
        return ((at - i) << self.width) | low

    def select_many(self, which: np.ndarray) -> np.ndarray:
        """The values at the places `which`, each from its entry of the sampled table and the bytes after it."""
        which = np.asarray(which, np.int64)
        if not len(which):
            return np.zeros(0, np.int64)
        if which.min() < 0 or which.max() >= self.n:
            raise IndexError("no such place")
        high = np.frombuffer(self.high, np.uint8)
        at = np.frombuffer(self.samples, "<u4")[which // SAMPLE].astype(np.int64)
        left, byte = which % SAMPLE, at >> 3
        word = high[byte] & (0xFF << (at & 7)) & 0xFF
        live = np.arange(len(which))
        while len(live):
            ones = np.bitwise_count(word[live].astype(np.uint8)).astype(np.int64)
            live, ones = live[ones <= left[live]], ones[ones <= left[live]]
            left[live] -= ones
            byte[live] += 1
            word[live] = high[byte[live]]
        out = ((byte << 3) + BYTE_SELECT[word, left] - which) << self.width
        if self.width:
            low = np.frombuffer(self.low, np.uint8)
            bits = which[:, None] * self.width + np.arange(self.width)
            out |= ((low[bits >> 3] >> (bits & 7)) & 1).astype(np.int64) @ (1 << np.arange(self.width, dtype=np.int64))
        return out


def byte_select() -> np.ndarray:
    """Place of the k-th set bit of each byte (row), 0 where there is none."""
    table = np.zeros((256, 8), np.int64)
    for byte in range(256):
        for k, bit in enumerate(b for b in range(8) if byte >> b & 1):
            table[byte, k] = bit
    return table


BYTE_SELECT = byte_select()


def low_width(n: int, universe: int) -> int:
    return max(0, (universe // n).bit_length() - 1) if n else 0
