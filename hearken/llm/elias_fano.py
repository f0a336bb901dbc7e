"""Elias-Fano coding of non-decreasing integers with a sampled select structure."""

from __future__ import annotations

import struct

import numpy as np

SAMPLE = 256
_HEAD = struct.Struct("<QQQBQQQ")


class EliasFano:
    """n values below 2**64: l low bits of each are packed; the high parts are a unary bit vector of about 2n bits.

    ``samples`` has the place of every SAMPLE-th set bit, so ``select`` looks at a bounded stretch of the vector; with it
    the whole takes near 2 + l bits a value, instead of 64.
    """

    def __init__(self, n: int, base: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.base, self.low_bits, self.low, self.high, self.samples = n, base, low_bits, low, high, samples

    @classmethod
    def encode(cls, values) -> EliasFano:
        values = np.asarray(values)
        n = len(values)
        if not n:
            empty = np.zeros(0, np.uint8)
            return cls(0, 0, 0, empty, empty, np.zeros(0, np.uint32))
        base = int(values[0])
        gaps = values.astype(np.int64).view(np.uint64) - np.uint64(base % 2**64)
        top = int(gaps[-1])
        low_bits = max(0, (top // n).bit_length() - 1) if top >= n else 0
        parts = gaps >> np.uint64(low_bits)
        spots = parts.astype(np.int64) + np.arange(n)
        bits = np.zeros(int(spots[-1]) + 1, np.uint8)
        bits[spots] = 1
        low = np.zeros(0, np.uint8)
        if low_bits:
            low = np.packbits(((gaps[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little")
        kind = np.uint32 if len(bits) < 2**32 else np.uint64
        return cls(n, base, low_bits, low, np.packbits(bits, bitorder="little"), spots[::SAMPLE].astype(kind))

    def _low(self, first: int, last: int) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(last - first, np.uint64)
        a, b = first * self.low_bits, last * self.low_bits
        bits = np.unpackbits(self.low[a // 8 : (b + 7) // 8], bitorder="little")[a % 8 : a % 8 + b - a]
        weights = np.uint64(1) << np.arange(self.low_bits, dtype=np.uint64)
        return (bits.reshape(-1, self.low_bits).astype(np.uint64) * weights).sum(axis=1, dtype=np.uint64)

    def _values(self, parts: np.ndarray, low: np.ndarray) -> np.ndarray:
        gaps = (parts.astype(np.uint64) << np.uint64(self.low_bits)) | low
        return (gaps + np.uint64(self.base % 2**64)).view(np.int64)

    def decode(self) -> np.ndarray:
        spots = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        return self._values(spots - np.arange(self.n), self._low(0, self.n))

    def select(self, i: int) -> int:
        """Value i, from the sample before it and the bits up to the next one."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        start = int(self.samples[i // SAMPLE])
        end = int(self.samples[i // SAMPLE + 1]) + 1 if i // SAMPLE + 1 < len(self.samples) else 8 * len(self.high)
        bits = np.unpackbits(self.high[start // 8 : (end + 7) // 8], bitorder="little")
        bits[: start % 8] = 0
        spot = start - start % 8 + int(np.flatnonzero(bits)[i % SAMPLE])
        return int(self._values(np.array([spot - i]), self._low(i, i + 1))[0])

    def to_bytes(self) -> bytes:
        head = _HEAD.pack(self.n, self.base % 2**64, self.low_bits, self.samples.itemsize, len(self.low), len(self.high), len(self.samples))
        return head + self.low.tobytes() + self.high.tobytes() + self.samples.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes, at: int = 0) -> tuple[EliasFano, int]:
        n, base, low_bits, width, n_low, n_high, n_samples = _HEAD.unpack_from(data, at)
        at += _HEAD.size
        low = np.frombuffer(data, np.uint8, n_low, at)
        high = np.frombuffer(data, np.uint8, n_high, at + n_low)
        samples = np.frombuffer(data, f"<u{width}", n_samples, at + n_low + n_high)
        return cls(n, base - 2**64 if base >= 2**63 else base, low_bits, low, high, samples), at + n_low + n_high + n_samples * width
