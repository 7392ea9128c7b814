"""MurmurHash64A over columns of keys, and bloom filters on it (numpy, no loop over rows)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.codec import bloom_shape

# Fixed values of the public algorithm and of the filter's two seeds.
_MULTIPLIER = np.uint64(0xC6A4A7935BD1E995)
_SHIFT = np.uint64(47)
SEEDS = (0xDEADBEEF12345678, 0xCAFEBABE87654321)


def murmur64(keys: list[bytes], seed: int) -> np.ndarray:
    """Hashes of all keys: the keys are a matrix of 8-byte words, mixed column by column."""
    size = np.fromiter(map(len, keys), np.int64, len(keys))
    width = int(size.max(initial=0)) // 8 + 1
    words = np.frombuffer(b"".join(k.ljust(8 * width, b"\0") for k in keys), "<u8").reshape(len(keys), width)
    h = np.uint64(seed) ^ (size.astype(np.uint64) * _MULTIPLIER)
    whole, tail = size // 8, size % 8
    for c in range(width):
        k = words[:, c] * _MULTIPLIER
        k = (k ^ (k >> _SHIFT)) * _MULTIPLIER
        full = (h ^ k) * _MULTIPLIER
        rest = (h ^ words[:, c]) * _MULTIPLIER
        h = np.where(c < whole, full, np.where((c == whole) & (tail > 0), rest, h))
    h = (h ^ (h >> _SHIFT)) * _MULTIPLIER
    return h ^ (h >> _SHIFT)


@F.pandas_udf(T.LongType())
def murmur64_column(keys: pd.Series, seeds: pd.Series) -> pd.Series:
    """The hash as a signed long; one seed (a literal) for a batch."""
    own = [k.encode() if isinstance(k, str) else bytes(k or b"") for k in keys]
    return pd.Series(murmur64(own, int(seeds.iloc[0]) % (1 << 64)).view(np.int64)) if own else pd.Series([], dtype="int64")


class Bloom:
    """A bit array with double hashing: position i is (h1 + i * h2) mod 2**64 mod m."""

    def __init__(self, m: int, k: int, bits: np.ndarray | None = None) -> None:
        self.m, self.k = m, k
        self.bits = np.zeros(m, bool) if bits is None else bits

    @classmethod
    def build(cls, keys: list[bytes], p: float = 0.01) -> Bloom:
        out = cls(*bloom_shape(max(1, len(keys)), p))
        if keys:
            out.bits[out._positions(keys).ravel()] = True
        return out

    def _positions(self, keys: list[bytes]) -> np.ndarray:
        a, b = (murmur64(keys, s) for s in SEEDS)
        return ((a[:, None] + np.arange(self.k, dtype=np.uint64)[None, :] * b[:, None]) % np.uint64(self.m)).astype(np.int64)

    def might_contain(self, keys: list[bytes]) -> np.ndarray:
        return self.bits[self._positions(keys)].all(axis=1) if keys else np.zeros(0, bool)

    def to_bytes(self) -> bytes:
        return self.m.to_bytes(4, "big") + bytes([self.k]) + np.packbits(self.bits, bitorder="little").tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> Bloom:
        """A section whose size does not fit its header is an error, not an empty filter."""
        m, k = int.from_bytes(raw[:4], "big"), raw[4] if len(raw) > 4 else 0
        if len(raw) != 5 + (m + 7) // 8 or not m:
            raise ValueError("bloom section of a wrong size")
        return cls(m, k, np.unpackbits(np.frombuffer(raw, np.uint8, offset=5), count=m, bitorder="little").astype(bool))
