"""Prefix polynomial hashes over bytes, vectorised with numpy."""

from __future__ import annotations

import numpy as np

U = np.uint64


class Rolling:
    """Hashes of all substrings of a buffer, modulo 2**64, from one running sum.

    Bytes are mapped to random odd 64-bit numbers, so short texts fill the word;
    the base is odd and so has an inverse, which moves a substring to the origin.
    Equal hashes must be verified on the bytes where exactness matters.
    """

    def __init__(self, seed: int = 1, base: int = 0x9E3779B97F4A7C15) -> None:
        self.table = np.random.default_rng(seed).integers(0, 2**64, 256, dtype=U) | U(1)
        self.base, self.inverse = base | 1, pow(base | 1, -1, 2**64)
        self.up = self.down = np.ones(1, U)

    def _grow(self, n: int) -> None:
        if len(self.up) < n:
            n = 1 << (n - 1).bit_length()
            for name, b in (("up", self.base), ("down", self.inverse)):
                powers = np.full(n, b, U)
                powers[0] = 1
                setattr(self, name, np.multiply.accumulate(powers))

    def prefix(self, data: np.ndarray) -> np.ndarray:
        self._grow(len(data) + 1)
        out = np.zeros(len(data) + 1, U)
        np.cumsum(self.table[data] * self.up[: len(data)], out=out[1:])
        return out

    def span(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Mixed hashes of the substrings [start, end)."""
        return mix((prefix[end] - prefix[start]) * self.down[start])


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers starts[i], starts[i] + 1, ... (lengths[i] of them), one run after the other."""
    total = int(lengths.sum())
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow string column without nulls, and the n + 1 offsets of its rows."""
    import pyarrow as pa

    width = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    if not len(column) or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]
