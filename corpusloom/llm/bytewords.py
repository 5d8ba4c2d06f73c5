"""Words of many texts at once, from the bytes of an Arrow column: places and 128-bit hashes, without a Python object each.

A word is a run of bytes that aren't ASCII white space, which in UTF-8 is the same as a run of characters that aren't. Its
hashes are polynomials in two odd bases modulo 2 ** 64, read off prefix sums, then scrambled.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of texts that are taken at once; a longer text is taken alone.
STEP_BYTES = 1 << 21
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
U = np.uint64
_IS_WORD = np.ones(256, bool)
_IS_WORD[[32, 9, 10, 11, 12, 13]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mixed(x: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit numbers."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Powers:
    """Powers of a base and of its inverse, as many as were asked for."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, U)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = n + n // 8
            self.up, self.down = (np.cumprod(np.concatenate([np.ones(1, U), np.full(size - 1, b, U)]), dtype=U) for b in (self.base, self.inverse))
        return self.up, self.down


@dataclass
class Words:
    """Words of the rows first..first + rows of a batch. raw: the bytes; doc: each word's row; begin: the first word of each row, and the end."""

    first: int
    rows: int
    raw: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    begin: np.ndarray
    hashes: tuple[np.ndarray, ...]


class Splitter:
    def __init__(self, lower: bool = False, hashes: int = 2, step_bytes: int = STEP_BYTES):
        self.lower, self.step_bytes = lower, step_bytes
        self.powers = [Powers(b) for b in BASES[:hashes]]

    def __call__(self, column: pa.Array):
        """Words of the column's texts, step by step."""
        if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
            offsets = np.frombuffer(column.buffers()[1], np.int64)
        else:
            offsets = np.frombuffer(column.buffers()[1], np.int32).astype(np.int64) if column.buffers()[1] is not None else np.zeros(1, np.int64)
        offsets = offsets[column.offset : column.offset + len(column) + 1]
        data = column.buffers()[2]
        raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        a = 0
        while a < len(column):
            b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + self.step_bytes, "right")) - 1)
            yield self.step(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], a)
            a = b

    def step(self, raw: np.ndarray, offsets: np.ndarray, first: int) -> Words:
        if self.lower:
            raw = _LOWER[raw]
        n, rows = len(raw), len(offsets) - 1
        inside = np.zeros(n + 2, bool)
        inside[1:-1] = _IS_WORD[raw]
        cut = np.zeros(n + 1, bool)
        cut[offsets] = True
        start = np.flatnonzero(inside[1:] & (~inside[:-1] | cut))
        end = np.flatnonzero(inside[:-1] & (~inside[1:] | cut))
        begin = np.searchsorted(start, offsets)
        doc = np.repeat(np.arange(rows), np.diff(begin))
        out = []
        wide = raw.astype(U) + U(1)
        for p in self.powers:
            up, down = p.upto(n + 1)
            total = np.zeros(n + 1, U)
            np.cumsum(wide * up[:n], out=total[1:])
            out.append(mixed((total[end] - total[start]) * down[start] + (end - start).astype(U)))
        return Words(first, rows, raw, start, end, doc, begin, tuple(out))
