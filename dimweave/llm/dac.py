"""Directly addressable codes: unsigned integers split into 8-bit chunks, one level per chunk.

Level 0 holds the low byte of every value, level k the next byte of the values that have one. Each
level but the last has a continuation bitmap (bit i: value i of this level goes on in the next) and a
rank directory (set bits before every block of ``BLOCK`` bits), so the place of value i in the next
level is the rank of its bit: any value is read by itself, without decoding what lies before it.

Layout: ``DAC1``, number of levels (u32), values per level (u64 each), then per level its bytes and,
except for the last level, its bitmap (bits in little order) and its directory (u64 per block).
"""

from __future__ import annotations

import struct

import numpy as np

MAGIC = b"DAC1"
BLOCK = 512


def encode(values: np.ndarray) -> bytes:
    """The coded form of non-negative integers below 2**64."""
    rest = np.asarray(values, dtype="<u8")
    sizes, parts = [], []
    while True:
        sizes.append(len(rest))
        parts.append((rest & 0xFF).astype("u1").tobytes())
        more = rest > 0xFF
        if not more.any():
            break
        bits = np.packbits(more, bitorder="little")
        starts = np.arange(0, len(more), BLOCK)
        before = np.concatenate(([0], np.cumsum(np.add.reduceat(more, starts, dtype="<u8"))[:-1])).astype("<u8")
        parts += [bits.tobytes(), before.tobytes()]
        rest = rest[more] >> np.uint64(8)
    return MAGIC + struct.pack(f"<I{len(sizes)}Q", len(sizes), *sizes) + b"".join(parts)


class DAC:
    """Random access to the values coded in ``data``; nothing is decoded until it is asked for."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a DAC1 file")
        (levels,) = struct.unpack_from("<I", data, 4)
        sizes = struct.unpack_from(f"<{levels}Q", data, 8)
        at, self.levels = 8 + 8 * levels, []
        for k, n in enumerate(sizes):
            low = np.frombuffer(data, "u1", n, at)
            at += n
            bits = before = None
            if k < levels - 1:
                bits = np.frombuffer(data, "u1", -(-n // 8), at)
                at += len(bits)
                before = np.frombuffer(data, "<u8", -(-n // BLOCK), at)
                at += 8 * len(before)
            self.levels.append((low, bits, before))

    def __len__(self) -> int:
        return len(self.levels[0][0])

    @staticmethod
    def _rank(bits: np.ndarray, before: np.ndarray, i: int) -> int:
        """Set bits before place ``i``: the block's directory entry and the bits within the block."""
        if not i:
            return 0
        block = (i - 1) // BLOCK
        within = int.from_bytes(bits[block * BLOCK // 8:-(-i // 8)].tobytes(), "little") & ((1 << (i - block * BLOCK)) - 1)
        return int(before[block]) + within.bit_count()

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < len(self):
            raise IndexError(i)
        value = 0
        for k, (low, bits, before) in enumerate(self.levels):
            value |= int(low[i]) << 8 * k
            if bits is None or not bits[i // 8] >> i % 8 & 1:
                break
            i = self._rank(bits, before, i)
        return value

    def between(self, start: int, end: int) -> np.ndarray:
        """Values ``start`` to ``end`` (not included): two rank queries a level find their chunks."""
        low, bits, before = self.levels[0]
        values = low[start:end].astype("<u8")
        chosen = None  # places of the values that go on
        for k in range(1, len(self.levels)):
            more = np.flatnonzero(np.unpackbits(bits[start // 8:-(-end // 8)], bitorder="little")[start % 8:start % 8 + end - start])
            if not len(more):
                break
            chosen = more if chosen is None else chosen[more]
            start = self._rank(bits, before, start)
            end = start + len(chosen)
            low, bits, before = self.levels[k]
            values[chosen] |= low[start:end].astype("<u8") << np.uint64(8 * k)
        return values
