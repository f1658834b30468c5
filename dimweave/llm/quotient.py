"""Counting quotient filters that lose nothing: counters of packed word-id n-grams in numpy.

A key is an n-gram of word ids packed into two halves of ``10 * length`` bits. A permutation of the key
space, which can be undone, spreads the keys evenly. Of the permuted key, the ``q`` highest bits are the
quotient and all the others the remainder. A filter holds, in the order of the permuted keys, how many
keys each quotient has (in unary: a one for each key, then a zero), their remainders in whole bytes, and
their counts in a byte (255: look into the list of large counts). Quotient and remainder give the key back,
so counters never mix, as they would in a sketch.

Filters of one cut of the key space are merged by decoding them in order, whatever their ``q``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

ID_BITS = 20
_HALF_ID = ID_BITS // 2
_ROUNDS = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93)


def _u(x: int) -> np.uint64:
    return np.uint64(x)


@dataclass
class Keys:
    """Keys of ``length`` words: the high and the low half of each, as unsigned 64-bit numbers."""

    high: np.ndarray
    low: np.ndarray
    length: int

    @property
    def half_bits(self) -> int:
        return _HALF_ID * self.length

    def __len__(self) -> int:
        return len(self.high)

    def take(self, at) -> Keys:
        return Keys(self.high[at], self.low[at], self.length)

    def order(self) -> np.ndarray:
        if 2 * self.half_bits <= 64:
            return np.argsort(self.whole(), kind="stable")
        return np.lexsort((self.low, self.high))

    def whole(self) -> np.ndarray:
        return (self.high << _u(self.half_bits)) | self.low


def join_keys(parts: list[Keys], length: int) -> Keys:
    none = np.zeros(0, dtype="u8")
    return Keys(np.concatenate([none, *(p.high for p in parts)]), np.concatenate([none, *(p.low for p in parts)]), length)


def pack(columns: list[np.ndarray]) -> Keys:
    """One key a row; ``columns`` are the ids of the first word, of the second, and so on."""
    m = len(columns)
    high, low = np.zeros(len(columns[0]), dtype="u8"), np.zeros(len(columns[0]), dtype="u8")
    for i, ids in enumerate(columns):
        ids = ids.astype("u8")
        if 2 * i + 1 < m:
            high = (high << _u(ID_BITS)) | ids
        elif 2 * i + 1 > m:
            low = (low << _u(ID_BITS)) | ids
        else:  # the middle word of an odd number lies in both halves
            high = (high << _u(_HALF_ID)) | (ids >> _u(_HALF_ID))
            low = ids & _u((1 << _HALF_ID) - 1)
    return Keys(high, low, m)


def unpack(keys: Keys) -> list[np.ndarray]:
    """The columns of ids that ``pack`` was given."""
    m, high, low = keys.length, keys.high.copy(), keys.low.copy()
    columns: list = [None] * m
    word = _u((1 << ID_BITS) - 1)
    for i in range(m - 1, -1, -1):
        if 2 * i + 1 > m:
            columns[i] = low & word
            low >>= _u(ID_BITS)
        elif 2 * i + 1 < m:
            columns[i] = high & word
            high >>= _u(ID_BITS)
        else:
            columns[i] = ((high & _u((1 << _HALF_ID) - 1)) << _u(_HALF_ID)) | low
            high >>= _u(_HALF_ID)
    return columns


def _stir(x: np.ndarray, factor: int, mask: np.uint64) -> np.ndarray:
    x = (x + _u(1)) * _u(factor)
    x = (x ^ (x >> _u(31))) * _u(factor)
    return (x ^ (x >> _u(29))) & mask


def permute(keys: Keys) -> Keys:
    """An even spread of the keys over the same space: each half in turn is shifted by a mix of the other."""
    mask = _u((1 << keys.half_bits) - 1)
    high, low = keys.high, keys.low
    for i, factor in enumerate(_ROUNDS):
        if i % 2:
            low = low ^ _stir(high, factor, mask)
        else:
            high = high ^ _stir(low, factor, mask)
    return Keys(high, low, keys.length)


def restore(keys: Keys) -> Keys:
    """What ``permute`` was given."""
    mask = _u((1 << keys.half_bits) - 1)
    high, low = keys.high, keys.low
    for i, factor in reversed(list(enumerate(_ROUNDS))):
        if i % 2:
            low = low ^ _stir(high, factor, mask)
        else:
            high = high ^ _stir(low, factor, mask)
    return Keys(high, low, keys.length)


def counted(keys: Keys, counts: np.ndarray | None = None) -> tuple[Keys, np.ndarray]:
    """Distinct (permuted) keys in order with the sums of their counts (1 each by default)."""
    if not len(keys):
        return keys, np.zeros(0, dtype="i8")
    order = keys.order()
    keys = keys.take(order)
    first = np.flatnonzero(np.r_[True, (keys.high[1:] != keys.high[:-1]) | (keys.low[1:] != keys.low[:-1])])
    sums = np.diff(np.r_[first, len(keys)]) if counts is None else np.add.reduceat(counts[order], first)
    return keys.take(first), sums


def cut_of(keys: Keys, bits: int) -> np.ndarray:
    """The part of the key space (its ``bits`` highest bits) each permuted key lies in."""
    return (keys.high >> _u(keys.half_bits - bits)).astype("i8")


def encode(keys: Keys, counts: np.ndarray, cut: int, bits: int) -> tuple[int, bytes, bytes, bytes, bytes]:
    """The filter of one cut: q, unary runs, remainders, counts, large counts. Keys in order, none twice."""
    q = min(keys.half_bits, bits + max(0, int(len(keys)).bit_length() - 1))
    left = keys.half_bits - q
    quotient = (keys.high >> _u(left)).astype("i8") - (cut << (q - bits))
    runs = np.zeros(len(keys) + (1 << (q - bits)), dtype=bool)
    runs[quotient + np.arange(len(keys))] = True  # a zero ends each quotient before it
    rest = keys.high & _u((1 << left) - 1)
    size = -(-(left + keys.half_bits) // 8)
    remainder = np.zeros((len(keys), 16), dtype="u1")
    wide = keys.low | (rest << _u(keys.half_bits))  # the lower 64 bits of the remainder
    over = (rest >> _u(64 - keys.half_bits)) if keys.half_bits > 0 else np.zeros_like(rest)
    remainder[:, :8] = wide.astype("<u8").view("u1").reshape(-1, 8)
    remainder[:, 8:] = over.astype("<u8").view("u1").reshape(-1, 8)
    large = counts >= 255
    small = np.where(large, 255, counts).astype("u1")
    return q, np.packbits(runs).tobytes(), remainder[:, :size].tobytes(), small.tobytes(), counts[large].astype("<i8").tobytes()


def decode(length: int, cut: int, bits: int, q: int, runs: bytes, remainders: bytes, small: bytes, large: bytes) -> tuple[Keys, np.ndarray]:
    """The keys, in order, and counts that ``encode`` was given."""
    n = len(small)
    half = _HALF_ID * length
    left = half - q
    ones = np.flatnonzero(np.unpackbits(np.frombuffer(runs, dtype="u1"), count=n + (1 << (q - bits))))
    quotient = (ones - np.arange(n)).astype("u8") + _u(cut << (q - bits))
    size = -(-(left + half) // 8)
    remainder = np.zeros((n, 16), dtype="u1")
    remainder[:, :size] = np.frombuffer(remainders, dtype="u1").reshape(n, size)
    wide = np.ascontiguousarray(remainder[:, :8]).view("<u8").reshape(-1)
    over = np.ascontiguousarray(remainder[:, 8:]).view("<u8").reshape(-1)
    low = wide & _u((1 << half) - 1)
    rest = (wide >> _u(half)) | (over << _u(64 - half))
    counts = np.frombuffer(small, dtype="u1").astype("i8")
    counts[counts == 255] = np.frombuffer(large, dtype="<i8")
    return Keys((quotient << _u(left)) | (rest & _u((1 << left) - 1)), low, length), counts


def filters(keys: Keys, counts: np.ndarray, bits: int):
    """(cut, q, runs, remainders, counts, large counts) for each part of the key space that holds any of ``keys``."""
    cuts = cut_of(keys, bits)
    starts = np.flatnonzero(np.r_[True, cuts[1:] != cuts[:-1]]) if len(cuts) else []
    for start, end in zip(starts, [*starts[1:], len(cuts)]):
        cut = int(cuts[start])
        yield (cut, *encode(keys.take(slice(start, end)), counts[start:end], cut, bits))
