"""Counting quotient filters of packed word-id n-grams, without loss.

An n-gram of 2 or 3 word ids of `bits` bits is packed into two halves of the same width and permuted by a Feistel network, which any
round function makes invertible. A permuted key is uniform, so its first bits deal keys evenly to shards, and the next ones are
its quotient. A filter keeps its keys in order: the quotients as a bit vector (a one for each key, a zero at the end of each quotient), the
remainders in full, so nothing is lost, and the counters in one byte each, larger ones apart. Sorted filters merge like sorted lists.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np

from corpusloom.llm.batches import mixed

_ROUNDS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)
_HEAD = struct.Struct("<QQBB")  # keys, large counters, quotient bits, width of a half
_LARGE = 255


def _ones(width: int) -> np.uint64:
    return np.uint64((1 << width) - 1)


def half_width(n: int, bits: int) -> int:
    """Bits of each half of a packed n-gram; 64 at most, so ids may have 42 bits."""
    return (n * bits + 1) // 2


def pack(ids: list[np.ndarray], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """2 or 3 arrays of ids to the halves of one number each."""
    ids = [x.astype(np.uint64) for x in ids]
    if len(ids) == 2:
        return ids[0], ids[1]
    part = np.uint64(half_width(3, bits) - bits)  # bits of the middle id in the lower half
    return (ids[0] << (np.uint64(bits) - part)) | (ids[1] >> part), ((ids[1] & _ones(int(part))) << np.uint64(bits)) | ids[2]


def unpack(hi: np.ndarray, lo: np.ndarray, n: int, bits: int) -> list[np.ndarray]:
    if n == 2:
        return [hi, lo]
    part = np.uint64(half_width(3, bits) - bits)
    upper = np.uint64(bits) - part
    return [hi >> upper, ((hi & _ones(int(upper))) << part) | (lo >> np.uint64(bits)), lo & _ones(bits)]


def permute(hi: np.ndarray, lo: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    for c in _ROUNDS:
        hi, lo = lo, hi ^ (mixed(lo + np.uint64(c)) & _ones(width))
    return hi, lo


def restore(hi: np.ndarray, lo: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The inverse of permute()."""
    for c in reversed(_ROUNDS):
        hi, lo = lo ^ (mixed(hi + np.uint64(c)) & _ones(width)), hi
    return hi, lo


@dataclass
class Counts:
    """Distinct keys in order, and their counts."""

    hi: np.ndarray
    lo: np.ndarray
    n: np.ndarray

    def __len__(self) -> int:
        return len(self.n)

    def part(self, a: int, b: int) -> Counts:
        return Counts(self.hi[a:b], self.lo[a:b], self.n[a:b])


def counted(hi: np.ndarray, lo: np.ndarray, n: np.ndarray | None, width: int) -> Counts:
    """Sorts keys and adds up equal ones (n: their counts, one each by default)."""
    if not len(hi):
        return Counts(hi, lo, np.zeros(0, np.int64))
    if 2 * width <= 64:  # both halves fit one number, which sorts faster
        key = (hi << np.uint64(width)) | lo
        if n is None:
            key.sort()
        else:
            order = np.argsort(key)
            key, n = key[order], n[order]
        hi, lo = key >> np.uint64(width), key & _ones(width)
    else:
        order = np.lexsort((lo, hi))
        hi, lo, n = hi[order], lo[order], None if n is None else n[order]
    first = np.flatnonzero(np.concatenate([[True], (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])]))
    sums = np.diff(np.append(first, len(hi))) if n is None else np.add.reduceat(n, first)
    return Counts(hi[first], lo[first], sums.astype(np.int64))


def merged(parts: list[Counts], width: int) -> Counts:
    if len(parts) == 1:
        return parts[0]
    return counted(np.concatenate([p.hi for p in parts]), np.concatenate([p.lo for p in parts]), np.concatenate([p.n for p in parts]), width)


def _bytes(values: np.ndarray, size: int) -> bytes:
    """The lower `size` bytes of each value."""
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size].tobytes()


def _values(data: bytes, at: int, n: int, size: int) -> np.ndarray:
    wide = np.zeros((n, 8), np.uint8)
    wide[:, :size] = np.frombuffer(data, np.uint8, n * size, at).reshape(n, size)
    return wide.reshape(-1).view("<u8")


def encode(c: Counts, width: int, shard_bits: int) -> bytes:
    """The filter of the keys of one shard, whose first shard_bits bits are equal."""
    left = width - shard_bits
    hi = c.hi & _ones(left)
    # Some two slots a key at most, and whole bytes for the rest.
    fits = [q for q in range(left + 1) if (left - q) % 8 == 0 and (q <= len(c).bit_length() or q < 8)]
    q = fits[-1]
    quotient = (hi >> np.uint64(left - q)).astype(np.int64)
    slots = np.zeros(len(c) + (1 << q), np.uint8)
    slots[quotient + np.arange(len(c))] = 1
    large = c.n >= _LARGE
    return b"".join([
        _HEAD.pack(len(c), int(large.sum()), q, width),
        np.packbits(slots).tobytes(),
        _bytes(hi & _ones(left - q), (left - q) // 8),
        _bytes(c.lo, (width + 7) // 8),
        np.minimum(c.n, _LARGE).astype(np.uint8).tobytes(),
        c.n[large].astype("<i8").tobytes(),
    ])


def decode(data: bytes, shard: int, shard_bits: int) -> Counts:
    n, n_large, q, width = _HEAD.unpack_from(data)
    at, left = _HEAD.size, width - shard_bits
    size = (n + (1 << q) + 7) // 8
    ones = np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8, size, at)))
    quotient = (ones - np.arange(n)).astype(np.uint64)
    at += size
    hi = (quotient << np.uint64(left - q)) | _values(data, at, n, (left - q) // 8)
    at += n * ((left - q) // 8)
    lo = _values(data, at, n, (width + 7) // 8)
    at += n * ((width + 7) // 8)
    counts = np.frombuffer(data, np.uint8, n, at).astype(np.int64)
    counts[counts == _LARGE] = np.frombuffer(data, "<i8", n_large, at + n)
    return Counts(hi | np.uint64(shard << left), lo, counts)


def shards(c: Counts, width: int, shard_bits: int) -> list[tuple[int, bytes]]:
    """The filters of all shards that some keys belong to."""
    of = (c.hi >> np.uint64(width - shard_bits)).astype(np.int64) if shard_bits else np.zeros(len(c), np.int64)
    starts = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])) if len(of) else []
    ends = [*starts[1:], len(of)]
    return [(int(of[a]), encode(c.part(a, b), width, shard_bits)) for a, b in zip(starts, ends, strict=False)]
