"""Arrow plumbing and vectorised word hashing shared by the operators of this subpackage.

Every helper works on whole texts. A null text counts as empty; a null id stays null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType
from xxhash import xxh3_64_intdigest

SLICE_BYTES = 2 << 20
"""Text bytes that one vectorised step looks at together (a longer text is a step of its own)."""

_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = 0x9E3779B97F4A7C15


def texts(df: DataFrame, id_col: str, text_col: str, *more: str) -> DataFrame:
    """id and text (null: empty) under fixed names, so that other columns can't clash."""
    return df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), *more)


def map_columns(df: DataFrame, schema: StructType, fn: Callable[[list[pa.Array]], Iterable[dict]], column: int = 1) -> DataFrame:
    """mapInArrow where fn turns the columns of a slice of rows into dicts of output columns.

    Slices hold at most SLICE_BYTES of text unless one row alone is longer; the text (or
    bytes) is the column of that number.
    """
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, column):
                for out in fn(part.columns):
                    yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, column: int = 1, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts a batch into runs of rows with at most `size` bytes of text each."""
    if not batch.num_rows:
        return
    ends = offsets_of(batch.column(column))
    ends = ends - ends[0]
    at = 0
    while at < batch.num_rows:
        to = int(np.searchsorted(ends, ends[at] + size, side="right")) - 1
        to = min(max(to, at + 1), batch.num_rows)
        yield batch.slice(at, to - at)
        at = to


def offsets_of(array: pa.Array) -> np.ndarray:
    """Byte offsets of a string column's rows in its data buffer (one more than rows)."""
    kind = np.int64 if pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type) else np.int32
    return np.frombuffer(array.buffers()[1], kind)[array.offset : array.offset + len(array) + 1].astype(np.int64)


def bytes_of(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all rows, end to end, and each row's offsets in them. No nulls allowed."""
    ends = offsets_of(array)
    data = array.buffers()[2]
    flat = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return flat[ends[0] : ends[-1]], ends - ends[0]


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def powers(n: int, base: int = _BASE) -> np.ndarray:
    """1, base, base^2, ... modulo 2^64."""
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Memo(dict):
    """A memo of a function whose keys are bounded by what they are."""

    def __init__(self, fn: Callable):
        super().__init__()
        self.fn = fn

    def __missing__(self, key):
        out = self[key] = self.fn(key)
        return out


class Recent(dict):
    """A memo of a function with bounded size: it keeps the last `size` new keys, and those in use before them, at least."""

    def __init__(self, fn: Callable, size: int):
        super().__init__()
        self.fn, self.size, self.old = fn, size, {}

    def __missing__(self, key):
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        out = self.old.get(key)
        if out is None:
            out = self.fn(key)
        self[key] = out
        return out


class Words:
    """The words `[^\\x20\\x09-\\x0D]+` of a slice of texts, found together.

    start, end: byte positions in the slice; doc: row of each word; first: index of each row's first word (one
    more than rows); id: number of each word's content in this slice; hash: 64 bits of its content.
    """

    def __init__(self, array: pa.Array):
        self.flat, self.offsets = bytes_of(array)
        flat, offsets = self.flat, self.offsets
        inside = ~_WHITE[flat]
        begin = inside.copy()
        begin[1:] &= ~inside[:-1]
        cut = offsets[:-1][offsets[:-1] < len(flat)]
        begin[cut] = inside[cut]
        stop = inside.copy()
        stop[:-1] &= ~inside[1:] | begin[1:]
        self.start, self.end = np.flatnonzero(begin), np.flatnonzero(stop) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(offsets) - 1), self.count)
        ends = np.concatenate([[0], np.cumsum(self.end - self.start)]).astype(np.int32)
        found = pa.Array.from_buffers(pa.binary(), len(self.start), [None, pa.py_buffer(ends), pa.py_buffer(flat[inside])]).dictionary_encode()
        self.id, self.distinct = found.indices.to_numpy().astype(np.int64), found.dictionary

    @cached_property
    def hash(self) -> np.ndarray:
        each = np.fromiter(map(xxh3_64_intdigest, self.distinct.to_pylist()), np.uint64, len(self.distinct))
        return each[self.id] if len(each) else np.zeros(0, np.uint64)


def shingles(words: Words, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of k words of each text, and each text's first index in them.

    A text with some words, but fewer than k, has one shingle of all of them.
    """
    n = words.count
    made = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    first = np.concatenate([[0], np.cumsum(made)])
    h = np.concatenate([words.hash, np.zeros(k, np.uint64)])
    at = np.arange(first[-1]) - np.repeat(first[:-1], made) + np.repeat(words.first[:-1], made)
    left = np.repeat(n, made)
    out = np.zeros(len(at), np.uint64)
    for j, c in enumerate(powers(k + 1, 0xD6E8FEB86659FD93)[1:]):
        term = h[np.minimum(at + j, len(h) - 1)] * c
        if (n < k).any():
            term[left <= j] = 0
        out += term
    return mixed(out), first
