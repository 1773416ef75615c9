"""Operator 7: removal of byte strings that occurred earlier, by prefix doubling over sampled positions.

A byte goes if a string of `size` bytes that covers it also starts earlier (at a smaller id, or
in the same text further left). Doubling from every position would shuffle each byte some twenty times over; so the
first round ranks a sample of positions that equal strings have in common, and each later round
ranks what is still open by a longer common part, until nothing is open:

1. Of the 69 positions in each string of 100 bytes the one with the smallest hash of 32 bytes is its anchor.
   Equal strings have equal anchors at the same distance from their starts. The successive strings of an anchor are
   one segment. Its rank is that of the 32 bytes; a segment whose rank occurs once is unique, and closed.
2. Segments of equal rank that hold the very same bytes are told apart by position: all but the first
   go. If all of a rank hold the same bytes, the first is closed: it stays.
3. What is open, the first ones of ranks with several contents, is split by the distance between string and
   anchor (27, 9, 3 and 1 distances), and ranked again by the bytes that all strings of such a part have in
   common: 74, 92, 98 and 100 bytes. Steps 2 and 3 are repeated; at 100 bytes equal ranks are equal strings.

Rows between rounds are segments, not strings; all groupings are aggregations that combine before they shuffle. Ranks are
content hashes, so that reranking needs no global numbering; from the second round on, contents are compared byte by byte.

Null text: empty. A null id comes before all others. Rows of equal id and text are the same document: none
of them is earlier than the other at the same place. Rows of equal id (or none) and other text come by a hash of their text,
of 64 bits for equal ids, 128 without one.
Texts shorter than `size` lose nothing. A long text is ranked in parts that overlap. Empty table: none. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.batches import SLICE_BYTES, bytes_of, map_columns, mixed, powers
from corpusloom.llm.shared import forget, stored

GRAM = 32
SPLIT = 3
_NONE = -(1 << 63)
ROW = ("id", "tag", "mark")
"""What tells texts apart: the id, and 128 bits of the text's hashes where there is none, 64 where ids repeat."""
_CODES = np.random.default_rng(7001).integers(0, 2**64, (2, 256), dtype=np.uint64)
_BASES = (0xD1B54A32D192ED03, 0xABC98388FB8FAC03)
_PLACES = np.uint64(0xFFFFFFFF)


def _grams(flat: np.ndarray, size: int, which: int = 0) -> np.ndarray:
    """Hashes of the `size` bytes from each position (a power of two; the last ones are of less)."""
    h = _CODES[which][flat]
    step = 1
    base = _BASES[which]
    while step < size:
        h[:-step] = h[:-step] * np.uint64(pow(base, step, 1 << 64)) + h[step:]
        step *= 2
    return h


class Prefixes:
    """Hashes of any substrings of a text."""

    def __init__(self, flat: np.ndarray, which: int):
        n, base = len(flat), _BASES[which]
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_CODES[which][flat] * powers(n, base)[:n], out=self.sums[1:])
        self.back = powers(n + 1, pow(base, -1, 1 << 64))

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.back[start] + (end - start).astype(np.uint64))


def anchors(flat: np.ndarray, offsets: np.ndarray, size: int) -> dict[str, np.ndarray]:
    """The segments of texts laid end to end: row, first and last position (in the text) of the strings of each anchor, the first one's distance to it, its rank, and a hash of all the segment's bytes."""
    names = ("row", "lo", "n", "d", "rank", "pair")
    lengths = np.diff(offsets)
    count = np.maximum(lengths - size + 1, 0)
    if not count.any():
        return dict.fromkeys(names, np.zeros(0, np.int64))
    n = len(flat)
    grams = mixed(_grams(flat, GRAM))
    # Of equal upper halves the leftmost is taken, wherever the text lies, so that equal strings have equal anchors.
    least = (grams & ~_PLACES) | np.arange(n, dtype=np.uint64)
    width, have = size - GRAM + 1, 1
    while 2 * have <= width:
        least[:-have] = np.minimum(least[:-have], least[have:])
        have *= 2
    if width > have:
        least[: have - width] = np.minimum(least[: have - width], least[width - have :])
    # Strings that run over the end of their text don't count.
    row = np.repeat(np.arange(len(lengths)), count)
    at = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(offsets[:-1], count)
    place = (least[at] & _PLACES).astype(np.int64)
    new = np.ones(len(at), bool)
    new[1:] = (place[1:] != place[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    lo, hi, place, row = at[first], at[last], place[first], row[first]
    pair = Prefixes(flat, 1).of(lo, hi + size) + mixed((place - lo).astype(np.uint64))
    return dict(zip(names, (row, lo - offsets[row], hi - lo, place - lo, grams[place].view(np.int64), pair.view(np.int64)), strict=True))


def _segments(column: pa.Array, size: int, most: int):
    """anchors() of the texts of a slice, or, if it has more than twice `most` bytes, of parts of each text that overlap by size - 1 bytes."""
    flat, offsets = bytes_of(column)
    if len(flat) <= 2 * most:
        yield anchors(flat, offsets, size)
        return
    for i in range(len(column)):
        for at in range(offsets[i], max(offsets[i] + 1, offsets[i + 1] - size + 1), most):
            part = flat[at : min(at + most + size - 1, offsets[i + 1])]
            found = anchors(part, np.array([0, len(part)]), size)
            yield found | {"row": found["row"] + i, "lo": found["lo"] + at - offsets[i]}


_SEGMENT = [*(T.StructField(f, T.LongType()) for f in ROW), T.StructField("lo", T.IntegerType()), T.StructField("n", T.ShortType()), T.StructField("d", T.ShortType())]
RANKS = T.StructType([T.StructField("core", T.LongType()), T.StructField("n", T.IntegerType())])
ANCHORS = T.StructType([*_SEGMENT, T.StructField("core", T.LongType()), T.StructField("content", T.LongType()), T.StructField("again", T.BooleanType())])
OPEN = T.StructType([*_SEGMENT, T.StructField("bytes", T.BinaryType())])
RESULT = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("n_bytes", T.LongType()),
        T.StructField("n_removed", T.LongType()),
        T.StructField("n_spans", T.LongType()),
        T.StructField("kept", T.BinaryType()),
    ]
)


def _ranks(size: int, most: int):
    def run(columns):
        for a in _segments(columns[1], size, most):
            rank, n = np.unique(a["rank"], return_counts=True)
            yield {"core": rank, "n": n}

    return run


def _again(a: dict[str, np.ndarray], keys: list[np.ndarray]) -> np.ndarray:
    """Which segments have an equal one earlier in these very rows; that needs no shuffle to be known."""
    order = np.lexsort((a["lo"], *reversed(keys), a["pair"], a["rank"]))
    out = np.zeros(len(order), bool)
    if len(order) > 1:
        x, y = order[1:], order[:-1]
        same = np.append(False, (a["rank"][x] == a["rank"][y]) & (a["pair"][x] == a["pair"][y]))
        head = order[np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))]
        out[order] = same & np.logical_or.reduce([x[order] != x[head] for x in (*keys, a["lo"])])
    return out


def _anchors(size: int, most: int):
    def run(columns):
        for a in _segments(columns[1], size, most):
            keys = [columns[i].to_numpy()[a["row"]] for i in (0, 2, 3)]
            again = _again(a, keys)
            # Known repeats are settled; a rank of their own keeps them out of the way of what is not.
            lone = mixed(keys[0].view(np.uint64) * np.uint64(_BASES[0]) + a["lo"].astype(np.uint64)).view(np.int64)
            yield dict(zip(ROW, keys, strict=True)) | {"lo": a["lo"], "n": a["n"], "d": a["d"], "core": np.where(again, lone, a["rank"]), "content": np.where(again, 0, a["pair"]), "again": again}

    return run


def _opened(size: int):
    """The segments listed for each text, with their bytes."""

    def run(columns):
        flat, offsets = bytes_of(columns[1])
        row = np.repeat(np.arange(len(columns[0])), np.diff(columns[4].offsets.to_numpy()))
        lo, n, d = (columns[4].flatten().field(f).to_numpy(zero_copy_only=False).astype(np.int64) for f in ("lo", "n", "d"))
        start = lo + offsets[row]
        data = memoryview(flat)
        yield {
            **{f: columns[i].to_numpy()[row] for f, i in zip(ROW, (0, 2, 3), strict=True)},
            "lo": lo,
            "n": n,
            "d": d,
            "bytes": [bytes(data[s:e]) for s, e in zip(start.tolist(), (start + n + size).tolist(), strict=True)],
        }

    return run


def _removed(size: int):
    def run(columns):
        ids, lists = columns[0], columns[4]
        out: dict[str, list] = {f: [] for f in RESULT.names[1:]}
        for text, marks in zip(columns[1], lists, strict=True):
            data = text.as_buffer().to_pybytes()
            removed = spans = 0
            kept = data
            if marks.is_valid and len(marks):
                packed = marks.values.to_numpy()
                lo, end = packed >> 17, (packed >> 17) + (packed >> 1 & 0xFFFF)
                # Segments that don't stay count for their strings, parts that do stay count against them.
                sign = np.where(packed & 1, -1, 1)
                edge = np.zeros(len(data) + 1, np.int32)
                np.add.at(edge, lo, sign)
                np.add.at(edge, end + 1, -sign)
                starts = np.cumsum(edge) > 0
                cover = np.cumsum(starts, dtype=np.int64)
                cover[size:] -= cover[:-size].copy()
                gone = cover[:-1] > 0
                removed = int(gone.sum())
                spans = int(gone[0]) + int(np.count_nonzero(gone[1:] & ~gone[:-1]))
                kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
            for name, value in zip(out, (len(data), removed, spans, kept), strict=True):
                out[name].append(value)
        yield out | {"id": ids}

    return run


def widths(size: int) -> list[int]:
    """How many distances a part of a segment has, round by round, down to one."""
    n = 1
    while n * SPLIT < size - GRAM + 1:
        n *= SPLIT
    return [SPLIT**k for k in range(round(np.log(n) / np.log(SPLIT)), -1, -1)]


def _parted(open_: DataFrame, width: int, size: int) -> DataFrame:
    """Segments split where the distance to the anchor is a multiple of width; core: what all strings of a part share, wherever it starts and ends."""
    cells = F.sequence(F.floor((F.col("d") - F.col("n")) / width), F.floor(F.col("d") / width))
    rows = open_.select("*", F.explode(cells).alias("cell"))
    far = F.least(F.col("d").cast("long"), F.col("cell") * width + width - 1).cast("int")
    near = F.greatest(F.col("d").cast("long") - F.col("n"), F.col("cell") * width).cast("int")
    rows = rows.withColumns({"far": far, "near": near})
    rows = rows.select(*ROW, (F.col("lo") + F.col("d") - F.col("far")).alias("lo"), (F.col("far") - F.col("near")).cast("short").alias("n"), F.col("far").cast("short").alias("d"), "cell", F.substring("bytes", F.col("d") - F.col("far") + 1, F.col("far") - F.col("near") + size).alias("content"))
    common = F.substring("content", (F.col("d") - F.col("cell") * width + 1).cast("int"), F.lit(size + 1 - width))
    return rows.select(*ROW, "lo", "n", "d", F.xxhash64(F.lit(width), "cell", common).alias("core"), "content")


def _firsts(segments: DataFrame) -> DataFrame:
    """The first segment of each content, as a table; open, if its core has other contents too."""
    first = segments.groupBy("core", "content").agg(F.min(F.struct(*ROW, "lo", "n", "d")).alias("x")).select("core", "content", "x.*")
    several = first.groupBy("core").agg(F.count("*").alias("__n")).where("__n > 1").select("core", F.lit(True).alias("open"))
    return stored(first.join(several, "core", "left").withColumn("open", F.coalesce("open", F.lit(False))), "firsts")


def _packed(sign: int):
    return (F.shiftleft(F.col("lo").cast("long"), 17) + F.col("n") * 2 + sign).alias("x")


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 100, part_bytes: int = SLICE_BYTES) -> DataFrame:
    """id, n_bytes, n_removed, n_spans (maximal removed runs) and kept (the remaining bytes) of each row. size: from 2 * GRAM to 32,767; part_bytes: how much of a long text is ranked at once."""
    if not 2 * GRAM <= size <= 32767:
        raise ValueError(f"size must be from {2 * GRAM} to 32767")
    docs = df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NONE)).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    # Part texts of equal id; the second hash is only kept where there is none, as constants take next to no room.
    docs = docs.withColumn("tag", F.xxhash64("text")).withColumn("mark", F.when(F.col("id") == _NONE, F.xxhash64(F.lit(SPLIT), "text")).otherwise(0).cast("long"))

    # Round 1: anchors whose rank occurs again. A rank is counted first, so that only these are stored.
    twice = map_columns(docs.select("id", "text"), RANKS, _ranks(size, part_bytes)).groupBy("core").agg(F.sum("n").alias("n")).where("n > 1").select("core", F.lit(True).alias("twice"))
    found = stored(map_columns(docs, ANCHORS, _anchors(size, part_bytes)).join(twice, "core", "left").where("again or twice").drop("twice"), "anchors")
    first = _firsts(found.where("not again"))
    marks = [found.select(*ROW, _packed(0)), first.where("not open").select(*ROW, _packed(1))]

    lists = first.where("open").groupBy(*ROW).agg(F.collect_list(F.struct("lo", "n", "d")).alias("x"))
    opened = open_ = stored(map_columns(docs.join(lists, [*ROW]).select("id", "text", "tag", "mark", "x"), OPEN, _opened(size)), "open")
    for width in widths(size):
        first = _firsts(_parted(open_, width, size))
        # Parts of one distance are strings: what shares a rank with others then only has their hash.
        marks.append((first.where("not open") if width > 1 else first).select(*ROW, _packed(1)))
        open_ = first.where("open").select(*ROW, "lo", "n", "d", F.col("content").alias("bytes"))

    forget(opened)
    packed = marks[0]
    for more in marks[1:]:
        packed = packed.unionByName(more)
    lists = packed.groupBy(*ROW).agg(F.collect_set("x").alias("x"))
    marked = docs.join(lists, [*ROW], "left").select("id", "text", "tag", "mark", "x")
    return map_columns(marked, RESULT, _removed(size)).withColumn("id", F.nullif("id", F.lit(_NONE)))


def digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 100, part_bytes: int = SLICE_BYTES) -> DataFrame:
    """As remove_repeats(), with the SHA-256 of the remaining bytes instead of them."""
    out = remove_repeats(df, id_col, text_col, size, part_bytes)
    return out.select("id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
