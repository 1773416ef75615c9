"""Operator 3: quality rules, with repetition found by suffix arrays.

The rules count words, symbols, repeated lines and words in repeated windows. The verdict then
looks at the longest common prefixes of each text's sorted suffixes, of characters: the code points of its words, with one
separator behind each word, which counts nothing. Wherever a suffix shares a prefix of at least `least` code points with a
neighbour, a repeated substring starts; those that can't be extended to the left are maximal. They may begin and end inside words.
Their spans are united; a text is kept if they cover no more than a fraction of it and none is too long.

Suffixes of all texts of a slice are sorted together, by text first, so that no prefix leaves its text. Words of windows are
compared by content, too: equal numbers are equal words.

Null text: no words, so it fails. Null id: kept. Repeated rows: one result each. Empty table: none.
measure() does not read other columns; keep() returns them all unchanged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.batches import Words, map_columns, slices, texts

WINDOW = 5
PART_BYTES = 256 << 10
"""Text bytes whose suffixes are sorted together (a longer text is sorted alone): this many arrays of 8 bytes a character are small."""
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True
_WHITE = " \t\n\v\f\r"
_WHITE_BYTES = np.zeros(256, bool)
_WHITE_BYTES[[ord(c) for c in _WHITE]] = True

SCHEMA = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("n_words", T.LongType()),
        T.StructField("word_chars", T.LongType()),
        T.StructField("n_symbols", T.LongType()),
        T.StructField("n_dup_lines", T.LongType()),
        T.StructField("n_repeat_words", T.LongType()),
        T.StructField("base_failed", T.BooleanType()),
        T.StructField("kept", T.BooleanType()),
        T.StructField("repeat_chars", T.LongType()),
        T.StructField("longest_repeat", T.LongType()),
    ]
)


def suffix_array(tokens: np.ndarray, row: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The sorted order of all suffixes of some sequences, and each one's common prefix with the one before it (0 for a sequence's first).

    tokens: the sequences end to end, as small integers; row: the number of each token's sequence, ascending (none: there is one).
    A suffix ends with its sequence. A rank is the place of the first suffix that agrees in as many tokens; the first ranks see as many tokens as
    a 64-bit key holds, each round sees twice as many, and only suffixes that still share a rank are sorted again.
    """
    n = len(tokens)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    row = np.zeros(n, np.int64) if row is None else row
    end = np.cumsum(np.bincount(row))[row]
    packed, step = _packed(tokens, row)
    order = np.argsort(packed)
    place = _heads(packed[order])
    rank = np.empty(n, np.int64)
    rank[order] = place
    open_ = order[_several(place)]
    done = step
    while len(open_):
        to = open_ + done
        old = rank[open_]
        key = old * (n + 1) + np.where(to < end[open_], rank[np.minimum(to, n - 1)] + 1, 0)
        by = np.argsort(key)
        open_, key, old = open_[by], key[by], old[by]
        place = _heads(key)
        rank[open_] = old + place - _heads(old)
        open_ = open_[_several(place)]
        done *= 2
    order = np.empty(n, np.int64)
    order[rank] = np.arange(n)
    return order, _prefixes(tokens, row, end, order, packed, step)


def _packed(tokens: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, int]:
    """A 63-bit number of each place: its row, then as many tokens as fit (0: past the row's end); and how many these are."""
    n, base = len(tokens), int(tokens.max()) + 2
    room, step = (int(row[-1]) + 1) * base, 1
    while room * base < 1 << 62 and step < n:
        room, step = room * base, step + 1
    packed = row.astype(np.int64)
    for j in range(step):
        packed *= base
        packed[: n - j] += np.where(row[: n - j] == row[j:], tokens[j:] + 1, 0)
    return packed, step


def _prefixes(tokens: np.ndarray, row: np.ndarray, end: np.ndarray, order: np.ndarray, packed: np.ndarray, step: int) -> np.ndarray:
    """The common prefix of each suffix with the one sorted before it, in sorted order.

    In order of the text, a suffix's prefix is one shorter than that of the suffix a token longer, if both neighbours have the
    same token before them. Only the others are compared, by packed tokens; their prefixes sum up to 2 n log n at most.
    """
    n = len(tokens)
    before = np.empty(n, np.int64)
    before[order[1:]] = order[:-1]
    before[order[0]] = order[0]
    within = row[before] == row
    within[order[0]] = False
    at = np.arange(n)
    follows = within & (at > 0) & (before > 0)
    follows &= (row[at - 1] == row) & (row[before - 1] == row) & (tokens[at - 1] == tokens[before - 1])
    a = np.flatnonzero(within & ~follows)
    b = before[a]
    most = np.minimum(end[a] - a, end[b] - b)
    size = np.zeros(len(a), np.int64)
    live = np.arange(len(a))
    while len(live) > 16:
        x = size[live]
        live, x = live[x < most[live]], x[x < most[live]]
        live = live[packed[a[live] + x] == packed[b[live] + x]]
        size[live] += step
    for i in live.tolist():
        size[i] += _common(tokens, int(a[i] + size[i]), int(b[i] + size[i]), int(most[i] - size[i]))
    live = np.flatnonzero(size < most)
    for _ in range(step):
        live = live[size[live] < most[live]]
        live = live[tokens[a[live] + size[live]] == tokens[b[live] + size[live]]]
        size[live] += 1
    length = np.zeros(n, np.int64)
    length[a] = size
    last = np.maximum.accumulate(np.where(follows, 0, at))
    return (length[last] - (at - last))[order]


def _common(tokens: np.ndarray, a: int, b: int, most: int) -> int:
    """How many tokens agree from two places on, up to `most`."""
    size, chunk = 0, 1024
    while size < most:
        chunk = min(chunk * 2, most - size)
        other = tokens[a + size : a + size + chunk] != tokens[b + size : b + size + chunk]
        if other.any():
            return size + int(other.argmax())
        size += chunk
    return size


def _several(place: np.ndarray) -> np.ndarray:
    """For _heads(), whether others have the same place."""
    out = np.zeros(len(place), bool)
    out[1:] = place[1:] == place[:-1]
    out[:-1] |= out[1:]
    return out


def _heads(values: np.ndarray) -> np.ndarray:
    """For sorted values, the place of the first equal one."""
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    return np.maximum.accumulate(np.where(new, np.arange(len(values)), 0))


def shared(tokens: np.ndarray, row: np.ndarray) -> np.ndarray:
    """For each token, the longest sequence from it on that occurs elsewhere in its row, too, in tokens."""
    order, lcp = suffix_array(tokens, row)
    longest = np.zeros(len(tokens), np.int64)
    longest[order] = np.maximum(lcp, np.append(lcp[1:], 0))
    return longest


def repeats(tokens: np.ndarray, chars: np.ndarray, least: int, fewest: int = WINDOW) -> tuple[int, int]:
    """Code points covered by the maximal repeated substrings of at least `least` code points and `fewest` tokens, and those of the longest, in one text."""
    first, row = np.array([0, len(tokens)]), np.zeros(len(tokens), np.int64)
    covered, longest = _repeats(shared(tokens, row), chars, row, first, least, fewest)
    return int(covered[0]), int(longest[0])


def _repeats(length: np.ndarray, chars: np.ndarray, row: np.ndarray, first: np.ndarray, least: int, fewest: int) -> tuple[np.ndarray, np.ndarray]:
    """repeats() of each row, from shared() of the rows' tokens; first: index of each row's first token (one more than rows)."""
    n = len(length)
    total = np.concatenate([[0], np.cumsum(chars)])
    at = np.arange(n)
    size = total[at + length] - total[at]
    # One token to the left, the same repeat is longer by that token: then this one is not maximal.
    maximal = np.ones(n, bool)
    maximal[1:] = (length[:-1] != length[1:] + 1) | (row[1:] != row[:-1])
    found = np.flatnonzero(maximal & (size >= least) & (length >= fewest))
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, found, 1)
    np.add.at(edge, found + length[found], -1)
    covered = np.concatenate([[0], np.cumsum(np.where(np.cumsum(edge[:-1]) > 0, chars, 0))])
    longest = np.zeros(len(first) - 1, np.int64)
    np.maximum.at(longest, row[found], size[found])
    return covered[first[1:]] - covered[first[:-1]], longest


def _characters(words: Words, chars: np.ndarray) -> np.ndarray:
    """The code points of all words, numbered as they occur in this slice, with a 0 behind each word; chars: code points by word."""
    at = np.flatnonzero((words.flat & 0xC0 != 0x80) & ~_WHITE_BYTES[words.flat])
    byte = np.concatenate([words.flat, np.zeros(3, np.uint8)]).astype(np.int32)
    point = byte[at]
    for least, marks, more in ((0xC0, 0x1F, 1), (0xE0, 0x0F, 2), (0xF0, 0x07, 3)):
        wide = np.flatnonzero(byte[at] >= least)
        value = byte[at[wide]] & marks
        for j in range(1, more + 1):
            value = value << 6 | byte[at[wide] + j] & 0x3F
        point[wide] = value
    number = np.cumsum(np.bincount(point) > 0)
    out = np.zeros(len(at) + len(chars), np.int64)
    inside = np.ones(len(out), bool)
    inside[np.cumsum(chars + 1) - 1] = False
    out[inside] = number[point]
    return out


def measured(column: pa.Array, least: int, most_covered: float, most_long: int) -> dict:
    """The columns of SCHEMA but id for some texts."""
    rows = pa.RecordBatch.from_arrays([column], names=["text"])
    parts = [_measured(part.column(0), least, most_covered, most_long) for part in slices(rows, 0, PART_BYTES)] or [_measured(column, least, most_covered, most_long)]
    return {name: np.concatenate([part[name] for part in parts]) for name in parts[0]}


def _measured(column: pa.Array, least: int, most_covered: float, most_long: int) -> dict:
    words = Words(column)
    rows = len(column)
    before = np.concatenate([[0], np.cumsum((words.flat & 0xC0) != 0x80)])
    chars = before[words.end] - before[words.start]
    sums = lambda x: np.concatenate([[0], np.cumsum(x)])
    by_row = lambda x: np.diff(sums(x)[words.first])
    word_chars = by_row(chars)
    n_symbols = np.diff(sums(_SYMBOLS[words.flat])[words.offsets])

    # Windows of five words that occur twice in one text.
    length = shared(words.id, words.doc)
    at = np.flatnonzero(length >= WINDOW)
    edge = np.zeros(len(words.start) + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + WINDOW, -1)
    n_repeat = by_row(np.cumsum(edge[:-1]) > 0)

    n_dup = np.zeros(rows, np.int64)
    for i, text in enumerate(column.to_pylist()):
        lines = [x for x in text.split("\n") if x.strip(_WHITE)]
        n_dup[i] = len(lines) - len(set(lines))

    points = _characters(words, chars)
    row = np.repeat(words.doc, chars + 1)
    covered, longest = _repeats(shared(points, row), (points > 0).astype(np.int64), row, sums(chars + 1)[words.first], least, 1)
    failed = (words.count < 10) | (100 * n_repeat > 20 * words.count)
    return {
        "n_words": words.count,
        "word_chars": word_chars,
        "n_symbols": n_symbols,
        "n_dup_lines": n_dup,
        "n_repeat_words": n_repeat,
        "base_failed": failed,
        "kept": ~failed & (covered <= most_covered * word_chars) & (longest <= most_long),
        "repeat_chars": covered,
        "longest_repeat": longest,
    }


def measure(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 60, most_covered: float = 0.2, most_long: int = 1000) -> DataFrame:
    """The counts, base_failed, kept and the repetition of each row, under the names of SCHEMA.

    least: code points of words in a repeated substring that counts; most_covered: the largest
    fraction of a text's word code points that such substrings may cover; most_long: the most code
    points in one of them.
    """

    def run(columns):
        yield {"id": columns[0], **measured(columns[1], least, most_covered, most_long)}

    return map_columns(texts(df, id_col, text_col), SCHEMA, run)


def keep(df: DataFrame, text_col: str = "text", least: int = 60, most_covered: float = 0.2, most_long: int = 1000) -> DataFrame:
    """The rows whose text measure() would keep, with all their columns."""

    @F.pandas_udf("boolean")
    def good(column):
        import pandas as pd

        rows = pa.RecordBatch.from_arrays([pa.array(column.where(column.notna(), ""), pa.string())], names=["text"])
        kept = [measured(part.column(0), least, most_covered, most_long)["kept"] for part in slices(rows, 0)]
        return pd.Series(np.concatenate(kept) if kept else [], dtype=bool)

    return df.where(good(F.col(text_col)))
