"""Operator 6: byte-level BPE encoding and decoding in linear time.

The vocabulary, with its bytes mapped to Latin-1 characters, is one Aho-Corasick automaton. For
each piece of a text (a match of the splitting pattern) the encoder takes the longest token at
each place and goes back to shorter ones, or to an earlier place, where the token is not
compatible with its predecessor or leads nowhere. Two adjacent tokens are compatible if the
merges, run on their joined bytes, give just these two; a sequence whose neighbours are all
compatible is the one that the merges produce. Compatibility is memoised, and each place is given
up once at most, so the work is linear in the piece.

Texts of a slice are cut into segments where no piece can cross, and each distinct segment is encoded
once; a row's ids are then gathered by Arrow. Segments are cut for patterns of SEPARABLE only; for any other
pattern a text is one segment.

Null text: empty (no ids). Null id: kept. Repeated rows: one result each. Empty table: none.
decode(): an id that is null or has no token gives no bytes and is counted in n_unknown; null ids: none.
Other columns of the input are not read, so their names cannot clash.
"""

from __future__ import annotations

import base64
import hashlib
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from corpusloom.llm.batches import Memo, Recent, bytes_of, map_columns, texts

MEMO_WORDS = 200_000
"""Segments, and pairs of tokens, of which a worker remembers this many recent ones at least, and twice as many at most."""
MEMO_BYTES = 64
"""Longer segments are not remembered."""

SCHEMA = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("ids", T.ArrayType(T.IntegerType())),
    ]
)
DECODED = T.StructType([T.StructField("id", T.LongType()), T.StructField("decoded", T.BinaryType()), T.StructField("n_unknown", T.LongType())])
DIGESTS = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("ids_sha256", T.StringType()),
        T.StructField("decoded_sha256", T.StringType()),
    ]
)
# Patterns of which no match goes on from a character that is not white space to a space or line
# feed, or from a letter to a sign other than an apostrophe; and none looks past the next character that is not white space.
SEPARABLE = frozenset([r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"])


_LETTER, _SIGN = (np.array([x < 128 and test(chr(x)) for x in range(256)]) for test in (str.isalpha, lambda x: x.isprintable() and not x.isalnum() and x not in " '"))


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, f))}


class BytePairs:
    """Encodes and decodes by a table of ranks, in which every single byte has one."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, memo: int = MEMO_WORDS):
        import ahocorasick
        import regex

        self.split = regex.compile(pattern).findall
        self.separable = pattern in SEPARABLE
        vocabulary: list[bytes | None] = [None] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            vocabulary[rank] = token
        self.vocabulary = pa.array(vocabulary, pa.binary())
        self.rank = {token.decode("latin-1"): rank for token, rank in ranks.items()}
        self.longest = max(map(len, self.rank), default=1)
        self.trie = ahocorasick.Automaton()
        for token in self.rank:
            self.trie.add_word(token, token)
        self.trie.make_automaton()
        self.parts = Memo(self.halves)
        self.pairs = Recent(lambda pair: self.apart(*pair), memo)
        self.shorter = Memo(self.prefix)
        self.words = Recent(self.segment, memo)

    def merged(self, text: str, until: int = 1) -> list[str]:
        """The tokens that the merges give, one merge at a time, as long as there are more than until."""
        parts, rank = list(text), self.rank
        while len(parts) > until:
            best, at = min((rank.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if best == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def halves(self, token: str) -> tuple[str, str] | None:
        """The two tokens of a token's last merge; None for a single byte or what no merges give."""
        two = self.merged(token, 2)
        return (two[0], two[1]) if len(two) == 2 else None

    def prefix(self, token: str) -> str | None:
        """The longest token that a token starts with, but itself."""
        return next((token[:n] for n in range(len(token) - 1, 0, -1) if token[:n] in self.rank), None)

    def apart(self, a: str, b: str) -> bool:
        """Whether a and b, side by side, stay two tokens: no merge across their common edge comes before theirs.

        Goes back through the merges of both, latest first; at each step the pieces at the edge are
        those that stood there before the merge of rank `before`, which the pair of them would have had to beat.
        """
        rank, before = self.rank, 1 << 60
        while True:
            if rank.get(a + b, 1 << 60) < before:
                return False
            ha, hb = self.parts[a], self.parts[b]
            if ha is None and hb is None:
                return True
            # Of equal merges the left one comes first; so b's is undone first at equal ranks.
            if hb is None or ha is not None and rank[a] > rank[b]:
                before, a = rank[a], ha[1]
            else:
                before, b = rank[b] + 1, hb[0]

    def piece(self, text: str) -> list[int]:
        """The ids of one piece, whose bytes are the Latin-1 characters of text."""
        rank, pairs = self.rank, self.pairs
        if text in rank:
            return [rank[text]]
        out: list[str] = []
        for _, token in self.trie.iter_long(text):
            if out and not pairs[out[-1], token]:
                break
            out.append(token)
        else:  # all neighbours are compatible
            return [rank[x] for x in out]
        pos = sum(map(len, out))
        dead: set[int] = set()  # places from which no compatible sequence goes on
        shorter = self.shorter
        trial: str | None = shorter[token]
        while True:
            while trial is not None and (pos + len(trial) in dead or out and not pairs[out[-1], trial]):
                trial = shorter[trial]
            if trial is None:
                # Nothing fits here after this predecessor: give the place up and shorten the predecessor.
                dead.add(pos)
                last = out.pop()
                pos -= len(last)
                trial = shorter[last]
                continue
            out.append(trial)
            pos += len(trial)
            if pos == len(text):
                return [rank[x] for x in out]
            # The longest token that starts here, as every byte is one; a search over more than it costs as much as all that is left.
            trial = next(self.trie.iter_long(text[pos : pos + self.longest]))[1]

    def segment(self, data: bytes) -> bytes:
        """The ids of a segment's pieces, as 32-bit numbers."""
        if self.separable and (data[1:] if data[0] == 0x20 else data).isalpha():  # ASCII letters: one piece
            ids = self.piece(data.decode("latin-1"))
        else:
            found = self.split(data.decode("utf-8", "surrogateescape"))
            ids = [i for p in found for i in self.piece(p.encode("utf-8", "surrogateescape").decode("latin-1"))]
        return array("i", ids).tobytes()

    def encode(self, column: pa.Array) -> pa.ListArray:
        """The ids of each text."""
        flat, offsets = bytes_of(column)
        cuts = segment_starts(flat, offsets) if self.separable else np.unique(offsets[:-1][np.diff(offsets) > 0])
        ends = pa.py_buffer(np.append(cuts, len(flat)).astype(np.int32))
        found = pa.Array.from_buffers(pa.binary(), len(cuts), [None, ends, pa.py_buffer(flat)]).dictionary_encode()
        made = [self.words[x] if len(x) <= MEMO_BYTES else self.segment(x) for x in found.dictionary.to_pylist()]
        ids = pa.array(np.frombuffer(b"".join(made), np.int32))
        each = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, made)]) // 4, pa.int32()), ids).take(found.indices)
        edges = each.offsets.to_numpy()[np.searchsorted(cuts, offsets)]
        return pa.ListArray.from_arrays(pa.array(edges, pa.int32()), each.values)

    def decode(self, ids: pa.ListArray) -> tuple[pa.Array, np.ndarray]:
        """The bytes of each row's ids, and how many of these are null or have no token."""
        flat, edges = ids.flatten(), np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(ids), 0).to_numpy())])
        known = pc.if_else(pc.and_(pc.greater_equal(flat, 0), pc.less(flat, len(self.vocabulary))), flat, None)
        tokens = self.vocabulary.take(known)
        missing = np.concatenate([[0], np.cumsum(tokens.is_null().to_numpy(zero_copy_only=False))])
        rows = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), tokens.fill_null(b""))
        return pc.binary_join(rows, b""), missing[edges[1:]] - missing[edges[:-1]]


def segment_starts(flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where the segments of texts laid end to end start: at texts; at spaces and line feeds behind a character that surely is not white space; at ASCII signs but the apostrophe behind an ASCII letter."""
    here = np.flatnonzero((flat == 0x20) | (flat == 0x0A))
    here = here[here > 0]
    last, second, third = (flat[np.maximum(here - k, 0)] for k in (1, 2, 3))
    # White space of more than one byte: U+0085 and U+00A0; U+1680, U+2000 to U+205F and U+3000, with others around them.
    wide = (last >= 0x80) & ((second == 0xC2) | np.isin(third, (0xE1, 0xE2, 0xE3)) & np.isin(second, (0x80, 0x81, 0x9A)))
    starts = np.zeros(len(flat), bool)
    starts[1:] = _LETTER[flat[:-1]] & _SIGN[flat[1:]]
    starts[here[(last > 0x20) & ~wide]] = True
    starts[offsets[:-1][np.diff(offsets) > 0]] = True
    return np.flatnonzero(starts)


_coders: dict[tuple, BytePairs] = {}


def _coder(path: str, pattern: str, memo: int = MEMO_WORDS) -> BytePairs:
    key = (path, pattern, memo)
    if key not in _coders:
        _coders[key] = BytePairs(read_ranks(path), pattern, memo)
    return _coders[key]


def encode(df: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", memo: int = MEMO_WORDS) -> DataFrame:
    """id, n_tokens and ids of each row. ranks: path of the rank file on every worker; memo: segments that a worker remembers."""

    def run(columns):
        ids = _coder(ranks, pattern, memo).encode(columns[1])
        yield {"id": columns[0], "n_tokens": pc.list_value_length(ids).cast(pa.int64()), "ids": ids}

    return map_columns(texts(df, id_col, text_col), SCHEMA, run)


def decode(df: DataFrame, ranks: str, pattern: str, id_col: str = "id", ids_col: str = "ids") -> DataFrame:
    """id, decoded bytes and n_unknown of each row's ids."""
    rows = df.select(F.col(id_col).cast("long"), F.coalesce(F.col(ids_col).cast("array<int>"), F.expr("cast(array() as array<int>)")))
    arrow = to_arrow_schema(DECODED)

    def run(batches):
        for b in batches:
            decoded, unknown = _coder(ranks, pattern).decode(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), decoded, pa.array(unknown, pa.int64())], schema=arrow)

    return rows.mapInArrow(run, DECODED)


def digests(df: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, SHA-256 of the decimal ids joined by a space, and of the bytes decoded from them."""

    def run(columns):
        coder = _coder(ranks, pattern)
        ids = coder.encode(columns[1])
        listed = pc.binary_join(pa.ListArray.from_arrays(ids.offsets, ids.values.cast(pa.string())), " ")
        sha256 = lambda x: [hashlib.sha256(v.as_buffer()).hexdigest() for v in x]
        yield {"id": columns[0], "n_tokens": pc.list_value_length(ids).cast(pa.int64()), "ids_sha256": sha256(listed), "decoded_sha256": sha256(coder.decode(ids)[0])}

    return map_columns(texts(df, id_col, text_col), DIGESTS, run)
