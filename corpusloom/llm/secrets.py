"""Operator 2: secret scans with structural confirmation.

Patterns find the base spans: assignments to secret-like names (assign), access key ids (access)
and long hexadecimal runs (hex). Then every run of base64, base64url or hexadecimal characters is
decoded, and reported as well if its bytes *are* a secret by their structure:

der      a private key in DER (PKCS#1 whose modulus is the product of its primes, PKCS#8 with the inner key of its algorithm or encrypted
         by password, SEC 1, DSA), each nested length exact
openssh  an OpenSSH private key, its length-prefixed fields filling the block exactly
jwt      a signed or encrypted token: JSON headers that name an algorithm, parts that decode

A key or token may start anywhere in a run; a key ends where its lengths say, and a run may hold several keys and tokens.
A run is decoded once for each place in a group of characters that a key may start at; lengths are then read where they
stand, and the first that doesn't fit ends it, so that the time grows with the text only.
PEM lines are joined before they are decoded. Spans are in code points, ends exclusive, and cover
the whole match of their pattern, the whole key (with its padding or PEM lines) or token.

Null text: empty (no spans). Null id: kept. Repeated rows: one result each. Empty table: none.
scan() does not read other columns; redact() keeps them all, and names its own column so that
none clashes.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import math
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.batches import bytes_of, map_columns, slices, texts

KINDS = ("assign", "access", "hex", "der", "openssh", "jwt")
BASE = KINDS[:3]
Span = tuple[str, int, int]

_ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")  # the runs of [0-9a-f]+ that are long enough
_NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
_RUN = re.compile(r"[A-Za-z0-9+/_=.-]{32,}")
_PEM = re.compile(r"-----(BEGIN|END) [A-Z0-9 ]*PRIVATE KEY-----")
_PIECE = re.compile(r"([A-Za-z0-9+/_-]{32,})={0,2}")
_PARTS = re.compile(r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{8,}(?:\.[A-Za-z0-9_-]*){2,4}")
_HEXADECIMAL = re.compile(r"[0-9A-Fa-f]*")
_MOST_FIELDS = 10  # no private key has more: PKCS#1 with further primes
_MOST_BYTES = 2049  # of a modulus, 16,384 bits; common libraries refuse longer ones
_MAGIC = b"openssh-key-v1\0"
# Object identifiers of algorithms, in DER.
_RSA = bytes.fromhex("2a864886f70d010101")
_EC = bytes.fromhex("2a8648ce3d0201")
_CURVES = tuple(map(bytes.fromhex, ("2b656e", "2b656f", "2b6570", "2b6571")))  # X25519, X448, Ed25519, Ed448
_NUMBERS = tuple(map(bytes.fromhex, ("2a8648ce380401", "2a864886f70d010301")))  # DSA, Diffie-Hellman
_ENCRYPTION = tuple(map(bytes.fromhex, ("2a864886f70d0105", "2a864886f70d010c01")))  # password-based, of PKCS#5 and PKCS#12
# A SEQUENCE (0x30) or the magic of OpenSSH keys, in base64 or hexadecimal.
_START = re.compile(r"M[A-P]|b3BlbnNzaC1rZXk|30|6[Ff]70656[Ee]7373682[Dd]6[Bb]6579")
_RUN_BYTES = np.zeros(256, bool)
_RUN_BYTES[[ord(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=.-"]] = True


def base_spans(text: str) -> list[Span]:
    """Assignments, access key ids and hexadecimal runs that are long enough."""
    out: list[Span] = []
    low = text.lower()
    if any(name in low for name in _NAMES):
        out += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [("hex", *m.span()) for m in _HEX.finditer(text)]
    return out


def structural_spans(text: str) -> list[Span]:
    """Runs whose decoded bytes have the structure of a secret."""
    out: list[Span] = []
    for m in _RUN.finditer(text):
        run, at = m[0], 0
        while at < len(run):
            token = _token(run, at)
            to, after = token or (len(run), len(run))
            out += [(kind, m.start() + start, m.start() + end) for start, end, kind in _keys(run, at, to)]
            if token:
                out.append(("jwt", m.start() + to, m.start() + after))
            at = after
    if "PRIVATE KEY-----" in text:
        begin = None
        for m in _PEM.finditer(text):
            if m[1] == "BEGIN":
                begin = m
                continue
            if begin:
                body = re.sub(r"\\[rn]|\s", "", re.sub(r"(?m)^[A-Za-z-]+:.*$", "", text[begin.end() : m.start()]))
                data = _base64(body)
                if data and (kind := _key(data, 0, len(data))) and (kind, begin.start(), m.end()) not in out:
                    out.append((kind, begin.start(), m.end()))
            begin = None
    return out


def spans(text: str, candidate: bool = True) -> list[Span]:
    """All spans, by start, then kind. candidate=False: the text is known to hold no run of 32 characters."""
    found = base_spans(text) + (structural_spans(text) if candidate or "PRIVATE KEY-----" in text else [])
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def _base64(run: str) -> bytes | None:
    run = run.rstrip("=").replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(run + "=" * (-len(run) % 4), validate=True)
    except (ValueError, binascii.Error):
        return None


def _keys(run: str, at: int, to: int):
    """(start, end, kind) of the keys in a part of a run, in base64 or hexadecimal, wherever they start; their own lengths tell where they end."""
    for piece in _PIECE.finditer(run, at, to):
        value, at = piece[1], 0
        decoded = _Decoded(value)
        while mark := _START.search(value, at):
            start = mark.start()
            data, offset, group = decoded.at(start, mark[0][0] in "36")
            found = _sized(data, offset)
            if found is None:
                at = start + 1
                continue
            kind, end = found
            at = start + (2 * (end - offset) if group == 2 else -(-4 * (end - offset) // 3))
            # The padding belongs to a key that ends with its piece.
            yield piece.start() + start, piece.end() if at == len(value) else piece.start() + at, kind


class _Decoded:
    """The bytes of a piece, decoded once for each place in a group of characters (4 in base64, 2 in hexadecimal) that a key may start at."""

    def __init__(self, value: str):
        self.value = value
        self.digits = (0, 0)
        self.made: dict[tuple[int, int, int], bytes] = {}

    def at(self, start: int, hexadecimal: bool) -> tuple[bytes, int, int]:
        """The bytes that hold those of a start, where these begin, and how many characters make a group."""
        if not hexadecimal:
            return self._read(0, len(self.value), start % 4, 4), start // 4 * 3, 4
        if start >= self.digits[1]:  # starts ascend
            self.digits = _HEXADECIMAL.match(self.value, start).span()
        first, end = self.digits
        return self._read(first, end, (start - first) % 2, 2), (start - first) // 2, 2

    def _read(self, first: int, end: int, shift: int, group: int) -> bytes:
        key = (first, shift, group)
        if key not in self.made:
            part = self.value[first + shift : end]
            part = part[: len(part) - (len(part) % 2 if group == 2 else len(part) % 4 == 1)]
            self.made[key] = (_hexadecimal if group == 2 else _base64)(part) or b""
        return self.made[key]


def _sized(data: bytes, at: int) -> tuple[str, int] | None:
    """Kind and end of the key that starts at a place."""
    if data.startswith(_MAGIC, at):
        end = _openssh(data, at)
        return ("openssh", end) if end else None
    top = _field(data, at, len(data))
    kind = _key(data, at, top[2]) if top and top[0] == 0x30 else None
    return (kind, top[2]) if kind else None


def _hexadecimal(run: str) -> bytes | None:
    try:
        return bytes.fromhex(run)
    except ValueError:
        return None


def _field(data: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """Tag, start and end of the DER field at a place; None if it doesn't fit before end."""
    if at + 2 > end:
        return None
    tag, n, at = data[at], data[at + 1], at + 2
    if n >= 0x80:
        size = n & 0x7F
        if not 1 <= size <= 4 or at + size > end:
            return None
        n, at = int.from_bytes(data[at : at + size], "big"), at + size
        if n < 0x80:
            return None
    return (tag, at, at + n) if at + n <= end else None


def _fields(data: bytes, at: int, end: int) -> list[tuple[int, int, int]] | None:
    """The DER fields that fill a range exactly; None if they don't, or are more than any key has."""
    out = []
    while at < end:
        field = _field(data, at, end)
        if field is None or len(out) == _MOST_FIELDS:
            return None
        out.append(field)
        at = field[2]
    return out


def _numbers(data: bytes, parts: list[tuple[int, int, int]]) -> list[int]:
    return [int.from_bytes(data[start:end], "big") for _, start, end in parts]


def _rsa(data: bytes, parts: list[tuple[int, int, int]]) -> bool:
    """Whether fields are those of PKCS#1: version, modulus, exponents, primes, ..., and the modulus is the product of the primes."""
    if len(parts) < 9 or {t for t, _, _ in parts[:9]} != {0x02} or data[parts[0][1] : parts[0][2]] not in (b"\0", b"\1"):
        return False
    primes = parts[4:6]
    if data[parts[0][1]] == 1:  # further primes
        more = _fields(data, *parts[9][1:]) if len(parts) == 10 and parts[9][0] == 0x30 else None
        each = [_fields(data, *m[1:]) for m in more or [] if m[0] == 0x30]
        if not each or len(each) < len(more) or not all(e and [t for t, _, _ in e] == [0x02] * 3 for e in each):
            return False
        primes = primes + [e[0] for e in each]
    elif len(parts) != 9:
        return False
    # Lengths and last bytes are compared first, as products take long; a number may start with a zero byte.
    modulus, size = parts[1], sum(end - start for _, start, end in primes)
    if not 0 <= size - (modulus[2] - modulus[1]) <= 2 * len(primes):
        return False
    if modulus[2] - modulus[1] > _MOST_BYTES:
        return False
    ends = _numbers(data, [(t, max(start, end - 8), end) for t, start, end in (modulus, *primes)])
    if (math.prod(ends[1:]) - ends[0]) % (1 << 64):
        return False
    numbers = _numbers(data, primes)
    return min(numbers) > 1 and math.prod(numbers) == _numbers(data, [modulus])[0]


def _dsa(data: bytes, parts: list[tuple[int, int, int]]) -> bool:
    """Whether fields are those of a DSA key: version, p, q that divides p - 1, generator, public and private number."""
    if [t for t, _, _ in parts] != [0x02] * 6 or data[parts[0][1] : parts[0][2]] != b"\0":
        return False
    sizes = [end - start for _, start, end in parts[1:]]
    if not 64 <= sizes[0] <= _MOST_BYTES or not 20 <= sizes[1] <= sizes[0] or max(sizes[2:4]) > sizes[0] or sizes[4] > sizes[1]:
        return False
    p, q, g, y, x = _numbers(data, parts[1:])
    return 0 < x < q and max(g, y) < p and (p - 1) % q == 0


def _key(data: bytes, at: int, end: int) -> str | None:
    """The kind of the key that fills a range exactly."""
    if data.startswith(_MAGIC, at):
        return "openssh" if _openssh(data, at) == end else None
    top = _field(data, at, end)
    if top is None or top[0] != 0x30 or top[2] != end:
        return None
    parts = _fields(data, top[1], top[2])
    if not parts:
        return None
    tags = [t for t, _, _ in parts]
    value = data[parts[0][1] : min(parts[0][2], parts[0][1] + 2)]
    if _rsa(data, parts) or _dsa(data, parts):
        return "der"
    if tags[:3] == [0x02, 0x30, 0x04] and value in (b"\0", b"\1"):  # PKCS#8
        algorithm = _fields(data, *parts[1][1:])
        if not algorithm or algorithm[0][0] != 0x06:
            return None
        return "der" if _inner(data[algorithm[0][1] : min(algorithm[0][2], algorithm[0][1] + 16)], data, *parts[2][1:]) else None
    if tags[:2] == [0x02, 0x04] and value == b"\1" and parts[1][2] - parts[1][1] >= 16:
        return "der"  # SEC 1
    if tags == [0x30, 0x04]:  # PKCS#8, encrypted
        algorithm = _fields(data, *parts[0][1:])
        return "der" if algorithm and algorithm[0][0] == 0x06 and data.startswith(_ENCRYPTION, algorithm[0][1], algorithm[0][2]) else None
    return None


def _inner(algorithm: bytes, data: bytes, at: int, end: int) -> bool:
    """Whether the key inside PKCS#8 has the structure of its algorithm; that of an unknown algorithm is not looked at."""
    field = _field(data, at, end)
    fills = field is not None and field[2] == end
    parts = _fields(data, field[1], field[2]) if fills and field[0] == 0x30 else None
    if algorithm == _RSA:
        return bool(parts) and _rsa(data, parts)
    if algorithm == _EC:
        return bool(parts) and [t for t, _, _ in parts[:2]] == [0x02, 0x04] and data[parts[0][1] : parts[0][2]] == b"\1"
    if algorithm in _CURVES:
        return fills and field[0] == 0x04
    if algorithm in _NUMBERS:
        return fills and field[0] == 0x02
    return True


def _openssh(data: bytes, at: int = 0) -> int | None:
    """Where the OpenSSH key ends that starts at a place."""
    at += len(_MAGIC)

    def take() -> int | None:
        nonlocal at
        n = int.from_bytes(data[at : at + 4], "big")
        if at + 4 + n > len(data):
            return None
        at += 4 + n
        return n

    if any(take() is None for _ in range(3)):  # cipher, key derivation, its options
        return None
    keys = int.from_bytes(data[at : at + 4], "big")
    at += 4
    return at if 1 <= keys <= 16 and all(take() for _ in range(keys + 1)) else None


def _token(run: str, at: int = 0) -> tuple[int, int] | None:
    """Start and end of the first signed or encrypted token from a place in a run on: 3 or 5 parts, JSON first."""
    while m := _PARTS.search(run, at):
        parts = m[0].split(".")
        at = m.start() + len(parts[0])  # where it is no header, the next part may be one
        if len(parts) == 4:
            parts = parts[:3]
        found = _header(parts[0])
        if found is None:
            continue
        start, header = found
        if len(parts) == 5 and not ("enc" in header and all(_base64(p) is not None for p in parts[1:])):
            parts = parts[:3]
        if len(parts) == 3 and not (isinstance(_json(parts[1]), dict) and _base64(parts[2]) is not None):
            continue
        return m.start() + start, m.start() + len(".".join(parts))
    return None


def _header(part: str) -> tuple[int, dict] | None:
    """The JSON header that names an algorithm and ends with a part, wherever in the part it starts, and its start; the leftmost one."""
    whole = _json(part)
    if isinstance(whole, dict) and isinstance(whole.get("alg"), str):
        return 0, whole
    found = []
    for shift in range(4):
        length = len(part) - shift
        if length % 4 == 1 or length < 8 or (_base64(part[shift + max(length // 4 - 1, 0) * 4 :]) or b"")[-1:] != b"}":
            continue
        data = _base64(part[shift:]) or b""
        start = _opened(data)
        if start is not None and start % 3 == 0 and (start or shift):
            header = _parsed(data[start:])
            if isinstance(header, dict) and isinstance(header.get("alg"), str):
                found.append((shift + start // 3 * 4, header))
    return min(found, key=lambda f: f[0], default=None)


def _opened(data: bytes) -> int | None:
    """Where the JSON object starts that ends with the last byte, found from behind by quotes that no backslash escapes and by braces outside strings."""
    flat = np.frombuffer(data, np.uint8)
    at = np.arange(len(flat))
    plain = np.maximum.accumulate(np.where(flat != 0x5C, at, -1))  # the last place up to here that is no backslash
    slashes = np.append(0, (at - plain)[:-1])
    quote = (flat == 0x22) & (slashes % 2 == 0)
    outside = np.cumsum(quote[::-1])[::-1] % 2 == 0
    step = np.where(np.isin(flat, (0x7D, 0x5D)), 1, np.where(np.isin(flat, (0x7B, 0x5B)), -1, 0)) * outside
    closed = np.flatnonzero((np.cumsum(step[::-1]) == 0) & (step[::-1] == -1))
    return len(flat) - 1 - int(closed[0]) if len(closed) else None


def _json(part: str):
    return _parsed(_base64(part))


def _parsed(data: bytes | None):
    try:
        return json.loads(data) if data else None
    except (ValueError, UnicodeDecodeError, RecursionError):
        return None


def with_runs(array: pa.Array, n: int = 32) -> np.ndarray:
    """Which texts hold n characters in a row out of which runs are made; n is a power of two."""
    flat, offsets = bytes_of(array)
    inside = _RUN_BYTES[flat]
    step = 1
    while step < n and len(inside) > step:
        inside = inside[:-step] & inside[step:]
        step *= 2
    if step < n:
        return np.zeros(len(array), bool)
    # A run over a text's edge only makes its text a candidate too.
    total = np.concatenate([[0], np.cumsum(inside)])
    return total[np.minimum(offsets[1:], len(inside))] > total[np.minimum(offsets[:-1], len(inside))]


SCHEMA = T.StructType(
    [
        T.StructField("id", T.LongType()),
        *(T.StructField(f"n_{k}", T.LongType()) for k in KINDS),
        T.StructField("base_sha256", T.StringType()),
        T.StructField("spans", T.StringType()),
    ]
)


def _listed(found: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in found)


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, the number of spans of each kind, SHA-256 of the list of base spans, and all spans as kind:start:end."""

    def run(columns):
        found = [spans(x, c) for x, c in zip(columns[1].to_pylist(), with_runs(columns[1]).tolist(), strict=True)]
        yield {
            "id": columns[0],
            **{f"n_{k}": [sum(s[0] == k for s in f) for f in found] for k in KINDS},
            "base_sha256": [hashlib.sha256(_listed([s for s in f if s[0] in BASE]).encode()).hexdigest() for f in found],
            "spans": list(map(_listed, found)),
        }

    return map_columns(texts(df, id_col, text_col), SCHEMA, run)


def redact(df: DataFrame, text_col: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """The rows with each secret's span (overlapping ones as one) replaced by mask; null texts stay null."""

    @F.pandas_udf("string")
    def cleaned(column):
        have = column.notna()
        rows = pa.RecordBatch.from_arrays([pa.array(column.where(have, ""), pa.string())], names=["text"])
        out: list[str] = []
        for part in slices(rows, 0):
            known = part.column(0)
            out += [_masked(x, c, mask) for x, c in zip(known.to_pylist(), with_runs(known).tolist(), strict=True)]
        return column.where(~have, pd.Series(out, dtype=object, index=column.index))

    return df.withColumn(text_col, cleaned(F.col(text_col)))


def _masked(text: str, candidate: bool, mask: str) -> str:
    found = spans(text, candidate)
    if not found:
        return text
    out, at = [], 0
    for _, start, end in found:
        if start >= at:
            out += [text[at:start], mask]
        at = max(at, end)
    return "".join([*out, text[at:]])
