"""Operator 10: media columns in Ogg.

store() keeps a payload as the packets of a logical stream of unsigned 8-bit samples, multiplexed
with a second logical stream that holds a comment packet. read() takes any Ogg bytes apart again:
it verifies each page's checksum, reassembles packets from the lacing values, over pages too,
demultiplexes the logical streams by serial number, and derives timestamps from granule positions.

A page that is damaged (checksum, version, cut short) is left out and counted; so is a packet that
lacks a part because of a gap in the page numbers. Media that are null or hold no stream of samples, as foreign or broken
ones, have an empty payload and an empty feature.

Null payload or text: empty. Null id: kept. Repeated rows: one result each. Empty table: none.
Other columns of the input are not read, so their names cannot clash.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from corpusloom.llm.batches import map_columns, texts

FRAME = 576
"""Samples in a packet."""
RATE = 8000
"""Samples a second."""
HEAD = struct.Struct("<4sBBqIIIB")  # capture, version, flags, granule position, serial, page number, checksum, segments
CONTINUED, FIRST, LAST = 1, 2, 4
_ID = struct.Struct("<8sIHH")  # magic, rate, samples in a packet, fill bytes
_REVERSED = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


def checksum(page: bytes) -> int:
    """Ogg's CRC-32 (polynomial 0x04C11DB7, most significant bit first, from 0) of a page whose checksum field is 0.

    With the bits of each byte reversed it is zlib's CRC without its inversions, bit-reversed.
    """
    crc = zlib.crc32(page.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(crc.to_bytes(4, "little").translate(_REVERSED), "big")


def _page(flags: int, granule: int, serial: int, number: int, lacing: bytes, body: bytes) -> bytes:
    head = HEAD.pack(b"OggS", 0, flags, granule, serial, number, 0, len(lacing)) + lacing
    return head[:22] + checksum(head + body).to_bytes(4, "little") + head[26:] + body


def store(payload: bytes, fill: int = 0) -> bytes:
    """The Ogg bytes of a payload of whole frames. Equal payloads give equal bytes: the serial numbers come from the content."""
    serial = zlib.crc32(payload)
    about = (serial + 1) & 0xFFFFFFFF
    out = [_page(FIRST, 0, serial, 0, bytes([_ID.size]), _ID.pack(b"rawPCM8\0", RATE, FRAME, fill))]
    note = b"comment\0" + hashlib.md5(payload, usedforsecurity=False).digest()
    out.append(_page(FIRST, 0, about, 0, bytes([len(note)]), note))
    lacing_of_frame = bytes([255] * (FRAME // 255) + [FRAME % 255])
    in_page = 255 // len(lacing_of_frame)
    frames = len(payload) // FRAME
    for number, at in enumerate(range(0, frames, in_page), 1):
        to = min(frames, at + in_page)
        out.append(_page(LAST if to == frames else 0, to * FRAME, serial, number, lacing_of_frame * (to - at), payload[at * FRAME : to * FRAME]))
    out.append(_page(LAST, 0, about, 1, b"\0", b""))
    return b"".join(out)


@dataclass
class Stream:
    """A logical stream: its packets, and for each the granule position of the page on which it ends (-1: none)."""

    serial: int
    packets: list[bytes] = field(default_factory=list)
    granules: list[int] = field(default_factory=list)
    pages: int = 0
    gaps: int = 0
    ended: bool = False
    _next: int = 0
    _part: list[bytes] | None = None


@dataclass
class Ogg:
    streams: dict[int, Stream]
    pages: int
    damaged: int


def read(data: bytes) -> Ogg:
    """Takes Ogg bytes apart; see the head of this module for what becomes of damaged pages."""
    out, at = Ogg({}, 0, 0), 0
    while (at := data.find(b"OggS", at)) >= 0:
        if at + HEAD.size > len(data):
            out.damaged += 1
            break
        _, version, flags, granule, serial, number, crc, n = HEAD.unpack_from(data, at)
        body = at + HEAD.size + n
        lacing = data[at + HEAD.size : body]
        end = body + sum(lacing)
        whole = version == 0 and len(lacing) == n and end <= len(data)
        if not whole or checksum(data[at : at + 22] + b"\0\0\0\0" + data[at + 26 : end]) != crc:
            out.damaged += 1
            at += 4
            continue
        out.pages += 1
        _packets(out.streams.setdefault(serial, Stream(serial)), flags, granule, number, lacing, data[body:end])
        at = end
    for s in out.streams.values():
        s.gaps += s._part is not None
    return out


def _packets(s: Stream, flags: int, granule: int, number: int, lacing: bytes, body: bytes) -> None:
    if number != s._next:
        s.gaps += 1
        s._part = None
    whole = not flags & CONTINUED or s._part is not None
    if not flags & CONTINUED and s._part is not None:
        s.gaps += 1
    if not flags & CONTINUED or s._part is None:
        s._part = None
    s._next, s.pages, s.ended = number + 1, s.pages + 1, s.ended or bool(flags & LAST)
    at = size = 0
    for value in lacing:
        size += value
        if value < 255:
            if whole:
                s.packets.append(b"".join([*(s._part or ()), body[at : at + size]]))
                s.granules.append(granule)
            s._part, whole, at, size = None, True, at + size, 0
    if lacing and lacing[-1] == 255:
        s._part = [*(s._part or ()), body[at : at + size]] if whole else None


def samples(ogg: Ogg) -> tuple[bytes, int, float, int] | None:
    """Payload, rate, seconds by the last granule position, and fill bytes of the stream of 8-bit samples; None without one."""
    for s in ogg.streams.values():
        if s.packets and s.packets[0][:8] == b"rawPCM8\0" and len(s.packets[0]) == _ID.size:
            _, rate, _, fill = _ID.unpack(s.packets[0])
            rate = rate or RATE
            return b"".join(s.packets[1:]), rate, max(s.granules[1:], default=0) / rate, fill
    return None


def padded(data: bytes) -> bytes:
    """The data with bytes 255 up to a positive multiple of FRAME."""
    return data.ljust(max(1, -(-len(data) // FRAME)) * FRAME, b"\xff")


def feature(payload: bytes, seconds: float) -> str:
    """Duration, loudness (root of the mean square about 128), zero crossings and the entropy of the samples, of what was read back."""
    if not payload:
        return ""
    x = np.frombuffer(payload, np.uint8)
    level = x.astype(np.int64) - 128
    share = np.bincount(x, minlength=256) / len(x)
    share = share[share > 0]
    crossings = int(np.count_nonzero((level[1:] >= 0) != (level[:-1] >= 0)))
    return f"s={seconds:.3f};rms={np.sqrt(np.mean(level * level)):.4f};zc={crossings};h={-(share * np.log2(share)).sum():.4f}"


SCHEMA = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("n_bytes", T.LongType()),
        T.StructField("media", T.BinaryType()),
    ]
)
DIGESTS = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("n_bytes", T.LongType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_sha256", T.StringType()),
        T.StructField("tail_crc32", T.LongType()),
        T.StructField("media_bytes", T.LongType()),
        T.StructField("media_sha256", T.StringType()),
        T.StructField("feature", T.StringType()),
        T.StructField("n_pages", T.LongType()),
        T.StructField("n_damaged", T.LongType()),
    ]
)


def _stored(text: str) -> tuple[int, bytes]:
    data = text.encode("utf-8", "surrogatepass")
    payload = padded(data)
    return len(data), store(payload, len(payload) - len(data))


def to_media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes and the Ogg bytes of each row's text as a media column."""

    def run(columns):
        made = [_stored(x) for x in columns[1].to_pylist()]
        yield {"id": columns[0], "n_bytes": [n for n, _ in made], "media": [m for _, m in made]}

    return map_columns(texts(df, id_col, text_col), SCHEMA, run)


def described(df: DataFrame) -> DataFrame:
    """Digests and features of a media column as to_media() gives it, all from the bytes read back."""

    def run(columns):
        ids, sizes, media = columns
        out: dict[str, list] = {f.name: [] for f in DIGESTS}
        for n, data in zip(sizes.to_pylist(), media.to_pylist(), strict=True):
            data = data or b""
            ogg = read(data)
            payload, _, seconds, _ = samples(ogg) or (b"", RATE, 0.0, 0)
            row = (n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(data), hashlib.sha256(data).hexdigest(), feature(payload, seconds), ogg.pages, ogg.damaged)
            for f, value in zip(DIGESTS.names[1:], row, strict=True):
                out[f].append(value)
        yield out | {"id": ids}

    return map_columns(df.select("id", "n_bytes", "media"), DIGESTS, run, column=2)
