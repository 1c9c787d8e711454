"""Media columns: MPEG transport streams as a binary column.

``mux`` stores a payload as 188-byte packets: a program association table, a
program map table, and packetised elementary packets of up to ``PES_BYTES``
payload bytes, each with a presentation time stamp; the first packet of every
``GROUP``-th elementary packet is a random-access point and carries the program
clock.  ``demux`` parses streams of 188-byte packets that are not scrambled: it
reassembles the sections of the program tables, over packets where they are long,
checks continuity counters (a packet may be repeated once, and a marked
discontinuity is none), reassembles the elementary packets and returns time stamps
and random-access points.  Both work on whole packet arrays in numpy.

Defined results: a null or empty text is stored as 64 zero bytes; equal texts
give equal streams; a damaged stream never fails: what is wrong with it (lost
sync or continuity, tables or elementary packets that are cut short or missing)
is counted in the result, beside what could be reassembled; an input column that
has the name of a result is replaced by it; repeated rows give repeated rows; an
empty table gives an empty result.  A row's stream and payload are in memory as a
whole, about four times the text.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .frames import append
from .textops import flat

#: Fixed values of the container format.
PACKET, SYNC, CLOCK = 188, 0x47, 90_000
PAT_PID, PMT_PID, STREAM_PID, NULL_PID = 0, 0x1000, 0x0100, 0x1FFF
STREAM_TYPE, STREAM_ID, PROGRAM = 0x06, 0xBD, 1
PAT_TABLE, PMT_TABLE = 0x00, 0x02

ALIGN = 64
PES_BYTES = 32_768
#: Clock ticks between elementary packets, and elementary packets between random-access points.
TICKS, GROUP = 3_600, 8


@cache
def _crc_table() -> list[int]:
    out = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = (c << 1) ^ 0x04C11DB7 if c & 0x80000000 else c << 1
        out.append(c & 0xFFFFFFFF)
    return out


def section_crc(data: bytes) -> int:
    """The CRC-32 of program tables (most significant bit first, no final inversion)."""
    c = 0xFFFFFFFF
    for b in data:
        c = (c << 8 & 0xFFFFFFFF) ^ _crc_table()[c >> 24 ^ b]
    return c


@cache
def _table_packet(pid: int, body: bytes) -> bytes:
    section = body + section_crc(body).to_bytes(4, "big")
    head = bytes([SYNC, 0x40 | pid >> 8, pid & 0xFF, 0x10, 0])
    return (head + section).ljust(PACKET, b"\xff")


@cache
def tables() -> bytes:
    pat = bytes([0x00, 0xB0, 13, 0, 1, 0xC1, 0, 0, PROGRAM >> 8, PROGRAM & 0xFF, 0xE0 | PMT_PID >> 8, PMT_PID & 0xFF])
    pmt = bytes([0x02, 0xB0, 18, PROGRAM >> 8, PROGRAM & 0xFF, 0xC1, 0, 0, 0xE0 | STREAM_PID >> 8, STREAM_PID & 0xFF, 0xF0, 0, STREAM_TYPE, 0xE0 | STREAM_PID >> 8, STREAM_PID & 0xFF, 0xF0, 0])
    return _table_packet(PAT_PID, pat) + _table_packet(PMT_PID, pmt)


def stamp(value: int, mark: int = 0x20) -> bytes:
    """A 33-bit time stamp in five bytes with marker bits."""
    return bytes([mark | value >> 29 & 0x0E | 1, value >> 22 & 0xFF, value >> 14 & 0xFE | 1, value >> 7 & 0xFF, value << 1 & 0xFE | 1])


def _elementary(pes: bytes, counter: int, clock: int | None) -> bytes:
    """One elementary packet as transport packets; ``clock`` marks a random-access point."""
    lead = 0 if clock is None else 8  # bytes of the adaptation field that carries the clock
    room = PACKET - 4
    n = -(-(len(pes) + lead) // room)
    spare = n * room - lead - len(pes)
    out = np.full((n, PACKET), 0xFF, np.uint8)
    out[:, 0], out[:, 1], out[:, 2] = SYNC, STREAM_PID >> 8, STREAM_PID & 0xFF
    out[0, 1] |= 0x40
    out[:, 3] = 0x10 | (counter + np.arange(n)) & 0x0F
    body = np.frombuffer(pes, np.uint8)
    first = min(len(pes), room - lead - (spare if n == 1 else 0))
    if clock is not None:
        pad = spare if n == 1 else 0
        out[0, 3] |= 0x20
        base = clock
        out[0, 4 : 4 + 8] = [7 + pad, 0x50, base >> 25 & 0xFF, base >> 17 & 0xFF, base >> 9 & 0xFF, base >> 1 & 0xFF, (base & 1) << 7 | 0x7E, 0]
    out[0, PACKET - first :] = body[:first]
    if n > 1:
        middle = (n - 2) * room
        out[1:-1, 4:] = body[first : first + middle].reshape(n - 2, room)
        tail = body[first + middle :]
        out[-1, PACKET - len(tail) :] = tail
    if spare and (n > 1 or clock is None):
        out[-1, 3] |= 0x20
        out[-1, 4] = spare - 1
        if spare > 1:
            out[-1, 5] = 0
    return out.tobytes()


def mux(payload: bytes) -> bytes:
    parts, counter = [tables()], 0
    for k, at in enumerate(range(0, max(len(payload), 1), PES_BYTES)):
        data = payload[at : at + PES_BYTES]
        time = k * TICKS & (1 << 33) - 1
        pes = b"\x00\x00\x01" + bytes([STREAM_ID]) + (len(data) + 8).to_bytes(2, "big") + bytes([0x84, 0x80, 5]) + stamp(time) + data
        packets = _elementary(pes, counter, time if k % GROUP == 0 else None)
        counter += len(packets) // PACKET
        parts.append(packets)
    return b"".join(parts)


@dataclass
class Demuxed:
    payload: bytes = b""
    packets: int = 0
    sync_errors: int = 0
    table_errors: int = 0
    continuity_errors: int = 0
    programs: dict[int, int] = field(default_factory=dict)
    streams: dict[int, int] = field(default_factory=dict)
    times: list[int] = field(default_factory=list)
    #: Time stamps at which decoding can begin.
    access: list[int] = field(default_factory=list)

    def feature(self) -> str:
        span = f"{self.times[0]}-{self.times[-1]}" if self.times else "-"
        return f"packets={self.packets};streams={len(self.streams)};pes={len(self.times)};pts={span};access={len(self.access)};errors={self.sync_errors + self.table_errors + self.continuity_errors}"


class Packets:
    """The packets of a stream that are in sync, as arrays."""

    def __init__(self, p: np.ndarray):
        self.p = p
        self.pid = (p[:, 1].astype(np.int64) & 0x1F) << 8 | p[:, 2]
        self.unit = (p[:, 1] & 0x40) > 0
        self.adapt, self.has = (p[:, 3] & 0x20) > 0, (p[:, 3] & 0x10) > 0
        self.start = np.minimum(4 + np.where(self.adapt, p[:, 4].astype(np.int64) + 1, 0), PACKET)
        flags = np.where(self.adapt & (p[:, 4] > 0), p[:, 5], 0)
        self.discontinuity, self.random = (flags & 0x80) > 0, (flags & 0x40) > 0

    def of(self, pid: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of the packets with a payload of one kind, without allowed repeats, and which of them do not follow the one before."""
        own = np.flatnonzero((self.pid == pid) & self.has)
        counter = (self.p[own, 3] & 0x0F).astype(np.int64)
        a, b = own[:-1], own[1:]
        payload = np.arange(PACKET) >= self.start[b, None]
        same = (np.diff(counter) == 0) & (self.start[a] == self.start[b]) & ((self.p[a] == self.p[b]) | ~payload).all(1)
        again = np.zeros(len(own), bool)
        for k in np.flatnonzero(same).tolist():
            again[k + 1] = not again[k]  # once only: a third one is an error
        own, counter = own[~again], counter[~again]
        broken = np.append(False, (np.diff(counter) % 16 != 1) & ~self.discontinuity[own[1:]])[: len(own)]
        return own, broken

    def sections(self, pid: int) -> Iterator[bytes | None]:
        """The table sections of one kind without their checksums; None for one that is cut short or damaged."""
        held: bytes | None = None
        own, broken = self.of(pid)
        for i, lost in zip(own.tolist(), broken.tolist(), strict=True):
            data = self.p[i, self.start[i] :].tobytes()
            if lost and held:
                yield None
                held = None
            if self.unit[i]:
                pointer = data[0] if data else 0
                if held:
                    held += data[1 : 1 + pointer]
                    whole, held = _split(held)
                    yield from whole
                    if held:  # another one begins before this one has ended
                        yield None
                if not data or 1 + pointer > len(data):
                    yield None
                    held = None
                    continue
                held = data[1 + pointer :]
            elif held:
                held += data
            if held:
                whole, held = _split(held)
                yield from whole
        if held:
            yield None


def _split(data: bytes) -> tuple[list[bytes | None], bytes]:
    """The whole sections at the start of ``data``, and what is left; stuffing ends them."""
    out: list[bytes | None] = []
    while data and data[0] != 0xFF:
        size = 3 + (int.from_bytes(data[1:3], "big") & 0x0FFF)
        if len(data) < max(3, size):
            return out, data
        section = data[:size]
        out.append(section[:-4] if size > 12 and section_crc(section) == 0 else None)
        data = data[size:]
    return out, b""


def demux(stream: bytes) -> Demuxed:
    out = Demuxed()
    n = len(stream) // PACKET
    p = np.frombuffer(stream, np.uint8, n * PACKET).reshape(n, PACKET)
    good = p[:, 0] == SYNC
    out.packets, out.sync_errors = n, int(n - good.sum()) + bool(len(stream) % PACKET)
    packets = Packets(p[good])
    for body in packets.sections(PAT_PID):
        out.table_errors += body is None
        for at in range(8, len(body) - 3 if body and body[0] == PAT_TABLE else 0, 4):
            if number := int.from_bytes(body[at : at + 2], "big"):
                out.programs[number] = int.from_bytes(body[at + 2 : at + 4], "big") & 0x1FFF
    for pid in dict.fromkeys(out.programs.values()):
        for body in packets.sections(pid):
            out.table_errors += body is None
            if not body or body[0] != PMT_TABLE:
                continue
            at = 12 + (int.from_bytes(body[10:12], "big") & 0x0FFF)
            while at + 5 <= len(body):
                out.streams[int.from_bytes(body[at + 1 : at + 3], "big") & 0x1FFF] = body[at]
                at += 5 + (int.from_bytes(body[at + 3 : at + 5], "big") & 0x0FFF)
    out.table_errors += not out.streams
    parts = []
    for stream_pid in out.streams:
        own, broken = packets.of(stream_pid)
        out.continuity_errors += int(broken.sum())
        q, begin = packets.p[own], packets.start[own]
        data = q[np.arange(PACKET) >= begin[:, None]].tobytes()
        ends = np.append(0, np.cumsum(PACKET - begin))
        heads = np.flatnonzero(packets.unit[own])
        out.table_errors += not len(heads)
        for a, b in zip(heads, np.append(heads, len(own))[1:], strict=True):
            pes = data[ends[a] : ends[b]]
            if pes[:3] != b"\x00\x00\x01" or len(pes) < 9 or len(pes) < 9 + pes[8]:
                out.table_errors += 1
                continue
            length, flags, head = int.from_bytes(pes[4:6], "big"), pes[7], pes[8]
            out.table_errors += bool(length) and len(pes) < 6 + length
            if flags & 0x80 and head >= 5:
                t = pes[9:14]
                time = (t[0] >> 1 & 7) << 30 | t[1] << 22 | t[2] >> 1 << 15 | t[3] << 7 | t[4] >> 1
                out.times.append(time)
                if packets.random[own[a]]:
                    out.access.append(time)
            parts.append(pes[9 + head : 6 + length if length else len(pes)])
    out.payload = b"".join(parts)
    return out


def payload_of(text: bytes) -> bytes:
    """The text with zero bytes up to a positive multiple of ``ALIGN``."""
    return text.ljust(max(ALIGN, -(-len(text) // ALIGN) * ALIGN), b"\0")


def _texts(batch: pa.RecordBatch, text_col: str) -> list[bytes]:
    data, offsets = flat(batch.column(batch.schema.get_field_index(text_col)))
    whole, at = data.tobytes(), offsets.tolist()
    return [whole[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


def store(df: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``df`` with ``media``: each text's payload as a transport stream."""
    fields = T.StructType([T.StructField("media", T.BinaryType())])
    return append(df, text_col, fields, lambda batch: [pa.array([mux(payload_of(t)) for t in _texts(batch, text_col)], pa.binary())], keep)


def read(df: DataFrame, media_col: str = "media", keep: list[str] | None = None) -> DataFrame:
    """``df`` with the payload, time stamps and random-access points of each stream (a null stream is an empty one)."""
    fields = T.StructType([T.StructField("payload", T.BinaryType()), T.StructField("pts", T.ArrayType(T.LongType())), T.StructField("access_points", T.ArrayType(T.LongType())), T.StructField("continuity_errors", T.LongType()), T.StructField("feature", T.StringType())])

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        got = [demux(t) for t in _texts(batch, media_col)]
        return [pa.array([d.payload for d in got], pa.binary()), pa.array([d.times for d in got], pa.list_(pa.int64())), pa.array([d.access for d in got], pa.list_(pa.int64())), pa.array([d.continuity_errors for d in got], pa.int64()), pa.array([d.feature() for d in got], pa.string())]

    return append(df, media_col, fields, make, keep)


DIGEST = T.StructType([T.StructField(c, T.StringType() if c in ("payload_sha256", "media_sha256", "feature") else T.LongType()) for c in ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")])


def digest(df: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """What ``store`` and then ``read`` give for each text, as sizes and hashes; the streams stay in the worker."""

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        rows = []
        for text in _texts(batch, text_col):
            media = mux(payload_of(text))
            got = demux(media)
            rows.append((len(text), len(got.payload), hashlib.sha256(got.payload).hexdigest(), zlib.crc32(got.payload[-ALIGN:]), len(media), hashlib.sha256(media).hexdigest(), got.feature()))
        return [pa.array(c, pa.string() if f.dataType == T.StringType() else pa.int64()) for c, f in zip(zip(*rows, strict=True), DIGEST, strict=True)]

    return append(df, text_col, DIGEST, make, keep)
