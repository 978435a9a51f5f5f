"""Media columns: MPEG transport streams.

``multiplexed`` stores a payload as one program with one private elementary
stream: access units in PES packets with time stamps, program tables before each
random-access point. ``parsed`` reads any transport stream of whole 188-byte
packets: program association and map sections (also over several packets, with
their CRC), continuity counters with duplicates and announced discontinuities,
adaptation fields, PES packets of bounded or open length, PTS and DTS, and for
every access unit its packet number and whether it is a random-access point, so
that a decoder can start there.

Nulls: a null payload is an empty payload, a null medium has status 'null' and no
units. Damage never raises: lost synchronisation, a wrong CRC, a gap in a counter
and a truncated unit are counted, and whole units are kept. Empty tables give
empty results; rows of any id, null or repeated, are treated alike. Columns to
keep are named by the caller.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binary_array, column, set_apart, slices

#: Fixed values of the format.
PACKET, SYNC, NULL_PID = 188, 0x47, 0x1FFF
PAT_PID, PAT_TABLE, PMT_TABLE = 0, 0, 2
PRIVATE_STREAM, PRIVATE_TYPE, CLOCK = 0xBD, 0x06, 90_000
#: Choices of the writer.
PMT_PID, DATA_PID, PROGRAM = 0x1000, 0x0100, 1
UNIT = 8192  # payload bytes of an access unit
KEY_EVERY = 4  # access units from one random-access point to the next
RATE = 25  # access units a second


def _crc_row(i: int) -> int:
    i <<= 24
    for _ in range(8):
        i = (i << 1) ^ (0x04C11DB7 if i & 0x80000000 else 0)
    return i & 0xFFFFFFFF


_CRC = [_crc_row(i) for i in range(256)]


@lru_cache(maxsize=256)
def section_crc(data: bytes) -> int:
    """CRC-32 of program sections; 0 over a section with its own CRC at the end."""
    crc = 0xFFFFFFFF
    for b in data:
        crc = ((crc << 8) & 0xFFFFFFFF) ^ _CRC[(crc >> 24) ^ b]
    return crc


# ---------------------------------------------------------------- writing
def section(table: int, number: int, body: bytes) -> bytes:
    head = bytes([table]) + (0xB000 | len(body) + 9).to_bytes(2, "big") + number.to_bytes(2, "big") + b"\xc1\0\0" + body
    return head + section_crc(head).to_bytes(4, "big")


TABLES = (
    (PAT_PID, section(PAT_TABLE, 1, PROGRAM.to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big"))),
    (PMT_PID, section(PMT_TABLE, PROGRAM, (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\0" + bytes([PRIVATE_TYPE]) + (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\0")),
)


def stamp(kind: int, value: int) -> bytes:
    """A 33-bit time stamp in its five bytes."""
    return bytes([kind << 4 | (value >> 30 & 7) << 1 | 1, value >> 22 & 255, (value >> 15 & 127) << 1 | 1, value >> 7 & 255, (value & 127) << 1 | 1])


def clock_reference(value: int) -> bytes:
    return ((value & (1 << 33) - 1) << 15 | 0x3F << 9).to_bytes(6, "big")


def multiplex(payload: bytes, unit: int = UNIT, key_every: int = KEY_EVERY) -> bytes:
    """The transport stream of a payload."""
    out: list[bytes] = []
    counters = {PAT_PID: 0, PMT_PID: 0, DATA_PID: 0}

    def packet(pid: int, begins: bool, adaptation: bytes | None, data: bytes) -> None:
        mode = 0x10 if adaptation is None else 0x30
        out.append(bytes([SYNC, 0x40 * begins | pid >> 8, pid & 255, mode | counters[pid]]) + (b"" if adaptation is None else bytes([len(adaptation)]) + adaptation) + data)
        counters[pid] = counters[pid] + 1 & 15

    for n, at in enumerate(range(0, max(1, len(payload)), unit)):
        key, data, time = n % key_every == 0, payload[at : at + unit], (n * CLOCK // RATE + CLOCK) & (1 << 33) - 1
        if key:
            for pid, table in TABLES:
                packet(pid, True, None, b"\0" + table + b"\xff" * (183 - len(table)))
        pes = b"\0\0\1" + bytes([PRIVATE_STREAM]) + (8 + len(data)).to_bytes(2, "big") + b"\x84\x80\x05" + stamp(2, time) + data
        first = bytes([0x50 if key else 0x10]) + clock_reference(time)
        sent = 0
        while sent < len(pes):
            adaptation = first if not sent else None
            room = PACKET - 4 - (0 if adaptation is None else 1 + len(adaptation))
            piece = pes[sent : sent + room]
            spare = room - len(piece)
            if spare and adaptation is None:
                adaptation = b"" if spare == 1 else b"\0" + b"\xff" * (spare - 2)
            elif spare:
                adaptation += b"\xff" * spare
            packet(DATA_PID, not sent, adaptation, piece)
            sent += len(piece)
    return b"".join(out)


# ---------------------------------------------------------------- reading
@dataclass
class Unit:
    pid: int
    packet: int
    pts: int | None = None
    dts: int | None = None
    random_access: bool = False
    data: bytes = b""


@dataclass
class Stream:
    """What a transport stream holds."""

    packets: int = 0
    tables: int = 0
    programs: dict[int, int] = field(default_factory=dict)  # program -> PID of its map
    types: dict[int, int] = field(default_factory=dict)  # PID -> stream type
    units: list[Unit] = field(default_factory=list)
    lost_sync: int = 0
    bad_crc: int = 0
    gaps: int = 0
    truncated: int = 0

    def payload(self, pid: int) -> bytes:
        return b"".join(u.data for u in self.units if u.pid == pid)


def read_stamp(b: bytes) -> int:
    return (b[0] >> 1 & 7) << 30 | b[1] << 22 | b[2] >> 1 << 15 | b[3] << 7 | b[4] >> 1


def elementary(unit: Unit, raw: bytes, out: Stream) -> None:
    """Adds the access unit of one PES packet, if it is whole."""
    if len(raw) < 6 or raw[:3] != b"\0\0\1":
        out.truncated += 1
        return
    size, at = int.from_bytes(raw[4:6], "big"), 6
    if size and len(raw) < 6 + size:
        out.truncated += 1
        return
    end = 6 + size if size else len(raw)
    if raw[3] not in (0xBC, 0xBE, 0xBF, 0xF0, 0xF1, 0xF2, 0xF8, 0xFF):  # streams without the optional header
        if end < 9 or end < 9 + raw[8]:
            out.truncated += 1
            return
        flags, at = raw[7] >> 6, 9 + raw[8]
        if flags & 2 and raw[8] >= 5:
            unit.pts = unit.dts = read_stamp(raw[9:14])
        if flags == 3 and raw[8] >= 10:
            unit.dts = read_stamp(raw[14:19])
    unit.data = raw[at:end]
    out.units.append(unit)


def tables(pid: int, data: bytes, out: Stream) -> None:
    """Takes in one whole section."""
    if section_crc(bytes(data)):
        out.bad_crc += 1
        return
    out.tables += 1
    if data[0] == PAT_TABLE and pid == PAT_PID:
        for i in range(8, len(data) - 4, 4):
            number = int.from_bytes(data[i : i + 2], "big")
            if number:
                out.programs[number] = int.from_bytes(data[i + 2 : i + 4], "big") & 0x1FFF
    elif data[0] == PMT_TABLE:
        i = 12 + (int.from_bytes(data[10:12], "big") & 0xFFF)
        while i + 5 <= len(data) - 4:
            out.types[int.from_bytes(data[i + 1 : i + 3], "big") & 0x1FFF] = data[i]
            i += 5 + (int.from_bytes(data[i + 3 : i + 5], "big") & 0xFFF)


def demultiplex(media: bytes) -> Stream:
    """Parses a transport stream of whole packets."""
    out = Stream()
    counters: dict[int, tuple[int, bytes]] = {}
    open_units: dict[int, tuple[Unit, list[bytes]]] = {}
    sections: dict[int, bytearray] = {}
    for n in range(len(media) // PACKET):
        p = media[n * PACKET : (n + 1) * PACKET]
        if p[0] != SYNC:
            out.lost_sync += 1
            continue
        out.packets += 1
        pid, mode, counter, begins = (p[1] & 31) << 8 | p[2], p[3] >> 4 & 3, p[3] & 15, p[1] & 0x40
        if pid == NULL_PID or not mode & 1 or p[1] & 0x80:
            continue
        at, key, jump = 4, False, False
        if mode & 2:
            at += 1 + p[4]
            if p[4]:
                jump, key = bool(p[5] & 0x80), bool(p[5] & 0x40)
        if at > PACKET:
            out.truncated += 1
            continue
        last = counters.get(pid)
        if last is not None and not jump:
            if counter == last[0] and p == last[1]:
                continue  # a packet sent twice
            if counter != last[0] + 1 & 15:
                out.gaps += 1
                if open_units.pop(pid, None):
                    out.truncated += 1
                sections.pop(pid, None)
        counters[pid] = (counter, p)
        data = p[at:]
        if pid == PAT_PID or pid in out.programs.values():
            if begins and data:
                pointer, held = data[0], sections.pop(pid, None)
                if held and pointer:  # the end of a section that began before
                    whole(pid, held + data[1 : 1 + pointer], out)
                sections[pid] = bytearray(data[1 + pointer :])
            elif pid in sections:
                sections[pid] += data
            if pid in sections:
                sections[pid] = whole(pid, sections[pid], out)
        elif pid in out.types:
            if begins:
                if pid in open_units:
                    unit, parts = open_units.pop(pid)
                    elementary(unit, b"".join(parts), out)
                open_units[pid] = (Unit(pid, n, random_access=key), [data])
            elif pid in open_units:
                open_units[pid][1].append(data)
    if len(media) % PACKET:
        out.truncated += 1
    for unit, parts in open_units.values():
        elementary(unit, b"".join(parts), out)
    out.units.sort(key=lambda u: u.packet)
    return out


def whole(pid: int, held: bytearray, out: Stream) -> bytearray:
    """Takes in the sections that are whole, and returns the rest."""
    while len(held) >= 3 and held[0] != 0xFF:
        size = 3 + (int.from_bytes(held[1:3], "big") & 0xFFF)
        if len(held) < size:
            break
        tables(pid, bytes(held[:size]), out)
        held = held[size:]
    return held


# ---------------------------------------------------------------- Spark side
def multiplexed(df: DataFrame, payload: str = "payload", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns and media, the transport stream of the payload column; a kept column of that name is called media_in."""
    df, names = set_apart(df, ("media",))
    payload, keep = names[payload], tuple(names[c] for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, payload, 4 << 20):
                media = [multiplex(x or b"") for x in column(part, payload).to_pylist()]
                yield pa.RecordBatch.from_arrays([*[column(part, c) for c in keep], binary_array(media)], [*keep, "media"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema.fields)
    return df.select(*dict.fromkeys([*keep, payload])).mapInArrow(run, f"{fields}, media binary")


UNITS = pa.list_(pa.struct([("pid", pa.int32()), ("packet", pa.int64()), ("pts", pa.int64()), ("dts", pa.int64()), ("random_access", pa.bool_()), ("bytes", pa.int64())]))
RESULT = ["payload", "status", "packets", "tables", "programs", "types", "units", "lost_sync", "bad_crc", "gaps", "truncated"]
PARSED = "payload binary, status string, packets long, tables long, programs map<int,int>, types map<int,int>, units array<struct<pid:int,packet:bigint,pts:bigint,dts:bigint,random_access:boolean,bytes:bigint>>, lost_sync long, bad_crc long, gaps long, truncated long"


def parsed(df: DataFrame, media: str = "media", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns, the payload of the first elementary stream, and what the transport stream holds.

    A kept column whose name the result needs is called name_in.
    """
    df, names = set_apart(df, RESULT)
    media, keep = names[media], tuple(names[c] for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, media, 4 << 20):
                found = [None if x is None else demultiplex(x) for x in column(part, media).to_pylist()]
                streams = [Stream() if s is None else s for s in found]
                status = ["null" if s is None else "damaged" if s.lost_sync or s.bad_crc or s.gaps or s.truncated else "whole" if s.types else "no program" for s in found]
                units = [[{"pid": u.pid, "packet": u.packet, "pts": u.pts, "dts": u.dts, "random_access": u.random_access, "bytes": len(u.data)} for u in s.units] for s in streams]
                numbers = [pa.array([getattr(s, c) for s in streams], pa.int64()) for c in ("packets", "tables")], [pa.array([getattr(s, c) for s in streams], pa.int64()) for c in ("lost_sync", "bad_crc", "gaps", "truncated")]
                maps = [pa.array([list(getattr(s, c).items()) for s in streams], pa.map_(pa.int32(), pa.int32())) for c in ("programs", "types")]
                payload = binary_array([s.payload(min(s.types)) if s.types else b"" for s in streams])
                yield pa.RecordBatch.from_arrays(
                    [*[column(part, c) for c in keep], payload, pa.array(status, pa.string()), *numbers[0], *maps, pa.array(units, UNITS), *numbers[1]],
                    [*keep, *RESULT],
                )

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema.fields)
    return df.select(*dict.fromkeys([*keep, media])).mapInArrow(run, f"{fields}, {PARSED}")


def feature() -> F.Column:
    """A line about a parsed stream: sizes, time range, and the packets of its random-access points."""
    keys = F.transform(F.filter("units", lambda u: u["random_access"]), lambda u: F.concat_ws("@", u["pts"].cast("string"), u["packet"].cast("string")))
    return F.concat_ws(";", F.concat(F.lit("packets="), "packets"), F.concat(F.lit("units="), F.size("units")), F.concat(F.lit("pts="), F.array_min("units.pts"), F.lit("-"), F.array_max("units.pts")), F.concat(F.lit("gaps="), "gaps"), F.concat(F.lit("keys="), F.concat_ws(",", keys)), F.col("status"))
