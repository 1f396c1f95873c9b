"""Media columns: MPEG transport streams of 188-byte packets.

``mux`` stores a payload in a stream: a program association table, a program map
table and one private-data elementary stream of packets with time stamps;
``demux`` reads any stream back: it finds packet sync, parses the program tables
(checking their CRC), checks continuity counters, reassembles elementary packets
and lists time stamps with random-access points.

Memory is bounded by one payload and its stream, or a few megabytes of short ones.
Nothing is shuffled.

Defined results: a null payload is empty and stored as bytes 0; an empty stream has no
program; packets that are damaged, repeated or scrambled are counted and skipped, never
raised.  An elementary packet that lost a part (a gap of the continuity counter, a
damaged packet, an end before its stated length) is counted as damaged and is not
among the units.  Texts of any length are cut into as many units as they need; repeated
rows and null keys give a row each; an empty table gives no rows; other columns,
whatever their names, aren't read.
"""

from __future__ import annotations

import hashlib
import zlib
from dataclasses import dataclass, field

PACKET, SYNC = 188, 0x47
#: Fixed values of the format: packet identifiers and stream kinds.
PAT_PID, NULL_PID = 0x0000, 0x1FFF
PMT_PID, DATA_PID, PROGRAM = 0x0100, 0x0101, 1
PRIVATE_DATA, PRIVATE_STREAM = 0x06, 0xBD
#: Bytes of payload in an elementary packet, 90 kHz ticks between two, and how many lie between random-access points.
UNIT_BYTES, TICKS, GROUP = 16384, 3600, 8
#: Payloads are filled up with bytes 0 to a multiple of this.
FILL = 64


def padded(data: bytes) -> bytes:
    """``data`` and bytes 0, to the next positive multiple of ``FILL``."""
    return data + bytes(max(FILL, -(-len(data) // FILL) * FILL) - len(data))


_crc_table: list[int] = []


def crc32_mpeg(data: bytes) -> int:
    """The tables' checksum: polynomial 04C11DB7, most significant bit first, start FFFFFFFF, not inverted."""
    if not _crc_table:
        for i in range(256):
            c = i << 24
            for _ in range(8):
                c = (c << 1 ^ 0x04C11DB7 if c & 0x80000000 else c << 1) & 0xFFFFFFFF
            _crc_table.append(c)
    c = 0xFFFFFFFF
    for b in data:
        c = (c << 8 & 0xFFFFFFFF) ^ _crc_table[c >> 24 ^ b]
    return c


def _section(table: int, number: int, body: bytes) -> bytes:
    head = bytes([table]) + (0xB000 | len(body) + 9).to_bytes(2) + number.to_bytes(2) + b"\xc1\0\0"
    return head + body + crc32_mpeg(head + body).to_bytes(4)


def _table_packet(pid: int, section: bytes) -> bytes:
    packet = bytes([SYNC]) + (0x4000 | pid).to_bytes(2) + b"\x10\0" + section
    return packet + b"\xff" * (PACKET - len(packet))


_tables = _table_packet(PAT_PID, _section(0, 1, PROGRAM.to_bytes(2) + (0xE000 | PMT_PID).to_bytes(2))) + _table_packet(
    PMT_PID, _section(2, PROGRAM, (0xE000 | DATA_PID).to_bytes(2) + b"\xf0\0" + bytes([PRIVATE_DATA]) + (0xE000 | DATA_PID).to_bytes(2) + b"\xf0\0")
)


def _stamp(prefix: int, t: int) -> bytes:
    return bytes([prefix << 4 | (t >> 29 & 0xE) | 1, t >> 22 & 0xFF, t >> 14 & 0xFE | 1, t >> 7 & 0xFF, t << 1 & 0xFE | 1])


def mux(payload: bytes) -> bytes:
    """A stream that carries the payload losslessly."""
    out, counter = [_tables], 0
    for unit, at in enumerate(range(0, len(payload), UNIT_BYTES)):
        data, pts = payload[at : at + UNIT_BYTES], unit * TICKS & (1 << 33) - 1
        pes = b"\0\0\1" + bytes([PRIVATE_STREAM]) + (len(data) + 8).to_bytes(2) + b"\x84\x80\x05" + _stamp(2, pts) + data
        # the first packet has an adaptation field: random access and a clock reference
        flags = 0x10 | (0x40 if unit % GROUP == 0 else 0)
        clock = (pts << 15 | 0x7E00).to_bytes(6)
        start, pos = True, 0
        while pos < len(pes):
            field_ = bytes([flags]) + clock if start else b""
            room = PACKET - 4 - (len(field_) + 1 if start else 0)
            part = pes[pos : pos + room]
            if len(part) < room:  # stuffing fills the adaptation field
                if start:
                    field_ += b"\xff" * (room - len(part))
                else:
                    spare = room - len(part) - 1
                    field_ = b"" if spare == 0 else b"\0" + b"\xff" * (spare - 1)
            adapted = start or len(part) < room
            head = bytes([SYNC]) + ((0x4000 if start else 0) | DATA_PID).to_bytes(2) + bytes([(0x30 if adapted else 0x10) | counter])
            out.append(head + (bytes([len(field_)]) + field_ if adapted else b"") + part)
            counter, pos, start = counter + 1 & 15, pos + len(part), False
    return b"".join(out)


@dataclass
class Stream:
    """What ``demux`` found.  ``units``: (pid, PTS or None, DTS or None, whether random access, data)."""

    packets: int = 0
    lost_sync: int = 0
    repeated: int = 0
    gaps: int = 0
    damaged: int = 0
    bad_tables: int = 0
    programs: dict[int, int] = field(default_factory=dict)
    streams: dict[int, int] = field(default_factory=dict)
    clocks: list[int] = field(default_factory=list)
    units: list[tuple[int, int | None, int | None, bool, bytes]] = field(default_factory=list)

    def payload(self, pid: int | None = None) -> bytes:
        return b"".join(u[4] for u in self.units if pid is None or u[0] == pid)

    def access_points(self) -> list[tuple[int, int | None]]:
        """(unit, PTS) of the random-access points."""
        return [(i, u[1]) for i, u in enumerate(self.units) if u[3]]


def demux(media: bytes) -> Stream:
    """Read a stream; bytes before, between and behind packets are skipped."""
    out, last, open_, sections, at = Stream(), {}, {}, {}, 0
    broken: set[int] = set()  # streams whose open unit or section lacks a part
    view = memoryview(media)
    while at + PACKET <= len(media):
        if media[at] != SYNC or at + 2 * PACKET <= len(media) and media[at + PACKET] != SYNC:
            found = media.find(bytes([SYNC]), at + 1)
            out.lost_sync += 1
            at = len(media) if found < 0 else found
            continue
        b1, b2, b3 = media[at + 1], media[at + 2], media[at + 3]
        pid, starts, has_field, has_data = (b1 & 0x1F) << 8 | b2, b1 & 0x40, b3 & 0x20, b3 & 0x10
        packet, pos, at = at, at + 4, at + PACKET
        out.packets += 1
        if b1 & 0x80 or b3 & 0xC0:
            out.damaged += 1
            broken.add(pid)
            continue
        if pid == NULL_PID:
            continue
        access = jump = False
        if has_field:
            size = media[pos]
            if size > PACKET - 5:
                out.damaged += 1
                broken.add(pid)
                continue
            if size:
                flags = media[pos + 1]
                jump, access = bool(flags & 0x80), bool(flags & 0x40)
                if flags & 0x10 and size >= 7:
                    raw = int.from_bytes(view[pos + 2 : pos + 8])
                    out.clocks.append((raw >> 15) * 300 + (raw & 0x1FF))
            pos += size + 1
        if has_data:
            counter = b3 & 15
            if pid in last and not jump:
                if counter == last[pid][0] and view[packet:at] == view[last[pid][1] : last[pid][1] + PACKET]:
                    out.repeated += 1
                    continue
                if counter != last[pid][0] + 1 & 15:
                    out.gaps += 1
                    broken.add(pid)
            last[pid] = counter, packet
        else:
            continue
        data = view[pos:at]
        if pid in broken:
            broken.discard(pid)
            sections.pop(pid, None)
            if open_.pop(pid, None):
                out.damaged += 1
        if pid == PAT_PID or pid in out.programs.values():
            if starts and len(data):
                begin = 1 + data[0]
                if pid in sections:
                    _tables_in(out, pid, sections[pid] + bytes(data[1:begin]))
                sections[pid] = _tables_in(out, pid, bytes(data[begin:]))
            elif sections.get(pid):
                sections[pid] = _tables_in(out, pid, sections[pid] + bytes(data))
        elif pid in out.streams:
            if starts:
                _close(out, pid, open_.pop(pid, None))
                open_[pid] = (access, [data])
            elif pid in open_:
                open_[pid][1].append(data)
            else:
                out.damaged += 1
    for pid, unit in open_.items():
        if pid in broken:
            out.damaged += 1
        else:
            _close(out, pid, unit)
    return out


def _tables_in(out: Stream, pid: int, data: bytes) -> bytes:
    """Read the sections that are whole, one after the other; what is left is the begin of one that goes on in the next packet."""
    while data and data[0] != 0xFF:  # stuffing follows the last one
        size = 3 + (int.from_bytes(data[1:3]) & 0x0FFF)
        if len(data) < max(3, size):
            return data
        _table(out, pid, data[:size])
        data = data[size:]
    return b""


def _table(out: Stream, pid: int, section: bytes) -> None:
    """Read one whole section; tables of other kinds, and those that aren't in force yet, say nothing."""
    size = len(section)
    if size < 12 or crc32_mpeg(section):
        out.bad_tables += 1
        return
    if not section[5] & 1:
        return
    if pid == PAT_PID and section[0] == 0:
        for k in range(8, size - 7, 4):
            number, at = int.from_bytes(section[k : k + 2]), int.from_bytes(section[k + 2 : k + 4]) & 0x1FFF
            if number:
                out.programs[number] = at
    elif section[0] == 2:
        k = 12 + (int.from_bytes(section[10:12]) & 0x0FFF)
        while k + 5 <= size - 4:
            out.streams[int.from_bytes(section[k + 1 : k + 3]) & 0x1FFF] = section[k]
            k += 5 + (int.from_bytes(section[k + 3 : k + 5]) & 0x0FFF)


def _close(out: Stream, pid: int, unit) -> None:
    """Take an elementary packet apart."""
    if unit is None:
        return
    pes = b"".join(unit[1])
    if len(pes) < 9 or pes[:3] != b"\0\0\1" or pes[6] >> 6 != 2:
        out.damaged += 1
        return
    size, begin = int.from_bytes(pes[4:6]), 9 + pes[8]
    end = 6 + size if size else len(pes)
    if end > len(pes) or begin > end:
        out.damaged += 1
        return
    pts = _time(pes[9:14]) if pes[7] & 0x80 and begin >= 14 else None
    dts = _time(pes[14:19]) if pes[7] & 0xC0 == 0xC0 and begin >= 19 else None
    out.units.append((pid, pts, dts, unit[0], pes[begin:end]))


def _time(b: bytes) -> int:
    return (b[0] >> 1 & 7) << 30 | b[1] << 22 | b[2] >> 1 << 15 | b[3] << 7 | b[4] >> 1


def store(df, id_column: str = "doc_id", text_column: str = "text"):
    """``doc_id``, ``n_bytes`` and ``media``, the stream that holds each row's text as UTF-8."""
    from pyspark.sql import functions as F

    from ledgerloom.llm.common import map_steps

    def step(columns):
        keys, texts = columns
        data = [(t or "").encode() for t in texts]
        return {"doc_id": keys, "n_bytes": list(map(len, data)), "media": [mux(padded(d)) for d in data]}

    return map_steps(df.select(F.col(f"`{id_column}`").alias("doc_id"), F.col(f"`{text_column}`").alias("text")), step, "doc_id long, n_bytes long, media binary")


def features(media_rows):
    """Read each row's ``media`` back: digests of payload and stream, and what the stream holds.

    ``units`` lists each elementary packet's time stamp and whether it is a
    random-access point.
    """
    from ledgerloom.llm.common import map_steps

    def step(columns):
        keys, sizes, medias = columns
        out = {name: [] for name in ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "units")}
        for media in medias:
            s = demux(media)
            payload = s.payload()
            out["payload_bytes"].append(len(payload))
            out["payload_sha256"].append(hashlib.sha256(payload).hexdigest())
            out["tail_crc32"].append(zlib.crc32(payload[-FILL:]))
            out["media_bytes"].append(len(media))
            out["media_sha256"].append(hashlib.sha256(media).hexdigest())
            points, times = s.access_points(), [u[1] for u in s.units if u[1] is not None]
            out["feature"].append(
                f"packets={s.packets};programs={len(s.programs)};streams={len(s.streams)};units={len(s.units)};access={len(points)};"
                f"pts={min(times, default=-1)}-{max(times, default=-1)};clocks={len(s.clocks)};gaps={s.gaps};repeated={s.repeated};damaged={s.damaged + s.bad_tables + s.lost_sync}"
            )
            out["units"].append([{"pts": u[1], "random_access": u[3]} for u in s.units])
        return out | {"doc_id": keys, "n_bytes": sizes}

    return map_steps(
        media_rows.select("doc_id", "n_bytes", "media"), step,
        "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, units array<struct<pts:long,random_access:boolean>>",
    )
