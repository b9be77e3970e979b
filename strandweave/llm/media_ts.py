"""MPEG transport stream columns: multiplex, parse, check and index.

`mux` stores bytes losslessly as access units in PES packets of a one-program
transport stream; `parse` reads any stream of 188-byte packets: it follows the
program tables (with their CRCs), checks continuity counters, reassembles
elementary packets and lists timestamps with random-access points.
"""

from __future__ import annotations

import hashlib
import zlib
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from ._text import map_pieces

# Fixed values of ISO/IEC 13818-1 and of the streams that `mux` writes.
PACKET = 188
SYNC = 0x47
PAT_PID = 0x0000
PMT_PID = 0x1000
DATA_PID = 0x0100
NULL_PID = 0x1FFF
PROGRAM = 1
PRIVATE_DATA = 0x06
PRIVATE_STREAM_1 = 0xBD
CLOCK = 90_000
CRC_POLYNOMIAL = 0x04C11DB7

#: Payload unit, bytes of an access unit, ticks from one to the next, units from one random-access point to the next.
UNIT, ACCESS_UNIT, TICKS, KEY_EVERY = 192, 3072, 3003, 4


def _crc_row(i: int) -> int:
    c = i << 24
    for _ in range(8):
        c = ((c << 1) ^ CRC_POLYNOMIAL if c & 0x80000000 else c << 1) & 0xFFFFFFFF
    return c


_CRC = [_crc_row(i) for i in range(256)]


def crc32_mpeg(data: bytes) -> int:
    c = 0xFFFFFFFF
    for b in data:
        c = ((c << 8) & 0xFFFFFFFF) ^ _CRC[(c >> 24) ^ b]
    return c


def _section(table_id: int, ident: int, body: bytes) -> bytes:
    size = 5 + len(body) + 4
    head = bytes([table_id, 0xB0 | size >> 8, size & 0xFF, ident >> 8, ident & 0xFF, 0xC1, 0, 0]) + body
    return head + crc32_mpeg(head).to_bytes(4, "big")


def _table_packet(pid: int, section: bytes) -> bytes:
    return bytes([SYNC, 0x40 | pid >> 8, pid & 0xFF, 0x10, 0]) + section + b"\xff" * (PACKET - 5 - len(section))


_TABLES = _table_packet(PAT_PID, _section(0, 1, bytes([0, PROGRAM, 0xE0 | PMT_PID >> 8, PMT_PID & 0xFF]))) + _table_packet(
    PMT_PID,
    _section(2, PROGRAM, bytes([0xE0 | DATA_PID >> 8, DATA_PID & 0xFF, 0xF0, 0, PRIVATE_DATA, 0xE0 | DATA_PID >> 8, DATA_PID & 0xFF, 0xF0, 0])),
)


def _timestamp(mark: int, t: int) -> bytes:
    return bytes([mark << 4 | (t >> 30 & 7) << 1 | 1, t >> 22 & 0xFF, (t >> 15 & 0x7F) << 1 | 1, t >> 7 & 0xFF, (t & 0x7F) << 1 | 1])


def pad(data: bytes) -> bytes:
    """data with spaces up to a positive multiple of UNIT bytes."""
    return data + b" " * (max(1, -(-len(data) // UNIT)) * UNIT - len(data))


def mux(payload: bytes) -> bytes:
    """A transport stream with PAT, PMT and one PES packet for each ACCESS_UNIT bytes of payload."""
    out, cc = [_TABLES], 0
    for n, at in enumerate(range(0, max(1, len(payload)), ACCESS_UNIT)):
        body, pts = payload[at : at + ACCESS_UNIT], n * TICKS & 0x1FFFFFFFF
        pes = b"\x00\x00\x01" + bytes([PRIVATE_STREAM_1]) + (8 + len(body)).to_bytes(2, "big") + b"\x84\x80\x05" + _timestamp(2, pts) + body
        field_ = b""
        if n % KEY_EVERY == 0:  # random access and a clock reference
            field_ = b"\x50" + (pts << 15 | 0x3F << 9).to_bytes(6, "big")
        pos = 0
        while pos < len(pes):
            room = PACKET - 4 - (len(field_) + 1 if field_ else 0)
            part = pes[pos : pos + room]
            short = room - len(part)
            if short:
                if not field_ and short == 1:
                    adapt = b"\x00"
                else:
                    field_ = field_ or b"\x00"
                    adapt = bytes([PACKET - 5 - len(part)]) + field_ + b"\xff" * (PACKET - 5 - len(part) - len(field_))
            else:
                adapt = bytes([len(field_)]) + field_ if field_ else b""
            out.append(bytes([SYNC, (0x40 if pos == 0 else 0) | DATA_PID >> 8, DATA_PID & 0xFF, (0x30 if adapt else 0x10) | cc]) + adapt + part)
            cc = cc + 1 & 15
            pos += len(part)
            field_ = b""
    return b"".join(out)


@dataclass
class Stream:
    """An elementary stream: its data, a (pts, offset in data, random access) entry per PES packet with a timestamp."""

    stream_type: int
    program: int
    data: bytes = b""
    units: list[tuple[int, int, bool]] = field(default_factory=list)
    n_pes: int = 0


@dataclass
class Parsed:
    streams: dict[int, Stream]
    programs: dict[int, int]
    n_packets: int = 0
    sync_errors: int = 0
    continuity_errors: int = 0
    table_errors: int = 0
    broken_pes: int = 0


def _read_timestamp(b: bytes) -> int:
    return (b[0] >> 1 & 7) << 30 | b[1] << 22 | (b[2] >> 1) << 15 | b[3] << 7 | b[4] >> 1


def parse(ts: bytes | None) -> Parsed:
    """Everything that a stream of packets holds; damage is counted and never raises.

    A packet without the sync byte is skipped and parsing goes on at the next
    sync byte; a repeated counter value with payload is a duplicate packet and is
    dropped; a jump in the counter counts as an error and discards the elementary
    packet under construction.  Null or empty input gives an empty result.
    """
    ts = ts or b""
    out = Parsed({}, {})
    counters: dict[int, int] = {}
    sections: dict[int, bytes] = {}
    building: dict[int, list] = {}
    chunks: dict[int, list[bytes]] = {}
    sizes: dict[int, int] = {}
    pos, end = 0, len(ts)

    def close(pid: int) -> None:
        held = building.pop(pid, None)
        if held is None:
            return
        key, parts = held
        pes = b"".join(parts)
        if len(pes) < 9 or pes[:3] != b"\x00\x00\x01":
            out.broken_pes += 1
            return
        size = pes[4] << 8 | pes[5]
        if size and len(pes) < 6 + size:
            out.broken_pes += 1
            return
        body = pes[9 + pes[8] : 6 + size if size else len(pes)]
        stream = out.streams[pid]
        stream.n_pes += 1
        if pes[7] & 0x80 and pes[8] >= 5:
            stream.units.append((_read_timestamp(pes[9:14]), sizes.get(pid, 0), key))
        chunks.setdefault(pid, []).append(body)
        sizes[pid] = sizes.get(pid, 0) + len(body)

    def table(pid: int, section: bytes) -> None:
        size = 3 + ((section[1] & 0x0F) << 8 | section[2])
        if crc32_mpeg(section[:size]):
            out.table_errors += 1
            return
        body = section[8 : size - 4]
        if pid == PAT_PID and section[0] == 0:
            for i in range(0, len(body) - 3, 4):
                if number := body[i] << 8 | body[i + 1]:
                    out.programs[number] = (body[i + 2] & 0x1F) << 8 | body[i + 3]
        elif section[0] == 2:
            i = 4 + ((body[2] & 0x0F) << 8 | body[3])
            while i + 5 <= len(body):
                es = (body[i + 1] & 0x1F) << 8 | body[i + 2]
                if es not in out.streams:
                    out.streams[es] = Stream(body[i], section[3] << 8 | section[4])
                i += 5 + ((body[i + 3] & 0x0F) << 8 | body[i + 4])

    while pos + PACKET <= end:
        if ts[pos] != SYNC:
            out.sync_errors += 1
            pos = ts.find(SYNC, pos + 1)
            if pos < 0:
                break
            continue
        b1, b2, b3 = ts[pos + 1], ts[pos + 2], ts[pos + 3]
        pid, first, at = (b1 & 0x1F) << 8 | b2, b1 & 0x40, pos + 4
        pos += PACKET
        out.n_packets += 1
        if b1 & 0x80 or pid == NULL_PID:
            continue
        key = jump = False
        if b3 & 0x20:
            size = ts[at]
            if size:
                key, jump = bool(ts[at + 1] & 0x40), bool(ts[at + 1] & 0x80)
            at += 1 + size
        if not b3 & 0x10:
            continue
        cc, last = b3 & 15, counters.get(pid)
        counters[pid] = cc
        if last is not None and not jump:
            if cc == last:
                continue
            if cc != last + 1 & 15:
                out.continuity_errors += 1
                if building.pop(pid, None):
                    out.broken_pes += 1
                sections.pop(pid, None)
        part = ts[at:pos]
        if pid in out.streams:
            if first:
                close(pid)
                building[pid] = [key, [part]]
            elif pid in building:
                building[pid][1].append(part)
        elif pid == PAT_PID or pid in out.programs.values():
            if first and part:
                part = part[1 + part[0] :]
            elif pid in sections:
                part = sections.pop(pid) + part
            else:
                continue
            while len(part) >= 3 and part[0] != 0xFF:
                size = 3 + ((part[1] & 0x0F) << 8 | part[2])
                if len(part) < size:
                    sections[pid] = part
                    break
                if size >= 12:
                    table(pid, part)
                part = part[size:]
    for pid in list(building):
        close(pid)
    for pid, stream in out.streams.items():
        stream.data = b"".join(chunks.get(pid, []))
    return out


def feature(p: Parsed) -> str:
    """Programs, streams, errors, timestamps and random-access points in one line."""
    parts = [f"packets={p.n_packets}", f"programs={','.join(map(str, sorted(p.programs)))}", f"cc_errors={p.continuity_errors}", f"sync_errors={p.sync_errors}", f"table_errors={p.table_errors}", f"broken_pes={p.broken_pes}"]
    for pid, s in sorted(p.streams.items()):
        pts = [u[0] for u in s.units]
        parts.append(f"pid={pid}:type={s.stream_type}:pes={s.n_pes}:bytes={len(s.data)}:first_pts={min(pts, default=-1)}:last_pts={max(pts, default=-1)}:rap={';'.join(f'{t}@{o}' for t, o, k in s.units if k)}")
    return "|".join(parts)


_INDEX = "array<struct<pid:int,pts:long,byte_offset:long,random_access:boolean>>"


def parse_media(df: DataFrame, media: str = "media", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns with counts, streams' bytes and the timestamp index of a binary transport-stream column.

    Null and empty streams give zero counts and empty lists. No shuffle.
    """
    fields = "n_packets long, n_programs int, sync_errors long, continuity_errors long, table_errors long, broken_pes long, streams array<struct<pid:int,stream_type:int,program:int,n_pes:long,data:binary>>, timestamps " + _INDEX
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [parse(x) for x in batch.column("_media").to_pylist()]
        cols = {k: batch.column(k) for k in keep}
        cols |= {k: pa.array([getattr(p, k) for p in rows], pa.int64()) for k in ("n_packets", "sync_errors", "continuity_errors", "table_errors", "broken_pes")}
        cols["n_programs"] = pa.array([len(p.programs) for p in rows], pa.int32())
        stream = pa.struct([("pid", pa.int32()), ("stream_type", pa.int32()), ("program", pa.int32()), ("n_pes", pa.int64()), ("data", pa.binary())])
        cols["streams"] = pa.array([[{"pid": k, "stream_type": s.stream_type, "program": s.program, "n_pes": s.n_pes, "data": s.data} for k, s in sorted(p.streams.items())] for p in rows], pa.list_(stream))
        entry = pa.struct([("pid", pa.int32()), ("pts", pa.int64()), ("byte_offset", pa.int64()), ("random_access", pa.bool_())])
        cols["timestamps"] = pa.array([[{"pid": k, "pts": t, "byte_offset": o, "random_access": r} for k, s in sorted(p.streams.items()) for t, o, r in s.units] for p in rows], pa.list_(entry))
        order = [*keep, "n_packets", "n_programs", "sync_errors", "continuity_errors", "table_errors", "broken_pes", "streams", "timestamps"]
        return pa.RecordBatch.from_arrays([cols[k] for k in order], names=order)

    return map_pieces(df.select(*keep, df[media].cast("binary").alias("_media")), "_media", run, ", ".join([*kept, fields]))


def store_text(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, media): each text as UTF-8 (null: empty), padded with spaces and multiplexed. No shuffle."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([mux(pad((t or "").encode())) for t in batch.column(1).to_pylist()], pa.binary())], names=[key, "media"])

    return map_pieces(docs.select(key, text), text, run, f"`{key}` {kind}, media binary")


def text_media_digest(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Store each text as a transport stream, parse the stream and describe both.

    One row per input row, nulls as empty texts; equal texts get equal values.
    The payload's digests are of the bytes that parsing gave back; a stream that
    does not give back what went in raises.  One pass over bounded pieces, no shuffle.
    """
    kind = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_packets long, continuity_errors long, n_random_access long"

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for t in batch.column(1).to_pylist():
            raw = (t or "").encode()
            media = mux(pad(raw))
            p = parse(media)
            back = p.streams[DATA_PID].data
            if back[: len(raw)] != raw or p.continuity_errors:
                raise ValueError("a stored stream did not give back its payload")
            rows.append((len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature(p), p.n_packets, p.continuity_errors, sum(u[2] for u in p.streams[DATA_PID].units)))
        names = [key, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_packets", "continuity_errors", "n_random_access"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]], names=names)

    return map_pieces(docs.select(key, text), text, run, schema)
