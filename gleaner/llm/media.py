"""Media columns: MPEG transport streams.

``mux`` wraps a payload of 576-byte frames (24 ms each at 90 kHz) as a program of one private stream:
program tables before every random-access point, a clock reference and the random-access flag on it,
a time stamp on every elementary packet. ``demux`` reads any transport stream of whole packets: it
parses program association and map tables with their checksums, checks continuity counters,
reassembles elementary packets and returns time stamps and random-access points.

``store`` writes a media column with its access points (time and packet number), so that a reader can
begin in the middle; ``parsed`` reads it back.

Defined cases: a null text counts as empty, and an empty one is a single frame of bytes 255; repeated
rows are stored each on their own, equal texts with equal values; other columns are left out; an empty
table gives an empty result. A stream that does not parse has its errors counted, and what is readable
of it returned.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.common import Batches, documents, id_and_text, map_batches
from gleaner.session import new_path

PACKET, BODY = 188, 184
FRAME, TICKS = 576, 2160
FRAMES = 8  # of an elementary packet
ACCESS = 8  # elementary packets between random-access points
PROGRAM, MAP_PID, STREAM_PID, STREAM_TYPE = 1, 0x1000, 0x100, 0x06
MEDIA = "doc_id long, n_bytes long, media binary, access array<struct<pts: long, packet: long>>"
BATCH_BYTES = 16 << 20


def _checksums() -> list[int]:
    table = []
    for byte in range(256):
        c = byte << 24
        for _ in range(8):
            c = (c << 1) ^ 0x04C11DB7 if c & 0x80000000 else c << 1
        table.append(c & 0xFFFFFFFF)
    return table


CHECKSUMS = _checksums()


def table_checksum(data: bytes) -> int:
    """0 over a whole section whose checksum is right."""
    c = 0xFFFFFFFF
    for byte in data:
        c = (c << 8 & 0xFFFFFFFF) ^ CHECKSUMS[c >> 24 ^ byte]
    return c


def _table_packet(pid: int, table: int, number: int, body: bytes) -> bytes:
    """A packet with one section, counter 0."""
    length = 5 + len(body) + 4
    head = bytes([table, 0xB0 | length >> 8, length & 255]) + number.to_bytes(2, "big") + bytes([0xC1, 0, 0])
    section = head + body
    section += table_checksum(section).to_bytes(4, "big")
    packet = bytes([0x47, 0x40 | pid >> 8, pid & 255, 0x10, 0]) + section
    return packet.ljust(PACKET, b"\xff")


TABLES = (
    _table_packet(0, 0x00, 1, PROGRAM.to_bytes(2, "big") + (0xE000 | MAP_PID).to_bytes(2, "big")),
    _table_packet(
        MAP_PID,
        0x02,
        PROGRAM,
        (0xE000 | STREAM_PID).to_bytes(2, "big")
        + b"\xf0\x00"
        + bytes([STREAM_TYPE])
        + (0xE000 | STREAM_PID).to_bytes(2, "big")
        + b"\xf0\x00",
    ),
)


def _counted(packet: bytes, counter: int) -> bytes:
    return packet[:3] + bytes([packet[3] & 0xF0 | counter & 15]) + packet[4:]


def _stamp(pts: int) -> bytes:
    return bytes([0x21 | pts >> 29 & 14, pts >> 22 & 255, pts >> 14 & 254 | 1, pts >> 7 & 255, pts << 1 & 254 | 1])


def _clock(pts: int) -> bytes:
    """Program clock reference: 33 bits of base, 6 reserved, 9 of extension."""
    return ((pts & (1 << 33) - 1) << 15 | 0x3F << 9).to_bytes(6, "big")


def _packet(data: bytes, first: bool, counter: int, field_: bytes = b"") -> bytes:
    """One packet; ``field_`` is the adaptation field without its length, stuffed as far as needed."""
    free = BODY - len(data)
    head = bytes([0x47, 0x40 * first | STREAM_PID >> 8, STREAM_PID & 255])
    if free == 0:
        return head + bytes([0x10 | counter & 15]) + data
    if free > 1 and not field_:
        field_ = b"\x00"
    return head + bytes([0x30 | counter & 15, free - 1]) + field_.ljust(free - 1, b"\xff") + data


def mux(payload: bytes) -> tuple[bytes, list[tuple[int, int]]]:
    """The stream, and time and packet number of its random-access points."""
    out, access = [], []
    counter = packets = 0
    step = FRAME * FRAMES
    for k, at in enumerate(range(0, len(payload), step)):
        data = payload[at : at + step]
        pts = k * FRAMES * TICKS
        field_ = b""
        if k % ACCESS == 0:
            access.append((pts, packets))
            out += [_counted(t, k // ACCESS) for t in TABLES]
            packets += len(TABLES)
            field_ = b"\x50" + _clock(pts)
        pes = b"\x00\x00\x01\xbd" + (len(data) + 8).to_bytes(2, "big") + b"\x80\x80\x05" + _stamp(pts) + data
        room = BODY - (len(field_) + 1 if field_ else 0)
        out.append(_packet(pes[:room], True, counter, field_))
        counter += 1
        packets += 1
        whole = (len(pes) - room) // BODY
        if whole > 0:
            block = np.empty((whole, PACKET), np.uint8)
            block[:, :3] = (0x47, STREAM_PID >> 8, STREAM_PID & 255)
            block[:, 3] = 0x10 | (counter + np.arange(whole)) & 15
            block[:, 4:] = np.frombuffer(pes, np.uint8, whole * BODY, room).reshape(whole, BODY)
            out.append(block.tobytes())
            counter += whole
            packets += whole
        rest = pes[room + max(whole, 0) * BODY :]
        if rest:
            out.append(_packet(rest, False, counter))
            counter += 1
            packets += 1
    return b"".join(out), access


@dataclass
class Stream:
    """What ``demux`` finds."""

    packets: int = 0
    programs: dict[int, int] = field(default_factory=dict)  # program -> pid of its map
    streams: dict[int, int] = field(default_factory=dict)  # pid -> type
    clock_pid: int | None = None
    table_errors: int = 0
    packet_errors: int = 0
    continuity_errors: int = 0
    repeated: int = 0
    clocks: list[int] = field(default_factory=list)
    # Per elementary packet: pid, time stamp, size, whether it is a random-access point.
    units: list[tuple[int, int | None, int, bool]] = field(default_factory=list)
    payload: dict[int, bytes] = field(default_factory=dict)


def _sections(packets: np.ndarray, begin: np.ndarray, start: np.ndarray, out: Stream) -> list[bytes]:
    """Whole sections of right checksum, from the packets of one pid."""
    found, held = [], b""
    for row, at, first in zip(packets, begin.tolist(), start.tolist(), strict=True):
        data = row[at:].tobytes()
        if first:
            held = data[1 + data[0] :] if data else b""
        else:
            held += data
        while len(held) >= 3 and held[0] != 0xFF:
            size = 3 + ((held[1] & 15) << 8 | held[2])
            if len(held) < size:
                break
            if table_checksum(held[:size]):
                out.table_errors += 1
            else:
                found.append(held[:size])
            held = held[size:]
    return found


def _time(pes: bytes) -> int | None:
    if len(pes) < 14 or not pes[7] & 0x80:
        return None
    b = pes[9:14]
    return (b[0] & 14) << 29 | b[1] << 22 | (b[2] & 254) << 14 | b[3] << 7 | b[4] >> 1


def demux(data: bytes) -> Stream:
    """Parse a transport stream of whole packets; a rest of less than a packet counts as an error."""
    out = Stream(packets=len(data) // PACKET, packet_errors=int(len(data) % PACKET > 0))
    rows = np.frombuffer(data, np.uint8, out.packets * PACKET).reshape(-1, PACKET)
    good = (rows[:, 0] == 0x47) & (rows[:, 1] < 0x80)
    out.packet_errors += int((~good).sum())
    rows = rows[good]
    pids = (rows[:, 1].astype(np.int64) & 31) << 8 | rows[:, 2]
    adapted = rows[:, 3] & 0x20 > 0
    flags = np.where(adapted & (rows[:, 4] > 0), rows[:, 5], 0)
    begin = np.where(adapted, 5 + rows[:, 4].astype(np.int64), 4)
    loaded = (rows[:, 3] & 0x10 > 0) & (begin < PACKET)
    start = rows[:, 1] & 0x40 > 0

    for i in np.flatnonzero(flags & 0x10).tolist():
        out.clocks.append(int.from_bytes(rows[i, 6:12].tobytes(), "big") >> 15)

    keep = loaded.copy()
    for pid in np.unique(pids[loaded]).tolist():
        own = np.flatnonzero(loaded & (pids == pid))
        step = np.diff((rows[own, 3] & 15).astype(np.int64)) % 16
        same = (step == 0) & (rows[own[1:], 4:] == rows[own[:-1], 4:]).all(axis=1)
        keep[own[1:][same]] = False  # a packet may be sent twice
        out.repeated += int(same.sum())
        out.continuity_errors += int(((step != 1) & ~same & (flags[own[1:]] & 0x80 == 0)).sum())

    def sections(pid: int) -> list[bytes]:
        own = np.flatnonzero(keep & (pids == pid))
        return _sections(rows[own], begin[own], start[own], out)

    for s in sections(0):
        for at in range(8, len(s) - 4, 4):
            number = s[at] << 8 | s[at + 1]
            if number:
                out.programs[number] = (s[at + 2] & 31) << 8 | s[at + 3]
    for map_pid in sorted(set(out.programs.values())):
        for s in sections(map_pid):
            out.clock_pid = (s[8] & 31) << 8 | s[9]
            at = 12 + ((s[10] & 15) << 8 | s[11])
            while at + 5 <= len(s) - 4:
                out.streams[(s[at + 1] & 31) << 8 | s[at + 2]] = s[at]
                at += 5 + ((s[at + 3] & 15) << 8 | s[at + 4])

    for pid in sorted(out.streams):
        own = np.flatnonzero(keep & (pids == pid))
        firsts = np.flatnonzero(start[own])
        if not len(firsts):
            continue
        own = own[firsts[0] :]
        firsts = firsts - firsts[0]
        body = rows[own][np.arange(PACKET)[None, :] >= begin[own][:, None]].tobytes()
        places = np.concatenate(([0], np.cumsum(PACKET - begin[own])))
        parts = []
        for a, b, i in zip(firsts.tolist(), [*firsts[1:].tolist(), len(own)], own[firsts].tolist(), strict=True):
            pes = body[places[a] : places[b]]
            if pes[:3] != b"\x00\x00\x01" or len(pes) < 9:
                out.packet_errors += 1
                continue
            size = pes[4] << 8 | pes[5]
            content = pes[9 + pes[8] : 6 + size if size else None]
            parts.append(content)
            out.units.append((pid, _time(pes), len(content), bool(flags[i] & 0x40)))
        out.payload[pid] = b"".join(parts)
    return out


def feature(s: Stream) -> str:
    """What the stream says about itself, in one line."""
    times = [u[1] for u in s.units if u[1] is not None]
    counts = defaultdict(int)
    for _, _, _, access in s.units:
        counts[access] += 1
    programs = ",".join(f"{n}@{pid}" for n, pid in sorted(s.programs.items()))
    streams = ",".join(f"{pid}:{kind}" for pid, kind in sorted(s.streams.items()))
    return (
        f"packets={s.packets};programs={programs};streams={streams};units={len(s.units)};access={counts[True]};"
        f"first={min(times, default='')};last={max(times, default='')};clocks={len(s.clocks)};"
        f"continuity_errors={s.continuity_errors};repeated={s.repeated};table_errors={s.table_errors};"
        f"packet_errors={s.packet_errors}"
    )


def payload_of(text: bytes) -> bytes:
    frames = max(1, -(-len(text) // FRAME))
    return text.ljust(frames * FRAME, b"\xff")


def media(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``media`` and its ``access`` points."""
    kind = pa.list_(pa.struct([("pts", pa.int64()), ("packet", pa.int64())]))

    def run(batches: Batches) -> Batches:
        for batch in batches:
            held, size, first = [], 0, 0
            for i, text in enumerate(batch.column(1).cast(pa.binary())):
                raw = text.as_py()
                held.append((len(raw), *mux(payload_of(raw))))
                size += len(raw)
                if size >= BATCH_BYTES or i == len(batch) - 1:
                    access = [[{"pts": p, "packet": n} for p, n in points] for _, _, points in held]
                    columns = [
                        batch.column(0).slice(first, len(held)),
                        pa.array([n for n, _, _ in held], pa.int64()),
                        pa.array([m for _, m, _ in held], pa.binary()),
                        pa.array(access, kind),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "media", "access"])
                    held, size, first = [], 0, i + 1

    return map_batches(id_and_text(docs), run, MEDIA)


def store(docs: DataFrame, path: str) -> None:
    media(docs).write.option("compression", "zstd").parquet(path)


def stored(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MEDIA).parquet(path)


def parsed(table: DataFrame) -> DataFrame:
    """Per document what a parse of ``media`` gives: digests of the payload, time stamps, errors."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            rows = []
            for data in batch.column(1):
                s = demux(data.as_py())
                payload = b"".join(s.payload[pid] for pid in sorted(s.payload))
                rows.append(
                    (
                        len(payload),
                        hashlib.sha256(payload).hexdigest(),
                        zlib.crc32(payload[-32:]),
                        feature(s),
                        [u[1] for u in s.units],
                        [u[1] for u in s.units if u[3]],
                    )
                )
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()))
            columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), batch.column(3), *columns, batch.column(4)],
                ["doc_id", "n_bytes", "media_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "feature"]
                + ["times", "access_times", "media_sha256"],
            )

    read = table.select(
        "doc_id",
        "media",
        "n_bytes",
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
    )
    schema = (
        "doc_id long, n_bytes long, media_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, "
        "feature string, times array<long>, access_times array<long>, media_sha256 string"
    )
    return map_batches(read, run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark)
    store(documents(spark, sf_dir), path)
    return parsed(stored(spark, path)).select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"
    )


QUERIES = {"op3_media_columns": query}
SQL: dict[str, str] = {}
