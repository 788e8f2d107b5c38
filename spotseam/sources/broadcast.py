"""Programme boundaries in transport streams: PSIP tables and XDS captions, from binary columns.

The bytes are a state machine's input, which no built-in expresses, so these run as
Arrow batches over (rec_id, content); each keeps a scan within its first megabytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PACKET, SYNC = 188, 0x47
PSIP_PID, STT, EIT = 0x1FFB, 0xCD, 0xCB
#: Seconds from 1970 to the start of GPS time.
GPS_EPOCH = 315_964_800
TOLERANCE_S = 300
VIDEO_TYPES = (0x01, 0x02, 0x1B, 0x24)
PSIP_SCAN, XDS_SCAN, PID_SCAN = 10 << 20, 30 << 20, 1 << 20


def packets(data: bytes, limit: int, start: int = 0) -> Iterator[tuple[int, bool, bytes]]:
    """(pid, starts a unit, payload) of whole packets; after a lost sync byte it looks for the next one."""
    at, end = data.find(SYNC, start), min(len(data), limit)
    while 0 <= at and at + PACKET <= end:
        if data[at] != SYNC:
            at = data.find(SYNC, at)
            continue
        p = data[at : at + PACKET]
        at += PACKET
        begin = 5 + p[4] if p[3] & 0x20 else 4
        if p[3] & 0x10 and begin < PACKET:
            yield (p[1] & 0x1F) << 8 | p[2], bool(p[1] & 0x40), p[begin:]


def sections(payloads: Iterator[tuple[bool, bytes]]) -> Iterator[bytes]:
    """Whole table sections, put together across packets."""

    def whole(buffer: bytearray) -> Iterator[bytes]:
        while len(buffer) >= 3:
            if buffer[0] == 0xFF:
                buffer.clear()
                return
            size = 3 + ((buffer[1] & 0x0F) << 8 | buffer[2])
            if len(buffer) < size:
                return
            yield bytes(buffer[:size])
            del buffer[:size]

    held = bytearray()
    for fresh, body in payloads:
        if fresh:
            pointer = body[0]
            held += body[1 : 1 + pointer]
            yield from whole(held)
            held.clear()
            body = body[1 + pointer :]
        held += body
        yield from whole(held)


def _title(section: bytes, at: int) -> str | None:
    size = section[at] & 0x1F if at < len(section) else 0
    text = section[at + 1 :]
    if size < 4 or len(text) < 8 or not text[0] or not text[4] or text[5]:
        return None
    body = text[8 : 8 + text[7]]
    return body.decode("latin-1").strip("\0 ") if len(body) == text[7] else None


def programmes(section: bytes, leap: int) -> Iterator[tuple[int, int, str | None]]:
    """(start in Unix seconds, length, title) of a listing's events."""
    end, at = len(section) - 4, 10
    for _ in range(section[9] if len(section) > 10 else 0):
        if at + 10 > end:
            return
        start = int.from_bytes(section[at + 2 : at + 6], "big") + GPS_EPOCH - leap
        yield start, int.from_bytes(section[at + 6 : at + 9], "big") & 0xFFFFF, _title(section, at + 9)
        described = at + 10 + (section[at + 9] & 0x1F)
        if described + 2 > end:
            return
        at = described + 2 + (int.from_bytes(section[described : described + 2], "big") & 0xFFF)


def read_psip(data: bytes, limit: int = PSIP_SCAN) -> tuple[int | None, int | None, int | None, str | None]:
    """(recording start, programme start, length, title): the first time table, and the first listing that runs then."""
    now, leap = None, 0
    for s in sections((fresh, body) for pid, fresh, body in packets(data, limit) if pid == PSIP_PID):
        if s[0] == STT and now is None and len(s) >= 9:
            leap = s[8]
            now = int.from_bytes(s[4:8], "big") - leap + GPS_EPOCH
        elif s[0] == EIT and now is not None:
            for start, length, title in programmes(s, leap):
                if start <= now + TOLERANCE_S and start + length > now - TOLERANCE_S:
                    return now, start, length, title
    return now, None, None, None


def video_pid(data: bytes, limit: int = PID_SCAN) -> int | None:
    """The first video stream of the first programme, by way of both programme tables."""
    held: dict[int, bytearray] = {}
    table = None
    for pid, fresh, body in packets(data, limit):
        if fresh:
            body = body[1 + body[0] :]
            held[pid] = bytearray()
        if pid not in (0, table):
            continue
        held.setdefault(pid, bytearray()).extend(body)
        s = held[pid]
        if len(s) < 12 or len(s) < 3 + ((s[1] & 0x0F) << 8 | s[2]):
            continue
        end = ((s[1] & 0x0F) << 8 | s[2]) - 1
        if pid == 0 and s[0] == 0:
            table = next(((s[i + 2] & 0x1F) << 8 | s[i + 3] for i in range(8, end - 3, 4) if s[i] or s[i + 1]), table)
        elif pid == table and s[0] == 2:
            at = 12 + ((s[10] & 0x0F) << 8 | s[11])
            while at + 5 <= end:
                if s[at] in VIDEO_TYPES:
                    return (s[at + 1] & 0x1F) << 8 | s[at + 2]
                at += 5 + ((s[at + 3] & 0x0F) << 8 | s[at + 4])
    return None


class Captions:
    """Extended data service packets from caption byte pairs; no checksum is tested."""

    def __init__(self):
        self.open = False
        self.kind, self.data = (0, 0), bytearray()
        self.name: str | None = None
        self.length_min: int | None = None
        self.elapsed_min = 0

    def pair(self, a: int, b: int) -> None:
        if not a and not b:
            return
        start = a in range(1, 14, 2)
        if start:
            self.open, self.kind, self.data = True, ((a + 1) // 2, b), bytearray()
        elif not self.open:
            return
        elif a == 0x0F:
            self.open = False
            self._finish()
        elif 0x10 <= a <= 0x1F:
            self.open = False
        elif 1 <= a <= 0x0D:
            if a // 2 == self.kind[0]:
                self.data.append(b)
        else:
            self.data += bytes([a, b] if b else [a])

    def _finish(self) -> None:
        d = [x - 0x20 for x in self.data]
        if self.kind == (1, 2) and len(d) >= 2 and 0 <= d[0] <= 23 and 0 <= d[1] <= 59:
            self.length_min = d[0] * 60 + d[1]
            if len(d) >= 4 and 0 <= d[2] <= 23 and 0 <= d[3] <= 59:
                self.elapsed_min = d[2] * 60 + d[3]
        elif self.kind == (1, 3):
            self.name = "".join(chr(x) for x in self.data if 0x20 <= x <= 0x7E).strip() or self.name


_CAPTIONS = b"\0\0\1\xb2GA94"


def _scan(stream: bytearray, captions: Captions) -> None:
    at = stream.find(_CAPTIONS)
    while at >= 0:
        body = stream[at + 8 :]
        if len(body) > 2 and body[0] == 3:
            for i in range(3, min(3 + 3 * (body[1] & 0x1F), len(body) - 2), 3):
                if body[i] & 0x07 == 0x04:  # valid, first field
                    captions.pair(body[i + 1] & 0x7F, body[i + 2] & 0x7F)
        at = stream.find(_CAPTIONS, at + 1)


def read_xds(data: bytes, limit: int = XDS_SCAN) -> tuple[str | None, int | None, int]:
    """(name, length in minutes, minutes elapsed): scans until the first programme length."""
    captions, stream = Captions(), bytearray()
    if (wanted := video_pid(data)) is None:
        return None, None, 0
    for pid, fresh, body in packets(data, limit):
        if pid != wanted:
            continue
        if fresh:
            _scan(stream, captions)
            stream.clear()
            if len(body) < 9 or body[:3] != b"\0\0\1" or not 0xE0 <= body[3] <= 0xEF:
                continue
            body = body[9 + body[8] :]
        stream += body
        if captions.length_min is not None:
            break
    else:
        _scan(stream, captions)
    return captions.name, captions.length_min, captions.elapsed_min


def psip(files: DataFrame, limit: int = PSIP_SCAN) -> DataFrame:
    """(rec_id, rec_start, prog_start, prog_len_s, title) of (rec_id, content); null where not found."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [read_psip(x or b"", limit) for x in b.column("content").to_pylist()]
            yield pa.record_batch([b.column("rec_id"), *(pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string())))], ["rec_id", "a", "b", "prog_len_s", "title"])

    rows = files.select("rec_id", F.substring("content", 1, limit).alias("content")).mapInArrow(read, "rec_id long, a long, b long, prog_len_s long, title string")
    return rows.select("rec_id", F.timestamp_seconds("a").alias("rec_start"), F.timestamp_seconds("b").alias("prog_start"), "prog_len_s", "title")


def xds(files: DataFrame, limit: int = XDS_SCAN) -> DataFrame:
    """(rec_id, name, prog_len_s, elapsed_s) of (rec_id, content)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [read_xds(x or b"", limit) for x in b.column("content").to_pylist()]
            seconds = lambda i: pa.array([None if r[i] is None else 60 * r[i] for r in rows], pa.int64())
            yield pa.record_batch([b.column("rec_id"), pa.array([r[0] for r in rows], pa.string()), seconds(1), seconds(2)], ["rec_id", "name", "prog_len_s", "elapsed_s"])

    return files.select("rec_id", F.substring("content", 1, limit).alias("content")).mapInArrow(read, "rec_id long, name string, prog_len_s long, elapsed_s long")
