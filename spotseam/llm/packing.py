"""Bounded-space online packing into fixed windows.

Each partition keeps a fixed number of open windows.  A document's full windows
leave at once; its rest goes to the open window that it fits best.  When it fits
none and all places are taken, the fullest window is emitted: with a small gap as
it is, else filled up by the head of the rest.  Windows still open at a
partition's end are leftovers; these are packed once more in groups, and what then
remains is cut into windows whose lengths are powers of two, which need no padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, need, portions
from .tokens import ENCODED, encoder

WINDOW = 2048
#: Open windows a partition; a leftover window holds at most 8 KB of ids.
OPEN = 64
#: A window with at most this gap is emitted as it is; its padding is under 0.4 %.
GAP = 8
#: Leftover windows a group in the second pass.
GROUP = 256


class Packer:
    """Best fit over a fixed number of open windows; a window is a list of pieces (doc, start, doc_tokens, ids)."""

    def __init__(self, window: int, places: int, gap: int):
        self.window, self.places, self.gap = window, places, gap
        self.open: list[list] = []
        self.used: list[int] = []
        self.done: list[list] = []

    def add(self, doc, start: int, total: int, ids: np.ndarray) -> None:
        while len(ids) >= self.window:
            self.done.append([(doc, start, total, ids[: self.window])])
            ids, start = ids[self.window :], start + self.window
        while len(ids):
            fits = [(self.window - u, i) for i, u in enumerate(self.used) if self.window - u >= len(ids)]
            if fits:
                i = min(fits)[1]
                head = len(ids)
            elif len(self.open) < self.places:
                self.open.append([])
                self.used.append(0)
                i, head = len(self.open) - 1, len(ids)
            else:
                i = max(range(len(self.used)), key=self.used.__getitem__)
                head = self.window - self.used[i]
                if head <= self.gap:
                    self._emit(i)
                    continue
            self.open[i].append((doc, start, total, ids[:head]))
            self.used[i] += head
            ids, start = ids[head:], start + head
            if self.used[i] == self.window:
                self._emit(i)

    def _emit(self, i: int) -> None:
        self.done.append(self.open.pop(i))
        self.used.pop(i)

    def rest(self) -> list[list]:
        out, self.open, self.used = self.open, [], []
        return out


def powers_of_two(pieces: list, window: int) -> list[list]:
    """Cuts pieces, in order, into windows of decreasing power-of-two lengths and full windows before them."""
    left = sum(len(p[3]) for p in pieces)
    out, queue = [], [*reversed(pieces)]
    while left:
        size = window if left >= window else 1 << (left.bit_length() - 1)
        left -= size
        room, now = size, []
        while room:
            doc, start, total, ids = queue.pop()
            now.append((doc, start, total, ids[:room]))
            if len(ids) > room:
                queue.append((doc, start + room, total, ids[room:]))
            room -= len(now[-1][3])
        out.append(now)
    return out


_COLUMNS = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _rows(windows: list[list], first: int, ids: bool, kind: pa.DataType) -> pa.RecordBatch:
    """One row a piece; with ``ids`` the row also carries them, for the second pass."""
    flat = [(first + w, p) for w, pieces in enumerate(windows) for p in pieces]
    lens = np.array([len(p[3]) for _, p in flat], np.int64)
    offs = np.concatenate([np.concatenate([[0], np.cumsum([len(p[3]) for p in pieces])[:-1]]) for pieces in windows]).astype(np.int64) if windows else np.zeros(0, np.int64)
    raw = [np.ascontiguousarray(p[3], "<u4").tobytes() for _, p in flat]
    col = lambda v: pa.array(v, pa.int64())
    return pa.record_batch(
        [pa.array([p[0] for _, p in flat], kind), col([p[1] for _, p in flat]), col(lens), col([zlib.crc32(x) for x in raw]), col([p[2] for _, p in flat]), col([s for s, _ in flat]), col(offs), pa.array(raw if ids else [None] * len(flat), pa.binary())],
        ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"],
    )


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, window: int = WINDOW, places: int = OPEN, gap: int = GAP) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Each document's ids and ``end_id`` lie in its pieces once each; null and empty
    texts are the end id alone.  Rows that repeat an id are documents of their own; other
    columns are left out; an empty table gives no pieces.  Sequence ids are unique,
    not gapless.
    """
    need(docs, id_col, text_col)
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = src.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, {_COLUMNS}, ids binary"

    def first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, packer = encoder(tokenizer), Packer(window, places, gap)
        base, made = TaskContext.get().partitionId() << 40, 0
        id_type = None
        for b in batches:
            id_type = b.schema.field("doc_id").type
            for part, texts in portions(b, "text", ENCODED):
                for k, ids in zip(part.column("doc_id").to_pylist(), enc.encode(texts)):
                    ids = np.append(ids, np.uint32(end_id))
                    packer.add(k, 0, len(ids), ids)
                if packer.done:
                    yield _rows(packer.done, base + made, False, id_type)
                    made += len(packer.done)
                    packer.done = []
        if id_type is not None and (left := packer.rest()):
            yield _rows(left, base + made, True, id_type)

    packed = cut(src.mapInArrow(first_pass, schema), "packed")
    final = packed.filter("ids is null").drop("ids")
    rest = packed.filter("ids is not null")
    # Leftovers: at most `places` windows a partition, so a group is bounded, and groups are spread.
    number = rest.select("sequence_id").distinct().count()
    groups = max(1, -(-number // GROUP))
    rest = rest.withColumn("g", F.pmod(F.xxhash64("sequence_id"), F.lit(groups)).cast("long"))

    def second_pass(table: pa.Table) -> pa.Table:
        table = table.sort_by([("sequence_id", "ascending"), ("offset", "ascending")])
        packer, base = Packer(window, places, gap), (1 << 62) + (table.column("g")[0].as_py() << 40)
        for k, s, n, raw in zip(*(table.column(c).to_pylist() for c in ("doc_id", "start", "doc_tokens", "ids"))):
            packer.add(k, s, n, np.frombuffer(raw, "<u4"))
        windows = packer.done + powers_of_two([p for w in packer.rest() for p in w], window)
        return pa.Table.from_batches([_rows(windows, base, False, table.schema.field("doc_id").type)]).drop_columns("ids")

    return final.unionByName(rest.groupBy("g").applyInArrow(second_pass, f"doc_id {kind}, {_COLUMNS}"))
