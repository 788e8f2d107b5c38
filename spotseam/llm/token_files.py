"""Token-id files: blocks of ids as byte planes, each compressed with zstandard.

A file holds, behind a magic number: the planes of every block; the documents as
an Arrow stream of (doc_id, n_tokens); the block index (offset, ids, compressed
bytes of each plane); and a footer with the places of both.  A plane of zeros takes
no bytes.  Reading one block needs the footer, the index and its planes only.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import cut, need, new_path, portions
from .tokens import ENCODED, encoder

MAGIC = b"SEAMTOK1"
#: Ids a block.
BLOCK = 1 << 16
_FOOTER = struct.Struct("<QQQQ8s")


def to_planes(ids: np.ndarray, bits: bool = False) -> list[bytes]:
    """Four byte planes of 32-bit ids, or 32 bit planes; b"" for a plane of zeros."""
    b = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    planes = np.packbits(np.unpackbits(b, axis=1, bitorder="little").T.copy(), axis=1) if bits else b.T.copy()
    return [p.tobytes() if p.any() else b"" for p in planes]


def from_planes(planes: list[bytes], n: int) -> np.ndarray:
    width = n if len(planes) == 4 else -(-n // 8)
    m = np.stack([np.frombuffer(p, np.uint8) if p else np.zeros(width, np.uint8) for p in planes])
    if len(planes) == 32:
        m = np.packbits(np.unpackbits(m, axis=1, count=n).T.copy(), axis=1, bitorder="little").T
    return np.ascontiguousarray(m.T).view("<u4").reshape(-1)


class Writer:
    """Writes documents one after another; holds one block of ids."""

    def __init__(self, sink, id_type: pa.DataType, block: int = BLOCK, bits: bool = False):
        self.sink, self.id_type, self.block, self.bits = sink, id_type, block, bits
        self.at, self.index, self.ids = len(MAGIC), [], []
        self.held, self.total, self.docs, self.counts = 0, 0, [], []
        self.zstd = zstandard.ZstdCompressor(level=3)
        sink.write(MAGIC)

    def add(self, doc, ids: np.ndarray) -> None:
        self.docs.append(doc)
        self.counts.append(len(ids))
        self.ids.append(ids)
        self.held += len(ids)
        self.total += len(ids)
        if self.held >= self.block:
            every = np.concatenate(self.ids)
            full = len(every) // self.block * self.block
            for i in range(0, full, self.block):
                self._block(every[i : i + self.block])
            self.ids, self.held = [every[full:]], len(every) - full

    def _block(self, ids: np.ndarray) -> None:
        planes = [self.zstd.compress(p) if p else b"" for p in to_planes(ids, self.bits)]
        self.index.append((self.at, len(ids), *map(len, planes)))
        for p in planes:
            self.sink.write(p)
            self.at += len(p)

    def close(self) -> None:
        if self.held:
            self._block(np.concatenate(self.ids))
        buffer = pa.BufferOutputStream()
        docs = pa.record_batch([pa.array(self.docs, self.id_type), pa.array(self.counts, pa.int64())], ["doc_id", "n_tokens"])
        with pa.ipc.new_stream(buffer, docs.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_batch(docs)
        raw = buffer.getvalue().to_pybytes()
        index = np.array(self.index, "<u8").tobytes()
        self.sink.write(raw)
        self.sink.write(index)
        self.sink.write(_FOOTER.pack(self.at, len(raw), len(index), len(self.index), MAGIC))


class Reader:
    """Random access to blocks, and documents in order with one block held."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        source.seek(size - _FOOTER.size)
        docs_at, docs_len, index_len, blocks, magic = _FOOTER.unpack(source.read(_FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a token-id file, or cut short")
        source.seek(docs_at)
        self.docs = pa.ipc.open_stream(source.read(docs_len)).read_all()
        self.index = np.frombuffer(source.read(index_len), "<u8").reshape(blocks, -1)
        self.zstd = zstandard.ZstdDecompressor()

    def block(self, i: int) -> np.ndarray:
        at, n, *lens = map(int, self.index[i])
        self.source.seek(at)
        return from_planes([self.zstd.decompress(self.source.read(k)) if k else b"" for k in lens], n)

    def documents(self) -> Iterator[tuple[object, int, int]]:
        """(doc_id, n_tokens, crc32 of its ids) of each document."""
        i, left = 0, np.zeros(0, "<u4")
        for b in self.docs.to_batches():
            for doc, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                crc, want = 0, n
                while want:
                    if not len(left):
                        left, i = self.block(i), i + 1
                    part, left = left[:want], left[want:]
                    crc, want = zlib.crc32(np.ascontiguousarray(part, "<u4").tobytes(), crc), want - len(part)
                yield doc, n, crc


def _open(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(path)


def write_token_files(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, bits: bool = False) -> DataFrame:
    """Writes files in ascending id order and returns one row a file: part, path, n_docs, n_tokens.

    Ids may repeat or be null (null first); ties go by text.  A failed task's file is never listed.
    """
    need(docs, id_col, text_col)
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("tie"))
    src = src.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, enc, out = TaskContext.get(), encoder(tokenizer), None
        name = f"{path}/part-{context.partitionId():06d}-{context.taskAttemptId()}.tok"
        for b in batches:
            if not b.num_rows:
                continue
            if out is None:
                fs, where = _open(name)
                fs.create_dir(where.rpartition("/")[0], recursive=True)
                sink = fs.open_output_stream(where)
                out = Writer(sink, b.schema.field("doc_id").type, bits=bits)
            for part, texts in portions(b, "text", ENCODED):
                for k, ids in zip(part.column("doc_id").to_pylist(), enc.encode(texts)):
                    out.add(k, np.append(ids, np.uint32(end_id)))
        if out is not None:
            out.close()
            sink.close()
            yield pa.record_batch([pa.array([context.partitionId()], pa.int64()), pa.array([name]), pa.array([len(out.docs)], pa.int64()), pa.array([out.total], pa.int64())], ["part", "path", "n_docs", "n_tokens"])

    return cut(src.mapInArrow(write, "part long, path string, n_docs long, n_tokens long"), "token-file-list")


def read_token_files(files: DataFrame, id_type: str = "bigint") -> DataFrame:
    """One row per document of the files: doc_id, start (ids before it in all files), n_tokens, ids_crc32."""
    before = F.coalesce(F.sum("n_tokens").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).cast("long")
    listed = files.select("part", "path", before.alias("before"))
    # One file a task: by number, as adaptive execution would put such few and small rows into one.
    spread = listed.repartition(max(1, files.count()), "part")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, at in zip(b.column("path").to_pylist(), b.column("before").to_pylist()):
                fs, where = _open(name)
                with fs.open_input_file(where) as source:
                    reader = Reader(source)
                    rows = [], [], [], []
                    for doc, n, crc in reader.documents():
                        for column, v in zip(rows, (doc, at, n, crc)):
                            column.append(v)
                        at += n
                    kind = reader.docs.schema.field("doc_id").type
                    yield pa.record_batch([pa.array(rows[0], kind), *(pa.array(x, pa.int64()) for x in rows[1:])], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return spread.mapInArrow(read, f"doc_id {id_type}, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2) -> DataFrame:
    """Writes files below the shared folder and reads them back."""
    files = write_token_files(docs, new_path(docs.sparkSession, "token-files"), tokenizer, id_col, text_col, end_id)
    return read_token_files(files, docs.schema[id_col].dataType.simpleString())
