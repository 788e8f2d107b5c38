"""Benchmark decontamination by spaced-seed hashing.

A mask keeps some positions of a span of words and ignores the others, so texts
that differ at an ignored position still meet.  The hashes of all items under all
masks are joined with those of all documents; around each hit the item is laid
over the document, and of the stretches with at most one substitution in four words
the one with the most equal words is reported if these are enough.

Items and documents meet by shuffles only.  What is sent to all tasks is a bitmap of the
items' hashes, of 16 MB at most however large the benchmark is: it spares
the shuffle the hashes that no item has, and decides nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop, need, portions, release
from .words import WordHashes, mix

#: Words at 0 are ignored. Any two substitutions within 20 words leave one of these a hit.
MASKS = ("11111111", "1101101011", "1110010111", "11010011101", "101100110011")
#: Words that must be equal in an overlap; items with fewer must be there whole.
LEAST = 12
#: Words of the shortest item that is looked for.
SHORTEST = 1
#: Bits of the bitmap at most.
BITS = 1 << 27
#: Bits a hash while that allows it: one in 600,000 hashes that no item has passes all three probes.
BITS_A_HASH = 256
_SHIFTS = (0, 18, 37)
#: Bytes of the bitmap in one row.
_CHUNK = 1 << 16
_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~“”‘’«»„…¿¡–—"


def _normal(word: str) -> str:
    return word.strip(_PUNCTUATION)


def _masked(words: np.ndarray, mask: str, seed: int) -> np.ndarray:
    n = len(words) - len(mask) + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    h = np.full(n, seed, np.uint64)
    for i, m in enumerate(mask):
        if m == "1":
            h = mix(h + words[i : i + n])
    return h


def _place(h: np.ndarray, probe: int, bits: int) -> np.ndarray:
    """One of the three places of each hash in the bitmap."""
    return (h >> np.uint64(_SHIFTS[probe])) & np.uint64(bits - 1)


def bitmap_rows(h: np.ndarray, bits: int) -> tuple[list[int], list[bytes]]:
    """The chunks of the bitmap that these hashes set bits in."""
    every = np.zeros(bits // 8, np.uint8)
    for at in (_place(h, probe, bits) for probe in range(len(_SHIFTS))):
        np.bitwise_or.at(every, (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
    chunks = every.reshape(-1, min(_CHUNK, len(every)))
    used = np.flatnonzero(chunks.any(axis=1))
    return used.tolist(), [chunks[i].tobytes() for i in used]


def _set(bitmap: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bitmap[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1) == 1


def overlap(doc: np.ndarray, item: np.ndarray, diagonal: int) -> tuple[int, int, int]:
    """(first word in the document, words, equal words) of the stretch on a diagonal with the most equal words, of those with at most a quarter substituted; on ties the first."""
    lo, hi = max(0, diagonal), min(len(doc), diagonal + len(item))
    same = doc[lo:hi] == item[lo - diagonal : hi - diagonal]
    total = np.concatenate([[0], np.cumsum(np.where(same, 1, -3))])  # doesn't fall over a stretch with a quarter substituted and less
    equal = np.concatenate([[0], np.cumsum(same)])
    starts = np.searchsorted(-np.minimum.accumulate(total), -total)  # the earliest for each end
    end = int(np.argmax(equal - equal[starts]))
    start = int(starts[end])
    if equal[end] == equal[start]:
        return lo + start, 0, 0
    start += int(np.argmax(same[start:]))
    return lo + start, end - start, int(equal[end] - equal[start])


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", masks: tuple[str, ...] = MASKS, least: int = LEAST, bits: int = BITS) -> DataFrame:
    """One row per document and item that overlap: doc_id, item_id, start_word, n_words, n_equal.

    Words are lower-cased, split at white space and stripped of punctuation; in scripts without spaces each
    sign is a word.  An overlap has ``least`` equal words, or all of a shorter item's, and at most one
    substitution in four words; per document row and item row the best one is reported, on ties the first.
    Null and empty texts overlap nothing.  Rows that repeat are reported each, documents and items;
    other columns are left out.
    """
    need(docs, id_col, text_col)
    need(benchmark, item_col, item_text_col)
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return _overlaps(src, benchmark.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("text")), masks, least, bits).select("doc_id", "item_id", "start_word", "n_words", "n_equal")


def without_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", masks: tuple[str, ...] = MASKS, least: int = LEAST, bits: int = BITS) -> DataFrame:
    """The rows of ``docs`` that overlap no item, all their columns as they are."""
    need(docs, id_col, text_col)
    need(benchmark, item_col, item_text_col)
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    found = _overlaps(src, benchmark.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("text")), masks, least, bits)
    gone = cut(found.select(F.col("doc_id").alias("_gone"), F.col("text_hash").alias("_gone_hash")).distinct(), "contaminated")
    same = F.col(id_col).eqNullSafe(F.col("_gone")) & (F.xxhash64(text_col) == F.col("_gone_hash"))
    return docs.join(gone, same, "left_anti")


def _overlaps(src: DataFrame, benchmark: DataFrame, masks: tuple[str, ...], least: int, bits: int) -> DataFrame:
    """(doc_id, text_hash, item_id, start_word, n_words, n_equal) of the best overlap of each document row and item row."""
    spark = src.sparkSession
    kind = src.schema["doc_id"].dataType.simpleString()

    def word_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        hashes, row = WordHashes(_normal), TaskContext.get().partitionId() << 33
        for b in batches:
            for part, texts in portions(b, "text"):
                flat, counts = hashes.of(texts)
                words = [w.tobytes() for w in np.split(flat, np.cumsum(counts)[:-1])]
                yield pa.record_batch([part.column("item_id"), pa.array(range(row, row + len(texts)), pa.int64()), pa.array(words, pa.binary()), pa.array(counts, pa.int64())], ["item_id", "item", "item_words", "n"])
                row += len(texts)

    items = cut(benchmark.mapInArrow(word_lists, f"item_id {benchmark.schema['item_id'].dataType.simpleString()}, item long, item_words binary, n long").filter(F.col("n") >= SHORTEST), "items")
    longest = max(map(len, masks))
    short = sorted(r["n"] for r in items.select("n").filter(F.col("n") < longest).distinct().collect())  # fewer than a mask has words
    every_mask = [*masks, *("1" * n for n in short)]

    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The hash at each place of each item, and the one before it; 1 for none."""
        for b in batches:
            h, before, item, place = [], [], [], []
            for i, raw in zip(b.column("item").to_pylist(), b.column("item_words").to_pylist()):
                w = np.frombuffer(raw, np.uint64)
                for m, mask in enumerate(every_mask):
                    if m < len(masks) or len(w) == len(mask):
                        x = _masked(w, mask, m)
                        h.append(x)
                        before.append(np.concatenate([np.ones(min(1, len(x)), np.uint64), x[:-1]]))
                        item.append(np.full(len(x), i))
                        place.append(np.arange(len(x)))
            col = lambda v: pa.array(np.concatenate(v).view(np.int64) if v else np.zeros(0, np.int64))
            yield pa.record_batch([col(h), col(before), col(item), col(place)], ["h", "item_before", "item", "place"])

    seeded = cut(items.select("item", "item_words").mapInArrow(seeds, "h long, item_before long, item long, place long"), "seeds")
    size = 1 << 20
    while size < min(bits, BITS_A_HASH * seeded.count()):
        size *= 2
    size = min(size, bits)

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            chunk, raw = bitmap_rows(b.column("h").to_numpy().view(np.uint64), size)
            yield pa.record_batch([pa.array(chunk, pa.int64()), pa.array(raw, pa.binary())], ["chunk", "raw"])

    def united(table: pa.Table) -> pa.Table:
        raw = np.bitwise_or.reduce([np.frombuffer(r, np.uint8) for r in table.column("raw").to_pylist()])
        return pa.table({"chunk": table.column("chunk")[:1], "raw": pa.array([raw.tobytes()], pa.binary())})

    # At most `size` bits, whatever the benchmark holds.
    bitmap = np.zeros(size // 8, np.uint8)
    for r in seeded.select("h").mapInArrow(mapped, "chunk long, raw binary").groupBy("chunk").applyInArrow(united, "chunk long, raw binary").collect():
        bitmap[r["chunk"] * _CHUNK : r["chunk"] * _CHUNK + len(r["raw"])] = np.frombuffer(r["raw"], np.uint8)
    sent = spark.sparkContext.broadcast(bitmap)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Documents with a hash that an item may have: their words, these hashes, each with the one before it (0 for none) and its place."""
        release()
        hashes, row = WordHashes(_normal), TaskContext.get().partitionId() << 33
        for b in batches:
            for part, texts in portions(b, "text"):
                flat, counts = hashes.of(texts)
                ends = np.cumsum(counts)
                starts = ends - counts
                found = []
                for m, mask in enumerate(every_mask):
                    h = _masked(flat, mask, m)
                    at = np.flatnonzero(_set(sent.value, _place(h, 0, size)))
                    for probe in (1, 2):
                        at = at[_set(sent.value, _place(h[at], probe, size))]
                    doc = np.searchsorted(ends, at, "right")
                    inside = at + len(mask) <= ends[doc]
                    at, doc = at[inside], doc[inside]
                    before = np.where(at > starts[doc], h[at - 1], np.uint64(0)) if len(at) else h[at]
                    found.append((doc, h[at], before, at - starts[doc]))
                doc, h, before, place = (np.concatenate(c) for c in zip(*found))
                order = np.argsort(doc, kind="stable")
                docs, first = np.unique(doc[order], return_index=True)
                offsets = pa.array(np.append(first, len(doc)).astype(np.int32))
                lists = lambda v: pa.ListArray.from_arrays(offsets, pa.array(v[order].view(np.int64)))
                take = pa.array(docs, pa.int64())
                words = pa.array([flat[starts[d] : ends[d]].tobytes() for d in docs], pa.binary())
                yield pa.record_batch([part.column("doc_id").take(take), part.column("text_hash").take(take), pa.array(row + docs, pa.int64()), words, lists(h), lists(before), lists(place)], ["doc_id", "text_hash", "doc", "words", "h", "before", "at"])
                row += len(texts)

    hashed = src.withColumn("text_hash", F.xxhash64("text"))
    suspects = cut(hashed.mapInArrow(scan, f"doc_id {kind}, text_hash long, doc long, words binary, h array<long>, before array<long>, at array<long>"), "suspects")
    hits = cut(suspects.select("doc", F.inline(F.arrays_zip("h", "before", "at"))), "hits")
    # A run of equal places under one mask counts once, where it begins.
    begun = hits.alias("d").join(seeded.alias("i").hint("merge"), (F.col("d.h") == F.col("i.h")) & (F.col("d.before") != F.col("i.item_before")))
    diagonals = begun.select("doc", "item", (F.col("at") - F.col("place")).alias("diagonal")).distinct().groupBy("doc", "item").agg(F.collect_list("diagonal").alias("diagonals"))
    met = cut(diagonals, "diagonals").join(suspects.select("doc", "doc_id", "text_hash", "words").hint("merge"), "doc")
    met = cut(met, "met").join(items.select("item", "item_id", "item_words").hint("merge"), "item")
    columns = ["doc_id", "text_hash", "item_id"]

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for n in range(b.num_rows):
                doc, item = (np.frombuffer(b.column(c)[n].as_py(), np.uint64) for c in ("words", "item_words"))
                best = (0, 0, 0)
                for g in b.column("diagonals")[n].as_py():
                    at, count, same = overlap(doc, item, g)
                    best = max(best, (same, -at, count))
                if best[0] >= min(least, len(item)):
                    rows.append((n, -best[1], best[2], best[0]))
            take = pa.array([r[0] for r in rows], pa.int64())
            yield pa.record_batch([*(b.column(c).take(take) for c in columns), *(pa.array([r[i] for r in rows], pa.int64()) for i in (1, 2, 3))], [*columns, "start_word", "n_words", "n_equal"])

    item_kind = benchmark.schema["item_id"].dataType.simpleString()
    out = cut(met.select(*columns, "words", "item_words", "diagonals").mapInArrow(verify, f"doc_id {kind}, text_hash long, item_id {item_kind}, start_word long, n_words long, n_equal long"), "overlaps")
    sent.destroy()
    drop(seeded, hits, suspects, items)
    return out
