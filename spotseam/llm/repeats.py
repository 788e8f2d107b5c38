"""Removal of long repeats: every byte that a 400-byte string covers which also starts elsewhere.

Sorting all suffixes moves many bytes for each byte of text at every level, so only
sampled suffixes are handled, and what holds for them is induced for the rest.  In
each 400-byte window the least hash of its 128-byte strings marks an anchor; equal
windows have equal anchors.  Consecutive windows of one anchor are a node.

1. Nodes are named by their whole span.  Nodes of one name have all windows in
   common: their bytes go.  Nodes whose anchor string stands nowhere else have none.
2. The others, ends of repeats, are cut into blocks of 16 window offsets.  If the
   bytes that a block's windows share stand in no other node, none of its windows repeats.
3. What is left is compared window by window.

Each step shrinks what the next one handles to a few hundredths, and every exchange
is by hash, so no group of equal strings meets in one task.

Passages are found the same way over words instead of bytes: windows of 50 words, named by
nodes, ends window by window.  They say where texts share shorter stretches than 400 bytes,
and remove nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop, need, portions, release
from .words import mix

LENGTH = 400
#: Bytes of an anchor string; a window of 400 has 273 of them.
ANCHOR = 128
#: Window offsets in a block.
BLOCK = 16
#: Words of a passage at least, and words of an anchor in it.
WORDS, WORD_ANCHOR = 50, 10
#: Windows of a long text handled at once, and bytes of a batch.
SEGMENT, BATCH = 1 << 20, 1 << 20
_rng = np.random.Generator(np.random.PCG64(400))
_TABLE = _rng.integers(0, 2**64, (2, 256), dtype=np.uint64)
_BASE = [int(x) * 2 + 1 for x in _rng.integers(2**40, 2**62, 2)]


class _Powers:
    """Powers of both bases and of their inverses, as far as a text needs them."""

    def __init__(self):
        self.n = 0

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.n:
            self.n = max(n, 2 * self.n)
            run = lambda b: np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(self.n, b, np.uint64)]), dtype=np.uint64)
            self.up = np.stack([run(b) for b in _BASE])
            self.down = np.stack([run(pow(b, -1, 2**64)) for b in _BASE])
        return self.up, self.down


_POWERS = _Powers()


class Prefix:
    """Hashes of any substrings: two independent polynomials modulo 2^64."""

    def __init__(self, x: np.ndarray):
        """``x`` are bytes, or 64-bit hashes of words."""
        up, self.down = _POWERS.upto(len(x))
        value = (lambda s: _TABLE[s][x]) if x.dtype == np.uint8 else (lambda s: mix(x ^ _TABLE[s, 0]))
        self.sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(value(s) * up[s, : len(x)], dtype=np.uint64)]) for s in (0, 1)]

    def of(self, start: np.ndarray, length, stream: int) -> np.ndarray:
        p = self.sums[stream]
        return mix((p[start + length] - p[start]) * self.down[stream][start])


def nodes_of(x: np.ndarray, sizes: list[int], length: int = LENGTH, anchor: int = ANCHOR) -> tuple[np.ndarray, np.ndarray, np.ndarray, Prefix]:
    """First and last window and anchor of each node in texts laid end to end, bytes or hashes of words."""
    prefix = Prefix(x)
    n = len(x)
    if n < length:
        return *(np.zeros(0, np.int64),) * 3, prefix
    key = prefix.of(np.arange(n - anchor + 1), anchor, 0) & np.uint64(0xFFFFFFFF00000000)
    key |= np.arange(n - anchor + 1, dtype=np.uint64)  # ties: the first
    span, width = length - anchor + 1, 1
    while width * 2 <= span:
        key, width = np.minimum(key[:-width], key[width:]), width * 2
    if rest := span - width:
        key = np.minimum(key[:-rest], key[rest:])
    ok = np.ones(n, bool)
    for end in np.cumsum(sizes):
        ok[max(0, end - length + 1) : end] = False
    at = np.flatnonzero(ok[: len(key)])
    if not len(at):
        return at, at, at, prefix
    first = (key[at] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.flatnonzero(np.diff(first)) + 1
    lo, hi = at[np.concatenate([[0], new])], at[np.concatenate([new - 1, [len(at) - 1]])]
    return lo, hi, first[np.concatenate([[0], new])], prefix


_SPACE = np.zeros(256, bool)
_SPACE[[*range(9, 14), 32]] = True


def word_hashes(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts, split at ASCII white space, and how many each text has; no word becomes a Python string."""
    x = np.frombuffer(b" ".join([*raws, b""]), np.uint8)
    space = _SPACE[x]
    before = np.concatenate([[True], space[:-1]])
    starts, ends = np.flatnonzero(~space & before), np.flatnonzero(space & ~before)  # a space stands behind each text
    up, down = _POWERS.upto(len(x))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_TABLE[0][x] * up[0, : len(x)], dtype=np.uint64)])
    begins = np.cumsum([0, *(len(r) + 1 for r in raws)])
    return mix((sums[ends] - sums[starts]) * down[0][starts]), np.diff(np.searchsorted(starts, begins))


def segments(raws: list[bytes], length: int = LENGTH, segment: int = SEGMENT, batch: int = BATCH) -> Iterator[list[tuple[int, int, bytes]]]:
    """(text, offset, bytes) of pieces that overlap so that each window lies whole in one, a batch at a time."""
    now, size = [], 0
    for i, raw in enumerate(raws):
        for a in range(0, len(raw) - length + 1, segment):
            piece = raw[a : a + segment - 1 + length]
            if size and size + len(piece) > batch:
                yield now
                now, size = [], 0
            now.append((i, a, piece))
            size += len(piece)
    if now:
        yield now


def merged(intervals: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(intervals):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def digest(raw: bytes, spans: list[tuple[int, int]]) -> tuple[int, int, int, str]:
    h, at = hashlib.sha256(), 0
    for a, b in spans:
        h.update(raw[at:a])
        at = b
    h.update(raw[at:])
    return len(raw), sum(b - a for a, b in spans), len(spans), h.hexdigest()


def _bytes(t: str | None) -> bytes:
    return (t or "").encode("utf-8", "surrogatepass")


_ONE = [("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]
_PAIR = pa.struct([("lo", pa.int64()), ("hi", pa.int64())])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, anchor: int = ANCHOR, words: int = WORDS, word_anchor: int = WORD_ANCHOR) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_passages, passage_words.

    Texts count as UTF-8 bytes, null as empty; texts below ``length`` bytes lose nothing.
    A row that repeats is another place: all of its windows start elsewhere too.
    Ids may be null; other columns are left out; an empty table gives no rows.
    n_passages counts maximal runs of words in which every ``words`` words (as they are, split at ASCII white space) also
    stand elsewhere, the same text included; passage_words their words.  Texts of fewer words have none.
    """
    need(docs, id_col, text_col)
    src = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))
    kind = src.schema["doc_id"].dataType.simpleString()
    places = f"doc_id {kind}, th long, g long, f1 long, f2 long, place long"

    def rows(b: pa.RecordBatch, row: np.ndarray, real: np.ndarray, lo: np.ndarray, hi: np.ndarray, p: np.ndarray, prefix: Prefix, length: int, anchor: int) -> pa.RecordBatch:
        f = [prefix.of(lo, hi - lo + length, s) for s in (0, 1)]
        f[0] = mix(f[0] ^ ((p - lo) * 512 + hi - lo).astype(np.uint64))
        row = pa.array(row)
        sign = lambda v: pa.array(v.view(np.int64))
        return pa.record_batch([b.column("doc_id").take(row), b.column("th").take(row), sign(prefix.of(p, anchor, 0)), sign(f[0]), sign(f[1]), pa.array((real << 20) | ((hi - lo) << 10) | (p - lo))], ["doc_id", "th", "g", "f1", "f2", "place"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for b, texts in (x for batch in batches for x in portions(batch, "text", BATCH)):
            for part in segments(list(map(_bytes, texts)), length):
                lo, hi, p, prefix = nodes_of(np.frombuffer(b"".join(x[2] for x in part), np.uint8), [len(x[2]) for x in part], length, anchor)
                begin = np.cumsum([0, *(len(x[2]) for x in part)])[:-1]
                seg = np.searchsorted(begin, lo, "right") - 1
                real = lo - begin[seg] + np.array([x[1] for x in part])[seg]
                yield rows(b, np.array([x[0] for x in part])[seg], real, lo, hi, p, prefix, length, anchor)

    def scan_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for b, texts in (x for batch in batches for x in portions(batch, "text", BATCH)):
            flat, counts = word_hashes(list(map(_bytes, texts)))
            lo, hi, p, prefix = nodes_of(flat, counts.tolist(), words, word_anchor)
            begin = np.cumsum(counts) - counts
            row = np.searchsorted(begin + counts, lo, "right")
            yield rows(b, row, lo - begin[row], lo, hi, p, prefix, words, word_anchor)

    told = _told(cut(src.mapInArrow(scan, places), "nodes"), "told")
    word_told = _told(cut(src.mapInArrow(scan_words, places), "word-nodes"), "word_told")
    return _finish(src, told, word_told, kind, length, words)


def _told(nodes: DataFrame, name: str) -> DataFrame:
    """(doc_id, th, ``name``: places, each with gone, all its windows repeat, and look, it has to be compared with others)."""
    names = cut(nodes.groupBy("g", "f1", "f2").agg(F.count("*").alias("n"), F.min(F.xxhash64("doc_id", "th", "place")).alias("rep")), "names")
    many = cut(names.groupBy("g").agg(F.count("*").alias("k")).filter("k > 1").select("g"), "anchors")
    ends = names.join(many.withColumn("open", F.lit(True)).hint("merge"), "g", "left").select("f1", "f2", "n", "rep", F.coalesce("open", F.lit(False)).alias("open"))
    ends = cut(ends.filter("n > 1 or open"), "names-open")
    drop(names, many)
    told = nodes.select("doc_id", "th", "f1", "f2", "place").join(ends.hint("merge"), ["f1", "f2"])
    told = told.filter("n > 1 or open").select("doc_id", "th", "place", (F.col("n") > 1).alias("gone"), (F.col("open") & ((F.col("n") == 1) | (F.col("rep") == F.xxhash64("doc_id", "th", "place")))).alias("look"))
    per_doc = cut(told.groupBy("doc_id", "th").agg(F.collect_set(F.struct("place", "gone", "look")).alias(name)), name)
    drop(nodes, ends)
    return per_doc


def _word_ends(told: list[list[dict] | None], raws: list[bytes], words: int) -> tuple[list[list[dict] | None], np.ndarray, list[np.ndarray]]:
    """For each text the spans of words that are known to repeat, and how many windows have to be compared; and these windows: places, two hashes, and whether they count."""
    gone, look, n = [], [], np.zeros(len(raws), np.int64)
    some = [i for i, t in enumerate(told) if t and any(x["look"] for x in t)]
    flat, counts = word_hashes([raws[i] for i in some])
    begin = dict(zip(some, (np.cumsum(counts) - counts).tolist()))
    for i, places in enumerate(told):
        spans = []
        for x in places or ():
            lo, more = x["place"] >> 20, x["place"] >> 10 & 1023
            if x["gone"]:
                spans.append((lo, lo + more + words))
            if x["look"]:
                look.append((lo, more + 1, not x["gone"], begin[i]))
                n[i] += more + 1
        gone.append([{"lo": a, "hi": e} for a, e in merged(spans)] if spans else None)
    if not look:
        return gone, n, [np.zeros(0, np.int64)] * 3 + [np.zeros(0, bool)]
    lo, size, want, base = (np.array(v) for v in zip(*look))
    s = np.repeat(lo - (np.cumsum(size) - size), size) + np.arange(size.sum())
    at, prefix = s + np.repeat(base, size), Prefix(flat)
    return gone, n, [s, *(prefix.of(at, words, i).view(np.int64) for i in (0, 1)), np.repeat(want, size)]


def _finish(src: DataFrame, told: DataFrame, word_told: DataFrame, kind: str, length: int, words: int) -> DataFrame:
    s, t, v = src.alias("s"), told.alias("t"), word_told.alias("v")
    on = lambda x: F.col("s.doc_id").eqNullSafe(F.col(f"{x}.doc_id")) & (F.col("s.th") == F.col(f"{x}.th"))
    met = s.join(t.hint("merge"), on("t"), "left").join(v.hint("merge"), on("v"), "left").select("s.doc_id", "s.th", "s.text", "t.told", "v.word_told")
    fields = [("th", pa.int64()), *_ONE, ("z", pa.binary()), ("gone", pa.list_(_PAIR)), ("place", pa.int64()), ("want", pa.bool_()), ("context", pa.binary()), ("word_gone", pa.list_(_PAIR))]
    word_fields = [("ws", pa.int64()), ("wh1", pa.int64()), ("wh2", pa.int64()), ("wwant", pa.bool_())]

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Finished rows; rows that wait for their ends, with text; and the contexts of open nodes."""
        zstd = zstandard.ZstdCompressor(level=3)
        for b, texts in (x for batch in batches for x in portions(batch, "text")):
            rows, owner, sizes, raws = [], [], [], list(map(_bytes, texts))
            word_gone, n, windows = _word_ends(b.column("word_told").to_pylist(), raws, words)
            for i, (th, raw, told) in enumerate(zip(b.column("th").to_pylist(), raws, b.column("told").to_pylist())):
                gone, wait = [], False
                for x in told or ():
                    lo, more = x["place"] >> 20, x["place"] >> 10 & 1023
                    if x["gone"]:
                        gone.append((lo, lo + more + length))
                    if x["look"]:
                        wait |= not x["gone"]
                        rows.append((th, None, None, None, None, None, None, x["place"], not x["gone"], raw[lo : lo + more + length], None))
                        owner.append(i)
                        sizes.append(0)
                gone = merged(gone)
                pairs = [{"lo": a, "hi": e} for a, e in gone]
                rows.append((th, None, None, None, None, zstd.compress(raw), pairs, None, None, None, word_gone[i]) if wait else (th, *digest(raw, gone), None, None, None, None, None, word_gone[i]))
                owner.append(i)
                sizes.append(n[i])
            offsets = pa.array(np.cumsum([0, *sizes]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(v, t)) for v, (_, t) in zip(windows, word_fields)]
            yield pa.record_batch([b.column("doc_id").take(pa.array(owner, pa.int64())), *(pa.array([r[j] for r in rows], k) for j, (_, k) in enumerate(fields)), *lists], ["doc_id", *(n for n, _ in fields), *(n for n, _ in word_fields)])

    result = "n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    seen = cut(met.mapInArrow(look, f"doc_id {kind}, th long, {result}, z binary, gone array<struct<lo:long,hi:long>>, place long, want boolean, context binary, word_gone array<struct<lo:long,hi:long>>, ws array<long>, wh1 array<long>, wh2 array<long>, wwant array<boolean>"), "seen")
    drop(told, word_told)
    done = seen.filter("kept_sha256 is not null").select("doc_id", "th", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    waiting = seen.filter("z is not null").select("doc_id", "th", "z", "gone")
    contexts = seen.filter("context is not null").select("doc_id", "th", "place", "want", "context")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            take, offs, cores = [], [], []
            for i, (place, raw) in enumerate(zip(b.column("place").to_pylist(), b.column("context").to_pylist())):
                more, p = place >> 10 & 1023, place & 1023
                o = np.arange((p - more) // BLOCK, p // BLOCK + 1)
                core = Prefix(np.frombuffer(raw, np.uint8)).of(p - o * BLOCK, length - BLOCK + 1, 0)
                take += [i] * len(o)
                offs.append(o)
                cores.append(mix(core ^ o.astype(np.uint64)))
            at = pa.array(take, pa.int64())
            flat = lambda v, t: pa.array(np.concatenate(v).view(np.int64) if v else np.zeros(0, np.int64), t)
            yield pa.record_batch([*(b.column(c).take(at) for c in ("doc_id", "th", "place")), flat(offs, pa.int64()), flat(cores, pa.int64())], ["doc_id", "th", "place", "o", "c"])

    cores = cut(contexts.mapInArrow(blocks, f"doc_id {kind}, th long, place long, o long, c long"), "blocks")
    shared = cut(cores.groupBy("c").agg(F.count("*").alias("n")).filter("n > 1").select("c"), "shared-cores")
    live = cores.join(shared.hint("merge"), "c").groupBy("doc_id", "th", "place").agg(F.collect_set("o").alias("os"))
    c, v = contexts.alias("c"), cut(live, "live-blocks").alias("v")
    same = F.col("c.doc_id").eqNullSafe(F.col("v.doc_id")) & (F.col("c.th") == F.col("v.th")) & (F.col("c.place") == F.col("v.place"))
    fine = c.join(v.hint("merge"), same).select("c.*", "v.os")

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            take, starts, h1, h2 = [], [], [], []
            for i, (place, raw, os) in enumerate(zip(*(b.column(c).to_pylist() for c in ("place", "context", "os")))):
                lo, more, p = place >> 20, place >> 10 & 1023, place & 1023
                o = (np.array(sorted(os))[:, None] * BLOCK + np.arange(BLOCK)).ravel()
                s = p - o[(o >= p - more) & (o <= p)]
                prefix = Prefix(np.frombuffer(raw, np.uint8))
                take += [i] * len(s)
                starts.append(s + lo)
                h1.append(prefix.of(s, length, 0))
                h2.append(prefix.of(s, length, 1))
            at = pa.array(take, pa.int64())
            flat = lambda v: pa.array(np.concatenate(v).view(np.int64) if v else np.zeros(0, np.int64))
            yield pa.record_batch([*(b.column(c).take(at) for c in ("doc_id", "th", "want")), flat(starts), flat(h1), flat(h2)], ["doc_id", "th", "want", "s", "h1", "h2"])

    every = cut(fine.mapInArrow(windows, f"doc_id {kind}, th long, want boolean, s long, h1 long, h2 long"), "windows")
    again = cut(every.groupBy("h1", "h2").agg(F.count("*").alias("n")).filter("n > 1").select("h1", "h2"), "repeated-windows")
    found = every.filter("want").select("doc_id", "th", "s", "h1", "h2").join(again.hint("merge"), ["h1", "h2"]).select("doc_id", "th", "s")
    found = cut(found.groupBy("doc_id", "th").agg(F.collect_set("s").alias("ss")), "found")
    w, f = waiting.alias("w"), found.alias("f")
    on = F.col("w.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("w.th") == F.col("f.th"))
    last = w.join(f.hint("merge"), on, "left").select("w.doc_id", "w.th", "w.z", "w.gone", "f.ss")
    drop(cores, shared, every, again)

    def end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zstd = zstandard.ZstdDecompressor()
        for b in batches:
            out = []
            for z, gone, ss in zip(*(b.column(c).to_pylist() for c in ("z", "gone", "ss"))):
                raw = zstd.decompress(z) if len(z) else b""
                out.append(digest(raw, merged([(x["lo"], x["hi"]) for x in gone] + [(s, s + length) for s in ss or ()])))
            yield pa.record_batch([b.column("doc_id"), b.column("th"), *(pa.array([r[j] for r in out], k) for j, (_, k) in enumerate(_ONE))], ["doc_id", "th", *(n for n, _ in _ONE)])

    r, p = done.unionByName(last.mapInArrow(end, f"doc_id {kind}, th long, {result}")).alias("r"), _passages(seen, words).alias("p")
    on = F.col("r.doc_id").eqNullSafe(F.col("p.doc_id")) & (F.col("r.th") == F.col("p.th"))
    n = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return r.join(p.hint("merge"), on, "left").select("r.doc_id", *(f"r.{c}" for c, _ in _ONE), n("n_passages"), n("passage_words"))


def _passages(seen: DataFrame, words: int) -> DataFrame:
    """(doc_id, th, n_passages, passage_words) of texts that have any."""
    zipped = F.arrays_zip(F.col("ws").alias("s"), F.col("wh1").alias("h1"), F.col("wh2").alias("h2"), F.col("wwant").alias("want"))
    windows = cut(seen.filter(F.size("ws") > 0).select("doc_id", "th", F.inline(zipped)), "word-windows")
    again = cut(windows.groupBy("h1", "h2").agg(F.count("*").alias("n")).filter("n > 1").select("h1", "h2"), "repeated-word-windows")
    open_ends = windows.filter("want").join(again.hint("merge"), ["h1", "h2"]).select("doc_id", "th", F.col("s").alias("lo"), (F.col("s") + words).alias("hi"))
    known = seen.filter("word_gone is not null").select("doc_id", "th", F.inline("word_gone"))
    spans = F.array_sort(F.collect_set(F.struct("lo", "hi")))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("w"), F.lit(-1).cast("long").alias("end"))
    # Spans in order: one that begins behind all before it opens a passage; each adds what lies behind the end so far.
    add = lambda a, x: F.struct((a["n"] + (x["lo"] > a["end"]).cast("long")).alias("n"), (a["w"] + F.greatest(F.lit(0).cast("long"), x["hi"] - F.greatest(x["lo"], a["end"]))).alias("w"), F.greatest(a["end"], x["hi"]).alias("end"))
    found = known.unionByName(open_ends).groupBy("doc_id", "th").agg(F.aggregate(spans, start, add).alias("x"))
    out = cut(found.select("doc_id", "th", F.col("x.n").alias("n_passages"), F.col("x.w").alias("passage_words")).filter("n_passages > 0"), "passages")
    drop(windows, again)
    return out
