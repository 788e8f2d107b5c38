"""Near-dedup with DartMinHash signatures, banded joining and exact verification.

Each element (a run of five words) owns a region: its weight wide, unbounded in
rank.  A hashed Poisson process throws darts into the region, the same ones in
every document that has the element; of all darts below a rank, each coordinate
keeps the earliest.  Two documents agree in a coordinate with probability equal to
their weighted Jaccard similarity, at a cost of n + k log k rather than n k.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of, cut, drop, need, portions, release
from .links import components
from .words import WordHashes, mix, seeded, shingles

#: Words an element, and least similarity of a link.
SHINGLE, SIMILAR = 5, 0.8
#: A link of similarity 0.8 is missed by all 40 bands of 6 with probability 5e-6.
BANDS, ROWS = 40, 6
#: Members of a bucket compared at once where its first member doesn't link them all.
BLOCK = 512
#: Coordinates that must agree before such a pair is verified: for similarity 0.8 fewer agree with probability 1e-6.
AGREE = 0.67


def dart_signatures(elements: list[np.ndarray], weights: list[np.ndarray] | None, k: int) -> np.ndarray:
    """(documents, k) identifiers of the earliest dart of each coordinate; documents need an element."""
    docs = len(elements)
    best = np.full(docs * k, np.iinfo(np.uint64).max, np.uint64)
    todo, factor = np.arange(docs), 1.0
    goal = k * np.log(k) + 3 * k
    while len(todo):
        h = np.concatenate([elements[i] for i in todo])
        owner = np.repeat(todo, [len(elements[i]) for i in todo])
        room = np.ones(len(h))
        if weights is not None:  # one slab of width 1 (the last narrower) after another
            w = np.concatenate([weights[i] for i in todo]).astype(float)
            n = np.ceil(w).astype(np.int64)
            slab = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            room = np.minimum(1.0, np.repeat(w, n) - slab)
            owner = np.repeat(owner, n)
            h = mix(np.repeat(h, n) + slab.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        total = np.bincount(owner, room, docs)
        limit = (factor * goal / np.maximum(total, 1e-9))[owner]
        rank, turn = np.zeros(len(h)), 0
        while len(h):
            x = seeded(h, turn)
            rank = rank - np.log(((x >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53)
            alive = rank < limit
            h, rank, limit, room, owner, x = h[alive], rank[alive], limit[alive], room[alive], owner[alive], x[alive]
            y = mix(x)
            hit = slice(None) if weights is None else ((mix(y) >> np.uint64(11)).astype(np.float64) * 2.0**-53 < room)
            cell = owner[hit] * k + (y[hit] >> np.uint64(32)).astype(np.int64) % k
            dart = (rank[hit].astype(np.float32).view(np.uint32).astype(np.uint64) << np.uint64(32)) | (mix(x[hit] ^ y[hit]) & np.uint64(0xFFFFFFFF))
            np.minimum.at(best, cell, dart)
            turn += 1
        # A coordinate that no dart has reached needs higher ranks; the darts below stay the same.
        todo = todo[(best.reshape(docs, k)[todo] == np.iinfo(np.uint64).max).any(axis=1)]
        factor *= 2
    return (best.reshape(docs, k) & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def band_keys(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    part = signatures.reshape(len(signatures), bands, rows).astype(np.uint64)
    key = np.broadcast_to(np.arange(bands, dtype=np.uint64), part.shape[:2]).copy()
    for i in range(rows):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + part[:, :, i])
    return key.view(np.int64)


def similarity(a: np.ndarray, b: np.ndarray, wa: np.ndarray | None = None, wb: np.ndarray | None = None) -> float:
    """Jaccard similarity of sorted distinct elements, weighted if weights are given; 1 for two empty ones."""
    if wa is None:
        both = len(np.intersect1d(a, b, assume_unique=True))
        return both / (len(a) + len(b) - both) if len(a) + len(b) else 1.0
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    both = float(np.minimum(wa[i], wb[j]).sum())
    every = float(wa.sum() + wb.sum()) - both
    return both / every if every else 1.0


class _Elements:
    """Elements of texts, with counts if these are the weights."""

    def __init__(self, k: int, counted: bool):
        self.k, self.counted, self.hashes = k, counted, WordHashes()

    def of(self, texts: list[str | None]) -> tuple[list[np.ndarray], list[np.ndarray] | None]:
        flat, counts = self.hashes.of(texts)
        found = shingles(flat, counts, self.k)
        if not self.counted:
            return found, None
        weights, at = [], 0
        for c, e in zip(counts.tolist(), found):
            weights.append(self._counts(flat[at : at + c], e))
            at += c
        return found, weights

    def _counts(self, flat: np.ndarray, e: np.ndarray) -> np.ndarray:
        n = len(flat) - self.k + 1
        if n < 1:
            return np.ones(len(e))
        acc = np.zeros(n, np.uint64)
        for i in range(self.k):
            acc = mix(acc + flat[i : n + i] + np.uint64(0x9E3779B97F4A7C15))
        return np.unique(acc, return_counts=True)[1].astype(float)

    @staticmethod
    def name(e: np.ndarray, w: np.ndarray | None) -> bytes:
        """The same 128 bits for documents of the same weighted elements, and for no others."""
        return xxhash.xxh3_128_digest(e.tobytes() + (b"" if w is None else w.tobytes()))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similar: float = SIMILAR, k: int = SHINGLE, bands: int = BANDS, rows: int = ROWS, weights: str = "set") -> DataFrame:
    """One row per row of ``docs``: doc_id, class_id (the smallest id of its class), class_size, kept, text_hash.

    Classes are the connected components of all links of similarity ``similar`` and more
    between lower-cased runs of ``k`` words; with ``weights="count"`` an element weighs as often as
    it occurs.  A text of fewer words is one element; texts without
    words (null ones too) are copies of one another.  Rows may repeat; a null id sorts
    last.  Of each class the row with the smallest id is kept, of those the one with the smallest
    text_hash; rows that repeat both are kept each.  Other columns are left out.

    Copies collapse to one node first.  The first member of a bucket is its hub; every node is
    verified with the hub that it shares most buckets with, one pair a node.  Buckets that then
    still hold several components are compared across them in blocks, by signature and then by
    text, within the block: links come out, never pairs.
    """
    need(docs, id_col, text_col)
    counted = {"set": False, "count": True}[weights]
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_hash"))
    kind = src.schema["doc_id"].dataType.simpleString()

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        elements = _Elements(k, counted)
        for b in batches:
            for part, texts in portions(b, "text"):
                found, w = elements.of(texts)
                full = [i for i, e in enumerate(found) if len(e)]
                signatures = dart_signatures([found[i] for i in full], None if w is None else [w[i] for i in full], bands * rows) if full else np.zeros((0, bands * rows), np.uint32)
                keys, small = band_keys(signatures, bands, rows), signatures.astype(np.uint8)
                key_rows, byte_rows = [[] for _ in found], [b""] * len(found)
                for n, i in enumerate(full):
                    key_rows[i], byte_rows[i] = keys[n], small[n].tobytes()
                names = [elements.name(e, None if w is None else w[i]) for i, e in enumerate(found)]
                yield pa.record_batch(
                    [part.column("doc_id"), part.column("text_hash"), pa.array(names, pa.binary()), pa.array([len(e) if w is None else int(w[i].sum()) for i, e in enumerate(found)], pa.int64()), pa.array(key_rows, pa.list_(pa.int64())), pa.array(byte_rows, pa.binary())],
                    ["doc_id", "text_hash", "node", "n", "keys", "sig"],
                )

    sketches = cut(src.mapInArrow(sketch, f"doc_id {kind}, text_hash long, node binary, n long, keys array<long>, sig binary"), "sketches")
    row = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "text_hash")
    first = F.min_by(F.struct("n", "keys", "sig"), F.coalesce(F.xxhash64("doc_id"), F.lit(0)))
    nodes = cut(sketches.groupBy("node").agg(F.min(row).alias("row"), F.count("*").alias("copies"), first.alias("f")).select("node", "row.doc_id", "row.text_hash", "copies", "f.*"), "nodes")

    buckets = nodes.select("node", F.posexplode("keys").alias("band", "key"))
    hubs = cut(buckets.groupBy("key").agg(F.min("node").alias("hub"), F.count("*").alias("members")).filter("members > 1"), "hubs")
    members = cut(buckets.join(hubs.hint("merge"), "key").select("key", "band", "node", "hub"), "members")
    drop(hubs)
    # Each member is verified with the one hub that it shares most buckets with.
    shared = members.filter("node <> hub").groupBy(F.col("node").alias("a"), F.col("hub").alias("b")).agg(F.count("*").alias("shared"))
    first = cut(shared.groupBy("a").agg(F.max(F.struct("shared", "b"))["b"].alias("b")), "first-pairs")
    texts = _texts(members, nodes, src, k, counted)
    links = cut(_verified(first, texts, similar, k, counted), "links")
    roots = components(links)
    more = cut(_across(members, nodes, texts, roots, similar, k, counted), "links")
    if not more.isEmpty():
        roots = components(links.unionByName(more))
    drop(members, first, texts, links, more)

    named = cut(nodes.select("node", "doc_id", "text_hash", "copies").join(roots.hint("merge"), "node", "left").select("node", "doc_id", "text_hash", "copies", F.coalesce("root", "node").alias("root")), "classes")
    sizes = cut(named.groupBy("root").agg(F.min(row).alias("row"), F.sum("copies").alias("class_size")).select("root", F.col("row.doc_id").alias("class_id"), F.col("row.text_hash").alias("class_hash"), "class_size"), "class-sizes")
    by_node = cut(named.select("node", "root").join(sizes.hint("merge"), "root").select("node", "class_id", "class_hash", "class_size"), "class-of-node")
    out = sketches.select("doc_id", "text_hash", "node").join(by_node.hint("merge"), "node")
    return out.select("doc_id", "class_id", "class_size", (F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("text_hash") == F.col("class_hash"))).alias("kept"), "text_hash")


def _texts(members: DataFrame, nodes: DataFrame, src: DataFrame, k: int, counted: bool) -> DataFrame:
    """(node, text) of all nodes in buckets, each fetched once by id and text hash."""
    wanted = cut(members.select("node").distinct().join(nodes.select("node", "doc_id", "text_hash").hint("merge"), "node"), "wanted")
    d, w = src.alias("d"), wanted.alias("w")
    same = F.col("d.doc_id").eqNullSafe(F.col("w.doc_id")) & F.col("d.text_hash").eqNullSafe(F.col("w.text_hash"))
    texts = d.join(w.hint("merge"), same).select("w.node", "d.text")

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows that repeat id and text lie one after another: one of them stays, if it is the node's own text."""
        release()
        elements, last = _Elements(k, counted), None
        for b in batches:
            for part, texts in portions(b, "text"):
                e, weight = elements.of(texts)
                good = []
                for i, (x, n) in enumerate(zip(e, part.column("node").to_pylist())):
                    good.append(n != last and elements.name(x, None if weight is None else weight[i]) == n)
                    last = n if good[-1] else last
                yield part.filter(pa.array(good, pa.bool_()))

    return cut(texts.mapInArrow(own, "node binary, text string"), "texts")


def _verified(pairs: DataFrame, texts: DataFrame, similar: float, k: int, counted: bool) -> DataFrame:
    """Those of the pairs (a, b) of nodes whose texts are similar."""
    a, b = texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), texts.select(F.col("node").alias("b"), F.col("text").alias("tb"))
    both = pairs.join(a.hint("merge"), "a").join(b.hint("merge"), "b").select("a", "b", "ta", "tb")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        elements, hub, hub_is = _Elements(k, counted), None, None
        for batch in batches:
            good = []
            hubs = batch.column("b").to_pylist()
            ta, tb = batch.column("ta"), batch.column("tb")
            for part in (slice(i, i + 64) for i in range(0, len(hubs), 64)):
                e, weight = elements.of(ta[part.start : part.stop].to_pylist())
                for i, x in enumerate(e):
                    if hubs[part.start + i] != hub_is:
                        hub_is, hub = hubs[part.start + i], elements.of([tb[part.start + i].as_py()])
                    good.append(similarity(x, hub[0][0], None if weight is None else weight[i], None if weight is None else hub[1][0]) >= similar)
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return both.mapInArrow(verify, "a binary, b binary").distinct()


def _across(members: DataFrame, nodes: DataFrame, texts: DataFrame, roots: DataFrame, similar: float, k: int, counted: bool) -> DataFrame:
    """Links (a, b) between different components of one bucket, enough to join all that are linked there.

    The bucket's largest component is dealt into blocks that meet the others only, so a bucket of m
    members with s outside its largest component costs m + m s / BLOCK rows.
    """
    placed = cut(members.select("key", "band", "node").join(roots.hint("merge"), "node", "left").select("key", "band", "node", F.coalesce("root", "node").alias("root")), "placed")
    parts = placed.groupBy("key", "root").agg(F.count("*").alias("n")).groupBy("key").agg(F.max(F.struct("n", "root")).alias("top"), F.sum("n").alias("every"))
    split = cut(parts.filter("top.n < every").select("key", F.col("top.root").alias("top"), F.ceil((F.col("every") - F.col("top.n")) / BLOCK).alias("few"), F.ceil(F.col("top.n") / BLOCK).alias("many")), "split-buckets")
    left = cut(placed.join(split.hint("merge"), "key"), "left-over").join(nodes.select("node", "n", "keys", "sig").hint("merge"), "node")
    inner, few, many = F.col("root") == F.col("top"), F.col("few").cast("int"), F.col("many").cast("int")
    home = F.pmod(F.xxhash64("node"), F.when(inner, many).otherwise(few)).cast("int")
    cell = lambda kind, x, y, side: F.struct(F.lit(kind).alias("kind"), x.cast("int").alias("x"), y.cast("int").alias("y"), side.cast("int").alias("side"))
    with_few = lambda of: F.transform(F.sequence(F.lit(0), few - 1), of)
    zero, one = F.lit(0), F.lit(1)
    to_many = F.transform(F.sequence(F.lit(0), many - 1), lambda j: cell(0, F.col("home"), j, zero))
    to_few = with_few(lambda j: cell(1, F.least("home", j), F.greatest("home", j), F.when(F.col("home") <= j, zero).otherwise(one)))
    cells = F.when(inner, with_few(lambda i: cell(0, i, F.col("home"), one))).otherwise(F.concat(to_many, to_few))
    dealt = left.withColumn("home", home).select("key", "band", "node", "root", "n", "keys", "sig", F.explode(cells).alias("c"))
    dealt = dealt.select("key", "c.kind", "c.x", "c.y", "c.side", "band", "node", "root", "n", "keys", "sig")
    dealt = dealt.repartition("key", "kind", "x", "y").sortWithinPartitions("key", "kind", "x", "y", "node")
    block = ["key", "kind", "x", "y"]
    takes_part = "key long, kind int, x int, y int, node binary, root binary, others array<binary>"

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Nodes of a block that have candidates, and those; a pair is one in the first bucket that it shares only."""
        release()
        for (key, kind, x, y), rows in _blocks(batches):
            m = len(rows["node"])
            sig = np.frombuffer(b"".join(rows["sig"]), np.uint8).reshape(m, -1)
            keys = np.array(rows["keys"], np.int64).reshape(m, -1)
            n, side, band = np.array(rows["n"], float), np.array(rows["side"]), rows["band"][0]
            root = np.unique(np.array(rows["root"], object), return_inverse=True)[1]
            others: list[list[bytes]] = [[] for _ in range(m)]
            met = np.zeros(m, bool)
            for i in range(m - 1):
                ok = (root[i + 1 :] != root[i]) & (np.minimum(n[i], n[i + 1 :]) >= similar * np.maximum(n[i], n[i + 1 :]))
                if kind == 0 or x != y:
                    ok &= side[i + 1 :] != side[i]
                at = np.flatnonzero(ok) + i + 1
                if len(at):
                    at = at[(sig[at] == sig[i]).mean(axis=1) >= AGREE]
                if len(at):
                    at = at[(keys[at, : band + 1] == keys[i, : band + 1]).argmax(axis=1) == band]
                if len(at):
                    others[i] = [rows["node"][j] for j in at]
                    met[i] = met[at] = True
            use = np.flatnonzero(met)
            pick = lambda c: [rows[c][i] for i in use]
            if len(use):
                same = lambda v, t: pa.array([v] * len(use), t)
                yield pa.record_batch(
                    [same(key, pa.int64()), same(kind, pa.int32()), same(x, pa.int32()), same(y, pa.int32()), pa.array(pick("node"), pa.binary()), pa.array(pick("root"), pa.binary()), pa.array([others[i] for i in use], pa.list_(pa.binary()))],
                    [*block, "node", "root", "others"],
                )

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Candidates whose components are still apart, by their texts."""
        release()
        elements = _Elements(k, counted)
        for _, rows in _blocks(batches):
            at = {v: i for i, v in enumerate(rows["node"])}
            e, weight = [], None if not counted else []
            for part in batches_of(rows["text"]):
                found, w = elements.of(rows["text"][part])
                e += found
                if counted:
                    weight += w
            up: dict[bytes, bytes] = {}

            def top(v: bytes) -> bytes:
                while (u := up.get(v, v)) != v:
                    up[v] = v = up.get(u, u)
                return v

            a, b = [], []
            for i, (v, root, others) in enumerate(zip(rows["node"], rows["root"], rows["others"])):
                for o in others:
                    j = at[o]
                    x, y = top(root), top(rows["root"][j])
                    if x != y and similarity(e[i], e[j], None if weight is None else weight[i], None if weight is None else weight[j]) >= similar:
                        up[x] = y
                        a.append(v)
                        b.append(o)
            if a:
                yield pa.record_batch([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])

    open_pairs = cut(dealt.mapInArrow(compare, takes_part), "open-pairs")
    told = open_pairs.join(texts.hint("merge"), "node").repartition(*block).sortWithinPartitions(*block, "node")
    return told.select(*block, "node", "root", "others", "text").mapInArrow(verify, "a binary, b binary")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, dict[str, list]]]:
    """(the first four columns, all other columns as lists) of runs of rows that agree in the former."""
    held: dict[str, list] = {}
    now = None
    for batch in batches:
        for portion in (batch.slice(i, 1024) for i in range(0, batch.num_rows, 1024)):
            names = portion.schema.names
            keys = list(zip(*(portion.column(i).to_pylist() for i in range(4))))
            columns = {c: portion.column(c).to_pylist() for c in names[4:]}
            at = 0
            while at < len(keys):
                end = at + 1
                while end < len(keys) and keys[end] == keys[at]:
                    end += 1
                if keys[at] != now:
                    if now is not None:
                        yield now, held
                    now, held = keys[at], {c: [] for c in columns}
                for c, v in columns.items():
                    held[c] += v[at:end]
                at = end
    if now is not None:
        yield now, held
