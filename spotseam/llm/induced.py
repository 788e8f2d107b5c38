"""External induced sorting of one shard: its suffixes in order, with the prefix that each shares with the one before it.

Suffixes that are smaller than the next one and follow a larger one are the samples.  The
stretches from sample to sample are sorted on disk and named; the names are a text of half the
length or less, sorted the same way.  From the samples' order two sweeps induce that of
all suffixes: upwards, each suffix sends the one before it, if that is larger, into a queue; downwards
likewise those that are smaller.  The queues lie on disk but for a part of fixed size; their
tuples carry the common prefix, one more than the least of those between their two senders.

``repeats`` takes samples by content instead, as one sweep moves far more bytes than a corpus
may (see the README); this is the same removal by the full method, for shards of a few megabytes.
"""

from __future__ import annotations

import heapq
import os
import struct
import tempfile
from bisect import bisect_left
from collections.abc import Iterator, Sequence

import numpy as np

from .repeats import LENGTH, digest, merged

_RECORD = struct.Struct("<qqqq")
#: Records that a queue keeps in memory, and records read at once.
HELD, BLOCK = 1 << 16, 1 << 12


class Disk:
    """A folder for runs; tells how many bytes lay there at most and were written in all."""

    def __init__(self, folder: str):
        self.folder, self.now, self.most, self.written, self.files = folder, 0, 0, 0, 0

    def path(self) -> str:
        self.files += 1
        return os.path.join(self.folder, f"{self.files}.run")

    def grew(self, n: int) -> None:
        self.now, self.written = self.now + n, self.written + n
        self.most = max(self.most, self.now)

    def remove(self, path: str) -> None:
        self.now -= os.path.getsize(path)
        os.remove(path)


class Run:
    """Records in a file, appended and then read in either direction."""

    def __init__(self, disk: Disk):
        self.disk, self.file, self.n, self.buffer = disk, disk.path(), 0, []

    def add(self, *record: int) -> None:
        self.buffer.append(_RECORD.pack(*record))
        if len(self.buffer) >= BLOCK:
            self._flush()

    def _flush(self) -> None:
        raw = b"".join(self.buffer)
        with open(self.file, "ab") as f:
            f.write(raw)
        self.n += len(self.buffer)
        self.buffer = []
        self.disk.grew(len(raw))

    def records(self, backwards: bool = False) -> Iterator[tuple[int, int, int, int]]:
        self._flush()
        with open(self.file, "rb") as f:
            for at in range(0, self.n, BLOCK):
                size = min(BLOCK, self.n - at)
                f.seek((self.n - at - size if backwards else at) * _RECORD.size)
                rows = list(_RECORD.iter_unpack(f.read(size * _RECORD.size)))
                yield from reversed(rows) if backwards else rows

    def drop(self) -> None:
        self._flush()
        self.disk.remove(self.file)


class DiskQueue:
    """A priority queue of records; beyond ``held`` of them the queue's content goes to a sorted run."""

    def __init__(self, disk: Disk, held: int):
        self.disk, self.held, self.heap, self.heads, self.runs = disk, held, [], [], []

    def push(self, *record: int) -> None:
        heapq.heappush(self.heap, record)
        if len(self.heap) > self.held:
            run = Run(self.disk)
            for r in sorted(self.heap):
                run.add(*r)
            self.heap = []
            rows = run.records()
            self.runs.append(run)
            heapq.heappush(self.heads, (next(rows), len(self.runs) - 1, rows))

    def __bool__(self) -> bool:
        return bool(self.heap or self.heads)

    def first(self) -> tuple[int, int, int, int]:
        if self.heads and (not self.heap or self.heads[0][0] < self.heap[0]):
            return self.heads[0][0]
        return self.heap[0]

    def pop(self) -> tuple[int, int, int, int]:
        if self.heads and (not self.heap or self.heads[0][0] < self.heap[0]):
            record, k, rows = self.heads[0]
            following = next(rows, None)
            if following is None:
                heapq.heappop(self.heads)
                self.runs[k].drop()
            else:
                heapq.heapreplace(self.heads, (following, k, rows))
            return record
        return heapq.heappop(self.heap)


class Minima:
    """The least common prefix since a letter was last met, over a growing sequence."""

    def __init__(self):
        self.at, self.value, self.last, self.n = [], [], {}, 0

    def grow(self, shared: int) -> None:
        while self.value and self.value[-1] >= shared:
            self.at.pop()
            self.value.pop()
        self.at.append(self.n)
        self.value.append(shared)
        self.n += 1

    def since(self, letter: int) -> int:
        """Over all entries behind the last one that asked for this letter; -1 for the first."""
        before, self.last[letter] = self.last.get(letter), self.n
        return -1 if before is None else self.value[bisect_left(self.at, before)]


def _types(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the next one; the empty one at the end is."""
    small = np.zeros(len(text) + 1, bool)
    small[-1] = True
    for i in range(len(text) - 1, -1, -1):
        after = text[i + 1] if i + 1 < len(text) else 0
        small[i] = text[i] < after or (text[i] == after and i + 1 < len(text) and small[i + 1])
    return small


def _run(text: np.ndarray, i: int) -> int:
    """How often the letter at a place stands there in a row."""
    k = i
    while k < len(text) and text[k] == text[i]:
        k += 1
    return k - i


def _shared(text: np.ndarray, i: int, j: int, known: int) -> int:
    k = known
    while i + k < len(text) and j + k < len(text) and text[i + k] == text[j + k]:
        k += 1
    return k


def _named(text: np.ndarray, samples: list[int], disk: Disk, held: int) -> tuple[list[int], int]:
    """The rank of each stretch from sample to sample among the different ones, by an external sort of its letters."""
    n, runs, part, size = len(text), [], [], 0
    paths = []

    def spill() -> None:
        nonlocal part, size
        path = disk.path()
        with open(path, "wb") as f:
            for key, i in sorted(part):
                f.write(struct.pack("<qq", len(key), i) + key)
        disk.grew(os.path.getsize(path))
        paths.append(path)
        part, size = [], 0

    def read(path: str) -> Iterator[tuple[bytes, int]]:
        with open(path, "rb") as f:
            while head := f.read(16):
                length, i = struct.unpack("<qq", head)
                yield f.read(length), i

    for k, i in enumerate(samples):
        end = samples[k + 1] + 1 if k + 1 < len(samples) else n
        # Where one stretch begins another, the shorter one is greater: the longer goes on with something smaller.
        part.append((text[i:end].astype(">u4").tobytes() + (b"\xff" * 4 if end <= n and k + 1 < len(samples) and samples[k + 1] < n else b""), k))
        size += 1
        if size >= held:
            spill()
    if part:
        spill()
    names, last, name = [0] * len(samples), None, 0
    for key, k in heapq.merge(*map(read, paths)):
        name += key != last
        names[k], last = name, key
    for path in paths:
        disk.remove(path)
    return names, name


def sorted_suffixes(text: np.ndarray, disk: Disk, held: int = HELD) -> Run:
    """A run of (place, common prefix with the suffix before it, 0, 0) of all suffixes but the empty one; letters are 1 and above."""
    n = len(text)
    small = _types(text)
    samples = [i for i in range(1, n) if small[i] and not small[i - 1]]
    order = Run(disk)  # the samples in order, with what each shares with the one before
    if samples:
        names, distinct = _named(text, samples, disk, held)
        if distinct == len(samples):
            at = [0] * distinct
            for k, name in enumerate(names):
                at[name - 1] = k
            ranked = ((k, 0) for k in at)
            inner = None
        else:
            inner = sorted_suffixes(np.array(names, np.int64), disk, held)
            ranked = ((k, shared) for k, shared, _, _ in inner.records())
        before = None
        for k, same in ranked:
            i = samples[k]
            known = 0
            if before is not None and same:
                known = (samples[k + same] if k + same < len(samples) else n) - i
                known = min(known, (samples[before + same] if before + same < len(samples) else n) - samples[before])
            order.add(i, 0 if before is None else _shared(text, i, samples[before], known), 0, 0)
            before = k
        if inner is not None:
            inner.drop()

    # Upwards: all larger-than-next suffixes, from the empty suffix and the samples.
    up, queue, turn = Run(disk), DiskQueue(disk, held), 0
    minima = Minima()

    def send(i: int, shared: int) -> None:
        """The suffix before ``i``, if it is of the kind that this sweep sorts, with what it shares with the one sent before it."""
        nonlocal turn
        minima.grow(shared)
        if i > 0 and not small[i - 1]:
            least = minima.since(int(text[i - 1]))
            queue.push(int(text[i - 1]), turn, i - 1, least + 1)
            turn += 1

    send(n, 0)
    seeds = order.records()
    seed = next(seeds, None)
    letter, last = 0, None
    while queue or seed is not None:
        if queue and (seed is None or queue.first()[0] <= text[seed[0]]):
            c, _, i, shared = queue.pop()
            shared = shared if c == letter else 0
            letter, last = c, ("large", i)
            up.add(i, shared, c, 0)
            send(i, shared)
        else:
            i, shared = seed[0], seed[1]
            c = int(text[i])
            if c != letter:
                shared = 0
            elif last[0] == "large":
                shared = min(_run(text, i), _run(text, last[1]))
            letter, last = c, ("small", i)
            send(i, shared)
            seed = next(seeds, None)
    order.drop()

    # Downwards: all suffixes; a common prefix is that with the next larger one until the end.
    down, queue, turn, minima = Run(disk), DiskQueue(disk, held), 0, Minima()

    def send_down(i: int, shared: int) -> None:
        nonlocal turn
        minima.grow(shared)
        if i > 0 and small[i - 1]:
            least = minima.since(int(text[i - 1]))
            queue.push(-int(text[i - 1]), turn, i - 1, least + 1)
            turn += 1

    large = up.records(backwards=True)
    item = next(large, None)
    letter, last, above = 0, None, 0  # `above`: what the last large suffix shares with the one before it
    while queue or item is not None:
        if queue and (item is None or -queue.first()[0] >= item[2]):
            c, _, i, shared = queue.pop()
            c = -c
            shared = shared if c == letter else 0
            letter, last = c, ("small", i)
        else:
            i, before, c, _ = item
            if c != letter:
                shared = 0
            elif last[0] == "small":
                shared = min(_run(text, i), _run(text, last[1]))
            else:
                shared = above
            letter, last, above = c, ("large", i), before
            item = next(large, None)
        down.add(i, shared, 0, 0)
        send_down(i, shared)
    up.drop()

    # Read from its end, an entry's prefix is that with the entry read after it: one step on.
    out, before = Run(disk), 0
    rows = down.records(backwards=True)
    pending = next(rows, None)
    while pending is not None:
        out.add(pending[0], before, 0, 0)
        before, pending = pending[1], next(rows, None)
    down.drop()
    return out


def remove_repeats_of_shard(texts: Sequence[bytes], folder: str | None = None, length: int = LENGTH, held: int = HELD) -> tuple[list[tuple[int, int, int, str]], Disk]:
    """(n_bytes, n_removed, n_spans, kept_sha256) of each text of a shard, and the disk that it took.

    A letter that no byte is stands behind each text, so that no match goes on across it.
    """
    begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
    text = np.frombuffer(b"\0".join([*texts, b""]), np.uint8).astype(np.int64) + 2
    ends = begins[1:] - 1
    text[ends] = 1
    with tempfile.TemporaryDirectory(dir=folder) as place:
        disk = Disk(place)
        windows: list[list[int]] = [[] for _ in texts]
        last = None

        def repeated(i: int) -> None:
            k = int(np.searchsorted(begins, i, "right")) - 1
            if i + length <= ends[k]:
                windows[k].append(i - int(begins[k]))

        for i, shared, _, _ in sorted_suffixes(text, disk, held).records():
            if shared >= length:
                repeated(last)
                repeated(i)
            last = i
        out = [digest(t, merged([(s, s + length) for s in w])) for t, w in zip(texts, windows)]
    return out, disk
