"""Words and shingles as 64-bit hashes, many texts at a time."""

from __future__ import annotations

import re
from collections.abc import Callable
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_GOLD = 0x9E3779B97F4A7C15
_STEP = np.uint64(_GOLD)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose outputs look independent."""
    x = x ^ (x >> np.uint64(30))
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def seeded(x: np.ndarray, seed: int) -> np.ndarray:
    return mix(x + np.uint64(_GOLD * (seed + 1) & 0xFFFFFFFFFFFFFFFF))


#: Letters of scripts that put no spaces between words: Thai to Tibetan, Burmese, Khmer, kana, Han.
_UNSPACED = re.compile("[\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")


def _apart(text: str) -> str:
    """The text with each such letter as a word of its own."""
    return text if text.isascii() or not _UNSPACED.search(text) else _UNSPACED.sub(r" \g<0> ", text)


class WordHashes(dict):
    """Hash of each word; a bounded cache that starts afresh when full. Words that ``normal`` empties have hash 0."""

    def __init__(self, normal: Callable[[str], str] | None = None, limit: int = 200_000):
        super().__init__()
        self.normal, self.limit = normal, limit

    def __missing__(self, word: str) -> int:
        if len(self) >= self.limit:
            self.clear()
        n = self.normal(word) if self.normal else word
        self[word] = h = (xxhash.xxh3_64_intdigest(n) or 1) if n else 0
        return h

    def of(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all words, lower-cased and split at white space (with ``normal`` also between signs of scripts without spaces), and how many each text has.

        Arrow numbers the distinct words of the batch, so each is looked up once.
        """
        words = [(_apart(t) if self.normal and t else t or "").lower().split() for t in texts]
        counts = np.fromiter(map(len, words), np.int64, len(words))
        coded = pa.array(list(chain.from_iterable(words)), pa.string()).dictionary_encode()
        del words
        distinct = coded.dictionary.to_pylist()
        flat = np.fromiter(map(self.__getitem__, distinct), np.uint64, len(distinct))[coded.indices.to_numpy()]
        if self.normal and len(flat):
            owner = np.repeat(np.arange(len(texts)), counts)[flat != 0]
            flat, counts = flat[flat != 0], np.bincount(owner, minlength=len(texts))
        return flat, counts


def shingles(flat: np.ndarray, counts: np.ndarray, k: int) -> list[np.ndarray]:
    """Per text the sorted distinct hashes of its runs of k words; a shorter text is one run; none without words."""
    n = len(flat)
    acc = np.zeros(max(0, n - k + 1), np.uint64)
    for i in range(k):
        acc = mix(acc + flat[i : n - k + 1 + i] + _STEP) if len(acc) else acc
    out, at = [], 0
    for c in counts.tolist():
        if c >= k:
            out.append(np.unique(acc[at : at + c - k + 1]))
        elif c:
            h = np.zeros(1, np.uint64)
            for x in flat[at : at + c]:
                h = mix(h + x + _STEP)
            out.append(seeded(h, c))
        else:
            out.append(np.zeros(0, np.uint64))
        at += c
    return out
