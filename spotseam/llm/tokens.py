"""Exact, fast token ids: the library's model encodes each distinct piece once.

The vocabulary cuts texts into pieces of letters, single digits and runs of other
signs, none of which crosses white space, and a piece's ids don't depend on what
is beside it.  Texts of Latin letters are cut here by the vocabulary's own pattern; of
other texts the words with other letters go through the library whole, with
every Unicode rule.  Arrow numbers the distinct pieces of a batch, so each is looked up once.
"""

from __future__ import annotations

import re
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: The vocabulary's own pre-token pattern, its letters and digits spelled out up to U+017F.
_LETTER, _DIGIT = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff\u0100-\u012f\u0131-\u017f", "0-9\xb2\xb3\xb9\xbc-\xbe"
_PIECES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_DIGIT}]|[^\t-\r {_LETTER}{_DIGIT}]+")
#: Texts of these only: composing changes none of them, lower case is the same everywhere, and white space is ASCII.
_LATIN = re.compile("[\0-\x1b \x21-\x7f\xa1-\u012f\u0131-\u017f]*")
_SPACES = re.compile("[\t-\r ]+")
#: Bytes of text to encode at once: the more, the fewer pieces are looked up again.
ENCODED = 4_000_000


class _Generation:
    """Pieces in one Arrow array, about 50 bytes each, and their ids laid end to end."""

    def __init__(self):
        self.pieces = pa.array([], pa.string())
        self.start, self.len = np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.flat, self.used = np.zeros(4096, np.uint32), 0

    def add(self, pieces: pa.Array, lens: np.ndarray, flat: np.ndarray) -> None:
        n = len(self.pieces)
        if n + len(pieces) > len(self.len):
            grow = max(2 * len(self.len), n + len(pieces))
            self.start, self.len = np.resize(self.start, grow), np.resize(self.len, grow)
        if self.used + len(flat) > len(self.flat):
            self.flat = np.resize(self.flat, max(2 * len(self.flat), self.used + len(flat)))
        self.flat[self.used : self.used + len(flat)] = flat
        self.len[n : n + len(pieces)] = lens
        self.start[n : n + len(pieces)] = self.used + np.cumsum(lens) - lens
        self.used += len(flat)
        self.pieces = pa.concat_arrays([self.pieces, pieces])

    def find(self, pieces: pa.Array) -> np.ndarray:
        return pc.fill_null(pc.index_in(pieces, value_set=self.pieces), -1).to_numpy().astype(np.int64)

    def ids(self, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lengths and ids of pieces, end to end."""
        lens = self.len[index]
        at = np.repeat(self.start[index] - (np.cumsum(lens) - lens), lens)
        at += np.arange(len(at))
        return lens, self.flat[at]


class WordEncoder:
    """Ids of whole texts, equal to ``Tokenizer.encode(text, add_special_tokens=False)``.

    The cache has two generations of ``max_words`` pieces each (about 50 bytes a piece; one batch may
    be more). When the newer one is full it becomes the older one, whose pieces move up again as they are
    met, so that frequent ones stay; that never changes an id.  Strings such as ``<|endoftext|>``
    in a text are ordinary text.  A null text has no ids.
    """

    def __init__(self, path: str, max_words: int = 400_000):
        from tokenizers import Tokenizer, pre_tokenizers

        self._lib = Tokenizer.from_file(path)
        self._lib.encode_special_tokens = True
        self._max = max_words
        self._model = self._lib.model
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self._bytes = lambda w: level.pre_tokenize_str(w)[0][0]
        self._new, self._old = _Generation(), _Generation()

    @staticmethod
    def _cut(text: str) -> list[str]:
        """Pieces of a text; a word with other letters is one piece, with a space before it."""
        if _LATIN.fullmatch(text):
            return _PIECES.findall(text.lower())
        out = []
        for w in _SPACES.split(text):
            if _LATIN.fullmatch(w):
                out += _PIECES.findall(w.lower())
            else:
                out.append(" " + w)
        return out

    def _learn(self, pieces: pa.Array) -> None:
        """Adds pieces to the newer generation: from the older one, by the model, or by the library."""
        if len(self._old.pieces):
            index = self._old.find(pieces)
            known = index >= 0
            self._new.add(pieces.filter(pa.array(known)), *self._old.ids(index[known]))
            pieces = pieces.filter(pa.array(~known))
        model, ids, odd = self._model.tokenize, [], []
        for k, p in enumerate(pieces.to_pylist()):
            if p[0] == " ":
                odd.append((k, p[1:]))
                ids.append([])
            else:
                ids.append([x.id for x in model(p if p.isascii() and p.isprintable() else self._bytes(p))])
        for (k, _), e in zip(odd, self._lib.encode_batch_fast([w for _, w in odd], add_special_tokens=False) if odd else []):
            ids[k] = e.ids
        lens = np.fromiter(map(len, ids), np.int64, len(ids))
        self._new.add(pieces, lens, np.fromiter(chain.from_iterable(ids), np.uint32, int(lens.sum())))

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        pieces = [self._cut(t) if t else [] for t in texts]
        counts = np.fromiter(map(len, pieces), np.int64, len(pieces))
        coded = pa.array(list(chain.from_iterable(pieces)), pa.string()).dictionary_encode()
        del pieces
        distinct = coded.dictionary
        index = self._new.find(distinct)
        if len(missing := np.flatnonzero(index < 0)):
            if len(self._new.pieces) and len(self._new.pieces) + len(missing) > self._max:
                # The newer generation is full: it becomes the older one, and this batch's pieces start the next.
                self._old, self._new, missing = self._new, _Generation(), np.arange(len(distinct))
            fresh = distinct.take(pa.array(missing))
            self._learn(fresh)
            index[missing] = self._new.find(fresh)
        lens, flat = self._new.ids(index[coded.indices.to_numpy()])
        ends = np.concatenate([[0], np.cumsum(lens)])[np.concatenate([[0], np.cumsum(counts)])].tolist()
        return [flat[a:b] for a, b in zip(ends, ends[1:])]


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder a Python worker and vocabulary, kept between tasks (``common.release`` frees it)."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]
