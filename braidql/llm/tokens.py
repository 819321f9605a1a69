"""Exact byte-pair token ids for whole columns of text.

A byte-level BPE never merges across the borders of its pre-tokens, so a text
may be cut at borders that are certain whatever stands around them, each
distinct piece encoded once by the tokenizers library, and the ids put
together again.  Certain borders: before one space or line feed between two
other characters, and between an ASCII letter or digit and ASCII punctuation
other than an apostrophe or a bracket (``<|``, ``[`` and the like may belong
to a special token).  Everything between two such cuts is left to the library.
"""

from __future__ import annotations

from itertools import chain

import numpy as np

from .textops import IDENTITY, equal_spans, span_hashes

_KIND = np.zeros(256, np.uint8)  # 1 letter or digit, 2 punctuation that may be cut at, 3 white space, 0 anything else
for _b in range(128):
    _c = chr(_b)
    _KIND[_b] = 1 if _c.isalnum() else 3 if _c.isspace() or 0x1C <= _b <= 0x1F else 2 if _c.isprintable() and _c not in "'<>|[]" else 0
# Last bytes of the non-ASCII characters with the property White_Space, and their first bytes; characters that share them are only cut less.
_MAY_END = np.zeros(256, bool)
_MAY_END[[*range(0x80, 0x8B), 0x9F, 0xA0, 0xA8, 0xA9, 0xAF]] = True
_MAY_BEGIN = np.zeros(256, bool)
_MAY_BEGIN[[0xC2, 0xE1, 0xE2, 0xE3]] = True


def default_tokenizer() -> str:
    """Path of the byte-level BPE file that is used unless a caller names one."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def piece_starts(raw: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Where the pieces of all texts begin; every text begins one unless it is empty."""
    n = len(raw)
    if not n:
        return np.zeros(0, np.int64)
    kind = _KIND[raw]
    here, before = kind[1:], kind[:-1]
    spaced = np.zeros(n, bool)
    blank = ((raw == 0x20) | (raw == 0x0A))[1:-1]
    spaced[1:-1] = blank & (kind[:-2] != 3) & (kind[2:] != 3)
    at = np.flatnonzero(spaced)
    if len(at):
        doubt = _MAY_END[raw[at - 1]] | _MAY_BEGIN[raw[np.minimum(at + 1, n - 1)]]
        spaced[at[doubt]] = False
    edge = np.zeros(n, bool)
    edge[1:] = ((here == 2) & (before == 1)) | ((here == 1) & (before == 2))
    cut = spaced | edge
    starts = bounds[:-1][np.diff(bounds) > 0]
    cut[starts] = True
    # A space right at a text's end or begin was judged by its neighbour text.
    inner_end = bounds[1:][np.diff(bounds) > 1] - 1
    cut[inner_end] &= kind[inner_end] != 3
    return np.flatnonzero(cut)


class _Grown:
    """An array that is appended to, with room to spare."""

    def __init__(self, kind) -> None:
        self.all, self.n = np.zeros(1 << 12, kind), 0

    def add(self, values: np.ndarray) -> None:
        need = self.n + len(values)
        if need > len(self.all):
            self.all = np.concatenate([self.all[: self.n], np.zeros(max(need, 2 * self.n) - self.n, self.all.dtype)])
        self.all[self.n : need] = values
        self.n = need


class PieceEncoder:
    """Ids of whole texts by way of a bounded cache of pieces.

    Pieces are looked up by a hash, and every hit is compared byte by byte: a
    piece that only shares its hash with another is encoded by itself.
    """

    def __init__(self, path: str, cache: int = 600_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.cache = cache
        self.few: dict[bytes, int] = {}
        self._reset()

    def _reset(self) -> None:
        self.known = np.zeros(0, np.uint64)  # ascending hashes
        self.entry = np.zeros(0, np.int64)  # which entry each has
        self.at, self.size, self.width, self.place = (_Grown(np.int64) for _ in range(4))
        self.ids, self.text = _Grown(np.uint32), _Grown(np.uint8)

    def _encode(self, starts: np.ndarray, ends: np.ndarray, data: memoryview) -> tuple[np.ndarray, np.ndarray]:
        """(place in ids, number of ids) of pieces that the library encodes now."""
        sizes = []
        begin = self.ids.n
        for i in range(0, len(starts), 20_000):
            part = [str(data[s:e], "utf-8", "replace") for s, e in zip(starts[i : i + 20_000].tolist(), ends[i : i + 20_000].tolist(), strict=True)]
            found = [e.ids for e in self.tokenizer.encode_batch_fast(part, add_special_tokens=False)]
            size = np.fromiter(map(len, found), np.int64, len(found))
            self.ids.add(np.fromiter(chain.from_iterable(found), np.uint32, int(size.sum())))
            sizes.append(size)
        size = np.concatenate(sizes)
        return begin + np.cumsum(size) - size, size

    def _learn(self, hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray, raw: np.ndarray) -> None:
        at, size = self._encode(starts, ends, memoryview(raw))
        width = ends - starts
        entry = self.at.n + np.arange(len(at))
        place = self.text.n + np.cumsum(width) - width
        self.text.add(raw[np.repeat(starts - (np.cumsum(width) - width), width) + np.arange(int(width.sum()))])
        for column, values in ((self.at, at), (self.size, size), (self.width, width), (self.place, place)):
            column.add(values)
        where = np.searchsorted(self.known, hashes)
        self.known = np.insert(self.known, where, hashes)
        self.entry = np.insert(self.entry, where, entry)

    def _pieces(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in ids, number of ids) of every piece."""
        hashes = span_hashes(raw, starts, ends, IDENTITY)
        distinct, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        if len(distinct) + len(self.known) > self.cache:
            self._reset()
        slot = np.minimum(np.searchsorted(self.known, distinct), max(len(self.known) - 1, 0))
        fresh = np.ones(len(distinct), bool) if not len(self.known) else self.known[slot] != distinct
        if fresh.any():
            self._learn(distinct[fresh], starts[first[fresh]], ends[first[fresh]], raw)
            slot = np.searchsorted(self.known, distinct)
        entry = self.entry[slot][back]
        at, size, width = self.at.all[entry], self.size.all[entry], ends - starts
        same = self.width.all[entry] == width
        same[same] = equal_spans(raw, starts[same], self.text.all[: self.text.n], self.place.all[entry[same]], width[same])
        if not same.all():
            stray = np.flatnonzero(~same)
            at[stray], size[stray] = self._encode(starts[stray], ends[stray], memoryview(raw))
        return at, size

    def count_few(self, pieces: list[bytes]) -> list[int]:
        """Ids in each of a handful of pieces, remembered one by one."""
        new = [p for p in dict.fromkeys(pieces) if p not in self.few]
        if new:
            if len(self.few) > 100_000:
                self.few.clear()
                new = list(dict.fromkeys(pieces))
            found = self.tokenizer.encode_batch_fast([p.decode("utf-8", "replace") for p in new], add_special_tokens=False)
            self.few.update(zip(new, (len(e.ids) for e in found), strict=True))
        return [self.few[p] for p in pieces]

    def counts(self, raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(starts of the pieces, ids in each, first piece of each text)."""
        starts = piece_starts(raw, bounds)
        ends = np.append(starts[1:], len(raw))
        if not len(starts):
            return starts, starts, np.zeros(len(bounds), np.int64)
        return starts, self._pieces(raw, starts, ends)[1], np.searchsorted(starts, bounds)

    def encode(self, raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, bounds of each text in them)."""
        starts = piece_starts(raw, bounds)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(bounds), np.int64)
        at, size = self._pieces(raw, starts, np.append(starts[1:], len(raw)))
        total = np.concatenate([[0], np.cumsum(size)])
        index = np.repeat(at - total[:-1], size) + np.arange(total[-1])
        return self.ids.all[index], total[np.searchsorted(starts, bounds)]


_ENCODERS: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """One encoder for each worker process; its cache outlives a task."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if path not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path] = PieceEncoder(path)
    return _ENCODERS[path]
