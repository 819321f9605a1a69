"""Vectorised work on the UTF-8 bytes of a column of texts.

A text is cut into words (runs of bytes other than separators) and every word
becomes a 64-bit hash without any Python object of its own: its bytes are read
eight at a time and mixed in a few numpy operations for all words at once.
Blocks of about a megabyte keep the working set small however long a word is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: ASCII white space: 0x09-0x0D and 0x20.
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
#: White space and every other ASCII byte that is no letter or digit.
NON_ALNUM = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
#: A-Z to a-z.
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
IDENTITY = np.arange(256, dtype=np.uint8)

_BLOCK = 1 << 20
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_FIRST = np.uint64(0xD6E8FEB86659FD93)
#: Masks that keep the first 0 to 8 bytes.
_KEEP = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose every output bit depends on every input bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary array; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    if not pa.types.is_large_string(column.type) and not pa.types.is_large_binary(column.type):
        kind = np.int32
    else:
        kind = np.int64
    _, offsets, data = column.buffers()
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    bounds = np.frombuffer(offsets, kind, n + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[bounds[0] : bounds[-1]], bounds - bounds[0]


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about ``limit`` bytes of text, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, bounds = column_bytes(batch.column(text))
        start = 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(bounds, bounds[start] + limit, "right")) - 1)
            yield batch.slice(start, stop - start)
            start = stop


def word_spans(raw: np.ndarray, bounds: np.ndarray, separators: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of all words; a text's border ends a word."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = ~(((raw == 0x20) | ((raw - np.uint8(9)) < 5)) if separators is SPACES else separators[raw])
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    cuts = bounds[(bounds > 0) & (bounds < len(raw))]
    begins[cuts] = inside[cuts]
    starts = np.flatnonzero(begins)
    ends_at = inside.copy()
    ends_at[:-1] &= ~inside[1:]
    ends_at[cuts - 1] = inside[cuts - 1]
    return starts, np.flatnonzero(ends_at) + 1


def folded(raw: np.ndarray, fold: np.ndarray) -> np.ndarray:
    """Bytes mapped by ``fold``."""
    if fold is IDENTITY:
        return raw
    return raw + ((raw - np.uint8(65)) < 26) * np.uint8(32) if fold is LOWER else fold[raw]


def _loads(raw: np.ndarray) -> np.ndarray:
    """The eight bytes from each place of ``raw`` on as one little-endian integer; zeros follow its end."""
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    return np.ndarray((len(raw) + 1,), "<u8", padded, 0, (1,))


def _later_lanes(widths: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(span, lane) of all lanes of eight bytes but the first of each span, in blocks."""
    long = np.flatnonzero(widths > 8)
    more = (widths[long] - 1) // 8
    upto = np.cumsum(more)
    total = int(upto[-1]) if len(long) else 0
    for start in range(0, total, _BLOCK >> 2):
        place = np.arange(start, min(total, start + (_BLOCK >> 2)))
        at = np.searchsorted(upto, place, "right")
        yield long[at], place - (upto[at] - more[at]) + 1


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: np.ndarray = LOWER) -> np.ndarray:
    """A 64-bit hash of each span, its bytes mapped by ``fold``.

    Every eight bytes are mixed with their place in the span by a bijection
    without linear structure, and the results are summed.  Spans of equal
    length of eight bytes or fewer have equal hashes only if they are equal.
    """
    loads = _loads(folded(raw, fold))
    widths = ends - starts
    out = mix64((loads[starts] & _KEEP[np.minimum(widths, 8)]) ^ _FIRST)
    for owner, lane in _later_lanes(widths):
        part = loads[starts[owner] + 8 * lane] & _KEEP[np.minimum(widths[owner] - 8 * lane, 8)]
        part = mix64(part ^ mix64(lane.astype(np.uint64) * _GOLDEN))
        first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        out[owner[first]] += np.add.reduceat(part, first)
    out += widths.astype(np.uint64) * _GOLDEN
    return mix64(out)


def equal_spans(raw: np.ndarray, starts: np.ndarray, other: np.ndarray, places: np.ndarray, widths: np.ndarray) -> np.ndarray:
    """Whether ``widths`` bytes at ``starts`` of ``raw`` are those at ``places`` of ``other``."""
    a, b = _loads(raw), _loads(other)
    out = ((a[starts] ^ b[places]) & _KEEP[np.minimum(widths, 8)]) == 0
    for owner, lane in _later_lanes(widths):
        unlike = ((a[starts[owner] + 8 * lane] ^ b[places[owner] + 8 * lane]) & _KEEP[np.minimum(widths[owner] - 8 * lane, 8)]) != 0
        out[owner[unlike]] = False
    return out


def word_hashes(raw: np.ndarray, bounds: np.ndarray, separators: np.ndarray = SPACES, fold: np.ndarray = LOWER) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, bounds of each text in them)."""
    starts, ends = word_spans(raw, bounds, separators)
    return span_hashes(raw, starts, ends, fold), np.searchsorted(starts, bounds)


def shingle_hashes(words: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each run of ``k`` words, bounds of each text in them).

    A text of one to ``k - 1`` words has one shingle, of all its words; a text
    without words has none.
    """
    n = np.diff(bounds)
    counts = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    out_bounds = np.concatenate([[0], np.cumsum(counts)])
    out = np.zeros(int(out_bounds[-1]), np.uint64)
    salts = [np.uint64(c) for c in mix64(np.arange(1, k + 1, dtype=np.uint64)) | np.uint64(1)]
    if len(words) >= k:
        rolled = np.zeros(len(words) - k + 1, np.uint64)
        for j in range(k):
            rolled += words[j : len(words) - k + 1 + j] * salts[j]
        long_enough = n >= k
        valid = np.zeros(len(words) + 1, np.int32)
        np.add.at(valid, bounds[:-1][long_enough], 1)
        np.add.at(valid, (bounds[1:] - k + 1)[long_enough], -1)
        keep = np.cumsum(valid)[: len(rolled)] > 0
        fill = np.zeros(len(out) + 1, np.int32)
        np.add.at(fill, out_bounds[:-1][long_enough], 1)
        np.add.at(fill, out_bounds[1:][long_enough], -1)
        out[np.cumsum(fill)[:-1] > 0] = rolled[keep]
    for i in np.flatnonzero((n > 0) & (n < k)):
        own = words[bounds[i] : bounds[i + 1]]
        with np.errstate(over="ignore"):
            out[out_bounds[i]] = sum((w * s for w, s in zip(own, salts, strict=False)), np.uint64(len(own)))
    return mix64(out), out_bounds


class HashTable:
    """Places of 64-bit hashes among distinct ones, without sorting what is looked up.

    A level holds one key in each slot; keys that found theirs taken stand in
    the next level, under other bits.
    """

    def __init__(self, keys: np.ndarray):
        self.keys, self.levels = keys, []
        left = np.arange(len(keys))
        while len(left):
            bits, shift = max(4, int(4 * len(left)).bit_length()), 7 * len(self.levels) % 32
            table = np.full(1 << bits, -1, np.int32)
            slots = self._slots(keys[left], bits, shift)
            table[slots] = left
            left = left[table[slots] != left]
            self.levels.append((bits, shift, table))

    @staticmethod
    def _slots(hashes: np.ndarray, bits: int, shift: int) -> np.ndarray:
        return (hashes >> shift) & ((1 << bits) - 1)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Place of each hash among the keys, or -1."""
        if not len(self.keys):
            return np.full(len(hashes), -1, np.int32)
        out = pending = None
        for bits, shift, table in self.levels:
            own = hashes if pending is None else hashes[pending]
            found = table[self._slots(own, bits, shift)]
            right = self.keys[found] == own  # -1 reads the last key: its slot is not empty
            right &= found >= 0
            if pending is None:
                out = np.where(right, found, -1)
                pending = np.flatnonzero(~right & (found >= 0))
            else:
                out[pending[right]] = found[right]
                pending = pending[~right & (found >= 0)]
            if not len(pending):
                break
        return out
