"""Benchmark decontamination by SimHash windows.

Words are runs of letters and digits, A-Z in lower case.  Every benchmark item
is fingerprinted over windows of its size class (the largest of 1, 2, 3, 4, 6,
8, 12, 16, 24, ... words that fits) and of half that size, at its start, middle
and end.  An item that stays similar with a change inside it has smaller windows
too, tiled along all of it, so small that changes in every second of them cost
more similarity than the threshold allows: one stays whole.  Every document is
fingerprinted over windows of those sizes at every word.

Window sums are bit-sliced: plane ``p`` of a position holds bit ``p`` of 64
counters, so windows of 2n words are one ripple-carry addition of two of n, and
the majority is one comparison of planes with a constant.

Fingerprints of 64 bits are cut into ``radius + 1`` blocks.  Two that differ in
at most ``radius`` bits agree in one block at least, so looking up each block
finds every pair within the radius.  Candidates are then verified exactly: the
weighted Jaccard similarity of five-word shingles of the item and of the passage
of the document it is aligned with.  An item's shingle weighs by its rarity
among all items of the benchmark, however they are dealt into blocks; a shingle
that the item has not weighs as its own do on average.

Defined results: null or empty texts and items match nothing; an item of fewer
than five words is one shingle; items that repeat a text are found each; an item
of null id is found with a null id;
repeated documents are found each; empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import materialize
from .textops import NON_ALNUM, column_bytes, mix64, shingle_hashes, slices, word_hashes

SHINGLE = 5
FOUND = "doc_id long, item_id long, similarity double, hamming int, word_start int, n_words int"
_CHUNK = 1 << 16


def size_class(n: int) -> int:
    """Largest of 1, 2, 3, 4, 6, 8, 12, ... that is at most ``n``."""
    p = 1 << (n.bit_length() - 1)
    return p + p // 2 if p > 1 and p + p // 2 <= n else p


#: Sizes of tiles; one of the last, at every word, is a single shingle.
TILES = (12, 8, 6, SHINGLE)


def tiles(weights: np.ndarray, n: int, threshold: float) -> tuple[int, int]:
    """(words, step) of the tiles of an item of ``n`` words with these weights of its shingles in order; (0, 1) if it needs none.

    A break between two words spoils the shingles that span it and, unless an
    end is left off, leads to as many that are not the item's.
    """
    if n < 2 * SHINGLE:
        return 0, 1
    sums = np.concatenate([[0.0], np.cumsum(weights)])
    gap = np.arange(n - 1)
    spoilt = sums[np.minimum(gap + 1, len(weights))] - sums[np.maximum(gap - SHINGLE + 2, 0)]
    budget = (1 - threshold) * sums[-1] + 1e-9
    inner = spoilt[SHINGLE - 2 : n - SHINGLE + 1]
    if inner.min() + threshold * (SHINGLE - 1) * weights.min() > budget:
        return 0, 1
    for size in TILES[:-1]:
        each = [spoilt[o : o + size - 1].min() for o in range(0, n - size + 1, size)]
        if max(sum(each[::2]), sum(each[1::2])) > budget:
            return size, size
    return SHINGLE, 1


def _add(a: list[np.ndarray], b: list[np.ndarray]) -> list[np.ndarray]:
    """Sum of two bit-sliced numbers of equally many planes."""
    carry, out = None, []
    for x, y in zip(a, b, strict=True):
        half = x ^ y
        if carry is None:
            out.append(half)
            carry = x & y
        else:
            out.append(half ^ carry)
            half &= carry
            carry = half | (x & y)
    return [*out, carry]


def fingerprints(words: np.ndarray, sizes: list[int]) -> Iterator[tuple[int, np.ndarray]]:
    """(size, SimHash of each window of that many words) for ascending sizes.

    A bit is set where more than half of the window's words have it.
    """
    n, powers, at = len(words), {1: [mix64(words)]}, 1
    for size in sizes:
        if size > n:
            return
        p = 1 << (size.bit_length() - 1)
        while at < p:
            planes = powers[at]
            m = n - 2 * at + 1
            powers[2 * at] = _add([x[:m] for x in planes], [x[at : at + m] for x in planes])
            at *= 2
        total = powers[p]
        if size > p:
            m, half = n - size + 1, powers[size - p]
            shorter = [x[p : p + m] for x in half]
            longer = [x[:m] for x in total]
            zero = np.zeros(m, np.uint64)
            total = _add(longer, [*shorter, *[zero] * (len(longer) - len(shorter))])
        need = size // 2 + 1
        yes = np.full(len(total[0]), ~np.uint64(0), np.uint64)
        for bit, plane in enumerate(total):
            if need >> bit & 1:
                yes &= plane
            else:
                yes |= plane
        yield size, yes


@dataclass
class SizeIndex:
    """Item windows of one size, with a table of every block's values."""

    prints: np.ndarray
    items: np.ndarray
    offsets: np.ndarray
    blocks: list[tuple[int, int]]
    orders: list[np.ndarray] = field(default_factory=list)
    starts: list[np.ndarray] = field(default_factory=list)
    present: list[np.ndarray] = field(default_factory=list)

    def __post_init__(self) -> None:
        for shift, width in self.blocks:
            value = self._block(self.prints, shift, width)
            order = np.argsort(value, kind="stable")
            self.orders.append(order)
            counts = np.bincount(value, minlength=1 << width)
            self.starts.append(np.concatenate([[0], np.cumsum(counts)]).astype(np.int64))
            self.present.append(counts > 0)

    @staticmethod
    def _block(prints: np.ndarray, shift: int, width: int) -> np.ndarray:
        return ((prints >> np.uint64(shift)) & np.uint64((1 << width) - 1)).astype(np.int32)

    def search(self, prints: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(position, item window, distance) of all pairs within ``radius``."""
        found = []
        for (shift, width), order, starts, present in zip(self.blocks, self.orders, self.starts, self.present, strict=True):
            value = self._block(prints, shift, width)
            hit = np.flatnonzero(present[value])
            if not len(hit):
                continue
            value = value[hit]
            count = starts[value + 1] - starts[value]
            place = np.repeat(starts[value] - (np.cumsum(count) - count), count) + np.arange(count.sum())
            at, of = np.repeat(hit, count), order[place]
            far = np.bitwise_count(prints[at] ^ self.prints[of])
            near = far <= radius
            found.append(np.stack([at[near], of[near], far[near].astype(np.int64)]))
        if not found:
            return (np.zeros(0, np.int64),) * 3
        at, of, far = np.unique(np.concatenate(found, 1), axis=1)
        return at, of, far


class BenchmarkIndex:
    """All that a task needs to search one block of benchmark items."""

    def __init__(self, item_ids: list[int | None], texts: list[str], radius: int = 3, threshold: float = 0.8, total: int | None = None, often: tuple[np.ndarray, np.ndarray] | None = None):
        """``total``: items of the whole benchmark; ``often``: shingles that several of them have, ascending, and in how many each is.  Both are those of ``texts`` unless given."""
        raw, bounds = column_bytes(pa.array(texts, pa.string()))
        words, cuts = word_hashes(raw, bounds, NON_ALNUM)
        self.radius, self.item_ids = radius, pa.array(item_ids, pa.int64())
        self.lengths = np.diff(cuts)
        shingles, of = shingle_hashes(words, cuts, SHINGLE)
        self.shingles = [np.unique(shingles[a:b], return_counts=True) for a, b in zip(of, of[1:], strict=False)]
        known, df = often or np.unique(np.concatenate([s for s, _ in self.shingles]) if self.shingles else np.zeros(0, np.uint64), return_counts=True)
        rarity = 1 + np.log((total or max(len(texts), 1)) / np.maximum(df, 1))
        alone = 1 + np.log(total or max(len(texts), 1))

        def weigh(own: np.ndarray) -> np.ndarray:
            at = np.minimum(np.searchsorted(known, own), max(len(known) - 1, 0))
            return np.where(known[at] == own, rarity[at], alone) if len(known) else np.full(len(own), alone)

        self.weights = [weigh(own) for own, _ in self.shingles]
        width = 64 // (radius + 1)
        blocks = [(b * width, width if b < radius else 64 - b * width) for b in range(radius + 1)]
        windows: dict[int, set[tuple[int, int]]] = {}
        for i, n in enumerate(self.lengths.tolist()):
            if n:
                for size in {size_class(n), size_class(max(1, size_class(n) // 2))}:
                    windows.setdefault(size, set()).update((i, o) for o in (0, (n - size) // 2, n - size))
                size, step = tiles(weigh(shingles[of[i] : of[i + 1]]), n, threshold)
                if size:
                    windows.setdefault(size, set()).update((i, o) for o in range(0, n - size + 1, step))
        self.sizes = sorted(windows)
        self.by_size: dict[int, SizeIndex] = {}
        for size in self.sizes:
            of_item, offset = np.array(sorted(windows[size])).T
            prints, begins = np.zeros(len(of_item), np.uint64), cuts[of_item] + offset
            for low in range(0, len(words), _CHUNK):
                a, b = np.searchsorted(begins, [low, low + _CHUNK])
                if a < b:
                    prints[a:b] = next(p for _, p in fingerprints(words[low : low + _CHUNK + size - 1], [size]))[begins[a:b] - low]
            self.by_size[size] = SizeIndex(prints, of_item, offset, blocks)

    def _weight(self, item: int, shingles: np.ndarray) -> np.ndarray:
        """Weight of each shingle as the item sees it."""
        own, weights = self.shingles[item][0], self.weights[item]
        at = np.minimum(np.searchsorted(own, shingles), len(own) - 1)
        return np.where(own[at] == shingles, weights[at], weights.mean())

    def similarity(self, item: int, words: np.ndarray) -> float:
        """Weighted Jaccard similarity of an item and a passage."""
        mine, times = self.shingles[item]
        other, counts = np.unique(shingle_hashes(words, np.array([0, len(words)]), SHINGLE)[0], return_counts=True)
        every = np.union1d(mine, other)
        a, b = np.zeros(len(every)), np.zeros(len(every))
        a[np.searchsorted(every, mine)], b[np.searchsorted(every, other)] = times, counts
        weight = self._weight(item, every)
        most = float((np.maximum(a, b) * weight).sum())
        return float((np.minimum(a, b) * weight).sum()) / most if most else 0.0

    def best(self, item: int, doc: np.ndarray, start: int) -> tuple[float, int, int]:
        """(similarity, first word, words) of the best passage near an alignment."""
        n = int(self.lengths[item])
        slack, wide = max(2, n // 8), max(2, n // 4)
        low, high = max(0, start - wide), min(len(doc), start + n + wide)
        region = doc[low:high]
        tries = {(max(0, start), min(len(doc), start + n))}
        if len(region) >= SHINGLE and n >= SHINGLE:
            rolled, _ = shingle_hashes(region, np.array([0, len(region)]), SHINGLE)
            hits = low + np.flatnonzero(np.isin(rolled, self.shingles[item][0]))
            if not len(hits):
                return 0.0, low, 0
            for room in (slack, wide):
                near = hits[(hits >= start - room) & (hits + SHINGLE <= start + n + room)]
                if len(near):
                    tries.add((int(near[0]), int(near[-1]) + SHINGLE))
        return max((self.similarity(item, doc[a:b]), a, b - a) for a, b in tries if b > a)

    def search(self, words: np.ndarray, cuts: np.ndarray, threshold: float) -> Iterator[tuple[int, int, float, int, int, int]]:
        """(text, item, similarity, distance, first word, words), the best for each text and item."""
        if not self.sizes or not len(words):
            return
        tries: dict[tuple[int, int], dict[int, int]] = {}
        overlap = self.sizes[-1]
        for begin in range(0, len(words), _CHUNK):
            part = words[begin : begin + _CHUNK + overlap - 1]
            for size, prints in fingerprints(part, self.sizes):
                index = self.by_size[size]
                at, of, far = index.search(prints[:_CHUNK], self.radius)
                if not len(at):
                    continue
                at = at + begin
                text = np.searchsorted(cuts, at, "right") - 1
                inside = at + size <= cuts[text + 1]
                start = at - cuts[text] - index.offsets[of]
                for t, i, s, d in zip(text[inside].tolist(), index.items[of[inside]].tolist(), start[inside].tolist(), far[inside].tolist(), strict=True):
                    known = tries.setdefault((t, i), {})
                    known[s] = min(d, known.get(s, 64))
        for (t, i), starts in sorted(tries.items()):
            doc = words[cuts[t] : cuts[t + 1]]
            (sim, a, n), d = max((self.best(i, doc, s), -d) for s, d in starts.items())
            if sim >= threshold:
                yield t, i, sim, -d, a, n


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", threshold: float = 0.8, radius: int = 3, block_bytes: int = 16 << 20) -> DataFrame:
    """doc_id, item_id, similarity and place of every passage that matches an item.

    The items travel to the executors in blocks of about ``block_bytes`` of
    text; a benchmark beyond that is searched block after block, each over all
    documents.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    out = None
    for index in _indexes(benchmark, item_col, item_text_col, radius, block_bytes, threshold):
        found = rows.mapInArrow(_searcher(index, threshold), FOUND)
        out = found if out is None else out.union(found)
    return out


def _indexes(benchmark: DataFrame, item_col: str, item_text_col: str, radius: int, block_bytes: int, threshold: float) -> Iterator:
    """Broadcast indexes of the blocks of a benchmark; an empty benchmark has one empty block."""
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).alias("text")).filter("length(text) > 0")
    size, total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count(F.lit(1))).first()
    n = max(1, -(-size // block_bytes))
    often = None
    if n > 1:
        shingles = items.select(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)).alias("block"), "text").mapInArrow(_item_shingles, "block long, shingle long")
        often = materialize(shingles.groupBy("shingle").agg(F.count(F.lit(1)).alias("items"), F.collect_set("block").alias("blocks")).filter("items > 1"), "benchmark-shingles")
    for k in range(n):
        own = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).orderBy("item_id").collect()
        counts = None
        if often is not None:
            table = often.filter(F.array_contains("blocks", F.lit(k).cast("long"))).select("shingle", "items").toArrow()
            known = table.column("shingle").to_numpy().view(np.uint64)
            order = np.argsort(known)
            counts = known[order], table.column("items").to_numpy()[order]
        yield benchmark.sparkSession.sparkContext.broadcast(BenchmarkIndex([r.item_id for r in own], [r.text for r in own], radius, threshold, total, counts))


def _item_shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, shingle) for each different shingle of each item."""
    for batch in slices(batches, "text"):
        words, cuts = word_hashes(*column_bytes(batch.column("text")), NON_ALNUM)
        shingles, of = shingle_hashes(words, cuts, SHINGLE)
        own = [np.unique(shingles[a:b]) for a, b in zip(of, of[1:], strict=False)]
        block = np.repeat(batch.column("block").to_numpy(), [len(x) for x in own])
        yield pa.RecordBatch.from_arrays([pa.array(block), pa.array(np.concatenate(own).view(np.int64))], ["block", "shingle"])


def _searcher(index, threshold: float):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            words, cuts = word_hashes(*column_bytes(batch.column("text")), NON_ALNUM)
            found = list(index.value.search(words, cuts, threshold))
            if found:
                text, item, sim, far, start, n = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(text)), index.value.item_ids.take(pa.array(item)), pa.array(sim), pa.array(far, pa.int32()), pa.array(start, pa.int32()), pa.array(n, pa.int32())],
                    ["doc_id", "item_id", "similarity", "hamming", "word_start", "n_words"],
                )

    return search


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", threshold: float = 0.8, radius: int = 3, block_bytes: int = 16 << 20) -> DataFrame:
    """``docs``, all columns, without the rows whose text holds a benchmark passage."""
    for index in _indexes(benchmark, item_col, item_text_col, radius, block_bytes, threshold):
        docs = docs.filter(~_holds(index, threshold)(F.col(text_col)))
    return docs


def _holds(index, threshold: float):
    @F.arrow_udf("boolean")
    def holds(texts: pa.Array) -> pa.Array:
        out: list[np.ndarray] = []
        for batch in slices(iter([pa.RecordBatch.from_arrays([texts], ["text"])]), "text"):
            flags = np.zeros(batch.num_rows, bool)
            words, cuts = word_hashes(*column_bytes(batch.column(0)), NON_ALNUM)
            flags[[t for t, *_ in index.value.search(words, cuts, threshold)]] = True
            out.append(flags)
        return pa.array(np.concatenate(out) if out else np.zeros(0, bool))

    return holds
