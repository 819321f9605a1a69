"""Edit-aware token counts.

A document is kept as its pre-token pieces, the bytes and tokens of each, and a
segment tree over leaves of about 64 pieces that sums characters, tokens, bytes
and pieces.  The tree is stored with the document and taken up again as it is.  An edit (start, characters to delete, text to insert)
descends the tree to the leaves it touches, cuts and encodes anew only the
pieces within four bytes of it, and updates the sums on the way up.  Whether a
piece begins at a byte depends on three bytes before and two after it at most,
so what lies farther away is as it was.

Defined results: a null text is an empty one; edits apply in order of ``seq``,
then start; starts and lengths are clamped to the text as it then is; null
starts and lengths count as 0, a null insertion as empty; edits of unknown
documents are ignored; repeated rows are edited each; no edits, no change.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textops import column_bytes, slices
from .tokens import PieceEncoder, default_tokenizer, encoder, piece_starts

LEAF = 64
REACH = 4
_CONTINUES = (np.arange(256) & 0xC0) == 0x80


def _chars(raw: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Characters that begin in each span between ``starts``."""
    return np.add.reduceat((~_CONTINUES[raw]).astype(np.int64), starts) if len(starts) else np.zeros(0, np.int64)


def tree_nodes(chars: np.ndarray, tokens: np.ndarray, sizes: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """The segment tree over leaves of ``leaf`` pieces: rows of characters, tokens, bytes and pieces; node i has children 2i and 2i + 1."""
    edges = np.arange(0, len(sizes), leaf)
    sums = np.zeros((4, len(edges)), np.int64)
    if len(edges):
        for row, values in enumerate((chars, tokens, sizes)):
            sums[row] = np.add.reduceat(values, edges)
        sums[3] = np.diff(np.append(edges, len(sizes)))
    return _grow(sums)


def _grow(sums: np.ndarray) -> np.ndarray:
    """A segment tree over leaves with these sums."""
    base = 1 << max(0, sums.shape[1] - 1).bit_length()
    nodes = np.zeros((4, 2 * base), np.int64)
    nodes[:, base : base + sums.shape[1]] = sums
    while base > 1:
        nodes[:, base // 2 : base] = nodes[:, base : 2 * base : 2] + nodes[:, base + 1 : 2 * base : 2]
        base //= 2
    return nodes


Leaf = tuple[bytes, np.ndarray, np.ndarray]


class PieceTree:
    """Token counts of one document under edits.

    Takes the stored tree as it is: leaves that no edit touches are never cut,
    decoded or summed.
    """

    def __init__(self, raw: bytes, sizes: np.ndarray, tokens: np.ndarray, enc: PieceEncoder, nodes: np.ndarray | None = None):
        self.enc = enc
        self.encoded = 0  # bytes that edits have made encode again
        if nodes is None:
            starts = np.cumsum(sizes) - sizes
            nodes = tree_nodes(_chars(np.frombuffer(raw, np.uint8), starts), tokens, sizes)
        self.nodes = nodes
        own = nodes[:, self.base :]
        count = int(np.flatnonzero(own[3])[-1]) + 1 if own[3].any() else 0
        self.cuts = np.concatenate([np.zeros((2, 1), np.int64), np.cumsum(own[2:, :count], 1)], 1)  # bytes and pieces before each stored leaf
        self.stored = raw, sizes, tokens
        self.leaves: list[int | Leaf] = list(range(count))  # an edited leaf, or the number of a stored one

    @property
    def base(self) -> int:
        return self.nodes.shape[1] // 2

    def leaf(self, at: int) -> Leaf:
        leaf = self.leaves[at]
        if isinstance(leaf, int):
            (a, p), (b, q) = self.cuts[:, leaf].tolist(), self.cuts[:, leaf + 1].tolist()
            raw, sizes, tokens = self.stored
            leaf = raw[a:b], sizes[p:q].astype(np.int64), tokens[p:q].astype(np.int64)
        return leaf

    @staticmethod
    def _sums(leaf: Leaf) -> tuple[int, int, int, int]:
        return len(leaf[0].decode("utf-8", "replace")), int(leaf[2].sum()), len(leaf[0]), len(leaf[1])

    def _set(self, at: int, leaf: Leaf) -> None:
        self.leaves[at] = leaf
        i = self.base + at
        self.nodes[:, i] = self._sums(leaf)
        while i > 1:
            i //= 2
            self.nodes[:, i] = self.nodes[:, 2 * i] + self.nodes[:, 2 * i + 1]

    @property
    def length(self) -> int:
        return int(self.nodes[0, 1])

    @property
    def total(self) -> int:
        return int(self.nodes[1, 1])

    @property
    def n_bytes(self) -> int:
        return int(self.nodes[2, 1])

    def parts(self) -> tuple[bytes, np.ndarray, np.ndarray]:
        """Bytes of the text, and sizes and tokens of all its pieces."""
        found = [self.leaf(i) for i in range(len(self.leaves))]
        join = lambda k: np.concatenate([np.zeros(0, np.int64), *(leaf[k] for leaf in found)])
        return b"".join(leaf[0] for leaf in found), join(1), join(2)

    def text(self) -> str:
        return self.parts()[0].decode()

    def _find(self, char: int) -> tuple[int, int]:
        """(leaf, characters before it) that holds character ``char``; the last one for the text's end."""
        i, before, chars, pieces = 1, 0, self.nodes[0], self.nodes[3]
        while i < self.base:
            i *= 2
            if before + chars[i] <= char and pieces[i + 1]:
                before += int(chars[i])
                i += 1
        return i - self.base, before

    def edit(self, start: int, delete: int, insert: str) -> None:
        start = max(0, min(start, self.length))
        delete = max(0, min(delete, self.length - start))
        new = insert.encode("utf-8", "replace")
        if not delete and not new:
            return
        if not self.leaves:
            self._replace(0, 0, b"", np.zeros(0, np.int64), np.zeros(0, np.int64), 0, 0, new, b"", b"")
            return
        low, before = self._find(start)
        high, _ = self._find(start + delete)
        high = max(high, low)
        # Leaves whose pieces lie within reach of the edit.
        first, last = max(0, low - 1), min(len(self.leaves) - 1, high + 1)
        for i in range(first, low):
            before -= int(self.nodes[0, self.base + i])
        found = [self.leaf(i) for i in range(first, last + 1)]
        raw, sizes, tokens = b"".join(leaf[0] for leaf in found), np.concatenate([leaf[1] for leaf in found]), np.concatenate([leaf[2] for leaf in found])
        text = raw.decode("utf-8", "replace")
        a = len(text[: start - before].encode())
        b = a + len(text[start - before : start - before + delete].encode())
        left = self.leaf(first - 1)[0][-REACH:] if first else b""
        right = self.leaf(last + 1)[0][:REACH] if last + 1 < len(self.leaves) else b""
        self._replace(first, last + 1, raw, sizes, tokens, a, b, new, left, right)

    def _replace(self, first: int, stop: int, raw: bytes, sizes: np.ndarray, tokens: np.ndarray, a: int, b: int, new: bytes, left: bytes, right: bytes) -> None:
        """Bytes ``a .. b`` of the leaves ``first .. stop`` become ``new``."""
        ends = np.cumsum(sizes)
        begins = ends - sizes
        p = max(0, int(np.searchsorted(begins, a - REACH, "right")) - 1)
        q = min(len(sizes), int(np.searchsorted(ends, b + REACH, "left")) + 1)
        lo, hi = (int(begins[p]), int(ends[q - 1])) if len(sizes) else (0, 0)
        middle = raw[lo:a] + new + raw[b:hi]
        around_left, around_right = (left + raw[:lo])[-REACH:], (raw[hi:] + right)[:REACH]
        self.encoded += len(middle)
        fresh_sizes, fresh_tokens = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if middle:
            whole = np.frombuffer(around_left + middle + around_right, np.uint8)
            cut = piece_starts(whole, np.array([0, len(whole)])) - len(around_left)
            cut = cut[(cut > 0) & (cut < len(middle))]
            starts = np.concatenate([[0], cut])
            stops = np.append(starts[1:], len(middle))
            fresh_sizes = stops - starts
            fresh_tokens = np.array(self.enc.count_few([middle[x:y] for x, y in zip(starts.tolist(), stops.tolist(), strict=True)]), np.int64)
        sizes = np.concatenate([sizes[:p], fresh_sizes, sizes[q:]])
        tokens = np.concatenate([tokens[:p], fresh_tokens, tokens[q:]])
        raw = raw[:lo] + middle + raw[hi:]
        cuts = np.concatenate([[0], np.cumsum(sizes)])
        count = stop - first
        parts = max(1, count)
        edges = [len(sizes) * k // parts for k in range(parts + 1)]
        leaves = [(raw[cuts[x] : cuts[y]], sizes[x:y], tokens[x:y]) for x, y in zip(edges, edges[1:], strict=False)]
        if count and max(len(leaf[1]) for leaf in leaves) <= 2 * LEAF:
            for i, leaf in enumerate(leaves):
                self._set(first + i, leaf)
            return
        edges = [*range(0, len(sizes), LEAF), len(sizes)]
        fresh = [(raw[cuts[x] : cuts[y]], sizes[x:y], tokens[x:y]) for x, y in zip(edges, edges[1:], strict=False) if y > x]
        own = self.nodes[:, self.base : self.base + len(self.leaves)]
        self.leaves[first:stop] = fresh
        self.nodes = _grow(np.concatenate([own[:, :first], np.array([self._sums(leaf) for leaf in fresh], np.int64).reshape(-1, 4).T, own[:, stop:]], 1))


def _packed(values: np.ndarray) -> bytes:
    """Counts as one byte each where they fit, else four; the first byte tells."""
    small = not len(values) or values.max() < 256
    return (b"\1" if small else b"\4") + values.astype("u1" if small else "<i4").tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "u1" if data[:1] == b"\1" else "<i4", offset=1)


TREES = "doc_id long, text string, sizes binary, tokens binary, nodes binary, n_tokens long"
EDITED = "doc_id long, text string, sizes binary, tokens binary, nodes binary, n_before long, n_tokens long, n_edits int, text_bytes long, encoded_bytes long"


def build_trees(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, keep: dict | None = None) -> DataFrame:
    """Pieces and token counts of every whole text, ready to be edited.

    ``keep``: further columns, name to DDL type, passed through.
    """
    path = tokenizer or default_tokenizer()
    keep = keep or {}

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in slices(batches, "text"):
            raw, bounds = column_bytes(batch.column("text"))
            starts, tokens, first = enc.counts(raw, bounds)
            sizes = np.diff(np.append(starts, len(raw)))
            chars = _chars(raw, starts)
            own = [slice(a, b) for a, b in zip(first, first[1:], strict=False)]
            nodes = [tree_nodes(chars[x], tokens[x], sizes[x]) for x in own]
            columns = [
                batch.column("doc_id"),
                batch.column("text").fill_null(""),
                pa.array([_packed(sizes[x]) for x in own], pa.binary()),
                pa.array([_packed(tokens[x]) for x in own], pa.binary()),
                pa.array([n.astype("<i4").tobytes() for n in nodes], pa.binary()),
                pa.array([int(n[1, 1]) for n in nodes], pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays([*columns, *(batch.column(c) for c in keep)], ["doc_id", "text", "sizes", "tokens", "nodes", "n_tokens", *keep])

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *keep)
    return rows.mapInArrow(build, ", ".join([TREES, *(f"{k} {v}" for k, v in keep.items())]))


def gather_edits(edits: DataFrame) -> DataFrame:
    """(of, edits) from rows of doc_id, seq, start, delete, insert."""
    one = F.struct("seq", F.col("start").cast("long").alias("start"), F.col("delete").cast("long").alias("delete"), "insert")
    return edits.filter("doc_id is not null").groupBy(F.col("doc_id").alias("of")).agg(F.sort_array(F.collect_list(one)).alias("edits"))


def edit_trees(trees: DataFrame, edits: DataFrame | None = None, tokenizer: str | None = None, full: bool = True) -> DataFrame:
    """Trees after their edits, with the counts before and after.

    Edits come as a table (see ``gather_edits``) or stand in a column ``edits``
    of ``trees``.  ``full`` false leaves out text and pieces.
    """
    path = tokenizer or default_tokenizer()
    if edits is not None:
        trees = trees.join(gather_edits(edits), F.col("doc_id") == F.col("of"), "left").drop("of")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            out: dict[str, list] = {f.split()[0]: [] for f in EDITED.split(", ")}
            for doc_id, text, sizes, tokens, nodes, before, todo in zip(*(batch.column(c) for c in ("doc_id", "text", "sizes", "tokens", "nodes", "n_tokens", "edits")), strict=True):
                raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                tree = PieceTree(raw, _unpacked(sizes.as_py()), _unpacked(tokens.as_py()), enc, np.frombuffer(nodes.as_py(), "<i4").reshape(4, -1).astype(np.int64))
                todo = todo.as_py() or []
                for e in todo:
                    tree.edit(e["start"] or 0, e["delete"] or 0, e["insert"] or "")
                new, *parts = tree.parts() if full else (None, None, None)
                for name, value in (("doc_id", doc_id.as_py()), ("n_before", before.as_py()), ("n_tokens", tree.total), ("n_edits", len(todo)), ("text_bytes", tree.n_bytes), ("encoded_bytes", tree.encoded)):
                    out[name].append(value)
                out["text"].append(new.decode() if full else None)
                out["sizes"].append(_packed(parts[0]) if full else None)
                out["tokens"].append(_packed(parts[1]) if full else None)
                out["nodes"].append(tree.nodes.astype("<i4").tobytes() if full else None)
            kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "int": pa.int32()}
            fields = [f.split() for f in EDITED.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(out[n], kinds[k]) for n, k in fields], [n for n, _ in fields])

    return trees.select("doc_id", "text", "sizes", "tokens", "nodes", "n_tokens", "edits").mapInArrow(apply, EDITED)
