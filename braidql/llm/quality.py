"""Quality classifier: a factorisation machine over texts.

Inputs of a score: hashed words of the text, statistics of its structure, and
metadata given by name (here the stated number of characters).  Pairs of
inputs interact through low-rank factors; the sum-of-squares identity
``sum_i<j <v_i, v_j> x_i x_j = 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)``
scores a text in time linear in its inputs.

Training reads a bounded sample of labelled rows: the ``sample`` rows of
smallest hash, and no more of them than have ``feature_bytes`` of features.
Both bounds are parameters; scoring reads every whole text.

Defined results: a null text is an empty one and gets a score too; null
metadata counts as 0; rows without a label, or with labels other than 0 and 1,
are not learned from; without any labelled row every score is 0.5; repeated
rows get equal scores; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import give_back, materialize
from .textops import SPACES, column_bytes, mix64, slices, span_hashes, word_hashes, word_spans

LINE_END = np.zeros(256, bool)
LINE_END[[0x0A, 0x0D]] = True


def _bytes_in(*spans: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, bool)
    for a, b in spans:
        out[a : b + 1] = True
    return out


_CLASSES = [
    _bytes_in((0x41, 0x5A)),  # capitals
    _bytes_in((0x61, 0x7A)),  # small letters
    _bytes_in((0x30, 0x39)),
    SPACES,
    _bytes_in((0x0A, 0x0A)),
    _bytes_in((0x2C, 0x2C), (0x2E, 0x2E), (0x3A, 0x3B), (0x3F, 0x3F)),  # prose punctuation
    _bytes_in((0x21, 0x21)),
    _bytes_in((0x23, 0x26), (0x2A, 0x2B), (0x40, 0x40), (0x5E, 0x5E), (0x7E, 0x7E)),  # symbols
    _bytes_in((0x3C, 0x3E), (0x5B, 0x5D), (0x7B, 0x7D), (0x5F, 0x5F), (0x2F, 0x2F)),  # mark-up, tables and code
    _bytes_in((0x80, 0xFF)),
]
N_STATS = len(_CLASSES) + 8


def _distinct(owner: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """How many different values each owner has."""
    if not len(values):
        return np.zeros(n)
    order = np.lexsort((values, owner))
    o, v = owner[order], values[order]
    new = np.ones(len(o), bool)
    new[1:] = (o[1:] != o[:-1]) | (v[1:] != v[:-1])
    return np.bincount(o[new], minlength=n).astype(float)


def structure(raw: np.ndarray, bounds: np.ndarray, words: np.ndarray, word_bounds: np.ndarray, meta: list[np.ndarray]) -> np.ndarray:
    """A row of statistics for each text, roughly of unit size; metadata columns follow."""
    n = len(bounds) - 1
    size = np.diff(bounds).astype(float)
    safe = np.maximum(size, 1)
    columns = []
    for member in _CLASSES:
        total = np.concatenate([[0], np.cumsum(member[raw], dtype=np.int64)])
        columns.append((total[bounds[1:]] - total[bounds[:-1]]) / safe)
    count = np.diff(word_bounds).astype(float)
    owner = np.repeat(np.arange(n), np.diff(word_bounds))
    starts, ends = word_spans(raw, bounds, LINE_END)
    line_owner = np.searchsorted(bounds, starts, "right") - 1
    lines = np.bincount(line_owner, minlength=n).astype(float)
    kinds = _distinct(line_owner, span_hashes(raw, starts, ends), n)
    columns += [
        np.log1p(size) / 10,
        np.log1p(count) / 8,
        np.minimum(size / np.maximum(count, 1) / 10, 3),
        _distinct(owner, words, n) / np.maximum(count, 1),
        np.log1p(lines) / 5,
        np.where(lines > 0, kinds / np.maximum(lines, 1), 1),
        np.log1p(size / np.maximum(lines, 1)) / 8,
        (count == 0).astype(float),
    ]
    columns += [np.log1p(np.abs(np.nan_to_num(m.astype(float)))) / 10 for m in meta]
    return np.stack(columns, 1).astype(np.float32)


def features(raw: np.ndarray, bounds: np.ndarray, meta: list[np.ndarray], bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bounds, hashed indices, values) of the words of each text, and the statistics."""
    n = len(bounds) - 1
    words, word_bounds = word_hashes(raw, bounds, SPACES)
    stats = structure(raw, bounds, words, word_bounds, meta)
    owner = np.repeat(np.arange(n, dtype=np.uint64), np.diff(word_bounds))
    keys, times = np.unique((owner << np.uint64(bits)) | (mix64(words) & np.uint64((1 << bits) - 1)), return_counts=True)
    of = (keys >> np.uint64(bits)).astype(np.int64)
    value = np.log1p(times).astype(np.float32)
    norm = np.sqrt(np.bincount(of, value.astype(float) ** 2, n))
    value /= np.maximum(norm, 1e-9)[of].astype(np.float32)
    return np.searchsorted(of, np.arange(n + 1)), (keys & np.uint64((1 << bits) - 1)).astype(np.int32), value, stats


def _row_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of each text's rows; what stands before a text does not touch its rounding."""
    out = np.zeros((len(bounds) - 1, values.shape[1]))
    some = np.flatnonzero(np.diff(bounds))
    if len(some):
        out[some] = np.add.reduceat(values.astype(np.float64), bounds[some], axis=0)
    return out


def _row_dots(rows: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """``rows @ weights``, each row's rounding its own however many there are."""
    return (rows.reshape(*rows.shape, *[1] * (weights.ndim - 1)) * weights).sum(1)


@dataclass
class FactorMachine:
    """Weights of hashed words (first ``2**bits`` rows) and of statistics."""

    bits: int
    bias: float
    linear: np.ndarray
    factors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def parts(self, bounds, index, value, stats):
        """(linear sums, factor sums, squared factor sums) of each text."""
        dense = np.clip((stats - self.mean) / self.scale, -4, 4)
        words = 1 << self.bits
        v = self.factors[index] * value[:, None]
        one = _row_sums(np.column_stack([self.linear[index] * value, (v * v).sum(1), v]), bounds)
        own = self.factors[words:]
        linear = one[:, 0] + _row_dots(dense, self.linear[words:])
        return dense, linear, one[:, 2:] + _row_dots(dense, own), one[:, 1] + _row_dots(dense**2, (own**2).sum(1))

    def logits(self, bounds, index, value, stats) -> np.ndarray:
        _, linear, sums, squares = self.parts(bounds, index, value, stats)
        return self.bias + linear + 0.5 * ((sums**2).sum(1) - squares)

    def scores(self, *inputs) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(*inputs), -30, 30)))


def train(bounds, index, value, stats, labels, bits: int, rank: int = 8, epochs: int = 12, batch: int = 256, rate: float = 0.02, decay: float = 1e-5, seed: int = 7) -> FactorMachine:
    """Minibatch Adam on the logistic loss."""
    rng = np.random.default_rng(seed)
    n, words = len(labels), 1 << bits
    rows = words + stats.shape[1]
    mean, scale = stats.mean(0), np.maximum(stats.std(0), 1e-3)
    model = FactorMachine(bits, 0.0, np.zeros(rows, np.float32), (rng.standard_normal((rows, rank)) * 0.05).astype(np.float32), mean, scale)
    share = np.clip(labels.mean(), 0.01, 0.99)
    model.bias = float(np.log(share / (1 - share)))
    params = [model.linear, model.factors]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    step = 0
    for _ in range(epochs):
        order = rng.permutation(n)
        for at in range(0, n, batch):
            pick = np.sort(order[at : at + batch])
            sizes = bounds[pick + 1] - bounds[pick]
            own_bounds = np.concatenate([[0], np.cumsum(sizes)])
            flat = np.repeat(bounds[pick] - own_bounds[:-1], sizes) + np.arange(own_bounds[-1])
            idx, val, st = index[flat], value[flat], stats[pick]
            dense, linear, sums, squares = model.parts(own_bounds, idx, val, st)
            logit = model.bias + linear + 0.5 * ((sums**2).sum(1) - squares)
            error = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - labels[pick]) / len(pick)
            model.bias -= rate * float(error.sum())
            scaled = np.repeat(error, sizes) * val
            grads = [np.zeros_like(p) for p in params]
            grads[0][:words] = np.bincount(idx, scaled, words)
            grads[0][words:] = error @ dense
            owner = np.repeat(np.arange(len(pick)), sizes)
            pull = np.bincount(idx, scaled * val, words)
            for f in range(rank):
                grads[1][:words, f] = np.bincount(idx, scaled * sums[owner, f], words) - pull * model.factors[:words, f]
            grads[1][words:] = dense.T @ (error[:, None] * sums) - (error @ dense**2)[:, None] * model.factors[words:]
            step += 1
            for p, g, m, s in zip(params, grads, first, second, strict=True):
                g += decay * p
                m += 0.1 * (g - m)
                s += 0.001 * (g * g - s)
                p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    return model


def _meta(batch: pa.RecordBatch, names: list[str]) -> list[np.ndarray]:
    return [batch.column(c).cast(pa.float64()).fill_null(0.0).to_numpy(zero_copy_only=False) for c in names]


def fit(labelled: DataFrame, text_col: str = "text", label_col: str = "label", order_col: str = "order", meta_cols: tuple[str, ...] = (), bits: int = 16, sample: int = 8000, feature_bytes: int = 128 << 20, **options) -> FactorMachine | None:
    """Train on the ``sample`` rows of smallest ``order_col``, or as many as have ``feature_bytes`` of features.

    Texts stay on the executors; their features come to the driver.
    """
    names = [f"m{i}" for i in range(len(meta_cols))]
    rows = (
        labelled.filter(F.col(label_col).isin(0, 1))
        .select(F.col(text_col).alias("text"), F.col(label_col).cast("int").alias("label"), F.col(order_col).alias("o"), *[F.col(c).cast("double").alias(a) for c, a in zip(meta_cols, names, strict=True)])
        .orderBy("o", "label")
        .limit(sample)
    )

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            bounds, index, value, stats = features(*column_bytes(batch.column("text")), _meta(batch, names), bits)
            blobs = [(index[a:b].tobytes(), value[a:b].tobytes()) for a, b in zip(bounds, bounds[1:], strict=False)]
            yield pa.RecordBatch.from_pydict({"o": batch.column("o"), "label": batch.column("label"), "i": pa.array([x for x, _ in blobs], pa.binary()), "v": pa.array([x for _, x in blobs], pa.binary()), "s": pa.array([r.tobytes() for r in stats], pa.binary())})
        give_back()

    extracted = materialize(rows.mapInArrow(extract, "o long, label int, i binary, v binary, s binary"), "quality-features")
    sizes = sorted(extracted.select("o", F.octet_length("i") + F.octet_length("v") + F.octet_length("s")).collect())
    room = np.cumsum([n for _, n in sizes]) <= feature_bytes
    if sizes and not room.all():
        extracted = extracted.filter(F.col("o") < sizes[int(np.argmin(room))][0])
    found = extracted.collect()
    found.sort(key=lambda r: (r.o, r.label, bytes(r.s), bytes(r.i)))
    if not found:
        return None
    index = np.concatenate([np.frombuffer(r.i, np.int32) for r in found])
    value = np.concatenate([np.frombuffer(r.v, np.float32) for r in found])
    bounds = np.concatenate([[0], np.cumsum([len(r.i) // 4 for r in found])])
    stats = np.stack([np.frombuffer(r.s, np.float32) for r in found])
    return train(bounds, index, value, stats, np.array([r.label for r in found], np.float32), bits, **options)


def score(df: DataFrame, model: FactorMachine | None, text_col: str = "text", meta_cols: tuple[str, ...] = (), out: str = "score") -> DataFrame:
    """``df`` with the model's probability of label 1 for each text."""
    if model is None:
        return df.withColumn(out, F.lit(0.5))
    held = df.sparkSession.sparkContext.broadcast(model)
    names = [f"m{i}" for i in range(len(meta_cols))]

    @F.arrow_udf("double")
    def judge(texts: pa.Array, *meta: pa.Array) -> pa.Array:
        table = pa.RecordBatch.from_arrays([texts, *meta], ["text", *names])
        parts = [held.value.scores(*features(*column_bytes(b.column("text")), _meta(b, names), held.value.bits)) for b in slices(iter([table]), "text")]
        give_back()
        return pa.array(np.concatenate(parts) if parts else np.zeros(0), pa.float64())

    return df.withColumn(out, judge(F.col(text_col), *[F.col(c).cast("double") for c in meta_cols]))


def fold(id_: Column, of: int) -> Column:
    """crc32 of the id's text modulo ``of``; a null id counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(id_.cast("string"), F.lit("")).cast("binary")), F.lit(of))


def fit_on_labels(docs: DataFrame, labels: DataFrame, folds: int = 5, sample: int = 8000, id_col: str = "doc_id", **options) -> FactorMachine | None:
    """Learn ``labels.quality`` from rows outside fold 0.

    The sample is drawn from the labels alone, so only as many texts as it
    holds are looked up: its ids are a broadcast of ``sample`` rows at most.
    """
    usable = labels.filter(F.col("quality").isin(0, 1) & (fold(F.col(id_col), folds) != 0))
    share = min(1.0, 4 * sample / max(usable.count(), 1))  # enough rows that the sample is full, few enough to meet in one task
    chosen = (
        usable.select(F.col(id_col).alias("label_id"), F.col("quality").alias("label"), F.xxhash64(id_col).alias("order"))
        .filter(F.pmod("order", F.lit(1 << 30)) < share * (1 << 30))
        .orderBy("order", "label")
        .limit(sample)
    )
    joined = docs.select(F.col(id_col).alias("own_id"), "text", "n_chars").join(F.broadcast(chosen), F.col("own_id") == F.col("label_id"))
    return fit(joined, meta_cols=("n_chars",), sample=sample, **options)
