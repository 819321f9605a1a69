"""Language-model scores of whole documents.

Counts of every word of the training documents are summed over the whole
corpus.  The ``frequent`` most frequent words (and the end of a text) form
classes of ``width`` words; other words fall into classes by their first bytes.
A gated recurrent network (``recurrent``) predicts class and frequent word; a
word elsewhere has its smoothed share of its class.

Training starts on a bounded sample (the ``warm`` training texts of smallest
hash, some epochs in one task) and then is data-parallel: in each of ``rounds`` rounds every partition trains
a copy of the weights on its own documents of the round (one in ``every`` by
hash of the text, another part each round; ``every`` is ``rounds`` unless given,
so that the rounds together learn from each training text once), and the copies
are averaged in a tree, weighted by their tokens.  Nothing that grows with the
corpus reaches the driver.

The counts of the most frequent words, at most ``table`` of them, are broadcast
(whole levels of frequency that a histogram admits, so nothing is sorted); other
words of a text leave as 64-bit hashes and meet their counts in a join.

Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z in lower case, told apart by 64-bit
hashes of their bytes.

Defined results: a null or empty text is one end token; a null id hashes as the
empty string; repeated rows are scored each; with no training documents counts
are 0 and every word unknown; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import recurrent
from .storage import materialize
from .textops import LOWER, SPACES, HashTable, column_bytes, mix64, slices, span_hashes, word_spans

END = int(mix64(np.array([0xE0D], np.uint64)).view(np.int64)[0])
REST_CLASSES = 28
FLUSH = 1 << 20


def fold(id_: Column, of: int) -> Column:
    """crc32 of the id's text modulo ``of``; a null id counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(id_.cast("string"), F.lit("")).cast("binary")), F.lit(of))


def tokenize(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each token, its first three bytes, bounds of texts); each text ends with END, of no bytes."""
    raw, bounds = column_bytes(texts)
    starts, ends = word_spans(raw, bounds, SPACES)
    words = span_hashes(raw, starts, ends, LOWER).view(np.int64)
    padded = np.append(raw, np.zeros(2, np.uint8))
    wide = ends - starts
    lead = LOWER[padded[starts]].astype(np.int32) << 16
    lead |= np.where(wide > 1, LOWER[padded[starts + 1]], 0).astype(np.int32) << 8
    lead |= np.where(wide > 2, LOWER[padded[starts + 2]], 0)
    cuts = np.searchsorted(starts, bounds)
    n = len(bounds) - 1
    hashes = np.full(len(words) + n, END, np.int64)
    leads = np.zeros(len(words) + n, np.int32)
    place = np.arange(len(words)) + np.repeat(np.arange(n), np.diff(cuts))
    hashes[place], leads[place] = words, lead
    return hashes, leads, cuts + np.arange(n + 1)


def rest_class(leads: np.ndarray) -> np.ndarray:
    """Class of each word that is not frequent, by its first bytes."""
    return (mix64(leads) % np.uint64(REST_CLASSES)).astype(np.int32)


COUNTS = "word long, rest int, c long"


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words, rest, times = np.zeros(0, np.int64), np.zeros(0, np.int16), np.zeros(0, np.int64)

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(words), pa.array(rest.astype(np.int32)), pa.array(times)], ["word", "rest", "c"])

    for part in slices(batches, "text"):
        found, leads, _ = tokenize(part.column("text"))
        distinct, first, counts = np.unique(found, return_index=True, return_counts=True)
        merged, back = np.unique(np.concatenate([words, distinct]), return_inverse=True)
        total = np.bincount(back, np.concatenate([times, counts]), len(merged)).astype(np.int64)
        kinds = np.zeros(len(merged), np.int16)
        kinds[back] = np.concatenate([rest, rest_class(leads[first])])
        words, rest, times = merged, kinds, total
        if len(words) > FLUSH:
            yield batch()
            words, rest, times = words[:0], rest[:0], times[:0]
    if len(words):
        yield batch()


@dataclass
class Vocabulary:
    """Broadcast part of the counts, and how words map to classes."""

    words: np.ndarray  # hashes of the table's words
    counts: np.ndarray
    slot: np.ndarray  # (int32) place of each among the frequent words, or -1
    width: int
    groups: int
    total: int
    distinct: int
    texts: int
    rest_log: np.ndarray  # log10 of the smoothed mass of each class of other words

    def look_up(self, hashes: np.ndarray, leads: np.ndarray):
        """(count or -1 if not in the table, input symbol, class, word in class)."""
        at = self._table.find(hashes)
        count = np.where(at >= 0, self.counts[at], -1)
        slot = np.where(at >= 0, self.slot[at], -1)
        elsewhere = np.flatnonzero(slot < 0)
        rest = rest_class(leads[elsewhere])
        symbol, classes, word = slot, slot // self.width, slot % self.width
        symbol[elsewhere], classes[elsewhere], word[elsewhere] = self.groups * self.width + rest, self.groups + rest, 0
        return count, symbol, classes, word

    @cached_property
    def _table(self) -> HashTable:
        return HashTable(self.words)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_table"}

    @property
    def start_symbol(self) -> int:
        return self.groups * self.width + REST_CLASSES


def count_words(training: DataFrame, text_col: str = "text") -> DataFrame:
    """word, rest, c over all texts."""
    found = training.select(F.col(text_col).alias("text")).mapInArrow(_count, COUNTS)
    return materialize(found.groupBy("word", "rest").agg(F.sum("c").cast("long").alias("c")), "lm-counts")


def build_vocabulary(counts: DataFrame, frequent: int, width: int, table: int) -> tuple[Vocabulary, np.ndarray, np.ndarray]:
    """(vocabulary, shares of the classes, shares of the words in each class)."""
    level = F.floor(F.log2(F.col("c")) * 8)
    levels, above = [], 0
    for r in sorted(counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n")).collect(), reverse=True):
        above += r.n
        if above > table:
            break
        levels.append(r.level)
    top = counts.filter(level >= (min(levels) if levels else 1 << 20)).toArrow().sort_by([("c", "descending"), ("word", "ascending")])
    words, c, rest = (top.column(k).to_numpy() for k in ("word", "c", "rest"))
    totals = counts.groupBy("rest").agg(F.sum("c").cast("long").alias("c"), F.count(F.lit(1)).alias("n")).collect()
    total, distinct = sum(r.c for r in totals), sum(r.n for r in totals)
    groups = frequent // width
    order = np.lexsort((words, -c))
    chosen = order[: groups * width]
    if END not in words[chosen]:
        end = np.flatnonzero(words == END)
        if not len(end):
            found = counts.filter(F.col("word") == END).agg(F.sum("c")).first()[0]
            words, c, rest = np.append(words, END), np.append(c, found or 0), np.append(rest, 0)
            end = np.array([len(words) - 1])
        chosen = np.append(chosen[: groups * width - 1], end)
    slot = np.full(len(words), -1, np.int32)
    slot[chosen] = np.arange(len(chosen))
    mass, kinds = np.full(REST_CLASSES, 0.1), np.zeros(REST_CLASSES)
    for r in totals:
        mass[r.rest] += r.c + 0.1 * r.n
    np.subtract.at(mass, rest[chosen], np.where(c[chosen] > 0, c[chosen] + 0.1, 0))
    mass = np.maximum(mass, 0.1)
    own = np.full(groups * width, 1e-3)
    own[: len(chosen)] = c[chosen] + 0.1
    own = own.reshape(groups, width)
    shares = np.concatenate([own.sum(1), mass])
    texts = int(c[words == END][0])
    vocabulary = Vocabulary(words, c, slot, width, groups, total, distinct, texts, np.log10(mass))
    return vocabulary, shares / shares.sum(), own / own.sum(1, keepdims=True)


WEIGHTS = "tokens double, weights binary"


def _trainer(net, vocabulary, epochs: int, options: dict):
    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, learned = net.value.load(net.value.flat()), 0
        parts = slices(batches, "text", 4 << 20)
        for part in list(parts) * epochs if epochs > 1 else parts:
            hashes, leads, bounds = tokenize(part.column("text"))
            _, symbol, classes, words = vocabulary.value.look_up(hashes, leads)
            learned += recurrent.train(own, symbol, classes, words, bounds, vocabulary.value.start_symbol, **options)
        if learned:
            yield pa.RecordBatch.from_pydict({"tokens": [float(learned)], "weights": [own.flat().tobytes()]})

    return fit


def _average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, tokens = None, 0.0
    for batch in batches:
        for row in batch.to_pylist():
            part = np.frombuffer(row["weights"], np.float32).astype(np.float64) * row["tokens"]
            total = part if total is None else total + part
            tokens += row["tokens"]
    if total is not None:
        yield pa.RecordBatch.from_pydict({"tokens": [tokens], "weights": [(total / tokens).astype(np.float32).tobytes()]})


def tree_average(copies: DataFrame, fan: int = 8) -> np.ndarray | None:
    """Token-weighted mean of weight vectors; at most ``fan`` of them reach the driver."""
    n = copies.count()
    while n > fan:
        n = -(-n // fan)
        copies = materialize(copies.repartition(n).mapInArrow(_average, WEIGHTS), "lm-weights")
    rows = copies.collect()
    if not rows:
        return None
    weight = np.array([r.tokens for r in rows])
    return sum(np.frombuffer(r.weights, np.float32) * w for r, w in zip(rows, weight / weight.sum(), strict=True))


def train(training: DataFrame, vocabulary: Vocabulary, class_share, word_share, text_col: str = "text", hidden: int = 16, rounds: int = 3, every: int | None = None, warm: int = 512, warm_epochs: int = 3, **options) -> recurrent.GatedNet:
    """The averaged network after the warm start and ``rounds`` rounds."""
    sc = training.sparkSession.sparkContext
    held = sc.broadcast(vocabulary)
    net = recurrent.GatedNet.create(vocabulary.start_symbol + 1, hidden, class_share, word_share)
    hashed = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    every = every or max(rounds, 1)
    part = F.pmod(hashed, F.lit(every))
    for k in range(-1, rounds):
        if k < 0:
            some = F.pmod(hashed, F.lit(1 << 30)) < min(1.0, 4 * warm / max(vocabulary.texts, 1)) * (1 << 30)
            own = training.filter(some).select(F.col(text_col).alias("text"), hashed.alias("hash")).orderBy("hash").limit(warm).coalesce(1).select("text")
            trainer = _trainer(sc.broadcast(net), held, warm_epochs, {"texts": 16, "rate": 0.01} | options)
        else:
            own = training.filter(part == k % every).select(F.col(text_col).alias("text"))
            trainer = _trainer(sc.broadcast(net), held, 1, {"rate": 0.005} | options)
        copies = materialize(own.mapInArrow(trainer, WEIGHTS), "lm-weights")
        mean = tree_average(copies)
        if mean is None:
            continue
        net = net.load(mean)
    return net


SCORED = "doc_id long, n_tokens long, known long, base double, score double, others array<long>"


def _scorer(net, vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary.value
        norm = np.log10(v.total + 0.1 * (v.distinct + 1))
        for part in slices(batches, "text", 6 << 20):
            hashes, leads, bounds = tokenize(part.column("text"))
            count, symbol, classes, words = v.look_up(hashes, leads)
            found = recurrent.score(net.value, symbol, classes, words, bounds, v.start_symbol) / np.log(10)
            inside = count >= 0
            seen = np.where(inside, np.log10(np.maximum(count, 0) + 0.1), 0.0)
            elsewhere = classes >= v.groups
            share = np.where(elsewhere, seen - v.rest_log[np.maximum(classes - v.groups, 0)], 0.0)
            sums = lambda x: np.add.reduceat(x, bounds[:-1])  # noqa: E731  a text has one token at least
            n = np.diff(bounds)
            out = np.concatenate([[0], np.cumsum(~inside)])[bounds]
            others = pa.ListArray.from_arrays(pa.array(out.astype(np.int32)), pa.array(hashes[~inside]))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(n), pa.array(sums((count > 0).astype(np.int64))), pa.array(sums(seen) - n * norm), pa.array(found + sums(share)), others],
                ["doc_id", "n_tokens", "known", "base", "score", "others"],
            )

    return run


def score_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 10, frequent: int = 2048, width: int = 64, table: int = 1 << 17, **options) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row."""
    training = df.filter(fold(F.col(id_col), folds) != 0)
    counts = count_words(training, text_col)
    vocabulary, class_share, word_share = build_vocabulary(counts, frequent, width, table)
    net = train(training, vocabulary, class_share, word_share, text_col, **options)
    sc = df.sparkSession.sparkContext
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    scored = materialize(rows.mapInArrow(_scorer(sc.broadcast(net), sc.broadcast(vocabulary)), SCORED).withColumn("row", F.monotonically_increasing_id()), "lm-scored")
    other = scored.select("row", F.explode("others").alias("other"))
    tally = (
        other.join(counts.select("word", "c"), F.col("other") == F.col("word"), "left")
        .groupBy(F.col("row").alias("of"))
        .agg(F.sum(F.log10(F.coalesce(F.col("c"), F.lit(0)) + F.lit(0.1).cast("double"))).alias("logs"), F.count("c").alias("more"))
    )
    logs = F.coalesce("logs", F.lit(0.0))
    return scored.join(tally, F.col("row") == F.col("of"), "left").select(
        "doc_id",
        (fold(F.col("doc_id"), folds) == 0).alias("held_out"),
        "n_tokens",
        (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(vocabulary.total).cast("long").alias("train_tokens"),
        (F.col("base") + logs).alias("base_score"),
        (F.col("score") + logs).alias("score"),
    )
