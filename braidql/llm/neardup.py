"""N-gram Jaccard join by an LSH forest.

Words are runs of non-space characters, A-Z in lower case; a text's set holds
the 64-bit hashes of its runs of five words.  Each of ``trees`` prefix tries
holds texts by a label of ``depth`` MinHash values (eight bits each, most
significant first), so that texts below one trie node share a prefix of the
label.  Matching starts at full depth, and matched prefixes are shortened level
by level until the recall is met.  The recall is estimated from the verified
links: how many of them only one trie has seen, and how many only two, tells how
many none has (the capture-recapture estimate of Chao); each text counts once
however many links it has.  A level also needs enough links for that, or it must
by itself see a link at the threshold with probability ``recall`` (six values do
so with 24 tries).  A shorter level verifies only groups that have grown.

Texts that are equal are one node throughout.  Nodes below a trie node are tied
to its least one only, connected components of those ties are cut into blocks
of bounded size, and a task verifies the pairs of one or two blocks exactly, by
counting shared shingles; it emits counts and a spanning tree, never pairs.  A
block of several is stored once, and tasks that verify two read both.  A
component of very many blocks may be one that chance ties hold together: its
trie nodes are verified first, each pair in the first trie that has it, and then
all pairs of each class of texts that the links found there connect.  So at
every size of a group, all pairs that share a trie node and all pairs of a class
are compared.

Defined results: a null text is an empty one; texts without words equal only
each other; one to four words are one shingle; rows that repeat an id or a text
are rows of their own; null ids are kept; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .storage import discard, keep, materialize, plain, read_whole, remove, scratch, write_atomically
from .textops import column_bytes, mix64, shingle_hashes, slices, word_hashes

SHINGLE = 5
BITS = 8
BLOCK_TEXTS = 256
BLOCK_SHINGLES = 1 << 20
MANY_BLOCKS = 64
PARTITION_BYTES = 256 << 20


def _sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """The shingle set of each text, ascending."""
    for batch in slices(iter([pa.RecordBatch.from_arrays([texts], ["text"])]), "text"):
        shingles, bounds = shingle_hashes(*word_hashes(*column_bytes(batch.column(0))), SHINGLE)
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            yield np.unique(shingles[a:b])


def _labeller(trees: int, depth: int):
    seeds = mix64(np.arange(1, 2 * trees * depth + 1, dtype=np.uint64))
    flip, scale = seeds[: trees * depth], seeds[trees * depth :] | np.uint64(1)
    shifts = np.array([BITS * (depth - 1 - i % depth) for i in range(trees * depth)], np.uint64)

    def label(shingles: np.ndarray) -> np.ndarray:
        least = np.full(trees * depth, ~np.uint64(0), np.uint64)
        for i in range(0, len(shingles), 512):
            part = shingles[i : i + 512, None] ^ flip
            part *= scale
            np.minimum(least, part.min(0), out=least)
        digits = (mix64(least) & np.uint64((1 << BITS) - 1)) << shifts
        return digits.reshape(trees, depth).sum(1, dtype=np.uint64).view(np.int64)

    return label


def _signatures(trees: int, depth: int):
    def signature(texts: pa.Array) -> pa.Array:
        label = _labeller(trees, depth)
        sizes, labels = [], []
        for shingles in _sets(texts):
            sizes.append(len(shingles))
            labels.append(label(shingles) if len(shingles) else None)
        return pa.StructArray.from_arrays([pa.array(sizes, pa.int32()), pa.array(labels, pa.list_(pa.int64()))], ["n", "labels"])

    return signature


def _signed(trees: int, depth: int):
    """Rows (doc_id, tid, text) with n and labels in place of the text."""
    signature = _signatures(trees, depth)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc_ids, tids, texts = batch.columns
            yield pa.RecordBatch.from_arrays([doc_ids, tids, *signature(texts).flatten()], ["doc_id", "tid", "n", "labels"])

    return run


def _rows_of(df: DataFrame, id_col: str, text: Column, trees: int, depth: int) -> DataFrame:
    """doc_id, tid, n, labels of each row; ids of types that Arrow may lack stay out of Python."""
    rows, own = df.select(F.col(id_col).alias("doc_id"), _tid(text).alias("tid"), text.alias("text")), "n int, labels array<bigint>"
    if plain(kind := rows.schema["doc_id"].dataType):
        return keep(rows, "lsh-rows", _signed(trees, depth), f"doc_id {kind.simpleString()}, tid string, {own}")
    sign = F.arrow_udf(_signatures(trees, depth), f"struct<{own}>")
    return materialize(rows.select("doc_id", "tid", sign("text").alias("sig")).select("doc_id", "tid", "sig.n", "sig.labels"), "lsh-rows")


def shared_counts(sets: list[np.ndarray], left: int | None = None) -> np.ndarray:
    """Matrix of the numbers of shingles that two sets share; of the first ``left`` sets with the others if given."""
    n = len(sets)
    out = np.zeros((n, n) if left is None else (left, n - left))
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    _, place, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    column = np.cumsum(times > 1) - 1
    keep = times[place] > 1
    owner, place = owner[keep], column[place[keep]]
    width = max(256, min(1 << 14, (1 << 22) // max(n, 1)))
    order = np.argsort(place, kind="stable")
    owner, place = owner[order], place[order]
    total = int(column[-1]) + 1 if len(column) else 0
    for start in range(0, total, width):
        a, b = np.searchsorted(place, [start, start + width])
        part = np.zeros((n, min(width, total - start)), np.float32)
        part[owner[a:b], place[a:b] - start] = 1
        out += part @ part.T if left is None else part[:left] @ part[left:].T
    return out


UNIT = "tid string, links long, root string, once long, twice long, unseen long"


@dataclass
class _Block:
    """Texts of one group: their ids and labels, and their shingles; ``tree`` if the group is a trie node."""

    tids: list[str]
    labels: np.ndarray
    sets: list[np.ndarray]
    tree: int | None

    def packed(self) -> pa.Buffer:
        columns = {"tid": pa.array(self.tids, pa.string()), "labels": pa.array(list(self.labels.view(np.int64)), pa.list_(pa.int64())), "shingles": pa.array([x.tobytes() for x in self.sets], pa.large_binary()), "tree": pa.array([self.tree] * len(self.tids), pa.int32())}
        rows, sink = pa.RecordBatch.from_pydict(columns), pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_batch(rows)
        return sink.getvalue()

    @classmethod
    def unpacked(cls, data: pa.Buffer) -> _Block:
        (rows,) = pa.ipc.open_stream(data)
        sets = [np.frombuffer(x.as_buffer(), np.uint64) if x.as_buffer().size else np.zeros(0, np.uint64) for x in rows.column("shingles")]
        return cls(rows.column("tid").to_pylist(), _label_rows(rows.column("labels")), sets, rows.column("tree")[0].as_py())


def _label_rows(labels: pa.Array) -> np.ndarray:
    return labels.flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(len(labels), -1)


def _links(one: _Block, other: _Block | None, threshold: float, depth: int, full: int) -> Iterator[tuple[str, int, str, int, int, int]]:
    """Links of one unit: all pairs of one block, or the pairs across two.

    ``once``, ``twice``, ``unseen``: links that one trie, two tries and no trie has at this depth.
    """
    tids, sets = one.tids + (other.tids if other else []), one.sets + (other.sets if other else [])
    if len(tids) < 2:
        return
    left = len(one.tids) if other else None
    size = np.array([len(s) for s in sets], float)
    both = shared_counts(sets, left)
    a, b = (size, size) if left is None else (size[:left], size[left:])
    union = a[:, None] + b[None, :] - both
    linked = (both >= (threshold - 1e-12) * union) & (union > 0)
    i, j = np.nonzero(np.triu(linked, 1) if left is None else linked)
    j = j + (left or 0)
    labels = (np.concatenate([one.labels, other.labels]) if other else one.labels) >> np.uint64(BITS * (full - depth))
    seen = np.zeros(len(i), np.int64)
    early = np.zeros(len(i), bool)
    for t in range(labels.shape[1]):
        same = labels[i, t] == labels[j, t]
        seen += same
        if one.tree is not None and t < one.tree:
            early |= same
    i, j, seen = i[~early], j[~early], seen[~early]  # a trie node's pairs: those that no earlier trie has
    parent = list(range(len(tids)))

    def find(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    for x, y in zip(i.tolist(), j.tolist(), strict=True):
        x, y = find(x), find(y)
        parent[max(x, y)] = min(x, y)
    count = lambda which: np.bincount(i[which], minlength=len(tids)) + np.bincount(j[which], minlength=len(tids))
    degree, *kinds = count(seen >= 0), count(seen == 1), count(seen == 2), count(seen == 0)
    for k in np.flatnonzero(degree).tolist():
        yield tids[k], int(degree[k]), tids[find(k)], *(int(x[k]) for x in kinds)


def _batches(found: Iterator[tuple], size: int = 10_000) -> Iterator[pa.RecordBatch]:
    """Rows of ``UNIT`` in batches."""
    kinds = {"string": pa.string(), "long": pa.int64()}
    fields = [f.split() for f in UNIT.split(", ")]
    while rows := list(islice(found, size)):
        yield pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*rows, strict=True), fields, strict=True)], [n for n, _ in fields])


def _blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, _Block]]:
    """(unit, blocks of its group, block) of rows that are sorted by unit."""
    held: list[tuple] = []

    def block() -> tuple[int, int, _Block]:
        tids, labels, sets, units, blocks, trees = zip(*sorted(held, key=lambda r: r[0]), strict=True)
        return units[0], blocks[0], _Block(list(tids), np.stack(labels), list(sets), trees[0])

    for batch in slices(batches, "text"):
        units, blocks, tids, trees = (batch.column(c).to_pylist() for c in ("unit", "blocks", "tid", "tree"))
        for row in zip(tids, _label_rows(batch.column("labels")), _sets(batch.column("text")), units, blocks, trees, strict=True):
            if held and held[0][3] != row[3]:
                yield block()
                held = []
            held.append(row)
    if held:
        yield block()


def _within(threshold: float, depth: int, full: int, folder: str):
    """Verifies each block by itself, and writes those whose group has more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for unit, blocks, block in _blocks_of(batches):
            if blocks > 1:
                write_atomically(_block_file(folder, unit), [block.packed()])
            yield from _links(block, None, threshold, depth, full)

    return lambda batches: _batches(run(batches))


def _across(threshold: float, depth: int, full: int, folder: str):
    """Verifies pairs of blocks, read from their files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        at, one = None, None
        for batch in batches:
            for a, b in zip(batch.column("unit").to_pylist(), batch.column("other").to_pylist(), strict=True):
                if a != at:
                    at, one = a, _Block.unpacked(read_whole(_block_file(folder, a)))
                yield from _links(one, _Block.unpacked(read_whole(_block_file(folder, b))), threshold, depth, full)

    return lambda batches: _batches(run(batches))


def _block_file(folder: str, unit: int) -> str:
    return f"{folder}/{unit & 0xFF:02x}/{unit & (1 << 64) - 1:016x}"


def _likely(rows: DataFrame, hashed: Column, wanted: DataFrame) -> DataFrame:
    """``rows`` whose ``hashed`` may be among the column ``hash`` of ``wanted``: by a map of 2^24 bits, so that few others are shuffled by the join that follows."""
    word, bit = "pmod(hash, 1 << 18)", "shiftleft(1L, shiftrightunsigned(hash, 58)::int)"
    bits = wanted.select(F.expr(word).alias("word"), F.expr(bit).alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    own = rows.withColumn("hash", hashed).withColumn("word", F.expr(word))
    return own.join(F.broadcast(bits), "word").filter(F.expr(f"(bits & {bit}) != 0")).drop("hash", "word", "bits")


def _nodes_of(texts: DataFrame, depth: int, full: int) -> DataFrame:
    """(node, tree, tid, least) of the trie nodes at ``depth`` that hold two texts or more."""
    labelled = texts.filter("labels is not null")
    node = F.xxhash64("tree", F.shiftrightunsigned("label", BITS * (full - depth))).alias("node")
    counts = labelled.select(F.posexplode("labels").alias("tree", "label")).select(node).groupBy("node").agg(F.count(F.lit(1)).alias("members"))
    shared = keep(counts.filter("members > 1").select("node"), "lsh-shared")
    rows = labelled.select("tid", F.posexplode("labels").alias("tree", "label")).select("tid", "tree", node)
    held = _likely(rows, F.col("node"), shared.select(F.col("node").alias("hash"))).join(shared, "node", "left_semi")
    held = keep(held, "lsh-held")
    found = keep(held.join(held.groupBy("node").agg(F.min("tid").alias("least")), "node"), "lsh-nodes")
    discard(texts.sparkSession, shared, held)
    return found


def _dealt(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` (tid, n, tree, texts, shingles, key) with the block of each.

    ``unit`` tells blocks apart; ``place`` numbers those of a group one after another, so that they are dealt evenly.
    """
    blocks = F.greatest(F.ceil(F.col("texts") / BLOCK_TEXTS), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    own = F.pmod(F.xxhash64("tid"), F.col("blocks")).cast("int")
    return rows.withColumn("blocks", blocks).withColumn("own", own).select("tid", "n", "tree", "blocks", "own", F.xxhash64(key).alias("group"), F.xxhash64(key, "own", "blocks").alias("unit"))


def _sized(members: DataFrame, key: str) -> DataFrame:
    """``members`` (tid, n, key, ...) with texts and shingles of their group."""
    groups = keep(members.groupBy(F.col(key).alias("of")).agg(F.count(F.lit(1)).alias("texts"), F.sum("n").alias("shingles")), "lsh-sizes")
    return members.join(groups, F.col(key) == F.col("of")).drop("of")


@dataclass
class _Level:
    """What one length of the prefixes has: groups, and the links of all texts."""

    groups: DataFrame
    found: DataFrame

    def recall(self) -> tuple[float, float]:
        """(estimate, cautious estimate) of the share of links that were found; texts weigh alike."""
        own = self.found.groupBy("tid").agg(*[F.sum(c).alias(c) for c in ("links", "once", "twice", "unseen")])
        share = lambda c: F.coalesce(F.sum(F.col(c) / F.col("links")) / 2, F.lit(0.0))
        n, once, twice, unseen = own.agg(F.count(F.lit(1)) / 2, share("once"), share("twice"), share("unseen")).first()
        missed = lambda slack: max(0.0, (once + slack) ** 2 / (2 * (twice + 1)) - unseen)
        return (n / (n + missed(0)), n / (n + missed(3))) if n else (1.0, 0.0)


def find_links(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, trees: int = 24, depth: int = 8, recall: float = 0.999) -> tuple[DataFrame, DataFrame]:
    """(rows, linked) of a corpus.

    ``rows``: doc_id, tid of each row (tid: MD5 of its text).  ``linked``:
    tid, root, links of every text that is similar to a different one.  Rows
    are told apart by id and text alone, never by their place in a scan.
    """
    spark = df.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = _rows_of(df, id_col, text, trees, depth)
    texts = keep(rows.groupBy("tid").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("labels").alias("labels")), "lsh-texts")
    once = not _repeats(rows)
    level = None
    for at in range(depth, 0, -1):
        new = _match(lambda wanted: _texts_of(df, id_col, text_col, wanted, once), texts, at, depth, threshold, level)
        if level:
            discard(spark, level.groups, *([] if new.found is level.found else [level.found]))
        level = new
        estimate, cautious = level.recall()
        if estimate >= recall and max(cautious, 1 - (1 - threshold**at) ** trees) >= recall:
            break
    found = level.found
    tied = components(found.select(F.col("tid").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("tid").agg(F.sum("links").cast("long").alias("links"))
    linked = keep(links.join(tied, F.col("tid") == F.col("node")).select("tid", "root", "links"), "lsh-linked")
    discard(spark, texts, level.groups, found)
    return rows.select("doc_id", "tid"), linked


def _match(texts_of, texts: DataFrame, at: int, depth: int, threshold: float, before: _Level | None) -> _Level:
    """Links of the groups at prefixes of ``at`` values; those of groups that have not grown since ``before`` are kept."""
    spark = texts.sparkSession
    nodes = _nodes_of(texts, at, depth)
    roots = components(nodes.select(F.col("least").alias("a"), F.col("tid").alias("b")))
    sized = keep(roots.join(texts.select(F.col("tid").alias("node"), "n"), "node").select(F.col("node").alias("tid"), "root", "n"), "lsh-roots")
    groups = keep(sized.groupBy("root").agg(F.count(F.lit(1)).alias("texts"), F.sum("n").alias("shingles")), "lsh-groups")
    # A group only ever grows, and its root is its least text: of equal root and number, it is the same.
    grown = groups.join(before.groups.select("root", "texts"), ["root", "texts"], "left_anti") if before else groups
    members = keep(sized.join(grown, "root").withColumn("tree", F.lit(None).cast("int")), "lsh-members")
    if before and members.isEmpty():
        discard(spark, nodes, sized, members)
        return _Level(groups, before.found)
    verify = lambda rows, key: _verify(texts_of, texts, _dealt(rows, key), threshold, at, depth)
    small = (F.col("texts") <= MANY_BLOCKS * BLOCK_TEXTS) & (F.col("shingles") <= MANY_BLOCKS * BLOCK_SHINGLES)
    parts = verify(members.filter(small), "root")
    large = members.filter(~small).select("tid", "n")
    if not large.isEmpty():
        inside = keep(_sized(nodes.join(large, "tid").select("node", "tree", "tid", "n"), "node"), "lsh-inside")
        # A text is in nodes of up to all tries: so many at a time that their blocks stay within twice the large groups' own size.
        rounds = -(-inside.agg(F.sum("n")).first()[0] // (2 * large.agg(F.sum("n")).first()[0]))
        first = [f for r in range(rounds) for f in verify(inside.filter(F.col("tree") % rounds == r), "node")]
        classes = components(reduce(DataFrame.union, first).select(F.col("tid").alias("a"), F.col("root").alias("b")))
        whole = classes.join(large, F.col("node") == F.col("tid")).select("tid", "root", "n", F.lit(None).cast("int").alias("tree"))
        parts += verify(keep(_sized(whole, "root"), "lsh-classes"), "root")
        discard(spark, inside, *first)
    if before:
        kept = before.found.join(members.select("tid"), "tid", "left_anti")
        found = keep(reduce(DataFrame.union, [*parts, kept]), "lsh-found")
    else:
        found = keep(reduce(DataFrame.union, parts), "lsh-found") if len(parts) > 1 else parts[0]
    discard(spark, nodes, sized, members, *(p for p in parts if p is not found))
    return _Level(groups, found)


def _tid(text: Column) -> Column:
    return F.md5(text.cast("binary"))


def _repeats(rows: DataFrame) -> bool:
    """Whether rows agree in both id and text."""
    return not rows.groupBy("tid", "doc_id").count().filter("count > 1").isEmpty()


def _texts_of(df: DataFrame, id_col: str, text_col: str, wanted: DataFrame, once: bool) -> DataFrame:
    """``wanted`` (tid, doc_id, unit, ...) with the texts, each from its row of least id: copies of a hot text have other ids."""
    keyed = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("key", _tid(F.col("text")))
    likely = _likely(keyed, F.xxhash64("key"), wanted.select(F.xxhash64("tid").alias("hash")))
    rows = likely.join(wanted, (F.col("key") == F.col("tid")) & F.col("id").eqNullSafe(F.col("doc_id"))).drop("key", "id", "doc_id")
    return rows if once else rows.dropDuplicates(["tid", "unit"])


def _verify(texts_of, texts: DataFrame, dealt: DataFrame, threshold: float, at: int, depth: int) -> list[DataFrame]:
    """Frames with rows of ``UNIT``: exact links within the groups of ``dealt``.

    Each text goes to the task that has its block, which verifies it.  Blocks
    of groups of several are kept as files, and pairs of them name these files,
    so that no text is copied for every other block.
    """
    spark = dealt.sparkSession
    folder = scratch(spark, "lsh-blocks")
    shingles = dealt.agg(F.sum("n")).first()[0] or 0
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-8 * shingles // PARTITION_BYTES))
    begin = F.pmod(F.col("group"), F.lit(1 << 30))
    rows = texts_of(dealt.join(texts.select("tid", "doc_id", "labels"), "tid").drop("n"))
    rows = rows.select("tid", "unit", "blocks", "tree", "labels", "text", F.pmod(begin + F.col("own"), F.lit(n)).cast("int").alias("place"))
    rows = rows.repartitionById(n, F.col("place")).drop("place").sortWithinPartitions("unit")
    found = [keep(rows, "lsh-found", _within(threshold, at, depth, folder), UNIT)]
    blocks = dealt.filter("blocks > 1").select("group", "blocks", "own", "unit").distinct()
    if not blocks.isEmpty():
        others = blocks.select("group", F.col("own").alias("high"), F.col("unit").alias("other"))
        low = F.col("own").cast("long")
        number = low * F.col("blocks") - F.floor(low * (low + 1) / 2) + F.col("high") - low
        pairs = blocks.join(others, "group").filter("own < high").select("unit", "other", F.pmod(begin + number, F.lit(n)).cast("int").alias("place"))
        pairs = pairs.repartitionById(n, F.col("place")).drop("place").sortWithinPartitions("unit", "other")
        found.append(keep(pairs, "lsh-found", _across(threshold, at, depth, folder), UNIT))
        remove(spark, folder)
    return found


def near_duplicates(df: DataFrame, **options) -> DataFrame:
    """One row a document: doc_id, class_id, links, copies.

    ``class_id``: the least id of all documents that chains of links or equal
    texts connect; ``links``: how many different texts are similar to this one;
    ``copies``: rows with this text.
    """
    rows, linked = find_links(df, **options)
    texts = rows.groupBy("tid").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies"))
    full = texts.join(linked, "tid", "left").withColumn("root", F.coalesce("root", "tid"))
    classes = full.groupBy("root").agg(F.min("least").alias("class_id"))
    info = keep(full.join(classes, "root").select("tid", "class_id", F.coalesce("links", F.lit(0)).alias("links"), "copies"), "lsh-info")
    return rows.join(info, "tid").select("doc_id", "class_id", "links", "copies")


def drop_near_duplicates(df: DataFrame, **options) -> DataFrame:
    """``df``, all columns, with one row of each class: that of the least id."""
    id_col, text_col = options.get("id_col", "doc_id"), options.get("text_col", "text")
    rows, linked = find_links(df, **options)
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "tid")
    tagged = rows.join(linked.select("tid", "root"), "tid", "left").withColumn("root", F.coalesce("root", "tid"))
    kept = keep(tagged.groupBy("root").agg(F.min(order).alias("o")).select(F.col("o.doc_id").alias("kept_id"), F.col("o.tid").alias("kept_tid")), "lsh-kept")
    key = "__neardup_tid"
    keyed = df.withColumn(key, _tid(F.coalesce(F.col(text_col), F.lit(""))))
    out = keyed.join(kept, (F.col(key) == F.col("kept_tid")) & F.col(id_col).eqNullSafe(F.col("kept_id")), "left_semi")
    return (out.dropDuplicates([key]) if _repeats(rows) else out).drop(key)
