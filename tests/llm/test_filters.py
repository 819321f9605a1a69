"""Decontamination, mixing, quality and the pipeline."""

import collections
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from braidql.llm import decontaminate, mixing, quality
from braidql.llm.queries import ORACLE, QUERIES
from braidql.llm.storage import materialize
from braidql.llm.textops import NON_ALNUM, column_bytes, mix64, word_hashes

from .conftest import prose
from .test_neardup import brute as near_copies

# ---- decontamination


def words(text):
    return re.findall(r"(?:[A-Za-z0-9]|[^\x00-\x7f])+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def contaminated(rows, items, threshold=0.8):
    """Pairs by sliding a window of each item's size over each text."""
    sets = {}
    for i, t in items:
        w = words(t)
        if w:
            sets[i] = (len(w), {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))})
    out = collections.Counter()
    for d, t in rows:
        w = words(t)
        own = [tuple(w[k : k + 5]) for k in range(max(1 if w else 0, len(w) - 4))]
        for i, (n, s) in sets.items():
            if s & set(own) and any(len(s & set(x)) / len(s | set(x)) >= threshold for k in range(len(own)) if (x := own[k : k + max(1, n - 4)])):
                out[d, i] += 1
    return out


def test_fingerprints_equal_counting():
    w = np.random.default_rng(0).integers(0, 2**63, 90).astype(np.uint64)
    bits = ((mix64(w)[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)).astype(int)
    for size, prints in decontaminate.fingerprints(w, [1, 2, 3, 6, 8, 12, 24, 48, 64, 200]):
        for i, p in enumerate(prints):
            assert int(p) == sum(1 << k for k in range(64) if 2 * bits[i : i + size, k].sum() > size)


def test_blocks_find_every_print_within_the_radius():
    rng = np.random.default_rng(1)
    prints = rng.integers(0, 2**63, 300).astype(np.uint64)
    near = prints.copy()
    for i in range(300):
        for b in rng.choice(64, i % 6, replace=False):
            near[i] ^= np.uint64(1) << np.uint64(b)
    blocks = [(0, 16), (16, 16), (32, 16), (48, 16)]
    index = decontaminate.SizeIndex(prints, np.arange(300), np.zeros(300, int), blocks)
    at, of, _ = index.search(near, 3)
    far = np.bitwise_count(near[:, None] ^ prints[None, :])
    assert set(zip(at.tolist(), of.tolist(), strict=True)) == set(zip(*map(list, np.nonzero(far <= 3)), strict=True))


def test_decontaminate_query(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert {(r.doc_id, r.item_id) for r in QUERIES["op8_decontaminate"](spark, sf).collect()} == set(contaminated(rows, items))


def test_edited_passages_are_found(spark):
    item = prose(70, 55).split()
    made = {"exact": item, "inside": item[:27] + ["new"] + item[28:], "start": ["new", *item[1:]], "cut": item[2:], "added": [*item[:50], "x", *item[50:]], "half": item[:25], "other": prose(71, 55).split()}
    rows = [(i, prose(80 + i, 40) + " " + " ".join(w).upper() + ", " + prose(90 + i, 40)) for i, w in enumerate(made.values())]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(1, " ".join(item)), (2, None), (3, ""), (4, "tiny one"), (1, " ".join(item))], "item_id long, text string")
    found = {r.doc_id for r in decontaminate.contaminated(docs, items).collect()}
    assert found == {d for d, _ in contaminated(rows, [(1, " ".join(item))])} == {0, 1, 2, 3, 4}
    kept = decontaminate.drop_contaminated(docs, items, block_bytes=300).collect()
    assert [r.doc_id for r in sorted(kept)] == [5, 6]


def test_long_items_with_a_replaced_middle_are_found():
    rng = np.random.default_rng(5)
    for n in (60, 100, 200, 400, 800):
        most = (n - 4) // 9 - 4  # words replaced in one run at Jaccard 0.8
        for trial in range(12):
            item = [f"w{k}" for k in rng.integers(0, 10**9, n)]
            r = max(1, most - trial % 3)
            at = int(rng.integers(n // 3, n // 2))
            doc = [f"d{k}" for k in range(90)] + item[:at] + [f"x{k}" for k in range(r)] + item[at + r :] + [f"e{k}" for k in range(90)]
            rows, items = [(0, " ".join(doc))], [(7, " ".join(item))]
            index = decontaminate.BenchmarkIndex([7], [items[0][1]])
            hashes, cuts = word_hashes(*column_bytes(pa.array([rows[0][1]])), NON_ALNUM)
            found = {(t, 7) for t, *_ in index.search(hashes, cuts, 0.8)}
            assert found == set(contaminated(rows, items)), (n, r)


def test_decontaminate_edges(spark, docs, none):
    items = spark.createDataFrame([(5, prose(1, 80)), (6, "two words"), (None, "x")], "item_id long, text string")
    want = set(contaminated([(r.doc_id, r.text) for r in docs.collect()], [(5, prose(1, 80)), (6, "two words")]))
    assert {(0, 5), (1, 5), (2, 5), (6, 6)} <= want
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, items).collect()} == want
    assert decontaminate.contaminated(none, items).count() == 0
    assert decontaminate.contaminated(docs, items.limit(0)).count() == 0
    kept = decontaminate.drop_contaminated(docs, items)
    assert kept.columns == docs.columns and kept.count() == docs.count() - len({d for d, _ in want})


def test_items_of_null_id_are_found(spark, docs):
    items = spark.createDataFrame([(None, prose(1, 80)), (6, "two words")], "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, items).collect()}
    want = set(contaminated([(r.doc_id, r.text) for r in docs.collect()], [(None, prose(1, 80)), (6, "two words")]))
    assert {(0, None), (1, None), (2, None), (6, 6)} <= want and found == want
    assert not {0, 1, 2, 6} & {r.doc_id for r in decontaminate.drop_contaminated(docs, items).collect()}


def test_similarity_does_not_depend_on_blocks(spark):
    """Weights are those of the whole benchmark, however its items are dealt into blocks."""
    common = prose(60, 14).split()
    items = spark.createDataFrame([(i, " ".join([*common, *prose(200 + i, 40).split()])) for i in range(12)], "item_id long, text string")
    docs = spark.createDataFrame([(i, prose(300 + i, 30) + " " + " ".join([*common, *prose(200 + i, 40).split()][k:])) for i in range(12) for k in (0, 2, 4)], "doc_id long, text string")
    whole = sorted((r.doc_id, r.item_id, round(r.similarity, 12)) for r in decontaminate.contaminated(docs, items).collect())
    assert len({d for d, *_ in whole}) == 12 and len({s for *_, s in whole}) > 2
    for size in (400, 1500):
        assert sorted((r.doc_id, r.item_id, round(r.similarity, 12)) for r in decontaminate.contaminated(docs, items, block_bytes=size).collect()) == whole


def test_recall_on_edited_items():
    """Items of 20 to 400 words with random edits that leave them similar: as many are found as by comparing all passages."""
    rng = np.random.default_rng(9)
    found = wanted = 0
    for n in (20, 40, 80, 130, 200, 300, 400):
        for _ in range(12):
            item = [f"w{k}" for k in rng.integers(0, 10**9, n)]
            own = list(item)
            for _ in range(int(rng.integers(1, max(2, n // 45 + 1)))):
                own[int(rng.integers(0, len(own)))] = f"x{rng.integers(0, 10**9)}"
            rows = [(0, " ".join([f"d{k}" for k in range(60)] + own + [f"e{k}" for k in range(60)]))]
            index = decontaminate.BenchmarkIndex([7], [" ".join(item)])
            hashes, cuts = word_hashes(*column_bytes(pa.array([rows[0][1]])), NON_ALNUM)
            want = set(contaminated(rows, [(7, " ".join(item))]))
            wanted += len(want)
            found += len(want & {(t, 7) for t, *_ in index.search(hashes, cuts, 0.8)})
    assert wanted > 50 and found == wanted


# ---- mixing


def test_mix_query(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = con.execute(f"SELECT doc_id, size, source_size, round(target, 6), taken FROM ({ORACLE['op9_mix_sources']})").fetchall()
    got = [(r.doc_id, r.size, r.source_size, round(r.target, 6), r.taken) for r in QUERIES["op9_mix_sources"](spark, sf).collect()]
    assert sorted(got) == sorted(want)


def water(sizes, weights, cap=3):
    """Targets by sharing out the excess again and again."""
    total, fixed, free = sum(sizes), {}, set(range(len(sizes)))
    while True:
        rest, w = total - sum(fixed.values()), sum(weights[i] for i in free)
        over = [i for i in free if rest * weights[i] / w > cap * sizes[i] + 1e-9] if w else []
        if not over:
            return [fixed.get(i, rest * weights[i] / w if w else 0) for i in range(len(sizes))]
        for i in over:
            fixed[i] = cap * sizes[i]
            free.discard(i)


def test_mix_edges(docs, none):
    rows = mixing.mix(docs).collect()
    assert len(rows) == docs.count() and mixing.mix(none).count() == 0
    sizes = collections.OrderedDict()
    for r in sorted(rows, key=lambda r: (r.source is None, (r.source or "").encode())):
        sizes[r.source] = r.source_size
    want = dict(zip(sizes, water(list(sizes.values()), [[5, 2, 1][i % 3] for i in range(len(sizes))]), strict=True))
    for r in rows:
        assert r.target == pytest.approx(want[r.source]) and r.taken <= 3 * r.size and r.taken == r.size * r.copies
    assert list(sizes)[-1] is None and sizes["b"] == 80
    again = mixing.apply_mix(docs)
    assert again.columns == docs.columns
    assert again.count() == sum(r.copies for r in rows)
    assert mixing.apply_mix(none).count() == 0


def test_mix_comes_near_its_targets(spark):
    rows = [(i, "w " * (i % 50 + 1), "abcd"[i % 7 % 4]) for i in range(4000)]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("want")).collect()
    assert all(abs(r.t - r.want) <= 50 for r in out)


def test_mix_is_native(spark, sf):
    df = QUERIES["op9_mix_sources"](spark, sf)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


# ---- quality


def test_sum_of_squares_identity():
    rng = np.random.default_rng(0)
    model = quality.FactorMachine(4, 0.3, rng.standard_normal(18).astype(np.float32), rng.standard_normal((18, 3)).astype(np.float32), np.zeros(2), np.ones(2))
    bounds, index, value = np.array([0, 3, 3]), np.array([1, 5, 9]), np.array([0.5, 1.0, 2.0], np.float32)
    stats = np.array([[0.2, -1.0], [1.0, 0.0]])
    got = model.logits(bounds, index, value, stats)
    for t in range(2):
        x = np.zeros(18)
        x[index[bounds[t] : bounds[t + 1]]] = value[bounds[t] : bounds[t + 1]]
        x[16:] = stats[t]
        pairs = sum(x[i] * x[j] * model.factors[i] @ model.factors[j] for i in range(18) for j in range(i))
        assert got[t] == pytest.approx(0.3 + model.linear @ x + pairs, rel=1e-5)


def test_quality_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in QUERIES["op10_quality_machine"](spark, sf).collect()}
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    labels = [r for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert all(rows[r.doc_id].held_out for r in labels) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows.values())
    assert sum(rows[r.doc_id].predicted == r.quality for r in labels) / len(labels) > 0.9


def test_quality_edges(spark, docs, none):
    labels = spark.createDataFrame([(0, 1), (2, 1), (3, 0), (4, 0), (7, 1), (9, None), (None, 0), (77, 1), (6, 5)], "doc_id long, quality int")
    model = quality.fit_on_labels(docs, labels)
    scored = quality.score(docs, model, meta_cols=("n_chars",), out="quality_score")
    rows = scored.collect()
    assert len(rows) == docs.count() and all(0 <= r.quality_score <= 1 for r in rows) and "score" in scored.columns
    assert quality.score(none, model, meta_cols=("n_chars",), out="q").count() == 0
    assert quality.fit_on_labels(docs, labels.limit(0)) is None
    assert quality.score(docs, None, out="q").first().q == 0.5


# ---- pipeline


def test_pipeline_stages_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names, columns = [n for n, _ in corpus_pipeline.STAGES], docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert len(names) == 5
    scores = {r.doc_id: r.predicted for r in QUERIES["op10_quality_machine"](spark, sf).collect()}
    kept = materialize(stages["quality_classifier"](spark, docs, sf), "t")
    assert kept.columns == columns and {r.doc_id for r in kept.collect()} == {d for d, p in scores.items() if p}
    rows = [(r.doc_id, r.text) for r in kept.collect()]
    one = materialize(stages["ngram_jaccard_join"](spark, kept, sf), "t")
    assert one.columns == columns and sorted(r.doc_id for r in one.collect()) == sorted({v[0] for v in near_copies(rows).values()})
    rows = [(r.doc_id, r.text) for r in one.collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    clean = materialize(stages["benchmark_decontamination"](spark, one, sf), "t")
    assert clean.columns == columns and {r.doc_id for r in clean.collect()} == {d for d, _ in rows} - {d for d, _ in contaminated(rows, items)}
    copies = {r.doc_id: r.copies for r in mixing.mix(clean).collect()}
    mixed = materialize(stages["mix_sources"](spark, clean, sf), "t")
    assert mixed.columns == columns and collections.Counter(r.doc_id for r in mixed.collect()) == collections.Counter({d: n for d, n in copies.items() if n})
    last = stages["token_frames"](spark, mixed, sf).orderBy("start").collect()
    assert len(last) == mixed.count() and [r.doc_id for r in last] == sorted(r.doc_id for r in mixed.collect())


def test_equal_texts_score_equally_and_the_sample_is_bounded(spark):
    """A text's score has nothing of its neighbours in the batch; features beyond the bound are not learned from."""
    rng = np.random.default_rng(2)
    texts = [" ".join(f"w{k}" for k in rng.integers(0, 500, rng.integers(0, 90))) for _ in range(120)]
    rows = [(t, i % 2, i) for i, t in enumerate(texts)]
    labelled = spark.createDataFrame(rows, "text string, label int, order long")
    model = quality.fit(labelled)

    def scores(some):
        return model.scores(*quality.features(*column_bytes(pa.array(some)), [], model.bits))

    alone = [float(scores([t])[0]) for t in texts]
    assert alone == scores(texts).tolist() and alone[::-1] == scores(texts[::-1]).tolist()
    bounded = quality.fit(labelled, feature_bytes=5000)
    own = quality.fit(labelled.filter("order < 6"), feature_bytes=1 << 30)
    assert bounded.mean.tolist() != model.mean.tolist() and len(bounded.mean) == len(own.mean)


def test_mix_keeps_few_files(spark, docs):
    """The sizes that every pass reads lie in as many files as they need, not in one for each task that read texts."""
    parts = docs.repartition(40)
    sized, _ = mixing.mixing_plan(parts)
    assert sized.count() == docs.count() and len(sized.inputFiles()) <= 4
    assert sorted(mixing.mix(parts).collect(), key=repr) == sorted(mixing.mix(docs.coalesce(1)).collect(), key=repr)
