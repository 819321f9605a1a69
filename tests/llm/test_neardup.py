import collections
import os
import random
import re
import shutil
import subprocess
import sys

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from braidql.llm import neardup
from braidql.llm.components import components
from braidql.llm.queries import QUERIES
from braidql.llm.storage import keep

from .conftest import prose

REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text or ""))
    return {tuple(w[k : k + 5]) for k in range(max(1 if w else 0, len(w) - 4))}


def brute(rows, threshold=0.8):
    """{place: (class id, links, copies)} by comparing every pair of texts."""
    texts = collections.defaultdict(list)
    for i, (_, t) in enumerate(rows):
        texts[t or ""].append(i)
    keys = list(texts)
    sets = [shingles(t) for t in keys]
    parent, links = list(range(len(keys))), collections.Counter()

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(keys)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if n and n / len(sets[i] | sets[j]) >= threshold - 1e-12:
                links[i] += 1
                links[j] += 1
                parent[find(i)] = find(j)
    ids = collections.defaultdict(list)
    for i, t in enumerate(keys):
        ids[find(i)] += [rows[p][0] for p in texts[t]]
    out = {}
    for i, t in enumerate(keys):
        known = [x for x in ids[find(i)] if x is not None]
        for p in texts[t]:
            out[p] = (min(known) if known else None, links[i], len(texts[t]))
    return out


def compare(rows, found):
    want = sorted(((rows[p][0], *v) for p, v in brute(rows).items()), key=repr)
    assert sorted((tuple(r) for r in found), key=repr) == want


def test_query(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    compare(rows, QUERIES["op5_jaccard_join"](spark, sf).collect())


def test_edge_rows(docs, none):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    compare(rows, neardup.near_duplicates(docs).collect())
    assert neardup.near_duplicates(none).count() == 0
    kept = neardup.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id if r.doc_id is not None else -1 for r in kept.collect()) == [-1, 0, 3, 5, 6, 7, 8, 9, 9]
    assert neardup.drop_near_duplicates(none).count() == 0


def family(seed, n, words=120):
    r = random.Random(seed)
    base = prose(seed, words).split()
    out = []
    for i in range(n):
        w = list(base)
        for _ in range(r.randint(0, 2)):
            w[r.randrange(len(w))] = f"edit{seed}x{i}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("many", [64, 1])
def test_blocks_and_large_components_lose_no_link(spark, tmp_path, monkeypatch, many):
    """With tiny blocks every way of dealing work is taken; links stay exact."""
    monkeypatch.setattr(neardup, "BLOCK_TEXTS", 7)
    monkeypatch.setattr(neardup, "MANY_BLOCKS", many)
    rows = [(i, t) for i, t in enumerate(t for s in range(3) for t in family(s, 40))]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/d")
    df = spark.read.parquet(f"{tmp_path}/d")
    compare(rows, neardup.near_duplicates(df).collect())


def test_prefixes_are_shortened_until_the_recall_is_met(spark, tmp_path):
    rows = [(i, t) for i, t in enumerate(t for s in range(6) for t in family(s + 20, 12))]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/d")
    df = spark.read.parquet(f"{tmp_path}/d")
    compare(rows, neardup.near_duplicates(df, trees=4, depth=6, recall=0.9999).collect())


def test_shared_counts():
    sets = [np.unique(np.random.default_rng(i).integers(0, 300, 100)).astype(np.uint64) for i in range(9)]
    got = neardup.shared_counts(sets)
    assert all(got[i, j] == len(np.intersect1d(sets[i], sets[j])) for i in range(9) for j in range(9) if i != j)


def test_labels_follow_similarity():
    label = neardup._labeller(24, 6)
    sets = list(neardup._sets(pa.array([prose(1, 300), prose(1, 300), prose(9, 300)])))
    a, b, c = (label(s) for s in sets)
    assert (a == b).all() and (a != c).all()


def test_components(spark):
    r = random.Random(2)
    edges = [(f"{i:03}", f"{i + 1:03}") for i in range(60) if i % 13] + [("500", f"{r.randrange(600, 700)}") for _ in range(40)] + [("900", "900")]
    found = dict(components(spark.createDataFrame(edges, "a string, b string")).collect())
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    assert found == {n: find(n) for n in parent}


def borderline(seed, n, words=104):
    """Pairs whose similarity is just over 0.8: edits of a text that spoil 10 to 11 of its 100 shingles."""
    r = random.Random(seed)
    out = []
    for i in range(n):
        base = [f"w{seed}x{i}x{k}" for k in range(words)]
        other = list(base)
        for at in (r.randrange(5, 40), r.randrange(50, 95)):
            other[at] = "edited"
        out += [" ".join(base), " ".join(other)]
    return out


def test_default_options_shorten_prefixes_and_find_borderline_links(spark, tmp_path, monkeypatch):
    """Similarities of 0.80 to 0.85: full depth misses links, shorter prefixes find them all."""
    rows = list(enumerate(borderline(3, 400)))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/d")
    df = spark.read.parquet(f"{tmp_path}/d")
    depths, match = [], neardup._match

    def spy(sets_of, texts, at, *rest):
        level = match(sets_of, texts, at, *rest)
        depths.append((at, level.found.select("tid").distinct().count() / 2))
        return level

    monkeypatch.setattr(neardup, "_match", spy)
    got = neardup.near_duplicates(df).collect()
    sets = [set(zip(*[t.split()[k:] for k in range(5)], strict=False)) for _, t in rows]
    near = [len(sets[i] & sets[i + 1]) / len(sets[i] | sets[i + 1]) for i in range(0, len(sets), 2)]
    assert all(0.8 <= s <= 0.85 for s in near)
    assert len(depths) > 1 and [a for a, _ in depths] == list(range(8, 8 - len(depths), -1))
    assert depths[0][1] < 400 and depths[-1][1] >= 0.995 * 400
    assert sum(r.links for r in got) == 2 * depths[-1][1]


def test_a_text_is_dealt_once_however_many_blocks_its_group_has(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK_TEXTS", 7)
    members = spark.range(40).selectExpr("md5(string(id)) AS tid", "100 AS n", "int(null) AS tree", "40L AS texts", "4000L AS shingles", "'a' AS root")
    assert neardup._dealt(members, "root").count() == 40
    rows = [(i, t) for i, t in enumerate(family(5, 40))]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/d")
    dealt, verify = [], neardup._verify

    def spy(texts_of, texts, members, *rest):
        dealt.append((members.count(), members.select("unit").distinct().count()))
        return verify(texts_of, texts, members, *rest)

    monkeypatch.setattr(neardup, "_verify", spy)
    compare(rows, neardup.near_duplicates(spark.read.parquet(f"{tmp_path}/d")).collect())
    assert dealt[0][0] <= 40 and dealt[0][1] > 1


def test_shuffle_files_go_when_the_next_table_is_written(spark, monkeypatch):
    import time

    from braidql.llm import storage

    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    kept = lambda: [f.getName() for f in map(files.getAllFiles().apply, range(files.getAllFiles().size())) if f.getName().startswith("shuffle")]
    monkeypatch.setattr(storage, "RELEASE_SECONDS", 0)
    spark._jvm.System.gc()
    time.sleep(2)
    before = set(kept())
    storage.materialize(spark.range(100_000).groupBy((F.col("id") % 1000).alias("k")).count(), "test-release")
    first = set(kept()) - before
    storage.materialize(spark.range(10), "test-release")
    until = time.monotonic() + 10
    while first & set(kept()) and time.monotonic() < until:
        time.sleep(0.2)
    assert not first & set(kept())


def test_few_unwanted_rows_are_shuffled_and_no_wanted_one_is_lost(spark):
    wanted = spark.range(0, 5000, 50).select(F.xxhash64("id").alias("hash"))
    kept = {r.id for r in neardup._likely(spark.range(5000), F.xxhash64("id"), wanted).collect()}
    assert kept >= set(range(0, 5000, 50)) and len(kept) < 110
    assert neardup._likely(spark.range(9), F.xxhash64("id"), wanted.limit(0)).count() == 0


def test_writes_start_no_processes(tmp_path):
    """Tasks write without Hadoop's ``chmod``, during whose start an executor's memory is seen twice."""
    log, wrapper = tmp_path / "started", tmp_path / "bin" / "chmod"
    wrapper.parent.mkdir()
    wrapper.write_text(f'#!/bin/sh\necho "$@" >> {log}\nexec {shutil.which("chmod")} "$@"\n')
    wrapper.chmod(0o755)
    code = f"""
from pyspark.sql import SparkSession
from braidql.llm import neardup
from tests.llm.conftest import prose
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4").config("spark.checkpoint.dir", "file://{tmp_path}/shared").getOrCreate()
rows = [(i, prose(i % 3, 80) + " more" * (i % 2)) for i in range(12)]
print("links", neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).agg({{"links": "sum"}}).first()[0])
"""
    env = os.environ | {"PATH": f"{wrapper.parent}:{os.environ['PATH']}", "PYTHONPATH": REPO}
    said = subprocess.run([sys.executable, "-c", code], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert "links 12" in said.stdout, said.stderr[-2000:]
    assert [x for x in (log.read_text().splitlines() if log.exists() else []) if "attempt_" in x] == []


@pytest.mark.parametrize("kind", ["date", "decimal(12,2)", "interval year", "string"])
def test_ids_of_other_types(spark, kind):
    """Ids that Arrow's files hold otherwise, or not at all, come back as they were."""
    made = {"date": "date_add(date'1500-01-01', id::int)", "decimal(12,2)": "id::decimal(12,2)", "interval year": "make_ym_interval(id::int, 0)::interval year", "string": "concat('é', id)"}[kind]
    df = spark.range(6).selectExpr(f"{made} AS doc_id", f"concat('{prose(1, 60)}', if(id % 2 = 0, ' even', '')) AS text")
    out = neardup.near_duplicates(df)
    assert out.schema["doc_id"].dataType == out.schema["class_id"].dataType == df.schema["doc_id"].dataType
    assert out.selectExpr("doc_id::string d", "class_id::string c", "links", "copies").orderBy("d").collect() == df.selectExpr("doc_id::string d", "(min(doc_id) OVER ())::string c", "1L links", "3L copies").orderBy("d").collect()


def test_kept_tables(spark):
    """Several row groups and files, nulls, arrays; tables and files without rows."""
    df = spark.range(0, 50_000, 1, 3).selectExpr("id", "if(id % 7 = 0, null, repeat(md5(id::string), 20)) s", "if(id % 5 = 0, null, array(id, null, -id)) a", "id::int i", "encode(id::string, 'utf-8') b", "id / 3 d", "id % 2 = 0 t")
    kept = keep(df, "kept")
    assert kept.schema == df.schema.__class__([f.__class__(f.name, f.dataType) for f in df.schema])
    assert kept.exceptAll(df).isEmpty() and df.exceptAll(kept).isEmpty() and len(kept.inputFiles()) == 3
    assert len(keep(df.filter("id < 10"), "kept").inputFiles()) == 1
    empty = keep(df.limit(0), "kept")
    assert empty.columns == df.columns and empty.isEmpty()
    stepped = keep(df, "kept", lambda batches: (b.select(["id"]) for b in batches), "id long")
    assert stepped.agg(F.sum("id")).first()[0] == sum(range(50_000))


def test_workers_return_memory(spark):
    """A worker that has had much memory holds little after its task."""

    def fill(batches):
        for batch in batches:
            pieces = [bytes(2000) for _ in range(150_000)]  # 300 MB, of which the last piece stays
            sys.modules["sys"].last_piece = pieces.pop()
            del pieces
            yield batch

    def held(batches):
        for batch in batches:
            with open("/proc/self/status") as f:
                size = next(int(line.split()[1]) for line in f if line.startswith("RssAnon")) // 1024
            yield pa.RecordBatch.from_pydict({"mb": pa.array([size] * batch.num_rows, pa.int64())})

    keep(spark.range(0, 4, 1, 4), "kept", fill, "id long")
    assert spark.range(0, 4, 1, 4).mapInArrow(held, "mb long").agg(F.max("mb")).first()[0] < 250
