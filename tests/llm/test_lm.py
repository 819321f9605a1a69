import collections
import math
import re
import zlib

import numpy as np
import pytest

from braidql.llm import lmscore, recurrent
from braidql.llm.queries import QUERIES

from .conftest import EDGE


def net(hidden=5, symbols=9, rng=None):
    rng = rng or np.random.default_rng(0)
    share = np.array([0.3, 0.3, 0.4])
    word = np.full((2, 3), 1 / 3)
    made = recurrent.GatedNet.create(symbols, hidden, share, word)
    for f in recurrent.FIELDS:
        a = getattr(made, f)
        a += rng.standard_normal(a.shape).astype(np.float32) * 0.3
    return made


def test_gradients_match_differences():
    rng = np.random.default_rng(1)
    model = net(rng=rng)
    for f in recurrent.FIELDS:
        setattr(model, f, getattr(model, f).astype(np.float64))
    symbols, classes, words = rng.integers(0, 9, (4, 3)), rng.integers(0, 3, (4, 3)), rng.integers(0, 3, (4, 3))
    mask = np.ones((4, 3), bool)
    mask[3, 2] = False
    state = np.zeros((3, 5), np.float64)
    _, grad, _ = model.gradients(symbols, classes, words, mask, state)
    for f in recurrent.FIELDS:
        a = getattr(model, f)
        at = tuple(rng.integers(0, n) for n in a.shape) if f != "inputs" else (symbols[0, 0], 2)
        old, h = a[at], 1e-3
        a[at] = old + h
        up = model.gradients(symbols, classes, words, mask, state)[0]
        a[at] = old - h
        down = model.gradients(symbols, classes, words, mask, state)[0]
        a[at] = old
        assert (up - down) / (2 * h) == pytest.approx(grad[f][at], rel=0.05, abs=2e-4), f


def test_probabilities_sum_to_one():
    model = net()
    states = np.random.default_rng(2).standard_normal((4, 5)).astype(np.float32)
    total = np.zeros(4)
    for c in range(3):
        for w in range(3 if c < 2 else 1):
            total += np.exp(model.log_probs(states, np.full(4, c), np.full(4, w)))
    assert total == pytest.approx(np.ones(4), rel=1e-5)


def test_state_is_carried_and_batches_do_not_matter():
    rng, model = np.random.default_rng(3), net()
    lengths = [1, 70, 3, 0, 33]
    bounds = np.concatenate([[0], np.cumsum(lengths)])
    n = bounds[-1]
    symbols, classes, words = rng.integers(0, 9, n), rng.integers(0, 3, n), rng.integers(0, 3, n)
    a = recurrent.score(model, symbols, classes, words, bounds, 8)
    b = recurrent.score(model, symbols, classes, words, bounds, 8, steps=7, texts=2)
    assert a == pytest.approx(b, rel=1e-5) and a[3] == 0
    i, j = bounds[1], bounds[2]
    given = np.concatenate([[8], symbols[i : j - 1]])[:, None]
    states, _ = model.run(given, np.zeros((1, 5), np.float32))
    assert a[1] == pytest.approx(model.log_probs(states[:, 0], classes[i:j], words[i:j]).sum(), rel=1e-5)


def test_training_learns_an_order():
    bounds = np.arange(0, 2001, 20)
    words = np.tile([0, 1, 2], 667)[:2000]
    model = recurrent.GatedNet.create(4, 8, np.array([0.999, 0.001]), np.full((1, 3), 1 / 3))
    before = recurrent.score(model, words, np.zeros(2000, int), words, bounds, 3).sum()
    for _ in range(15):
        recurrent.train(model, words, np.zeros(2000, int), words, bounds, 3, texts=16, rate=0.02)
    assert recurrent.score(model, words, np.zeros(2000, int), words, bounds, 3).sum() > before * 0.3


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")), None]


def held(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 10 == 0


def check(rows, found):
    c = collections.Counter()
    for d, t in rows:
        if not held(d):
            c.update(tokens(t))
    total, distinct = sum(c.values()), len(c)
    want = []
    for d, t in rows:
        w = tokens(t)
        want.append((d, held(d), len(w), sum(c[x] > 0 for x in w), total, sum(math.log10((c[x] + 0.1) / (total + 0.1 * (distinct + 1))) for x in w)))
    key = lambda r: repr(r[:4])
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in found), key=key)
    for a, b in zip(got, sorted(want, key=key), strict=True):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], rel=1e-9)


def test_query(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    found = QUERIES["op7_recurrent_lm"](spark, sf).collect()
    check(rows, found)
    out = [r for r in found if r.held_out]
    assert all(r.score < 0 for r in found) and sum(r.score for r in out) > sum(r.base_score for r in out)


def test_edge_rows_and_rare_words(docs, none):
    """A table of eight words leaves almost all counts to the join."""
    options = {"frequent": 4, "width": 2, "table": 8, "rounds": 1, "every": 2, "warm": 4}
    check([(r.doc_id, r.text) for r in docs.collect()], lmscore.score_documents(docs, **options).collect())
    assert lmscore.score_documents(none, **options).count() == 0


def test_no_training_rows(spark):
    df = spark.createDataFrame([(i, "a b") for i in range(300) if held(i)][:5], "doc_id long, text string")
    rows = lmscore.score_documents(df, frequent=4, width=2, table=8).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 and r.base_score == 0 and math.isfinite(r.score) for r in rows)


def test_rounds_learn_from_every_training_text(docs, monkeypatch):
    """The tokens of the rounds after the warm start are those of all training texts."""
    learned, average = [], lmscore.tree_average

    def spy(copies, *args):
        learned.append(sum(r.tokens for r in copies.collect()))
        return average(copies, *args)

    monkeypatch.setattr(lmscore, "tree_average", spy)
    rows = lmscore.score_documents(docs, frequent=4, width=2, table=8, warm=4).collect()
    assert sum(learned[1:]) == rows[0].train_tokens


def test_training_carries_state_into_inner_stretches(monkeypatch):
    rng, model, seen = np.random.default_rng(4), net(), []
    bounds = np.array([0, 3, 43, 43, 60])
    symbols, classes, words = rng.integers(0, 8, 60), rng.integers(0, 3, 60), rng.integers(0, 3, 60)
    first, gradients = model.load(model.flat()), recurrent.GatedNet.gradients

    def spy(self, given, target, word, mask, state):
        seen.append((given.copy(), state.copy()))
        return gradients(self, given, target, word, mask, state)

    monkeypatch.setattr(recurrent.GatedNet, "gradients", spy)
    assert recurrent.train(model, symbols, classes, words, bounds, 8, stretch=16, steps=16) == 60
    given, state = seen[0]
    want = []
    for i, j in zip(bounds, bounds[1:], strict=False):
        before = np.concatenate([[8], symbols[i:j]])
        run = np.concatenate([np.zeros((1, 5)), first.run(before[:-1, None], np.zeros((1, 5), np.float32))[0][:, 0]]) if j > i else []
        want += [(before[k], run[k]) for k in range(0, j - i, 16)]
    key = lambda x: (int(x[0]), x[1].tolist())
    for (a, s), (b, t) in zip(sorted(zip(given[0], state, strict=True), key=key), sorted(want, key=key), strict=True):
        assert a == b and s == pytest.approx(t, abs=1e-5)


def plain_score(model, v, text):
    """Token by token, one matrix product at a time."""
    h = model.hidden
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    tokens = [w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", lowered)] + [None]
    state, symbol, total = np.zeros(h), v.start_symbol, 0.0
    places = {int(w): i for i, w in enumerate(v.words)}
    w64 = {f: getattr(model, f).astype(np.float64) for f in recurrent.FIELDS}
    sig = lambda x: 1 / (1 + np.exp(-x))
    log_softmax = lambda x: x - x.max() - np.log(np.exp(x - x.max()).sum())
    for token in tokens:
        given, pull = w64["inputs"][symbol] + w64["gate_bias"], state @ w64["recurrent"]
        z, r = sig(given[:h] + pull[:h]), sig(given[h : 2 * h] + pull[h : 2 * h])
        new = np.tanh(given[2 * h :] + r * pull[2 * h :])
        state = (1 - z) * new + z * state
        if token is None:
            key, rest = lmscore.END, 0
        else:
            raw = np.frombuffer(token, np.uint8)
            key = int(lmscore.span_hashes(raw, np.array([0]), np.array([len(raw)])).view(np.int64)[0])
            rest = int(lmscore.rest_class(np.array([int.from_bytes(token[:3].ljust(3, b"\0"), "big")]))[0])
        at = places.get(key)
        slot = -1 if at is None else int(v.slot[at])
        by_class = log_softmax(state @ w64["class_out"] + w64["class_bias"])
        if slot >= 0:
            c, w = divmod(slot, v.width)
            total += by_class[c] + log_softmax(state @ w64["word_out"][c] + w64["word_bias"][c])[w]
            symbol = slot
        else:
            count = 0 if at is None else int(v.counts[at])
            total += by_class[v.groups + rest] + math.log(count + 0.1) - v.rest_log[rest] * math.log(10)
            symbol = v.groups * v.width + rest
    return total / math.log(10)


def test_scores_equal_a_plain_loop(spark, docs, monkeypatch):
    """The query's score of each text, by weights that were learned, and by a loop over its tokens."""
    kept = {}
    build, learn = lmscore.build_vocabulary, lmscore.train
    monkeypatch.setattr(lmscore, "build_vocabulary", lambda *a: kept.setdefault("v", build(*a)))
    monkeypatch.setattr(lmscore, "train", lambda *a, **k: kept.setdefault("net", learn(*a, **k)))
    out = lmscore.score_documents(docs, frequent=8, width=4, table=1 << 17).collect()
    texts = collections.defaultdict(list)
    for d, t, *_ in EDGE:
        texts[d].append(t)
    vocabulary = kept["v"][0]
    for r in out:
        if len(texts[r.doc_id]) == 1 and r.doc_id != 7:
            assert r.score == pytest.approx(plain_score(kept["net"], vocabulary, texts[r.doc_id][0]), rel=1e-4)
    assert {r.doc_id for r in out} == set(texts)
