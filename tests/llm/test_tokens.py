import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from braidql.llm import framefile, tokenbin, tokencount
from braidql.llm.queries import QUERIES
from braidql.llm.textops import NON_ALNUM, SPACES, column_bytes, shingle_hashes, word_hashes
from braidql.llm.tokens import default_tokenizer, encoder

from .conftest import EDGE

PIECES = [" ", "  ", "\n", "\t", "a", "b", "word", "é", "ß", " ", "\u0085", " ", " ", "1", "23", "'s", "'", "!", "$", "<|endoftext|>", "<|", "日本", "🙂", ".", ",", "’", "　", "Ω", "²", "\x1f", "\x00", "_", "-", "\r\n", "n't", "LL"]


@pytest.fixture(scope="module")
def enc():
    return encoder(default_tokenizer())


def noise(r, n):
    return "".join(r.choice(PIECES) for _ in range(n))


def whole(enc, text):
    return enc.tokenizer.encode(text, add_special_tokens=False).ids


def test_pieces_give_the_ids_of_whole_texts(enc):
    r = random.Random(5)
    for _ in range(60):
        texts = [noise(r, r.randint(0, 40)) for _ in range(50)]
        ids, bounds = enc.encode(*column_bytes(pa.array(texts)))
        for i, t in enumerate(texts):
            assert ids[bounds[i] : bounds[i + 1]].tolist() == whole(enc, t)


def test_edits_equal_counting_again(enc):
    r = random.Random(6)
    for _ in range(150):
        text = noise(r, r.choice([0, 1, 5, 40, 700]))
        raw, bounds = column_bytes(pa.array([text]))
        starts, tokens, _ = enc.counts(raw, bounds)
        tree = tokencount.PieceTree(text.encode(), np.diff(np.append(starts, len(raw))), tokens, enc)
        for _ in range(r.randint(1, 5)):
            at, cut, new = r.randint(0, len(text) + 2), r.choice([0, 1, 3, r.randint(0, len(text))]), noise(r, r.choice([0, 1, 3, 150]))
            place = min(at, len(text))
            text = text[:place] + new + text[place + cut :]
            tree.edit(at, cut, new)
            assert tree.text() == text and tree.total == len(whole(enc, text)) and tree.length == len(text)


def test_edit_touches_little(enc):
    text = "some plain words here and there " * 2000
    raw, bounds = column_bytes(pa.array([text]))
    starts, tokens, _ = enc.counts(raw, bounds)
    tree = tokencount.PieceTree(text.encode(), np.diff(np.append(starts, len(raw))), tokens, enc)
    tree.edit(30_000, 5, "other")
    assert tree.encoded < 60


def test_edits_of_a_table(spark, docs, enc):
    edits = spark.createDataFrame([(0, 2, 0, 3, "x"), (0, 1, 0, 0, "Hello "), (9, 1, None, None, None), (77, 1, 0, 0, "unknown"), (4, 1, 5, 5, "new")], "doc_id long, seq int, start long, delete long, insert string")
    out = tokencount.edit_trees(tokencount.build_trees(docs), edits).collect()
    assert len(out) == len(EDGE)
    for r in out:
        assert r.n_tokens == len(whole(enc, r.text))
    assert next(r.text for r in out if r.doc_id == 0).startswith("xlo ")
    assert next(r.text for r in out if r.doc_id == 4) == "new"
    assert tokencount.edit_trees(tokencount.build_trees(docs.limit(0)), edits).count() == 0


def test_edit_query(spark, sf, enc):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in QUERIES["op3_edit_counts"](spark, sf).collect():
        t = texts[r.doc_id]
        n = len(t)
        assert r.n_before == len(whole(enc, t))
        for at, cut, new in ((n // 4, 10, ""), (n // 2, 0, " one more thing"), (n - 5, 5, ". The end.")):
            at = max(0, min(at, len(t)))
            t = t[:at] + new + t[at + cut :]
        assert (r.n_tokens, r.text_bytes) == (len(whole(enc, t)), len(t.encode()))


def test_frame_file(tmp_path):
    w = framefile.FrameWriter(2)
    docs = [(5, [1, 2, 3]), (None, []), (7, list(range(5000))), (-3, [65535])]
    path = tmp_path / "x.tokens"
    with open(path, "wb") as f:
        for d, ids in docs:
            for part in w.add(d, np.array(ids, np.uint32)):
                f.write(part)
        for part in w.finish():
            f.write(part)
    with open(path, "rb") as f:
        r = framefile.FrameReader(f)
        assert len(r) == 4 and r.find([7]).tolist() == [2] and bool(r.null[1])
        assert [np.concatenate([[], *r.ids(i)]).astype(int).tolist() for i in range(4)] == [ids for _, ids in docs]
    import zstandard

    data = path.read_bytes()
    assert zstandard.ZstdDecompressor().decompressobj().decompress(data) == np.array([1, 2, 3], "<u2").tobytes()
    broken = bytearray(data)
    broken[12] ^= 0xFF
    path.write_bytes(broken)
    with open(path, "rb") as f, pytest.raises(Exception):  # noqa: B017
        for i in range(4):
            list(framefile.FrameReader(f).ids(i))


def test_long_documents_have_several_frames(monkeypatch, tmp_path):
    monkeypatch.setattr(framefile, "FRAME_IDS", 100)
    w = framefile.FrameWriter(4)
    data = b"".join([*w.add(1, np.arange(250)), *w.add(2, np.arange(3)), *w.finish()])
    import io

    r = framefile.FrameReader(io.BytesIO(data))
    assert np.concatenate(list(r.ids(0))).tolist() == list(range(250)) and len(w.frames) == 4


def brute(rows, enc):
    start, out = 0, []
    for doc_id, text in rows:
        ids = [*whole(enc, text or ""), 2]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_query(spark, sf, enc):
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    assert sorted(tuple(r) for r in QUERIES["op4_token_frames"](spark, sf).collect()) == brute(rows, enc)


def test_edge_rows_and_lookup(spark, docs, none, enc, tmp_path):
    path = f"file://{tmp_path}/t"
    full = tokenbin.read_tokens(tokenbin.write_tokens(docs, path)).orderBy("start").collect()
    assert [r.doc_id for r in full] == [None, 0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 9, 9]
    assert full[0].start == 0 and all(a.start + a.n_tokens == b.start for a, b in zip(full, full[1:], strict=False))
    by_id = {d: t for d, t, *_ in EDGE if d not in (9, None)}
    for r in full:
        if r.doc_id in by_id:
            assert r.ids == [*whole(enc, by_id[r.doc_id] or ""), 2]
    assert tokenbin.read_documents(spark, path, [6])[0][1].tolist() == [*whole(enc, "two words"), 2]
    assert tokenbin.read_tokens(tokenbin.write_tokens(none)).count() == 0


def test_word_and_shingle_hashes():
    texts = ["a b  c\nA", "", " ", "é,x-y", "one two three four five six", None, "w" * 3_000_000 + " z"]
    raw, bounds = column_bytes(pa.array(texts))
    words, cuts = word_hashes(raw, bounds, SPACES)
    assert np.diff(cuts).tolist() == [4, 0, 0, 1, 6, 0, 2] and words[0] == words[3]
    assert np.diff(word_hashes(raw, bounds, NON_ALNUM)[1]).tolist()[3] == 3
    shingles, of = shingle_hashes(words, cuts, 5)
    assert np.diff(of).tolist() == [1, 0, 0, 1, 2, 0, 1]
    alone, _ = shingle_hashes(*word_hashes(*column_bytes(pa.array(["two three four five six"])), SPACES), 5)
    assert alone[0] == shingles[of[4] + 1]


def test_equal_hashes_are_told_apart(enc, monkeypatch):
    """Pieces whose hashes collide keep their own ids, and the word hash has no linear structure."""
    from braidql.llm import textops, tokens

    thue = "a"
    while len(thue) < 2048:
        thue += thue.translate(str.maketrans("ab", "ba"))
    pairs = [(thue[:n], thue[:n].translate(str.maketrans("ab", "ba"))) for n in (8, 64, 1024, 2048)]
    for a, b in pairs:
        raw, bounds = column_bytes(pa.array([a, b]))
        hashes, _ = word_hashes(raw, bounds, SPACES)
        assert hashes[0] != hashes[1]
    texts = [t for pair in pairs for t in pair] + ["some words that have equal lengths", "word corn bird cord worm ward", "x" * 700 + "y", "x" * 699 + "yx"]
    weak = lambda raw, starts, ends, fold: (ends - starts).astype(np.uint64)
    monkeypatch.setattr(tokens, "span_hashes", weak)
    own = tokens.PieceEncoder(default_tokenizer(), 50)
    for _ in range(2):
        ids, bounds = own.encode(*column_bytes(pa.array(texts)))
        for i, t in enumerate(texts):
            assert ids[bounds[i] : bounds[i + 1]].tolist() == whole(enc, t)
    assert textops.equal_spans(np.frombuffer(b"abcdefghijklm", np.uint8), np.array([0, 1]), np.frombuffer(b"xabcdefghijkX", np.uint8), np.array([1, 1]), np.array([11, 11])).tolist() == [True, False]
