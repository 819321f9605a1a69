import hashlib
import io
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from braidql.llm import warc
from braidql.llm.queries import ORACLE, QUERIES

LONG = "<html>" + "same payload " * 20
PAGES = [(3, "http://a/3", LONG), (1, "http://a/1", LONG), (2, None, LONG), (4, "http://a/ä b", "short"), (5, "http://a/5", "short"), (6, "http://a/6", None), (7, "", ""), (None, "http://a/n", LONG), (8, "http://a/8", LONG + "x\r\n\r\nWARC/1.1\r\n"), (8, "http://a/8", LONG + "x\r\n\r\nWARC/1.1\r\n")]


@pytest.fixture(scope="module")
def pages(spark):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    return df.withColumns({k: F.lit("clash") for k in ("payload", "digest", "of", "first", "n", "refers_to", "record_id")})


def test_round_trip(spark, pages):
    files = warc.write_captures(pages)
    got = warc.assemble(warc.read_records(files)).collect()
    assert len(got) == len(PAGES)
    by_id = {r.page_id: r for r in got}
    assert {i for i, r in by_id.items() if r.record_type == "revisit"} == {2, 3}
    for page_id, _, html in PAGES:
        r = by_id[page_id]
        raw = (html or "").encode()
        assert r.payload_digest == "sha256:" + hashlib.sha256(raw).hexdigest() and r.payload_bytes == len(raw)
        assert [x.record_type for x in r.requests] == ["request"] and [x.record_type for x in r.metadata] == ["metadata"]
        if r.record_type == "response":
            assert bytes(r.block).split(b"\r\n\r\n", 1)[1] == raw and r.payload_sha256 == hashlib.sha256(raw).hexdigest()
        else:
            assert r.original.page_id == 1
    assert by_id[2].target_uri is None and by_id[4].target_uri == "http://a/ä%20b"


def test_orphans_chains_and_reverse_links(spark):
    row = dict.fromkeys([f.split()[0] for f in warc.RECORD.split(", ")])
    rows = [
        row | {"record_id": "c", "record_type": "response", "concurrent_to": ["q1"], "payload_bytes": 3},
        row | {"record_id": "q1", "record_type": "request", "concurrent_to": []},
        row | {"record_id": "m1", "record_type": "metadata", "concurrent_to": ["q1"]},
        row | {"record_id": "m2", "record_type": "metadata", "concurrent_to": ["m1", "c"]},
        row | {"record_id": "lost", "record_type": "metadata", "concurrent_to": ["nothing"]},
        row | {"record_id": None, "record_type": "request", "concurrent_to": None},
    ]
    df = spark.createDataFrame([tuple(r.values()) for r in rows], warc.RECORD)
    (found,) = warc.assemble(df).collect()
    assert [x.record_id for x in found.requests] == ["q1"] and sorted(x.record_id for x in found.metadata) == ["m1", "m2"]
    assert sorted(str(r.record_id) for r in warc.orphans(df).collect()) == ["None", "lost"]
    assert warc.assemble(df.limit(0)).count() == 0


def test_records_are_gzip_members_and_headers_parse():
    data = b"".join(warc.capture_records(1, "http://a/", b"x" * 200, "00", None))
    members = list(warc._Members(io.BytesIO(data), 7))
    assert len(members) == 3 and members[0][0] == 0
    headers, block = warc.parse_record(members[1][1])
    assert headers["warc-type"] == ["response"] and block.endswith(b"x" * 200)
    assert zlib.decompressobj(31).decompress(data[members[1][0] :]).startswith(b"WARC/1.1\r\nWARC-Type: response")
    folded, _ = warc.parse_record(b"WARC/1.0\r\nWARC-Type: metadata\r\nX: a\r\n b\r\nContent-Length: 0\r\n\r\n")
    assert folded["x"] == ["a b"]
    with pytest.raises(ValueError):
        list(warc._Members(io.BytesIO(data[:50])))
    with pytest.raises(ValueError):
        warc.parse_record(b"WARC/1.0\r\nContent-Length: 9\r\n\r\nshort")


def test_query(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf}/pages.parquet'")
    want = con.execute(f"SELECT page_id, payload_bytes, payload_digest, record_type, refers_to FROM ({ORACLE['op6_warc_transactions']})").fetchall()
    assert sorted(map(tuple, QUERIES["op6_warc_transactions"](spark, sf).collect())) == sorted(want)


def test_empty_table(pages):
    files = warc.write_captures(pages.limit(0))
    assert files.count() == 0 and warc.assemble(warc.read_records(files)).count() == 0


def test_payloads_that_are_not_their_digests_are_refused(spark):
    headers = {"warc-type": ["response"], "content-type": ["application/http;msgtype=response"], "warc-payload-digest": ["sha256:" + hashlib.sha256(b"body").hexdigest()]}
    assert warc.record_row(headers, b"HTTP/1.1 200 OK\r\n\r\nbody", False, "f", 0)["payload_sha256"] == hashlib.sha256(b"body").hexdigest()
    with pytest.raises(ValueError, match="another payload"):
        warc.record_row(headers, b"HTTP/1.1 200 OK\r\n\r\nbodx", False, "f", 0)
    row = dict.fromkeys([f.split()[0] for f in warc.RECORD.split(", ")])
    rows = [row | {"record_id": "c", "record_type": "response", "payload_sha256": "aa", "concurrent_to": []}, row | {"record_id": "r", "record_type": "revisit", "refers_to": "c", "payload_digest": "sha256:bb", "concurrent_to": []}]
    with pytest.raises(Exception, match="digest is not that"):
        warc.assemble(spark.createDataFrame([tuple(r.values()) for r in rows], warc.RECORD)).collect()
    rows[1]["payload_digest"] = "sha256:aa"
    assert {r.payload_sha256 for r in warc.assemble(spark.createDataFrame([tuple(r.values()) for r in rows], warc.RECORD)).collect()} == {"aa"}


def test_files_of_a_partition_are_bounded(tmp_path, monkeypatch):
    import pyarrow as pa

    class Context:
        get = staticmethod(lambda: type("C", (), {"partitionId": lambda self: 3})())

    monkeypatch.setattr(warc, "TaskContext", Context)
    monkeypatch.setattr(warc, "FILE_BYTES", 1000)
    batch = pa.RecordBatch.from_pydict({"page_id": list(range(9)), "url": ["http://a/"] * 9, "payload": [b"x%d" % i for i in range(9)], "digest": ["0"] * 9, "refers_to": pa.array([None] * 9, pa.int64())})
    made = [r for out in warc._writer(str(tmp_path))(iter([batch.slice(0, 5), batch.slice(5)])) for r in out.to_pylist()]
    assert len(made) > 2 and sum(r["captures"] for r in made) == 9
    for r in made:
        data = list(warc._Members(open(r["path"], "rb")))
        assert len(data) == 1 + 3 * r["captures"]
