import gzip
import hashlib
import io
import struct
import wave
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from braidql.llm import media
from braidql.llm.queries import QUERIES


def chunk(name, data):
    return struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))


PNG = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0\0")) + chunk(b"IEND", b"")
GIF = b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0x80, 0, 0) + b"\0\0\0\xff\xff\xff" + b"\x2c" + struct.pack("<HHHHB", 0, 0, 1, 1, 0) + b"\x02\x02\x44\x01\x00" + b"\x3b"
BMP = b"BM" + struct.pack("<IIIIiiHHIIiiII", 58, 0, 54, 40, 1, 1, 1, 24, 0, 4, 0, 0, 0, 0) + b"\0" * 4
JPEG = b"\xff\xd8\xff\xe0" + struct.pack(">H", 4) + b"JF" + b"\xff\xda" + struct.pack(">H", 3) + b"\0" + b"\x01\xff\x00\x02" + b"\xff\xd9"
PDF = b"%PDF-1.4\n1 0 obj\nendobj\nstartxref\n0\n%%EOF\n"
TIFF = b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", 1) + struct.pack("<HHII", 256, 3, 1, 1) + struct.pack("<I", 0)
FLAC = b"fLaC" + b"\x80" + (34).to_bytes(3, "big") + b"\0" * 34
OGG = b"OggS\0\x06" + b"\0" * 20 + b"\x01\x03abc"
MP3 = b"ID3\x04\0\0" + b"\0\0\0\x02" + b"xx" + b"\xff\xfb\x90\0"
MP4 = struct.pack(">I4s8s", 16, b"ftyp", b"isom\0\0\0\0") + struct.pack(">I4s", 8, b"moov")


def zipped():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a.txt", "hello")
        z.writestr("b.txt", "world" * 50)
    return out.getvalue()


def wav(samples):
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(8000)
        w.writeframes(samples)
    return out.getvalue()


KINDS = {"image/png": PNG, "image/gif": GIF, "image/bmp": BMP, "image/jpeg": JPEG, "application/pdf": PDF, "image/tiff": TIFF, "audio/flac": FLAC, "audio/ogg": OGG, "audio/mpeg": MP3, "video/mp4": MP4, "application/zip": zipped(), "application/gzip": gzip.compress(b"hello"), "audio/wav": wav(b"abcd")}


@pytest.mark.parametrize("kind", KINDS)
def test_each_format_is_confirmed_and_cut_ones_are_not(kind):
    data = KINDS[kind]
    seen = media.sniff_bytes(data, "text/plain")
    assert (seen["type"], seen["confirmed"], seen["corrected"], seen["length"]) == (kind, True, True, len(data))
    assert not media.sniff_bytes(data[: len(data) // 2], "text/plain")["confirmed"]
    inside = media.sniff_bytes(b"some words " + data, "text/plain")
    assert [(e["offset"], e["type"], e["length"]) for e in inside["embedded"]] == [(11, kind, len(data))] and inside["type"] == "text/plain"


def test_text_is_no_medium():
    for text in ("BM BM RIFF ID3 %PDF- ftyp GIF89a", "PK\x03\x04 II*\0", ""):
        seen = media.sniff_bytes(text.encode(), "text/plain")
        assert not seen["confirmed"] and seen["embedded"] == [] and seen["type"] == "text/plain"
    assert media.sniff_bytes(None, None)["length"] == 0


def test_outermost_is_carved():
    held = zipped()
    stored = io.BytesIO()
    with zipfile.ZipFile(stored, "w", zipfile.ZIP_STORED) as z:
        z.writestr("x.png", PNG)
    seen = media.sniff_bytes(b".." + stored.getvalue() + b"--" + held + PNG, None)
    assert [e["type"] for e in seen["embedded"]] == ["application/zip", "application/zip", "image/png"]


def test_columns_and_carving(spark):
    df = spark.createDataFrame([(1, bytearray(b"ab" + PNG + b"x" + GIF), "text/plain"), (2, None, None), (3, bytearray(b""), "x")], "id int, data binary, declared string")
    seen = df.withColumn("report", media.sniff(F.col("data"), F.col("declared")))
    pieces = [(r.id, r.carved.type, bytes(r.carved.data)) for r in media.carve(seen, "data", "report").collect()]
    assert pieces == [(1, "image/png", PNG), (1, "image/gif", GIF)]


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 1000])
def test_wav_round_trip(spark, n):
    text = "é" * (n // 2) + "x" * (n % 2)
    row = spark.createDataFrame([(text,)], "t string").select(media.wav_of(media.padded(F.col("t"))).alias("m")).first()
    want = text.encode() + bytes(-len(text.encode()) % 64 if text else 64)
    assert bytes(row.m) == wav(want)


def test_query(spark, sf):
    rows = {r.doc_id: r for r in QUERIES["op1_media_sniff"](spark, sf).collect()}
    for d in spark.read.parquet(f"{sf}/documents.parquet").collect():
        raw = (d.text or "").encode()
        own = raw + bytes(-len(raw) % 64 if raw else 64)
        r = rows[d.doc_id]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(own), hashlib.sha256(own).hexdigest(), zlib.crc32(own[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(wav(own)), hashlib.sha256(wav(own)).hexdigest()) and r.feature.startswith("type=audio/wav;")


def flac_stream(blocks):
    """A stream of constant, verbatim and fixed subframes with Rice-coded residuals."""

    def frame(number, size, kind):
        head = bytes([0xFF, 0xF8, 0x70, 0x08, number]) + struct.pack(">H", size - 1)
        crc = 0
        for c in head:
            crc = media._CRC8[crc ^ c]
        bits = "0" + format(kind, "06b") + "0"
        if kind == 0:
            bits += format(7, "016b")
        elif kind == 1:
            bits += "".join(format(i * 37 % 65536, "016b") for i in range(size))
        else:  # first order, one part, Rice parameter 2
            bits += format(100, "016b") + "00" + "0000" + "0010" + "".join("0" * (i % 5) + "1" + "01" for i in range(size - 1))
        body = head + bytes([crc]) + int(bits + "0" * (-len(bits) % 8), 2).to_bytes((len(bits) + 7) // 8, "big")
        crc = 0
        for c in body:
            crc = (crc << 8 & 0xFFFF) ^ media._CRC16[crc >> 8 ^ c]
        return body + struct.pack(">H", crc)

    total = sum(n for n, _ in blocks)
    info = struct.pack(">HH", 16, 4096) + bytes(6) + (44100 << 44 | 15 << 36 | total).to_bytes(8, "big") + bytes(16)
    return b"fLaC\x80" + (34).to_bytes(3, "big") + info + b"".join(frame(i, n, kind) for i, (n, kind) in enumerate(blocks))


def test_flac_and_mpeg_end_where_their_frames_do():
    sound = flac_stream([(300, 0), (300, 1), (300, 9), (120, 9)])
    frame = b"\xff\xfb\x90\x00" + b"a" * 413
    song = b"ID3\x04\0\0\0\0\0\x02xx" + frame * 3
    for stream, kind in ((sound, "audio/flac"), (song, "audio/mpeg"), (song + b"TAG" + b"n" * 125, "audio/mpeg")):
        seen = media.sniff_bytes(b"ab" + stream + b"cd" + PNG + GIF, "text/plain")
        assert [(e["offset"], e["type"], e["length"]) for e in seen["embedded"]] == [(2, kind, len(stream)), (4 + len(stream), "image/png", len(PNG)), (4 + len(stream) + len(PNG), "image/gif", len(GIF))]
    for cut in (len(sound) - 1, len(sound) - 40):
        assert not media.sniff_bytes(sound[:cut], None)["confirmed"]
    broken = bytearray(sound)
    broken[-10] ^= 4
    assert not media.sniff_bytes(bytes(broken), None)["confirmed"]
