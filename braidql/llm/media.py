"""Media columns: signature sniffing and carving.

An Aho-Corasick automaton finds every magic number of a value in one pass;
a validator of the format then confirms structure and length at each place.
The format confirmed at the start corrects the declared type; confirmed
formats elsewhere are embedded media, carved as spans that do not overlap
(outermost, leftmost first).

Defined results: a null value has no type, length 0 and no embedded media, and
its declared type stays; an empty value likewise; bytes of no known format keep
their declared type with ``confirmed`` false.
"""

from __future__ import annotations

import struct
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Magic bytes of each format.
MAGIC = {
    "audio/wav": [b"RIFF"],
    "image/png": [b"\x89PNG\r\n\x1a\n"],
    "image/jpeg": [b"\xff\xd8\xff"],
    "image/gif": [b"GIF87a", b"GIF89a"],
    "image/bmp": [b"BM"],
    "image/tiff": [b"II*\x00", b"MM\x00*"],
    "application/pdf": [b"%PDF-"],
    "application/zip": [b"PK\x03\x04"],
    "application/gzip": [b"\x1f\x8b\x08"],
    "audio/flac": [b"fLaC"],
    "audio/ogg": [b"OggS"],
    "audio/mpeg": [b"ID3"],
    "video/mp4": [b"ftyp"],
}
#: Where the magic bytes stand in the format, if not at its start.
MAGIC_AT = {"video/mp4": 4}


def _riff(b: bytes, at: int) -> tuple[str, int, int, int] | None:
    if at + 12 > len(b):
        return None
    size = struct.unpack_from("<I", b, at + 4)[0]
    end, kind = at + 8 + size, b[at + 8 : at + 12]
    if end > len(b) or kind not in (b"WAVE", b"WEBP", b"AVI "):
        return None
    pos, seen, body = at + 12, set(), (at, 0)
    while pos + 8 <= end:
        name, n = b[pos : pos + 4], struct.unpack_from("<I", b, pos + 4)[0]
        if pos + 8 + n > end or not all(32 <= c < 127 for c in name):
            return None
        seen.add(name)
        if name == b"data":
            body = (pos + 8, n)
        pos += 8 + n + (n & 1)
    if pos != end and pos - 1 != end:
        return None
    if kind == b"WAVE":
        return ("audio/wav", end - at, *body) if {b"fmt ", b"data"} <= seen else None
    if kind == b"WEBP":
        return ("image/webp", end - at, at, end - at) if seen & {b"VP8 ", b"VP8L", b"VP8X"} else None
    return ("video/x-msvideo", end - at, at, end - at) if b"LIST" in seen else None


def _png(b: bytes, at: int) -> int | None:
    pos, first = at + 8, True
    while pos + 12 <= len(b):
        n, name = struct.unpack_from(">I4s", b, pos)
        if pos + 12 + n > len(b) or first != (name == b"IHDR") or (first and n != 13):
            return None
        if zlib.crc32(b[pos + 4 : pos + 8 + n]) != struct.unpack_from(">I", b, pos + 8 + n)[0]:
            return None
        pos, first = pos + 12 + n, False
        if name == b"IEND":
            return pos - at
    return None


def _jpeg(b: bytes, at: int) -> int | None:
    pos, scans = at + 2, 0
    while pos + 4 <= len(b):
        if b[pos] != 0xFF:
            return None
        marker = b[pos + 1]
        if marker == 0xFF:
            pos += 1
            continue
        if marker == 0xD9:
            return pos + 2 - at if scans else None
        if marker < 0xC0 or 0xD0 <= marker <= 0xD8:
            return None
        n = struct.unpack_from(">H", b, pos + 2)[0]
        if n < 2:
            return None
        pos += 2 + n
        if marker == 0xDA:
            scans += 1
            while True:
                pos = b.find(b"\xff", pos)
                if pos < 0 or pos + 1 >= len(b):
                    return None
                if b[pos + 1] == 0 or 0xD0 <= b[pos + 1] <= 0xD7:
                    pos += 2
                else:
                    break
    return pos + 2 - at if pos + 2 <= len(b) and scans and b[pos : pos + 2] == b"\xff\xd9" else None


def _gif(b: bytes, at: int) -> int | None:
    def blocks(pos: int) -> int | None:
        while pos < len(b):
            if not b[pos]:
                return pos + 1
            pos += 1 + b[pos]
        return None

    if at + 13 > len(b):
        return None
    flags = b[at + 10]
    pos, frames = at + 13 + (3 << (flags & 7) + 1 if flags & 0x80 else 0), 0
    while pos is not None and pos < len(b):
        if b[pos] == 0x3B:
            return pos + 1 - at if frames else None
        if b[pos] == 0x21:
            pos = blocks(pos + 2)
        elif b[pos] == 0x2C and pos + 10 <= len(b):
            local = b[pos + 9]
            pos = blocks(pos + 10 + (3 << (local & 7) + 1 if local & 0x80 else 0) + 1)
            frames += 1
        else:
            return None
    return None


def _bmp(b: bytes, at: int) -> int | None:
    if at + 30 > len(b):
        return None
    size, reserved, start, header = struct.unpack_from("<IIII", b, at + 2)
    planes, depth = struct.unpack_from("<HH", b, at + 26)
    good = not reserved and header in (40, 52, 56, 108, 124) and 14 + header <= start <= size and planes == 1 and depth in (1, 4, 8, 16, 24, 32)
    return size if good and at + size <= len(b) else None


def _tiff(b: bytes, at: int) -> int | None:
    order = "<" if b[at : at + 2] == b"II" else ">"
    if at + 8 > len(b):
        return None
    width = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
    pos, end, seen = struct.unpack_from(order + "I", b, at + 4)[0], 8, set()
    while pos:
        if pos in seen or at + pos + 2 > len(b):
            return None
        seen.add(pos)
        n = struct.unpack_from(order + "H", b, at + pos)[0]
        if not n or at + pos + 2 + 12 * n + 4 > len(b):
            return None
        spans: dict[int, list[int]] = {}
        for i in range(n):
            tag, kind, count, value = struct.unpack_from(order + "HHII", b, at + pos + 2 + 12 * i)
            if kind not in width:
                return None
            size = width[kind] * count
            if size > 4:
                end = max(end, value + size)
            if at + end > len(b):
                return None
            if tag in (273, 279):
                base = at + value if size > 4 else at + pos + 2 + 12 * i + 8
                spans[tag] = list(struct.unpack_from(f"{order}{count}{'H' if kind == 3 else 'I'}", b, base))
        end = max([end, pos + 6 + 12 * n, *(o + s for o, s in zip(spans.get(273, []), spans.get(279, []), strict=False))])
        pos = struct.unpack_from(order + "I", b, at + pos + 2 + 12 * n)[0]
    return end if seen and at + end <= len(b) else None


def _pdf(b: bytes, at: int) -> int | None:
    if at + 8 > len(b) or not (chr(b[at + 5]).isdigit() and b[at + 6] == 0x2E):
        return None
    follows = b.find(b"%PDF-", at + 5)
    end = b.rfind(b"%%EOF", at, len(b) if follows < 0 else follows)
    if end < 0 or b.find(b"startxref", at, end) < 0:
        return None
    end += 5
    return end + (b[end : end + 2] == b"\r\n") * 2 + (b[end : end + 1] == b"\n") - at


def _zip(b: bytes, at: int) -> int | None:
    pos, entries = at, 0
    while b[pos : pos + 4] == b"PK\x03\x04" and pos + 30 <= len(b):
        flags = struct.unpack_from("<H", b, pos + 6)[0]
        packed, _, name, extra = struct.unpack_from("<IIHH", b, pos + 18)
        pos += 30 + name + extra + packed
        entries += 1
        if flags & 8:  # sizes follow the data
            mark = b.find(b"PK\x07\x08", pos)
            if mark < 0:
                return None
            pos = mark + 16
    directory = 0
    while b[pos : pos + 4] == b"PK\x01\x02" and pos + 46 <= len(b):
        pos += 46 + sum(struct.unpack_from("<HHH", b, pos + 28))
        directory += 1
    if b[pos : pos + 4] != b"PK\x05\x06" or pos + 22 > len(b) or directory != entries:
        return None
    count, note = struct.unpack_from("<H", b, pos + 10)[0], struct.unpack_from("<H", b, pos + 20)[0]
    return pos + 22 + note - at if count == entries and pos + 22 + note <= len(b) else None


def _gzip(b: bytes, at: int) -> int | None:
    unpack, pos = zlib.decompressobj(31), at
    try:
        while not unpack.eof and pos < len(b):
            data = b[pos : pos + 65536]
            while data and not unpack.eof:
                unpack.decompress(data, 1 << 20)
                data = unpack.unconsumed_tail
            pos += 65536
    except zlib.error:
        return None
    return min(pos, len(b)) - len(unpack.unused_data) - at if unpack.eof else None


# Fixed values of FLAC: sizes of blocks and samples by their codes.
FLAC_BLOCKS = {1: 192, **{i: 576 << (i - 2) for i in range(2, 6)}, **{i: 256 << (i - 8) for i in range(8, 16)}}
FLAC_DEPTHS = {1: 8, 2: 12, 4: 16, 5: 20, 6: 24, 7: 32}


def _crc_table(polynomial: int, bits: int) -> list[int]:
    top, out = 1 << (bits - 1), []
    for i in range(256):
        r = i << (bits - 8)
        for _ in range(8):
            r = (r << 1 ^ polynomial if r & top else r << 1) & (1 << bits) - 1
        out.append(r)
    return out


_CRC8, _CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)


def _flac_header(b: bytes, at: int, depth: int) -> tuple[int, int, int, int, int] | None:
    """(end of the header, number, block size, channel code, sample size) of a frame, its checksum confirmed."""
    if at + 6 > len(b) or b[at] != 0xFF or b[at + 1] & 0xFE != 0xF8:
        return None
    block, rate, channels, code = b[at + 2] >> 4, b[at + 2] & 15, b[at + 3] >> 4, b[at + 3] >> 1 & 7
    if not block or rate == 15 or channels > 10 or code == 3 or b[at + 3] & 1:
        return None
    lead = b[at + 4]
    more = 0 if lead < 0x80 else 8 - (lead ^ 0xFF).bit_length() - 1
    if lead >= 0x80 and not 1 <= more <= 6:
        return None
    number = lead if not more else lead & (0x3F >> more)
    for c in b[at + 5 : at + 5 + more]:
        number = number << 6 | c & 0x3F
    pos = at + 5 + more
    size = FLAC_BLOCKS.get(block) or int.from_bytes(b[pos : pos + block - 5], "big") + 1
    pos += (block - 5 if block in (6, 7) else 0) + {12: 1, 13: 2, 14: 2}.get(rate, 0)
    crc = 0
    for c in b[at:pos]:
        crc = _CRC8[crc ^ c]
    return (pos + 1, number, size, channels, FLAC_DEPTHS.get(code, depth)) if pos < len(b) and crc == b[pos] else None


class _Bits:
    """Bits of a value from byte ``at`` on; reading past the end is an IndexError."""

    def __init__(self, b: bytes, at: int):
        self.b, self.pos = b, 8 * at

    def take(self, n: int) -> int:
        first, last = self.pos >> 3, (self.pos + n + 7) >> 3
        if last > len(self.b):
            raise IndexError("past the end")
        value = int.from_bytes(self.b[first:last], "big") >> (8 * last - self.pos - n) & (1 << n) - 1
        self.pos += n
        return value

    def unary(self) -> int:
        n = 0
        while not self.take(1):
            n += 1
        return n


def _flac_frame(b: bytes, at: int, header: tuple[int, int, int, int, int]) -> int | None:
    """End of a frame, by reading through its subframes; its checksum confirmed."""
    pos, _, size, channels, depth = header
    bits = _Bits(b, pos)
    for channel in range(channels + 1 if channels < 8 else 2):
        width = depth + (channel == {8: 1, 9: 0, 10: 1}.get(channels, -1))
        if bits.take(1):
            return None
        kind = bits.take(6)
        if bits.take(1):
            width -= bits.unary() + 1
        if kind == 0:
            bits.pos += width
        elif kind == 1:
            bits.pos += width * size
        elif 8 <= kind <= 12 or kind >= 32:
            order = kind - 8 if kind < 32 else kind - 31
            bits.pos += width * order
            if kind >= 32:
                precision = bits.take(4) + 1
                bits.pos += 5 + precision * order
            method = bits.take(2)
            if method > 1:
                return None
            parts = 1 << bits.take(4)
            for part in range(parts):
                rice, escape = bits.take(4 + method), (15, 31)[method]
                n = size // parts - (order if part == 0 else 0)
                if rice == escape:
                    bits.pos += bits.take(5) * n
                else:
                    for _ in range(n):
                        bits.unary()
                        bits.pos += rice
        else:
            return None
    end = (bits.pos + 7) // 8 + 2
    crc = 0
    for c in b[at:end]:
        crc = (crc << 8 & 0xFFFF) ^ _CRC16[crc >> 8 ^ c]
    return end if end <= len(b) and not crc else None


def _flac(b: bytes, at: int) -> int | None:
    """Metadata blocks, then frames: each ends where the next of the sequence begins, the last where its subframes do."""
    pos, first, last, samples, depth = at + 4, True, False, 0, 16
    while not last:
        if pos + 4 > len(b):
            return None
        last, kind, n = bool(b[pos] & 0x80), b[pos] & 0x7F, int.from_bytes(b[pos + 1 : pos + 4], "big")
        if first and (kind or n != 34) or pos + 4 + n > len(b):
            return None
        if first:
            packed = int.from_bytes(b[pos + 14 : pos + 22], "big")
            samples, depth = packed & (1 << 36) - 1, (packed >> 36 & 31) + 1
        pos, first = pos + 4 + n, False
    done, header = 0, _flac_header(b, pos, depth)
    while header:
        done += header[2]
        step = header[2] if b[pos + 1] & 1 else 1  # frames count samples, or frames
        follows, found = pos + 1, None
        while not (samples and done >= samples) and found is None:
            follows = b.find(b[pos : pos + 2], follows + 1)
            if follows < 0:
                break
            found = _flac_header(b, follows, depth)
            found = found if found and found[1] == header[1] + step else None
        if found is None:
            end = _flac_frame(b, pos, header)
            return end - at if end and done >= samples else None
        pos, header = follows, found
    return pos - at if not samples else None


def _ogg(b: bytes, at: int) -> int | None:
    pos, done = at, False
    while b[pos : pos + 4] == b"OggS" and pos + 27 <= len(b) and not b[pos + 4] and not done:
        n = b[pos + 26]
        done = bool(b[pos + 5] & 4)
        pos += 27 + n + sum(b[pos + 27 : pos + 27 + n])
        if pos > len(b):
            return None
    return pos - at if done else None


# Fixed values of MPEG audio: kilobits a second by version and layer, samples a second by version.
MPEG_BITS = {
    (1, 1): (32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
MPEG_RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}


def _mpeg_frame(b: bytes, at: int) -> int | None:
    """Bytes of the frame whose header stands at ``at``."""
    if at + 4 > len(b) or b[at] != 0xFF or b[at + 1] & 0xE0 != 0xE0:
        return None
    version, layer, bits, rate = b[at + 1] >> 3 & 3, 4 - (b[at + 1] >> 1 & 3), b[at + 2] >> 4, b[at + 2] >> 2 & 3
    if version == 1 or layer == 4 or not 0 < bits < 15 or rate == 3:
        return None
    first = 1 if version == 3 else 2
    speed = MPEG_BITS[first, layer if first == 1 else min(layer, 2)][bits - 1] * 1000
    samples, padding = MPEG_RATES[version][rate], b[at + 2] >> 1 & 1
    if layer == 1:
        return (12 * speed // samples + padding) * 4
    return (144 if layer == 2 or first == 1 else 72) * speed // samples + padding


def _mpeg(b: bytes, at: int) -> int | None:
    """A tag, then frames; a last frame that the value cuts off reaches to its end."""
    if at + 10 > len(b) or b[at + 3] not in (2, 3, 4) or any(c & 0x80 for c in b[at + 6 : at + 10]):
        return None
    n = b[at + 6] << 21 | b[at + 7] << 14 | b[at + 8] << 7 | b[at + 9]
    begin = pos = at + 10 + n
    while (size := _mpeg_frame(b, pos)) is not None and pos < len(b):
        pos = min(pos + size, len(b))
    if pos == begin:
        return None
    return pos + 128 * (b[pos : pos + 3] == b"TAG" and pos + 128 <= len(b)) - at


def _mp4(b: bytes, at: int) -> int | None:
    pos, seen = at, set()
    while pos + 8 <= len(b):
        n, name = struct.unpack_from(">I4s", b, pos)
        if name not in (b"ftyp", b"moov", b"mdat", b"free", b"skip", b"moof", b"mfra", b"uuid", b"meta", b"styp", b"sidx"):
            break
        n = struct.unpack_from(">Q", b, pos + 8)[0] if n == 1 and pos + 16 <= len(b) else len(b) - pos if n == 0 else n
        if n < 8 or pos + n > len(b):
            return None
        seen.add(name)
        pos += n
    return pos - at if b"ftyp" in seen and seen & {b"moov", b"moof"} else None


VALIDATORS = {"image/png": _png, "image/jpeg": _jpeg, "image/gif": _gif, "image/bmp": _bmp, "image/tiff": _tiff, "application/pdf": _pdf, "application/zip": _zip, "application/gzip": _gzip, "audio/flac": _flac, "audio/ogg": _ogg, "audio/mpeg": _mpeg, "video/mp4": _mp4}


def validate(kind: str, b: bytes, at: int) -> tuple[str, int, int, int] | None:
    """(type, length, start and length of its raw samples) if the format holds at ``at``."""
    if kind == "audio/wav":
        return _riff(b, at)
    try:
        n = VALIDATORS[kind](b, at)
    except (struct.error, IndexError):
        return None
    return (kind, n, at, n) if n else None


def automaton():
    """All magic numbers in one Aho-Corasick automaton over Latin-1 text."""
    import ahocorasick

    found = ahocorasick.Automaton()
    for kind, magics in MAGIC.items():
        for magic in magics:
            found.add_word(magic.decode("latin-1"), (kind, len(magic) + MAGIC_AT.get(kind, 0)))
    found.make_automaton()
    return found


_AUTOMATON = None


def sniff_bytes(data: bytes | None, declared: str | None) -> dict:
    """The report on one value."""
    global _AUTOMATON
    if _AUTOMATON is None:
        _AUTOMATON = automaton()
    top, inner, candidates = None, [], 0
    if data:
        covered = 0
        hits = sorted((end + 1 - back, kind) for end, (kind, back) in _AUTOMATON.iter(data.decode("latin-1")))
        for at, kind in hits:
            candidates += 1
            if at < 0 or at and at < covered:
                continue
            if valid := validate(kind, data, at):
                if at == 0:
                    top = top or valid
                else:
                    inner.append({"offset": at, "length": valid[1], "type": valid[0]})
                    covered = at + valid[1]
    n = len(data or b"")
    return {
        "type": top[0] if top else declared,
        "confirmed": top is not None,
        "corrected": bool(top and top[0] != declared),
        "length": top[1] if top else n,
        "body_offset": top[2] if top else 0,
        "body_length": top[3] if top else n,
        "candidates": candidates,
        "embedded": inner,
    }


REPORT = pa.struct([("type", pa.string()), ("confirmed", pa.bool_()), ("corrected", pa.bool_()), ("length", pa.int64()), ("body_offset", pa.int64()), ("body_length", pa.int64()), ("candidates", pa.int64()), ("embedded", pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64()), ("type", pa.string())])))])
REPORT_DDL = "struct<type:string,confirmed:boolean,corrected:boolean,length:bigint,body_offset:bigint,body_length:bigint,candidates:bigint,embedded:array<struct<offset:bigint,length:bigint,type:string>>>"


def sniff(data: Column, declared: Column) -> Column:
    """Column of reports on binary values and their declared types."""

    @F.arrow_udf(REPORT_DDL)
    def report(values: pa.Array, types: pa.Array) -> pa.Array:
        return pa.array([sniff_bytes(v.as_py(), t.as_py()) for v, t in zip(values, types, strict=True)], REPORT)

    return report(data, declared)


def carve(df: DataFrame, data_col: str, report_col: str) -> DataFrame:
    """One row for each embedded medium: ``df``'s columns, and offset, type and bytes of the piece in ``carved``."""
    piece = F.explode(F.col(report_col)["embedded"])
    rows = df.select("*", piece.alias("carved"))
    part = F.substring(F.col(data_col), F.col("carved.offset").cast("int") + 1, F.col("carved.length").cast("int"))
    return rows.withColumn("carved", F.struct("carved.offset", "carved.type", part.alias("data")))


def _le32(n: Column) -> Column:
    h = F.lpad(F.hex(n), 8, "0")
    return F.unhex(F.concat(*[F.substring(h, i, 2) for i in (7, 5, 3, 1)]))


def wav_of(payload: Column) -> Column:
    """An 8-bit mono PCM WAV file whose samples are the payload's bytes (of even number)."""
    n = F.octet_length(payload).cast("long")
    fmt = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, 1, 8000, 8000, 1, 8)
    return F.concat(F.lit(b"RIFF"), _le32(n + 36), F.lit(b"WAVE" + fmt + b"data"), _le32(n), payload)


def padded(text: Column, unit: int = 64) -> Column:
    """UTF-8 bytes of a text (null: none), filled with bytes 0 to a positive multiple of ``unit``."""
    raw = F.coalesce(text.cast("binary"), F.lit(b""))
    n = F.octet_length(raw)
    gap = F.when(n == 0, F.lit(unit)).otherwise(F.pmod(-n, F.lit(unit)))
    zeros = F.unhex(F.repeat(F.lit("00"), gap))
    return F.concat(raw, zeros)
