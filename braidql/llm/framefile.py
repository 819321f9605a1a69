"""A seekable file of token ids.

Layout, all integers little-endian:

* one or more zstandard frames for each document, each independent of the
  others and carrying its own content checksum;
* a skippable frame (magic 0x184D2A50) with the document index;
* a skippable frame (magic 0x184D2A5E) with the seek table of the published
  zstandard seekable format: for each frame compressed size, decompressed
  size and the low 32 bits of its XXH64, then the frame count, a descriptor
  and the magic 0x8F92EAB1.

A reader opens the end of the file, and then decompresses the frames of the
documents it wants and nothing else.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator

import numpy as np
import xxhash
import zstandard

# Fixed values of the published formats.
SKIPPABLE_INDEX = 0x184D2A50
SKIPPABLE_SEEK = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
CHECKSUM_FLAG = 0x80

INDEX_MAGIC = b"BQIX"
#: Ids in a frame at most, so that a reader's memory is bounded.
FRAME_IDS = 1 << 20


def _ids_bytes(ids: np.ndarray, width: int) -> bytes:
    return ids.astype("<u2" if width == 2 else "<u4").tobytes()


class FrameWriter:
    """Turns documents into the bytes of one file, piece by piece."""

    def __init__(self, width: int, level: int = 3):
        self.width = width
        self.compressor = zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True)
        self.frames: list[tuple[int, int, int]] = []
        self.docs: list[tuple[int | None, int, int]] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> Iterator[bytes]:
        """Frames of one document; an empty one has none."""
        n = 0
        for i in range(0, len(ids), FRAME_IDS):
            data = _ids_bytes(ids[i : i + FRAME_IDS], self.width)
            frame = self.compressor.compress(data)
            self.frames.append((len(frame), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF))
            n += 1
            yield frame
        self.docs.append((doc_id, len(ids), n))

    def finish(self) -> Iterator[bytes]:
        ids = np.array([d or 0 for d, _, _ in self.docs], "<i8")
        null = np.array([d is None for d, _, _ in self.docs], "u1")
        sizes = np.array([n for _, n, _ in self.docs], "<i8")
        frames = np.array([f for _, _, f in self.docs], "<u4")
        body = INDEX_MAGIC + struct.pack("<BQ", self.width, len(ids)) + ids.tobytes() + null.tobytes() + sizes.tobytes() + frames.tobytes()
        body += struct.pack("<Q", xxhash.xxh64_intdigest(body))
        yield struct.pack("<II", SKIPPABLE_INDEX, len(body)) + body
        table = np.array(self.frames, "<u4").reshape(-1, 3).tobytes()
        tail = table + struct.pack("<IBI", len(self.frames), CHECKSUM_FLAG, SEEKABLE_MAGIC)
        yield struct.pack("<II", SKIPPABLE_SEEK, len(tail)) + tail


class FrameReader:
    """Random access to a file that ``FrameWriter`` made.  ``source`` can seek and read."""

    def __init__(self, source):
        self.source = source
        end = source.seek(0, 2)
        source.seek(end - 9)
        count, flags, magic = struct.unpack("<IBI", source.read(9))
        if magic != SEEKABLE_MAGIC or not flags & CHECKSUM_FLAG:
            raise ValueError("not a seekable token file")
        table_at = end - 9 - 12 * count - 8
        source.seek(table_at)
        kind, size = struct.unpack("<II", source.read(8))
        if kind != SKIPPABLE_SEEK or size != 12 * count + 9:
            raise ValueError("damaged seek table")
        self.table = np.frombuffer(source.read(12 * count), "<u4").reshape(-1, 3).astype(np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(self.table[:, 0])])
        source.seek(int(self.offsets[-1]))
        kind, size = struct.unpack("<II", source.read(8))
        body = source.read(size)
        if kind != SKIPPABLE_INDEX or body[:4] != INDEX_MAGIC or struct.unpack("<Q", body[-8:])[0] != xxhash.xxh64_intdigest(body[:-8]):
            raise ValueError("damaged document index")
        self.width, n = struct.unpack("<BQ", body[4:13])
        at = 13
        self.doc_ids = np.frombuffer(body, "<i8", n, at)
        self.null = np.frombuffer(body, "u1", n, at + 8 * n).astype(bool)
        self.sizes = np.frombuffer(body, "<i8", n, at + 9 * n)
        frames = np.frombuffer(body, "<u4", n, at + 17 * n).astype(np.int64)
        self.first = np.concatenate([[0], np.cumsum(frames)])
        self.decompressor = zstandard.ZstdDecompressor()

    def __len__(self) -> int:
        return len(self.doc_ids)

    def ids(self, i: int) -> Iterator[np.ndarray]:
        """The ids of the ``i``-th document, frame by frame, checksums verified."""
        for f in range(self.first[i], self.first[i + 1]):
            self.source.seek(int(self.offsets[f]))
            data = self.decompressor.decompress(self.source.read(int(self.table[f, 0])), int(self.table[f, 1]))
            if xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != self.table[f, 2]:
                raise ValueError(f"checksum of frame {f} does not match")
            yield np.frombuffer(data, "<u2" if self.width == 2 else "<u4")

    def find(self, doc_ids: Iterable[int]) -> np.ndarray:
        """Places of the documents with these ids, in file order."""
        return np.flatnonzero(np.isin(self.doc_ids, list(doc_ids)) & ~self.null)
