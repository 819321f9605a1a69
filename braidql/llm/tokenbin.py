"""Token-id output in seekable zstandard files, and its reader.

``write_tokens`` deals documents by range of id, so that file after file holds
ascending ids, sorts inside each partition (Spark spills if it must), and
streams each partition into files of bounded size.  A file's name depends on
its partition and number alone and appears by a rename: a task that runs again after a lost executor
replaces it with equal content.  One manifest row a file goes through Spark;
ids never pass through the driver.

Defined results: a null or empty text has the end id alone; null ids come
first; rows that share an id stay separate, in order of their text's hash; an
empty table gives no file and no row.  Only the two named columns are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .framefile import FrameReader, FrameWriter
from .storage import open_fs, partitions_for, scratch
from .textops import column_bytes, slices

MANIFEST = "part long, path string, docs long, tokens long, bytes long"
DIGEST = "doc_id long, start long, n_tokens long, ids_crc32 long, part long, ordinal long"
FULL = "doc_id long, start long, n_tokens long, ids array<int>, part long, ordinal long"


#: A file is closed when it has this many ids.
FILE_IDS = 1 << 27


def _writer(path: str, tokenizer: str, end_id: int | None, width: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .storage import give_back, write_atomically
        from .tokens import encoder

        part, number = TaskContext.get().partitionId(), 0
        enc = encoder(tokenizer)

        def documents() -> Iterator[tuple[int | None, np.ndarray]]:
            for batch in slices(batches, "text"):
                ids, bounds = enc.encode(*column_bytes(batch.column("text")))
                for i, doc_id in enumerate(batch.column("doc_id").to_pylist()):
                    own = ids[bounds[i] : bounds[i + 1]]
                    yield doc_id, own if end_id is None else np.append(own, np.uint32(end_id))

        rows = documents()
        row, docs, tokens = next(rows, None), 0, 0

        def stream() -> Iterator[bytes]:
            nonlocal row, docs, tokens
            out = FrameWriter(width)
            while row is not None and tokens < FILE_IDS:
                yield from out.add(*row)
                docs, tokens = docs + 1, tokens + len(row[1])
                row = next(rows, None)
            yield from out.finish()

        while row is not None:
            name, docs, tokens = f"{path}/part-{part:06d}-{number:04d}.tokens", 0, 0
            size = write_atomically(name, stream())
            yield pa.RecordBatch.from_pydict({"part": pa.array([part << 16 | number], pa.int64()), "path": [name], "docs": [docs], "tokens": [tokens], "bytes": [size]})
            number += 1
        give_back()

    return write


def write_tokens(df: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int | None = 2, width: int = 2, partitions: int | None = None) -> DataFrame:
    """Write ``df`` as token files below ``path``; the manifest, a row for each file.

    ``width``: bytes of an id, 2 while all ids are below 65536.
    """
    from .tokens import default_tokenizer

    spark = df.sparkSession
    path = path or scratch(spark, "tokens")
    partitions = partitions or partitions_for(df)
    rows = (
        df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
        .withColumns({"tie": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
        .repartitionByRange(partitions, "doc_id", "tie", "row")
        .sortWithinPartitions("doc_id", "tie", "row")
        .select("doc_id", "text")
    )
    rows.mapInArrow(_writer(path, tokenizer or default_tokenizer(), end_id, width), MANIFEST).write.parquet(f"{path}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{path}/manifest")


def _read(batches: Iterator[pa.RecordBatch], full: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            fs, path = open_fs(row["path"])
            with fs.open_input_file(path) as source:
                reader, start, at = FrameReader(source), row["base"], 0
                while at < len(reader):
                    rows: dict[str, list] = {k: [] for k in ("doc_id", "start", "n_tokens", "ids" if full else "ids_crc32", "part", "ordinal")}
                    held = 0
                    while at < len(reader) and held < 1 << 20 and len(rows["part"]) < 10_000:
                        n, crc, ids = 0, 0, []
                        for chunk in reader.ids(at):
                            n += len(chunk)
                            if full:
                                ids.append(chunk)
                            else:
                                crc = zlib.crc32(chunk.astype("<u4").tobytes(), crc)
                        if n != reader.sizes[at]:
                            raise ValueError(f"{row['path']}: document {at} has {n} ids, its index says {reader.sizes[at]}")
                        rows["doc_id"].append(None if reader.null[at] else int(reader.doc_ids[at]))
                        rows["start"].append(start)
                        rows["n_tokens"].append(n)
                        rows["ids" if full else "ids_crc32"].append(np.concatenate(ids).astype(np.int32) if full and ids else [] if full else crc)
                        rows["part"].append(row["part"])
                        rows["ordinal"].append(at)
                        start, at, held = start + n, at + 1, held + n * full
                    types = {"doc_id": pa.int64(), "start": pa.int64(), "n_tokens": pa.int64(), "ids": pa.list_(pa.int32()), "ids_crc32": pa.int64(), "part": pa.int64(), "ordinal": pa.int64()}
                    yield pa.RecordBatch.from_arrays([pa.array(v, types[k]) for k, v in rows.items()], list(rows))


def read_tokens(manifest: DataFrame, full: bool = True) -> DataFrame:
    """Documents of the files that ``manifest`` lists.

    ``start`` counts the ids of all documents before.  ``full``: with the ids
    themselves; else with their CRC-32 as little-endian 32-bit integers.
    """
    files = manifest.select("part", "path", F.coalesce(F.sum("tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long").alias("base"))
    files = files.repartition(max(1, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    return files.mapInArrow(lambda it: _read(it, full), FULL if full else DIGEST)


def read_documents(spark: SparkSession, path: str, doc_ids: list[int]) -> list[tuple[int, np.ndarray]]:
    """Look up single documents: only their frames are read and decompressed."""
    found = []
    for row in spark.read.parquet(f"{path}/manifest").orderBy("part").toLocalIterator():
        fs, where = open_fs(row["path"])
        with fs.open_input_file(where) as source:
            reader = FrameReader(source)
            found += [(int(reader.doc_ids[i]), np.concatenate(list(reader.ids(i)))) for i in reader.find(doc_ids) if reader.first[i] < reader.first[i + 1]]
    return found
