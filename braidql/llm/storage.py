"""Shared working folders.

Everything an operator cuts its lineage with lives below
``spark.checkpoint.dir``: that folder is readable by the driver and by every
executor, so a lost executor never takes intermediate results with it.
"""

from __future__ import annotations

import ctypes
import gc
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_OWN: dict[str, str] = {}
RELEASE_SECONDS = 5
_released = [0.0]


def shared_root(spark: SparkSession) -> str:
    """The folder all executors share; a temporary one only in local mode."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if root:
        return root.rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if sc.applicationId not in _OWN:
        _OWN[sc.applicationId] = "file://" + tempfile.mkdtemp(prefix="braidql-")
        sc.setCheckpointDir(_OWN[sc.applicationId])
    return _OWN[sc.applicationId]


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; nothing is created yet."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and return a scan of it.

    One pass and columnar, where ``checkpoint()`` computes its input twice.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    release(spark)
    return spark.read.schema(spark.read.parquet(path).schema).parquet(path)


def keep(df: DataFrame, name: str, step: Callable | None = None, schema: str | None = None) -> DataFrame:
    """``materialize`` with Python workers as writers, for the many tables of one operator.

    For each file of Spark's writers, Hadoop's local file system starts
    ``chmod`` three times.  A child that is being started shares its parent's
    memory, so that an executor is seen to take twice what it has.  Columns of
    other than plain types go through Spark's writer.

    With ``step``, what it makes of the rows (as for ``mapInArrow``, of type
    ``schema``) is written, by the same workers.
    """
    kind = T.StructType.fromDDL(schema) if schema else df.schema
    if not all(plain(f.dataType) for f in kind):
        return materialize(df.mapInArrow(step, kind) if step else df, name)
    spark = df.sparkSession
    path = scratch(spark, name)
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(folder)
    df.mapInArrow(_part_of(path, step), "done boolean").write.format("noop").mode("overwrite").save()
    release(spark)
    return spark.read.schema(kind).parquet(path)


def plain(kind: T.DataType) -> bool:
    """Whether Arrow's Parquet files hold this type as Spark's do."""
    if isinstance(kind, T.ArrayType):
        return plain(kind.elementType)
    return kind in (T.StringType(), T.BinaryType(), T.BooleanType(), T.ByteType(), T.ShortType(), T.IntegerType(), T.LongType(), T.FloatType(), T.DoubleType())


def _part_of(path: str, step: Callable | None):
    """Writes a task's rows to one file, which appears by a rename; none for no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = open_fs(path)
        part = f"part-{TaskContext.get().partitionId():05d}.parquet"
        temporary = f"{folder}/.{part}.{uuid.uuid4().hex}.tmp"
        out = writer = None
        for rows in _groups(step(batches) if step else batches):
            if writer is None:
                out = fs.open_output_stream(temporary)
                writer = pq.ParquetWriter(out, rows.schema, compression="zstd")
            writer.write_table(rows)
        if writer is not None:
            writer.close()
            out.close()
            fs.move(temporary, f"{folder}/{part}")
        give_back()
        yield from ()

    return run


def give_back() -> None:
    """Return a worker's free memory to the system: idle workers live on beside those of the next stage."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def _groups(batches: Iterator[pa.RecordBatch], most: int = 16 << 20) -> Iterator[pa.Table]:
    """The batches put together to row groups of about ``most`` bytes."""
    held, size = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.nbytes
        if size >= most:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def release(spark: SparkSession) -> None:
    """Have the shuffle files of finished queries deleted, every few seconds at most.

    Spark deletes them when the driver's garbage is collected.  A driver that
    only hands out tasks makes little of it, and would keep all of a run's.
    """
    if time.monotonic() - _released[0] >= RELEASE_SECONDS:
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        _released[0] = time.monotonic()


def discard(spark: SparkSession, *frames: DataFrame) -> None:
    """Delete the folders of materialized frames that nothing reads any more."""
    for frame in frames:
        for name in {f.rsplit("/", 1)[0] for f in frame.inputFiles()}:
            if name.startswith(shared_root(spark)) or name.removeprefix("file://").startswith(shared_root(spark).removeprefix("file://")):
                remove(spark, name)


def remove(spark: SparkSession, uri: str) -> None:
    """Delete a folder of the shared ones."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def partitions_for(df: DataFrame, each: int = 256 << 20) -> int:
    """How many partitions to deal ``df`` into: as configured, or more where the planner expects over ``each`` bytes in one."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    expected = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(least, -(-expected // each)) if expected < 1 << 54 else least  # more: the planner does not know


def open_fs(uri: str):
    """(filesystem, path) of pyarrow for a URI that executors can write to."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:") and not uri.startswith("file://"):
        return fs.LocalFileSystem(), uri[len("file:") :]
    return fs.FileSystem.from_uri(uri)


def read_whole(uri: str):
    """The bytes of a file, as a buffer of pyarrow."""
    fs, path = open_fs(uri)
    with fs.open_input_file(path) as source:
        return source.read_buffer()


def write_atomically(uri: str, parts) -> int:
    """Write an iterable of byte strings to ``uri`` through a rename.

    A task that is retried or run twice writes the same final name, so readers
    see one complete file whatever happens to executors.  Returns the size.
    """
    fs, path = open_fs(uri)
    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
    temporary = f"{path}.{uuid.uuid4().hex}.tmp"
    size = 0
    with fs.open_output_stream(temporary) as out:
        for part in parts:
            out.write(part)
            size += len(part)
    fs.move(temporary, path)
    return size
