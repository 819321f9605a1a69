"""Reading and writing files and the commands built on it.

Formats that Spark knows are scans with its push-down.  Arrow, Excel and JSON5
have no Spark source: their files are read in the executors, one file a task,
except Excel, which is a driver-side convenience for small sheets.
"""

from __future__ import annotations

import io
import json
import re
import tempfile
import uuid
from collections.abc import Iterator, Sequence
from typing import Any
from urllib.parse import urlparse

import pyarrow as pa
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import basic
from ..operators.joins import Keys, Options, join
from . import formats
from .formats import Format

#: Options of the language and what Spark calls them.
READ_OPTIONS = {
    "separator": "sep", "has_header": "header", "quote_char": "quote", "comment_char": "comment", "null_values": "nullValue", "encoding": "encoding",
    "infer_schema": "inferSchema", "parse_dates": "inferSchema", "trim_whitespace": "ignoreLeadingWhiteSpace",
}
WRITE_OPTIONS = {"separator": "sep", "has_header": "header", "quote_char": "quote", "null_value": "nullValue", "date_format": "dateFormat", "timestamp_format": "timestampFormat", "line_terminator": "lineSep", "quote_all": "quoteAll"}
QUOTE_STYLES = ("necessary", "always", "non_numeric", "never")


def _q(name: str) -> Column:
    return F.col(f"`{name}`")


def resolve(path: str) -> str:
    """A path that Spark can open; hf:// names a file of a published dataset."""
    if path.startswith("hf://datasets/"):
        owner, name, *rest = path[len("hf://datasets/") :].split("/")
        return f"https://huggingface.co/datasets/{owner}/{name}/resolve/main/{'/'.join(rest)}"
    return path


def _head(spark: SparkSession, path: str, n: int = 8192) -> bytes:
    """The first bytes of a file (or of the first file of a folder), through Spark's file systems."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.getFileStatus(at).isDirectory():
        inner = [s.getPath() for s in fs.listStatus(at) if not s.getPath().getName().startswith(("_", "."))]
        if not inner:
            return b""
        at = inner[0]
    stream = fs.open(at)
    try:
        return bytes(stream.readNBytes(n))
    finally:
        stream.close()


def sniff(spark: SparkSession, path: str) -> Format:
    """The format of a file: by its ending, else by its content."""
    found = formats.format_of(path) or formats.format_of_bytes(_head(spark, path))
    if found is None:
        raise ValueError(f"cannot tell the format of {path}")
    return found


def load(spark: SparkSession, path: str | Sequence[str], format: str | None = None, schema: str | T.StructType | None = None, columns: Sequence[str] | None = None, max_rows: int | None = None, skip_rows: int = 0, **options: Any) -> DataFrame:
    """Read files.  Several paths are one table with the columns of all."""
    if not isinstance(path, str):
        return basic.union_all([load(spark, p, format, schema, columns, max_rows, skip_rows, **options) for p in path])
    path = resolve(path)
    if urlparse(path).scheme in ("http", "https"):
        spark.sparkContext.addFile(path)
        from pyspark import SparkFiles

        path = "file://" + SparkFiles.get(path.rsplit("/", 1)[-1].split("?")[0])
    kind = formats.by_name(format) if format else sniff(spark, path)
    shape = {k: options.pop(k) for k in ("flatten", "flatten_separator", "max_depth") if k in options}
    df = _read(spark, path, kind, schema, options)
    if shape.pop("flatten", False):
        df = flatten(df, shape.get("flatten_separator", "."), shape.get("max_depth"))
    if skip_rows:
        df = basic.skip(df, skip_rows) if max_rows is None else df.offset(skip_rows)
    if columns:
        df = basic.select(df, columns)
    return df.limit(max_rows) if max_rows is not None else df


def _read(spark: SparkSession, path: str, kind: Format, schema: Any, options: dict[str, Any]) -> DataFrame:
    if kind.name == "arrow":
        return _read_arrow(spark, path)
    if kind.name == "json5":
        return _read_json5(spark, path, schema)
    if kind.name == "excel":
        return _read_excel(spark, path, options)
    if kind.options.get("multiLine") and kind.source == "json":
        head = _head(spark, path)
        if formats.is_lines(head):
            kind = formats.FORMATS["jsonlines"]
        elif schema is None and not options and re.match(rb"\[\s*\n\s*\{", head):
            rows = _array_lines(spark, path)
            if rows is not None:
                return rows
    reader = spark.read.format(kind.source)
    ignore = options.pop("ignore_errors", False)
    if kind.name in ("csv", "tsv", "adt") and options.pop("detect_separator", False):
        options["sep"] = formats.separator_of(_head(spark, path).decode("utf-8", "replace"))
    for name, value in (kind.options | options).items():
        reader = reader.option(READ_OPTIONS.get(name, name), value)
    if ignore:
        reader = reader.option("mode", "DROPMALFORMED")
    return (reader.schema(schema) if schema else reader).load(path)


def flatten(df: DataFrame, separator: str = ".", max_depth: int | None = None) -> DataFrame:
    """Fields of objects as columns of the table, named by their paths.

    ``max_depth`` is how many levels are opened (None: all); lists stay.  A null
    object gives null fields, an object without fields stays as it is.  Paths
    that meet in one name are an error.
    """

    def fields(col: Column, name: str, kind: T.DataType, left: float) -> Iterator[Column]:
        if isinstance(kind, T.StructType) and kind.fields and left > 0:
            for f in kind.fields:
                yield from fields(col.getField(f.name), f"{name}{separator}{f.name}", f.dataType, left - 1)
        else:
            names.append(name)
            yield col.alias(name)

    names: list[str] = []
    levels = float("inf") if max_depth is None else max_depth
    columns = [c for f in df.schema.fields for c in fields(_q(f.name), f.name, f.dataType, levels)]
    twice = sorted({n for n in names if names.count(n) > 1})
    if twice:
        raise ValueError(f"flattened names meet: {', '.join(twice)}")
    return df.select(columns)


def _array_lines(spark: SparkSession, path: str) -> DataFrame | None:
    """A file with one JSON array, whole elements on every line, read in as many tasks as any text; None if its lines are otherwise."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory():
        return None
    line = F.btrim("value", F.lit(" \t\r"))
    lines = spark.read.text(path).select(line.alias("line")).filter("line != ''")
    element, commas = ~F.col("line").isin("[", "]"), F.col("line").startswith(",").cast("int") + F.col("line").endswith(",").cast("int")
    n, between, opened, closed = lines.agg(F.count_if(element), F.sum(F.when(element, commas)), F.count_if(F.col("line") == "["), F.count_if(F.col("line") == "]")).first()
    if not n or between != n - 1 or (opened, closed) != (1, 1):
        return None
    # As arrays, lines that begin or end within an element are malformed, and those of several elements give all of them.
    arrays = lines.filter(element).select(F.concat(F.lit("["), F.regexp_replace("line", "^,|,$", ""), F.lit("]")))
    texts = getattr(arrays._jdf, "as")(spark._jvm.org.apache.spark.sql.Encoders.STRING())
    try:
        return DataFrame(spark._jsparkSession.read().option("mode", "FAILFAST").json(texts), spark)  # parses all to know the schema
    except PySparkException:
        return None


def _read_arrow(spark: SparkSession, path: str) -> DataFrame:
    """Arrow files, opened by the tasks that read them; the schema comes from the first one."""
    from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema

    files = spark.read.format("binaryFile").load(path)
    first = files.select("content").first()
    if first is None:
        raise ValueError(f"no Arrow file at {path}")
    schema = from_arrow_schema(_open_arrow(bytes(first.content)).schema)
    target = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                for part in _open_arrow(content.as_py()).cast(target).to_batches():
                    yield part

    return files.select("content").mapInArrow(run, schema)


def _open_arrow(content: bytes) -> pa.Table:
    try:
        return pa.ipc.open_file(io.BytesIO(content)).read_all()
    except pa.ArrowInvalid:
        return pa.ipc.open_stream(io.BytesIO(content)).read_all()


def _read_json5(spark: SparkSession, path: str, schema: Any) -> DataFrame:
    files = spark.read.format("binaryFile").load(path).select(F.col("content").cast("string").alias("text"))

    @F.arrow_udf("string")
    def plain(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else json.dumps(json.loads(formats.json5_to_json(t))) for t in texts.to_pylist()], pa.string())

    rows = files.select(plain("text").alias("value"))
    kind = schema or spark.range(1).select(F.schema_of_json(F.lit(rows.first().value))).first()[0]
    parsed = rows.select(F.from_json("value", kind).alias("x"))
    inner = parsed.schema["x"].dataType
    return parsed.select(F.inline("x")) if isinstance(inner, T.ArrayType) else parsed.select("x.*")


def _read_excel(spark: SparkSession, path: str, options: dict[str, Any]) -> DataFrame:
    try:
        import openpyxl  # noqa: F401
    except ImportError as e:
        raise ValueError("reading Excel needs the openpyxl library") from e
    import pandas as pd

    return spark.createDataFrame(pd.read_excel(path, **options))


def save(df: DataFrame, path: str, format: str | None = None, mode: str = "errorifexists", single: bool = False, **options: Any) -> None:
    """Write a table: a folder of part files, or with ``single`` one file for small results."""
    kind = formats.by_name(format) if format else formats.format_of(path) or formats.FORMATS["csv"]
    if not kind.writes:
        raise ValueError(f"{kind.name} cannot be written")
    if kind.name in ("arrow", "excel"):
        return _save_local(df, path, kind)
    if kind.name in ("csv", "tsv"):
        df = _csv_values(df, options)
    if kind.source == "json":
        df = _json_values(df, options)
    if single and kind.name in ("json", "jsoncompact"):
        return _save_array(df, path, mode, options)
    df = df.coalesce(1) if single else df
    writer = df.write.format(kind.source).mode(mode)
    defaults = {k: v for k, v in kind.options.items() if k not in ("inferSchema", "multiLine")}
    if kind.name == "adt":
        df = df.select(*[F.col(f"`{c}`").cast("string") for c in df.columns])
        writer = df.write.format("csv").mode(mode)
        defaults["quote"] = "\0"
        defaults["emptyValue"] = ""
    if options.get("escape_unicode"):
        writer, options, defaults = _json_rows(df, options).write.format("text").mode(mode), {}, {}
    for name, value in (defaults | options).items():
        writer = writer.option(WRITE_OPTIONS.get(name, name), value)
    if not single:
        writer.save(path)
        return None
    folder = f"{path}.{tempfile.gettempprefix()}{abs(hash(path)) % 10**8}"
    writer.save(folder)
    return _keep_one_file(df.sparkSession, folder, path, mode)


def _csv_values(df: DataFrame, options: dict[str, Any]) -> DataFrame:
    """Takes ``quote_style`` and ``float_precision`` out of the options of a CSV writer.

    ``necessary`` quotes what would be read wrongly, ``always`` everything,
    ``never`` nothing, so that text which holds a separator is an error, not a
    broken file.  ``non_numeric`` is refused: Spark's writer quotes by content.
    ``float_precision`` is the number of decimals of floating columns.
    """
    style = options.pop("quote_style", "necessary")
    if style not in QUOTE_STYLES or style == "non_numeric":
        raise ValueError(f"no quote style {style!r}")
    if style == "always":
        options["quote_all"] = True
    elif style == "never":
        options["quote"] = "\0"
        unsafe = "[" + re.escape(options.get("separator", options.get("sep", ","))) + "\r\n]"
        for f in df.schema.fields:
            if isinstance(f.dataType, T.StringType):
                col = _q(f.name)
                broken = F.raise_error(F.lit(f"column {f.name} holds a separator and is not quoted")).cast("string")
                df = df.withColumn(f.name, F.when(col.rlike(unsafe), broken).otherwise(col))
    digits = options.pop("float_precision", None)
    if digits is not None:
        for f in df.schema.fields:
            if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
                col = _q(f.name)
                finite = ~F.isnan(col) & (F.abs(col) != float("inf"))
                df = df.withColumn(f.name, F.when(finite, F.format_string(f"%.{int(digits)}f", col.cast("double"))).otherwise(col.cast("string")))
    return df


def _json_values(df: DataFrame, options: dict[str, Any]) -> DataFrame:
    """Takes ``flatten`` and ``include_nulls`` out of the options of a JSON writer; ``escape_unicode`` is for its rows."""
    shape = {k: options.pop(k) for k in ("flatten", "flatten_separator", "max_depth") if k in options}
    if "include_nulls" in options:
        options["ignoreNullFields"] = not options.pop("include_nulls")
    return flatten(df, shape.get("flatten_separator", "."), shape.get("max_depth")) if shape.get("flatten") else df


def _json_rows(df: DataFrame, options: dict[str, Any]) -> DataFrame:
    """Each row as one JSON text; with ``escape_unicode`` in ASCII, beyond it as escaped UTF-16 units."""
    options = dict(options)
    escape = options.pop("escape_unicode", False)
    row = F.to_json(F.struct("*"), {k: str(v).lower() if isinstance(v, bool) else str(v) for k, v in options.items()})
    if escape:
        units = lambda c: F.regexp_replace(F.lower(F.hex(F.encode(c, "UTF-16BE"))), "(.{4})", r"\\u$1")
        row = F.array_join(F.transform(F.regexp_extract_all(row, F.lit(r"[\x00-\x7f]+|."), F.lit(0)), lambda c: F.when(c.rlike(r"^[\x00-\x7f]"), c).otherwise(units(c))), "")
    return df.select(row.alias("value"))


def _keep_one_file(spark: SparkSession, folder: str, path: str, mode: str) -> None:
    """The only part file of a folder takes the folder's place."""
    jvm = spark._jvm
    at, to = jvm.org.apache.hadoop.fs.Path(folder), jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    part = next(s.getPath() for s in fs.listStatus(at) if s.getPath().getName().startswith("part-"))
    if fs.exists(to):
        if mode == "errorifexists":
            fs.delete(at, True)
            raise FileExistsError(path)
        fs.delete(to, True)
    fs.rename(part, to)
    fs.delete(at, True)


def _save_array(df: DataFrame, path: str, mode: str, options: dict[str, Any]) -> None:
    """One JSON array: its rows are written by the tasks that have them, and the files joined byte by byte."""
    spark = df.sparkSession
    jvm = spark._jvm
    to, folder = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    conf = spark._jsc.hadoopConfiguration()
    fs = to.getFileSystem(conf)
    if mode == "errorifexists" and fs.exists(to):
        raise FileExistsError(path)
    rows = _json_rows(df, options)
    rows.select(F.concat(F.lit(","), "value").alias("value")).write.option("compression", "none").text(folder.toString())
    try:
        stream = fs.create(to, True)
        try:
            first = True
            for part in sorted((s for s in fs.listStatus(folder) if s.getPath().getName().startswith("part-") and s.getLen()), key=lambda s: s.getPath().getName()):
                source = fs.open(part.getPath())
                if first:
                    stream.write(bytearray(b"[\n"))
                    source.seek(1)  # the comma of the first row
                    first = False
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, stream, conf, False)
                source.close()
            stream.write(bytearray(b"[]\n" if first else b"]\n"))
        finally:
            stream.close()
    finally:
        fs.delete(folder, True)


def _save_local(df: DataFrame, path: str, kind: Format) -> None:
    """Arrow and Excel files are written by the driver, for results that fit it."""
    table = df.toArrow()
    if kind.name == "arrow":
        with pa.OSFile(path.removeprefix("file://"), "wb") as sink, pa.ipc.new_file(sink, table.schema) as writer:
            writer.write_table(table)
        return
    try:
        import openpyxl  # noqa: F401
    except ImportError as e:
        raise ValueError("writing Excel needs the openpyxl library") from e
    table.to_pandas().to_excel(path, index=False)


def convert(spark: SparkSession, source: str, target: str, read: dict[str, Any] | None = None, write: dict[str, Any] | None = None) -> None:
    save(load(spark, source, **(read or {})), target, **(write or {}))


def inspect(spark: SparkSession, path: str, sample: int = 0, stats: bool = False, **options: Any) -> dict[str, Any]:
    """Format, schema, rows, and if asked for a sample and statistics."""
    df = load(spark, path, **options)
    found: dict[str, Any] = {"path": path, "format": sniff(spark, path).name, "columns": dict(df.dtypes), "rows": df.count()}
    if sample:
        found["sample"] = [r.asDict(True) for r in df.limit(sample).collect()]
    if stats:
        found["stats"] = basic.describe(df).first().asDict()
    return found


def validate(df: DataFrame, schema: dict[str, str] | None = None, check_duplicates: bool = False, check_nulls: Sequence[str] | bool = False) -> list[str]:
    """What is wrong with a table; an empty list if nothing is.  One pass for nulls, one for duplicates."""
    problems = []
    own = dict(df.dtypes)
    for name, kind in (schema or {}).items():
        want = T._parse_datatype_string(basic.CASTS.get(kind.lower(), kind)).simpleString()
        if name not in own:
            problems.append(f"column {name} is missing")
        elif own[name] != want:
            problems.append(f"column {name} is {own[name]}, not {want}")
    problems += [f"column {c} is not in the schema" for c in own if schema and c not in schema]
    if check_nulls:
        names = [c for c in (df.columns if check_nulls is True else check_nulls) if c in own]
        counts = df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in names]).first()
        problems += [f"column {c} has {counts[c]} nulls" for c in names if counts[c]]
    if check_duplicates:
        extra = df.groupBy(*[F.col(f"`{c}`") for c in df.columns]).count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0))).first()[0]
        if extra:
            problems.append(f"{extra} rows repeat others")
    return problems


def merge(frames: Sequence[DataFrame], method: str = "concat", on: Sequence[str] = (), how: str = "inner") -> DataFrame:
    """Tables one below the other, or joined one after the other."""
    if method == "concat":
        return basic.union_all(frames, missing=True)
    if method != "join" or not on:
        raise ValueError("merge takes concat, or join with keys")
    out = frames[0]
    for i, other in enumerate(frames[1:], 1):
        out = join(out, other, Keys.on(*on), Options(how=how, suffix=f"_right_{i}"))
    return out
