"""Projection, filter, sort, limit, reshape: verbs over whole frames."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Names of cast targets, with Spark's type for each.
CASTS = {
    "int8": "tinyint", "i8": "tinyint", "int16": "smallint", "i16": "smallint", "int32": "int", "i32": "int", "int64": "bigint", "i64": "bigint", "int": "bigint", "integer": "bigint",
    "uint8": "smallint", "u8": "smallint", "uint16": "int", "u16": "int", "uint32": "bigint", "u32": "bigint", "uint64": "decimal(20,0)", "u64": "decimal(20,0)",
    "float32": "float", "f32": "float", "float64": "double", "f64": "double", "float": "double", "double": "double",
    "string": "string", "str": "string", "utf8": "string", "boolean": "boolean", "bool": "boolean", "date": "date", "datetime": "timestamp", "timestamp": "timestamp", "time": "string",
}
ROW = "__row"
PLACE = "__place"


def ddl_of(name: str) -> str:
    """Spark's type for a type name."""
    if name.lower() not in CASTS:
        raise ValueError(f"no type {name!r}")
    return CASTS[name.lower()]


@dataclass(frozen=True)
class SortKey:
    column: str
    descending: bool = False

    def spark(self) -> Column:
        c = F.col(f"`{self.column}`")
        return c.desc_nulls_last() if self.descending else c.asc_nulls_first()


def asc(column: str) -> SortKey:
    return SortKey(column)


def desc(column: str) -> SortKey:
    return SortKey(column, True)


def _check(df: DataFrame, columns: Sequence[str]) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"no column {', '.join(missing)}")


def _q(name: str) -> Column:
    return F.col(f"`{name}`")


def select(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    _check(df, columns)
    return df.select(*[_q(c) for c in columns])


def select_by_index(df: DataFrame, indices: Sequence[int]) -> DataFrame:
    return df.select(*[_q(df.columns[i]) for i in indices])


def filter_rows(df: DataFrame, condition: Column | str) -> DataFrame:
    """Rows where a condition (or the truth of a column) holds."""
    if isinstance(condition, str) and condition in df.columns:
        from ..functions.registry import Typed, truthy

        return df.filter(truthy(Typed(_q(condition), df.schema[condition].dataType)))
    return df.filter(condition)


def filter_values(df: DataFrame, test: Callable) -> DataFrame:
    """Rows for which a Python function of a pandas frame gives true; Arrow batches."""

    def run(batches):
        for batch in batches:
            yield batch[test(batch)]

    return df.mapInPandas(run, df.schema)


def sort(df: DataFrame, keys: Sequence[SortKey | str], descending: Sequence[bool] | None = None) -> DataFrame:
    flags = descending or [False] * len(keys)
    return df.orderBy(*[(k if isinstance(k, SortKey) else SortKey(k, d)).spark() for k, d in zip(keys, flags, strict=True)])


def numbered(df: DataFrame) -> DataFrame:
    return df.withColumn(ROW, F.monotonically_increasing_id())


def head(df: DataFrame, n: int = 5) -> DataFrame:
    return df.limit(n)


limit = head


def tail(df: DataFrame, n: int = 5) -> DataFrame:
    """The last rows in the order of input, by a top-k over the row number."""
    return numbered(df).orderBy(F.desc(ROW)).limit(n).orderBy(ROW).drop(ROW)


def stable(df: DataFrame) -> DataFrame:
    """A frame whose rows lie in the same partitions however often it is read.

    Scans and what follows them row by row are so already; behind a shuffle the
    rows are written to the folder that ``spark.checkpoint.dir`` names.
    """
    if "Exchange" not in df._jdf.queryExecution().executedPlan().toString():
        return df
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        root = sc.getConf().get("spark.checkpoint.dir")
        if not root and (not sc.master.startswith("local") or sc.master.startswith("local-cluster")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(root or "file://" + tempfile.mkdtemp(prefix="braidql-"))
    return df.checkpoint()


def placed(df: DataFrame, name: str = PLACE) -> DataFrame:
    """With the place of each row in the order of input, from 0.

    Rows are counted by partition first, so no task sees them all; only those
    counts, one for each partition, come together.
    """
    row = F.monotonically_increasing_id()
    tagged = stable(df).withColumns({"__part": F.shiftright(row, 33), name: row.bitwiseAND(F.lit((1 << 33) - 1))})
    earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    counts = tagged.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = counts.select(F.col("__part").alias("__of"), F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    found = tagged.join(F.broadcast(before), F.col("__part") == F.col("__of"))
    return found.withColumn(name, F.col("__before") + F.col(name)).drop("__part", "__of", "__before")


def skip(df: DataFrame, n: int) -> DataFrame:
    """Rows behind the first ``n``; an offset without a limit would send all of them through one task."""
    return placed(df).filter(F.col(PLACE) >= n).drop(PLACE) if n > 0 else df


def slice_rows(df: DataFrame, offset: int, length: int) -> DataFrame:
    """``length`` rows from ``offset``; negative offsets count from the end."""
    if offset >= 0:
        return df.offset(offset).limit(length)
    return tail(df, -offset).limit(length)


def top_k(df: DataFrame, keys: Sequence[SortKey | str], k: int, descending: Sequence[bool] | None = None) -> DataFrame:
    return sort(df, keys, descending).limit(k)


def unique(df: DataFrame, subset: Sequence[str] | None = None, keep: str = "any", order_by: Sequence[SortKey | str] | None = None) -> DataFrame:
    """Distinct rows.  ``keep``: any, first, last or none of the rows that agree."""
    if keep == "any":
        return df.dropDuplicates(list(subset) if subset else None)
    columns = list(subset or df.columns)
    if keep == "none":
        once = df.groupBy(*[_q(c) for c in columns]).count().filter("count = 1").drop("count")
        from .joins import Keys, join

        return join(df, once, Keys.on(*columns), how="semi", null_equal=True)
    keys = [(k if isinstance(k, SortKey) else SortKey(k)) for k in order_by or [SortKey(ROW)]]
    if keep == "last":
        keys = [SortKey(k.column, not k.descending) for k in keys]
    w = Window.partitionBy(*[_q(c) for c in columns]).orderBy(*[k.spark() for k in keys])
    return numbered(df).withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n", ROW)


def unique_values(df: DataFrame, column: str) -> DataFrame:
    return select(df, [column]).distinct()


def drop_nulls(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    return df.dropna(subset=list(subset) if subset else None)


def fill_null(df: DataFrame, value, subset: Sequence[str] | None = None) -> DataFrame:
    """A constant for nulls, in the columns whose type it fits."""
    return df.fillna(value, subset=list(subset) if subset else None)


def fill_null_with(df: DataFrame, strategy: str, columns: Sequence[str], order_by: Sequence[str], partition_by: Sequence[str] = ()) -> DataFrame:
    """Nulls filled ``forward`` or ``backward`` along an order, or with ``min``, ``max``, ``mean``, ``zero``, ``one``."""
    part = Window.partitionBy(*partition_by)
    run = part.orderBy(*order_by)
    found = {
        "forward": lambda c: F.last(c, True).over(run.rowsBetween(Window.unboundedPreceding, 0)),
        "backward": lambda c: F.first(c, True).over(run.rowsBetween(0, Window.unboundedFollowing)),
        "min": lambda c: F.min(c).over(part),
        "max": lambda c: F.max(c).over(part),
        "mean": lambda c: F.avg(c).over(part),
        "zero": lambda c: F.lit(0),
        "one": lambda c: F.lit(1),
    }
    if strategy not in found:
        raise ValueError(f"no strategy {strategy!r}")
    return df.withColumns({c: F.coalesce(_q(c), found[strategy](_q(c))) for c in columns})


def rename(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    _check(df, list(mapping))
    return df.withColumnsRenamed(dict(mapping))


def with_column(df: DataFrame, name: str, value) -> DataFrame:
    """A column from an expression or a constant."""
    return df.withColumn(name, value if isinstance(value, Column) else F.lit(value))


def drop(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    _check(df, columns)
    return df.drop(*columns)


def cast(df: DataFrame, column: str, to: str, strict: bool = True) -> DataFrame:
    _check(df, [column])
    c = _q(column)
    return df.withColumn(column, c.cast(ddl_of(to)) if strict else c.try_cast(ddl_of(to)))


def map_column(df: DataFrame, column: str, fn: Callable[[Column], Column]) -> DataFrame:
    return df.withColumn(column, fn(_q(column)))


def map_columns(df: DataFrame, fn: Callable[[Column], Column], kind: type[T.DataType] = T.DataType) -> DataFrame:
    """``fn`` over every column of a kind."""
    return df.select(*[fn(_q(f.name)).alias(f.name) if isinstance(f.dataType, kind) else _q(f.name) for f in df.schema.fields])


def map_rows(df: DataFrame, fn: Callable, schema: str) -> DataFrame:
    """A Python function over pandas batches."""

    def run(batches):
        for batch in batches:
            yield fn(batch)

    return df.mapInPandas(run, schema)


def explode(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row for each element; several columns step together; an empty list leaves one null."""
    if len(columns) == 1:
        return df.withColumn(columns[0], F.explode_outer(_q(columns[0])))
    zipped = df.withColumn("__z", F.explode_outer(F.arrays_zip(*[_q(c) for c in columns])))
    return zipped.withColumns({c: F.col("__z").getField(c) for c in columns}).drop("__z")


def reverse(df: DataFrame) -> DataFrame:
    return numbered(df).orderBy(F.desc(ROW)).drop(ROW)


def count(df: DataFrame) -> int:
    return df.count()


def describe(df: DataFrame) -> DataFrame:
    """mean, min and max of each numeric column, with the number of rows and columns."""
    numeric = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    cells = [F.count(F.lit(1)).alias("rows"), F.lit(len(df.columns)).alias("columns")]
    for c in numeric:
        cells += [F.avg(_q(c)).alias(f"{c}_mean"), F.min(_q(c)).alias(f"{c}_min"), F.max(_q(c)).alias(f"{c}_max")]
    return df.agg(*cells)


def union_all(frames: Sequence[DataFrame], missing: bool = False) -> DataFrame:
    """Frames one below the other, columns matched by name."""
    out = frames[0]
    for other in frames[1:]:
        out = out.unionByName(other, allowMissingColumns=missing)
    return out


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.exceptAll(b)
