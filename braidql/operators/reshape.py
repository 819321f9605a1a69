"""Pivots, unpivots, samples and frequencies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .basic import PLACE, placed

# Aggregates that a pivot may use.
PIVOT_AGGREGATES = {"sum": F.sum, "mean": F.avg, "avg": F.avg, "count": F.count, "min": F.min, "max": F.max, "first": F.first, "last": F.last, "median": F.median}


def _q(name: str) -> Column:
    return F.col(f"`{name}`")


def unpivot(df: DataFrame, ids: Sequence[str], values: Sequence[str] | None = None, variable: str = "variable", value: str = "value") -> DataFrame:
    """Wide to long.  Values of several types become text."""
    values = list(values or [c for c in df.columns if c not in ids])
    kinds = {df.schema[c].dataType for c in values}
    if len(kinds) > 1:
        to = "double" if all(isinstance(k, T.NumericType) for k in kinds) else "string"
        df = df.withColumns({c: _q(c).cast(to) for c in values})
    return df.unpivot([_q(c) for c in ids], [_q(c) for c in values], variable, value)


melt = unpivot


def pivot(df: DataFrame, index: Sequence[str], column: str, value: str, agg: str = "sum", values: Sequence | None = None) -> DataFrame:
    """Long to wide: a column ``<column>_<value>`` for each value of ``column``.

    Naming the values saves the pass that finds them.
    """
    if agg not in PIVOT_AGGREGATES:
        raise ValueError(f"no aggregate {agg!r}")
    wide = df.groupBy(*[_q(c) for c in index]).pivot(column, list(values) if values else None).agg(PIVOT_AGGREGATES[agg](_q(value)))
    return wide.withColumnsRenamed({c: f"{column}_{c}" for c in wide.columns if c not in index})


def transpose(df: DataFrame, header: str | None = None) -> DataFrame:
    """Columns to rows; the first column (or ``header``) names the new columns.  For small frames: each row becomes a column."""
    first = header or df.columns[0]
    others = [c for c in df.columns if c != first]
    kinds = {df.schema[c].dataType for c in others}
    if len(kinds) > 1:
        to = "double" if all(isinstance(k, T.NumericType) for k in kinds) else "string"
        df = df.withColumns({c: _q(c).cast(to) for c in others})
    return df.transpose(_q(first))


def sample(df: DataFrame, size: float, seed: int | None = None, replacement: bool = False) -> DataFrame:
    """A share of the rows (a float below 1), or an exact number of them."""
    if isinstance(size, float) and size <= 1:
        return df.sample(replacement, size, seed)
    return df.orderBy(F.rand(seed)).limit(int(size))


def value_counts(df: DataFrame, column: str, sort: bool = False) -> DataFrame:
    """(value, count) of a column, nulls a value of their own."""
    found = df.groupBy(_q(column).alias("value")).agg(F.count(F.lit(1)).alias("count"))
    return found.orderBy(F.desc("count"), F.col("value").asc_nulls_first()) if sort else found


def histogram(df: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """(bin, low, high, count): equal widths between the extremes, the last bin closed.  One pass for the extremes, one to count."""
    c = _q(column).cast("double")
    low, high = df.agg(F.min(c), F.max(c)).first()
    edges = df.sparkSession.range(bins).withColumn("bin", F.col("id").cast("int")).drop("id")
    if low is None:
        return edges.limit(0).select("bin", F.lit(0.0).alias("low"), F.lit(0.0).alias("high"), F.lit(0).cast("long").alias("count"))
    span = (high - low) or 1.0
    place = F.least(F.floor((c - low) / span * bins), F.lit(bins - 1)).cast("int")
    counts = df.filter(c.isNotNull()).groupBy(place.alias("at")).agg(F.count(F.lit(1)).alias("n"))
    return edges.join(F.broadcast(counts), F.col("bin") == F.col("at"), "left").select("bin", (low + F.col("bin") * span / bins).alias("low"), (low + (F.col("bin") + 1) * span / bins).alias("high"), F.coalesce("n", F.lit(0)).alias("count"))


def frequencies(df: DataFrame, column: str, kind: str, args: Sequence) -> DataFrame:
    """The frequency verbs: value_counts, topk, topk_with_counts, most_frequent, least_frequent, histogram."""
    if kind == "histogram":
        return histogram(df, column, int(args[0]) if args else 10)
    if kind == "value_counts":
        return value_counts(df, column, bool(args and args[0]))
    k = int(args[0]) if kind.startswith("topk") else 1
    down = not (len(args) > 1 and args[1] is False) and kind != "least_frequent"
    order = F.desc("count") if down else F.asc("count")
    best = value_counts(df, column).orderBy(order, F.col("value").asc_nulls_first()).limit(k)
    return best if kind == "topk_with_counts" else best.select("value")


def chunks(df: DataFrame, size: int) -> DataFrame:
    """Rows with the number of their batch of ``size``, in the order of input."""
    return placed(df).withColumn("batch", F.floor(F.col(PLACE) / size)).drop(PLACE)
