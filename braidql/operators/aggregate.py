"""Grouped aggregation with named functions."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Functions and the ending of the column that each makes.
NAMES = ("count", "sum", "mean", "median", "min", "max", "std", "var", "first", "last", "list", "nunique", "concat")
ROW = "__row"


@dataclass(frozen=True)
class Agg:
    """One aggregate; ``first`` and ``last`` follow ``order_by``, or the order of input."""

    fn: str
    column: str | None = None
    sep: str = ","
    order_by: str | None = None

    @property
    def name(self) -> str:
        return "count" if self.fn == "count" else f"{self.column}_{self.fn}"

    @property
    def needs_order(self) -> bool:
        return self.fn in ("first", "last", "list", "concat") and self.order_by is None

    def spark(self) -> Column:
        c = F.col(f"`{self.column}`") if self.column else F.lit(1)
        at = F.col(f"`{self.order_by}`") if self.order_by else F.col(ROW)
        listed = lambda: F.sort_array(F.collect_list(F.struct(at.alias("at"), c.alias("v"))))
        builders = {
            "count": lambda: F.count(F.lit(1)),
            "sum": lambda: F.sum(c),
            "mean": lambda: F.avg(c),
            "median": lambda: F.median(c),
            "min": lambda: F.min(c),
            "max": lambda: F.max(c),
            "std": lambda: F.stddev_samp(c),
            "var": lambda: F.var_samp(c),
            "first": lambda: F.min_by(c, at),
            "last": lambda: F.max_by(c, at),
            "list": lambda: F.transform(listed(), lambda s: s["v"]),
            "nunique": lambda: F.count_distinct(c) + F.coalesce(F.max(c.isNull().cast("int")), F.lit(0)),
            "concat": lambda: F.array_join(F.transform(F.filter(listed(), lambda s: s["v"].isNotNull()), lambda s: s["v"].cast("string")), self.sep),
        }
        if self.fn not in builders:
            raise ValueError(f"no aggregate {self.fn!r}")
        return builders[self.fn]().alias(self.name)


def group_by_agg(df: DataFrame, keys: Sequence[str], aggs: Sequence[Agg]) -> DataFrame:
    """One hash aggregation, partial before the shuffle."""
    if any(a.needs_order for a in aggs):
        df = df.withColumn(ROW, F.monotonically_increasing_id())
    return df.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(*[a.spark() for a in aggs])


def group_rows(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys with the list of their rows, in the order of input."""
    names = df.columns
    rows = df.withColumn(ROW, F.monotonically_increasing_id())
    listed = F.sort_array(F.collect_list(F.struct(F.col(ROW), *[F.col(f"`{c}`") for c in names])))
    plain = F.transform("rows", lambda r: F.struct(*[r.getField(n).alias(n) for n in names]))
    return rows.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(listed.alias("rows")).withColumn("rows", plain)


def grouping_sets(df: DataFrame, keys: Sequence[str], aggs: Sequence[Agg], kind: str = "rollup") -> DataFrame:
    """Aggregates over a rollup or a cube of the keys."""
    return getattr(df, kind)(*[F.col(f"`{k}`") for k in keys]).agg(*[a.spark() for a in aggs])


class AggregationBuilder:
    """Collects keys and aggregates; ``build`` gives both."""

    def __init__(self, keys: Sequence[str] = ()):
        self.keys, self.aggs = list(keys), []

    def group_by(self, *keys: str) -> AggregationBuilder:
        self.keys += keys
        return self

    def _add(self, fn: str, column: str | None = None) -> AggregationBuilder:
        self.aggs.append(Agg(fn, column))
        return self

    def sum(self, column: str) -> AggregationBuilder:
        return self._add("sum", column)

    def mean(self, column: str) -> AggregationBuilder:
        return self._add("mean", column)

    def count(self) -> AggregationBuilder:
        return self._add("count")

    def min(self, column: str) -> AggregationBuilder:
        return self._add("min", column)

    def max(self, column: str) -> AggregationBuilder:
        return self._add("max", column)

    def build(self) -> tuple[list[str], list[Agg]]:
        return self.keys, self.aggs


def simple_agg(*keys: str) -> AggregationBuilder:
    return AggregationBuilder(keys)
