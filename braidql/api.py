"""The fluent interface: an immutable query over a DataFrame.

Every method adds to the plan and returns a new query; ``collect``, ``count``,
``to_json`` and ``write`` run it.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession

from . import sources
from .lang import parse
from .operators import aggregate, basic, joins, reshape, series
from .operators.aggregate import Agg
from .plans import compile_filter


def session() -> SparkSession:
    return SparkSession.getActiveSession() or SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()


class Query:
    """A plan with the log of what made it."""

    def __init__(self, df: DataFrame, params: dict[str, Any] | None = None, operations: tuple[str, ...] = ()):
        self.df, self.params, self.operations = df, params or {}, operations

    # ---- sources

    @classmethod
    def from_file(cls, path: str | Sequence[str], **options: Any) -> Query:
        return cls(sources.load(session(), path, **options), operations=(f"load {path}",))

    @classmethod
    def from_json(cls, text: str) -> Query:
        value = json.loads(text)
        rows = [json.dumps(v) for v in (value if isinstance(value, list) else [value])]
        spark = session()
        return cls(spark.read.json(spark.sparkContext.parallelize(rows)))

    @classmethod
    def from_csv(cls, text: str, **options: Any) -> Query:
        spark = session()
        lines = spark.sparkContext.parallelize(text.splitlines(), 1)
        return cls(spark.read.csv(lines, header=True, inferSchema=True, **options))

    @classmethod
    def from_rows(cls, rows: Sequence[dict] | Any, schema: str | None = None) -> Query:
        return cls(session().createDataFrame(rows, schema))

    @classmethod
    def empty(cls) -> Query:
        return cls(session().range(0).drop("id"))

    @classmethod
    def range(cls, start: int, end: int) -> Query:
        return cls(session().range(start, end).withColumnRenamed("id", "value"))

    def _with(self, df: DataFrame, what: str) -> Query:
        return Query(df, self.params, (*self.operations, what))

    def bind(self, **params: Any) -> Query:
        """Values of the variables ``$name``."""
        return Query(self.df, self.params | params, self.operations)

    # ---- the filter language

    def apply_filter(self, text: str) -> Query:
        return self._with(compile_filter(text, self.df, self.params, lambda p: sources.load(self.df.sparkSession, p)), f"filter {text}")

    __call__ = apply_filter

    def filter_expr(self, text: str) -> Query:
        """Rows where a condition holds; fields may be named with or without the dot."""
        dotted = re.sub(r"(?<![\w.$\"'])(?!(?:and|or|not|true|false|null)\b)([A-Za-z_]\w*)(?!\w*\s*\()(?=(?:[^\"']|\"[^\"]*\"|'[^']*')*$)", r".\1", text)
        return self._with(compile_filter(f"select({dotted})", self.df, self.params), f"where {text}")

    # ---- verbs

    def select(self, *columns: str) -> Query:
        return self._with(basic.select(self.df, columns), f"select {', '.join(columns)}")

    def where(self, condition: Column | str) -> Query:
        return self._with(basic.filter_rows(self.df, condition), "where")

    def sort_by(self, *columns: str | tuple[str, bool]) -> Query:
        """Ascending, nulls first; ``(name, True)`` descends."""
        keys = [basic.SortKey(*c) if isinstance(c, tuple) else basic.SortKey(c) for c in columns]
        return self._with(basic.sort(self.df, keys), f"sort by {', '.join(k.column for k in keys)}")

    def head(self, n: int = 5) -> Query:
        return self._with(basic.head(self.df, n), f"head {n}")

    def tail(self, n: int = 5) -> Query:
        return self._with(basic.tail(self.df, n), f"tail {n}")

    def slice(self, offset: int, length: int) -> Query:
        return self._with(basic.slice_rows(self.df, offset, length), f"slice {offset} {length}")

    def group_by(self, *keys: str) -> Query:
        return self._with(aggregate.group_rows(self.df, keys), f"group by {', '.join(keys)}")

    def aggregate(self, keys: Sequence[str], aggs: Sequence[Agg]) -> Query:
        return self._with(aggregate.group_by_agg(self.df, keys, aggs), f"aggregate {', '.join(a.name for a in aggs)}")

    def join_with(self, other: Query, keys: Sequence[str] | joins.Keys, how: str = "inner", **options: Any) -> Query:
        on = keys if isinstance(keys, joins.Keys) else joins.Keys.on(*keys)
        return self._with(joins.join(self.df, other.df, on, how=how, **options), f"{how} join")

    def inner_join(self, other: Query, *keys: str) -> Query:
        return self.join_with(other, keys)

    def left_join(self, other: Query, *keys: str) -> Query:
        return self.join_with(other, keys, "left")

    def unique(self, *subset: str) -> Query:
        return self._with(basic.unique(self.df, subset or None), "unique")

    def unique_values(self, column: str) -> Query:
        return self._with(basic.unique_values(self.df, column), f"unique values of {column}")

    def rename(self, **mapping: str) -> Query:
        return self._with(basic.rename(self.df, mapping), "rename")

    def with_column(self, name: str, value: Any) -> Query:
        return self._with(basic.with_column(self.df, name, value), f"column {name}")

    def drop(self, *columns: str) -> Query:
        return self._with(basic.drop(self.df, columns), f"drop {', '.join(columns)}")

    def cast_column(self, column: str, to: str) -> Query:
        return self._with(basic.cast(self.df, column, to), f"cast {column}")

    def explode(self, *columns: str) -> Query:
        return self._with(basic.explode(self.df, columns), "explode")

    def transpose(self) -> Query:
        return self._with(reshape.transpose(self.df), "transpose")

    def pivot(self, index: Sequence[str], column: str, value: str, agg: str = "sum") -> Query:
        return self._with(reshape.pivot(self.df, index, column, value, agg), "pivot")

    def unpivot(self, ids: Sequence[str], values: Sequence[str] | None = None) -> Query:
        return self._with(reshape.unpivot(self.df, ids, values), "unpivot")

    def rolling(self, column: str, fn: str, size: int, order_by: Sequence[str], keys: Sequence[str] = (), min_periods: int | None = None) -> Query:
        return self._with(series.rolling_agg(self.df, column, fn, size, order_by, keys, min_periods), f"rolling {fn}")

    def describe(self) -> Query:
        return self._with(basic.describe(self.df), "describe")

    # ---- results

    def count(self) -> int:
        return self.df.count()

    def is_empty(self) -> bool:
        return self.df.isEmpty()

    def collect(self) -> list[dict]:
        return [r.asDict(True) for r in self.df.collect()]

    def to_json(self, pretty: bool = False) -> str:
        rows = [json.loads(r) for r in self.df.toJSON().collect()]
        return json.dumps(rows, indent=2 if pretty else None, ensure_ascii=False)

    def write(self, path: str, **options: Any) -> None:
        sources.save(self.df, path, **options)

    def explain(self) -> None:
        self.df.explain("formatted")


class Executor:
    """Runs filters by text; parsed filters are cached by the parser."""

    def __init__(self, params: dict[str, Any] | None = None):
        self.params = params or {}

    def execute(self, text: str, df: DataFrame) -> DataFrame:
        return compile_filter(text, df, self.params, lambda p: sources.load(df.sparkSession, p))

    def execute_streaming(self, text: str, frames: Sequence[DataFrame]) -> list[DataFrame]:
        return [self.execute(text, df) for df in frames]

    @staticmethod
    def validate(text: str) -> None:
        """Raise if a filter does not parse."""
        parse(text)

    precompile = validate

    @staticmethod
    def cache_size() -> int:
        return parse.cache_info().currsize

    @staticmethod
    def clear_cache() -> None:
        parse.cache_clear()


def process_csv(text: str, operations: Callable[[Query], Query]) -> str:
    return operations(Query.from_csv(text)).to_json()


def process_json(text: str, operations: Callable[[Query], Query]) -> str:
    return operations(Query.from_json(text)).to_json()


def process_file(source: str, target: str, operations: Callable[[Query], Query]) -> None:
    operations(Query.from_file(source)).write(target)


class Pipeline:
    """Verbs collected first and run on any frame later."""

    def __init__(self, steps: tuple[tuple[str, Callable[[DataFrame], DataFrame]], ...] = ()):
        self.steps = steps

    def add(self, name: str, step: Callable[[DataFrame], DataFrame]) -> Pipeline:
        return Pipeline((*self.steps, (name, step)))

    def select(self, *columns: str) -> Pipeline:
        return self.add("select", lambda df: basic.select(df, columns))

    def filter(self, condition: Column | str) -> Pipeline:
        return self.add("filter", lambda df: basic.filter_rows(df, condition))

    def sort(self, *keys: basic.SortKey | str) -> Pipeline:
        return self.add("sort", lambda df: basic.sort(df, keys))

    def head(self, n: int) -> Pipeline:
        return self.add("head", lambda df: basic.head(df, n))

    def tail(self, n: int) -> Pipeline:
        return self.add("tail", lambda df: basic.tail(df, n))

    def group_by(self, *keys: str) -> Pipeline:
        return self.add("group_by", lambda df: aggregate.group_rows(df, keys))

    def aggregate(self, keys: Sequence[str], aggs: Sequence[Agg]) -> Pipeline:
        return self.add("aggregate", lambda df: aggregate.group_by_agg(df, keys, aggs))

    def join(self, right: DataFrame, keys: joins.Keys, options: joins.Options | None = None) -> Pipeline:
        return self.add("join", lambda df: joins.join(df, right, keys, options))

    def execute(self, df: DataFrame) -> DataFrame:
        for _, step in self.steps:
            df = step(df)
        return df

    def describe(self) -> list[str]:
        return [name for name, _ in self.steps]

    def __len__(self) -> int:
        return len(self.steps)
