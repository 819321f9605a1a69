"""The function registry.

A function is a builder from typed columns to a column.  Its result type comes
from Spark's own analyser: the builder is run once on typed nulls and the schema
is read off.  Functions marked with a kind of value are elementwise: over an
array they map its elements, over a whole frame the columns of that kind.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class FilterError(ValueError):
    """A filter that cannot be compiled against its input."""


@dataclass(frozen=True)
class Typed:
    """A column with its type, and its value if it is a constant."""

    col: Column
    dtype: T.DataType
    value: Any = None
    safe: bool = field(default=False, compare=False)

    @property
    def is_array(self) -> bool:
        return isinstance(self.dtype, T.ArrayType)

    @property
    def is_struct(self) -> bool:
        return isinstance(self.dtype, T.StructType)

    @property
    def is_string(self) -> bool:
        return isinstance(self.dtype, T.StringType)

    @property
    def is_number(self) -> bool:
        return isinstance(self.dtype, T.NumericType)

    @property
    def is_integer(self) -> bool:
        return isinstance(self.dtype, (T.LongType, T.IntegerType, T.ShortType, T.ByteType))

    @property
    def is_null(self) -> bool:
        return isinstance(self.dtype, T.NullType)


def literal(value: Any) -> Typed:
    """A constant; integers beyond 64 bits become decimals or, wider still, text."""
    if value is None:
        return Typed(F.lit(None), T.NullType())
    if isinstance(value, bool):
        return Typed(F.lit(value), T.BooleanType(), value)
    if isinstance(value, int):
        if -(2**63) <= value < 2**63:
            return Typed(F.lit(value).cast("long"), T.LongType(), value)
        if abs(value) < 10**38:
            return Typed(F.lit(str(value)).cast("decimal(38,0)"), T.DecimalType(38, 0), value)
        return Typed(F.lit(str(value)), T.StringType(), str(value))
    if isinstance(value, float):
        return Typed(F.lit(value), T.DoubleType(), value)
    if isinstance(value, str):
        return Typed(F.lit(value), T.StringType(), value)
    if isinstance(value, (list, tuple)):
        items = [literal(v) for v in value]
        kind = items[0].dtype if items else T.StringType()
        return Typed(F.array(*[i.col for i in items]), T.ArrayType(kind), list(value))
    if isinstance(value, dict):
        items = {k: literal(v) for k, v in value.items()}
        return Typed(F.struct(*[v.col.alias(k) for k, v in items.items()]), T.StructType([T.StructField(k, v.dtype) for k, v in items.items()]), value)
    raise FilterError(f"no literal of type {type(value).__name__}")


_TYPES: dict[Any, T.DataType] = {}


def type_of(build: Callable[..., Column], args: list[Typed], key: Any = None) -> T.DataType:
    """Type of ``build(*args)``, found on typed nulls."""
    key = None if key is None else (key, *[(a.dtype.json(), repr(a.value)) for a in args])
    if key is not None and key in _TYPES:
        return _TYPES[key]
    spark = SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
    proxies = [Typed(F.lit(a.value) if a.value is not None and not isinstance(a.value, (list, dict)) else F.lit(None).cast(a.dtype), a.dtype, a.value) for a in args]
    found = spark.range(0).select(build(*proxies).alias("x")).schema[0].dataType
    if key is not None:
        _TYPES[key] = found
    return found


@dataclass(frozen=True)
class Spec:
    name: str
    build: Callable[..., Column]
    low: int
    high: int
    each: str | None


REGISTRY: dict[str, Spec] = {}


def register(*names: str, low: int = 1, high: int | None = None, each: str | None = None):
    """Register a builder under ``names``.  ``each``: str, num, date or any for elementwise functions."""

    def keep(build):
        for name in names:
            REGISTRY[name] = Spec(name, build, low, low if high is None else high, each)
        return build

    return keep


def fits(kind: str, dtype: T.DataType) -> bool:
    """Whether values of a type are of a kind."""
    if kind == "any":
        return True
    if kind == "num":
        return isinstance(dtype, T.NumericType)
    if kind == "str":
        return isinstance(dtype, T.StringType)
    return isinstance(dtype, (T.StringType, T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType))


def call(name: str, args: list[Typed]) -> Typed:
    """Apply a function, over the elements of an array where it is elementwise."""
    spec = REGISTRY.get(name)
    if spec is None:
        raise FilterError(f"unknown function {name}")
    if not spec.low <= len(args) <= spec.high:
        raise FilterError(f"{name} takes {spec.low}" + (f" to {spec.high}" if spec.high != spec.low else "") + f" arguments, not {len(args)}")
    if spec.each and args and args[0].is_array:
        inner, rest = args[0].dtype.elementType, args[1:]
        over = lambda first, *others: F.transform(first.col, lambda x: spec.build(Typed(x, inner), *others))
        return Typed(over(args[0], *rest), type_of(over, args, (name, "each")))
    return Typed(spec.build(*args), type_of(spec.build, args, name))


def const(arg: Typed, what: str) -> Any:
    """The value of an argument that must be a constant."""
    if arg.value is None:
        raise FilterError(f"{what} must be a constant")
    return arg.value


def text(arg: Typed) -> Column:
    """As a string; null stays null."""
    if arg.is_array or arg.is_struct or isinstance(arg.dtype, T.MapType):
        return F.to_json(arg.col)
    return arg.col.cast("string")


def shown(arg: Typed) -> Column:
    """As a string, null as the word."""
    return F.coalesce(text(arg), F.lit("null"))


def double(arg: Typed) -> Column:
    return arg.col.cast("double")


def truthy(arg: Typed) -> Column:
    """Never null: null, false, 0, NaN, empty texts, arrays and objects are false."""
    c, t = arg.col, arg.dtype
    if isinstance(t, T.NullType):
        return F.lit(False)
    if isinstance(t, T.BooleanType):
        return F.coalesce(c, F.lit(False))
    if isinstance(t, (T.DoubleType, T.FloatType)):
        return F.coalesce((c != 0) & ~F.isnan(c), F.lit(False))
    if isinstance(t, T.NumericType):
        return F.coalesce(c != 0, F.lit(False))
    if isinstance(t, T.StringType):
        return F.coalesce(c != "", F.lit(False))
    if isinstance(t, (T.ArrayType, T.MapType)):
        return F.coalesce(F.size(c) > 0, F.lit(False))
    if isinstance(t, T.StructType):
        return c.isNotNull() if t.fields else F.lit(False)
    return c.isNotNull()


def guarded(ok: Column, value: Column, message: str, safe: bool = False) -> Column:
    """``value`` where ``ok`` (or unknown), else an error, or null under ``try``."""
    return F.when(ok, value) if safe else F.when(~ok, F.raise_error(F.lit(message)).cast("double")).otherwise(value)
