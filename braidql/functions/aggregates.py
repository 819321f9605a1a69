"""Aggregates, over the elements of an array and over the rows of a group.

``AGGREGATES`` maps names to builders of Spark aggregate columns; the registry
holds the same names for arrays.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .registry import FilterError, Typed, const, double, register, shown, truthy

# ---- arrays ---------------------------------------------------------------


def numbers(x: Typed) -> Column:
    """The numeric elements as doubles; nulls dropped."""
    if not x.is_array:
        return F.array(double(x)) if x.is_number else F.array().cast("array<double>")
    if not isinstance(x.dtype.elementType, T.NumericType):
        return F.array().cast("array<double>")
    return F.transform(F.filter(x.col, lambda v: v.isNotNull()), lambda v: v.cast("double"))


def array_sum(values: Column) -> Column:
    return F.when(F.size(values) > 0, F.aggregate(values, F.lit(0.0), lambda a, v: a + v))


def array_mean(values: Column) -> Column:
    return F.try_divide(array_sum(values), F.size(values))


def array_var(values: Column, ddof: int) -> Column:
    """Variance by a running mean, so that large offsets do no harm."""
    zero = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"))

    def step(a: Column, v: Column) -> Column:
        n = a["n"] + 1
        mean = a["mean"] + (v - a["mean"]) / n
        return F.struct(n.alias("n"), mean.alias("mean"), (a["m2"] + (v - a["mean"]) * (v - mean)).alias("m2"))

    return F.aggregate(values, zero, step, lambda a: F.when(a["n"] > ddof, a["m2"] / (a["n"] - ddof)))


def array_quantile(values: Column, q: Column) -> Column:
    """Linear interpolation between the neighbours of ``(n - 1) q``."""
    ordered = F.sort_array(values)
    place = (F.size(values) - 1) * q
    low = F.floor(place).cast("int")
    a, b = F.get(ordered, low), F.get(ordered, F.least(low + 1, F.size(values) - 1))
    return F.when(F.size(values) > 0, a + (b - a) * (place - low))


def pearson(a: Column, b: Column) -> Column:
    pairs = F.filter(F.arrays_zip(a.alias("a"), b.alias("b")), lambda p: p["a"].isNotNull() & p["b"].isNotNull())
    ma, mb = array_mean(F.transform(pairs, lambda p: p["a"])), array_mean(F.transform(pairs, lambda p: p["b"]))
    total = lambda f: F.aggregate(pairs, F.lit(0.0), lambda s, p: s + f(p))
    va, vb = total(lambda p: (p["a"] - ma) * (p["a"] - ma)), total(lambda p: (p["b"] - mb) * (p["b"] - mb))
    r = F.try_divide(total(lambda p: (p["a"] - ma) * (p["b"] - mb)), F.sqrt(va * vb))
    return F.when(F.size(pairs) >= 2, F.coalesce(r, F.lit(0.0)))


def _fraction(p: Typed) -> Column:
    """A share: integers are percentages."""
    return double(p) / 100 if p.is_integer else double(p)


@register("add", "sum", low=1, high=99)
def _sum(x: Typed, *more: Typed) -> Column:
    if more:
        return _sum(Typed(F.array(*[a.col for a in (x, *more)]), T.ArrayType(x.dtype)))
    if not x.is_array:
        return x.col
    inner = x.dtype.elementType
    if isinstance(inner, T.StringType):
        return F.when(F.size(x.col) > 0, F.array_join(x.col, ""))
    if isinstance(inner, T.ArrayType):
        return F.flatten(x.col)
    if isinstance(inner, (T.LongType, T.IntegerType, T.ShortType, T.ByteType)):
        return F.when(F.size(x.col) > 0, F.aggregate(x.col, F.lit(0).cast("long"), lambda a, v: a + v))
    return F.when(F.size(x.col) > 0, F.aggregate(F.transform(x.col, lambda v: v.cast("double")), F.lit(0.0), lambda a, v: a + v))


@register("avg", "mean")
def _mean(x: Typed) -> Column:
    return array_mean(numbers(x))


@register("max")
def _max(x: Typed) -> Column:
    return F.array_max(x.col) if x.is_array else x.col


@register("min")
def _min(x: Typed) -> Column:
    return F.array_min(x.col) if x.is_array else x.col


@register("median")
def _median(x: Typed) -> Column:
    return array_quantile(numbers(x), F.lit(0.5))


@register("std", "stdev_s")
def _std(x: Typed) -> Column:
    return F.sqrt(array_var(numbers(x), 1))


@register("var")
def _var(x: Typed) -> Column:
    return array_var(numbers(x), 1)


@register("stdev_p")
def _stdev_p(x: Typed) -> Column:
    values = numbers(x)
    return F.when(F.size(values) >= 2, F.sqrt(array_var(values, 0)))


@register("percentile", low=2)
def _percentile(x: Typed, p: Typed) -> Column:
    ordered = F.sort_array(numbers(x))
    return F.get(ordered, F.floor((F.size(ordered) - 1) * _fraction(p)).cast("int"))


@register("quartile", low=1, high=2)
def _quartile(x: Typed, *q: Typed) -> Column:
    return array_quantile(numbers(x), (double(q[0]) if q else F.lit(2.0)) / 4)


@register("count")
def _count(x: Typed) -> Column:
    if x.is_array or isinstance(x.dtype, T.MapType):
        return F.size(x.col).cast("long")
    if x.is_string:
        return F.char_length(x.col).cast("long")
    return F.lit(len(x.dtype.fields) if x.is_struct else 1).cast("long")


# ---- rows -----------------------------------------------------------------

Build = Callable[..., Column]


def _row_sum(x: Typed) -> Column:
    if x.is_string:
        return F.listagg(x.col)
    if not x.is_number and not x.is_null:
        raise FilterError(f"cannot add values of type {x.dtype.simpleString()}")
    return F.sum(x.col)


def _row_percentile(x: Typed, p: Typed) -> Column:
    ordered = F.sort_array(F.collect_list(double(x)))
    return F.get(ordered, F.floor((F.size(ordered) - 1) * _fraction(p)).cast("int"))


def _row_correl(a: Typed, b: Typed) -> Column:
    both = a.col.isNotNull() & b.col.isNotNull()
    return F.when(F.count_if(both) >= 2, F.coalesce(F.corr(double(a), double(b)), F.lit(0.0)))


AGGREGATES: dict[str, Build] = {
    "add": _row_sum,
    "sum": _row_sum,
    "avg": lambda x: F.avg(double(x)),
    "mean": lambda x: F.avg(double(x)),
    "max": lambda x: F.max(x.col),
    "min": lambda x: F.min(x.col),
    "median": lambda x: F.median(double(x)),
    "std": lambda x: F.stddev_samp(double(x)),
    "stdev_s": lambda x: F.stddev_samp(double(x)),
    "var": lambda x: F.var_samp(double(x)),
    "stdev_p": lambda x: F.when(F.count(x.col) >= 2, F.stddev_pop(double(x))),
    "percentile": _row_percentile,
    "quartile": lambda x, *q: F.percentile(double(x), float(const(q[0], "the quartile") if q else 2) / 4),
    "correl": _row_correl,
    "length": lambda x: F.count(F.lit(1)),
    "len": lambda x: F.count(F.lit(1)),
    "count": lambda x: F.count(F.lit(1)),
    "count_if": lambda x, m: F.count_if(truthy(m)),
    "avg_if": lambda x, m: F.avg(F.when(truthy(m), double(x))),
    "most_frequent": lambda x: F.mode(x.col, True),
    "group_concat": lambda x, *sep: F.listagg(shown(x), sep[0].value if sep else ","),
    "sharpe_ratio": lambda x, *rf: F.try_divide(F.avg(double(x)) - (double(rf[0]) if rf else F.lit(0.0)), F.stddev_pop(double(x))),
    "beta": lambda a, m: F.try_divide(F.covar_pop(double(a), double(m)), F.var_pop(double(m))),
    "alpha": lambda a, m, *rf: F.avg(double(a)) - ((double(rf[0]) if rf else F.lit(0.0)) + F.try_divide(F.covar_pop(double(a), double(m)), F.var_pop(double(m))) * (F.avg(double(m)) - (double(rf[0]) if rf else F.lit(0.0)))),
}
