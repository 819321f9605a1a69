"""Mathematics, random values and sequences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .registry import Typed, const, double, guarded, register


@register("abs", each="num")
def _abs(x: Typed) -> Column:
    return F.abs(x.col)


def _plain(name: str, build) -> None:
    register(name, each="num")(lambda x: build(double(x)))


for _name, _fn in {"atan": F.atan, "sin": F.sin, "cos": F.cos, "tan": F.tan, "exp": F.exp}.items():
    _plain(_name, _fn)


def _within(name: str, fn, test) -> None:
    register(name, each="num")(lambda x: guarded(test(double(x)), fn(double(x)), f"{name}: argument out of range", x.safe))


_within("acos", F.acos, lambda c: F.abs(c) <= 1)
_within("asin", F.asin, lambda c: F.abs(c) <= 1)
_within("log10", F.log10, lambda c: c > 0)
_within("sqrt", F.sqrt, lambda c: c >= 0)


@register("pow", low=2, each="num")
def _pow(x: Typed, y: Typed) -> Column:
    return F.pow(double(x), double(y))


@register("pi", low=0, high=1)
def _pi(*_: Typed) -> Column:
    return F.pi()


@register("floor", each="num")
def _floor(x: Typed) -> Column:
    return x.col if x.is_integer else F.floor(x.col).cast("double")


@register("ceil", each="num")
def _ceil(x: Typed) -> Column:
    return x.col if x.is_integer else F.ceil(x.col).cast("double")


def _scale(digits: tuple[Typed, ...]) -> Column:
    return F.pow(F.lit(10.0), double(digits[0])) if digits else F.lit(1.0)


@register("round", low=1, high=2, each="num")
def _round(x: Typed, *digits: Typed) -> Column:
    if not digits or digits[0].value is not None:
        return F.round(double(x), int(digits[0].value) if digits else 0)
    s = _scale(digits)
    return F.round(double(x) * s) / s


@register("roundup", low=1, high=2, each="num")
def _roundup(x: Typed, *digits: Typed) -> Column:
    s = _scale(digits)
    return F.ceil(double(x) * s).cast("double") / s


@register("rounddown", low=1, high=2, each="num")
def _rounddown(x: Typed, *digits: Typed) -> Column:
    s = _scale(digits)
    return F.floor(double(x) * s).cast("double") / s


@register("mround", low=2, each="any")
def _mround(x: Typed, m: Typed) -> Column:
    return F.when(double(m) == 0, double(x)).otherwise(F.round(F.try_divide(double(x), double(m))) * double(m))


@register("isnan", each="num")
def _isnan(x: Typed) -> Column:
    return F.coalesce(F.isnan(double(x)), F.lit(False))


def _infinite(c: Column) -> Column:
    return F.coalesce(F.abs(c) == float("inf"), F.lit(False))


@register("isinf", each="num")
def _isinf(x: Typed) -> Column:
    return _infinite(double(x))


@register("isfinite", each="num")
def _isfinite(x: Typed) -> Column:
    return F.coalesce(~F.isnan(double(x)) & ~_infinite(double(x)), F.lit(False))


@register("isnormal", each="num")
def _isnormal(x: Typed) -> Column:
    return F.coalesce(~F.isnan(double(x)) & ~_infinite(double(x)) & (F.abs(double(x)) >= 2.2250738585072014e-308), F.lit(False))


@register("rand", low=0, high=1)
def _rand(*_: Typed) -> Column:
    return F.rand()


@register("randarray")
def _randarray(n: Typed) -> Column:
    return F.array(*[F.rand() for _ in range(int(const(n, "the length of randarray")))])


@register("randbetween", low=2)
def _randbetween(low: Typed, high: Typed) -> Column:
    drawn = F.floor(F.rand() * (high.col - low.col + 1) + low.col).cast("long")
    return F.when(low.col <= high.col, drawn).otherwise(F.raise_error(F.lit("randbetween: the bounds are reversed")).cast("long"))


@register("generate_sequence", low=3)
def _generate_sequence(start: Typed, end: Typed, step: Typed) -> Column:
    if start.is_integer and end.is_integer and step.is_integer:
        right = F.when(step.col > 0, start.col <= end.col).otherwise(start.col >= end.col)
        return F.when(right, F.sequence(start.col, end.col, step.col)).otherwise(F.array().cast("array<long>"))
    n = F.floor((double(end) - double(start)) / double(step) + 1e-9)
    return F.when(n >= 0, F.transform(F.sequence(F.lit(0).cast("long"), n), lambda i: double(start) + i * double(step))).otherwise(F.array().cast("array<double>"))


@register("range", low=1, high=3)
def _range(*args: Typed) -> Column:
    zero = F.lit(0).cast("long")
    start, end = (zero, args[0].col) if len(args) == 1 else (args[0].col, args[1].col)
    step = args[2].col if len(args) == 3 else F.when(start <= end, F.lit(1)).otherwise(F.lit(-1)).cast("long")
    last = end - F.signum(step.cast("double")).cast("long")
    some = F.when(step > 0, start < end).otherwise(start > end)
    return F.when(some, F.sequence(start, last, step)).otherwise(F.array().cast("array<long>"))
