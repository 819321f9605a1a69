"""Ordered-series analytics over arrays.

What a window of the array can express is a higher-order function; true
recursions (exponential averages, the parabolic stop) run in Arrow batches, one
array at a time.  ``braidql.operators.series`` has the same over ordered rows.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .aggregates import array_mean, array_sum, array_var
from .registry import Typed, double, register

NAN = float("nan")


def doubles(x: Typed) -> Column:
    return F.transform(x.col, lambda v: v.cast("double"))


def _at(c: Column, i: Column) -> Column:
    return F.get(c, F.greatest(i, F.lit(0)))


def _each(values: Column, fn) -> Column:
    return F.transform(values, lambda _, i: fn(i))


def _trailing(values: Column, i: Column, n: Column) -> Column:
    start = F.greatest(i - n + 1, F.lit(0))
    return F.slice(values, start + 1, i - start + 1)


def _int(args: tuple[Typed, ...], k: int, default: int) -> Column:
    return args[k].col.cast("int") if len(args) > k else F.lit(default)


def _float(args: tuple[Typed, ...], k: int, default: float) -> Column:
    return double(args[k]) if len(args) > k else F.lit(default)


@register("log_returns")
def _log_returns(x: Typed) -> Column:
    p = doubles(x)
    return F.transform(p, lambda v, i: F.when((i > 0) & (v > 0) & (_at(p, i - 1) > 0), F.log(v / _at(p, i - 1))))


@register("roc", low=1, high=2)
def _roc(x: Typed, *period: Typed) -> Column:
    p, n = doubles(x), _int(period, 0, 12)
    return _each(p, lambda i: (F.get(p, i) / _at(p, i - n) - 1) * 100)


@register("bbands", low=1, high=3)
def _bbands(x: Typed, *more: Typed) -> Column:
    p, n, k = doubles(x), _int(more, 0, 20), _float(more, 1, 2.0)

    def band(i: Column) -> Column:
        own = _trailing(p, i, n)
        middle, width = array_mean(own), k * F.sqrt(array_var(own, 0))
        return F.struct(middle.alias("middle"), (middle + width).alias("upper"), (middle - width).alias("lower"))

    return _each(p, band)


@register("cci", low=3, high=4)
def _cci(high: Typed, low: Typed, close: Typed, *period: Typed) -> Column:
    h, lo, c = doubles(high), doubles(low), doubles(close)
    typical = _each(c, lambda i: (F.get(h, i) + F.get(lo, i) + F.get(c, i)) / 3)
    n = _int(period, 0, 20)

    def index(i: Column) -> Column:
        own = _trailing(typical, i, n)
        mean = array_mean(own)
        deviation = array_mean(F.transform(own, lambda v: F.abs(v - mean)))
        return F.coalesce(F.try_divide(F.get(typical, i) - mean, 0.015 * deviation), F.lit(0.0))

    return _each(typical, index)


@register("obv", low=2)
def _obv(close: Typed, volume: Typed) -> Column:
    c, v = doubles(close), doubles(volume)
    flows = _each(c, lambda i: F.when(i == 0, F.lit(0.0)).otherwise(F.signum(F.get(c, i) - _at(c, i - 1)) * F.get(v, i)))
    return _each(flows, lambda i: array_sum(F.slice(flows, F.lit(1), i + 1)))


@register("stoch_k", low=3, high=4)
def _stoch_k(high: Typed, low: Typed, close: Typed, *period: Typed) -> Column:
    h, lo, c, n = doubles(high), doubles(low), doubles(close), _int(period, 0, 14)

    def k(i: Column) -> Column:
        top, bottom = F.array_max(_trailing(h, i, n)), F.array_min(_trailing(lo, i, n))
        return F.when(top == bottom, F.lit(50.0)).otherwise((F.get(c, i) - bottom) / (top - bottom) * 100)

    return _each(c, k)


@register("max_drawdown")
def _max_drawdown(x: Typed) -> Column:
    zero = F.struct(F.lit(-math.inf).alias("peak"), F.lit(0.0).alias("worst"))

    def step(a: Column, v: Column) -> Column:
        peak = F.greatest(a["peak"], v)
        return F.struct(peak.alias("peak"), F.greatest(a["worst"], F.coalesce(F.try_divide(peak - v, peak), F.lit(0.0))).alias("worst"))

    return F.aggregate(doubles(x), zero, step, lambda a: a["worst"])


@register("sharpe_ratio", low=1, high=2)
def _sharpe(x: Typed, *rf: Typed) -> Column:
    r = doubles(x)
    return F.coalesce(F.try_divide(array_mean(r) - _float(rf, 0, 0.0), F.sqrt(array_var(r, 0))), F.lit(NAN))


@register("sortino_ratio", low=1, high=2)
def _sortino(x: Typed, *rf: Typed) -> Column:
    r, free = doubles(x), _float(rf, 0, 0.0)
    below = F.filter(r, lambda v: v < free)
    down = F.sqrt(array_mean(F.transform(below, lambda v: (v - free) * (v - free))))
    ratio = F.when(F.size(below) == 0, F.lit(math.inf)).otherwise(F.try_divide(array_mean(r) - free, down))
    return F.when(F.size(r) == 0, F.lit(NAN)).otherwise(ratio)


def _beta_of(a: Column, m: Column) -> Column:
    ma, mm = array_mean(a), array_mean(m)
    cov = array_mean(_each(a, lambda i: (F.get(a, i) - ma) * (F.get(m, i) - mm)))
    same = F.size(a) == F.size(m)
    return F.when(same, F.coalesce(F.try_divide(cov, array_var(m, 0)), F.lit(NAN))).otherwise(F.lit(NAN))


@register("beta", low=2)
def _beta(asset: Typed, market: Typed) -> Column:
    return _beta_of(doubles(asset), doubles(market))


@register("alpha", low=2, high=3)
def _alpha(asset: Typed, market: Typed, *rf: Typed) -> Column:
    a, m, free = doubles(asset), doubles(market), _float(rf, 0, 0.0)
    return array_mean(a) - (free + _beta_of(a, m) * (array_mean(m) - free))


# ---- recursions -----------------------------------------------------------

Series = list


def ema(values: Series, period: int) -> Series:
    """Starts at the first value; weight ``2 / (period + 1)``."""
    k, out = 2 / (period + 1), []
    for v in values:
        out.append(v if not out else k * v + (1 - k) * out[-1])
    return out


def rsi(prices: Series, period: int = 14) -> Series:
    if len(prices) < period + 1:
        return [None] * len(prices)
    steps = [0.0, *(b - a for a, b in zip(prices, prices[1:], strict=False))]
    up, down = ema([max(s, 0.0) for s in steps], period), ema([max(-s, 0.0) for s in steps], period)
    return [50.0 if u + d == 0 else 100 * u / (u + d) for u, d in zip(up, down, strict=True)]


def macd(prices: Series, fast: int = 12, slow: int = 26, signal: int = 9) -> list[dict]:
    line = [a - b for a, b in zip(ema(prices, fast), ema(prices, slow), strict=True)]
    smooth = ema(line, signal)
    return [{"macd": m, "signal": s, "histogram": m - s} for m, s in zip(line, smooth, strict=True)]


def true_range(high: Series, low: Series, close: Series) -> Series:
    return [high[0] - low[0] if i == 0 else max(high[i] - low[i], abs(high[i] - close[i - 1]), abs(low[i] - close[i - 1])) for i in range(len(close))]


def atr(high: Series, low: Series, close: Series, period: int = 14) -> Series:
    return ema(true_range(high, low, close), period)


def directional_index(high: Series, low: Series, close: Series, period: int = 14) -> Series:
    """The directional movement index, from plain averages of ``period`` bars; null before two periods."""
    n = len(close)
    out: Series = [None] * n
    ranges = true_range(high, low, close) if n else []
    plus, minus = [0.0] * n, [0.0] * n
    for i in range(1, n):
        up, down = high[i] - high[i - 1], low[i - 1] - low[i]
        plus[i], minus[i] = up if up > down and up > 0 else 0.0, down if down > up and down > 0 else 0.0
    for i in range(2 * period - 1, n):
        window = range(i - period + 1, i + 1)
        total = sum(ranges[j] for j in window)
        if total:
            p, m = 100 * sum(plus[j] for j in window) / total, 100 * sum(minus[j] for j in window) / total
            out[i] = 100 * abs(p - m) / (p + m) if p + m else 0.0
    return out


def parabolic_sar(high: Series, low: Series, step: float = 0.02, most: float = 0.2) -> Series:
    """Stop and reverse: the stop speeds up with each new extreme and flips when it is touched."""
    n = len(high)
    if n < 3:
        return [None] * n
    rising = high[1] >= high[0]
    stop, extreme, speed = (low[0], high[0], step) if rising else (high[0], low[0], step)
    out: Series = [stop]
    for i in range(1, n):
        stop += speed * (extreme - stop)
        past = slice(max(0, i - 2), i)
        stop = min(stop, *low[past]) if rising else max(stop, *high[past])
        if (low[i] < stop) if rising else (high[i] > stop):
            rising, stop, speed = not rising, extreme, step
            extreme = high[i] if rising else low[i]
        elif (high[i] > extreme) if rising else (low[i] < extreme):
            extreme, speed = high[i] if rising else low[i], min(speed + step, most)
        out.append(stop)
    return out


def stoch_d(high: Series, low: Series, close: Series, k: int = 14, d: int = 3) -> Series:
    fast = []
    for i in range(len(close)):
        top, bottom = max(high[max(0, i - k + 1) : i + 1]), min(low[max(0, i - k + 1) : i + 1])
        fast.append(50.0 if top == bottom else (close[i] - bottom) / (top - bottom) * 100)
    return ema(fast, d)


_DOUBLES = "array<double>"
_MACD = "array<struct<macd:double,signal:double,histogram:double>>"
_MACD_TYPE = pa.list_(pa.struct([("macd", pa.float64()), ("signal", pa.float64()), ("histogram", pa.float64())]))


def _recursive(name: str, fn, series: int, params: int, whole: bool = True, ddl: str = _DOUBLES, kind: pa.DataType = None) -> None:
    """Register ``fn(series..., params...)``; a null in a series makes the result null."""
    kind = kind or pa.list_(pa.float64())

    def build(*args: Typed) -> Column:
        def run(*columns: pa.Array) -> pa.Array:
            out = []
            for row in zip(*(c.to_pylist() for c in columns), strict=True):
                bad = any(v is None or None in v for v in row[:series])
                options = [int(v) if whole else v for v in row[series:]]
                out.append(None if bad else fn(*row[:series], *options))
            return pa.array(out, kind)

        run.__annotations__ = {"columns": pa.Array, "return": pa.Array}
        return F.arrow_udf(run, ddl)(*[doubles(a) for a in args[:series]], *[double(a) for a in args[series:]])

    register(name, low=series, high=series + params)(build)


_recursive("rsi", rsi, 1, 1)
_recursive("macd", macd, 1, 3, ddl=_MACD, kind=_MACD_TYPE)
_recursive("atr", atr, 3, 1)
_recursive("adx", directional_index, 3, 1)
_recursive("parabolic_sar", parabolic_sar, 2, 2, whole=False)
_recursive("stoch_d", stoch_d, 3, 2)
