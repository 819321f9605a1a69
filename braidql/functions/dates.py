"""Dates and times; everything is UTC except the local forms."""

from __future__ import annotations

import os
import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .registry import FilterError, Typed, const, register

# Text forms that stand for an instant, tried in this order.
PATTERNS = ["yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd", "yyyy/MM/dd HH:mm:ss", "yyyy/MM/dd"]
_RFC3339 = r"^\d{4}-\d\d-\d\d[Tt ]\d\d:\d\d:\d\d(\.\d+)?([Zz]|[+-]\d\d:\d\d)$"


def instant(x: Typed) -> Column:
    """A timestamp of epoch seconds, a date, or text in one of the known forms; null if it is none."""
    t = x.dtype
    if isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return x.col.cast("timestamp")
    if x.is_integer:
        return F.timestamp_seconds(x.col)
    if x.is_number:
        return F.timestamp_micros((x.col.cast("double") * 1_000_000).cast("long"))
    if x.is_string:
        exact = F.when(x.col.rlike(_RFC3339), x.col.try_cast("timestamp"))
        return F.coalesce(exact, *[F.try_to_timestamp(x.col, F.lit(p)) for p in PATTERNS])
    raise FilterError(f"no instant can be made of {t.simpleString()}")


def seconds(c: Column) -> Column:
    return F.unix_seconds(c)


for _name, _fn in {"year": F.year, "month": F.month, "day": F.dayofmonth, "hour": F.hour, "minute": F.minute, "second": F.second}.items():
    register(_name, each="date")(lambda x, fn=_fn: fn(instant(x)))


@register("now", low=0, high=1)
def _now(*_: Typed) -> Column:
    return F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss 'UTC'")


@register("today", low=0, high=1)
def _today(*_: Typed) -> Column:
    return F.date_format(F.current_date(), "yyyy-MM-dd")


@register("systime", "systime_ns", low=0, high=1)
def _systime(*_: Typed) -> Column:
    return F.unix_micros(F.current_timestamp()) * 1000


@register("systime_int", low=0, high=1)
def _systime_int(*_: Typed) -> Column:
    return F.unix_seconds(F.current_timestamp())


@register("start_of_month", each="date")
def _start_of_month(x: Typed) -> Column:
    return F.date_format(F.trunc(instant(x), "month"), "yyyy-MM-dd")


@register("end_of_month", each="date")
def _end_of_month(x: Typed) -> Column:
    return seconds(F.last_day(instant(x)).cast("timestamp")) + 86399


@register("start_of_week", low=1, high=2, each="date")
def _start_of_week(x: Typed, *first: Typed) -> Column:
    day = const(first[0], "the first day of the week").lower() if first else "monday"
    at = instant(x)
    if day == "monday":
        return seconds(F.date_trunc("week", at))
    if day == "sunday":
        return seconds(F.date_trunc("week", at + F.expr("INTERVAL 1 DAY")) - F.expr("INTERVAL 1 DAY"))
    raise FilterError(f"a week cannot start on {day}")


@register("end_of_week", each="date")
def _end_of_week(x: Typed) -> Column:
    return F.dayofweek(instant(x)) == 1


def _truncated(x: Typed, unit: Typed) -> Column:
    name = const(unit, "the unit").lower()
    if name not in ("year", "quarter", "month", "week", "day", "hour", "minute", "second"):
        raise FilterError(f"no unit {name}")
    return F.date_trunc(name, instant(x))


@register("truncate_date", low=2, each="date")
def _truncate_date(x: Typed, unit: Typed) -> Column:
    return seconds(_truncated(x, unit))


@register("truncate_time", low=2, each="date")
def _truncate_time(x: Typed, unit: Typed) -> Column:
    return seconds(_truncated(x, unit))


@register("date_diff", low=2)
def _date_diff(a: Typed, b: Typed) -> Column:
    return F.floor(F.abs(seconds(instant(a)) - seconds(instant(b))) / 86400).cast("long")


_UNITS = {"s": "SECOND", "m": "MINUTE", "h": "HOUR", "d": "DAY", "w": "WEEK"}


@register("time_series_range", low=3)
def _time_series_range(start: Typed, end: Typed, step: Typed) -> Column:
    found = re.fullmatch(r"\s*(\d+)\s*([smhdw])\w*\s*", const(step, "the step"))
    if not found or not int(found[1]):
        raise FilterError(f"no step {step.value}")
    a, b = instant(start), instant(end)
    points = F.transform(F.sequence(a, b, F.expr(f"INTERVAL {found[1]} {_UNITS[found[2]]}")), seconds)
    return F.when(a < b, points).otherwise(F.array().cast("array<long>"))


@register("gmtime", each="date")
def _gmtime(x: Typed) -> Column:
    at = instant(x)
    parts = {"year": F.year, "month": F.month, "day": F.dayofmonth, "hour": F.hour, "minute": F.minute, "second": F.second, "weekday": lambda c: F.dayofweek(c) - 1, "yearday": F.dayofyear}
    return F.struct(*[fn(at).alias(name) for name, fn in parts.items()])


def _local(at: Column) -> Column:
    return F.from_utc_timestamp(at, os.environ.get("TZ") or "UTC")


@register("localtime", each="date")
def _localtime(x: Typed) -> Column:
    return F.date_format(_local(instant(x)), "yyyy-MM-dd HH:mm:ss")


@register("mktime")
def _mktime(x: Typed) -> Column:
    found = F.try_to_timestamp(x.col, F.lit("yyyy-MM-dd HH:mm:ss"))
    if x.safe:
        return seconds(found)
    return F.when(x.col.isNotNull() & found.isNull(), F.raise_error(F.lit("mktime: not YYYY-MM-DD HH:MM:SS")).cast("long")).otherwise(seconds(found))


# Java letters of the strftime codes.
CODES = {
    "Y": "yyyy", "m": "MM", "d": "dd", "H": "HH", "M": "mm", "S": "ss", "y": "yy", "b": "MMM", "h": "MMM", "B": "MMMM", "a": "EEE", "A": "EEEE", "j": "DDD", "I": "hh", "p": "a",
    "e": "d", "F": "yyyy-MM-dd", "T": "HH:mm:ss", "D": "MM/dd/yy", "R": "HH:mm", "f": "SSSSSSSSS", "z": "xx", "Z": "VV", "n": "\n", "t": "\t", "%": "%",
}


def java_pattern(form: str) -> str:
    """The datetime pattern of a strftime format."""
    out = []
    for code, plain in re.findall(r"%(.)|([^%]+)", form, re.S):
        if plain:
            out.append(re.sub(r"[A-Za-z]+", lambda m: f"'{m[0]}'", plain.replace("'", "''")))
        elif code in CODES:
            out.append(CODES[code])
        else:
            raise FilterError(f"no format code %{code}")
    return "".join(out)


def _format(at: Column, form: Typed) -> Column:
    text = const(form, "the format")
    if "%s" in text or "%u" in text:  # epoch seconds and ISO weekday have no pattern letter
        parts = re.split(r"(%s|%u)", text)
        return F.concat(*[F.unix_seconds(at).cast("string") if p == "%s" else (F.weekday(at) + 1).cast("string") if p == "%u" else F.date_format(at, java_pattern(p)) for p in parts if p])
    return F.date_format(at, java_pattern(text))


@register("strftime", low=2, each="date")
def _strftime(x: Typed, form: Typed) -> Column:
    return _format(instant(x), form)


@register("strflocaltime", low=2, each="date")
def _strflocaltime(x: Typed, form: Typed) -> Column:
    return _format(_local(instant(x)), form)


@register("strptime", low=2, each="str")
def _strptime(x: Typed, form: Typed) -> Column:
    forms = form.value if isinstance(form.value, list) else [const(form, "the format")]
    found = [F.try_to_timestamp(x.col, F.lit(java_pattern(f))) for f in forms]
    return seconds(F.coalesce(*found) if len(found) > 1 else found[0])
