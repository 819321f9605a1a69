"""Arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .registry import FilterError, Typed, const, register, truthy


def _need_array(x: Typed, name: str) -> None:
    if not x.is_array:
        raise FilterError(f"{name} needs an array, not {x.dtype.simpleString()}")


@register("first")
def _first(x: Typed) -> Column:
    _need_array(x, "first")
    return F.get(x.col, F.lit(0))


@register("last", "array_pop")
def _last(x: Typed) -> Column:
    _need_array(x, "last")
    return F.try_element_at(x.col, F.lit(-1))


@register("reverse")
def _reverse(x: Typed) -> Column:
    return F.reverse(x.col)


@register("sort")
def _sort(x: Typed) -> Column:
    _need_array(x, "sort")
    return F.sort_array(x.col)


@register("unique")
def _unique(x: Typed) -> Column:
    _need_array(x, "unique")
    return F.array_distinct(x.col)


@register("flatten")
def _flatten(x: Typed) -> Column:
    _need_array(x, "flatten")
    inner = Typed(x.col, x.dtype.elementType)
    return F.flatten(x.col) if inner.is_array else x.col


@register("array_push", low=2, high=99)
def _push(x: Typed, *values: Typed) -> Column:
    _need_array(x, "array_push")
    return F.concat(x.col, F.array(*[v.col.cast(x.dtype.elementType) for v in values]))


@register("array_shift")
def _shift(x: Typed) -> Column:
    _need_array(x, "array_shift")
    return F.when(F.size(x.col) > 0, F.slice(x.col, 2, F.size(x.col))).otherwise(x.col)


@register("array_unshift", low=2, high=99)
def _unshift(x: Typed, *values: Typed) -> Column:
    """The length that the array has with the values put in front."""
    _need_array(x, "array_unshift")
    return F.size(x.col) + len(values)


@register("repeat", low=2)
def _repeat(x: Typed, n: Typed) -> Column:
    return F.array_repeat(x.col, F.greatest(n.col.cast("int"), F.lit(0)))


@register("zip", low=2, high=99)
def _zip(*arrays: Typed) -> Column:
    """Arrays of the elements at one place, as many as the shortest array has."""
    n = F.least(*[F.size(a.col) for a in arrays])
    same = all(a.dtype == arrays[0].dtype for a in arrays)
    item = lambda i: (F.array if same else F.struct)(*[F.get(a.col, i) if same else F.get(a.col, i).alias(f"_{k}") for k, a in enumerate(arrays)])
    places = F.filter(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda i: i < n)
    return F.transform(places, item)


@register("buffer", low=1, high=2)
def _buffer(x: Typed, *size: Typed) -> Column:
    _need_array(x, "buffer")
    n = int(const(size[0], "the size of buffer")) if size else 1024
    chunks = F.ceil(F.size(x.col) / n).cast("int")
    places = F.filter(F.sequence(F.lit(0), F.greatest(chunks, F.lit(1)) - 1), lambda i: i < chunks)
    return F.transform(places, lambda i: F.slice(x.col, i * n + 1, F.lit(n)))


@register("transpose")
def _transpose(x: Typed) -> Column:
    _need_array(x, "transpose")
    wide = F.size(F.get(x.col, F.lit(0)))
    places = F.filter(F.sequence(F.lit(0), F.greatest(wide, F.lit(1)) - 1), lambda i: i < wide)
    return F.transform(places, lambda i: F.transform(x.col, lambda row: F.get(row, i)))


@register("head", "limit", low=1, high=2)
def _head(x: Typed, *n: Typed) -> Column:
    _need_array(x, "head")
    return F.slice(x.col, 1, n[0].col.cast("int") if n else F.lit(5))


@register("tail", low=1, high=2)
def _tail(x: Typed, *n: Typed) -> Column:
    _need_array(x, "tail")
    k = F.least(n[0].col.cast("int") if n else F.lit(5), F.size(x.col))
    return F.slice(x.col, F.size(x.col) - k + 1, k)


@register("shape")
def _shape(x: Typed) -> Column:
    _need_array(x, "shape")
    return F.array(F.size(x.col).cast("long"))


@register("count_if", low=2)
def _count_if(x: Typed, mask: Typed) -> Column:
    inner = mask.dtype.elementType
    return F.size(F.filter(mask.col, lambda m: truthy(Typed(m, inner)))).cast("long")


@register("avg_if", low=2)
def _avg_if(x: Typed, mask: Typed) -> Column:
    return _avg_ifs(x, mask)


@register("avg_ifs", low=3, high=99)
def _avg_ifs(x: Typed, *masks: Typed) -> Column:
    good = F.lit(True)
    places = F.transform(x.col, lambda v, i: F.struct(v.cast("double").alias("v"), i.alias("i")))

    def held(p: Column) -> Column:
        ok = good
        for m in masks:
            ok = ok & truthy(Typed(F.get(m.col, p["i"]), m.dtype.elementType))
        return ok

    from .aggregates import array_mean

    return array_mean(F.transform(F.filter(places, held), lambda p: p["v"]))


@register("group_concat", low=1, high=2)
def _group_concat(x: Typed, *sep: Typed) -> Column:
    from .registry import shown

    _need_array(x, "group_concat")
    return F.array_join(F.transform(x.col, lambda v: shown(Typed(v, x.dtype.elementType))), sep[0].value if sep else ",")


@register("zscore")
def _zscore(x: Typed) -> Column:
    from .aggregates import array_mean, array_var

    values = F.transform(x.col, lambda v: v.cast("double"))
    sigma = F.sqrt(array_var(values, 0))
    safe = F.when(sigma == 0, F.raise_error(F.lit("zscore: no deviation")).cast("double")).otherwise(sigma) if not x.safe else F.when(sigma != 0, sigma)
    return F.transform(values, lambda v: (v - array_mean(values)) / safe)


@register("histogram", low=1, high=2)
def _histogram(x: Typed, *bins: Typed) -> Column:
    """{counts, bins}: equal widths between the extremes, the last bin closed."""
    n = int(const(bins[0], "the number of bins")) if bins else 10
    values = F.filter(F.transform(x.col, lambda v: v.cast("double")), lambda v: v.isNotNull())
    low, high = F.array_min(values), F.array_max(values)
    span = F.when(high > low, high - low).otherwise(F.lit(1.0))
    place = lambda v: F.least(F.floor((v - low) / span * n), F.lit(n - 1))
    counts = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.size(F.filter(values, lambda v: place(v) == i)).cast("long"))
    edges = F.transform(F.sequence(F.lit(0), F.lit(n)), lambda i: low + span * i / n)
    return F.struct(counts.alias("counts"), edges.alias("bins"))


def _frequencies(x: Typed) -> Column:
    """Distinct values with their counts and first places, most frequent first, then first seen."""
    return F.array_sort(
        F.transform(F.array_distinct(x.col), lambda v: F.struct(v.alias("value"), F.size(F.filter(x.col, lambda w: w.eqNullSafe(v))).cast("long").alias("count"), F.coalesce(F.array_position(x.col, v), F.lit(0)).alias("place"))),
        lambda a, b: F.when(a["count"] != b["count"], F.signum(b["count"] - a["count"])).otherwise(F.signum(a["place"] - b["place"])).cast("int"),
    )


@register("most_frequent")
def _most_frequent(x: Typed) -> Column:
    return F.get(_frequencies(x), F.lit(0))["value"]


@register("least_frequent")
def _least_frequent(x: Typed) -> Column:
    return F.try_element_at(_frequencies(x), F.lit(-1))["value"]


@register("value_counts", low=1, high=2)
def _value_counts(x: Typed, *sort: Typed) -> Column:
    found = _frequencies(x)
    if not (sort and sort[0].value):
        found = F.array_sort(found, lambda a, b: F.signum(a["place"] - b["place"]).cast("int"))
    return F.transform(found, lambda s: F.struct(s["value"].alias("value"), s["count"].alias("count")))


def _ordered(x: Typed, args: tuple[Typed, ...]) -> Column:
    found = _frequencies(x)
    if len(args) > 1 and args[1].value is False:
        found = F.reverse(found)
    return F.slice(found, 1, args[0].col.cast("int"))


@register("topk", low=2, high=3)
def _topk(x: Typed, *args: Typed) -> Column:
    return F.transform(_ordered(x, args), lambda s: s["value"])


@register("topk_with_counts", low=2, high=3)
def _topk_with_counts(x: Typed, *args: Typed) -> Column:
    return F.transform(_ordered(x, args), lambda s: F.struct(s["value"].alias("value"), s["count"].alias("count")))


@register("correl", low=2)
def _correl(a: Typed, b: Typed) -> Column:
    from .aggregates import pearson

    return pearson(F.transform(a.col, lambda v: v.cast("double")), F.transform(b.col, lambda v: v.cast("double")))
