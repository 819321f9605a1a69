"""Joins of every kind.

Sides are joined on columns of one name or on pairs of names; ``null_equal``
makes null match null.  Columns of the right side that the left has too get a
suffix.  The physical join is left to Spark, which knows sizes at run time, but
for theta joins: there the smaller side is broadcast and the other spread.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names of join kinds, with Spark's name for each.
KINDS = {
    "inner": "inner", "left": "left", "left_outer": "left", "right": "right", "right_outer": "right", "outer": "full", "full": "full", "full_outer": "full",
    "cross": "cross", "semi": "left_semi", "left_semi": "left_semi", "anti": "left_anti", "left_anti": "left_anti",
}
VALIDATIONS = ("many_to_many", "one_to_one", "one_to_many", "many_to_one")

# Most bytes, as planned, of a side that every task of a theta join holds whole.
WHOLE_BYTES = 32 << 20


@dataclass(frozen=True)
class Keys:
    left: tuple[str, ...]
    right: tuple[str, ...]

    @classmethod
    def on(cls, *columns: str) -> Keys:
        return cls(columns, columns)

    @classmethod
    def left_right(cls, left: Sequence[str], right: Sequence[str]) -> Keys:
        if len(left) != len(right):
            raise ValueError("as many keys are needed on the left as on the right")
        return cls(tuple(left), tuple(right))


@dataclass(frozen=True)
class Options:
    how: str = "inner"
    suffix: str = "_right"
    validate: str = "many_to_many"
    sort: bool = False
    null_equal: bool = False
    coalesce: bool = field(default=True)


class ValidationError(ValueError):
    """Keys that are not unique where they must be."""


def kind_of(name: str) -> str:
    if name not in KINDS:
        raise ValueError(f"no join of kind {name!r}")
    return KINDS[name]


def _unique(df: DataFrame, keys: Sequence[str]) -> bool:
    return df.groupBy(*[F.col(f"`{k}`") for k in keys]).count().filter("count > 1").isEmpty()


def validate(left: DataFrame, right: DataFrame, keys: Keys, rule: str) -> None:
    """Raise if keys repeat on a side where the rule forbids it."""
    if rule not in VALIDATIONS:
        raise ValueError(f"no validation {rule!r}")
    if rule in ("one_to_one", "one_to_many") and not _unique(left, keys.left):
        raise ValidationError("keys repeat on the left")
    if rule in ("one_to_one", "many_to_one") and not _unique(right, keys.right):
        raise ValidationError("keys repeat on the right")


def renamed(left: DataFrame, right: DataFrame, suffix: str, dropped: frozenset[str] = frozenset()) -> dict[str, str]:
    """New name of each column of the right side that is kept."""
    taken, out = set(left.columns), {}
    for name in right.columns:
        if name in dropped:
            continue
        new = name
        while new in taken:
            new += suffix
        taken.add(new)
        out[name] = new
    return out


def join(left: DataFrame, right: DataFrame, keys: Keys, options: Options | None = None, **changes) -> DataFrame:
    """Join two frames.  Keys of one name appear once; pairs of names keep both."""
    o = replace(options or Options(), **changes)
    how = kind_of(o.how)
    if o.validate != "many_to_many":
        validate(left, right, keys, o.validate)
    if how == "cross":
        return left.crossJoin(right.withColumnsRenamed(renamed(left, right, o.suffix)))
    inner = right.toDF(*[f"__r{i}" for i in range(len(right.columns))])
    at = {name: f"__r{i}" for i, name in enumerate(right.columns)}
    condition = _condition(left, keys, at, o.null_equal)
    joined = left.join(inner, condition, how)
    if how in ("left_semi", "left_anti"):
        return _sorted(joined, keys, o)
    same = frozenset(r for a, r in zip(keys.left, keys.right, strict=True) if a == r) if o.coalesce else frozenset()
    names = renamed(left, right, o.suffix, same)
    key_pair = {a: at[r] for a, r in zip(keys.left, keys.right, strict=True) if a == r}
    cells = []
    for name in left.columns:
        own = F.col(f"`{name}`")
        cells.append(F.coalesce(own, F.col(key_pair[name])).alias(name) if name in key_pair and how in ("right", "full") and o.coalesce else own)
    cells += [F.col(at[name]).alias(new) for name, new in names.items()]
    return _sorted(joined.select(*cells), keys, o)


def _condition(left: DataFrame, keys: Keys, at: dict[str, str], null_equal: bool) -> Column:
    pairs = [(F.col(f"`{a}`"), F.col(at[b])) for a, b in zip(keys.left, keys.right, strict=True)]
    return reduce(lambda x, y: x & y, [a.eqNullSafe(b) if null_equal else a == b for a, b in pairs])


def _sorted(df: DataFrame, keys: Keys, o: Options) -> DataFrame:
    return df.orderBy(*[F.col(f"`{k}`").asc_nulls_first() for k in keys.left]) if o.sort else df


def inner_join(left: DataFrame, right: DataFrame, keys: Keys) -> DataFrame:
    return join(left, right, keys, how="inner")


def left_join(left: DataFrame, right: DataFrame, keys: Keys) -> DataFrame:
    return join(left, right, keys, how="left")


def right_join(left: DataFrame, right: DataFrame, keys: Keys) -> DataFrame:
    return join(left, right, keys, how="right")


def outer_join(left: DataFrame, right: DataFrame, keys: Keys) -> DataFrame:
    return join(left, right, keys, how="full")


def join_multiple(frames: Sequence[DataFrame], keys: Keys, options: Options | None = None) -> DataFrame:
    """Frames joined one after the other; the i-th one's clashes get ``_right_i``."""
    if not frames:
        raise ValueError("there is nothing to join")
    out = frames[0]
    for i, other in enumerate(frames[1:], 1):
        out = join(out, other, keys, options, suffix=f"_right_{i}")
    return out


def join_with_condition(left: DataFrame, right: DataFrame, condition: Column | str, how: str = "inner", suffix: str = "_right") -> DataFrame:
    """Theta join.  ``condition`` speaks of the joined names: clashes of the right side carry the suffix."""
    other = right.withColumnsRenamed(renamed(left, right, suffix))
    kind = kind_of(how)
    whole = _whole_side(left, other, kind)
    if whole == "right":
        left, other = _spread(left), F.broadcast(other)
    elif whole == "left":
        left, other = F.broadcast(left), _spread(other)
    return left.join(other, F.expr(condition) if isinstance(condition, str) else condition, kind)


def _whole_side(left: DataFrame, right: DataFrame, how: str) -> str | None:
    """The side that every task should hold whole, as comparing all pairs otherwise reads a side again for each part of the other; None if both are large."""
    size = lambda df: int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    can = {"right": how in ("inner", "cross", "left", "left_semi", "left_anti"), "left": how in ("inner", "cross", "right")}
    sizes = {side: size(df) for side, df in (("right", right), ("left", left)) if can[side]}
    least = min(sizes, key=sizes.get, default=None)
    return least if least and sizes[least] <= WHOLE_BYTES else None


def _spread(df: DataFrame) -> DataFrame:
    """``df`` over several tasks a core: a row's work is the other side's, however few the rows are."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism)


def asof_join(left: DataFrame, right: DataFrame, by: Sequence[str], at: str, value: str, out: str | None = None) -> DataFrame:
    """For each left row the last ``value`` of the right side at or before it, by one window over both sides."""
    from pyspark.sql import Window

    names = left.columns
    a = left.withColumns({"__value": F.lit(None).cast(right.schema[value].dataType), "__side": F.lit(1)})
    b = right.select(*by, at, F.col(value).alias("__value"), F.lit(0).alias("__side"))
    w = Window.partitionBy(*by).orderBy(at, "__side").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b, allowMissingColumns=True)
    return both.withColumn("__last", F.last("__value", True).over(w)).filter("__side = 1").select(*names, F.col("__last").alias(out or value))
