"""Syntax trees to columns, against a static schema."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.registry import REGISTRY, FilterError, Typed, call, const, literal, text, truthy, type_of
from ..lang import ast as A

#: Functions whose first argument is always the piped value.
TAKES_INPUT = frozenset("head tail limit url_set_protocol replace spaces_to_tabs tabs_to_spaces contains".split())


@dataclass(frozen=True)
class Scope:
    """What ``.`` is, the variables, and whether errors become null."""

    dot: Typed
    row: bool = False
    params: dict[str, Any] = field(default_factory=dict)
    safe: bool = False

    def at(self, dot: Typed) -> Scope:
        return replace(self, dot=dot, row=False)


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def row_scope(schema: T.StructType, params: dict[str, Any] | None = None, hidden: frozenset[str] = frozenset()) -> Scope:
    """``.`` is a row of a frame."""
    shown = T.StructType([f for f in schema.fields if f.name not in hidden])
    whole = F.struct(*[quoted(f.name).alias(f.name) for f in shown.fields])
    return Scope(Typed(whole, shown), True, params or {})


_TIMES = (T.DateType, T.TimestampType, T.TimestampNTZType)


def unify(items: list[Typed]) -> tuple[list[Column], T.DataType]:
    """Columns of one common type."""
    kinds = [i.dtype for i in items if not i.is_null]
    if not kinds:
        return [i.col for i in items], T.NullType()
    if all(k == kinds[0] for k in kinds):
        return [i.col if not i.is_null else F.lit(None).cast(kinds[0]) for i in items], kinds[0]
    if all(isinstance(k, T.NumericType) for k in kinds):
        wide = T.LongType() if all(Typed(F.lit(0), k).is_integer for k in kinds) else T.DoubleType()
        return [i.col.cast(wide) for i in items], wide
    if all(isinstance(k, T.ArrayType) and isinstance(k.elementType, T.NumericType) for k in kinds):
        whole = all(Typed(F.lit(0), k.elementType).is_integer for k in kinds)
        wide = T.ArrayType(T.LongType() if whole else T.DoubleType())
        return [i.col.cast(wide) for i in items], wide
    return [text(i) for i in items], T.StringType()


def field_of(base: Typed, name: str, row: bool = False) -> Typed:
    t = base.dtype
    if isinstance(t, T.StructType):
        found = next((f for f in t.fields if f.name == name), None)
        if found is None:
            return literal(None)
        return Typed(quoted(name) if row else base.col.getField(name), found.dataType)
    if isinstance(t, T.ArrayType):
        inner = field_of(Typed(F.lit(None).cast(t.elementType), t.elementType), name)
        return Typed(F.transform(base.col, lambda x: field_of(Typed(x, t.elementType), name).col), T.ArrayType(inner.dtype))
    if isinstance(t, T.MapType):
        return Typed(F.try_element_at(base.col, F.lit(name)), t.valueType)
    if isinstance(t, T.VariantType):
        return Typed(F.try_variant_get(base.col, F.lit(f"$['{name}']"), "variant"), t)
    if base.is_null:
        return base
    raise FilterError(f"no field {name!r} in a value of type {t.simpleString()}")


def index_of(base: Typed, index: Typed) -> Typed:
    t = base.dtype
    if base.is_null:
        return base
    if index.is_string:
        return field_of(base, const(index, "a key"))
    i = index.col.cast("int")
    if isinstance(t, T.ArrayType):
        if isinstance(index.value, int):
            return Typed(F.try_element_at(base.col, F.lit(index.value + 1 if index.value >= 0 else index.value)), t.elementType)
        return Typed(F.try_element_at(base.col, F.when(i >= 0, i + 1).otherwise(i)), t.elementType)
    if base.is_string:
        n = F.char_length(base.col)
        place = F.when(i < 0, i + n).otherwise(i)
        return Typed(F.when((place >= 0) & (place < n), F.substring(base.col, place + 1, F.lit(1))), t)
    if isinstance(t, T.VariantType):
        return Typed(F.try_variant_get(base.col, F.lit(f"$[{const(index, 'the index')}]"), "variant"), t)
    raise FilterError(f"cannot index a value of type {t.simpleString()}")


def slice_of(base: Typed, start: Typed | None, stop: Typed | None) -> Typed:
    n = F.size(base.col) if base.is_array else F.char_length(base.col)
    bound = lambda b, none: none if b is None else F.least(F.greatest(F.when(b.col < 0, b.col + n).otherwise(b.col), F.lit(0)), n).cast("int")
    a, b = bound(start, F.lit(0)), bound(stop, n)
    size = F.greatest(b - a, F.lit(0))
    if base.is_array:
        return Typed(F.slice(base.col, a + 1, size), base.dtype)
    if base.is_string:
        return Typed(F.substring(base.col, a + 1, size), base.dtype)
    raise FilterError("only arrays and strings can be sliced")


def arithmetic(op: str, a: Typed, b: Typed, safe: bool = False) -> Typed:
    if a.is_null or b.is_null:
        return Typed(F.lit(None).cast("double"), T.DoubleType())
    if op == "+" and a.is_string and b.is_string:
        return Typed(F.concat(a.col, b.col), T.StringType())
    if op == "+" and a.is_array and b.is_array:
        return Typed(F.concat(a.col, b.col), a.dtype)
    if op == "+" and a.is_struct and b.is_struct:
        names = {f.name: a.col.getField(f.name) for f in a.dtype.fields} | {f.name: b.col.getField(f.name) for f in b.dtype.fields}
        merged = F.struct(*[c.alias(n) for n, c in names.items()])
        return Typed(merged, T.StructType([*[f for f in a.dtype.fields if f.name not in b.dtype.names], *b.dtype.fields]))
    if a.is_array and b.is_number or a.is_number and b.is_array:
        over, inner = (a, lambda x: arithmetic(op, x, b, safe)) if a.is_array else (b, lambda x: arithmetic(op, a, x, safe))
        element = over.dtype.elementType
        kind = inner(Typed(F.lit(None).cast(element), element)).dtype
        return Typed(F.transform(over.col, lambda x: inner(Typed(x, element)).col), T.ArrayType(kind))
    if not (a.is_number and b.is_number):
        raise FilterError(f"cannot apply {op} to {a.dtype.simpleString()} and {b.dtype.simpleString()}")
    if op == "/":
        x, y = a.col.cast("double"), b.col.cast("double")
        return Typed(F.try_divide(x, y) if safe else x / y, T.DoubleType())
    whole = a.is_integer and b.is_integer
    to = (lambda t: t.col.cast("long")) if whole else (lambda t: t.col if isinstance(t.dtype, T.DoubleType) else t.col.cast("double"))
    tried = {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}
    plain = {"+": lambda x, y: x + y, "-": lambda x, y: x - y, "*": lambda x, y: x * y}
    return Typed((tried if safe and whole else plain)[op](to(a), to(b)), T.LongType() if whole else T.DoubleType())


def _comparable(a: Typed, b: Typed) -> tuple[Column, Column] | None:
    if isinstance(a.dtype, _TIMES) and b.is_string:
        return a.col, b.col.cast(a.dtype)
    if isinstance(b.dtype, _TIMES) and a.is_string:
        return a.col.cast(b.dtype), b.col
    same = a.is_number and b.is_number or type(a.dtype) is type(b.dtype) or isinstance(a.dtype, _TIMES) and isinstance(b.dtype, _TIMES)
    return (a.col, b.col) if same else None


def comparison(op: str, a: Typed, b: Typed) -> Column:
    """Never null: null equals null and is below everything else."""
    if op in ("==", "!="):
        if a.is_null or b.is_null:
            found = F.lit(True) if a.is_null and b.is_null else (b if a.is_null else a).col.isNull()
        else:
            pair = _comparable(a, b)
            found = pair[0].eqNullSafe(pair[1]) if pair else a.col.isNull() & b.col.isNull()
        return ~found if op == "!=" else found
    if a.is_null or b.is_null:
        other = b if a.is_null else a
        some = F.lit(False) if other.is_null else other.col.isNotNull()
        strict = some if (op in ("<", "<=")) == a.is_null else F.lit(False)
        return strict | ~some if op in ("<=", ">=") else strict
    pair = _comparable(a, b)
    if pair is None:
        raise FilterError(f"cannot order {a.dtype.simpleString()} and {b.dtype.simpleString()}")
    x, y = pair
    if op in (">", ">="):
        x, y, a, b, op = y, x, b, a, {">": "<", ">=": "<="}[op]
    base = x < y if op == "<" else x <= y
    if a.value is not None:  # a constant below the other: null is never above it
        return F.coalesce(base, F.lit(False))
    if b.value is not None:
        return x.isNull() | base
    nulls = F.when(x.isNull(), y.isNotNull() if op == "<" else F.lit(True)).when(y.isNull(), F.lit(False))
    return nulls.otherwise(base)


def predicate(node: A.Node, scope: Scope) -> Column:
    """A condition for a row filter: plain comparisons, so that scans can use them."""
    if isinstance(node, A.Binary) and node.op in ("and", "or"):
        a, b = predicate(node.left, scope), predicate(node.right, scope)
        return a & b if node.op == "and" else a | b
    if isinstance(node, A.Binary) and node.op in (">", ">="):
        a, b = evaluate(node.left, scope), evaluate(node.right, scope)
        if b.value is not None and (pair := _comparable(a, b)):
            return pair[0] > pair[1] if node.op == ">" else pair[0] >= pair[1]
    if isinstance(node, A.Binary) and node.op in ("<", "<="):
        a, b = evaluate(node.left, scope), evaluate(node.right, scope)
        if a.value is not None and (pair := _comparable(a, b)):
            return pair[0] < pair[1] if node.op == "<" else pair[0] <= pair[1]
    found = evaluate(node, scope)
    return found.col if isinstance(found.dtype, T.BooleanType) else truthy(found)


def over_array(array: Typed, body: A.Node, scope: Scope) -> tuple[Any, T.DataType]:
    """(function of an element column, its type) of ``body`` applied to elements."""
    inner = array.dtype.elementType
    kind = evaluate(body, scope.at(Typed(F.lit(None).cast(inner), inner))).dtype
    return (lambda x: evaluate(body, scope.at(Typed(x, inner))).col), kind


def _need_array(x: Typed, name: str) -> None:
    if not x.is_array:
        raise FilterError(f"{name} needs an array, not {x.dtype.simpleString()}")


def _map(x: Typed, body: A.Node, scope: Scope) -> Typed:
    if not x.is_array:
        return evaluate(body, scope.at(x))
    if isinstance(body, A.Identity):
        return x
    if isinstance(body, A.Call) and body.name in ("select", "filter") and len(body.args) == 1:
        return _filter(x, body.args[0], scope)
    if isinstance(body, A.Pipe) and isinstance(body.stages[0], A.Call) and body.stages[0].name == "select":
        rest = body.stages[1] if len(body.stages) == 2 else A.Pipe(body.stages[1:])
        return _map(_filter(x, body.stages[0].args[0], scope), rest, scope)
    fn, kind = over_array(x, body, scope)
    return Typed(F.filter(F.transform(x.col, fn), lambda v: v.isNotNull()), T.ArrayType(kind))


def _filter(x: Typed, body: A.Node, scope: Scope) -> Typed:
    inner = x.dtype.elementType
    return Typed(F.filter(x.col, lambda v: truthy(evaluate(body, scope.at(Typed(v, inner))))), x.dtype)


def _keyed(x: Typed, keys: tuple[A.Node, ...], scope: Scope) -> Typed:
    """Elements as (key, place, element), in ascending order of these."""
    inner = x.dtype.elementType
    key = lambda v: F.struct(*[evaluate(k, scope.at(Typed(v, inner))).col.alias(f"k{i}") for i, k in enumerate(keys)])
    rows = F.sort_array(F.transform(x.col, lambda v, i: F.struct(key(v).alias("k"), i.alias("i"), v.alias("v"))))
    return Typed(rows, x.dtype)


def _special(node: A.Call, scope: Scope) -> Typed | None:
    """Forms whose arguments are filters of their own."""
    name, args, dot = node.name, node.args, scope.dot
    if name in ("map", "map_values", "transform_values") and args and not (name == "transform_values" and isinstance(args[-1], A.Object)):
        source, body = (dot, args[0]) if len(args) == 1 else (evaluate(args[0], scope), args[1])
        if name != "map" and source.is_struct:
            cells = [(f.name, evaluate(body, scope.at(field_of(source, f.name, scope.row and source is dot)))) for f in source.dtype.fields]
            return Typed(F.struct(*[c.col.alias(n) for n, c in cells]), T.StructType([T.StructField(n, c.dtype) for n, c in cells]))
        if name != "map" and isinstance(source.dtype, T.MapType):
            inner = source.dtype.valueType
            build = lambda v: evaluate(body, scope.at(Typed(v, inner))).col
            kind = evaluate(body, scope.at(Typed(F.lit(None).cast(inner), inner))).dtype
            return Typed(F.transform_values(source.col, lambda _, v: build(v)), T.MapType(source.dtype.keyType, kind))
        return _map(source, body, scope)
    if name in ("select", "filter") and len(args) == 1:
        if dot.is_array:
            return _filter(dot, args[0], scope)
        return Typed(F.when(truthy(evaluate(args[0], scope)), dot.col), dot.dtype)
    if name in ("sort_by", "min_by", "max_by", "group_by") and args:
        source, keys = (evaluate(args[0], scope), args[1:]) if len(args) > 1 and not scope.dot.is_array else (dot, args)
        _need_array(source, name)
        rows = _keyed(source, keys, scope).col
        if name == "sort_by":
            return Typed(F.transform(rows, lambda r: r["v"]), source.dtype)
        if name == "min_by":
            return Typed(F.get(rows, F.lit(0))["v"], source.dtype.elementType)
        if name == "max_by":
            best = F.filter(rows, lambda r: r["k"].eqNullSafe(F.try_element_at(rows, F.lit(-1))["k"]))
            return Typed(F.get(best, F.lit(0))["v"], source.dtype.elementType)
        kinds = F.array_distinct(F.transform(rows, lambda r: r["k"]))
        groups = F.transform(kinds, lambda k: F.transform(F.filter(rows, lambda r: r["k"].eqNullSafe(k)), lambda r: r["v"]))
        return Typed(groups, T.ArrayType(source.dtype))
    if name == "iferror" and len(args) == 2:
        tried, other = evaluate(args[0], replace(scope, safe=True)), evaluate(args[1], scope)
        cols, kind = unify([tried, other])
        return Typed(F.coalesce(*cols), kind)
    return None


def _arguments(node: A.Call, scope: Scope) -> list[Typed]:
    """Arguments in either style: all given, or the first one piped in."""
    spec = REGISTRY.get(node.name)
    if spec is None:
        raise FilterError(f"unknown function {node.name}")
    args = [evaluate(a, scope) for a in node.args]
    if not args:
        return [] if spec.high == 0 or spec.low == 0 and (scope.row or spec.high > 0) else [scope.dot]
    few = len(args) < spec.low
    piped = node.name in TAKES_INPUT and len(args) < spec.high
    constant = len(args) < spec.high and not scope.row and all(a.value is not None for a in args) and spec.high < 90
    return [scope.dot, *args] if few or piped or constant else args


def invoke(name: str, args: list[Typed], safe: bool) -> Typed:
    return call(name, [replace(a, safe=True) for a in args] if safe else args)


def put_field(base: Typed, path: list[str], value: Typed) -> Typed:
    """The object with a field set, made where it is missing."""
    if not base.is_struct:
        base = Typed(F.struct(), T.StructType([]))
    name, rest = path[0], path[1:]
    if rest:
        value = put_field(field_of(base, name), rest, value)
    cells = {f.name: (base.col.getField(f.name), f.dataType) for f in base.dtype.fields} | {name: (value.col, value.dtype)}
    return Typed(F.struct(*[c.alias(n) for n, (c, _) in cells.items()]), T.StructType([T.StructField(n, t) for n, (_, t) in cells.items()]))


def path_of(node: A.Node) -> list[str]:
    """Field names of a plain path ``.a.b``."""
    if isinstance(node, A.Identity):
        return []
    if isinstance(node, A.Field):
        return [*path_of(node.base), node.name]
    raise FilterError("only a plain path can be changed")


def assigned(node: A.Assign, scope: Scope) -> tuple[list[str], Typed]:
    """(path, new value) of an assignment; the right side sees the whole object."""
    path, value = path_of(node.target), evaluate(node.value, scope)
    if node.op == "+=":
        old = evaluate(node.target, scope)
        try:
            value = arithmetic("+", old, value, scope.safe)
        except FilterError:
            pass  # kinds that do not add: the new value replaces the old
    return path, value


def evaluate(node: A.Node, scope: Scope) -> Typed:
    """The column of an expression."""
    if isinstance(node, A.Identity):
        return scope.dot
    if isinstance(node, A.Literal):
        return literal(node.value)
    if isinstance(node, A.Variable):
        if node.name not in scope.params:
            raise FilterError(f"no variable ${node.name}")
        return literal(scope.params[node.name])
    if isinstance(node, A.Field):
        base = evaluate(node.base, scope)
        return field_of(base, node.name, scope.row and isinstance(node.base, A.Identity))
    if isinstance(node, A.Index):
        return index_of(evaluate(node.base, scope), evaluate(node.index, scope))
    if isinstance(node, A.Slice):
        bound = lambda b: None if b is None else evaluate(b, scope)
        return slice_of(evaluate(node.base, scope), bound(node.start), bound(node.stop))
    if isinstance(node, A.Iterate):
        base = evaluate(node.base, scope)
        return base if base.is_array else call("values", [base])
    if isinstance(node, A.Binary):
        if node.op in ("and", "or"):
            a, b = truthy(evaluate(node.left, scope)), truthy(evaluate(node.right, scope))
            return Typed(a & b if node.op == "and" else a | b, T.BooleanType())
        a, b = evaluate(node.left, scope), evaluate(node.right, scope)
        if node.op in "+-*/":
            return arithmetic(node.op, a, b, scope.safe)
        return Typed(comparison(node.op, a, b), T.BooleanType())
    if isinstance(node, A.Not):
        return Typed(~truthy(evaluate(node.operand, scope)), T.BooleanType())
    if isinstance(node, A.Negate):
        return arithmetic("-", literal(0), evaluate(node.operand, scope), scope.safe)
    if isinstance(node, A.If):
        cols, kind = unify([evaluate(node.then, scope), evaluate(node.otherwise, scope)])
        return Typed(F.when(truthy(evaluate(node.condition, scope)), cols[0]).otherwise(cols[1]), kind)
    if isinstance(node, A.Try):
        return _special(A.Call("iferror", (node.body, node.fallback)), scope)
    if isinstance(node, A.Pipe):
        for stage in node.stages:
            scope = scope.at(found) if (found := evaluate(stage, scope)) is not scope.dot else scope
        return scope.dot
    if isinstance(node, (A.Sequence, A.Array)):
        if not node.items:
            return Typed(F.array().cast("array<string>"), T.ArrayType(T.StringType()), [])
        items = [evaluate(i, scope) for i in node.items]
        cols, kind = unify(items)
        values = [i.value for i in items]
        return Typed(F.array(*cols), T.ArrayType(kind), values if None not in values else None)
    if isinstance(node, A.Object):
        cells = [(k, evaluate(v, scope)) for k, v in node.entries]
        made = F.struct(*[c.col.alias(k) for k, c in cells])
        fixed = {k: c.value for k, c in cells} if all(c.value is not None for _, c in cells) else None
        kind = T.StructType([T.StructField(k, c.dtype) for k, c in cells])
        return Typed(made if scope.row or fixed is not None else F.when(scope.dot.col.isNotNull(), made), kind, fixed)
    if isinstance(node, A.Assign):
        return put_field(scope.dot, *assigned(node, scope))
    if isinstance(node, A.Delete):
        path = path_of(node.target)
        kept = scope.dot.col.dropFields(".".join(path))
        return Typed(kept, type_of(lambda d: d.col.dropFields(".".join(path)), [scope.dot]))
    if isinstance(node, A.Call):
        found = _special(node, scope)
        return found if found is not None else invoke(node.name, _arguments(node, scope), scope.safe)
    raise FilterError(f"{type(node).__name__} is not an expression")
