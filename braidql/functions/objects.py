"""Objects, JSON and conditionals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .registry import FilterError, Typed, const, register, shown, text, truthy


@register("fromjson", low=1, high=2)
def _fromjson(x: Typed, *schema: Typed) -> Column:
    if schema:
        return F.from_json(x.col, const(schema[0], "the schema"))
    return F.try_parse_json(x.col) if x.safe else F.parse_json(x.col)


@register("tojson")
def _tojson(x: Typed) -> Column:
    if x.is_array or x.is_struct or isinstance(x.dtype, (T.MapType, T.VariantType)):
        return F.coalesce(F.to_json(x.col), F.lit("null"))
    if x.is_string:
        quoted = F.to_json(F.array(x.col))
        return F.when(x.col.isNull(), F.lit("null")).otherwise(F.substring(quoted, F.lit(2), F.length(quoted) - 2))
    return shown(x)


@register("json_get", low=2)
def _json_get(x: Typed, path: Typed) -> Column:
    return F.get_json_object(x.col if x.is_string else text(x), const(path, "the path"))


@register("keys")
def _keys(x: Typed) -> Column:
    if x.is_struct:
        return F.array(*[F.lit(n) for n in sorted(x.dtype.names)])
    if x.is_array:
        n = F.size(x.col)
        return F.filter(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda i: i < n)
    return F.array_sort(F.map_keys(x.col))


@register("values")
def _values(x: Typed) -> Column:
    if x.is_struct:
        kinds = {f.dataType.json() for f in x.dtype.fields}
        if all(isinstance(f.dataType, T.NumericType) for f in x.dtype.fields):
            whole = all(Typed(x.col, f.dataType).is_integer for f in x.dtype.fields)
            cell = lambda f: x.col[f.name].cast("long" if whole else "double")
        elif len(kinds) == 1:
            cell = lambda f: x.col[f.name]
        else:
            cell = lambda f: text(Typed(x.col[f.name], f.dataType))
        return F.array(*[cell(f) for f in x.dtype.fields])
    return x.col if x.is_array else F.map_values(x.col)


@register("has", low=2)
def _has(x: Typed, key: Typed) -> Column:
    if x.is_struct:
        return F.lit(const(key, "the key") in x.dtype.names)
    if isinstance(x.dtype, T.MapType):
        return F.coalesce(F.map_contains_key(x.col, key.col), F.lit(False))
    return F.lit(False)


@register("del", low=2, high=99)
def _del(x: Typed, *which: Typed) -> Column:
    if x.is_struct:
        gone = {const(w, "a key") for w in which}
        return F.struct(*[x.col[n].alias(n) for n in x.dtype.names if n not in gone])
    if x.is_array:
        n = F.size(x.col)
        places = [F.when(w.col < 0, w.col + n).otherwise(w.col) for w in which]
        return F.filter(x.col, lambda _, i: ~i.isin(*places))
    return F.map_filter(x.col, lambda k, _: ~k.isin(*[w.col for w in which]))


@register("transform_keys", low=2)
def _transform_keys(x: Typed, mapping: Typed) -> Column:
    if x.is_struct:
        names = mapping.value or {}
        return F.struct(*[x.col[n].alias(names.get(n, n)) for n in x.dtype.names])
    table = F.create_map(*[F.lit(v) for kv in (mapping.value or {}).items() for v in kv])
    return F.transform_keys(x.col, lambda k, _: F.coalesce(F.try_element_at(table, k), k))


@register("transform_values", low=2)
def _transform_values(x: Typed, mapping: Typed) -> Column:
    """Values looked up in a mapping; those it lacks stay."""
    table = mapping.value or {}

    def looked_up(v: Typed) -> Column:
        out = v.col
        for old, new in table.items():
            out = F.when(text(v) == str(old), F.lit(new).cast(v.dtype)).otherwise(out)
        return out

    if x.is_struct:
        return F.struct(*[looked_up(Typed(x.col[f.name], f.dataType)).alias(f.name) for f in x.dtype.fields])
    if x.is_array:
        return F.transform(x.col, lambda v: looked_up(Typed(v, x.dtype.elementType)))
    return F.transform_values(x.col, lambda _, v: looked_up(Typed(v, x.dtype.valueType)))


def leaves(c: Column, dtype: T.StructType, sep: str = ".", lead: str = "") -> list[tuple[str, Column, T.DataType]]:
    """(name, column, type) of all fields below nested objects."""
    out = []
    for f in dtype.fields:
        if isinstance(f.dataType, T.StructType):
            out += leaves(c[f.name], f.dataType, sep, f"{lead}{f.name}{sep}")
        else:
            out.append((lead + f.name, c[f.name], f.dataType))
    return out


@register("unnest", low=1, high=2)
def _unnest(x: Typed, *sep: Typed) -> Column:
    if not x.is_struct:
        raise FilterError("unnest needs an object")
    return F.struct(*[c.alias(name) for name, c, _ in leaves(x.col, x.dtype, sep[0].value if sep else ".")])


@register("empty")
def _empty(x: Typed) -> Column:
    if x.is_string:
        return F.coalesce(x.col == "", F.lit(True))
    if x.is_array or isinstance(x.dtype, T.MapType):
        return F.coalesce(F.size(x.col) == 0, F.lit(True))
    return x.col.isNull()


# Type names of the language.
def type_name(dtype: T.DataType) -> str:
    if isinstance(dtype, T.NullType):
        return "null"
    if isinstance(dtype, T.BooleanType):
        return "boolean"
    if isinstance(dtype, (T.LongType, T.IntegerType, T.ShortType, T.ByteType)):
        return "integer"
    if isinstance(dtype, T.DecimalType):
        return "biginteger" if not dtype.scale else "float"
    if isinstance(dtype, T.NumericType):
        return "float"
    if isinstance(dtype, T.ArrayType):
        return "array"
    if isinstance(dtype, (T.StructType, T.MapType)):
        return "object"
    return "string"


@register("type")
def _type(x: Typed) -> Column:
    return F.when(x.col.isNull(), F.lit("null")).otherwise(F.lit(type_name(x.dtype)))


@register("coalesce", low=1, high=99)
def _coalesce(*args: Typed) -> Column:
    return F.coalesce(*[a.col for a in args])


@register("iif", low=3)
def _iif(condition: Typed, a: Typed, b: Typed) -> Column:
    return F.when(truthy(condition), a.col).otherwise(b.col)


@register("error", low=0, high=1)
def _error(*message: Typed) -> Column:
    return F.raise_error(text(message[0]) if message else F.lit("error"))
