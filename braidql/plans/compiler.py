"""A filter to a DataFrame plan.

Stages of a pipeline turn one shape into the next: rows of a frame, groups of
rows, or one row of aggregates.  Nothing is evaluated; every stage adds to the
plan, so Catalyst sees the whole program.

Rewrites on the way: a body over groups becomes aggregates (no list of rows is
gathered) wherever each part of it reduces; ``map(select(p))`` is a filter that
scans can use; sorting followed by a head is a top-k; reductions of a frame are
global aggregates; a row number is added only for verbs that need the order of
input.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.aggregates import AGGREGATES
from ..functions.objects import leaves
from ..functions.registry import REGISTRY, FilterError, Typed, fits, literal, truthy, type_of
from ..lang import ast as A
from ..lang import parse
from ..operators import basic, joins, reshape
from .expressions import Scope, assigned, evaluate, invoke, path_of, predicate, put_field, quoted, row_scope

ROWID = "__rowid"
#: Columns that carry order and are no part of a row.
HIDDEN = frozenset({ROWID, *(f"__o{i}" for i in range(16))})


class NotReducible(FilterError):
    """A body over groups that needs the rows themselves."""


@dataclass(frozen=True)
class Env:
    params: dict[str, Any] = field(default_factory=dict)
    load: Callable[[str], DataFrame] | None = None


@dataclass(frozen=True)
class Frame:
    """Rows.  ``order``: (sort columns) in force but not yet applied; ``series``: one column seen as values."""

    df: DataFrame
    order: tuple[tuple[Column, bool], ...] = ()
    series: bool = False

    @property
    def columns(self) -> list[str]:
        return [c for c in self.df.columns if c not in HIDDEN]

    def scope(self, env: Env) -> Scope:
        found = row_scope(self.df.schema, env.params, HIDDEN)
        if self.series:
            name = self.columns[0]
            return replace(found, dot=Typed(quoted(name), self.df.schema[name].dataType), row=False)
        return found

    def numbered(self) -> Frame:
        """With a row number that follows the order of input."""
        return self if ROWID in self.df.columns else replace(self, df=self.df.withColumn(ROWID, F.monotonically_increasing_id()))

    def sorts(self, flip: bool = False) -> list[Column]:
        keys = self.order or ((F.col(ROWID), True),)
        return [c.asc_nulls_first() if up != flip else c.desc_nulls_last() for c, up in keys]

    def placed(self) -> Frame:
        """Numbered if no order is in force."""
        return self if self.order else self.numbered()

    def head(self, n: int) -> Frame:
        return replace(self, df=self.df.orderBy(*self.sorts()).limit(n) if self.order else self.df.limit(n))

    def tail(self, n: int) -> Frame:
        own = self.placed()
        kept = own.df.orderBy(*own.sorts(flip=True)).limit(n)
        return replace(own, df=kept, order=own.order or ((F.col(ROWID), True),))

    def slice(self, start: int | None, stop: int | None) -> Frame:
        start = start or 0
        if start < 0 and stop is None:
            return self.tail(-start)
        if start < 0 or stop is not None and stop < 0:
            n = self.df.count()
            start, stop = max(0, start + n) if start < 0 else start, n if stop is None else stop + n if stop < 0 else stop
        df = self.df.orderBy(*self.sorts()) if self.order else self.df
        if stop is None:
            return replace(self, df=basic.skip(df, start))
        df = df.offset(start) if start else df
        return replace(self, df=df.limit(max(0, stop - start)))

    def finish(self) -> DataFrame:
        df = self.df.orderBy(*self.sorts()) if self.order else self.df
        return df.drop(*HIDDEN)


@dataclass(frozen=True)
class Groups:
    frame: Frame
    keys: tuple[tuple[A.Node, Typed], ...]


def compile_filter(text: str, df: DataFrame, params: dict[str, Any] | None = None, load: Callable[[str], DataFrame] | None = None) -> DataFrame:
    """The frame that a filter makes of ``df``."""
    env = Env(params or {}, load)
    tree = parse(text)
    shape: Frame | Groups = Frame(df)
    for stage in tree.stages if isinstance(tree, A.Pipe) else (tree,):
        shape = _stage(stage, shape, env)
    return _rows_of(shape, env).finish()


def _rows_of(shape: Frame | Groups, env: Env) -> Frame:
    """Groups that nothing reduced: one row each with the list of its rows."""
    if isinstance(shape, Frame):
        return shape
    frame = shape.frame.numbered()
    keys = [k.col.alias(f"__k{i}") for i, (_, k) in enumerate(shape.keys)]
    rows = F.struct(F.col(ROWID), *[quoted(c).alias(c) for c in frame.columns])
    listed = frame.df.groupBy(*keys).agg(F.sort_array(F.collect_list(rows)).alias("rows"))
    names = frame.columns
    plain = F.transform("rows", lambda r: F.struct(*[r.getField(n).alias(n) for n in names]))
    return Frame(listed.select(plain.alias("rows")), series=True)


# ---- reductions -----------------------------------------------------------


@dataclass(frozen=True)
class Values:
    """A column over the rows of a group: where ``kept`` holds, nulls left out.  Without a column: the rows."""

    element: Typed | None
    kept: Column | None = None

    def column(self) -> Typed:
        if self.element is None:
            raise NotReducible("rows are no values")
        return self.element if self.kept is None else replace(self.element, col=F.when(self.kept, self.element.col))


class Reducer:
    """Turns a body over a group of rows into aggregate columns."""

    def __init__(self, frame: Frame, env: Env, keys: tuple[tuple[A.Node, Typed], ...] = ()):
        self.frame, self.env, self.keys = frame, env, keys
        self.scope = frame.scope(env)
        self.ordered = False

    def values(self, node: A.Node, over: Values) -> Values | None:
        """``node`` as values over the group, or None if it is something else."""
        if isinstance(node, A.Identity):
            return over
        if isinstance(node, A.Iterate):
            return self.values(node.base, over)
        if isinstance(node, A.Field) and not isinstance(node.base, A.Index):
            base = self.values(node.base, over)
            if base is not None and (base.element is None or base.element.is_struct):
                return replace(base, element=self._inside(A.Field(A.Identity(), node.name), base))
            return None
        if isinstance(node, A.Call) and node.name in ("map", "select", "filter") and len(node.args) == 1:
            return self._mapped(node.args[0] if node.name == "map" else node, over)
        if isinstance(node, A.Pipe):
            found: Values | None = over
            for stage in node.stages:
                found = self.values(stage, found)
                if found is None:
                    return None
            return found
        return None

    def _inside(self, node: A.Node, over: Values) -> Typed:
        return evaluate(node, self.scope if over.element is None else self.scope.at(over.element))

    def _mapped(self, body: A.Node, over: Values) -> Values:
        if isinstance(body, A.Pipe):
            for stage in body.stages:
                over = self._mapped(stage, over)
            return over
        if isinstance(body, A.Call) and body.name in ("select", "filter") and len(body.args) == 1:
            held = truthy(self._inside(body.args[0], over))
            return replace(over, kept=held if over.kept is None else over.kept & held)
        if isinstance(body, A.Identity):
            return over
        return replace(over, element=self._inside(body, over))

    def reduce(self, node: A.Node, over: Values) -> Typed:
        """``node`` as an aggregate column."""
        if isinstance(node, (A.Literal, A.Variable)):
            return evaluate(node, self.scope)
        for key, column in self.keys:
            if isinstance(node, type(key)) and node == _of_first(key):
                return column
        if isinstance(node, A.Field) and isinstance(node.base, A.Index) and isinstance(node.base.index, A.Literal):
            return self._picked(node.base, A.Field(A.Identity(), node.name), over)
        if isinstance(node, A.Index) and isinstance(node.index, A.Literal):
            return self._picked(node, A.Identity(), over)
        if isinstance(node, A.Pipe):
            counted = self._distinct(node, over)
            if counted is not None:
                return counted
            for i in range(len(node.stages) - 1, 0, -1):
                lead = self.values(A.Pipe(node.stages[:i]) if i > 1 else node.stages[0], over)
                if lead is not None:
                    found = self.reduce(node.stages[i], lead)
                    for stage in node.stages[i + 1 :]:
                        found = evaluate(stage, self.scope.at(found))
                    return found
            found = self.reduce(node.stages[0], over)
            for stage in node.stages[1:]:
                found = evaluate(stage, self.scope.at(found))
            return found
        if isinstance(node, A.Call):
            return self._called(node, over)
        if isinstance(node, A.Object):
            cells = [(k, self.reduce(v, over)) for k, v in node.entries]
            return Typed(F.struct(*[c.col.alias(k) for k, c in cells]), T.StructType([T.StructField(k, c.dtype) for k, c in cells]))
        if isinstance(node, (A.Binary, A.Not, A.Negate, A.If, A.Array, A.Sequence, A.Try)):
            return self._composed(node, over)
        raise NotReducible(f"{type(node).__name__} does not reduce")

    def _distinct(self, node: A.Pipe, over: Values) -> Typed | None:
        """``... | unique | length`` counts without the set of values."""
        *lead, first, second = node.stages
        names = [n.name if isinstance(n, A.Call) and not n.args else None for n in (first, second)]
        if names[0] != "unique" or names[1] not in ("length", "len", "count"):
            return None
        found = over if not lead else self.values(A.Pipe(tuple(lead)) if len(lead) > 1 else lead[0], over)
        if found is None or found.element is None:
            return None
        return Typed(F.count_distinct(found.column().col), T.LongType())

    def _picked(self, index: A.Index, part: A.Node, over: Values) -> Typed:
        """A field of the first or last row."""
        base = self.values(index.base, over)
        if base is None or base.kept is not None or index.index.value not in (0, -1):
            raise NotReducible("only the first and the last row are aggregates")
        self.ordered = True
        value = self._inside(part, base)
        pick = F.min_by if index.index.value == 0 else F.max_by
        return Typed(pick(value.col, F.col(ROWID)), value.dtype)

    def _called(self, node: A.Call, over: Values) -> Typed:
        name = node.name
        if name in ("length", "len", "count") and len(node.args) <= 1:
            found = self.values(node.args[0], over) if node.args else over
            if found is None:
                raise NotReducible("a count of something else")
            if found.element is None:
                return Typed(F.count(F.lit(1)) if found.kept is None else F.count_if(found.kept), T.LongType())
            return Typed(F.count(found.column().col), T.LongType())
        if name in ("first", "last") and len(node.args) <= 1:
            return self._picked(A.Index(node.args[0] if node.args else A.Identity(), A.Literal(0 if name == "first" else -1)), A.Identity(), over)
        if name == "unique" and not node.args:
            column = over.column()
            return Typed(F.array_sort(F.collect_set(column.col)), T.ArrayType(column.dtype))
        if name in ("min_by", "max_by") and len(node.args) == 1 and over.element is None and over.kept is None:
            self.ordered = True
            key = self._inside(node.args[0], over)
            row = self.scope.dot
            tie = F.col(ROWID) if name == "min_by" else -F.col(ROWID)
            return Typed((F.min_by if name == "min_by" else F.max_by)(row.col, F.struct(key.col, tie)), row.dtype)
        if name in AGGREGATES:
            columns, constants = [], []
            for arg in node.args or (A.Identity(),):
                found = self.values(arg, over)
                if found is not None and found.element is not None:
                    columns.append(found.column())
                elif isinstance(arg, (A.Literal, A.Variable)):
                    constants.append(evaluate(arg, self.scope))
                else:
                    raise NotReducible(f"{name} of something else")
            if not columns:
                columns = [over.column()]
            args = [*columns, *constants]
            kind = type_of(AGGREGATES[name], args, ("rows", name))
            return Typed(AGGREGATES[name](*args), kind)
        if name in REGISTRY and node.args:
            return invoke(name, [self.reduce(a, over) for a in node.args], self.scope.safe)
        raise NotReducible(f"{name} does not reduce")

    def _composed(self, node: A.Node, over: Values) -> Typed:
        """Operators over parts that reduce: each part becomes a field that the operator reads."""
        parts = A.children(node)
        found = [self.reduce(p, over) for p in parts]
        names = {id(p): f"p{i}" for i, p in enumerate(parts)}

        def stand_in(p: A.Node) -> A.Node:
            return A.Field(A.Identity(), names[id(p)]) if not isinstance(p, A.Literal) else p

        def rebuilt(value):
            if isinstance(value, A.Node):
                return stand_in(value)
            return tuple(rebuilt(v) for v in value) if isinstance(value, tuple) else value

        shell = type(node)(**{k: rebuilt(v) for k, v in vars(node).items()})
        return evaluate(shell, _Fields({names[id(p)]: f for p, f in zip(parts, found, strict=True)}, self.scope))


class _Fields(Scope):
    """A scope whose fields are given columns."""

    def __init__(self, cells: dict[str, Typed], base: Scope):
        dot = Typed(F.struct(*[c.col.alias(n) for n, c in cells.items()]), T.StructType([T.StructField(n, c.dtype) for n, c in cells.items()]))
        object.__setattr__(self, "dot", _Cells(dot.col, dot.dtype, cells))
        object.__setattr__(self, "row", False)
        object.__setattr__(self, "params", base.params)
        object.__setattr__(self, "safe", base.safe)


class _Cells(Typed):
    """An object whose fields stand for columns themselves, not for parts of one."""

    def __init__(self, col: Column, dtype: T.DataType, cells: dict[str, Typed]):
        object.__setattr__(self, "col", _CellColumn(cells))
        object.__setattr__(self, "dtype", dtype)
        object.__setattr__(self, "value", None)
        object.__setattr__(self, "safe", False)


class _CellColumn:
    def __init__(self, cells: dict[str, Typed]):
        self.cells = cells

    def getField(self, name: str) -> Column:  # noqa: N802  the Column interface
        return self.cells[name].col

    def isNotNull(self) -> Column:  # noqa: N802
        return F.lit(True)


def _of_first(key: A.Node) -> A.Node:
    """How a group's body names the key: the same path, of the first row."""
    if isinstance(key, A.Identity):
        return A.Index(A.Identity(), A.Literal(0))
    if isinstance(key, A.Field):
        return A.Field(_of_first(key.base), key.name)
    return key


# ---- stages ---------------------------------------------------------------


def _one_row(frame: Frame, found: Typed, ordered: bool) -> Frame:
    df = frame.numbered().df if ordered else frame.df
    if found.is_struct:
        made = df.agg(found.col.alias("value"))
        return Frame(made.select("value.*"))
    return Frame(df.agg(found.col.alias("value")), series=True)


def _project(frame: Frame, entries: list[tuple[str, Typed]]) -> Frame:
    keep = [F.col(ROWID)] if ROWID in frame.df.columns and ROWID not in [n for n, _ in entries] else []
    order = frame.order
    df = frame.df
    if order:  # the keys may leave with the projection
        df = df.withColumns({f"__o{i}": c for i, (c, _) in enumerate(order)})
        keep += [F.col(f"__o{i}") for i in range(len(order))]
        df = df.select(*[t.col.alias(n) for n, t in entries], *keep)
        return Frame(df, tuple((F.col(f"__o{i}"), up) for i, (_, up) in enumerate(order)))
    return Frame(df.select(*[t.col.alias(n) for n, t in entries], *keep))


def _map_rows(body: A.Node, frame: Frame, env: Env) -> Frame:
    stages = body.stages if isinstance(body, A.Pipe) else (body,)
    for i, stage in enumerate(stages):
        if isinstance(stage, A.Call) and stage.name in ("select", "filter") and len(stage.args) == 1:
            frame = replace(frame, df=frame.df.filter(predicate(stage.args[0], frame.scope(env))))
            continue
        rest = stages[i:]
        return _map_value(rest[0] if len(rest) == 1 else A.Pipe(tuple(rest)), frame, env)
    return frame


def _map_value(body: A.Node, frame: Frame, env: Env) -> Frame:
    if isinstance(body, A.Identity):
        return frame
    scope = frame.scope(env)
    if isinstance(body, A.Object):
        return _project(frame, [(k, evaluate(v, scope)) for k, v in body.entries])
    if isinstance(body, (A.Assign, A.Delete)) and not frame.series:
        return _change(body, frame, env)
    found = evaluate(body, scope)
    if found.is_struct:
        made = _project(frame, [("value", found)])
        rows = replace(made, df=made.df.filter("value is not null"))
        keep = [c for c in rows.df.columns if c != "value"]
        return replace(rows, df=rows.df.select("value.*", *keep))
    made = _project(frame, [("value", found)])
    return replace(made, df=made.df.filter("value is not null"), series=True)


def _change(node: A.Node, frame: Frame, env: Env) -> Frame:
    """Assignments and deletions on every row."""
    if isinstance(node, A.Delete):
        targets = node.target.items if isinstance(node.target, A.Sequence) else (node.target,)
        df = frame.df
        for target in targets:
            path = path_of(target)
            df = df.drop(path[0]) if len(path) == 1 else df.withColumn(path[0], quoted(path[0]).dropFields(".".join(path[1:])))
        return replace(frame, df=df)
    scope = frame.scope(env)
    path, value = assigned(node, scope)
    if len(path) > 1:
        base = evaluate(A.Field(A.Identity(), path[0]), scope)
        value = put_field(base, path[1:], value)
    return replace(frame, df=frame.df.withColumn(path[0], value.col))


_AGGREGATING = frozenset(AGGREGATES) | {"map", "first", "last"}


def _aggregates(node: A.Node) -> bool:
    """Whether an object over a frame reduces it, rather than projecting its rows."""
    if isinstance(node, A.Call) and (node.name == "map" or node.name in ("length", "count", "len") and not node.args):
        return True
    if isinstance(node, A.Index) and isinstance(node.base, A.Identity):
        return True
    return any(_aggregates(c) for c in A.children(node))


def _constant(node: A.Node, env: Env) -> Any:
    found = evaluate(node, Scope(literal(None), params=env.params))
    if found.value is None and not found.is_null:
        raise FilterError("a constant is needed here")
    return found.value


def _column_names(nodes: tuple[A.Node, ...], env: Env) -> list[str]:
    out: list[str] = []
    for n in nodes:
        if isinstance(n, A.Field):
            out.append(path_of(n)[-1])
        elif isinstance(n, (A.Array, A.Sequence)):
            out += _column_names(n.items, env)
        else:
            value = _constant(n, env)
            out += value if isinstance(value, list) else [value]
    return out


def _single(spark: SparkSession, value: Typed) -> Frame:
    return Frame(spark.range(1).select(value.col.alias("value")), series=True)


def _stage(node: A.Node, shape: Frame | Groups, env: Env) -> Frame | Groups:
    if isinstance(shape, Groups):
        return _group_stage(node, shape, env)
    frame = shape
    if isinstance(node, (A.Identity, A.Iterate)) and not isinstance(getattr(node, "base", None), A.Field):
        return frame
    if isinstance(node, A.Pipe):
        for stage in node.stages:
            shape = _stage(stage, shape, env)
        return shape
    if isinstance(node, A.Field) and isinstance(node.base, (A.Identity, A.Iterate)) and not frame.series:
        made = _project(frame, [(node.name, evaluate(A.Field(A.Identity(), node.name), frame.scope(env)))])
        return replace(made, series=True)
    if isinstance(node, A.Iterate) and isinstance(node.base, A.Field):
        found = evaluate(node.base, frame.scope(env))
        return Frame(frame.df.select(F.explode(found.col).alias("value")), series=True) if found.is_array else _stage(node.base, frame, env)
    if isinstance(node, A.Index) and isinstance(node.base, (A.Identity, A.Iterate)) and isinstance(node.index, A.Literal) and isinstance(node.index.value, int):
        n = node.index.value
        return frame.slice(n, n + 1) if n >= 0 else frame.tail(-n).slice(0, 1)
    if isinstance(node, A.Field) and isinstance(node.base, A.Index):
        return _stage(A.Field(A.Identity(), node.name), _stage(node.base, frame, env), env)
    if isinstance(node, A.Slice) and isinstance(node.base, A.Identity):
        bound = lambda b: None if b is None else int(_constant(b, env))
        return frame.slice(bound(node.start), bound(node.stop))
    if isinstance(node, (A.Assign, A.Delete)):
        return _change(node, frame, env)
    if isinstance(node, A.Object) and not _aggregates(node):
        return _project(frame, [(k, evaluate(v, frame.scope(env))) for k, v in node.entries])
    if isinstance(node, A.Call):
        found = _verb(node, frame, env)
        if found is not None:
            return found
    return _reduced(node, frame, env)


def _reduced(node: A.Node, frame: Frame, env: Env) -> Frame:
    """A reduction of the whole frame, or else an expression of each row."""
    reducer = Reducer(frame, env)
    element = frame.scope(env).dot if frame.series else None
    try:
        found = reducer.reduce(node, Values(element))
    except NotReducible:
        return _map_value(node, frame, env)
    return _one_row(frame, found, reducer.ordered)


def _group_stage(node: A.Node, groups: Groups, env: Env) -> Frame | Groups:
    if isinstance(node, (A.Identity, A.Iterate)):
        return groups
    if isinstance(node, A.Call) and node.name == "length" and not node.args:
        keys = [k.col.alias(f"__k{i}") for i, (_, k) in enumerate(groups.keys)]
        return Frame(groups.frame.df.select(*keys).distinct().agg(F.count(F.lit(1)).alias("value")), series=True)
    body = node.args[0] if isinstance(node, A.Call) and node.name == "map" and len(node.args) == 1 else node if isinstance(node, A.Object) else None
    if body is None:
        return _stage(node, _rows_of(groups, env), env)
    frame = groups.frame.numbered() if _needs_order(body) else groups.frame
    named = frame.df.withColumns({f"__k{i}": k.col for i, (_, k) in enumerate(groups.keys)})
    inner = Frame(named, series=frame.series)
    keys = tuple((n, replace(k, col=F.col(f"__k{i}"))) for i, (n, k) in enumerate(groups.keys))
    reducer = Reducer(inner, env, keys)
    reducer.scope = frame.scope(env)
    try:
        stages = body.stages if isinstance(body, A.Pipe) else (body,)
        first = stages[0]
        over = Values(reducer.scope.dot if frame.series else None)
        entries = [(k, reducer.reduce(v, over)) for k, v in first.entries] if isinstance(first, A.Object) else [("value", reducer.reduce(body, over))]
    except NotReducible:
        return _map_rows(body, _rows_of(groups, env), env)
    made = Frame(named.groupBy(*[F.col(f"__k{i}") for i in range(len(keys))]).agg(*[c.col.alias(n) for n, c in entries]).select(*[quoted(n) for n, _ in entries]))
    if not isinstance(first, A.Object):
        return replace(made, df=made.df.filter("value is not null"), series=True)
    return _map_rows(A.Pipe(tuple(stages[1:])), made, env) if len(stages) > 1 else made


def _needs_order(node: A.Node) -> bool:
    if isinstance(node, A.Index) or isinstance(node, A.Call) and node.name in ("first", "last", "min_by", "max_by"):
        return True
    return any(_needs_order(c) for c in A.children(node))


def _join(node: A.Call, frame: Frame, env: Env) -> Frame:
    how = {"join": "inner"}.get(node.name, node.name.removesuffix("_join"))
    first = node.args[0]
    path = first.path if isinstance(first, A.Path) else _constant(first, env)
    if env.load is None:
        raise FilterError("nothing here can read the other side of a join")
    other = env.load(path)
    left, right = [], []
    conditions = list(node.args[1:])
    while conditions:
        c = conditions.pop(0)
        if isinstance(c, A.Binary) and c.op == "and":
            conditions = [c.left, c.right, *conditions]
        elif isinstance(c, A.Binary) and c.op == "==":
            left.append(path_of(c.left)[-1])
            right.append(path_of(c.right)[-1])
        else:
            name = path_of(c)[-1]
            left.append(name)
            right.append(name)
    keys = joins.Keys.left_right(left, right)
    return Frame(joins.join(frame.finish(), other, keys, joins.Options(how=how)))


def _broadcast(node: A.Call, frame: Frame, env: Env) -> Frame | None:
    """An elementwise function over all columns that fit it."""
    spec = REGISTRY.get(node.name)
    if spec is None or spec.each is None or frame.series:
        return None
    rest = [literal(_constant(a, env)) for a in node.args]
    cells = []
    for f in frame.df.schema.fields:
        own = Typed(quoted(f.name), f.dataType)
        if f.name not in HIDDEN and fits(spec.each, f.dataType):
            own = invoke(node.name, [own, *rest], False)
        cells.append(own.col.alias(f.name))
    return replace(frame, df=frame.df.select(*cells))


def _verb(node: A.Call, frame: Frame, env: Env) -> Frame | Groups | None:
    """Verbs over rows."""
    name, args, df = node.name, node.args, frame.df
    spark = df.sparkSession
    scope = frame.scope(env)
    if name == "map" and len(args) == 1:
        return _map_rows(args[0], frame, env)
    if name in ("select", "filter") and len(args) == 1:
        return replace(frame, df=df.filter(predicate(args[0], scope)))
    if name == "select" and len(args) > 1:
        return _project(frame, [(n, evaluate(A.Field(A.Identity(), n), scope)) for n in _column_names(args, env)])
    if name == "sort_by" and args:
        keys = [evaluate(k, scope) if not isinstance(k, A.Literal) else evaluate(A.Field(A.Identity(), str(k.value)), scope) for a in args for k in (a.items if isinstance(a, (A.Array, A.Sequence)) else (a,))]
        return replace(frame, order=tuple((k.col, True) for k in keys))
    if name == "sort" and not args:
        return replace(frame, order=((quoted(frame.columns[0]), True),))
    if name == "reverse" and not args:
        own = frame.placed()
        return replace(own, order=tuple((c, not up) for c, up in own.order) or ((F.col(ROWID), False),))
    if name in ("head", "limit", "tail"):
        n = int(_constant(args[0], env)) if args else 5
        return frame.tail(n) if name == "tail" else frame.head(n)
    if name in ("first", "last") and not args:
        return frame.head(1) if name == "first" else frame.tail(1)
    if name == "array_shift" and not args:
        return frame.slice(1, None)
    if name == "group_by" and args:
        keys = [k for a in args for k in (a.items if isinstance(a, (A.Array, A.Sequence)) else (a,))]
        keys = [A.Field(A.Identity(), k.value) if isinstance(k, A.Literal) else k for k in keys]
        return Groups(frame, tuple((k, evaluate(k, scope)) for k in keys))
    if name in ("min_by", "max_by") and len(args) == 1:
        key = evaluate(args[0], scope)
        own = frame.numbered()
        up = name == "min_by"
        return Frame(own.df.orderBy(key.col.asc_nulls_first() if up else key.col.desc_nulls_last(), F.col(ROWID)).limit(1).drop(ROWID))
    if name == "unique" and not args:
        return replace(frame, df=df.dropDuplicates(frame.columns))
    if name in ("length", "len", "count") and not args:
        return Frame(df.agg(F.count(F.lit(1)).alias("value")), series=True)
    if name in ("avg", "mean", "median", "std", "var", "stdev_p", "stdev_s") and not args and not frame.series:
        numeric = [f for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in HIDDEN]
        return Frame(df.agg(*[AGGREGATES[name](Typed(quoted(f.name), f.dataType)).alias(f.name) for f in numeric]))
    if name in ("sum", "add") and not args and not frame.series:
        numeric = [f for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in HIDDEN]
        return Frame(df.agg(sum((F.coalesce(F.sum(quoted(f.name).cast("double")), F.lit(0.0)) for f in numeric), F.lit(0.0)).alias("value")), series=True)
    if name in ("max", "min") and not args and not frame.series:
        first = next((f for f in df.schema.fields if isinstance(f.dataType, T.NumericType)), None)
        if first is None:
            raise FilterError(f"{name} needs a numeric column")
        return Frame(df.agg(AGGREGATES[name](Typed(quoted(first.name), first.dataType)).alias("value")), series=True)
    if name in ("value_counts", "topk", "topk_with_counts", "most_frequent", "least_frequent", "histogram"):
        values = [a for a in args if not isinstance(a, (A.Field, A.Iterate, A.Identity))]
        named = [a for a in args if isinstance(a, A.Field)]
        column = path_of(named[0])[-1] if named else frame.columns[0]
        return Frame(reshape.frequencies(df, column, name, [_constant(v, env) for v in values]), series=name in ("topk", "most_frequent", "least_frequent"))
    if name == "columns" and not args:
        return _single(spark, literal(frame.columns))
    if name == "keys" and not args and not frame.series:
        return _single(spark, literal(frame.columns))
    if name == "shape" and not args:
        return Frame(df.agg(F.array(F.count(F.lit(1)), F.lit(len(frame.columns)).cast("long")).alias("value")), series=True)
    if name == "dtypes" and not args:
        return Frame(spark.range(1).select(*[F.lit(t).alias(n) for n, t in df.dtypes if n not in HIDDEN]))
    if name == "cut":
        wanted = [c for c in _column_names(args, env) if c in frame.columns]
        return _project(frame, [(c, evaluate(A.Field(A.Identity(), c), scope)) for c in wanted])
    if name in ("melt", "unpivot"):
        ids = _column_names(args[:1], env) if args else frame.columns[:1]
        return Frame(reshape.unpivot(frame.finish(), ids, _column_names(args[1:2], env) if len(args) > 1 else None))
    if name == "pivot":
        index, pivot, value = _column_names(args[:1], env), _column_names(args[1:2], env)[0], _column_names(args[2:3], env)[0]
        return Frame(reshape.pivot(frame.finish(), index, pivot, value, _constant(args[3], env) if len(args) > 3 else "sum"))
    if name == "transpose" and not args:
        return Frame(reshape.transpose(frame.finish()))
    if name == "sample":
        return replace(frame, df=reshape.sample(df, *[_constant(a, env) for a in args]))
    if name == "unnest" and not args:
        return Frame(df.select(*[c.alias(n) for n, c, _ in leaves(_RowColumn(), df.drop(*HIDDEN).schema)]))
    if name == "map_values" and len(args) == 1:
        cells = [(f.name, evaluate(args[0], scope.at(Typed(quoted(f.name), f.dataType)))) for f in df.schema.fields if f.name not in HIDDEN]
        return _project(frame, cells)
    if name in ("join", "inner_join", "left_join", "right_join", "outer_join", "semi_join", "anti_join") and len(args) >= 2 and isinstance(args[0], (A.Path, A.Literal)) and not frame.series:
        return _join(node, frame, env)
    if name in ("generate_uuidv7", "systime", "systime_int", "systime_ns") and not args and not frame.series:
        column = {"generate_uuidv7": "uuid_v7"}.get(name, name)
        return replace(frame, df=df.withColumn(column, REGISTRY[name].build()))
    if name == "buffer" and not frame.series:
        return Frame(reshape.chunks(df, int(_constant(args[0], env)) if args else 1024))
    if name == "empty" and not args:
        return Frame(df.agg((F.count(F.lit(1)) == 0).alias("value")), series=True)
    if name == "type" and not args and not frame.series:
        return _single(spark, literal("dataframe"))
    if frame.series or not (set(args) == set() or all(isinstance(a, (A.Literal, A.Variable)) for a in args)):
        return None
    return _broadcast(node, frame, env)


class _RowColumn:
    """Columns of a row by name."""

    def __getitem__(self, name: str) -> Column:
        return quoted(name)
