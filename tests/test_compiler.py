import pytest

from braidql.functions.registry import FilterError
from braidql.plans import compile_filter

ROWS = [("Ann", 30, "x", 1.5, [1, 2, 3]), ("Bob", None, "y", 2.5, []), ("Cyd", 41, "x", None, None), ("Dee", 30, None, 0.0, [5])]


@pytest.fixture(scope="module")
def people(spark):
    return spark.createDataFrame(ROWS, "name string, age bigint, team string, score double, tags array<bigint>").coalesce(1)


def rows(df):
    return [tuple(r) for r in df.collect()]


@pytest.mark.parametrize(
    "text, want",
    [
        ("map(.age)", [(30,), (41,), (30,)]),
        ("map(select(.age < 35)) | map(.name)", [("Ann",), ("Bob",), ("Dee",)]),
        ("map(select(.age > 35) | .name)", [("Cyd",)]),
        ("map(select(.team == null)) | map(.name)", [("Dee",)]),
        ("map(select(.team != \"x\")) | map(.name)", [("Bob",), ("Dee",)]),
        ("map(select(.score)) | map(.name)", [("Ann",), ("Bob",)]),
        ("map(select(not .score)) | map(.name)", [("Cyd",), ("Dee",)]),
        ("map(select(.tags)) | map(.name)", [("Ann",), ("Dee",)]),
        (".[0] | .name", [("Ann",)]),
        (".[-1].name", [("Dee",)]),
        (".[1:3] | .name", [("Bob",), ("Cyd",)]),
        (".[-2:] | .name", [("Cyd",), ("Dee",)]),
        ("reverse | .name", [("Dee",), ("Cyd",), ("Bob",), ("Ann",)]),
        ("sort_by(.age) | .name", [("Bob",), ("Ann",), ("Dee",), ("Cyd",)]),
        ("sort_by(.age, .name) | reverse | head(2) | map(.name)", [("Cyd",), ("Dee",)]),
        ("tail(1) | map(.name)", [("Dee",)]),
        ("max_by(.age) | .name", [("Cyd",)]),
        ("min_by(.score) | .name", [("Cyd",)]),
        ("length", [(4,)]),
        ("map(.age) | length", [(3,)]),
        ("map(.age) | add / length", [(101 / 3,)]),
        ("map(.tags | map(. + 1) | add)", [(9,), (6,)]),
        ("map(.tags | length)", [(3,), (0,), (0,), (1,)]),
        ("map(.tags[-1])", [(3,), (5,)]),
        ("map({name, n: (.tags | map(select(. > 1)) | length)}) | map(select(.n > 0))", [("Ann", 2), ("Dee", 1)]),
        ("map(try (1 / .score) catch -1)", [(1 / 1.5,), (0.4,), (-1.0,), (-1.0,)]),
        ("map(if .age == 30 then .name else \"-\" end)", [("Ann",), ("-",), ("-",), ("Dee",)]),
        (".age += 1 | map(.age)", [(31,), (42,), (31,)]),
        (".extra.deep |= .name | map(.extra.deep) | .[0]", [("Ann",)]),
        ("del(.tags, .score, .age) | .[0]", [("Ann", "x")]),
        ("map(.missing)", []),
        ("map(.name | startswith(\"A\"))", [(True,), (False,), (False,), (False,)]),
        ("map(startswith(.name; \"A\"))", [(True,), (False,), (False,), (False,)]),
        ("map($who) | .[0]", [("me",)]),
        ("map([.age, 5] | max)", [(30,), (5,), (41,), (30,)]),
        ("unique | length", [(4,)]),
        ("columns", [(["name", "age", "team", "score", "tags"],)]),
        ("{n: length, a: (map(.age) | max)}", [(4, 41)]),
        ("map({a: .name, b: {c: .age}}) | map(.b.c)", [(30,), (41,), (30,)]),
        ("map(.name) | map(length) | add", [(12,)]),
    ],
)
def test_programs(people, text, want):
    assert rows(compile_filter(text, people, {"who": "me"})) == want


@pytest.mark.parametrize(
    "body, want",
    [
        ("{t: .[0].team, n: length}", {("x", 2), ("y", 1), (None, 1)}),
        ("{t: .[0].team, s: (map(.age) | add), k: (map(.age) | length)}", {("x", 71, 2), ("y", None, 0), (None, 30, 1)}),
        ("{t: .[0].team, first: .[0].name, last: .[-1].name}", {("x", "Ann", "Cyd"), ("y", "Bob", "Bob"), (None, "Dee", "Dee")}),
        ("{t: .[0].team, old: (map(select(.age > 35)) | length)}", {("x", 1), ("y", 0), (None, 0)}),
        ("{t: .[0].team, two: (sort_by(.age) | .[1].name)}", {("x", "Cyd"), ("y", None), (None, None)}),
        ("{t: .[0].team, names: (map(.name) | unique | join(\"+\"))}", {("x", "Ann+Cyd"), ("y", "Bob"), (None, "Dee")}),
        ("{t: .[0].team, top: (max_by(.age) | .name)}", {("x", "Cyd"), ("y", "Bob"), (None, "Dee")}),
    ],
)
def test_groups(people, body, want):
    assert set(rows(compile_filter(f"group_by(.team) | map({body})", people))) == want


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_groups_become_aggregates(people):
    plan = _plan(compile_filter("group_by(.team) | map({t: .[0].team, a: (map(.age) | add / length)})", people))
    assert "HashAggregate" in plan and "collect_list" not in plan


def test_distinct_counts_gather_no_set(people):
    out = compile_filter("group_by(.team) | map({team: .[0].team, n: (map(.name) | unique | length)})", people)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "collect_set" not in plan and "collect_list" not in plan
    want = {t: len({r.name for r in people.collect() if r.team == t and r.name is not None}) for t in {r.team for r in people.collect()}}
    assert {r.team: r.n for r in out.collect()} == want


def test_topk_and_pushdown(spark, sf):
    li = spark.read.parquet(f"{sf}/lineitem.parquet")
    assert "TakeOrderedAndProject" in _plan(compile_filter("sort_by(.l_tax) | reverse | .[0:3]", li))
    plan = _plan(compile_filter("map(select(.l_quantity > 49)) | map({k: .l_orderkey})", li))
    assert "GreaterThan(l_quantity,49.0)" in plan and "l_comment" not in plan and "Python" not in plan
    assert "rowid" not in plan


def test_split_of_a_filter_is_whole(people):
    held = compile_filter("map(select(.age > 30 or .team == \"y\"))", people).count()
    other = compile_filter("map(select(not (.age > 30 or .team == \"y\")))", people).count()
    assert held + other == 4


def test_joins(spark, people):
    teams = spark.createDataFrame([("x", "red"), (None, "grey")], "team string, colour string")
    load = {"teams.csv": teams}.get
    assert rows(compile_filter("join(teams.csv; .team == .team) | map({name, colour})", people, load=load)) == [("Ann", "red"), ("Cyd", "red")]
    assert compile_filter("left_join('teams.csv'; .team)", people, load=load).count() == 4
    assert compile_filter("anti_join('teams.csv'; .team)", people, load=load).count() == 2


@pytest.mark.parametrize("text", ["map(.name < .age)", "map(nothing(.name))", "map(.name + .age)", "map($unknown)", "map(pow(1; 2; 3))", "join('x'; .a)"])
def test_errors(people, text):
    with pytest.raises(FilterError):
        compile_filter(text, people)


def test_empty_table(spark):
    df = spark.createDataFrame([], "a bigint, b string")
    assert rows(compile_filter("map(select(.a > 1)) | group_by(.b) | map({b: .[0].b, n: length})", df)) == []
    assert rows(compile_filter("map(.a) | add", df)) == [(None,)]
    assert rows(compile_filter("length", df)) == [(0,)]


def test_odd_column_names(spark):
    df = spark.createDataFrame([(1, 2)], "`US City Name` int, `a.b` int")
    assert rows(compile_filter('map(.["US City Name"] + .["a.b"])', df)) == [(3,)]


def test_json_values(spark):
    df = spark.createDataFrame([('{"a": {"b": [1, 2]}}',)], "j string")
    assert compile_filter("map(.j | fromjson | .a.b | .[1])", df).selectExpr("cast(value as int) v").first().v == 2
