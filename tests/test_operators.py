import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from braidql.functions import finance
from braidql.operators import aggregate, basic, joins, reshape, series
from braidql.operators.aggregate import Agg
from braidql.operators.joins import Keys


@pytest.fixture(scope="module")
def left(spark):
    return spark.createDataFrame([(1, "Alice", 10), (2, "Bob", 20), (3, "Charlie", 10), (4, "Dave", 30), (5, "Eve", None)], "id int, name string, dept_id int")


@pytest.fixture(scope="module")
def right(spark):
    return spark.createDataFrame([(10, "Engineering", 100), (20, "Sales", 50), (40, "Marketing", 75), (None, "Nobody", 1)], "id int, name string, budget int")


@pytest.mark.parametrize("how, n", [("inner", 3), ("left", 5), ("left_outer", 5), ("right", 5), ("outer", 7), ("full_outer", 7), ("semi", 3), ("anti", 2), ("cross", 20)])
def test_join_kinds(left, right, how, n):
    assert joins.join(left, right, Keys.left_right(["dept_id"], ["id"]), how=how).count() == n


def test_join_names_and_null_keys(left, right):
    df = joins.join(left, right, Keys.left_right(["dept_id"], ["id"]), null_equal=True)
    assert df.columns == ["id", "name", "dept_id", "id_right", "name_right", "budget"]
    assert df.count() == 4
    full = joins.outer_join(left.select("id", "name"), right.select("id", "budget"), Keys.on("id"))
    assert full.columns == ["id", "name", "budget"] and full.filter("id = 40").count() == 1


def test_validation(left, right):
    with pytest.raises(joins.ValidationError):
        joins.join(left, right, Keys.left_right(["dept_id"], ["id"]), validate="one_to_one")
    assert joins.join(left, right, Keys.left_right(["dept_id"], ["id"]), validate="many_to_one").count() == 3
    with pytest.raises(ValueError):
        joins.kind_of("sideways")


def test_many_and_theta(left, right):
    assert joins.join_multiple([left, left, left], Keys.on("id")).columns == ["id", "name", "dept_id", "name_right_1", "dept_id_right_1", "name_right_2", "dept_id_right_2"]
    assert joins.join_with_condition(left, right, "dept_id < id_right", "left").count() == 7


def test_basic(spark, left):
    assert [r.id for r in basic.tail(left.coalesce(1), 2).collect()] == [4, 5]
    assert [r.id for r in basic.slice_rows(left.coalesce(1), 1, 2).collect()] == [2, 3]
    assert [r.id for r in basic.slice_rows(left.coalesce(1), -2, 1).collect()] == [4]
    assert [r.id for r in basic.sort(left, ["dept_id", "id"], [True, False]).collect()] == [4, 2, 1, 3, 5]
    assert [r.id for r in basic.reverse(left.coalesce(1)).collect()] == [5, 4, 3, 2, 1]
    assert basic.unique(left, ["dept_id"], "none").count() == 3
    assert basic.unique(left.coalesce(1), ["dept_id"], "last").filter("dept_id = 10").first().id == 3
    assert basic.drop_nulls(left).count() == 4 and basic.fill_null(left, 0).filter("dept_id = 0").count() == 1
    assert basic.cast(left, "id", "str").dtypes[0] == ("id", "string")
    assert basic.select_by_index(left, [1]).columns == ["name"]
    assert basic.map_columns(left, lambda c: c + 1, type(left.schema["id"].dataType)).first().id == 2
    assert basic.filter_values(left, lambda pdf: pdf["id"] > 3).count() == 2
    assert basic.explode(spark.createDataFrame([([1, 2], ["a"]), ([], None)], "x array<int>, y array<string>"), ["x", "y"]).count() == 3
    with pytest.raises(ValueError):
        basic.select(left, ["nothing"])
    with pytest.raises(ValueError):
        basic.cast(left, "id", "blob")


def test_aggregates(spark):
    df = spark.createDataFrame([("a", 1.0, "p"), ("a", None, None), ("a", 3.0, "q"), ("b", 5.0, "p")], "k string, v double, s string").coalesce(1)
    aggs = [Agg("count"), *[Agg(fn, "v") for fn in ("sum", "mean", "median", "min", "max", "std", "var", "first", "last", "list", "nunique")], Agg("concat", "s")]
    a, b = sorted(aggregate.group_by_agg(df, ["k"], aggs).collect())
    assert tuple(a)[1:] == (3, 4.0, 2.0, 2.0, 1.0, 3.0, pytest.approx(2**0.5), 2.0, 1.0, 3.0, [1.0, None, 3.0], 3, "p,q")
    assert b.v_std is None and b.v_nunique == 1
    assert [len(r.rows) for r in sorted(aggregate.group_rows(df, ["k"]).collect())] == [3, 1]
    assert aggregate.simple_agg("k").sum("v").count().build()[1][0].name == "v_sum"


def test_series(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([1.0, 3.0, None, 5.0, 9.0])], "i int, v double")
    out = [r.v_rolling_std for r in series.rolling_std(df, "v", 2, ["i"], min_periods=1).orderBy("i").collect()]
    assert out == [0.0, pytest.approx(2**0.5), 0.0, 0.0, pytest.approx(8**0.5)]
    assert [r.v_ewma for r in series.ewma(df, "v", 0.5, ["i"]).orderBy("i").collect()] == [1.0, 2.0, 2.0, 3.5, 6.25]
    assert [r.v_cumulative_sum for r in series.cumulative_agg(df, "v", "sum", ["i"]).orderBy("i").collect()] == [1.0, 4.0, 4.0, 9.0, 18.0]
    with pytest.raises(ValueError):
        series.ewma(df, "v", 2, ["i"])
    with pytest.raises(ValueError):
        series.rolling_agg(df, "v", "mode", 2, ["i"])


def test_indicators_equal_those_of_arrays(spark):
    """Each key's rows give what the array functions give of its values; a null blanks its key, short keys have no result."""
    rows = [(k, i, 50.0 + (i * (7 + k)) % 13, 45.0 + (i * 5) % 7 - k) for k in (1, 2) for i in range(12)]
    df = spark.createDataFrame([*rows, (3, 0, 1.0, 1.0), (4, 0, 2.0, None), (4, 1, 3.0, 1.0)], "k int, i int, h double, l double").withColumn("c", (F.col("h") + F.col("l")) / 2)
    by = {k: [r for r in df.orderBy("i").collect() if r.k == k] for k in (1, 2, 3, 4)}

    def got(out, name):
        found = out.orderBy("k", "i").collect()
        return {k: [r[name] for r in found if r.k == k] for k in by}

    col = lambda k, c: [r[c] for r in by[k]]
    bars = lambda k: (col(k, "h"), col(k, "l"), col(k, "c"))
    want = {
        "h_rsi": (series.rsi(df, "h", ["i"], ["k"], 4), lambda k: finance.rsi(col(k, "h"), 4)),
        "h_signal": (series.macd(df, "h", ["i"], ["k"], 2, 5, 3), lambda k: [m["signal"] for m in finance.macd(col(k, "h"), 2, 5, 3)]),
        "atr": (series.atr(df, "h", "l", "c", ["i"], ["k"], 4), lambda k: finance.atr(*bars(k), 4)),
        "adx": (series.adx(df, "h", "l", "c", ["i"], ["k"], 3), lambda k: finance.directional_index(*bars(k), 3)),
        "stoch_d": (series.stoch_d(df, "h", "l", "c", ["i"], ["k"], 5, 3), lambda k: finance.stoch_d(*bars(k), 5, 3)),
        "parabolic_sar": (series.parabolic_sar(df, "h", "l", ["i"], ["k"]), lambda k: finance.parabolic_sar(col(k, "h"), col(k, "l"))),
    }
    for name, (out, plain) in want.items():
        found = got(out, name)
        for k in (1, 2):
            assert found[k] == [None if v is None else pytest.approx(v) for v in plain(k)], name
    assert got(want["h_rsi"][0], "h_rsi")[3] == [None] and got(want["parabolic_sar"][0], "parabolic_sar")[4] == [None, None]
    assert got(series.cci(df, "h", "l", "c", ["i"], ["k"], 3), "cci")[3] == [0.0]
    ratios = {r.k: r.sortino_ratio for r in series.sortino_ratio(df, "h", ["k"], 55.0).collect()}
    assert ratios[3] == pytest.approx(-1.0)
    assert series.rsi(df.limit(0), "h", ["i"], ["k"]).count() == 0


def test_reshape(spark):
    df = spark.createDataFrame([(1, "a", 2.0), (1, "b", 3.0), (2, "a", 4.0)], "i int, c string, v double")
    wide = reshape.pivot(df, ["i"], "c", "v")
    assert sorted(wide.collect()) == [(1, 2.0, 3.0), (2, 4.0, None)] and wide.columns == ["i", "c_a", "c_b"]
    long = reshape.unpivot(wide, ["i"]).filter("value is not null")
    assert long.agg(F.sum("value")).first()[0] == 9.0
    chunks = reshape.chunks(spark.range(10).repartition(3), 4).groupBy("batch").count().orderBy("batch").collect()
    assert [r["count"] for r in chunks] == [4, 4, 2]
    assert reshape.sample(df, 2, 1).count() == 2
    assert reshape.histogram(spark.createDataFrame([], "v double"), "v", 3).count() == 0


def test_places_after_a_shuffle(spark):
    """Rows are numbered once each, also where a second reading could deal them otherwise."""
    df = spark.range(1000).repartition(7).withColumn("v", F.col("id") % 10)
    assert sorted(r[basic.PLACE] for r in basic.placed(df).collect()) == list(range(1000))
    assert basic.skip(df, 300).count() == 700 and basic.skip(df, 0).count() == 1000 and basic.skip(df, 2000).count() == 0
    assert [r.id for r in basic.skip(df.orderBy("id"), 995).collect()] == [995, 996, 997, 998, 999]
    assert basic.skip(spark.range(0), 3).columns == ["id"]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(-50, 50)), min_size=1, max_size=30))
def test_group_sums_add_up(spark, pairs):
    df = spark.createDataFrame(pairs, "k int, v int")
    out = aggregate.group_by_agg(df, ["k"], [Agg("sum", "v"), Agg("count")]).collect()
    assert sum(r.v_sum for r in out) == sum(v for _, v in pairs) and sum(r["count"] for r in out) == len(pairs)


ZEROS = [(1, 1, 0.0), (1, 2, 0.0), (1, 3, 5.0), (1, 4, 2.0), (1, 5, -4.0), (1, 6, 0.0), (2, 1, None), (2, 2, None), (3, 1, None), (3, 2, 0.0), (3, 3, 8.0), (3, 4, 2.0), (4, 1, -2.0), (4, 2, -6.0), (5, 1, 7.0)]


def same_as_sql(df, sql):
    """Rows of ``df`` against those of ``sql`` over ZEROS, infinities and NaN included."""
    import duckdb

    con = duckdb.connect()
    con.execute("CREATE TABLE t (k BIGINT, i BIGINT, v DOUBLE)")
    con.executemany("INSERT INTO t VALUES (?, ?, ?)", ZEROS)
    plain = lambda rows: sorted(repr([f"{v:.9g}".replace("-nan", "nan") if isinstance(v, float) else v for v in r]) for r in rows)
    assert plain(df.collect()) == plain(con.execute(sql).fetchall())


@pytest.fixture(scope="module")
def zeros(spark):
    return spark.createDataFrame(ZEROS, "k long, i long, v double")


OVER = "PARTITION BY k ORDER BY i"


def test_change_against_zero(zeros):
    same_as_sql(series.roc(zeros, "v", 3, ["i"], ["k"]), f"SELECT k, i, v, v / coalesce(lag(v, 3) OVER ({OVER}), first_value(v) OVER ({OVER})) * 100 - 100 FROM t")


def test_log_returns_of_zero(zeros):
    same_as_sql(series.log_returns(zeros, "v", ["i"], ["k"]), f"SELECT k, i, v, ln(v / lag(v) OVER ({OVER})) FROM t")


def test_drawdown_from_zero(zeros):
    same_as_sql(series.max_drawdown(zeros, "v", ["i"], ["k"]), f"SELECT k, max((peak - v) / peak) FROM (SELECT k, v, max(v) OVER ({OVER} ROWS UNBOUNDED PRECEDING) AS peak FROM t) GROUP BY 1")


def test_a_theta_join_spreads_the_larger_side(spark, monkeypatch):
    few, many = spark.range(9).selectExpr("id AS a"), spark.range(0, 300, 1, 1).selectExpr("id AS b")
    df = joins.join_with_condition(few, many, "a < b AND b < 4")
    assert df.rdd.getNumPartitions() > 1 and df.count() == 6
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastNestedLoopJoin" in plan and "RepartitionBy" not in plan
    for how, n in (("left", 12), ("right", 303), ("full", 309), ("semi", 3), ("anti", 6)):
        assert joins.join_with_condition(few, many, "a < b AND b < 4", how).count() == n, how
    monkeypatch.setattr(joins, "WHOLE_BYTES", 0)
    assert joins.join_with_condition(few, many, "a < b AND b < 4").count() == 6
