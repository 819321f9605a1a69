"""Registered queries, one for each operator, with the SQL they must equal.

``_filter`` registers a filter program, ``_value`` an expression of each row of
a table, ``_group`` an aggregate of each group of ``lineitem``; ``_frame``
registers operators called as functions.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import streaming
from .operators import aggregate, basic, joins, reshape, series
from .operators.aggregate import Agg
from .operators.joins import Keys
from .plans import compile_filter
from .sources import files

Run = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Run] = {}
ORACLE: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _filter(name: str, source: str, text: str, sql: str | None, columns: str | None = None) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = compile_filter(text, table(spark, sf_dir, source), {"low": 10, "word": "ring"}, lambda t: table(spark, sf_dir, t))
        return out.toDF(*columns.split()) if columns else out

    QUERIES[name] = run
    if sql:
        ORACLE[name] = sql


_KEYS = {"part": "p_partkey", "supplier": "s_suppkey", "events": "event_id", "pages": "page_id", "orders": "o_orderkey", "customer": "c_custkey", "nation": "n_nationkey", "embeddings": "vec_id", "documents": "doc_id"}


def _value(name: str, source: str, expression: str, sql: str | None) -> None:
    key = _KEYS[source]
    _filter(f"fn_{name}", source, f"map({{id: .{key}, v: ({expression})}})", sql and f"SELECT {key} AS id, {sql} AS v FROM {source}")


def _group(name: str, expression: str, sql: str | None) -> None:
    text = f"group_by(.l_returnflag, .l_linestatus) | map({{flag: .[0].l_returnflag, status: .[0].l_linestatus, v: ({expression})}})"
    _filter(f"agg_{name}", "lineitem", text, sql and f"SELECT l_returnflag AS flag, l_linestatus AS status, {sql} AS v FROM lineitem GROUP BY 1, 2")


def _frame(name: str, sql: str | None):
    def keep(build: Callable[[Callable[[str], DataFrame]], DataFrame]) -> Callable:
        QUERIES[name] = lambda spark, sf_dir: build(lambda t: table(spark, sf_dir, t))
        if sql:
            ORACLE[name] = sql
        return build

    return keep


# ---- the language ---------------------------------------------------------

_filter(
    "flagship",
    "lineitem",
    "map(select(.l_quantity < 25)) | group_by(.l_returnflag) | map({flag: .[0].l_returnflag, n: length, revenue: (map(.l_extendedprice * (1 - .l_discount)) | add), avg_qty: (map(.l_quantity) | add / length)})",
    "SELECT l_returnflag AS flag, count(*) AS n, sum(l_extendedprice * (1 - l_discount)) AS revenue, avg(l_quantity) AS avg_qty FROM lineitem WHERE l_quantity < 25 GROUP BY 1",
)
_filter("select_fields", "lineitem", ".[] | {l_orderkey, l_linenumber, qty: .l_quantity}", "SELECT l_orderkey, l_linenumber, l_quantity AS qty FROM lineitem")
_filter("filter_rows", "lineitem", "map(select(.l_extendedprice > 50000 and .l_discount >= 0.05))", "SELECT * FROM lineitem WHERE l_extendedprice > 50000 AND l_discount >= 0.05")
_filter("filter_or_not", "orders", 'select(.o_orderstatus == "F" or not (.o_totalprice < 200000)) | {o_orderkey}', "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' OR NOT (o_totalprice < 200000)")
_filter("filter_variable", "part", "map(select(.p_size <= $low)) | map(select(.p_name | contains($word))) | {p_partkey}", "SELECT p_partkey FROM part WHERE p_size <= 10 AND contains(p_name, 'ring')")
_filter("map_expression", "lineitem", "map({k: .l_orderkey, n: .l_linenumber, net: .l_extendedprice * (1 - .l_discount) * (1 + .l_tax), half: .l_quantity / 2})", "SELECT l_orderkey AS k, l_linenumber AS n, l_extendedprice * (1 - l_discount) * (1 + l_tax) AS net, l_quantity / 2 AS half FROM lineitem")
_filter("comma", "part", "map({k: .p_partkey, v: ((.p_size, .p_partkey, 3) | add)})", "SELECT p_partkey AS k, p_size + p_partkey + 3 AS v FROM part")
_filter("quoted_field", "part", 'map({k: .p_partkey, "a b": .p_size}) | map({k: .k, v: .["a b"] * 2})', "SELECT p_partkey AS k, p_size * 2 AS v FROM part")
_filter("filter_verb", "part", "filter(.p_size > 40) | {p_partkey, p_size}", "SELECT p_partkey, p_size FROM part WHERE p_size > 40")
_filter("head_verb", "part", "sort_by(.p_partkey) | head(7) | {p_partkey, p_name}", "SELECT p_partkey, p_name FROM part ORDER BY p_partkey LIMIT 7")
_filter("limit_verb", "orders", "sort_by(.o_totalprice, .o_orderkey) | reverse | limit(9) | {o_orderkey}", "SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 9")
_filter("slice_to_the_end", "orders", "sort_by(.o_totalprice, .o_orderkey) | .[100:] | {o_orderkey}", "SELECT o_orderkey FROM orders ORDER BY o_totalprice, o_orderkey OFFSET 100")
_filter("map_drops_null", "orders", 'map(if .o_orderstatus == "F" then .o_orderkey else null end)', "SELECT o_orderkey AS value FROM orders WHERE o_orderstatus = 'F'")
_filter("if_else", "part", 'map({k: .p_partkey, size: if .p_size > 30 then "large" else if .p_size > 10 then "medium" else "small" end end})', "SELECT p_partkey AS k, CASE WHEN p_size > 30 THEN 'large' WHEN p_size > 10 THEN 'medium' ELSE 'small' END AS size FROM part")
_filter("try_catch", "part", "map({k: .p_partkey, v: try (.p_retailprice / (.p_size - 10)) catch -1})", "SELECT p_partkey AS k, CASE WHEN p_size = 10 THEN -1 ELSE p_retailprice / (p_size - 10) END AS v FROM part")
_filter("string_index_slice", "part", "map({k: .p_partkey, a: .p_name[0:3], b: .p_name[-1], c: (.p_name | split(\" \") | .[1])})", "SELECT p_partkey AS k, substr(p_name, 1, 3) AS a, right(p_name, 1) AS b, string_split(p_name, ' ')[2] AS c FROM part")
_filter("assign_update", "part", ".p_size += 1 | .p_name |= (.p_name | uppercase) | {p_partkey, p_size, p_name}", "SELECT p_partkey, p_size + 1 AS p_size, upper(p_name) AS p_name FROM part")
_filter("delete_columns", "part", "del(.p_name, .p_type)", "SELECT p_partkey, p_brand, p_size, p_retailprice FROM part")
_filter("array_and_iterate", "part", "map([.p_size, .p_partkey, 3] | map(. * 2) | add)", "SELECT 2 * (p_size + p_partkey + 3) AS value FROM part")
_filter("nested_object", "part", "map({k: .p_partkey, o: {a: .p_size, b: {c: .p_brand}}}) | map({k, c: .o.b.c, a: .o.a})", "SELECT p_partkey AS k, p_brand AS c, p_size AS a FROM part")
_filter("macro", "part", "def twice(x): x + x; map({k: .p_partkey, v: twice(.p_size)})", "SELECT p_partkey AS k, p_size + p_size AS v FROM part")
_filter("having", "lineitem", "group_by(.l_suppkey) | map({s: .[0].l_suppkey, n: length, q: (map(.l_quantity) | add)}) | map(select(.q > 1000))", "SELECT l_suppkey AS s, count(*) AS n, sum(l_quantity) AS q FROM lineitem GROUP BY 1 HAVING sum(l_quantity) > 1000")
_filter("group_conditional", "lineitem", "group_by(.l_returnflag) | map({f: .[0].l_returnflag, late: (map(select(.l_tax > 0.04)) | length), big: (map(select(.l_quantity > 40) | .l_extendedprice) | add)})", "SELECT l_returnflag AS f, count(*) FILTER (WHERE l_tax > 0.04) AS late, sum(l_extendedprice) FILTER (WHERE l_quantity > 40) AS big FROM lineitem GROUP BY 1")
_filter("group_rows_fallback", "nation", "group_by(.n_regionkey) | map(sort_by(.n_nationkey) | {r: .[0].n_regionkey, third: .[2].n_name})", "SELECT n_regionkey AS r, n_name AS third FROM (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS i FROM nation) WHERE i = 3")
_filter("group_count", "orders", "group_by(.o_orderpriority) | length", "SELECT count(DISTINCT o_orderpriority) AS value FROM orders")
_filter("reduce_sum", "lineitem", "map(.l_extendedprice * .l_discount) | add", "SELECT sum(l_extendedprice * l_discount) AS value FROM lineitem")
_filter("reduce_object", "orders", "{n: length, total: (map(.o_totalprice) | add), top: (map(.o_totalprice) | max)}", "SELECT count(*) AS n, sum(o_totalprice) AS total, max(o_totalprice) AS top FROM orders")
_filter("sort_topk", "orders", "sort_by(.o_totalprice, .o_orderkey) | reverse | .[0:10] | {o_orderkey, o_totalprice}", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 10")
_filter("sort_tail", "orders", "sort_by(.o_orderkey) | tail(7) | {o_orderkey}", "SELECT o_orderkey FROM orders ORDER BY o_orderkey DESC LIMIT 7")
_filter("sort_slice", "orders", "sort_by(.o_orderkey) | .[5:9] | {o_orderkey}", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 4 OFFSET 5")
_filter("min_by_row", "supplier", "min_by(.s_acctbal) | {s_suppkey}", "SELECT s_suppkey FROM supplier ORDER BY s_acctbal, s_suppkey LIMIT 1")
_filter("max_by_row", "supplier", "max_by(.s_acctbal) | {s_suppkey}", "SELECT s_suppkey FROM supplier ORDER BY s_acctbal DESC, s_suppkey LIMIT 1")
_filter("unique_rows", "orders", "{o_orderstatus, o_orderpriority} | unique", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
_filter("length_of_table", "lineitem", "length", "SELECT count(*) AS value FROM lineitem")
_filter("map_values", "region", "map_values(tostring)", "SELECT r_regionkey::VARCHAR AS r_regionkey, r_name FROM region")
_filter("broadcast_lowercase", "region", "lowercase", "SELECT r_regionkey, lower(r_name) AS r_name FROM region")
_filter("columns_of_table", "part", 'columns | map(join(","))', "SELECT string_agg(column_name, ',') AS value FROM (DESCRIBE part)")
_filter("shape_of_table", "nation", "shape", "SELECT [count(*), 3] AS value FROM nation")
_filter("dtypes_of_table", "region", "dtypes", "SELECT 'int' AS r_regionkey, 'string' AS r_name")
_filter("cut_columns", "nation", 'cut(["n_name", "nothing", "n_nationkey"])', "SELECT n_name, n_nationkey FROM nation")
_filter("frame_avg", "supplier", "avg", "SELECT avg(s_suppkey) AS s_suppkey, avg(s_nationkey) AS s_nationkey, avg(s_acctbal) AS s_acctbal FROM supplier")
_filter("frame_sum", "supplier", "sum", "SELECT sum(s_suppkey) + sum(s_nationkey) + sum(s_acctbal) AS value FROM supplier")
_filter("frame_max_first_numeric", "supplier", "max", "SELECT max(s_suppkey) AS value FROM supplier")
_filter("frame_median", "supplier", "median", "SELECT median(s_suppkey) AS s_suppkey, median(s_nationkey) AS s_nationkey, median(s_acctbal) AS s_acctbal FROM supplier")
_filter("frame_std", "supplier", "std", "SELECT stddev_samp(s_suppkey) AS s_suppkey, stddev_samp(s_nationkey) AS s_nationkey, stddev_samp(s_acctbal) AS s_acctbal FROM supplier")
_filter("value_counts", "orders", "value_counts(.o_orderpriority)", "SELECT o_orderpriority AS value, count(*) AS count FROM orders GROUP BY 1")
_filter("topk_frequent", "lineitem", "topk(.l_linenumber; 2)", "SELECT l_linenumber AS value FROM lineitem GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 2")
_filter("topk_with_counts", "events", "topk_with_counts(.event_type; 3)", "SELECT event_type AS value, count(*) AS count FROM events GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 3")
_filter("most_frequent", "events", "most_frequent(.event_type)", "SELECT event_type AS value FROM events GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1")
_filter("least_frequent", "events", "least_frequent(.event_type)", "SELECT event_type AS value FROM events GROUP BY 1 ORDER BY count(*), 1 LIMIT 1")
_filter("melt_table", "supplier", 'cut(["s_suppkey", "s_nationkey", "s_acctbal"]) | melt(["s_suppkey"])', "SELECT s_suppkey, 's_nationkey' AS variable, s_nationkey::DOUBLE AS value FROM supplier UNION ALL SELECT s_suppkey, 's_acctbal', s_acctbal FROM supplier")
_filter("pivot_table", "lineitem", 'pivot(["l_returnflag"]; "l_linestatus"; "l_quantity")', "SELECT l_returnflag, sum(l_quantity) FILTER (WHERE l_linestatus = 'F') AS \"l_linestatus_F\", sum(l_quantity) FILTER (WHERE l_linestatus = 'O') AS \"l_linestatus_O\" FROM lineitem GROUP BY 1")
_filter("join_in_filter", "nation", 'join("region"; .n_regionkey == .r_regionkey) | group_by(.r_name) | map({r: .[0].r_name, n: length})', "SELECT r_name AS r, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
_filter("left_join_in_filter", "customer", 'left_join("orders"; .c_custkey == .o_custkey) | {c_custkey, o_orderkey}', "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey")
_filter("anti_join_in_filter", "customer", 'anti_join("orders"; .c_custkey == .o_custkey) | {c_custkey}', "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")

# ---- aggregates -----------------------------------------------------------

_group("count", "length", "count(*)")
_group("sum", "map(.l_quantity) | sum", "sum(l_quantity)")
_group("mean", "map(.l_quantity) | mean", "avg(l_quantity)")
_group("avg", "map(.l_tax) | avg", "avg(l_tax)")
_group("min", "map(.l_extendedprice) | min", "min(l_extendedprice)")
_group("max", "map(.l_extendedprice) | max", "max(l_extendedprice)")
_group("median", "map(.l_extendedprice) | median", "median(l_extendedprice)")
_group("std", "map(.l_quantity) | std", "stddev_samp(l_quantity)")
_group("stdev_s", "map(.l_quantity) | stdev_s", "stddev_samp(l_quantity)")
_group("stdev_p", "map(.l_quantity) | stdev_p", "stddev_pop(l_quantity)")
_group("var", "map(.l_quantity) | var", "var_samp(l_quantity)")
_group("quartile", "map(.l_extendedprice) | quartile(.; 3)", "quantile_cont(l_extendedprice, 0.75)")
_group("percentile", "map(.l_extendedprice) | percentile(.; 90)", "list_sort(list(l_extendedprice))[1 + floor((count(*) - 1) * 0.9)::INT]")
_group("correl", "correl(map(.l_quantity); map(.l_extendedprice))", "coalesce(corr(l_quantity, l_extendedprice), 0)")
_group("count_if", "map(select(.l_discount > 0.05)) | length", "count(*) FILTER (WHERE l_discount > 0.05)")
_group("avg_if", "map(select(.l_discount > 0.05) | .l_quantity) | avg", "avg(l_quantity) FILTER (WHERE l_discount > 0.05)")
_group("avg_ifs", "map(select(.l_discount > 0.05) | select(.l_tax < 0.03) | .l_quantity) | avg", "avg(l_quantity) FILTER (WHERE l_discount > 0.05 AND l_tax < 0.03)")
_group("unique", "map(.l_linenumber) | unique | length", "count(DISTINCT l_linenumber)")
_group("most_frequent", "map(.l_linenumber) | most_frequent", "list_extract(map_keys(histogram(l_linenumber)), list_position(map_values(histogram(l_linenumber)), list_max(map_values(histogram(l_linenumber)))))")
_group("sharpe_ratio", "map(.l_discount) | sharpe_ratio(.; 0.01)", "(avg(l_discount) - 0.01) / stddev_pop(l_discount)")
_group("beta", "beta(map(.l_extendedprice); map(.l_quantity))", "covar_pop(l_extendedprice, l_quantity) / var_pop(l_quantity)")
_group("alpha", "alpha(map(.l_extendedprice); map(.l_quantity))", "avg(l_extendedprice) - covar_pop(l_extendedprice, l_quantity) / var_pop(l_quantity) * avg(l_quantity)")


@_frame(
    "group_agg_all13",
    "SELECT l_returnflag, count(*) AS count, sum(l_quantity) AS l_quantity_sum, avg(l_quantity) AS l_quantity_mean, median(l_extendedprice) AS l_extendedprice_median, min(l_shipdate) AS l_shipdate_min, max(l_shipdate) AS l_shipdate_max,"
    " stddev_samp(l_tax) AS l_tax_std, var_samp(l_tax) AS l_tax_var, count(DISTINCT l_suppkey) AS l_suppkey_nunique, arg_min(l_partkey, l_orderkey * 10 + l_linenumber) AS l_partkey_first, arg_max(l_partkey, l_orderkey * 10 + l_linenumber) AS l_partkey_last"
    " FROM lineitem GROUP BY 1",
)
def _all13(t):
    aggs = [Agg("count"), Agg("sum", "l_quantity"), Agg("mean", "l_quantity"), Agg("median", "l_extendedprice"), Agg("min", "l_shipdate"), Agg("max", "l_shipdate"), Agg("std", "l_tax"), Agg("var", "l_tax"), Agg("nunique", "l_suppkey")]
    aggs += [Agg("first", "l_partkey", order_by="at"), Agg("last", "l_partkey", order_by="at")]
    return aggregate.group_by_agg(t("lineitem").withColumn("at", F.expr("l_orderkey * 10 + l_linenumber")), ["l_returnflag"], aggs)


@_frame("group_list_concat", "SELECT n_regionkey, string_agg(n_name, '|' ORDER BY n_nationkey) AS n_name_concat, list(n_nationkey ORDER BY n_nationkey) AS n_nationkey_list FROM nation GROUP BY 1")
def _list_concat(t):
    return aggregate.group_by_agg(t("nation"), ["n_regionkey"], [Agg("concat", "n_name", "|", "n_nationkey"), Agg("list", "n_nationkey", order_by="n_nationkey")])


@_frame("rollup", "SELECT l_returnflag, l_linestatus, count(*) AS count, sum(l_quantity) AS l_quantity_sum FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def _rollup(t):
    return aggregate.grouping_sets(t("lineitem"), ["l_returnflag", "l_linestatus"], [Agg("count"), Agg("sum", "l_quantity")])


# ---- joins ----------------------------------------------------------------

_JOINED = "c_custkey, c_name, o_orderkey, o_totalprice"


def _customer_orders(t) -> tuple[DataFrame, DataFrame, Keys]:
    return t("customer").select("c_custkey", "c_name"), t("orders").filter("o_totalprice > 300000").select("o_orderkey", "o_custkey", "o_totalprice"), Keys.left_right(["c_custkey"], ["o_custkey"])


for _kind, _sql in {"inner": "JOIN", "left": "LEFT JOIN", "right": "RIGHT JOIN", "full": "FULL JOIN"}.items():
    _frame(f"join_{_kind}", f"SELECT {_JOINED} FROM customer {_sql} (SELECT * FROM orders WHERE o_totalprice > 300000) ON c_custkey = o_custkey")(
        lambda t, kind=_kind: joins.join(*_customer_orders(t), how=kind).select("c_custkey", "c_name", "o_orderkey", "o_totalprice")
    )
for _kind, _sql in {"semi": "", "anti": "NOT "}.items():
    _frame(f"join_{_kind}", f"SELECT c_custkey, c_name FROM customer WHERE {_sql}EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")(lambda t, kind=_kind: joins.join(*_customer_orders(t), how=kind))


@_frame("join_cross", "SELECT n_nationkey, r_regionkey FROM nation CROSS JOIN region")
def _cross(t):
    return joins.join(t("nation").select("n_nationkey"), t("region").select("r_regionkey"), Keys.on(), how="cross")


@_frame("join_suffix", "SELECT a.n_regionkey, a.n_name, a.n_nationkey, b.n_name AS n_name_right, b.n_nationkey AS n_nationkey_right FROM nation a JOIN nation b USING (n_regionkey)")
def _suffix(t):
    return joins.join(t("nation"), t("nation"), Keys.on("n_regionkey"))


@_frame("join_theta", "SELECT s_suppkey, p_partkey FROM supplier JOIN part ON s_acctbal < p_retailprice AND s_suppkey > p_size")
def _theta(t):
    return joins.join_with_condition(t("supplier"), t("part"), "s_acctbal < p_retailprice AND s_suppkey > p_size").select("s_suppkey", "p_partkey")


@_frame("join_null_equal", "SELECT a.k, a.x, b.y FROM (SELECT CASE WHEN n_nationkey % 3 = 0 THEN NULL ELSE n_nationkey END AS k, n_nationkey AS x FROM nation) a JOIN (SELECT CASE WHEN n_nationkey % 3 = 0 THEN NULL ELSE n_nationkey END AS k, n_nationkey AS y FROM nation) b ON a.k IS NOT DISTINCT FROM b.k")
def _null_equal(t):
    side = lambda name: t("nation").selectExpr("IF(n_nationkey % 3 = 0, NULL, n_nationkey) AS k", f"n_nationkey AS {name}")
    return joins.join(side("x"), side("y"), Keys.on("k"), null_equal=True)


@_frame("join_multi", "SELECT n_nationkey, a.n_name, b.n_name AS n_name_right_1, c.n_name AS n_name_right_2 FROM nation a JOIN nation b USING (n_nationkey) JOIN nation c USING (n_nationkey)")
def _multi(t):
    n = t("nation").select("n_nationkey", "n_name")
    return joins.join_multiple([n, n, n], Keys.on("n_nationkey"))


@_frame("join_validated", "SELECT n_nationkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def _validated(t):
    return joins.join(t("nation"), t("region"), Keys.left_right(["n_regionkey"], ["r_regionkey"]), validate="many_to_one").select("n_nationkey", "r_name")


@_frame("join_asof", "SELECT a.event_id, a.user_id, b.value AS last_purchase FROM (SELECT * FROM events WHERE event_type <> 'purchase') a ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') b ON a.user_id = b.user_id AND a.ts >= b.ts")
def _asof(t):
    e = t("events")
    return joins.asof_join(e.filter("event_type <> 'purchase'").select("event_id", "user_id", "ts"), e.filter("event_type = 'purchase'"), ["user_id"], "ts", "value", "last_purchase").select("event_id", "user_id", "last_purchase")


@_frame(
    "join_star",
    "SELECT r_name, sum(l_extendedprice * (1 - l_discount)) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1",
)
def _star(t):
    out = t("lineitem")
    for other, a, b in (("orders", "l_orderkey", "o_orderkey"), ("customer", "o_custkey", "c_custkey"), ("nation", "c_nationkey", "n_nationkey"), ("region", "n_regionkey", "r_regionkey")):
        out = joins.inner_join(out, t(other), Keys.left_right([a], [b]))
    return out.groupBy("r_name").agg(F.sum(F.expr("l_extendedprice * (1 - l_discount)")).alias("revenue"))


# ---- verbs ----------------------------------------------------------------


@_frame("verb_select_rename_cast", "SELECT s_suppkey AS id, s_acctbal::FLOAT AS s_acctbal FROM supplier")
def _rename_cast(t):
    return basic.cast(basic.rename(basic.select(t("supplier"), ["s_suppkey", "s_acctbal"]), {"s_suppkey": "id"}), "s_acctbal", "f32")


@_frame("verb_sort_limit", "SELECT p_partkey, p_size FROM part ORDER BY p_size DESC, p_partkey LIMIT 20")
def _sort_limit(t):
    return basic.top_k(t("part").select("p_partkey", "p_size"), [basic.desc("p_size"), basic.asc("p_partkey")], 20)


@_frame("verb_unique_keep_first", "SELECT n_regionkey, min(n_nationkey) AS n_nationkey FROM nation GROUP BY 1")
def _keep_first(t):
    return basic.unique(t("nation").select("n_regionkey", "n_nationkey"), ["n_regionkey"], "first", ["n_nationkey"])


@_frame("verb_unique_keep_none", "SELECT p_size FROM part GROUP BY 1 HAVING count(*) = 1")
def _keep_none(t):
    return basic.unique(t("part").select("p_size"), ["p_size"], "none")


_HOLES = "SELECT event_id, user_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END AS value FROM events"


def _holes(t) -> DataFrame:
    return t("events").selectExpr("event_id", "user_id", "IF(event_id % 3 = 0, NULL, value) AS value")


@_frame("verb_drop_nulls", f"SELECT * FROM ({_HOLES}) WHERE value IS NOT NULL")
def _drop_nulls(t):
    return basic.drop_nulls(_holes(t), ["value"])


@_frame("verb_fill_null", f"SELECT event_id, user_id, coalesce(value, -1) AS value FROM ({_HOLES})")
def _fill(t):
    return basic.fill_null(_holes(t), -1.0, ["value"])


@_frame("verb_fill_forward", f"SELECT event_id, user_id, last_value(value IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS value FROM ({_HOLES})")
def _forward(t):
    return basic.fill_null_with(_holes(t), "forward", ["value"], ["event_id"], ["user_id"])


@_frame("verb_explode", "SELECT vec_id, unnest(embedding)::DOUBLE AS x FROM embeddings")
def _explode(t):
    return basic.explode(t("embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x")), ["x"])


@_frame("verb_describe", "SELECT count(*) AS rows, 3 AS columns, avg(p_size) AS p_size_mean, min(p_size) AS p_size_min, max(p_size) AS p_size_max, avg(p_retailprice) AS p_retailprice_mean, min(p_retailprice) AS p_retailprice_min, max(p_retailprice) AS p_retailprice_max FROM part")
def _describe(t):
    return basic.describe(t("part").select("p_name", "p_size", "p_retailprice"))


@_frame("verb_histogram", "WITH e AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem), c AS (SELECT least(floor((l_extendedprice - lo) / (hi - lo) * 8), 7)::INT AS bin, count(*) AS n FROM lineitem, e GROUP BY 1) SELECT b AS bin, lo + b * (hi - lo) / 8 AS low, lo + (b + 1) * (hi - lo) / 8 AS high, coalesce(n, 0) AS count FROM (SELECT unnest(range(8))::INT AS b) CROSS JOIN e LEFT JOIN c ON bin = b")
def _histogram(t):
    return reshape.histogram(t("lineitem"), "l_extendedprice", 8)


@_frame("verb_unpivot", "SELECT l_orderkey, l_linenumber, 'l_tax' AS variable, l_tax AS value FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, 'l_discount', l_discount FROM lineitem")
def _unpivot(t):
    return reshape.unpivot(t("lineitem"), ["l_orderkey", "l_linenumber"], ["l_tax", "l_discount"])


@_frame("verb_pivot_mean", "SELECT o_orderstatus, avg(o_totalprice) FILTER (WHERE o_orderpriority = '1-URGENT') AS \"o_orderpriority_1-URGENT\", avg(o_totalprice) FILTER (WHERE o_orderpriority = '5-LOW') AS \"o_orderpriority_5-LOW\" FROM orders GROUP BY 1")
def _pivot_mean(t):
    return reshape.pivot(t("orders"), ["o_orderstatus"], "o_orderpriority", "o_totalprice", "mean", ["1-URGENT", "5-LOW"])


@_frame("verb_transpose", "SELECT 'r_regionkey' AS key, * FROM (PIVOT (SELECT r_name, r_regionkey FROM region) ON r_name USING first(r_regionkey))")
def _transpose(t):
    return reshape.transpose(t("region").select("r_name", "r_regionkey"))


@_frame("verb_select_by_index", "SELECT p_name, p_partkey FROM part")
def _select_by_index(t):
    df = t("part")
    return basic.select_by_index(df, [df.columns.index("p_name"), df.columns.index("p_partkey")])


@_frame("verb_filter_values", "SELECT p_partkey, p_size FROM part WHERE p_size % 7 = 3")
def _filter_values(t):
    return basic.filter_values(t("part").select("p_partkey", "p_size"), lambda pdf: pdf["p_size"] % 7 == 3)


@_frame("verb_with_column", "SELECT s_suppkey, s_acctbal, s_acctbal * 2 AS twice, 'x' AS mark FROM supplier")
def _with_column(t):
    return basic.with_column(basic.with_column(t("supplier").select("s_suppkey", "s_acctbal"), "twice", F.col("s_acctbal") * 2), "mark", "x")


@_frame("verb_map_column", "SELECT p_partkey, upper(p_name) AS p_name FROM part")
def _map_column(t):
    return basic.map_column(t("part").select("p_partkey", "p_name"), "p_name", F.upper)


@_frame("verb_map_rows", "SELECT p_partkey, p_size * 3 + 1 AS v FROM part")
def _map_rows(t):
    return basic.map_rows(t("part").select("p_partkey", "p_size"), lambda pdf: pdf.assign(v=pdf["p_size"] * 3 + 1)[["p_partkey", "v"]], "p_partkey long, v int")


@_frame("verb_unique_values", "SELECT DISTINCT p_type FROM part")
def _unique_values(t):
    return basic.unique_values(t("part"), "p_type")


@_frame("verb_skip", "SELECT o_orderkey FROM orders OFFSET 1234")
def _skip(t):
    return basic.skip(t("orders").select("o_orderkey"), 1234)


@_frame("merge_join", "SELECT n_nationkey, n.n_name, m.n_name AS n_name_right_1 FROM nation n LEFT JOIN (SELECT * FROM nation WHERE n_regionkey = 1) m USING (n_nationkey)")
def _merge_join(t):
    some = t("nation").filter("n_regionkey = 1").select("n_nationkey", "n_name")
    return files.merge([t("nation").select("n_nationkey", "n_name"), some], "join", ["n_nationkey"], "left")


@_frame("validate_table", "SELECT 'column value has ' || count(*) FILTER (value IS NULL) || ' nulls' AS problem FROM (SELECT CASE WHEN event_id % 5 <> 0 THEN value END AS value FROM events)")
def _validate(t):
    df = t("events").select("event_id", F.expr("CASE WHEN event_id % 5 <> 0 THEN value END").alias("value"))
    return df.sparkSession.createDataFrame([(p,) for p in files.validate(df, check_nulls=True)], "problem string")


@_frame("verb_sample", None)
def _sample(t):
    return reshape.sample(t("lineitem"), 0.1, 7)


@_frame("verb_batches", "SELECT o_orderkey, (row_number() OVER () - 1) // 1000 AS batch FROM orders")
def _batches(t):
    return reshape.chunks(t("orders").select("o_orderkey"), 1000)


@_frame("union_all", "SELECT n_name AS name FROM nation UNION ALL SELECT r_name FROM region")
def _union(t):
    return basic.union_all([t("nation").select(F.col("n_name").alias("name")), t("region").select(F.col("r_name").alias("name"))])


@_frame("intersect", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def _intersect(t):
    return basic.intersect(t("customer").select(F.col("c_nationkey").alias("k")), t("supplier").select(F.col("s_nationkey").alias("k")))


@_frame("except_all", "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier")
def _except(t):
    return basic.difference(t("customer").select(F.col("c_nationkey").alias("k")), t("supplier").select(F.col("s_nationkey").alias("k")))


# ---- windows and series ---------------------------------------------------

_ORDER, _BY = ["ts", "event_id"], ["user_id"]
_OVER = "PARTITION BY user_id ORDER BY ts, event_id"


def _events(t) -> DataFrame:
    return t("events").select("event_id", "user_id", "ts", "value")


def _cents(t) -> DataFrame:
    """Whole cents, so that sums do not depend on their order."""
    return t("events").select("event_id", "user_id", "ts", F.round(F.col("value") * 100).cast("long").alias("cents"))


_CENTS = "(SELECT event_id, user_id, ts, round(value * 100)::BIGINT AS cents FROM events)"
for _fn, _sql in {"sum": "sum", "mean": "avg", "min": "min", "max": "max", "count": "count"}.items():
    _w = f"OVER ({_OVER} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)"
    _frame(f"rolling_{_fn}", f"SELECT *, CASE WHEN count(cents) {_w} >= 3 THEN {_sql}(cents) {_w} END AS cents_rolling_{_fn} FROM {_CENTS}")(lambda t, fn=_fn: series.rolling_agg(_cents(t), "cents", fn, 5, _ORDER, _BY, 3))
    _frame(f"cumulative_{_fn}", f"SELECT *, {_sql}(cents) OVER ({_OVER} ROWS UNBOUNDED PRECEDING) AS cents_cumulative_{_fn} FROM {_CENTS}")(lambda t, fn=_fn: series.cumulative_agg(_cents(t), "cents", fn, _ORDER, _BY))


@_frame("rolling_std", f"SELECT event_id, user_id, ts, value, CASE WHEN count(value) OVER w >= 5 THEN stddev_samp(value) OVER w END AS value_rolling_std FROM events WINDOW w AS ({_OVER} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)")
def _rolling_std(t):
    return series.rolling_std(_events(t), "value", 5, _ORDER, _BY)


@_frame(
    "ewma",
    f"WITH RECURSIVE n AS (SELECT event_id, user_id, ts, value, row_number() OVER ({_OVER}) AS i FROM events), e AS (SELECT n.*, value AS value_ewma FROM n WHERE i = 1 UNION ALL SELECT n.*, 0.3 * n.value + 0.7 * e.value_ewma FROM e JOIN n ON n.user_id = e.user_id AND n.i = e.i + 1) SELECT event_id, user_id, ts, value, value_ewma FROM e",
)
def _ewma(t):
    return series.ewma(_events(t), "value", 0.3, _ORDER, _BY)


@_frame("series_log_returns", f"SELECT event_id, user_id, ts, value, ln(value / lag(value) OVER ({_OVER})) AS value_log_return FROM events")
def _log_returns(t):
    return series.log_returns(_events(t), "value", _ORDER, _BY)


@_frame("series_roc", f"SELECT event_id, user_id, ts, value, value / coalesce(lag(value, 3) OVER ({_OVER}), first_value(value) OVER ({_OVER})) * 100 - 100 AS value_roc FROM events")
def _roc(t):
    return series.roc(_events(t), "value", 3, _ORDER, _BY)


@_frame("series_zscore", "SELECT event_id, user_id, ts, value, (value - avg(value) OVER w) / stddev_pop(value) OVER w AS value_zscore FROM events WINDOW w AS (PARTITION BY user_id)")
def _zscore(t):
    return series.zscore(_events(t), "value", _BY)


@_frame("series_bbands", f"SELECT event_id, user_id, ts, value, avg(value) OVER w AS value_middle, avg(value) OVER w + 2 * stddev_pop(value) OVER w AS value_upper, avg(value) OVER w - 2 * stddev_pop(value) OVER w AS value_lower FROM events WINDOW w AS ({_OVER} ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)")
def _bbands(t):
    return series.bbands(_events(t), "value", _ORDER, _BY, 10)


@_frame("series_obv", f"WITH f AS (SELECT event_id, user_id, ts, value, coalesce(sign(value - lag(value) OVER ({_OVER})), 0) * value AS flow FROM events) SELECT event_id, user_id, ts, value, sum(flow) OVER ({_OVER} ROWS UNBOUNDED PRECEDING) AS obv FROM f")
def _obv(t):
    return series.obv(_events(t), "value", "value", _ORDER, _BY)


_BARS = "(SELECT event_id, user_id, ts, value + event_id % 3 AS high, value - event_id % 5 AS low, value AS close FROM events)"
_CHAIN = "JOIN n ON n.user_id = e.user_id AND n.i = e.i + 1"


def _bars(t) -> DataFrame:
    own = F.col("value")
    return t("events").select("event_id", "user_id", "ts", (own + F.col("event_id") % 3).alias("high"), (own - F.col("event_id") % 5).alias("low"), own.alias("close"))


@_frame(
    "series_rsi",
    f"WITH RECURSIVE n AS (SELECT event_id, user_id, ts, value, coalesce(value - lag(value) OVER ({_OVER}), 0) AS s, row_number() OVER ({_OVER}) AS i, count(*) OVER (PARTITION BY user_id) AS c FROM events), e AS (SELECT n.*, 0::DOUBLE AS u, 0::DOUBLE AS d FROM n WHERE i = 1 UNION ALL SELECT n.*, 0.4 * greatest(n.s, 0) + 0.6 * e.u, 0.4 * greatest(-n.s, 0) + 0.6 * e.d FROM e {_CHAIN}) SELECT event_id, user_id, ts, value, CASE WHEN c > 4 THEN CASE WHEN u + d = 0 THEN 50 ELSE 100 * u / (u + d) END END AS value_rsi FROM e",
)
def _rsi(t):
    return series.rsi(_events(t), "value", _ORDER, _BY, 4)


@_frame(
    "series_macd",
    f"WITH RECURSIVE n AS (SELECT event_id, user_id, ts, value, row_number() OVER ({_OVER}) AS i FROM events), e AS (SELECT n.*, value AS f, value AS s, 0::DOUBLE AS g FROM n WHERE i = 1 UNION ALL SELECT n.*, (2 * n.value + e.f) / 3, (n.value + 2 * e.s) / 3, 0.4 * ((2 * n.value + e.f) / 3 - (n.value + 2 * e.s) / 3) + 0.6 * e.g FROM e {_CHAIN}) SELECT event_id, user_id, ts, value, f - s AS value_macd, g AS value_signal, f - s - g AS value_histogram FROM e",
)
def _macd(t):
    return series.macd(_events(t), "value", _ORDER, _BY, 2, 5, 4)


@_frame(
    "series_atr",
    f"WITH RECURSIVE b AS (SELECT *, lag(close) OVER ({_OVER}) AS p, row_number() OVER ({_OVER}) AS i FROM {_BARS}), n AS (SELECT *, greatest(high - low, abs(high - p), abs(low - p)) AS r FROM b), e AS (SELECT n.*, r::DOUBLE AS atr FROM n WHERE i = 1 UNION ALL SELECT n.*, 0.4 * n.r + 0.6 * e.atr FROM e {_CHAIN}) SELECT event_id, user_id, ts, high, low, close, atr FROM e",
)
def _atr(t):
    return series.atr(_bars(t), "high", "low", "close", _ORDER, _BY, 4)


@_frame(
    "series_adx",
    f"WITH b AS (SELECT *, high - lag(high) OVER ({_OVER}) AS u, lag(low) OVER ({_OVER}) - low AS d, lag(close) OVER ({_OVER}) AS p, row_number() OVER ({_OVER}) AS i FROM {_BARS}), s AS (SELECT *, sum(CASE WHEN u > d AND u > 0 THEN u ELSE 0 END) OVER w AS plus, sum(CASE WHEN d > u AND d > 0 THEN d ELSE 0 END) OVER w AS minus, sum(greatest(high - low, abs(high - p), abs(low - p))) OVER w AS r FROM b WINDOW w AS ({_OVER} ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)) SELECT event_id, user_id, ts, high, low, close, CASE WHEN i >= 8 AND r <> 0 THEN CASE WHEN plus + minus = 0 THEN 0 ELSE abs(plus - minus) / (plus + minus) * 100 END END AS adx FROM s",
)
def _adx(t):
    return series.adx(_bars(t), "high", "low", "close", _ORDER, _BY, 4)


@_frame(
    "series_cci",
    f"WITH b AS (SELECT *, (high + low + close) / 3 AS x FROM {_BARS}), s AS (SELECT *, avg(x) OVER w AS m, list(x) OVER w AS l FROM b WINDOW w AS ({_OVER} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)) SELECT event_id, user_id, ts, high, low, close, CASE WHEN len(l) = 1 THEN 0 ELSE (x - m) / (0.015 * list_avg(list_transform(l, lambda v: abs(v - m)))) END AS cci FROM s",
)
def _cci(t):
    return series.cci(_bars(t), "high", "low", "close", _ORDER, _BY, 5)


@_frame("series_sortino_ratio", "SELECT user_id, CASE WHEN count(*) FILTER (value < 50) = 0 THEN 'Infinity'::DOUBLE ELSE (avg(value) - 50) / sqrt(avg((value - 50) * (value - 50)) FILTER (value < 50)) END AS sortino_ratio FROM events GROUP BY 1")
def _sortino(t):
    return series.sortino_ratio(_events(t), "value", _BY, 50.0)


@_frame(
    "series_stoch_d",
    f"WITH RECURSIVE n AS (SELECT event_id, user_id, ts, high, low, close, row_number() OVER ({_OVER}) AS i, CASE WHEN max(high) OVER w = min(low) OVER w THEN 50 ELSE (close - min(low) OVER w) / (max(high) OVER w - min(low) OVER w) * 100 END AS stoch_k FROM {_BARS} WINDOW w AS ({_OVER} ROWS BETWEEN 13 PRECEDING AND CURRENT ROW)), e AS (SELECT n.*, stoch_k AS stoch_d FROM n WHERE i = 1 UNION ALL SELECT n.*, 0.5 * n.stoch_k + 0.5 * e.stoch_d FROM e {_CHAIN}) SELECT event_id, user_id, ts, high, low, close, stoch_k, stoch_d FROM e",
)
def _stoch_d(t):
    return series.stoch_d(_bars(t), "high", "low", "close", _ORDER, _BY)


@_frame("series_parabolic_sar", None)
def _parabolic_sar(t):
    return series.parabolic_sar(_bars(t), "high", "low", _ORDER, _BY)


@_frame("series_stoch_k", f"SELECT event_id, user_id, ts, value, CASE WHEN max(value) OVER w = min(value) OVER w THEN 50 ELSE (value - min(value) OVER w) / (max(value) OVER w - min(value) OVER w) * 100 END AS stoch_k FROM events WINDOW w AS ({_OVER} ROWS BETWEEN 13 PRECEDING AND CURRENT ROW)")
def _stoch_k(t):
    return series.stoch_k(_events(t), "value", "value", "value", _ORDER, _BY)


@_frame("series_max_drawdown", f"SELECT user_id, max((peak - value) / peak) AS max_drawdown FROM (SELECT user_id, value, max(value) OVER ({_OVER} ROWS UNBOUNDED PRECEDING) AS peak FROM events) GROUP BY 1")
def _drawdown(t):
    return series.max_drawdown(_events(t), "value", _ORDER, _BY)


@_frame("tumbling_window", "SELECT time_bucket(INTERVAL '1 hour', ts) AS start, time_bucket(INTERVAL '1 hour', ts) + INTERVAL '1 hour' AS \"end\", event_type, count(*) AS n, sum(value) AS total FROM events GROUP BY ALL")
def _tumbling(t):
    from .streaming import tumbling

    return tumbling(t("events"), "ts", "1 hour", [F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")], ("event_type",))


@_frame(
    "session_window",
    "WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '2 hours' THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL '2 hours' AS \"end\", count(*) AS n FROM s GROUP BY user_id, k",
)
def _sessions(t):
    from .streaming import sessions

    return sessions(t("events"), "ts", "2 hours", [F.count(F.lit(1)).alias("n")], ("user_id",))


# ---- sources --------------------------------------------------------------


def _shared(spark: SparkSession) -> str:
    """A folder that driver and executors share; a temporary one only in local mode."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root and spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return root.rstrip("/") if root else "file://" + tempfile.mkdtemp(prefix="braidql-")


def _round_trip(ending: str, **options) -> None:
    """Orders with some nulls, written in a format and read again."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = f"{_shared(spark)}/orders-{uuid.uuid4().hex}.{ending}"
        kept = F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderpriority")).alias("o_orderpriority")
        files.save(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", kept), path, **options)
        return files.load(spark, path).select(F.col("o_orderkey").cast("bigint").alias("o_orderkey"), "o_orderstatus", F.col("o_totalprice").cast("double").alias("o_totalprice"), "o_orderpriority")

    QUERIES[f"source_{ending}"] = run
    ORACLE[f"source_{ending}"] = "SELECT o_orderkey, o_orderstatus, o_totalprice, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderpriority END AS o_orderpriority FROM orders"


for _name in ("csv", "tsv", "adt", "jsonl", "orc", "parquet"):
    _round_trip(_name)
_round_trip("json", single=True)


def _json_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested rows, written flat and in ASCII, read again."""
    path = f"{_shared(spark)}/parts-{uuid.uuid4().hex}.jsonl"
    nested = table(spark, sf_dir, "part").select("p_partkey", F.struct(F.col("p_size").alias("size"), F.concat(F.col("p_name"), F.lit(" ёΩ")).alias("name")).alias("of"))
    files.save(nested, path, flatten=True, flatten_separator="_", escape_unicode=True)
    return files.load(spark, path)


QUERIES["source_json_options"] = _json_options
ORACLE["source_json_options"] = "SELECT p_partkey, p_size::BIGINT AS of_size, p_name || ' ёΩ' AS of_name FROM part"


def _converted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Parquet table converted to CSV, that to JSON lines, and those read."""
    folder = f"{_shared(spark)}/converted-{uuid.uuid4().hex}"
    files.convert(spark, f"{sf_dir}/supplier.parquet", f"{folder}.csv")
    files.convert(spark, f"{folder}.csv", f"{folder}.jsonl")
    return files.load(spark, f"{folder}.jsonl").select(F.col("s_suppkey").cast("long").alias("s_suppkey"), "s_name", F.col("s_acctbal").cast("double").alias("s_acctbal"))


QUERIES["source_convert"] = _converted
ORACLE["source_convert"] = "SELECT s_suppkey, s_name, s_acctbal FROM supplier"


# ---- streams --------------------------------------------------------------


def _streamed(spark: SparkSession, sf_dir: str, name: str, build: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What a stream over a table's files writes until they are all read."""
    folder = f"{_shared(spark)}/stream-{uuid.uuid4().hex}"
    stream = streaming.read_stream(spark, f"{sf_dir}/{name}*.parquet", table(spark, sf_dir, name).schema)
    writer = build(stream).writeStream.format("parquet").option("checkpointLocation", f"{folder}/state")
    writer.trigger(availableNow=True).start(f"{folder}/rows").awaitTermination()
    return spark.read.parquet(f"{folder}/rows")


def _user_totals(key, frames, state):
    n, total = state.get if state.exists else (0, 0)
    for frame in frames:
        n, total = n + len(frame), total + int(frame["event_id"].sum())
    state.update((n, total))
    yield pd.DataFrame({"user_id": [key[0]], "n": [n], "total": [total]})


QUERIES["stream_filter"] = lambda spark, sf_dir: _streamed(spark, sf_dir, "orders", lambda s: streaming.apply(s, "map(select(.o_totalprice > 200000)) | map({k: .o_orderkey, half: .o_totalprice / 2})"))
ORACLE["stream_filter"] = "SELECT o_orderkey AS k, o_totalprice / 2 AS half FROM orders WHERE o_totalprice > 200000"

QUERIES["stream_stateful"] = lambda spark, sf_dir: _streamed(spark, sf_dir, "events", lambda s: streaming.stateful(s.select("user_id", "event_id"), ["user_id"], _user_totals, "user_id long, n long, total long", "n long, total long"))
ORACLE["stream_stateful"] = "SELECT user_id, count(*) AS n, sum(event_id)::BIGINT AS total FROM events GROUP BY 1"


# ---- functions of a row ---------------------------------------------------

for _name, _table, _text, _sql in [
    ("abs", "supplier", ".s_acctbal - 5000 | abs", "abs(s_acctbal - 5000)"),
    ("acos", "part", "acos(.p_size / 100)", "acos(p_size / 100.0)"),
    ("asin", "part", "asin(.p_size / 100)", "asin(p_size / 100.0)"),
    ("atan", "part", "atan(.p_size)", "atan(p_size)"),
    ("sin", "part", "sin(.p_size)", "sin(p_size)"),
    ("cos", "part", "cos(.p_size)", "cos(p_size)"),
    ("tan", "part", "tan(.p_size)", "tan(p_size)"),
    ("exp", "part", "exp(.p_size / 10)", "exp(p_size / 10.0)"),
    ("log10", "part", "log10(.p_retailprice)", "log10(p_retailprice)"),
    ("sqrt", "part", "sqrt(.p_retailprice)", "sqrt(p_retailprice)"),
    ("pow", "part", "pow(.p_size; 3)", "pow(p_size::DOUBLE, 3)"),
    ("pi", "part", "pi", "pi()"),
    ("floor", "part", "floor(.p_retailprice / 7)", "floor(p_retailprice / 7)"),
    ("ceil", "part", "ceil(.p_retailprice / 7)", "ceil(p_retailprice / 7)"),
    ("round", "part", "round(.p_retailprice / 7)", "round(p_retailprice / 7)"),
    ("roundup", "part", "roundup(.p_retailprice / 7; 1)", "ceil(p_retailprice / 7 * 10.0) / 10.0"),
    ("rounddown", "part", "rounddown(.p_retailprice / 7; 1)", "floor(p_retailprice / 7 * 10.0) / 10.0"),
    ("mround", "part", "mround(.p_size; 7)", "round(p_size / 7.0) * 7"),
    ("isfinite", "part", "isfinite(.p_retailprice)", "isfinite(p_retailprice)"),
    ("isnan", "part", "isnan(.p_retailprice)", "isnan(p_retailprice)"),
    ("generate_sequence", "part", "generate_sequence(1; .p_size; 3) | add", "list_sum(range(1, p_size + 1, 3))::BIGINT"),
    ("range", "part", "range(.p_size) | add", "(p_size * (p_size - 1) / 2)::BIGINT"),
    ("array_sum", "part", "[.p_size, 4, .p_partkey] | sum", "p_size + 4 + p_partkey"),
    ("array_mean", "embeddings", ".embedding | mean", "list_avg(embedding::DOUBLE[])"),
    ("array_max", "embeddings", ".embedding | max", "list_max(embedding)"),
    ("array_min", "embeddings", ".embedding | min", "list_min(embedding)"),
    ("array_std", "embeddings", ".embedding | std", "list_stddev_samp(embedding::DOUBLE[])"),
    ("array_var", "embeddings", ".embedding | var", "list_var_samp(embedding::DOUBLE[])"),
    ("array_median", "embeddings", ".embedding | median", "list_median(embedding::DOUBLE[])"),
    ("array_percentile", "embeddings", "percentile(.embedding; 25)", "list_sort(embedding::DOUBLE[])[1 + floor((len(embedding) - 1) * 0.25)::INT]"),
    ("array_first", "embeddings", ".embedding | first", "embedding[1]"),
    ("array_last", "embeddings", ".embedding | last", "embedding[-1]"),
    ("array_pop", "embeddings", ".embedding | array_pop", "embedding[-1]"),
    ("array_shift", "embeddings", ".embedding | array_shift | .[0]", "embedding[2]"),
    ("array_push", "part", "array_push([.p_size]; 7; 9) | add", "p_size + 16"),
    ("array_unshift", "part", "array_unshift([.p_size]; 7; 9)", "3"),
    ("array_reverse", "embeddings", ".embedding | reverse | .[0]", "embedding[-1]"),
    ("array_sort", "embeddings", ".embedding | sort | .[2]", "list_sort(embedding)[3]"),
    ("array_unique", "part", "[.p_size, 5, 5, .p_size] | unique | add", "CASE WHEN p_size = 5 THEN 5 ELSE p_size + 5 END"),
    ("array_flatten", "part", "[[.p_size], [1, 2]] | flatten | add", "p_size + 3"),
    ("array_slice", "embeddings", ".embedding[2:5] | .[2]", "embedding[5]"),
    ("array_zip", "part", "zip([.p_size, .p_partkey]; [10, 20, 30]) | .[1] | add", "p_partkey + 20"),
    ("array_buffer", "embeddings", "buffer(.embedding; 10) | .[1] | .[0]", "embedding[11]"),
    ("array_repeat", "part", "repeat(.p_size; 3) | add", "3 * p_size"),
    ("array_transpose", "part", "[[1, 2], [.p_size, 4]] | transpose | .[0] | add", "p_size + 1"),
    ("array_map_select", "embeddings", ".embedding | map(select(. > 0)) | length", "len(list_filter(embedding, lambda x: x > 0))"),
    ("array_sort_by", "embeddings", ".embedding | sort_by(. * -1) | .[0]", "list_max(embedding)"),
    ("array_min_by", "embeddings", ".embedding | min_by(. * -1)", "list_max(embedding)"),
    ("array_contains", "part", "contains([1, 5, .p_size]; 7)", "p_size = 7"),
    ("array_count_if", "part", "count_if([1, 2, 3]; [.p_size > 10, true, .p_size > 30])", "1 + (p_size > 10)::INT + (p_size > 30)::INT"),
    ("array_avg_if", "part", "avg_if([1, 2, .p_size]; [true, false, true])", "(1 + p_size) / 2.0"),
    ("array_histogram", "part", 'histogram([0, .p_size, 100, 25]; 4) | .counts | join(",")', "array_to_string(list_transform(range(4), lambda i: len(list_filter([0, p_size, 100, 25], lambda x: least(x // 25, 3) = i))), ',')"),
    ("array_value_counts", "part", '[1, 1, .p_size] | value_counts | map(.value * 10 + .count) | join(",")', "CASE WHEN p_size = 1 THEN '13' ELSE '12,' || (p_size * 10 + 1) END"),
    ("array_filter", "part", '[.p_size, 5, 30] | filter(. > 10) | join(",")', "array_to_string(list_filter([p_size, 5, 30], lambda x: x > 10), ',')"),
    ("error", "part", 'try (if .p_size > 20 then error("large") else .p_name end) catch "caught"', "CASE WHEN p_size > 20 THEN 'caught' ELSE p_name END"),
    ("array_topk", "part", "topk([3, .p_size, .p_size, 3, .p_size]; 1) | .[0]", "p_size"),
    ("group_concat", "part", 'group_concat([.p_size, 2]; "-")', "p_size || '-2'"),
    ("zscore", "embeddings", ".embedding | zscore | .[0]", "(embedding[1]::DOUBLE - list_avg(embedding::DOUBLE[])) / list_stddev_pop(embedding::DOUBLE[])"),
    ("max_drawdown", "part", "max_drawdown([10, .p_size + 20, 5])", "(p_size + 15) / (p_size + 20.0)"),
    ("concat", "part", 'concat(.p_name; "-"; .p_size)', "p_name || '-' || p_size"),
    ("contains", "part", '.p_name | contains("red")', "contains(p_name, 'red')"),
    ("startswith", "part", '.p_name | startswith("s")', "starts_with(p_name, 's')"),
    ("endswith", "part", 'endswith(.p_name; "ring")', "ends_with(p_name, 'ring')"),
    ("lowercase", "part", ".p_type | lowercase", "lower(p_type)"),
    ("tolower", "part", ".p_type | tolower", "lower(p_type)"),
    ("uppercase", "part", ".p_name | uppercase", "upper(p_name)"),
    ("toupper", "part", ".p_name | toupper", "upper(p_name)"),
    ("trim", "part", 'concat("  "; .p_name; " ") | trim', "p_name"),
    ("lstrip", "part", 'concat("  "; .p_name; " ") | lstrip', "p_name || ' '"),
    ("rstrip", "part", 'concat("  "; .p_name; " ") | rstrip', "'  ' || p_name"),
    ("replace", "part", '.p_name | replace("e"; "E")', "replace(p_name, 'e', 'E')"),
    ("split", "part", '.p_name | split(" ") | .[1]', "string_split(p_name, ' ')[2]"),
    ("join", "part", '.p_name | split(" ") | join("_")', "replace(p_name, ' ', '_')"),
    ("titlecase", "part", ".p_name | titlecase", "array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ')"),
    ("camel_case", "part", ".p_name | camel_case", "string_split(p_name, ' ')[1] || upper(string_split(p_name, ' ')[2][1]) || string_split(p_name, ' ')[2][2:]"),
    ("snake_case", "part", ".p_name | snake_case", "replace(lower(p_name), ' ', '_')"),
    ("to_ascii", "part", ".p_name[0:2] | to_ascii", "ascii(p_name) || ' ' || ascii(p_name[2:])"),
    ("pluralize", "part", '.p_name | split(" ") | .[1] | pluralize', "string_split(p_name, ' ')[2] || 's'"),
    ("singular", "part", '.p_name | split(" ") | .[1] | pluralize | singular', "string_split(p_name, ' ')[2]"),
    ("transliterate", "part", 'concat("Щука объём льёт ЁЖ "; .p_name) | transliterate(.; "cyrillic"; "latin")', "'Shchuka ob''em l''et EZh ' || p_name"),
    ("humanize", "orders", "humanize(.o_orderkey)", "format('{:,}', o_orderkey)"),
    ("dos2unix", "part", 'concat(.p_name; "\\r\\n") | dos2unix', "p_name || chr(10)"),
    ("unix2dos", "part", 'concat(.p_name; "\\n") | unix2dos', "p_name || chr(13) || chr(10)"),
    ("tabs_to_spaces", "part", 'concat(.p_name; "\\t") | tabs_to_spaces(2)', "p_name || '  '"),
    ("spaces_to_tabs", "part", 'concat(.p_name; "    ") | spaces_to_tabs(4)', "p_name || chr(9)"),
    ("is_valid_utf8", "part", ".p_name | is_valid_utf8", "true"),
    ("to_valid_utf8", "part", ".p_name | to_valid_utf8", "p_name"),
    ("length", "documents", ".text | length", "length(text)"),
    ("tostring", "part", ".p_size | tostring", "p_size::VARCHAR"),
    ("tonumber", "part", ".p_size | tostring | tonumber", "p_size::DOUBLE"),
    (
        "base32_encode",
        "part",
        ".p_name | base32_encode",
        "array_to_string(list_transform(range((8 * strlen(p_name) + 4) // 5), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + list_sum(list_transform(range(5), lambda k: CASE WHEN rpad(encode(p_name)::BIT::VARCHAR, 8 * strlen(p_name)::INT + 5, '0')[i * 5 + k + 1] = '1' THEN 1 << (4 - k)::INT ELSE 0 END))::INT]), '')",
    ),
    ("base32_roundtrip", "part", ".p_name | base32_encode | base32_decode", "p_name"),
    ("base58_encode", "part", ".p_name | base58_encode", None),
    (
        "base58_encode_number",
        "orders",
        ".o_orderkey | tostring | base58_encode",
        "ltrim(array_to_string(list_transform(range(15, -1, -1), lambda i: '123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz'[1 + (('0x' || hex(o_orderkey::VARCHAR))::HUGEINT // pow(58, i)::HUGEINT % 58)::INT]), ''), '1')",
    ),
    ("base58_roundtrip", "part", ".p_name | base58_encode | base58_decode", "p_name"),
    ("base64_encode", "documents", ".text | base64_encode", "base64(encode(text))"),
    ("base64_decode", "documents", ".text | base64_encode | base64_decode", "text"),
    ("md5", "documents", ".text | md5", "md5(text)"),
    ("sha1", "documents", ".text | sha1", "sha1(text)"),
    ("SHA1", "part", ".p_name | SHA1", "sha1(p_name)"),
    ("SHA512", "part", ".p_name | SHA512", None),
    ("sha256", "documents", ".text | sha256", "sha256(text)"),
    ("sha512", "part", ".p_name | sha512", None),
    ("fromjson", "events", '.props | fromjson(.; "k INT") | .k', "(props->>'k')::INT"),
    ("json_get", "events", '.props | json_get("$.k")', "props->>'k'"),
    ("tojson", "part", "{a: .p_size, b: .p_name} | tojson", "'{\"a\":' || p_size || ',\"b\":\"' || p_name || '\"}'"),
    ("keys", "part", '{b: 1, a: .p_size} | keys | join(",")', "'a,b'"),
    ("values", "part", "{b: 1, a: .p_size} | values | add", "p_size + 1"),
    ("has", "part", '{a: .p_size} | has(.; "a")', "true"),
    ("del_key", "part", '{a: .p_size, b: 1} | del(.a) | keys | join(",")', "'b'"),
    ("transform_keys", "part", '{a: .p_size} | transform_keys(.; {a: "z"}) | .z', "p_size"),
    ("transform_values", "part", "transform_values([.p_size, 1]; . + 1) | add", "p_size + 3"),
    ("unnest", "part", '{a: {b: .p_size}} | unnest | .["a.b"]', "p_size"),
    ("empty", "part", '.p_name | empty', "false"),
    ("type", "part", ".p_retailprice | type", "'float'"),
    ("coalesce", "part", "coalesce(null; .p_size)", "p_size"),
    ("iif", "part", 'iif(.p_size > 20; "big"; "small")', "CASE WHEN p_size > 20 THEN 'big' ELSE 'small' END"),
    ("iferror", "part", "iferror(1 / (.p_size - 10); 0)", "CASE WHEN p_size = 10 THEN 0 ELSE 1 / (p_size - 10) END"),
    ("year", "orders", ".o_orderdate | year", "year(o_orderdate)"),
    ("month", "orders", ".o_orderdate | month", "month(o_orderdate)"),
    ("day", "orders", ".o_orderdate | day", "day(o_orderdate)"),
    ("hour", "events", ".ts | hour", "hour(ts)"),
    ("minute", "events", ".ts | minute", "minute(ts)"),
    ("second", "events", ".ts | second", "second(ts)"),
    ("start_of_month", "orders", ".o_orderdate | start_of_month", "strftime(date_trunc('month', o_orderdate), '%Y-%m-%d')"),
    ("end_of_month", "orders", ".o_orderdate | end_of_month", "epoch(last_day(o_orderdate)::TIMESTAMP)::BIGINT + 86399"),
    ("start_of_week", "orders", ".o_orderdate | start_of_week", "epoch(date_trunc('week', o_orderdate)::TIMESTAMP)::BIGINT"),
    ("start_of_week_sunday", "orders", 'start_of_week(.o_orderdate; "sunday")', "epoch(date_trunc('day', o_orderdate)::TIMESTAMP)::BIGINT - 86400 * dayofweek(o_orderdate)"),
    ("end_of_week", "orders", ".o_orderdate | end_of_week", "dayofweek(o_orderdate) = 0"),
    ("truncate_date", "orders", 'truncate_date(.o_orderdate; "year")', "epoch(date_trunc('year', o_orderdate)::TIMESTAMP)::BIGINT"),
    ("truncate_time", "events", 'truncate_time(.ts; "hour")', "epoch(date_trunc('hour', ts))::BIGINT"),
    ("date_diff", "orders", 'date_diff(.o_orderdate; "1995-01-01")', "abs(epoch(o_orderdate)::BIGINT - epoch(TIMESTAMP '1995-01-01')::BIGINT) // 86400"),
    ("time_series_range", "part", 'time_series_range(0; 86400 * .p_size; "1d") | last', "86400 * p_size"),
    ("gmtime", "events", "gmtime(.ts) | .weekday * 1000 + .yearday", "dayofweek(ts) * 1000 + dayofyear(ts)"),
    ("mktime", "orders", 'strftime(.o_orderdate; "%Y-%m-%d %H:%M:%S") | mktime', "epoch(o_orderdate)::BIGINT"),
    ("strftime", "events", 'strftime(.ts; "%Y/%m/%d %H-%M-%S %j")', "strftime(ts, '%Y/%m/%d %H-%M-%S %j')"),
    ("strflocaltime", "events", 'strflocaltime(.ts; "%Y-%m-%d %H:%M:%S")', "strftime(ts, '%Y-%m-%d %H:%M:%S')"),
    ("localtime", "events", "localtime(.ts)", "strftime(ts, '%Y-%m-%d %H:%M:%S')"),
    ("strptime", "orders", 'strftime(.o_orderdate; "%d.%m.%Y") | strptime(.; "%d.%m.%Y")', "epoch(o_orderdate)::BIGINT"),
    ("url_extract_domain", "pages", ".url | url_extract_domain", "regexp_extract(url, '://([^/?#]+)', 1)"),
    ("url_extract_domain_without_www", "pages", ".url | url_extract_domain_without_www", "regexp_replace(regexp_extract(url, '://([^/?#]+)', 1), '^www\\.', '')"),
    ("url_extract_path", "pages", ".url | url_extract_path", "regexp_extract(url, '://[^/?#]+([^?#]*)', 1)"),
    ("url_extract_protocol", "pages", ".url | url_extract_protocol", "regexp_extract(url, '^([^:]+)', 1)"),
    ("url_extract_query_string", "pages", ".url | url_extract_query_string", "nullif(regexp_extract(url, '\\?([^#]*)', 1), '')"),
    ("url_extract_port", "pages", 'url_set_port(.url; 8080) | url_extract_port', "8080"),
    ("url_parse", "pages", ".url | url_parse | .fragment", "nullif(regexp_extract(url, '#(.*)$', 1), '')"),
    ("url_set_domain", "pages", '.url | url_set_domain("x.org")', "regexp_replace(url, '://[^/?#]+', '://x.org')"),
    ("url_set_domain_without_www", "pages", ".url | url_set_domain_without_www", "regexp_replace(url, '://www\\.', '://')"),
    ("url_set_path", "pages", '.url | url_set_path("/p")', "regexp_replace(url, '(://[^/?#]+)[^?#]*', '\\1/p')"),
    ("url_set_port", "pages", "url_set_port(.url; 8080)", "regexp_replace(url, '(://[^/?#]+)', '\\1:8080')"),
    ("url_set_protocol", "pages", '.url | url_set_protocol("ftp")', "regexp_replace(url, '^[^:]+', 'ftp')"),
    ("url_set_query_string", "pages", 'url_set_query_string(.url; "zz"; "1")', "regexp_replace(url, '#.*', '') || CASE WHEN contains(url, '?') THEN '&' ELSE '?' END || 'zz=1' || regexp_extract(url, '#.*')"),
    ("url_strip_fragment", "pages", ".url | url_strip_fragment", "regexp_replace(url, '#.*$', '')"),
    ("url_strip_port", "pages", "url_set_port(.url; 8080) | url_strip_port", "url"),
    ("url_strip_port_if_default", "pages", "url_set_port(.url; 443) | url_strip_port_if_default", "CASE WHEN starts_with(url, 'https://') THEN url ELSE regexp_replace(url, '(://[^/?#]+)', '\\1:443') END"),
    ("url_strip_protocol", "pages", ".url | url_strip_protocol", "regexp_replace(url, '^[^:]+:', '')"),
    ("url_strip_query_string", "pages", ".url | url_strip_query_string", "regexp_replace(url, '\\?[^#]*', '')"),
    ("rand", "part", "rand", None),
    ("randbetween", "part", "randbetween(1; 6)", None),
    ("randarray", "part", "randarray(3) | length", "3"),
    ("generate_uuidv4", "part", "generate_uuidv4 | length", "36"),
    ("generate_uuidv7", "part", "generate_uuidv7 | length", "36"),
    ("now", "part", "now | length", "23"),
    ("today", "part", "today | length", "10"),
    ("systime", "part", "systime | type", "'integer'"),
    ("systime_ns", "part", "systime_ns > 1700000000000000000", "true"),
    ("systime_int", "part", "systime_int > 0", "true"),
    ("log_returns", "part", "[.p_retailprice, .p_size, .p_partkey] | log_returns | .[2]", "CASE WHEN p_partkey > 0 THEN ln(p_partkey / p_size::DOUBLE) END"),
    ("roc", "part", "roc([.p_size, 5, .p_retailprice]; 2) | .[2]", "(p_retailprice / p_size - 1) * 100"),
    ("rsi", "part", "rsi([.p_retailprice, .p_size, .p_partkey, 30]; 1) | .[2]", "CASE WHEN p_partkey > p_size THEN 100.0 WHEN p_partkey < p_size THEN 0.0 ELSE 50.0 END"),
    ("macd", "part", "macd([.p_retailprice, .p_size]; 1; 3; 1) | .[1] | .macd", "p_size - (0.5 * p_size + 0.5 * p_retailprice)"),
    ("bbands", "part", "bbands([.p_size, .p_partkey, .p_retailprice]; 2) | .[2] | .upper", "(p_partkey + p_retailprice) / 2 + abs(p_partkey - p_retailprice)"),
    ("atr", "part", "atr([.p_retailprice, .p_size + 60]; [.p_size, .p_size]; [.p_size, 3]; 3) | .[1]", "0.5 * greatest(60, 60) + 0.5 * (p_retailprice - p_size)"),
    ("adx", "part", "adx([.p_size, .p_size + 1, .p_size, .p_size + .p_partkey + 5]; [0, 1, -2, 2]; [1, 1, 1, 1]; 2) | .[3]", "100.0 * (p_partkey + 2) / (p_partkey + 8)"),
    ("cci", "part", "cci([.p_size, 4, .p_retailprice]; [.p_size, 4, .p_retailprice]; [.p_size, 4, .p_retailprice]) | .[2]", "(p_retailprice - (p_size + 4 + p_retailprice) / 3) / (0.005 * (abs(p_size - (p_size + 4 + p_retailprice) / 3) + abs(4 - (p_size + 4 + p_retailprice) / 3) + abs(p_retailprice - (p_size + 4 + p_retailprice) / 3)))"),
    ("obv", "part", "obv([.p_size, 25, .p_partkey]; [5, .p_size, 7]) | .[2]", "sign(25 - p_size) * p_size::DOUBLE + sign(p_partkey - 25) * 7"),
    ("parabolic_sar", "part", "parabolic_sar([.p_size, .p_size + 1, .p_size + 2, .p_size + 3]; [.p_size - 1, .p_size, .p_size + 1, .p_size + 2]) | .[3]", "p_size - 1 + 0.06 * 3"),
    ("stoch_k", "part", "stoch_k([.p_size, 60]; [0, .p_size - 50]; [1, .p_size]) | .[1]", "(p_size - least(0, p_size - 50)) / (60.0 - least(0, p_size - 50)) * 100"),
    ("stoch_d", "part", "stoch_d([60, 60]; [0, 0]; [.p_size, 30]; 14; 3) | .[1]", "0.5 * 50 + 0.5 * (p_size / 60.0 * 100)"),
    ("sharpe_ratio", "part", "sharpe_ratio([.p_size, 2, .p_retailprice])", "list_avg([p_size::DOUBLE, 2, p_retailprice]) / list_stddev_pop([p_size::DOUBLE, 2, p_retailprice])"),
    ("sortino_ratio", "part", "sortino_ratio([0 - .p_size, 3, .p_retailprice])", "((p_retailprice + 3 - p_size) / 3) / p_size"),
    ("beta", "part", "beta([.p_size, 4, .p_retailprice]; [1, 2, .p_partkey + 5])", "((p_size + 8 + p_retailprice * (p_partkey + 5)) / 3 - (p_size + 4 + p_retailprice) / 3 * (8 + p_partkey) / 3) / list_var_pop([1, 2, p_partkey + 5::DOUBLE])"),
    ("alpha", "part", "alpha([.p_size, 4, .p_retailprice]; [1, 2, .p_partkey + 5])", "(p_size + 4 + p_retailprice) / 3 - ((p_size + 8 + p_retailprice * (p_partkey + 5)) / 3 - (p_size + 4 + p_retailprice) / 3 * (8 + p_partkey) / 3) / list_var_pop([1, 2, p_partkey + 5::DOUBLE]) * (8 + p_partkey) / 3"),
    ("correl", "part", "correl([.p_size, 4, .p_retailprice]; [1, 2, .p_partkey + 5])", "((p_size + 8 + p_retailprice * (p_partkey + 5)) / 3 - (p_size + 4 + p_retailprice) / 3 * (8 + p_partkey) / 3) / sqrt(list_var_pop([p_size::DOUBLE, 4, p_retailprice]) * list_var_pop([1, 2, p_partkey + 5::DOUBLE]))"),
    ("quartile", "part", "quartile([.p_size, 4, .p_retailprice, 9]; 1)", "list_aggregate([p_size::DOUBLE, 4, p_retailprice, 9], 'quantile_cont', 0.25)"),
]:
    _value(_name, _table, _text, _sql)
