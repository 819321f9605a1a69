import io
import json
import subprocess

import pandas as pd
import pytest
from pyspark.sql import functions as F

from braidql import cli, config, sources
from braidql.api import Executor, Pipeline, Query, process_csv, process_json
from braidql.operators.aggregate import Agg, simple_agg
from braidql.operators.joins import Keys
from braidql.sources import formats

PEOPLE = [{"name": "Alice", "age": 30, "city": "New York"}, {"name": "Bob", "age": 25, "city": "San Francisco"}, {"name": "Charlie", "age": 35, "city": "Chicago"}]


@pytest.fixture
def people(spark):
    return spark.createDataFrame([tuple(p.values()) for p in PEOPLE], "name string, age bigint, city string").coalesce(1)


@pytest.mark.parametrize("ending", ["csv", "tsv", "json", "jsonl", "parquet", "orc", "arrow", "adt"])
def test_round_trips(spark, people, tmp_path, ending):
    path = f"{tmp_path}/people.{ending}"
    sources.save(people, path)
    back = sources.load(spark, path)
    got = sorted((r["name"], int(r["age"]), r["city"]) for r in back.collect())
    assert got == sorted(tuple(p.values()) for p in PEOPLE)


def test_json5_and_json_array(spark, tmp_path):
    (tmp_path / "a.json5").write_text("// people\n[{name: 'Al', age: +3, /* x */ s: \"it's\",}, {name: 'Bo', age: 0x10}]")
    rows = sorted(sources.load(spark, f"{tmp_path}/a.json5").select("name", "age", "s").collect())
    assert [tuple(r) for r in rows] == [("Al", 3, "it's"), ("Bo", 16, None)]
    (tmp_path / "a.json").write_text(json.dumps(PEOPLE))
    assert sources.load(spark, f"{tmp_path}/a.json").count() == 3


def test_options(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x;y\n1;-\n2;3\n4;5\n")
    df = sources.load(spark, f"{tmp_path}/a.csv", detect_separator=True, null_values="-", skip_rows=1, max_rows=1, columns=["y"])
    assert [tuple(r) for r in df.collect()] == [(3,)]
    (tmp_path / "b.jsonl").write_text('{"a": 1}\nbroken\n{"a": 2}\n')
    assert sources.load(spark, f"{tmp_path}/b.jsonl", schema="a int", ignore_errors=True).count() == 2
    assert sources.load(spark, [f"{tmp_path}/a.csv", f"{tmp_path}/a.csv"], separator=";").count() == 6


def test_writer_options(spark, tmp_path):
    df = spark.createDataFrame([(1, 'say "hi"', 2.345, ("x", ("é😀",))), (2, None, None, None)], "id int, s string, d double, o struct<a:string,b:struct<c:string>>").coalesce(1)
    flat = sources.files.flatten(df, "_")
    assert flat.columns == ["id", "s", "d", "o_a", "o_b_c"] and flat.collect()[1].o_a is None
    assert sources.files.flatten(df, "_", 1).columns == ["id", "s", "d", "o_a", "o_b"]
    with pytest.raises(ValueError):
        sources.files.flatten(df.withColumn("o.a", F.lit(1)))
    sources.save(df, f"{tmp_path}/a.jsonl", single=True, escape_unicode=True, include_nulls=True)
    lines = (tmp_path / "a.jsonl").read_text().splitlines()
    assert lines[0].isascii() and [json.loads(x) for x in lines][0]["o"] == {"a": "x", "b": {"c": "é😀"}} and json.loads(lines[1])["s"] is None
    sources.save(df, f"{tmp_path}/b.json", single=True, escape_unicode=True, flatten=True, flatten_separator="/")
    assert [r.get("o/b/c") for r in json.loads((tmp_path / "b.json").read_text())] == ["é😀", None]
    assert sources.load(spark, f"{tmp_path}/a.jsonl", flatten=True).columns == ["d", "id", "o.a", "o.b.c", "s"]
    plain = df.select("id", "s", "d")
    sources.save(plain, f"{tmp_path}/a.csv", single=True, float_precision=1, quote_style="always")
    assert (tmp_path / "a.csv").read_text().splitlines()[1] == '"1","say ""hi""","2.3"'
    sources.save(plain, f"{tmp_path}/b.csv", single=True, float_precision=2, quote_style="never")
    assert (tmp_path / "b.csv").read_text().splitlines()[1] == '1,say "hi",2.35'
    with pytest.raises(Exception, match="not quoted"):
        sources.save(plain.withColumn("s", F.lit("a,b")), f"{tmp_path}/c.csv", quote_style="never")
    with pytest.raises(ValueError):
        sources.save(plain, f"{tmp_path}/d.csv", quote_style="sometimes")


@pytest.mark.parametrize("head, name", [(b"PAR1xx", "parquet"), (b"Obj\x01", "avro"), (b"ARROW1", "arrow"), (b"ORC", "orc"), (b'[{"a":1}]', "json"), (b'{"a":1}\n{"a":2}\n{"a"', "jsonlines"), (b"a\tb\n1\t2\n", "tsv"), (b"a,b\n1,2\n", "csv"), (b"a\x1fb\x1e1\x1f2", "adt")])
def test_sniffing(head, name):
    assert formats.format_of_bytes(head).name == name


def test_formats():
    assert formats.format_of("x/y.ndjson.gz").name == "jsonlines" and formats.format_of("x") is None
    assert formats.separator_of('a|b\n"1|2"|3\n') == "|"
    with pytest.raises(ValueError):
        formats.by_name("nothing")
    assert sources.files.resolve("hf://datasets/u/r/d/a.csv").endswith("/datasets/u/r/resolve/main/d/a.csv")


def test_validate_merge_inspect(spark, people, tmp_path):
    twice = people.union(people)
    problems = sources.validate(twice, {"name": "string", "age": "i32", "zip": "str"}, True, True)
    assert len(problems) == 4
    assert sources.validate(people, {"name": "string", "age": "int64", "city": "utf8"}, True, True) == []
    assert sources.merge([people, people.select("name")]).count() == 6
    assert sources.merge([people, people], "join", ["name"]).count() == 3
    sources.save(people, f"{tmp_path}/p.parquet")
    found = sources.inspect(spark, f"{tmp_path}/p.parquet", 2, True)
    assert found["rows"] == 3 and len(found["sample"]) == 2 and found["stats"]["age_mean"] == 30


def test_fluent(spark, people):
    q = Query(people)
    assert q.filter_expr("age > 26 and city != 'Chicago'").count() == 1
    assert [r["name"] for r in q.sort_by(("age", True)).head(1).collect()] == ["Charlie"]
    assert json.loads(q.select("name").apply_filter("map(.name | uppercase)").to_json())[0] == {"value": "ALICE"}
    assert q.bind(n=26).apply_filter("map(select(.age > $n))").count() == 2
    assert q.inner_join(Query(people.select("name")), "name").count() == 3
    assert q.aggregate([], [Agg("max", "age")]).collect() == [{"age_max": 35}]
    assert len(q.select("name").head(1).operations) == 2
    assert Query.range(0, 4).count() == 4 and Query.empty().is_empty()
    keys, aggs = simple_agg("city").mean("age").build()
    assert q.aggregate(keys, aggs).count() == 3
    assert json.loads(process_csv("a,b\n1,2\n3,4", lambda x: x.filter_expr("a > 1"))) == [{"a": 3, "b": 4}]
    assert json.loads(process_json('[{"a": 1}, {"a": 2}]', lambda x: x.tail(1))) == [{"a": 2}]
    plan = Pipeline().select("name", "age").filter("age > 26").sort("age").head(1)
    assert plan.execute(people).first().name == "Alice" and plan.describe() == ["select", "filter", "sort", "head"]
    assert plan.join(people, Keys.on("name")).execute(people).count() == 1
    ex = Executor({"n": 1})
    ex.clear_cache()
    assert ex.execute("map(.age + $n)", people).count() == 3 and ex.cache_size() == 1
    with pytest.raises(ValueError):
        ex.validate("map(")


def test_command_line(spark, people, tmp_path, capsys):
    src = f"{tmp_path}/p.csv"
    sources.save(people, src, single=True)
    out = io.StringIO()
    assert cli.main(["map(select(.age > $n)) | map(.name)", src, "--argjson", "n", "29"], out) == 0
    assert json.loads(out.getvalue()) == ["Alice", "Charlie"]
    assert cli.main(["convert", src, f"{tmp_path}/p.parquet"], out) == 0 and spark.read.parquet(f"{tmp_path}/p.parquet").count() == 3
    assert cli.main(["map(", src], out) == 2
    assert cli.main(["validate", src, "--check-duplicates"], out) == 0
    assert cli.main(["merge", src, src, "-o", f"{tmp_path}/m.jsonl"], out) == 0 and spark.read.json(f"{tmp_path}/m.jsonl").count() == 6
    out = io.StringIO()
    assert cli.main(["inspect", src, "--schema"], out) == 0 and json.loads(out.getvalue())["age"] == "int"
    out = io.StringIO()
    cli.Repl(spark, out).run(iter([f":load {src}", "length", ":validate map(.a)", "bad(", ":history", ":quit"]))
    assert "valid" in out.getvalue() and "error" in out.getvalue()


def test_completions():
    bash = cli.completions("bash")
    ask = lambda *words: subprocess.run(["bash", "-c", f'{bash}\nCOMP_WORDS=({" ".join(words)}); COMP_CWORD={len(words) - 1}; _braidql; echo "${{COMPREPLY[@]}}"'], capture_output=True, text=True, check=True).stdout.split()
    assert ask("braidql", "con") == ["convert"] and ask("braidql", "validate", "--check") == ["--check-duplicates", "--check-nulls"]
    assert "bashcompinit" in cli.completions("zsh") and "-l check-nulls" in cli.completions("fish")


def test_config(tmp_path):
    (tmp_path / "c.toml").write_text('limit = 5\nmaster = "local[2]"\n')
    got = config.load(str(tmp_path / "c.toml"), {"BRAIDQL_LIMIT": "7"}, output_format="csv")
    assert (got.limit, got.master, got.output_format) == (7, "local[2]", "csv")
    (tmp_path / "d.json").write_text('{"nothing": 1}')
    with pytest.raises(ValueError):
        config.load(str(tmp_path / "d.json"), {})


def test_streaming(spark, people, tmp_path):
    from braidql import streaming

    people.write.parquet(f"{tmp_path}/in")
    stream = streaming.read_stream(spark, f"{tmp_path}/in", people.schema)
    seen = []
    streaming.for_each_batch(stream, "map(select(.age > 26)) | {n: length}", lambda df, _: seen.append(df.first().n), f"{tmp_path}/cp").awaitTermination()
    assert seen == [2]
    rows = streaming.apply(stream, "map(select(.age > 26)) | map({name})")
    assert rows.isStreaming and rows.columns == ["name"]
    events = spark.createDataFrame([("a", "2024-01-01 00:00:10"), ("a", "2024-01-01 00:00:50"), ("a", "2024-01-01 00:09:00")], "k string, t string").withColumn("t", F.to_timestamp("t"))
    assert streaming.tumbling(events, "t", "1 minute", [F.count("*").alias("n")], ("k",)).count() == 2
    assert streaming.sessions(events, "t", "2 minutes", [F.count("*").alias("n")], ("k",)).count() == 2

    def total(key, frames, state):
        state.update(((state.get[0] if state.exists else 0) + sum(int(f["age"].sum()) for f in frames),))
        yield pd.DataFrame({"city": [key[0]], "total": [state.get[0]]})

    for _ in range(2):  # the second run takes up the state that the first has left
        ages = streaming.stateful(streaming.read_stream(spark, f"{tmp_path}/in", people.schema), ["city"], total, "city string, total long", "total long")
        ages.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/ages-state").trigger(availableNow=True).start(f"{tmp_path}/ages").awaitTermination()
        people.write.mode("append").parquet(f"{tmp_path}/in")
    once = {r.city: r.s for r in people.groupBy("city").agg(F.sum("age").alias("s")).collect()}
    assert {r.city: r.m for r in spark.read.parquet(f"{tmp_path}/ages").groupBy("city").agg(F.max("total").alias("m")).collect()} == {k: 2 * v for k, v in once.items()}


def test_one_array_is_written_and_read_by_many_tasks(spark, tmp_path, monkeypatch):
    df = spark.range(1000).repartition(7).select("id", F.when(F.col("id") % 3 != 0, F.concat(F.lit('a,]\n"'), "id")).alias("s"), F.struct(F.array("id", F.lit(2)).alias("x")).alias("o"))
    monkeypatch.setattr(type(df), "toLocalIterator", None)  # rows must not pass the driver
    sources.save(df, f"{tmp_path}/a.json", single=True)
    found = json.loads((tmp_path / "a.json").read_text())
    assert sorted(r["id"] for r in found) == list(range(1000)) and found[0]["o"]["x"][1] == 2
    assert sorted(p.name for p in tmp_path.iterdir() if not p.name.startswith(".")) == ["a.json"]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        back = sources.load(spark, f"{tmp_path}/a.json")
        assert back.rdd.getNumPartitions() > 2
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert back.columns == ["id", "o", "s"] and sorted(map(str, back.select(*df.columns).collect())) == sorted(map(str, df.collect()))
    with pytest.raises(FileExistsError):
        sources.save(df, f"{tmp_path}/a.json", single=True)
    sources.save(df.limit(0), f"{tmp_path}/b.json", single=True)
    assert json.loads((tmp_path / "b.json").read_text()) == []


@pytest.mark.parametrize(
    "text",
    [
        '[\n{"a": [\n{"b": 1},\n{"b": 2}\n], "c": 3},\n{"c": 4}\n]\n',
        '[\n{"c": 1}, {"c": 2},\n{"c": 3}\n]',
        '[\n{"c": 1},\n{"c":\n2}\n]',
        '[\n{"c": 1}\n,{"c": "x\\n,]"}\n\n]',
        '[\r\n  {"c": 1},\r\n  {"d": {"e": 2}}\r\n]\r\n',
        '[\n{"c": 1},\n{"c": 2}]',
    ],
)
def test_arrays_over_lines_are_what_a_whole_reading_gives(spark, tmp_path, text):
    (tmp_path / "a.json").write_bytes(text.encode())
    got, want = sources.load(spark, f"{tmp_path}/a.json"), spark.read.option("multiLine", True).json(f"{tmp_path}/a.json")
    assert got.dtypes == want.dtypes and got.collect() == want.collect() and len(json.loads(text)) == got.count()
