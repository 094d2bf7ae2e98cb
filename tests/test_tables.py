"""Queries against DuckDB, native plans against the interpreter, sources, sinks and streams."""

import gzip
import json

import pytest

from millrace import queries as own
from millrace.api import exit_status, query, query_all, query_json, slurp
from millrace.functions.values import from_json, to_json
from millrace.plans.typed import NotNative
from millrace.sources.readers import read_json, rows_as_json
from millrace.sources.writers import Style, write_text
from tests.conftest import DATA, same_as_sql


@pytest.mark.parametrize("name", sorted(own.oracle_sql()))
def test_against_sql(name, spark, duck):
    same_as_sql(own.queries()[name](spark, DATA), duck, own.oracle_sql()[name])


PROGRAMS = [
    "{a, b}", "select(.a > 1)", "select(.a < 2) | .b", ".a + 1", ".a == null", ".b // \"none\"", "if .a then .b else \"x\" end", "[.c[] | . * 2]", ".c | length", ".c[-1]", ".c[1:]", ".b | length",
    "(.b // \"\") | ascii_upcase", ".c | add", ".c | map(select(. > 1))", ".c[]", ".a, .d", "reduce .c[] as $x (0; . + $x)", ".d | floor", ".d * 2 | tostring", "{x: .a, y: (.c | any(. > 2))}", ".c | sort | reverse", "[.a, .d]", ".a as $x | .c | map(. + $x)", ".b |= (. // \"z\")", "has(\"a\")", "(.b // \"\") | test(\"^x\")", ".c | contains([2])", ".c | min", ".d > .a",
]


@pytest.mark.parametrize("program", PROGRAMS)
def test_native_equals_interpreted(program, spark):
    rows = [(1, "xy", [3, 1, 2], 1.5), (None, None, [], -0.25), (2, "", [2], 3.0), (5, "xé", [4, 4], 2.75)]
    df = spark.createDataFrame(rows, "a long, b string, c array<long>, d double")
    native = query(df, program, mode="native")
    options = {"ignoreNullFields": "false"}
    from pyspark.sql import functions as F

    if native.columns == ["value"]:
        got = [to_json(from_json(json.loads(json.dumps(r["x"])))["value"]) for r in native.select(F.to_json(F.struct("value"), options).alias("x")).collect()]
    else:
        got = [to_json(from_json(r["x"])) for r in native.select(F.to_json(F.struct("*"), options).alias("x")).collect()]
    want = [r["value"] for r in query(df, program, mode="interpreted").collect()]
    assert sorted(got) == sorted(want)


def test_filter_reaches_the_scan(spark, capsys):
    own.QUERIES["select_eq"](spark, DATA).explain("formatted")
    plan = capsys.readouterr().out
    assert "EqualTo(event_type,purchase)" in plan
    assert "ReadSchema: struct<user_id:bigint,event_type:string,value:double>" in plan


def test_json_values_in_columns(spark):
    texts = ['{"k":1}', '{"k":"a"}', '{"k":null}', "{}", '{"k":[1]}', '{"k":true}', '{"k":2.5}', '{"k":"5"}', '{"k":false}']
    df = spark.createDataFrame([(t,) for t in texts], "j string")
    for program in ("(.j | fromjson | .k) > 1", "(.j | fromjson | .k) == \"a\"", "(.j | fromjson | .k) < \"b\"", "(.j | fromjson | .k | type)", "if (.j | fromjson | .k) then 1 else 0 end", "(.j | fromjson | .k) != 1", "(.j | fromjson | .k | tostring)", "select((.j | fromjson | .k) >= 2) | .j"):
        native = [to_json(r["value"]) for r in query(df, program, mode="native").collect()]
        assert native == [r["value"] for r in query(df, program, mode="interpreted").collect()], program


def test_falls_back(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k long, s string")
    with pytest.raises(NotNative):
        query(df, "[paths]", mode="native")
    assert [r["value"] for r in query(df, "[paths] | length").collect()] == ["2", "2"]
    assert [r["value"] for r in query_all(df, "map(.s) | sort_by(.) | add").collect()] == ['"ab"']


def test_empty_and_clashing_columns(spark):
    df = spark.createDataFrame([], "value long, `$each` string, key string")
    assert query(df, "{value, key}").count() == 0
    assert query_all(df, "length").first()["value"] == 0
    assert query_all(df, "group_by(.key) | map({k: .[0].key, n: length})").count() == 0


def test_sources(spark, tmp_path):
    (tmp_path / "a.json").write_text('\ufeff{"a":1}\n\n{"a":[2]}\n')
    with gzip.open(tmp_path / "b.json.gz", "wt") as file:
        file.write('{"a":3}\n')
    (tmp_path / "c.txt").write_text('{"a":\n 1} {"a": 2} 3')
    (tmp_path / "d.seq").write_text('\x1e{"a":1}\n\x1e{"a":\n\x1e[2]\n')
    value = lambda df: [r["value"] for r in df.orderBy("file", "place", "turn").collect()]
    assert value(query_json(spark, str(tmp_path / "a.json"), ".a")) == ["1", "[2]"]
    assert value(query_json(spark, str(tmp_path / "b.json.gz"), ".a", mode="lines")) == ["3"]
    assert value(query_json(spark, str(tmp_path / "c.txt"), ".a?")) == ["1", "2"]
    assert value(query_json(spark, str(tmp_path / "d.seq"), ".", mode="seq")) == ['{"a":1}', "[2]"]
    assert value(query_json(spark, str(tmp_path / "c.txt"), "length", mode="raw")) == ["5", "14"]
    assert value(query_json(spark, str(tmp_path / "a.json"), "map(.a)", slurped=True)) == ["[1,[2]]"]
    assert value(query_json(spark, str(tmp_path / "a.json"), "[inputs | .a]", null_input=True)) == ["[1,[2]]"]
    assert value(query_json(spark, str(tmp_path / "a.json"), "select(length == 2)", stream_events=True))[0] == '[["a"],1]'


def test_errors_and_exit_status(spark, tmp_path):
    (tmp_path / "a").write_text("1\nx\n2\n")
    out = query_json(spark, str(tmp_path / "a"), "., (if . == 2 then error(\"two\") else empty end)", mode="lines")
    rows = out.orderBy("place", "turn").collect()
    assert [r["value"] for r in rows] == ["1", None, "2", None] and rows[3]["error"] == "two"
    assert exit_status(out) == 5
    assert exit_status(query_json(spark, str(tmp_path / "a"), "empty", mode="raw")) == 4
    assert exit_status(query_json(spark, str(tmp_path / "a"), "null", mode="raw")) == 1


@pytest.mark.parametrize("style,want", [(Style(), '{"b":1,"a":"é"}\n"x"\n'), (Style(raw=True), '{"b":1,"a":"é"}\nx\n'), (Style(join=True), '{"b":1,"a":"é"}x'), (Style(sort_keys=True, ascii_only=True), '{"a":"\\u00e9","b":1}\n"x"\n'), (Style(indent=1), '{\n "b": 1,\n "a": "é"\n}\n"x"\n'), (Style(seq=True), '\x1e{"b":1,"a":"é"}\n\x1e"x"\n')])
def test_sinks(spark, tmp_path, style, want):
    docs = spark.createDataFrame([("f", 0, '{"b":1,"a":"é"}'), ("f", 1, '"x"')], "file string, place long, doc string")
    from millrace.api import interpret

    write_text(interpret(docs, "."), str(tmp_path / "out"), style)
    text = "".join(p.read_text().rstrip("\n") if style.join else p.read_text() for p in sorted((tmp_path / "out").glob("part-*")))
    assert text == want


def test_partitions_keep_order(spark, tmp_path):
    (tmp_path / "in").write_text("".join(f'{{"i":{i}}}\n' for i in range(5000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        docs = read_json(spark, str(tmp_path / "in"), "lines")
        assert docs.rdd.getNumPartitions() > 1
        assert slurp(docs, "map(.i) == [range(5000)]").first()["value"] == "true"
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_stream(spark, tmp_path):
    from millrace.streaming.live import query_stream, stream_lines

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a").write_text('{"a":1}\n\n{"a":2}\n')
    out = query_stream(stream_lines(spark, str(tmp_path / "in")), ".a + 1")
    run = out.writeStream.format("memory").queryName("live").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    run.awaitTermination(60)
    assert sorted(r["value"] for r in spark.table("live").collect()) == ["2", "3"]


def test_rows_as_json_keeps_nulls(spark):
    df = spark.createDataFrame([(None, 1.0)], "a string, b double")
    assert from_json(rows_as_json(df).first()["doc"]) == {"a": None, "b": 1.0}


WHOLE = [
    "map(.v) | min", "map(.v) | max", "map(.v) | unique | length", "map(.v) | add", "length", "map(.k) | unique", "group_by(.k) | length", "group_by(.k) | map({k: .[0].k, n: length})",
    "group_by(.k) | map({k: .[0].k, lo: (map(.v) | min), hi: (map(.v) | max)})", "group_by(.k) | map({k: .[0].k, d: (map(.v) | unique | length), u: (map(.v) | unique), s: (map(.v) | sort)})", "group_by(.k) | map({k: .[0].k, sum: (map(.v) | add)})",
    "group_by(.k) | map({k: .[0].k, n: (map(select(.v == null)) | length), m: (map(select(.v > 1) | .v) | min)})", "min_by(.v) | .i", "group_by(.k) | map({k: .[0].k, a: (min_by(.v) | .i), b: (max_by(.v) | .i)})", "[.[] | select(.v < 2)] | map(.i)", "sort_by(.v, .i) | .[:3] | map(.i)", "any(.v > 4)", "all(.v != 7)",
    "group_by(.s) | map({s: .[0].s, n: length, t: (map(.s) | unique | length)})", "map(select(.k == 9) | .v) | min", "map(select(.v == null) | .v) | unique | length",
]


@pytest.mark.parametrize("program", WHOLE)
def test_whole_programs_on_nulls(program, spark):
    rows = [(1, 1, None, "a"), (2, 1, 2, None), (3, 2, None, "b"), (4, None, 5, None), (5, 3, 4, "b"), (6, 3, 1, "a"), (7, 3, 4, "")]
    df = spark.createDataFrame(rows, "i long, k long, v long, s string")
    from pyspark.sql import functions as F

    native = query_all(df, program, order=("i",), mode="native")
    if native.columns == ["value"]:
        got = [r["x"] for r in native.select(F.to_json(F.struct("value"), {"ignoreNullFields": "false"}).alias("x")).collect()]
        got = [to_json(from_json(x)["value"]) for x in got]
    else:
        got = [to_json(from_json(r["x"])) for r in native.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("x")).collect()]
    want = [from_json(r["value"]) for r in query_all(df, program, order=("i",), mode="interpreted").collect()]
    want = [to_json(x) for w in want for x in (w if isinstance(w, list) else [w])]
    assert sorted(got) == sorted(want)


def test_set_operations_and_products_against_the_interpreter(spark):
    a = spark.createDataFrame([(1, "x"), (2, None), (2, None), (3, "y")], "k long, s string")
    b = spark.createDataFrame([(2, None), (3, "z")], "k long, s string")
    for program in (". + $b | map(.k)", ". - $b | map(.k)", "$b - . | map(.s)", "[.[] as $x | $b[] as $y | select($x.k == $y.k) | {k: $x.k, s: $y.s}]", "[.[] as $x | $b[] as $y | select($x.k < $y.k) | $x.k + $y.k]"):
        native = query_all(a, program, tables={"b": b}, mode="native")
        got = [to_json(r.asDict() if len(native.columns) > 1 else r["value"] if "value" in native.columns else r[0]) for r in native.collect()]
        want = [to_json(x) for x in from_json(query_all(a, program, tables={"b": b}, mode="interpreted").collect()[0]["value"])]
        assert sorted(got) == sorted(want), program
    with pytest.raises(NotNative):
        query_all(a, "[.[] as $x | $b[] as $y | length]", tables={"b": b}, mode="native")
