"""The native plan for JSON texts against the interpreter, document by document."""

import pytest
from pyspark.sql import functions as F

from millrace.api import interpret, query_json, run_documents
from millrace.plans.typed import NotNative

DOCS = [
    '{"type":"push","id":"7","public":true,"actor":{"login":"ann","n":3},"tags":["x","y"],"items":[{"k":1,"s":"one"},{"k":2}],"v":1.5}',
    ' { "type" : "pull" , "id" : "8", "z":1, "a":2, "actor": {"n":-4, "login":"bob"}, "tags":[], "items":[], "v":-2 } ',
    '{"type":null,"actor":null,"items":null,"tags":null}', "{}", "[1,2,{\"type\":\"push\"}]", '"push"', "3", "null", "true", "12345678901234567890", "1.50", "-0", "1e3",
    '{"type":"push","type":"pull"}', '{"type":"p\\u00e9","v":0.00001}', '{"type":"tab\\tq\\"b\\\\","v":100000000000000000000}', '{"broken":', '{"type":"push"} {"type":"pull"}', "", '{"type":7,"v":"1"}', '{"type":[1],"v":[1.0]}',
    '{"type":"é😀","v":0.1,"items":[{"k":"x"},3],"actor":"ann"}', '{"type":"push","v":-0,"items":[{"k":1.0}],"tags":[1,"a",null,[2]]}', '{"type":"push","v":123456.789,"items":[{"k":{"b":1,"a":2}}],"tags":{"b":1,"a":[]}}', '{"type":"push","v":NaN}', "{'type':'push'}", '{"v":00}', '{"v":3.0}',
    '{"type":"push","items":[{"k":1},{"k":2,"s":null}],"v":9007199254740993}',
]
PROGRAMS = [
    ".", ".type", ".actor.login", ".actor.n", ".v", ".tags", ".tags[0]", ".items[1].k", '."type"', ".actor", "[.type, .v]", "{type, login: .actor.login, v}", "[.tags]",
    'select(.type == "push")', 'select(.type == "push") | .actor.login', 'select(.type != "push") | {type}', 'select(.type == "push" and .v > 1) | [.id, .v]', 'select(.v < 2 or (.public | not)) | .type', 'select(.v >= -2) | .v',
    'select(.type | test("^pu")) | .type', 'select(.type | startswith("pu"))', 'select(.type | endswith("h")) | .id', 'select(.type | contains("us")) | .type', "select(.actor.login)", "select(.missing == null) | .type", "select(.type == null)",
    "length", ".type | length", ".tags | length", "keys", ".actor | keys", "type", ".v | type", 'has("type")', '.actor | has("login")',
    ".items[] | .k", ".items[]", "[.items[] | .k]", ".items | map(.k)", ".items | map({k, s})", ".items[] | select(.k > 1) | .k", ".tags[] | length", ".type, .v", "[.[]]", ".[0]", ".[2].type",
    ".v + 1", ".v * 2 - 1", '.type + "!"', ".v // 0", 'if .v then .type else "none" end', ".actor.n as $n | .items[] | [.k, $n]", "(.v == 1.5), (.type | ascii_upcase)", "empty", ".v | tostring", ".tags | tojson", "not", "$name", 'select(.type == $name) | .v', "{}", "[]", "1", '"a\\nb"',
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([("f", i, d) for i, d in enumerate(DOCS)], "file string, place long, doc string").coalesce(1).cache()


def gathered(df):
    return sorted((r["place"], r["turn"], r["value"] or "", r["error"] or "") for r in df.collect())


@pytest.mark.parametrize("program", PROGRAMS)
def test_same_as_the_interpreter(program, docs):
    given = {"name": "push"}
    assert gathered(run_documents(docs, program, given)) == gathered(interpret(docs, program, given))


@pytest.mark.parametrize("program", [".actor.login", 'select(.type == "push" and .v > 1) | .id', "{type, login: .actor.login}", "length", "keys", ".items | map(.k)", "."])
def test_most_documents_stay_out_of_the_interpreter(program, spark, capsys):
    plain = ['{"type":"push","id":"1","actor":{"login":"ann"},"items":[{"k":1}],"v":2}', '{"type":"pull","v":1.25,"items":[]}'] * 5
    df = spark.createDataFrame([("f", i, d) for i, d in enumerate(plain)], "file string, place long, doc string")
    native = run_documents(df, program, plan="native")
    assert native.where("error is not null").count() == 0
    assert gathered(native) == gathered(interpret(df, program))
    native.explain()
    assert "MapInArrow" not in capsys.readouterr().out


def test_what_has_no_native_form(docs):
    for program in ("..", "paths", "limit(1; .[])", ".[.id]", "to_entries"):
        with pytest.raises(NotNative):
            run_documents(docs, program, plan="native")


def test_files_and_places(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"v":2}\n{"v":"x"}\n\n{"v":1e2}\n')
    (tmp_path / "b.json").write_text('{"v":3}\n{"v":4}')
    got = query_json(spark, str(tmp_path), ".v", "lines").orderBy("file", "place", "turn")
    assert [r["value"] for r in got.collect()] == ["2", '"x"', "100", "3", "4"]


def test_many_documents_in_one_file_keep_their_order(spark, tmp_path):
    n = 1_100_000
    (tmp_path / "many.json").write_text("\n\n".join(map(str, range(n))) + "\n")
    got = query_json(spark, f"{tmp_path}/many.json", ".", "documents", plan="interpreted")
    wrong = got.where(F.col("place").cast("string") != F.col("value")).count()
    assert wrong == 0 and got.count() == n and got.agg(F.countDistinct("place")).first()[0] == n


def test_function_in_sql(spark):
    from millrace.api import register

    register(spark, "outputs_of")
    rows = spark.sql("""SELECT outputs_of(doc, '.a[]') AS o FROM VALUES ('{"a":[1,"x"]}'), ('{"a":1}'), ('broken'), (null) AS t(doc)""").collect()
    assert [r["o"] for r in rows] == [["1", '"x"'], [], [], None]
