"""The interpreter over tables: rows are dealt over all cores, and built-ins in Python do what the language defines."""

import pytest
from pyspark.sql import functions as F

from millrace import queries as own
from millrace.api import evaluate, query
from millrace.operators import interpreter
from tests.conftest import DATA


@pytest.mark.parametrize("name", ["paths", "update_generator", "walk", "formats_more"])
def test_one_row_group_is_dealt_over_the_cores(name, spark):
    shares = own.queries()[name](spark, DATA).groupBy(F.spark_partition_id()).count().collect()
    assert len(shares) >= 8
    assert max(r["count"] for r in shares) * 4 < sum(r["count"] for r in shares)


def test_dealt_rows_keep_their_order(spark, tmp_path):
    spark.range(5_000).coalesce(1).write.parquet(str(tmp_path / "t"))
    got = query(spark.read.parquet(str(tmp_path / "t")), ".id", mode="interpreted").collect()
    assert [int(r["value"]) for r in got] == list(range(5_000))


def test_descent_reads_values_without_errors_on_them():
    assert evaluate("[paths]", {"a": "\ud800", "b": [1]}) == [[["a"], ["b"], ["b", 0]]]
    assert evaluate("[path(.. | strings)]", {"a": "\ud800", "b": [1, "x"]}) == [[["a"], ["b", 1]]]


def test_an_update_copies_a_container_once(monkeypatch):
    copies = []
    put = interpreter.put
    monkeypatch.setattr(interpreter, "put", lambda v, k, new: copies.append(k) or put(v, k, new))
    given = {"a": list(range(500)), "b": {"c": 1}}
    assert evaluate("(.. | numbers) |= . + 1", given) == [{"a": list(range(1, 501)), "b": {"c": 2}}]
    assert len(copies) == 3 and given["a"][0] == 0  # before, a copy for each number


def test_an_update_leaves_values_that_are_held_twice():
    (got,) = evaluate("(.a.b, .a, .a.o.b) |= {b: 1, o: ., p: .}", {"a": {"b": 0}})
    first = {"b": 1, "o": 0, "p": 0}
    assert got == {"a": {"b": 1, "o": {"b": {"b": 1, "o": first, "p": first}}, "p": {"b": first}}}


def test_walk_builds_each_container_once(monkeypatch):
    copies = []
    put = interpreter.put
    monkeypatch.setattr(interpreter, "put", lambda v, k, new: copies.append(k) or put(v, k, new))
    given = {"a": [1, {"b": 2}, "x"], "c": None}
    assert evaluate('walk(if type == "number" then . + 1 elif . == null then empty else . end)', given) == [{"a": [2, {"b": 3}, "x"]}]
    assert evaluate("[path(walk(.))]", "scalar") == [[[]]]
    assert not copies and given["c"] is None and given["a"][0] == 1
