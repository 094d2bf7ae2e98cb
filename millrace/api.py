"""Entry points: programs over tables and over JSON texts."""

from __future__ import annotations

import json
import os
from collections.abc import Iterable, Iterator
from functools import lru_cache
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.builtins import Inputs
from millrace.functions.values import Problem, from_json, to_json
from millrace.lang.syntax import parse
from millrace.operators.interpreter import compile_program
from millrace.plans import frames, texts
from millrace.plans.typed import NotNative
from millrace.sources.readers import rows_as_json

#: rows of another table that a program without relational form may take in
GATHERED_ROWS = 100_000
OUTPUT = "file string, place long, turn int, value string, error string"


def evaluate(program: str, value: Any, variables: dict[str, Any] | None = None, paths: Iterable[str] = ()) -> list[Any]:
    """All outputs for one Python value, on the driver."""
    return list(compile_program(program, variables, tuple(paths))(value))


def interpret(docs: DataFrame, program: str, variables: dict[str, Any] | None = None, paths: Iterable[str] = (), stream_events: bool = False, events_for_errors: bool = False) -> DataFrame:
    """(file, place, turn, value, error) of a program over documents (file, place, doc), in Arrow batches.

    value is compact JSON. Outputs before an error are kept; the error is a row of its own, with its
    message and no value. A document that can't be read is an error too, or with events_for_errors an
    input ["message", []] of the program. stream_events gives the program the events of tostream.
    """
    tree, variables, paths = parse(program), dict(variables or {}), tuple(paths)
    if stream_events:
        tree = ("pipe", ("call", "tostream", ()), tree)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = compile_program(tree, variables, paths)
        for batch in batches:
            out: list[tuple] = []
            for file, place, doc in zip(*(c.to_pylist() for c in batch.select(["file", "place", "doc"]).columns), strict=True):
                turn = 0
                try:
                    try:
                        given = from_json(doc)
                    except Problem as problem:
                        if not events_for_errors:
                            raise
                        given = [str(problem), []]
                    for x in f(given):
                        out.append((file, place, turn, to_json(x), None))
                        turn += 1
                except Problem as problem:
                    out.append((file, place, turn, None, str(problem)))
            columns = list(zip(*out, strict=True)) or [[]] * 5
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int32(), pa.string(), pa.string()), strict=True)], ["file", "place", "turn", "value", "error"])

    return docs.select("file", "place", "doc").mapInArrow(run, OUTPUT)


def run_documents(docs: DataFrame, program: str, variables: dict[str, Any] | None = None, paths: Iterable[str] = (), plan: str = "auto") -> DataFrame:
    """(file, place, turn, value, error) of a program over documents (file, place, doc); see interpret.

    plan auto evaluates what it can as Column expressions over the parsed document, and gives the interpreter
    only the documents whose outputs that leaves in doubt. native has an error row for each of those instead,
    and is an error if the program has no such form; interpreted gives all to the interpreter.
    """
    tree = parse(program)
    if plan != "interpreted":
        try:
            done = texts.compiled(docs, tree, variables)
        except NotNative:
            if plan == "native":
                raise
        else:
            left = texts.others(done)
            if plan == "native":
                doubtful = left.select("file", "place", F.lit(0).alias("turn"), F.lit(None).cast("string").alias("value"), F.lit("this document needs the interpreter").alias("error"))
            else:
                doubtful = interpret(left, program, variables, paths)
            return texts.native_outputs(done).unionByName(doubtful)
    return interpret(docs, program, variables, paths)


def query(df: DataFrame, program: str, variables: dict[str, Any] | None = None, mode: str = "auto", paths: Iterable[str] = ()) -> DataFrame:
    """A program that runs once for every row of a table.

    Objects become columns, other outputs one column ``value``. mode: native (an error if a part has no
    relational form), interpreted (value is JSON text), or auto (native where possible).
    """
    tree = parse(program)
    if mode != "interpreted" and tree[0] != "program":
        try:
            return frames.per_row(df, tree, variables)
        except NotNative:
            if mode == "native":
                raise
    return interpret(rows_as_json(df, deal=True), program, variables, paths).where("error is null").select("value")


def query_all(df: DataFrame, program: str, variables: dict[str, Any] | None = None, tables: dict[str, DataFrame] | None = None, order: Iterable[str] = (), mode: str = "auto") -> DataFrame:
    """A program whose input is the array of all rows (as with ``--slurp``).

    tables are other tables, named $t in the program; order names columns that give the rows' order.
    Without a relational form the rows are gathered in order into one task, which suits small tables only;
    the other tables are then gathered too, and more than GATHERED_ROWS rows of one are an error.
    """
    tree = parse(program)
    if mode != "interpreted":
        try:
            return frames.whole(df, tree, variables, tables, tuple(order))
        except NotNative:
            if mode == "native":
                raise
    known = dict(variables or {})
    for name, table in (tables or {}).items():
        found = rows_as_json(table).orderBy("place").limit(GATHERED_ROWS + 1).collect()
        if len(found) > GATHERED_ROWS:
            raise ValueError(f"${name} has more than {GATHERED_ROWS} rows, and this program has no relational form")
        known[name] = [json.loads(r["doc"]) for r in found]
    sorted_ = df.orderBy(*order) if order else df
    return slurp(rows_as_json(sorted_), program, known).where("error is null").select("value")


def slurp(docs: DataFrame, program: str, variables: dict[str, Any] | None = None, inputs: bool = False, paths: Iterable[str] = ()) -> DataFrame:
    """One run over the array of all documents, or, with inputs, over null with the documents behind input and inputs. All documents go to one task."""
    variables, paths = dict(variables or {}), tuple(paths)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = compile_program(program, variables, paths)
        values = (from_json(x) for b in batches for x in b.column(0).to_pylist())
        out = []
        try:
            if inputs:
                Inputs.rest = values
                results = f(None)
            else:
                results = f(list(values))
            for x in results:
                out.append((to_json(x), None))
        except Problem as problem:
            out.append((None, str(problem)))
        yield pa.record_batch([pa.array([""] * len(out), pa.string()), pa.array([0] * len(out), pa.int64()), pa.array(range(len(out)), pa.int32()), pa.array([x for x, _ in out], pa.string()), pa.array([x for _, x in out], pa.string())], ["file", "place", "turn", "value", "error"])

    return docs.orderBy("file", "place").select("doc").coalesce(1).mapInArrow(run, OUTPUT)


def query_json(spark: SparkSession, path, program: str, mode: str = "auto", slurped: bool = False, null_input: bool = False, variables: dict[str, Any] | None = None, paths: Iterable[str] = (), stream_events: bool = False, plan: str = "auto") -> DataFrame:
    """A program over JSON files; see interpret for the result, run_documents for plan. mode is that of read_json."""
    from millrace.sources.readers import read_json

    docs = read_json(spark, path, mode)
    if slurped or null_input:
        return slurp(docs, program, variables, inputs=null_input and not slurped, paths=paths)
    if stream_events:
        return interpret(docs, program, variables, paths, stream_events)
    return run_documents(docs, program, variables, paths, plan)


def named_arguments(named: dict[str, Any], positional: Iterable[Any] = ()) -> dict[str, Any]:
    """Variables with $ARGS and $ENV beside them."""
    return {**named, "ARGS": {"positional": list(positional), "named": named}, "ENV": dict(os.environ)}


def exit_status(outputs: DataFrame) -> int:
    """0 if the last output is neither null nor false, 1 if it is, 4 without output, 5 after an error."""
    if not outputs.where("error is not null").isEmpty():
        return 5
    last = outputs.orderBy(F.desc("file"), F.desc("place"), F.desc("turn")).select("value").head(1)
    return 4 if not last else int(last[0]["value"] in ("null", "false"))


@lru_cache(maxsize=256)
def _compiled(program: str):
    return compile_program(program)


def register(spark: SparkSession, name: str = "jsonq") -> None:
    """A SQL function name(doc, program) with the array of outputs, for use in SQL; null for a null document, and after an error the outputs before it.

    Programs are compiled once in a worker, not once for every row.
    """

    @F.pandas_udf("array<string>")
    def outputs(docs: pd.Series, programs: pd.Series) -> pd.Series:
        def one(doc: str | None, program: str) -> list[str] | None:
            if doc is None or program is None:
                return None
            out: list[str] = []
            try:
                for x in _compiled(program)(from_json(doc)):
                    out.append(to_json(x))
            except Problem:
                pass
            return out

        return pd.Series([one(d, p) for d, p in zip(docs, programs, strict=True)], dtype=object)

    spark.udf.register(name, outputs)
