"""``python -m millrace [options] PROGRAM [FILE...]``: files are read through Spark, standard input on the driver.

Options are those of the usual command-line JSON processors; see ``--help``.
"""

from __future__ import annotations

import argparse
import os
import sys
from collections.abc import Iterator
from typing import Any

from millrace.functions.builtins import Inputs
from millrace.functions.values import Problem, all_json, from_json
from millrace.lang.syntax import SyntaxProblem, parse
from millrace.operators.interpreter import compile_program
from millrace.sources.writers import Style

#: colours of null, false, true, numbers, strings, arrays, objects and keys
COLOURS = ["0;90", "0;39", "0;39", "0;39", "0;32", "1;39", "1;39", "34;1"]


def arguments(argv: list[str] | None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="millrace", add_help=True, allow_abbrev=False)
    for short, long, text in (
        ("-n", "--null-input", "run once, with null"), ("-s", "--slurp", "run once, with all documents as an array"), ("-R", "--raw-input", "lines are strings"),
        ("-c", "--compact-output", "no white space"), ("-r", "--raw-output", "strings without quotes"), ("-j", "--join-output", "raw, without line ends"), ("-a", "--ascii-output", "escape other characters"),
        ("-S", "--sort-keys", "keys in order"), ("-C", "--color-output", "colours"), ("-M", "--monochrome-output", "no colours"), ("-e", "--exit-status", "status by the last output"),
    ):
        p.add_argument(short, long, action="store_true", help=text)
    for long in ("--tab", "--seq", "--stream", "--stream-errors", "--jsonl", "--raw-output0", "--unbuffered"):
        p.add_argument(long, action="store_true")
    p.add_argument("--indent", type=int, default=2)
    p.add_argument("-f", "--from-file")
    p.add_argument("-L", dest="paths", action="append", default=[], help="folder of modules")
    for long in ("--arg", "--argjson", "--rawfile", "--slurpfile"):
        p.add_argument(long, nargs=2, action="append", default=[], metavar=("NAME", "VALUE"))
    p.add_argument("--args", dest="rest", nargs=argparse.REMAINDER)
    p.add_argument("--jsonargs", dest="json_rest", nargs=argparse.REMAINDER)
    p.add_argument("program", nargs="?")
    p.add_argument("files", nargs="*")
    return p.parse_args(argv)


def variables(a: argparse.Namespace) -> dict[str, Any]:
    text = lambda path: open(path, encoding="utf-8").read()
    named: dict[str, Any] = dict(a.arg)
    named |= {k: from_json(v) for k, v in a.argjson} | {k: text(v) for k, v in a.rawfile} | {k: all_json(text(v)) for k, v in a.slurpfile}
    positional = list(a.rest or []) + [from_json(x) for x in a.json_rest or []]
    return {**named, "ARGS": {"positional": positional, "named": named}, "__prog_args": positional}


def documents(a: argparse.Namespace, text: str) -> Iterator[Any]:
    if a.raw_input:
        if a.slurp:
            yield text
        else:
            yield from text.splitlines()
        return
    parts = text.split("\x1e") if a.seq else text.splitlines() if a.jsonl or a.stream_errors else [text]
    for part in parts:
        try:
            yield from all_json(part)
        except Problem as problem:
            if a.stream_errors:
                yield [str(problem), []]
            elif not a.seq:
                raise


def through_spark(a: argparse.Namespace, program: str, given: dict[str, Any]) -> Iterator[tuple[str | None, str | None]]:
    from pyspark.sql import SparkSession

    from millrace.api import interpret, run_documents, slurp
    from millrace.sources.readers import read_json

    spark = SparkSession.builder.config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    mode = ("raw-slurp" if a.slurp else "raw") if a.raw_input else "seq" if a.seq else "lines" if a.jsonl or a.stream_errors else "auto"
    docs = read_json(spark, a.files, mode)
    if a.null_input or (a.slurp and not a.raw_input):
        out = slurp(docs, program, given, inputs=a.null_input, paths=a.paths)
    else:
        plain = not (a.stream or a.stream_errors)
        out = run_documents(docs, program, given, a.paths) if plain else interpret(docs, program, given, a.paths, a.stream, a.stream_errors)
        out = out.orderBy("file", "place", "turn")
    for row in out.toLocalIterator():
        yield row["value"], row["error"]


def on_driver(a: argparse.Namespace, program: str, given: dict[str, Any], text: str) -> Iterator[tuple[str | None, str | None]]:
    from millrace.functions.values import to_json

    tree = parse(program)
    if a.stream:
        tree = ("pipe", ("call", "tostream", ()), tree)
    run, inputs = compile_program(tree, given, tuple(a.paths)), documents(a, text)
    Inputs.rest = inputs
    while True:
        try:
            given_ = [None] if a.null_input else [list(inputs)] if a.slurp and not a.raw_input else inputs
            for value in given_:
                for x in run(value):
                    yield to_json(x), None
            return
        except Problem as problem:
            yield None, str(problem)
            if given_ is not inputs:
                return


def coloured(text: str) -> str:
    import re

    def paint(m: re.Match) -> str:
        kind = 7 if m["key"] else 4 if m["string"] else 0 if m[0] == "null" else 2 if m[0] in ("true", "false") else 3
        return f"\x1b[{COLOURS[kind]}m{m[0]}\x1b[0m"

    return re.sub(r'(?P<key>"(?:[^"\\]|\\.)*"(?=:))|(?P<string>"(?:[^"\\]|\\.)*")|null|true|false|-?\d[\d.eE+-]*', paint, text)


def main(argv: list[str] | None = None, stdin: str | None = None, out=None) -> int:
    a, out = arguments(argv), out or sys.stdout
    program = a.program
    if a.from_file:
        a.files = ([program] if program else []) + a.files
        program = open(a.from_file, encoding="utf-8").read()
    try:
        given = variables(a)
    except (OSError, Problem) as problem:
        print(f"millrace: {problem}", file=sys.stderr)
        return 2
    try:
        compile_program(program or ".", given, tuple(a.paths))
    except (SyntaxProblem, Problem) as problem:
        print(f"millrace: {problem}", file=sys.stderr)
        return 3
    indent = None if a.compact_output else "\t" if a.tab else a.indent
    style = Style(indent, a.raw_output, a.join_output, a.raw_output0, a.ascii_output, a.sort_keys, a.seq)
    if missing := [f for f in a.files if "*" not in f and "://" not in f and not os.path.exists(f)]:
        print(f"millrace: no such file: {missing[0]}", file=sys.stderr)
        return 2
    source = through_spark(a, program or ".", given) if a.files else on_driver(a, program or ".", given, stdin if stdin is not None else "" if a.null_input and sys.stdin.isatty() else sys.stdin.read())
    status, last, some = 0, None, False
    try:
        for value, error in source:
            if error is not None:
                print(f"millrace: error: {error}", file=sys.stderr)
                status = 5
                continue
            last, some = value, True
            text = style.text(from_json(value))
            out.write((coloured(text) if a.color_output and not a.monochrome_output else text) + style.end)
    except Problem as problem:
        print(f"millrace: error: {problem}", file=sys.stderr)
        return 2
    if status or not a.exit_status:
        return status
    return 4 if not some else int(last in ("null", "false"))


if __name__ == "__main__":
    sys.exit(main())
