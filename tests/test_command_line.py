"""The command line on standard input and on files."""

import io

import pytest

from millrace.__main__ import main


def run(*argv, stdin=""):
    out = io.StringIO()
    return main(list(argv), stdin, out), out.getvalue()


@pytest.mark.parametrize(
    "argv,stdin,want",
    [
        (["-c", ".a"], '{"a":[1]} {"a":2}', (0, "[1]\n2\n")),
        ([".", "--indent", "1"], '{"a":1}', (0, '{\n "a": 1\n}\n')),
        (["--tab", "."], "[1]", (0, "[\n\t1\n]\n")),
        (["-r", "."], '"x"', (0, "x\n")),
        (["-j", "."], '"x" 1', (0, "x1")),
        (["-S", "-c", "."], '{"b":1,"a":2}', (0, '{"a":2,"b":1}\n')),
        (["-a", "."], '"é😀"', (0, '"\\u00e9\\ud83d\\ude00"\n')),
        (["-s", "-c", "add"], "1 2", (0, "3\n")),
        (["-n", "-c", "[inputs]"], "1 2", (0, "[1,2]\n")),
        (["-R", "length"], "ab\nc\n", (0, "2\n1\n")),
        (["-R", "-s", "length"], "ab\nc\n", (0, "5\n")),
        (["-n", "--arg", "x", "1", "--argjson", "y", "2", "-c", "[$x, $y, $ARGS.named.x]"], "", (0, '["1",2,"1"]\n')),
        (["-n", "-c", "$ARGS.positional", "--args", "a", "b"], "", (0, '["a","b"]\n')),
        (["-n", "-c", "$ARGS.positional", "--jsonargs", "1", "{}"], "", (0, "[1,{}]\n")),
        (["--seq", "-c", "."], "\x1e[1]\x1ebad\x1e2", (0, "\x1e[1]\n\x1e2\n")),
        (["--stream", "-c", "."], '{"a":1}', (0, '[["a"],1]\n[["a"]]\n')),
        (["--stream-errors", "-c", "length"], "1\nx\n", (0, "1\n2\n")),
        (["--raw-output0", "."], '"a" "b"', (0, "a\0b\0")),
        (["-e", "."], "null", (1, "null\n")),
        (["-e", "empty"], "1", (4, "")),
        ([".a"], "1 {}", (5, "null\n")),
        ([".["], "1", (3, "")),
        (["-n", "--argjson", "x", "{", "."], "", (2, "")),
        (["-C", "-c", "."], '{"a":1}', (0, '{\x1b[34;1m"a"\x1b[0m:\x1b[0;39m1\x1b[0m}\n')),
    ],
)
def test_standard_input(argv, stdin, want):
    assert run(*argv, stdin=stdin) == want


def test_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"a":1}\n{"a":2}\n')
    (tmp_path / "b.json").write_text('{"a":3}\n{"a":4}\n')
    assert run("-c", ".a", f"{tmp_path}/*.json") == (0, "1\n2\n3\n4\n")
    assert run("-s", "-c", "map(.a)", str(tmp_path / "a.json"), str(tmp_path / "b.json")) == (0, "[1,2,3,4]\n")
    assert run(".", str(tmp_path / "none")) == (2, "")
    (tmp_path / "p").write_text("def f: .a * 2; f")
    assert run("-f", str(tmp_path / "p"), str(tmp_path / "b.json")) == (0, "6\n8\n")
