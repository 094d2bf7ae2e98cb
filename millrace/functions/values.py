"""JSON values in Python: order, equality, arithmetic and text.

None, bool, int (64-bit, else float), float, str, list, dict (in insertion order).
"""

from __future__ import annotations

import json
import math
import re
from functools import cmp_to_key
from typing import Any

INT_MIN, INT_MAX = -(1 << 63), (1 << 63) - 1


class Problem(Exception):
    """An error of the language; it carries any value."""

    def __init__(self, value: Any):
        super().__init__(value)
        self.value = value

    def __str__(self) -> str:
        return self.value if isinstance(self.value, str) else to_json(self.value) + " (not a string)"


KINDS = {type(None): "null", bool: "boolean", int: "number", float: "number", str: "string", list: "array", dict: "object"}


def kind(v: Any) -> str:
    found = KINDS.get(type(v))
    if found:
        return found
    if v is None:
        return "null"
    if isinstance(v, bool):
        return "boolean"
    if isinstance(v, (int, float)):
        return "number"
    return {str: "string", list: "array", dict: "object"}[type(v)]


def truthy(v: Any) -> bool:
    return v is not None and v is not False


def told(v: Any) -> str:
    """A value in an error message: its type, and its text if that is short."""
    text = to_json(v)
    return f"{kind(v)} ({text if len(text.encode()) <= 11 else text[:11] + '...'})"


def short(v: Any) -> str:
    text = to_json(v)
    return text if len(text) <= 30 else text[:27] + "..."


def fit(n: int | float) -> int | float:
    """Integers beyond 64 bits become floats."""
    return n if isinstance(n, float) or INT_MIN <= n <= INT_MAX else float(n)


def whole(x: float) -> int | float:
    return int(x) if math.isfinite(x) and x == int(x) and INT_MIN <= x <= INT_MAX else x


RANKS = {"null": 0, "number": 3, "string": 4, "array": 5, "object": 6}
PLAIN = frozenset((int, str))


def rank(v: Any) -> int:
    return 2 if v is True else 1 if v is False else RANKS[kind(v)]


def compare(a: Any, b: Any) -> int:
    """null < false < true < numbers < strings < arrays < objects; NaN is below every number."""
    if type(a) is type(b) and type(a) in PLAIN:  # code points order as UTF-8 does
        return -1 if a < b else int(a > b)
    x, y = rank(a), rank(b)
    if x != y:
        return -1 if x < y else 1
    if x == 3:
        if a != a:
            return -1
        return -1 if a < b else int(a > b)
    if x == 4:
        a, b = a.encode("utf-8", "surrogatepass"), b.encode("utf-8", "surrogatepass")
        return -1 if a < b else int(a > b)
    if x == 5:
        for i, j in zip(a, b, strict=False):
            if c := compare(i, j):
                return c
        return (len(a) > len(b)) - (len(a) < len(b))
    if x == 6:
        if c := compare(sorted_keys(a), sorted_keys(b)):
            return c
        for k in sorted_keys(a):
            if c := compare(a[k], b[k]):
                return c
    return 0


order = cmp_to_key(compare)


def sorted_keys(d: dict) -> list[str]:
    return sorted(d, key=lambda k: k.encode("utf-8", "surrogatepass"))


def equal(a: Any, b: Any) -> bool:
    return compare(a, b) == 0 if a == a else False


def add(a: Any, b: Any) -> Any:
    if a is None:
        return b
    if b is None:
        return a
    x, y = kind(a), kind(b)
    if x == y:
        if x == "number":
            return fit(a + b)
        if x in ("string", "array"):
            return a + b
        if x == "object":
            return {**a, **b}
    raise Problem(f"{told(a)} and {told(b)} cannot be added")


def subtract(a: Any, b: Any) -> Any:
    x, y = kind(a), kind(b)
    if x == y == "number":
        return fit(a - b)
    if x == y == "array":
        return [i for i in a if not any(equal(i, j) for j in b)]
    raise Problem(f"{told(a)} and {told(b)} cannot be subtracted")


def merge(a: dict, b: dict) -> dict:
    out = dict(a)
    for k, v in b.items():
        out[k] = merge(out[k], v) if isinstance(out.get(k), dict) and isinstance(v, dict) else v
    return out


def multiply(a: Any, b: Any) -> Any:
    x, y = kind(a), kind(b)
    if x == y == "number":
        return fit(a * b)
    if {x, y} == {"string", "number"}:
        s, n = (a, b) if x == "string" else (b, a)
        if not n >= 0:
            return None
        if len(s) * n > 100_000_000:
            raise Problem("Repeat string result too long")
        return s * int(n)
    if x == y == "object":
        return merge(a, b)
    raise Problem(f"{told(a)} and {told(b)} cannot be multiplied")


def divide(a: Any, b: Any) -> Any:
    x, y = kind(a), kind(b)
    if x == y == "number":
        if b == 0:
            raise Problem(f"{told(a)} and {told(b)} cannot be divided because the divisor is zero")
        if isinstance(a, int) and isinstance(b, int) and a % b == 0:
            return fit(a // b)
        return a / b
    if x == y == "string":
        return split(a, b)
    raise Problem(f"{told(a)} and {told(b)} cannot be divided")


def truncated(x: int | float) -> int:
    if x != x:
        return 0
    return max(INT_MIN, min(INT_MAX, int(x))) if math.isfinite(x) else (INT_MAX if x > 0 else INT_MIN)


def modulo(a: Any, b: Any) -> Any:
    if kind(a) == kind(b) == "number":
        if a != a or b != b:
            return math.nan
        x, y = truncated(a), truncated(b)
        if y == 0:
            raise Problem(f"{told(a)} and {told(b)} cannot be divided because the divisor is zero")
        return abs(x) % abs(y) * (-1 if x < 0 else 1)
    raise Problem(f"{told(a)} and {told(b)} cannot be divided")


BINARY = {
    "+": add, "-": subtract, "*": multiply, "/": divide, "%": modulo,
    "==": equal, "!=": lambda a, b: not equal(a, b),
    "<": lambda a, b: compare(a, b) < 0, "<=": lambda a, b: compare(a, b) <= 0,
    ">": lambda a, b: compare(a, b) > 0, ">=": lambda a, b: compare(a, b) >= 0,
}


def split(s: str, sep: str) -> list[str]:
    if not s:
        return []
    return s.split(sep) if sep else list(s)


def number_text(x: int | float) -> str:
    """Shortest digits, without an exponent up to 15 zeros after them; NaN as null, infinities as the largest numbers."""
    if isinstance(x, int):
        return str(x)
    if x != x:
        return "null"
    if math.isinf(x):
        return "1.7976931348623157e+308" if x > 0 else "-1.7976931348623157e+308"
    mantissa, _, power = repr(abs(x)).partition("e")
    before, _, after = mantissa.partition(".")
    digits = (before + after.rstrip("0")).lstrip("0") or "0"
    point = len(before) + int(power or 0) if before.strip("0") else int(power or 0) - (len(after) - len(after.lstrip("0")))
    digits = digits.rstrip("0") or "0"
    sign = "-" if math.copysign(1, x) < 0 else ""
    if digits == "0":
        return sign + "0"
    if point > len(digits) + 15 or point <= -5 + 1:
        exponent = point - 1
        return f"{sign}{digits[0]}{'.' if len(digits) > 1 else ''}{digits[1:]}e{'-' if exponent < 0 else '+'}{abs(exponent):02d}"
    if point <= 0:
        return f"{sign}0.{'0' * -point}{digits}"
    if point >= len(digits):
        return sign + digits + "0" * (point - len(digits))
    return f"{sign}{digits[:point]}.{digits[point:]}"


ESCAPES = {'"': '\\"', "\\": "\\\\", "\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f"} | {chr(i): f"\\u{i:04x}" for i in (*range(8), 11, *range(14, 32), 127)}
ESCAPED = str.maketrans(ESCAPES)


TO_ESCAPE = re.compile('["\\\\\x00-\x1f\x7f]')


def string_text(s: str, ascii_only: bool = False) -> str:
    out = s.translate(ESCAPED) if TO_ESCAPE.search(s) else s
    if ascii_only:
        out = "".join(c if ord(c) < 128 else json.dumps(c)[1:-1] for c in out)
    return f'"{out}"'


def to_json(v: Any, indent: int | str | None = None, sort_keys: bool = False, ascii_only: bool = False, level: int = 0) -> str:
    """Compact text, or with line breaks if indent is given (blanks, or the text of one step)."""
    if v is None:
        return "null"
    if v is True or v is False:
        return "true" if v else "false"
    if isinstance(v, (int, float)):
        return number_text(v)
    if isinstance(v, str):
        return string_text(v, ascii_only)
    if indent in (None, 0) and not sort_keys and not ascii_only:
        if isinstance(v, list):
            return "[" + ",".join([to_json(x) for x in v]) + "]"
        return "{" + ",".join([string_text(k) + ":" + to_json(x) for k, x in v.items()]) + "}"
    step = None if indent in (None, 0) else indent if isinstance(indent, str) else " " * indent
    inner = lambda x: to_json(x, indent, sort_keys, ascii_only, level + 1)
    if isinstance(v, list):
        parts, ends = [inner(x) for x in v], "[]"
    else:
        keys, colon = (sorted_keys(v) if sort_keys else v), ":" if step is None else ": "
        parts, ends = [string_text(k, ascii_only) + colon + inner(v[k]) for k in keys], "{}"
    if step is None or not parts:
        return ends[0] + ",".join(parts) + ends[1]
    pad = "\n" + step * (level + 1)
    return ends[0] + pad + ("," + pad).join(parts) + "\n" + step * level + ends[1]


CONSTANTS = {"nan": math.nan, "NaN": math.nan, "Infinity": math.inf, "-Infinity": -math.inf}
DECODER = json.JSONDecoder(parse_int=lambda s: int(s) if len(s) < 19 else fit(int(s)) if len(s) < 4000 else float(s), parse_constant=lambda s: CONSTANTS[s], strict=False)


def from_json(text: str) -> Any:
    text = text.removeprefix("\ufeff")
    try:
        return DECODER.decode(text)
    except ValueError as problem:
        if "-NaN" in text:
            return from_json(text.replace("-NaN", "NaN"))
        if (word := text.strip()) in ("nan", "-nan", "infinity", "-infinity", "inf", "-inf"):
            return float(word.replace("-nan", "nan"))
        raise Problem(f"{problem} (while parsing '{text[:40]}')") from None


def all_json(text: str) -> list[Any]:
    """Documents that follow each other, with or without white space between."""
    out, at = [], 0
    while True:
        while at < len(text) and text[at] in " \t\r\n﻿":
            at += 1
        if at >= len(text):
            return out
        try:
            value, at = DECODER.raw_decode(text, at)
        except ValueError as problem:
            raise Problem(str(problem)) from None
        out.append(value)
