"""Built-in functions: Python where values are computed, the language itself where programs are composed."""

from __future__ import annotations

import base64
import calendar
import math
import os
import re
import sys
import time
from collections.abc import Callable, Iterator
from datetime import datetime, timedelta, timezone
from functools import lru_cache
from typing import Any

import regex

from millrace.functions.values import Problem, add, compare, equal, fit, from_json, kind, order, short, sorted_keys, split, to_json, told, truncated, truthy, whole
from millrace.lang.syntax import parse_library

BUILTINS: dict[tuple[str, int], Callable] = {}
PATH_BUILTINS: dict[tuple[str, int], Callable] = {}
FORMATS: dict[str, Callable[[Any], str]] = {}


def value(*names: str):
    """Registers f(input, *arguments); arguments that are generators give all combinations, the last one outermost."""

    def register(f: Callable) -> Callable:
        size = f.__code__.co_argcount - 1

        def maker(compiler, *args):
            runs = [compiler.run(a) for a in args]
            if size == 0:

                def none(env, v):
                    yield f(v)

                return none
            if size == 1:
                only = runs[0]

                def one(env, v):
                    for x in only(env, v):
                        yield f(v, x)

                return one

            def call(env, v):
                def deal(i, got):
                    if i < 0:
                        yield f(v, *got)
                    else:
                        for x in runs[i](env, v):
                            yield from deal(i - 1, [x, *got])

                return deal(size - 1, [])

            return call

        for name in names:
            BUILTINS[name, size] = maker
        return f

    return register


def maker(table: dict, *keys: tuple[str, int]):
    def register(f: Callable) -> Callable:
        for key in keys:
            table[key] = f
        return f

    return register


def need(v: Any, wanted: str, name: str) -> Any:
    if kind(v) != wanted:
        raise Problem(f"{told(v)} {'number required' if wanted == 'number' else f'cannot be used by {name}: {wanted} required'}")
    return v


# types and containers
@value("length")
def _length(v):
    if v is None:
        return 0
    if isinstance(v, bool):
        raise Problem(f"{told(v)} has no length")
    return fit(abs(v)) if isinstance(v, (int, float)) else len(v)


value("type")(kind)
value("not")(lambda v: not truthy(v))
@value("utf8bytelength")
def _utf8bytelength(v):
    if not isinstance(v, str):
        raise Problem(f"{told(v)} only strings have UTF-8 byte length")
    return len(v.encode())



value("infinite", "inf")(lambda v: math.inf)
value("nan")(lambda v: math.nan)
value("now")(lambda v: time.time())
value("have_literal_numbers")(lambda v: True)
value("have_decnum")(lambda v: False)
value("input_line_number")(lambda v: 0)
value("input_filename")(lambda v: None)
value("get_search_list")(lambda v: [])
value("env")(lambda v: dict(os.environ))
value("toarray")(lambda v: v if isinstance(v, list) else [v])
value("tojson")(lambda v: to_json(v))


@value("keys")
def _keys(v):
    if isinstance(v, dict):
        return sorted_keys(v)
    if isinstance(v, list):
        return list(range(len(v)))
    raise Problem(f"{told(v)} has no keys")


@value("keys_unsorted")
def _keys_unsorted(v):
    return list(v) if isinstance(v, dict) else _keys(v)


@value("has")
def _has(v, k):
    if isinstance(v, dict) and isinstance(k, str):
        return k in v
    if isinstance(v, list) and kind(k) == "number":
        return 0 <= k < len(v)
    raise Problem(f"Cannot check whether {kind(v)} has a {kind(k)} key")


@value("contains")
def _contains(a, b):
    if isinstance(a, dict) and isinstance(b, dict):
        return all(k in a and _contains(a[k], x) for k, x in b.items())
    if isinstance(a, list) and isinstance(b, list):
        return all(any(kind(x) == kind(y) and _contains(x, y) for x in a) for y in b)
    if isinstance(a, str) and isinstance(b, str):
        return b in a
    if kind(a) == kind(b):
        return equal(a, b)
    raise Problem(f"{told(a)} and {told(b)} cannot have their containment checked")


@value("to_entries")
def _to_entries(v):
    if not isinstance(v, dict):
        raise Problem(f"{told(v)} has no keys")
    return [{"key": k, "value": x} for k, x in v.items()]


@value("from_entries")
def _from_entries(v):
    out = {}
    for e in v if isinstance(v, list) else ():
        if not isinstance(e, dict):
            raise Problem(f"Cannot index {kind(e)} with \"key\"")
        key = next((e[n] for n in ("key", "k", "name", "Name", "Key", "K") if n in e and truthy(e[n])), next((e[n] for n in ("key", "k", "name", "Name", "Key", "K") if n in e and e[n] is not None), None))
        if kind(key) in ("boolean", "number"):
            key = to_json(key)
        if key is None:
            key = "null"
        if not isinstance(key, str):
            raise Problem(f"Cannot use {told(key)} as object key")
        out[key] = next((e[n] for n in ("value", "v", "Value", "V") if n in e), None)
    return out


@value("add")
def _add(v):
    out = None
    for x in _items(v):
        out = add(out, x)
    return out


def _items(v):
    if isinstance(v, dict):
        return list(v.values())
    if isinstance(v, list):
        return v
    raise Problem(f"Cannot iterate over {told(v)}")


def _array(v, name):
    if not isinstance(v, list):
        raise Problem(f"{told(v)} cannot be {name}, as it is not an array")
    return v


value("sort")(lambda v: sorted(_array(v, "sorted"), key=order))


@value("unique")
def _unique(v):
    out = []
    for x in sorted(_array(v, "sorted"), key=order):
        if not out or compare(out[-1], x):
            out.append(x)
    return out


value("min")(lambda v: min(_array(v, "searched"), key=order, default=None))
value("max")(lambda v: _last_max(_array(v, "searched"), lambda x: x))


def _last_max(items, key):
    best = None
    for i, x in enumerate(items):
        if i == 0 or compare(key(x), key(best)) >= 0:
            best = x
    return best


@value("reverse")
def _reverse(v):
    if v is None:
        return []
    if isinstance(v, (str, list)):
        return v[::-1]
    raise Problem(f"Cannot reverse {told(v)}")


def _flat(v, depth):
    for x in v:
        if isinstance(x, list) and depth > 0:
            yield from _flat(x, depth - 1)
        else:
            yield x


@value("flatten")
def _flatten_to(v, depth):
    if need(depth, "number", "flatten") < 0:
        raise Problem("flatten depth must not be negative")
    return list(_flat(_items(v), depth))


value("flatten")(lambda v: list(_flat(_items(v), math.inf)))


@value("transpose")
def _transpose(v):
    width = max((len(r) for r in v), default=0)
    return [[r[i] if i < len(r) else None for r in v] for i in range(width)]


@value("bsearch")
def _bsearch(v, x):
    if not isinstance(v, list):
        raise Problem(f"{told(v)} cannot be searched from")
    low, high = 0, len(v)
    while low < high:
        mid = (low + high) // 2
        c = compare(v[mid], x)
        if c == 0:
            return mid
        low, high = (mid + 1, high) if c < 0 else (low, mid)
    return -1 - low


@value("indices", "_indices")
def _indices(v, x):
    if v is None:
        return None
    if isinstance(v, str) and isinstance(x, str):
        return [i for i in range(len(v)) if v.startswith(x, i)] if x else None
    if isinstance(v, list):
        if isinstance(x, list):
            return [i for i in range(len(v) - len(x) + 1) if all(equal(v[i + j], y) for j, y in enumerate(x))] if x else None
        return [i for i, y in enumerate(v) if equal(y, x)]
    raise Problem(f"Cannot determine indices in {kind(v)}")


@value("index")
def _index(v, x):
    return next(iter(_indices(v, x) or []), None)


@value("rindex")
def _rindex(v, x):
    return next(iter((_indices(v, x) or [])[::-1]), None)


# strings
@value("tostring")
def _tostring(v):
    return v if isinstance(v, str) else to_json(v)


@value("tonumber")
def _tonumber(v):
    if kind(v) == "number":
        return v
    if isinstance(v, str) and re.fullmatch(r"-?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?", v):
        return fit(int(v)) if re.fullmatch(r"-?\d+", v) else float(v)
    if isinstance(v, str) and v == "nan":
        return math.nan
    raise Problem(f"{told(v)} cannot be parsed as a number")


@value("toboolean")
def _toboolean(v):
    if isinstance(v, bool):
        return v
    if v in ("true", "false") and isinstance(v, str):
        return v == "true"
    raise Problem(f"{told(v)} cannot be parsed as a boolean")


@value("fromjson")
def _fromjson(v):
    return from_json(need(v, "string", "fromjson"))


LOWER = {i: i + 32 for i in range(65, 91)}
UPPER = {i: i - 32 for i in range(97, 123)}
value("ascii_downcase")(lambda v: need(v, "string", "ascii_downcase").translate(LOWER))
value("ascii_upcase")(lambda v: need(v, "string", "ascii_upcase").translate(UPPER))
value("explode")(lambda v: [ord(c) for c in need(v, "string", "explode")])
value("ascii")(lambda v: ord(v[0]) if isinstance(v, str) else chr(v))


@value("implode")
def _implode(v):
    if not isinstance(v, list) or any(kind(c) != "number" for c in v):
        raise Problem("Unicode codepoint must be numeric")
    return "".join(chr(c) if 0 <= c < 0x110000 and not 0xD800 <= c < 0xE000 else "�" for c in map(truncated, v))


value("ltrimstr")(lambda v, p: v.removeprefix(p) if isinstance(v, str) and isinstance(p, str) else v)
value("rtrimstr")(lambda v, p: v.removesuffix(p) if isinstance(v, str) and isinstance(p, str) else v)
value("trimstr")(lambda v, p: (v.removeprefix(p) if len(p) < 2 * len(v) else v).removesuffix(p) if isinstance(v, str) and isinstance(p, str) else v)


@value("startswith")
def _startswith(v, p):
    if not (isinstance(v, str) and isinstance(p, str)):
        raise Problem("startswith() requires string inputs")
    return v.startswith(p)


@value("endswith")
def _endswith(v, p):
    if not (isinstance(v, str) and isinstance(p, str)):
        raise Problem("endswith() requires string inputs")
    return v.endswith(p)


SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
for _name, _strip in (("trim", str.strip), ("ltrim", str.lstrip), ("rtrim", str.rstrip)):

    def _trim(v, _strip=_strip):
        if not isinstance(v, str):
            raise Problem("trim input must be a string")
        return _strip(v, SPACE)

    BUILTINS[_name, 0] = lambda compiler, f=_trim: lambda env, v: iter((f(v),))


@value("split")
def _split(v, sep):
    if not (isinstance(v, str) and isinstance(sep, str)):
        raise Problem("split input and separator must be strings")
    return split(v, sep)


@value("join")
def _join(v, sep):
    out = []
    for x in _items(v):
        if isinstance(x, (list, dict)):
            raise Problem(f"{told(sep)} and {told(x)} cannot be added")
        out.append("" if x is None else x if isinstance(x, str) else to_json(x))
    if out and not isinstance(sep, str) and len(out) > 1:
        raise Problem(f"{told(out[0])} and {told(sep)} cannot be added")
    return (sep or "").join(out) if isinstance(sep, str) or sep is None else "".join(out)


# numbers
def _number(name: str, f: Callable[[float], Any]):
    def call(v):
        if kind(v) != "number":
            raise Problem(f"{told(v)} number required")
        try:
            return f(v)
        except OverflowError:
            return math.inf
        except ValueError:
            return math.nan

    value(name)(call)


def _toward(f):
    return lambda x: x if isinstance(x, int) or not math.isfinite(x) else fit(f(x))


def _half_away(x):
    return math.floor(abs(x) + 0.5) * (-1 if x < 0 else 1)


def _log(f):
    return lambda x: -math.inf if x == 0 else math.nan if x < 0 else f(x)


def _frexp(x):
    m, e = math.frexp(x) if math.isfinite(x) else (x, 0)
    return [m, e]


for _name, _f in {
    "floor": _toward(math.floor), "ceil": _toward(math.ceil), "round": _toward(_half_away), "trunc": _toward(math.trunc), "truncate": _toward(math.trunc), "rint": _toward(round), "nearbyint": _toward(round),
    "fabs": lambda x: abs(float(x)), "sqrt": lambda x: math.sqrt(x), "cbrt": math.cbrt, "exp": math.exp, "exp2": lambda x: 2.0**x, "exp10": lambda x: 10.0**x, "expm1": math.expm1,
    "log": _log(math.log), "log_e": _log(math.log), "log2": _log(math.log2), "log10": _log(math.log10), "log1p": lambda x: math.log1p(x), "logb": lambda x: -math.inf if x == 0 else abs(x) if math.isinf(x) else float(math.frexp(x)[1] - 1),
    "sin": math.sin, "cos": math.cos, "tan": math.tan, "asin": math.asin, "acos": math.acos, "atan": math.atan, "sinh": math.sinh, "cosh": math.cosh, "tanh": math.tanh, "asinh": math.asinh, "acosh": math.acosh, "atanh": math.atanh,
    "significand": lambda x: x if x == 0 or not math.isfinite(x) else math.frexp(x)[0] * 2, "exponent": lambda x: math.frexp(x)[1], "gamma": math.lgamma, "lgamma": math.lgamma, "lgamma_r": math.lgamma, "tgamma": math.gamma, "frexp": _frexp,
    "modf": lambda x: [math.copysign(0.0, x), x] if math.isinf(x) else list(math.modf(x)), "isnan": lambda x: x != x, "isinfinite": lambda x: math.isinf(x), "isfinite": lambda x: not math.isinf(x), "isnormal": lambda x: math.isfinite(x) and abs(x) >= sys.float_info.min,
}.items():
    _number(_name, lambda x, f=_f: whole(r) if isinstance(r := f(x), float) else r)


def _bessel(n: int) -> Callable[[float], float]:
    """J_n by Simpson's rule on its integral; exact to rounding for moderate arguments."""

    def f(x):
        steps = 2 * (200 + 4 * int(abs(x)))
        h = math.pi / steps
        term = lambda t: math.cos(n * t - x * math.sin(t))
        return h / 3 / math.pi * sum((1 if i in (0, steps) else 4 if i % 2 else 2) * term(i * h) for i in range(steps + 1))

    return f


_number("j0", _bessel(0))
_number("j1", _bessel(1))


@value("abs")
def _abs(v):
    if kind(v) != "number":
        raise Problem(f"{told(v)} has no absolute value")
    return v if v >= 0 or v != v else fit(-v)


def _floats(name: str, size: int, f: Callable):
    def call(*args):
        for a in args:
            if kind(a) != "number":
                raise Problem(f"{told(a)} number required")
        try:
            out = f(*args)
        except OverflowError:
            out = math.inf
        except (ValueError, ZeroDivisionError):
            out = math.nan
        return whole(out) if isinstance(out, float) else out

    value(name)({2: lambda v, a, b: call(a, b), 3: lambda v, a, b, c: call(a, b, c), 1: lambda v, a: call(v, a)}[size])


def _pow(a, b):
    return float(a) ** b if not (a == 0 and b < 0) else math.inf


_floats("pow", 2, _pow)
_floats("atan2", 2, math.atan2)
_floats("fmin", 2, min)
_floats("fmax", 2, max)
_floats("fmod", 2, math.fmod)
_floats("hypot", 2, math.hypot)
_floats("copysign", 2, math.copysign)
_floats("remainder", 2, math.remainder)
_floats("drem", 2, math.remainder)
_floats("ldexp", 2, lambda a, b: math.ldexp(a, int(b)))
_floats("scalb", 1, lambda a, b: math.ldexp(a, int(b)))
_floats("scalb", 2, lambda a, b: math.ldexp(a, int(b)))
_floats("scalbln", 2, lambda a, b: math.ldexp(a, int(b)))
_floats("fma", 3, lambda a, b, c: float(a) * b + c)


# generators
@maker(BUILTINS, ("empty", 0))
def _empty(compiler):
    return lambda env, v: iter(())


PATH_BUILTINS["empty", 0] = _empty


@maker(BUILTINS, ("error", 0))
def _error0(compiler):
    def f(env, v):
        raise Problem(v)
        yield

    return f


@maker(BUILTINS, ("error", 1))
def _error1(compiler, message):
    m = compiler.run(message)

    def f(env, v):
        for x in m(env, v):
            raise Problem(x)
        yield from ()

    return f


@maker(PATH_BUILTINS, ("error", 0), ("error", 1))
def _error_paths(compiler, *args):
    f = (_error1 if args else _error0)(compiler, *args)
    return lambda env, pv: f(env, pv[1])


@maker(BUILTINS, ("halt", 0), ("halt_error", 0), ("halt_error", 1))
def _halt(compiler, *args):
    return lambda env, v: iter(())


def _counting(maker_mode: str):
    """limit, skip, first, last, nth over a generator, for values or for paths."""

    def values(env, v):
        return env, v[1] if maker_mode == "paths" else v

    def limit(compiler, n, g):
        count, source = compiler.run(n), getattr(compiler, maker_mode)(g)

        def f(env, v):
            for k in count(*values(env, v)):
                if need(k, "number", "limit") < 0:
                    raise Problem("limit doesn't support negative count")
                if k > 0:
                    for i, x in enumerate(source(env, v), 1):
                        yield x
                        if i >= k:
                            break

        return f

    def skip(compiler, n, g):
        count, source = compiler.run(n), getattr(compiler, maker_mode)(g)

        def f(env, v):
            for k in count(*values(env, v)):
                if need(k, "number", "skip") < 0:
                    raise Problem("skip doesn't support negative count")
                for i, x in enumerate(source(env, v)):
                    if i >= k:
                        yield x

        return f

    def nth(compiler, n, g):
        count, source = compiler.run(n), getattr(compiler, maker_mode)(g)

        def f(env, v):
            for k in count(*values(env, v)):
                if need(k, "number", "nth") < 0:
                    raise Problem("nth doesn't support negative indices")
                for i, x in enumerate(source(env, v)):
                    if i >= k:
                        yield x
                        break

        return f

    def first(compiler, g):
        source = getattr(compiler, maker_mode)(g)

        def f(env, v):
            for x in source(env, v):
                yield x
                break

        return f

    def last(compiler, g):
        source = getattr(compiler, maker_mode)(g)

        def f(env, v):
            some, x = False, None
            for x in source(env, v):
                some = True
            if some:
                yield x

        return f

    return {("limit", 2): limit, ("skip", 2): skip, ("nth", 2): nth, ("first", 1): first, ("last", 1): last}


BUILTINS.update(_counting("run"))
PATH_BUILTINS.update(_counting("paths"))


@maker(BUILTINS, ("range", 1), ("range", 2), ("range", 3))
def _range(compiler, *args):
    runs = [compiler.run(a) for a in args]

    def f(env, v):
        if len(runs) == 1:
            bounds = ((0, b, 1) for b in runs[0](env, v))
        elif len(runs) == 2:
            bounds = ((a, b, 1) for a in runs[0](env, v) for b in runs[1](env, v))
        else:
            bounds = ((a, b, c) for a in runs[0](env, v) for b in runs[1](env, v) for c in runs[2](env, v))
        for a, b, c in bounds:
            for x in (a, b, c):
                if kind(x) != "number":
                    raise Problem("Range bounds must be numeric")
            n = a
            while (c > 0 and n < b) or (c < 0 and n > b):
                yield whole(n) if isinstance(n, float) else n
                n += c

    return f


@maker(BUILTINS, ("isempty", 1))
def _isempty(compiler, g):
    source = compiler.run(g)

    def f(env, v):
        yield next((False for _ in source(env, v)), True)

    return f


def _quantifier(stop_at: bool):
    def build(compiler, *args):
        source = compiler.run(args[0]) if len(args) == 2 else lambda env, v: iter(_items(v))
        test = compiler.run(args[-1]) if args else lambda env, v: iter((v,))

        def f(env, v):
            yield stop_at if any(truthy(t) == stop_at for x in source(env, v) for t in test(env, x)) else not stop_at

        return f

    return build


for _n in range(3):
    BUILTINS["any", _n], BUILTINS["all", _n] = _quantifier(True), _quantifier(False)


def _keyed(name: str, build: Callable[[list[tuple[Any, Any]]], Any]):
    def make(compiler, f):
        run = compiler.run(f)
        return lambda env, v: iter((build([(list(run(env, x)), x) for x in _array(v, {"sort_by": "sorted", "group_by": "grouped"}.get(name, "searched"))]),))

    BUILTINS[name, 1] = make


def _by_key(pairs):
    return sorted(pairs, key=lambda p: order(p[0]))


def _groups(pairs):
    out = []
    for k, x in _by_key(pairs):
        if out and compare(out[-1][0], k) == 0:
            out[-1][1].append(x)
        else:
            out.append((k, [x]))
    return out


_keyed("sort_by", lambda pairs: [x for _, x in _by_key(pairs)])
_keyed("group_by", lambda pairs: [g for _, g in _groups(pairs)])
_keyed("unique_by", lambda pairs: [g[0] for _, g in _groups(pairs)])
_keyed("min_by", lambda pairs: min(pairs, key=lambda p: order(p[0]))[1] if pairs else None)
_keyed("max_by", lambda pairs: _last_max(pairs, lambda p: p[0])[1] if pairs else None)


# descent and selection
def _children(v: Any) -> Iterator[tuple[Any, Any]]:
    return enumerate(v) if isinstance(v, list) else v.items() if isinstance(v, dict) else ()


def _descend(v: Any) -> Iterator[Any]:
    """A value and all within it, each before what it holds."""
    left = [v]
    while left:
        x = left.pop()
        yield x
        if isinstance(x, list):
            left.extend(reversed(x))
        elif isinstance(x, dict):
            left.extend(reversed(x.values()))


def _descend_paths(pv: tuple[list | None, Any]) -> Iterator[tuple[list | None, Any]]:
    left = [pv]
    while left:
        path, x = left.pop()
        yield path, x
        if path is not None and isinstance(x, (list, dict)):
            left.extend([([*path, k], y) for k, y in _children(x)][::-1])


BUILTINS["recurse", 0] = lambda compiler: lambda env, v: _descend(v)
PATH_BUILTINS["recurse", 0] = lambda compiler: lambda env, pv: _descend_paths(pv)
BUILTINS["paths", 0] = lambda compiler: lambda env, v: (path for path, _ in _descend_paths(([], v)) if path)


@maker(BUILTINS, ("select", 1))
def _select(compiler, test):
    run = compiler.run(test)

    def f(env, v):
        for t in run(env, v):
            if truthy(t):
                yield v

    return f


@maker(PATH_BUILTINS, ("select", 1))
def _select_paths(compiler, test):
    run = compiler.run(test)

    def f(env, pv):
        for t in run(env, pv[1]):
            if truthy(t):
                yield pv

    return f


def _selector(name: str, fits: Callable[[Any], bool]):
    BUILTINS[name, 0] = lambda compiler: lambda env, v: iter((v,) if fits(v) else ())
    PATH_BUILTINS[name, 0] = lambda compiler: lambda env, pv: iter((pv,) if fits(pv[1]) else ())


_selector("values", lambda v: v is not None)
_selector("nulls", lambda v: v is None)
_selector("booleans", lambda v: kind(v) == "boolean")
_selector("numbers", lambda v: kind(v) == "number")
_selector("strings", lambda v: isinstance(v, str))
_selector("arrays", lambda v: isinstance(v, list))
_selector("objects", lambda v: isinstance(v, dict))
_selector("iterables", lambda v: isinstance(v, (list, dict)))
_selector("scalars", lambda v: not isinstance(v, (list, dict)))


def _walker(run: Callable) -> tuple[Callable, Callable]:
    """(down, inside) for walk: all outputs of f after it went down, and a container after it went down all items."""
    gone: list = []

    def inside(env, v):
        if isinstance(v, list):
            return [new for x in v if (new := next(down(env, x), gone)) is not gone]
        if isinstance(v, dict):
            return {k: new for k, x in v.items() if (new := next(down(env, x), gone)) is not gone}
        return v

    def down(env, v):
        return run(env, inside(env, v))

    return down, inside


@maker(BUILTINS, ("walk", 1))
def _walk(compiler, f):
    down, _ = _walker(compiler.run(f))

    def walk(env, v):
        yield from down(env, v)

    return walk


@maker(PATH_BUILTINS, ("walk", 1))
def _walk_paths(compiler, f):
    (_, inside), found = _walker(compiler.run(f)), compiler.paths(f)

    def walk(env, pv):
        yield from found(env, (None, inside(env, pv[1])) if isinstance(pv[1], (list, dict)) else pv)

    return walk


@maker(BUILTINS, ("map", 1))
def _map(compiler, f):
    from millrace.operators.interpreter import each

    run = compiler.run(f)

    def over(env, v):
        yield [y for _, x in each(v) for y in run(env, x)]

    return over


# paths and streams
@maker(BUILTINS, ("path", 1))
def _path(compiler, g):
    source = compiler.paths(g)

    def f(env, v):
        for path, out in source(env, ([], v)):
            if path is None:
                raise Problem(f"Invalid path expression with result {short(out)}")
            yield path

    return f


@value("getpath")
def _getpath(v, path):
    from millrace.operators.interpreter import get_path

    if not isinstance(path, list):
        raise Problem("Path must be specified as an array")
    try:
        return get_path(v, path)
    except Problem:
        return None


@maker(PATH_BUILTINS, ("getpath", 1))
def _getpath_paths(compiler, p):
    source = compiler.run(p)

    def f(env, pv):
        for path in source(env, pv[1]):
            yield [*pv[0], *path], _getpath(pv[1], path)

    return f


@value("setpath")
def _setpath(v, path, new):
    from millrace.operators.interpreter import set_path

    if not isinstance(path, list):
        raise Problem("Path must be specified as an array")
    return set_path(v, path, new)


@value("delpaths")
def _delpaths(v, paths):
    from millrace.operators.interpreter import delete_paths

    if not isinstance(paths, list) or any(not isinstance(p, list) for p in paths):
        raise Problem("Paths must be specified as an array")
    return delete_paths(v, paths)


@value("tostream_all")
def _tostream(v):
    return list(stream_events(v))


def stream_events(v: Any, path: tuple = (), top: bool = True) -> Iterator[list]:
    """[path, leaf] for leaves (empty containers included) and [path] after the last item of a container."""
    items = list(v.items()) if isinstance(v, dict) else list(enumerate(v)) if isinstance(v, list) else []
    if not items:
        yield [list(path), v]
        return
    for k, x in items:
        yield from stream_events(x, (*path, k), False)
    yield [[*path, items[-1][0]]]


@maker(BUILTINS, ("fromstream", 1))
def _fromstream(compiler, g):
    from millrace.operators.interpreter import set_path

    source = compiler.run(g)

    def f(env, v):
        held, some = None, False
        for event in source(env, v):
            path = event[0]
            if len(event) == 2:
                if not path:
                    yield event[1]
                    held, some = None, False
                    continue
                held, some = set_path(held, path, event[1]), True
            elif len(path) <= 1 and some:
                yield held
                held, some = None, False

    return f


# input and output
class Inputs:
    """The documents that input and inputs read; set by whoever runs a program on a whole stream."""

    rest: Iterator[Any] = iter(())


@maker(BUILTINS, ("input", 0))
def _input(compiler):
    def f(env, v):
        for x in Inputs.rest:
            yield x
            return
        raise Problem("No more inputs")

    return f


@maker(BUILTINS, ("inputs", 0))
def _inputs(compiler):
    return lambda env, v: iter(Inputs.rest)


@maker(BUILTINS, ("debug", 0), ("stderr", 0), ("debug", 1))
def _debug(compiler, *args):
    message = compiler.run(args[0]) if args else lambda env, v: iter((v,))

    def f(env, v):
        for x in message(env, v):
            print(to_json(["DEBUG:", x]), file=sys.stderr)
        yield v

    return f


@maker(BUILTINS, ("builtins", 0))
def _builtins(compiler):
    names = [f"{n}/{k}" for n, k in {*BUILTINS, *PRELUDE_NAMES} if not n.startswith("_")]
    return lambda env, v: iter((names,))


@maker(BUILTINS, ("modulemeta", 0))
def _modulemeta(compiler):
    from millrace.lang.modules import describe

    return lambda env, v: iter((describe(need(v, "string", "modulemeta")),))


# patterns
@lru_cache(maxsize=256)
def _pattern(text: str, flags: str):
    known = {"g": 0, "i": regex.I, "x": regex.X, "s": regex.S, "n": 0, "l": 0, "p": regex.S | regex.M, "m": regex.M}
    bits = regex.V0
    for c in flags:
        if c not in known:
            raise Problem(f"{flags} is not a valid modifier string")
        bits |= known[c]
    try:
        return regex.compile(text, bits)
    except regex.error as problem:
        raise Problem(f"{text} (at offset 0) is not a valid regex: {problem}") from None


def matches(s: Any, re_: Any, flags: Any, every: bool) -> list:
    if isinstance(re_, list):
        re_, flags = re_[0], re_[1] if len(re_) > 1 else flags
    if not isinstance(s, str) or not isinstance(re_, str):
        raise Problem(f"{told(s)} cannot be matched, as it is not a string")
    if flags is not None and not isinstance(flags, str):
        raise Problem(f"{told(flags)} is not a string")
    found = _pattern(re_, flags or "").finditer(s)
    out = []
    for m in found:
        if not ("n" in (flags or "") and not m.group()):
            out.append(m)
        if out and not every and "g" not in (flags or ""):
            break
    return out


def _told(m) -> dict:
    names = {i: n for n, i in m.re.groupindex.items()}
    groups = []
    for i in range(1, (m.re.groups or 0) + 1):
        text = m.group(i)
        groups.append({"offset": m.start(i) if text is not None else -1, "length": len(text) if text is not None else 0, "string": text, "name": names.get(i)})
    return {"offset": m.start(), "length": len(m.group()), "string": m.group(), "captures": groups}


def _named(m) -> dict:
    return {n: m.group(n) for n in sorted(m.re.groupindex, key=m.re.groupindex.get)}


def _scanned(m):
    return list(m.groups()) if m.re.groups else m.group()


def _regex_function(name: str, show: Callable, every: bool = False):
    """name(re) and name(re; flags), one output a match."""

    def make(compiler, pattern, flags=("literal", None)):
        p, g = compiler.run(pattern), compiler.run(flags)

        def f(env, v):
            for fl in g(env, v):
                for r in p(env, v):
                    for m in matches(v, r, fl, every):
                        yield show(m)

        return f

    BUILTINS[name, 1] = BUILTINS[name, 2] = make


_regex_function("match", _told)
_regex_function("capture", _named)
_regex_function("scan", _scanned, every=True)
value("test")(lambda v, r: bool(matches(v, r, None, False)))
value("test")(lambda v, r, fl: bool(matches(v, r, fl, False)))


def _pieces(v, r, fl):
    out, at = [], 0
    for m in matches(v, r, fl, True):
        out.append(v[at : m.start()])
        at = m.end()
    return [*out, v[at:]]


value("split")(_pieces)


@maker(BUILTINS, ("splits", 1), ("splits", 2))
def _splits(compiler, pattern, flags=("literal", None)):
    p, g = compiler.run(pattern), compiler.run(flags)
    return lambda env, v: (x for fl in g(env, v) for r in p(env, v) for x in _pieces(v, r, fl))


def _substitute(every: bool):
    def make(compiler, pattern, replacement, flags=("literal", None)):
        p, r, g = compiler.run(pattern), compiler.run(replacement), compiler.run(flags)

        def f(env, v):
            for fl in g(env, v):
                for re_ in p(env, v):
                    found = matches(v, re_, fl, every)

                    def build(i, at):
                        if i == len(found):
                            yield v[at:]
                            return
                        m = found[i]
                        for text in r(env, _named(m)):
                            if not isinstance(text, str):
                                raise Problem(f"{told(v[at : m.start()])} and {told(text)} cannot be added")
                            for rest in build(i + 1, m.end()):
                                yield v[at : m.start()] + text + rest

                    yield from build(0, 0)

        return f

    return make


for _n in (2, 3):
    BUILTINS["sub", _n], BUILTINS["gsub", _n] = _substitute(False), _substitute(True)


# dates
def _moment(v, name: str) -> datetime:
    if isinstance(v, list) and len(v) >= 6 and all(kind(x) == "number" for x in v):
        return datetime.fromtimestamp(_mktime(v), timezone.utc)
    if kind(v) != "number":
        raise Problem(f"{name} requires parsed datetime inputs")
    return datetime(1970, 1, 1, tzinfo=timezone.utc) + timedelta(seconds=math.floor(v))


def _parts(t: datetime, fraction: float = 0.0) -> list:
    return [t.year, t.month - 1, t.day, t.hour, t.minute, whole(t.second + fraction), (t.weekday() + 1) % 7, t.timetuple().tm_yday - 1]


@value("mktime")
def _mktime(v):
    if not isinstance(v, list) or len(v) < 3 or any(kind(x) != "number" for x in v):
        raise Problem("mktime requires parsed datetime inputs" if not isinstance(v, list) or len(v) >= 6 else "mktime requires array of 6 numbers")
    y, mo, d, h, mi, s = [math.floor(x) for x in [*v, 0, 0, 0][:6]]
    return calendar.timegm((y + mo // 12, mo % 12 + 1, 1, 0, 0, 0)) + (d - 1) * 86400 + h * 3600 + mi * 60 + s


@value("gmtime")
def _gmtime(v):
    need(v, "number", "gmtime")
    return _parts(_moment(v, "gmtime"), v - math.floor(v))


value("localtime")(lambda v: _parts(_moment(v, "localtime").astimezone()))


@value("strftime")
def _strftime(v, fmt):
    if not isinstance(fmt, str):
        raise Problem("strftime/1 requires a string format")
    return _moment(v, "strftime/1").strftime(fmt.replace("%Z", "UTC"))


@value("strflocaltime")
def _strflocaltime(v, fmt):
    if not isinstance(fmt, str):
        raise Problem("strflocaltime/1 requires a string format")
    return _moment(v, "strflocaltime/1").astimezone().strftime(fmt)


@value("strptime")
def _strptime(v, fmt):
    if not isinstance(v, str):
        raise Problem("strptime/1 requires string inputs and arguments")
    try:
        t = datetime.strptime(v, fmt.replace("%Z", "UTC" if "UTC" in v else "Z").replace("%T", "%H:%M:%S").replace("%F", "%Y-%m-%d"))
    except ValueError:
        raise Problem(f'date "{v}" does not match format "{fmt}"') from None
    return _parts(t.astimezone(timezone.utc) if t.tzinfo else t)


ISO = "%Y-%m-%dT%H:%M:%SZ"


@value("fromdate", "fromdateiso8601")
def _fromdate(v):
    if not isinstance(v, str):
        raise Problem("strptime/1 requires string inputs and arguments")
    try:
        t = datetime.fromisoformat(v)
    except ValueError:
        raise Problem(f'date "{v}" does not match format "{ISO}"') from None
    return math.floor((t if t.tzinfo else t.replace(tzinfo=timezone.utc)).timestamp())


value("todate", "todateiso8601")(lambda v: _strftime(need(v, "number", "todate"), ISO))
value("date")(lambda v: _strftime(v, ISO))
value("dateadd")(lambda v, unit, n: add(v, n))
value("datesub")(lambda v, unit, n: v - n)

# formats
FORMATS["@text"] = _tostring
FORMATS["@json"] = to_json
MARKUP = str.maketrans({"&": "&amp;", "<": "&lt;", ">": "&gt;", "'": "&#39;", '"': "&quot;"})
FORMATS["@html"] = lambda v: _tostring(v).translate(MARKUP)
PLAIN = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_.~")
FORMATS["@uri"] = lambda v: "".join(chr(b) if b in PLAIN else f"%{b:02X}" for b in _tostring(v).encode())
FORMATS["@urid"] = lambda v: re.sub(rb"%([0-9A-Fa-f]{2})", lambda m: bytes([int(m[1], 16)]), _tostring(v).encode()).decode(errors="replace")
FORMATS["@base64"] = lambda v: base64.b64encode(_tostring(v).encode()).decode()
FORMATS["@base32"] = lambda v: base64.b32encode(_tostring(v).encode()).decode()


def _decoded(v, decode, alphabet: str, unit: int):
    text = _tostring(v).rstrip("=")
    if re.search(f"[^{alphabet}]", text) or (text and len(text) % unit == 1):
        raise Problem(f"{told(v)} is not valid base{'64' if unit == 4 else '32'} data")
    return decode(text + "=" * (-len(text) % unit)).decode(errors="replace")


FORMATS["@base64d"] = lambda v: _decoded(v, base64.b64decode, "A-Za-z0-9+/", 4)
FORMATS["@base32d"] = lambda v: _decoded(v, base64.b32decode, "A-Z2-7", 8)


def _row(v, show_string, sep, name):
    if not isinstance(v, list):
        raise Problem(f"{told(v)} cannot be {name}-formatted, only an array can be")
    out = []
    for x in v:
        if isinstance(x, (list, dict)):
            raise Problem(f"{told(x)} is not valid in a {name} row")
        out.append("" if x is None else show_string(x) if isinstance(x, str) else to_json(x))
    return sep.join(out)


FORMATS["@csv"] = lambda v: _row(v, lambda s: '"' + s.replace('"', '""') + '"', ",", "csv")
FORMATS["@tsv"] = lambda v: _row(v, lambda s: s.replace("\\", "\\\\").replace("\t", "\\t").replace("\n", "\\n").replace("\r", "\\r"), "\t", "tsv")


def _quoted(x):
    if isinstance(x, (list, dict)):
        raise Problem(f"{told(x)} can not be escaped for shell")
    return "'" + x.replace("'", "'\\''") + "'" if isinstance(x, str) else to_json(x)


FORMATS["@sh"] = lambda v: " ".join(map(_quoted, v)) if isinstance(v, list) else _quoted(v)

PRELUDE = r"""
def map_values(f): .[] |= f;
def recurse(f): def again: ., (f | again); again;
def recurse(f; c): def again: ., (f | select(c) | again); again;
def with_entries(f): to_entries | map(f) | from_entries;
def add(f): reduce f as $x (null; . + $x);
def first: .[0];
def last: .[-1];
def nth($n): .[$n];
def in(o): . as $k | o | has($k);
def inside(o): . as $x | o | contains($x);
def until(c; f): def again: if c then . else f | again end; again;
def while(c; f): def again: if c then ., (f | again) else empty end; again;
def repeat(f): def again: ., (f | again); again;
def paths(f): path(.. | select(f)) | select(length > 0);
def leaf_paths: paths(scalars);
def del(f): delpaths([path(f)]);
def pick(f): . as $all | reduce path(f) as $p (null; setpath($p; $all | getpath($p)));
def tostream: tostream_all[];
def truncate_stream(f): . as $n | null | f | . as $e | if (.[0] | length) > $n then setpath([0]; .[0][$n:]) else empty end;
def combinations: if length == 0 then [] else .[0][] as $x | (.[1:] | combinations) as $rest | [$x] + $rest end;
def combinations(n): . as $all | [range(n)] | map($all) | combinations;
def IN(s): any(s == .; .);
def IN(g; s): any(g == s; .);
def INDEX(s; f): reduce s as $row ({}; .[$row | f | tostring] |= $row);
def INDEX(f): INDEX(.[]; f);
def JOIN($index; f): [.[] | [., $index[f]]];
def JOIN($index; s; f): s | [., $index[f]];
def JOIN($index; s; f; g): s | [., $index[f]] | g;
"""
DEFINITIONS = parse_library(PRELUDE + " .")[2]
PRELUDE_NAMES = [(name, len(params)) for name, params, _ in DEFINITIONS]


def prelude(compiler):
    """An environment with the functions written in the language."""
    from millrace.operators.interpreter import Env

    env = Env({"$ENV": (dict(os.environ),)})
    for name, params, body in DEFINITIONS:
        env.names[name, len(params)] = (env, params, tuple(p[1:] if p[0] == "$" else p for p in params), compiler.run(body), body)
    return env
