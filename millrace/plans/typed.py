"""Programs over typed columns: trees to Spark Columns.

A Typed is a Column with its Spark type; a row of a table is a Typed whose fields are the table's columns.
What has no exact relational form raises NotNative, and the caller takes the interpreter instead.
SQL NULL stands for null; where the language would raise an error on a value, the result is null.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.lang.syntax import Node


class NotNative(Exception):
    """This part of a program needs the interpreter."""


@dataclass(frozen=True)
class Typed:
    col: Column | None
    type: T.DataType
    fields: dict[str, Column] | None = None

    def column(self) -> Column:
        if self.col is not None:
            return self.col
        return F.struct(*[c.alias(k) for k, c in self.fields.items()])

    def get(self, name: str) -> Typed:
        if isinstance(self.type, T.VariantType):
            plain = re.fullmatch(r"[A-Za-z_]\w*", name)
            if not plain and "'" in name:
                raise NotNative("field name")
            return Typed(F.try_variant_get(self.col, f"$.{name}" if plain else f"$['{name}']", "variant"), self.type)
        if not isinstance(self.type, T.StructType):
            if isinstance(self.type, T.MapType):
                return Typed(F.try_element_at(self.column(), F.lit(name)), self.type.valueType)
            raise NotNative(f"{self.type.simpleString()} has no field {name}")
        if name not in self.type.names:
            return Typed(F.lit(None).cast("string"), T.NullType())
        col = self.fields[name] if self.fields else self.col.getField(name)
        return Typed(col, self.type[name].dataType)


@dataclass(frozen=True)
class Scope:
    vars: dict[str, Typed] = field(default_factory=dict)
    defs: dict[tuple[str, int], tuple] = field(default_factory=dict)


NUMBERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
TIMES = (T.TimestampType, T.TimestampNTZType, T.DateType)
LONG, DOUBLE, STRING, BOOLEAN = T.LongType(), T.DoubleType(), T.StringType(), T.BooleanType()


def is_number(t: Typed) -> bool:
    return isinstance(t.type, NUMBERS)


def literal(value) -> Typed:
    if value is None:
        return Typed(F.lit(None).cast("string"), T.NullType())
    if isinstance(value, bool):
        return Typed(F.lit(value), BOOLEAN)
    if isinstance(value, int):
        return Typed(F.lit(value).cast("long"), LONG)
    if isinstance(value, float):
        return Typed(F.lit(value), DOUBLE)
    if isinstance(value, str):
        return Typed(F.lit(value), STRING)
    raise NotNative("literal container")


def rank(t: T.DataType) -> int:
    """The place of a type in the total order (null aside)."""
    if isinstance(t, T.BooleanType):
        return 1
    if isinstance(t, NUMBERS):
        return 3
    if isinstance(t, (T.StringType, *TIMES)):
        return 4
    return 5 if isinstance(t, T.ArrayType) else 6


def variant_rank(c: Column) -> Column:
    """The place of a JSON value's type in the total order; true counts as false here."""
    kind = F.coalesce(F.schema_of_variant(c), F.lit("VOID"))
    out = F.when(kind == "VOID", 0).when(kind == "BOOLEAN", 1).when(kind.rlike("^(BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL)"), 3)
    return out.when(kind == "STRING", 4).when(kind.startswith("ARRAY"), 5).otherwise(6)


def variant_as(c: Column, rank_: int) -> Column:
    """The value, if it is of the type with that rank, else null."""
    return F.when(variant_rank(c) == rank_, F.try_variant_get(c, "$", {1: "boolean", 3: "double", 4: "string"}[rank_]))


def variant_comparison(op: str, v: Typed, other: Typed) -> Column:
    rb, y = rank(other.type), other.column()
    if rb not in (1, 3, 4):
        raise NotNative("comparison of JSON values")
    x, own = variant_as(v.col, rb), variant_rank(v.col)
    y = y.cast("double") if rb == 3 else y
    order = F.when(y.isNull(), F.when(own == 0, 0).otherwise(1)).when(own < rb, -1).when(own > rb, 1).when(x < y, -1).when(x > y, 1).otherwise(0)
    return {"==": order == 0, "!=": order != 0, "<": order < 0, "<=": order <= 0, ">": order > 0, ">=": order >= 0}[op]


def truth(t: Typed) -> Column:
    """Never null."""
    if isinstance(t.type, T.VariantType):
        return (variant_rank(t.col) > 0) & F.coalesce(variant_as(t.col, 1), F.lit(True))
    if isinstance(t.type, T.BooleanType):
        return F.coalesce(t.col, F.lit(False))
    if isinstance(t.type, T.NullType):
        return F.lit(False)
    return t.column().isNotNull() if t.col is not None else F.lit(True)


def condition(node: Node, value: Typed, scope: Scope) -> Column:
    """For filters: null counts as false, so that comparisons stay plain and can be pushed into scans."""
    if node[0] == "and":
        return condition(node[1], value, scope) & condition(node[2], value, scope)
    if node[0] == "or":
        return condition(node[1], value, scope) | condition(node[2], value, scope)
    if node[0] == "binary" and node[1] in ("==", "!=", "<", "<=", ">", ">="):
        return comparison(node[1], scalar(node[2], value, scope), scalar(node[3], value, scope), exact=False)
    return truth(scalar(node, value, scope))


def comparison(op: str, a: Typed, b: Typed, exact: bool = True) -> Column:
    """exact: true or false; else null may stand for false."""
    if isinstance(a.type, T.VariantType) or isinstance(b.type, T.VariantType):
        if isinstance(a.type, T.VariantType) and not isinstance(b.type, (T.VariantType, T.NullType)):
            return variant_comparison(op, a, b)
        turned = {"<": ">", ">": "<", "<=": ">=", ">=": "<="}.get(op, op)
        if isinstance(b.type, T.VariantType) and not isinstance(a.type, (T.VariantType, T.NullType)):
            return variant_comparison(turned, b, a)
        raise NotNative("comparison of JSON values")
    if isinstance(a.type, T.NullType) or isinstance(b.type, T.NullType):
        x, y = a.column().isNotNull(), b.column().isNotNull()
        both = {"==": ~x & ~y, "!=": x | y, "<": ~x & y, ">": x & ~y, "<=": ~x, ">=": ~y}
        return both[op]
    ra, rb = rank(a.type), rank(b.type)
    x, y = a.column(), b.column()
    if ra != rb:
        less = F.when(x.isNull() & y.isNull(), F.lit(0)).when(x.isNull(), F.lit(-1)).when(y.isNull(), F.lit(1)).otherwise(F.lit(-1 if ra < rb else 1))
        return {"==": less == 0, "!=": less != 0, "<": less < 0, "<=": less <= 0, ">": less > 0, ">=": less >= 0}[op]
    if ra == 6:
        raise NotNative("objects are ordered by their keys")
    if isinstance(a.type, TIMES) != isinstance(b.type, TIMES):
        x, y = (text(Typed(c, t)) for c, t in ((x, a.type), (y, b.type)))
    if op == "==":
        return x.eqNullSafe(y) if exact else (x == y)
    if op == "!=":
        return ~x.eqNullSafe(y)
    plain = {"<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]
    null_first = {"<": x.isNull() & y.isNotNull(), "<=": x.isNull(), ">": y.isNull() & x.isNotNull(), ">=": y.isNull()}[op]
    return F.coalesce(plain, null_first) if exact else (plain | null_first)


def arithmetic(op: str, a: Typed, b: Typed) -> Typed:
    if isinstance(a.type, T.NullType) and op == "+":
        return b
    if isinstance(b.type, T.NullType) and op == "+":
        return a
    x, y = a.column(), b.column()
    either = lambda both: F.when(x.isNull(), y).when(y.isNull(), x).otherwise(both)  # noqa: E731  null is neutral in sums
    if is_number(a) and is_number(b):
        whole = isinstance(a.type, WHOLE) and isinstance(b.type, WHOLE)
        kind = LONG if whole else DOUBLE
        x, y = x.cast(kind), y.cast(kind)
        if op == "+":
            return Typed(F.when(x.isNull(), y).when(y.isNull(), x).otherwise(x + y), kind)
        if op == "-":
            return Typed(x - y, kind)
        if op == "*":
            return Typed(x * y, kind)
        if op == "/":
            return Typed(F.try_divide(x.cast("double"), y.cast("double")), DOUBLE)
        return Typed(F.try_mod(x.cast("long"), y.cast("long")), LONG)
    if isinstance(a.type, T.StringType) and isinstance(b.type, T.StringType):
        if op == "+":
            return Typed(either(F.concat(x, y)), STRING)
        if op == "/":
            return split_plain(a, b)
    if isinstance(a.type, T.StringType) and is_number(b) and op == "*":
        return Typed(F.when(y >= 0, F.repeat(x, y.cast("int"))), STRING)
    if isinstance(a.type, T.ArrayType) and isinstance(b.type, T.ArrayType) and a.type.elementType == b.type.elementType:
        if op == "+":
            return Typed(either(F.concat(x, y)), a.type)
        if op == "-":
            return Typed(F.filter(x, lambda i: ~F.coalesce(F.exists(y, lambda j: j.eqNullSafe(i)), F.lit(False))), a.type)
    if isinstance(a.type, T.StructType) and isinstance(b.type, T.StructType) and op == "+":
        names = list(dict.fromkeys([*a.type.names, *b.type.names]))
        got = {n: (b if n in b.type.names else a).get(n) for n in names}
        return record(got)
    raise NotNative(f"{a.type.simpleString()} {op} {b.type.simpleString()}")


def record(entries: dict[str, Typed]) -> Typed:
    return Typed(None, T.StructType([T.StructField(k, t.type) for k, t in entries.items()]), {k: t.column() for k, t in entries.items()})


def split_plain(a: Typed, b: Typed) -> Typed:
    quoted = F.concat(F.lit("\\Q"), F.replace(b.column(), F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    empty = F.array().cast("array<string>")
    chars = F.filter(F.split(a.column(), ""), lambda c: c != "")
    return Typed(F.when(a.column() == "", empty).when(b.column() == "", chars).otherwise(F.split(a.column(), quoted, -1)), T.ArrayType(STRING))


def text(t: Typed) -> Column:
    """tostring of scalars."""
    c = t.column()
    if isinstance(t.type, T.StringType):
        return F.coalesce(c, F.lit("null"))
    if isinstance(t.type, T.NullType):
        return F.lit("null")
    if isinstance(t.type, (T.BooleanType, *WHOLE)):
        return F.coalesce(c.cast("string"), F.lit("null"))
    if isinstance(t.type, (T.FloatType, T.DoubleType)):
        d = c.cast("double")
        small = F.when((d == F.floor(d)) & (F.abs(d) < 1e15), F.floor(d).cast("string")).when((F.abs(d) < 1e7) & (F.abs(d) >= 1e-3), d.cast("string"))
        return F.when(d.isNull() | F.isnan(d), F.lit("null")).otherwise(F.coalesce(small, F.lower(F.regexp_replace(F.regexp_replace(d.cast("string"), r"\.0E", "E"), r"E(\d)", "e+$1"))))
    if isinstance(t.type, T.DateType):
        return F.date_format(c, "yyyy-MM-dd")
    if isinstance(t.type, TIMES):
        return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    raise NotNative(f"text of {t.type.simpleString()}")


def common(items: list[Typed]) -> tuple[list[Column], T.DataType]:
    """Columns of one type, for arrays and branches."""
    kinds = {t.type.simpleString() for t in items if not isinstance(t.type, T.NullType)}
    if not kinds:
        return [t.column() for t in items], STRING
    first = next(t.type for t in items if not isinstance(t.type, T.NullType))
    if len(kinds) > 1:
        if not all(is_number(t) or isinstance(t.type, T.NullType) for t in items):
            raise NotNative("values of several types")
        first = LONG if all(isinstance(t.type, (*WHOLE, T.NullType)) for t in items) else DOUBLE
    return [t.column().cast(first) if t.type != first else t.column() for t in items], first


def array_of(node: Node | None, value: Typed, scope: Scope) -> Typed:
    """[f]: a list of scalars, or a generator over one array."""
    if node is None:
        raise NotNative("empty array has no type")
    items = []
    while node[0] == "comma":
        items.insert(0, node[2])
        node = node[1]
    items.insert(0, node)
    if len(items) > 1:
        cols, kind = common([scalar(i, value, scope) for i in items])
        return Typed(F.array(*cols), T.ArrayType(kind))
    return generated(items[0], value, scope)


def stages(node: Node) -> list[Node]:
    return [*stages(node[1]), *stages(node[2])] if node[0] == "pipe" else [node]


def generated(node: Node, value: Typed, scope: Scope) -> Typed:
    """All outputs of ``source[] | f | select(g) | ...`` as an array."""
    first, *rest = stages(node)
    # .a[].b is .a[] | .b
    tail = []
    while first[0] in ("index", "slice") and first[1][0] in ("each", "index", "slice") and _has_each(first):
        tail.insert(0, (first[0], ("identity",), *first[2:]))
        first = first[1]
    rest = [*tail, *rest]
    if first[0] == "each":
        source = scalar(first[1], value, scope)
    elif first[0] == "call" and first[1] == "range" and len(first[2]) <= 2:
        a, b = (literal(0), scalar(first[2][0], value, scope)) if len(first[2]) == 1 else [scalar(x, value, scope) for x in first[2]]
        low, high = a.column().cast("long"), b.column().cast("long")
        source = Typed(F.when(low < high, F.sequence(low, high - 1)).otherwise(F.array().cast("array<bigint>")), T.ArrayType(LONG))
    else:
        one = scalar(node, value, scope)
        return Typed(F.array(one.column()), T.ArrayType(one.type))
    if not isinstance(source.type, T.ArrayType):
        raise NotNative("only arrays are iterated natively")
    return through(source, rest, scope)


def _has_each(node: Node) -> bool:
    while node[0] in ("index", "slice"):
        node = node[1]
    return node[0] == "each"


def through(source: Typed, rest: list[Node], scope: Scope) -> Typed:
    for step in rest:
        kind = source.type.elementType
        if step[0] == "call" and step[1] == "select":
            source = Typed(F.filter(source.column(), _on_item(step[2][0], kind, scope, truth)), source.type)
        elif step == ("call", "values", ()):
            source = Typed(F.filter(source.column(), lambda x: x.isNotNull()), source.type)
        elif step[0] == "each" and step[1] == ("identity",) and isinstance(kind, T.ArrayType):
            source = Typed(F.flatten(source.column()), kind)
        else:
            out = probe(step, kind, scope)
            source = Typed(F.transform(source.column(), _on_item(step, kind, scope, Typed.column)), T.ArrayType(out))
    return source


def _on_item(node: Node, kind: T.DataType, scope: Scope, then: Callable[[Typed], Column]) -> Callable[[Column], Column]:
    return lambda x: then(scalar(node, Typed(x, kind), scope))


def probe(node: Node, kind: T.DataType, scope: Scope) -> T.DataType:
    """The type of a scalar over a value of that type."""
    return scalar(node, Typed(F.lit(None).cast(kind), kind), scope).type


def scalar(node: Node, value: Typed, scope: Scope) -> Typed:
    """A program with exactly one output."""
    kind = node[0]
    if kind == "identity":
        return value
    if kind == "literal":
        return literal(node[1])
    if kind == "var":
        if node[1] not in scope.vars:
            raise NotNative(f"${node[1]}")
        return scope.vars[node[1]]
    if kind == "pipe":
        return scalar(node[2], scalar(node[1], value, scope), scope)
    if kind == "index":
        return indexed(scalar(node[1], value, scope), node[2], value, scope)
    if kind == "slice":
        return sliced(scalar(node[1], value, scope), node[2], node[3], value, scope)
    if kind == "array":
        return array_of(node[1], value, scope)
    if kind == "object":
        entries = {}
        for key, item in node[1]:
            if key[0] != "literal" or not isinstance(key[1], str):
                raise NotNative("computed keys")
            entries[key[1]] = scalar(item, value, scope)
        return record(entries)
    if kind == "negate":
        a = scalar(node[1], value, scope)
        if not is_number(a):
            raise NotNative("negation")
        return Typed(-a.column(), a.type)
    if kind == "binary":
        a, b = scalar(node[2], value, scope), scalar(node[3], value, scope)
        if node[1] in ("+", "-", "*", "/", "%"):
            return arithmetic(node[1], a, b)
        return Typed(comparison(node[1], a, b), BOOLEAN)
    if kind in ("and", "or"):
        a, b = truth(scalar(node[1], value, scope)), truth(scalar(node[2], value, scope))
        return Typed(a & b if kind == "and" else a | b, BOOLEAN)
    if kind == "if":
        test = truth(scalar(node[1], value, scope))
        (yes, no), out = common([scalar(node[2], value, scope), scalar(node[3], value, scope)])
        return Typed(F.when(test, yes).otherwise(no), out)
    if kind == "alt":
        left, right = scalar(node[1], value, scope), scalar(node[2], value, scope)
        (a, b), out = common([left, right])
        return Typed(F.when(truth(left), a).otherwise(b), out)
    if kind == "try" and node[2] is None:
        return scalar(node[1], value, scope)
    if kind == "template":
        if node[1] not in (None, "@text"):
            show = lambda t: formatted(node[1], t).column()
        else:
            show = text
        parts = [F.lit(p) if isinstance(p, str) else show(scalar(p, value, scope)) for p in node[2]]
        return Typed(F.concat(*parts), STRING)
    if kind == "format":
        return formatted(node[1], value)
    if kind == "bind" and len(node[2]) == 1:
        return scalar(node[3], value, bound(node[2][0], scalar(node[1], value, scope), scope))
    if kind == "def":
        return scalar(node[4], value, replace(scope, defs={**scope.defs, (node[1], len(node[2])): (node[2], node[3], scope)}))
    if kind == "reduce":
        return folded(node, value, scope)
    if kind == "assign":
        return assigned(node, value, scope)
    if kind == "call":
        return called(node[1], node[2], value, scope)
    raise NotNative(kind)


def bound(pattern: Node, source: Typed, scope: Scope) -> Scope:
    if pattern[0] == "var":
        return replace(scope, vars={**scope.vars, pattern[1]: source})
    if pattern[0] == "array":
        for i, p in enumerate(pattern[1]):
            scope = bound(p, indexed(source, ("literal", i), source, scope), scope)
        return scope
    for key, name, inner in pattern[1]:
        if key[0] != "literal":
            raise NotNative("computed keys in patterns")
        item = source.get(key[1])
        if name:
            scope = replace(scope, vars={**scope.vars, name: item})
        if inner:
            scope = bound(inner, item, scope)
    return scope


def indexed(target: Typed, key: Node, value: Typed, scope: Scope) -> Typed:
    if key[0] == "literal" and isinstance(key[1], str):
        return target.get(key[1])
    if key[0] == "literal" and getattr(target, "parts", None) and key[1] in (0, 1):
        return target.parts[key[1]]
    if isinstance(target.type, T.VariantType):
        if key[0] == "literal" and isinstance(key[1], int) and key[1] >= 0:
            return Typed(F.try_variant_get(target.col, f"$[{key[1]}]", "variant"), target.type)
        raise NotNative("index of a JSON value")
    k = scalar(key, value, scope)
    if isinstance(target.type, T.ArrayType) and is_number(k):
        i = F.floor(k.column()).cast("int")
        return Typed(F.when(i >= 0, F.get(target.column(), i)).otherwise(F.try_element_at(target.column(), F.when(i < 0, i))), target.type.elementType)
    if isinstance(target.type, T.MapType) and isinstance(k.type, T.StringType):
        return Typed(F.try_element_at(target.column(), k.column()), target.type.valueType)
    raise NotNative("index")


def sliced(target: Typed, start: Node | None, stop: Node | None, value: Typed, scope: Scope) -> Typed:
    c, is_text = target.column(), isinstance(target.type, T.StringType)
    if not is_text and not isinstance(target.type, T.ArrayType):
        raise NotNative("slice")
    size = F.char_length(c) if is_text else F.size(c)

    def place(node, default, up):
        if node is None:
            return default
        x = scalar(node, value, scope)
        if not is_number(x):
            raise NotNative("slice bound")
        i = (F.ceil(x.column()) if up else F.floor(x.column())).cast("int")
        return F.greatest(F.lit(0), F.least(size, F.when(i < 0, i + size).otherwise(i)))

    a, b = place(start, F.lit(0), False), place(stop, size, True)
    count = F.greatest(F.lit(0), b - a)
    return Typed(F.substring(c, a + 1, count) if is_text else F.slice(c, a + 1, count), target.type)


def folded(node: Node, value: Typed, scope: Scope) -> Typed:
    """reduce over an array, with a state of one type."""
    _, source, patterns, init, update = node
    items, start = generated(source, value, scope), scalar(init, value, scope)
    if len(patterns) > 1 or not isinstance(start.type, (*NUMBERS, T.StringType, T.BooleanType)):
        raise NotNative("state")
    element = items.type.elementType
    state = start.type
    for _ in range(2):  # a whole number may become a fraction
        out = scalar(update, Typed(F.lit(None).cast(state), state), bound(patterns[0], Typed(F.lit(None).cast(element), element), scope)).type
        if out == state:
            break
        state = out
    step = lambda acc, x: scalar(update, Typed(acc, state), bound(patterns[0], Typed(x, element), scope)).column().cast(state)
    return Typed(F.aggregate(items.column(), start.column().cast(state), step), state)


def _static_path(node: Node) -> list[str]:
    if node[0] == "identity":
        return []
    if node[0] == "index" and node[2][0] == "literal" and isinstance(node[2][1], str):
        return [*_static_path(node[1]), node[2][1]]
    if node[0] == "pipe":
        return [*_static_path(node[1]), *_static_path(node[2])]
    raise NotNative("path")


def assigned(node: Node, value: Typed, scope: Scope) -> Typed:
    _, op, left, right = node
    path = _static_path(left)

    def go(t: Typed, path: list[str]) -> Typed:
        if not path:
            if op == "|=":
                return scalar(right, t, scope)
            new = scalar(right, value, scope)
            if op == "=":
                return new
            if op == "//=":
                (a, b), out = common([t, new])
                return Typed(F.when(truth(t), a).otherwise(b), out)
            return arithmetic(op[0], t, new)
        if not isinstance(t.type, T.StructType):
            raise NotNative("path into another type")
        names = t.type.names if path[0] in t.type.names else [*t.type.names, path[0]]
        return record({n: go(t.get(n), path[1:]) if n == path[0] else t.get(n) for n in names})

    return go(value, path)


def formatted(name: str, t: Typed) -> Typed:
    if name in ("@csv", "@tsv", "@sh"):
        if not isinstance(t.type, T.ArrayType):
            raise NotNative(name)
        element = t.type.elementType
        if isinstance(element, T.StringType):
            quote = {
                "@csv": lambda x: F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"')),
                "@tsv": lambda x: F.replace(F.replace(F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit("\t"), F.lit("\\t")), F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r")),
                "@sh": lambda x: F.concat(F.lit("'"), F.replace(x, F.lit("'"), F.lit("'\\''")), F.lit("'")),
            }[name]
            show = lambda x: F.when(x.isNull(), F.lit("" if name != "@sh" else "null")).otherwise(quote(x))
        else:
            show = lambda x: F.when(x.isNull(), F.lit("" if name != "@sh" else "null")).otherwise(text(Typed(x, element)))
        return Typed(F.array_join(F.transform(t.column(), show), {"@csv": ",", "@tsv": "\t", "@sh": " "}[name]), STRING)
    s = text(t)
    if name == "@text":
        return Typed(s, STRING)
    if name == "@json" and not isinstance(t.type, T.StringType):
        return Typed(s, STRING)
    if name == "@html":
        for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("'", "&#39;"), ('"', "&quot;")):
            s = F.replace(s, F.lit(a), F.lit(b))
        return Typed(s, STRING)
    if name == "@uri":
        return Typed(F.replace(F.replace(F.replace(F.url_encode(s), F.lit("+"), F.lit("%20")), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A")), STRING)
    if name == "@base64":
        return Typed(F.replace(F.base64(F.encode(s, "UTF-8")), F.lit("\r\n"), F.lit("")), STRING)
    if name == "@base64d":
        return Typed(F.decode(F.try_to_binary(s, F.lit("base64")), "UTF-8"), STRING)
    raise NotNative(name)


#: C-style date codes and their Java patterns
DATE_CODES = {"Y": "yyyy", "m": "MM", "d": "dd", "H": "HH", "M": "mm", "S": "ss", "j": "DDD", "b": "MMM", "B": "MMMM", "a": "EEE", "A": "EEEE", "y": "yy", "I": "hh", "p": "a", "F": "yyyy-MM-dd", "T": "HH:mm:ss", "Z": "'UTC'", "%": "'%'"}


def date_pattern(fmt: str) -> str:
    out = []
    for code, plain in re.findall(r"%(.)|([^%]+)", fmt):
        if code and code not in DATE_CODES:
            raise NotNative(f"%{code}")
        out.append(DATE_CODES[code] if code else "'" + plain.replace("'", "''") + "'")
    return "".join(out).replace("''''", "''")


def moment(t: Typed) -> Column:
    if isinstance(t.type, TIMES):
        return t.column()
    if is_number(t):
        return F.timestamp_seconds(F.floor(t.column()))
    raise NotNative("date")


def const(node: Node) -> str:
    if node[0] != "literal" or not isinstance(node[1], str):
        raise NotNative("a literal string is needed")
    return node[1]


def java_regex(pattern: str, flags: str) -> str:
    if re.search(r"\(\?<?[=!]|\\[1-9]|\(\?P", pattern) or set(flags) - set("gixsm"):
        raise NotNative("pattern")
    bits = "".join(sorted({"i": "i", "x": "x", "s": "s", "m": "m", "g": ""}[f] for f in flags))
    return (f"(?{bits})" if bits else "") + pattern


def same(f: Callable[[Column], Column], out: T.DataType | None = None):
    return lambda t: Typed(f(t.column()), out or t.type)


def needs(kinds: tuple, f: Callable[[Typed], Typed]):
    def call(t: Typed) -> Typed:
        if not isinstance(t.type, kinds):
            raise NotNative(t.type.simpleString())
        return f(t)

    return call


def _guarded(f, bad):
    return lambda c: F.when(c.cast("double") > 0, f(c.cast("double"))).when(c == 0, F.lit(bad)).when(c < 0, F.lit(float("nan")))


def _whole(f):
    return lambda t: Typed(f(t.column().cast("double")).cast("long"), LONG) if not isinstance(t.type, WHOLE) else t


TEXT, ARRAY = (T.StringType,), (T.ArrayType,)
WHITE = r"\p{IsWhite_Space}"
UNARY: dict[str, Callable[[Typed], Typed]] = {
    "not": lambda t: Typed(~truth(t), BOOLEAN),
    "tostring": lambda t: Typed(F.coalesce(variant_as(t.col, 4), F.to_json(t.col), F.lit("null")), STRING) if isinstance(t.type, T.VariantType) else Typed(text(t), STRING) if not isinstance(t.type, T.StringType) else t,
    "ascii_downcase": needs(TEXT, same(lambda c: F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))),
    "ascii_upcase": needs(TEXT, same(lambda c: F.translate(c, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"))),
    "utf8bytelength": needs(TEXT, same(lambda c: F.octet_length(c).cast("long"), LONG)),
    "trim": needs(TEXT, same(lambda c: F.regexp_replace(c, f"^{WHITE}+|{WHITE}+$", ""))),
    "ltrim": needs(TEXT, same(lambda c: F.regexp_replace(c, f"^{WHITE}+", ""))),
    "rtrim": needs(TEXT, same(lambda c: F.regexp_replace(c, f"{WHITE}+$", ""))),
    "toboolean": lambda t: t if isinstance(t.type, T.BooleanType) else needs(TEXT, same(lambda c: F.when(c == "true", True).when(c == "false", False), BOOLEAN))(t),
    "floor": needs(NUMBERS, _whole(F.floor)), "ceil": needs(NUMBERS, _whole(F.ceil)), "round": needs(NUMBERS, _whole(lambda c: F.round(c))),
    "trunc": needs(NUMBERS, _whole(lambda c: F.when(c < 0, F.ceil(c)).otherwise(F.floor(c)))), "abs": needs(NUMBERS, same(F.abs)), "fabs": needs(NUMBERS, same(lambda c: F.abs(c.cast("double")), DOUBLE)),
    "log": needs(NUMBERS, same(_guarded(F.ln, float("-inf")), DOUBLE)), "log2": needs(NUMBERS, same(_guarded(F.log2, float("-inf")), DOUBLE)), "log10": needs(NUMBERS, same(_guarded(F.log10, float("-inf")), DOUBLE)),
    "exp2": needs(NUMBERS, same(lambda c: F.pow(F.lit(2.0), c), DOUBLE)), "exp10": needs(NUMBERS, same(lambda c: F.pow(F.lit(10.0), c), DOUBLE)),
    "isnan": needs(NUMBERS, same(lambda c: F.isnan(c.cast("double")), BOOLEAN)), "isinfinite": needs(NUMBERS, same(lambda c: F.abs(c.cast("double")) == float("inf"), BOOLEAN)),
    "reverse": needs((*TEXT, *ARRAY), same(lambda c: F.reverse(c))), "flatten": needs(ARRAY, lambda t: Typed(F.flatten(t.column()), t.type.elementType) if isinstance(t.type.elementType, T.ArrayType) else t),
    "sort": needs(ARRAY, same(lambda c: F.sort_array(c))), "unique": needs(ARRAY, same(lambda c: F.sort_array(F.array_distinct(c)))),
    "min": needs(ARRAY, lambda t: Typed(F.get(F.sort_array(t.column()), 0), t.type.elementType)), "max": needs(ARRAY, lambda t: Typed(F.try_element_at(F.sort_array(t.column()), F.lit(-1)), t.type.elementType)),
    "first": needs(ARRAY, lambda t: Typed(F.get(t.column(), 0), t.type.elementType)), "last": needs(ARRAY, lambda t: Typed(F.try_element_at(t.column(), F.lit(-1)), t.type.elementType)),
    "todate": lambda t: Typed(F.date_format(moment(t), "yyyy-MM-dd'T'HH:mm:ss'Z'"), STRING),
    "fromdate": lambda t: Typed(F.unix_timestamp(t.column()), LONG) if isinstance(t.type, T.TimestampType) else Typed(F.unix_timestamp(F.to_timestamp_ltz(t.column().cast("string"))), LONG),
    "gmtime": lambda t: Typed(F.array(*[f(moment(t)).cast("long") for f in (F.year, lambda c: F.month(c) - 1, F.day, F.hour, F.minute, F.second, lambda c: F.dayofweek(c) - 1, lambda c: F.dayofyear(c) - 1)]), T.ArrayType(LONG)),
    "transpose": needs(ARRAY, lambda t: Typed(F.transform(F.sequence(F.lit(0), F.array_max(F.transform(t.column(), lambda r: F.size(r))) - 1), lambda i: F.transform(t.column(), lambda r: F.get(r, i))), t.type)),
    "values": lambda t: t,
}
for _name in ("sqrt", "cbrt", "exp", "expm1", "log1p", "sin", "cos", "tan", "asin", "acos", "atan", "sinh", "cosh", "tanh", "asinh", "acosh", "atanh"):
    UNARY[_name] = needs(NUMBERS, same(lambda c, f=getattr(F, _name): f(c.cast("double")), DOUBLE))
UNARY |= {"todateiso8601": UNARY["todate"], "fromdateiso8601": UNARY["fromdate"], "truncate": UNARY["trunc"], "log_e": UNARY["log"]}
UNARY["fromjson"] = needs(TEXT, same(F.try_parse_json, T.VariantType()))
UNARY["tonumber"] = lambda t: t if is_number(t) else Typed(F.coalesce(variant_as(t.col, 3), variant_as(t.col, 4).try_cast("double")), DOUBLE) if isinstance(t.type, T.VariantType) else needs(TEXT, same(lambda c: c.try_cast("double"), DOUBLE))(t)


def length(t: Typed) -> Typed:
    if isinstance(t.type, T.StringType):
        return Typed(F.coalesce(F.char_length(t.column()), F.lit(0)).cast("long"), LONG)
    if isinstance(t.type, (T.ArrayType, T.MapType)):
        return Typed(F.when(t.column().isNull(), 0).otherwise(F.size(t.column())).cast("long"), LONG)
    if is_number(t):
        return Typed(F.coalesce(F.abs(t.column()), F.lit(0)), t.type)
    if isinstance(t.type, T.StructType):
        return literal(len(t.type.names))
    raise NotNative("length")


def total(t: Typed) -> Typed:
    """add of an array."""
    element = t.type.elementType if isinstance(t.type, T.ArrayType) else None
    if isinstance(element, NUMBERS):
        out = LONG if isinstance(element, WHOLE) else DOUBLE
        return Typed(F.when(F.size(t.column()) > 0, F.aggregate(t.column(), F.lit(0).cast(out), lambda a, x: a + F.coalesce(x.cast(out), F.lit(0).cast(out)))), out)
    if isinstance(element, T.StringType):
        return Typed(F.when(F.size(t.column()) > 0, F.array_join(t.column(), "")), STRING)
    if isinstance(element, T.ArrayType):
        return Typed(F.when(F.size(t.column()) > 0, F.flatten(F.filter(t.column(), lambda x: x.isNotNull()))), element)
    raise NotNative("add")


def type_name(t: Typed) -> Typed:
    names = {1: "boolean", 3: "number", 4: "string", 5: "array", 6: "object"}
    if isinstance(t.type, T.NullType):
        return literal("null")
    if isinstance(t.type, T.VariantType):
        own = variant_rank(t.col)
        return Typed(F.when(own == 0, "null").when(own == 1, "boolean").when(own == 3, "number").when(own == 4, "string").when(own == 5, "array").otherwise("object"), STRING)
    name = F.lit(names[rank(t.type)])
    return Typed(F.when(t.column().isNull(), F.lit("null")).otherwise(name) if t.col is not None else name, STRING)


def called(name: str, args: tuple, value: Typed, scope: Scope) -> Typed:
    if (name, len(args)) in scope.defs:
        params, body, outer = scope.defs[name, len(args)]
        inner = replace(outer, defs={**outer.defs})
        for p, a in zip(params, args, strict=True):
            if p[0] == "$":
                inner.vars[p[1:]] = scalar(a, value, scope)
            inner.defs[p.lstrip("$"), 0] = ((), a, scope)
        # the definition itself isn't in its scope: recursion is not native
        return scalar(body, value, replace(inner, vars={**outer.vars, **inner.vars}))
    if not args:
        if name == "length":
            return length(value)
        if name == "type":
            return type_name(value)
        if name == "add":
            return total(value)
        if name in ("any", "all"):
            if not isinstance(value.type, T.ArrayType):
                raise NotNative(name)
            quantify = F.exists if name == "any" else F.forall
            return Typed(quantify(value.column(), lambda x: truth(Typed(x, value.type.elementType))), BOOLEAN)
        if name in ("keys", "keys_unsorted"):
            if isinstance(value.type, T.StructType):
                names = sorted(value.type.names) if name == "keys" else value.type.names
                return Typed(F.array(*[F.lit(n) for n in names]), T.ArrayType(STRING))
            if isinstance(value.type, T.MapType):
                keys = F.map_keys(value.column())
                return Typed(F.sort_array(keys) if name == "keys" else keys, T.ArrayType(STRING))
        if name == "to_entries" and isinstance(value.type, T.MapType):
            return Typed(F.map_entries(value.column()), T.ArrayType(T.StructType([T.StructField("key", value.type.keyType), T.StructField("value", value.type.valueType)])))
        if name == "now":
            return Typed(F.unix_micros(F.current_timestamp()) / 1e6, DOUBLE)
        if name in ("infinite", "nan"):
            return literal(float("inf") if name == "infinite" else float("nan"))
        if name in UNARY and name != "values":
            return UNARY[name](value)
        raise NotNative(name)
    if name == "map":
        if not isinstance(value.type, T.ArrayType):
            raise NotNative("map")
        return through(value, stages(args[0]), scope)
    if name in ("any", "all") and len(args) == 1 and isinstance(value.type, T.ArrayType):
        quantify = F.exists if name == "any" else F.forall
        return Typed(quantify(value.column(), lambda x: truth(scalar(args[0], Typed(x, value.type.elementType), scope))), BOOLEAN)
    if name in ("first", "last", "isempty", "add") and len(args) == 1:
        items = generated(args[0], value, scope)
        return Typed(F.size(items.column()) == 0, BOOLEAN) if name == "isempty" else total(items) if name == "add" else UNARY[name](items)
    if name == "sort_by" and isinstance(value.type, T.ArrayType):
        return by_key(value, args[0], scope)
    if name in ("min_by", "max_by") and isinstance(value.type, T.ArrayType):
        ordered = by_key(value, args[0], scope)
        return UNARY["first" if name == "min_by" else "last"](ordered)
    if name == "has":
        k = args[0]
        if k[0] == "literal" and isinstance(k[1], str) and isinstance(value.type, T.StructType):
            return literal(k[1] in value.type.names)
        key = scalar(k, value, scope)
        if isinstance(value.type, T.MapType):
            return Typed(F.coalesce(F.map_contains_key(value.column(), key.column()), F.lit(False)), BOOLEAN)
        if isinstance(value.type, T.ArrayType):
            return Typed(F.coalesce((key.column() >= 0) & (key.column() < F.size(value.column())), F.lit(False)), BOOLEAN)
    if name == "del":
        path = _static_path(args[0])
        if len(path) == 1 and isinstance(value.type, T.StructType):
            return record({n: value.get(n) for n in value.type.names if n != path[0]})
    if name == "pick":
        parts, node = [], args[0]
        while node[0] == "comma":
            parts.insert(0, node[2])
            node = node[1]
        paths = [_static_path(p) for p in [node, *parts]]
        if all(len(p) == 1 for p in paths):
            return record({p[0]: value.get(p[0]) for p in paths})
    if name == "IN" and len(args) == 1:
        items = array_of(args[0], value, scope)
        return Typed(F.coalesce(F.exists(items.column(), lambda x: x.eqNullSafe(value.column())), F.lit(False)), BOOLEAN)
    if name in ("test", "sub", "gsub", "capture", "match", "scan"):
        return by_pattern(name, args, value, scope)
    return binary_call(name, [scalar(a, value, scope) for a in args], args, value)


def by_key(value: Typed, key: Node, scope: Scope) -> Typed:
    """sort_by inside a row: a stable sort by (key, place)."""
    kind = value.type.elementType
    probe(key, kind, scope)
    keyed = F.transform(value.column(), lambda x, i: F.struct(scalar(key, Typed(x, kind), scope).column().alias("k"), i.alias("i"), x.alias("x")))
    return Typed(F.transform(F.sort_array(keyed), lambda s: s["x"]), value.type)


def by_pattern(name: str, args: tuple, value: Typed, scope: Scope) -> Typed:
    if not isinstance(value.type, T.StringType):
        raise NotNative(name)
    c, last = value.column(), len(args) - 1
    plain = 2 if name in ("sub", "gsub") else 1
    flags = const(args[last]) if len(args) > plain else ""
    pattern = java_regex(const(args[0]), flags)
    if name == "test":
        return Typed(F.coalesce(c.rlike(pattern), F.lit(False)), BOOLEAN)
    if name in ("sub", "gsub"):
        new = re.sub(r"([\\$])", r"\\\1", const(args[1]))
        if name == "gsub" or "g" in flags:
            return Typed(F.regexp_replace(c, pattern, new), STRING)
        return Typed(F.regexp_replace(c, f"(?s)^(.*?){pattern}", "$1" + new), STRING) if "(" not in pattern else _not(name)
    if name == "capture":
        names = re.findall(r"\(\?<([A-Za-z_]\w*)>", pattern)
        groups = re.findall(r"(?<!\\)\((?!\?[:imsx])", pattern)
        if not names or len(groups) != len(names):
            raise NotNative(name)
        return record({n: Typed(F.when(c.rlike(pattern), F.regexp_extract(c, pattern, i + 1)), STRING) for i, n in enumerate(names)})
    raise NotNative(name)


def _not(name: str):
    raise NotNative(name)


def binary_call(name: str, args: list[Typed], nodes: tuple, value: Typed) -> Typed:
    c, a = value.column(), args[0].column()
    texts = isinstance(value.type, T.StringType) and isinstance(args[0].type, T.StringType)
    if name == "startswith" and texts:
        return Typed(F.startswith(c, a), BOOLEAN)
    if name == "endswith" and texts:
        return Typed(F.endswith(c, a), BOOLEAN)
    if name == "ltrimstr" and texts:
        return Typed(F.when(F.startswith(c, a), F.substring(c, F.char_length(a) + 1, F.char_length(c))).otherwise(c), STRING)
    if name == "rtrimstr" and texts:
        return Typed(F.when(F.endswith(c, a), F.substring(c, F.lit(1), F.char_length(c) - F.char_length(a))).otherwise(c), STRING)
    if name == "split" and texts and len(args) == 1:
        return split_plain(value, args[0])
    if name == "splits" and texts and len(args) == 1:
        return Typed(F.split(c, java_regex(const(nodes[0]), ""), -1), T.ArrayType(STRING))
    if name == "join" and isinstance(value.type, T.ArrayType):
        element = value.type.elementType
        shown = F.transform(c, lambda x: F.coalesce(x if isinstance(element, T.StringType) else F.when(x.isNotNull(), text(Typed(x, element))), F.lit("")))
        return Typed(F.array_join(shown, const(nodes[0])), STRING)
    if name == "index" and texts:
        at = F.instr(c, const(nodes[0]))
        return Typed(F.when(at > 0, at - 1).cast("long"), LONG)
    if name == "rindex" and texts:
        back = F.instr(F.reverse(c), const(nodes[0])[::-1])
        return Typed(F.when(back > 0, F.char_length(c) - back - len(const(nodes[0])) + 1).cast("long"), LONG)
    if name == "indices" and texts:
        needle = const(nodes[0])
        places = F.when(F.char_length(c) > 0, F.sequence(F.lit(1), F.char_length(c))).otherwise(F.array().cast("array<int>"))
        return Typed(F.transform(F.filter(places, lambda i: F.substring(c, i, F.lit(len(needle))) == needle), lambda i: (i - 1).cast("long")), T.ArrayType(LONG))
    if name == "contains":
        if texts:
            return Typed(F.contains(c, a), BOOLEAN)
        if isinstance(value.type, T.ArrayType) and value.type == args[0].type and not isinstance(value.type.elementType, (T.StringType, T.ArrayType, T.StructType)):
            return Typed(F.forall(a, lambda y: F.coalesce(F.array_contains(c, y), F.lit(False))), BOOLEAN)
    if name == "pow" and is_number(args[0]) and is_number(args[1]):
        return Typed(F.pow(a, args[1].column()), DOUBLE)
    if name in ("atan2", "hypot") and is_number(args[0]):
        return Typed(getattr(F, name)(a, args[1].column()), DOUBLE)
    if name == "fma":
        return Typed(a.cast("double") * args[1].column() + args[2].column(), DOUBLE)
    if name == "scalb":
        return Typed(c.cast("double") * F.pow(F.lit(2.0), a), DOUBLE)
    if name in ("strftime", "strflocaltime"):
        return Typed(F.date_format(moment(value), date_pattern(const(nodes[0]))), STRING)
    if name == "flatten" and isinstance(value.type, T.ArrayType) and nodes[0][0] == "literal" and isinstance(nodes[0][1], int):
        out = value
        for _ in range(nodes[0][1]):
            out = UNARY["flatten"](out)
        return out
    if name == "nth" and isinstance(value.type, T.ArrayType):
        return Typed(F.get(c, a.cast("int")), value.type.elementType)
    raise NotNative(name)
