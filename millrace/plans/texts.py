"""Programs over JSON texts as Column expressions: field chains, filters, projections, lengths, iteration.

A document is parsed once into a variant, and a program becomes two columns: the array of its outputs as
compact JSON, and whether that is certain. Documents for which it isn't (malformed ones, repeated keys, an
index into a value of another type, numbers or escapes whose text could differ) keep their place and go to
the interpreter, which gives the same outputs for them, or the error. So the fast path is never asked to
raise errors, and what it can't express at all raises NotNative.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.lang.syntax import Node
from millrace.plans.typed import NotNative, Typed, const, java_regex, variant_as, variant_comparison, variant_rank

VARIANT = T.VariantType()
#: numbers that are shown as they are parsed: whole ones of up to 15 digits, short fractions without a last zero
PLAIN_NUMBER = r"^-?(?:(?:0|[1-9]\d{0,14})$|(?!0\.0000)(?:0|[1-9]\d{0,7})\.\d{0,6}[1-9]$)"
#: in a document: a number that may be shown in another way (or a string that looks like one)
ODD_NUMBER = r"(?:^|[:\[,])\s*-?(?:\d+\.?\d*[eE]|\d*\.\d*0(?!\d)|\d{16}|\d{8}\d+\.|\d*\.\d{8}|0\.0000|(?<=-)0(?![.\d]))"
MARK = "(the end of this document)"
MINUS_ZERO = r"-0(?![.\d])"


@dataclass(frozen=True)
class Value:
    """kind: doc (a variant; path: its place in the document, if fixed), string, number (double), boolean, json (text) or null."""

    kind: str
    col: Column | None = None
    path: str | None = None


@dataclass
class Sure:
    """What must hold for the native outputs to be the right ones."""

    root: Column
    checks: list[Column]

    def that(self, check: Column) -> None:
        self.checks.append(F.coalesce(check, F.lit(False)))

    def apart(self) -> Sure:
        return replace(self, checks=[])

    def all(self) -> Column:
        return reduce(lambda a, b: a & b, self.checks, F.lit(True))


def quoted(text: Column) -> Column:
    return F.regexp_extract(F.to_json(F.struct(text.alias("v"))), r'(?s)^\{"v":(.*)\}$', 1)


def fixed_number(c: Column, sure: Sure) -> Column:
    """The text of a double that is whole and not large."""
    whole = (c == F.floor(c)) & (F.abs(c) < 1e15) & ~((c == 0) & (F.lit(1.0) / F.when(c == 0, F.lit(1.0)).otherwise(c) < 0))
    sure.that(c.isNull() | whole)
    return F.coalesce(c.try_cast("long").cast("string"), F.lit("null"))


def shown(x: Value, sure: Sure) -> Column:
    """Compact JSON."""
    if x.kind == "null":
        return F.lit("null")
    if x.kind == "json":
        return F.coalesce(x.col, F.lit("null"))
    if x.kind == "string":
        return F.coalesce(quoted(x.col), F.lit("null"))
    if x.kind == "boolean":
        return F.coalesce(x.col.cast("string"), F.lit("null"))
    if x.kind == "number":
        return fixed_number(x.col, sure)
    kind, plain = variant_rank(x.col), F.to_json(x.col)
    sure.that((kind != 3) | (plain.rlike(PLAIN_NUMBER) & ((plain != "0") | ~sure.root.rlike(MINUS_ZERO))))
    text = F.when(kind == 0, "null").when(kind == 4, quoted(F.try_variant_get(x.col, "$", "string")))
    if x.path is None:  # members come in another order from a variant
        sure.that(kind < 5)
        return text.otherwise(plain)
    inner = F.get_json_object(sure.root, x.path)
    sure.that((kind < 5) | ~(sure.root.rlike(ODD_NUMBER) | F.contains(inner, F.lit("\\u"))))
    return text.when(kind >= 5, inner).otherwise(plain)


def truth(x: Value) -> Column:
    if x.kind == "doc":
        return (variant_rank(x.col) > 0) & F.coalesce(variant_as(x.col, 1), F.lit(True))
    if x.kind == "null":
        return F.lit(False)
    return F.coalesce(x.col, F.lit(False)) if x.kind == "boolean" else x.col.isNotNull()


def field(x: Value, name: str, sure: Sure) -> Value:
    if x.kind == "null":
        return x
    if x.kind != "doc" or "'" in name or "\\" in name:
        raise NotNative("field")
    step = f".{name}" if re.fullmatch(r"[A-Za-z_]\w*", name) else f"['{name}']"
    out = F.try_variant_get(x.col, f"${step}", "variant")
    # a value was found, so this is an object; else it must be an object without it, or null
    sure.that(out.isNotNull() | variant_rank(x.col).isin(0, 6))
    return Value("doc", out, None if x.path is None else x.path + step)


def item(x: Value, i: int, sure: Sure) -> Value:
    if x.kind != "doc" or i < 0:
        raise NotNative("index")
    out = F.try_variant_get(x.col, f"$[{i}]", "variant")
    sure.that(out.isNotNull() | variant_rank(x.col).isin(0, 5))
    return Value("doc", out, None if x.path is None else f"{x.path}[{i}]")


def text_of(x: Value, sure: Sure) -> Column:
    """The string; that it is one must be sure."""
    if x.kind == "string":
        return x.col
    if x.kind != "doc":
        raise NotNative("string")
    sure.that(variant_rank(x.col) == 4)
    return F.try_variant_get(x.col, "$", "string")


def number_of(x: Value, sure: Sure) -> Column:
    if x.kind == "number":
        return x.col
    if x.kind != "doc":
        raise NotNative("number")
    sure.that(variant_rank(x.col) == 3)
    out = F.try_variant_get(x.col, "$", "double")
    sure.that(F.abs(out) < 2.0**53)
    return out


def compared(op: str, a: Value, b: Value) -> Column:
    typed = {"string": T.StringType(), "number": T.DoubleType(), "boolean": T.BooleanType()}
    if a.kind == "doc" and b.kind in typed:
        return variant_comparison(op, Typed(a.col, VARIANT), Typed(b.col, typed[b.kind]))
    if b.kind == "doc" and a.kind in typed:
        return compared({"<": ">", ">": "<", "<=": ">=", ">=": "<="}.get(op, op), b, a)
    if "null" in (a.kind, b.kind) and op in ("==", "!="):
        other = b if a.kind == "null" else a
        empty = F.lit(True) if other.kind == "null" else variant_rank(other.col) == 0 if other.kind == "doc" else other.col.isNull()
        return empty if op == "==" else ~empty
    if a.kind == b.kind and a.kind in typed:
        x, y = a.col, b.col
        return {"==": x == y, "!=": x != y, "<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]
    raise NotNative("comparison")


def constant(value) -> Value:
    if value is None:
        return Value("null")
    if isinstance(value, bool):
        return Value("boolean", F.lit(value))
    if isinstance(value, (int, float)) and abs(value) < 2**53:
        return Value("number", F.lit(float(value)))
    if isinstance(value, str):
        return Value("string", F.lit(value))
    raise NotNative("literal")


def single(node: Node, x: Value, sure: Sure, vars: dict[str, Value]) -> Value:
    """A program with exactly one output."""
    kind = node[0]
    if kind == "identity":
        return x
    if kind == "literal":
        return constant(node[1])
    if kind == "var" and node[1] in vars:
        return vars[node[1]]
    if kind == "pipe":
        return single(node[2], single(node[1], x, sure, vars), sure, vars)
    if kind == "index":
        target, key = single(node[1], x, sure, vars), node[2]
        if key[0] == "literal" and isinstance(key[1], str):
            return field(target, key[1], sure)
        if key[0] == "literal" and isinstance(key[1], int) and not isinstance(key[1], bool):
            return item(target, key[1], sure)
        raise NotNative("index")
    if kind == "object":
        parts = []
        for key, value in node[1]:
            if key[0] != "literal" or not isinstance(key[1], str) or not re.fullmatch(r"[\w .:/-]*", key[1], re.ASCII):
                raise NotNative("key")
            parts.append((key[1], single(value, x, sure, vars)))
        if len({k for k, _ in parts}) < len(parts):
            raise NotNative("repeated keys")
        pieces = [p for n, (k, v) in enumerate(parts) for p in (F.lit(("," if n else "{") + f'"{k}":'), shown(v, sure))]
        return Value("json", F.concat(*pieces, F.lit("}")) if parts else F.lit("{}"))
    if kind == "array":
        outs = many(node[1], x, sure, vars) if node[1] is not None else F.array().cast("array<string>")
        return Value("json", F.concat(F.lit("["), F.array_join(outs, ","), F.lit("]")))
    if kind in ("and", "or"):
        a, b = truth(single(node[1], x, sure, vars)), truth(single(node[2], x, sure, vars))
        return Value("boolean", a & b if kind == "and" else a | b)
    if kind == "binary":
        a, b = single(node[2], x, sure, vars), single(node[3], x, sure, vars)
        if node[1] in ("+", "-", "*"):
            if "string" in (a.kind, b.kind) and node[1] == "+":
                return Value("string", F.concat(text_of(a, sure), text_of(b, sure)))
            p, q = number_of(a, sure), number_of(b, sure)
            return Value("number", {"+": p + q, "-": p - q, "*": p * q}[node[1]])
        if node[1] in ("/", "%"):
            raise NotNative("division")
        return Value("boolean", F.coalesce(compared(node[1], a, b), F.lit(False)))
    if kind == "bind" and len(node[2]) == 1 and node[2][0][0] == "var":
        return single(node[3], x, sure, {**vars, node[2][0][1]: single(node[1], x, sure, vars)})
    if kind == "alt":
        a, b = single(node[1], x, sure, vars), single(node[2], x, sure, vars)
        return Value("json", F.when(truth(a), shown(a, sure)).otherwise(shown(b, sure)))
    if kind == "if":
        test = truth(single(node[1], x, sure, vars))
        a, b = single(node[2], x, sure, vars), single(node[3], x, sure, vars)
        return Value("json", F.when(test, shown(a, sure)).otherwise(shown(b, sure)))
    if kind == "call":
        return called(node[1], node[2], x, sure, vars)
    raise NotNative(kind)


def called(name: str, args: tuple, x: Value, sure: Sure, vars: dict[str, Value]) -> Value:
    if name == "not" and not args:
        return Value("boolean", ~truth(x))
    if name in ("test", "startswith", "endswith", "contains") and args:
        if not (args[0][0] == "literal" and isinstance(args[0][1], str)):
            raise NotNative(name)
        text = text_of(x, sure)
        if name == "test":
            return Value("boolean", text.rlike(java_regex(const(args[0]), const(args[1]) if len(args) > 1 else "")))
        return Value("boolean", {"startswith": F.startswith, "endswith": F.endswith, "contains": F.contains}[name](text, F.lit(args[0][1])))
    if name in ("ascii_downcase", "ascii_upcase") and not args:
        small, large = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
        return Value("string", F.translate(text_of(x, sure), *((large, small) if name == "ascii_downcase" else (small, large))))
    if name == "tostring" and not args and x.kind == "doc":
        kind = variant_rank(x.col)
        return Value("string", F.when(kind == 4, F.try_variant_get(x.col, "$", "string")).otherwise(shown(x, sure)))
    if name == "tojson" and not args:
        return Value("string", shown(x, sure))
    if name == "has" and len(args) == 1 and args[0][0] == "literal" and isinstance(args[0][1], str) and x.kind == "doc":
        inside = field(x, args[0][1], sure)
        sure.that(variant_rank(x.col) == 6)
        return Value("boolean", inside.col.isNotNull())
    if args or x.kind != "doc":
        if name == "length" and not args and x.kind == "string":
            return Value("number", F.char_length(x.col).cast("double"))
        if name == "map" and len(args) == 1 and x.kind == "doc":
            return single(("array", ("pipe", ("each", ("identity",)), args[0])), x, sure, vars)
        raise NotNative(name)
    kind = variant_rank(x.col)
    if name == "type":
        names = ("null", "boolean", "boolean", "number", "string", "array", "object")
        return Value("string", F.element_at(F.array(*[F.lit(n) for n in names]), kind + 1))
    items, members = F.try_variant_get(x.col, "$", "array<variant>"), F.try_variant_get(x.col, "$", "map<string,variant>")
    if name == "length":
        sure.that(kind.isin(0, 4, 5, 6))
        of = F.when(kind == 4, F.char_length(F.try_variant_get(x.col, "$", "string"))).when(kind == 5, F.size(items)).when(kind == 6, F.size(members)).otherwise(0)
        return Value("number", of.cast("double"))
    if name == "keys":
        sure.that(kind == 6)
        return Value("json", F.to_json(F.sort_array(F.map_keys(members))))
    raise NotNative(name)


def many(node: Node, x: Value, sure: Sure, vars: dict[str, Value]) -> Column:
    """All outputs of a program, as an array of JSON texts."""
    none = F.array().cast("array<string>")
    kind = node[0]
    if kind == "call" and node[1] == "empty":
        return none
    if kind == "comma":
        return F.concat(many(node[1], x, sure, vars), many(node[2], x, sure, vars))
    steps = _steps(node)
    for at, s in enumerate(steps):
        before = steps[:at]
        if s[0] == "call" and s[1] == "select" and len(s[2]) == 1:
            x = single(_joined(before), x, sure, vars)
            passes = truth(single(s[2][0], x, sure, vars))
            inner = sure.apart()
            outs = many(_joined(steps[at + 1 :]), x, inner, vars)
            sure.that(~passes | inner.all())
            return F.when(passes, outs).otherwise(none)
        if s == ("each", ("identity",)):
            x = single(_joined(before), x, sure, vars)
            if x.kind != "doc":
                raise NotNative("iteration")
            items = F.try_variant_get(x.col, "$", "array<variant>")
            sure.that(variant_rank(x.col) == 5)
            rest = _joined(steps[at + 1 :])
            probe = sure.apart()

            def certain(e: Column) -> Column:
                own = sure.apart()
                many(rest, Value("doc", e), own, vars)
                return own.all()

            many(rest, Value("doc", x.col), probe, vars)
            sure.that(F.forall(items, certain))
            return F.flatten(F.transform(items, lambda e: many(rest, Value("doc", e), sure.apart(), vars)))
        if s[0] == "bind" and len(s[2]) == 1 and s[2][0][0] == "var":
            x = single(_joined(before), x, sure, vars)
            if any(_generates(n) for n in (s[3],)):
                return many(_joined([s[3], *steps[at + 1 :]]), x, sure, {**vars, s[2][0][1]: single(s[1], x, sure, vars)})
        if s[0] == "comma" and before:
            return many(s, single(_joined(before), x, sure, vars), sure, vars) if at + 1 == len(steps) else _not()
    return F.array(shown(single(node, x, sure, vars), sure))


def _not():
    raise NotNative("generator")


def _generates(node: Node) -> bool:
    return isinstance(node, tuple) and (node[:1] in (("each",), ("comma",)) or node[:2] in (("call", "select"), ("call", "empty")) or any(_generates(n) for n in node if isinstance(n, tuple)))


def _steps(node: Node) -> list[Node]:
    """The stages of a pipe; .a[].b is .a | .[] | .b."""
    if node[0] == "pipe":
        return [*_steps(node[1]), *_steps(node[2])]
    if node[0] == "each" and node[1] != ("identity",):
        return [*_steps(node[1]), ("each", ("identity",))]
    if node[0] == "index" and _generates(node[1]):
        return [*_steps(node[1]), ("index", ("identity",), node[2])]
    return [node]


def _joined(steps: list[Node]) -> Node:
    if not steps:
        return ("identity",)
    return steps[0] if len(steps) == 1 else ("pipe", steps[0], _joined(steps[1:]))


def compiled(docs: DataFrame, tree: Node, variables: dict | None = None) -> DataFrame:
    """(file, place, doc, outs array<string>, sure boolean) of documents (file, place, doc)."""
    # a parser stops after the first value of a text; inside an array, before a mark, a text must be one value
    whole = F.try_parse_json(F.concat(F.lit("["), F.col("doc"), F.lit(f',"{MARK}"]')))
    parsed = docs.select("file", "place", "doc", whole.alias("w")).withColumn("v", F.try_variant_get("w", "$[0]", "variant"))
    alone = (F.try_variant_get("w", "$[1]", "string") == MARK) & F.try_variant_get("w", "$[2]", "variant").isNull()
    sure = Sure(F.col("doc"), [F.coalesce(alone, F.lit(False)), ~F.contains("doc", F.lit("\\u")), ~F.contains("doc", F.lit("\x7f"))])
    scalars = {k: constant(v) for k, v in (variables or {}).items() if v is None or isinstance(v, (bool, str)) or (isinstance(v, (int, float)) and abs(v) < 2**53)}
    outs = many(tree, Value("doc", F.col("v"), "$"), sure, scalars)
    return parsed.select("file", "place", "doc", outs.alias("outs"), sure.all().alias("sure"))


def native_outputs(done: DataFrame) -> DataFrame:
    """(file, place, turn, value, error) of what is sure; a generator keeps the filter from being pushed below the parsing."""
    outs = F.when(F.col("sure"), F.col("outs")).otherwise(F.array().cast("array<string>"))
    return done.select("file", "place", F.posexplode(outs).alias("turn", "value")).withColumn("error", F.lit(None).cast("string"))


def others(done: DataFrame) -> DataFrame:
    """(file, place, doc) of the documents that need the interpreter."""
    return done.select("file", "place", F.explode(F.when(F.col("sure"), F.array().cast("array<string>")).otherwise(F.array("doc"))).alias("doc"))
