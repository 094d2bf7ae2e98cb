"""Programs over whole tables: generators, filters, groups, joins, sorts and running states as DataFrame operations.

Two readings of ``.``: a row (Rows: the program runs once for every row), or the array of all rows
(Whole: what ``--slurp`` or ``[inputs]`` gives). Whole tables are never gathered: ``group_by(k) |
map({...})`` is an aggregation, ``sort_by(k) | .[:n]`` a top-n, ``INDEX`` with ``JOIN`` a left join,
``select(IN(...))`` a semi-join, ``foreach`` with a running sum a window.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from millrace.lang.syntax import Node
from millrace.plans.typed import BOOLEAN, DOUBLE, LONG, NUMBERS, WHOLE, NotNative, Scope, Typed, bound, condition, const, is_number, java_regex, literal, record, scalar, stages, truth


#: columns to sort by, each with True if ascending
Order = tuple[tuple[Column, bool], ...]


@dataclass(frozen=True)
class Rows:
    """One value of the program for every row of df."""

    df: DataFrame
    value: Typed
    scope: Scope


@dataclass(frozen=True)
class Whole:
    """The array of all values of rows, in the order of ``order`` (empty: the order doesn't matter)."""

    rows: Rows
    order: Order = ()
    tables: dict[str, DataFrame] | None = None


def of_table(df: DataFrame, variables: dict | None = None) -> Rows:
    fields = {f.name: F.col(f"`{f.name}`") for f in df.schema.fields}
    scope = Scope({k: literal(v) for k, v in (variables or {}).items()})
    return Rows(df, Typed(None, df.schema, fields), scope)


def fixed(rows: Rows) -> Rows:
    """The value as a column of its own, so that later steps see plain attributes."""
    if rows.value.fields is not None:
        df = rows.df.select(*[c.alias(k) for k, c in rows.value.fields.items()], *_kept(rows))
        return Rows(df, Typed(None, rows.value.type, {k: F.col(f"`{k}`") for k in rows.value.fields}), _rescope(rows))
    df = rows.df.select(rows.value.column().alias("value"), *_kept(rows))
    return Rows(df, Typed(F.col("value"), rows.value.type), _rescope(rows))


def _kept(rows: Rows) -> list[Column]:
    return [t.column().alias(f"$${k}") for k, t in rows.scope.vars.items()]


def _rescope(rows: Rows) -> Scope:
    return replace(rows.scope, vars={k: Typed(F.col(f"`$${k}`"), t.type) for k, t in rows.scope.vars.items()})


def result(rows: Rows) -> DataFrame:
    """Columns of an object, or one column named value."""
    if isinstance(rows.value.type, T.StructType):
        fields = rows.value.fields or {n: rows.value.col.getField(n) for n in rows.value.type.names}
        return rows.df.select(*[_shown(c, rows.value.type[k].dataType).alias(k) for k, c in fields.items()])
    return rows.df.select(_shown(rows.value.column(), rows.value.type).alias("value"))


def _shown(c: Column, kind: T.DataType) -> Column:
    """JSON values leave as text."""
    return F.to_json(c) if isinstance(kind, T.VariantType) else c


def _explode(rows: Rows, items: Column, kind: T.DataType) -> Rows:
    names = [c for c in rows.df.columns if c != "$each" and c.removeprefix("$$") not in rows.scope.vars]
    df = rows.df.select(*[F.col(f"`{c}`") for c in names], *_kept(rows), F.explode(items).alias("$each"))
    return Rows(df, Typed(F.col("`$each`"), kind), _rescope(rows))


def step(rows: Rows, node: Node) -> Rows:
    """One stage of a pipe over rows; may filter, multiply or change the value."""
    kind = node[0]
    if kind == "pipe":
        return step(step(rows, node[1]), node[2])
    if kind == "call" and node[1] == "select" and len(node[2]) == 1:
        return replace(rows, df=rows.df.filter(condition(node[2][0], rows.value, rows.scope)))
    if kind == "call" and node[1] == "empty":
        return replace(rows, df=rows.df.filter(F.lit(False)))
    if kind == "call" and node[1] in ("values", "scalars", "numbers", "strings", "booleans", "arrays", "objects", "nulls", "iterables") and not node[2]:
        return _selected(rows, node[1])
    if kind == "call" and node[1] == "splits":
        pieces = F.split(rows.value.column(), java_regex(const(node[2][0]), ""), -1)
        return _explode(rows, pieces, T.StringType())
    if kind == "call" and node[1] == "scan" and len(node[2]) == 1:
        pattern = java_regex(const(node[2][0]), "")
        if "(" in pattern.replace("\\(", ""):
            raise NotNative("scan with groups")
        return _explode(rows, F.regexp_extract_all(rows.value.column(), F.lit(pattern), F.lit(0)), T.StringType())
    if kind == "call" and node[1] == "range":
        items = scalar(("array", node), rows.value, rows.scope)
        return _explode(rows, items.column(), LONG)
    if kind == "call" and node[1] == "combinations" and not node[2] and isinstance(rows.value.type, T.ArrayType):
        raise NotNative("combinations")
    if kind == "each":
        inner = step(rows, node[1])
        if not isinstance(inner.value.type, T.ArrayType):
            raise NotNative("only arrays are iterated natively")
        return _explode(inner, inner.value.column(), inner.value.type.elementType)
    if kind in ("index", "slice") and _multiplies(node[1]):
        inner = step(rows, node[1])
        return replace(inner, value=scalar((kind, ("identity",), *node[2:]), inner.value, inner.scope))
    if kind == "comma":
        items = scalar(("array", node), rows.value, rows.scope)
        return _explode(rows, items.column(), items.type.elementType)
    if kind == "bind" and len(node[2]) == 1:
        if _multiplies(node[1]):
            inner = step(rows, node[1])
            if rows.value.fields is None:
                raise NotNative("binding of a generator")  # the input would be lost
            return step(Rows(inner.df, rows.value, bound(node[2][0], inner.value, inner.scope)), node[3])
        return step(replace(rows, scope=bound(node[2][0], scalar(node[1], rows.value, rows.scope), rows.scope)), node[3])
    if kind == "if" and node[3] == ("call", "empty", ()):
        return step(replace(rows, df=rows.df.filter(condition(node[1], rows.value, rows.scope))), node[2])
    if kind == "def":
        return step(replace(rows, scope=replace(rows.scope, defs={**rows.scope.defs, (node[1], len(node[2])): (node[2], node[3], rows.scope)})), node[4])
    return replace(rows, value=scalar(node, rows.value, rows.scope))


def _multiplies(node: Node) -> bool:
    if not isinstance(node, tuple) or not node:
        return False
    if node[0] in ("each", "comma") or (node[0] == "call" and node[1] in ("range", "splits", "scan", "recurse", "select", "empty")):
        return True
    return node[0] in ("index", "slice", "pipe") and any(_multiplies(x) for x in node[1:] if isinstance(x, tuple))


def _selected(rows: Rows, name: str) -> Rows:
    t, col = rows.value.type, rows.value.column()
    kinds = {"numbers": NUMBERS, "strings": (T.StringType,), "booleans": (T.BooleanType,), "arrays": (T.ArrayType,), "objects": (T.StructType, T.MapType), "iterables": (T.ArrayType, T.StructType, T.MapType)}
    if name == "values":
        keep = col.isNotNull()
    elif name == "nulls":
        keep = col.isNull()
    elif name == "scalars":
        keep = F.lit(True) if not isinstance(t, kinds["iterables"]) else col.isNull()
    else:
        keep = col.isNotNull() if isinstance(t, kinds[name]) else F.lit(False)
    return replace(rows, df=rows.df.filter(keep))


def per_row(df: DataFrame, tree: Node, variables: dict | None = None) -> DataFrame:
    return result(step(of_table(df, variables), tree))


# the whole table as one array
def aggregate(node: Node, rows: Rows, keys: dict[str, tuple[Node, Column]], order: Order) -> Typed:
    """The value of a program over the array of a group's rows, as an aggregate Column."""
    steps = stages(node)
    value, scope = rows.value, rows.scope
    for col_node, col in keys.values():
        # .[0].k and .[0] | k, for a key k
        if steps[0] == ("index", ("identity",), ("literal", 0)) and len(steps) > 1 and _joined(steps[1:]) == col_node:
            return Typed(col, scalar(col_node, value, scope).type)
        if len(steps) == 1 and _from_first(steps[0]) == col_node:
            return Typed(col, scalar(col_node, value, scope).type)
    if node == ("call", "length", ()):
        return Typed(F.count(F.lit(1)), LONG)
    if node[0] == "literal":
        return literal(node[1])
    if node[0] == "binary" and node[1] in ("+", "-", "*", "/", "%"):
        from millrace.plans.typed import arithmetic

        return arithmetic(node[1], aggregate(node[2], rows, keys, order), aggregate(node[3], rows, keys, order))
    if node[0] == "object":
        return record({k[1]: aggregate(v, rows, keys, order) for k, v in node[1]})
    if node[0] == "index" and node[2][0] == "literal" and isinstance(node[2][1], str):
        inner = node[1]
        if inner[0] == "call" and inner[1] in ("min_by", "max_by"):
            return _extreme(inner, ("index", ("identity",), node[2]), rows)
    if len(steps) == 2 and steps[0][0] == "call" and steps[0][1] in ("min_by", "max_by"):
        return _extreme(steps[0], steps[1], rows)
    if len(steps) >= 2 and steps[0][0] == "call" and steps[0][1] == "sort_by" and steps[1] in (("call", "last", ()), ("call", "first", ())):
        which = ("call", "max_by" if steps[1][1] == "last" else "min_by", steps[0][2])
        return _extreme(which, _joined(steps[2:]), rows)
    if node[0] == "call" and node[1] in ("any", "all") and len(node[2]) == 1:
        test = truth(scalar(node[2][0], value, scope))
        return Typed(F.coalesce((F.bool_or if node[1] == "any" else F.bool_and)(test), F.lit(node[1] == "all")), BOOLEAN)
    if node[0] == "call" and node[1] == "add" and len(node[2]) == 1:
        steps = [("array", node[2][0]), ("call", "add", ())]
    item, test = mapped(steps[0], value, scope)
    if item is not None and len(steps) > 1:
        return _folded(steps[1:], item, test)
    if item is not None and len(steps) == 1:
        return Typed(_unboxed(F.collect_list(_boxed(item.column(), test))), T.ArrayType(item.type))
    raise NotNative("aggregate")


def _from_first(node: Node) -> Node | None:
    """k of .[0].k"""
    if node[0] == "index" and node[2][0] == "literal" and isinstance(node[2][1], str):
        if node[1] == ("index", ("identity",), ("literal", 0)):
            return ("index", ("identity",), node[2])
        inner = _from_first(node[1])
        return None if inner is None else ("index", inner, node[2])
    return None


def _joined(steps: list[Node]) -> Node:
    if not steps:
        return ("identity",)
    return steps[0] if len(steps) == 1 else ("pipe", steps[0], _joined(steps[1:]))


def mapped(node: Node, value: Typed, scope: Scope) -> tuple[Typed | None, Column | None]:
    """map(f) or [.[] | f]: the item, and the condition under which it counts."""
    if node[0] == "call" and node[1] == "map":
        steps = stages(node[2][0])
    elif node[0] == "array" and node[1] is not None:
        first, *rest = stages(node[1])
        tail = []
        while first[0] == "index":
            tail.insert(0, ("index", ("identity",), first[2]))
            first = first[1]
        if first != ("each", ("identity",)):
            return None, None
        steps = [*tail, *rest]
    else:
        return None, None
    test = None
    for s in steps:
        if s[0] == "call" and s[1] == "select":
            more = truth(scalar(s[2][0], value, scope))
            test = more if test is None else test & more
        elif s == ("call", "values", ()):
            more = value.column().isNotNull()
            test = more if test is None else test & more
        else:
            value = scalar(s, value, scope)
    return value, test


def _folded(steps: list[Node], item: Typed, test: Column | None) -> Typed:
    col = item.column() if test is None else F.when(test, item.column())
    names = [s[1] if s[0] == "call" and not s[2] else None for s in steps]
    if names == ["add"]:
        if is_number(item):
            return Typed(F.sum(col.cast("long" if isinstance(item.type, WHOLE) else "double")), LONG if isinstance(item.type, WHOLE) else DOUBLE)
        raise NotNative("add of other values depends on the order of rows")
    if names == ["length"]:
        return Typed(F.count(F.lit(1)) if test is None else F.count_if(test), LONG)
    if names in (["min"], ["max"]):
        # null is the least value; Spark's aggregates pass over it, which only suits max
        return Typed(F.max(col) if names == ["max"] else F.when(~F.coalesce(F.bool_or(_is_null(item, test)), F.lit(False)), F.min(col)), item.type)
    if names == ["unique", "length"]:
        return Typed(F.count_distinct(col) + F.coalesce(F.bool_or(_is_null(item, test)), F.lit(False)).cast("long"), LONG)
    if names in (["unique"], ["sort"]):
        gather = F.collect_set if names == ["unique"] else F.collect_list
        return Typed(_unboxed(F.sort_array(gather(_boxed(item.column(), test)))), T.ArrayType(item.type))
    if names in (["any"], ["all"]):
        t = truth(item) if test is None else F.when(test, truth(item))
        return Typed(F.coalesce((F.bool_or if names == ["any"] else F.bool_and)(t), F.lit(names == ["all"])), BOOLEAN)
    raise NotNative("fold")


def _is_null(item: Typed, test: Column | None) -> Column:
    return item.column().isNull() if test is None else test & item.column().isNull()


def _boxed(col: Column, test: Column | None) -> Column:
    """In a struct of its own a null is gathered like any other value."""
    box = F.struct(col.alias("v"))
    return box if test is None else F.when(test, box)


def _unboxed(boxes: Column) -> Column:
    return F.transform(boxes, lambda x: x["v"])


def _extreme(call: Node, then: Node, rows: Rows) -> Typed:
    """min_by and max_by: a null key is the least; Spark passes over such rows."""
    key = scalar(call[2][0], rows.value, rows.scope).column()
    out = scalar(then, rows.value, rows.scope)
    if call[1] == "max_by":
        return Typed(F.when(F.count(key) == 0, F.first(out.column())).otherwise(F.max_by(out.column(), key)), out.type)
    least = F.first(F.when(key.isNull(), out.column()), ignorenulls=True)
    return Typed(F.when(F.bool_or(key.isNull()), least).otherwise(F.min_by(out.column(), key)), out.type)


def _keys(node: Node) -> list[Node]:
    """The parts of a key: group_by(.a, .b) and group_by([.a, .b])."""
    if node[0] == "array" and node[1] is not None:
        return _keys(node[1])
    return [*_keys(node[1]), node[2]] if node[0] == "comma" else [node]


def sort_keys(node: Node, rows: Rows) -> Order:
    """Ascending keys, nulls first; -k sorts a number downwards."""
    out = []
    for k in _keys(node):
        if k[0] == "negate":
            inner = scalar(k[1], rows.value, rows.scope)
            if not is_number(inner):
                raise NotNative("negated key")
            out.append((inner.column(), False))
        else:
            out.append((scalar(k, rows.value, rows.scope).column(), True))
    return tuple(out)


def whole(df: DataFrame, tree: Node, variables: dict | None = None, tables: dict[str, DataFrame] | None = None, order: tuple[str, ...] = ()) -> DataFrame:
    """The result of a program whose input is the array of df's rows. order names columns that give the rows' order, where the program needs one."""
    return finish(run_whole(Whole(of_table(df, variables), tuple((F.col(f"`{c}`"), True) for c in order), tables or {}), stages(tree)))


def finish(done: Whole | Rows) -> DataFrame:
    if isinstance(done, Whole):
        out = done.rows
        return result(replace(out, df=out.df.orderBy(*sorting(done.order))) if done.order else out)
    return result(done)


def run_whole(w: Whole, steps: list[Node]) -> Whole | Rows:
    if not steps:
        return w
    node, rest = steps[0], steps[1:]
    rows = w.rows
    if node[0] == "each" and node[1] == ("identity",):
        # rows from here on
        out = rows
        for s in rest:
            out = joined_or_step(out, s, w)
        return out
    if node[0] == "array" and node[1] is not None:
        first, *inner = stages(node[1])
        if first == ("each", ("identity",)):
            return run_whole(replace(w, rows=_through(w, inner), order=_after(w, inner)), rest)
        if first[0] == "foreach":
            return run_whole(running(w, first, inner), rest)
        if first[0] == "bind" and first[1] == ("each", ("identity",)):
            return run_whole(replace(w, rows=_with_each(w, first, inner), order=()), rest)
        if first[0] in ("index", "slice", "each"):
            tail = []
            while first[0] in ("index", "slice", "each") and first != ("each", ("identity",)):
                tail.insert(0, (first[0], ("identity",), *first[2:]))
                first = first[1]
            if first == ("each", ("identity",)):
                return run_whole(replace(w, rows=_through(w, [*tail, *inner]), order=()), rest)
    if node[0] == "foreach":
        return joined_rest(running(w, node, []), rest)
    if node[0] == "bind" and node[1] == ("each", ("identity",)):
        return _with_each(w, node, rest)
    if node[0] == "binary" and node[1] in ("+", "-") and (both := _two_tables(w, node)):
        return run_whole(replace(w, rows=both, order=()), rest)
    if node[0] == "reduce":
        return reduced(w, node, rest)
    if node[0] == "slice" and node[1] == ("identity",):
        return run_whole(_cut(w, node), rest)
    if node[0] == "index" and node[1] == ("identity",) and node[2][0] == "literal" and isinstance(node[2][1], int):
        i = node[2][1]
        if not w.order:
            raise NotNative("rows have no order")
        df = rows.df.orderBy(*sorting(w.order)).offset(i).limit(1) if i >= 0 else rows.df.orderBy(*sorting(_backwards(w.order))).offset(-i - 1).limit(1)
        return _row_steps(replace(rows, df=df), rest)
    if node[0] == "call":
        return _call(w, node[1], node[2], rest)
    if node[0] in ("object", "binary", "pipe", "alt"):
        return _row_steps(_aggregated(w, _joined([node])), rest)
    if node == ("identity",):
        return run_whole(w, rest)
    raise NotNative(node[0])


@dataclass(frozen=True)
class Elsewhere(Typed):
    """The array itself, where a program goes over its rows by name; only the names may be used."""

    def column(self) -> Column:
        raise NotNative("the whole table beside its rows")

    def get(self, name: str) -> Typed:
        raise NotNative("the whole table beside its rows")


def _with_each(w: Whole, node: Node, rest: list[Node]) -> Rows:
    """.[] as $x | ...: names instead of the value; $t[] as $y joins another table, on what the selects after it say."""
    if len(node[2]) != 1:
        raise NotNative("alternative patterns")
    out = Rows(w.rows.df, Elsewhere(None, T.NullType()), bound(node[2][0], w.rows.value, w.rows.scope))
    steps = [*stages(node[3]), *rest]
    while steps and steps[0][0] == "bind" and len(steps[0][2]) == 1 and steps[0][1][0] == "each" and steps[0][1][1][0] == "var" and steps[0][1][1][1] in (w.tables or {}):
        _, source, patterns, body = steps[0]
        other = w.tables[source[1][1]]
        name = f"$with{len(out.df.columns)}"
        df = out.df.crossJoin(other.select(F.struct(*[F.col(f"`{c}`") for c in other.columns]).alias(name)))
        out = Rows(df, out.value, bound(patterns[0], Typed(F.col(f"`{name}`"), other.schema), out.scope))
        steps = [*stages(body), *steps[1:]]
    for s in steps:
        out = step(out, s)
    return out


def _two_tables(w: Whole, node: Node) -> Rows | None:
    """. + $t and . - $t for tables of the same columns: all rows, and the rows that t doesn't hold."""

    def side(n: Node) -> Rows | None:
        return w.rows if n == ("identity",) else of_table(w.tables[n[1]]) if n[0] == "var" and n[1] in (w.tables or {}) else None

    a, b = side(node[2]), side(node[3])
    if a is None or b is None:
        return None
    a, b = fixed(a), fixed(b)
    kinds = [{f.name: f.dataType for f in t.df.schema.fields} for t in (a, b)]
    if kinds[0] != kinds[1]:
        raise NotNative("tables of different columns")
    if node[1] == "+":
        return replace(a, df=a.df.unionByName(b.df))
    named = b.df.select(F.struct(*[F.col(f"`{c}`") for c in a.df.columns]).alias("$row")).distinct()
    same = [F.col(f"`{c}`").eqNullSafe(F.col("`$row`").getField(c)) for c in a.df.columns]
    return replace(a, df=a.df.join(named, same, "left_anti"))


def joined_rest(out: Whole, rest: list[Node]) -> Rows:
    return _row_steps(replace(out.rows, df=out.rows.df.orderBy(*sorting(out.order))) if out.order else out.rows, rest)


def _row_steps(rows: Rows, rest: list[Node]) -> Rows:
    for s in rest:
        rows = step(rows, s)
    return rows


def _through(w: Whole, inner: list[Node]) -> Rows:
    out = w.rows
    for s in inner:
        out = joined_or_step(out, s, w)
    return out


def _after(w: Whole, inner: list[Node]) -> Order:
    """Filters keep the order; other steps lose what the order refers to."""
    return w.order if all(s[0] == "call" and s[1] == "select" for s in inner) else ()


def joined_or_step(rows: Rows, node: Node, w: Whole) -> Rows:
    """select(IN($t[] | f)) and its negation as semi- and anti-joins; else an ordinary step."""
    if node[0] == "call" and node[1] == "select":
        test, negated = node[2][0], False
        if test[0] == "pipe" and test[2] == ("call", "not", ()):
            test, negated = test[1], True
        probe = ("identity",)
        if test[0] == "pipe" and test[2][0] == "call" and test[2][1] == "IN":
            probe, test = test[1], test[2]
        if test[0] == "call" and test[1] == "IN" and len(test[2]) == 2:
            probe, test = test[2][0], ("call", "IN", (test[2][1],))
        if test[0] == "call" and test[1] == "IN" and (found := _other(test[2][0], w)):
            other, key = found
            left = scalar(probe, rows.value, rows.scope).column()
            right = other.df.select(scalar(key, other.value, other.scope).column().alias("$key"))
            return replace(rows, df=rows.df.join(right, left.eqNullSafe(right["`$key`"]), "left_anti" if negated else "left_semi"))
    return step(rows, node)


def _other(node: Node, w: Whole) -> tuple[Rows, Node] | None:
    """($t[] | f) for a table t."""
    first, *rest = stages(node)
    tail = []
    while first[0] == "index":
        tail.insert(0, ("index", ("identity",), first[2]))
        first = first[1]
    if first[0] == "each" and first[1][0] == "var" and first[1][1] in (w.tables or {}):
        return of_table(w.tables[first[1][1]]), _joined([*tail, *rest])
    return None


def _backwards(order: Order) -> Order:
    return tuple((c, not up) for c, up in order)


def sorting(order: Order) -> list[Column]:
    """Null is the least value."""
    return [F.asc_nulls_first(c) if up else F.desc_nulls_last(c) for c, up in order]


def _cut(w: Whole, node: Node) -> Whole:
    """.[a:b] of a sorted table, for non-negative literal bounds."""
    bounds = [n[1] if n and n[0] == "literal" else None if n is None else NotNative for n in node[2:]]
    if NotNative in bounds or any(b is not None and (not isinstance(b, int) or b < 0) for b in bounds):
        raise NotNative("slice bounds of a table")
    if not w.order:
        raise NotNative("rows have no order")
    df = w.rows.df.orderBy(*sorting(w.order))
    if bounds[0]:
        df = df.offset(bounds[0])
    if bounds[1] is not None:
        df = df.limit(bounds[1] - (bounds[0] or 0))
    return replace(w, rows=replace(w.rows, df=df))


def _aggregated(w: Whole, node: Node) -> Rows:
    out = aggregate(node, w.rows, {}, w.order)
    if out.fields is not None:
        df = w.rows.df.agg(*[c.alias(k) for k, c in out.fields.items()])
        return Rows(df, Typed(None, out.type, {k: F.col(f"`{k}`") for k in out.fields}), Scope())
    return Rows(w.rows.df.agg(out.column().alias("value")), Typed(F.col("value"), out.type), Scope())


def _call(w: Whole, name: str, args: tuple, rest: list[Node]) -> Whole | Rows:
    rows = w.rows
    if name == "group_by":
        return grouped(w, args[0], rest)
    if name in ("map", "map_values"):
        inner = stages(args[0])
        following = [s for s in rest]
        if following and following[0] in (("call", "add", ()), ("call", "min", ()), ("call", "max", ()), ("call", "length", ()), ("call", "any", ()), ("call", "all", ())):
            try:
                return _row_steps(_aggregated(w, ("pipe", ("call", "map", args), following[0])), following[1:])
            except NotNative:
                pass
        return run_whole(replace(w, rows=_through(w, inner), order=_after(w, inner)), rest)
    if name == "sort_by":
        return run_whole(replace(w, order=(*sort_keys(args[0], rows), *w.order)), rest)
    if name == "sort" and rows.value.fields is None:
        return run_whole(replace(w, order=((rows.value.column(), True),)), rest)
    if name == "reverse" and w.order:
        return run_whole(replace(w, order=tuple(_backwards(w.order))), rest)
    if name in ("first", "last") and not args and w.order:
        order = w.order if name == "first" else _backwards(w.order)
        return _row_steps(replace(rows, df=rows.df.orderBy(*sorting(order)).limit(1)), rest)
    if name in ("min_by", "max_by"):
        out = _extreme(("call", name, args), ("identity",), rows)
        df = rows.df.agg(out.column().alias("value"))
        return _row_steps(Rows(df, Typed(F.col("value"), out.type), Scope()), rest)
    if name == "unique":
        one = fixed(rows)
        df = one.df.distinct()
        order = tuple((c, True) for c in (one.value.fields or {"value": one.value.col}).values())
        return run_whole(replace(w, rows=replace(one, df=df), order=order), rest)
    if name == "unique_by":
        keys = [scalar(k, rows.value, rows.scope).column() for k in _keys(args[0])]
        if not w.order:
            raise NotNative("rows have no order")
        first = F.row_number().over(Window.partitionBy(*keys).orderBy(*sorting(w.order)))
        df = rows.df.withColumn("$first", first).filter(F.col("`$first`") == 1)
        return run_whole(replace(w, rows=replace(rows, df=df), order=tuple((k, True) for k in keys)), rest)
    if name in ("length", "add", "min", "max", "any", "all"):
        node = ("call", name, args)
        if name in ("add", "min", "max") and not args or name in ("any", "all") and not args:
            node = ("pipe", ("call", "map", (("identity",),)), node)
        return _row_steps(_aggregated(w, node), rest)
    if name == "JOIN":
        return run_whole(lookup(w, args, _read_of_match(rest)), rest)
    if name == "limit" and args[1] == ("each", ("identity",)) and args[0][0] == "literal":
        if not w.order:
            raise NotNative("rows have no order")
        return _row_steps(replace(rows, df=rows.df.orderBy(*sorting(w.order)).limit(args[0][1])), rest)
    raise NotNative(name)


def grouped(w: Whole, key: Node, rest: list[Node]) -> Whole | Rows:
    """group_by(k) | map(f) as one aggregation; the result is ordered by the keys."""
    rows, parts = w.rows, _keys(key)
    cols = {f"$k{i}": (k, F.col(f"`$k{i}`")) for i, k in enumerate(parts)}
    order = tuple((c, True) for _, c in cols.values())
    keyed = [scalar(k, rows.value, rows.scope).column().alias(n) for n, (k, _) in cols.items()]
    if rest and rest[0][0] == "call" and rest[0][1] == "map" or rest and rest[0][0] == "array":
        node = rest[0][2][0] if rest[0][0] == "call" else _joined(stages(rest[0][1])[1:])
        top = _top_per_group(w, parts, node)
        if top is not None:
            return run_whole(replace(w, rows=top, order=()), rest[1:])
        steps = stages(node)
        head, test = steps[0], None
        if len(steps) > 1 and steps[0][0] == "call" and steps[0][1] == "select":  # groups that meet a condition
            test, head = steps[0][2][0], _joined(steps[1:])
        else:
            head = node
        out = aggregate(head, rows, cols, w.order)
        named = out.fields or {"value": out.column()}
        keyless = {n: c for n, c in named.items() if not any(c is k for _, k in cols.values())}
        measures = [c.alias(n) for n, c in keyless.items()]
        if test is not None:
            measures.append(_having(test, rows, cols, w.order).alias("$having"))
        done = rows.df.groupBy(*keyed).agg(*measures or [F.count(F.lit(1)).alias("$n")])
        if test is not None:
            done = done.filter(F.col("`$having`"))
        fields = {n: F.col(f"`{n}`") if n in keyless else c for n, c in named.items()}
        value = Typed(None, out.type, fields) if out.fields else Typed(fields["value"], out.type)
        return run_whole(replace(w, rows=Rows(done, value, Scope()), order=order), rest[1:])
    if rest and rest[0] == ("call", "length", ()):
        return _row_steps(_aggregated(w, ("pipe", ("call", "map", (key if len(parts) == 1 else ("array", key),)), ("pipe", ("call", "unique", ()), ("call", "length", ())))), rest[1:])
    raise NotNative("groups as arrays")


def _having(test: Node, rows: Rows, cols: dict, order) -> Column:
    if test[0] in ("and", "or"):
        a, b = _having(test[1], rows, cols, order), _having(test[2], rows, cols, order)
        return a & b if test[0] == "and" else a | b
    if test[0] == "binary":
        from millrace.plans.typed import comparison

        return comparison(test[1], aggregate(test[2], rows, cols, order), aggregate(test[3], rows, cols, order))
    return truth(aggregate(test, rows, cols, order))


def _top_per_group(w: Whole, parts: list[Node], node: Node) -> Rows | None:
    """map(sort_by(k) | .[:n] | .[]) and map(sort_by(k) | last): the first or last rows of each group."""
    steps = stages(node)
    if steps[0][0] != "call" or steps[0][1] != "sort_by" or len(steps) < 2:
        return None
    rows = w.rows
    order, n = (*sort_keys(steps[0][2][0], rows), *w.order), None
    cut = steps[1]
    if cut in (("call", "last", ()), ("call", "first", ())):
        n, rest = 1, steps[2:]
        order = tuple(_backwards(order)) if cut[1] == "last" else order
    elif cut[0] == "slice" and cut[1] == ("identity",) and cut[2] is None and cut[3] and cut[3][0] == "literal" and len(steps) > 2 and steps[2] == ("each", ("identity",)):
        n, rest = cut[3][1], steps[3:]
    elif cut[0] == "each" and cut[1][0] == "slice" and cut[1][2] is None and cut[1][3][0] == "literal":
        n, rest = cut[1][3][1], steps[2:]
    else:
        return None
    keys = [scalar(k, rows.value, rows.scope).column() for k in parts]
    at = F.row_number().over(Window.partitionBy(*keys).orderBy(*sorting(order)))
    return _row_steps(replace(rows, df=rows.df.withColumn("$at", at).filter(F.col("`$at`") <= n)), rest)


def _read_of_match(rest: list[Node]) -> set[str] | None:
    """The fields of .[1] that map(f) after a JOIN reads, if it reads nothing else of the pair but fields; else None."""
    names: set[str] = set()

    def plain(node) -> bool:
        if not isinstance(node, tuple):
            return True
        if node[:1] == ("index",) and node[1] in (("index", ("identity",), ("literal", 0)), ("index", ("identity",), ("literal", 1))) and node[2][0] == "literal" and isinstance(node[2][1], str):
            if node[1][2][1] == 1:
                names.add(node[2][1])
            return True
        return node[:1] not in (("identity",), ("pipe",), ("each",), ("bind",), ("call",), ("var",), ("reduce",), ("foreach",), ("assign",), ("def",)) and all(map(plain, node))

    return names if rest and rest[0][:2] == ("call", "map") and plain(rest[0][2][0]) else None


def lookup(w: Whole, args: tuple, fields: set[str] | None = None) -> Whole:
    """JOIN($t | INDEX(k); f): every row beside a row of t with that key, or null; of t only the named fields are read."""
    index, key = args[0], args[-1]
    first, *more = stages(index)
    if first[0] != "var" or first[1] not in (w.tables or {}) or len(more) != 1 or more[0][0] != "call" or more[0][1] != "INDEX":
        raise NotNative("JOIN")
    other = of_table(w.tables[first[1]])
    right = scalar(more[0][2][0], other.value, other.scope)
    left = scalar(key, w.rows.value, w.rows.scope)
    # keys are unique as object keys are: one row each
    kept = [c for c in other.df.columns if fields is None or c in fields] or other.df.columns[:1]
    kind = T.StructType([other.df.schema[c] for c in kept])
    table = other.df.groupBy(right.column().alias("$key")).agg(F.max(F.struct(*[F.col(f"`{c}`") for c in kept])).alias("$row"))
    df = w.rows.df.join(table, left.column() == F.col("`$key`"), "left")
    match = Typed(F.col("`$row`"), kind)
    pair = record({"0": w.rows.value, "1": match})
    return replace(w, rows=Rows(df, Pair(pair.col, pair.type, pair.fields, (w.rows.value, match)), w.rows.scope), order=())


@dataclass(frozen=True)
class Pair(Typed):
    """[row, match], two values of different types."""

    parts: tuple[Typed, Typed] = ()


def running(w: Whole, node: Node, inner: list[Node]) -> Whole:
    """foreach .[] as $e (0; . + f): a running sum (or count) in the order of rows."""
    _, source, patterns, init, update, *extract = node
    if source != ("each", ("identity",)) or not w.order or init[0] != "literal" or update[0] != "binary" or update[1] != "+" or update[2] != ("identity",):
        raise NotNative("foreach")
    rows = w.rows
    scope = bound(patterns[0], rows.value, rows.scope)
    item = scalar(update[3], rows.value, scope)
    if not is_number(item):
        raise NotNative("foreach")
    start = literal(init[1])
    rows, total = _prefix_sum(rows, item.column(), w.order)
    scope = bound(patterns[0], rows.value, rows.scope)
    kind = LONG if isinstance(item.type, WHOLE) and isinstance(start.type, WHOLE) else DOUBLE
    df = rows.df.withColumn("$state", (start.column() + total).cast(kind))
    state = Typed(F.col("`$state`"), kind)
    value = scalar(extract[0], state, scope) if extract else state
    out = Rows(df, value, replace(rows.scope, vars=scope.vars))
    for s in inner:
        out = step(out, s)
    return Whole(out, w.order, w.tables)


def _prefix_sum(rows: Rows, item: Column, order: Order) -> tuple[Rows, Column]:
    """A running sum over all rows. Where the first key is a number or a time, rows are dealt into ranges of it:
    sums of ranges are few and get running sums first, then each range runs by itself. Other keys need one task."""
    key, up = order[0]
    kind = rows.df.select(key.alias("k")).schema["k"].dataType
    everything = Window.orderBy(*sorting(order)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    if not isinstance(kind, (*NUMBERS, T.TimestampType, T.DateType)):
        return rows, F.sum(item).over(everything)
    number = key.cast("timestamp").cast("double") if isinstance(kind, T.DateType) else key.cast("double")
    ranges = int(rows.df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = sorted(set(rows.df.select(number.alias("k")).approxQuantile("k", [i / ranges for i in range(1, ranges)], 0.01))) if ranges > 1 else []
    if not cuts:
        return rows, F.sum(item).over(everything)
    # a null key is the least; equal keys share a range
    place = F.coalesce(F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c < number)), F.lit(0))
    dealt = rows.df.withColumn("$range", F.when(key.isNull(), F.lit(-1)).otherwise(place))
    sums = dealt.groupBy("$range").agg(F.sum(item).alias("$sum"))
    before = Window.orderBy(F.col("`$range`") if up else F.desc("`$range`")).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("$range", F.coalesce(F.sum("`$sum`").over(before), F.lit(0)).alias("$before"))  # at most one row a range
    own = Window.partitionBy("$range").orderBy(*sorting(order)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return replace(rows, df=dealt.join(F.broadcast(sums), "$range")), F.col("`$before`") + F.coalesce(F.sum(item).over(own), F.lit(0))


def reduced(w: Whole, node: Node, rest: list[Node]) -> Rows:
    """reduce .[] as $e (c; . + f): a sum; with a condition, a conditional sum."""
    _, source, patterns, init, update = node
    if source != ("each", ("identity",)) or init[0] != "literal":
        raise NotNative("reduce")
    scope = bound(patterns[0], w.rows.value, w.rows.scope)
    test = None
    if update[0] == "if" and update[3] == ("identity",):
        test, update = condition(update[1], w.rows.value, scope), update[2]
    if update[0] != "binary" or update[1] != "+" or update[2] != ("identity",):
        raise NotNative("reduce")
    item, start = scalar(update[3], w.rows.value, scope), literal(init[1])
    if not is_number(item) or not is_number(start):
        raise NotNative("reduce")
    kind = LONG if isinstance(item.type, WHOLE) and isinstance(start.type, WHOLE) else DOUBLE
    col = item.column() if test is None else F.when(test, item.column())
    df = w.rows.df.agg((start.column() + F.coalesce(F.sum(col), F.lit(0))).cast(kind).alias("value"))
    return _row_steps(Rows(df, Typed(F.col("value"), kind), Scope()), rest)
