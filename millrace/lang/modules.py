"""Modules: import, include and data files, resolved on the driver before a program is compiled."""

from __future__ import annotations

import os
from typing import Any

from millrace.functions.values import Problem, all_json
from millrace.lang.syntax import Node, parse_library

SEARCH: tuple[str, ...] = ()


def constant(node: Node | None) -> Any:
    """The value of a tree of literals, arrays and objects."""
    if node is None:
        return None
    if node[0] == "literal":
        return node[1]
    if node[0] == "array":
        return [] if node[1] is None else _listed(node[1])
    if node[0] == "object":
        return {constant(k): constant(v) for k, v in node[1]}
    raise Problem("Module metadata must be constant")


def _listed(node: Node) -> list:
    return _listed(node[1]) + [constant(node[2])] if node[0] == "comma" else [constant(node)]


def locate(name: str, suffix: str, paths: tuple[str, ...]) -> str:
    last = name.rsplit("/", 1)[-1]
    for folder in paths:
        for place in (f"{folder}/{name}{suffix}", f"{folder}/{name}/{last}{suffix}"):
            if os.path.isfile(place):
                return place
    raise Problem(f"module not found: {name}")


def _search(info: Any, base: str, paths: tuple[str, ...]) -> tuple[str, ...]:
    found = (info or {}).get("search") if isinstance(info, dict) else None
    found = [found] if isinstance(found, str) else found or []
    return tuple(os.path.join(base, f) for f in found) + paths


def _imported(imports, base: str, paths: tuple[str, ...], seen: tuple[str, ...]) -> tuple[list, dict[str, Any]]:
    defs, data = [], {}
    for kind, path, alias, info in imports:
        where = _search(constant(info), base, paths)
        if alias and alias.startswith("$"):
            with open(locate(path[1], ".json", where), encoding="utf-8") as file:
                values = all_json(file.read())
            data[alias[1:]] = data[f"{alias[1:]}::{alias[1:]}"] = values
            continue
        place = locate(path[1], ".jq", where)
        if place in seen:
            raise Problem(f"modules import each other: {place}")
        with open(place, encoding="utf-8") as file:
            _, inner, own = parse_library(file.read())
        more, more_data = _imported(inner, os.path.dirname(place), paths, (*seen, place))
        data |= more_data
        prefix = f"{alias}::" if kind == "import" else ""
        # a module's functions see those before them; outside they go by the prefixed name
        defs += more
        defs += own
        if prefix:
            defs += [(prefix + name, params, ("call", name, tuple(("call", p.lstrip("$"), ()) for p in params))) for name, params, _ in own]
    return defs, data


def resolve(tree: Node, paths: tuple[str, ...]) -> tuple[Node, dict[str, Any]]:
    """The tree with imported definitions around it, and the variables of data files."""
    if tree[0] != "program":
        return tree, {}
    _, meta, imports, body = tree
    constant(meta)
    defs, data = _imported(imports, ".", paths or SEARCH, ())
    for d in reversed(defs):
        body = ("def", *d, body)
    return body, data


def describe(name: str, paths: tuple[str, ...] = ()) -> dict:
    """Metadata, dependencies and functions of a module."""
    with open(locate(name, ".jq", paths or SEARCH), encoding="utf-8") as file:
        meta, imports, defs = parse_library(file.read())
    deps = [{**(constant(info) or {}), **({"as": alias.lstrip("$")} if alias else {}), "is_data": bool(alias and alias.startswith("$")), "relpath": path[1]} for _, path, alias, info in imports]
    return {**(constant(meta) or {}), "deps": deps, "defs": [f"{n}/{len(p)}" for n, p, _ in defs]}
