"""Text of a program to a syntax tree of plain tuples ``(kind, ...)``.

One recursive-descent pass works on the text itself, since a string may hold programs (``"a\\(.b)"``).
Loosest first: ``|``, ``,``, assignments, ``//``, ``or`` and ``and``, comparisons, ``+ -``, ``* / %``,
postfix. ``def``, ``as``, ``label`` and ``reduce``-like forms reach as far to the right as they can.
"""

from __future__ import annotations

import re
from typing import Any

Node = tuple[Any, ...]

TOKEN = re.compile(
    r"""(?:\s|\#[^\n]*)*(?:
    (?P<num>\d+(?:\.\d*)?(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?)
  | (?P<field>\.[A-Za-z_]\w*)
  | (?P<var>\$(?:[A-Za-z_]\w*::)*[A-Za-z_]\w*)
  | (?P<format>@[A-Za-z_]\w*)
  | (?P<word>(?:[A-Za-z_]\w*::)*[A-Za-z_]\w*)
  | (?P<op>\?//=?|\|=|//=|\+=|-=|\*=|/=|%=|==|!=|<=|>=|\.\.|//|[.\[\]{}()|,:;=<>+\-*/%?"])
  | (?P<end>\Z))""",
    re.X,
)
KEYWORDS = {"def", "if", "then", "elif", "else", "end", "as", "reduce", "foreach", "try", "catch", "label", "import", "include", "and", "or", "__loc__"}
ASSIGN = {"=", "|=", "+=", "-=", "*=", "/=", "%=", "//="}
COMPARE = {"==", "!=", "<", "<=", ">", ">="}
MAX_DEPTH = 96


class SyntaxProblem(ValueError):
    """The program can't be read; the message names the place."""


def number(text: str) -> int | float:
    if re.fullmatch(r"\d+", text) and int(text) < 1 << 63:
        return int(text)
    return float(text)


class Reader:
    def __init__(self, text: str):
        self.text, self.at, self.depth = text, 0, 0
        self.step()

    # tokens
    def step(self) -> tuple[str, str]:
        """Returns the current token and reads the next one."""
        old = getattr(self, "token", ("", ""))
        found = TOKEN.match(self.text, self.at)
        if not found:
            raise SyntaxProblem(f"unexpected character at {self.at}: {self.text[self.at : self.at + 12]!r}")
        self.start, self.at = found.start(found.lastgroup), found.end()
        self.token = (found.lastgroup, found.group(found.lastgroup))
        return old

    def has(self, *texts: str) -> bool:
        return self.token[1] in texts and self.token[0] in ("op", "word")

    def take(self, *texts: str) -> str | None:
        return self.step()[1] if self.has(*texts) else None

    def need(self, text: str) -> None:
        if not self.take(text):
            self.fail(f"expected {text!r}")

    def fail(self, why: str):
        raise SyntaxProblem(f"{why} at {self.start}, found {self.token[1]!r}")

    # programs
    def program(self) -> Node:
        meta, imports = None, []
        if self.has("module"):
            self.step()
            meta = self.postfix()
            self.need(";")
        while self.has("import", "include"):
            kind = self.step()[1]
            path = self.string(None)
            alias = None
            if kind == "import":
                self.need("as")
                alias = self.step()[1]
            info = None if self.has(";") else self.postfix()
            self.need(";")
            imports.append((kind, path, alias, info))
        defs = []
        while self.has("def"):
            defs.append(self.definition())
        body = ("identity",) if self.token[0] == "end" else self.pipe()
        if self.token[0] != "end":
            self.fail("unexpected text")
        for d in reversed(defs):
            body = ("def", *d, body)
        return ("program", meta, tuple(imports), body) if meta or imports else body

    def library(self) -> tuple[Any, list, list]:
        """(metadata, imports, definitions) of a module file."""
        tree = self.program()
        meta, imports, body = tree[1:] if tree[0] == "program" else (None, (), tree)
        defs = []
        while body[0] == "def":
            defs.append(body[1:4])
            body = body[4]
        return meta, list(imports), defs

    def definition(self) -> tuple[str, tuple, Node]:
        self.need("def")
        name, params = self.step()[1], []
        if self.take("("):
            while True:
                kind, text = self.step()
                if kind not in ("word", "var"):
                    self.fail("expected a parameter")
                params.append(text)
                if not self.take(";"):
                    break
            self.need(")")
        self.need(":")
        body = self.pipe()
        self.need(";")
        return name, tuple(params), body

    def pipe(self) -> Node:
        self.depth += 1
        if self.depth > MAX_DEPTH:
            self.fail("nested too deeply")
        try:
            if self.has("def"):
                name, params, body = self.definition()
                return ("def", name, params, body, self.pipe())
            if self.has("label"):
                self.step()
                name = self.step()[1]
                self.need("|")
                return ("label", name, self.pipe())
            left = self.comma()
            return ("pipe", left, self.pipe()) if self.take("|") else left
        finally:
            self.depth -= 1

    def comma(self) -> Node:
        left = self.assign()
        while self.take(","):
            left = ("comma", left, self.assign())
        return left

    def assign(self) -> Node:
        left = self.alternative()
        if self.has("as"):
            return self.bound(left)
        if self.token[0] == "op" and self.token[1] in ASSIGN:
            op = self.step()[1]
            return ("assign", op, left, self.alternative())
        return left

    def alternative(self) -> Node:
        left = self.logic()
        while self.take("//"):
            left = ("alt", left, self.logic())
        return left

    def logic(self) -> Node:
        left = self.compare()
        while self.has("and", "or"):
            left = (self.step()[1], left, self.compare())
        return left

    def compare(self) -> Node:
        left = self.sum()
        if self.token[0] == "op" and self.token[1] in COMPARE:
            left = ("binary", self.step()[1], left, self.sum())
            if self.token[0] == "op" and self.token[1] in COMPARE:
                self.fail("comparisons don't chain")
        return left

    def sum(self) -> Node:
        left = self.product()
        while self.has("+", "-"):
            left = ("binary", self.step()[1], left, self.product())
        return left

    def product(self) -> Node:
        left = self.unary()
        while self.has("*", "/", "%"):
            left = ("binary", self.step()[1], left, self.unary())
        return left

    def unary(self) -> Node:
        if self.take("-"):
            return ("negate", self.unary())
        if self.has("reduce", "foreach"):
            return self.fold()
        if self.take("try"):
            body = self.postfix()
            return ("try", body, self.postfix() if self.take("catch") else None)
        return self.postfix()

    def fold(self) -> Node:
        kind = self.step()[1]
        source = self.compare()
        self.need("as")
        patterns = [self.pattern()]
        while self.take("?//"):
            patterns.append(self.pattern())
        self.need("(")
        parts = [self.pipe()]
        while self.take(";"):
            parts.append(self.pipe())
        self.need(")")
        if len(parts) not in ((2,) if kind == "reduce" else (2, 3)):
            self.fail(f"{kind} takes other parts")
        return (kind, source, tuple(patterns), *parts)

    def postfix(self) -> Node:
        out = self.primary()
        while True:
            if self.token[0] == "field":
                out = ("index", out, ("literal", self.step()[1][1:]))
            elif self.has(".") and self.text[self.at : self.at + 1] == '"':
                self.step()
                out = ("index", out, self.string(None))
            elif self.has(".") and self.text[self.at : self.at + 1] == "[":
                self.step()
            elif self.take("["):
                out = self.bracket(out)
            elif self.take("?"):
                out = ("try", out, None)
            else:
                return out

    def bound(self, source: Node) -> Node:
        """``source as pattern | body``; the body reaches as far as it can."""
        self.need("as")
        patterns = [self.pattern()]
        while self.take("?//"):
            patterns.append(self.pattern())
        self.need("|")
        return ("bind", source, tuple(patterns), self.pipe())

    def bracket(self, out: Node) -> Node:
        if self.take("]"):
            return ("each", out)
        if self.take(":"):
            stop = self.pipe()
            self.need("]")
            return ("slice", out, None, stop)
        first = self.pipe()
        if self.take(":"):
            stop = None if self.has("]") else self.pipe()
            self.need("]")
            return ("slice", out, first, stop)
        self.need("]")
        return ("index", out, first)

    def primary(self) -> Node:
        kind, text = self.token
        if kind == "num":
            self.step()
            return ("literal", number(text))
        if kind == "field":
            self.step()
            return ("index", ("identity",), ("literal", text[1:]))
        if kind == "var":
            self.step()
            return ("literal", {"file": "<top-level>", "line": 1}) if text == "$__loc__" else ("var", text[1:])
        if kind == "format":
            self.step()
            return self.string(text) if self.token[1] == '"' else ("format", text)
        if kind == "op":
            return self.mark(text)
        if kind == "word":
            return self.word(text)
        self.fail("expected a term")

    def mark(self, text: str) -> Node:
        if text == '"':
            return self.string(None)
        self.step()
        if text == ".":
            return ("index", ("identity",), self.string(None)) if self.token[1] == '"' else ("identity",)
        if text == "-":
            return ("negate", self.postfix())
        if text == "..":
            return ("call", "recurse", ())
        if text == "(":
            out = self.pipe()
            self.need(")")
            return out
        if text == "[":
            if self.take("]"):
                return ("array", None)
            out = self.pipe()
            self.need("]")
            return ("array", out)
        if text == "{":
            return self.object()
        self.at = self.start
        self.step()
        self.fail("expected a term")

    def word(self, text: str) -> Node:
        if text in ("reduce", "foreach"):
            return self.fold()
        if text == "if":
            self.step()
            return self.condition()
        if text == "try":
            return self.unary()
        if text == "def":
            name, params, body = self.definition()
            return ("def", name, params, body, self.pipe())
        if text == "label":
            return self.pipe()
        if text in KEYWORDS:
            self.fail("keyword in the wrong place")
        self.step()
        if text in ("null", "true", "false"):
            return ("literal", {"null": None, "true": True, "false": False}[text])
        if text == "break" and self.token[0] == "var":
            return ("break", self.step()[1])
        args = []
        if self.take("("):
            args.append(self.pipe())
            while self.take(";"):
                args.append(self.pipe())
            self.need(")")
        return ("call", text, tuple(args))

    def condition(self) -> Node:
        test = self.pipe()
        self.need("then")
        yes = self.pipe()
        if self.take("elif"):
            return ("if", test, yes, self.condition())
        no = self.pipe() if self.take("else") else ("identity",)
        self.need("end")
        return ("if", test, yes, no)

    def object(self) -> Node:
        entries = []
        while not self.take("}"):
            kind, text = self.token
            if kind == "var":
                self.step()
                key, value = ("literal", text[1:]), ("var", text[1:]) if text != "$__loc__" else ("literal", {"file": "<top-level>", "line": 1})
                if self.take(":"):
                    key, value = ("var", text[1:]), self.entry_value()
            else:
                if kind == "word":
                    key = ("literal", self.step()[1])
                elif kind == "num":
                    key = ("literal", self.step()[1])
                elif kind == "format":
                    self.step()
                    key = self.string(text)
                elif text == '"':
                    key = self.string(None)
                elif text == "(":
                    self.step()
                    key = self.pipe()
                    self.need(")")
                else:
                    self.fail("expected a key")
                value = self.entry_value() if self.take(":") else ("index", ("identity",), key)
            entries.append((key, value))
            if not self.has("}"):
                self.need(",")
        return ("object", tuple(entries))

    def entry_value(self) -> Node:
        out = self.alternative()
        while self.take("|"):
            out = ("pipe", out, self.alternative())
        return out

    def pattern(self) -> Node:
        if self.token[0] == "var":
            return ("var", self.step()[1][1:])
        if self.take("["):
            parts = [self.pattern()]
            while self.take(","):
                parts.append(self.pattern())
            self.need("]")
            return ("array", tuple(parts))
        self.need("{")
        entries = []
        while True:
            kind, text = self.token
            bound = None
            if kind == "var":
                self.step()
                key, bound = ("literal", text[1:]), text[1:]
            elif kind == "word":
                key = ("literal", self.step()[1])
            elif text == '"':
                key = self.string(None)
            else:
                self.need("(")
                key = self.pipe()
                self.need(")")
            inner = self.pattern() if self.take(":") else None
            if inner is None and bound is None:
                self.fail("expected ':'")
            entries.append((key, bound, inner))
            if not self.take(","):
                break
        self.need("}")
        return ("object", tuple(entries))

    def string(self, fmt: str | None) -> Node:
        """The string at the current token; its holes are programs."""
        if self.token[1] != '"':
            self.fail("expected a string")
        parts, plain, i, s = [], [], self.at, self.text
        while True:
            if i >= len(s):
                self.fail("string without end")
            c = s[i]
            if c == '"':
                break
            if c != "\\":
                plain.append(c)
                i += 1
                continue
            e = s[i + 1 : i + 2]
            if e == "(":
                self.at = i + 2
                self.step()
                hole = self.pipe()
                if self.token[1] != ")":
                    self.fail("expected ')'")
                parts += ["".join(plain), hole]
                plain, i = [], self.at
            elif e == "u":
                code = int(s[i + 2 : i + 6], 16)
                i += 6
                if 0xD800 <= code < 0xDC00 and s[i : i + 2] == "\\u" and 0xDC00 <= (low := int(s[i + 2 : i + 6], 16)) < 0xE000:
                    code, i = 0x10000 + ((code - 0xD800) << 10) + low - 0xDC00, i + 6
                plain.append("�" if 0xD800 <= code < 0xE000 else chr(code))
            else:
                known = {'"': '"', "\\": "\\", "/": "/", "n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}
                if e not in known:
                    self.fail("unknown escape in string")
                plain.append(known[e])
                i += 2
        self.at = i + 1
        self.step()
        if not parts:
            return ("literal", "".join(plain))
        return ("template", fmt, (*parts, "".join(plain)))


def parse(text: str) -> Node:
    return Reader(text).program()


def parse_library(text: str):
    return Reader(text).library()
