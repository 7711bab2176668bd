"""A sandboxed template language: text is parsed to a syntax tree, constants are folded, closures are generated.

Syntax: ``{{ expr }}``, ``{% if expr %} .. {% elif expr %} .. {% else %} .. {% endif %}``,
``{% for x in expr %} .. {% endfor %}`` (with ``loop.index``, ``loop.index0``, ``loop.first``, ``loop.last``),
``{% set x = expr %}``, ``{% generation %} .. {% endgeneration %}`` and ``{# comment #}``. A dash inside a tag's
bracket (``{%-``, ``-%}``) strips the white space on that side. Expressions: strings, integers, names, ``a.b`` and
``a['b']``, ``not``, ``and``, ``or``, ``==``, ``!=``, ``<``, ``<=``, ``>``, ``>=``, ``in``, ``+``, ``~``, ``%``, parentheses and the
filters ``trim``, ``upper``, ``lower``, ``length``, ``default(x)``. There are no calls, and names and members are looked up
in dicts and lists alone, so a template can't reach Python objects.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import Any


class TemplateError(ValueError):
    """The template isn't valid, or used a value in a way its type doesn't allow."""


_TAG = re.compile(r"\{\{(-?)(.*?)(-?)\}\}|\{%(-?)(.*?)(-?)%\}|\{#(-?).*?(-?)#\}", re.S)
_TOKEN = re.compile(r"\s*(?:(?P<num>\d+)|(?P<str>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|<=|>=|[-<>+~%().\[\]|,=]))")
_ESCAPE = {"n": "\n", "t": "\t", "r": "\r"}
_FILTERS: dict[str, Callable] = {
    "trim": lambda v: _text(v).strip(),
    "upper": lambda v: _text(v).upper(),
    "lower": lambda v: _text(v).lower(),
    "length": lambda v: len(v) if isinstance(v, (str, list, dict)) else 0,
}
MAX_DEPTH = 50


def _text(v: Any) -> str:
    return "" if v is None else "true" if v is True else "false" if v is False else str(v)


def _member(v: Any, key: Any) -> Any:
    if isinstance(v, dict):
        return v.get(key)
    if isinstance(v, (list, str)) and isinstance(key, int) and not isinstance(key, bool) and -len(v) <= key < len(v):
        return v[key]
    return None


def _add(a: Any, b: Any) -> Any:
    if isinstance(a, int) and isinstance(b, int):
        return a + b
    return _text(a) + _text(b)


def _mod(a: Any, b: Any) -> int:
    if not isinstance(a, int) or not isinstance(b, int) or not b:
        raise TemplateError("% needs integers, the second not zero")
    return a % b


def _less(a: Any, b: Any) -> bool:
    if type(a) is not type(b) or not isinstance(a, (int, str)):
        raise TemplateError("only two integers or two strings have an order")
    return a < b


_BINARY: dict[str, Callable] = {
    "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": _less, ">": lambda a, b: _less(b, a),
    "<=": lambda a, b: not _less(b, a), ">=": lambda a, b: not _less(a, b), "+": _add, "%": _mod,
    "~": lambda a, b: _text(a) + _text(b), "in": lambda a, b: a in b if isinstance(b, (list, dict)) or (isinstance(b, str) and isinstance(a, str)) else False,
}


class _Parser:
    """Expressions to trees: ("const", v), ("name", n), ("member", e, e), ("filter", f, e, args), ("not", e), ("and"|"or", e, e), (op, e, e)."""

    def __init__(self, source: str):
        self.toks: list[tuple[str, str]] = []
        at, source = 0, source.rstrip()
        while at < len(source):
            m = _TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"can't read {source[at : at + 20]!r}")
            self.toks.append((m.lastgroup or "", m[m.lastgroup]))
            at = m.end()
        self.i, self.depth = 0, 0

    def peek(self) -> str:
        return self.toks[self.i][1] if self.i < len(self.toks) and self.toks[self.i][0] != "str" else ""

    def take(self, what: str | None = None) -> tuple[str, str]:
        if self.i >= len(self.toks) or (what is not None and self.peek() != what):
            raise TemplateError(f"expected {what or 'more'}")
        self.i += 1
        return self.toks[self.i - 1]

    def whole(self):
        e = self.either()
        if self.i < len(self.toks):
            raise TemplateError(f"unexpected {self.toks[self.i][1]!r}")
        return e

    def _left(self, ops: tuple[str, ...], below: Callable):
        e = below()
        while self.peek() in ops:
            op = self.take()[1]
            e = (op, e, below())
        return e

    def either(self):
        self.depth += 1
        if self.depth > MAX_DEPTH:
            raise TemplateError("nested too deep")
        e = self._left(("or",), lambda: self._left(("and",), self.negated))
        self.depth -= 1
        return e

    def negated(self):
        n = 0
        while self.peek() == "not":
            self.take()
            n += 1
        e = self._left(("==", "!=", "<", "<=", ">", ">=", "in"), lambda: self._left(("+", "~"), lambda: self._left(("%",), self.postfix)))
        for _ in range(n):
            e = ("not", e)
        return e

    def postfix(self):
        e = self.atom()
        while self.peek() in (".", "[", "|"):
            op = self.take()[1]
            if op == ".":
                kind, name = self.take()
                if kind != "name":
                    raise TemplateError("a name goes after a dot")
                e = ("member", e, ("const", name))
            elif op == "[":
                e = ("member", e, self.either())
                self.take("]")
            else:
                name = self.take()[1]
                args = []
                if self.peek() == "(":
                    self.take()
                    args.append(self.either())
                    self.take(")")
                if name == "default" and len(args) == 1:
                    e = ("default", e, args[0])
                elif name in _FILTERS and not args:
                    e = ("filter", name, e)
                else:
                    raise TemplateError(f"no filter {name}")
        return e

    def atom(self):
        kind, s = self.take()
        if kind == "num":
            return ("const", int(s))
        if kind == "str":
            return ("const", re.sub(r"\\(.)", lambda m: _ESCAPE.get(m[1], m[1]), s[1:-1], flags=re.S))
        if kind == "name":
            return ("const", {"true": True, "false": False, "none": None}[s]) if s in ("true", "false", "none") else ("name", s)
        if s == "-" and self.i < len(self.toks) and self.toks[self.i][0] == "num":
            return ("const", -int(self.take()[1]))
        if s == "(":
            e = self.either()
            self.take(")")
            return e
        raise TemplateError(f"unexpected {s!r}")


def parse(source: str) -> list:
    """The syntax tree: a list of ("text", s), ("show", e), ("set", n, e), ("if", [(e, body)], body), ("for", n, e, body), ("gen", body)."""
    parts: list[tuple[str, str]] = []
    at, strip = 0, False
    for m in _TAG.finditer(source):
        text = source[at : m.start()]
        if strip:
            text = text.lstrip()
        left, right = (m[1] or m[4] or m[7]), (m[3] or m[6] or m[8])
        parts.append(("text", text.rstrip() if left else text))
        if m[2] is not None:
            parts.append(("show", m[2]))
        elif m[5] is not None:
            parts.append(("tag", m[5].strip()))
        at, strip = m.end(), bool(right)
    parts.append(("text", source[at:].lstrip() if strip else source[at:]))
    pos = 0

    def body(ends: tuple[str, ...], depth: int) -> tuple[list, str]:
        nonlocal pos
        if depth > MAX_DEPTH:
            raise TemplateError("nested too deep")
        out: list = []
        while pos < len(parts):
            kind, s = parts[pos]
            pos += 1
            if kind == "text":
                if s:
                    out.append(("text", s))
                continue
            if kind == "show":
                out.append(("show", _Parser(s).whole()))
                continue
            word = s.split(None, 1)[0] if s else ""
            rest = s[len(word) :]
            if word in ends:
                return out, s
            if word == "if":
                arms, other, cond = [], [], rest
                while True:
                    inner, end = body(("elif", "else", "endif"), depth + 1)
                    arms.append((_Parser(cond).whole(), inner))
                    if end.startswith("elif"):
                        cond = end[4:]
                        continue
                    if end == "else":
                        other, end = body(("endif",), depth + 1)
                    break
                out.append(("if", arms, other))
            elif word == "for":
                m = re.fullmatch(r"\s*([A-Za-z_]\w*)\s+in\s+(.*)", rest, re.S)
                if not m:
                    raise TemplateError(f"can't read {s!r}")
                inner, _ = body(("endfor",), depth + 1)
                out.append(("for", m[1], _Parser(m[2]).whole(), inner))
            elif word == "set":
                m = re.fullmatch(r"\s*([A-Za-z_]\w*)\s*=(.*)", rest, re.S)
                if not m:
                    raise TemplateError(f"can't read {s!r}")
                out.append(("set", m[1], _Parser(m[2]).whole()))
            elif word == "generation":
                inner, _ = body(("endgeneration",), depth + 1)
                out.append(("gen", inner))
            else:
                raise TemplateError(f"no tag {word!r}")
        if ends:
            raise TemplateError(f"{ends[-1]} is missing")
        return out, ""

    return body((), 0)[0]


def fold_expr(e):
    """An expression with its constant parts evaluated; a part that can't be is left to fail when it runs."""
    kind = e[0]
    if kind in ("const", "name"):
        return e
    if kind == "filter":
        e = ("filter", e[1], fold_expr(e[2]))
        known = e[2][0] == "const"
    else:
        e = (kind, *map(fold_expr, e[1:]))
        if kind in ("and", "or") and e[1][0] == "const":
            return e[2] if bool(e[1][1]) == (kind == "and") else e[1]
        known = all(x[0] == "const" for x in e[1:])
    if not known:
        return e
    try:
        return ("const", _expr(e)({}))
    except TemplateError:
        return e


def fold(tree: list) -> list:
    """A tree with constant expressions evaluated, dead arms dropped and neighbouring texts joined."""
    out: list = []

    def add(node) -> None:
        if node[0] == "text" and out and out[-1][0] == "text":
            out[-1] = ("text", out[-1][1] + node[1])
        elif node != ("text", ""):
            out.append(node)

    for node in tree:
        if node[0] == "show":
            e = fold_expr(node[1])
            add(("text", _text(e[1])) if e[0] == "const" else ("show", e))
        elif node[0] == "set":
            add(("set", node[1], fold_expr(node[2])))
        elif node[0] == "for":
            add(("for", node[1], fold_expr(node[2]), fold(node[3])))
        elif node[0] == "gen":
            add(("gen", fold(node[1])))
        elif node[0] == "if":
            arms, other = [], fold(node[2])
            for cond, inner in node[1]:
                c = fold_expr(cond)
                if c[0] == "const" and not c[1]:
                    continue
                if c[0] == "const":
                    other = fold(inner)
                    break
                arms.append((c, fold(inner)))
            if arms:
                add(("if", arms, other))
            else:
                for x in other:
                    add(x)
        else:
            add(node)
    return out


def _expr(e) -> Callable[[dict], Any]:
    kind = e[0]
    if kind == "const":
        v = e[1]
        return lambda env: v
    if kind == "name":
        n = e[1]
        return lambda env: env.get(n)
    if kind == "filter":
        f, a = _FILTERS[e[1]], _expr(e[2])
        return lambda env: f(a(env))
    if kind == "not":
        a = _expr(e[1])
        return lambda env: not a(env)
    a, b = _expr(e[1]), _expr(e[2])
    if kind == "member":
        return lambda env: _member(a(env), b(env))
    if kind == "and":
        return lambda env: a(env) and b(env)
    if kind == "or":
        return lambda env: a(env) or b(env)
    if kind == "default":
        return lambda env: b(env) if (v := a(env)) is None else v
    f = _BINARY[kind]
    return lambda env: f(a(env), b(env))


class _Out:
    """The text so far; ``spans``: (from, to) in characters of what the model is to generate."""

    def __init__(self) -> None:
        self.parts: list[str] = []
        self.size, self.spans, self.inside = 0, [], 0

    def add(self, s: str) -> None:
        self.parts.append(s)
        self.size += len(s)


def _block(tree: list) -> Callable[[dict, _Out], None]:
    steps = [_node(x) for x in tree]

    def run(env: dict, out: _Out) -> None:
        for s in steps:
            s(env, out)

    return run


def _node(node) -> Callable[[dict, _Out], None]:
    kind = node[0]
    if kind == "text":
        s = node[1]
        return lambda env, out: out.add(s)
    if kind == "show":
        e = _expr(node[1])
        return lambda env, out: out.add(_text(e(env)))
    if kind == "set":
        name, e = node[1], _expr(node[2])

        def assign(env: dict, out: _Out) -> None:
            env[name] = e(env)

        return assign
    if kind == "if":
        arms, other = [(_expr(c), _block(b)) for c, b in node[1]], _block(node[2])

        def choose(env: dict, out: _Out) -> None:
            for c, b in arms:
                if c(env):
                    return b(env, out)
            return other(env, out)

        return choose
    if kind == "for":
        name, e, b = node[1], _expr(node[2]), _block(node[3])

        def loop(env: dict, out: _Out) -> None:
            items = e(env)
            items = items if isinstance(items, list) else []
            inner = dict(env)
            for i, x in enumerate(items):
                inner[name] = x
                inner["loop"] = {"index": i + 1, "index0": i, "first": i == 0, "last": i == len(items) - 1}
                b(inner, out)

        return loop
    b = _block(node[1])

    def generated(env: dict, out: _Out) -> None:
        start, out.inside = out.size, out.inside + 1
        b(env, out)
        out.inside -= 1
        if not out.inside and out.size > start:
            out.spans.append((start, out.size))

    return generated


def compile_template(source: str) -> Callable[[dict], tuple[str, list[tuple[int, int]]]]:
    """A function from names to (text, spans). Raises TemplateError if the source isn't a template."""
    run = _block(fold(parse(source)))

    def render(names: dict) -> tuple[str, list[tuple[int, int]]]:
        out = _Out()
        run(dict(names), out)
        return "".join(out.parts), out.spans

    return render
