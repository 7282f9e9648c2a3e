"""A small sandboxed template language compiled to Python closures.

Syntax: text, ``{{ expression }}``, ``{% if e %} .. {% elif e %} .. {% else %} .. {% endif %}``,
``{% for name in e %} .. {% endfor %}`` (inside: ``loop.first``, ``loop.last``, ``loop.index0``), ``{% set name = e %}``
and ``{% generation %} .. {% endgeneration %}``, which marks what a model is to learn. A ``-`` inside a tag strips the
white space beside it. Expressions: strings, integers, true, false, none, names, ``a.b`` and ``a['b']`` of
mappings, comparisons, ``in``, ``and or not``, ``+``, ``~`` (joins texts), parentheses, and filters ``x | name`` out of those
that are given to the compiler. There are no calls, no attributes of Python objects and no imports, so a template can
only read the values it is given.

``compile_template`` parses to a syntax tree, folds what is constant and returns a function from values to a stream of
(text, generated) segments. A ``for`` over an iterator takes one item at a time, so a conversation of any length renders
in bounded memory.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from typing import Any


class TemplateError(ValueError):
    """A template that can't be parsed, or reads a value that isn't there."""


# ---- tree


@dataclass(frozen=True)
class Const:
    value: Any


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Get:
    of: Any
    key: Any


@dataclass(frozen=True)
class Op:
    name: str
    args: tuple


@dataclass(frozen=True)
class Filter:
    name: str
    of: Any


@dataclass(frozen=True)
class Emit:
    value: Any


@dataclass(frozen=True)
class If:
    test: Any
    then: tuple
    other: tuple


@dataclass(frozen=True)
class For:
    name: str
    of: Any
    body: tuple


@dataclass(frozen=True)
class Assign:
    name: str
    value: Any


@dataclass(frozen=True)
class Generation:
    body: tuple


_TAG = re.compile(r"\{\{-?(.*?)-?\}\}|\{%-?(.*?)-?%\}|\{#.*?#\}", re.S)
_TOKEN = re.compile(r"""\s*(?:("(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')|(\d+)|([A-Za-z_]\w*)|(==|!=|<=|>=|[-+~<>|.\[\]()]))""", re.S)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "0": "\0"}
_COMPARE = ("==", "!=", "<", ">", "<=", ">=")


def _lex(code: str) -> list[tuple[str, str]]:
    out, at = [], 0
    code = code.strip()
    while at < len(code):
        m = _TOKEN.match(code, at)
        if not m:
            raise TemplateError(f"unexpected {code[at:at + 10]!r}")
        kind = ("string", "number", "name", "sign")[m.lastindex - 1]
        out.append((kind, m[m.lastindex]))
        at = m.end()
    return out


class _Expression:
    """Recursive descent over the tokens of one tag."""

    def __init__(self, tokens: list[tuple[str, str]]):
        self.tokens, self.at = tokens, 0

    def peek(self) -> str:
        return self.tokens[self.at][1] if self.at < len(self.tokens) and self.tokens[self.at][0] != "string" else ""

    def take(self, *wanted: str) -> str:
        if wanted and self.peek() not in wanted or self.at >= len(self.tokens):
            raise TemplateError(f"expected {' or '.join(wanted) or 'more'}")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def whole(self):
        tree = self.either()
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return tree

    def either(self):
        tree = self.both()
        while self.peek() == "or":
            self.take()
            tree = Op("or", (tree, self.both()))
        return tree

    def both(self):
        tree = self.negated()
        while self.peek() == "and":
            self.take()
            tree = Op("and", (tree, self.negated()))
        return tree

    def negated(self):
        if self.peek() == "not":
            self.take()
            return Op("not", (self.negated(),))
        return self.compared()

    def compared(self):
        tree = self.summed()
        if self.peek() in _COMPARE or self.peek() == "in":
            sign = self.take()
            return Op(sign, (tree, self.summed()))
        if self.peek() == "not":
            self.take()
            self.take("in")
            return Op("not", (Op("in", (tree, self.summed())),))
        return tree

    def summed(self):
        tree = self.filtered()
        while self.peek() in ("+", "~"):
            sign = self.take()
            tree = Op(sign, (tree, self.filtered()))
        return tree

    def filtered(self):
        tree = self.atom()
        while True:
            if self.peek() == "|":
                self.take()
                tree = Filter(self.take(), tree)
            elif self.peek() == ".":
                self.take()
                tree = Get(tree, Const(self.take()))
            elif self.peek() == "[":
                self.take()
                tree = Get(tree, self.either())
                self.take("]")
            else:
                return tree

    def atom(self):
        if self.at >= len(self.tokens):
            raise TemplateError("an expression ends too early")
        kind, value = self.tokens[self.at]
        self.at += 1
        if kind == "string":
            return Const(re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), value[1:-1], flags=re.S))
        if kind == "number":
            return Const(int(value))
        if value == "(":
            tree = self.either()
            self.take(")")
            return tree
        if kind != "name":
            raise TemplateError(f"unexpected {value!r}")
        constants = {"true": True, "false": False, "none": None}
        return Const(constants[value.lower()]) if value.lower() in constants else Name(value)


def parse(source: str) -> tuple:
    """The template's syntax tree: a tuple of nodes."""
    items: list[tuple[str, str]] = []  # ("text" | "emit" | "tag", content)
    at = 0
    for m in _TAG.finditer(source):
        text = source[at : m.start()]
        if m[0][2:3] == "-":
            text = text.rstrip()
        if at and source[at - 3 : at - 2] == "-":
            text = text.lstrip()
        items.append(("text", text))
        if m[1] is not None:
            items.append(("emit", m[1]))
        elif m[2] is not None:
            items.append(("tag", m[2].strip()))
        at = m.end()
    items.append(("text", source[at:].lstrip() if at and source[at - 3 : at - 2] == "-" else source[at:]))
    nodes, rest, stop = _body(items, 0, ())
    if stop:
        raise TemplateError(f"unexpected {stop}")
    del rest
    return nodes


def _expr(code: str):
    return _Expression(_lex(code)).whole()


def _body(items: list[tuple[str, str]], at: int, until: tuple[str, ...]) -> tuple[tuple, int, str]:
    out: list[Any] = []
    while at < len(items):
        kind, content = items[at]
        at += 1
        if kind == "text":
            if content:
                out.append(Emit(Const(content)))
            continue
        if kind == "emit":
            out.append(Emit(_expr(content)))
            continue
        word, _, rest = content.partition(" ")
        if word in until:
            return tuple(out), at, content
        if word == "if":
            node, at = _branches(items, at, rest)
            out.append(node)
        elif word == "for":
            m = re.fullmatch(r"\s*([A-Za-z_]\w*)\s+in\s+(.+)", rest, re.S)
            if not m:
                raise TemplateError(f"for {rest}")
            body, at, _ = _body(items, at, ("endfor",))
            out.append(For(m[1], _expr(m[2]), body))
        elif word == "set":
            m = re.fullmatch(r"\s*([A-Za-z_]\w*)\s*=(?!=)(.+)", rest, re.S)
            if not m:
                raise TemplateError(f"set {rest}")
            out.append(Assign(m[1], _expr(m[2])))
        elif word == "generation":
            body, at, _ = _body(items, at, ("endgeneration",))
            out.append(Generation(body))
        else:
            raise TemplateError(f"unknown tag {word!r}")
    if until:
        raise TemplateError(f"{until[-1]} is missing")
    return tuple(out), at, ""


def _branches(items: list[tuple[str, str]], at: int, test: str) -> tuple[If, int]:
    then, at, stop = _body(items, at, ("elif", "else", "endif"))
    if stop.startswith("elif"):
        node, at = _branches(items, at, stop[4:])
        return If(_expr(test), then, (node,)), at
    other: tuple = ()
    if stop == "else":
        other, at, _ = _body(items, at, ("endif",))
    return If(_expr(test), then, other), at


# ---- folding


def fold(node, filters: dict[str, Callable[[str], str]]):
    """The same tree with constant expressions evaluated, dead branches gone and neighbouring texts joined."""
    if isinstance(node, tuple):
        out: list[Any] = []
        for x in (fold(n, filters) for n in node):
            for y in x if isinstance(x, tuple) else (x,):
                if isinstance(y, Emit) and isinstance(y.value, Const) and out and isinstance(out[-1], Emit) and isinstance(out[-1].value, Const):
                    out[-1] = Emit(Const(_text(out[-1].value.value) + _text(y.value.value)))
                else:
                    out.append(y)
        return tuple(out)
    if isinstance(node, Op):
        new = Op(node.name, tuple(fold(a, filters) for a in node.args))
        return Const(_evaluate(new, filters)({})) if all(isinstance(a, Const) for a in new.args) else new
    if isinstance(node, Filter):
        new = Filter(node.name, fold(node.of, filters))
        if node.name not in filters:
            raise TemplateError(f"unknown filter {node.name!r}")
        return Const(filters[node.name](_text(new.of.value))) if isinstance(new.of, Const) else new
    if isinstance(node, Get):
        return Get(fold(node.of, filters), fold(node.key, filters))
    if isinstance(node, Emit):
        return Emit(fold(node.value, filters))
    if isinstance(node, Assign):
        return Assign(node.name, fold(node.value, filters))
    if isinstance(node, If):
        test = fold(node.test, filters)
        then, other = fold(node.then, filters), fold(node.other, filters)
        return (then if test.value else other) if isinstance(test, Const) else If(test, then, other)
    if isinstance(node, For):
        return For(node.name, fold(node.of, filters), fold(node.body, filters))
    if isinstance(node, Generation):
        return Generation(fold(node.body, filters))
    return node


# ---- closures


def _text(value: Any) -> str:
    return "" if value is None else value if isinstance(value, str) else str(value)


_BINARY: dict[str, Callable[[Any, Any], Any]] = {
    "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, ">": lambda a, b: a > b,
    "<=": lambda a, b: a <= b, ">=": lambda a, b: a >= b, "in": lambda a, b: a in b, "+": lambda a, b: a + b,
    "~": lambda a, b: _text(a) + _text(b),
}


def _evaluate(node, filters: dict[str, Callable[[str], str]]) -> Callable[[dict], Any]:
    if isinstance(node, Const):
        return lambda scope, v=node.value: v
    if isinstance(node, Name):
        def name(scope: dict, n: str = node.name) -> Any:
            if n not in scope:
                raise TemplateError(f"{n} is not defined")
            return scope[n]

        return name
    if isinstance(node, Get):
        of, key = _evaluate(node.of, filters), _evaluate(node.key, filters)

        def get(scope: dict) -> Any:
            base, k = of(scope), key(scope)
            if not isinstance(base, dict):
                raise TemplateError("only mappings have parts")
            return base.get(k)

        return get
    if isinstance(node, Filter):
        of, f = _evaluate(node.of, filters), filters[node.name]
        return lambda scope: f(_text(of(scope)))
    args = [_evaluate(a, filters) for a in node.args]
    if node.name == "not":
        return lambda scope: not args[0](scope)
    if node.name == "and":
        return lambda scope: args[0](scope) and args[1](scope)
    if node.name == "or":
        return lambda scope: args[0](scope) or args[1](scope)
    f2 = _BINARY[node.name]
    return lambda scope: f2(args[0](scope), args[1](scope))


Renderer = Callable[[dict, bool], Iterator[tuple[str, bool]]]


def _generate(nodes: tuple, filters: dict[str, Callable[[str], str]]) -> Renderer:
    parts = [_node(n, filters) for n in nodes]

    def run(scope: dict, marked: bool) -> Iterator[tuple[str, bool]]:
        for p in parts:
            yield from p(scope, marked)

    return run


def _node(node, filters: dict[str, Callable[[str], str]]) -> Renderer:
    if isinstance(node, Emit):
        value = _evaluate(node.value, filters)

        def emit(scope: dict, marked: bool) -> Iterator[tuple[str, bool]]:
            yield _text(value(scope)), marked

        return emit
    if isinstance(node, Assign):
        value = _evaluate(node.value, filters)

        def assign(scope: dict, marked: bool) -> Iterator[tuple[str, bool]]:
            scope[node.name] = value(scope)
            return iter(())

        return assign
    if isinstance(node, If):
        test, then, other = _evaluate(node.test, filters), _generate(node.then, filters), _generate(node.other, filters)
        return lambda scope, marked: then(scope, marked) if test(scope) else other(scope, marked)
    if isinstance(node, Generation):
        body = _generate(node.body, filters)
        return lambda scope, marked: body(scope, True)
    of, body = _evaluate(node.of, filters), _generate(node.body, filters)

    def loop(scope: dict, marked: bool) -> Iterator[tuple[str, bool]]:
        items: Iterable = iter(of(scope))
        index, none = 0, object()
        item = next(items, none)
        while item is not none:
            after = next(items, none)
            inner = {**scope, node.name: item, "loop": {"first": index == 0, "last": after is none, "index0": index}}
            yield from body(inner, marked)
            item, index = after, index + 1

    return loop


def compile_template(source: str, filters: dict[str, Callable[[str], str]]) -> Callable[[dict], Iterator[tuple[str, bool]]]:
    """A function from a mapping of values to the rendered (text, generated) segments, in order."""
    run = _generate(fold(parse(source), filters), filters)
    return lambda values: run(dict(values), False)
