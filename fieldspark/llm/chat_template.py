"""Compiler for a small sandboxed template language.

Text, ``{{ expr }}`` and the statements ``{% for x in e %}``, ``{% if e %}``,
``{% elif e %}``, ``{% else %}``, ``{% set x = e %}`` and ``{% generation %}``,
each closed by ``{% end... %}``. Expressions: strings, integers, true, false,
none, names, ``a.b``, ``a['b']``, ``+ == != < > and or not in``, parentheses, and
filters ``e | name``. Templates see their variables and the named filters only:
fields are looked up in mappings, never as attributes of Python objects, and
nothing can be called.

A template is parsed into tuples, constant parts are folded, and each node
becomes a Python closure over (scope, sink). The sink takes pieces of output and
tells which of them lie between generation markers.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from typing import Any

TAG = re.compile(r"\{\{-?\s*(.*?)\s*-?\}\}|\{%-?\s*(.*?)\s*-?%\}|\{#.*?#\}", re.S)
TOKEN = re.compile(r"""\s*(?:(?P<str>'(?:\\.|[^'\\])*'|"(?:\\.|[^"\\])*")|(?P<int>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|[-+<>|.()\[\]]))""", re.S)
CONSTANTS = {"true": True, "false": False, "none": None}
ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}
Node = tuple


class TemplateError(ValueError):
    pass


class Expression:
    """Recursive descent from weakest to strongest: or, and, not, comparison, +, filter, field."""

    def __init__(self, source: str):
        self.source, self.tokens, at = source, [], 0
        while at < len(source.rstrip()):
            match = TOKEN.match(source, at)
            if match is None:
                raise TemplateError(f"cannot read {source[at:]!r}")
            self.tokens.append((match.lastgroup, match[match.lastgroup]))
            at = match.end()
        self.at = 0

    def peek(self) -> tuple[str | None, str]:
        return self.tokens[self.at] if self.at < len(self.tokens) else (None, "")

    def take(self, *wanted: str) -> bool:
        kind, value = self.peek()
        if kind in ("op", "name") and value in wanted:
            self.at += 1
            return True
        return False

    def need(self, wanted: str) -> None:
        if not self.take(wanted):
            raise TemplateError(f"{wanted!r} expected in {self.source!r}")

    def name(self) -> str:
        kind, value = self.peek()
        if kind != "name":
            raise TemplateError(f"name expected in {self.source!r}")
        self.at += 1
        return value

    def whole(self) -> Node:
        node = self.either()
        if self.at < len(self.tokens):
            raise TemplateError(f"{self.peek()[1]!r} not expected in {self.source!r}")
        return node

    def either(self) -> Node:
        node = self.both()
        while self.take("or"):
            node = ("or", node, self.both())
        return node

    def both(self) -> Node:
        node = self.negated()
        while self.take("and"):
            node = ("and", node, self.negated())
        return node

    def negated(self) -> Node:
        return ("not", self.negated()) if self.take("not") else self.compared()

    def compared(self) -> Node:
        node = self.added()
        kind, op = self.peek()
        if self.take("==", "!=", "<", ">", "in"):
            return (op, node, self.added())
        return node

    def added(self) -> Node:
        node = self.filtered()
        while self.take("+"):
            node = ("+", node, self.filtered())
        return node

    def filtered(self) -> Node:
        node = self.field()
        while self.take("|"):
            node = ("filter", node, self.name())
        return node

    def field(self) -> Node:
        node = self.atom()
        while True:
            if self.take("."):
                node = ("field", node, ("const", self.name()))
            elif self.take("["):
                node = ("field", node, self.either())
                self.need("]")
            else:
                return node

    def atom(self) -> Node:
        kind, value = self.peek()
        self.at += 1
        if kind == "str":
            return ("const", re.sub(r"\\(.)", lambda m: ESCAPES.get(m[1], m[1]), value[1:-1], flags=re.S))
        if kind == "int":
            return ("const", int(value))
        if kind == "name":
            return ("const", CONSTANTS[value]) if value in CONSTANTS else ("var", value)
        if value == "(":
            node = self.either()
            self.need(")")
            return node
        raise TemplateError(f"value expected in {self.source!r}")


def parse(source: str) -> Node:
    """Syntax tree of a template."""
    parts: list[tuple[str, str]] = []
    at = 0
    for tag in TAG.finditer(source):
        if tag.start() > at:
            parts.append(("text", source[at : tag.start()]))
        if tag[1] is not None:
            parts.append(("expr", tag[1]))
        elif tag[2] is not None:
            parts.append(("stmt", tag[2]))
        at = tag.end()
    if at < len(source):
        parts.append(("text", source[at:]))
    body, end, left = _block(parts, 0, ())
    if left < len(parts):
        raise TemplateError(f"{end!r} without its opening")
    return body


def _block(parts: list[tuple[str, str]], at: int, closers: tuple[str, ...]) -> tuple[Node, str, int]:
    """Nodes up to one of ``closers``; the closing statement and its place."""
    nodes: list[Node] = []
    while at < len(parts):
        kind, value = parts[at]
        word = value.split(None, 1)[0] if kind == "stmt" and value else ""
        if kind == "text":
            nodes.append(("text", value))
        elif kind == "expr":
            nodes.append(("out", Expression(value).whole()))
        elif word in closers or word in ("elif", "else") or word.startswith("end"):
            return ("block", *nodes), value, at
        elif word == "for":
            match = re.fullmatch(r"for\s+([A-Za-z_]\w*)\s+in\s+(.+)", value, re.S)
            if match is None:
                raise TemplateError(f"cannot read {value!r}")
            body, end, at = _block(parts, at + 1, ("endfor",))
            _closed(end, "endfor")
            nodes.append(("for", match[1], Expression(match[2]).whole(), body))
        elif word == "if":
            node, at = _if(parts, at, value[2:])
            nodes.append(node)
        elif word == "generation":
            body, end, at = _block(parts, at + 1, ("endgeneration",))
            _closed(end, "endgeneration")
            nodes.append(("generation", body))
        elif word == "set":
            name, eq, expr = value[3:].partition("=")
            if not eq or not name.strip().isidentifier():
                raise TemplateError(f"cannot read {value!r}")
            nodes.append(("set", name.strip(), Expression(expr).whole()))
        else:
            raise TemplateError(f"unknown statement {value!r}")
        at += 1
    if closers:
        raise TemplateError(f"{closers[0]} missing")
    return ("block", *nodes), "", at


def _if(parts: list[tuple[str, str]], at: int, condition: str) -> tuple[Node, int]:
    body, end, at = _block(parts, at + 1, ("endif",))
    if end.startswith("elif"):
        other, at = _if(parts, at, end[4:])
    elif end == "else":
        other, end, at = _block(parts, at + 1, ("endif",))
        _closed(end, "endif")
    else:
        _closed(end, "endif")
        other = ("block",)
    return ("if", Expression(condition).whole(), body, other), at


def _closed(end: str, wanted: str) -> None:
    if end != wanted:
        raise TemplateError(f"{wanted} expected, not {end!r}")


BINARY: dict[str, Callable[[Any, Any], Any]] = {
    "+": lambda a, b: a + b, "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, ">": lambda a, b: a > b, "in": lambda a, b: a in b,
}


def fold(node: Node, filters: dict[str, Callable]) -> Node:
    """The same tree with constant expressions, branches and neighbouring texts put together."""
    kind = node[0]
    if kind in ("text", "const", "var"):
        return node
    if kind == "block":
        nodes: list[Node] = []
        for x in (fold(x, filters) for x in node[1:]):
            for y in x[1:] if x[0] == "block" else (x,):
                if y[0] == "text" and nodes and nodes[-1][0] == "text":
                    nodes[-1] = ("text", nodes[-1][1] + y[1])
                else:
                    nodes.append(y)
        return ("block", *nodes)
    if kind == "for":
        return ("for", node[1], fold(node[2], filters), fold(node[3], filters))
    if kind == "set":
        return ("set", node[1], fold(node[2], filters))
    if kind == "filter" and node[2] not in filters:
        raise TemplateError(f"unknown filter {node[2]!r}")
    node = (kind, *[fold(x, filters) if isinstance(x, tuple) else x for x in node[1:]])
    fixed = [x[1] for x in node[1:] if isinstance(x, tuple) and x[0] == "const"]
    if kind == "out":
        return ("text", _text(fixed[0])) if fixed else node
    if kind == "if":
        return (node[2] if fixed[0] else node[3]) if node[1][0] == "const" else node
    if kind == "filter" and fixed:
        return ("const", filters[node[2]](fixed[0]))
    if kind == "not" and fixed:
        return ("const", not fixed[0])
    if kind in BINARY and len(fixed) == 2:
        return ("const", BINARY[kind](*fixed))
    if kind in ("and", "or") and node[1][0] == "const":
        return node[2] if bool(fixed[0]) == (kind == "and") else node[1]
    return node


def _text(value: Any) -> str:
    return "" if value is None else value if isinstance(value, str) else str(value)


def _field(holder: Any, key: Any) -> Any:
    return holder.get(key) if isinstance(holder, dict) else None


def _value(node: Node, filters: dict[str, Callable]) -> Callable[[dict], Any]:
    kind, parts = node[0], node[1:]
    if kind == "const":
        return lambda scope, c=parts[0]: c
    if kind == "var":
        return lambda scope, n=parts[0]: scope.get(n)
    a = _value(parts[0], filters)
    if kind == "filter":
        return lambda scope, f=filters[parts[1]]: f(a(scope))
    if kind == "not":
        return lambda scope: not a(scope)
    b = _value(parts[1], filters)
    if kind == "field":
        return lambda scope: _field(a(scope), b(scope))
    if kind == "and":
        return lambda scope: a(scope) and b(scope)
    if kind == "or":
        return lambda scope: a(scope) or b(scope)
    return lambda scope, f=BINARY[kind]: f(a(scope), b(scope))


class Sink:
    """Collects output; ``spans`` are the code points written between generation markers."""

    def __init__(self):
        self.parts: list[str] = []
        self.size, self.depth, self.spans = 0, 0, []

    def write(self, text: str) -> None:
        self.parts.append(text)
        self.size += len(text)

    def flush(self) -> tuple[str, list[tuple[int, int]]]:
        piece, spans = "".join(self.parts), self.spans
        self.parts, self.size, self.spans = [], 0, []
        return piece, spans


def _writer(node: Node, filters: dict[str, Callable]) -> Callable[[dict, Sink], Iterable]:
    """A closure that writes the node; it yields after every round of a loop, so that a caller may flush the sink."""
    kind, parts = node[0], node[1:]
    if kind == "text":
        return lambda scope, sink: sink.write(parts[0]) or ()
    if kind == "out":
        value = _value(parts[0], filters)
        return lambda scope, sink: sink.write(_text(value(scope))) or ()
    if kind == "set":
        value = _value(parts[1], filters)
        return lambda scope, sink: scope.__setitem__(parts[0], value(scope)) or ()
    if kind == "if":
        test, yes, no = _value(parts[0], filters), _writer(parts[1], filters), _writer(parts[2], filters)
        return lambda scope, sink: (yes if test(scope) else no)(scope, sink)
    if kind == "generation":
        body = _writer(parts[0], filters)

        def generation(scope, sink):
            start = sink.size
            for _ in body(scope, sink):
                pass  # a span is never cut
            sink.spans.append((start, sink.size))
            return ()

        return generation
    if kind == "for":
        items, body = _value(parts[1], filters), _writer(parts[2], filters)

        def loop(scope, sink):
            for i, item in enumerate(items(scope) or ()):
                inner = scope | {parts[0]: item, "loop": {"index0": i, "index": i + 1, "first": i == 0}}
                yield from body(inner, sink)
                yield

        return loop
    bodies = [_writer(x, filters) for x in parts]

    def block(scope, sink):
        for body in bodies:
            yield from body(scope, sink)

    return block


class Template:
    def __init__(self, source: str, filters: dict[str, Callable[[Any], Any]] | None = None):
        self.filters = filters or {}
        self.tree = fold(parse(source), self.filters)
        self._write = _writer(self.tree, self.filters)

    def pieces(self, scope: dict, limit: int) -> Iterator[tuple[str, list[tuple[int, int]]]]:
        """Output and generation spans, cut after loop rounds once ``limit`` code points are reached. Loops may run over iterators."""
        sink = Sink()
        for _ in self._write(dict(scope), sink):
            if sink.size >= limit:
                yield sink.flush()
        yield sink.flush()

    def render(self, scope: dict) -> tuple[str, list[tuple[int, int]]]:
        return next(self.pieces(scope, 1 << 62))
