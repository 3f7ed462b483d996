"""A small sandboxed template language, compiled to Python closures.

Syntax: ``{{ expr }}``, ``{% for x in expr %}``, ``{% if expr %} .. {% elif %} .. {% else %} .. {% endif %}`` and
``{% generation %} .. {% endgeneration %}`` for text that carries loss. Expressions: names, ``a.b`` (keys of mappings
only), string and integer literals, ``==``, ``!=``, ``and``, ``or``, ``not``, ``~`` (join), ``x | filter``. Nothing
else can be reached: no calls, no Python attributes, no evaluation of source text.

``compile_template`` parses to a tree, folds constant parts, and returns ``render(context)``, which yields
``(piece, in_generation)`` lazily, so a conversation of any length is rendered in bounded memory.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

_TAG = re.compile(r"\{\{(.*?)\}\}|\{%(.*?)%\}", re.S)
_TOKEN = re.compile(r"\s*(?:('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(\d+)|([A-Za-z_]\w*)|(==|!=|[.|~()]))")


class TemplateError(ValueError):
    pass


def _tokens(source: str) -> list[tuple[str, object]]:
    out, at = [], 0
    while source[at:].strip():
        m = _TOKEN.match(source, at)
        if not m:
            raise TemplateError(f"unexpected text in expression: {source[at:]!r}")
        text, number, name, mark = m.groups()
        if text is not None:
            plain = re.sub(r"\\(.)", lambda x: {"n": "\n", "t": "\t"}.get(x[1], x[1]), text[1:-1])
            out.append(("const", plain))
        elif number is not None:
            out.append(("const", int(number)))
        elif name in ("and", "or", "not"):
            out.append((name, name))
        else:
            out.append(("name", name) if name else (mark, mark))
        at = m.end()
    return [*out, ("end", None)]


class _Parser:
    """Recursive descent over one expression; precedence: or, and, not, comparison, join, filter."""

    def __init__(self, source: str, filters: dict[str, Callable]):
        self.rest, self.filters = _tokens(source), filters

    def take(self, *kinds):
        if self.rest[0][0] in kinds:
            return self.rest.pop(0)
        return None

    def whole(self):
        tree = self.either()
        if not self.take("end"):
            raise TemplateError(f"unexpected {self.rest[0][1]!r}")
        return tree

    def _chain(self, below, kinds):
        tree = below()
        while op := self.take(*kinds):
            tree = (op[0], tree, below())
        return tree

    def either(self):
        return self._chain(self.both, ("or",))

    def both(self):
        return self._chain(self.negated, ("and",))

    def negated(self):
        return ("not", self.negated()) if self.take("not") else self._chain(self.joined, ("==", "!="))

    def joined(self):
        return self._chain(self.filtered, ("~",))

    def filtered(self):
        tree = self.atom()
        while self.take("|"):
            name = self.take("name")
            if not name or name[1] not in self.filters:
                raise TemplateError("unknown filter")
            tree = ("filter", self.filters[name[1]], tree)
        return tree

    def atom(self):
        if self.take("("):
            tree = self.either()
            if not self.take(")"):
                raise TemplateError("missing )")
            return tree
        if value := self.take("const"):
            return value
        name = self.take("name")
        if not name:
            raise TemplateError(f"unexpected {self.rest[0][1]!r}")
        tree = ("name", name[1])
        while self.take("."):
            key = self.take("name")
            if not key or key[1].startswith("_"):
                raise TemplateError("bad key")
            tree = ("key", tree, key[1])
        return tree


def parse(source: str, filters: dict[str, Callable]) -> list:
    """The syntax tree: a list of text, print, for, if and generation nodes."""
    root: list = []
    stack: list[tuple[str, list, list]] = [("", root, root)]
    expr = lambda s: _Parser(s, filters).whole()
    at = 0
    for m in _TAG.finditer(source):
        here = stack[-1][2]
        if m.start() > at:
            here.append(("text", source[at : m.start()]))
        at = m.end()
        if m[1] is not None:
            here.append(("print", expr(m[1])))
            continue
        word, _, rest = m[2].strip().partition(" ")
        if word == "for":
            var, _, over = rest.partition(" in ")
            if not re.fullmatch(r"[A-Za-z]\w*", var.strip()):
                raise TemplateError("bad loop variable")
            body: list = []
            here.append(("for", var.strip(), expr(over), body))
            stack.append(("for", here, body))
        elif word == "generation":
            body = []
            here.append(("generation", body))
            stack.append(("generation", here, body))
        elif word == "if":
            arms: list = [(expr(rest), [])]
            here.append(("if", arms))
            stack.append(("if", arms, arms[0][1]))
        elif word in ("elif", "else") and stack[-1][0] == "if":
            arms = stack[-1][1]
            arms.append((expr(rest) if word == "elif" else ("const", True), []))
            stack[-1] = ("if", arms, arms[-1][1])
        elif word == "end" + stack[-1][0] and len(stack) > 1:
            stack.pop()
        else:
            raise TemplateError(f"unexpected tag {word!r}")
    if len(stack) > 1:
        raise TemplateError(f"unclosed {stack[-1][0]}")
    if at < len(source):
        root.append(("text", source[at:]))
    return root


_BINARY = {
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "and": lambda a, b: a and b,
    "or": lambda a, b: a or b,
    "~": lambda a, b: f"{a}{b}",
}


def fold_expr(tree):
    """Constant parts of an expression become one constant."""
    kind = tree[0]
    if kind in ("const", "name"):
        return tree
    if kind == "key":
        return ("key", fold_expr(tree[1]), tree[2])
    if kind == "filter":
        inner = fold_expr(tree[2])
        return ("const", tree[1](inner[1])) if inner[0] == "const" else ("filter", tree[1], inner)
    if kind == "not":
        inner = fold_expr(tree[1])
        return ("const", not inner[1]) if inner[0] == "const" else ("not", inner)
    a, b = fold_expr(tree[1]), fold_expr(tree[2])
    if a[0] == b[0] == "const":
        return ("const", _BINARY[kind](a[1], b[1]))
    return (kind, a, b)


def fold(nodes: list) -> list:
    """Constant prints become text, arms that can't be taken go, neighbouring texts join."""
    out: list = []

    def add(node):
        if node[0] == "text" and out and out[-1][0] == "text":
            out[-1] = ("text", out[-1][1] + node[1])
        elif node != ("text", ""):
            out.append(node)

    for node in nodes:
        if node[0] == "print":
            e = fold_expr(node[1])
            add(("text", str(e[1])) if e[0] == "const" else ("print", e))
        elif node[0] == "for":
            out.append(("for", node[1], fold_expr(node[2]), fold(node[3])))
        elif node[0] == "generation":
            out.append(("generation", fold(node[1])))
        elif node[0] == "if":
            arms = []
            for test, body in node[1]:
                test = fold_expr(test)
                if test[0] == "const" and not test[1]:
                    continue
                arms.append((test, fold(body)))
                if test[0] == "const":
                    break
            if arms and arms[0][0][0] == "const":
                for x in arms[0][1]:
                    add(x)
            elif arms:
                out.append(("if", arms))
        else:
            add(node)
    return out


def _value(tree) -> Callable[[dict], object]:
    kind = tree[0]
    if kind == "const":
        return lambda c, v=tree[1]: v
    if kind == "name":
        return lambda c, k=tree[1]: c[k]
    if kind == "key":
        inner, key = _value(tree[1]), tree[2]

        def get(c):
            value = inner(c)
            if not isinstance(value, dict):
                raise TemplateError("only mappings have keys")
            return value[key]

        return get
    if kind == "filter":
        inner, use = _value(tree[2]), tree[1]
        return lambda c: use(inner(c))
    if kind == "not":
        inner = _value(tree[1])
        return lambda c: not inner(c)
    a, b, op = _value(tree[1]), _value(tree[2]), _BINARY[kind]
    if kind == "and":
        return lambda c: a(c) and b(c)
    if kind == "or":
        return lambda c: a(c) or b(c)
    return lambda c: op(a(c), b(c))


Piece = tuple[str, bool]


def _body(nodes: list, loss: bool) -> Callable[[dict], Iterator[Piece]]:
    parts = [_node(n, loss) for n in nodes]

    def run(c):
        for p in parts:
            yield from p(c)

    return run


def _node(node, loss: bool) -> Callable[[dict], Iterator[Piece]]:
    kind = node[0]
    if kind == "text":
        pieces = [(node[1], loss)]
        return lambda c: pieces
    if kind == "print":
        value = _value(node[1])
        return lambda c: [(str(value(c)), loss)]
    if kind == "generation":
        return _body(node[1], True)
    if kind == "for":
        name, over, body = node[1], _value(node[2]), _body(node[3], loss)

        def loop(c):
            for x in over(c):
                yield from body({**c, name: x})

        return loop
    arms = [(_value(t), _body(b, loss)) for t, b in node[1]]

    def choose(c):
        for test, body in arms:
            if test(c):
                return body(c)
        return ()

    return choose


def compile_template(source: str, filters: dict[str, Callable] | None = None) -> Callable[[dict], Iterator[Piece]]:
    return _body(fold(parse(source, filters or {})), False)
