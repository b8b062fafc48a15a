"""Python sources as flat events; names, packages and calls are resolved by joins, not in here."""

from __future__ import annotations

import ast
from collections.abc import Iterator

EVENTS = "path string, kind string, class string, symbol string, line int, ord long, name string, attr string, module string, level int, shadowed boolean"

_FUNCTION = (ast.FunctionDef, ast.AsyncFunctionDef)


def _inside(node: ast.AST) -> Iterator[ast.AST]:
    """A statement and what is in it, but for functions and classes nested deeper."""
    yield node
    for child in ast.iter_child_nodes(node):
        if not isinstance(child, (*_FUNCTION, ast.ClassDef)):
            yield from _inside(child)


def _calls(owner: str, function: ast.AST) -> Iterator[tuple]:
    nodes = [x for statement in function.body for x in _inside(statement)]
    a = function.args
    local = {x.arg for x in (*a.posonlyargs, *a.args, *a.kwonlyargs, *filter(None, (a.vararg, a.kwarg)))}
    local |= {x.id for x in nodes if isinstance(x, ast.Name) and isinstance(x.ctx, ast.Store)}
    for x in nodes:
        if isinstance(x, ast.Call):
            f = x.func
            if isinstance(f, ast.Name):
                yield "call", owner, function.name, function.lineno, f.id, None, None, 0, f.id in local
            elif isinstance(f, ast.Attribute) and isinstance(f.value, ast.Name):
                yield "call", owner, function.name, function.lineno, f.value.id, f.attr, None, 0, f.value.id in local


def events_of(source: str) -> Iterator[tuple]:
    """kind, class, symbol, line, name, attr, module, level, shadowed."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError):
        yield "failed", "", "", 0, None, None, None, 0, False
        return
    yield "parsed", "", "", 0, None, None, None, 0, False
    for node in tree.body:
        if isinstance(node, _FUNCTION):
            yield "function", "", node.name, node.lineno, node.name, None, None, 0, False
            yield from _calls("", node)
        elif isinstance(node, ast.ClassDef):
            yield "class", "", node.name, node.lineno, node.name, None, None, 0, False
            for item in node.body:
                if isinstance(item, _FUNCTION):
                    yield "method", node.name, item.name, item.lineno, item.name, None, None, node.lineno, False
                    yield from _calls(node.name, item)
    for node in ast.walk(tree):
        if isinstance(node, ast.Import):
            for alias in node.names:
                yield "import", "", "", node.lineno, alias.name, alias.asname, None, 0, False
        elif isinstance(node, ast.ImportFrom):
            yield "from", "", "", node.lineno, None, None, node.module, node.level, False
            for alias in node.names:
                yield "from_name", "", "", node.lineno, alias.name, alias.asname, node.module, node.level, False
