"""Python: classes, and functions as methods of the nearest class around them."""

from __future__ import annotations

import ast
import re

from .source import Definition

HEAD = re.compile(r"^(?P<indent>[ \t]*)(?P<text>(?:async[ \t]+)?(?P<kind>def|class)[ \t]+(?P<name>\w+))", re.M)


def extract(text: str) -> list[Definition]:
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return by_indent(text)
    lines, found = text.encode().splitlines(keepends=True), []
    stack: list[tuple[ast.AST, str | None]] = [(tree, None)]
    while stack:
        node, owner = stack.pop()
        if isinstance(node, (ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef)):
            is_class = isinstance(node, ast.ClassDef)
            kind = "class" if is_class else "method" if owner else "func"
            name = node.name if is_class or not owner else f"{owner}.{node.name}"
            found.append(Definition(kind, name, node.lineno, node.end_lineno, segment(lines, node)))
            owner = node.name if is_class else owner
        stack += [(child, owner) for child in reversed(list(ast.iter_child_nodes(node)))]
    return sorted(found, key=lambda d: d.start_line)


def segment(lines: list[bytes], node) -> str:
    """The node's text from its own column on; columns count bytes."""
    own = lines[node.lineno - 1 : node.end_lineno]
    own[-1] = own[-1][: node.end_col_offset]
    own[0] = own[0][node.col_offset :]
    return b"".join(own).decode("utf-8", "replace")


def by_indent(text: str) -> list[Definition]:
    """For text that doesn't parse: a definition lasts while lines are indented deeper."""
    lines, found = text.split("\n"), []
    open_classes: list[tuple[int, str]] = []
    for m in HEAD.finditer(text):
        indent, start = len(m["indent"].expandtabs()), text.count("\n", 0, m.start()) + 1
        open_classes = [(i, n) for i, n in open_classes if i < indent]
        end = start
        for k in range(start, len(lines)):
            if lines[k].strip() and len(lines[k].expandtabs()) - len(lines[k].expandtabs().lstrip()) <= indent:
                break
            end = k + 1 if lines[k].strip() else end
        own = "\n".join(lines[start - 1 : end])[len(m["indent"]) :]
        if m["kind"] == "class":
            found.append(Definition("class", m["name"], start, end, own))
            open_classes.append((indent, m["name"]))
        else:
            owner = open_classes[-1][1] if open_classes else None
            found.append(Definition("method" if owner else "func", f"{owner}.{m['name']}" if owner else m["name"], start, end, own))
    return found
