"""JavaScript and TypeScript: functions, classes, interfaces, and methods by their class or interface."""

from __future__ import annotations

import re

from .source import Definition, Source

BLANK = re.compile(
    r"//[^\n]*|/\*.*?(?:\*/|\Z)|\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'?|`(?:\\.|[^`\\])*`?"
    r"|(?P<regex>/(?![*/\s])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*)",
    re.S,
)
FUNCTION = re.compile(r"(?<![\w$.])(?P<start>(?:async\s+)?function)\s+(?P<name>[\w$]+)\s*(?=[<(])")
CLASS = re.compile(r"(?<![\w$.])(?P<abstract>abstract\s+)?(?P<kind>class|interface)\s+(?P<name>[\w$]+)(?=[^\w$])")
METHOD = re.compile(
    r"(?<![\w$.#'\"])(?P<mods>(?:(?:public|private|protected|static|override|readonly|abstract|async|get|set)\s+)*\*?\s*)(?P<name>[\w$]+)\??\s*(?=[<(])"
)
#: Words before a parenthesis that are no method's name.
RESERVED = frozenset("if for while switch catch function return new typeof await super with do else throw delete void in of yield case class import export".split())
#: Before a brace, these make it an object literal.
BEFORE_OBJECT = re.compile(r"(?:[=(,:\[?&|!]|\breturn|\bdefault|\.\.\.)\s*\Z")


def behind(code: str, at: int) -> str:
    """The last characters before a place."""
    return code[max(0, at - 80) : at]


def is_literal(text: str, m: re.Match) -> bool:
    """A slash begins a pattern where no value stands before it."""
    if m["regex"] is None:
        return True
    before = behind(text, m.start()).rstrip()
    return not before or before[-1] in "(,=:[!&|?{};~+-*%<>" or bool(re.search(r"\b(?:return|typeof|case|in|of)\Z", before))


def extract(text: str, typed: bool) -> list[Definition]:
    src = Source(text, BLANK, is_literal)
    code, found = src.code, []
    bodies: dict[int, tuple[str, str]] = {}
    for m in CLASS.finditer(code):
        if m["kind"] == "interface" and not typed:
            continue
        opened = head_end(src, m.end())
        if opened is None:
            continue
        statement = m["kind"] == "interface" or not re.search(r"[=(,:?]\s*\Z|\breturn\s*\Z", behind(code, m.start()))
        # a class expression is no container, and an abstract class is not extracted itself
        if statement and not m["abstract"]:
            found.append((m.start("kind"), src.define(m["kind"], m["name"], m.start("kind"), src.pairs[opened])))
        bodies[opened] = (m["kind"] if statement and not m["abstract"] else "other", m["name"])
    for m in re.finditer(r"(?<![\w$.])class\s*(?=\{|extends\b)", code):
        if (opened := head_end(src, m.end())) is not None:
            bodies.setdefault(opened, ("other", ""))
    for m in FUNCTION.finditer(code):
        statement = not re.search(r"[=(,:?!&|+]\s*\Z|\b(?:return|new|void|typeof)\s*\Z|=>\s*\Z", behind(code, m.start()))
        end = body(src, m.end())
        if statement and end is not None and code[end] == "{":
            found.append((m.start("start"), src.define("func", m["name"], m.start("start"), src.pairs[end])))
    for m in METHOD.finditer(code):
        if (d := method(src, m, bodies, typed)) is not None:
            found.append((m.start(), d))
    return [d for _, d in sorted(found, key=lambda x: x[0])]


def head_end(src: Source, at: int) -> int | None:
    """The brace of a class or interface behind its head; type arguments may hold braces of their own."""
    depth = 0
    while at < len(src.code):
        c = src.code[at]
        if c == "<":
            depth += 1
        elif c == ">":
            depth -= 1
        elif c == "{" and depth <= 0:
            return at
        elif c in "([{":
            at = src.pairs[at]
        elif c in ";)}":
            return None
        at += 1
    return None


def body(src: Source, at: int) -> int | None:
    """What ends a signature that begins with type parameters or a parenthesis: its body's brace or a semicolon."""
    code = src.code
    at = src.skip(at)
    if code[at : at + 1] == "<":
        depth = 0
        while at < len(code):
            depth += (code[at] == "<") - (code[at] == ">" and code[at - 1] != "=")
            at += 1
            if not depth:
                break
        at = src.skip(at)
    if code[at : at + 1] != "(":
        return None
    at = src.skip(src.pairs[at] + 1)
    if code[at : at + 1] == ":":
        at = src.skip(at + 1)
        # a return type: a brace that begins it is a type, one behind it the body
        first = True
        while at < len(code):
            c = code[at]
            last = src.before(at)
            if c == "{" and not first and code[last] not in "|&:<,=" and code[last - 1 : last + 1] != "=>":
                return at
            if c in ";}\n," and not first:
                return at
            if c in "([{":
                at = src.pairs[at]
            first = first and c.isspace()
            at += 1
        return None
    return at if at < len(code) else None


def method(src: Source, m: re.Match, bodies: dict[int, tuple[str, str]], typed: bool) -> Definition | None:
    code, name = src.code, m["name"]
    start = m.start() + (len(m["mods"]) - len(m["mods"].lstrip()) if m["mods"] else 0)
    if name in RESERVED or name[0].isdigit():
        return None
    around = src.enclosing(start)
    if not around:
        return None
    inside = bodies.get(around[0])
    last = src.before(start)
    if last >= 0 and code[last] not in "{},;)" and not (inside and "\n" in code[last:start]) and not code[last] == ">":
        return None
    if inside is None and (not BEFORE_OBJECT.search(behind(code, around[0])) or code[last] not in "{,"):
        return None
    # directly inside that brace, not in parentheses within it
    if src.nearest(start) != around[0]:
        return None
    end = body(src, m.end())
    if end is None:
        return None
    if code[end] == "{":
        close = src.pairs[end]
    elif typed and inside and inside[0] == "interface":
        close = src.before(end)
    else:
        return None
    owner = next((bodies[b][1] for b in around if bodies.get(b, ("other",))[0] in ("class", "interface")), None)
    return src.define("method", f"{owner}.{name}" if owner else name, start, close)

