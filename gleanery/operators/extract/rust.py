"""Rust: functions and methods, structs, enums, and traits as interfaces."""

from __future__ import annotations

import re

from .source import Definition, Source

BLANK = re.compile(
    r"//[^\n]*|/\*|\bb?r(?P<hash>#*)\".*?\"(?P=hash)|b?\"(?:\\.|[^\"\\])*\"?|b?'(?:\\(?:u\{[^}]*\}|x..|.)|[^'\\\n])'",
    re.S,
)
ITEM = re.compile(
    r"(?<![\w.:])(?P<before>(?:pub(?:\s*\([^)]*\))?\s+)?(?:default\s+)?(?:(?:const|async|unsafe|extern)\s+)*)"
    r"(?P<kind>fn|struct|enum|trait)\s+(?P<name>\w+)",
)
KINDS = {"struct": "struct", "enum": "enum", "trait": "interface"}
HEAD = re.compile(r"(?:\b(?P<impl>impl)\b|\btrait\s+(?P<trait>\w+))")


def without_block_comments(text: str) -> str:
    """Block comments nest, so they are blanked by counting; other literals are passed over."""
    out, at = [], 0
    while (m := BLANK.search(text, at)) is not None:
        out.append(text[at : m.start()])
        end = m.end()
        if m[0] == "/*":
            depth = 1
            while depth and (n := re.compile(r"/\*|\*/").search(text, end)):
                depth += 1 if n[0] == "/*" else -1
                end = n.end()
            end = end if not depth else len(text)
        out.append(re.sub(r"[^\n]", " ", text[m.start() : end]))
        at = end
    return "".join([*out, text[at:]])


class RustSource(Source):
    def __init__(self, text: str):
        super().__init__(without_block_comments(text), re.compile(r"(?!)"))
        self.text = text


def extract(text: str) -> list[Definition]:
    src, found = RustSource(text), []
    containers = {}
    for m in ITEM.finditer(src.code):
        kind, start = m["kind"], m.start()
        end = item_end(src, m.end(), kind)
        if end is None:
            continue
        if kind != "fn":
            found.append(src.define(KINDS[kind], m["name"], start, end))
            continue
        owner = None
        for brace in src.enclosing(start):
            if brace not in containers:
                containers[brace] = container(src, brace)
            if containers[brace] is not None:
                owner = containers[brace]
                break
        found.append(src.define("method" if owner else "func", f"{owner}.{m['name']}" if owner else m["name"], start, end))
    return found


def item_end(src: Source, at: int, kind: str) -> int | None:
    """End of the body, or of a struct without one; None for a function without a body."""
    code = src.code
    while at < len(code):
        c = code[at]
        if c in "([":
            at = src.pairs[at]
        elif c == "{":
            return src.pairs[at]
        elif c == ";":
            return at if kind == "struct" else None
        elif c == "}":
            return None
        at += 1
    return None


def container(src: Source, brace: int) -> str | None:
    """The type of an impl or the name of a trait whose body opens here, else None."""
    start = max(src.code.rfind(c, 0, brace) for c in ";{}") + 1
    head = src.code[start:brace]
    m = HEAD.search(head)
    if not m or re.search(r"\bfn\b", head):
        return None
    if m["trait"]:
        return m["trait"]
    rest = skip_generics(head[m.end() :].lstrip())
    rest = re.split(r"\bwhere\b", rest)[0]
    return type_name(after_for(rest))


def skip_generics(s: str) -> str:
    """What stands behind leading <…>; the > of an arrow does not count."""
    if not s.startswith("<"):
        return s
    depth = 0
    for i, c in enumerate(s):
        if c == "<":
            depth += 1
        elif c == ">" and s[i - 1] != "-":
            depth -= 1
            if not depth:
                return s[i + 1 :].lstrip()
    return ""


def after_for(s: str) -> str:
    """The type of `Trait for Type`; `for<'a>` inside of angle brackets does not count."""
    depth = 0
    for i, c in enumerate(s):
        if c in "<([":
            depth += 1
        elif c in ")]" or c == ">" and s[i - 1] != "-":
            depth -= 1
        elif not depth and re.match(r"\bfor\b(?!\s*<)", s[i:]) and (i == 0 or not (s[i - 1].isalnum() or s[i - 1] == "_")):
            return s[i + 3 :]
    return s


def type_name(s: str) -> str | None:
    """Generics, references and pointers are unwrapped; of a path the first name counts."""
    plain = re.sub(r"^(?:\s|&|\*|'\w+|\bmut\b|\bconst\b|\bdyn\b|\()+", "", s)
    m = re.match(r"\w+", plain)
    return m[0] if m else None
