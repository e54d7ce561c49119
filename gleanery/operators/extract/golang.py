"""Go: functions, methods with their receiver's type, and types."""

from __future__ import annotations

import re

from .source import Definition, Source

BLANK = re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|`[^`]*`?|\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])+'", re.S)
FUNC = re.compile(r"^func\b[ \t]*(\((?P<receiver>[^()]*(?:\([^()]*\)[^()]*)*)\))?[ \t]*(?P<name>\w+)", re.M)
TYPE = re.compile(r"(?:^|(?<=[;{]))[ \t]*(?P<type>type)\b[ \t]*(?:(?P<group>\()|(?P<name>\w+))", re.M)
SPEC = re.compile(r"(?:^|;)[ \t]*(?P<name>[^\W\d]\w*)[ \t]*(?=[\w*\[({=<])", re.M)


def extract(text: str) -> list[Definition]:
    src = Source(text, BLANK)
    found = [(m.start(), [function(src, m)]) for m in FUNC.finditer(src.code)]
    found += [(m.start("type"), types(src, m)) for m in TYPE.finditer(src.code)]
    return [d for _, own in sorted(found, key=lambda x: x[0]) for d in own]


def function(src: Source, m: re.Match) -> Definition:
    end = body_end(src, m.end())
    if m["receiver"] is None:
        return src.define("func", m["name"], m.start(), end)
    receiver = receiver_type(m["receiver"])
    return src.define("method", f"{receiver}.{m['name']}" if receiver else m["name"], m.start(), end)


def receiver_type(receiver: str) -> str:
    """`s *Service[T]`, `*Service` and `Service` are all Service."""
    plain = re.sub(r"\[.*", "", receiver.split(",")[0]).strip()
    words = re.findall(r"\w+", plain)
    return words[-1] if words else ""


def body_end(src: Source, at: int) -> int:
    """End of the body behind a signature, or of the line if there is none."""
    code = src.code
    while at < len(code):
        c = code[at]
        if c in "([":
            at = src.pairs[at]
        elif c == "{":
            word = re.search(r"(\w+)\s*\Z", code[max(0, at - 40) : at])
            if not word or word[1] not in ("interface", "struct"):
                return src.pairs[at]
            at = src.pairs[at]
        elif c == "\n":
            break
        at += 1
    return src.before(at)


def spec_end(src: Source, at: int) -> int:
    """End of a type behind its name: of the line, but for brackets that go on."""
    code = src.code
    while at < len(code) and code[at] not in "\n;)}":
        at = src.pairs[at] + 1 if code[at] in "([{" else at + 1
    return src.before(at)


def kind_of(src: Source, at: int) -> str:
    """Kind of the type behind a name and its type parameters."""
    at = src.skip(at)
    if src.code[at : at + 1] == "[" and re.match(r"\[\s*\w+\s+[^\]\s]", src.code[at:]):
        at = src.skip(src.pairs[at] + 1)
    word = re.match(r"\w*", src.code[at:])[0]
    return word if word in ("interface", "struct") else "type"


def types(src: Source, m: re.Match) -> list[Definition]:
    """One symbol for each type of a group; all have the group's text and the first one's kind."""
    start = m.start("type")
    if not m["group"]:
        return [src.define(kind_of(src, m.end("name")), m["name"], start, spec_end(src, m.end("name")))]
    opened = m.start("group")
    end, at, names = src.pairs[opened], opened + 1, []
    while at < end:
        at = src.skip(at)
        spec = re.compile(r"([^\W\d]\w*)").match(src.code, at, end)
        if not spec:
            at += 1
            continue
        names.append((spec[1], spec.end()))
        at = spec_end(src, spec.end()) + 1
        while at < end and src.code[at] in " \t;":
            at += 1
    kind = kind_of(src, names[0][1]) if names else "type"
    return [src.define(kind, name, start, end) for name, _ in names]
