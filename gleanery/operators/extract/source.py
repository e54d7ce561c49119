"""What the extractors share: definitions, and source text with comments and literals blanked out."""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass

OPEN, CLOSE = "([{", ")]}"


@dataclass(frozen=True)
class Definition:
    kind: str
    name: str
    start_line: int
    end_line: int
    text: str


class Source:
    """`code` is `text` with each character of a blank span (but line ends) as a space, so places agree.

    `pairs` gives for an opening bracket the place of its closing one (the
    text's last place if there is none), and `around` for a brace the nearest
    brace that is open there.
    """

    def __init__(self, text: str, blank: re.Pattern, is_blank=None):
        self.text = text
        out, at = [], 0
        for m in blank.finditer(text):
            if is_blank is None or is_blank(text, m):
                out += [text[at : m.start()], re.sub(r"[^\n]", " ", m[0])]
                at = m.end()
        self.code = "".join([*out, text[at:]])
        self.lines = [i for i, c in enumerate(text) if c == "\n"]
        self.pairs: dict[int, int] = {}
        self.around: dict[int, int] = {}
        self.outer: dict[int, int] = {}
        stack: list[int] = []
        for m in re.finditer(r"[()\[\]{}]", self.code):
            i, c = m.start(), m[0]
            if c in OPEN:
                if c == "{":
                    self.around[i] = next((j for j in reversed(stack) if self.code[j] == "{"), -1)
                self.outer[i] = stack[-1] if stack else -1
                stack.append(i)
            else:
                # a bracket that was never opened is passed over, one never closed ends with its parent
                kind = OPEN[CLOSE.index(c)]
                if any(self.code[j] == kind for j in stack):
                    while self.code[stack[-1]] != kind:
                        self.pairs[stack.pop()] = i
                    self.pairs[stack.pop()] = i
        for i in stack:
            self.pairs[i] = len(text) - 1
        self.brackets = sorted(self.pairs)
        self.braces = [i for i in self.brackets if self.code[i] == "{"]

    def line(self, at: int) -> int:
        return bisect_right(self.lines, at - 1) + 1

    def define(self, kind: str, name: str, start: int, end: int) -> Definition:
        """The span from start to end, the latter included."""
        return Definition(kind, name, self.line(start), self.line(end), self.text[start : end + 1])

    def nearest(self, at: int) -> int:
        """The nearest bracket of any kind that is open at a place."""
        k = bisect_right(self.brackets, at - 1) - 1
        here = self.brackets[k] if k >= 0 else -1
        while here >= 0 and self.pairs[here] < at:
            here = self.outer[here]
        return here

    def enclosing(self, at: int) -> list[int]:
        """Braces open at a place, the nearest first."""
        k = bisect_right(self.braces, at - 1) - 1
        here = self.braces[k] if k >= 0 else -1
        while here >= 0 and self.pairs[here] < at:
            here = self.around[here]
        found = []
        while here >= 0:
            found.append(here)
            here = self.around[here]
        return found

    def skip(self, at: int) -> int:
        """The first place from `at` that is not white space."""
        while at < len(self.code) and self.code[at].isspace():
            at += 1
        return at

    def before(self, at: int) -> int:
        """The last place before `at` that is not white space."""
        at -= 1
        while at >= 0 and self.code[at].isspace():
            at -= 1
        return at
