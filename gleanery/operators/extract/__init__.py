"""Definitions in source text, by file extension. Each gives one symbol and one chunk."""

from __future__ import annotations

from . import golang, python, rust, script
from .source import Definition

#: Extension -> language.
EXTRACTORS = {"rs": "rust", "go": "go", "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "py": "python"}


def extract(path: str, text: str) -> list[Definition]:
    """Definitions in order of their start; none for other extensions."""
    language = EXTRACTORS.get(path.rpartition(".")[2] if "." in path.rpartition("/")[2] else "")
    if language == "rust":
        return rust.extract(text)
    if language == "go":
        return golang.extract(text)
    if language == "python":
        return python.extract(text)
    if language in ("javascript", "typescript"):
        return script.extract(text, language == "typescript")
    return []
