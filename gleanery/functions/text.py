"""Text and symbol expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Longer tokens (in bytes) are not indexed.
TOKEN_BYTES = 40


def terms(text: Column) -> Column:
    """The analyser of indexed fields: lower-case runs of letters and digits of fewer than TOKEN_BYTES bytes."""
    split = F.split(F.lower(text), r"[^\p{L}\p{N}]+")
    return F.filter(split, lambda t: (t != "") & (F.octet_length(t) < TOKEN_BYTES))


def query_tokens(query: Column) -> Column:
    """Lower-case words between white space; punctuation stays."""
    return F.filter(F.split(F.lower(query), r"\s+"), lambda t: t != "")


def symbol_tail(symbol: Column) -> Column:
    """What stands behind the last colon."""
    return F.substring_index(symbol, ":", -1)


def dot_parts(name: Column) -> Column:
    return F.split(name, r"\.")


def joined_symbols(symbols: Column) -> Column:
    return F.array_join(symbols, " ")


def split_symbols(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda t: t != "")


def first_symbol(symbols: Column, file_path: Column) -> Column:
    """The first defined symbol, or file:<path>."""
    return F.coalesce(F.get(symbols, F.lit(0)), F.concat(F.lit("file:"), file_path))


def content_id(text: Column) -> Column:
    """Content-addressed chunk id."""
    return F.sha2(text, 256)


def module_path(path: Column, separator: str = "/") -> Column:
    """The parent directory of a relative path; `crate` at the root."""
    normal = F.replace(path, F.lit("\\"), F.lit("/"))
    parent = F.regexp_replace(normal, "/?[^/]*$", "")
    parent = F.when(parent.isin("", "."), F.lit("crate")).otherwise(parent)
    return parent if separator == "/" else F.replace(parent, F.lit("/"), F.lit(separator))


def symbol_id(kind: Column, module: Column, name: Column) -> Column:
    return F.concat_ws(":", kind, module, name)


def extension(path: Column) -> Column:
    return F.regexp_extract(path, r"\.([^./]+)$", 1)


def relative_path(path: Column, root: Column) -> Column:
    """The path without root in front, else the path itself."""
    trimmed = F.rtrim(root, F.lit("/"))
    return F.when(F.startswith(path, F.concat(trimmed, F.lit("/"))), F.substring(path, F.length(trimmed) + 2, F.length(path))).otherwise(path)
