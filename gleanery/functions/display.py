"""What a result looks like to a reader."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def base_name(path: Column) -> Column:
    return F.element_at(F.split(F.rtrim(path, F.lit("/")), "/"), -1)


def split_symbol_id(symbol: Column, file_path: Column) -> tuple[Column, Column]:
    """(kind, name): file:<path>, kind:module:name, kind:name, or a symbol named as its file."""
    parts = F.split(symbol, ":")
    is_file, n = F.startswith(symbol, F.lit("file:")), F.size(parts)
    kind = F.when(is_file, F.lit("file")).when(n >= 2, F.get(parts, F.lit(0))).otherwise(F.lit("symbol"))
    name = F.when(is_file, base_name(F.substring(symbol, 6, 1 << 30))).when(n >= 2, F.element_at(parts, -1)).otherwise(base_name(file_path))
    return kind, name


def percent(score: Column) -> Column:
    """Per cent as a float, at most 100."""
    return F.least((score.cast("float") * F.lit(100.0).cast("float")).cast("float"), F.lit(100.0).cast("float"))


def confidence(score: Column) -> Column:
    return F.when(percent(score) > 85, "High").when(percent(score) > 50, "Medium").otherwise("Low")


def shown_percent(score: Column) -> Column:
    """Rounded half to even."""
    return F.bround(percent(score).cast("double"), 0).cast("int")


def line_range(start: Column, end: Column) -> Column:
    return F.when(start == end, start.cast("string")).otherwise(F.concat_ws("-", start, end))


def parse_location(location: Column) -> tuple[Column, Column, Column]:
    """(file, line, error): <file>:<line>, cut at the last colon."""
    tail = F.substring_index(location, ":", -1)
    line = F.when(F.rlike(tail, F.lit(r"^\+?\d+$")), tail).try_cast("long")
    error = F.when(~F.contains(location, F.lit(":")), "Missing file path").when(line.isNull(), "Invalid line number")
    file = F.substring(location, F.lit(1), F.length(location) - F.length(tail) - 1)
    return F.when(error.isNull(), file), F.when(error.isNull(), line), error


def formatted(results_prefix: str = "") -> Column:
    """The text block of a result row."""
    c = lambda name: F.col(results_prefix + name)
    kind, name = split_symbol_id(c("symbol_id"), c("file_path"))
    why = F.when(
        F.size(c("reasons")) > 0,
        F.concat(F.lit("\n  Why:\n"), F.array_join(F.transform(c("reasons"), lambda r: F.concat(F.lit("  - "), r)), "\n"), F.lit("\n")),
    ).otherwise("")
    lines = line_range(c("start_line"), c("end_line"))
    return F.concat(
        F.upper(kind), F.lit("\n  "), name, F.lit("\n\n  Confidence: "), confidence(c("score")), F.lit(" ("), shown_percent(c("score")).cast("string"), F.lit("%)\n"),
        why, F.lit("\n  Symbol:\n  "), c("symbol_id"), F.lit("\n\n  File:\n  "), c("file_path"), F.lit(":"), lines, F.lit("\n"),
    )
