"""Quality rules by line-first cleaning.

Each line with a word is held against punctuation, navigation and boilerplate
rules; lines that fail any are removed, and a document that loses too much of
its text that way is rejected. Base rules on the whole document come first.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import arrow_bounds, carried, id_text
from .near_dup import _WORDS, mixed

_WS = "[\\x20\\x09-\\x0D]"
SPACES = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
#: A sentence's end: a CJK stop anywhere, or a stop (and closing quotes) before white space or the line's end.
SENTENCE = f"[。！？]|[.!?…؟।۔][\"”’»')\\]]*(?:{_WS}|$)"
#: A mark between items of a menu.
SEPARATOR = f"{_WS}[|»›·•>/](?:{_WS}|$)"
MENU = "(?i)^(?:home|menu|log ?in|sign (?:in|up)|skip to|next|previous|back to|read more|click here|share)(?:[^A-Za-z]|$)"
BOILERPLATE = "(?i)lorem ipsum|javascript|cookie|terms of (?:use|service)|privacy policy|all rights reserved|powered by|subscribe to our"
#: In a line of up to so many words, the navigation and the boilerplate rules hold.
MENU_WORDS, BOILERPLATE_WORDS = 30, 60
#: A menu has so many separators, or one for each so many words.
MENU_MARKS, MENU_ITEM_WORDS = 2, 5
#: So many symbols are noise, if they are beyond SYMBOL_PERCENT too.
LEAST_SYMBOLS = 2
#: Per cent: of symbols to a line's words, of words in repeated windows, and of words removed, beyond which it fails.
SYMBOL_PERCENT, REPEAT_PERCENT, LOSS_PERCENT = 10, 50, 50
LEAST_WORDS = 50

_sentence, _separator, _menu, _boilerplate = map(re.compile, (SENTENCE, SEPARATOR, MENU, BOILERPLATE))


def repeated_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that are found twice or more."""
    n = len(words)
    if n < 4:
        return 0
    w = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, n)
    odd = np.uint64(0x9E3779B97F4A7C15)
    h = mixed(((w[:-2] * odd + w[1:-1]) * odd) + w[2:])
    ordered = np.sort(h)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    hit = np.isin(h, twice)
    covered = np.zeros(n, bool)
    for i in range(3):
        covered[i : n - 2 + i] |= hit
    return int(covered.sum())


def failed_rule(line: str, data: bytes, n_words: int, seen: bool) -> str:
    """The first rule that a line with words fails, or nothing."""
    if not _sentence.search(line):
        return "punctuation"
    if n_words <= MENU_WORDS:
        marks = len(_separator.findall(line))
        if marks >= MENU_MARKS or marks and marks * MENU_ITEM_WORDS >= n_words or _menu.search(line):
            return "navigation"
    symbols = len(data) - len(data.translate(None, SYMBOLS))
    if symbols >= LEAST_SYMBOLS and 100 * symbols > SYMBOL_PERCENT * n_words:
        return "punctuation"
    if seen or n_words <= BOILERPLATE_WORDS and _boilerplate.search(line):
        return "boilerplate"
    return ""


def measures(text: str) -> dict:
    """All measures of one text, and what is left of it."""
    data = text.encode("utf-8", "replace")
    words = data.split()
    n = len(words)
    blank = len(data) - len(data.translate(None, SPACES))
    seen: set[str] = set()
    kept, with_word, removed, lost = [], 0, 0, 0
    for line in text.split("\n"):
        own = line.encode("utf-8", "replace")
        n_own = len(own.split())
        if n_own:
            with_word += 1
            if failed_rule(line, own, n_own, line in seen):
                removed += 1
                lost += n_own
                seen.add(line)
                continue
            seen.add(line)
        kept.append(line)
    repeat = repeated_words(words)
    base_failed = n < LEAST_WORDS or 100 * repeat > REPEAT_PERCENT * n
    return {
        "n_words": n,
        "word_chars": len(text) - blank,
        "n_symbols": len(data) - len(data.translate(None, SYMBOLS)),
        "n_dup_lines": with_word - len(seen),
        "n_repeat_words": repeat,
        "base_failed": base_failed,
        "kept": not base_failed and 100 * lost <= LOSS_PERCENT * n,
        "n_lines_removed": removed,
        "n_words_removed": lost,
        "cleaned": "\n".join(kept),
    }


SCHEMA = {
    "n_words": (T.LongType(), pa.int64()),
    "word_chars": (T.LongType(), pa.int64()),
    "n_symbols": (T.LongType(), pa.int64()),
    "n_dup_lines": (T.LongType(), pa.int64()),
    "n_repeat_words": (T.LongType(), pa.int64()),
    "base_failed": (T.BooleanType(), pa.bool_()),
    "kept": (T.BooleanType(), pa.bool_()),
    "n_lines_removed": (T.LongType(), pa.int64()),
    "n_words_removed": (T.LongType(), pa.int64()),
    "cleaned": (T.StringType(), pa.string()),
}


def assess(docs: DataFrame, with_text: bool = False, carry: bool = False) -> DataFrame:
    """One row for each row of docs: doc_id, the measures, base_failed, kept, what was removed[, cleaned text].

    A null, empty or blank text has no words and fails. Rows that repeat a
    doc_id are judged each; other columns are ignored, or with `carry` come
    along in the struct _given. An empty table gives no rows. No shuffle.
    """
    arrow_bounds(docs.sparkSession)
    names = [c for c in SCHEMA if with_text or c != "cleaned"]

    def run(batches):
        for b in batches:
            rows = [measures(t) for t in b.column("text").to_pylist()]
            columns = [pa.array([r[c] for r in rows], SCHEMA[c][1]) for c in names]
            yield pa.record_batch([b.column("doc_id"), *columns, *map(b.column, more)], ["doc_id", *names, *more])

    base = id_text(docs, "doc_id", "text", *carried(docs, carry, ["doc_id", "text"]))
    more = [c for c in base.columns if c == "_given"]
    schema = T.StructType([T.StructField("doc_id", T.LongType()), *(T.StructField(c, SCHEMA[c][0]) for c in names), *(base.schema[c] for c in more)])
    return base.mapInArrow(run, schema)


_SQL_SENTENCE = SENTENCE.replace("'", "''")

#: DuckDB's form of assess() on the table documents.
ORACLE = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS ws FROM d),
base AS (SELECT doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '{_WS}', '', 'g'))::BIGINT AS word_chars,
  (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols FROM w),
windows AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS tri
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3)),
hits AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, tri) AS c FROM windows) WHERE c >= 2),
rep AS (SELECT doc_id, count(DISTINCT p)::BIGINT AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM hits) GROUP BY doc_id),
l0 AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line, unnest(range(len(string_split(t, chr(10))))) AS pos FROM d),
l1 AS (SELECT *, len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) AS n,
  length(line) - length(regexp_replace(line, '[#*$%&|<>]', '', 'g')) AS symbols, len(regexp_extract_all(line, '{SEPARATOR}')) AS marks,
  row_number() OVER (PARTITION BY doc_id, line ORDER BY pos) > 1 AS seen FROM l0),
l2 AS (SELECT *, NOT regexp_matches(line, '{_SQL_SENTENCE}')
  OR (symbols >= {LEAST_SYMBOLS} AND 100 * symbols > {SYMBOL_PERCENT} * n)
  OR (n <= {MENU_WORDS} AND (regexp_matches(line, '{MENU}') OR marks >= {MENU_MARKS} OR (marks > 0 AND marks * {MENU_ITEM_WORDS} >= n)))
  OR seen OR (n <= {BOILERPLATE_WORDS} AND regexp_matches(line, '{BOILERPLATE}')) AS failed FROM l1 WHERE n > 0),
lines AS (SELECT doc_id, count(*) FILTER (seen)::BIGINT AS dup, count(*) FILTER (failed)::BIGINT AS removed,
  coalesce(sum(n) FILTER (failed), 0)::BIGINT AS lost FROM l2 GROUP BY doc_id),
j AS (SELECT b.*, coalesce(dup, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words,
  coalesce(removed, 0) AS n_lines_removed, coalesce(lost, 0) AS n_words_removed
  FROM base b LEFT JOIN rep USING (doc_id) LEFT JOIN lines USING (doc_id))
SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words AS base_failed,
  NOT (n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words)
  AND 100 * n_words_removed <= {LOSS_PERCENT} * n_words AS kept FROM j
"""
