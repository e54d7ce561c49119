"""Query intent, its weights, and query expansion, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Keywords of the intents, in the order in which they are tried.
KEYWORDS = {
    "Flow": ["flow", "lifecycle", "path", "sequence"],
    "Architecture": ["architecture", "module", "crate", "relationship", "dependency"],
    "Definition": ["define", "definition", "implement", "signature"],
}
#: Weights (lexical, semantic) by intent.
WEIGHTS = {"Symbol": (0.95, 0.05), "Definition": (0.8, 0.2), "Flow": (0.4, 0.6), "Architecture": (0.3, 0.7), "Semantic": (0.1, 0.9)}
#: Triggers and the words that they append; the first that holds counts.
EXPANSIONS = [
    (["auth", "authentication"], "login jwt token middleware authorize verify access session identity permission oauth"),
    (["database", "db"], "repository gorm sql transaction query storage client connection migration schema"),
    (["api", "endpoint"], "controller handler route request response gateway payload"),
    (["cache"], "redis memcached ttl evict storage buffer local"),
    (["config", "setting"], "environment variable yaml json property flag registry"),
]
CONCEPTUAL = ["Semantic", "Flow", "Architecture"]
EXPANDED = ["Flow", "Architecture"]


def contains_any(text: Column, words: list[str]) -> Column:
    found = F.lit(False)
    for w in words:
        found = found | F.contains(text, F.lit(w))
    return found


def identifier_like(text: Column) -> Column:
    return F.rlike(text, F.lit("::|[._A-Z]"))


def classify(query: Column) -> Column:
    """Symbol, Flow, Architecture, Definition or Semantic."""
    trimmed = F.regexp_replace(query, r"^\s+|\s+$", "")
    lower = F.lower(trimmed)
    case = F.when(trimmed == "", F.lit("Semantic")).when(~F.rlike(trimmed, F.lit(r"\s")), F.lit("Symbol"))
    for intent, words in KEYWORDS.items():
        case = case.when(contains_any(lower, words), F.lit(intent))
    return case.when(identifier_like(trimmed), F.lit("Definition")).otherwise(F.lit("Semantic"))


def weight(intent: Column, side: int) -> Column:
    """The lexical (0) or semantic (1) weight, a float."""
    case = None
    for name, pair in WEIGHTS.items():
        value = F.lit(pair[side]).cast("float")
        case = F.when(intent == name, value) if case is None else case.when(intent == name, value)
    return case


def expand(query: Column) -> Column:
    """The query with the first matching group's words behind it."""
    lower, case = F.lower(query), None
    for triggers, words in EXPANSIONS:
        hit, value = contains_any(lower, triggers), F.concat(query, F.lit(" " + words))
        case = F.when(hit, value) if case is None else case.when(hit, value)
    return case.otherwise(query)


def search_text(query: Column, intent: Column) -> Column:
    """What the retrievers get: expanded for Flow and Architecture."""
    return F.when(intent.isin(EXPANDED), expand(query)).otherwise(query)
