"""Rank fusion and the explainable ranking heuristics, step by step.

Every step takes and returns candidates (query_id, query, intent, chunk
columns, score float, reasons), so that plans compose them and tests hold each
alone. Scores are rounded to float after each factor.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.intent import CONCEPTUAL, contains_any, weight
from ..functions.text import dot_parts, first_symbol, query_tokens, symbol_tail
from ..schema import RESULT_COLUMNS

RRF_K = 60
FLOOR = 0.15
CHUNK = ["file_path", "start_line", "end_line", "symbols_defined"]
#: Parts of a path that are dropped unless tests are included.
NOISE = ["vendor", "node_modules", "mock", "test", "generated", ".pb.go", "fixtures", "examples"]
#: Penalties; the first that holds counts.
PENALTIES = [
    (["vendor", "node_modules"], [], 0.01, "Vendor/node_modules penalty"),
    (["generated", ".pb.go"], [], 0.05, "Generated code penalty"),
    (["testdata"], ["_test.go", ".test.ts", "_test.rs", "_test.py"], 0.10, "Test/testdata penalty"),
    (["mock", "test"], [], 0.20, "Mock/Test directory penalty"),
    (["fixtures", "examples", "target", "build", "dist"], [], 0.10, "Fixtures/Examples/Build penalty"),
]
#: Names of entry points, and names too common to tell anything.
ENTRY_POINTS = ["service", "handler", "controller", "router", "interface", "api"]
GENERIC = ["main", "new", "init", "test", "helper", "util", "config"]


def scaled(score: Column, factor: Column | float) -> Column:
    factor = F.lit(factor).cast("float") if isinstance(factor, (int, float)) else factor
    return (score.cast("float") * factor.cast("float")).cast("float")


def boosted(df: DataFrame, hit: Column, factor: Column | float, reason: Column | str) -> DataFrame:
    """Where hit, the score times the factor, and one more reason."""
    why = F.lit(reason) if isinstance(reason, str) else reason
    return df.withColumns(
        {
            "score": F.when(hit, scaled(F.col("score"), factor)).otherwise(F.col("score")),
            "reasons": F.when(hit, F.concat("reasons", F.array(why))).otherwise(F.col("reasons")),
        }
    )


def tails() -> Column:
    return F.transform("symbols_defined", lambda s: F.lower(symbol_tail(s)))


def fuse(lexical: DataFrame, semantic: DataFrame) -> DataFrame:
    """Merges two ranked lists by chunk id: sums of weight / (60 + rank0).

    Inputs are (query_id, query, intent, id, chunk columns, rank0). A chunk id
    that a list holds twice adds twice. The representative row is the first
    seen, lexical before semantic. A union and one aggregation, so no outer join.
    """
    columns = ["query_id", "query", "intent", "id", *CHUNK, "rank0"]
    both = lexical.select(*columns, F.lit(0).alias("side")).union(semantic.select(*columns, F.lit(1).alias("side")))
    share = F.when(F.col("side") == 0, weight(F.col("intent"), 0)).otherwise(weight(F.col("intent"), 1))
    both = both.withColumn("part", (share / (F.lit(RRF_K) + F.col("rank0"))).cast("float"))
    merged = both.groupBy("query_id", "id").agg(
        F.sum("part").cast("float").alias("score"),
        F.min_by(F.struct("query", "intent", *CHUNK), F.struct("side", "rank0")).alias("_first"),
        F.max(F.col("side") == 0).alias("_lex"),
        F.max(F.col("side") == 1).alias("_sem"),
    )
    reasons = F.array_compact(F.array(F.when(F.col("_lex"), "Lexical match"), F.when(F.col("_sem"), "Semantic match")))
    return merged.select("query_id", "id", "_first.*", "score", reasons.alias("reasons"))


def drop_noise(df: DataFrame, include_tests: bool = False) -> DataFrame:
    return df if include_tests else df.filter(~contains_any(F.lower("file_path"), NOISE))


def noise_suppression(df: DataFrame) -> DataFrame:
    path, factor, reason = F.lower(F.col("file_path")), None, None
    for words, ends, value, why in PENALTIES:
        hit = contains_any(path, words)
        for end in ends:
            hit = hit | F.endswith(path, F.lit(end))
        f, w = F.lit(value).cast("float"), F.lit(why)
        factor, reason = (F.when(hit, f), F.when(hit, w)) if factor is None else (factor.when(hit, f), reason.when(hit, w))
    return boosted(df, reason.isNotNull(), factor, reason)


def definition_boost(df: DataFrame) -> DataFrame:
    """A symbol's tail is the whole query, or one of its dotted parts is a query token."""
    tokens = query_tokens(F.col("query"))
    hit = F.exists(tails(), lambda t: (t == F.lower("query")) | F.arrays_overlap(dot_parts(t), tokens))
    return boosted(df, hit, 2.0, "Definition boost")


def names_a_token() -> Column:
    tokens = query_tokens(F.col("query"))
    return F.exists(tails(), lambda t: F.exists(tokens, lambda q: F.contains(t, q)))


def identifier_boost(df: DataFrame) -> DataFrame:
    return boosted(df, names_a_token(), 1.3, "Identifier match boost")


def conceptual() -> Column:
    return F.col("intent").isin(CONCEPTUAL)


def concept_boost(df: DataFrame) -> DataFrame:
    return boosted(df, conceptual() & names_a_token(), 1.5, "Concept match boost")


def intent_boost(df: DataFrame) -> DataFrame:
    """Times 2.5, and one reason, for each symbol that names an entry point."""
    hits = F.when(conceptual(), F.size(F.filter(tails(), lambda t: contains_any(t, ENTRY_POINTS)))).otherwise(0)
    return df.withColumns(
        {
            "score": F.aggregate(F.array_repeat(F.lit(2.5).cast("float"), hits), F.col("score").cast("float"), lambda s, f: (s * f).cast("float")),
            "reasons": F.concat("reasons", F.array_repeat(F.lit("Intent-based service/handler boost"), hits)),
        }
    )


def generic_penalty(df: DataFrame) -> DataFrame:
    hit = conceptual() & F.exists(tails(), lambda t: t.isin(GENERIC))
    return boosted(df, hit, 0.2, "Generic symbol penalty")


def file_coherence(df: DataFrame) -> DataFrame:
    """Times 1 + 0.05 for each further candidate of the same file, counted before the floor."""
    counted = df.withColumn("_n", F.count("*").over(Window.partitionBy("query_id", "file_path")))
    factor = (F.lit(1.0) + ((F.col("_n") - 1).cast("float") * F.lit(0.05).cast("float")).cast("float")).cast("float")
    return boosted(counted, F.col("_n") > 1, factor, "File coherence boost").drop("_n")


def normalise(df: DataFrame) -> DataFrame:
    """Against the most that two first places give, at most 1."""
    most = (F.lit(1.0).cast("float") / F.lit(float(RRF_K))).cast("float")
    share = (F.col("score").cast("float") / (most * F.lit(2.0)).cast("float")).cast("float")
    return df.withColumn("score", F.least(share, F.lit(1.0).cast("float")))


def floor(df: DataFrame) -> DataFrame:
    return df.filter(F.col("score") >= F.lit(FLOOR).cast("float"))


def to_results(df: DataFrame) -> DataFrame:
    return df.withColumn("symbol_id", first_symbol(F.col("symbols_defined"), F.col("file_path"))).select(*RESULT_COLUMNS)


def rank(lexical: DataFrame, semantic: DataFrame, include_tests: bool = False) -> DataFrame:
    """All steps in order; rows are results, to be ordered by result_order()."""
    found = drop_noise(fuse(lexical, semantic), include_tests)
    for step in (noise_suppression, definition_boost, identifier_boost, concept_boost, intent_boost, generic_penalty, file_coherence, normalise, floor):
        found = step(found)
    return to_results(found)


def result_order() -> list[Column]:
    return [F.col("query_id"), F.desc("score"), F.col("symbol_id"), F.col("file_path"), F.col("start_line")]
