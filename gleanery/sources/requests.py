"""Requests as JSON lines, answered as JSON lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import RESULT_COLUMNS

METHODS = ["search", "resolve_symbol", "find_related"]


def error_of(method: Column, bad: Column) -> Column:
    """The error of a request, null for a good one."""
    missing = lambda name: F.get_json_object("value", f"$.params.{name}").isNull()
    line = F.expr("try_cast(get_json_object(value, '$.params.line') AS BIGINT)")
    return (
        F.when(bad, "Invalid JSON")
        .when((method == "search") & missing("query"), "Missing query parameter")
        .when((method == "resolve_symbol") & missing("name"), "Missing name parameter")
        .when((method == "find_related") & (missing("file") | line.isNull()), "Missing file or line parameter")
        .when(~F.coalesce(method.isin(METHODS), F.lit(False)), "Unknown method")
    )


def parse(lines: DataFrame, id_col: str = "request_id", value_col: str = "value") -> DataFrame:
    """(request_id, method, query, name, file, line, error) of (request_id, value); blank lines have no row."""
    rows = lines.select(F.col(id_col).alias("request_id"), F.col(value_col).alias("value")).filter(F.trim("value") != "")
    method = F.get_json_object("value", "$.method")
    # a request must be an object with a method
    bad = method.isNull() | ~F.rlike(F.trim("value"), F.lit(r"^\{[\s\S]*\}$"))
    field = lambda n: F.get_json_object("value", f"$.params.{n}")
    return rows.select(
        "request_id",
        method.alias("method"),
        field("query").alias("query"),
        field("name").alias("name"),
        field("file").alias("file"),
        F.expr("try_cast(get_json_object(value, '$.params.line') AS BIGINT)").alias("line"),
        error_of(method, bad).alias("error"),
    )


def respond(requests: DataFrame, results: DataFrame) -> DataFrame:
    """(request_id, response): the results of each good request as a JSON array, best first, or its error."""
    columns = [c for c in RESULT_COLUMNS if c != "query_id"]
    rows = results.select(F.col("query_id").alias("request_id"), F.struct((-F.col("score")).alias("_s"), *columns).alias("_r"))
    grouped = rows.groupBy("request_id").agg(F.array_sort(F.collect_list("_r")).alias("_rs"))
    strip = F.transform("_rs", lambda r: F.struct(*(r[c].alias(c) for c in columns)))
    good = F.coalesce(F.to_json(strip), F.lit("[]"))
    answer = F.when(F.col("error").isNotNull(), F.to_json(F.struct(F.col("error").alias("error")))).otherwise(good)
    return requests.join(grouped, "request_id", "left").select("request_id", answer.alias("response"))
