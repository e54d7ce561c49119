"""Tables of the engine. Schemas are explicit and never inferred."""

from __future__ import annotations

from pyspark.sql import types as T

CHUNKS = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("file_path", T.StringType(), False),
        T.StructField("start_line", T.IntegerType(), False),
        T.StructField("end_line", T.IntegerType(), False),
        T.StructField("raw_content", T.StringType(), False),
        T.StructField("symbols_defined", T.ArrayType(T.StringType()), False),
    ]
)
SYMBOLS = T.StructType(
    [
        T.StructField("symbol_id", T.StringType(), False),
        T.StructField("symbol_name", T.StringType(), False),
        T.StructField("symbol_type", T.StringType(), False),
        T.StructField("file_path", T.StringType(), False),
        T.StructField("start_line", T.IntegerType(), False),
        T.StructField("end_line", T.IntegerType(), False),
    ]
)
RESULTS = T.StructType(
    [
        T.StructField("query_id", T.LongType(), False),
        T.StructField("symbol_id", T.StringType(), False),
        T.StructField("score", T.FloatType(), False),
        T.StructField("file_path", T.StringType(), False),
        T.StructField("start_line", T.IntegerType(), False),
        T.StructField("end_line", T.IntegerType(), False),
        T.StructField("reasons", T.ArrayType(T.StringType()), False),
    ]
)
EMBEDDINGS = T.StructType([T.StructField("chunk_id", T.StringType(), False), T.StructField("embedding", T.ArrayType(T.FloatType()), False)])
POSTINGS = "field string, term string, key string, tf int, dl int"
ERRORS = "path string, error string"
QUERIES = "query_id long, query string"
EMBEDDED = "query_id long, embedding array<float>"
RESULT_COLUMNS = [f.name for f in RESULTS]
DEFINITION = "Definition"
