"""Exact symbols, chunks by position, chunks by id, and related chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sizes import broadcast_if_small, kept
from .knn import vector_search

#: Lines in a bucket of the position index.
SPAN = 256


def exact_symbols(queries: DataFrame, symbols: DataFrame, k: int = 25) -> DataFrame:
    """(query_id, rank0, symbol columns): id or name equals the query, as written.

    Equal ids in two files are two rows. What equals in both comes first, then
    by path and line.
    """
    asked = broadcast_if_small(queries.select("query_id", F.col("query").alias("_q")))
    # two equi-joins instead of an OR, which would be a nested loop
    by_id = symbols.join(asked, F.col("symbol_id") == F.col("_q"))
    by_name = symbols.join(asked, (F.col("symbol_name") == F.col("_q")) & (F.col("symbol_id") != F.col("_q")))
    hits = by_id.union(by_name).withColumn("_both", (F.col("symbol_id") == F.col("_q")) & (F.col("symbol_name") == F.col("_q")))
    order = Window.partitionBy("query_id").orderBy(F.desc("_both"), "file_path", "start_line", "symbol_id", "end_line")
    ranked = hits.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= k)
    return ranked.withColumn("rank0", (F.col("_n") - 1).cast("int")).drop("_n", "_q", "_both")


def get_chunk(chunks: DataFrame, chunk_id: str) -> DataFrame:
    return chunks.filter(F.col("id") == chunk_id)


def locate(positions: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query_id, chunk columns): for each (query_id, file, line) the innermost chunk around the line.

    An interval join on (path, bucket of lines): a chunk is listed under each
    bucket that it touches, a position looks into one.
    """
    buckets = F.sequence(F.floor(F.col("start_line") / SPAN), F.floor(F.col("end_line") / SPAN))
    listed = chunks.withColumn("_b", F.explode(buckets))
    asked = positions.select("query_id", F.col("file").alias("file_path"), "line", F.floor(F.col("line") / SPAN).alias("_b"))
    hits = listed.join(broadcast_if_small(asked), ["file_path", "_b"]).filter("start_line <= line and line <= end_line")
    order = Window.partitionBy("query_id").orderBy(F.col("end_line") - F.col("start_line"), "start_line", "id")
    best = hits.withColumn("_n", F.row_number().over(order)).filter("_n = 1")
    return best.select("query_id", "line", *chunks.columns)


def find_related(positions: DataFrame, chunks: DataFrame, embeddings: DataFrame, k: int = 20) -> DataFrame:
    """Result rows of the k chunks nearest to the one at a position, without chunks around that line itself.

    The cut at k comes before that exclusion. The score is the cosine, which
    may be negative; there is no floor.
    """
    from ..functions.text import first_symbol

    around = locate(positions, chunks)
    asked = around.select("query_id", F.col("id").alias("chunk_id")).join(embeddings, "chunk_id").select("query_id", "embedding")
    near = kept(vector_search(asked, embeddings, k))
    # embeddings are by content, so a neighbour is the id's first chunk
    first = chunks.join(broadcast_if_small(near.select(F.col("chunk_id").alias("id")).distinct()), "id", "left_semi")
    order = Window.partitionBy("id").orderBy("file_path", "start_line", "end_line")
    first = first.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")
    rows = near.join(first.withColumnRenamed("id", "chunk_id"), "chunk_id")
    rows = rows.join(broadcast_if_small(positions.select("query_id", F.col("file").alias("_f"), F.col("line").alias("_l"))), "query_id")
    own = (F.col("file_path") == F.col("_f")) & F.col("_l").between(F.col("start_line"), F.col("end_line"))
    return rows.filter(~own).select(
        "query_id",
        first_symbol(F.col("symbols_defined"), F.col("file_path")).alias("symbol_id"),
        F.col("score").cast("float").alias("score"),
        "file_path",
        "start_line",
        "end_line",
        F.array(F.lit("Embedding similarity")).alias("reasons"),
    )
