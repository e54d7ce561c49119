"""Exact nearest neighbours by cosine, and the cosine as an expression."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..workers import reach

#: Query vectors that go to a worker at once.
BLOCK = 1024


def cosine(a: Column, b: Column) -> Column:
    """Dot product over both norms; 0 where a norm is 0."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms == 0, F.lit(0.0)).otherwise(dot(a, b) / norms)


def vector_search(queries: DataFrame, embeddings: DataFrame, k: int, id_col: str = "chunk_id") -> DataFrame:
    """(query_id, <id>, score, rank0): the k nearest of each query vector; ties by id.

    `queries` is (query_id, embedding). Vectors of another dimension than the
    query's are skipped. Queries are taken in blocks of BLOCK vectors, so what
    a worker gets is bounded; each batch of vectors is one matrix product, and
    gives no more than its own best k of a query to the shuffle.
    """
    spark, schema = queries.sparkSession, f"query_id long, {id_col} {embeddings.schema[id_col].dataType.simpleString()}, score double"
    reach(spark)
    ordered = queries.select("query_id", F.col("embedding").cast("array<double>").alias("embedding"))
    found, blocks = None, []
    block: list = []
    for row in ordered.toLocalIterator():
        block.append((row["query_id"], row["embedding"]))
        if len(block) == BLOCK:
            blocks.append(block)
            block = []
    blocks += [block] if block else []
    for own in blocks:
        part = embeddings.select(id_col, "embedding").mapInArrow(nearest(spark.sparkContext.broadcast(own), k, id_col), schema)
        found = part if found is None else found.union(part)
    if found is None:
        return spark.createDataFrame([], schema + ", rank0 int")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), id_col)
    return found.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= k).withColumn("rank0", (F.col("_n") - 1).cast("int")).drop("_n")


def nearest(shared, k: int, id_col: str):
    def run(batches):
        by_size: dict[int, tuple[list, list]] = {}
        for query_id, vector in shared.value:
            ids, vectors = by_size.setdefault(len(vector or ()), ([], []))
            ids.append(query_id)
            vectors.append(vector)
        sides = {n: (np.array(ids), unit(np.array(v, float).reshape(len(ids), n))) for n, (ids, v) in by_size.items()}
        for b in batches:
            lists = b.column("embedding")
            sizes = np.asarray(lists.value_lengths().fill_null(-1))
            for n, (query_ids, matrix) in sides.items():
                rows = np.flatnonzero(sizes == n)
                if not len(rows):
                    continue
                own = lists.take(pa.array(rows))
                vectors = unit(np.asarray(own.flatten(), dtype=float).reshape(len(rows), n))
                scores = np.round(matrix @ vectors.T, 9)
                keep = min(k, len(rows))
                # all that are not below the k-th best, so that ties are settled later
                least = -np.partition(-scores, keep - 1, axis=1)[:, keep - 1 : keep]
                q, v = np.nonzero(scores >= least)
                yield pa.record_batch([pa.array(query_ids[q]), b.column(id_col).take(pa.array(rows[v])), pa.array(scores[q, v])], ["query_id", id_col, "score"])

    return run


def unit(m: np.ndarray) -> np.ndarray:
    norms = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, norms, out=np.zeros_like(m), where=norms > 0)
