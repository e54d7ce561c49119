"""The search plan: route, expand, retrieve on both sides, rank."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..embedding import Embedder, embed
from ..functions.intent import classify, search_text
from ..operators import bm25, knn, lookup, ranking
from ..schema import RESULT_COLUMNS
from ..sizes import broadcast_if_small, kept

EXACT_K, LEXICAL_K, SEMANTIC_K, RESOLVE_K, RELATED_K = 25, 50, 50, 25, 20


@dataclass
class Corpus:
    """The tables of an index; postings and their statistics are derived."""

    chunks: DataFrame
    symbols: DataFrame
    embeddings: DataFrame
    chunk_postings: DataFrame | None = None
    symbol_postings: DataFrame | None = None
    chunk_stats: DataFrame | None = None
    symbol_stats: DataFrame | None = None

    def __post_init__(self):
        self.chunk_postings = self.chunk_postings or bm25.chunk_postings(self.chunks)
        self.symbol_postings = self.symbol_postings or bm25.symbol_postings(self.symbols)
        self.chunk_stats = self.chunk_stats or bm25.field_stats(self.chunks, self.chunk_postings)
        self.symbol_stats = self.symbol_stats or bm25.field_stats(self.symbols, self.symbol_postings)


def routed(queries: DataFrame) -> DataFrame:
    return queries.select("query_id", "query", classify(F.col("query")).alias("intent"))


def exact_results(queries: DataFrame, symbols: DataFrame) -> DataFrame:
    """Results of queries that name a symbol; they bypass filter, floor and ranking."""
    hits = lookup.exact_symbols(queries, symbols, EXACT_K)
    return labelled(hits, "Exact symbol match")


def labelled(hits: DataFrame, reason: str) -> DataFrame:
    return hits.withColumns({"score": F.lit(1.0).cast("float"), "reasons": F.array(F.lit(reason))}).select(*RESULT_COLUMNS)


def search(queries: DataFrame, corpus: Corpus, embedder: Embedder, include_tests: bool = False, vectors: DataFrame | None = None) -> DataFrame:
    """Results of (query_id, query); `vectors` (query_id, embedding) may stand in for embedded queries.

    Symbol queries with an exact hit end there; the rest goes through both
    retrievers and the ranking.
    """
    asked = routed(queries)
    exact = exact_results(asked.filter("intent = 'Symbol'"), corpus.symbols)
    rest = asked.join(broadcast_if_small(exact.select("query_id").distinct(), keep=True), "query_id", "left_anti")
    texts = rest.select("query_id", search_text(F.col("query"), F.col("intent")).alias("query"))
    lexical = bm25.search_chunks(texts, corpus.chunks, corpus.chunk_postings, corpus.chunk_stats, LEXICAL_K)
    wanted = embed(texts, embedder) if vectors is None else vectors.join(rest.select("query_id"), "query_id", "left_semi")
    near = knn.vector_search(wanted, corpus.embeddings, SEMANTIC_K)
    semantic = representatives(near, corpus.chunks)
    asked_rows = broadcast_if_small(rest)
    hybrid = ranking.rank(lexical.join(asked_rows, "query_id"), semantic.join(asked_rows, "query_id"), include_tests)
    return exact.unionByName(hybrid)


def representatives(near: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunk columns of (query_id, chunk_id, rank0): embeddings are by content, so an id's first chunk stands for it."""
    columns = ["file_path", "start_line", "end_line", "symbols_defined"]
    near = kept(near)
    wanted = broadcast_if_small(near.select(F.col("chunk_id").alias("id")).distinct())
    first = chunks.join(wanted, "id", "left_semi").groupBy("id").agg(F.min(F.struct("file_path", "start_line", "end_line", "symbols_defined")).alias("_c"))
    return near.withColumnRenamed("chunk_id", "id").join(first, "id").select("query_id", "id", *(F.col(f"_c.{c}").alias(c) for c in columns), "rank0")


def resolve(queries: DataFrame, corpus: Corpus) -> DataFrame:
    """Symbols by BM25 on their names, shown as exact look-ups."""
    hits = bm25.search_symbols(queries, corpus.symbols, corpus.symbol_postings, corpus.symbol_stats, RESOLVE_K)
    return labelled(hits.drop("score"), "Exact symbol lookup")


def related(positions: DataFrame, corpus: Corpus) -> DataFrame:
    return lookup.find_related(positions, corpus.chunks, corpus.embeddings, RELATED_K)
