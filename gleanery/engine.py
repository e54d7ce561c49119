"""The engine: index a repository, search it, resolve symbols, find related code."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .embedding import Embedder, HashedTokens, embed
from .operators import bm25
from .operators.ranking import result_order
from .plans import search as plans
from .schema import QUERIES
from .sources import repository, requests
from .sources.store import Store
from .sizes import release


class Engine:
    """Answers one query or a DataFrame of queries (query_id, query); results are DataFrames, the best of each query first."""

    def __init__(self, spark: SparkSession, path: str, embedder: Embedder | None = None):
        self.spark, self.store, self.embedder = spark, Store(spark, path), embedder or HashedTokens()
        self.include_tests = False
        self._corpus: plans.Corpus | None = None

    def set_include_tests(self, include: bool) -> None:
        self.include_tests = include

    def index_repository(self, root: str) -> DataFrame:
        """Indexes all files anew and returns the files that failed, as (path, error): the table `errors`, all of it."""
        found = repository.definitions(repository.scan(self.spark, root, self.include_tests)).persist()
        try:
            self.store.write("errors", found.filter("error is not null").select("path", "error"))
            self.index(repository.chunks_of(found), repository.symbols_of(found))
        finally:
            found.unpersist()
        return self.store.read("errors")

    def index(self, chunks: DataFrame, symbols: DataFrame) -> None:
        """Writes the tables and, from what is written, postings and embeddings."""
        self.store.write("chunks", chunks)
        self.store.write("symbols", symbols)
        chunks, symbols = self.store.read("chunks"), self.store.read("symbols")
        self.store.write("chunk_postings", bm25.chunk_postings(chunks))
        self.store.write("symbol_postings", bm25.symbol_postings(symbols))
        texts = chunks.select(F.col("id").alias("chunk_id"), "raw_content").dropDuplicates(["chunk_id"])
        self.store.upsert_embeddings(embed(texts, self.embedder, "chunk_id", "raw_content"))
        self._corpus = None

    @property
    def corpus(self) -> plans.Corpus:
        if self._corpus is None:
            read = self.store.read
            self._corpus = plans.Corpus(read("chunks"), read("symbols"), read("embeddings"), read("chunk_postings"), read("symbol_postings"))
        return self._corpus

    def _queries(self, query: str | DataFrame) -> DataFrame:
        return query if isinstance(query, DataFrame) else self.spark.createDataFrame([(0, query)], QUERIES)

    def search(self, query: str | DataFrame) -> DataFrame:
        return plans.search(self._queries(query), self.corpus, self.embedder, self.include_tests).orderBy(*result_order())

    def resolve_symbol(self, name: str | DataFrame) -> DataFrame:
        return plans.resolve(self._queries(name), self.corpus).orderBy(*result_order())

    def find_related(self, file: str | DataFrame, line: int | None = None) -> DataFrame:
        """Of one position or of a DataFrame (query_id, file, line)."""
        positions = file if isinstance(file, DataFrame) else self.spark.createDataFrame([(0, file, line)], "query_id long, file string, line long")
        return plans.related(positions, self.corpus).orderBy(*result_order())

    def flow(self, query: str) -> DataFrame:
        """The best result alone, as a starting point to trace a flow from."""
        return self.search(query).limit(1)

    def answer(self, line: str) -> str | None:
        """The response to one JSON request, for a loop over lines; None for a blank line."""
        row = self.serve(self.spark.createDataFrame([(0, line.strip())], "request_id long, value string")).first()
        release()
        return row["response"] if row else None

    def serve(self, lines: DataFrame) -> DataFrame:
        """(request_id, response) of JSON requests (request_id, value); tests are never included."""
        asked = requests.parse(lines).persist()
        try:
            good = asked.filter("error is null")
            pick = lambda method, field: good.filter(F.col("method") == method).select(F.col("request_id").alias("query_id"), F.col(field).alias("query"))
            found = plans.search(pick("search", "query"), self.corpus, self.embedder, False)
            found = found.unionByName(plans.resolve(pick("resolve_symbol", "name"), self.corpus))
            positions = good.filter("method = 'find_related'").select(F.col("request_id").alias("query_id"), "file", "line")
            return requests.respond(asked, found.unionByName(plans.related(positions, self.corpus)))
        finally:
            asked.unpersist()

    def clear(self) -> None:
        self.store.clear()
        self._corpus = None
