"""BM25 over postings, for a table of queries.

Postings are (field, term, key, tf, dl), narrow and clustered by term when
stored, so that a query's terms prune row groups. Scores sum over fields, each
with its own document frequencies and mean length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import joined_symbols, terms
from ..sizes import BROADCAST_ROWS, broadcast_if_small

K1, B = 1.2, 0.75
CHUNK_FIELDS = ["content", "symbols"]
SYMBOL_FIELDS = ["symbol_name"]


def row_key(*parts: Column) -> Column:
    """128 bits for a row, narrower than its path, lines and id; equal rows keep equal keys."""
    return F.md5(F.concat_ws("\x00", *parts))


def keyed_chunks(chunks: DataFrame) -> DataFrame:
    return chunks.withColumn("key", row_key(F.col("file_path"), F.col("start_line").cast("string"), F.col("end_line").cast("string"), F.col("id")))


def keyed_symbols(symbols: DataFrame) -> DataFrame:
    return symbols.withColumn("key", row_key(F.col("file_path"), F.col("start_line").cast("string"), F.col("end_line").cast("string"), F.col("symbol_id")))


def counted(text: DataFrame) -> DataFrame:
    """Postings of (field, key, text): terms are counted inside each row, so no shuffle is needed."""
    own = text.select("field", "key", terms(F.col("text")).alias("_t")).withColumn("dl", F.size("_t")).filter("dl > 0")
    # a sorted array holds equal terms together: a term's count is the distance of its run's ends
    ordered = own.withColumn("_t", F.array_sort("_t"))
    ends = F.filter(F.transform("_t", lambda t, i: F.when((i + 1 == F.size("_t")) | (F.get("_t", i + 1) != t), F.struct(t.alias("term"), i.alias("at")))), lambda x: x.isNotNull())
    runs = ordered.select("field", "key", "dl", ends.alias("_e"))
    tf = lambda x, i: F.struct(x["term"].alias("term"), (x["at"] - F.coalesce(F.when(i > 0, F.get("_e", i - 1)["at"]), F.lit(-1))).alias("tf"))
    return runs.select("field", "key", "dl", F.explode(F.transform("_e", tf)).alias("_x")).select("field", "_x.term", "key", "_x.tf", "dl")


def chunk_postings(chunks: DataFrame) -> DataFrame:
    """Postings of the fields content and symbols. Indexed rows are not de-duplicated by content."""
    fields = F.array(
        F.struct(F.lit("content").alias("field"), F.col("raw_content").alias("text")),
        F.struct(F.lit("symbols").alias("field"), joined_symbols(F.col("symbols_defined")).alias("text")),
    )
    return counted(keyed_chunks(chunks).select("key", F.explode(fields).alias("_f")).select("_f.field", "key", "_f.text"))


def symbol_postings(symbols: DataFrame) -> DataFrame:
    return counted(keyed_symbols(symbols).select(F.lit("symbol_name").alias("field"), "key", F.col("symbol_name").alias("text")))


def field_stats(text_rows: DataFrame, postings: DataFrame) -> DataFrame:
    """(field, n, avgdl): one row for each field; n counts all rows, also those without a term."""
    lengths = postings.groupBy("field").agg(F.sum("tf").alias("total"))
    return lengths.crossJoin(F.broadcast(text_rows.agg(F.count("*").alias("n")))).select("field", "n", (F.col("total") / F.col("n")).alias("avgdl"))


def term_stats(postings: DataFrame) -> DataFrame:
    """(field, term, df)."""
    return postings.groupBy("field", "term").agg(F.count("*").alias("df"))


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, term): the distinct terms of each query."""
    return queries.select("query_id", F.explode(F.array_distinct(terms(F.col("query")))).alias("term"))


def scores(queries: DataFrame, postings: DataFrame, stats: DataFrame) -> DataFrame:
    """(query_id, key, score) of every row that shares a term with a query.

    The queries' terms are broadcast if they are few; postings are filtered by
    them before anything is shuffled, and partial sums come before the shuffle.
    """
    wanted = query_terms(queries)
    few = wanted.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    # what follows from the queries' terms has a row for each term, query and field at most
    hint = F.broadcast if few else lambda df: df
    hits = postings.join(hint(wanted.select("term").distinct()), "term", "left_semi")
    per_term = hits.groupBy("field", "term").agg(F.count("*").alias("df")).join(F.broadcast(stats), "field")
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighted = wanted.join(per_term, "term").select("query_id", "field", "term", idf.alias("idf"), "avgdl")
    met = hits.join(hint(weighted), ["field", "term"])
    tf = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return met.select("query_id", "key", (F.col("idf") * tf).alias("s")).groupBy("query_id", "key").agg(F.round(F.sum("s"), 9).alias("score"))


def top(found: DataFrame, k: int, *ties: str) -> DataFrame:
    """The best k of each query with rank0 from 0; each task keeps no more than k of a query before the shuffle."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), *ties)
    return found.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= k).withColumn("rank0", (F.col("_n") - 1).cast("int")).drop("_n")


def search_chunks(queries: DataFrame, chunks: DataFrame, postings: DataFrame, stats: DataFrame, k: int = 50) -> DataFrame:
    """(query_id, rank0, score, chunk columns): best k chunks by BM25; ties by id, path and line.

    Ties at the k-th place are settled on the chunk's own columns, so rows of
    equal score up to there are joined before the last cut.
    """
    found = scores(queries, postings, stats)
    # all that may be among the best k: scores not below the k-th
    tied = Window.partitionBy("query_id").orderBy(F.desc("score"))
    near = found.withColumn("_r", F.rank().over(tied)).filter(F.col("_r") <= k).drop("_r")
    joined = keyed_chunks(chunks).join(broadcast_if_small(near, keep=True), "key").drop("key")
    return top(joined, k, "id", "file_path", "start_line", "end_line")


def search_symbols(queries: DataFrame, symbols: DataFrame, postings: DataFrame, stats: DataFrame, k: int = 25) -> DataFrame:
    """(query_id, rank0, score, symbol columns): BM25 on the name, and the exact id as one more term."""
    found = scores(queries, postings, stats)
    exact = exact_id_scores(queries, symbols, stats)
    found = found.union(exact).groupBy("query_id", "key").agg(F.sum("score").alias("score"))
    tied = Window.partitionBy("query_id").orderBy(F.desc("score"))
    near = found.withColumn("_r", F.rank().over(tied)).filter(F.col("_r") <= k).drop("_r")
    joined = keyed_symbols(symbols).join(broadcast_if_small(near, keep=True), "key").drop("key")
    return top(joined, k, "symbol_id", "file_path", "start_line", "end_line")


def exact_id_scores(queries: DataFrame, symbols: DataFrame, stats: DataFrame) -> DataFrame:
    """The untokenised id field: a term of length one, so its score is its idf."""
    hits = keyed_symbols(symbols).join(broadcast_if_small(queries.select("query_id", F.col("query").alias("symbol_id"))), "symbol_id")
    n = stats.agg(F.max("n").alias("n"))
    per = hits.groupBy("query_id").agg(F.count("*").alias("df")).crossJoin(F.broadcast(n))
    idf = F.round(F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), 9)
    return hits.select("query_id", "key").join(per.select("query_id", idf.alias("score")), "query_id")
