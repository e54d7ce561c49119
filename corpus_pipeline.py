"""A corpus pipeline of five of the subpackage's operators.

Each stage takes (spark, docs, sf_dir), works on all that the stage before has
kept, and returns a DataFrame; run() writes each as Parquet to the shared
folder and reads it again. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.llm import language_id, line_dedup, near_dup, packing, quality
from gleanery.llm.common import documents, staged

#: A text whose best language has a smaller share of its n-grams is rejected as of no language.
LEAST_SCORE = 0.2


def with_text(rows: DataFrame, columns: list[str], given: str) -> DataFrame:
    """The columns as they are in the struct `given`, but for the text, which is `cleaned`, and n_chars, counted anew."""
    new = {"text": F.col("cleaned"), "n_chars": F.length("cleaned").cast("long")}
    return rows.select(*(new.get(c, F.col(f"{given}.{c}")).alias(c) for c in columns))


def whole(docs: DataFrame) -> DataFrame:
    """doc_id, text, and all columns but the text in the struct _docs, where no result can clash with them."""
    return docs.select("doc_id", "text", F.struct(*(c for c in docs.columns if c != "text")).alias("_docs"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and keep most of their text, without the lines that failed.

    Null, empty and blank texts fail. Rows are judged each, whatever their
    doc_id, null included. An empty table gives no rows.
    """
    judged = quality.assess(whole(docs), with_text=True, carry=True).filter("kept")
    return with_text(judged, docs.columns, "_given._docs")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a language that the labelled ones teach; a null lang is filled in.

    Without a labelled document all stay. A text without a letter goes. Rows
    are judged each, whatever their doc_id, null included; null ids are not
    learned from. An empty table gives no rows.
    """
    filters = language_id.train(docs)
    if not filters.languages:
        return docs
    found = language_id.identify(whole(docs), filters, carry=True, with_text=True).filter((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= LEAST_SCORE))
    new = {"text": F.col("text"), "lang": F.coalesce("_given._docs.lang", "lang_pred")}
    return found.select(*(new.get(c, F.col(f"_given._docs.{c}")).alias(c) for c in docs.columns))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that stand earlier; those of which no word is left go.

    Rows with one doc_id count as one document, rows with a null one as a
    document behind all others (see line_dedup). Texts that lose nothing stay,
    blank ones included. An empty table gives no rows.
    """
    found = line_dedup.deduplicate(whole(docs))
    found = found.filter(F.col("removed").isNull() | F.rlike("cleaned", F.lit(r"[^\x20\x09-\x0D]")))
    return with_text(found, docs.columns, "_docs")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of five-word shingles with a similarity of 0.8 or more.

    It is a row of the group's smallest doc_id; where that repeats in the group,
    the row whose text has the smallest hash. Rows of one doc_id in different
    groups are different documents. A document with a null doc_id stays if no
    row with its set of shingles has an id, and once for each such set. Texts
    without a word stay, once for each doc_id and text.
    """
    kept = near_dup.near_duplicates(docs, rows=True).filter("kept").groupBy("group", "doc_id", "row").agg(F.count("*").alias("n"))
    kept = kept.groupBy("group").agg(F.min(F.struct("doc_id", "row", "n")).alias("k"))
    kept = staged(kept.select(F.col("k.doc_id").alias("_id"), F.col("k.row").alias("_row"), F.col("k.n").alias("_n")), "kept")
    given = docs.select(F.struct(*docs.columns).alias("_docs"), "doc_id", "text").select("_docs", F.col("doc_id").cast("long").alias("_i"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("_r"))
    found = given.join(kept, F.col("_i").eqNullSafe(F.col("_id")) & (F.col("_r") == F.col("_row")))
    # only rows that are copies of each other are grouped
    if not kept.filter("_n > 1").isEmpty():
        found = found.filter("_n = 1").union(found.filter("_n > 1").dropDuplicates(["_i", "_r"]))
    return found.select("_docs.*")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of 2048 tokens.

    Null and empty texts take one token; rows that repeat a doc_id are packed
    each. An empty table gives no rows.
    """
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("language ID", language),
    ("line dedup", lines),
    ("MinHash near-dedup", near_duplicates),
    ("best-fit packing", packed),
]

#: Tokenisation and the plan of sequences have no form in SQL; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = staged(docs, name.replace(" ", "-"))
    return docs
