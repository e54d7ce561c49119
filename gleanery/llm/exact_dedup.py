"""Exact deduplication by content-defined chunk recipes, in DataFrame functions only.

A text is cut where its content says so, so that equal passages make equal
chunks. Each chunk has a 64-bit identifier, and identifiers are verified over
the corpus: one that stands for chunks of different SHA-256 is told apart by a
rank. A document is then its recipe, the ordered list of its chunks'
identifiers, and documents are equal where their recipes are. Texts are read
once and never shuffled; recipes are about a hundredth of their size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, documents, id_text, salted_left_join, staged

LEAST, MOST = 256, 4096
#: A chunk ends behind a space, where the letters around it say so, or at MOST code points.
BOUNDARY = "(?<=[aeionst,.;] )(?=[b-dfghklmpr-tv])"
CHUNK = f"(?s).{{{LEAST},{MOST - 1}}}?(?:{BOUNDARY}|\\z)|.{{{MOST}}}|.{{1,{LEAST - 1}}}"


def recipes(docs: DataFrame, key_bits: int = 64) -> DataFrame:
    """(doc_id, text_sha256, keys, marks): each chunk's identifier and SHA-256, in order."""
    normal = id_text(docs).select("doc_id", F.regexp_replace("text", SPACE, " ").alias("text"))
    cut = normal.select("doc_id", F.sha2("text", 256).alias("text_sha256"), F.regexp_extract_all("text", F.lit(CHUNK), F.lit(0)).alias("_chunks"))
    key = lambda c: F.shiftrightunsigned(F.xxhash64(c), 64 - key_bits) if key_bits < 64 else F.xxhash64(c)
    return cut.select(
        "doc_id",
        "text_sha256",
        F.transform("_chunks", key).alias("keys"),
        F.transform("_chunks", lambda c: F.unhex(F.sha2(c, 256))).alias("marks"),
    )


def verified(found: DataFrame) -> DataFrame:
    """(doc_id, text_sha256, recipe): identifiers that stand for several chunks are told apart."""
    chunks = found.select("doc_id", "text_sha256", F.posexplode(F.arrays_zip("keys", "marks")).alias("pos", "chunk"))
    chunks = chunks.select("doc_id", "text_sha256", "pos", "chunk.keys", "chunk.marks")
    several = chunks.groupBy("keys", "marks").agg(F.lit(1).alias("_one")).groupBy("keys").agg(F.count("*").alias("n"), F.min("marks").alias("first")).filter("n > 1")
    several = staged(several.select("keys", "first"), "ambiguous")
    if several.isEmpty():
        return found.select("doc_id", "text_sha256", F.col("keys").alias("recipe"), F.lit(None).cast("array<struct<pos:int,mark:binary>>").alias("extra"))
    # such chunks, but for the first of each identifier, are named by their whole digest
    other = chunks.join(several, "keys").filter("marks <> first")
    other = other.groupBy("doc_id", "text_sha256").agg(F.array_sort(F.collect_set(F.struct("pos", F.col("marks").alias("mark")))).alias("extra"))
    return found.join(other, ["doc_id", "text_sha256"], "left").select("doc_id", "text_sha256", F.col("keys").alias("recipe"), "extra")


def exact_duplicates(docs: DataFrame, key_bits: int = 64) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), one row for each row of docs.

    Texts are equal when identical after each run of white space has become one
    space; null counts as empty, and all empty texts are one group. keep_id is
    the group's smallest doc_id, group_size its number of rows. Rows that
    repeat a doc_id and its text count each, and share all values. Other
    columns are ignored; a null doc_id is never the smallest of several. An empty
    table gives no rows.

    Groups are counted before the shuffle, and a large group's rows are dealt
    over salts, so copies that make up much of the corpus spread over tasks.
    """
    found = staged(verified(staged(recipes(docs, key_bits), "recipes")), "verified")
    parts = ["recipe", "extra"]
    groups = found.groupBy(*parts).agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size")).filter("group_size > 1")
    # null-safe key for the join
    null_safe = lambda d: d.withColumn("extra", F.coalesce("extra", F.expr("cast(array() as array<struct<pos:int,mark:binary>>)")))
    joined = salted_left_join(null_safe(found), null_safe(groups), parts, F.col("doc_id"))
    keep = F.coalesce("keep_id", "doc_id")
    return joined.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"),
        "text_sha256",
    )


def op1_exact_dedup(spark, sf_dir):
    return exact_duplicates(documents(spark, sf_dir))


ORACLE = r"""
SELECT doc_id, min(doc_id) OVER (PARTITION BY n) AS keep_id, count(*) OVER (PARTITION BY n) AS group_size,
  doc_id = min(doc_id) OVER (PARTITION BY n) AS kept, sha256(n) AS text_sha256
FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS n FROM documents)
"""
