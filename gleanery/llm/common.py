"""What the operators share: staging, batch bounds, input hygiene, skew joins."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..workers import reach

#: The white space of every contract: space, \t, \n, \v, \f, \r.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
BATCH_ROWS = 256


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see.

    spark.checkpoint.dir names it on a cluster. Unset, a local session gets a
    temporary folder (removed at exit), any other a folder in the warehouse.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if spark.sparkContext.master.startswith("local") and "cluster" not in spark.sparkContext.master:
        found = tempfile.mkdtemp(prefix="gleanery-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        found = f"file://{found}"
    else:
        found = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_staged"
    spark.conf.set("spark.checkpoint.dir", found)
    return found


def staged(df: DataFrame, label: str) -> DataFrame:
    """Writes df to the shared folder and returns a reader of it.

    This cuts the lineage, so a lost executor costs a re-read, not the jobs
    before; and what reads it twice computes it once. The driver's garbage is
    collected, as Spark then drops the shuffle files of the jobs behind it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def arrow_bounds(spark: SparkSession) -> None:
    """Bounds the rows and bytes that one Arrow batch holds in a Python worker, which finds this package."""
    reach(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def id_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *more: Column) -> DataFrame:
    """(doc_id, text), null text as empty; other columns go, whatever their names, but for `more`."""
    return df.select(
        *more,
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )


def carried(docs: DataFrame, carry: bool, own: list[str]) -> list[Column]:
    """All columns of docs but `own`, as one column _given, if they are to be carried along."""
    names = [c for c in docs.columns if c not in own]
    return [F.struct(*(F.col(f"`{c}`") for c in names)).alias("_given")] if carry and names else []


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def salted_left_join(
    many: DataFrame, few: DataFrame, keys: list[str], by: Column, salts: int = 16
) -> DataFrame:
    """Left join in which a key with a large share of `many` goes to `salts` tasks.

    `few` has one row for a key and is repeated once for each salt; `by` is any
    expression that differs between rows of one key.
    """
    left = many.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(salts)).cast("int"))
    right = few.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*keys, "_salt"], "left").drop("_salt")
