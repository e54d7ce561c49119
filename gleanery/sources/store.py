"""The index as Parquet tables in one folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import CHUNKS, EMBEDDINGS, ERRORS, POSTINGS, SYMBOLS

SCHEMAS = {"chunks": CHUNKS, "symbols": SYMBOLS, "embeddings": EMBEDDINGS, "chunk_postings": POSTINGS, "symbol_postings": POSTINGS, "errors": ERRORS}
#: Tables are laid out by what they are looked up with, so that row groups prune.
SORTED_BY = {"chunks": "file_path", "symbols": "symbol_name", "embeddings": "chunk_id", "chunk_postings": "term", "symbol_postings": "term", "errors": "path"}


class Store:
    """Overwrites tables as a whole, so indexing again is idempotent; opening creates nothing.

    A table is a folder of versions and a pointer that names the one that
    counts. The pointer is replaced by one rename, so a crash at any time
    leaves either the old table or the new one.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def current(self, table: str) -> str | None:
        """The folder of the version that counts, if there is one."""
        fs, p = self._fs(f"{self.path}/{table}.current")
        if not fs.exists(p):
            return None
        stream = fs.open(p)
        try:
            name = bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()
        return f"{self.path}/{table}/{name}"

    def exists(self, table: str) -> bool:
        return self.current(table) is not None

    def read(self, table: str) -> DataFrame:
        """The table, empty if it has not been written."""
        found = self.current(table)
        if found is None:
            return self.spark.createDataFrame([], SCHEMAS[table])
        return self.spark.read.schema(SCHEMAS[table]).parquet(found)

    def write(self, table: str, df: DataFrame) -> None:
        """Replaces the table: a new version is written, as df may read the old one, and pointed to; then older ones go."""
        name, jvm = uuid.uuid4().hex, self.spark.sparkContext._jvm
        df.repartitionByRange(SORTED_BY[table]).sortWithinPartitions(SORTED_BY[table]).write.parquet(f"{self.path}/{table}/{name}")
        fs, pointer = self._fs(f"{self.path}/{table}.current")
        _, written = self._fs(f"{self.path}/{table}.{name}")
        stream = fs.create(written, True)
        try:
            stream.write(bytearray(name.encode()))
        finally:
            stream.close()
        rename = jvm.org.apache.hadoop.fs.Options.Rename
        how = self.spark.sparkContext._gateway.new_array(rename, 1)
        how[0] = rename.OVERWRITE
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        context.rename(fs.makeQualified(written), fs.makeQualified(pointer), how)
        for status in fs.listStatus(self._fs(f"{self.path}/{table}")[1]):
            if status.getPath().getName() != name:
                fs.delete(status.getPath(), True)

    def upsert_embeddings(self, new: DataFrame) -> None:
        """Inserts or replaces by chunk id; of several new rows of an id, one stays."""
        self.write("embeddings", upserted(self.read("embeddings"), new))

    def import_embeddings_json(self, path: str, lines: bool = False) -> None:
        """Reads {"chunk": {"id": …}, "embedding": […]} records: one JSON array, or with `lines` what the export wrote."""
        schema = "chunk struct<id string>, embedding array<float>"
        self.upsert_embeddings(self.spark.read.schema(schema).json(path, multiLine=not lines).select(F.col("chunk.id").alias("chunk_id"), "embedding"))

    def export_embeddings_json(self, path: str) -> None:
        """Writes a folder of JSON lines {"chunk": {"id": …}, "embedding": […]}, in the order of ids over its files."""
        rows = self.read("embeddings").orderBy("chunk_id")
        rows.select(F.struct(F.col("chunk_id").alias("id")).alias("chunk"), "embedding").write.mode("overwrite").json(path)

    def clear(self) -> None:
        for table in SCHEMAS:
            for name in (f"{table}.current", table):
                fs, p = self._fs(f"{self.path}/{name}")
                fs.delete(p, True)


def upserted(old: DataFrame, new: DataFrame) -> DataFrame:
    """(chunk_id, embedding), new rows before old ones; an aggregation, so no window over a hot id."""
    both = old.select("chunk_id", "embedding", F.lit(0).alias("age")).unionByName(new.select("chunk_id", "embedding", F.lit(1).alias("age")))
    return both.groupBy("chunk_id").agg(F.max(F.struct("age", "embedding")).alias("_e")).select("chunk_id", F.col("_e.embedding").alias("embedding"))
