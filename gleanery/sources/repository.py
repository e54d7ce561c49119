"""Source files of a repository, and what is extracted from them."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.intent import contains_any
from ..functions.text import content_id, extension, module_path, relative_path, symbol_id
from ..operators.extract import EXTRACTORS, extract
from ..schema import DEFINITION
from ..workers import reach

#: Folders that are skipped, and those skipped unless tests are included.
SKIPPED = ["/.git/", "/node_modules/", "/vendor/", "/target/", "/build/", "/dist/"]
TEST_FOLDERS = ["/test/", "/mock/", "/generated/"]


def skipped(path: Column, include_tests: bool = False) -> Column:
    """Whether a file is left out; the whole path counts, also what lies above the repository."""
    return contains_any(path, SKIPPED + ([] if include_tests else TEST_FOLDERS))


def scan(spark: SparkSession, root: str, include_tests: bool = False) -> DataFrame:
    """(path, content): every file below root that is not skipped and has an extractor; path is relative."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    plain = F.regexp_replace(F.col("path"), "^[a-z]+:/*(?=/)", "")
    found = found.withColumn("path", plain).filter(~skipped(F.col("path"), include_tests) & extension(F.col("path")).isin(list(EXTRACTORS)))
    base = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root).toUri().getPath()
    return found.select(relative_path(F.col("path"), F.lit(base)).alias("path"), "content")


DEFINITIONS = "path string, language string, kind string, name string, start_line int, end_line int, raw_content string, error string"


def definitions(files: DataFrame) -> DataFrame:
    """Rows of (path, content) files: one for each definition, or one with an error.

    content is binary or a string. Files that are not UTF-8 give nothing. A
    file whose extractor fails gives an error row and does not end the job.
    """
    reach(files.sparkSession)
    names = [x.split()[0] for x in DEFINITIONS.split(", ")]

    def run(batches):
        for b in batches:
            rows = []
            for path, data in zip(b.column("path").to_pylist(), b.column("content").to_pylist()):
                try:
                    text = data.decode("utf-8") if isinstance(data, bytes) else data
                except UnicodeDecodeError:
                    continue
                if text is None:
                    continue
                language = EXTRACTORS.get(path.rpartition(".")[2] if "." in path.rpartition("/")[2] else "")
                try:
                    rows += [(path, language, d.kind, d.name, d.start_line, d.end_line, d.text, None) for d in extract(path, text)]
                except Exception as e:  # noqa: BLE001
                    rows.append((path, language, None, None, None, None, None, f"{type(e).__name__}: {e}"))
            kinds = [pa.string()] * 4 + [pa.int32()] * 2 + [pa.string()] * 2
            yield pa.record_batch([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    return files.select("path", "content").mapInArrow(run, DEFINITIONS)


def module(path: Column, language: Column) -> Column:
    return F.when(language == "rust", module_path(path, "::")).otherwise(module_path(path))


def with_ids(found: DataFrame) -> DataFrame:
    good = found.filter(F.col("error").isNull())
    return good.withColumn("symbol_id", symbol_id(F.col("kind"), module(F.col("path"), F.col("language")), F.col("name")))


def symbols_of(found: DataFrame) -> DataFrame:
    return with_ids(found).select("symbol_id", F.col("name").alias("symbol_name"), F.lit(DEFINITION).alias("symbol_type"), F.col("path").alias("file_path"), "start_line", "end_line")


def chunks_of(found: DataFrame) -> DataFrame:
    return with_ids(found).select(
        content_id(F.col("raw_content")).alias("id"), F.col("path").alias("file_path"), "start_line", "end_line", "raw_content", F.array("symbol_id").alias("symbols_defined")
    )
