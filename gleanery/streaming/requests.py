"""The JSON-lines server as a stream: a folder of request files in, response files out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..engine import Engine
from ..sizes import release


def serve_stream(spark: SparkSession, engine: Engine, requests_dir: str, responses_dir: str, checkpoint: str) -> StreamingQuery:
    """Answers each micro-batch; a batch that runs again after a failure overwrites its own folder."""
    lines = spark.readStream.text(requests_dir)

    def answer(batch: DataFrame, number: int) -> None:
        numbered = batch.withColumn("request_id", F.monotonically_increasing_id())
        out = engine.serve(numbered).select(F.col("response").alias("value"))
        out.write.mode("overwrite").text(f"{responses_dir}/batch={number}")
        release()

    return lines.writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
