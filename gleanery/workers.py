"""Python workers find this package also when the driver was started elsewhere."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def reach(spark: SparkSession) -> None:
    """Puts the package's folder on the workers' path; where executors don't have it, ship it with --py-files."""
    root, env = os.path.dirname(os.path.dirname(os.path.abspath(__file__))), spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])
