"""The session every entry point uses."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


#: Bytes of one Arrow batch to a Python worker.
BATCH_BYTES = 8 << 20


def bounded_batches(df: DataFrame) -> DataFrame:
    """df; its session from now on sends Python workers Arrow batches of a few MB, so that long texts do not add up, and
    tells new workers where this package is, in case the driver alone has it on its path."""
    spark = df.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    paths, root = spark.sparkContext.environment.get("PYTHONPATH", ""), str(Path(__file__).resolve().parents[1])
    if root not in paths.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [paths, root]))
    return df


def session(name: str = "tieout", **settings: str) -> SparkSession:
    """An existing session, or a new one; the master and sizes are the cluster's to set."""
    builder = SparkSession.builder.appName(name)
    for key, value in {**SETTINGS, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
