"""A bank feed matched against the ledger as it comes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tieout import schemas


def bank_stream(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """New CSV files of a folder."""
    return spark.readStream.schema(schemas.BANK).option("header", True).option("maxFilesPerTrigger", files_per_batch).csv(folder)


def matched(feed: DataFrame, ledger: DataFrame) -> DataFrame:
    """Feed rows with matched, true where the ledger has a row of the same amount, day and memo: a stream-static join without
    state."""
    known = ledger.select(F.col("gl_date").alias("posted_date"), F.col("amount").alias("posted_amount"), F.col("line_memo").alias("messy_memo")).distinct().withColumn("_hit", F.lit(True))
    return feed.join(known, ["posted_date", "posted_amount", "messy_memo"], "left").withColumn("matched", F.coalesce("_hit", F.lit(False))).drop("_hit")


def daily_totals(feed: DataFrame, lateness: str = "7 days") -> DataFrame:
    """Sums by day, final once the watermark has passed: rows later than lateness do not count."""
    timed = feed.withColumn("at", F.col("posted_date").cast("timestamp"))
    return timed.withWatermark("at", lateness).groupBy(F.window("at", "1 day")).agg(F.sum("posted_amount").alias("amount"), F.count(F.lit(1)).alias("n")).select(F.col("window.start").cast("date").alias("day"), "amount", "n")


def write(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """All that is there now, exactly once."""
    return stream.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
