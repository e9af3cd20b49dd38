"""Records as they arrive: the stateless operators on streams, and percentiles that grow by merging.

A streaming DataFrame goes through the same functions as a table (`refused.judged_lines`, `packed.info_items`, ...).
What is kept between batches is sketches: a batch adds one small file of them, so late records simply merge into their
day, and a batch that is run again replaces its own file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from svlattice.operators import percentiles


def first_deliveries(records: DataFrame, keys: list[str], at: str = "loaded_at", late: str = "14 days") -> DataFrame:
    """A stream without repeated records: of equal keys the first within the watermark."""
    return records.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def grow_daily_sketches(records: DataFrame, files: DataFrame, folder: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Starts a query that adds each batch's (caller, svtype, day) sketches under `folder`."""

    def add(batch: DataFrame, batch_id: int) -> None:
        percentiles.daily_sketches(batch, files).write.mode("overwrite").parquet(f"{folder}/batch_id={batch_id}")

    writer = records.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def read_daily(spark: SparkSession, folder: str) -> DataFrame:
    """Percentiles by caller, svtype and day of all batches so far."""
    by = ["caller", "svtype", "day"]
    return percentiles.read_percentiles(percentiles.merged(spark.read.parquet(folder), by), by)


def hourly_counts(records: DataFrame, at: str = "loaded_at", late: str = "1 day") -> DataFrame:
    """Arrivals by hour and svtype of a stream; hours close once the watermark has passed them."""
    df = records.withWatermark(at, late).groupBy(F.window(at, "1 hour"), "svtype").agg(F.count("*").alias("n"))
    return df.select(F.col("window.start").alias("hour"), "svtype", "n")
