"""Structured Streaming counterparts: what a stream has seen gives what a batch over all of it gives."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lexmill.storage import scratch_path


def stream_of(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """A table's files as a stream."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_trigger)
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(target).isDirectory():
        return reader.parquet(path)
    folder, _, name = path.rpartition("/")
    return reader.option("pathGlobFilter", name).parquet(folder)


def final_rows(updates: DataFrame, keys: list[str], checkpoint: str | None = None) -> DataFrame:
    """Run a stream of updates over all there is and give the last row of each key.

    Updates are appended with their batch's number; a repeated batch writes its folder anew, so a retry adds nothing.
    """
    spark = updates.sparkSession
    out = scratch_path(spark, "stream-updates")

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch_number", F.lit(number)).write.mode("overwrite").parquet(f"{out}/n={number}")

    query = updates.writeStream.outputMode("update").option("checkpointLocation", checkpoint or scratch_path(spark, "stream-state")).foreachBatch(keep).trigger(availableNow=True).start()
    query.awaitTermination()
    names = updates.columns
    schema = spark.createDataFrame([], updates.schema).withColumn("batch_number", F.lit(0)).schema
    last = F.max_by(F.struct(*names), "batch_number")
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(out).groupBy(*[F.col(k).alias(f"key_{k}") for k in keys]).agg(last.alias("r")).select("r.*")


def hourly(events: DataFrame, late: str = "30 days") -> DataFrame:
    """Tumbling windows with a watermark; state of hours behind it goes."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    counted = timed.groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))
    return counted.select(F.col("window.start").alias("hour"), "event_type", "n", "value")


def sliding(events: DataFrame, late: str = "30 days") -> DataFrame:
    """ST4: windows of an hour every half hour, with a watermark."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    counted = timed.groupBy(F.window("ts", "1 hour", "30 minutes"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))
    return counted.select(F.col("window.start").alias("hour"), "event_type", "n", "value")


def latest(events: DataFrame, key: str, version: str, arrival: str, keep: list[str]) -> DataFrame:
    """W1 as a running aggregate: one row of state a key."""
    best = F.max_by(F.struct(*keep), F.struct(F.col(version), -F.col(arrival)))
    return events.where(F.col(key).isNotNull()).groupBy(key).agg(best.alias("r")).select(key, "r.*")


def first_seen(events: DataFrame, keys: list[str], late: str) -> DataFrame:
    """Duplicates within the watermark go; the first to arrive stays."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def moving_average(values: DataFrame, key: str, order: str, value: str, k: int) -> DataFrame:
    """W12 with state: (key, average, n) after each batch; values come in order of batches and are sorted within one."""
    alpha = 2.0 / (k + 1)

    def fold(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        average, n = state.get if state.exists else (None, 0)
        rows = pd.concat(list(batches)).dropna(subset=["v"]).sort_values("o")
        for v in rows["v"]:
            average = float(v) if average is None else alpha * float(v) + (1 - alpha) * average
            n += 1
        if average is not None:
            state.update((average, n))
            yield pd.DataFrame({"k": [group[0]], "average": [average], "n": [n]})

    narrow = values.select(F.col(key).cast("string").alias("k"), F.col(order).cast("long").alias("o"), F.col(value).cast("double").alias("v"))
    return narrow.groupBy("k").applyInPandasWithState(fold, "k string, average double, n long", "average double, n long", "update", GroupStateTimeout.NoTimeout)
