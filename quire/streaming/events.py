"""Streams: windows over events, and bodies graded as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Counts per window and type; on a stream, events later than `late` are left out."""
    src = events.withWatermark("ts", late) if events.isStreaming else events
    return src.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start_ts"), "event_type", "n", "total")


def sliding(events: DataFrame, width: str = "2 hours", step: str = "1 hour", late: str = "1 day") -> DataFrame:
    src = events.withWatermark("ts", late) if events.isStreaming else events
    return src.groupBy(F.window("ts", width, step).alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start_ts"), "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    src = events.withWatermark("ts", late) if events.isStreaming else events
    return src.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start_ts"), "n")


def read_stream(spark: SparkSession, folder: str, name: str, files_per_batch: int = 1) -> DataFrame:
    """A table of the folder as a stream of its files; a table is one file, or a folder of files of any names."""
    path = f"{folder}/{name}.parquet"
    stream = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_batch)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where).isDirectory():
        return stream.parquet(path)
    return stream.option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def drain(stream: DataFrame, out: str, checkpoint: str, transform) -> None:
    """Runs transform on each micro-batch until the source is empty; finished batches aren't run again after a restart."""

    def batch(df: DataFrame, number: int) -> None:
        transform(df).write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
