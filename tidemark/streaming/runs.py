"""Streams over files: everything that is there now, in one or more batches, into a table of the shared folder.

The reference has no streams; these are extensions of its windowed totals.
"""

from __future__ import annotations

import uuid


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import shared_folder


def read(spark: SparkSession, path: str, files_per_batch: int = 64) -> DataFrame:
    """A stream of the Parquet files at ``path``, with the schema they have now."""
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(f"{path[:-1]}[{path[-1]}]")  # as a pattern, the path may also be that of a single file


def settle(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """Run a stream over all there is and return its last state (complete mode) or all it sent (append mode).

    Each batch goes to a folder of its own, so a batch that is run again after a failure overwrites what it wrote.
    """
    spark = stream.sparkSession
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    seen: list[int] = []

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/batch={number}")
        seen.append(number)

    run = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(put).start()
    run.awaitTermination()
    if not seen:
        return spark.createDataFrame([], stream.schema)
    wanted = [max(seen)] if mode == "complete" else sorted(set(seen))
    return spark.read.schema(stream.schema).parquet(*[f"{base}/out/batch={n}" for n in wanted])


def hourly_complete(events: DataFrame, least: int, late: str = "7 days") -> DataFrame:
    """Daily totals by kind, null unless at least ``least`` events are in."""
    day = F.window("ts", "1 day")
    out = events.withWatermark("ts", late).groupBy(day, "event_type").agg(F.count("*").alias("n"), F.sum(F.round(F.col("value") * 10000).cast("long")).alias("v"))
    return out.select(F.col("window.start").cast("date").alias("day"), "event_type", "n", F.when(F.col("n") >= least, F.col("v") / 1e4).alias("total"))


def sliding(events: DataFrame) -> DataFrame:
    """Totals of seven days, every day."""
    out = events.withWatermark("ts", "7 days").groupBy(F.window("ts", "7 days", "1 day"), "event_type").agg(F.count("*").alias("n"))
    return out.select(F.col("window.start").cast("date").alias("start"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "12 hours") -> DataFrame:
    """Runs of events of a user without a longer gap."""
    out = events.withWatermark("ts", "1 day").groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("session_window.start").cast("timestamp_ntz").alias("start"), F.col("session_window.end").cast("timestamp_ntz").alias("stop"), "n")


def span(events: DataFrame) -> str:
    """How late a row of a table can come when its files are read in any order: the days between its ends, and one."""
    ends = events.agg(F.datediff(F.max("ts"), F.min("ts"))).first()[0]
    return f"{(ends or 0) + 1} days"


def distinct_days(events: DataFrame, late: str) -> DataFrame:
    """The first event of each user and day, by dropping duplicates within the watermark; rows later than ``late`` go."""
    d = events.withColumn("day", F.to_date("ts")).withWatermark("ts", late)
    return d.dropDuplicatesWithinWatermark(["user_id", "day"]).select("user_id", "day")


