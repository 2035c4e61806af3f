"""Streams that are taken up again: a folder keeps what has come, by year, and a later run brings only what is new.

Extensions, like the other streams. Nothing that came is rewritten. Corrections stand beside what they correct, and reading
takes the newest; so a batch that is run again after a failure overwrites its own folder and nothing else.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def bring(stream: DataFrame, base: str, day: Column, mode: str = "append") -> int:
    """Bring all that is new into the folder ``base``, by the year of ``day``; returns how many batches that took, 0 if
    nothing was new. With ``mode`` update, totals that changed are brought again.

    The folder is one of the shared ones; a run into it after lost executors, or another day, goes on where the last ended.
    Rows without a day are kept under a null year.
    """
    dated = stream.withColumn("year", F.year(day))
    taken: set[int] = set()

    def put(batch: DataFrame, number: int) -> None:
        # A year's rows of a batch lie together, so that years don't end up as a small file of every task.
        batch.repartition("year", F.pmod(F.xxhash64(*batch.columns), F.lit(8))).write.mode("overwrite").partitionBy("year").parquet(f"{base}/rows/batch={number}")
        taken.add(number)

    run = dated.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(put).start()
    run.awaitTermination()
    return len(taken)


def brought(spark: SparkSession, base: str, schema: T.StructType) -> DataFrame:
    """All that came into a folder, with ``year`` and ``batch``; a filter on years reads those alone. Empty before the first run."""
    whole = T.StructType([*schema.fields, T.StructField("batch", T.LongType()), T.StructField("year", T.IntegerType())])
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{base}/rows")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], whole)
    return spark.read.schema(whole).option("basePath", f"{base}/rows").parquet(f"{base}/rows")


def newest(rows: DataFrame, keys: list[str], version: list[str]) -> DataFrame:
    """Of the rows of a key the one with the greatest ``version``, of equal ones the greatest by the other columns; null
    versions are the least, and rows with null keys are a key like any other.

    Tasks fold their own rows first, so a key with a third of all rows sends a row a task; no key's rows are gathered.
    """
    rest = [c for c in rows.columns if c not in keys and c not in version]
    top = F.max(F.struct(*version, *rest)).alias("top")
    return rows.groupBy(*keys).agg(top).select(*[F.col(c) if c in keys else F.col(f"top.{c}").alias(c) for c in rows.columns])


def missing_years(rows: DataFrame, first: int, last: int) -> DataFrame:
    """The years of a span that have not come yet, as ``year``."""
    span = rows.sparkSession.range(first, last + 1).select(F.col("id").cast("int").alias("year"))
    return span.join(rows.where("year is not null").select("year").distinct(), "year", "left_anti")


def daily_totals(stream: DataFrame, keys: list[str], value: Column, late: str) -> DataFrame:
    """A stream with ``ts`` -> ``(day, keys..., n, total)`` for each day so far, to be brought in update mode; the state of a
    day is let go ``late`` after it, and what comes later than that is lost."""
    days = stream.withWatermark("ts", late).groupBy(F.window("ts", "1 day"), *keys)
    return days.agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("window.start").cast("date").alias("day"), *keys, "n", "total")


def final(totals: DataFrame, lag: int = 7) -> DataFrame:
    """The days that are final: those at least ``lag`` days before the newest one that has come."""
    end = totals.agg(F.date_sub(F.max("day"), lag).alias("end"))
    return totals.join(F.broadcast(end), F.col("day") <= F.col("end")).drop("end")
