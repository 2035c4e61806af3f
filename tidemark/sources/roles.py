"""The driver's tables in the roles that the operators expect."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table below ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _dense(sums: DataFrame, key: str, value: str) -> DataFrame:
    """Every key on every day between the first and the last of all keys; days without rows are 0.

    The two ends are one row, which every key gets; each key's days are then made where the key is.
    """
    ends = sums.agg(F.min("date").alias("a"), F.max("date").alias("b"))
    keys = sums.select(key).distinct().join(F.broadcast(ends))
    ends = keys.select(key, F.explode(F.sequence("a", "b")).alias("date"))
    return ends.join(sums, [key, "date"], "left").select(key, "date", F.coalesce(value, F.lit(0.0)).alias(value))


def daily_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(segment, date, flow): orders' total by priority and day, exact to the cent before it becomes a double."""
    o = table(spark, sf_dir, "orders")
    cents = F.sum(F.round(F.col("o_totalprice") * 100).cast("long"))
    sums = o.groupBy(F.col("o_orderpriority").alias("segment"), F.to_date("o_orderdate").alias("date"))
    return _dense(sums.agg((cents / 1e6).alias("flow")), "segment", "flow")


def daily_rain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cell, date, rain): shipped quantity by return flag and day."""
    li = table(spark, sf_dir, "lineitem")
    sums = li.groupBy(F.col("l_returnflag").alias("cell"), F.to_date("l_shipdate").alias("date"))
    return _dense(sums.agg((F.sum(F.col("l_quantity").cast("long")) / 10.0).alias("rain")), "cell", "rain")


def scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(scene, ts, day, aoi, orbit, cloud): events as satellite scenes."""
    e = table(spark, sf_dir, "events")
    cloud = F.round(F.pmod("value", F.lit(100.0)), 4)
    return e.select(
        F.col("event_id").alias("scene"),
        "ts",
        F.to_date("ts").alias("day"),
        F.col("user_id").alias("aoi"),
        F.col("event_type").alias("orbit"),
        cloud.alias("cloud"),
    )


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(px, row, col, class, b1...b8): vectors as pixels, bands scaled to digital numbers from 0 to 10000."""
    e = table(spark, sf_dir, "embeddings")
    bands = [
        F.least(F.greatest(F.floor((F.element_at("embedding", i).cast("double") + 0.5) * 8000), F.lit(0)), F.lit(10000)).cast("int").alias(f"b{i}")
        for i in range(1, 9)
    ]
    place = [F.floor(F.col("vec_id") / 32).cast("int").alias("row"), F.pmod("vec_id", F.lit(32)).cast("int").alias("col")]
    return e.select(F.col("vec_id").alias("px"), *place, F.col("label").alias("class"), *bands)
