"""Readers with declared schemas, and connectors' common behaviour."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The columns of a field log, in order.
FIELD_LOG = T.StructType(
    [T.StructField(n, T.StringType() if n in ("date", "site", "depths_m", "times_s", "note") else T.DoubleType()) for n in (
        "date", "site", "lat", "lon", "width_m", "depths_m", "distance_m", "times_s", "coefficient", "area_m2", "surface_m_s",
        "flow_m3s", "low_m3s", "high_m3s", "flow_mld", "time_spread_pct", "note",
    )]
)


def null_nan(df: DataFrame) -> DataFrame:
    """NaN means no data: it becomes null once, at the edge."""
    kinds = {f.name: f.dataType for f in df.schema}
    return df.select(*[F.when(~F.isnan(n), F.col(n)).alias(n) if isinstance(k, (T.DoubleType, T.FloatType)) else F.col(n) for n, k in kinds.items()])


def wide_daily(spark: SparkSession, path: str, names: dict[str, str]) -> DataFrame:
    """A wide daily CSV (a date, one column a river id) -> (segment, date, flow); unknown columns go.

    A gzip file cannot be split: the rows are dealt out again after the read.
    """
    header = spark.read.option("header", True).csv(path).columns
    schema = T.StructType([T.StructField(header[0], T.DateType())] + [T.StructField(c, T.DoubleType()) for c in header[1:]])
    wide = null_nan(spark.read.option("header", True).schema(schema).csv(path)).withColumnRenamed(header[0], "date")
    kept = [c for c in header[1:] if c in names]
    long = wide.repartition(spark.sparkContext.defaultParallelism).unpivot("date", kept, "id", "flow")
    name = F.create_map(*[F.lit(x) for c in kept for x in (c, names[c])])[F.col("id")]
    return long.select(name.alias("segment"), "date", "flow")


def features(spark: SparkSession, path: str) -> DataFrame:
    """A GeoJSON FeatureCollection of lines -> (feature, way, seq, lon, lat), a row for each vertex."""
    schema = "features array<struct<properties: map<string,string>, geometry: struct<type: string, coordinates: array<array<double>>>>>"
    f = spark.read.option("multiLine", True).schema(schema).json(path).select(F.posexplode("features").alias("feature", "f"))
    v = f.select("feature", F.col("f.properties")["osm_way"].cast("long").alias("way"), F.posexplode("f.geometry.coordinates").alias("seq", "c"))
    return v.select("feature", "way", "seq", F.element_at("c", 1).alias("lon"), F.element_at("c", 2).alias("lat"))


def first_asset(assets: Column, names: Sequence[str]) -> Column:
    """An item's asset by name: the first of the candidates in any case, else the first whose name contains one."""
    keys = F.map_keys(assets)

    def equal(name: str) -> Column:
        return F.get(F.filter(keys, lambda k: F.lower(k) == name.lower()), F.lit(0))

    def inside(name: str) -> Column:
        return F.get(F.filter(keys, lambda k: F.contains(F.lower(k), F.lit(name.lower()))), F.lit(0))

    return F.try_element_at(assets, F.coalesce(*map(equal, names), *map(inside, names)))


def first_working(makers: Sequence[Callable[[], DataFrame]]) -> DataFrame:
    """The first source that has rows; later ones are asked only if those before fail or are empty."""
    failed: list[Exception] = []
    for make in makers:
        try:
            found = make()
            if not found.isEmpty():
                return found
        except Exception as error:  # the next source may do
            failed.append(error)
    raise RuntimeError(f"no source has rows: {failed}")


def checked_gap_free(series: DataFrame, key: str) -> DataFrame:
    """The series, each row carrying a check that its key's days have no gap and no negative value."""
    from pyspark.sql import Window as W

    w = W.partitionBy(key)
    span = F.datediff(F.max("date").over(w), F.min("date").over(w)) + 1
    good = (F.count("date").over(w) == span) & (F.min("flow").over(w) >= 0)
    return series.withColumn("ok", good).withColumn("flow", F.when(F.col("ok"), F.col("flow")).otherwise(F.raise_error(F.lit("days are missing or negative")).cast("double"))).drop("ok")


def new_years(have: DataFrame, wanted: DataFrame) -> DataFrame:
    """The years still to be fetched, for an ingest that goes on where it stopped."""
    return wanted.join(have.select("year").distinct(), "year", "left_anti")
