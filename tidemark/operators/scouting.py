"""The scouting queue of an area's fields: robust z-scores, an isolation forest, priorities and reasons."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators.pixels import isolation_forest
from tidemark.session import materialize

LEAST_FOREST = 12  # fields that a forest needs; with fewer the rules alone decide
ORDER = ("HIGH", "WATCH", "LOW", "INSUFFICIENT DATA", "NOT CROPLAND")


def robust_scores(cells: DataFrame, area: str, features: Sequence[str], able: Column, least: int = 5) -> DataFrame:
    """F42 for every feature: z_<feature>, how far a cell is from the median of its area's able cells, in scaled median
    deviations; null for other cells, with under ``least`` values or without spread. Two aggregates by area, joined back."""
    d = cells.withColumn("_able", able)
    for f in features:
        d = d.withColumn(f"_{f}", F.when(F.col("_able"), F.col(f)))
    mid = d.groupBy(area).agg(*[F.median(f"_{f}").alias(f"_m_{f}") for f in features], *[F.count(f"_{f}").alias(f"_n_{f}") for f in features])
    d = d.join(mid, area)
    spread = d.groupBy(area).agg(*[(1.4826 * F.median(F.abs(F.col(f"_{f}") - F.col(f"_m_{f}")))).alias(f"_s_{f}") for f in features])
    d = d.join(spread, area)
    z = lambda f: F.when((F.col(f"_n_{f}") >= least) & (F.col(f"_s_{f}") > 1e-9), (F.col(f"_{f}") - F.col(f"_m_{f}")) / F.col(f"_s_{f}"))
    return d.select(*cells.columns, *[z(f).alias(f"z_{f}") for f in features])


def queue(cells: DataFrame, area: str, key: str, features: Sequence[str], stress: Sequence[str], field: Column, seen: Column) -> DataFrame:
    """``cells(area, key, features...)`` -> with z-scores, ``outlier``, ``strength``, ``stress_z``, ``priority``, ``place`` and ``reason``.

    Cells are candidates where they are fields, seen well enough and have every feature. Areas with 12 candidates or more
    let an isolation forest on the z-scores (null as 0) name outliers: outlier and stress_z <= -1.5 is HIGH, either WATCH.
    In smaller areas -2.5 and -1.5 decide. An area is one task's group of the forest; it is a grid of some hundred cells.
    """
    able = F.coalesce(field & seen & reduce(lambda a, b: a & b, [F.col(f).isNotNull() for f in features]), F.lit(False))
    d = robust_scores(cells.withColumn("_field", F.coalesce(field, F.lit(False))).withColumn("_cand", able), area, features, F.col("_cand"))
    d = d.withColumn("_count", F.count_if("_cand").over(W.partitionBy(area)))
    names = [f"z_{f}" for f in features]
    # A forest takes far longer than its rows' size tells. Read from a table and dealt out by a given count, areas stay
    # spread over all partitions; after the window, Spark would leave the shuffle out and join its small partitions to one.
    parts = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cand = materialize(d.where(F.col("_cand") & (F.col("_count") >= LEAST_FOREST)).select(area, key, *names))
    forest = isolation_forest(cand.repartition(parts, area), area, key, names)
    d = d.join(forest, [area, key], "left").withColumn("outlier", F.coalesce("outlier", F.lit(False)))
    low = [F.col(f"z_{f}") for f in stress]
    d = d.withColumn("stress_z", F.least(*low) if len(low) > 1 else low[0])
    under = lambda x: F.coalesce(F.col("stress_z") <= x, F.lit(False))
    many = F.col("_count") >= LEAST_FOREST
    high = F.when(many, F.col("outlier") & under(-1.5)).otherwise(under(-2.5))
    watch = F.when(many, F.col("outlier") | under(-1.5)).otherwise(under(-1.5))
    priority = F.when(~F.col("_field"), ORDER[4]).when(~F.col("_cand"), ORDER[3]).when(high, ORDER[0]).when(watch, ORDER[1]).otherwise(ORDER[2])
    d = d.withColumn("priority", priority)
    far = F.array_sort(F.array(*[F.struct(F.abs(F.col(n)).alias("far"), F.lit(f).alias("name"), F.col(n).alias("z")) for n, f in zip(names, features)]))
    worst = F.element_at(F.filter(far, lambda x: x["far"].isNotNull()), -1)
    most = F.when(F.size(F.filter(far, lambda x: x["far"].isNotNull())) > 0, F.concat(worst["name"], F.format_string(" %+.2f", worst["z"])))
    unlike = F.concat(F.coalesce(most, F.lit("n/a")), F.when(F.col("outlier"), ", unlike the other fields").otherwise(""))
    reason = F.when(F.col("priority").isin("HIGH", "WATCH"), unlike).when(F.col("priority") == "LOW", "like the other fields").otherwise(F.lower("priority"))
    place = F.array_position(F.array(*map(F.lit, ORDER)), F.col("priority")).cast("int")
    return d.withColumn("place", place).withColumn("reason", reason).drop("_field", "_cand", "_count")
