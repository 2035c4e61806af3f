"""Writers: CSV with six significant digits, yearly upserts, GeoJSON, reports of small results."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def write_csv(df: DataFrame, path: str, digits: int = 6) -> None:
    """Doubles with so many significant digits, dates in ISO form."""
    out = []
    for f in df.schema:
        text = F.format_string(f"%.{digits}g", F.col(f.name)) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else None
        out.append((F.when(F.col(f.name).isNotNull(), text) if text is not None else F.col(f.name)).alias(f.name))
    df.select(*out).write.mode("overwrite").option("header", True).csv(path)


def upsert_years(df: DataFrame, path: str) -> None:
    """Rows by year; a year that is written again replaces what was there, the others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("year").parquet(path)


def write_features(df: DataFrame, path: str, lon: str, lat: str) -> None:
    """Points as GeoJSON features, one a line."""
    properties = F.struct(*[c for c in df.columns if c not in (lon, lat)])
    point = F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates"))
    df.select(F.to_json(F.struct(F.lit("Feature").alias("type"), point.alias("geometry"), properties.alias("properties")))).write.mode("overwrite").text(path)


def report(title: str, parts: Mapping[str, DataFrame | str | float], most: int = 200) -> str:
    """A Markdown report; scalars are bullets, tables sections. Of a table with more than
    ``most`` rows, as a report is read by people, the first are shown and a line says so."""
    lines = [f"# {title}", ""]
    for name, part in parts.items():
        if isinstance(part, DataFrame):
            lines += ["", f"## {name}", "", "| " + " | ".join(part.columns) + " |", "|" + "---|" * len(part.columns)]
            rows = part.limit(most + 1).collect()
            lines += ["| " + " | ".join("n/a" if v is None else str(v) for v in row) + " |" for row in rows[:most]]
            lines += ["", f"Only the first {most} rows are shown."] * (len(rows) > most)
        else:
            lines.append(f"- {name}: {part}")
    return "\n".join(lines) + "\n"
