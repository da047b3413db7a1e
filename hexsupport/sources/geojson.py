"""Polygon tables from and to GeoJSON lines: one feature on each line, read and written by Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hexsupport.sources.fixtures import GEOMETRY


def read(spark: SparkSession, path: str, properties: str) -> DataFrame:
    """Features with the given properties (a schema such as ``"id string, name string"``) and ``geometry``; other geometry types become null."""
    raw = "array<array<array<array<double>>>>"
    schema = f"properties struct<{', '.join(f'{n.split()[0]}:{n.split()[1]}' for n in properties.split(','))}>, geometry struct<type:string,coordinates:string>"
    rows = spark.read.text(path).select(F.from_json("value", schema).alias("f")).filter("f IS NOT NULL")
    multi = F.from_json("f.geometry.coordinates", raw)
    single = F.array(F.from_json("f.geometry.coordinates", "array<array<array<double>>>"))
    geometry = F.when(F.col("f.geometry.type") == "MultiPolygon", multi).when(F.col("f.geometry.type") == "Polygon", single)
    return rows.select("f.properties.*", geometry.cast(GEOMETRY).alias("geometry"))


def write(df: DataFrame, path: str) -> None:
    """Writes ``df(…, geometry)`` as GeoJSON lines."""
    properties = F.struct(*(F.col(f"`{c}`") for c in df.columns if c != "geometry"))
    shape = F.struct(F.lit("MultiPolygon").alias("type"), F.col("geometry").alias("coordinates"))
    df.select(F.to_json(F.struct(F.lit("Feature").alias("type"), properties.alias("properties"), shape.alias("geometry")))).write.text(path)
