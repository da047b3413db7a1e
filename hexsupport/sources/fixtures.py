"""Small polygon tables to try the operators on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: A multipolygon as nested arrays: polygons, rings, points, coordinates.
GEOMETRY = "array<array<array<array<double>>>>"


def rectangle(west: float, south: float, east: float, north: float) -> list[list[float]]:
    return [[west, south], [east, south], [east, north], [west, north], [west, south]]


def _closed(*points: float) -> list[list[float]]:
    ring = [[points[k], points[k + 1]] for k in range(0, len(points), 2)]
    return [*ring, ring[0]]


#: Four shapes around Melbourne.
TOY = {
    "regular": [[rectangle(144.90, -37.85, 145.00, -37.75)]],
    "irregular": [[_closed(145.05, -37.86, 145.14, -37.84, 145.17, -37.79, 145.13, -37.77, 145.16, -37.72, 145.08, -37.73, 145.03, -37.80)]],
    "complex": [[_closed(144.72, -37.75, 144.78, -37.77, 144.81, -37.74, 144.86, -37.76, 144.84, -37.71, 144.91, -37.68, 144.88, -37.64, 144.82, -37.67, 144.79, -37.63, 144.74, -37.66, 144.70, -37.70)]],
    "hole": [[rectangle(145.20, -37.85, 145.32, -37.73), _closed(145.24, -37.81, 145.24, -37.77, 145.28, -37.77, 145.28, -37.81)]],
}
#: Features with a shared edge, a hole, its filling, and two parts.
FEATURES = {
    "100": [[rectangle(144.90, -37.90, 145.00, -37.80)]],
    "200": [[rectangle(145.00, -37.90, 145.10, -37.80)]],
    "500": [[rectangle(144.90, -37.78, 145.10, -37.66), _closed(144.97, -37.74, 144.97, -37.70, 145.03, -37.70, 145.03, -37.74)]],
    "600": [[rectangle(144.97, -37.74, 145.03, -37.70)]],
    "400": [[rectangle(144.91, -37.64, 144.95, -37.60)], [rectangle(145.05, -37.64, 145.09, -37.60)]],
}


def toy_polygons(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(TOY.items()), f"geometry_id string, geometry {GEOMETRY}")


def toy_features(spark: SparkSession) -> DataFrame:
    rows = [(i, g, f"Feature {i}", group, kind) for (i, g), group, kind in zip(FEATURES.items(), "AABBC", (1, 1, 2, 2, 3), strict=True)]
    return spark.createDataFrame(rows, f"feature_id string, geometry {GEOMETRY}, feature_name string, group_name string, class_name int")
