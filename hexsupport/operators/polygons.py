"""Polygon tables: checks, and which coarse cells each polygon comes near."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hexsupport.functions import grid, planar
from hexsupport.functions.project import SYSTEMS, from_lng_lat, gnomonic, supported, to_lng_lat
from hexsupport.operators.cells import SupportError
from hexsupport.sources.fixtures import GEOMETRY
from hexsupport.sources.shared import written

#: Radius of a resolution-0 cell in degrees of arc, with room for descendants that stand out of their ancestor.
REACH = 1.7 * 1.1 * 1281.256 / 6371.0088 * 180 / np.pi
#: Levels below a coarse cell that one task fills in at once: at most 7 ** 5 cells.
DEPTH = 5


def checked_polygons(polygons: DataFrame, crs: int | None, id_col: str | None = None) -> None:
    """Raises unless there are valid polygons, a supported reference system and, if asked for, unique ids."""
    if crs is None:
        raise SupportError("Polygons must have a defined coordinate reference system")
    if not supported(crs):
        raise SupportError(f"Reference system {crs} is not supported; use one of {SYSTEMS}, a UTM zone (32601 to 32660, 32701 to 32760) or a projection string")
    if "geometry" not in polygons.columns or polygons.schema["geometry"].dataType.simpleString() != GEOMETRY:
        raise SupportError("Polygons need a `geometry` column of POLYGON or MULTIPOLYGON as nested arrays")
    if id_col is not None:
        if not isinstance(id_col, str) or id_col not in polygons.columns:
            raise SupportError(f"Polygon id column `{id_col}` was not found")
        ids = polygons.agg(F.count("*").alias("n"), F.count(f"`{id_col}`").alias("there"), F.count_distinct(f"`{id_col}`").alias("kinds")).first()
        if ids.there < ids.n:
            raise SupportError("Polygon ids have missing values")
        if ids.kinds < ids.n:
            raise SupportError(f"`{id_col}` must uniquely identify polygons")
    worst = polygons.select("geometry").mapInPandas(_faults, "fault string").groupBy("fault").count().collect()
    if not worst:
        raise SupportError("There must be at least one polygon")
    bad = {r.fault: r["count"] for r in worst if r.fault}
    if bad:
        raise SupportError(f"Invalid or empty geometries: {bad}")


def _faults(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for df in frames:
        yield pd.DataFrame({"fault": ["missing" if g is None else planar.faults(planar.shape_of(g)) for g in df.geometry]})


def shapes(column: pd.Series, crs: int) -> list[planar.Shape]:
    """Shapes in longitude and latitude."""
    return [planar.mapped(planar.shape_of(g), lambda p: to_lng_lat(p, crs)) for g in column]


def _near(box: tuple[float, float, float, float], cell: np.ndarray, res: int) -> np.ndarray:
    """Which cells may have a descendant that comes near a box of longitudes and latitudes."""
    lat, lng = grid.centres(cell)
    pad = REACH * np.sqrt(7.0) ** -res
    wide = pad / np.maximum(np.cos(np.radians(np.minimum(np.abs(lat) + pad, 89.9))), 1e-3)
    west, south, east, north = box
    lap = np.maximum(np.maximum(west - lng, lng - east), 0)
    lap = np.minimum(lap, np.maximum(np.maximum(west - (lng - 360), (lng - 360) - east), 0))
    lap = np.minimum(lap, np.maximum(np.maximum(west - (lng + 360), (lng + 360) - east), 0))
    return (lap <= wide) & (np.maximum(south - lat, lat - north) <= pad)


def descend(box: tuple[float, float, float, float], cell: np.ndarray, low: int, high: int) -> np.ndarray:
    """Descendants at ``high`` of cells of resolution ``low`` that may come near a box."""
    cell = cell[_near(box, cell, low)]
    for res in range(low + 1, high + 1):
        cell = grid.children(cell)
        cell = cell[_near(box, cell, res)]
    return cell


def reach(polygons: DataFrame, crs: int, res: int) -> DataFrame:
    """``(poly, coarse)``: the cells of resolution ``res`` that each polygon of ``polygons(poly, geometry)`` comes near."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            for poly, shape in zip(df.poly, shapes(df.geometry, crs), strict=True):
                found = descend(planar.box(shape), grid.roots(), 0, res)
                yield pd.DataFrame({"poly": np.full(len(found), poly, np.int64), "coarse": found})

    return polygons.select("poly", "geometry").mapInPandas(run, "poly long, coarse long")


def numbered(polygons: DataFrame) -> DataFrame:
    """``polygons`` with ``poly``: the place of each row in the table. It is written once, so that all that reads it sees the same places."""
    return written(polygons.withColumn("poly", F.monotonically_increasing_id()))


def cell_rings(cell: np.ndarray, whole: bool = False) -> list[np.ndarray]:
    """Boundaries as anticlockwise rings of longitude and latitude; continuous over the antimeridian.

    ``whole``: with the points where edges cross the icosahedron's.
    """
    lat, lng, n = grid.outlines(cell) if whole else grid.boundaries(cell)
    out = []
    for a, b, k in zip(lat, lng, n, strict=True):
        ring = np.stack([b[:k], a[:k]], 1)
        ring[:, 0] = ring[0, 0] + (ring[:, 0] - ring[0, 0] + 180) % 360 - 180
        out.append(planar.anticlockwise(ring))
    return out


def plane_for(centre: tuple[float, float], crs: int):
    """Where topology is judged: great circles are straight for longitude and latitude, the plane of the reference system else."""
    return gnomonic(*centre) if crs == 4326 else lambda p: from_lng_lat(p, crs)
