"""Cell geometry for maps: boundaries as nested arrays, well-known text, GeoJSON, and a plain SVG picture."""

from __future__ import annotations

from collections.abc import Iterator
from html import escape

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hexsupport.functions import bits
from hexsupport.operators.cells import checked
from hexsupport.operators.polygons import cell_rings
from hexsupport.sources.fixtures import GEOMETRY


def boundaries(cells: DataFrame, column: str = "h3", validate: bool = True) -> DataFrame:
    """``cells`` with ``geometry``: a closed ring of longitude and latitude for each row, also repeated ones.

    Edges that cross one of the icosahedron's, as some of odd resolutions do, have a further point there.
    """
    if validate:
        checked(cells, "x", column, empty_ok=False)
    base = cells.drop("geometry").withColumn("_cell", bits.to_long(F.col(f"`{column}`")))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            rings = cell_rings(df._cell.to_numpy(np.int64), whole=True) if len(df) else []
            yield df.drop(columns="_cell").assign(geometry=[[[[*r.tolist(), r[0].tolist()]]] for r in rings])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema if f.name != "_cell")
    return base.mapInPandas(run, f"{schema}, geometry {GEOMETRY}")


def _joined(level: int) -> str:
    """Points of a ring as text, in SQL."""
    sep = ("concat(cast(p[0] AS string), ' ', cast(p[1] AS string))", "concat('[', cast(p[0] AS string), ',', cast(p[1] AS string), ']')")[level]
    return f"array_join(transform(r, p -> {sep}), '{', ' if level == 0 else ','}')"


def with_wkt(df: DataFrame) -> DataFrame:
    """``df`` with ``wkt`` from ``geometry``."""
    rings = f"array_join(transform(g, r -> concat('(', {_joined(0)}, ')')), ', ')"
    return df.withColumn("wkt", F.expr(f"concat('MULTIPOLYGON (', array_join(transform(geometry, g -> concat('(', {rings}, ')')), ', '), ')')"))


def with_geojson(df: DataFrame) -> DataFrame:
    """``df`` with ``geojson``: a geometry object as text."""
    return df.withColumn("geojson", F.to_json(F.struct(F.lit("MultiPolygon").alias("type"), F.col("geometry").alias("coordinates"))))


def svg(cells: DataFrame, context: DataFrame | None = None, width: int = 800, most: int = 100_000) -> str:
    """A picture of ``cells(geometry)`` and, over them, outlines of ``context(geometry)``; for at most ``most`` shapes of each."""

    def paths(df: DataFrame) -> list[list[np.ndarray]]:
        rows = df.select("geometry").limit(most + 1).collect()
        if len(rows) > most:
            raise ValueError(f"over {most} shapes do not make a picture")
        return [[np.array(ring, float) for polygon in r.geometry for ring in polygon] for r in rows]

    own, other = paths(cells), paths(context) if context is not None else []
    points = np.concatenate([ring for rings in own + other for ring in rings])
    west, south = points.min(axis=0)
    east, north = points.max(axis=0)
    squeeze = np.cos(np.radians((south + north) / 2))
    unit = width / max((east - west) * squeeze, 1e-9)

    def drawn(rings: list[np.ndarray], style: str) -> str:
        d = "".join("M" + "L".join(f"{(x - west) * squeeze * unit:.2f},{(north - y) * unit:.2f}" for x, y in ring) + "Z" for ring in rings)
        return f'<path d="{d}" style="{escape(style)}"/>'

    shapes = [drawn(r, "fill:#cfe3f5;stroke:#4477aa;stroke-width:0.5") for r in own] + [drawn(r, "fill:none;stroke:#000;stroke-width:2") for r in other]
    return f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 {width} {(north - south) * unit:.2f}">{"".join(shapes)}</svg>'
