"""Polygons to cells of one resolution, by centre, containment, intersection or share of overlap; and ring expansion.

A polygon is first met by coarse cells; each is filled in by its own task, so one
polygon spreads over many. Geometry is exact within tolerance: containment and
intersection with great-circle edges, shares of area in a local equidistant plane.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hexsupport.functions import bits, grid, planar
from hexsupport.functions.project import azimuthal, gnomonic
from hexsupport.operators.cells import SupportError, as_cells, checked, whole_number
from hexsupport.operators.index import ABOVE, index
from hexsupport.operators.meet import filled
from hexsupport.operators.polygons import DEPTH, cell_rings, checked_polygons, descend, numbered, reach, shapes
from hexsupport.sources.shared import written

RULES = ("center", "within", "intersects", "overlap")
#: A cell is contained if no more than this share of it lies outside.
SLIVER = 1e-9


def centre_cells(polygons: DataFrame, crs: int, res: int) -> DataFrame:
    """``(poly, cell)``: cells whose centre lies in a polygon, in the plane of longitude and latitude."""
    low = max(0, res - DEPTH)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            for (poly,), part in df.groupby(["poly"]):
                shape = shapes(part.geometry[:1], crs)[0]
                for coarse in part.coarse.to_numpy():
                    cell = descend(planar.box(shape), np.array([coarse]), low, res)
                    lat, lng = grid.centres(cell)
                    cell = cell[planar.inside(shape, np.stack([lng, lat], 1))]
                    yield pd.DataFrame({"poly": np.full(len(cell), poly, np.int64), "cell": cell})

    rows = reach(polygons, crs, low).join(polygons.select("poly", "geometry"), "poly")
    return rows.repartition("poly", "coarse").select("poly", "coarse", "geometry").mapInPandas(run, "poly long, cell long")


def _seeds(polygons: DataFrame, crs: int, res: int) -> DataFrame:
    """``(poly, cell)``: the cell of a point inside each polygon."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            at = np.array([planar.interior_point(s) for s in shapes(df.geometry, crs)]).reshape(-1, 2)
            yield pd.DataFrame({"poly": df.poly, "cell": grid.cells(at[:, 1], at[:, 0], res) if len(at) else np.zeros(0, np.int64)})

    return polygons.select("poly", "geometry").mapInPandas(run, "poly long, cell long")


def disks(cells: DataFrame, rings: int) -> DataFrame:
    """``cells(cell)`` and all within ``rings`` steps, each once: a task goes outwards from its own cells, whatever the number of rings."""
    turn = max(1, 1_000_000 // (1 + 3 * rings * (rings + 1)))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            cell = df.cell.to_numpy()
            for k in range(0, len(cell), turn):
                whole = edge = np.unique(cell[k : k + turn])
                for _ in range(rings):
                    edge = np.setdiff1d(grid.neighbours(edge)[1], whole)
                    whole = np.union1d(whole, edge)
                yield pd.DataFrame({"cell": whole})

    cells = cells.select("cell").distinct()
    return cells.mapInPandas(run, "cell long").distinct() if rings else cells


def expand(cells: DataFrame, rings: int = 1, column: str = "h3", validate: bool = True) -> DataFrame:
    """``(h3)``: single-resolution cells and those within ``rings`` steps; empty in, empty out."""
    rings = whole_number(rings, 0, None, "`rings` must be a non-negative integer")
    if validate:
        checked(cells, "x", column, single="")
    return disks(as_cells(cells, column), rings).select(bits.to_text(F.col("cell")).alias("h3"))


def near_groups(cells: DataFrame, polygons: DataFrame, crs: int, res: int) -> DataFrame:
    """``(poly, coarse, cells, geometry)``: the cells below a coarse cell (at most ``7 ** DEPTH``) and a polygon that they may meet; an equi-join on coarse cells."""
    low = max(0, res - DEPTH)
    below = cells.select("cell", bits.parent(F.col("cell"), low).alias("coarse")).groupBy("coarse").agg(F.collect_list("cell").alias("cells"))
    pairs = reach(polygons, crs, low).join(below, "coarse")
    return pairs.join(polygons.select("poly", "geometry"), "poly").select("poly", "coarse", "cells", "geometry")


def meeting(polygons: DataFrame, crs: int, res: int, areas: bool = False) -> DataFrame:
    """``(cell, poly, within, area, share)``: all cells of a resolution that have a point in common with a polygon, by the polygons' index."""
    finest = max(0, res - ABOVE)
    return filled(index(polygons, crs, finest, spherical=True), res, finest, areas)


def _pieces(crs: int, spherical: bool):
    """(cell, rings): what a polygon covers of a cell, in the cell's local plane."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            out = []
            for cells, shape in zip(df.cells, shapes(df.geometry, crs), strict=True):
                cell = np.asarray(cells, np.int64)
                lat, lng = grid.centres(cell)
                for c, ring, at in zip(cell, cell_rings(cell), zip(lng, lat, strict=True), strict=True):
                    to = gnomonic(*at) if spherical else azimuthal(*at)
                    found = planar.clipped(planar.mapped(shape, to), to(ring))
                    if found:
                        out.append((c, [r.ravel().tolist() for r in found]))
            yield pd.DataFrame(out, columns=["cell", "rings"])

    return run


def _covered(least: float, spherical: bool):
    """Cells of which pieces cover at least a share."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            keep = []
            cell = df.cell.to_numpy()
            lat, lng = grid.centres(cell)
            for pieces, ring, at in zip(df.pieces, cell_rings(cell), zip(lng, lat, strict=True), strict=True):
                to = gnomonic(*at) if spherical else azimuthal(*at)
                groups = [[np.array(r, float).reshape(-1, 2) for r in piece] for piece in pieces]
                keep.append(planar.union_area(groups) >= least * planar.ring_area(to(ring)))
            yield df.loc[keep, ["cell"]]

    return run


def cover(polygons: DataFrame, resolution: int, boundary: str = "center", min_overlap: float | None = None, crs: int = 4326, validate: bool = True, exhaustive: bool = False) -> DataFrame:
    """``(h3)``: the cells of a resolution that cover a polygon table under a rule, each once.

    ``center``: the centre lies in a polygon. ``within``: the cell lies in the
    union. ``intersects``: it has a point in common with a polygon. ``overlap``: at
    least ``min_overlap`` of its area is covered by the union (1: ``within``, of all
    candidates). Candidates of the last two are the centre cells, the cell of a
    point inside each polygon, and their neighbours: polygons thinner than a cell
    and sharp corners may meet cells beyond. With ``exhaustive`` every cell that
    meets a polygon is a candidate.
    """
    resolution = whole_number(resolution, 0, bits.FINEST, "`resolution` must be an integer between 0 and 15")
    if boundary not in RULES:
        raise SupportError(f"`boundary` must be one of {RULES}")
    if boundary == "overlap":
        if isinstance(min_overlap, bool) or not isinstance(min_overlap, (int, float)) or not 0 < min_overlap <= 1:
            raise SupportError("`min_overlap` must be a number over 0 and up to 1")
    elif min_overlap is not None:
        raise SupportError("`min_overlap` is only used with the overlap boundary")
    if validate:
        checked_polygons(polygons, crs)
    polygons = numbered(polygons)
    if boundary == "center":
        cells = centre_cells(polygons, crs, resolution).select("cell").distinct()
        return cells.select(bits.to_text(F.col("cell")).alias("h3"))
    shared = boundary != "intersects"
    met = meeting(polygons, crs, resolution, areas=shared)
    if boundary != "within" and not exhaustive:
        beside = disks(centre_cells(polygons, crs, resolution).unionByName(_seeds(polygons, crs, resolution)).select("cell"), 1)
        met = met.join(beside, "cell", "left_semi")
    if not shared:
        cells = met.select("cell").distinct()
    else:
        spherical = boundary == "within" or min_overlap == 1
        least = 1 - SLIVER if spherical else min_overlap
        # what one polygon covers is known; only where several together may cover enough, their union is laid out
        per = written(met.groupBy("cell").agg(F.count("*").alias("n"), F.max("share").alias("most"), F.sum("share").alias("all")))
        alone = per.filter(F.col("most") >= least).select("cell")
        several = per.filter((F.col("n") > 1) & (F.col("most") < least) & (F.col("all") >= least * (1 - 1e-6))).select("cell")
        pieces = near_groups(several, polygons, crs, resolution).mapInPandas(_pieces(crs, spherical), "cell long, rings array<array<double>>")
        grouped = pieces.groupBy("cell").agg(F.collect_list("rings").alias("pieces"))
        cells = alone.unionByName(grouped.mapInPandas(_covered(least, spherical), "cell long"))
    return cells.select(bits.to_text(F.col("cell")).alias("h3"))
