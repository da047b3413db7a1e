"""A polygon table as cells of mixed resolution.

A polygon becomes inner cells, all of whose descendants lie in it whole, at the
coarsest resolution at which that holds, without geometry; and border cells of
one resolution, each with only the edges that come near it and whether its centre
lies inside. Whether a place near a border cell lies in the polygon then follows
from the edges between it and that centre, so no task but the one that reads a
polygon's row ever holds all of its corners, and inner cells meet other cells by
an equi-join alone. A step down looks only at the edges of the cell above.

Rows: ``poly, cell, inside, edges``; ``edges`` is null in inner cells, else four
coordinates of each edge, with the polygon to the left. Long edges are cut to the
neighbourhood of their cell.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hexsupport.functions import bits, grid, planar, spaces
from hexsupport.functions.project import to_lng_lat
from hexsupport.operators.cells import SupportError
from hexsupport.sources.shared import written

#: Pairs of cells and edges that are looked at together; it bounds memory, not results.
PAIRS = 1 << 18
#: Levels that one task goes down from one cell.
STEP = 4
#: Edges of a border cell that are not dealt out further where the resolution follows the polygons.
FEW = 64
#: Levels between border cells and the cells that are related to them.
ABOVE = 2
SCHEMA = "poly long, cell long, inside boolean, edges array<double>"
PENTAGONS = np.array(bits.PENTAGONS)


@dataclass
class Nodes:
    """Cells of polygons, by place, each with a stretch of edges."""

    poly: np.ndarray
    cell: np.ndarray
    inside: np.ndarray
    sizes: np.ndarray
    edges: np.ndarray

    def __len__(self) -> int:
        return len(self.poly)

    def take(self, keep: np.ndarray) -> Nodes:
        return Nodes(self.poly[keep], self.cell[keep], self.inside[keep], self.sizes[keep], self.edges[np.repeat(keep, self.sizes)])

    @staticmethod
    def joined(parts: list[Nodes]) -> Nodes:
        return Nodes(*(np.concatenate([getattr(p, k) for p in parts]) for k in ("poly", "cell", "inside", "sizes", "edges")))

    def frame(self) -> pd.DataFrame:
        ends = np.cumsum(self.sizes)
        edges = [self.edges[e - n : e].ravel() if n else None for e, n in zip(ends.tolist(), self.sizes.tolist(), strict=True)]
        return pd.DataFrame({"poly": self.poly, "cell": self.cell, "inside": self.inside, "edges": pd.Series(edges, dtype=object)})


def nodes_of(frame: pd.DataFrame) -> Nodes:
    edges = [np.asarray(e, float).reshape(-1, 4) for e in frame.edges]
    return Nodes(frame.poly.to_numpy(), frame.cell.to_numpy(), frame.inside.to_numpy(bool), np.array([len(e) for e in edges], np.int64), np.concatenate([*edges, np.empty((0, 4))]))


def oriented_edges(shape: planar.Shape, place) -> np.ndarray:
    """All edges, shells anticlockwise and holes clockwise, but for those without length."""
    out = []
    if place.crs == 4326:
        x, y, z = place.at(np.concatenate(planar.rings(shape))).mean(0)
        lng, lat = np.degrees(np.arctan2(y, x)), np.degrees(np.arctan2(z, np.hypot(x, y)))
    for polygon in shape:
        for k, ring in enumerate(polygon):
            flat = place.local(np.full(len(ring), lng), np.full(len(ring), lat), place.at(ring)) if place.crs == 4326 else ring
            ring = ring if (planar.ring_area(flat) >= 0) == (k == 0) else ring[::-1]
            out.append(np.concatenate([ring, np.roll(ring, -1, axis=0)], 1))
    out = np.concatenate(out)
    return out[(out[:, :2] != out[:, 2:]).any(1)]


def _centres(cell: np.ndarray) -> np.ndarray:
    lat, lng = grid.centres(cell)
    return np.stack([lng, lat], 1)


def _near(points: np.ndarray, lng) -> np.ndarray:
    """Points with longitudes within half a turn of others: a plane has two images of one meridian."""
    return np.stack([lng + (points[:, 0] - lng + 180) % 360 - 180, points[:, 1]], 1)


def _around(middle: np.ndarray, angle: np.ndarray, res: int) -> tuple[np.ndarray, np.ndarray]:
    """(place in ``middle``, cell): the cells of a resolution below which something may lie within an angle, half their radius at most, of a place."""
    sphere = spaces.Sphere()
    if res == 0:
        own, cell = np.repeat(np.arange(len(middle)), 122), np.tile(grid.roots(), len(middle))
    else:
        lng, lat = np.degrees(np.arctan2(middle[:, 1], middle[:, 0])), np.degrees(np.arcsin(np.clip(middle[:, 2], -1, 1)))
        own, cell = np.arange(len(middle)), grid.cells(lat, lng, res)
        for _ in range(3):
            k, beside = grid.neighbours(cell)
            pairs = np.unique(np.concatenate([np.stack([own, cell], 1), np.stack([own[k], beside], 1)]), axis=0)
            own, cell = pairs[:, 0], pairs[:, 1]
    near = sphere.apart(sphere.at(_centres(cell)), middle[own]) <= angle[own] + spaces.REACH * np.sqrt(7.0) ** -res + 1e-9
    return own[near], cell[near]


def first_nodes(poly: np.ndarray, edges: np.ndarray, sizes: np.ndarray, place, finest: int) -> Iterator[tuple[int, Nodes]]:
    """(resolution, nodes): each polygon's cells of the finest resolution whose radius is twice the polygon's or more.

    ``sizes``: how many of ``edges`` each of ``poly`` has.
    """
    starts = np.cumsum(sizes) - sizes
    try:
        middle, angle = place.caps(edges, starts)
        origin = place.outside(edges, starts)
    except ValueError as error:
        raise SupportError(str(error)) from None
    level = np.clip(np.floor(-2 * np.log(np.maximum(2 * angle, 1e-12) / spaces.REACH) / np.log(7.0)), 0, finest).astype(int)
    a, b = vectors(edges[:, :2], place), vectors(edges[:, 2:], place)
    for res in np.unique(level).tolist():
        chosen = np.flatnonzero(level == res)
        own, cell = _around(middle[chosen], angle[chosen], res)
        own = chosen[own]
        points = _centres(cell)
        if place.crs != 4326:
            points = _near(points, np.degrees(np.arctan2(middle[own, 1], middle[own, 0])))
        at, reach = place.at(points), place.radius(points, res)
        odd, counts, picked = np.zeros(len(cell), np.int64), np.zeros(len(cell), np.int64), []
        for node, edge in slices(sizes[own], starts[own]):
            odd += np.bincount(node, spaces.crosses(origin[own[node]], at[node], a[edge], b[edge]), len(cell)).astype(np.int64)
            near = spaces.within(place, at[node], a[edge], b[edge], reach[node] * (1 + 1e-6))
            counts += np.bincount(node[near], minlength=len(cell))
            picked.append(edge[near])
        inside = odd % 2 == 1
        yield res, Nodes(poly[own], cell, inside, counts, edges[np.concatenate([*picked, np.empty(0, np.int64)])]).take(inside | (counts > 0))


def slices(sizes: np.ndarray, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, place) of all places of each row's stretch, a bounded number at a time, also where one stretch is longer than that."""
    ends = np.cumsum(sizes)
    for begun in range(0, int(ends[-1]) if len(ends) else 0, PAIRS):
        at = np.arange(begun, min(begun + PAIRS, int(ends[-1])))
        row = np.searchsorted(ends, at, "right")
        yield row, at - (ends - sizes)[row] + starts[row]


def _lng_lat(points: np.ndarray, place) -> np.ndarray:
    return to_lng_lat(points, place.crs)


def vectors(points: np.ndarray, place) -> np.ndarray:
    """Edge ends, in the coordinates of the polygons' system, as vectors of the space."""
    return place.at(points) if place.crs == 4326 else np.concatenate([points, np.ones((len(points), 1))], 1)


def _level(nodes: Nodes, place, res: int) -> Nodes:
    """The children, at ``res``, of border cells, each with the parent's edges that come near it; those outside are left out."""
    parents = np.repeat(np.arange(len(nodes)), 7)
    digit = np.tile(np.arange(7), len(nodes))
    own = nodes.cell[parents]
    cell = (own & ~(np.int64(15) << 52) & ~(np.int64(7) << 3 * (grid.FINEST - res))) | np.int64(res) << 52 | digit.astype(np.int64) << 3 * (grid.FINEST - res)
    used = nodes.cell & (np.int64(1) << 45) - 1
    penta = np.isin(nodes.cell >> 45 & 127, PENTAGONS) & (used == (np.int64(1) << 3 * (grid.FINEST + 1 - res)) - 1)
    there = ~(penta[parents] & (digit == 1))
    parents, cell = parents[there], cell[there]
    starts = np.cumsum(nodes.sizes) - nodes.sizes
    points, origin = _centres(cell), _centres(nodes.cell)
    if place.crs != 4326:
        around = _lng_lat(nodes.edges[starts, :2], place)[:, 0]
        points, origin = _near(points, around[parents]), _near(origin, around)
    origin = place.at(origin)
    at, reach = place.at(points), place.radius(points, res)
    a, b = vectors(nodes.edges[:, :2], place), vectors(nodes.edges[:, 2:], place)
    inside, counts, picked = nodes.inside[parents].astype(np.int64), np.zeros(len(cell), np.int64), []
    for child, edge in slices(nodes.sizes[parents], starts[parents]):
        inside += np.bincount(child, spaces.crosses(origin[parents[child]], at[child], a[edge], b[edge]), len(cell)).astype(np.int64)
        near = spaces.within(place, at[child], a[edge], b[edge], reach[child] * (1 + 1e-6))
        counts += np.bincount(child[near], minlength=len(cell))
        picked.append(place.cut(nodes.edges[edge[near]], at[child[near]], reach[child[near]]))
    inside = inside % 2 == 1
    return Nodes(nodes.poly[parents], cell, inside, counts, np.concatenate([*picked, np.empty((0, 4))])).take(inside | (counts > 0))


def descended(nodes: Nodes, place, res: int, goal: int, crowded: int | None = None) -> Iterator[Nodes]:
    """Inner cells, and border cells at ``goal``, of border cells at ``res``; with ``crowded``, those of more than ``FEW`` edges go on down to that resolution."""
    while len(nodes):
        border = nodes.sizes > 0
        if res >= goal:
            more = nodes.sizes > FEW if crowded is not None and res < crowded else np.zeros(len(nodes), bool)
            yield nodes.take(~more)
            if not more.any():
                return
            nodes, border = nodes.take(more), border[more]
        if not border.all():
            yield nodes.take(~border)
        nodes = nodes.take(border)
        if int(nodes.sizes.sum()) > PAIRS and len(nodes) > 1:  # depth first, so that wide polygons stay small here
            for k in range(0, len(nodes), max(1, len(nodes) // 8)):
                own = np.zeros(len(nodes), bool)
                own[k : k + max(1, len(nodes) // 8)] = True
                yield from descended(nodes.take(own), place, res, goal, crowded)
            return
        if len(nodes):
            nodes, res = _level(nodes, place, res + 1), res + 1


def index(polygons: DataFrame, crs: int, finest: int | None, spherical: bool = False) -> DataFrame:
    """The index of ``polygons(poly, geometry)`` with border cells of resolution ``finest``.

    Without ``finest`` border cells follow each polygon's size, and go further down
    where its edges are crowded.

    With ``spherical`` corners are turned into longitude and latitude first, and
    edges between them are great circles whatever the reference system.

    Polygons of longitude and latitude may cross the antimeridian or hold a pole;
    each must lie within 85 degrees of some place. Every row of ``geometry`` is a
    valid polygon. An empty table gives an empty index.
    """
    place = spaces.space(4326 if spherical else crs)

    def shape_of(geometry) -> planar.Shape:
        shape = planar.shape_of(geometry)
        return planar.mapped(shape, lambda p: to_lng_lat(p, crs)) if spherical else shape

    def begin(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if not len(frame):
                continue
            own = [oriented_edges(shape_of(g), place) for g in frame.geometry]
            for res, nodes in first_nodes(frame.poly.to_numpy(), np.concatenate(own), np.array([len(e) for e in own]), place, bits.FINEST - 1 if finest is None else finest):
                if finest is None:
                    goal = min(bits.FINEST, res + 1)
                    for part in descended(nodes, place, res, goal, min(bits.FINEST, goal + 6)):
                        yield part.frame()
                    continue
                # small outlines are finished here, wide ones spread first
                goal = finest if finest - res <= STEP and int(nodes.sizes.sum()) <= PAIRS else min(finest, res + 1)
                for part in descended(nodes, place, res, goal):
                    yield part.frame()

    def go_on(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            level = frame.cell.to_numpy() >> 52 & 15
            for res in np.unique(level).tolist():
                for part in descended(nodes_of(frame[level == res]), place, res, min(finest, res + STEP)):
                    yield part.frame()

    out = written(polygons.select("poly", "geometry").mapInPandas(begin, SCHEMA))
    if finest is None:
        return out
    unfinished = F.col("edges").isNotNull() & (bits.resolution(F.col("cell")) < finest)
    done = []
    # border cells spread over all tasks between steps, so that one polygon's outline is not one task's
    while not (rest := out.filter(unfinished)).isEmpty():
        done.append(out.filter(~unfinished))
        out = written(rest.repartition("poly", "cell").mapInPandas(go_on, SCHEMA))
    for part in done:
        out = out.unionByName(part)
    return out
