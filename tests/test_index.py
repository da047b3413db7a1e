"""The polygon index and what is settled by it: against plain geometry, each cell alone, in several systems and places."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from hexsupport.functions import bits, grid, planar, spaces
from hexsupport.functions.project import azimuthal, from_lng_lat, gnomonic
from hexsupport.operators import index as indexing
from hexsupport.operators import meet
from hexsupport.operators.cells import SupportError
from hexsupport.operators.cover import expand
from hexsupport.operators.polygons import cell_rings, numbered
from hexsupport.operators.relate import assign, membership
from hexsupport.sources.fixtures import GEOMETRY, rectangle


def star(rng, lng: float, lat: float, size: float, corners: int) -> np.ndarray:
    """A ring of longitudes and latitudes around a place, of a size in degrees of arc, also over the antimeridian and poles."""
    turn = (np.arange(corners) + rng.uniform(0.1, 0.9, corners)) / corners * 2 * np.pi
    far = np.radians(size) * rng.uniform(0.4, 1, corners)
    p, l = np.radians(lat), np.radians(lng)
    up = np.array([np.cos(p) * np.cos(l), np.cos(p) * np.sin(l), np.sin(p)])
    east, north = np.array([-np.sin(l), np.cos(l), 0]), np.array([-np.sin(p) * np.cos(l), -np.sin(p) * np.sin(l), np.cos(p)])
    v = np.cos(far)[:, None] * up + np.sin(far)[:, None] * (np.cos(turn)[:, None] * east + np.sin(turn)[:, None] * north)
    return np.stack([np.degrees(np.arctan2(v[:, 1], v[:, 0])), np.degrees(np.arcsin(v[:, 2]))], 1)


def around(lng: float, lat: float, size: float, res: int) -> np.ndarray:
    """All cells of a resolution within a number of degrees of a place."""
    place, cell = spaces.Sphere(), grid.roots()
    at = place.at(np.array([[lng, lat]]))
    for r in range(res + 1):
        cell = grid.children(cell) if r else cell
        y, x = grid.centres(cell)
        cell = cell[place.apart(place.at(np.stack([x, y], 1)), at) <= np.radians(size) + place.radius(at, r)[0]]
    return np.unique(cell)


def first(shape, place, finest: int):
    edges = indexing.oriented_edges(shape, place)
    return list(indexing.first_nodes(np.array([0]), edges, np.array([len(edges)]), place, finest))


def settled(shape, crs: int, cells: np.ndarray, finest: int, areas: bool = True) -> tuple[dict, pd.DataFrame]:
    """What the library finds for cells and one polygon, without Spark: ``{cell: (within, area)}``, and the index."""
    place = spaces.space(crs)
    frames = [n.frame() for res, nodes in first(shape, place, finest) for n in indexing.descended(nodes, place, res, finest)]
    table = pd.concat(frames, ignore_index=True)
    found, inner = {}, table[table.edges.isna()]
    for c in cells.tolist():
        if any(int(grid.ancestor(np.array([c]), int(a >> 52 & 15))[0]) == a for a in inner.cell.tolist()):
            found[c] = (True, None)
    border = table[table.edges.notna()].rename(columns={"cell": "coarse"})
    parents = grid.ancestor(cells, finest)
    border = border[border.coarse.isin(parents)].copy()
    border["cells"] = [cells[parents == c] for c in border.coarse]
    for out in meet.settle(crs, areas)(iter([border])):
        found |= {c: (w, a) for c, w, a in zip(out.cell.tolist(), out.within, out.area, strict=True)}
    return found, table


PLACES = [(145.0, -37.8, 4326), (179.9, 10.0, 4326), (30.0, 89.5, 4326), (-60.0, -88.0, 4326), (0.02, 0.01, 4326), (145.0, -37.8, 3857), (12.0, 60.0, 3857), (145.0, -36.5, 7899), (147.3, -42.0, 32755)]


@pytest.mark.parametrize(("lng", "lat", "crs"), PLACES)
def test_cells_and_polygons_as_one_by_one(lng, lat, crs):
    rng = np.random.default_rng(abs(int(lng * 100 + lat)) + crs)
    for size, corners, res in ((0.08, 9, 6), (0.3, 60, 6), (0.02, 5, 6), (2.5, 12, 4)):
        shell = star(rng, lng, lat, size, corners)
        hole = star(rng, lng, lat, size * 0.15, 7)[::-1]
        shape = [[shell, hole]]
        if crs != 4326:
            shape = planar.mapped(shape, lambda p: from_lng_lat(p, crs))
        cells = around(lng, lat, size * 1.2, res)
        found, _ = settled(shape, crs, cells, res - 2)
        y, x = grid.centres(cells)
        for c, ring, a, b in zip(cells.tolist(), cell_rings(cells), x, y, strict=True):
            to = gnomonic(a, b) if crs == 4326 else lambda p: from_lng_lat(p, crs)
            own = planar.mapped(shape, to) if crs == 4326 else shape
            assert planar.meet([[to(ring)]], own) == (c in found)
            if c in found:
                within, area = found[c]
                assert within == bool(planar.inside(own, to(np.array([[a, b]])))[0])
                if area is not None and crs == 4326 and size < 1:
                    local = azimuthal(a, b)
                    plain = planar.union_area([planar.clipped(planar.mapped(shape, local), local(ring))])
                    whole = planar.ring_area(local(ring))
                    assert abs(area - plain) <= 1e-5 * whole  # edges of the plain way are straight between far corners


def test_areas_of_short_edges_are_exact():
    rng = np.random.default_rng(2)
    shape = [[star(rng, 145.0, -37.8, 0.02, 400)]]
    cells = around(145.0, -37.8, 0.022, 8)
    found, _ = settled(shape, 4326, cells, 6)
    y, x = grid.centres(cells)
    seen = 0
    for c, ring, a, b in zip(cells.tolist(), cell_rings(cells), x, y, strict=True):
        if c in found and found[c][1] is not None:
            local = azimuthal(a, b)
            plain = planar.union_area([planar.clipped(planar.mapped(shape, local), local(ring))])
            assert abs(found[c][1] - plain) <= 1e-9 * planar.ring_area(local(ring))
            seen += 1
    assert seen > 20


def test_index_of_many_corners_stays_small():
    """A ring of 200,000 corners: no border cell carries more than a sliver of its edges."""
    turn = np.linspace(0, 2 * np.pi, 200_000, endpoint=False)
    ring = np.stack([145 + 0.5 * np.cos(turn) * (1 + 0.1 * np.sin(40 * turn)), -37.8 + 0.4 * np.sin(turn) * (1 + 0.1 * np.sin(40 * turn))], 1)
    place = spaces.Sphere()
    ((res, nodes),) = first([[ring]], place, 7)
    border = inner = most = 0
    for part in indexing.descended(nodes, place, res, 7):
        border += int((part.sizes > 0).sum())
        inner += int((part.sizes == 0).sum())
        most = max(most, int(part.sizes.max(initial=0)))
    assert most < 8_000 and 100 < inner < border < 3000


def test_inner_cells_are_compact_and_thin_polygons_cost_their_length():
    square = [[np.array(rectangle(144.0, -38.5, 145.5, -37.0)[:-1])]]
    _, table = settled(square, 4326, np.array([around(144.7, -37.7, 0.001, 9)[0]]), 7)
    levels = np.unique(table[table.edges.isna()].cell.to_numpy() >> 52 & 15)
    assert levels.min() < 6 and levels.max() == 7
    thin = [[np.array([[140.0, -40.0], [150.0, -30.0], [150.0, -29.9999], [140.0, -39.9999]])]]
    _, table = settled(thin, 4326, np.array([around(145, -35, 0.001, 9)[0]]), 7)
    assert len(table) < 5000  # its box holds 250,000 such cells


def test_no_half_globe():
    place = spaces.Sphere()
    wide = np.array([[0.0, -5], [120, -5], [240, -5]])
    with pytest.raises(SupportError, match="85 degrees"):
        first([[wide]], place, 3)


def _table(spark, rings):
    return spark.createDataFrame([(f"p{i}", [[[*r.tolist(), r[0].tolist()]]]) for i, r in enumerate(rings)], f"id string, geometry {GEOMETRY}")


def _text(cells):
    return [(f"{c:x}",) for c in cells.tolist()]


@pytest.mark.parametrize(("lng", "lat", "crs"), [(145.0, -37.8, 4326), (179.95, 12.0, 4326), (145.0, -37.8, 3857)])
def test_nearest_as_one_by_one(spark, lng, lat, crs):
    rng = np.random.default_rng(7)
    spots = [(lng + dx, lat + dy) for dx in (-4, -1.5, 0, 0.7, 3) for dy in (-2, 0, 1.1)]
    rings = [star(rng, x, y, 0.15, 8) for x, y in spots]
    if crs == 4326:
        rings = [np.stack([(r[:, 0] + 180) % 360 - 180, r[:, 1]], 1) for r in rings]
    shapes = [[[from_lng_lat(r, crs)]] for r in rings]
    cells = np.concatenate([around(lng + 0.4, lat + 0.3, 0.5, 5), around(lng - 2.5, lat + 4, 0.3, 5), around(lng + 30, lat - 10, 0.1, 5)])
    polygons = _table(spark, [s[0][0] for s in shapes])
    out = assign(spark.createDataFrame(_text(cells), "h3 string"), polygons, "id", outside="nearest", crs=crs, validate=False)
    rows = {int(r.h3, 16): r for r in out.collect()}
    assert len(rows) == len(cells)
    y, x = grid.centres(cells)
    seen = 0
    for c, a, b in zip(cells.tolist(), x, y, strict=True):
        if rows[c].assignment_method == "nearest":
            to = azimuthal(a, b) if crs == 4326 else lambda p: p
            at = np.zeros((1, 2)) if crs == 4326 else from_lng_lat(np.array([[a, b]]), crs)
            far = [planar.distance(planar.mapped(s, to), at)[0] for s in shapes]
            assert abs(rows[c].assignment_distance / min(far) - 1) < 1e-3 and far[int(rows[c].polygon_id[1:])] <= min(far) * (1 + 1e-3)
            if min(far) < 50_000:
                assert rows[c].polygon_id == f"p{int(np.argmin(far))}" and abs(rows[c].assignment_distance / min(far) - 1) < 1e-6
            seen += 1
    assert seen > 30


def test_equally_near_polygons_are_ambiguous(spark):
    left, right = (np.array(rectangle(x, 1_000_000.0, x + 1000, 1_001_000.0)[:-1]) for x in (-3000.0, 2000.0))
    cell = grid.cells([float(np.degrees(np.arctan(np.sinh(1_000_500 / 6378137.0))))], [0.0], 9)
    y, x = grid.centres(cell)
    shift = from_lng_lat(np.stack([x, y], 1), 3857)[0, 0]
    polygons = _table(spark, [left + [shift, 0], right + [shift, 0]])
    row = assign(spark.createDataFrame(_text(cell), "h3 string"), polygons, "id", outside="nearest", crs=3857).first()
    assert (row.assignment_method, row.polygon_id, row.candidate_n, row.assignment_distance) == ("ambiguous", None, 2, None)


def test_polygon_over_the_antimeridian_and_around_a_pole(spark):
    polygons = spark.createDataFrame([("a", [[rectangle(179.5, -1.0, -179.5, 1.0)]]), ("p", [[[[0.0, 85.0], [90.0, 85.0], [180.0, 85.0], [-90.0, 85.0], [0.0, 85.0]]]])], f"id string, geometry {GEOMETRY}")
    inside = grid.cells([0.0, 0.5, 90.0, 88.0], [180.0, -179.9, 0.0, 123.0], 5)
    beside = grid.cells([0.0, 0.0, 84.0], [178.0, 0.0, 50.0], 5)
    table = spark.createDataFrame(_text(np.concatenate([inside, beside])), "h3 string")
    found = {(int(r.h3, 16), r.polygon_id) for r in membership(table, polygons, "id", validate=False).collect()}
    assert found == {(int(c), p) for c, p in zip(inside, "aapp", strict=True)}


def test_many_small_polygons_in_one_coarse_cell(spark):
    """10^5 squares below a cell of resolution 3, and cells of two resolutions: the square around each centre is known."""
    n, pitch = 316, 0.004
    numbers = spark.range(n * n)
    west, south = 144.0 + (F.col("id") % n) * pitch, -38.5 + F.floor(F.col("id") / n) * pitch
    e, t = west + pitch * 0.9, south + pitch * 0.9
    corner = lambda x, y: F.array(x, y)
    ring = F.array(corner(west, south), corner(e, south), corner(e, t), corner(west, t), corner(west, south))
    polygons = numbers.select(F.col("id").alias("name"), F.array(F.array(ring)).alias("geometry"))
    cells = np.concatenate([around(144.5, -38.0, 0.02, 9), around(144.9, -37.7, 0.01, 10)])
    out = membership(spark.createDataFrame(_text(cells), "h3 string"), polygons, "name", validate=False).toPandas()
    y, x = grid.centres(cells)
    i, j = np.floor((x - 144.0) / pitch).astype(int), np.floor((y + 38.5) / pitch).astype(int)
    there = ((x - 144.0) / pitch - i < 0.9) & ((y + 38.5) / pitch - j < 0.9)
    pairs = set(zip(out.h3, out.polygon_id, strict=True))
    assert {(f"{c:x}", int(b * n + a)) for c, a, b, k in zip(cells.tolist(), i, j, there, strict=True) if k} <= pairs
    assert set(out.h3) == {f"{c:x}" for c in cells.tolist()}


def test_index_rows(spark):
    table = numbered(spark.createDataFrame([([[rectangle(144.0, -38.0, 144.5, -37.5)]],)], f"geometry {GEOMETRY}"))
    rows = indexing.index(table, 4326, 7)
    assert rows.filter("edges IS NULL AND NOT inside").isEmpty() and rows.filter(F.col("edges").isNotNull() & (bits.resolution(F.col("cell")) != 7)).isEmpty()
    assert rows.groupBy("poly", "cell").count().filter("count > 1").isEmpty()
    assert indexing.index(table.limit(0), 4326, 7).isEmpty()
    assert expand(rows.filter("edges IS NULL").select(bits.to_text(F.col("cell")).alias("h3")), 0, validate=False).count() > 0
