"""Validity and overlapping interiors: against plain rules, in bounded memory."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from hexsupport.functions import planar
from hexsupport.operators.cells import SupportError
from hexsupport.operators.relate import check_topology, overlapping_pairs
from hexsupport.sources.fixtures import GEOMETRY, rectangle, toy_features


def _plain_crossing(p, q, r, s, proper):
    return any(planar._cross_at(p[i], q[i], r[j], s[j], proper) for i in range(len(p)) for j in range(len(r)))


@pytest.mark.parametrize("proper", [True, False])
def test_crossing_edges_are_found_by_halving(monkeypatch, proper):
    rng = np.random.default_rng(1)
    monkeypatch.setattr(planar, "LEAF", 3)
    for turn in range(120):
        n, size = rng.integers(4, 40), rng.choice([0.02, 0.1, 1.0])
        p = rng.random((n, 2)) if turn % 2 else rng.integers(0, 12, (n, 2)) / 12
        q = p + (rng.uniform(-size, size, (n, 2)) if turn % 2 else rng.integers(-1, 2, (n, 2)) / 12)
        k = n // 2
        assert planar.crossing((p[:k], q[:k]), (p[k:], q[k:]), proper) == _plain_crossing(p[:k], q[:k], p[k:], q[k:], proper)


def test_points_inside_by_bands():
    rng = np.random.default_rng(3)
    turn = np.sort(rng.random(3000)) * 2 * np.pi
    shape = [[np.stack([np.cos(turn), np.sin(turn)], 1) * rng.uniform(0.5, 1, 3000)[:, None]]]
    points = rng.uniform(-1, 1, (4000, 2))
    p, q = planar.edges(shape)
    assert (planar.inside(shape, points) == planar._odd(p, q, points)).all()
    d = planar.distance(shape, points[:300])
    assert np.allclose(d, [planar.distance(shape, x[None])[0] for x in points[:300]])


def test_validity_of_many_corners():
    """200,000 corners: a matrix of all pairs of edges would take 320 GB."""
    t = np.linspace(0, 2 * np.pi, 200_000, endpoint=False)
    ring = np.stack([np.cos(t), np.sin(t)], 1) * (1 + 0.1 * np.sin(400 * t))[:, None]
    assert planar.faults([[ring, ring[::10][::-1] * 0.5]]) is None
    bad = ring.copy()
    bad[[70_000, 70_001]] = bad[[70_001, 70_000]]
    assert planar.faults([[bad]]) == "self-intersection"
    assert planar.faults([[ring, ring[::10] * 0.5 + [2.0, 0]]]) == "hole outside its shell"


def _rows(spark, geometries):
    return spark.createDataFrame(list(geometries.items()), f"name string, geometry {GEOMETRY}").repartition(3)


def _found(spark, geometries, crs=4326):
    return {(r.a, r.b) for r in overlapping_pairs(_rows(spark, geometries), crs, "name").collect()}


@pytest.mark.parametrize(("east", "north", "unit", "crs"), [(16_100_000.0, -4_600_000.0, 1000.0, 3857), (2_500_000.0, 2_400_000.0, 250.0, 7899)])
def test_rectangles_on_a_lattice_as_by_rule(spark, east, north, unit, crs):
    """Shared edges, shared corners, equal outlines, and one within another, all by whole numbers, in planes: on the sphere edges along a parallel differ with their length."""
    rng = np.random.default_rng(5)
    boxes = [(x, y, x + w, y + h) for x, y, w, h in zip(rng.integers(0, 14, 30), rng.integers(0, 14, 30), rng.integers(1, 5, 30), rng.integers(1, 5, 30), strict=True)]
    boxes += [boxes[0], (0, 0, 20, 1), (-3, -3, 30, 30), (30, 0, 31, 30), (20, 30, 22, 31)]
    want = {(f"{i:02}", f"{j:02}") for i, a in enumerate(boxes) for j, b in enumerate(boxes) if i < j and max(a[0], b[0]) < min(a[2], b[2]) and max(a[1], b[1]) < min(a[3], b[3])}
    shapes = {f"{i:02}": [[rectangle(*(o + unit * float(v) for o, v in zip((east, north, east, north), b, strict=True)))]] for i, b in enumerate(boxes)}
    assert _found(spark, shapes, crs) == want


def test_odd_neighbours(spark):
    square = rectangle(144.0, -38.0, 144.4, -37.6)
    hole = rectangle(144.1, -37.9, 144.3, -37.7)[::-1]
    shapes = {
        "with hole": [[square, hole]], "filling": [[rectangle(144.1, -37.9, 144.3, -37.7)]], "in the hole": [[rectangle(144.15, -37.85, 144.2, -37.8)]],
        "two parts": [[rectangle(145.0, -38.0, 145.1, -37.9)], [rectangle(144.35, -37.65, 144.5, -37.5)]], "apart": [[rectangle(150.0, -38.0, 150.1, -37.9)]],
        "wedge": [[[[144.4, -38.0], [144.6, -38.0], [144.4, -37.8], [144.4, -38.0]]]],
    }
    assert _found(spark, shapes) == {("two parts", "with hole"), ("filling", "in the hole")}
    assert overlapping_pairs(toy_features(spark)).isEmpty()


def test_edges_through_corners(spark):
    """A diagonal that enters another square just at its corner, and one that only touches it there, in a plane."""
    x, y = 16_100_000.0, -4_600_000.0
    tri = lambda *p: [[[[x + 100.0 * a, y + 100.0 * b] for a, b in (*p, p[0])]]]
    shapes = {"a square": tri((0, 0), (4, 0), (4, 4), (0, 4)), "b in": tri((-4, -4), (4, 4), (-4, 4)), "c by": tri((4, 4), (8, 0), (8, 8)), "d along": tri((4, 0), (8, 0), (4, 2))}
    assert _found(spark, shapes, 3857) == {("a square", "b in")}


def test_overlaps_at_the_antimeridian(spark):
    shapes = {"a": [[rectangle(179.0, 0.0, -179.0, 1.0)]], "b": [[rectangle(-179.5, 0.5, -178.0, 2.0)]], "c": [[rectangle(-179.0, -1.0, -178.0, 0.4)]]}
    assert _found(spark, shapes) == {("a", "b")}


def test_many_small_polygons_beside_a_long_outline(spark):
    """6,400 squares below one coarse cell within a ring of 20,000 corners: no overlap; then one square more across others."""
    n, pitch = 80, 0.004
    west, south = 144.0 + (F.col("id") % n) * pitch, -38.5 + F.floor(F.col("id") / n) * pitch
    corner = lambda x, y: F.array(x, y)
    ring = F.array(corner(west, south), corner(west + pitch, south), corner(west + pitch, south + pitch), corner(west, south + pitch), corner(west, south))
    small = spark.range(n * n).select(F.col("id").cast("string").alias("name"), F.array(F.array(ring)).alias("geometry"))
    t = np.linspace(0, 2 * np.pi, 20_000, endpoint=False)
    outer, inner = (np.stack([144.4 + r * np.cos(t), -38.1 + r * np.sin(t)], 1) for r in (0.9, 0.8))
    around = spark.createDataFrame([("around", [[[*outer.tolist(), outer[0].tolist()], [*inner[::-1].tolist(), inner[-1].tolist()]]])], small.schema)
    assert overlapping_pairs(small.unionByName(around)).isEmpty()
    more = spark.createDataFrame([("more", [[rectangle(144.001, -38.499, 144.005, -38.497)]])], small.schema)
    found = {(r.a, r.b) for r in overlapping_pairs(small.unionByName(more), 4326, "name").collect()}
    assert found == {("0", "more"), ("1", "more")}
    with pytest.raises(SupportError, match="2 pairs"):
        check_topology(small.unionByName(more))
