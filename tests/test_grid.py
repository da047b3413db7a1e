from __future__ import annotations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from hexsupport.functions import grid, planar
from hexsupport.functions.bits import PENTAGONS


def _levels(top: int):
    cell = grid.roots()
    for res in range(top + 1):
        yield res, cell
        cell = grid.children(cell)


def test_numbers_of_cells_and_round_trips_everywhere():
    for res, cell in _levels(3):
        assert len(cell) == 2 + 120 * 7**res
        lat, lng = grid.centres(cell)
        assert (grid.cells(lat, lng, res) == cell).all()


def test_neighbours_are_mutual_six_or_five():
    for _, cell in _levels(2):
        own, beside = grid.neighbours(cell)
        count = np.bincount(own)
        assert (count == 5).sum() == 12 and (count == 6).sum() == len(cell) - 12
        pairs = set(zip(cell[own].tolist(), beside.tolist(), strict=True))
        assert all((b, a) in pairs for a, b in pairs)


def test_known_places():
    lat, lng = grid.centres(np.array([0x8928308280FFFFF]))
    assert abs(lat[0] - 37.7767) < 1e-4 and abs(lng[0] + 122.4185) < 1e-4
    assert hex(grid.cells([-37.90177681], [144.89773077], 8)[0]) == "0x88be631825fffff"


@settings(max_examples=60, deadline=None)
@given(st.floats(-89.5, 89.5), st.floats(-180, 180), st.integers(0, 15))
def test_a_place_lies_near_its_cell(lat, lng, res):
    cell = grid.cells([lat], [lng], res)
    a, b = grid.centres(cell)
    x, y = grid.to_xyz(np.radians([lat]), np.radians([lng])), grid.to_xyz(np.radians(a), np.radians(b))
    assert np.linalg.norm(x - y) * 6371 <= 1.1 * 1281.256 / np.sqrt(7.0) ** res + 1e-6
    assert (grid.cells(a, b, res) == cell).all()


def test_pentagons_have_five_corners():
    cell = grid.roots()
    assert set(np.flatnonzero(grid.boundaries(cell)[2] == 5)) == set(PENTAGONS)


def test_union_area_counts_overlap_once_and_holes_not_at_all():
    square = lambda x, y, s: np.array([[x, y], [x + s, y], [x + s, y + s], [x, y + s]], float)
    assert planar.union_area([[square(0, 0, 2)], [square(1, 1, 2)]]) == pytest.approx(7)
    assert planar.union_area([[square(0, 0, 4), square(1, 1, 2)]]) == pytest.approx(12)
    assert planar.union_area([]) == 0


def test_topology_of_abutting_nested_and_overlapping_shapes():
    square = lambda x, y, s: np.array([[x, y], [x + s, y], [x + s, y + s], [x, y + s]], float)
    a, beside = [[square(0, 0, 2)]], [[square(2, 0, 2)]]
    ring, filling = [[square(0, 0, 4), square(1, 1, 2)]], [[square(1, 1, 2)]]
    assert planar.meet(a, beside) and planar.meet(ring, filling)  # overlaps: tests/test_topology.py
    assert planar.faults([[np.array([[0, 0], [2, 2], [2, 0], [0, 1]], float)]]) == "self-intersection"


def test_outlines_have_points_on_the_edges_of_the_icosahedron():
    """Pentagons of odd resolutions have ten points; further points lie half way between two faces, each on two cells; those of even resolutions have none."""
    cell, kinds = grid.roots(), {}
    for res in range(4):
        cell = grid.children(cell) if res else cell
        lat, lng, n = grid.outlines(cell)
        plain_lat, plain_lng, corners = grid.boundaries(cell)
        kinds[res] = {k: int((n == k).sum()) for k in np.unique(n).tolist()}
        if res % 2 == 0:
            assert (n == corners).all()
            continue
        xyz, plain = (grid.to_xyz(np.radians(a), np.radians(b)) for a, b in ((lat, lng), (plain_lat, plain_lng)))
        times: dict[tuple, int] = {}
        for own, k, ends, m in zip(xyz, n, plain, corners, strict=True):
            for point in own[:k]:
                if not (np.abs(ends[:m] - point).max(axis=1) < 1e-12).any():
                    near = np.sort(grid.layout().centre @ point)[::-1]
                    assert abs(near[0] - near[1]) < 1e-9 and near[1] - near[2] > 1e-6
                    key = tuple(np.round(point, 8).tolist())
                    times[key] = times.get(key, 0) + 1
        assert set(times.values()) == {2}
    assert kinds[1][10] == kinds[3][10] == 12 and kinds[0] == {5: 12, 6: 110} and set(kinds[1]) == {6, 7, 8, 10}


def test_corners_of_pentagons_differ():
    for res in range(4):
        cell = np.array([(1 << 59) | (res << 52) | (b << 45) | ((1 << 3 * (15 - res)) - 1) for b in PENTAGONS])
        lat, lng, n = grid.boundaries(cell)
        xyz = grid.to_xyz(np.radians(lat), np.radians(lng))
        assert (n == 5).all()
        for own in xyz:
            d = np.sort([np.linalg.norm(own[k] - own[(k + 1) % 5]) for k in range(5)])
            assert d[0] > 0.9 * d[-1]
