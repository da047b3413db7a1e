"""Map tiles of cells: what is drawn where, and on odd input."""

from __future__ import annotations

import re

import numpy as np
import pytest

from hexsupport.functions import grid
from hexsupport.operators.cells import SupportError
from hexsupport.operators.tiles import tiles


def _cells(spark, lat, lng, res):
    return spark.createDataFrame([(f"{c:x}",) for c in np.unique(grid.cells(np.array(lat, float), np.array(lng, float), res))], "h3 string")


def test_many_cells_of_one_pixel_are_one_shape(spark):
    rng = np.random.default_rng(1)
    cells = _cells(spark, 10.5 + rng.random(300) * 1e-3, 20.5 + rng.random(300) * 1e-3, 13)
    assert cells.count() > 100
    out = {r.z: r for r in tiles(cells.union(cells), 3, 5).collect()}
    assert sorted(out) == [3, 4, 5] and all(r.shapes == 1 for r in out.values())
    z = 5
    x, y = (20.5 + 180) / 360 * 2**z, (0.5 - np.log(np.tan(np.pi / 4 + np.radians(10.5) / 2)) / (2 * np.pi)) * 2**z
    assert (out[z].x, out[z].y) == (int(x), int(y))
    i, j = map(int, re.search(r'd="M(\d+),(\d+)h1v1h-1Z"', out[z].svg).groups())
    assert abs(i - x % 1 * 256) < 2 and abs(j - y % 1 * 256) < 2


def test_a_cell_over_tiles_has_its_corners_in_each(spark):
    cells = _cells(spark, [0.01], [0.01], 3)
    out = tiles(cells, 8, 8).collect()
    assert len(out) > 1 and all(r.shapes == 1 for r in out)
    places = {tuple(sorted((round(r.x * 256 + float(a), 1), round(r.y * 256 + float(b), 1)) for a, b in re.findall(r"[ML](-?[\d.]+),(-?[\d.]+)", r.svg))) for r in out}
    (corners,) = places
    assert len(corners) >= 6
    xs, ys = zip(*corners, strict=True)
    assert {(r.x, r.y) for r in out} == {(x, y) for x in range(int(min(xs) // 256), int(max(xs) // 256) + 1) for y in range(int(min(ys) // 256), int(max(ys) // 256) + 1)}


def test_both_ends_of_the_antimeridian(spark):
    out = tiles(_cells(spark, [5.0], [179.999], 2), 6, 6).collect()
    columns = {r.x for r in out}
    assert {0, 63} <= columns and columns <= {0, 1, 2, 61, 62, 63}


def test_poles_and_odd_arguments(spark):
    cells = _cells(spark, [89.999, -89.999], [0.0, 10.0], 6)
    assert all(0 <= r.x < 2**r.z and 0 <= r.y < 2**r.z for r in tiles(cells, 0, 6).collect())
    assert tiles(cells.limit(0), 0, 1, validate=False).count() == 0
    for call in (lambda: tiles(cells, 3, 2), lambda: tiles(cells, -1, 2), lambda: tiles(cells, 0, 1, style='"'), lambda: tiles(cells.limit(0), 0, 1)):
        with pytest.raises(SupportError):
            call()
