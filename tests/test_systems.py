"""Reference systems from projection strings: against published worked examples, and back again."""

from __future__ import annotations

import numpy as np
import pytest

from hexsupport.functions import planar
from hexsupport.functions.project import from_lng_lat, supported, to_lng_lat
from hexsupport.functions.systems import System
from hexsupport.operators.cells import SupportError
from hexsupport.operators.cover import cover
from hexsupport.operators.relate import assign, membership
from hexsupport.sources.fixtures import FEATURES, GEOMETRY, rectangle, toy_features

#: Worked examples of the guidance note and of Snyder (1987): string, longitude, latitude, x, y, tolerance.
EXAMPLES = [
    ("+proj=aea +lat_1=29.5 +lat_2=45.5 +lat_0=23 +lon_0=-96 +ellps=clrk66", -75, 35, 1885472.7, 1535925.0, 0.1),
    ("+proj=laea +lat_0=40 +lon_0=-100 +ellps=clrk66", -110, 30, -965932.1, -1056814.9, 0.1),
    ("+proj=laea +lat_0=52 +lon_0=10 +x_0=4321000 +y_0=3210000 +ellps=GRS80", 5, 50, 3962799.45, 2999718.85, 0.01),
    ("+proj=stere +lat_0=90 +lon_0=0 +k_0=0.994 +x_0=2000000 +y_0=2000000 +ellps=WGS84", 44, 73, 3320416.75, 632668.43, 0.01),
    ("+proj=stere +lat_0=-90 +lat_ts=-71 +lon_0=70 +x_0=6000000 +y_0=6000000 +ellps=WGS84", 120, -75, 7255380.79, 7053389.56, 0.01),
    ("+proj=lcc +lat_1=28.383333333333333 +lat_2=30.283333333333333 +lat_0=27.833333333333333 +lon_0=-99 +x_0=609601.2192024384 +y_0=0 +ellps=clrk66 +units=us-ft", -96, 28.5, 2963503.91, 254759.80, 0.02),
    ("+proj=lcc +lat_1=18 +lat_0=18 +lon_0=-77 +k_0=1 +x_0=250000 +y_0=150000 +ellps=clrk66", -(76 + 56 / 60 + 37.26 / 3600), 17 + 55 / 60 + 55.80 / 3600, 255966.58, 142493.51, 0.01),
    ("+proj=tmerc +lat_0=49 +lon_0=-2 +k=0.9996012717 +x_0=400000 +y_0=-100000 +ellps=airy", 0.5, 50.5, 577274.99, 69740.50, 0.01),
]


@pytest.mark.parametrize("example", EXAMPLES, ids=[e[0].split()[0][6:] + str(i) for i, e in enumerate(EXAMPLES)])
def test_worked_examples(example):
    text, lng, lat, x, y, close = example
    at = from_lng_lat(np.array([[lng, lat]]), text)
    assert np.allclose(at, [[x, y]], rtol=0, atol=close)
    assert np.allclose(to_lng_lat(at, text), [[lng, lat]], atol=1e-9)


@pytest.mark.parametrize(
    "text",
    [
        "+proj=longlat +ellps=bessel +towgs84=598.1,73.7,418.2,0.202,0.045,-2.455,6.7", "+proj=aeqd +lat_0=-37.8 +lon_0=145 +datum=WGS84 +units=m +no_defs", "+proj=utm +zone=55 +south", "+proj=laea +lat_0=-90 +lon_0=10",
        "+proj=merc +lat_ts=40 +lon_0=100", "+proj=aea +lat_1=-18 +lat_2=-36 +lon_0=132 +ellps=GRS80", "+proj=stere +lat_0=-90 +lat_ts=-71", "+proj=tmerc +lat_0=-30 +lon_0=140 +R=6371000", "+proj=lcc +lat_1=-36 +lat_2=-38 +lat_0=-37 +lon_0=145 +x_0=2500000 +y_0=2500000 +ellps=GRS80 +units=km",
    ],
)
def test_there_and_back(text):
    rng = np.random.default_rng(1)
    points = np.stack([rng.uniform(138, 152, 200), rng.uniform(-50, -25, 200)], 1)
    assert np.allclose(to_lng_lat(from_lng_lat(points, text), text), points, atol=1e-8)


def test_agrees_with_the_numbered_systems():
    points = np.array([[144.9, -37.8], [147.0, -36.1]])
    assert np.allclose(from_lng_lat(points, "+proj=utm +zone=55 +south +datum=WGS84"), from_lng_lat(points, 32755), atol=1e-3)
    assert np.allclose(from_lng_lat(points, "+proj=lcc +lat_1=-36 +lat_2=-38 +lat_0=-37 +lon_0=145 +x_0=2500000 +y_0=2500000 +ellps=GRS80"), from_lng_lat(points, 7899), atol=1e-6)
    assert np.allclose(from_lng_lat(points, "+proj=merc +R=6378137"), from_lng_lat(points, 3857), atol=1e-6)


def test_datum_shift_of_the_guidance_note():
    """WGS72 to WGS84 by seven parameters, as published: 55 N, 4 E."""
    shifted = System("+proj=longlat +a=6378135 +rf=298.26 +towgs84=0,0,4.5,0,0,0.554,0.219").inverse(np.array([[4.0, 55.0]]))
    assert np.allclose(shifted, [[4 + 0.554 / 3600, 55 + 0.09 / 3600]], atol=0.005 / 3600)


def test_strings_that_say_too_little():
    for text in ("+proj=robin", "+proj=laea +ellps=none", "+proj=stere +lat_0=45", "+proj=utm +zone=61", "+proj=lcc +lat_1=x", "+proj=merc +towgs84=1,2", "+proj=merc +units=ell", "nothing"):
        assert not supported(text)
        with pytest.raises(ValueError):
            System(text)


@pytest.mark.parametrize("text", ["+proj=aeqd +lat_0=-37.8 +lon_0=145 +datum=WGS84 +units=m", "+proj=laea +lat_0=-38 +lon_0=144", "+proj=aea +lat_1=-36 +lat_2=-39 +lon_0=145 +units=us-ft"])
def test_features_in_any_system(spark, text):
    """The same features in an equidistant or equal-area plane meet the same cells."""
    moved = spark.createDataFrame([(i, [[from_lng_lat(np.array(r), text).tolist() for r in p] for p in g]) for i, g in FEATURES.items()], f"feature_id string, geometry {GEOMETRY}")
    cells = cover(toy_features(spark), 7)
    assert {r.h3 for r in cover(moved, 7, crs=text).collect()} == {r.h3 for r in cells.collect()}
    pairs = {tuple(r) for r in membership(cells, toy_features(spark), "feature_id").collect()}
    assert {tuple(r) for r in membership(cells, moved, "feature_id", crs=text).collect()} == pairs
    own = {(r.h3, r.polygon_id, r.assignment_method) for r in assign(cells, moved, "feature_id", crs=text).collect()}
    assert own == {(r.h3, r.polygon_id, r.assignment_method) for r in assign(cells, toy_features(spark), "feature_id").collect()}


def test_a_polygon_around_the_pole_in_its_plane(spark):
    text = "+proj=stere +lat_0=90 +lon_0=0 +k_0=0.994 +x_0=2000000 +y_0=2000000"
    square = spark.createDataFrame([("p", [[rectangle(1_800_000.0, 1_800_000.0, 2_200_000.0, 2_200_000.0)]])], f"id string, geometry {GEOMETRY}")
    cells = spark.createDataFrame([("8009fffffffffff",), ("8001fffffffffff",), ("8003fffffffffff",)], "h3 string")
    found = {r.h3 for r in membership(cells, square, "id", crs=text).collect()}
    assert found and found <= {"8001fffffffffff", "8003fffffffffff"}
    with pytest.raises(SupportError, match="projection string"):
        membership(cells, square, "id", crs="+proj=robin")
    assert planar.faults([[np.array(rectangle(0, 0, 1, 1)[:-1], float)]]) is None
