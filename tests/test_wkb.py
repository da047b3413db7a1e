"""Well-known binary: written examples, round trips, broken bytes."""

from __future__ import annotations

import struct

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from hexsupport.operators.cover import cover
from hexsupport.sources import wkb
from hexsupport.sources.fixtures import FEATURES, TOY, toy_features, toy_polygons

POINT = st.tuples(st.floats(allow_nan=False), st.floats(allow_nan=False)).map(list)
SHAPES = st.lists(st.lists(st.lists(POINT, max_size=6), min_size=1, max_size=3), max_size=4)


@settings(max_examples=150, deadline=None)
@given(SHAPES, st.sampled_from([None, 4326, 32755]))
def test_round_trip(shape, srid):
    assert wkb.decoded(wkb.encoded(shape, srid)) == shape


@pytest.mark.parametrize("shape", [*TOY.values(), *FEATURES.values()])
def test_fixtures(shape):
    assert wkb.decoded(wkb.encoded(shape)) == shape


def test_written_examples():
    ring = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 0.0)]
    flat = [[[list(p) for p in ring]]]
    big = struct.pack(">BIII", 0, 3, 1, 4) + b"".join(struct.pack(">dd", *p) for p in ring)
    assert wkb.decoded(big) == flat
    for code in (0x80000003, 1003):
        assert wkb.decoded(struct.pack("<BIII", 1, code, 1, 4) + b"".join(struct.pack("<ddd", *p, 7.0) for p in ring)) == flat
    assert wkb.decoded(struct.pack("<BIII", 1, 3003, 1, 4) + b"".join(struct.pack("<dddd", *p, 7.0, 8.0) for p in ring)) == flat
    mixed = struct.pack(">BII", 0, 6, 2) + big + wkb.encoded(flat)  # each part in its own byte order
    assert wkb.decoded(mixed) == flat * 2
    assert wkb.encoded(flat, 4326)[:9] == bytes.fromhex("0103000020e6100000") and wkb.decoded(wkb.encoded([])) == []


def test_broken_bytes():
    good = wkb.encoded(TOY["regular"])
    for bad, message in ((b"", "not well-known"), (b"\x07", "not well-known"), (good[:-1], "buffer|early"), (good[:7], "early"), (good + b"x", "left over"), (struct.pack("<BIdd", 1, 1, 0, 0), "kind 1")):
        with pytest.raises(ValueError, match=message):
            wkb.decoded(bad)


def test_columns(spark):
    toy = toy_polygons(spark)
    binary = wkb.to_wkb(toy, target="shape").drop("geometry")
    assert dict(binary.dtypes)["shape"] == "binary"
    back = wkb.from_wkb(binary, "shape")
    assert {r.geometry_id: r.geometry for r in back.collect()} == {r.geometry_id: r.geometry for r in toy.collect()}
    assert {r.h3 for r in cover(back, 7).collect()} == {r.h3 for r in cover(toy, 7).collect()}
    odd = spark.createDataFrame([(1, None), (2, bytearray(wkb.encoded([])))], "GEOMETRY int, wkb binary")
    assert [r.geometry for r in wkb.from_wkb(odd).orderBy("wkb").collect()] == [None, []] and wkb.from_wkb(odd).columns == ["wkb", "geometry"]
    assert wkb.to_wkb(toy_features(spark).limit(0)).isEmpty()
