from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from hexsupport.functions import bits, grid, planar
from hexsupport.functions.project import from_lng_lat, gnomonic, to_lng_lat
from hexsupport.operators.audit import audit
from hexsupport.operators.cells import SupportError
from hexsupport.operators.compact import compact, expanded, ownership
from hexsupport.operators.cover import cover, expand
from hexsupport.operators.polygons import cell_rings
from hexsupport.operators.relate import assign, membership
from hexsupport.operators.render import boundaries, svg
from hexsupport.operators.rollup import rollup
from hexsupport.sources import geojson
from hexsupport.sources.fixtures import GEOMETRY, rectangle, toy_features, toy_polygons
from hexsupport.streaming import rollup as stream_rollup


@pytest.fixture(scope="module")
def fine(spark):
    """The cells of the complex toy shape at resolution 9."""
    return cover(toy_polygons(spark).filter("geometry_id = 'complex'"), 9).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "h3 string")


def _set(df):
    return {r[0] for r in df.collect()}


def test_compaction_goldens(fine):
    kept = compact(fine, 7)
    found = audit(fine, kept)
    row = found.summary.first()
    assert (row.source_cell_n, row.compact_cell_n, row.exact_source_n, row.ancestor_source_n) == (1285, 235, 165, 1120)
    assert row.exact_reconstruction and row.hierarchy_integrity and row.ownership_integrity
    assert [(r[0], r[1]) for r in found.resolution.collect()] == [(7, 15), (8, 55), (9, 165)]
    assert {(r.compact_resolution, r.source_cell_n) for r in found.ownership.collect()} == {(7, 735), (8, 385), (9, 165)}
    assert _set(expanded(kept, 9)) == _set(fine)


def test_floor_is_monotonic(fine):
    sizes = [compact(fine, p).count() for p in (9, 8, 7, 6)]
    assert sizes == sorted(sizes, reverse=True) and sizes[0] == 1285


def test_unsorted_repeated_and_upper_case_cells_count_once(spark, fine):
    twice = fine.select(F.upper("h3").alias("h3")).unionByName(fine)
    assert _set(compact(twice, 7)) == _set(compact(fine, 7))


def test_empty_sets(spark, empty):
    assert compact(empty).count() == 0 and expand(empty, 2).count() == 0
    for call in (lambda: ownership(empty, empty), lambda: audit(empty, empty), lambda: membership(empty, toy_features(spark), "feature_id"), lambda: boundaries(empty)):
        with pytest.raises(SupportError, match="at least one"):
            call()


@pytest.mark.parametrize(("values", "message"), [(["not_an_h3_cell"], "invalid H3 indexes"), ([None], "missing or empty"), ([""], "missing or empty"), (["88be631825fffff", "89be63182c3ffff"], "single source resolution")])
def test_bad_cells(spark, values, message):
    with pytest.raises(SupportError, match=message):
        compact(spark.createDataFrame([(v,) for v in values], "h3 string"))


def test_bad_arguments(spark, fine):
    toy = toy_polygons(spark)
    for call, message in (
        (lambda: expand(fine, -1), "non-negative integer"), (lambda: expand(fine, 1.5), "non-negative integer"), (lambda: cover(toy, 16), "between 0 and 15"), (lambda: cover(toy, 7, "near"), "boundary"),
        (lambda: cover(toy, 7, "overlap"), "min_overlap"), (lambda: cover(toy, 7, "center", 0.5), "only used"), (lambda: compact(fine, 10), "between 0 and 9"), (lambda: cover(toy, 7, crs=None), "defined coordinate reference system"),
        (lambda: cover(toy.drop("geometry"), 7), "POLYGON or MULTIPOLYGON"), (lambda: membership(fine, toy, "name"), "not found"), (lambda: assign(fine, toy_features(spark), "feature_id", ["x"]), "Unknown polygon attributes"),
        (lambda: assign(fine, toy_features(spark), "feature_id", ["geometry"]), "geometry"), (lambda: assign(fine, toy_features(spark), "feature_id", outside="far"), "outside"),
    ):
        with pytest.raises(SupportError, match=message):
            call()


def test_ownership_errors(spark, fine):
    with pytest.raises(SupportError, match="finer than"):
        ownership(compact(fine, 8).filter(F.length("h3") > 0).limit(0).unionByName(spark.createDataFrame([("88be631825fffff",)], "h3 string")), fine)
    with pytest.raises(SupportError, match="ownership is incomplete"):
        ownership(fine, compact(fine, 7).limit(10))


def _relation(fine):
    return ownership(fine, compact(fine, 7)).cache()


def test_rollup_conserves_and_sorts(spark, fine):
    relation = _relation(fine)
    cell = bits.to_long(F.col("h3"))
    data = fine.withColumn("events", F.lit(1)).withColumn("kind", F.element_at(F.array(F.lit("Zulu"), F.lit("Alpha"), F.lit("Beta")), (F.pmod(F.xxhash64("h3"), 3) + 1).cast("int"))).withColumn("half", F.when(cell % 2 == 0, 0.5))
    out = rollup(data, relation, sum=["events"], collapse=["kind", "half"]).collect()
    assert out[0].asDict().keys() >= {"compact_h3", "events", "kind", "kind_n", "half", "half_n"}
    assert sum(r.events for r in out) == 1285 and sum(r.source_cell_n for r in out) == 1285
    assert all(r.kind == "; ".join(sorted(r.kind.split("; "))) and r.kind_n == len(r.kind.split("; ")) for r in out)
    again = rollup(data.orderBy(F.desc("h3")), relation, sum=["events"], collapse=["kind", "half"]).collect()
    assert out == again


@pytest.mark.parametrize(
    ("change", "fields", "message"),
    [
        (lambda d: d, {}, "At least one field"), (lambda d: d, {"sum": ["no"]}, "not found"), (lambda d: d, {"sum": ["kind"]}, "numeric"), (lambda d: d.withColumn("n", F.lit(None).cast("int")), {"sum": ["n"]}, "Missing values"),
        (lambda d: d.unionByName(d.limit(1)), {"sum": ["events"]}, "Duplicate"), (lambda d: d.limit(9), {"sum": ["events"]}, "same authoritative source"), (lambda d: d.withColumn("source_cell", F.lit(1)), {"collapse": ["source_cell"]}, "overwrite existing"),
        (lambda d: d.withColumn("n", F.lit(float("nan"))), {"sum": ["n"]}, "Missing values"),
    ],
)
def test_rollup_errors(fine, change, fields, message):
    data = fine.withColumn("events", F.lit(1)).withColumn("kind", F.lit("a"))
    with pytest.raises(SupportError, match=message):
        rollup(change(data), _relation(fine), **fields)


def test_coverage_rules_contain_each_other(spark):
    toy = toy_polygons(spark)
    within, centre, meets = (_set(cover(toy, 8, rule)) for rule in ("within", "center", "intersects"))
    half, whole, sliver = (_set(cover(toy, 8, "overlap", k)) for k in (0.5, 1, 0.01))
    assert within < centre < meets and whole == within and within < half < sliver <= meets


def test_small_and_projected_polygons(spark):
    tiny = spark.createDataFrame([([[rectangle(144.95, -37.80, 144.952, -37.798)]],)], f"geometry {GEOMETRY}")
    assert cover(tiny, 8).count() == 0 and cover(tiny, 8, "within").count() == 0 and cover(tiny, 8, "intersects").count() >= 1
    ring = np.array(rectangle(144.90, -37.85, 145.00, -37.75))
    for crs in (3857, 7899):
        moved = from_lng_lat(ring, crs)
        assert np.allclose(to_lng_lat(moved, crs), ring)
        table = spark.createDataFrame([([[moved.tolist()]],)], f"geometry {GEOMETRY}")
        assert cover(table, 7, crs=crs).count() == 17


#: Shapes that are hard to cover.
HARD = {
    "sliver": [[rectangle(144.80, -37.80, 145.20, -37.7999)]],
    "tiny": [[rectangle(144.95, -37.80, 144.952, -37.798)]],
    "bay": [[[[144.80, -37.80], [145.00, -37.80], [145.00, -37.70], [144.98, -37.70], [144.98, -37.78], [144.82, -37.78], [144.82, -37.70], [144.80, -37.70], [144.80, -37.80]]]],
    "neck": [[[[144.80, -37.80], [144.90, -37.80], [144.90, -37.755], [145.00, -37.755], [145.00, -37.80], [145.10, -37.80], [145.10, -37.70], [145.00, -37.70], [145.00, -37.745], [144.90, -37.745], [144.90, -37.70], [144.80, -37.70], [144.80, -37.80]]]],
    "ring": [[rectangle(144.80, -37.80, 144.90, -37.70), rectangle(144.805, -37.795, 144.895, -37.705)[::-1]]],
    "parts": [[rectangle(144.80, -37.80, 144.84, -37.76)], [rectangle(144.90, -37.74, 144.94, -37.70)]],
}


@pytest.mark.parametrize("name", sorted(HARD))
def test_all_cells_that_meet_a_polygon_are_found(spark, name):
    """Against each cell around the polygon, tried alone, and against the cells of points in it."""
    shape = planar.shape_of(HARD[name])
    west, south, east, north = planar.box(shape)
    table = spark.createDataFrame([(HARD[name],)], f"geometry {GEOMETRY}")
    found = {int(h, 16) for h in _set(cover(table, 8, "intersects", exhaustive=True))}
    x, y = (v.ravel() for v in np.meshgrid(np.linspace(west, east, 400), np.linspace(south, north, 60)))
    within = planar.inside(shape, np.stack([x, y], 1))
    assert set(grid.cells(y[within], x[within], 8).tolist()) <= found
    wide = np.unique(grid.cells(*(v.ravel() for v in np.meshgrid(np.arange(south - 0.02, north + 0.02, 0.002), np.arange(west - 0.02, east + 0.02, 0.002))), 8))
    lat, lng = grid.centres(wide)
    meets = [c for c, ring, a, b in zip(wide.tolist(), cell_rings(wide), lng, lat, strict=True) if planar.meet([[gnomonic(a, b)(ring)]], planar.mapped(shape, gnomonic(a, b)))]
    assert found == set(meets)
    assert {int(h, 16) for h in _set(cover(table, 8, "overlap", 1e-9, exhaustive=True))} <= found


def test_many_rings(spark):
    one = spark.createDataFrame([("88be631825fffff",)], "h3 string")
    assert expand(one, 20).count() == 1 + 3 * 20 * 21
    assert _set(expand(expand(one, 2), 3)) == _set(expand(one, 5))


def test_zones_of_a_projected_grid(spark):
    place = np.array([[144.9631, -37.8136], [147.0, -10.0], [149.5, -60.0]])
    assert np.allclose(from_lng_lat(place[:1], 32755), [[320704.4, 5812911.7]], atol=0.1)
    assert np.allclose(to_lng_lat(from_lng_lat(place, 32755), 32755), place, atol=1e-9)
    moved = from_lng_lat(np.array(rectangle(144.90, -37.85, 145.00, -37.75)), 32755)
    assert cover(spark.createDataFrame([([[moved.tolist()]],)], f"geometry {GEOMETRY}"), 7, crs=32755).count() == 17


def test_expansion(spark, fine):
    one = fine.limit(1)
    assert expand(one, 0).count() == 1 and expand(one, 1).count() == 7 and expand(one, 2).count() == 19
    penta = spark.createDataFrame([("8009fffffffffff",)], "h3 string")
    assert expand(penta, 1).count() == 6


def test_overlapping_polygons_are_rejected(spark):
    rows = [("A", [[rectangle(144.90, -37.90, 145.02, -37.80)]]), ("B", [[rectangle(144.98, -37.90, 145.10, -37.80)]])]
    polys = spark.createDataFrame(rows, f"id string, geometry {GEOMETRY}")
    cells = cover(polys, 7)
    with pytest.raises(SupportError, match="overlapping interiors"):
        membership(cells, polys, "id")


def test_assignment_keeps_order_and_attributes(spark):
    features = toy_features(spark)
    cells = expand(cover(features, 7), 1)
    out = assign(cells, features, "feature_id", ["group_name", "feature_id"], "nearest").collect()
    back = assign(cells, features.orderBy(F.desc("feature_id")), "feature_id", ["group_name"], "nearest").collect()
    assert [r.h3 for r in out] == sorted(r.h3 for r in out)
    assert [(r.h3, r.polygon_id, r.assignment_method) for r in out] == [(r.h3, r.polygon_id, r.assignment_method) for r in back]
    assert {r.assignment_method for r in out} <= {"centre", "intersects", "largest_overlap", "nearest", "ambiguous"}
    assert all(r.assignment_distance > 0 for r in out if r.assignment_method == "nearest")
    plain = assign(cells, features, "feature_id").filter("assignment_method = 'unassigned'").first()
    assert plain.polygon_id is None and plain.candidate_n == 0 and plain.assignment_distance is None


def test_rendering_and_geojson(spark, tmp_path):
    toy = toy_polygons(spark)
    drawn = boundaries(cover(toy, 7))
    assert drawn.count() == cover(toy, 7).count()
    assert svg(drawn, toy).startswith("<svg") and "stroke-width:2" in svg(drawn, toy)
    geojson.write(toy, f"file://{tmp_path}/g")
    back = geojson.read(spark, f"file://{tmp_path}/g", "geometry_id string")
    assert {r.geometry_id: r.geometry for r in back.collect()} == {r.geometry_id: r.geometry for r in toy.collect()}


def test_stream_rollup(spark, fine, tmp_path):
    relation = _relation(fine)
    rows = fine.withColumn("v", F.lit(2.0))
    rows.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("h3 string, v double").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    stream_rollup.start(stream, relation, ["v"], f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    out = stream_rollup.totals(spark, f"{tmp_path}/out", ["v"]).collect()
    assert sum(r.v for r in out) == 2 * 1285 and len(out) == 235
