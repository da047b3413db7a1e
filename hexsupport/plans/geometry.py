"""Queries on polygons and cells: a lattice of rectangles with closed-form SQL, and the toy tables with known results."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hexsupport.functions import grid, planar
from hexsupport.operators.compact import compact, ownership
from hexsupport.operators.cover import cover, expand
from hexsupport.operators.polygons import cell_rings, descend
from hexsupport.operators.relate import TIE, assign, cascade, membership, overlapping_pairs
from hexsupport.operators.render import boundaries, with_geojson, with_wkt
from hexsupport.operators.rollup import rollup
from hexsupport.plans.algebra import table
from hexsupport.sources.fixtures import FEATURES, GEOMETRY, TOY, toy_features, toy_polygons
from hexsupport.sources.shared import written

#: The kernels on rectangles: polygons are a 5 x 5 lattice of 10 x 10 squares with gaps, cells squares of side 4.
PITCH, SIDE, CELL = 12.0, 10.0, 4.0


def _box(west, south, east, north):
    ring = F.array(F.array(west, south), F.array(east, south), F.array(east, north), F.array(west, north))
    return F.array(F.array(ring))


def lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(poly, polygon_id, west, south, east, north, geometry)`` for each nation."""
    nation = table(spark, sf_dir, "nation")
    west, south = (F.col("n_nationkey") % 5) * PITCH, F.floor(F.col("n_nationkey") / 5) * PITCH
    df = nation.select(F.col("n_nationkey").cast("long").alias("poly"), F.col("n_name").alias("polygon_id"), west.alias("west"), south.cast("double").alias("south"))
    df = df.withColumn("east", F.col("west") + SIDE).withColumn("north", F.col("south") + SIDE)
    return df.withColumn("geometry", _box(F.col("west"), F.col("south"), F.col("east"), F.col("north")).cast(GEOMETRY))


def squares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(cell, x, y)``: a square around each supplier's or customer's place; quarters keep all sums exact."""
    customer = table(spark, sf_dir, "customer")
    x = (F.col("c_custkey") * 37 % 341) / 4.0
    y = (F.col("c_custkey") * 53 % 331) / 4.0
    return customer.select(F.col("c_custkey").alias("cell"), x.alias("x"), y.alias("y"))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Squares and rectangles that share a tile: an equi-join on tiles of the lattice's pitch."""
    cells = squares(spark, sf_dir)
    half = CELL / 2

    def tiles(low, high):
        return F.sequence(F.floor(low / PITCH).cast("int"), F.floor(high / PITCH).cast("int"))

    own = cells.withColumn("tx", F.explode(tiles(F.col("x") - half, F.col("x") + half))).withColumn("ty", F.explode(tiles(F.col("y") - half, F.col("y") + half)))
    polys = lattice(spark, sf_dir).withColumn("tx", F.explode(tiles(F.col("west"), F.col("east")))).withColumn("ty", F.explode(tiles(F.col("south"), F.col("north"))))
    return own.join(polys, ["tx", "ty"]).dropDuplicates(["cell", "poly"]).select("cell", "x", "y", "poly", "geometry")


def _kernel(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The plane kernels on squares: meeting, centre inside, containment, and area of overlap."""
    for df in frames:
        out = []
        for cell, x, y, poly, geometry in df.itertuples(index=False):
            shape, h = planar.shape_of(geometry), CELL / 2
            ring = np.array([[x - h, y - h], [x + h, y - h], [x + h, y + h], [x - h, y + h]])
            if not planar.meet([[ring]], shape):
                continue
            centre = np.array([[x, y]])
            within = bool(planar.inside(shape, centre)[0]) and not bool(planar.on_edge(shape, centre)[0])
            out.append((cell, poly, within, planar.union_area([planar.clipped(shape, ring)])))
        yield pd.DataFrame(out, columns=["cell", "poly", "within", "area"]).astype({"cell": "int64", "poly": "int64", "within": bool, "area": float})


def lattice_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).mapInPandas(_kernel, "cell long, poly long, within boolean, area double")


def membership_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_features(spark, sf_dir).join(lattice(spark, sf_dir), "poly").select("cell", "polygon_id")


def within_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_features(spark, sf_dir).filter(F.col("area") >= CELL * CELL * (1 - 1e-9)).select("cell", "poly")


def overlap_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of each square that polygons cover, where it is a quarter or more."""
    share = lattice_features(spark, sf_dir).groupBy("cell").agg(F.round(F.sum("area") / (CELL * CELL), 9).alias("share"))
    return share.filter("share >= 0.25")


def assign_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All squares: by centre, single meeting, largest overlap, ambiguous, or unassigned."""
    found = cascade(lattice_features(spark, sf_dir))
    out = squares(spark, sf_dir).select("cell").join(found, "cell", "left").join(lattice(spark, sf_dir).select("poly", "polygon_id"), "poly", "left")
    return out.select("cell", "polygon_id", F.coalesce("assignment_method", F.lit("unassigned")).alias("assignment_method"), F.coalesce("candidate_n", F.lit(0)).alias("candidate_n"))


def nearest_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distance of each square's centre from the nearest rectangle's outline, for those that meet none."""
    rest = squares(spark, sf_dir).join(lattice_features(spark, sf_dir).select("cell").distinct(), "cell", "left_anti")
    sent = spark.sparkContext.broadcast([(r.poly, r.geometry) for r in lattice(spark, sf_dir).select("poly", "geometry").collect()])  # 25 nations

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        flat = [planar.shape_of(g) for _, g in sent.value]
        for df in frames:
            at = df[["x", "y"]].to_numpy(float)
            far = np.array([planar.distance(s, at) for s in flat]).reshape(len(flat), -1)
            yield pd.DataFrame({"cell": df.cell, "distance": far.min(axis=0).round(9), "tied": (far <= far.min(axis=0) * (1 + 1e-9)).sum(axis=0)})

    return rest.mapInPandas(run, "cell long, distance double, tied long")


def topology_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rectangles in a projected system, one per nation, of which neighbours overlap or abut: the pairs with overlapping interiors."""
    nation = table(spark, sf_dir, "nation")
    west, south = 16_100_000.0 + (F.col("n_nationkey") % 5) * 20_000, -4_600_000.0 + F.floor(F.col("n_nationkey") / 5) * 20_000
    wide = F.when(F.col("n_nationkey") % 3 == 0, 30_000).otherwise(20_000)
    polys = nation.select("n_nationkey", _box(west, south, west + wide, south + 20_000).cast(GEOMETRY).alias("geometry"))
    return overlapping_pairs(polys.withColumn("k", F.col("n_nationkey").cast("long")), 3857, "k")


# --- toy tables


def cover_toy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells by rule over the four toy shapes: counts that are known or follow from each other."""
    toy = toy_polygons(spark)
    regular, complex_ = toy.filter("geometry_id = 'regular'"), toy.filter("geometry_id = 'complex'")
    runs = {
        "regular r7 center": cover(regular, 7), "regular r7 intersects": cover(regular, 7, "intersects"), "regular r7 center expanded": expand(cover(regular, 7), 1),
        "complex r8 center": cover(complex_, 8), "complex r8 compact 7": compact(cover(complex_, 8), 7), "complex r9 center": cover(complex_, 9), "complex r9 compact 7": compact(cover(complex_, 9), 7),
    }
    out = None
    for name, cells in runs.items():
        row = cells.agg(F.lit(name).alias("run"), F.count("*").alias("cells"))
        out = row if out is None else out.unionByName(row)
    return out


def cover_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover(toy_polygons(spark), 8, "within")


def cover_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover(toy_polygons(spark), 8, "overlap", 0.5)


def cover_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover(toy_features(spark), 8, "intersects")


def cover_exhaustive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover(toy_features(spark), 8, "intersects", exhaustive=True)


def membership_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return membership(cover(toy_features(spark), 7), toy_features(spark), "feature_id")


def assign_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many cells each method assigns."""
    return assign(cover_features(spark, sf_dir), toy_features(spark), "feature_id").groupBy("assignment_method").agg(F.count("*").alias("cells"))


def assign_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = expand(cover(toy_features(spark), 7), 2)
    out = assign(cells, toy_features(spark), "feature_id", ["feature_name", "group_name"], "nearest")
    return out.withColumn("assignment_distance", F.round("assignment_distance", 3))


def workflow_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage, assignment, compaction, ownership and rollup from end to end."""
    features = toy_features(spark)
    cells = written(cover(features, 8, "intersects"))
    named = assign(cells, features, "feature_id", ["group_name"]).select("h3", F.coalesce("polygon_id", F.lit("none")).alias("feature"), "group_name").withColumn("one", F.lit(1))
    return rollup(named, ownership(cells, compact(cells, 7)), sum=["one"], collapse=["feature", "group_name"])


def render_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_geojson(with_wkt(boundaries(cover(toy_polygons(spark), 7)))).select("h3", "wkt", "geojson")


QUERIES = {f.__name__: f for f in (membership_lattice, within_lattice, overlap_lattice, assign_lattice, nearest_lattice, topology_pairs)}
#: Runs on the toy tables with known results, for tests; ``places`` asks the same of the star tables.
TOY_RUNS = {f.__name__: f for f in (cover_toy, cover_within, cover_overlap, cover_features, cover_exhaustive, membership_features, assign_features, assign_nearest, workflow_features, render_boundaries)}

_H = CELL / 2
_LATTICE = f"""p AS (SELECT n_nationkey::BIGINT AS poly, n_name AS polygon_id, (n_nationkey % 5) * {PITCH} AS w, (n_nationkey // 5) * {PITCH} AS s FROM nation),
  c AS (SELECT c_custkey AS cell, (c_custkey * 37 % 341) / 4.0 AS x, (c_custkey * 53 % 331) / 4.0 AS y FROM customer),
  m AS (SELECT cell, poly, polygon_id, x > w AND x < w + {SIDE} AND y > s AND y < s + {SIDE} AS within,
    ((least(x + {_H}, w + {SIDE}) - greatest(x - {_H}, w)) * (least(y + {_H}, s + {SIDE}) - greatest(y - {_H}, s)))::DOUBLE AS area
    FROM c JOIN p ON x + {_H} >= w AND x - {_H} <= w + {SIDE} AND y + {_H} >= s AND y - {_H} <= s + {SIDE})"""

SQL = {
    "membership_lattice": f"WITH {_LATTICE} SELECT cell, polygon_id FROM m",
    "within_lattice": f"WITH {_LATTICE} SELECT cell, poly FROM m WHERE area >= {CELL * CELL}",
    "overlap_lattice": f"WITH {_LATTICE} SELECT cell, round(sum(area) / {CELL * CELL}, 9) AS share FROM m GROUP BY cell HAVING sum(area) / {CELL * CELL} >= 0.25",
    "assign_lattice": f"""WITH {_LATTICE}, g AS (SELECT cell, count(*) AS hits, count(*) FILTER (within) AS inside, max(polygon_id) FILTER (within) AS around, max(area) AS top FROM m GROUP BY cell),
      l AS (SELECT m.cell, count(*) AS n, max(m.polygon_id) AS most FROM m JOIN g USING (cell) WHERE m.area >= g.top - greatest({TIE}, g.top * {TIE}) GROUP BY m.cell)
      SELECT c.cell, CASE WHEN inside = 1 THEN around WHEN n = 1 THEN most END AS polygon_id,
        CASE WHEN hits IS NULL THEN 'unassigned' WHEN inside = 1 THEN 'centre' WHEN hits = 1 THEN 'intersects' WHEN n = 1 THEN 'largest_overlap' ELSE 'ambiguous' END AS assignment_method,
        CASE WHEN hits IS NULL THEN 0 WHEN inside = 1 THEN 1 ELSE hits END::INT AS candidate_n
      FROM c LEFT JOIN g USING (cell) LEFT JOIN l USING (cell)""",
    "nearest_lattice": f"""WITH {_LATTICE}, d AS (SELECT cell, sqrt(power(greatest(w - x, x - w - {SIDE}, 0), 2) + power(greatest(s - y, y - s - {SIDE}, 0), 2)) AS d
      FROM c CROSS JOIN p WHERE cell NOT IN (SELECT cell FROM m)), n AS (SELECT cell, min(d) AS least FROM d GROUP BY cell)
      SELECT cell, round(least, 9) AS distance, count(*) AS tied FROM d JOIN n USING (cell) WHERE d <= least * (1 + 1e-9) GROUP BY cell, least""",
    "cover_toy": """SELECT * FROM (VALUES ('regular r7 center', 17::BIGINT), ('regular r7 intersects', 28), ('regular r7 center expanded', 36), ('complex r8 center', 183),
      ('complex r8 compact 7', 81), ('complex r9 center', 1285), ('complex r9 compact 7', 235)) t(run, cells)""",
    "assign_features": "SELECT * FROM (VALUES ('centre', 537::BIGINT), ('intersects', 96), ('largest_overlap', 2)) t(assignment_method, cells)",
    "topology_pairs": """WITH p AS (SELECT n_nationkey::BIGINT AS k, n_nationkey % 5 AS i, n_nationkey // 5 AS j, CASE WHEN n_nationkey % 3 = 0 THEN 3 ELSE 2 END AS wide FROM nation)
      SELECT x.k AS a, y.k AS b FROM p x JOIN p y ON x.k < y.k AND x.j = y.j AND 2 * x.i < 2 * y.i + y.wide AND 2 * y.i < 2 * x.i + x.wide""",
}


def _cell_sql(shapes: dict, res: int) -> str:
    """CTEs ``met(h3, id, crossed, around)`` for the cells near shapes and each shape.

    Centres and corners of all cells around the shapes come precomputed; the rest
    is plain SQL, in a plane with the cell's centre as origin in which great
    circles are straight: whether an edge of the cell crosses one of the shape, and
    whether the shape lies around the centre. No shape here fits into a cell.
    """
    edges = [(k, *a, *b) for k, g in shapes.items() for polygon in g for ring in polygon for a, b in zip(ring, ring[1:], strict=False)]
    outline = [[np.array([[a, b] for _, a, b, _, _ in edges])]]
    cell = descend(planar.box(outline), grid.roots(), 0, res)
    lat, lng = grid.centres(cell)
    listed = ", ".join(f"('{c:x}', {x:.12f}, {y:.12f}, {np.round(ring[:, 0], 12).tolist()}, {np.round(ring[:, 1], 12).tolist()})" for c, x, y, ring in zip(cell.tolist(), lng, lat, cell_rings(cell), strict=True))

    def flat(x: str, y: str) -> str:
        depth = f"(sin(radians(y0)) * sin(radians({y})) + cos(radians(y0)) * cos(radians({y})) * cos(radians({x} - x0)))"
        return f"cos(radians({y})) * sin(radians({x} - x0)) / {depth}, (cos(radians(y0)) * sin(radians({y})) - sin(radians(y0)) * cos(radians({y})) * cos(radians({x} - x0))) / {depth}"

    turn = lambda p, q, r: f"(({q}x - {p}x) * ({r}y - {p}y) - ({q}y - {p}y) * ({r}x - {p}x))"
    return f"""cells(h3, x0, y0, xs, ys) AS (VALUES {listed}),
  edges(id, ex, ey, fx, fy) AS (VALUES {", ".join(f"('{k}', {', '.join(map(repr, rest))})" for k, *rest in edges)}),
  sides AS (SELECT h3, x0, y0, unnest(xs) AS px, unnest(ys) AS py, unnest(list_concat(xs[2:], xs[:1])) AS qx, unnest(list_concat(ys[2:], ys[:1])) AS qy FROM cells),
  hexagon(h3, px, py, qx, qy) AS (SELECT h3, {flat("px", "py")}, {flat("qx", "qy")} FROM sides),
  outline(h3, id, ex, ey, fx, fy) AS (SELECT h3, id, {flat("ex", "ey")}, {flat("fx", "fy")} FROM cells CROSS JOIN edges),
  around AS (SELECT h3, id, count(*) FILTER ((ey > 0) <> (fy > 0) AND ex - ey / nullif(fy - ey, 0) * (fx - ex) > 0) % 2 = 1 AS around FROM outline GROUP BY h3, id),
  crossed AS (SELECT DISTINCT h3, id FROM outline JOIN hexagon USING (h3)
    WHERE {turn("e", "f", "p")} * {turn("e", "f", "q")} <= 0 AND {turn("p", "q", "e")} * {turn("p", "q", "f")} <= 0),
  met AS (SELECT a.h3, a.id, c.h3 IS NOT NULL AS crossed, around FROM around a LEFT JOIN crossed c USING (h3, id) WHERE around OR c.h3 IS NOT NULL)"""


def sql() -> dict[str, str]:
    """SQL for the queries of this module."""
    return {name: text for name, text in SQL.items() if name in QUERIES}


def toy_sql() -> dict[str, str]:
    """SQL for the runs on the toy tables that have any."""
    return {name: text for name, text in SQL.items() if name in TOY_RUNS} | {
        "cover_within": f"WITH {_cell_sql(TOY, 8)} SELECT h3 FROM met WHERE around AND NOT crossed",
        "cover_exhaustive": f"WITH {_cell_sql(FEATURES, 8)} SELECT DISTINCT h3 FROM met",
        # of those, the ones whose centre is at most one step (0.0090 degrees here, two steps are 0.0155 or more) from a cell around whose centre a shape lies
        "cover_features": f"""WITH {_cell_sql(FEATURES, 8)} SELECT DISTINCT m.h3 FROM met m JOIN cells c USING (h3) WHERE EXISTS (SELECT 1 FROM met n JOIN cells d ON n.h3 = d.h3
    WHERE n.around AND sqrt(power((c.x0 - d.x0) * cos(radians(c.y0)), 2) + power(c.y0 - d.y0, 2)) < 0.012)""",
        # coarse cells by their centre, and all pairs that meet
        "membership_features": f"WITH {_cell_sql(FEATURES, 7)} SELECT h3, id AS polygon_id FROM met WHERE h3 IN (SELECT h3 FROM met WHERE around)",
    }
