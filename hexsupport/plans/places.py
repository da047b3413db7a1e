"""Queries on cells and polygons that the star tables give, with SQL that lays out the same cells by formula.

Every customer stands for a cell of resolution 9, consecutive ones filling whole
parents around the middle of an icosahedron's face, where a cell's centre and
corners are sums of one step for each digit. Nations are rectangles in EPSG:3857
around that middle, some of which share an edge.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hexsupport.functions import grid
from hexsupport.functions.project import WGS84, from_lng_lat
from hexsupport.operators.compact import compact, ownership
from hexsupport.operators.cover import cover, expand
from hexsupport.operators.relate import TIE, assign, membership
from hexsupport.operators.render import boundaries
from hexsupport.operators.rollup import rollup, text_cells
from hexsupport.operators.tiles import SIDE as PIXELS
from hexsupport.operators.tiles import STYLE, tiles
from hexsupport.plans.algebra import _hex as hex_sql
from hexsupport.plans.algebra import _number as cell_sql
from hexsupport.plans.algebra import table
from hexsupport.sources.fixtures import GEOMETRY
from hexsupport.sources.shared import written
from hexsupport.sources.wkb import from_wkb, to_wkb

#: The base cell, its place in the plane in whole kilometres, and the lattice of nations around it, in metres of the plane.
BASE, CRS = 95, 3857
MIDDLE = np.round(from_lng_lat(np.array([154.18229776, -34.38844532]), CRS) / 1000) * 1000 + [137.0, 291.0]
PITCH, SIDE, LEVEL = 3800.0, 3000.0, 9
#: Zooms of the map tiles.
ZOOMS = (6, 14)
#: Share of a cell that must be covered; SQL measures on the sphere, the library on the ellipsoid, so shares differ by some 1e-5.
LEAST = 0.45


def nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(nation, region, geometry)``; each third rectangle reaches to the next one's edge."""
    i, j = F.col("n_nationkey") % 5, F.floor(F.col("n_nationkey") / 5)
    west, south = float(MIDDLE[0] - 2.5 * PITCH) + i * PITCH, float(MIDDLE[1] - 2.5 * PITCH) + j * PITCH
    east, north = west + F.when(F.col("n_nationkey") % 3 == 0, PITCH).otherwise(SIDE), south + SIDE
    ring = F.array(F.array(west, south), F.array(east, south), F.array(east, north), F.array(west, north))
    return table(spark, sf_dir, "nation").select(F.col("n_name").alias("nation"), F.col("n_regionkey").alias("region"), F.array(F.array(ring)).cast(GEOMETRY).alias("geometry"))


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_cells(table(spark, sf_dir, "customer"), "c_custkey", LEVEL, BASE)


def membership_nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return membership(customers(spark, sf_dir), nations(spark, sf_dir), "nation", CRS)


def assign_nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = assign(customers(spark, sf_dir), nations(spark, sf_dir), "nation", ["region"], crs=CRS)
    return out.select("h3", "polygon_id", "assignment_method", "candidate_n", F.coalesce("region", F.lit(-1)).alias("region"))


def assign_nations_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = assign(customers(spark, sf_dir), nations(spark, sf_dir), "nation", outside="nearest", crs=CRS)
    return out.withColumn("assignment_distance", F.round("assignment_distance", 4))


def cover_nations_center(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover(nations(spark, sf_dir), 8, crs=CRS)


def cover_nations_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover(nations(spark, sf_dir), 8, "within", crs=CRS)


def cover_nations_intersects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover(nations(spark, sf_dir), 8, "intersects", crs=CRS)


def cover_nations_exhaustive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover(nations(spark, sf_dir), 8, "intersects", crs=CRS, exhaustive=True)


def cover_nations_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover(nations(spark, sf_dir), 8, "overlap", LEAST, crs=CRS)


def expand_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return expand(customers(spark, sf_dir), 2)


def boundaries_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corners of each customer's cell: their number, and each one's place to seven digits."""
    ring = F.slice(F.col("geometry")[0][0], 1, F.size(F.col("geometry")[0][0]) - 1)
    places = F.array_join(F.array_sort(F.transform(ring, lambda p: F.format_string("%.6f %.6f", p[0] + 1e-9, p[1] + 1e-9))), ", ")
    return boundaries(customers(spark, sf_dir)).select("c_custkey", F.size(ring).alias("corners"), places.alias("places"))


def tiles_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Map tiles of the customers' cells, from zooms where many share a pixel to those where a cell spans tens."""
    out = tiles(customers(spark, sf_dir), *ZOOMS)
    return out.select("z", "x", "y", "shapes", F.length("svg").alias("characters"))


def binary_nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations written as well-known binary and read again: the size in bytes, and the bounds of what is read."""
    binary = to_wkb(nations(spark, sf_dir)).select("nation", "wkb")
    ring = F.flatten(F.flatten("geometry"))
    bound = lambda f, k: f(F.transform(ring, lambda p: p[k]))
    return from_wkb(binary).select(
        "nation", F.octet_length("wkb").alias("bytes"), F.size(ring).alias("points"), bound(F.array_min, 0).alias("west"), bound(F.array_min, 1).alias("south"), bound(F.array_max, 0).alias("east"), bound(F.array_max, 1).alias("north"),
    )


def workflow_nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage, assignment, compaction, ownership and rollup from end to end: cells and nations of each compact cell."""
    polygons = nations(spark, sf_dir)
    cells = written(cover(polygons, 8, crs=CRS))
    named = assign(cells, polygons, "nation", ["region"], crs=CRS).select("h3", F.coalesce("polygon_id", F.lit("none")).alias("nation"), "region").withColumn("one", F.lit(1))
    out = rollup(named, ownership(cells, compact(cells, 7)), sum=["one"], collapse=["nation", "region"])
    return out.select("compact_h3", "compact_resolution", "source_cell_n", F.col("one").cast("long").alias("one"), "nation", F.col("nation_n").cast("long").alias("nation_n"))


QUERIES = {
    f.__name__: f
    for f in (
        membership_nations, assign_nations, assign_nations_nearest, cover_nations_center, cover_nations_within, cover_nations_intersects, cover_nations_exhaustive, cover_nations_overlap, expand_customers,
        boundaries_customers, tiles_customers, binary_nations, workflow_nations,
    )
}

_NATIONS = f"""p AS (SELECT n_name AS nation, n_regionkey AS region, n_nationkey AS k, {MIDDLE[0] - 2.5 * PITCH} + (n_nationkey % 5) * {PITCH} AS w, {MIDDLE[1] - 2.5 * PITCH} + (n_nationkey // 5) * {PITCH} AS s FROM nation),
  n AS (SELECT *, w + CASE WHEN k % 3 = 0 THEN {PITCH} ELSE {SIDE} END AS e, s + {SIDE} AS t FROM p)"""


def _sum(numbers, key: str, res: int, part) -> str:
    """The sum of one part of a step for each base-7 digit of a key, as SQL."""
    terms = []
    for r in range(1, res + 1):
        digit = f"({key} // {7 ** (res - r)} % 7)"
        terms.append(f"[{', '.join(repr(float(part(z))) for z in numbers * grid.scale(r))}][1 + {digit}]")
    return " + ".join(terms)


def _cells(keys: str, res: int) -> str:
    """CTEs ``c(key, h3, x, y)`` (centre in the plane) and ``hexagon(h3, i, x, y, lng, lat)`` (corners, anticlockwise) of the cells of ``keys``, a query for ``key``."""
    face = grid.layout().home_face[BASE]
    axes = [getattr(grid.layout(), k)[face] for k in ("centre", "real", "imag")]
    v = [f"({float(axes[0][d])!r} + {grid.UNIT} * (re * {float(axes[1][d])!r} + im * {float(axes[2][d])!r}))" for d in range(3)]
    at = f"degrees(atan2({v[1]}, {v[0]})) AS lng, degrees(atan2({v[2]}, sqrt({v[0]} * {v[0]} + {v[1]} * {v[1]}))) AS lat"
    flat = f"radians(lng) * {WGS84[0]} AS x, ln(tan(pi() / 4 + radians(lat) / 2)) * {WGS84[0]} AS y"
    corner = grid.scale(res) * np.exp(1j * np.pi / 6) * grid.SIXTH ** np.arange(6) / np.sqrt(3)
    listed = ", ".join(f"({i}, {float(z.real)!r}, {float(z.imag)!r})" for i, z in enumerate(corner))
    return f"""plane AS (SELECT key, {hex_sql(cell_sql("key", res, BASE))} AS h3, {_sum(grid.STEPS, "key", res, np.real)} AS re, {_sum(grid.STEPS, "key", res, np.imag)} AS im FROM ({keys})),
  c AS (SELECT key, h3, {flat} FROM (SELECT key, h3, {at} FROM plane)),
  hexagon AS (SELECT h3, i, lng, lat, {flat} FROM (SELECT h3, i, {at} FROM (SELECT h3, i, re + a AS re, im + b AS im FROM plane, (VALUES {listed}) u(i, a, b)))),
  side AS (SELECT a.h3, a.i, a.x AS px, a.y AS py, b.x AS qx, b.y AS qy FROM hexagon a JOIN hexagon b ON a.h3 = b.h3 AND b.i = (a.i + 1) % 6)"""


#: Cells and rectangles that meet: no side of either has the other beyond it.
_MET = """box AS (SELECT h3, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM hexagon GROUP BY h3),
  beside AS (SELECT h3, nation, region, w, s, e, t FROM box JOIN n ON x1 >= w AND x0 <= e AND y1 >= s AND y0 <= t),
  apart AS (SELECT DISTINCT h3, nation FROM beside JOIN side USING (h3) WHERE greatest((qx - px) * (s - py) - (qy - py) * (w - px), (qx - px) * (s - py) - (qy - py) * (e - px),
    (qx - px) * (t - py) - (qy - py) * (w - px), (qx - px) * (t - py) - (qy - py) * (e - px)) < 0),
  met AS (SELECT h3, nation, region, w, s, e, t, x > w AND x < e AND y > s AND y < t AS within FROM beside JOIN c USING (h3) ANTI JOIN apart USING (h3, nation))"""
#: The square of the plane's scale at a height: what an area there is multiplied by.
_TRUE = f"4 / power(exp(h / {WGS84[0]}) + exp(-h / {WGS84[0]}), 2)"
#: How much of each cell a rectangle covers: between consecutive heights the covered length is linear; eighths of such a slab follow the plane's scale.
_AREA = f"""cut AS (SELECT h3, nation, unnest([py, s, t, py + (w - px) / nullif(qx - px, 0) * (qy - py), py + (e - px) / nullif(qx - px, 0) * (qy - py)]) AS y FROM met JOIN side USING (h3)),
  height AS (SELECT h3, nation, y, lead(y) OVER (PARTITION BY h3, nation ORDER BY y) AS z FROM (SELECT DISTINCT h3, nation, y FROM cut JOIN met USING (h3, nation) WHERE y BETWEEN s AND t)),
  eighth AS (SELECT h3, nation, (z - y) / 8 AS thick, y + (z - y) * (i.range + 0.5) / 8 AS h FROM height, range(8) i WHERE z > y),
  slab AS (SELECT h3, nation, thick, h, min(px + (h - py) / (qy - py) * (qx - px)) AS l, max(px + (h - py) / (qy - py) * (qx - px)) AS r FROM eighth JOIN side USING (h3)
    WHERE (py > h) <> (qy > h) GROUP BY h3, nation, thick, h),
  area AS (SELECT h3, nation, sum(thick * greatest(least(r, e) - greatest(l, w), 0) * {_TRUE}) AS area FROM slab JOIN met USING (h3, nation) GROUP BY h3, nation),
  whole AS (SELECT h3, sum(px * qy - py * qx) / 2 * any_value({_TRUE}) AS whole FROM (SELECT h3, y AS h, px - x AS px, py - y AS py, qx - x AS qx, qy - y AS qy FROM side JOIN c USING (h3)) GROUP BY h3)"""
_METHOD = f"""g AS (SELECT h3, count(*) AS hits, count(*) FILTER (within) AS inside, max(nation) FILTER (within) AS around, max(area) AS top FROM met LEFT JOIN area USING (h3, nation) GROUP BY h3),
  l AS (SELECT h3, count(*) AS n, max(nation) AS most FROM met LEFT JOIN area USING (h3, nation) JOIN g USING (h3) WHERE coalesce(area, 0) >= top - greatest({TIE}, top * {TIE}) OR hits = 1 GROUP BY h3),
  a AS (SELECT h3, CASE WHEN inside = 1 THEN around WHEN n = 1 THEN most END AS polygon_id,
    CASE WHEN hits IS NULL THEN 'unassigned' WHEN inside = 1 THEN 'centre' WHEN hits = 1 THEN 'intersects' WHEN n = 1 THEN 'largest_overlap' ELSE 'ambiguous' END AS assignment_method,
    CASE WHEN hits IS NULL THEN 0 WHEN inside = 1 THEN 1 ELSE hits END::INT AS candidate_n FROM c LEFT JOIN g USING (h3) LEFT JOIN l USING (h3))"""


def sql() -> dict[str, str]:
    customer = _cells("SELECT DISTINCT c_custkey AS key FROM customer", LEVEL)
    near = _cells(f"SELECT range AS key FROM range({7**4})", 8)
    assigned = f"WITH {_NATIONS}, {customer}, {_MET}, {_AREA}, {_METHOD}"
    covered = f"WITH {_NATIONS}, {near}, {_MET}, {_AREA}"
    within = "SELECT h3 FROM area JOIN whole USING (h3) GROUP BY h3, whole HAVING sum(area) >= whole * (1 - 1e-6)"
    return {
        "membership_nations": f"WITH {_NATIONS}, {customer}, {_MET} SELECT h3, nation AS polygon_id FROM met",
        "assign_nations": f"{assigned} SELECT h3, polygon_id, assignment_method, candidate_n, coalesce(n.region, -1)::INT AS region FROM a LEFT JOIN n ON n.nation = polygon_id",
        "assign_nations_nearest": f"""{assigned}, d AS (SELECT h3, nation, sqrt(power(greatest(w - x, x - e, 0), 2) + power(greatest(s - y, y - t, 0), 2)) AS d FROM a JOIN c USING (h3), n WHERE assignment_method = 'unassigned'),
    m AS (SELECT h3, min(d) AS least FROM d GROUP BY h3),
    r AS (SELECT h3, count(*) AS tied, min(nation) AS nation, min(least) AS least FROM d JOIN m USING (h3) WHERE d <= least * (1 + 1e-9) GROUP BY h3)
    SELECT h3, CASE WHEN tied = 1 THEN nation ELSE polygon_id END AS polygon_id, CASE WHEN tied = 1 THEN 'nearest' WHEN tied > 1 THEN 'ambiguous' ELSE assignment_method END AS assignment_method,
      CASE WHEN tied IS NULL THEN 0.0 WHEN tied = 1 THEN round(least, 4) END AS assignment_distance, CASE WHEN tied = 1 THEN 1 WHEN tied > 1 THEN 2 ELSE candidate_n END::INT AS candidate_n FROM a LEFT JOIN r USING (h3)""",
        "cover_nations_center": f"WITH {_NATIONS}, {near} SELECT DISTINCT h3 FROM c JOIN n ON x > w AND x < e AND y > s AND y < t",
        "cover_nations_within": f"{covered} {within}",
        "cover_nations_intersects": f"WITH {_NATIONS}, {near}, {_MET} SELECT DISTINCT h3 FROM met",
        "cover_nations_exhaustive": f"WITH {_NATIONS}, {near}, {_MET} SELECT DISTINCT h3 FROM met",
        "cover_nations_overlap": f"{covered} SELECT h3 FROM area JOIN whole USING (h3) GROUP BY h3, whole HAVING sum(area) >= whole * {LEAST}",
        # two centres of neighbours are 1 apart in the face's plane, of second neighbours sqrt(3) to 2
        "expand_customers": _expand_sql(),
        "boundaries_customers": f"""WITH {customer} SELECT c_custkey, count(*)::INT AS corners, string_agg(printf('%.6f %.6f', lng + 1e-9, lat + 1e-9), ', ' ORDER BY printf('%.6f %.6f', lng + 1e-9, lat + 1e-9)) AS places
    FROM customer JOIN c ON c.key = c_custkey JOIN hexagon USING (h3) GROUP BY c_custkey""",
        # a cell is a pixel where its bounds are less than one, and else its six corners in each tile that the bounds meet
        "tiles_customers": f"""WITH {customer}, u AS (SELECT h3, (lng + 180) / 360 AS u, 0.5 - ln(tan(pi() / 4 + radians(lat) / 2)) / (2 * pi()) AS v FROM hexagon),
    q AS (SELECT z.range AS z, h3, u * {PIXELS} * power(2, z.range) AS px, v * {PIXELS} * power(2, z.range) AS py FROM u, range({ZOOMS[0]}, {ZOOMS[1] + 1}) z),
    b AS (SELECT z, h3, min(px) AS x0, max(px) AS x1, min(py) AS y0, max(py) AS y1 FROM q GROUP BY z, h3),
    dot AS (SELECT DISTINCT z, floor((x0 + x1) / 2)::BIGINT AS i, floor((y0 + y1) / 2)::BIGINT AS j FROM b WHERE x1 - x0 < 1 AND y1 - y0 < 1),
    col AS (SELECT *, unnest(range(floor(x0 / {PIXELS})::BIGINT, floor(x1 / {PIXELS})::BIGINT + 1)) AS x FROM b WHERE x1 - x0 >= 1 OR y1 - y0 >= 1),
    wide AS (SELECT z, h3, x, unnest(range(floor(y0 / {PIXELS})::BIGINT, floor(y1 / {PIXELS})::BIGINT + 1)) AS y FROM col),
    shape AS (SELECT z, i // {PIXELS} AS x, j // {PIXELS} AS y, length('M' || (i % {PIXELS}) || ',' || (j % {PIXELS}) || 'h1v1h-1Z') AS n FROM dot
      UNION ALL SELECT z, x, y, sum(1 + length(printf('%.1f,%.1f', px - x * {PIXELS}, py - y * {PIXELS}))) + 1 AS n FROM wide JOIN q USING (z, h3) GROUP BY z, h3, x, y)
    SELECT z::INT AS z, x, y, count(*)::INT AS shapes, ({len(STYLE) + 89} + sum(n))::INT AS characters FROM shape GROUP BY z, x, y""",
        "binary_nations": f"WITH {_NATIONS} SELECT nation, 1 + 4 + 4 + 4 + 4 * 16 AS bytes, 4 AS points, w AS west, s AS south, e AS east, t AS north FROM n",
        "workflow_nations": f"""{covered}, {_METHOD}, k AS (SELECT key, h3 FROM c WHERE EXISTS (SELECT 1 FROM n WHERE x > w AND x < e AND y > s AND y < t)),
    o AS (SELECT key, h3, count(*) OVER (PARTITION BY key // 7) = 7 AS whole FROM k),
    b AS (SELECT CASE WHEN whole THEN {hex_sql(cell_sql("(key // 7)", 7, BASE))} ELSE h3 END AS compact_h3, CASE WHEN whole THEN 7 ELSE 8 END AS compact_resolution, coalesce(polygon_id, 'none') AS nation FROM o JOIN a USING (h3))
    SELECT compact_h3, compact_resolution, count(*)::INT AS source_cell_n, count(*)::BIGINT AS one, string_agg(DISTINCT nation, '; ' ORDER BY nation) AS nation, count(DISTINCT nation)::BIGINT AS nation_n
    FROM b GROUP BY compact_h3, compact_resolution""",
    }


def _expand_sql(rings: int = 2) -> str:
    """Cells with a customer and those within some steps, as places of the lattice ``u + v * third``: digits are turned into places, and places back into digits."""
    unit = grid.scale(LEVEL)
    third = np.exp(2j * np.pi / 3)

    def place(z: complex) -> tuple[int, int]:
        v = z.imag / third.imag
        return round(z.real - v * third.real), round(v)

    steps = [[place(d * grid.scale(r) / unit) for d in grid.STEPS] for r in range(1, LEVEL + 1)]
    part = lambda k, key: " + ".join(f"{[s[k] for s in own]}[1 + ({key} // {7 ** (LEVEL - r)} % 7)]" for r, own in enumerate(steps, 1))
    # a step in the lattice is at most `rings` long if the greatest difference of its three axes is
    return f"""WITH own AS (SELECT {part(0, "key")} AS u, {part(1, "key")} AS v FROM (SELECT DISTINCT c_custkey AS key FROM customer)),
    step AS (SELECT i.range AS du, j.range AS dv FROM range({-rings}, {rings + 1}) i, range({-rings}, {rings + 1}) j WHERE abs(i.range - j.range) <= {rings}),
    goal AS (SELECT DISTINCT u + du AS u, v + dv AS v FROM own, step),
    known AS (SELECT key, {part(0, "key")} AS u, {part(1, "key")} AS v FROM (SELECT range AS key FROM range({7**6})) WHERE key < 7 * (SELECT max(c_custkey) + 2401 FROM customer))
    SELECT {hex_sql(cell_sql("key", LEVEL, BASE))} AS h3 FROM goal JOIN known USING (u, v)"""
