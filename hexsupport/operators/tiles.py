"""Pictures of many cells as a pyramid of square map tiles, drawn where Spark holds them.

A cell that is smaller than a pixel of a zoom is drawn as the pixel at its
middle, and equal pixels are one. So a tile holds at most one shape a pixel, and
larger cells, of which few fit: what a task gathers is bounded whatever the
number of cells, and is combined before it is shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hexsupport.operators.cells import SupportError, checked, whole_number
from hexsupport.operators.render import boundaries

#: Pixels of a tile's side, and the latitude at which the map is cut.
SIDE, EDGE = 256, 85.05112877980659
STYLE = "fill:#cfe3f5;stroke:#4477aa;stroke-width:0.5"


def tiles(cells: DataFrame, low: int, high: int, column: str = "h3", style: str = STYLE, validate: bool = True) -> DataFrame:
    """``(z, x, y, shapes, svg)``: each tile of zooms ``low`` to ``high`` that the bounds of a cell meet.

    Tiles are those of web maps: zoom z has 2^z columns from 180 degrees west
    and 2^z rows from the north, in the Mercator plane cut at 85.05 degrees.
    ``shapes`` counts what is drawn in a tile: pixels, and cells that span a
    pixel or more, these by all their corners in tenths of a pixel. Repeated
    cells are drawn once; a cell over the antimeridian is drawn at both of its
    ends; one that holds a pole, by its corners alone. No cells give no tiles
    where ``validate`` is off. A cell gives a row for each tile that it spans,
    so choose ``high`` by the cells' size.
    """
    low = whole_number(low, 0, 22, "`low` must be a whole number from 0 to 22.")
    high = whole_number(high, low, 22, "`high` must be a whole number from `low` to 22.")
    if any(c in style for c in "\"<>&"):
        raise SupportError("`style` must hold no quotes, angle brackets or ampersands.")
    if validate:
        checked(cells, "x", column, empty_ok=False)
    rings = boundaries(cells.select(F.col(f"`{column}`").alias("h3")).distinct(), validate=False)
    # corners in the unit square of the map, without the one that closes the ring
    open_ring = "slice(geometry[0][0], 1, size(geometry[0][0]) - 1)"
    lat = f"radians(least({EDGE}, greatest(-{EDGE}, p[1])))"
    flat = rings.select(F.expr(f"transform({open_ring}, p -> (p[0] + 180) / 360)").alias("u"), F.expr(f"transform({open_ring}, p -> 0.5 - ln(tan(pi() / 4 + {lat} / 2)) / (2 * pi()))").alias("v"))
    split = F.array_max("u") - F.array_min("u") > 0.5
    flat = flat.withColumn("u", F.when(split, F.expr("transform(u, x -> IF(x < 0.5, x + 1, x))")).otherwise(F.col("u")))
    shapes = flat.withColumn("z", F.explode(F.sequence(F.lit(low), F.lit(high)))).withColumn("across", F.expr("shiftleft(1L, z)"))
    bounds = {"x0": F.array_min("u"), "x1": F.array_max("u"), "y0": F.array_min("v"), "y1": F.array_max("v")}
    shapes = shapes.select("*", *((b * F.col("across") * SIDE).alias(k) for k, b in bounds.items()))
    tiny = (F.col("x1") - F.col("x0") < 1) & (F.col("y1") - F.col("y0") < 1)

    last = F.col("across") * SIDE - 1
    i, j = F.floor((F.col("x0") + F.col("x1")) / 2), F.least(last, F.greatest(F.lit(0).cast("long"), F.floor((F.col("y0") + F.col("y1")) / 2)))
    dots = shapes.filter(tiny).select("z", F.pmod(i, F.col("across") * SIDE).alias("i"), j.alias("j"))
    dots = dots.select("z", F.expr(f"i div {SIDE}").alias("x"), F.expr(f"j div {SIDE}").alias("y"), F.expr(f"concat('M', i % {SIDE}, ',', j % {SIDE}, 'h1v1h-1Z')").alias("path"))

    tile = lambda c: F.floor(F.col(c) / SIDE)
    row = lambda c: F.least(F.col("across") - 1, F.greatest(F.lit(0).cast("long"), tile(c)))
    wide = shapes.filter(~tiny).withColumn("column", F.explode(F.sequence(tile("x0"), tile("x1")))).withColumn("y", F.explode(F.sequence(row("y0"), row("y1"))))
    place = f"format_string('%.1f,%.1f', (p.u * across - column) * {SIDE}, (p.v * across - y) * {SIDE})"
    path = F.expr(f"concat('M', array_join(transform(arrays_zip(u, v), p -> {place}), 'L'), 'Z')")
    wide = wide.select("z", F.pmod("column", "across").alias("x"), "y", path.alias("path"))

    drawn = dots.unionByName(wide).groupBy("z", "x", "y").agg(F.array_sort(F.collect_set("path")).alias("paths"))
    head = f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 {SIDE} {SIDE}"><path style="{style}" d="'
    return drawn.select("z", "x", "y", F.size("paths").alias("shapes"), F.concat(F.lit(head), F.array_join("paths", ""), F.lit('"/></svg>')).alias("svg"))
