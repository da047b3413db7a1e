"""Cells and polygon features: many-to-many membership, and assignment of each cell to one feature."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hexsupport.functions import bits
from hexsupport.operators.cells import SupportError, as_cells, checked
from hexsupport.operators.index import ABOVE, index
from hexsupport.operators.meet import features, nearest, overlapping
from hexsupport.operators.polygons import checked_polygons, numbered
from hexsupport.sources.shared import written

#: Relative tolerance of equal overlaps.
TIE = 2.0**-26
METHODS = ("centre", "intersects", "largest_overlap", "nearest", "ambiguous", "unassigned")
RESULT = ("h3", "polygon_id", "assignment_method", "assignment_distance", "candidate_n")


def overlapping_pairs(polygons: DataFrame, crs: int = 4326, id_col: str | None = None) -> DataFrame:
    """``(a, b)``: pairs of polygons whose interiors overlap, by their places in the table or, if named, their ids.

    Polygons meet in cells of their own sizes: a cell of one and a cell of another
    below it, found by an equi-join on ancestors. What lies below an inner cell
    overlaps; two border cells are settled by their own edges.
    """
    table = numbered(polygons)
    rows = index(table, crs, None)
    levels = sorted(r[0] for r in rows.select(bits.resolution(F.col("cell"))).distinct().collect())  # at most 16
    light = rows.select("poly", "cell", bits.resolution(F.col("cell")).alias("level"), F.col("edges").isNull().alias("inner"))
    above = F.explode(F.array_compact(F.array(*(F.when(F.col("level") >= r, bits.parent(F.col("cell"), r)) for r in levels))))
    low = light.select(F.col("poly").alias("b"), F.col("cell").alias("b_cell"), F.col("inner").alias("b_inner"), above.alias("cell"))
    pairs = light.select(F.col("poly").alias("a"), "cell", F.col("inner").alias("a_inner")).join(low, "cell").filter((F.col("a") < F.col("b")) | (F.col("a") > F.col("b")) & (F.col("cell") != F.col("b_cell")))
    pairs = written(pairs.withColumnRenamed("cell", "a_cell"))
    known = pairs.filter("a_inner").select("a", "b").distinct()
    rest = pairs.filter("NOT a_inner").join(known, ["a", "b"], "left_anti")
    parts = {k: rows.select(F.col("poly").alias(k), F.col("cell").alias(f"{k}_cell"), F.col("inside").alias(f"{k}_inside"), F.col("edges").alias(f"{k}_edges")) for k in "ab"}
    rest = rest.join(parts["a"], ["a", "a_cell"]).join(parts["b"], ["b", "b_cell"])
    found = known.unionByName(rest.select("a", "b", "a_cell", "b_cell", "a_inside", "b_inside", "a_edges", "b_edges").mapInPandas(overlapping(crs), "a long, b long"))
    found = found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    if id_col is None:
        return found
    named = table.select("poly", F.col(f"`{id_col}`").alias("id"))
    for k in "ab":
        found = found.join(named.withColumnsRenamed({"poly": k, "id": f"{k}_id"}), k)
    return found.select(F.least("a_id", "b_id").alias("a"), F.greatest("a_id", "b_id").alias("b"))


def check_topology(polygons: DataFrame, crs: int = 4326) -> None:
    found = overlapping_pairs(polygons, crs).count()
    if found:
        raise SupportError(f"Polygons have overlapping interiors: {found} pairs")


def membership(cells: DataFrame, polygons: DataFrame, id_col: str, crs: int = 4326, column: str = "h3", validate: bool = True) -> DataFrame:
    """``(h3, polygon_id)``: all pairs of cells and polygons with a point in common, by cell, then by the polygons' order."""
    if validate:
        facts = checked(cells, "x", column, empty_ok=False)
        checked_polygons(polygons, crs, id_col)
        check_topology(polygons, crs)
        res = facts.coarsest
    else:
        res = cells.agg(F.min(bits.resolution(bits.to_long(F.col(column))))).first()[0]
    table = numbered(polygons)
    finest = max(0, res - ABOVE)
    met = features(as_cells(cells, column), index(table, crs, finest), crs, finest)
    named = met.join(table.select("poly", F.col(f"`{id_col}`").alias("polygon_id")), "poly")
    return named.orderBy(bits.to_text(F.col("cell")), "poly").select(bits.to_text(F.col("cell")).alias("h3"), "polygon_id")


def cascade(features: DataFrame) -> DataFrame:
    """One row per cell of ``features(cell, poly, within, area)``: ``cell, poly, assignment_method, candidate_n``.

    The polygon around the centre; else the only one that meets the cell; else the
    one with the largest overlap, unless another equals it.
    """
    ranked = features.withColumn("top", F.max("area").over(Window.partitionBy("cell")))
    level = F.count_if(F.col("area") >= F.col("top") - F.greatest(F.lit(TIE), F.col("top") * TIE))
    per = ranked.groupBy("cell").agg(F.count("*").cast("int").alias("hits"), F.count_if("within").alias("inside"), F.max_by("poly", F.col("within").cast("int")).alias("around"), F.max_by("poly", "area").alias("most"), level.alias("level"))
    method = F.when(F.col("inside") > 1, "error").when(F.col("inside") == 1, "centre").when(F.col("hits") == 1, "intersects").when(F.col("level") == 1, "largest_overlap").otherwise("ambiguous")
    per = per.withColumn("assignment_method", method)
    poly = F.when(F.col("assignment_method") == "centre", F.col("around")).when(F.col("assignment_method") != "ambiguous", F.col("most"))
    return per.select("cell", poly.alias("poly"), "assignment_method", F.when(F.col("assignment_method") == "centre", 1).otherwise(F.col("hits")).cast("int").alias("candidate_n"))


def assign(cells: DataFrame, polygons: DataFrame, id_col: str, keep: list[str] | None = None, outside: str = "unassigned", crs: int = 4326, column: str = "h3", validate: bool = True) -> DataFrame:
    """One row per cell: ``h3, polygon_id, assignment_method, assignment_distance, candidate_n`` and the kept attributes, by cell.

    Cells that meet no polygon stay ``unassigned`` or, if asked, go to the polygon
    ``nearest`` to their centre; equally near ones are ``ambiguous``.
    """
    if outside not in ("unassigned", "nearest"):
        raise SupportError("`outside` must be \"unassigned\" or \"nearest\"")
    if keep is not None and (isinstance(keep, str) or any(not isinstance(k, str) or not k for k in keep)):
        raise SupportError("`keep` must be a character vector without missing or empty names")
    keep = [k for k in dict.fromkeys(keep or []) if k != id_col]
    unknown = [k for k in keep if k not in polygons.columns]
    if unknown:
        raise SupportError(f"Unknown polygon attributes in `keep`: {unknown}")
    if "geometry" in keep:
        raise SupportError("`keep` cannot name the geometry column")
    if set(keep) & set(RESULT):
        raise SupportError(f"`keep` would overwrite result columns: {sorted(set(keep) & set(RESULT))}")
    if validate:
        res = checked(cells, "x", column, empty_ok=False).coarsest
        checked_polygons(polygons, crs, id_col)
        check_topology(polygons, crs)
    else:
        res = cells.agg(F.min(bits.resolution(bits.to_long(F.col(column))))).first()[0]
    table = numbered(polygons)
    own = written(as_cells(cells, column))
    finest = max(0, res - ABOVE)
    indexed = index(table, crs, finest)
    met = written(cascade(features(own, indexed, crs, finest, areas=True)))
    if validate and not met.filter("assignment_method = 'error'").isEmpty():
        raise SupportError("There are multiple assignments for an H3 centre")
    met = met.withColumn("assignment_distance", F.lit(0.0))
    rest = own.join(met, "cell", "left_anti")
    if outside == "nearest":
        near = nearest(written(rest), indexed, crs, finest)
        alone = F.col("tied") == 1
        rest = near.select("cell", F.when(alone, F.col("poly")).alias("poly"), F.when(alone, "nearest").otherwise("ambiguous").alias("assignment_method"), F.when(alone, 1).otherwise(2).cast("int").alias("candidate_n"), F.when(alone, F.col("dist")).alias("assignment_distance"))
    else:
        rest = rest.select("cell", F.lit(None).cast("long").alias("poly"), F.lit("unassigned").alias("assignment_method"), F.lit(0).alias("candidate_n"), F.lit(None).cast("double").alias("assignment_distance"))
    named = table.select("poly", F.col(f"`{id_col}`").alias("polygon_id"), *(F.col(f"`{k}`") for k in keep))
    out = met.unionByName(rest).join(named, "poly", "left").withColumn("h3", bits.to_text(F.col("cell")))
    return out.select(*RESULT, *keep).orderBy("h3")
