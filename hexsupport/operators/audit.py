"""Audit of a compaction: reconstruction, hierarchy and ownership, as three small tables."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hexsupport.functions import bits
from hexsupport.operators.cells import SupportError, as_cells, settled
from hexsupport.operators.compact import owned, relation
from hexsupport.operators.rollup import RELATION
from hexsupport.sources.shared import written


class Audit(NamedTuple):
    summary: DataFrame
    resolution: DataFrame
    ownership: DataFrame


def overlaps(cells: DataFrame, levels: list[int]) -> DataFrame:
    """(cell, ancestor) for cells of ``cells(cell)`` that have a coarser one among them."""
    own = bits.resolution(F.col("cell"))
    at = F.filter(F.array(*(bits.parent(F.col("cell"), p) for p in levels)), lambda a: bits.resolution(a) < own)
    return cells.select("cell", F.explode(at).alias("ancestor")).join(cells.select(F.col("cell").alias("ancestor")), "ancestor", "left_semi")


def audit(source: DataFrame, compacted: DataFrame, lookup: DataFrame | None = None, column: str = "h3", validate: bool = True) -> Audit:
    """Sixteen measures of a compaction, and its cells by resolution and sources by relationship.

    Without ``lookup`` the relation is built, and an incomplete one is an error;
    a given one is only measured. The reconstruction is never expanded: a source
    cell is found if it has an ancestor in the compaction, and what a compact cell
    covers beyond the source is its number of descendants less the sources below.
    """
    if validate:
        own, cells = settled(source, "source", column, empty_ok=False, single="")
        other, kept = settled(compacted, "compacted", column, empty_ok=False)
        if other.finest > own.finest:
            raise SupportError("`compacted` has cells finer than the source resolution")
        res = own.finest
    else:
        cells, kept = written(as_cells(source, column)), written(as_cells(compacted, column))
        res = cells.agg(F.max(bits.resolution(F.col("cell")))).first()[0]
    own = bits.resolution(F.col("cell"))
    sizes = kept.agg(F.count("*").alias("n"), F.min(own).alias("low"), F.max(own).alias("high"), F.collect_set(own).alias("levels")).first()
    levels = sorted(sizes.levels)
    given = lookup is not None
    if given:
        lost = [c for c in RELATION if c not in lookup.columns]
        if lost:
            raise SupportError(f"`lookup` lacks columns: {lost}")
    pairs = written(owned(cells, kept, levels))
    found = pairs.agg(F.count("*").alias("source_cell_n"), F.count_if(F.col("owner").isNull()).alias("missing")).first()
    if not given:
        if found.missing:
            raise SupportError(f"Source ownership is incomplete: {found.missing} cells without an owner")
        lookup = relation(pairs)

    # nested cells cover the same descendants: only those without an ancestor in the set cover anything new
    nested = overlaps(kept, levels)
    tops = kept.join(nested.select("cell").distinct(), "cell", "left_anti")
    covered = tops.agg(F.sum(bits.child_count(F.col("cell"), F.lit(res) - bits.resolution(F.col("cell")))).alias("n")).first().n
    overlap = nested.count()

    text = lookup.select(*RELATION)
    owners = kept.select(bits.to_text(F.col("cell")).alias("compact_h3"), F.lit(1).alias("is_owner"))
    sources = cells.select(bits.to_text(F.col("cell")).alias("source_h3"), F.lit(1).alias("is_source"))
    per = text.join(owners, "compact_h3", "left").join(sources, "source_h3", "full").agg(
        F.count("compact_h3").alias("rows"),
        F.count_distinct("source_h3").alias("kinds"),
        F.count_if(F.col("is_source").isNull()).alias("foreign"),
        F.count_if(F.col("is_source").isNotNull() & F.col("compact_h3").isNull()).alias("unmatched"),
        F.count_if(F.col("compact_h3").isNotNull() & F.col("is_owner").isNull()).alias("unknown"),
        F.count_if(F.col("compact_h3").isNotNull() & ~F.coalesce(F.col("relationship").isin("exact", "ancestor"), F.lit(False))).alias("odd"),
        F.count_if(F.col("relationship") == "exact").alias("exact"),
        F.count_if(F.col("relationship") == "ancestor").alias("ancestor"),
        F.count("is_source").alias("matched"),
    ).first()
    n, missing = found.source_cell_n, found.missing
    additional = covered - (n - missing)
    whole = per.rows == n and per.kinds == n and not (per.foreign or per.unmatched or per.unknown or per.odd)
    values = (
        n, sizes.n, n - sizes.n, 100.0 * (n - sizes.n) / n, res, sizes.low, sizes.high, per.exact, per.ancestor, per.unmatched, missing, additional, overlap,
        missing == 0 and additional == 0, overlap == 0, whole,
    )
    schema = (
        "source_cell_n long, compact_cell_n long, reduction_n long, reduction_pct double, source_resolution int, compact_resolution_min int, compact_resolution_max int, "
        "exact_source_n long, ancestor_source_n long, unmatched_source_n long, roundtrip_missing_n long, roundtrip_additional_n long, hierarchy_overlap_n long, "
        "exact_reconstruction boolean, hierarchy_integrity boolean, ownership_integrity boolean"
    )
    summary = source.sparkSession.createDataFrame([values], schema)
    by_level = kept.groupBy(bits.resolution(F.col("cell")).alias("compact_resolution")).agg(F.count("*").cast("int").alias("compact_cell_n")).orderBy("compact_resolution")
    by_owner = text.groupBy("relationship", "compact_resolution").agg(F.count("*").cast("int").alias("source_cell_n")).orderBy("compact_resolution", "relationship")
    return Audit(summary, by_level, by_owner)
