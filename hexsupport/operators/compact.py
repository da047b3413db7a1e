"""Exact hierarchical compaction of single-resolution cell sets, and source-to-owner relations.

A cell's owner is its coarsest *full* ancestor: one all of whose descendants at
the source resolution are present. Fullness is counted by windows over nested
ancestors, which share one exchange on the ancestor ``SPAN`` levels up; a group
then holds at most ``7 ** SPAN`` cells, however coarse the floor is. Full
ancestors of that level, a ``7 ** SPAN``-th of the rows, go through the same step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hexsupport.functions import bits
from hexsupport.operators.cells import SupportError, as_cells, settled, uncompact, whole_number
from hexsupport.sources.shared import written

SPAN = 4


def owners(cells: DataFrame, res: int, floor: int) -> DataFrame:
    """``(cell, owner)`` for distinct ``cells(cell)`` of one resolution."""
    if res <= floor:
        return cells.select("cell", F.col("cell").alias("owner"))
    top = max(floor, res - SPAN)
    levels = list(range(top, res))
    df = cells.select("cell", *(bits.parent(F.col("cell"), p).alias(f"a{p}") for p in levels))
    owner = F.col("cell")
    for k in reversed(range(len(levels))):
        p = levels[k]
        there = F.count("*").over(Window.partitionBy(*(f"a{q}" for q in levels[: k + 1])))
        df = df.withColumn(f"n{p}", there)
    for p in reversed(levels):
        owner = F.when(F.col(f"n{p}") == bits.child_count(F.col(f"a{p}"), res - p), F.col(f"a{p}")).otherwise(owner)
    df = df.select("cell", owner.alias("owner"))
    if top == floor:
        return df
    whole = cells.groupBy(bits.parent(F.col("cell"), top).alias("cell")).agg(F.count("*").alias("n"))
    whole = whole.filter(F.col("n") == bits.child_count(F.col("cell"), res - top)).select("cell")
    above = owners(whole, top, floor).select(F.col("cell").alias("owner"), F.col("owner").alias("above"))
    return df.join(above, "owner", "left").select("cell", F.coalesce("above", "owner").alias("owner"))


def compact(source: DataFrame, min_resolution: int | None = None, column: str = "h3", validate: bool = True) -> DataFrame:
    """The compacted set ``(h3)`` of a single-resolution source, sorted; empty in, empty out.

    ``min_resolution`` is the coarsest resolution allowed. Repeated cells count once.
    """
    res, cells = _source(source, column, validate)
    if min_resolution is not None:
        high = bits.FINEST if res is None else res
        min_resolution = whole_number(min_resolution, 0, high, f"`min_resolution` must be between 0 and {high}")
    if res is None:
        return source.sparkSession.createDataFrame([], "h3 string")
    found = owners(cells, res, min_resolution or 0)
    return found.select("owner").distinct().select(bits.to_text(F.col("owner")).alias("h3")).orderBy("h3")


def _source(source: DataFrame, column: str, validate: bool) -> tuple[int | None, DataFrame]:
    """The resolution of a source, None if it is empty, and its distinct ``cells(cell)``."""
    if validate:
        facts, cells = settled(source, "x", column, single="source ")
        return facts.finest, cells
    row = source.select(bits.resolution(bits.to_long(F.col(column))).alias("r")).limit(1).collect()
    return row[0].r if row else None, as_cells(source, column)


def owned(source: DataFrame, compacted: DataFrame, resolutions: list[int]) -> DataFrame:
    """``(cell, owner)``, owner null where no cell of ``compacted(cell)`` is the source cell or an ancestor; the finest wins.

    ``resolutions`` are those present in ``compacted`` (16 at most).
    """
    at = F.array(*(bits.parent(F.col("cell"), p) for p in resolutions))
    ancestors = source.select("cell", F.explode(F.filter(F.array_distinct(at), lambda a: bits.resolution(a) <= bits.resolution(F.col("cell")))).alias("owner"))
    best = ancestors.join(compacted.select(F.col("cell").alias("owner")), "owner").groupBy("cell").agg(F.max_by("owner", bits.resolution(F.col("owner"))).alias("owner"))
    return source.join(best, "cell", "left")


def relation(pairs: DataFrame) -> DataFrame:
    """The public form of ``(cell, owner)``."""
    cell, owner = F.col("cell"), F.col("owner")
    return pairs.select(
        bits.to_text(cell).alias("source_h3"), bits.resolution(cell).alias("source_resolution"), bits.to_text(owner).alias("compact_h3"),
        bits.resolution(owner).alias("compact_resolution"), F.when(cell == owner, "exact").otherwise("ancestor").alias("relationship"),
    )


def ownership(source: DataFrame, compacted: DataFrame, column: str = "h3", validate: bool = True) -> DataFrame:
    """One row per source cell: ``source_h3, source_resolution, compact_h3, compact_resolution, relationship``, sorted.

    The owner is the cell itself if compacted has it (``exact``), else its finest
    ancestor there (``ancestor``). Compacted cells that own nothing are left out.
    """
    if not validate:
        kept = as_cells(compacted, column)
        levels = sorted(r.r for r in kept.select(bits.resolution(F.col("cell")).alias("r")).distinct().collect())
        pairs = owned(as_cells(source, column), kept, levels)
    else:
        own, cells = settled(source, "source", column, empty_ok=False, single="")
        other, kept = settled(compacted, "compacted", column, empty_ok=False)
        if other.finest > own.finest:
            raise SupportError("`compacted` has cells finer than the source resolution")
        pairs = written(owned(cells, kept, sorted(other.levels)))
        lost = pairs.filter("owner IS NULL").count()
        if lost:
            raise SupportError(f"Source ownership is incomplete: {lost} cells without an owner")
    return relation(pairs).orderBy("source_h3")


def compact_and_own(source: DataFrame, min_resolution: int = 0, column: str = "h3", validate: bool = True) -> DataFrame:
    """The relation between a source and its own compaction, in one pass and unsorted."""
    res, cells = _source(source, column, validate)
    if res is None:
        raise SupportError("`source` must contain at least one cell")
    return relation(owners(cells, res, min_resolution))


def expanded(compacted: DataFrame, res: int, column: str = "h3") -> DataFrame:
    """The descendants ``(h3)`` of a compacted set at a resolution."""
    return uncompact(as_cells(compacted, column), res).select(bits.to_text(F.col("cell")).alias("h3"))
