"""Rollup of source tables to compact owners: sums and sorted distinct values, with conservation checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hexsupport.functions import bits
from hexsupport.operators.cells import SupportError, faults
from hexsupport.sources.shared import written

KEYS = ("compact_h3", "compact_resolution", "source_cell_n")
RELATION = ("source_h3", "source_resolution", "compact_h3", "compact_resolution", "relationship")
SEPARATOR = "; "
#: Relative tolerance of conserved sums.
CLOSE = 2.0**-26


def _names(values, what: str) -> list[str]:
    values = [values] if isinstance(values, str) else list(values or [])
    if any(not isinstance(v, str) or not v for v in values):
        raise SupportError(f"`{what}` must be a character vector without missing or empty names")
    return list(dict.fromkeys(values))


def _arguments(data: DataFrame, relation: DataFrame, sums: list[str], collapses: list[str], column: str) -> None:
    if not sums and not collapses:
        raise SupportError("At least one field must be given in `sum` or `collapse`")
    if column not in data.columns:
        raise SupportError(f"Cell column `{column}` was not found in `data`")
    both = sorted(set(sums) & set(collapses))
    if both:
        raise SupportError(f"Fields cannot be both summed and collapsed: {both}")
    lost = [f for f in sums + collapses if f not in data.columns]
    if lost:
        raise SupportError(f"Fields were not found in `data`: {lost}")
    if column in sums + collapses:
        raise SupportError(f"`{column}` cannot be aggregated itself")
    made = [*sums, *collapses, *(f"{f}_n" for f in collapses)]
    if set(made) & set(KEYS) or len(set(made)) < len(made):
        raise SupportError(f"Results would overwrite existing columns: {sorted(set(made) & set(KEYS)) or made}")
    text = [f for f in sums if not isinstance(data.schema[f].dataType, T.NumericType)]
    if text:
        raise SupportError(f"Sum fields must be numeric: {text}")
    lost = [c for c in RELATION if c not in relation.columns]
    if lost:
        raise SupportError(f"`lookup` lacks columns: {lost}")


def _contents(data: DataFrame, relation: DataFrame, sums: list[str], column: str) -> None:
    """Tells what is wrong with the rows, check by check; called only where the joined rows show that something is."""
    gaps = [F.count_if(F.col(f"`{f}`").isNull() | F.isnan(F.col(f"`{f}`").cast("double"))).alias(f"gap{k}") for k, f in enumerate(sums)]
    found = data.agg(*faults(data, column), F.count_distinct(F.lower(f"`{column}`")).alias("kinds"), *gaps).first()
    if not found.rows:
        raise SupportError("`data` must contain at least one row")
    if found.missing or found.invalid:
        raise SupportError(f"`data` has missing or invalid H3 indexes: {found.missing + found.invalid}")
    if found.kinds < found.rows:
        raise SupportError("Duplicate source cells in `data`")
    bad = [f for k, f in enumerate(sums) if found[f"gap{k}"]]
    if bad:
        raise SupportError(f"Missing values in sum fields: {bad}")
    held = relation.agg(F.count("*").alias("rows"), F.count_distinct("source_h3").alias("kinds"), *(F.count_if(F.col(c).isNull()).alias(f"gap_{c}") for c in RELATION)).first()
    if any(held[f"gap_{c}"] for c in RELATION):
        raise SupportError("Missing values in `lookup`")
    if held.kinds < held.rows:
        raise SupportError("Duplicate source cells in `lookup`")
    own = data.select(F.lower(f"`{column}`").alias("source_h3"), F.lit(1).alias("l"))
    sides = own.join(relation.select("source_h3", F.lit(1).alias("r")), "source_h3", "full").agg(F.count_if(F.col("l").isNull() | F.col("r").isNull()).alias("n")).first()
    if sides.n:
        raise SupportError(f"`data` and `lookup` must have the same authoritative source cells; {sides.n} differ")


def _as_text(data: DataFrame, field: str):
    """Values as text; whole floating numbers lose their ``.0``."""
    text = F.col(f"`{field}`").cast("string")
    if isinstance(data.schema[field].dataType, (T.DoubleType, T.FloatType)):
        whole = F.col(f"`{field}`") == F.floor(f"`{field}`")
        return F.when(whole & (F.abs(f"`{field}`") < 1e15), F.col(f"`{field}`").cast("long").cast("string")).otherwise(text)
    return text


def rollup(data: DataFrame, relation: DataFrame, sum=None, collapse=None, column: str = "h3", validate: bool = True) -> DataFrame:  # noqa: A002
    """One row per owner, sorted: ``compact_h3, compact_resolution, source_cell_n``, the sums, then each collapsed field and its ``<field>_n``.

    Sums are doubles. A collapsed field holds its distinct non-null values as
    text in binary order joined by ``"; "``, null where there are none, and
    ``_n`` counts them.
    """
    sums, collapses = _names(sum, "sum"), _names(collapse, "collapse")
    _arguments(data, relation, sums, collapses, column)
    rows = data.select(F.lower(f"`{column}`").alias("source_h3"), *(F.col(f"`{f}`").cast("double").alias(f"s{k}") for k, f in enumerate(sums)), *(_as_text(data, f).alias(f"c{k}") for k, f in enumerate(collapses)))
    if validate:
        joined, before = _joined(rows, relation, len(sums))
        if before is None:
            _contents(data, relation, sums, column)
            raise SupportError("`data` and `lookup` do not fit together")
    else:
        joined = rows.join(relation.select("source_h3", "compact_h3", "compact_resolution"), "source_h3")
    aggs = [F.count("*").cast("int").alias("source_cell_n"), *(F.sum(f"s{k}").alias(f"s{k}") for k in range(len(sums))), *(F.array_sort(F.collect_set(f"c{k}")).alias(f"c{k}") for k in range(len(collapses)))]
    grouped = joined.groupBy("compact_h3", "compact_resolution").agg(*aggs)
    columns = [*KEYS, *(F.col(f"s{k}").alias(f) for k, f in enumerate(sums))]
    for k, f in enumerate(collapses):
        columns += [F.when(F.size(f"c{k}") > 0, F.array_join(f"c{k}", SEPARATOR)).alias(f), F.size(f"c{k}").cast("int").alias(f"{f}_n")]
    out = grouped.select(*columns)
    if validate:
        out = written(out)
        conserved(before, out, sums)
    return out.orderBy("compact_h3")


def _joined(rows: DataFrame, relation: DataFrame, n_sums: int):
    """(rows with their owners, their number and sums): joined and written once; the sums are None where any check fails."""
    own = relation.select(*RELATION, F.lit(1).alias("r"))
    both = rows.withColumn("l", F.lit(1)).join(own, "source_h3", "full")
    # the window goes by the join's key, so that nothing is dealt again
    both = both.withColumn("times", F.count("*").over(Window.partitionBy("source_h3")))
    gap = reduce(lambda a, c: a | F.col(c).isNull(), ("source_resolution", "compact_h3", "compact_resolution", "relationship", "l", "r"), F.col("source_h3").isNull())
    gap = reduce(lambda a, k: a | F.col(f"s{k}").isNull() | F.isnan(f"s{k}"), range(n_sums), gap | (F.col("times") > 1) | ~bits.is_valid(bits.to_long(F.col("source_h3"))))
    both = written(both.withColumn("bad", gap).drop("source_resolution", "relationship", "l", "r", "times"))
    facts = both.agg(F.count("*").alias("n"), F.count_if("bad").alias("bad"), *(F.sum(f"s{k}").alias(f"s{k}") for k in range(n_sums))).first()
    return both, (facts if facts.n and not facts.bad else None)


def conserved(before, out: DataFrame, sums: list[str]) -> None:
    """Raises unless every source row and every sum is found in the owners once."""
    after = out.agg(F.sum("source_cell_n").alias("n"), *(F.sum(f"`{f}`").alias(f"s{k}") for k, f in enumerate(sums))).first()
    if (after.n or 0) != before.n:
        raise SupportError(f"{before.n} source rows became {after.n}")
    for k, f in enumerate(sums):
        if abs(after[f"s{k}"] - before[f"s{k}"]) > CLOSE * max(abs(before[f"s{k}"]), 1.0):
            raise SupportError(f"The sum of `{f}` is not conserved: {before[f's{k}']} became {after[f's{k}']}")


def reconcile(data: DataFrame, out: DataFrame, sums: list[str], by: list[str] | None = None) -> DataFrame:
    """Totals before and after a rollup: ``field, source_total, owner_total`` (one row per sum), optionally by columns that both have."""
    by = by or []

    def totals(df: DataFrame, name: str) -> DataFrame:
        grouped = df.groupBy(*by).agg(*(F.sum(F.col(f"`{f}`").cast("double")).alias(f) for f in sums))
        return reduce(DataFrame.unionByName, [grouped.select(*by, F.lit(f).alias("field"), F.col(f"`{f}`").alias(name)) for f in sums])

    return totals(data, "source_total").join(totals(out, "owner_total"), [*by, "field"], "full")


def text_cells(df: DataFrame, key: str, res: int = 9, base: int = 95, column: str = "h3") -> DataFrame:
    """``df`` with a cell column made from consecutive numbers."""
    return df.withColumn(column, bits.to_text(bits.from_number(F.col(f"`{key}`"), res, base)))
