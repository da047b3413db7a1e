"""Cell sets: checks, descendants, and the exceptions that bad arguments raise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hexsupport.functions import bits
from hexsupport.sources.shared import written


class SupportError(ValueError):
    """An argument or a table breaks an operator's contract."""


def whole_number(value, low: int, high: int | None, message: str) -> int:
    """``value`` as int if it is a whole number within bounds."""
    good = isinstance(value, (int, float)) and not isinstance(value, bool) and value == value and float(value).is_integer()
    if not good or value < low or (high is not None and value > high):
        raise SupportError(message)
    return int(value)


def as_cells(df: DataFrame, column: str = "h3") -> DataFrame:
    """The distinct cells of a text column as numbers ``cell``; text is taken in either case."""
    return df.select(bits.to_long(F.col(f"`{column}`")).alias("cell")).distinct()


def faults(df: DataFrame, column: str) -> list[Column]:
    """Aggregates over a text column: rows, missing, invalid, coarsest and finest resolution."""
    text = F.col(f"`{column}`")
    missing = text.isNull() | (text == "")
    cell = bits.to_long(text)
    return [
        F.count("*").alias("rows"),
        F.count_if(missing).alias("missing"),
        F.count_if(~missing & ~bits.is_valid(cell)).alias("invalid"),
        F.min(F.when(bits.is_valid(cell), bits.resolution(cell))).alias("coarsest"),
        F.max(F.when(bits.is_valid(cell), bits.resolution(cell))).alias("finest"),
    ]


def checked(df: DataFrame, what: str = "x", column: str = "h3", empty_ok: bool = True, single: str | None = None):
    """The facts of ``faults`` after checks in one pass: text type, no missing, all valid, and if ``single`` names it one resolution."""
    if column not in df.columns or dict(df.dtypes)[column] != "string":
        raise SupportError(f"`{what}` needs a character column of cells named `{column}`")
    found = df.agg(*faults(df, column)).first()
    _judge(found, what, empty_ok, single)
    return found


def _judge(found, what: str, empty_ok: bool, single: str | None) -> None:
    if not found.rows and not empty_ok:
        raise SupportError(f"`{what}` must contain at least one cell")
    if found.missing:
        raise SupportError(f"`{what}` has missing or empty cells: {found.missing}")
    if found.invalid:
        raise SupportError(f"`{what}` has invalid H3 indexes: {found.invalid}")
    if single and found.rows and found.coarsest != found.finest:
        raise SupportError(f"`{what}` must have a single {single}resolution, not {found.coarsest} to {found.finest}")


def settled(df: DataFrame, what: str = "x", column: str = "h3", empty_ok: bool = True, single: str | None = None):
    """(facts, cells): the checks of ``checked`` and the distinct ``cells(cell)``, from one pass whose result is written once."""
    if column not in df.columns or dict(df.dtypes)[column] != "string":
        raise SupportError(f"`{what}` needs a character column of cells named `{column}`")
    text = F.col(f"`{column}`")
    counted = df.select(bits.to_long(text).alias("cell"), (text.isNull() | (text == "")).alias("missing")).groupBy("cell", "missing").agg(F.count("*").alias("n"))
    counted = written(counted)
    cell, valid = F.col("cell"), bits.is_valid(F.col("cell"))
    facts = counted.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
        F.coalesce(F.sum(F.when(F.col("missing"), F.col("n"))), F.lit(0)).alias("missing"),
        F.coalesce(F.sum(F.when(~F.col("missing") & ~valid, F.col("n"))), F.lit(0)).alias("invalid"),
        F.min(F.when(valid, bits.resolution(cell))).alias("coarsest"),
        F.max(F.when(valid, bits.resolution(cell))).alias("finest"),
        F.collect_set(F.when(valid, bits.resolution(cell))).alias("levels"),
    ).first()
    _judge(facts, what, empty_ok, single)
    return facts, counted.select("cell")


def uncompact(cells: DataFrame, res: int, chunk: int = 5, carry: list[str] | None = None) -> DataFrame:
    """All descendants at ``res`` of ``cells(cell)``, with the columns ``carry``; cells already there stay.

    Descendants are made ``chunk`` levels at a time, so that no row explodes into
    more than ``7 ** chunk`` others at once.
    """
    res = whole_number(res, 0, bits.FINEST, "`res` must be between 0 and 15")
    carry = carry or []
    out = cells.select("cell", *carry)
    for step in range(0, res, chunk) if res else ():
        top = min(step + chunk, res)
        own = bits.resolution(F.col("cell"))
        lower = F.greatest(F.lit(0), F.lit(top) - own)
        numbers = F.sequence(F.lit(0).cast("long"), F.pow(F.lit(7.0), lower).cast("long") - 1)
        wide = out.filter(own >= top).unionByName(
            out.filter(own < top).select("cell", *carry, F.explode(numbers).alias("number")).select(bits.child(F.col("cell"), top, F.col("number")).alias("cell"), *carry).filter(bits.is_valid(F.col("cell")))
        )
        out = wide
    return out
