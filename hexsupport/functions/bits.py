"""Hexagonal cell ids as 64-bit numbers: pure column expressions.

Layout, from the top: 0, mode (4 bits, 1 for cells), reserved (3 bits), resolution
(4 bits), base cell (7 bits), fifteen 3-bit digits; digits beyond the resolution are 7.
Public ids are lower-case hexadecimal text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The base cells at the icosahedron's corners.
PENTAGONS = (4, 14, 24, 38, 49, 58, 63, 72, 83, 97, 107, 117)
FINEST = 15
_LOWEST_BITS = sum(1 << 3 * k for k in range(FINEST))


def _lit(value: int) -> Column:
    return F.lit(value).cast("long")


def to_long(text: Column) -> Column:
    """The number of a hexadecimal id; null for anything else."""
    return F.when(text.rlike("^[0-9a-fA-F]{1,16}$"), F.conv(text, 16, 10).try_cast("long"))


def to_text(cell: Column) -> Column:
    return F.lower(F.hex(cell))


def resolution(cell: Column) -> Column:
    return F.shiftright(cell, 52).bitwiseAND(_lit(15)).cast("int")


def base_cell(cell: Column) -> Column:
    return F.shiftright(cell, 45).bitwiseAND(_lit(127)).cast("int")


def _ones(bits: Column) -> Column:
    """A number of ``bits`` one bits."""
    return F.call_function("shiftleft", _lit(1), bits) - 1


def _unused(res: Column) -> Column:
    """The digits beyond a resolution, all ones."""
    return _ones((FINEST - res) * 3)


def _used_digits(cell: Column, res: Column) -> Column:
    return F.call_function("shiftright", cell.bitwiseAND(_lit((1 << 45) - 1)), (FINEST - res) * 3)


def leading_digit(cell: Column) -> Column:
    """The first digit that is not 0, or 0."""
    used = _used_digits(cell, resolution(cell))
    place = F.floor((F.length(F.bin(used)) - 1) / 3).cast("int") * 3
    return F.when(used == 0, 0).otherwise(F.call_function("shiftright", used, place).bitwiseAND(_lit(7)).cast("int"))


def is_valid(cell: Column) -> Column:
    """Whether a number is a cell: mode, reserved bits, base cell, digits, and no deleted axis around a pentagon. Null is not."""
    sevens = cell.bitwiseAND(F.shiftright(cell, 1)).bitwiseAND(F.shiftright(cell, 2)).bitwiseAND(_lit(_LOWEST_BITS))
    digits = sevens == _unused(resolution(cell)).bitwiseAND(_lit(_LOWEST_BITS))
    deleted = base_cell(cell).isin(*PENTAGONS) & (leading_digit(cell) == 1)
    return F.coalesce((F.shiftright(cell, 56) == 8) & (base_cell(cell) <= 121) & digits & ~deleted, F.lit(False))


def is_pentagon(cell: Column) -> Column:
    return base_cell(cell).isin(*PENTAGONS) & (leading_digit(cell) == 0)


def parent(cell: Column, res: int | Column) -> Column:
    """The ancestor at a resolution that is not finer than the cell's."""
    res = F.lit(res) if isinstance(res, int) else res
    bare = cell.bitwiseAND(_lit(~(15 << 52)))
    return bare.bitwiseOR(F.call_function("shiftleft", res.cast("long"), F.lit(52))).bitwiseOR(_unused(res))


def child_count(cell: Column, levels: int | Column) -> Column:
    """How many descendants a cell has so many levels below."""
    if isinstance(levels, int):
        return F.when(is_pentagon(cell), _lit(1 + 5 * (7**levels - 1) // 6)).otherwise(_lit(7**levels))
    whole = F.pow(F.lit(7.0), levels).cast("long")
    return F.when(is_pentagon(cell), ((whole - 1) / 6).cast("long") * 5 + 1).otherwise(whole)


def child(cell: Column, res: int, number: Column) -> Column:
    """The descendant at ``res`` whose digits below the cell are ``number`` in base 7 (for pentagons some do not exist)."""
    own = resolution(cell)
    bare = cell.bitwiseAND(_lit(~(15 << 52))).bitwiseAND(F.bitwise_not(_unused(own)))
    place = lambda j: F.call_function("shiftleft", F.floor(number / 7**j).cast("long") % 7, F.lit(3 * (FINEST - res + j)))
    digits = reduce(lambda a, j: a.bitwiseOR(F.when(F.lit(j) < F.lit(res) - own, place(j)).otherwise(_lit(0))), range(res), _lit(0))
    return bare.bitwiseOR(_lit(res << 52)).bitwiseOR(digits).bitwiseOR(_lit((1 << 3 * (FINEST - res)) - 1))


def from_number(key: Column, res: int = 9, base: int = 95) -> Column:
    """The cell of a base cell whose digits are ``key`` in base 7; consecutive keys fill whole parents."""
    digits = reduce(lambda a, i: a.bitwiseOR(F.call_function("shiftleft", F.floor(key / 7 ** (res - i)).cast("long") % 7, F.lit(3 * (FINEST - i)))), range(1, res + 1), _lit(0))
    return _lit((1 << 59) | (res << 52) | (base << 45) | ((1 << 3 * (FINEST - res)) - 1)).bitwiseOR(digits)
