"""Polygons as well-known binary, the form in which tables and files of geometry usually hold them.

Read are POLYGON and MULTIPOLYGON in either byte order, also extended ones (with
the number of a reference system) and ones with heights or measures, which are
left out. Written are little-endian POLYGON or MULTIPOLYGON.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hexsupport.sources.fixtures import GEOMETRY

#: Fixed values of the format: kinds, and flags of the extended form.
POLYGON, MULTIPOLYGON = 3, 6
HAS_Z, HAS_M, HAS_SRID = 0x80000000, 0x40000000, 0x20000000


def _header(data: bytes, at: int) -> tuple[str, int, int, int]:
    """(byte order, kind, numbers a point, place after)."""
    if at >= len(data) or data[at] > 1:
        raise ValueError("not well-known binary")
    order = "<" if data[at] else ">"
    (code,) = struct.unpack_from(f"{order}I", data, at + 1)
    at += 9 if code & HAS_SRID else 5
    flat = code & 0x0FFFFFFF
    more = flat // 1000  # 1: heights, 2: measures, 3: both
    size = 2 + (bool(code & HAS_Z) or more in (1, 3)) + (bool(code & HAS_M) or more in (2, 3))
    return order, flat % 1000, size, at


def _polygon(data: bytes, at: int) -> tuple[list, int]:
    order, kind, size, at = _header(data, at)
    if kind != POLYGON:
        raise ValueError(f"geometry of kind {kind}; only polygons are read")
    (rings,) = struct.unpack_from(f"{order}I", data, at)
    out, at = [], at + 4
    for _ in range(rings):
        (n,) = struct.unpack_from(f"{order}I", data, at)
        points = np.frombuffer(data, f"{order}f8", n * size, at + 4).reshape(n, size)
        out.append(points[:, :2].tolist())
        at += 4 + n * size * 8
    return out, at


def decoded(data: bytes) -> list:
    """Nested lists (polygon, ring, point, coordinate) of one geometry."""
    try:
        order, kind, _, at = _header(data, 0)
        if kind == POLYGON:
            out, at = _polygon(data, 0)
            out = [out] if out else []
        elif kind == MULTIPOLYGON:
            (parts,) = struct.unpack_from(f"{order}I", data, at)
            out, at = [], at + 4
            for _ in range(parts):
                polygon, at = _polygon(data, at)
                out.append(polygon)
        else:
            raise ValueError(f"geometry of kind {kind}; only polygons are read")
    except struct.error:
        raise ValueError("well-known binary ends early") from None
    if at != len(data):
        raise ValueError("well-known binary has bytes left over")
    return out


def encoded(geometry, srid: int | None = None) -> bytes:
    """The bytes of nested lists: a polygon if there is just one, else a multipolygon."""

    def begin(kind: int, outer: bool) -> bytes:
        marked = outer and srid is not None
        return struct.pack("<BI", 1, kind | (HAS_SRID if marked else 0)) + (struct.pack("<I", srid) if marked else b"")

    def polygon(rings, outer: bool) -> bytes:
        parts = [begin(POLYGON, outer), struct.pack("<I", len(rings))]
        for ring in rings:
            points = np.array([list(p) for p in ring], "<f8").reshape(-1, 2)
            parts += [struct.pack("<I", len(points)), points.tobytes()]
        return b"".join(parts)

    if len(geometry) == 1:
        return polygon(geometry[0], True)
    return begin(MULTIPOLYGON, True) + struct.pack("<I", len(geometry)) + b"".join(polygon(p, False) for p in geometry)


def _mapped(df: DataFrame, source: str, target: str, kind: str, turn) -> DataFrame:
    rest = [c for c in df.columns if c.lower() != target.lower()]
    wide = df.select(*(F.col(f"`{c}`") for c in rest), F.col(f"`{source}`").alias("_source_of_geometry"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            made = pd.Series([None if g is None else turn(g) for g in frame["_source_of_geometry"]], index=frame.index, dtype=object)
            yield frame[rest].assign(**{target: made})

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*(F.col(f"`{c}`") for c in rest)).schema)
    return wide.mapInPandas(run, f"{schema}{', ' if schema else ''}`{target}` {kind}")


def from_wkb(df: DataFrame, source: str = "wkb", target: str = "geometry") -> DataFrame:
    """``df`` with ``target``, the nested arrays of the binary column ``source``.

    Null stays null; an empty geometry is an empty array; other kinds and broken
    bytes are an error. A column of the name ``target`` is replaced.
    """
    return _mapped(df, source, target, GEOMETRY, lambda g: decoded(bytes(g)))


def to_wkb(df: DataFrame, source: str = "geometry", target: str = "wkb", srid: int | None = None) -> DataFrame:
    """``df`` with the binary column ``target`` of the nested arrays ``source``; with ``srid``, in the extended form."""
    return _mapped(df, source, target, "binary", lambda g: encoded(g, srid))
