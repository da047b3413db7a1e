"""Cells against a polygon index: what meets, whose centre lies inside, how much is covered; and the nearest polygon."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hexsupport.functions import bits, grid, spaces
from hexsupport.functions.project import to_lng_lat
from hexsupport.operators.cells import uncompact
from hexsupport.operators.index import PAIRS, vectors
from hexsupport.operators.index import slices as _slices
from hexsupport.sources.shared import written

FEATURES = "cell long, poly long, within boolean, area double, share double"
#: Relative tolerance of equal distances, and of a centre on an edge.
EQUAL, ON_EDGE = 1e-9, 1e-12
#: How far from an edge ground beside it is looked at, as a share of its length, and the relative size of a turn that is none.
BESIDE, APART = 1e-6, 1e-11
#: Room for the difference between the sphere, on which the nearest is narrowed down, and the ellipsoid, on which it is measured.
ROUND = 1.012


def corners(cell: np.ndarray) -> np.ndarray:
    """Boundaries as longitude and latitude, anticlockwise, continuous over the antimeridian; the last corner fills up shorter ones."""
    lat, lng, n = grid.boundaries(cell)
    ring = np.stack([lng, lat], 2)
    last = ring[np.arange(len(cell)), n - 1]
    ring = np.where((np.arange(ring.shape[1]) < n[:, None])[..., None], ring, last[:, None])
    ring[..., 0] = ring[:, :1, 0] + (ring[..., 0] - ring[:, :1, 0] + 180) % 360 - 180
    return ring


def _pairs(left: np.ndarray, right: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, place on the left, place on the right) of all pairs of each row's two stretches, a bounded number at a time."""
    starts, row = np.cumsum(right) - right, np.repeat(np.arange(len(left)), left)
    ends = np.cumsum(right[row])
    k = 0
    while k < len(row):
        begun = int(ends[k - 1]) if k else 0
        until = max(k + 1, int(np.searchsorted(ends, begun + PAIRS, "right")))
        own = right[row[k:until]]
        first = np.repeat(np.arange(k, until), own)
        yield row[first], first, np.arange(len(first)) - np.repeat(ends[k:until] - own - begun, own) + starts[row[first]]
        k = until


def _flat(column: pd.Series, kind) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate([np.asarray(x, kind) for x in column]), np.array([len(x) for x in column], np.int64)


def settle(crs: int, areas: bool):
    """Cells below a border cell against its edges: all cells and edges of a batch at once."""
    place = spaces.space(crs)

    def judged(df: pd.DataFrame) -> pd.DataFrame:
        cell, many = _flat(df.cells, np.int64)
        flat, sizes = _flat(df.edges, float)
        edges, sizes = flat.reshape(-1, 4), sizes // 4
        owner = np.repeat(np.arange(len(df)), many)
        a, b = vectors(edges[:, :2], place), vectors(edges[:, 2:], place)
        lat, lng = grid.centres(cell)
        ring = corners(cell)
        coarse_lat, coarse_lng = grid.centres(df.coarse.to_numpy())
        if crs != 4326:  # one image of each meridian: that of the edges
            around = to_lng_lat(edges[np.cumsum(sizes) - sizes, :2], crs)[:, 0]
            coarse_lng = around + (coarse_lng - around + 180) % 360 - 180
            moved = around[owner] + (lng - around[owner] + 180) % 360 - 180
            ring[..., 0] += (moved - lng)[:, None]
            lng = moved
        ring[..., 0] += (360 * np.round((lng - ring[:, 0, 0]) / 360))[:, None]
        points = np.stack([lng, lat], 1)
        origin, at = place.at(np.stack([coarse_lng, coarse_lat], 1)), place.at(points)
        flat_ring = place.local(np.repeat(lng, 6).reshape(-1, 6), np.repeat(lat, 6).reshape(-1, 6), place.at(ring))
        reach = np.sqrt((flat_ring**2).sum(-1)).max(1)
        # areas are taken from a place in the cell that is as far from all edges as may be of three
        trial = [points + w * (ring[:, k] - points) + 0.07 * w * (ring[:, k - 1] - points) for w, k in ((0.0, 0), (0.31, 1), (0.29, 4))]
        trial_at = [place.at(t) for t in trial]
        odd = np.zeros((3, len(cell)), np.int64)
        close = np.full((3, len(cell)), np.inf)
        least = np.full(len(cell), np.inf)
        hit, held = np.zeros(len(cell), bool), []
        for row, own, edge in _pairs(many, sizes):
            for j in range(3 if areas else 1):
                odd[j] += np.bincount(own, spaces.crosses(origin[row], trial_at[j][own], a[edge], b[edge]), len(cell)).astype(np.int64)
            p, q = (place.local(lng[own], lat[own], v[edge]) for v in (a, b))
            near = spaces.from_segments(p, q)
            np.minimum.at(least, own, near)
            keep = near <= reach[own] * (1 + 1e-9)
            own, edge, p, q = own[keep], edge[keep], p[keep], q[keep]
            some = spaces.clip(p, q, flat_ring[own])[2]
            hit[own[some]] = True
            if areas:
                own, edge, p, q = own[some], edge[some], p[some], q[some]
                held.append((own, edge))
                for j in range(3):
                    shift = place.local(lng, lat, trial_at[j])[own]
                    np.minimum.at(close[j], own, spaces.from_segments(p - shift, q - shift))
        inside = df.inside.to_numpy(bool)[owner]
        around_centre = inside ^ (odd[0] % 2 == 1)
        size = np.abs(at[:, :2]).max(1) if crs != 4326 else 1.0
        within = around_centre & (least > ON_EDGE * np.maximum(size, 1.0))
        meets = hit | around_centre
        area, whole = np.full(len(cell), np.nan), np.ones(len(cell))
        if areas:
            best = close.argmin(0) if not held else np.where(np.isinf(close).all(0), 0, np.where(np.isinf(close), -1, close).argmax(0))
            rows = np.arange(len(cell))
            seat = np.stack(trial)[best, rows]
            metric = spaces.metres(np.repeat(lng, 6).reshape(-1, 6), np.repeat(lat, 6).reshape(-1, 6), ring) - spaces.metres(lng, lat, seat)[:, None]
            whole = spaces.ring_areas(metric)
            area = np.where(inside ^ (odd[best, rows] % 2 == 1), whole, 0.0)
            ends = to_lng_lat(edges.reshape(-1, 2), crs).reshape(-1, 4)
            for own, edge in held:
                p, q = (spaces.metres(lng[own], lat[own], ends[edge, k : k + 2]) - spaces.metres(lng[own], lat[own], seat[own]) for k in (0, 2))
                area -= np.bincount(own, spaces.shadows(p, q, metric[own]), len(cell))
            area = np.maximum(area, 0)
        out = pd.DataFrame({"cell": cell, "poly": df.poly.to_numpy()[owner], "within": within, "area": area, "share": area / whole})
        return out[meets]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            if len(df):
                yield judged(df)

    return run


def _above(cells: DataFrame, res: int) -> DataFrame:
    return cells.groupBy(bits.parent(F.col("cell"), res).alias("coarse")).agg(F.collect_list("cell").alias("cells"))


def features(cells: DataFrame, indexed: DataFrame, crs: int, finest: int, areas: bool = False) -> DataFrame:
    """``cell, poly, within, area, share`` of each of ``cells(cell)`` and polygon that meet: whether the centre lies inside and, if asked for, the overlap in square metres and as a share of the cell.

    Cells below an inner cell of the index are settled by an equi-join (their
    ``area`` stays null: their centre lies inside), those below a border cell by
    its edges. ``finest`` is the resolution of the border cells; no cell is coarser.
    """
    inner = indexed.filter("edges IS NULL").select(F.col("cell").alias("coarse"), "poly")
    levels = sorted(r[0] for r in inner.select(bits.resolution(F.col("coarse"))).distinct().collect())  # at most 16
    border = indexed.filter("edges IS NOT NULL").withColumnRenamed("cell", "coarse").join(_above(cells, finest), "coarse")
    found = _known(border.select("poly", "coarse", "inside", "edges", "cells").mapInPandas(settle(crs, areas), FEATURES))
    if levels:
        own = cells.select("cell", F.explode(F.array(*(bits.parent(F.col("cell"), r) for r in levels))).alias("coarse"))
        found = found.unionByName(_whole(own.join(inner, "coarse")))
    return found


def _known(found: DataFrame) -> DataFrame:
    """Areas that were not asked for are null."""
    return found.withColumns({c: F.nanvl(c, F.lit(None).cast("double")) for c in ("area", "share")})


def _whole(cells: DataFrame) -> DataFrame:
    """Cells that lie in a polygon whole."""
    return cells.select("cell", "poly", F.lit(True).alias("within"), F.lit(None).cast("double").alias("area"), F.lit(1.0).alias("share"))


def filled(indexed: DataFrame, res: int, finest: int, areas: bool = False) -> DataFrame:
    """As ``features``, of all cells of resolution ``res`` that meet a polygon of an index whose edges are great circles."""
    judge = settle(4326, areas)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            if len(df):
                coarse, place = np.unique(df.coarse.to_numpy(), return_inverse=True)
                below = coarse
                for _ in range(res - finest):
                    below = grid.children(below)
                below = below[np.argsort(grid.ancestor(below, finest), kind="stable")]
                lists = np.split(below, np.flatnonzero(np.diff(grid.ancestor(below, finest))) + 1)
                yield from judge(iter([df.assign(cells=[lists[k] for k in place])]))

    border = indexed.filter("edges IS NOT NULL").select("poly", F.col("cell").alias("coarse"), "inside", "edges")
    found = _known(border.mapInPandas(run, FEATURES))
    inner = uncompact(indexed.filter("edges IS NULL").select("cell", "poly"), res, carry=["poly"])
    return found.unionByName(_whole(inner))


# --- interiors that overlap


def overlapping(crs: int):
    """Which pairs of a border cell and a cell below it, of two polygons, show that their interiors overlap.

    Interiors overlap where an edge of one crosses an edge of the other, or where
    the ground just to the left of an edge of one, near its ends or half way, lies
    in the other. A cell without edges lies in its polygon whole, so there an edge
    of the other, or the centre in it, tells.
    """
    place = spaces.space(crs)

    def judged(df: pd.DataFrame) -> pd.DataFrame:
        n = len(df)
        cells = {k: df[f"{k}_cell"].to_numpy() for k in "ab"}
        edges, sizes, centre, flag = {}, {}, {}, {k: df[f"{k}_inside"].to_numpy(bool) for k in "ab"}
        none = np.empty(0)
        flat, many = _flat(df.a_edges, float)
        around = to_lng_lat(flat.reshape(-1, 4)[np.cumsum(many // 4) - many // 4, :2], crs)[:, 0]
        lat, lng = grid.centres(cells["a"])
        lng = around + (lng - around + 180) % 360 - 180
        reach = {}
        for k in "ab":
            flat, many = _flat(df[f"{k}_edges"].map(lambda e: none if e is None else e), float)
            sizes[k] = many // 4
            v, row = flat.reshape(-1, 4), np.repeat(np.arange(n), many // 4)
            # all in the plane at the centre of the upper cell
            edges[k] = [place.local(lng[row], lat[row], vectors(v[:, c : c + 2], place)) for c in (0, 2)]
            y, x = grid.centres(cells[k])
            points = np.stack([around + (x - around + 180) % 360 - 180, y], 1)
            centre[k] = place.local(lng, lat, place.at(points))
            r = np.zeros(n)
            level = cells[k] >> 52 & 15
            for res in np.unique(level).tolist():
                r[level == res] = place.radius(points[level == res], res)
            reach[k] = r
        found = np.zeros(n, bool)
        for row, i, j in _pairs(sizes["a"], sizes["b"]):
            p, q, r, s = edges["a"][0][i], edges["a"][1][i], edges["b"][0][j], edges["b"][1][j]
            d1, d2 = spaces.cross2(q - p, r - p), spaces.cross2(q - p, s - p)
            d3, d4 = spaces.cross2(s - r, p - r), spaces.cross2(s - r, q - r)
            eps = APART * np.sqrt(((q - p) ** 2).sum(1) * ((s - r) ** 2).sum(1))
            found[row[(np.minimum(d1, d2) < -eps) & (np.maximum(d1, d2) > eps) & (np.minimum(d3, d4) < -eps) & (np.maximum(d3, d4) > eps)]] = True
        for one, other in (("a", "b"), ("b", "a")):
            # ground beside the edges of one, where it is within reach of the other's cell, against the other's edges
            p, q = edges[one]
            row = np.repeat(np.arange(n), sizes[one])
            d = q - p
            left = np.stack([-d[:, 1], d[:, 0]], 1) * BESIDE
            points = np.concatenate([p + t * d + left for t in (BESIDE * 100, 0.5, 1 - BESIDE * 100)])
            row = np.tile(row, 3)
            near = np.sqrt(((points - centre[other][row]) ** 2).sum(1)) <= reach[other][row] * (1 - 1e-3)
            points, row = points[near], row[near]
            if len(points):
                odd, at = np.zeros(len(points), np.int64), np.concatenate([centre[other][row], points], 1)
                for k, j in _slices(sizes[other][row], (np.cumsum(sizes[other]) - sizes[other])[row]):
                    odd += np.bincount(k, spaces.crosses(*(_raised(v) for v in (at[k, :2], at[k, 2:], edges[other][0][j], edges[other][1][j]))), len(points)).astype(np.int64)
                found[row[flag[other][row] ^ (odd % 2 == 1)]] = True
        # a lower cell that lies in its polygon whole, and whose centre lies in the other
        whole = np.flatnonzero((sizes["b"] == 0) & ~found)
        odd = np.zeros(len(whole), np.int64)
        for k, j in _slices(sizes["a"][whole], (np.cumsum(sizes["a"]) - sizes["a"])[whole]):
            odd += np.bincount(k, spaces.crosses(*(_raised(v) for v in (centre["a"][whole[k]], centre["b"][whole[k]], edges["a"][0][j], edges["a"][1][j]))), len(whole)).astype(np.int64)
        found[whole[flag["a"][whole] ^ (odd % 2 == 1)]] = True
        return df.loc[found, ["a", "b"]].drop_duplicates()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            for k in range(0, len(df), 2048):
                yield judged(df.iloc[k : k + 2048].reset_index(drop=True))

    return run


def _raised(v: np.ndarray) -> np.ndarray:
    return np.concatenate([v, np.ones((len(v), 1))], 1)


# --- the nearest polygon


def _pyramid(cells: DataFrame, levels: list[int], crs: int) -> dict[int, DataFrame]:
    """For each level the distinct ancestors of ``cells(cell)``: ``above`` (the ancestor one step up), ``cell, x, y, z, r`` (centre and radius in the space)."""
    place = spaces.space(crs)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            cell = df.cell.to_numpy()
            lat, lng = grid.centres(cell)
            points = np.stack([lng, lat], 1)
            level, r = cell >> 52 & 15, np.zeros(len(cell))
            for res in np.unique(level).tolist():
                r[level == res] = place.radius(points[level == res], res)
            with np.errstate(all="ignore"):
                at = place.at(points)
            wild = ~np.isfinite(at).all(1)
            at[wild], r[wild] = 0, np.inf
            yield pd.DataFrame({"cell": cell, "x": at[:, 0], "y": at[:, 1], "z": at[:, 2], "r": r})

    own = cells.select(F.explode(F.array(*(bits.parent(F.col("cell"), r) for r in levels))).alias("cell")).distinct()
    table = written(own.mapInPandas(run, "cell long, x double, y double, z double, r double"))
    out = {}
    for k, res in enumerate(levels):
        level = table.filter(bits.resolution(F.col("cell")) == res)
        out[res] = level.withColumn("above", bits.parent(F.col("cell"), levels[k - 1])) if k else level
    return out


def _bounds(crs: int) -> tuple[Column, Column]:
    """Least and greatest distance of a place below a cell ``g`` from the nearest edge near a cell ``c``."""
    chord = F.sqrt(F.pow(F.col("gx") - F.col("cx"), 2) + F.pow(F.col("gy") - F.col("cy"), 2) + F.pow(F.col("gz") - F.col("cz"), 2))
    apart, slack = (2 * F.asin(F.least(chord / 2, F.lit(1.0))), ROUND) if crs == 4326 else (chord, 1 + EQUAL)
    around = F.col("gr") + F.col("cr")
    return F.greatest(apart - around, F.lit(0.0)) / slack, (apart + around) * slack


def _measure(crs: int):
    """The distance of each cell's centre from each polygon's edges near a border cell: metres on the ellipsoid, or lengths of the plane."""
    place = spaces.space(crs)

    def measured(df: pd.DataFrame) -> pd.DataFrame:
        cell, many = _flat(df.cells, np.int64)
        flat, sizes = _flat(df.edges, float)
        edges, sizes = flat.reshape(-1, 4), sizes // 4
        owner = np.repeat(np.arange(len(df)), many)
        a, b = vectors(edges[:, :2], place), vectors(edges[:, 2:], place)
        lat, lng = grid.centres(cell)
        at = place.at(np.stack([lng, lat], 1))
        best = np.full(len(cell), np.inf)
        for _, own, edge in _pairs(many, sizes):
            far = place.far(at[own], a[edge], b[edge])
            if crs == 4326:  # the sphere tells which edges may be nearest
                least = np.full(len(cell), np.inf)
                np.minimum.at(least, own, far)
                keep = far <= least[own] * ROUND + 1e-12
                own, edge = own[keep], edge[keep]
                p, q = (spaces.metres(lng[own], lat[own], edges[edge, k : k + 2]) for k in (0, 2))
                far = spaces.from_segments(p, q)
            np.minimum.at(best, own, far)
        out = pd.DataFrame({"cell": cell, "poly": df.poly.to_numpy()[owner], "dist": best})
        # what is farther than another polygon of this batch is not the nearest
        return out[out.dist <= out.groupby("cell").dist.transform("min") * (1 + EQUAL)]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            if len(df):
                yield measured(df)

    return run


def nearest(cells: DataFrame, indexed: DataFrame, crs: int, finest: int) -> DataFrame:
    """``cell, poly, dist, tied``: the polygon nearest to the centre of each of ``cells(cell)``, none of which meets one, and how many are as near.

    Cells and border cells are narrowed down together, from coarse to fine: a
    pair of coarse cells stays while the least distance between what lies below
    them is not beyond the greatest distance to the nearest border cell known;
    then it is replaced by the pairs of their finer cells. All steps are
    equi-joins; what is compared last are cells and the edges of the few border
    cells that no bound rules out. No polygon goes through the driver or to all tasks.
    """
    levels = sorted({0, *range(finest, -1, -2)})
    border = indexed.filter("edges IS NOT NULL")
    groups, goals = _pyramid(cells, levels, crs), _pyramid(border.select("cell"), levels, crs)
    low, high = _bounds(crs)

    def kept(pairs: DataFrame) -> DataFrame:
        ranked = pairs.withColumn("low", low).withColumn("high", F.min(high).over(Window.partitionBy("g")))
        return ranked.filter("low <= high").select("g", "c")

    def named(df: DataFrame, k: str, *more: str) -> DataFrame:
        return df.select(F.col("cell").alias(k), *(F.col(c).alias(f"{k}{c}") for c in ("x", "y", "z", "r")), *more)

    tops = [F.struct(*(F.lit(v).alias(k) for k, v in zip(("c", "cx", "cy", "cz", "cr"), r, strict=True))) for r in goals[0].select("cell", "x", "y", "z", "r").collect()]  # at most 122
    pairs = kept(named(groups[0], "g").withColumn("top", F.explode(F.array(*tops))).select("g", "gx", "gy", "gz", "gr", "top.*"))
    for res in levels[1:]:
        finer = pairs.withColumnsRenamed({"g": "gabove", "c": "cabove"})
        finer = finer.join(named(groups[res], "g", F.col("above").alias("gabove")), "gabove").join(named(goals[res], "c", F.col("above").alias("cabove")), "cabove")
        pairs = kept(finer)
    last = written(pairs)
    lists = _above(cells, finest).withColumnRenamed("coarse", "g")
    met = last.join(lists, "g").join(border.select(F.col("cell").alias("c"), "poly", "edges"), "c").select("poly", "edges", "cells").mapInPandas(_measure(crs), "cell long, poly long, dist double")
    per = met.groupBy("cell", "poly").agg(F.min("dist").alias("dist"))
    least = per.groupBy("cell").agg(F.min("dist").alias("least"))
    near = per.join(least, "cell").filter(F.col("dist") <= F.col("least") * (1 + EQUAL))
    return near.groupBy("cell").agg(F.min_by("poly", F.struct("dist", "poly")).alias("poly"), F.min("dist").alias("dist"), F.count("*").alias("tied"))
