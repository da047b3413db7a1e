"""Plane geometry in numpy. A shape is a list of polygons, each a list of rings (n x 2), the first the shell."""

from __future__ import annotations

import numpy as np

Shape = list[list[np.ndarray]]


def shape_of(nested) -> Shape:
    """From nested lists (multipolygon, polygon, ring, point); closing points are left out."""
    out = []
    for polygon in nested:
        rings = [np.array([list(p) for p in ring], float).reshape(-1, 2) for ring in polygon]
        out.append([r[:-1] if len(r) > 1 and (r[0] == r[-1]).all() else r for r in rings])
    return out


def mapped(shape: Shape, to) -> Shape:
    return [[to(ring) for ring in polygon] for polygon in shape]


def rings(shape: Shape) -> list[np.ndarray]:
    return [ring for polygon in shape for ring in polygon]


def edges(shape: Shape) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of every edge."""
    own = rings(shape)
    return np.concatenate(own), np.concatenate([np.roll(r, -1, axis=0) for r in own])


def box(shape: Shape) -> tuple[float, float, float, float]:
    p = np.concatenate(rings(shape))
    return (*p.min(axis=0), *p.max(axis=0))


def _cross(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a[..., 0] * b[..., 1] - a[..., 1] * b[..., 0]


def _odd(p: np.ndarray, q: np.ndarray, points: np.ndarray) -> np.ndarray:
    x, y = points[:, :1], points[:, 1:]
    over = (p[:, 1] > y) != (q[:, 1] > y)
    with np.errstate(divide="ignore", invalid="ignore"):
        at = p[:, 0] + (y - p[:, 1]) / (q[:, 1] - p[:, 1]) * (q[:, 0] - p[:, 0])
    return (over & (x < at)).sum(axis=1) % 2 == 1


def inside(shape: Shape, points: np.ndarray) -> np.ndarray:
    """Whether points lie inside (even-odd rule; on an edge: undefined)."""
    p, q = edges(shape)
    if len(p) * len(points) <= PAIRS:
        return _odd(p, q, points)
    # bands of points in the order of their heights, each with the edges that reach its heights
    order = np.argsort(points[:, 1])
    low, high = np.minimum(p[:, 1], q[:, 1]), np.maximum(p[:, 1], q[:, 1])
    band = max(1, min(PAIRS // len(p), len(points)), len(points) // 1000)
    out = np.zeros(len(points), bool)
    for k in range(0, len(points), band):
        own = order[k : k + band]
        there = (high >= points[own[0], 1]) & (low <= points[own[-1], 1])
        for m in range(0, len(own), turn := max(1, PAIRS // max(1, int(there.sum())))):
            out[own[m : m + turn]] = _odd(p[there], q[there], points[own[m : m + turn]])
    return out


def distance(shape: Shape, points: np.ndarray) -> np.ndarray:
    """Distance of points from the edges."""
    p, q = edges(shape)
    d = q - p
    size = np.maximum((d * d).sum(axis=1), 1e-300)
    turn, out = max(1, PAIRS // len(p)), []
    for k in range(0, len(points), turn):
        own = points[k : k + turn]
        t = np.clip(((own[:, None] - p) * d).sum(axis=2) / size, 0, 1)
        out.append(np.sqrt((((p + t[..., None] * d) - own[:, None]) ** 2).sum(axis=2)).min(axis=1))
    return np.concatenate(out) if out else np.empty(0)


def on_edge(shape: Shape, points: np.ndarray, close: float = 1e-12) -> np.ndarray:
    return distance(shape, points) <= close * max(1.0, np.abs(points).max(initial=0))


#: Pairs of edges, or of points and edges, that are looked at together, and edges that are compared each with each.
PAIRS, LEAF = 1 << 18, 64


def _cross_at(p: np.ndarray, q: np.ndarray, r: np.ndarray, s: np.ndarray, proper: bool) -> bool:
    d1, d2 = _cross(q - p, r - p), _cross(q - p, s - p)
    d3, d4 = _cross(s - r, p - r), _cross(s - r, q - r)
    if proper:
        eps = 1e-12 * np.maximum(np.abs(q - p).max(axis=-1), 1e-300) * np.maximum(np.abs(s - r).max(axis=-1), 1e-300)
        return bool((((d1 > eps) & (d2 < -eps)) | ((d1 < -eps) & (d2 > eps))).__and__(((d3 > eps) & (d4 < -eps)) | ((d3 < -eps) & (d4 > eps))).any())
    apart = (np.maximum(p, q) < np.minimum(r, s)).any(axis=-1) | (np.maximum(r, s) < np.minimum(p, q)).any(axis=-1)
    return bool((~apart & (d1 * d2 <= 0) & (d3 * d4 <= 0)).any())


def _in_box(p: np.ndarray, q: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Which edges come into a box, borders included; a few that pass a corner closely may be named too."""
    near = ((np.minimum(p, q) <= high) & (np.maximum(p, q) >= low)).all(axis=1)
    # of these, all corners of the box on one side of the edge's line: the edge passes by
    d, centre, half = q - p, (low + high) / 2, (high - low) / 2
    off = np.abs(_cross(d, centre - p))
    return near & (off <= (np.abs(d[:, 0]) * half[1] + np.abs(d[:, 1]) * half[0]) * (1 + 1e-9) + 1e-300)


def crossing(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], proper: bool = False) -> bool:
    """Whether edges meet; ``proper``: whether any two cross in a point inside both.

    The plane is halved until few edges are left in each part, so that the memory
    needed is a few numbers for each edge, however many there are.
    """
    both = np.concatenate([a[0], a[1], b[0], b[1]])
    todo = [(*a, *b, both.min(axis=0), both.max(axis=0), 0)] if len(a[0]) and len(b[0]) else []
    while todo:
        p, q, r, s, low, high, depth = todo.pop()
        if len(p) * len(r) <= LEAF**2 or depth == 48:
            turn = max(1, PAIRS // len(r))
            for k in range(0, len(p), turn):
                if _cross_at(p[k : k + turn, None], q[k : k + turn, None], r[None], s[None], proper):
                    return True
            continue
        axis = int(np.argmax(high - low))
        middle = (low[axis] + high[axis]) / 2
        for side in range(2):
            lo, hi = low.copy(), high.copy()
            (hi if side == 0 else lo)[axis] = middle
            i, j = _in_box(p, q, lo, hi), _in_box(r, s, lo, hi)
            if i.any() and j.any():
                todo.append((p[i], q[i], r[j], s[j], lo, hi, depth + 1))
    return False


def meet(a: Shape, b: Shape) -> bool:
    """Whether two closed shapes have a point in common."""
    ax, bx = box(a), box(b)
    if ax[2] < bx[0] or bx[2] < ax[0] or ax[3] < bx[1] or bx[3] < ax[1]:
        return False
    return crossing(edges(a), edges(b)) or bool(inside(b, rings(a)[0][:1])[0]) or bool(inside(a, rings(b)[0][:1])[0]) or any(bool(inside(b, p[0][:1])[0]) for p in a) or any(bool(inside(a, p[0][:1])[0]) for p in b)


def clipped(shape: Shape, convex: np.ndarray) -> list[np.ndarray]:
    """The rings cut to a convex anticlockwise ring; with the even-odd rule they bound the intersection."""
    out = []
    for ring in rings(shape):
        for k in range(len(convex)):
            if not len(ring):
                break
            a, d = convex[k], convex[(k + 1) % len(convex)] - convex[k]
            side = _cross(d, ring - a)
            after, far = np.roll(ring, -1, axis=0), np.roll(side, -1)
            change = (side >= 0) != (far >= 0)
            t = np.where(change, side / np.where(change, side - far, 1), 0)
            cut = ring + t[:, None] * (after - ring)
            both = np.stack([ring, cut], 1).reshape(-1, 2)
            ring = both[np.stack([side >= 0, change], 1).ravel()]
        if len(ring) >= 3:
            out.append(ring)
    return out


def _at(groups: list[list[np.ndarray]], y: float) -> list[tuple[float, float]]:
    """Intervals of a horizontal line in each group of rings (even-odd)."""
    found = []
    for own in groups:
        p = np.concatenate(own)
        q = np.concatenate([np.roll(r, -1, axis=0) for r in own])
        over = (p[:, 1] > y) != (q[:, 1] > y)
        p, q = p[over], q[over]
        x = np.sort(p[:, 0] + (y - p[:, 1]) / (q[:, 1] - p[:, 1]) * (q[:, 0] - p[:, 0]))
        found += list(zip(x[0::2].tolist(), x[1::2].tolist(), strict=False))
    return found


def union_area(groups: list[list[np.ndarray]]) -> float:
    """Area of the union of groups of rings, each with the even-odd rule.

    Between consecutive heights of corners and crossings the covered length is
    linear, so the length half way up times the height is exact.
    """
    groups = [g for g in groups if g]
    if not groups:
        return 0.0
    p = np.concatenate([r for g in groups for r in g])
    q = np.concatenate([np.roll(r, -1, axis=0) for g in groups for r in g])
    heights = [p[:, 1]]
    if len(groups) > 1:
        d, e = q - p, (q - p)[None]
        den = _cross(d[:, None], e)
        with np.errstate(divide="ignore", invalid="ignore"):
            gap = p[None] - p[:, None]
            t, u = _cross(gap, e) / den, _cross(gap, d[:, None]) / den
        k = np.argwhere((den != 0) & (t > 0) & (t < 1) & (u > 0) & (u < 1))
        heights.append(p[k[:, 0], 1] + t[k[:, 0], k[:, 1]] * d[k[:, 0], 1])
    ys = np.unique(np.concatenate(heights))
    total = 0.0
    for low, high in zip(ys[:-1], ys[1:], strict=True):
        covered, end = 0.0, -np.inf
        for a, b in sorted(_at(groups, (low + high) / 2)):
            if b > end:
                covered += b - max(a, end)
                end = b
        total += covered * (high - low)
    return float(total)


def ring_area(ring: np.ndarray) -> float:
    return 0.5 * float(_cross(ring, np.roll(ring, -1, axis=0)).sum())


def anticlockwise(ring: np.ndarray) -> np.ndarray:
    return ring if ring_area(ring) >= 0 else ring[::-1]


def interior_point(shape: Shape) -> np.ndarray:
    """A point inside: the middle of the widest stretch at half height of the largest polygon."""
    best = max(shape, key=lambda p: abs(ring_area(p[0])))
    ys = np.unique(np.concatenate(best)[:, 1])
    middle = (ys[0] + ys[-1]) / 2
    k = max(1, int(np.searchsorted(ys, middle)))
    y = (ys[k - 1] + ys[min(k, len(ys) - 1)]) / 2
    a, b = max(_at([best], y), key=lambda s: s[1] - s[0])
    return np.array([(a + b) / 2, y])


def faults(shape: Shape) -> str | None:
    """What makes a shape invalid, or None: too few points, numbers that are not finite, rings that cross or stand outside their shell."""
    if not shape or any(not p for p in shape):
        return "empty"
    for polygon in shape:
        for ring in polygon:
            if len(ring) < 3 or not np.isfinite(ring).all() or ring_area(ring) == 0:
                return "degenerate ring"
        p, q = edges([polygon])
        if crossing((p, q), (p, q), proper=True):
            return "self-intersection"
        for hole in polygon[1:]:
            beyond = hole[~inside([[polygon[0]]], hole)]
            for k in range(0, len(beyond), 64):
                if not on_edge([[polygon[0]]], beyond[k : k + 64]).all():
                    return "hole outside its shell"
    return None
