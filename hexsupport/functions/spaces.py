"""Where edges are straight, and what edges do to many cells at once, in numpy.

A space maps longitudes and latitudes to vectors of three components: unit
vectors of the sphere, where edges are great circles and nothing is special
about the antimeridian or a pole, or ``(x, y, 1)`` of a reference system's plane.
In both, the side of a point from a line is the sign of a determinant. All
functions take flat arrays with one row for each pair of a cell and an edge.
"""

from __future__ import annotations

import numpy as np

from hexsupport.functions.project import from_lng_lat, geodesic, to_lng_lat

#: Radius in radians around the centre of a resolution-0 cell that holds all of its descendants whole; each level has a seventh of the area.
REACH = 1.7 * 1.1 * 1281.256 / 6371.0088


def _dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * b).sum(-1)


def cross3(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    (ax, ay, az), (bx, by, bz) = (np.moveaxis(v, -1, 0) for v in (a, b))
    return np.stack([ay * bz - az * by, az * bx - ax * bz, ax * by - ay * bx], -1)


def cross2(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a[..., 0] * b[..., 1] - a[..., 1] * b[..., 0]


def from_segments(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Distance of the origin from segments in a plane."""
    d = q - p
    t = np.clip(-_dot(p, d) / np.maximum(_dot(d, d), 1e-300), 0, 1)
    return np.hypot(*(p + t[..., None] * d).T).T


def _caps(a: np.ndarray, b: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each stretch of pairs of unit vectors their middle and the greatest angle from it."""
    middle = np.add.reduceat(a + b, starts)
    middle /= np.maximum(np.sqrt(_dot(middle, middle)), 1e-300)[:, None]
    own = np.repeat(middle, np.diff(starts, append=len(a)), axis=0)
    chord = np.sqrt(np.maximum(_dot(a - own, a - own), _dot(b - own, b - own)))
    return middle, 2 * np.arcsin(np.minimum(np.maximum.reduceat(chord, starts) / 2, 1))


class Sphere:
    """Longitude and latitude; edges are the short ways along great circles."""

    crs = 4326

    def at(self, points: np.ndarray) -> np.ndarray:
        lng, lat = np.radians(points[..., 0]), np.radians(points[..., 1])
        return np.stack([np.cos(lat) * np.cos(lng), np.cos(lat) * np.sin(lng), np.sin(lat)], -1)

    def radius(self, points: np.ndarray, res: int) -> np.ndarray:
        return np.full(len(points), REACH * np.sqrt(7.0) ** -res)

    def apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return 2 * np.arcsin(np.minimum(np.sqrt(_dot(a - b, a - b)) / 2, 1))

    def far(self, c: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Angle between points and edges."""
        n = cross3(a, b - a)
        size = np.sqrt(_dot(n, n))
        beside = (_dot(cross3(n, a), c) >= 0) & (_dot(cross3(b, n), c) >= 0) & (size > 0)
        line = np.arcsin(np.minimum(np.abs(_dot(n, c - a)) / np.maximum(size, 1e-300), 1))
        return np.where(beside, line, np.minimum(self.apart(c, a), self.apart(c, b)))

    def local(self, lng: np.ndarray, lat: np.ndarray, v: np.ndarray) -> np.ndarray:
        """Vectors near places, in the plane that touches the sphere there (great circles stay straight)."""
        l, p = np.radians(lng), np.radians(lat)
        up = np.stack([np.cos(p) * np.cos(l), np.cos(p) * np.sin(l), np.sin(p)], -1)
        east = np.stack([-np.sin(l), np.cos(l), np.zeros_like(l)], -1)
        north = np.stack([-np.sin(p) * np.cos(l), -np.sin(p) * np.sin(l), np.cos(p)], -1)
        depth = np.maximum(_dot(v, up), 1e-9)
        return np.stack([_dot(v - up, east), _dot(v - up, north)], -1) / depth[..., None]

    def caps(self, edges: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each stretch of edges a place and the angle around it within which they lie."""
        return _caps(self.at(edges[:, :2]), self.at(edges[:, 2:]), starts)

    def outside(self, edges: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """For each stretch of edges, rings within a hemisphere, a point outside."""
        middle, angle = self.caps(edges, starts)
        if not (angle < np.radians(85)).all():
            raise ValueError("a polygon must lie within 85 degrees of a place")
        aside = np.cross(middle, np.where(np.abs(middle[:, 2:]) < 0.9, [0.36, 0.48, 0.8], [0.8, 0.36, 0.48]))
        aside /= np.sqrt(_dot(aside, aside))[:, None]
        angle = (angle * 1.02 + 1e-7)[:, None]
        return np.cos(angle) * middle + np.sin(angle) * aside

    def cut(self, edges: np.ndarray, c: np.ndarray, r: np.ndarray) -> np.ndarray:
        """Edges that are much longer than ``r``, cut to some ``r`` around ``c``; the others as they are."""
        a, b = self.at(edges[:, :2]), self.at(edges[:, 2:])
        long = self.apart(a, b) > 8 * r
        if long.any():
            n = np.cross(a[long], b[long])
            n /= np.sqrt(_dot(n, n))[:, None]
            foot = c[long] - _dot(c[long], n)[:, None] * n
            foot /= np.sqrt(_dot(foot, foot))[:, None]
            ahead, out = np.cross(n, foot), edges.copy()
            at_a, at_b = (np.arctan2(_dot(v[long], ahead), _dot(v[long], foot)) for v in (a, b))
            lo, hi = np.maximum(at_a, -2 * r[long]), np.minimum(at_b, 2 * r[long])
            for k, t, own in ((0, lo, lo > at_a), (2, hi, hi < at_b)):
                v = np.cos(t)[:, None] * foot + np.sin(t)[:, None] * ahead
                where = np.flatnonzero(long)[own & (lo < hi)]
                v = v[own & (lo < hi)]
                out[where, k], out[where, k + 1] = np.degrees(np.arctan2(v[:, 1], v[:, 0])), np.degrees(np.arcsin(np.clip(v[:, 2], -1, 1)))
            return out
        return edges


class Flat:
    """A reference system's plane, in which edges are straight."""

    def __init__(self, crs: int):
        self.crs = crs

    def at(self, points: np.ndarray) -> np.ndarray:
        return np.concatenate([from_lng_lat(points, self.crs), np.ones((*points.shape[:-1], 1))], -1)

    def radius(self, points: np.ndarray, res: int) -> np.ndarray:
        """The radius around each centre's image that holds the image of all descendants."""
        angle = np.degrees(REACH * np.sqrt(7.0) ** -res)
        turn = np.linspace(0, 2 * np.pi, 12, endpoint=False)
        lat = points[:, 1:] + angle * np.sin(turn)
        wide = angle * np.cos(turn) / np.maximum(np.cos(np.radians(np.minimum(np.abs(points[:, 1:]) + angle, 89))), 0.02)
        with np.errstate(all="ignore"):
            rim = from_lng_lat(np.stack([points[:, :1] + wide, lat], -1), self.crs)
            far = np.sqrt(((rim - from_lng_lat(points, self.crs)[:, None]) ** 2).sum(-1)).max(1) * 1.05
        return np.where((np.abs(lat).max(1) < 89) & np.isfinite(far), far, np.inf)

    def apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.sqrt(_dot(a - b, a - b))

    def far(self, c: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return from_segments((a - c)[..., :2], (b - c)[..., :2])

    def local(self, lng: np.ndarray, lat: np.ndarray, v: np.ndarray) -> np.ndarray:
        return v[..., :2] - from_lng_lat(np.stack([lng, lat], -1), self.crs)

    def caps(self, edges: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As of the sphere, of the edges' ends and points between them, with room."""
        t = np.linspace(0, 1, 5)[:, None]
        between = Sphere().at(to_lng_lat(edges[:, None, :2] * (1 - t) + edges[:, None, 2:] * t, self.crs))
        middle, angle = _caps(between[:, :3].reshape(-1, 3), between[:, 2:].reshape(-1, 3), 3 * starts)
        return middle, angle * 1.1

    def outside(self, edges: np.ndarray, starts: np.ndarray) -> np.ndarray:
        low = np.minimum.reduceat(np.minimum(edges[:, :2], edges[:, 2:]), starts)
        high = np.maximum.reduceat(np.maximum(edges[:, :2], edges[:, 2:]), starts)
        return np.concatenate([low - (high - low) * [0.137, 0.071] - 1, np.ones((len(low), 1))], 1)

    def cut(self, edges: np.ndarray, c: np.ndarray, r: np.ndarray) -> np.ndarray:
        d = edges[:, 2:] - edges[:, :2]
        size = np.sqrt(_dot(d, d))
        long = size > 8 * r
        if not long.any():
            return edges
        d, size, r = d[long] / size[long, None], size[long], r[long]
        foot = _dot(c[long, :2] - edges[long, :2], d)
        lo, hi = np.clip(foot - 2 * r, 0, size), np.clip(foot + 2 * r, 0, size)
        out = edges.copy()
        begin = edges[long, :2]
        out[long, :2] = np.where((lo > 0)[:, None], begin + lo[:, None] * d, begin)
        out[long, 2:] = np.where((hi < size)[:, None], begin + hi[:, None] * d, edges[long, 2:])
        return out


def space(crs: int) -> Sphere | Flat:
    return Sphere() if crs == 4326 else Flat(crs)


def crosses(o: np.ndarray, c: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the ways from ``o`` to ``c`` cross edges ``a`` to ``b``; a corner on the way belongs to one side of it."""
    way, left, right = cross3(o, c - o), a - o, b - o
    out = (_dot(way, left) >= 0) != (_dot(way, right) >= 0)
    k = np.flatnonzero(out)
    o, c, left, right, a, b = o[k], c[k], left[k], right[k], a[k], b[k]
    out[k] = (_dot(cross3(left, right), o) >= 0) != (_dot(cross3(a - c, b - c), c) >= 0)
    return out


def within(place: Sphere | Flat, c: np.ndarray, a: np.ndarray, b: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Whether edges come within ``r`` of points."""
    ends, size = c - a, b - a
    out = _dot(ends, ends) <= (r + 1.6 * np.sqrt(_dot(size, size))) ** 2  # an arc is at most pi / 2 times its chord
    k = np.flatnonzero(out)
    out[k] = place.far(c[k], a[k], b[k]) <= r[k]
    return out


def clip(p: np.ndarray, q: np.ndarray, corners: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(from, to, whether any): the part of each segment in a closed convex anticlockwise ring of its own, as shares of its length."""
    low, high, some = np.zeros(len(p)), np.ones(len(p)), np.ones(len(p), bool)
    for k in range(corners.shape[1]):
        h = corners[:, k]
        d = corners[:, (k + 1) % corners.shape[1]] - h
        a, b = cross2(d, p - h), cross2(d, q - h)
        some &= (a >= 0) | (b >= 0)
        t = a / np.where(a == b, 1, a - b)
        low = np.where((a < 0) & (b >= 0), np.maximum(low, t), low)
        high = np.where((a >= 0) & (b < 0), np.minimum(high, t), high)
    return low, high, some & (low <= high)


def ring_areas(corners: np.ndarray) -> np.ndarray:
    return 0.5 * cross2(corners, np.roll(corners, -1, axis=1)).sum(1)


def _swept(v: np.ndarray, corners: np.ndarray) -> np.ndarray:
    """Area of a ring around the origin between the first corner and the direction ``v``."""
    after = np.roll(corners, -1, axis=1)
    slices = 0.5 * cross2(corners, after)
    k = ((cross2(corners, v[:, None]) >= 0) & (cross2(after, v[:, None]) < 0) & (slices > 0)).argmax(1)
    rows = np.arange(len(v))
    h, d = corners[rows, k], after[rows, k] - corners[rows, k]
    reach = cross2(h, d) / np.where(cross2(v, d) == 0, 1, cross2(v, d))
    return (np.cumsum(slices, axis=1) - slices)[rows, k] + 0.5 * cross2(h, v) * reach


def shadows(p: np.ndarray, q: np.ndarray, corners: np.ndarray) -> np.ndarray:
    """What each segment hides of a convex ring from the origin, which lies in it: positive if the origin is to the left.

    The part of a polygon in the ring is the ring, if the origin is in the
    polygon, or else nothing, less the shadows of the polygon's edges (shells
    anticlockwise, holes clockwise). ``corners``: the ring of each segment.
    """
    low, high, some = clip(p, q, corners)
    a, b = p + low[:, None] * (q - p), p + high[:, None] * (q - p)
    turn = cross2(a, b)
    some &= (turn != 0) & (low < high)
    whole = ring_areas(corners)
    with np.errstate(divide="ignore", invalid="ignore"):
        swept = (_swept(b, corners) - _swept(a, corners)) % whole
    swept = np.where(turn > 0, swept, swept - whole)
    # a short segment's sweep may come out as nothing or all around, by rounding
    swept = np.where(np.abs(swept) > 0.75 * whole, 0, swept)
    return np.where(some, swept - 0.5 * turn, 0)


def metres(lng: np.ndarray, lat: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Longitudes and latitudes in metres east and north of places of their own, equidistant from them."""
    s, az = geodesic(lat, lng, points[..., 1], points[..., 0])
    return np.stack([s * np.sin(az), s * np.cos(az)], -1)
