"""Map projections in numpy: geodesic azimuthal, gnomonic, and the supported reference systems."""

from __future__ import annotations

import numpy as np

#: Semi-major axis and flattening of WGS84, and of GRS80.
WGS84 = (6378137.0, 1 / 298.257223563)
GRS80 = (6378137.0, 1 / 298.257222101)
SYSTEMS = (4326, 3857, 7899)


def zone(crs: int) -> tuple[int, bool] | None:
    """The UTM zone of a reference system on WGS84, and whether it is of the south."""
    number, south = (crs - 32700, True) if crs > 32700 else (crs - 32600, False)
    return (number, south) if 1 <= number <= 60 else None


def supported(crs) -> bool:
    """Whether ``crs`` is the number of a known reference system, or a projection string."""
    if isinstance(crs, str):
        from hexsupport.functions.systems import system

        try:
            return system(crs) is not None
        except ValueError:
            return False
    return crs in SYSTEMS or isinstance(crs, int) and zone(crs) is not None


def geodesic(lat0: float, lng0: float, lat, lng, ellipsoid: tuple[float, float] = WGS84) -> tuple[np.ndarray, np.ndarray]:
    """(distance in metres, azimuth) from one place to others on an ellipsoid, in degrees (Vincenty, 1975)."""
    a, f = ellipsoid
    b = a * (1 - f)
    u1, u2 = np.arctan((1 - f) * np.tan(np.radians(lat0))), np.arctan((1 - f) * np.tan(np.radians(lat)))
    span = np.radians(np.asarray(lng, float) - lng0)
    s1, c1, s2, c2 = np.sin(u1), np.cos(u1), np.sin(u2), np.cos(u2)
    lam = span.copy()
    for _ in range(60):
        sl, cl = np.sin(lam), np.cos(lam)
        east, north = c2 * sl, c1 * s2 - s1 * c2 * cl
        sin_s = np.hypot(east, north)
        cos_s = s1 * s2 + c1 * c2 * cl
        sigma = np.arctan2(sin_s, cos_s)
        sin_a = np.where(sin_s > 0, c1 * c2 * sl / np.where(sin_s > 0, sin_s, 1), 0.0)
        cos2_a = 1 - sin_a**2
        mid = np.where(cos2_a > 1e-16, cos_s - 2 * s1 * s2 / np.where(cos2_a > 1e-16, cos2_a, 1), 0.0)
        c = f / 16 * cos2_a * (4 + f * (4 - 3 * cos2_a))
        after = span + (1 - c) * f * sin_a * (sigma + c * sin_s * (mid + c * cos_s * (2 * mid**2 - 1)))
        done = np.abs(after - lam).max(initial=0) < 1e-14
        lam = after
        if done:
            break
    u = cos2_a * (a**2 - b**2) / b**2
    big = 1 + u / 16384 * (4096 + u * (-768 + u * (320 - 175 * u)))
    small = u / 1024 * (256 + u * (-128 + u * (74 - 47 * u)))
    gap = small * sin_s * (mid + small / 4 * (cos_s * (2 * mid**2 - 1) - small / 6 * mid * (4 * sin_s**2 - 3) * (4 * mid**2 - 3)))
    return b * big * (sigma - gap), np.arctan2(east, north)


def geodesic_end(lat0: float, lng0: float, s, az, ellipsoid: tuple[float, float] = WGS84) -> tuple[np.ndarray, np.ndarray]:
    """(latitude, longitude) in degrees of the places at a distance in metres and an azimuth from one place (Vincenty, 1975)."""
    a, f = ellipsoid
    b = a * (1 - f)
    u1 = np.arctan((1 - f) * np.tan(np.radians(lat0)))
    su, cu, ca, sa = np.sin(u1), np.cos(u1), np.cos(az), np.sin(az)
    sigma1, sin_a = np.arctan2(np.tan(u1), ca), cu * sa
    cos2_a = 1 - sin_a**2
    u = cos2_a * (a**2 - b**2) / b**2
    big = 1 + u / 16384 * (4096 + u * (-768 + u * (320 - 175 * u)))
    small = u / 1024 * (256 + u * (-128 + u * (74 - 47 * u)))
    sigma = s / (b * big)
    for _ in range(40):
        mid = np.cos(2 * sigma1 + sigma)
        ss, cs = np.sin(sigma), np.cos(sigma)
        sigma = s / (b * big) + small * ss * (mid + small / 4 * (cs * (2 * mid**2 - 1) - small / 6 * mid * (4 * ss**2 - 3) * (4 * mid**2 - 3)))
    ss, cs, mid = np.sin(sigma), np.cos(sigma), np.cos(2 * sigma1 + sigma)
    lat = np.arctan2(su * cs + cu * ss * ca, (1 - f) * np.hypot(sin_a, su * ss - cu * cs * ca))
    lam = np.arctan2(ss * sa, cu * cs - su * ss * ca)
    c = f / 16 * cos2_a * (4 + f * (4 - 3 * cos2_a))
    turn = lam - (1 - c) * f * sin_a * (sigma + c * ss * (mid + c * cs * (2 * mid**2 - 1)))
    return np.degrees(lat), lng0 + np.degrees(turn)


def azimuthal(lng0: float, lat0: float):
    """Longitudes and latitudes to metres east and north, equidistant from a place."""

    def to(points: np.ndarray) -> np.ndarray:
        s, az = geodesic(lat0, lng0, points[..., 1], points[..., 0])
        return np.stack([s * np.sin(az), s * np.cos(az)], -1)

    return to


def gnomonic(lng0: float, lat0: float):
    """Longitudes and latitudes to a plane in which great circles are straight; what is a quarter turn away or more goes far out."""
    p0, l0 = np.radians(lat0), np.radians(lng0)

    def to(points: np.ndarray) -> np.ndarray:
        p, d = np.radians(points[..., 1]), np.radians(points[..., 0]) - l0
        depth = np.maximum(np.sin(p0) * np.sin(p) + np.cos(p0) * np.cos(p) * np.cos(d), 1e-6)
        return np.stack([np.cos(p) * np.sin(d), np.cos(p0) * np.sin(p) - np.sin(p0) * np.cos(p) * np.cos(d)], -1) / depth[..., None]

    return to


class Conic:
    """Lambert's conformal conic projection with two standard parallels."""

    #: Fixed values of EPSG:7899.
    LAT0, LNG0, FIRST, SECOND, EAST, NORTH = -37.0, 145.0, -36.0, -38.0, 2_500_000.0, 2_500_000.0

    def __init__(self):
        self.a, f = GRS80
        self.e = np.sqrt(f * (2 - f))
        m1, m2 = self._m(self.FIRST), self._m(self.SECOND)
        t0, t1, t2 = self._t(self.LAT0), self._t(self.FIRST), self._t(self.SECOND)
        self.n = np.log(m1 / m2) / np.log(t1 / t2)
        self.f = m1 / (self.n * t1**self.n)
        self.r0 = self.a * self.f * t0**self.n

    def _m(self, lat):
        p = np.radians(lat)
        return np.cos(p) / np.sqrt(1 - (self.e * np.sin(p)) ** 2)

    def _t(self, lat):
        p = np.radians(lat)
        s = self.e * np.sin(p)
        return np.tan(np.pi / 4 - p / 2) / ((1 - s) / (1 + s)) ** (self.e / 2)

    def forward(self, points: np.ndarray) -> np.ndarray:
        r = self.a * self.f * self._t(points[..., 1]) ** self.n
        turn = self.n * np.radians(points[..., 0] - self.LNG0)
        return np.stack([self.EAST + r * np.sin(turn), self.NORTH + self.r0 - r * np.cos(turn)], -1)

    def inverse(self, points: np.ndarray) -> np.ndarray:
        x, y = points[..., 0] - self.EAST, self.r0 - (points[..., 1] - self.NORTH)
        sign = np.sign(self.n)
        r, turn = sign * np.hypot(x, y), np.arctan2(sign * x, sign * y)
        t = (r / (self.a * self.f)) ** (1 / self.n)
        p = np.pi / 2 - 2 * np.arctan(t)
        for _ in range(8):
            s = self.e * np.sin(p)
            p = np.pi / 2 - 2 * np.arctan(t * ((1 - s) / (1 + s)) ** (self.e / 2))
        return np.stack([np.degrees(turn / self.n) + self.LNG0, np.degrees(p)], -1)


class Transverse:
    """Transverse Mercator projection of a UTM zone, by Krueger's series in the third flattening."""

    SCALE, EAST, SOUTH = 0.9996, 500_000.0, 10_000_000.0

    def __init__(self, number: int, south: bool):
        a, f = WGS84
        n = f / (2 - f)
        self.lng0, self.north = 6 * number - 183.0, self.SOUTH if south else 0.0
        self.e = np.sqrt(f * (2 - f))
        self.radius = self.SCALE * a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
        self.there = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
        self.back = (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480)

    def forward(self, points: np.ndarray) -> np.ndarray:
        s, turn = np.sin(np.radians(points[..., 1])), np.radians(points[..., 0] - self.lng0)
        t = np.sinh(np.arctanh(s) - self.e * np.arctanh(self.e * s))
        z = np.arctan2(t, np.cos(turn)) + 1j * np.arctanh(np.sin(turn) / np.hypot(1, t))
        z = z + sum(c * np.sin(2 * (k + 1) * z) for k, c in enumerate(self.there))
        return np.stack([self.EAST + self.radius * z.imag, self.north + self.radius * z.real], -1)

    def inverse(self, points: np.ndarray) -> np.ndarray:
        z = (points[..., 1] - self.north + 1j * (points[..., 0] - self.EAST)) / self.radius
        z = z - sum(c * np.sin(2 * (k + 1) * z) for k, c in enumerate(self.back))
        t = np.sin(z.real) / np.hypot(np.sinh(z.imag), np.cos(z.real))
        turn, goal = np.arctan2(np.sinh(z.imag), np.cos(z.real)), np.arcsinh(t)
        s = np.tanh(goal)
        for _ in range(8):
            s = np.tanh(goal + self.e * np.arctanh(self.e * s))
        return np.stack([np.degrees(turn) + self.lng0, np.degrees(np.arcsin(s))], -1)


def from_lng_lat(points: np.ndarray, crs: int | str) -> np.ndarray:
    if crs == 4326:
        return points
    if isinstance(crs, str):
        from hexsupport.functions.systems import system

        return system(crs).forward(points)
    if crs == 3857:
        return np.stack([np.radians(points[..., 0]), np.arctanh(np.sin(np.radians(points[..., 1])))], -1) * WGS84[0]
    if crs == 7899:
        return Conic().forward(points)
    if supported(crs):
        return Transverse(*zone(crs)).forward(points)
    raise ValueError(f"reference system {crs} is not supported; use one of {SYSTEMS}")


def to_lng_lat(points: np.ndarray, crs: int | str) -> np.ndarray:
    if crs == 4326:
        return points
    if isinstance(crs, str):
        from hexsupport.functions.systems import system

        return system(crs).inverse(points)
    if crs == 3857:
        return np.stack([np.degrees(points[..., 0] / WGS84[0]), np.degrees(np.arctan(np.sinh(points[..., 1] / WGS84[0])))], -1)
    if crs == 7899:
        return Conic().inverse(points)
    if supported(crs):
        return Transverse(*zone(crs)).inverse(points)
    raise ValueError(f"reference system {crs} is not supported; use one of {SYSTEMS}")
