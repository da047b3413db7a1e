"""Reference systems from projection strings, in numpy: ``+proj=laea +lat_0=52 +lon_0=10 +ellps=GRS80 ...``.

Formulas on the ellipsoid follow Snyder (1987) and the public guidance note 7-2
on coordinate conversions. A datum is shifted by three or seven parameters.
"""

from __future__ import annotations

import shlex
from functools import lru_cache

import numpy as np

from hexsupport.functions.project import WGS84, geodesic, geodesic_end

#: Semi-major axis and inverse flattening of common ellipsoids.
ELLIPSOIDS = {
    "WGS84": (6378137.0, 298.257223563), "GRS80": (6378137.0, 298.257222101), "airy": (6377563.396, 299.3249646), "bessel": (6377397.155, 299.1528128),
    "clrk66": (6378206.4, 294.9786982139), "clrk80": (6378249.145, 293.465), "intl": (6378388.0, 297.0), "krass": (6378245.0, 298.3), "sphere": (6370997.0, np.inf),
}
#: Metres in a unit of length.
UNITS = {"m": 1.0, "km": 1000.0, "ft": 0.3048, "us-ft": 1200 / 3937}
KINDS = ("longlat", "merc", "tmerc", "utm", "lcc", "aea", "laea", "stere", "aeqd")
DONE = 30


class System:
    """One reference system: ``forward`` from longitude and latitude on WGS84, and ``inverse``."""

    def __init__(self, text: str):
        parts = dict((t.lstrip("+").split("=", 1) + [""])[:2] for t in shlex.split(text))
        self.kind = parts.get("proj", "")
        if self.kind not in KINDS:
            raise ValueError(f"projection {self.kind!r} is not supported; use one of {KINDS}")

        def number(key: str, otherwise: float) -> float:
            try:
                return float(parts.get(key, otherwise))
            except ValueError:
                raise ValueError(f"{key} must be a number in {text!r}") from None

        name = parts.get("ellps", {"WGS84": "WGS84", "NAD83": "GRS80", "NAD27": "clrk66"}.get(parts.get("datum", "WGS84"), ""))
        if "R" in parts:
            self.a, f = number("R", 0), 0.0
        elif name in ELLIPSOIDS or "a" in parts:
            a, rf = ELLIPSOIDS.get(name, ELLIPSOIDS["WGS84"])
            self.a, f = number("a", a), 1 / number("rf", rf) if "b" not in parts else 1 - number("b", 0) / number("a", a)
        else:
            raise ValueError(f"ellipsoid or datum {name or parts.get('datum')!r} is not known; give +a and +rf")
        self.f, self.e = f, float(np.sqrt(f * (2 - f)))
        self.lat0, self.lng0 = number("lat_0", 0), number("lon_0", 0)
        self.east, self.north, self.k = number("x_0", 0), number("y_0", 0), number("k_0", number("k", 1))
        if "to_meter" not in parts and parts.get("units", "m") not in UNITS:
            raise ValueError(f"unit {parts['units']!r} is not known; give +to_meter")
        self.unit = number("to_meter", UNITS.get(parts.get("units", "m"), 1.0))
        self.shift = [float(x) for x in parts["towgs84"].split(",")] if "towgs84" in parts else []
        if len(self.shift) not in (0, 3, 7):
            raise ValueError("towgs84 needs three or seven numbers")
        if self.kind == "utm":
            zone = int(number("zone", 0))
            if not 1 <= zone <= 60:
                raise ValueError("zone must be 1 to 60")
            self.lat0, self.lng0, self.k, self.east, self.north = 0.0, 6 * zone - 183.0, 0.9996, 500_000.0, 10_000_000.0 if "south" in parts else 0.0
        p0, self.polar = np.radians(self.lat0), np.sign(self.lat0) if abs(self.lat0) == 90 else 0
        if self.kind == "lcc":
            first = number("lat_1", self.lat0)
            second = number("lat_2", first)
            m, t = self._m(np.radians([first, second])), self._t(np.radians([first, second]))
            self.n = np.sin(np.radians(first)) if first == second else np.log(m[0] / m[1]) / np.log(t[0] / t[1])
            self.c = m[0] / (self.n * t[0] ** self.n)
            self.r0 = self.a * self.k * self.c * self._t(p0) ** self.n
        elif self.kind == "aea":
            first, second = np.radians(number("lat_1", 29.5)), np.radians(number("lat_2", 45.5))
            m, q = self._m(np.array([first, second])), self._q(np.array([first, second]))
            self.n = np.sin(first) if first == second else (m[0] ** 2 - m[1] ** 2) / (q[1] - q[0])
            self.c = m[0] ** 2 + self.n * q[0]
            self.r0 = self.a * np.sqrt(self.c - self.n * self._q(p0)) / self.n
        elif self.kind == "laea":
            self.qp = self._q(np.pi / 2)
            self.beta0 = np.arcsin(np.clip(self._q(p0) / self.qp, -1, 1))
            self.rq = self.a * np.sqrt(self.qp / 2)
            self.d = 1.0 if self.polar else self.a * self._m(p0) / (self.rq * np.cos(self.beta0))
        elif self.kind == "stere":
            if not self.polar:
                raise ValueError("stere is supported about a pole: lat_0 must be 90 or -90")
            standard = np.radians(abs(number("lat_ts", 90)))
            e = self.e
            # the scale at the pole, or that which is true on a parallel
            self.c = 2 * self.k / np.sqrt((1 + e) ** (1 + e) * (1 - e) ** (1 - e)) if standard >= np.pi / 2 - 1e-12 else self._m(standard) / self._t(standard)
        elif self.kind == "merc":
            standard = np.radians(number("lat_ts", 0))
            self.k = float(self._m(standard)) if standard else self.k
        elif self.kind in ("tmerc", "utm"):
            n = f / (2 - f)
            self.radius = self.k * self.a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
            self.there = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180, 13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440, 61 * n**3 / 240 - 103 * n**4 / 140, 49561 * n**4 / 161280)
            self.back = (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360, n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440, 17 * n**3 / 480 - 37 * n**4 / 840, 4397 * n**4 / 161280)
            self.begin = self._complex(np.array([p0]), np.zeros(1))[0].real

    # auxiliary latitudes

    def _m(self, p):
        return np.cos(p) / np.sqrt(1 - (self.e * np.sin(p)) ** 2)

    def _t(self, p):
        s = self.e * np.sin(p)
        return np.tan(np.pi / 4 - p / 2) / ((1 - s) / (1 + s)) ** (self.e / 2)

    def _from_t(self, t):
        p = np.pi / 2 - 2 * np.arctan(t)
        for _ in range(DONE):
            s = self.e * np.sin(p)
            p = np.pi / 2 - 2 * np.arctan(t * ((1 - s) / (1 + s)) ** (self.e / 2))
        return p

    def _q(self, p):
        s, e = np.sin(p), self.e
        if e == 0:
            return 2 * s
        return (1 - e**2) * (s / (1 - (e * s) ** 2) - np.log((1 - e * s) / (1 + e * s)) / (2 * e))

    def _from_q(self, q):
        p = np.arcsin(np.clip(q / 2, -1, 1))
        for _ in range(DONE):
            s = np.sin(p)
            slope = 2 * np.cos(p) * (1 - self.e**2) / (1 - (self.e * s) ** 2) ** 2
            p = np.clip(p + np.where(np.abs(slope) > 1e-12, (q - self._q(p)) / np.where(np.abs(slope) > 1e-12, slope, 1), 0), -np.pi / 2, np.pi / 2)
        return p

    def _complex(self, p, turn):
        s = np.sin(p)
        t = np.sinh(np.arctanh(np.clip(s, -1 + 1e-16, 1 - 1e-16)) - self.e * np.arctanh(self.e * s))
        z = np.arctan2(t, np.cos(turn)) + 1j * np.arctanh(np.sin(turn) / np.hypot(1, t))
        return z + sum(c * np.sin(2 * (k + 1) * z) for k, c in enumerate(self.there))

    # the plane

    def _plane(self, p, turn):
        """(x, y) before false origins, of latitudes and turns from the central meridian in radians."""
        if self.kind == "merc":
            return self.a * self.k * turn, -self.a * self.k * np.log(self._t(p))
        if self.kind == "lcc":
            r = self.a * self.k * self.c * self._t(p) ** self.n
            return r * np.sin(self.n * turn), self.r0 - r * np.cos(self.n * turn)
        if self.kind == "aea":
            r = self.a * np.sqrt(np.maximum(self.c - self.n * self._q(p), 0)) / self.n
            return r * np.sin(self.n * turn), self.r0 - r * np.cos(self.n * turn)
        if self.kind == "laea":
            if self.polar:
                r = self.a * np.sqrt(np.maximum(self.qp - self.polar * self._q(p), 0))
                return r * np.sin(turn), -self.polar * r * np.cos(turn)
            beta = np.arcsin(np.clip(self._q(p) / self.qp, -1, 1))
            b = self.rq * np.sqrt(2 / np.maximum(1 + np.sin(self.beta0) * np.sin(beta) + np.cos(self.beta0) * np.cos(beta) * np.cos(turn), 1e-12))
            return b * self.d * np.cos(beta) * np.sin(turn), b / self.d * (np.cos(self.beta0) * np.sin(beta) - np.sin(self.beta0) * np.cos(beta) * np.cos(turn))
        if self.kind == "stere":
            r = self.a * self.c * self._t(self.polar * p)
            return r * np.sin(turn), -self.polar * r * np.cos(turn)
        z = self._complex(p, turn)
        return self.radius * z.imag, self.radius * (z.real - self.begin)

    def _sphere(self, x, y):
        """Latitudes and turns of ``(x, y)``."""
        if self.kind == "merc":
            return self._from_t(np.exp(-y / (self.a * self.k))), x / (self.a * self.k)
        if self.kind in ("lcc", "aea"):
            sign = np.sign(self.n)
            r, turn = sign * np.hypot(x, self.r0 - y), np.arctan2(sign * x, sign * (self.r0 - y)) / self.n
            if self.kind == "lcc":
                return self._from_t((r / (self.a * self.k * self.c)) ** (1 / self.n)), turn
            return self._from_q((self.c - (r * self.n / self.a) ** 2) / self.n), turn
        if self.kind == "laea":
            if self.polar:
                return self.polar * self._from_q(self.qp - (x**2 + y**2) / self.a**2), np.arctan2(x, -self.polar * y)
            u, v = x / self.d, y * self.d
            r = np.hypot(u, v)
            c = 2 * np.arcsin(np.clip(r / (2 * self.rq), -1, 1))
            safe = np.where(r > 0, r, 1)
            beta = np.arcsin(np.clip(np.cos(c) * np.sin(self.beta0) + v * np.sin(c) * np.cos(self.beta0) / safe, -1, 1))
            return self._from_q(self.qp * np.sin(beta)), np.arctan2(u * np.sin(c), r * np.cos(self.beta0) * np.cos(c) - v * np.sin(self.beta0) * np.sin(c) + (r == 0))
        if self.kind == "stere":
            return self.polar * self._from_t(np.hypot(x, y) / (self.a * self.c)), np.arctan2(x, -self.polar * y)
        z = y / self.radius + self.begin + 1j * x / self.radius
        z = z - sum(c * np.sin(2 * (k + 1) * z) for k, c in enumerate(self.back))
        goal = np.arcsinh(np.sin(z.real) / np.hypot(np.sinh(z.imag), np.cos(z.real)))
        s = np.tanh(goal)
        for _ in range(DONE):
            s = np.tanh(goal + self.e * np.arctanh(self.e * s))
        return np.arcsin(s), np.arctan2(np.sinh(z.imag), np.cos(z.real))

    # datums

    def _shifted(self, points: np.ndarray, back: bool) -> np.ndarray:
        """Longitude and latitude from WGS84 to this datum, or back, by way of geocentric places; heights are left out."""
        if not self.shift:
            return points
        one, other = (WGS84, (self.a, self.f)) if not back else ((self.a, self.f), WGS84)
        lng, lat = np.radians(points[..., 0]), np.radians(points[..., 1])
        e2 = one[1] * (2 - one[1])
        n = one[0] / np.sqrt(1 - e2 * np.sin(lat) ** 2)
        v = np.stack([n * np.cos(lat) * np.cos(lng), n * np.cos(lat) * np.sin(lng), n * (1 - e2) * np.sin(lat)], -1)
        move, turns, ppm = np.array(self.shift[:3]), np.radians(np.array((self.shift + [0.0] * 4)[3:6]) / 3600), (self.shift + [0.0] * 4)[6]
        rx, ry, rz = turns
        matrix = (1 + ppm * 1e-6) * np.array([[1, -rz, ry], [rz, 1, -rx], [-ry, rx, 1]])  # position vector
        v = v @ matrix.T + move if back else (v - move) @ np.linalg.inv(matrix).T
        e2 = other[1] * (2 - other[1])
        r = np.hypot(v[..., 0], v[..., 1])
        lat = np.arctan2(v[..., 2], r * (1 - e2))
        for _ in range(6):
            n = other[0] / np.sqrt(1 - e2 * np.sin(lat) ** 2)
            lat = np.arctan2(v[..., 2] + e2 * n * np.sin(lat), r)
        return np.stack([np.degrees(np.arctan2(v[..., 1], v[..., 0])), np.degrees(lat)], -1)

    def forward(self, points: np.ndarray) -> np.ndarray:
        own = self._shifted(np.asarray(points, float), False)
        if self.kind == "longlat":
            return own
        if self.kind == "aeqd":
            s, az = geodesic(self.lat0, self.lng0, own[..., 1], own[..., 0], (self.a, self.f))
            x, y = s * np.sin(az), s * np.cos(az)
        else:
            turn = np.radians(own[..., 0] - self.lng0)
            x, y = self._plane(np.radians(own[..., 1]), turn if self.kind == "merc" else (turn + np.pi) % (2 * np.pi) - np.pi)
        return np.stack([x + self.east, y + self.north], -1) / self.unit

    def inverse(self, points: np.ndarray) -> np.ndarray:
        points = np.asarray(points, float)
        if self.kind == "longlat":
            return self._shifted(points, True)
        x, y = points[..., 0] * self.unit - self.east, points[..., 1] * self.unit - self.north
        if self.kind == "aeqd":
            lat, lng = geodesic_end(self.lat0, self.lng0, np.hypot(x, y), np.arctan2(x, y), (self.a, self.f))
            return self._shifted(np.stack([lng, lat], -1), True)
        p, turn = self._sphere(x, y)
        return self._shifted(np.stack([np.degrees(turn) + self.lng0, np.degrees(p)], -1), True)


@lru_cache(maxsize=64)
def system(text: str) -> System:
    return System(text)
