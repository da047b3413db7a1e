"""Between places on the sphere and hexagonal cells, vectorised over numpy arrays.

The grid is laid out on the 20 faces of an icosahedron in gnomonic projection.
Within a face, positions are complex numbers in units of the distance between
resolution-0 cells, the real axis pointing at a corner. A cell's centre is its
base cell's home position plus one step for each digit, a step of resolution r
being ``7 ** (-r / 2)`` long and turned by ``TURN`` at odd resolutions. What lies
beyond a face's edge is unfolded to the face beside it: the two share a plane
when turned about the common edge. Around the 12 corners five faces meet, so that
a sixth of the plane is cut out there. All tables come from the face positions.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from hexsupport.functions.bits import FINEST, PENTAGONS

#: Fixed values of the public grid: latitude and longitude of each face's centre, and the azimuth of its first corner (radians).
FACES = (
    (0.803582649718989942, 1.248397419617396099, 5.619958268523939882),
    (1.307747883455638156, 2.536945009877921159, 5.760339081714187279),
    (1.054751253523952054, -1.347517358900396623, 0.780213654393430055),
    (0.600191595538186799, -0.450603909469755746, 0.430469363979999913),
    (0.491715428198773866, 0.401988202911306943, 6.130269123335111400),
    (0.172745327415618701, 1.678146885280433686, 2.692877706530642877),
    (0.605929321571350690, 2.953923329812411617, 2.982963003477243874),
    (0.427370518328979641, -1.888876200336285401, 3.532912002790141181),
    (-0.079066118549212831, -0.733429513380867741, 3.494305004259568154),
    (-0.230961644455383637, 0.506495587332349035, 3.003214169499538391),
    (0.079066118549212831, 2.408163140208925497, 5.930472956509811562),
    (0.230961644455383637, -2.635097066257444203, 0.138378484090254847),
    (-0.172745327415618701, -1.463445768309359553, 0.448714947059150361),
    (-0.605929321571350690, -0.187669323777381622, 0.158629650112549365),
    (-0.427370518328979641, 1.252716453253507838, 5.891865957979238535),
    (-0.600191595538186799, 2.690988744120037492, 2.711123289609793325),
    (-0.491715428198773866, -2.739604450678486295, 3.294508837434268316),
    (-0.803582649718989942, -1.893195233972397139, 3.804819692245439833),
    (-1.307747883455638156, -0.604647643711872080, 3.664438879055192436),
    (-1.054751253523952054, 1.794075294689396615, 2.361378999196363184),
)
#: Fixed values of the public grid: home face and place of the base cells that several faces share.
SHARED_HOMES = {
    1: (2, "110"), 4: (0, "200"), 5: (1, "110"), 11: (1, "011"), 13: (3, "110"), 14: (11, "200"), 19: (2, "011"), 22: (0, "110"), 24: (10, "200"), 28: (4, "110"), 30: (0, "011"),
    35: (11, "110"), 38: (12, "200"), 39: (6, "101"), 40: (7, "101"), 43: (3, "011"), 49: (14, "200"), 52: (10, "110"), 53: (4, "011"), 54: (12, "110"), 58: (13, "200"), 63: (6, "200"),
    67: (5, "101"), 68: (16, "011"), 69: (8, "101"), 72: (7, "200"), 78: (15, "011"), 81: (14, "110"), 82: (13, "110"), 83: (5, "200"), 86: (9, "101"), 91: (17, "011"), 93: (16, "101"),
    97: (8, "200"), 99: (17, "101"), 102: (19, "011"), 107: (9, "200"), 108: (15, "101"), 110: (18, "011"), 116: (18, "101"), 117: (19, "200"), 120: (19, "101"),
}
#: Distance of resolution-0 cells in the gnomonic plane, and the turn of odd resolutions.
UNIT, TURN = 0.381966011250105, 0.3334731722518321
_THIRD = np.exp(2j * np.pi / 3)
#: A digit's step: digits are the sums of the axes i, j, k as bits 4, 2, 1.
STEPS = np.array([(d >> 2 & 1) + (d >> 1 & 1) * _THIRD + (d & 1) * _THIRD**2 for d in range(7)])
SIXTH = np.exp(1j * np.pi / 3)
_SEVENTH = np.sqrt(7.0)


def scale(res: int) -> complex:
    """The step of a resolution: its length and turn."""
    return _SEVENTH**-res * np.exp(1j * TURN * (res % 2))


def to_xyz(lat, lng) -> np.ndarray:
    return np.stack([np.cos(lat) * np.cos(lng), np.cos(lat) * np.sin(lng), np.sin(lat)], -1)


def _nearest(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lattice place (u, v), with centre ``u - v / 2 + v * sqrt(3) / 2 * i``, nearest to each number."""
    b = z.imag / (np.sqrt(3) / 2)
    a = z.real + b / 2
    # differences of the three axes sum to zero; the one rounded most follows from the others
    x, y, w = a - b, b, -a
    rx, ry, rw = np.round(x), np.round(y), np.round(w)
    dx, dy, dw = np.abs(rx - x), np.abs(ry - y), np.abs(rw - w)
    big = (dx > dy) & (dx > dw)
    rx = np.where(big, -ry - rw, rx)
    ry = np.where(~big & (dy > dw), -rx - rw, ry)
    return rx + ry, ry


def _centre(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    return u + v * _THIRD


class Layout:
    """All tables of the grid."""

    def __init__(self):
        faces = np.array(FACES)
        self.centre = to_xyz(faces[:, 0], faces[:, 1])
        lat, lng, az = faces.T
        north = np.stack([-np.sin(lat) * np.cos(lng), -np.sin(lat) * np.sin(lng), np.cos(lat)], -1)
        east = np.stack([-np.sin(lng), np.cos(lng), np.zeros_like(lng)], -1)
        # azimuths turn clockwise from north, the plane's angles the other way round from the first corner
        self.real = np.cos(az)[:, None] * north + np.sin(az)[:, None] * east
        self.imag = np.sin(az)[:, None] * north - np.cos(az)[:, None] * east
        corners = 2 * _THIRD ** np.arange(3)
        at = self.from_plane(np.repeat(np.arange(20), 3), np.tile(corners, 20)).reshape(20, 3, 3)
        #: By face and edge (0: opposite the third corner, and so on): the face beside it, and z -> a * z + b into it.
        self.beside = np.zeros((20, 3), int)
        self.into = np.zeros((20, 3, 2), complex)
        for f in range(20):
            for e in range(3):
                ends = (e, (e + 1) % 3)
                for g in range(20):
                    match = [int(np.argmax(at[g] @ at[f, c])) for c in ends]
                    if g != f and all(at[g, m] @ at[f, c] > 1 - 1e-9 for m, c in zip(match, ends, strict=True)):
                        p, q = corners[list(ends)], corners[match]
                        a = (q[1] - q[0]) / (p[1] - p[0])
                        self.beside[f, e], self.into[f, e] = g, (a, q[0] - a * p[0])
        places = {f"{i}{j}{k}": complex(i + j * _THIRD + k * _THIRD**2) for i in range(3) for j in range(3) for k in range(3)}
        ten = ["000", "100", "010", "001", "110", "011", "101", "200", "020", "002"]
        where = [(f, n, self.from_plane(np.array([f]), np.array([places[n]]))[0]) for f in range(20) for n in ten]
        kinds: list[np.ndarray] = []
        for _, _, x in where:
            if not any(x @ y > 1 - 1e-9 for y in kinds):
                kinds.append(x)
        kinds.sort(key=lambda x: -x[2])  # base cells are numbered from north to south
        self.base = np.array(kinds)
        self.home_face, self.home = np.zeros(122, int), np.zeros(122, complex)
        #: By face and place: the base cell, the number of its corner's step around (0 elsewhere), and z -> a * z + b into the home plane.
        self.found: dict[tuple[int, int, int], tuple[int, int, complex, complex]] = {}
        own: dict[int, list] = {}
        for f, n, x in where:
            own.setdefault(int(np.argmax(self.base @ x)), []).append((f, n))
        for b, at_ in own.items():
            f, n = at_[0] if len(at_) == 1 else SHARED_HOMES[b]
            self.home_face[b], self.home[b] = f, places[n]
        #: By corner base cell and step -3..1 around it: the face and z -> a * z + b from the home plane.
        self.around: dict[int, dict[int, tuple[int, complex, complex]]] = {}
        for b in PENTAGONS:
            self.around[b] = {0: (int(self.home_face[b]), 1 + 0j, 0j)}
            for sign in (1, -1):
                f, a, c = self.around[b][0]
                for m in range(1, 2 if sign > 0 else 4):
                    corner = a * self.home[b] + c
                    # going around, the next edge is the one on that side of the corner
                    e = int(np.argmin(np.abs(corners - corner)))
                    edge = (e + 2) % 3 if sign > 0 else e
                    g, (x, y) = int(self.beside[f, edge]), self.into[f, edge]
                    f, a, c = g, x * a, x * c + y
                    self.around[b][sign * m] = (f, a, c)
        for b, at_ in own.items():
            for f, n in at_:
                u, v = _nearest(np.array([places[n]]))
                key = (f, int(u[0]), int(v[0]))
                if b in PENTAGONS:
                    m, (_, a, c) = next((m, t) for m, t in self.around[b].items() if t[0] == f)
                    self.found[key] = (b, m, 1 / a, -c / a)
                elif f == self.home_face[b]:
                    self.found[key] = (b, 0, 1 + 0j, 0j)
                else:
                    e = next(e for e in range(3) if self.beside[f, e] == self.home_face[b] and abs(self.into[f, e][0] * places[n] + self.into[f, e][1] - self.home[b]) < 1e-9)
                    self.found[key] = (b, 0, *self.into[f, e])
        # a cell near an edge may belong to a base cell whose place is beyond it
        normals = SIXTH * _THIRD ** np.arange(3)
        for f in range(20):
            for z in {p for p in places.values() if abs(abs(p) - np.sqrt(3)) < 1e-9}:
                e = int((z / normals).real.argmax())
                x, y = self.into[f, e]
                u, v = _nearest(np.array([z, x * z + y]))
                b, m, a, c = self.found[int(self.beside[f, e]), int(u[1]), int(v[1])]
                self.found[f, int(u[0]), int(v[0])] = (b, m, a * x, a * y + c)

    def to_plane(self, face: np.ndarray, xyz: np.ndarray) -> np.ndarray:
        """Gnomonic positions on the given faces."""
        x, y, w = (np.einsum("ij,ij->i", axis[face], xyz) for axis in (self.real, self.imag, self.centre))
        return (x + 1j * y) / w / UNIT

    def from_plane(self, face: np.ndarray, z: np.ndarray) -> np.ndarray:
        xyz = self.centre[face] + UNIT * (z.real[:, None] * self.real[face] + z.imag[:, None] * self.imag[face])
        return xyz / np.linalg.norm(xyz, axis=1, keepdims=True)

    def unfold(self, base: np.ndarray, z: np.ndarray, bent: np.ndarray) -> np.ndarray:
        """Places on the sphere of positions in the home planes of base cells."""
        return self.from_plane(*self.on_faces(base, z, bent))

    def between(self, face: np.ndarray, z: np.ndarray, other: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(whether there is one, place on the sphere) of the points where straight ways from ``z`` on a face to ``w`` on another cross their common edge, apart from both ends."""
        found, at = np.zeros(len(z), bool), np.zeros((len(z), 3))
        normals = SIXTH * _THIRD ** np.arange(3)
        for e in range(3):
            k = np.flatnonzero((face != other) & (self.beside[face, e] == other))
            a, b = self.into[face[k], e].T
            end = (w[k] - b) / a  # in the plane of the first face
            near, far = (z[k] / normals[e]).real - 1, (end / normals[e]).real - 1
            cut = (near < -1e-9) & (far > 1e-9)
            k, t = k[cut], (-near / np.where(cut, far - near, 1))[cut]
            found[k], at[k] = True, self.from_plane(face[k], z[k] + t * (end[cut] - z[k]))
        return found, at

    def on_faces(self, base: np.ndarray, z: np.ndarray, bent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(face, position on it) of positions in the home planes of base cells.

        ``bent``: around a corner, whether the position belongs to the digits that
        are counted beyond the cut, and so is turned back by a sixth.
        """
        face, z = self.home_face[base].copy(), z.copy()
        corner = np.isin(base, PENTAGONS)
        if corner.any():
            c = np.flatnonzero(corner)
            arm = z[c] - 2
            arm = np.where(bent[c], arm / SIXTH, arm)
            turn = np.angle(-arm) * 180 / np.pi  # from the home face's centre; -210 to 90 goes once around
            turn = np.where(turn > 90 + 1e-9, turn - np.where(bent[c], 300, 360), turn)
            turn = np.where(turn < -210 - 1e-9, turn + 300, turn)
            spot = 2 - np.abs(arm) * np.exp(1j * turn * np.pi / 180)
            step = np.clip(np.round(turn / 60), -3, 1).astype(int)
            for b, m in {(int(b), int(m)) for b, m in zip(base[c], step, strict=True)}:
                k = (base[c] == b) & (step == m)
                f, x, y = self.around[b][m]
                face[c[k]], z[c[k]] = f, x * spot[k] + y
        flat = ~corner
        normals = SIXTH * _THIRD ** np.arange(3)  # edge e lies at a distance of 1 in direction 60 + 120 e
        for _ in range(4):
            beyond = (z[:, None] / normals).real - 1
            edge = beyond.argmax(axis=1)
            out = flat & (beyond[np.arange(len(z)), edge] > 1e-12)
            if not out.any():
                break
            t = self.into[face[out], edge[out]]
            z[out] = t[:, 0] * z[out] + t[:, 1]
            face[out] = self.beside[face[out], edge[out]]
        return face, z


@lru_cache(maxsize=1)
def layout() -> Layout:
    return Layout()


def digits_of(cell: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(resolution, base cell, digits as 15 columns) of cells."""
    cell = cell.astype(np.int64)
    places = 3 * (FINEST - np.arange(1, FINEST + 1))
    return (cell >> 52) & 15, (cell >> 45) & 127, (cell[:, None] >> places) & 7


def _position(cell: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(base cell, resolution, position in the home plane, whether the digits are those beyond the cut)."""
    res, base, digits = digits_of(cell)
    used = np.arange(1, FINEST + 1) <= res[:, None]
    z = layout().home[base].copy()
    for r in range(1, FINEST + 1):
        z += np.where(used[:, r - 1], STEPS[np.minimum(digits[:, r - 1], 6)], 0) * scale(r)
    real = np.where(used, digits, 0)
    lead = real[np.arange(len(real)), (real > 0).argmax(axis=1)]
    return base, res, z, np.isin(base, PENTAGONS) & (lead == 5)


def _lat_lng(xyz: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.degrees(np.arcsin(np.clip(xyz[:, 2], -1, 1))), np.degrees(np.arctan2(xyz[:, 1], xyz[:, 0]))


def centres(cell: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Latitudes and longitudes, in degrees, of cell centres."""
    base, _, z, bent = _position(cell)
    return _lat_lng(layout().unfold(base, z, bent))


def boundaries(cell: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lat, lng, number of corners): six columns each, anticlockwise; pentagons use five."""
    base, res, z, bent = _position(cell)
    step = _SEVENTH**-res * np.exp(1j * TURN * (res % 2))
    lat, lng = np.empty((len(cell), 6)), np.empty((len(cell), 6))
    _, _, digits = digits_of(cell)
    penta = np.isin(base, PENTAGONS) & (np.where(digits < 7, digits, 0).sum(axis=1) == 0)
    for k in range(6):
        # around a corner the directions -30 and 270 are one
        turn = np.exp(1j * np.pi / 6) * SIXTH**k
        at = z + step * turn / np.sqrt(3)
        lat[:, k], lng[:, k] = _lat_lng(layout().unfold(base, at, bent))
    # at odd resolutions it is the fourth and fifth direction that are one
    odd = penta & (res % 2 == 1)
    lat[odd, 4], lng[odd, 4] = lat[odd, 5], lng[odd, 5]
    return lat, lng, np.where(penta, 5, 6)


def outlines(cell: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lat, lng, number of points): as ``boundaries``, with a further point wherever an edge crosses one of the icosahedron, so up to twelve columns.

    Only edges of odd resolutions do so, apart from their ends: corners of even
    ones lie on the icosahedron's edges.
    """
    base, res, z, bent = _position(cell)
    n = boundaries(cell)[2]
    step = _SEVENTH**-res * np.exp(1j * TURN * (res % 2))
    corners = [layout().on_faces(base, z + step * np.exp(1j * np.pi / 6) * SIXTH**k / np.sqrt(3), bent) for k in range(6)]
    odd = (n == 5) & (res % 2 == 1)
    corners[4] = tuple(np.where(odd, last, own) for own, last in zip(corners[4], corners[5], strict=True))
    points, there = [], []
    for k in range(6):
        points.append(layout().from_plane(*corners[k]))
        there.append(k < n)
        # the edge to the next corner; after the last of a pentagon's, to the first
        last = k + 1 == n
        face, at = (np.where(last, corners[0][i], corners[(k + 1) % 6][i]) for i in range(2))
        found, middle = layout().between(*corners[k], face, at)
        points.append(middle)
        there.append(found & (k < n) & (res % 2 == 1))
    order = np.argsort(~np.stack(there, 1), axis=1, kind="stable")
    xyz = np.take_along_axis(np.stack(points, 1), order[..., None], axis=1)
    lat, lng = _lat_lng(xyz.reshape(-1, 3))
    return lat.reshape(-1, 12), lng.reshape(-1, 12), np.stack(there, 1).sum(1)


def _digits_at(z: np.ndarray, res: int, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Digits by column, and the place of resolution 0, of positions in a plane."""
    u, v = _nearest(z / scale(res))
    found = np.zeros((len(z), FINEST), np.int64)
    for r in range(res, 0, -1):
        pu, pv = _nearest(_centre(u, v) * scale(r) / scale(r - 1))
        step = _centre(u, v) - _centre(pu, pv) * scale(r - 1) / scale(r)
        found[:, r - 1] = np.abs(step[:, None] - STEPS).argmin(axis=1)
        u, v = pu, pv
    return found, _centre(u, v)


def cells(lat, lng, res: int) -> np.ndarray:
    """The cells of a resolution that hold places given in degrees."""
    grid = layout()
    xyz = to_xyz(np.radians(np.asarray(lat, float)), np.radians(np.asarray(lng, float)))
    face = (xyz @ grid.centre.T).argmax(axis=1)
    z = grid.to_plane(face, xyz)
    _, top = _digits_at(z, res, None)
    u, v = _nearest(top)
    base, step, a, b = np.zeros(len(z), int), np.zeros(len(z), int), np.ones(len(z), complex), np.zeros(len(z), complex)
    for f, x, y in {(int(f), int(x), int(y)) for f, x, y in zip(face, u, v, strict=True)}:
        k = (face == f) & (u == x) & (v == y)
        base[k], step[k], a[k], b[k] = grid.found[f, x, y]
    z = a * z + b
    digits, _ = _digits_at(z, res, None)
    # around a corner, what starts along the deleted axis, or beyond it on its face, lies beyond the cut
    lead = digits[np.arange(len(z)), (digits > 0).argmax(axis=1)]
    cut = np.isin(base, PENTAGONS) & ((lead == 1) | (lead == 5) & (step == 1))
    if cut.any():
        digits[cut] = _digits_at(2 + (z[cut] - 2) * SIXTH, res, None)[0]
    cell = np.int64(1) << 59 | np.int64(res) << 52 | base.astype(np.int64) << 45
    for r in range(1, FINEST + 1):
        cell = cell | (digits[:, r - 1] if r <= res else np.full(len(z), 7)) << np.int64(3 * (FINEST - r))
    return cell


def neighbours(cell: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index into ``cell``, neighbour) of the cells beside each cell: six, or five of a pentagon."""
    base, res, z, bent = _position(cell)
    own, found = [], []
    for r in np.unique(res).tolist():
        k = np.flatnonzero(res == r)
        for d in range(6):
            at = z[k] + scale(r) * SIXTH**d
            lat, lng = _lat_lng(layout().unfold(base[k], at, bent[k]))
            own.append(k)
            found.append(cells(lat, lng, r))
    own, found = np.concatenate(own), np.concatenate(found)
    pairs = np.unique(np.stack([own, found], 1)[found != cell[own]], axis=0)
    return pairs[:, 0], pairs[:, 1]


def children(cell: np.ndarray) -> np.ndarray:
    """The cells one level below, in one array."""
    res, base, digits = digits_of(cell)
    place = 3 * (FINEST - 1 - res)
    out = []
    lead = np.where(digits < 7, digits, 0).sum(axis=1) == 0
    for d in range(7):
        own = (cell & ~(np.int64(15) << 52) & ~(np.int64(7) << place)) | (res + 1) << 52 | np.int64(d) << place
        out.append(own[~(np.isin(base, PENTAGONS) & lead & (d == 1))])
    return np.concatenate(out)


def ancestor(cell: np.ndarray, res: int) -> np.ndarray:
    return cell & ~(np.int64(15) << 52) | np.int64(res) << 52 | (np.int64(1) << 3 * (FINEST - res)) - 1


def roots() -> np.ndarray:
    """The 122 cells of resolution 0."""
    return np.int64(1) << 59 | np.arange(122, dtype=np.int64) << 45 | (np.int64(1) << 45) - 1
