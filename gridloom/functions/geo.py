"""Affine grids and map projections as column expressions.

x is always the longitude or easting. Supported systems: degrees, web mercator, UTM zones (third-order Krueger
series, below a millimetre inside a zone), and the conic, azimuthal and polar systems of ``CONFORMAL_CONIC``,
``EQUAL_AREA_CONIC``, ``EQUAL_AREA_AZIMUTHAL`` and ``POLAR``. Datums of the same kind (WGS 84, ETRS89, NAD83, GDA94, GDA2020) are
taken as one, as their ellipsoids differ by a tenth of a millimetre; shifts between them (up to two metres) are not applied.
Every formula takes a namespace ``m``, Spark's functions by default, so numpy evaluates the same ones
inside Arrow tasks.
"""

from __future__ import annotations

import math
import re
from types import SimpleNamespace

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

SPARK = SimpleNamespace(sin=F.sin, cos=F.cos, tan=F.tan, asin=F.asin, atan=F.atan, atan2=F.atan2, sinh=F.sinh, cosh=F.cosh, asinh=F.asinh, atanh=F.atanh, sqrt=F.sqrt, log=F.log, exp=F.exp)
NUMPY = SimpleNamespace(sin=np.sin, cos=np.cos, tan=np.tan, asin=np.arcsin, atan=np.arctan, atan2=np.arctan2, sinh=np.sinh, cosh=np.cosh, asinh=np.arcsinh, atanh=np.arctanh, sqrt=np.sqrt, log=np.log, exp=np.exp)

RADIUS, FLATTENING, SCALE = 6378137.0, 1 / 298.257223563, 0.9996
_N = FLATTENING / (2 - FLATTENING)
_A = RADIUS / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_E = 2 * _N**0.5 / (1 + _N)
ALPHA = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16, 13 * _N**2 / 48 - 3 * _N**3 / 5, 61 * _N**3 / 240)
BETA = (_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96, _N**2 / 48 + _N**3 / 15, 17 * _N**3 / 480)
DELTA = (2 * _N - 2 * _N**2 / 3 - 2 * _N**3, 7 * _N**2 / 3 - 8 * _N**3 / 5, 56 * _N**3 / 15)
PI = 3.141592653589793
RAD = PI / 180

# Parameters of the EPSG registry. Degrees: latitude and longitude of origin, standard parallels; false easting, false northing.
CONFORMAL_CONIC = {3112: (0, 134, -18, -36, 0, 0), 2154: (46.5, 3, 49, 44, 700000, 6600000)}
EQUAL_AREA_CONIC = {3577: (0, 132, -18, -36, 0, 0), 5070: (23, -96, 29.5, 45.5, 0, 0), 3005: (45, -126, 50, 58.5, 1000000, 0)}
# Latitude and longitude of origin, false easting and northing.
EQUAL_AREA_AZIMUTHAL = {3035: (52, 10, 4321000, 3210000)}
# Latitude of true scale, longitude that points down (north) or up (south).
POLAR = {3031: (-71, 0), 3976: (-70, 0), 3413: (70, -45), 3995: (71, 0)}
DEGREES = (4326, 4258, 4269, 4283, 7844)
# UTM zones: first code, last code, what to subtract for the zone, south.
ZONES = ((32601, 32660, 32600, False), (32701, 32760, 32700, True), (25828, 25838, 25800, False), (26901, 26923, 26900, False), (28348, 28358, 28300, True), (7846, 7859, 7800, True))


class ProjectionError(ValueError):
    """Scenes or systems that do not go together."""


def apply_affine(gt: Column, col: Column, row: Column) -> tuple[Column, Column]:
    """World coordinates of a pixel position, all six terms."""
    return gt["x0"] + col * gt["xres"] + row * gt["xskew"], gt["y0"] + col * gt["yskew"] + row * gt["yres"]


def invert_affine(gt: Column, x: Column, y: Column) -> tuple[Column, Column]:
    """Pixel position (col, row) of world coordinates."""
    det = gt["xres"] * gt["yres"] - gt["xskew"] * gt["yskew"]
    dx, dy = x - gt["x0"], y - gt["y0"]
    return (dx * gt["yres"] - dy * gt["xskew"]) / det, (dy * gt["xres"] - dx * gt["yskew"]) / det


def aligned(a: Column, b: Column, res: Column) -> Column:
    """Whether two edges are a whole number of pixels apart, to a ten-thousandth."""
    q = F.abs(a - b) / res
    return F.abs(F.rint(q) - q) < 0.0001


def snap_down(v: Column, res) -> Column:
    return res * F.floor(v / res)


def snap_up(v: Column, res) -> Column:
    return res * F.ceil(v / res)


def utm_forward(lon, lat, zone: int, south: bool, m=SPARK):
    """Easting and northing of degrees."""
    phi, dl = lat * RAD, (lon - (zone * 6 - 183)) * RAD
    s = m.sin(phi)
    t = m.sinh(m.atanh(s) - _E * m.atanh(_E * s))
    xi, eta = m.atan2(t, m.cos(dl)), m.atanh(m.sin(dl) / m.sqrt(t * t + 1.0))
    e, n = eta, xi
    for j, a in enumerate(ALPHA, 1):
        e = e + m.cos(xi * (2 * j)) * m.sinh(eta * (2 * j)) * a
        n = n + m.sin(xi * (2 * j)) * m.cosh(eta * (2 * j)) * a
    return e * (SCALE * _A) + 500000.0, n * (SCALE * _A) + (1e7 if south else 0.0)


def utm_inverse(x, y, zone: int, south: bool, m=SPARK):
    """Degrees of easting and northing."""
    xi, eta = (y - (1e7 if south else 0.0)) / (SCALE * _A), (x - 500000.0) / (SCALE * _A)
    a, b = xi, eta
    for j, c in enumerate(BETA, 1):
        a = a - m.sin(xi * (2 * j)) * m.cosh(eta * (2 * j)) * c
        b = b - m.cos(xi * (2 * j)) * m.sinh(eta * (2 * j)) * c
    chi = m.asin(m.sin(a) / m.cosh(b))
    phi = chi
    for j, d in enumerate(DELTA, 1):
        phi = phi + m.sin(chi * (2 * j)) * d
    return m.atan2(m.sinh(b), m.cos(a)) / RAD + (zone * 6 - 183), phi / RAD


def web_forward(lon, lat, m=SPARK):
    return lon * (RADIUS * RAD), m.asinh(m.tan(lat * RAD)) * RADIUS


def web_inverse(x, y, m=SPARK):
    return x / (RADIUS * RAD), m.atan(m.sinh(y / RADIUS)) / RAD


# ---- conic, azimuthal and polar systems ------------------------------------

def _isometric(phi, m):
    return m.asinh(m.tan(phi)) - m.atanh(m.sin(phi) * _E) * _E


def _parallel(phi: float) -> float:
    """Radius of a parallel over that of the equator."""
    return math.cos(phi) / math.sqrt(1 - (_E * math.sin(phi))**2)


def _authalic(s, m):
    """(1 - e^2) times the area integral at sine of latitude s."""
    return (s / (1.0 - s * s * _E**2) + m.atanh(s * _E) / _E) * (1 - _E**2)


def _of_conformal(chi, m):
    """Latitude of a conformal latitude."""
    phi = chi
    for j, d in enumerate(DELTA, 1):
        phi = phi + m.sin(chi * (2 * j)) * d
    return phi


def _of_authalic(beta, m):
    """Latitude of an authalic latitude."""
    e2 = _E**2
    terms = (e2 / 3 + 31 * e2**2 / 180 + 517 * e2**3 / 5040, 23 * e2**2 / 360 + 251 * e2**3 / 3780, 761 * e2**3 / 45360)
    phi = beta
    for j, d in enumerate(terms, 1):
        phi = phi + m.sin(beta * (2 * j)) * d
    return phi


_MATH = SimpleNamespace(sin=math.sin, tan=math.tan, asinh=math.asinh, atanh=math.atanh)
_POLE = _authalic(1.0, _MATH)


class _Conic:
    """Conic systems: a radius that depends on latitude alone, and angles in proportion to longitude."""

    def __init__(self, lat, lon, first, second, x, y):
        self.lat, self.lon, self.x, self.y = lat * RAD, lon, x, y
        self.first, self.second = first * RAD, second * RAD
        self.set()
        self.origin = self.radius(self.lat, _MATH)

    def forward(self, lon, lat, m):
        r, a = self.radius(lat * RAD, m), (lon - self.lon) * (RAD * self.n)
        return m.sin(a) * r + self.x, self.origin - m.cos(a) * r + self.y

    def inverse(self, x, y, m):
        sign = math.copysign(1.0, self.n)
        dx, dy = (x - self.x) * sign, (self.origin - (y - self.y)) * sign
        return m.atan2(dx, dy) / (self.n * RAD) + self.lon, self.latitude(m.sqrt(dx * dx + dy * dy) * sign, m) / RAD


class _ConformalConic(_Conic):
    def set(self):
        a, b = _isometric(self.first, _MATH), _isometric(self.second, _MATH)
        self.n = (math.log(_parallel(self.first)) - math.log(_parallel(self.second))) / (b - a)
        self.scale = RADIUS * _parallel(self.first) / self.n * math.exp(self.n * a)

    def radius(self, phi, m):
        q = _isometric(phi, m) * -self.n
        return (math.exp(q) if m is _MATH else m.exp(q)) * self.scale

    def latitude(self, r, m):
        psi = m.log(r / self.scale) / -self.n
        return _of_conformal(m.atan(m.sinh(psi)), m)


class _EqualAreaConic(_Conic):
    def set(self):
        q1, q2 = (_authalic(math.sin(p), _MATH) for p in (self.first, self.second))
        m1, m2 = _parallel(self.first)**2, _parallel(self.second)**2
        self.n = (m1 - m2) / (q2 - q1)
        self.c = m1 + self.n * q1

    def radius(self, phi, m):
        x = self.c - _authalic(m.sin(phi), m) * self.n
        return (math.sqrt(x) if m is _MATH else m.sqrt(x)) * (RADIUS / self.n)

    def latitude(self, r, m):
        q = (self.c - r * r * (self.n / RADIUS)**2) / self.n
        return _of_authalic(m.asin(q / _POLE), m)


class _EqualAreaAzimuthal:
    def __init__(self, lat, lon, x, y):
        self.lon, self.x, self.y = lon, x, y
        self.r = RADIUS * math.sqrt(_POLE / 2)
        beta = math.asin(_authalic(math.sin(lat * RAD), _MATH) / _POLE)
        self.sin, self.cos = math.sin(beta), math.cos(beta)
        self.d = RADIUS * _parallel(lat * RAD) / (self.r * self.cos)

    def forward(self, lon, lat, m):
        s = _authalic(m.sin(lat * RAD), m) / _POLE
        c, a = m.sqrt(1.0 - s * s), (lon - self.lon) * RAD
        b = m.sqrt(2.0 / (s * self.sin + c * m.cos(a) * self.cos + 1.0)) * self.r
        return b * c * m.sin(a) * self.d + self.x, b * (s * self.cos - c * m.cos(a) * self.sin) / self.d + self.y

    def inverse(self, x, y, m):
        dx, dy = (x - self.x) / self.d, (y - self.y) * self.d
        # Nothing is divided by zero at the origin.
        rho = m.sqrt(dx * dx + dy * dy + 1e-12)
        c = m.asin(rho / (2 * self.r)) * 2.0
        beta = m.asin(m.cos(c) * self.sin + dy * m.sin(c) / rho * self.cos)
        return m.atan2(dx * m.sin(c), rho * m.cos(c) * self.cos - dy * m.sin(c) * self.sin) / RAD + self.lon, _of_authalic(beta, m) / RAD


class _Polar:
    def __init__(self, lat, lon):
        self.sign, self.lon = math.copysign(1.0, lat), lon
        phi = abs(lat) * RAD
        self.scale = RADIUS * _parallel(phi) * math.exp(_isometric(phi, _MATH))

    def forward(self, lon, lat, m):
        r, a = m.exp(-_isometric(lat * (RAD * self.sign), m)) * self.scale, (lon - self.lon) * RAD
        return r * m.sin(a), r * m.cos(a) * -self.sign

    def inverse(self, x, y, m):
        psi = -m.log(m.sqrt(x * x + y * y) / self.scale)
        return m.atan2(x, y * -self.sign) / RAD + self.lon, _of_conformal(m.atan(m.sinh(psi)), m) * self.sign / RAD


_FAMILIES = ((CONFORMAL_CONIC, _ConformalConic), (EQUAL_AREA_CONIC, _EqualAreaConic), (EQUAL_AREA_AZIMUTHAL, _EqualAreaAzimuthal), (POLAR, _Polar))
SYSTEMS = {code: kind(*values) for table, kind in _FAMILIES for code, values in table.items()}


def epsg_of(srs: str | int) -> int:
    """Authority code of "EPSG:n", a number, or WKT that ends in one."""
    text = str(srs).strip()
    if m := re.fullmatch(r"(?i)(?:epsg:)?(\d+)", text):
        return int(m[1])
    codes = re.findall(r'(?i)(?:AUTHORITY\s*\[\s*"EPSG"\s*,\s*"?|ID\s*\[\s*"EPSG"\s*,\s*"?)(\d+)', text)
    if codes:
        return int(codes[-1])
    if m := re.search(r'(?i)"[^"]*WGS[ _]?(?:19)?84[ /_]*UTM[ _]zone[ _](\d+)([NS])', text):
        return (32600 if m[2].upper() == "N" else 32700) + int(m[1])
    raise ProjectionError(f"no authority code in coordinate system {text[:60]!r}")


def same_system(a: str, b: str) -> bool:
    """Equal codes, else equal text up to white space."""
    try:
        return epsg_of(a) == epsg_of(b)
    except ProjectionError:
        return "".join(a.split()) == "".join(b.split())


def linear_unit(code: int) -> str:
    return "degree" if code in DEGREES else "metre"


def _utm(code: int) -> tuple[int, bool] | None:
    return next(((code - less, south) for first, last, less, south in ZONES if first <= code <= last), None)


def to_degrees(code: int, x, y, m=SPARK):
    if code in DEGREES:
        return x, y
    if code == 3857:
        return web_inverse(x, y, m)
    if u := _utm(code):
        return utm_inverse(x, y, *u, m)
    if code in SYSTEMS:
        return SYSTEMS[code].inverse(x, y, m)
    raise ProjectionError(f"EPSG:{code} is not supported")


def from_degrees(code: int, lon, lat, m=SPARK):
    if code in DEGREES:
        return lon, lat
    if code == 3857:
        return web_forward(lon, lat, m)
    if u := _utm(code):
        return utm_forward(lon, lat, *u, m)
    if code in SYSTEMS:
        return SYSTEMS[code].forward(lon, lat, m)
    raise ProjectionError(f"EPSG:{code} is not supported")


def transform(source: int, target: int, x, y, m=SPARK):
    """Coordinates from one system to another."""
    return (x, y) if source == target else from_degrees(target, *to_degrees(source, x, y, m), m)
